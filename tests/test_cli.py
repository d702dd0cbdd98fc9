import random

import pytest

from strandframe.cli import main
from strandframe.operators import graph, kmers
from strandframe.sources.sequences import InputNotSupported, read_fasta


def test_commands(spark, tmp_path):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    reads = [genome[i : i + 100] for i in range(0, 501, 10)]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    fq, out = str(tmp_path / "r.fq"), str(tmp_path / "out")
    assert main(["count", "-k", "20", "-o", str(tmp_path / "c"), fq], spark) == 0  # k is made odd
    rows = [tuple(map(int, x.split())) for x in (tmp_path / "c/coverage_distribution.txt-canonical").read_text().splitlines()]
    assert sum(a * b for a, b in rows) == sum(len(r) - 20 for r in reads)
    main(["assemble", "-k", "21", "-o", out, fq], spark)
    assert (tmp_path / "out/assembly_graph_summary.xml").exists()
    (contig,) = read_fasta(spark, f"{out}/unitigs.fasta/*.txt").collect()
    assert len(contig["seq"]) == len(genome) - 2
    with pytest.raises(FileExistsError):
        main(["assemble", "-o", out, fq], spark)
    with pytest.raises(InputNotSupported):
        main(["count", "-o", str(tmp_path / "d"), str(tmp_path / "r.txt")], spark)
    main(["gc", "-o", str(tmp_path / "g"), fq], spark)
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() == 1


def test_assemble_exchanges_no_table_of_all_vertices(spark, tmp_path, monkeypatch):
    """Distribution, summary and degrees come from marked vertices and numbers of the others."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = some(60)
    reads = [some(70) + shared + some(70) for _ in range(3)] + [some(200), some(200), some(21)]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    every = graph.vertices(spark.createDataFrame([(s,) for s in reads], "seq string"), 21)
    frequencies = sorted(tuple(r) for r in kmers.histogram(every).collect())
    s, degrees = graph.summary(every).first(), sorted(tuple(r) for r in graph.degree_matrix(every).collect())
    monkeypatch.setattr(graph, "word_vertices", None)
    main(["assemble", "-k", "21", "-o", str(tmp_path / "out"), str(tmp_path / "r.fq")], spark)
    lines = (tmp_path / "out/coverage_distribution.txt-canonical").read_text().splitlines()
    assert [tuple(map(int, x.split())) for x in lines] == frequencies
    xml = (tmp_path / "out/assembly_graph_summary.xml").read_text()
    assert all(f"<{n}>{s[n]}</{n}>" in xml for n in ("vertex_count", "arc_count", "vertex_observation_count"))
    assert all(f"<parent_count>{p}</parent_count><child_count>{c}</child_count><frequency>{n}</frequency>" in xml for p, c, n in degrees)
