"""Core operators against plain versions of the same, formats, and edge cases."""

import gzip
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import codec, dna, stats, words
from strandframe.functions import containers as ct
from strandframe.functions.hashing import KMER_SEED, MULTIPLIER, canonical_hash, murmur64a, packed_hash
from strandframe.operators import graph, kmers, ordered, skew, unique, unitigs
from strandframe.plans.queries import REG
from strandframe.session import ensure_checkpoint_dir
from strandframe.sources import ranges, sinks
from strandframe.sources import sequences as src
from strandframe.streaming.kmers import count_available, last_updates
from strandframe.streaming.state import read_totals

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMP)


def reads_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, seq string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# ---- scalar functions ----


def test_dna_functions(spark):
    pair = ("TACCACGTTAGGCCCAGCAACAGATCGCG", "CGCGATCTGTTGCTGGGCCTAACGTGGTA")
    assert one(spark, dna.reverse_complement(F.lit(pair[0]))) == pair[1]
    assert one(spark, dna.normalize(F.lit("acgtNn.xR\r\n"))) == "ACGTAAAAA"
    assert one(spark, dna.complement_any(F.lit("ACGTN"))) == "TGCAG"
    assert one(spark, dna.child(F.lit("ATGATCTGC"), F.lit("A"))) == "TGATCTGCA"
    assert one(spark, dna.parent(F.lit("ATGATCTGC"), F.lit("A"))) == "AATGATCTG"
    assert [one(spark, dna.code(F.lit(b))) for b in "ACGTN"] == [0, 1, 2, 3, None]
    assert one(spark, dna.letter(F.lit(2))) == "G"
    assert one(spark, dna.rotate(F.lit("0123456789"), 3)) == "3456789012"
    assert one(spark, dna.lower_range(F.lit("ACGTAC"), 1, 3)) == "AcgtAC"
    assert [one(spark, dna.encoded_length(F.lit("A" * n))) for n in (3, 4, 35)] == [1, 2, 9]
    assert one(spark, dna.gc_ratio(F.lit("GGCA"))) == 0.75 and one(spark, dna.gc_ratio(F.lit(""))) is None
    assert one(spark, dna.observed_key(F.lit("aNt"))) == "AAT"
    assert [one(spark, dna.unit_prefix(F.lit(n))) for n in (999, 1500, 2_000_000, 3_000_000_000)] == ["999", "1.500 k", "2.000 M", "3.000 G"]
    for f in (dna.normalize, dna.reverse_complement, dna.canonical, dna.gc_ratio, dna.codes):
        assert one(spark, f(F.lit(None).cast("string"))) is None


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ACGT", max_size=60))
def test_codec(seq):
    data = codec.pack(seq)
    assert codec.unpack(data, len(seq)) == seq and len(data) == len(seq) * 2 // 8 + 1


def test_more_kmers(spark):
    assert one(spark, dna.set_letter(F.lit("ACGT"), F.lit(2), F.lit("T"))) == "ACTT" and one(spark, dna.mock(5)) == "AAAAA"
    made = [r[0] for r in spark.range(20).select(dna.random_kmer(9)).collect()]
    assert len(set(made)) > 10 and all(set(x) <= set("ACGT") and len(x) == 9 for x in made)
    two = spark.createDataFrame([(p,) for p in ("TTTACG", rc("TTTACG"))], "kmer string")
    assert kmers.partition_by_hash(two, 16).select(F.spark_partition_id()).distinct().count() == 1
    assert {str(r[0]) for r in two.select(canonical_hash(F.col("kmer"))).collect()} == {str(murmur64a(b"CGTAAA\0", KMER_SEED))}


def test_murmur():
    # published test value of the hash: SMHasher's verification code for this variant
    def published(data, seed):
        return murmur64a(data, seed ^ (len(data) * MULTIPLIER & (1 << 64) - 1) ^ len(data))

    hashes = b"".join(published(bytes(range(i)), 256 - i).to_bytes(8, "little") for i in range(256))
    assert published(hashes, 0) & 0xFFFFFFFF == 0x1F0D3804
    assert 0 <= murmur64a(b"ACGT\0", KMER_SEED) < 1 << 64


def test_statistics(spark):
    df = spark.createDataFrame([(i,) for i in range(27)] + [(None,)], "x int")
    p = stats.percentiles(df, "x").first()
    assert (p["p5"], p["p95"], p["p50"]) == (0, 26, 14)
    assert p["p5"] - 0 == 26 - p["p95"]
    assert stats.median(df, "x").first()[0] == 13
    assert stats.percentiles(df, "x", "float").first()["p95"] == 24
    row = stats.ref_stddev(df, "x").first()
    assert row["mean"] == 13 and abs(row["ref_stddev"] - (sum((i - 13) ** 2 for i in range(27)) ** 0.5) / 27) < 1e-9
    none = df.limit(0)
    assert stats.median(none, "x").first()[0] is None and tuple(stats.ref_stddev(none, "x").first()) == (0, 0, 0)
    weighted = spark.createDataFrame([(31, 2), (3000, 1)], "v int, f int")
    got = {r["percentile"]: r["value"] for r in stats.weighted_percentiles(weighted, "v", "f").collect()}
    assert got[30] == 31 and got[70] == 31 and got[95] == 3000


# ---- k-mers and graph ----


def plain_counts(texts, k):
    c = Counter()
    for t in texts:
        for i in range(len(t or "") - k + 1):
            c[min(t[i : i + k], rc(t[i : i + k]))] += 1
    return c


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ACGT", max_size=40), max_size=6))
def test_counts_and_graph(spark, texts):
    k = 5
    df = reads_of(spark, *texts, None)
    want = plain_counts(texts, k)
    assert {r["kmer"]: r["coverage"] for r in kmers.count(df, k).collect()} == want
    near = defaultdict(lambda: [set(), set()])
    for t in texts:
        for s in (t, rc(t)):
            for i in range(len(s) - k):
                near[s[i : i + k]][1].add(s[i + k])
                near[s[i + 1 : i + 1 + k]][0].add(s[i])
    mask = lambda x: sum(1 << "ACGT".index(b) for b in x)
    wanted = {v: (n, mask(near[v][0]), mask(near[v][1])) for v, n in want.items()}
    assert {r["kmer"]: tuple(r)[1:] for r in graph.vertices(df, k).collect()} == wanted
    most, words.MOST = words.MOST, 3  # k-mers as text
    try:
        assert {r["kmer"]: tuple(r)[1:] for r in graph.vertices(df, k).collect()} == wanted
        assert {r["kmer"]: r["coverage"] for r in kmers.count(df, k).collect()} == want
    finally:
        words.MOST = most


@pytest.mark.parametrize("k", [1, 3, 4, 21, 31, 43])
def test_words(spark, k):
    rng = random.Random(k)
    w = words.of(k)
    rows = [("".join(rng.choice("ACGT") for _ in range(k)), rng.randrange(4)) for _ in range(40)]
    df = spark.createDataFrame(rows, "s string, c int").withColumn("word", w.of_text(F.col("s")))
    df = w.with_rc(df.withColumn("arc", w.extend(F.col("word"), F.col("c"))), "word", "t")
    df = w.with_rc(df, "arc", "u", k + 1)
    parts = [F.col("word"), F.col("t"), w.prefix(F.col("arc")), w.suffix(F.col("arc")), w.suffix(F.col("u"))]
    got = df.select("s", "c", w.last(F.col("arc")), *[w.text(x).alias(f"x{i}") for i, x in enumerate(parts)])
    for s, c, last, back, turned, before, after, far in got.collect():
        assert (back, turned, before, after, last, far) == (s, rc(s), s, s[1:] + "ACGT"[c], c, rc(s))


def test_long_reads_as_words(spark, monkeypatch):
    """Reads longer than what is handled at once, characters other than letters, and pieces of a read."""
    rng = random.Random(6)
    text = "".join(rng.choice("ACGTN") for _ in range(words.PART + 3000))
    df = reads_of(spark, text, "AC", None, text[:50])
    clean = text.replace("N", "A")
    assert {r["kmer"]: r["coverage"] for r in kmers.count(df, 21).collect()} == plain_counts([clean, clean[:50]], 21)
    v = graph.vertices(df, 21).agg(F.sum(F.bit_count("parents") + F.bit_count("children"))).first()[0]
    arcs = {min(clean[i : i + 22], rc(clean[i : i + 22])) for i in range(len(clean) - 21)}
    assert v == 2 * len(arcs) - sum(a == rc(a) for a in arcs)  # an arc that is its own mirror image has one end


def test_chunks_change_nothing(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(5000))
    df = reads_of(spark, text)
    whole, cut = (sorted(graph.windows_with_context(df, 21, chunk=c).drop("home").collect()) for c in (1024, 7))
    assert whole == cut and len(whole) == 4980
    got = kmers.extract(df, 21, positions=True).collect()
    assert all(text[r["pos"] : r["pos"] + 21] == r["kmer"] for r in got) and len(got) == 4980


def test_read_and_its_mirror(spark):
    s = "ACGTTGCATTAGACCAGT"
    assert {r["coverage"] for r in kmers.count(reads_of(spark, s, rc(s)), 7).collect()} == {2}
    assert kmers.odd(48) == 49 and kmers.odd(49) == 49


def paths(spark, texts, k=5, least=0, **more):
    df = reads_of(spark, *texts)
    return sorted(tuple(r) for r in unitigs.assemble(df, k, minimum_length=least, **more).collect())


def test_unitig_line_and_cycle(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("ACGT") for _ in range(60))
    k = 11
    # the first and the last k-mer have no arc on one side, so they aren't unitig vertices
    assert paths(spark, [line], k) == [(min(line[1:-1], rc(line[1:-1])), 0)]
    ring = "".join(rng.choice("ACGT") for _ in range(50))
    got = paths(spark, [ring + ring[: k]], k)
    turns = [(x + x)[i : i + len(x)] for x in (ring, rc(ring)) for i in range(len(x))]
    low = min(t + t[: k - 1] for t in turns)
    assert got == [(low, 1)]
    assert paths(spark, ["ACG", None, ""], k) == [] and paths(spark, ["A" * 40], k) in ([], [("A" * k, 1)])


def plain_unitigs(texts, k):
    """Unitigs by walking, from a plain graph with flow-split choices."""
    cov = plain_counts(texts, k)
    near = defaultdict(set)
    for t in texts:
        for s in (t, rc(t)):
            for i in range(len(s) - k):
                near[s[i : i + k]].add(s[i + 1 : i + 1 + k])
    of = lambda x: cov[min(x, rc(x))]
    choice = {}
    for s, ends in near.items():
        strong = [d for d in ends if of(d) >= of(s) // 4]
        if len(strong) == 1 and of(strong[0]) < 8 * of(s) and of(s) < 8 * of(strong[0]):
            choice[s] = strong[0]
    mutual = {(s, d) for s, d in choice.items() if choice.get(rc(d)) == rc(s)}
    marked = {s for s, _ in mutual} & {d for _, d in mutual}
    step = {s: d for s, d in mutual if s in marked and d in marked}
    entered, out, seen = set(step.values()), set(), set()
    for s in sorted(marked - entered):
        path, at = s, s
        seen.add(s)
        while at in step:
            at = step[at]
            seen.add(at)
            path += at[-1]
        out.add((min(path, rc(path)), 0))
    for s in sorted(marked - seen):
        ring, at = [s], step[s]
        while at != s:
            ring.append(at)
            at = step[at]
        low = ring.index(min(ring))
        ring = ring[low:] + ring[:low]
        turned = [rc(x) for x in reversed(ring)]
        low = turned.index(min(turned))
        turned = turned[low:] + turned[:low]
        out.add((min(x[0] + "".join(y[-1] for y in x[1:]) for x in (ring, turned)), 1))
    return sorted(out)


@pytest.mark.parametrize(("k", "most"), [(5, 31), (7, 31), (5, 3)])
def test_unitigs_of_small_graphs(spark, monkeypatch, k, most):
    """Against walking, over crowded graphs with hairpins, short cycles and branches, as numbers and as text."""
    monkeypatch.setattr(words, "MOST", most)
    rng = random.Random(k)
    for n in range(2):
        texts = ["".join(rng.choice("ACGT"[: 2 + n % 3]) for _ in range(rng.randrange(k, 40))) for _ in range(6)]
        ring = "".join(rng.choice("ACGT") for _ in range(rng.randrange(k, 30)))
        texts.append(ring + ring[:k])
        assert paths(spark, texts, k) == plain_unitigs(texts, k)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AC", min_size=1, max_size=30))
def test_least_rotation(text):
    at = unitigs.least_rotation(text)
    assert text[at:] + text[:at] == min(text[i:] + text[:i] for i in range(len(text)))


def test_chains_of_cycles_in_parts(spark, monkeypatch):
    """A cycle and a line whose edges lie in many segments are put together by ranks."""
    rng = random.Random(11)
    ring, line = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 400))
    k, texts = 21, []
    for whole, size in ((ring + ring, 300), (line, 370)):
        texts += [whole[i : i + 30] for i in range(0, size, 3)]
    scattered = lambda e, w: original(e.withColumn("home", F.xxhash64("arc")), w)
    original = unitigs.segments
    monkeypatch.setattr(unitigs, "segments", scattered)
    monkeypatch.setattr(unitigs, "CHUNK", 1)
    assert paths(spark, texts, k) == plain_unitigs(texts, k) and any(c for _, c in plain_unitigs(texts, k))


@pytest.mark.parametrize("least", [1, 2])
def test_unique_kmers_stay_in_their_reads(spark, least):
    """Reads that share some stretches, cut into groups at any place: k-mers that occur once aren't exchanged, totals and
    unitigs are those of all vertices."""
    rng, k = random.Random(7), 9
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [some(25) for _ in range(4)]
    texts = [some(rng.randrange(30)) + rng.choice([x, rc(x)]) + some(rng.randrange(30)) for x in shared * 4]
    texts += [some(n) for n in (k - 1, k, k + 1, k + 2, k + 3, k + 4, 200)] + [some(40)] * 2 + ["A" * 30, "AC" * 20, shared[0] + shared[1][:15] + shared[0][:10]]
    df = reads_of(spark, *texts)
    g = unique.graph(df, k, part=61, bucket=64)
    every = graph.word_vertices(df, k, home=True)
    assert 0 < g.marked.count() < every.count() // 2
    count = lambda d: sorted(tuple(r) for r in d.collect())
    totals = [F.bit_count("parents").alias("p"), F.bit_count("children").alias("c")]
    assert count(g.classes().groupBy("coverage", *totals).agg(F.sum("n"))) == count(every.groupBy("coverage", *totals).agg(F.count(F.lit(1))))
    mine = count(unitigs.assemble_graph(g, k, least, 0))
    assert mine == count(unitigs.assemble_vertices(every, k, least, 0)) and len(mine) > 5
    assert least > 1 or mine == plain_unitigs(texts, k)


def test_stretches_between_marked_kmers_are_chained_whole(spark):
    """unitig_paths: one read with repeated k-mers at both ends and in its middle gives the same paths as all edges, and
    each stretch between them comes as one row, not as edges."""
    rng, k = random.Random(21), 11
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c = some(k + 4), some(k + 4), some(k + 4)
    texts = [a + some(50) + b + some(k - 8) + c, a, rc(b), c]
    g = unique.graph(reads_of(spark, *texts), k)
    assert g.of(unique.RUN).count() == 2
    assert sorted(tuple(r) for r in unitigs.assemble_graph(g, k, minimum_length=0).collect()) == plain_unitigs(texts, k)


def test_names_without_a_table_of_all_vertices(spark, tmp_path, monkeypatch):
    """unitig_names of a table of reads, against walking."""
    rng = random.Random(23)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = some(130)
    texts = [some(60) + shared + some(60), some(50) + rc(shared), some(200)]
    spark.createDataFrame(list(enumerate(texts)), "read_id long, buffer_for_sequence string").write.parquet(str(tmp_path / "sequence_reads.parquet"))
    monkeypatch.setattr(graph, "word_vertices", None)
    got = {r["seq"]: r["name"] for r in REG.queries["unitig_names"](spark, str(tmp_path)).collect()}
    assert got == {s: str(sinks.path_name(s, 21)) for s, _ in plain_unitigs(texts, 21) if len(s) >= 100} and len(got) >= 2


def table_of_reads(spark, place, seed):
    """Reads that share stretches, as a table in a folder, and their texts."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [some(130) for _ in range(3)]
    texts = [some(rng.randrange(90)) + rng.choice([x, rc(x)]) + some(rng.randrange(90)) for x in shared * 3] + [some(200)]
    spark.createDataFrame(list(enumerate(texts)), "read_id long, buffer_for_sequence string").write.parquet(str(place / "sequence_reads.parquet"))
    return texts


def test_tables_of_paths_go_when_used_up(spark, tmp_path):
    """unitig_paths leaves what its result reads: segments, lone vertices and whole reads, not the tables of its steps."""
    texts = table_of_reads(spark, tmp_path, 29)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    df = REG.queries["unitig_paths"](spark, str(tmp_path))
    left = set(folder.glob("table-*")) - before
    assert len(left) == 3
    assert [x.name for t in left for x in t.glob("kind=*")] == [f"kind={unique.WHOLE}"]
    assert sorted(r["seq"] for r in df.collect()) == [s for s, _ in plain_unitigs(texts, 21)]


def test_exchanges_of_names_go_before_segments_are_ranked(spark, tmp_path, monkeypatch):
    """unitig_names: when segments are ranked, no file of an exchange before is left, and the names are right."""
    texts = table_of_reads(spark, tmp_path, 37)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    exchanged = lambda: {n for f in files.getAllFiles().mkString("\n").split("\n") if (n := Path(f).name).startswith("shuffle_")}
    before, left, start = exchanged(), [], unitigs._start

    def seen(parts):
        for _ in range(50):
            if not left or left[-1]:
                left.append(len(exchanged() - before))  # removed a moment after the write
                time.sleep(0.1 if left[-1] else 0)
        return start(parts)

    monkeypatch.setattr(unitigs, "_start", seen)
    got = {r["seq"]: r["name"] for r in REG.queries["unitig_names"](spark, str(tmp_path)).collect()}
    assert left[-1] == 0
    assert got == {s: str(sinks.path_name(s, 21)) for s, _ in plain_unitigs(texts, 21) if len(s) >= 100} and got


@pytest.mark.parametrize("least", [1, 3])
def test_reads_of_equal_text_mark_no_kmers(spark, tmp_path, least):
    """unitig_names: a table that holds each read under several ids marks as many k-mers as one that holds it once; names,
    totals and unitigs count every read."""
    texts = table_of_reads(spark, tmp_path, 41)
    reads = reads_of(spark, *texts * 3, *texts[:4], texts[-1] + "A" * 3)
    once, g = (unique.graph(df, 21) for df in (reads_of(spark, *texts, texts[-1] + "A" * 3), reads))
    assert g.marked.count() == once.marked.count() and g.of(unique.RUN).count() == once.of(unique.RUN).count() > 0
    every = graph.word_vertices(reads, 21, home=True)
    count = lambda d: sorted(tuple(r) for r in d.collect())
    assert count(g.classes().groupBy("coverage").agg(F.sum("n"))) == count(every.groupBy("coverage").agg(F.count(F.lit(1))))
    mine = count(unitigs.assemble_graph(g, 21, least, 0))
    assert mine == count(unitigs.assemble_vertices(every, 21, least, 0)) and len(mine) > 5
    table = spark.read.parquet(str(tmp_path / "sequence_reads.parquet"))
    table.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"), "*").select((F.col("read_id") + F.col("i") * 1000).alias("read_id"), "buffer_for_sequence").write.parquet(str(tmp_path / "more/sequence_reads.parquet"))
    got = {r["seq"]: r["name"] for r in REG.queries["unitig_names"](spark, str(tmp_path / "more")).collect()}
    assert got == {s: str(sinks.path_name(s, 21)) for s, _ in plain_unitigs(texts * 3, 21) if len(s) >= 100} and got


def test_used_up_graph_keeps_what_others_read(spark):
    """A graph that isn't given away can be assembled again, at another least coverage too."""
    rng = random.Random(31)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = some(40)
    texts = [some(30) + shared + some(30), some(20) + rc(shared), some(50)]
    g = unique.graph(reads_of(spark, *texts), 9)
    found = [sorted(tuple(r) for r in unitigs.assemble_graph(g, 9, least, 0).collect()) for least in (1, 2, 1)]
    assert found[0] == found[2] == plain_unitigs(texts, 9) and found[1] != found[0]


def test_flow_split(spark):
    rng = random.Random(5)
    left, right = ("".join(rng.choice("ACGT") for _ in range(30)) for _ in range(2))
    a, b = left + "A" + right, left + "C" + right
    k = 11
    strong = paths(spark, [a] * 10 + [b], k)
    assert any(len(s) == len(a) - 2 for s, _ in strong)
    assert max(len(s) for s, _ in paths(spark, [a] * 5 + [b] * 5, k)) < len(a) - 2


# ---- order and skew ----


def test_ordered(spark):
    rows = [(random.Random(7).randrange(100) * (i % 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = {b: i for i, (a, b) in enumerate(sorted(rows))}
    assert {r["b"]: r["row_index"] for r in ordered.row_index(df, ["a", "b"]).collect()} == want
    dealt = ordered.block_round_robin(df, ["a", "b"], 16, 3).collect()
    assert Counter(r["store_index"] for r in dealt) == dict(enumerate(ordered.store_sizes(500, 3, 16)))
    assert len({(r["store_index"], r["index_in_store"]) for r in dealt}) == 500
    assert ordered.row_index(df.limit(0), ["a"]).count() == 0
    gaps = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "a int, v int")
    assert [r["t"] for r in ordered.running_total(gaps, ["a"], "v", "t").orderBy("a").collect()] == [5, 5, 7]
    assert [r["t"] for r in ordered.running_total(gaps, ["a"], "v", "t", inclusive=False).orderBy("a").collect()] == [0, 5, 5]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_row_index_of_wide_rows(spark, coalesce):
    """Every row keeps its columns and gets a number of its own, with repeated rows and whatever adaptive execution does."""
    df = spark.range(40000).selectExpr("id div 3 as a", "repeat(sha2(cast(id as string), 256), 5) as wide", "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = ordered.row_index(df, ["a"]).selectExpr("count(*) n", "count(distinct row_index) d", "max(row_index) high", "count_if(row_index div 3 = a) right", "count(distinct wide) w").first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert tuple(got) == (40000, 40000, 39999, 40000, 40000)


@pytest.mark.parametrize("parts", ["1", "2", "7", "40"])
def test_totals_by_key(spark, parts):
    rng = random.Random(int(parts))
    rows = []
    for i in range(3000):
        key = rng.choice(["hot"] * 20 + ["b", "c", None, ""])
        rows.append((key, rng.choice([1, 1, 1, 1, 2, 3, None]) if key == "hot" else rng.randrange(40), i if rng.random() < 0.95 else None, rng.choice([None, 1, 5])))
    rows += [r for r in rows if r[2] is not None][:400]
    rows += [("hot", 2, 5, 3)] * 700 + [("hot", 3, None, 5)] * 600  # one row repeated very often, and rows without an id
    want = {}
    seen = set()
    for k, s, r, m in rows:
        if r is not None and (k, s, r) in seen:
            continue
        seen.add((k, s, r))
        e = want.setdefault(k, [0, set(), 0])
        e[0] += 1
        e[1].add(s)
        e[2] += m or 0
    df = spark.createDataFrame(rows, "k string, s long, r long, m int").selectExpr("*", "1 as key", "2 as part", "3 as rows")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(old, (parts, "false", "50"), strict=True):
            spark.conf.set(c, v)
        got = {r["key"]: (r["rows"], r["subs"], r["total"]) for r in skew.totals_by_key(df, "k", "s", "r", "m").collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == {k: (a, len(b), c) for k, (a, b, c) in want.items()}
    assert skew.totals_by_key(df.limit(0), "k", "s", "r", "m").count() == 0
    heavy = skew.heavy_keys(skew.totals_by_key(df, "k", "s", "r"), 0.5).collect()
    assert [r["key"] for r in heavy] == ["hot"]


def test_skew_is_spread(spark):
    """A key with nearly all rows, most of them without an id and many the same, goes to many partitions, none much
    larger than the others."""
    df = spark.range(40000).selectExpr("if(id % 50 = 0, concat('k', id), 'hot') as k", "1 as s", "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as r")
    fold = skew._fold
    acc = spark.sparkContext.accumulator(0)

    def counted(batches):
        n = 0
        for b in batches:
            n += b.num_rows
        acc.add(int(n > 2 * 40000 / 8))
        return iter(())

    skew._fold = counted
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert skew.totals_by_key(df, "k", "s", "r").count() == 0 and acc.value == 0
    finally:
        skew._fold = fold
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["key"]: r["rows"] for r in skew.totals_by_key(df, "k", "s", "r").where("key = 'hot'").collect()}
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(40000) if i % 50]
    assert got == {"hot": ids.count(None) + len(set(ids) - {None})}


# ---- formats ----


def test_fasta(spark, tmp_path):
    text = "junk\nmore junk\n>a one\nACGT\nacg\n>empty\n>b\r\nAC\r\nGT\r\n>c > x\nTTN"
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "y.fasta.gz").write_bytes(gzip.compress(b">z\nAAA\n"))
    got = sorted((r["name"], r["seq"]) for r in src.read_sequences(spark, [str(tmp_path / "x.fa"), str(tmp_path / "y.fasta.gz")]).collect())
    assert got == [("a one", "ACGTacg"), ("b", "ACGT"), ("c > x", "TTN"), ("empty", ""), ("z", "AAA")]


def test_fastq(spark, tmp_path):
    text = "@r1 x\nACGT\n+\n@III\n@r2\nGGCC\n+r2\nIIII\n@r3\r\nTT\r\n+\r\n@@\r\n"
    (tmp_path / "x.fq").write_bytes(text.encode())
    (tmp_path / "y.fastq.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("x.fq", "y.fastq.gz"):
        got = sorted((r["name"], r["seq"]) for r in src.read_sequences(spark, [str(tmp_path / name)]).collect())
        assert got == [("r1 x", "ACGT"), ("r2", "GGCC"), ("r3", "TT")]


@pytest.mark.parametrize("size", [1, 7, 50, 1000, 10**6])
def test_ranges(spark, tmp_path, size):
    """Byte ranges of any size give every record once; quality lines that look like identifiers don't mislead."""
    rng = random.Random(3)
    want = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40)))) for i in range(30)]
    (tmp_path / "a.fq").write_bytes("".join(f"@{n}\n{s}\n+\n{'@+'[i % 2] * len(s)}\n" for i, (n, s) in enumerate(want)).encode())
    (tmp_path / "a.fa").write_bytes(("junk\n" + "".join(f">{n}\r\n{s[:9]}\r\n{s[9:]}\r\n" for n, s in want)).encode().rstrip())
    for name in ("a.fq", "a.fa"):
        path = str(tmp_path / name)
        whole = (tmp_path / name).stat().st_size
        got = [x for at in range(0, whole, size) for x in ranges.RangeReader(path, at, min(whole, at + size)).open()]
        assert got == want
    if size == 1000:
        ranges.register(spark)
        (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@z\nGG\n+\nII\n"))
        paths_ = ",".join(str(tmp_path / x) for x in ("a.fq", "b.fq.gz"))
        df = spark.read.format("sequences").option("range_bytes", 500).load(paths_)
        assert sorted((r["name"], r["seq"]) for r in df.collect()) == sorted([*want, ("z", "GG")])


def test_reader_errors(tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAC\n")
    reader = ranges.RangeReader(str(tmp_path / "a.fa"))
    with pytest.raises(src.InputNotOpen):
        reader.next()
    reader.open()
    with pytest.raises(src.InputAlreadyOpen):
        reader.open()
    assert reader.next() == ("a", "AC")
    with pytest.raises(src.InputAtEnd):
        reader.next()
    reader.close()
    with pytest.raises(src.InputNotFound):
        ranges.RangeReader(str(tmp_path / "b.fa")).open()
    kinds = (src.InputError, src.InputNotFound, src.InputNotSupported, src.InputAlreadyOpen, src.InputNotOpen, src.InputAtEnd)
    assert [k.code for k in kinds] == [-1, -2, -3, -4, -5, -6]


def test_records_of_buffers(spark):
    rows = [(1, "x.fa", "junk\n>a\nAC\n>b\r\nG\r\nT"), (2, None, ""), (3, "x.fq", "@r\nAC\n+\nII\nxx\nGG\n+\nII\n@s\r\nTT\r\n+\r\nII"), (4, "x.fq", None), (None, "y.fq.gz", "@q\n\n+\n\n")]
    df = spark.createDataFrame(rows, "k long, f string, b string").selectExpr("*", "1 as id", "2 as record")
    assert [tuple(r) for r in src.records_of_buffers(df, "fasta", "k", "f", "b").collect()] == [(1, 0, "a", "AC"), (1, 1, "b", "GT")]
    assert sorted(map(tuple, src.records_of_buffers(df, "fastq", "k", "f", "b").collect()), key=str) == [(3, 0, "r", "AC"), (3, 2, "s", "TT"), (None, 0, "q", "")]
    assert src.records_of_buffers(df.limit(0), "fastq", "k", "f", "b").count() == 0


def test_small_functions(spark):
    assert one(spark, dna.reverse_range(F.lit("0123456789"), 2, 4)) == "0143256789" and one(spark, dna.swap(F.lit("abcd"), 3, 1)) == "adcb"
    assert one(spark, dna.swap(F.lit("ab"), 0, 5)) == "ab" and one(spark, dna.reverse_range(F.lit(None).cast("string"), 0, 1)) is None
    v = F.array(*[F.lit(x) for x in (31, 2, 12, 1)])
    assert one(spark, ct.sort_by(v, lambda a, b: a % 10 - b % 10)) in ([31, 1, 2, 12], [1, 31, 2, 12]) and one(spark, ct.any_element(v)) == 31
    assert one(spark, ct.any_element(F.array().cast("array<int>"))) is None
    two = spark.createDataFrame([("ACGTTGCATTAGACCAGTAAC",), (rc("ACGTTGCATTAGACCAGTAAC"),)], "kmer string")
    assert kmers.with_minimizer(two, 21, 8, hashed=True).select("minimizer", "store").distinct().count() == 1
    assert str(one(spark, packed_hash(F.lit("ACGT")))) == str(murmur64a(codec.pack("ACGT"), KMER_SEED))


def test_bucketed_join(spark, tmp_path):
    """Vertices and arcs in tables of the same buckets join without an exchange."""
    df = reads_of(spark, "ACGTTGCATTAGACCAGT", "ACGTTGCATT")
    v = graph.vertices(df, 7)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        a, b = (sinks.write_bucketed(x, name, "kmer", 4) for x, name in ((v, "bucketed_vertices"), (graph.observed_arcs(df, 7), "bucketed_arcs")))
        joined = b.join(a, "kmer")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == b.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("bucketed_vertices", "bucketed_arcs"):
            spark.sql(f"drop table if exists {name}")


def test_formats():
    assert [src.format_of(x) for x in ("a.fa", "a.fasta.gz", "a.fq", "a.fastq.gz")] == ["fasta", "fasta", "fastq", "fastq"]
    with pytest.raises(src.InputNotSupported):
        src.format_of("a.txt")
    with pytest.raises(src.InputNotFound):
        src.read_sequences(None, [])
    src.register_format("plain", (".txt",), lambda spark, paths: None)
    assert src.format_of("a.txt") == "plain" and src.FORMATS.pop("plain")
    assert src.looks_like_identifier("@1424:1:1:2886:1915/1\n") and not src.looks_like_identifier("@" + "I" * 120) and not src.looks_like_identifier("ACGT")


def test_file_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {f"r{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 90))) for i in range(400)}
    (tmp_path / "s.fa").write_text("".join(f">{n}\n{s}\n" for n, s in want.items()))
    (tmp_path / "s.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in want.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        for name in ("s.fa", "s.fq"):
            got = src.read_sequences(spark, [str(tmp_path / name)])
            assert {r["name"]: r["seq"] for r in got.collect()} == want and got.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks(spark, tmp_path):
    df = reads_of(spark, "ACGTTGCATTAGACCAGT", "ACGTTGCATT")
    v = graph.vertices(df, 7)
    sinks.write_coverage_distribution(kmers.histogram(kmers.count(df, 7)), str(tmp_path / "o"))
    assert (tmp_path / "o/coverage_distribution.txt").read_bytes() == b"Coverage\tFrequency\n1\t16\n2\t8\n"
    assert (tmp_path / "o/coverage_distribution.txt-canonical").read_bytes() == b"1 8\n2 4\n"
    sinks.write_summary(graph.summary(v), graph.degree_matrix(v), 7, str(tmp_path / "o"))
    import xml.etree.ElementTree as ET

    root = ET.parse(tmp_path / "o/assembly_graph_summary.xml").getroot()
    assert root.find("vertex_count").text == "24" and len(root.findall("connectivity/class")) == 25
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (80, 161, 100)]
    contigs = spark.createDataFrame([(s, 0) for s in seqs], "seq string, circular int")
    sinks.write_unitigs(contigs, 21, str(tmp_path / "u"))
    back = src.read_fasta(spark, str(tmp_path / "u/*.txt")).collect()
    assert sorted(r["seq"] for r in back) == sorted(seqs)
    lines = [x for p in (tmp_path / "u").glob("*.txt") for x in p.read_text().splitlines()]
    assert max(len(x) for x in lines if x[0] != ">") == 80
    head = next(r["name"] for r in back if r["seq"] == seqs[1])
    assert head.startswith(f"path_{sinks.path_name(seqs[1], 21)} length=161 circular=0 signature=")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_unitigs(contigs, 21, str(tmp_path / "u"))


def test_streaming(spark, tmp_path):
    texts = ["ACGTTGCATTAGACCAGT", "ACGTTGCATT", "TTTTTTTTT"]
    for i, t in enumerate(texts):
        reads_of(spark, t).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r["kmer"]: r["coverage"] for r in count_available(spark, stream, 7).collect()}
    assert got == plain_counts(texts, 7)


@pytest.mark.parametrize("most", [31, 3])
def test_stream_counts_keep_no_state(spark, tmp_path, monkeypatch, most):
    """Batches write their own counts only, whatever came before them; a stream without files has no rows."""
    monkeypatch.setattr(words, "MOST", most)
    texts = ["ACGTTGCATTAGACCAGT", "ACGTTGCATT", "TTTTTTTTT"]
    for i, t in enumerate(texts):
        reads_of(spark, t).write.parquet(str(tmp_path / f"in/{i}"))
    (tmp_path / "none").mkdir()
    of = lambda at: spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(at))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("stream-*"))
    got = {r["kmer"]: r["coverage"] for r in count_available(spark, of(tmp_path / "in/*"), 7).collect()}
    (new,) = set(folder.glob("stream-*")) - before
    assert got == plain_counts(texts, 7)
    assert not (new / "state/state").exists() and len(list((new / "out").glob("batch=*"))) >= 3
    assert count_available(spark, of(tmp_path / "none"), 7).collect() == []


def test_state_of_a_stream(spark, tmp_path):
    rows = [("a", "ACGT"), ("a", None), ("b", ""), (None, "ACG"), ("a", "AC")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "file string, seq string").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("file string, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {tuple(r) for r in last_updates(spark, read_totals(stream), "file", "reads").collect()}
    assert got == {("a", 3, 6), ("b", 1, 0)}


def test_every_query_has_sql():
    assert set(REG.queries) == set(REG.sql)
