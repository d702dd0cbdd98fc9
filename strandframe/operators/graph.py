"""The de Bruijn graph: vertices with coverage and neighbour bits, arcs, degrees, summary, neighbours.

A vertex row is a canonical k-mer; parents and children are bit masks of letters (bit = nucleotide code). Both
masks and the coverage come from one scan and one aggregation with map-side combining, without any join: each
window knows the letters before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna, words

#: Coverage saturates here.
MAX_COVERAGE = 2147483647


def _pieces(k: int, size: int) -> Column:
    """Array of the pieces of s that hold `size` windows each, with the letters around each piece."""
    s, width = F.col("s"), size + k - 1

    def piece(a: Column) -> Column:
        return F.struct(
            s.substr(a + 1, F.lit(width)).alias("s"),
            F.when(a > 0, s.substr(a, F.lit(1))).otherwise(F.col("l")).alias("l"),
            F.when(a + width < F.length(s), s.substr(a + width + 1, F.lit(1))).otherwise(F.col("r")).alias("r"),
        )

    return F.transform(F.sequence(F.lit(0), F.length(s) - k, F.lit(size)), piece)


def windows_with_context(reads: DataFrame, k: int, seq: str = "seq", chunk: int = 1024) -> DataFrame:
    """Columns kmer, before, after, home: each window with the letters around it, empty at the ends of a read, and a
    hash of the piece that it was cut from, which has `chunk` windows at most."""
    out = reads.where(F.length(seq) >= k).select(F.col(seq).alias("s"), F.lit("").alias("l"), F.lit("").alias("r"))
    for size in (chunk * 1024, chunk):
        out = out.select(F.explode(_pieces(k, size)).alias("p")).select("p.s", "p.l", "p.r")
    i = F.col("i")
    return out.select("s", "l", "r", F.xxhash64("s").alias("home"), F.explode(F.sequence(F.lit(1), F.length("s") - k + 1)).alias("i")).select(
        F.col("s").substr(i, F.lit(k)).alias("kmer"),
        F.when(i > 1, F.col("s").substr(i - 1, F.lit(1))).otherwise(F.col("l")).alias("before"),
        F.when(i + k <= F.length("s"), F.col("s").substr(i + k, F.lit(1))).otherwise(F.col("r")).alias("after"),
        "home",
    )


def bit(base: Column) -> Column:
    """Mask of one letter; 0 for the empty string."""
    return (
        F.when(base == "A", F.lit(1)).when(base == "C", F.lit(2)).when(base == "G", F.lit(4)).when(base == "T", F.lit(8)).otherwise(F.lit(0))
    )


def mirror(mask: Column) -> Column:
    """Mask of the complementary letters: the four bits in reverse order."""
    part = lambda b, by: F.shiftleft(mask.bitwiseAND(b), by) if by > 0 else F.shiftright(mask.bitwiseAND(b), -by)
    return part(1, 3) + part(2, 1) + part(4, -1) + part(8, -3)


def letters_of(mask: Column) -> Column:
    """The letters of a mask in the order A, C, G, T."""
    return F.filter(F.array(*[F.lit(x) for x in dna.LETTERS]), lambda x: mask.bitwiseAND(bit(x)) > 0)


def word_vertices(reads: DataFrame, k: int, seq: str = "seq", home: bool = False) -> DataFrame:
    """(word, coverage, parents, children) of canonical k-mers as words. With home, also the lowest hash of the pieces
    that hold the k-mer: neighbours mostly share it, which assembly uses to place them together."""
    if k <= words.MOST:
        oriented_ = words.windows(reads, k, seq, around=True)
    else:
        w = windows_with_context(reads, k, seq)
        w = w.select("kmer", dna.reverse_complement(F.col("kmer")).alias("rc"), bit(F.col("before")).alias("b"), bit(F.col("after")).alias("a"), "home")
        forward = F.col("kmer") <= F.col("rc")
        oriented_ = w.select(
            F.least("kmer", "rc").alias("word"),
            F.when(forward, F.col("b")).otherwise(mirror(F.col("a"))).alias("parents"),
            F.when(forward, F.col("a")).otherwise(mirror(F.col("b"))).alias("children"),
            "home",
        )
    return oriented_.groupBy("word").agg(
        F.least(F.count(F.lit(1)), F.lit(MAX_COVERAGE)).cast("int").alias("coverage"),
        F.bit_or("parents").cast("int").alias("parents"),
        F.bit_or("children").cast("int").alias("children"),
        *([F.min("home").alias("home")] if home else []),
    )


def vertices(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, coverage, parents, children) of canonical k-mers."""
    return word_vertices(reads, k, seq).select(words.of(k).text(F.col("word")).alias("kmer"), "coverage", "parents", "children")


def oriented(vertices_: DataFrame) -> DataFrame:
    """Each vertex on both strands."""
    turned = F.struct(
        dna.reverse_complement(F.col("kmer")).alias("kmer"), F.col("coverage"),
        mirror(F.col("children")).alias("parents"), mirror(F.col("parents")).alias("children"),
    )
    same = F.struct("kmer", "coverage", "parents", "children")
    return vertices_.select(F.explode(F.array(same, turned)).alias("v")).select("v.*")


def arcs(vertices_: DataFrame) -> DataFrame:
    """Distinct oriented arcs (src, dst), both strands, read off the children bits: no shuffle."""
    o = oriented(vertices_).select("kmer", F.explode(letters_of(F.col("children"))).alias("base"))
    return o.select(F.col("kmer").alias("src"), dna.child(F.col("kmer"), F.col("base")).alias("dst"))


def observed_arcs(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Distinct (kmer, type, base) of canonical sources, type CHILD or PARENT."""
    v = vertices(reads, k, seq)
    both = F.array(
        F.struct(F.lit("CHILD").alias("type"), letters_of(F.col("children")).alias("bases")),
        F.struct(F.lit("PARENT").alias("type"), letters_of(F.col("parents")).alias("bases")),
    )
    return v.select("kmer", F.explode(both).alias("x")).select("kmer", "x.type", F.explode("x.bases").alias("base"))


def degree_matrix(vertices_: DataFrame, number: Column | None = None) -> DataFrame:
    """25 rows (parent_count, child_count, frequency) over both strands, zero cells included. number: vertices that a row
    stands for, one by default. The other strand of a
    vertex has the counts in turn, so the strands are united after the aggregation."""
    one = vertices_.groupBy(F.bit_count("parents").alias("p"), F.bit_count("children").alias("c")).agg(F.sum(F.lit(1) if number is None else number).alias("n"))
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("parent_count"), F.col(b).alias("child_count")) for a, b in ("pc", "cp")]))
    counted = one.select("n", sides.alias("s")).groupBy("s.parent_count", "s.child_count").agg(F.sum("n").alias("n"))
    spark = vertices_.sparkSession
    cells = spark.range(25).select(F.floor(F.col("id") / 5).cast("int").alias("parent_count"), (F.col("id") % 5).cast("int").alias("child_count"))
    return cells.join(counted, ["parent_count", "child_count"], "left").select(
        "parent_count", "child_count", F.coalesce("n", F.lit(0)).cast("long").alias("frequency")
    )


def summary(vertices_: DataFrame, number: Column | None = None) -> DataFrame:
    """One row over both strands: vertex_count, vertex_observation_count, arc_count. number: vertices that a row stands
    for, one by default."""
    n = (F.lit(1) if number is None else number).cast("long")
    degree = F.bit_count("children") + F.bit_count("parents")
    return vertices_.agg(
        F.coalesce(F.sum(n) * 2, F.lit(0)).alias("vertex_count"),
        F.coalesce(F.sum(F.col("coverage") * n) * 2, F.lit(0)).alias("vertex_observation_count"),
        F.coalesce(F.sum(degree * n), F.lit(0)).cast("long").alias("arc_count"),
    )


def neighbours(vertices_: DataFrame, side: str) -> DataFrame:
    """(kmer, coverage, neighbour, neighbour_coverage) of canonical vertices; side is 'children' or 'parents'."""
    step = dna.child if side == "children" else dna.parent
    out = vertices_.select("kmer", "coverage", F.explode(letters_of(F.col(side))).alias("base"))
    out = out.withColumn("neighbour", step(F.col("kmer"), F.col("base"))).withColumn("key", dna.canonical(F.col("neighbour")))
    other = vertices_.select(F.col("kmer").alias("key"), F.col("coverage").alias("neighbour_coverage"))
    return out.join(other, "key").select("kmer", "coverage", "neighbour", "neighbour_coverage")


def neighbourhoods(vertices_: DataFrame) -> DataFrame:
    """Each vertex with arrays of its parents and children, at most four each: (kmer, coverage, parents, children)."""
    sides = [neighbours(vertices_, s).withColumn("side", F.lit(s)) for s in ("parents", "children")]
    both = sides[0].unionByName(sides[1])
    one = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("neighbour", "neighbour_coverage"))))
    near = both.groupBy("kmer").agg(one("parents").alias("parents"), one("children").alias("children"))
    return vertices_.select("kmer", "coverage").join(near, "kmer", "left")


def dangling_arcs(vertices_: DataFrame) -> DataFrame:
    """Arcs whose end isn't among the vertices; none of all vertices of some reads, but of a part of them."""
    ends = arcs(vertices_).withColumn("kmer", dna.canonical(F.col("dst")))
    return ends.join(vertices_.select("kmer"), "kmer", "left_anti").select("src", "dst")


def without_flags(vertices_: DataFrame, flags: int, column: str = "flags") -> DataFrame:
    """Vertices that have none of the given flag bits; a null flag column has none."""
    return vertices_.where(F.coalesce(F.col(column), F.lit(0)).bitwiseAND(F.lit(flags)) == 0)
