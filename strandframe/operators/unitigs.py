"""Unitigs: flow-split choice, marking, and assembly of maximal simple paths and cycles.

All steps work on words (numbers up to 31 letters) and on arcs, which are words one letter longer. An arc, read on the
strand on which it is lower, has two ends: the vertex that it leaves and, on the other strand, the other vertex that it
leaves. So each step is one aggregation, by arc or by vertex, in place of joins: both coverages of an arc meet by arc,
the candidates of a vertex by vertex, the two choices of an arc by arc, the two sides of a vertex by vertex.

Of k-mers up to 31 letters only those that may occur more than once, and their neighbours, take these steps: see
operators/unique.py. Assembly then chains edges, and stretches of the others, in partitions that are placed by the piece of a read that they come from, where most
neighbours meet, and ranks the few remaining segments by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna, words
from strandframe.functions.words import Text
from strandframe.operators import graph, unique
from strandframe.session import Steps, checkpointed, dropped, settled

#: Fixed values of the heuristic: the repeat multiplier (exclusive) and the divisor of the noise threshold.
REPEAT = 8
NOISE = 4
#: Edges chained at once, in numbers of edges.
CHUNK = 1 << 16
#: The same, in bytes.
CHUNK_BYTES = 1 << 26

#: vertices (word, coverage, children, parents, home), words, least coverage and what keeps a table between two exchanges,
#: if anything does, to the choice (src, code, home).
Strategy = Callable[[DataFrame, Text, int, Callable[[DataFrame], DataFrame] | None], DataFrame]


def _by_arc(out: DataFrame, w: Text, *more: str) -> DataFrame:
    """Rows (src, code, home, more) with arc, on its lower strand, and forward, whether that is the strand of src. Both
    are true of an arc that is its own reverse complement: then backward is too."""
    whole = w.with_rc(out.withColumn("x", w.extend(F.col("src"), F.col("code"))), "x", "r", w.k + 1)
    return whole.select(F.least("x", "r").alias("arc"), (F.col("x") <= F.col("r")).alias("forward"), (F.col("x") >= F.col("r")).alias("backward"), "home", *more)


def _number(n: int) -> Column:
    """Rows numbered 0..n-1 for each row, without any function that leaves generated code."""
    return F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("i")


def _leaving(arcs: DataFrame, w: Text, *more: tuple[str, Column, Column]) -> DataFrame:
    """Both ends of each arc as (src, code, home) of the strand that leaves it, with named columns of either end; one end
    of an arc that is its own reverse complement."""
    both = w.with_rc(arcs, "arc", "r", w.k + 1).select("*", _number(2)).where("i = 0 or arc != r")
    own = F.when(F.col("i") == 0, F.col("arc")).otherwise(F.col("r"))
    ends = [F.when(F.col("i") == 0, a).otherwise(b).alias(name) for name, a, b in more]
    return both.select(own.alias("x"), "home", *ends).select(w.prefix(F.col("x")).alias("src"), w.last(F.col("x")).alias("code"), "home", *[n for n, *_ in more])


def arcs_with_coverage(vertices: DataFrame, w: Text, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Oriented arcs (src, code, home, src_coverage, dst_coverage); code is that of the letter that dst adds. Every arc
    is sent by both of its vertices, so one aggregation brings their coverages together."""
    letters = F.col("children").bitwiseOR(F.shiftleft(graph.mirror(F.col("parents")), 4)).alias("letters")
    each = w.with_rc(vertices, "word", "t").select("word", "t", "coverage", "home", letters, _number(8)).where(F.getbit(F.col("letters"), F.col("i")) == 1)
    ends = each.select(F.when(F.col("i") < 4, F.col("word")).otherwise(F.col("t")).alias("src"), (F.col("i") % 4).alias("code"), "coverage", "home")
    side = lambda flag: F.max(F.when(F.col(flag), F.col("coverage"))).alias(flag)
    arcs = _by_arc(ends, w, "coverage").groupBy("arc").agg(side("forward"), side("backward"), F.min("home").alias("home"))
    arcs = keep(arcs) if keep else arcs
    a, b = F.col("forward"), F.col("backward")
    return _leaving(arcs, w, ("src_coverage", a, b), ("dst_coverage", b, a))


def flow_split(vertices: DataFrame, w: Text, minimum_coverage: int = 1, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """choice (src, code, home): the arc taken from each oriented vertex, if any. With c the coverage of the source, a
    candidate is taken if it is the only one of coverage >= c div 4, and neither coverage reaches 8 times the
    other. (No other candidate can then have the same coverage.)

    Where one candidate is that strong, the maximum over strong candidates is the candidate's own value; numbers
    only, so that the aggregate stays a hash aggregate.
    """
    cc, nc = F.col("src_coverage").cast("long"), F.col("dst_coverage").cast("long")
    strong = nc >= F.floor(cc / NOISE)
    one = lambda x: F.max(F.when(strong, x))
    grouped = arcs_with_coverage(vertices, w, keep).groupBy("src").agg(
        F.count_if(strong).alias("strong"), one(F.col("code")).alias("code"), one(cc).alias("cc"), one(nc).alias("nc"), F.min("home").alias("home")
    )
    fits = (F.col("nc") < F.col("cc") * REPEAT) & (F.col("cc") < F.col("nc") * REPEAT) & (F.col("nc") >= minimum_coverage)
    return grouped.where((F.col("strong") == 1) & fits).select("src", "code", "home")


def highest_coverage(vertices: DataFrame, w: Text, minimum_coverage: int = 1, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The other strategy: the child of highest coverage, the first letter on ties."""
    rank = F.col("dst_coverage").cast("long") * 4 + (3 - F.col("code"))
    best = arcs_with_coverage(vertices, w, keep).groupBy("src").agg(F.max(rank).alias("r"), F.min("home").alias("home"))
    return best.where(F.floor(F.col("r") / 4) >= minimum_coverage).select("src", (3 - F.col("r") % 4).cast("int").alias("code"), "home")


def choices(reads: DataFrame, k: int, strategy: Strategy = flow_split, minimum_coverage: int = 1) -> DataFrame:
    """(src, dst) as text: the arc taken from each oriented vertex of the reads."""
    w = words.of(k)
    taken = strategy(graph.word_vertices(reads, k, home=True), w, minimum_coverage)
    dst = w.suffix(w.extend(F.col("src"), F.col("code")))
    return taken.select(w.text(F.col("src")).alias("src"), w.text(dst).alias("dst"))


def mutual(choice: DataFrame, w: Text) -> DataFrame:
    """(arc, home) of arcs that both of their ends have chosen."""
    sides = _by_arc(choice, w).groupBy("arc").agg(F.max("forward").alias("forward"), F.max("backward").alias("backward"), F.min("home").alias("home"))
    return sides.where("forward and backward").select("arc", "home")


def _sides(mutual_: DataFrame, w: Text, inner: DataFrame | None = None) -> DataFrame:
    """(word, ahead, behind, home) of canonical vertices with a mutual arc on both sides: the unitig vertices. inner:
    more mutual arcs of one side of a vertex, in these columns."""
    ends = _leaving(mutual_, w, ("arc", F.col("arc"), F.col("arc")))
    turned = w.with_rc(ends, "src", "t")
    own = turned.select(F.least("src", "t").alias("word"), F.when(F.col("src") <= F.col("t"), F.col("arc")).alias("a"), F.when(F.col("src") > F.col("t"), F.col("arc")).alias("b"), "home")
    if inner is not None:
        own = own.unionByName(inner.select("word", F.col("ahead").alias("a"), F.col("behind").alias("b"), "home"))
    sides = own.groupBy("word").agg(F.max("a").alias("ahead"), F.max("b").alias("behind"), F.min("home").alias("home"))
    return sides.where("ahead is not null and behind is not null")


def unitig_vertices(reads: DataFrame, k: int, minimum_coverage: int = 1, strategy: Strategy = flow_split) -> DataFrame:
    """kmer, on both strands, of the vertices with a mutual parent and a mutual child."""
    w = words.of(k)
    found = _sides(mutual(strategy(graph.word_vertices(reads, k, home=True), w, minimum_coverage), w), w)
    kmer = w.text(F.col("word"))
    return found.select(F.explode(F.array(kmer, dna.reverse_complement(kmer))).alias("kmer"))


# ---- chains ----------------------------------------------------------------------------------------------------

def _chained(src: pa.Array, dst: pa.Array, letters: pa.StringArray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Chains of segments of which no two leave or enter one vertex: first, last, letters of all but the first, closed."""
    nodes = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
    at = nodes.indices.to_numpy()
    n, edges = len(nodes.dictionary), len(src)
    following, edge = np.full(n, -1), np.full(n, -1)
    following[at[:edges]], edge[at[:edges]] = at[edges:], np.arange(edges)
    entered = np.zeros(n, bool)
    entered[at[edges:]] = True
    heads = np.flatnonzero((following >= 0) & ~entered)
    cyclic = following >= 0
    who, what, lasts = [], [], heads.copy()
    chain, now = np.arange(len(heads)), heads
    while len(now):
        who.append(chain)
        what.append(edge[now])
        cyclic[now] = False
        now = following[now]
        lasts[chain] = now
        goes_on = following[now] >= 0
        chain, now = chain[goes_on], now[goes_on]
    rings = []
    for start in np.flatnonzero(cyclic).tolist():
        if cyclic[start]:
            rings.append(start)
            now = start
            while cyclic[now]:
                cyclic[now] = False
                who.append(np.array([len(heads) + len(rings) - 1]))
                what.append(edge[now : now + 1])
                now = following[now]
    owner = np.concatenate(who) if who else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    text = letters.take(pa.array((np.concatenate(what) if who else owner)[order]))
    firsts = np.concatenate([heads, np.array(rings, np.int64)])
    ends = np.concatenate([lasts, np.array(rings, np.int64)])
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(firsts)))])
    offsets = np.frombuffer(text.buffers()[1], np.int32)[starts] if len(text) else np.zeros(1, np.int32)
    joined = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets.tobytes()), text.buffers()[2] or pa.py_buffer(b""))
    closed = np.arange(len(firsts)) >= len(heads)
    return nodes.dictionary.take(pa.array(firsts)), nodes.dictionary.take(pa.array(ends)), joined, closed


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (src, dst, letters) to longer ones, CHUNK or CHUNK_BYTES of them at once, so that memory doesn't depend
    on the partition."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        first, last, letters, closed = _chained(*(t[c].combine_chunks() for c in ("src", "dst", "letters")))
        return pa.RecordBatch.from_arrays([first, last, letters, pa.array(closed)], ["first", "last", "letters", "closed"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK or sum(x.nbytes for x in held) >= CHUNK_BYTES:
            yield out(held)
            held = []
    if held:
        yield out(held)


def segments(edges: DataFrame, w: Text) -> DataFrame:
    """(first, last, letters, closed): chains of edges (arc, home), on both strands. Edges of one home, which is one piece
    of a read, lie together; a chain may also go on into the next home. Edges may have columns (first, last, text) too:
    then rows without an arc are chains already, on one strand. They are exchanged on one strand."""
    placed = w.with_rc(edges.repartition("home").sortWithinPartitions("home"), "arc", "r", w.k + 1)
    first, arc = F.col("i") == 0, F.col("x")
    src, dst, letters = w.prefix(arc), w.suffix(arc), dna.letter(w.last(arc))
    if "text" in edges.columns:
        placed = w.with_rc(w.with_rc(placed, "first", "first_rc"), "last", "last_rc")
        run = lambda a, b, step: F.when(F.col("x").isNotNull(), step).when(first, a).otherwise(b)
        src, dst = run(F.col("first"), F.col("last_rc"), src), run(F.col("last"), F.col("first_rc"), dst)
        letters = run(F.substr("text", F.lit(w.k + 1)), dna.reverse_complement(F.substr("text", F.lit(1), F.length("text") - w.k)), letters)
    both = placed.select("*", _number(2)).where("i = 0 or arc is null or arc != r").withColumn("x", F.when(first, F.col("arc")).otherwise(F.col("r")))
    return both.select(src.alias("src"), dst.alias("dst"), letters.alias("letters")).mapInArrow(_chain, f"first {w.kind}, last {w.kind}, letters string, closed boolean")


# ---- ranks of segments -----------------------------------------------------------------------------------------


def _rank(state: DataFrame) -> DataFrame:
    """Pointer doubling of (n, nx, d, done) until no more rows end. `done` is a flag of its own: a cycle whose
    length divides a power of two also reaches n = nx."""
    ended = -1
    while True:
        count = state.where("done").count()
        if count == ended:
            return state
        ended = count
        other = state.select(F.col("n").alias("nx"), F.col("nx").alias("nx2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = state.where(~F.col("done")).join(other, "nx").select(
            "n", F.col("nx2").alias("nx"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done")
        )
        state = checkpointed(state.where("done").unionByName(moved))


def _start(parts: DataFrame) -> DataFrame:
    """State of each segment; one that stops, or that no other goes on from, is done."""
    firsts = parts.select(F.col("first").alias("last"), F.lit(True).alias("goes_on"))
    done = F.col("goes_on").isNull() | F.col("stops")
    return checkpointed(
        parts.join(firsts, "last", "left").select(F.col("first").alias("n"), F.col("last").alias("nx"), F.lit(1).cast("long").alias("d"), done.alias("done"))
    )


def _assemble(ranked: DataFrame, parts: DataFrame, w: Text) -> DataFrame:
    ordered = ranked.select("n", "nx", "d").join(parts.select(F.col("first").alias("n"), "letters"), "n")
    runs = ordered.groupBy("nx").agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "n", "letters"))).alias("a"))
    return runs.select(F.concat(w.text(F.col("a")[0]["n"]), F.array_join(F.transform("a", lambda x: x["letters"]), "")).alias("seq"))


def unitig_paths(mutual_: DataFrame, k: int, kept: unique.Graph | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, own: bool = False) -> DataFrame:
    """(seq, circular): each maximal path of mutual arcs (arc, home) between unitig vertices once, on the strand that is
    lower by letters; a vertex without such arcs is a path. A cycle of L vertices gives L+k-1 letters from its lowest
    k-mer on, and circular = 1. kept: a graph of which mutual_ has the arcs of marked vertices, and of whose other
    arcs all are mutual. keep: what keeps the table of each step; mutual_ is not read after the first. own: whether kept
    may lose what is used up."""
    w, keep, done = words.of(k), keep or Steps(), kept.without if kept and own else lambda *_: None
    sides = keep(_sides(mutual_, w, kept and kept.of(unique.INNER)))
    done(unique.INNER)
    ends = sides.select("word", "home", F.explode(F.array("ahead", "behind")).alias("arc"))
    if kept:
        ends = ends.unionByName(kept.of(unique.END).select("word", "home", F.col("ahead").alias("arc")))
    links = ends.groupBy("arc").agg(F.count(F.lit(1)).alias("n"), F.max("word").alias("word"), F.min("home").alias("home"))
    links = w.with_rc(links, "arc", "r", k + 1)
    links = keep(links.select("arc", "word", "home", ((F.col("n") == 2) | (F.col("arc") == F.col("r"))).alias("edge")))
    done(unique.END)
    lone = links.where(~F.col("edge")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    alone = settled(lone.select("word")).select(w.text(F.col("word")).alias("seq"))
    edges = links.where("edge").select("arc", "home")
    if kept:
        edges = edges.unionByName(kept.of(unique.RUN).select(F.col("word").alias("first"), F.col("ahead").alias("last"), "text", "home"), allowMissingColumns=True)
        alone = alone.unionByName(kept.of(unique.WHOLE).select(F.least("text", dna.reverse_complement(F.col("text"))).alias("seq")))
    all_parts = keep(segments(edges, w))
    done(unique.RUN)
    parts = all_parts.where(~F.col("closed")).select("first", "last", "letters", F.lit(False).alias("stops"))
    ranked = _rank(_start(parts))
    seq = F.col("seq")
    # both strands of each path are there, or one that is its own reverse complement
    open_paths = _assemble(ranked.where("done"), parts, w).where(seq <= dna.reverse_complement(seq))

    rings = all_parts.where("closed").select(F.concat(w.text(F.col("first")), "letters").alias("seq"))
    turning = ranked.where(~F.col("done")).select(F.col("n").alias("first"))
    cyclic = checkpointed(parts.join(turning, "first", "left_semi"))
    size = cyclic.count()
    if size:
        label = cyclic.select(F.col("first").alias("n"), F.col("last").alias("nx"), F.col("first").alias("low"))
        for _ in range(max(1, size.bit_length())):
            other = label.select(F.col("n").alias("nx"), F.col("nx").alias("nx2"), F.col("low").alias("low2"))
            label = checkpointed(label.join(other, "nx").select("n", F.col("nx2").alias("nx"), F.least("low", "low2").alias("low")))
        heads = label.where(F.col("n") == F.col("low")).select(F.col("n").alias("last"), F.lit(True).alias("head"))
        cut = cyclic.drop("stops").join(heads, "last", "left").select("first", "last", "letters", F.coalesce("head", F.lit(False)).alias("stops"))
        cut = checkpointed(cut)
        rings = rings.unionByName(_assemble(_rank(_start(cut)).where("done"), cut, w))
    cycles = rings.select(lowest_rotation(seq.substr(F.lit(1), F.length(seq) - 1), F.lit(k)).alias("seq")).distinct()
    return open_paths.unionByName(alone).withColumn("circular", F.lit(0)).unionByName(cycles.withColumn("circular", F.lit(1)))


# ---- cycles ----------------------------------------------------------------------------------------------------


def least_rotation(text: str) -> int:
    """Where the lowest rotation of a text begins, in time proportional to its length: of two candidates, the one
    that turns out higher after some equal letters can't have the lowest begin at any of these letters."""
    n, a, b, same = len(text), 0, 1, 0
    while a < n and b < n and same < n:
        x, y = text[(a + same) % n], text[(b + same) % n]
        if x == y:
            same += 1
            continue
        if x > y:
            a += same + 1
        else:
            b += same + 1
        b += a == b
        same = 0
    return min(a, b)


def _turned(path: str, k: int) -> str:
    """A circular path, of L+k-1 letters, from its lowest k-mer on, on the strand on which that is lower. The k-mers of
    a cycle of unitig vertices are all different, so the lowest one begins the lowest rotation."""
    cycle = path[: len(path) - k + 1]
    if not cycle:
        return path
    out = []
    for strand in (cycle, cycle[::-1].translate(str.maketrans(dna.LETTERS, dna.COMPLEMENTS))):
        at = least_rotation(strand)
        whole = strand[at:] + strand[:at]
        out.append((whole * (len(path) // len(whole) + 1))[: len(path)])
    return min(out)


def lowest_rotation(path: Column, k: Column) -> Column:
    """Circular paths in their normal form; null stays null."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _turned(p, int(n)) for p, n in zip(paths, ks, strict=True)])

    return run(path, k)


def assemble(reads: DataFrame, k: int, minimum_coverage: int = 1, minimum_length: int = 100, strategy: Strategy = flow_split) -> DataFrame:
    """(seq, circular): unitigs of at least minimum_length letters."""
    if k <= words.MOST:
        return assemble_graph(unique.graph(reads, k), k, minimum_coverage, minimum_length, strategy, own=True)
    return assemble_vertices(graph.word_vertices(reads, k, home=True), k, minimum_coverage, minimum_length, strategy)


def assemble_vertices(vertices: DataFrame, k: int, minimum_coverage: int = 1, minimum_length: int = 100, strategy: Strategy = flow_split) -> DataFrame:
    """The same of vertices (word, coverage, parents, children, home)."""
    w, steps = words.of(k), Steps()
    return unitig_paths(steps(mutual(steps(strategy(vertices, w, minimum_coverage, steps)), w)), k, keep=steps).where(F.length("seq") >= minimum_length)


def assemble_graph(graph_: unique.Graph, k: int, minimum_coverage: int = 1, minimum_length: int = 100, strategy: Strategy = flow_split, own: bool = False) -> DataFrame:
    """The same of a graph of reads. Two vertices of equal coverage with one arc between them choose each other by either
    strategy, if that coverage is enough. own: whether the graph, which nothing else reads, may lose what is used up."""
    w, steps = words.of(k), Steps()
    kept = graph_ if minimum_coverage <= 1 else graph_._replace(rows=graph_.rows.where(F.col("coverage") >= minimum_coverage))
    choice = steps(strategy(graph_.vertices(), w, minimum_coverage, steps))
    if own:
        dropped(graph_.marked)
        graph_.without(unique.BESIDE, unique.CLASS)
    return unitig_paths(steps(mutual(choice, w)), k, kept, steps, own).where(F.length("seq") >= minimum_length)
