"""Queries p1, p2 and p4 to p9 over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import distinct, encoding, frequency, frequent, packing, personal, spans, splitting
from strandframe.operators.observations import counting
from strandframe.plans.queries import COUNTING
from strandframe.plans.registry import Registry
from strandframe.session import read_table

REG = Registry()
query = REG.add

#: Keys reported for each length.
TOP = 10
#: A key is common if it lies in more than this share of the blocks of its length.
COMMON = 0.1
#: Given names that every task can hold.
MOST_NAMES = 1_000_000
#: Tokens of a container.
CAPACITY = 2048


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every item over its limit."""
    items = read_table(spark, d, "input_streams")
    return splitting.split_items(items, "stream_id", "file", "starting_offset", "ending_offset", "mega_block_size", "overlap_entries", "buffer")


def _records(spark: SparkSession, d: str) -> DataFrame:
    reads = read_table(spark, d, "sequence_reads").select(F.col("read_id").alias("rec"), F.col("buffer_for_sequence").alias("text"))
    return reads.unionByName(read_table(spark, d, "vertex_neighborhoods").select(F.col("visit_id").alias("rec"), F.col("main_kmer").alias("text")))


RECORDS = "rec as (select distinct read_id rec, buffer_for_sequence t from sequence_reads union select distinct visit_id, main_kmer from vertex_neighborhoods)"
SPANS = f"""{RECORDS}, w as materialized (select rec, i::int p, substr(t,(i+1)::int,40) s from rec, unnest(range(0,length(t)-39)) x(i) where length(t)>=40),
h as (select s from w group by 1 having min(rec)<max(rec)), q as (select distinct rec, p from w where s in (select s from h)),
g as (select rec, p, sum(n) over (partition by rec order by p) k from (select rec, p, (coalesce(p>lag(p) over (partition by rec order by p)+40,true))::int n from q)),
f as (select rec, min(p)::int a, (max(p)+40)::int b from g group by rec, k)"""


@query(sql=f"with {SPANS} select rec rec_id, a span_start, (b-a)::int span_length from f")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each record that other records have too."""
    return spans.shared_spans(_records(spark, d)).withColumnRenamed("rec", "rec_id")


@query(sql=f"with {SPANS}, z as (select rec, coalesce(max(length(t)),0)::int n from rec group by 1), y as (select rec, sum(b-a)::bigint s from f group by 1) select z.rec rec_id, n n_chars, coalesce(s,0)::bigint shared_chars, case when n>0 then round(coalesce(s,0)/n,6) else 0 end share from z left join y on y.rec=z.rec")
def p2_shared_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record is shared."""
    return spans.shared_share(_records(spark, d)).withColumnRenamed("rec", "rec_id")


def _p4_sql() -> str:
    from itertools import combinations

    groups, m = ["day", "dataset", "kernel"], 1 << distinct.PRECISION
    x = "('0x'||substr(h,4,13))::bigint"
    base = (
        f"with k0 as (select emitted_at::date \"day\", dataset, kernel, regexp_replace(translate(kmer,'acgt','ACGT'),'[^ACGT]','A','g') k from kmers where length(kmer)=kmer_length), "
        "k1 as (select \"day\", dataset, kernel, md5(least(k,reverse(translate(k,'ACGT','TGCA')))) h from k0), "
        f"k2 as (select \"day\", dataset, kernel, ('0x'||substr(h,1,3))::int r, case when {x}=0 then 53 else 53-length(bin({x})) end z from k1), "
        "b as materialized (select \"day\", dataset, kernel, r, max(z) z from k2 group by all) "
    )
    parts = []
    for size in (3, 2, 1):
        for own in combinations(groups, size):
            cols = ", ".join(f'"{g}"' for g in own)
            e = f"({m}-count(*))/{float(m)}"
            sigma = f"{e}" + "".join(f"+pow({e},{float(2**k)})*{float(2 ** (k - 1))}" for k in range(1, 20))
            shown = ", ".join(f'"{g}"' if g in own else f'null "{g}"' for g in groups)
            parts.append(
                f"select '{'+'.join(own)}' \"level\", {shown}, round({m * m / (2 * 0.6931471805599453)!r}/({float(m)}*({sigma})+sum(pow(2.0,-z))))::bigint \"distinct\", {distinct.standard_error()!r}::double std_error from (select {cols}, r, max(z) z from b group by all) group by {cols}"
            )
    return base + " union all ".join(parts)


@query(sql=_p4_sql())
def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys by day, dataset, kernel and their combinations, with the standard error."""
    rows = counting(read_table(spark, d, "kmers"), F.to_date("emitted_at").alias("day"), "dataset", "kernel")
    return distinct.distinct_by_all(rows, ["day", "dataset", "kernel"], "key")


P4_ROWS = """select emitted_at::date "day", dataset, kernel, ('0x'||substr(h,1,3))::int register, max(case when x=0 then 53 else 53-length(bin(x)) end)::tinyint "rank" from
(select *, ('0x'||substr(h,4,13))::bigint x from (select emitted_at, dataset, kernel, md5(least(k,reverse(translate(k,'ACGT','TGCA')))) h from
(select emitted_at, dataset, kernel, regexp_replace(upper(kmer),'[^ACGT]','A','g') k from kmers where length(kmer)=kmer_length))) group by all"""


@query(sql=P4_ROWS)
def p4_registers(spark: SparkSession, d: str) -> DataFrame:
    """The partial results by day, dataset and kernel; those of any two sets of rows merge by the larger rank."""
    rows = counting(read_table(spark, d, "kmers"), F.to_date("emitted_at").alias("day"), "dataset", "kernel")
    return distinct.registers(rows, ["day", "dataset", "kernel"], "key")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = counting(read_table(spark, d, "kmers"), "obs_id", F.col("kmer_length").alias("grp"))
    return rows.withColumnRenamed("key", "value")


@query(sql=f"with {COUNTING}, n as (select kmer_length, key, count(*) n from c group by all) select kmer_length, key kmer from (select *, row_number() over (partition by kmer_length order by n desc, key) r from n) where r<={TOP}")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten keys of each length with the most counting rows."""
    return frequent.most_frequent(_grouped(spark, d), TOP, "obs_id").select(F.col("grp").alias("kmer_length"), F.col("value").alias("kmer"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    top = frequent.most_frequent(_grouped(spark, d), TOP, "obs_id")
    return top.select(F.col("grp").alias("kmer_length"), F.col("value").alias("kmer"), "n", F.col("votes").alias("at_least"), (F.col("votes") + F.col("light")).alias("at_most"))


@query(sql=f"with {COUNTING}, n as (select kmer_length, key, count(*) n from c group by all) select kmer_length, key kmer, n, true bounded from (select *, row_number() over (partition by kmer_length order by n desc, key) r from n) where r<={TOP}")
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with exact counts, and whether the sketch's upper bound holds."""
    return _p5(spark, d).select("kmer_length", "kmer", "n", (F.col("n") <= F.col("at_most")).alias("bounded"))


@query()
def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with the sketch's bounds on their rows, repeats included."""
    return _p5(spark, d).select("kmer_length", "kmer", "at_least", "at_most")


P6 = f"""with {COUNTING}, n as (select length(key)::int kmer_length, key kmer, count(*) "rows", count(distinct block_id) blocks from c group by all),
b as (select kmer_length, count(distinct block_id) all_blocks from c group by 1), s as (select kmer_length, max(minimum_coverage) least from count_settings where kmer_length is not null group by 1),
m as (select n.*, "rows"<coalesce(least,1) rare, blocks>all_blocks*0.1 common from n left join b using (kmer_length) left join s using (kmer_length))"""


def _p6(spark: SparkSession, d: str) -> DataFrame:
    kmers = read_table(spark, d, "kmers")
    rows = counting(kmers, F.col("obs_id").alias("id"), F.col("block_id").alias("record")).withColumnRenamed("key", "value")
    n = kmers.count()
    some = kmers.sample(min(1.0, frequency.SAMPLE / max(1, n)), seed=7) if n > frequency.SAMPLE else kmers
    counts = frequency.frequencies(rows, counting(some).withColumnRenamed("key", "value"), min(n, frequency.SAMPLE)).withColumn("grp", F.length("value"))
    settings = read_table(spark, d, "count_settings").groupBy(F.col("kmer_length").alias("grp")).agg(F.max("minimum_coverage").alias("least"))
    blocks = kmers.where(F.length("kmer") == F.col("kmer_length")).groupBy(F.col("kmer_length").alias("grp")).agg(F.count_distinct("block_id").alias("all_records"))
    return frequency.marked_frequencies(counts, settings, blocks, COMMON)


@query(sql=f"{P6} select kmer_length, kmer, 'rare' mark from m where rare union all select kmer_length, kmer, 'common' from m where common")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are too rare or too common."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return _p6(spark, d).select(F.col("grp").alias("kmer_length"), F.col("value").alias("kmer"), F.explode(marks).alias("mark"))


@query(sql=f"{P6} select * from m")
def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Rows, blocks and marks of every key."""
    return _p6(spark, d).select(F.col("grp").alias("kmer_length"), F.col("value").alias("kmer"), F.col("n").alias("rows"), F.col("records").alias("blocks"), "rare", "common")


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_column(read_table(spark, d, "documents"), "doc_id", "text")


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that is too long."""
    return packing.pack_documents(read_table(spark, d, "documents"), "doc_id", "text", CAPACITY)


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and items of every container."""
    placed = packing.pack_documents(read_table(spark, d, "documents"), "doc_id", "text", CAPACITY)
    return placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("items"))


@query(sql="select count(*) documents, count_if(coalesce(text,'')='') empty, 0::bigint overfull, 0::bigint cut_needlessly from documents")
def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document is placed, an empty one with no tokens; no container holds more
    than its capacity; of a document in several pieces all but the last are as large as a container."""
    rows = packing.pack_documents(read_table(spark, d, "documents"), "doc_id", "text", CAPACITY)
    first, full = F.col("piece") == 0, F.col("n_tokens") == CAPACITY
    whole = rows.groupBy("doc_id").agg(F.count_if(first).alias("d"), F.count_if(first & (F.col("n_tokens") == 0)).alias("e"), (F.count(F.lit(1)) - F.count_if(full)).alias("short"))
    marks = whole.select(F.col("d"), F.col("e"), F.lit(0).alias("o"), (F.col("short") > F.col("d")).cast("int").alias("c"))
    sums = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("s")).select(F.lit(0), F.lit(0), (F.col("s") > CAPACITY).cast("int"), F.lit(0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return marks.union(sums).agg(total("d").alias("documents"), total("e").alias("empty"), total("o").alias("overfull"), total("c").alias("cut_needlessly"))


def _given(spark: SparkSession, d: str) -> frozenset[str]:
    """The table of given names, which is fixed and small; a table that isn't is an error."""
    rows = read_table(spark, d, "given_names").where("given_name is not null").distinct()
    if rows.count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return frozenset(r[0] for r in rows.collect())


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal data in the documents."""
    return personal.find_personal(read_table(spark, d, "documents"), "doc_id", "text", _given(spark, d))


@query()
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders for personal data."""
    return personal.redact(read_table(spark, d, "documents"), "doc_id", "text", _given(spark, d))
