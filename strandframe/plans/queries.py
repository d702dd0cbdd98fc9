"""Queries for the engine's own operators and for the general problem p3, over whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import containers as ct
from strandframe.functions import codec, dna, stats
from strandframe.functions.hashing import KMER_SEED, MULTIPLIER, SHIFT, SIGNATURE_SEED, canonical_hash, kmer_hash, murmur64a_column
from strandframe.operators import graph, kmers, ordered, sequences, skew, unitigs
from strandframe.operators.observations import counting
from strandframe.plans.registry import Registry
from strandframe.session import ensure_checkpoint_dir, read_table
from strandframe.sources import sinks
from strandframe.sources.sequences import of_format, read_fasta, read_sequences, records_of_buffers

REG = Registry()
query = REG.add

#: k of the registered queries, and the range of reads that they need at least.
K = 21
#: A key is heavy from this share of all rows on.
HEAVY = 1 / 50

# ---- pieces of SQL -------------------------------------------------------------------------------------------


def rc(x: str) -> str:
    return f"reverse(translate({x},'ACGT','TGCA'))"


READS = r"r as materialized (select distinct read_id, regexp_replace(upper(regexp_replace(buffer_for_sequence,'[\r\n]+$','')),'[^ACGT]','A','g') s from sequence_reads)"


class GraphSql:
    """CTEs of the graph of a table r (read_id, s), each with all that it needs before it."""

    def __init__(self, k: int = K, reads: str = READS, least: int = 1) -> None:
        bits = "sum(distinct case {} when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 end)"
        self.reads = reads
        self.kmers = f"{reads}, km as (select read_id, i::int - 1 pos, substr(s,i::int,{k}) k from r, unnest(range(1,length(s)-{k}+2)) t(i) where length(s)>={k})"
        self.counts = f"{self.kmers}, v as materialized (select least(k,{rc('k')}) key, count(*) cov from km group by 1)"
        self.both = f"{self.counts}, o as materialized (select key k, cov from v union all select {rc('key')}, cov from v)"
        self.arcs = (
            f"{self.both}, e1 as (select substr(s,i::int,{k}) src, substr(s,(i+1)::int,{k}) dst from r, unnest(range(1,length(s)-{k}+1)) t(i) where length(s)>{k}), "
            f"arc as materialized (select distinct src,dst from (select src,dst from e1 union all select {rc('dst')},{rc('src')} from e1))"
        )
        self.choice = (
            f"{self.arcs}, x as (select a.src,a.dst,c.cov cc,n.cov nc,c.cov//4 thr from arc a join o c on c.k=a.src join o n on n.k=a.dst), "
            "w as (select *, count(*) over (partition by src,nc) same, sum((nc>=thr)::int) over (partition by src) strong from x), "
            f"ch as materialized (select src,dst from w where same=1 and nc<8*cc and cc<8*nc and nc>=thr and strong=1 and nc>={least})"
        )
        self.unitig = (
            f"{self.choice}, mut as materialized (select a.src,a.dst from ch a join ch b on b.src={rc('a.dst')} and b.dst={rc('a.src')}), "
            "u as materialized (select src k from mut intersect select dst from mut)"
        )
        self.vertex = (
            f"{self.arcs}, ch1 as (select src k, {bits.format('right(dst,1)')} m from arc group by 1), pa1 as (select dst k, {bits.format('left(src,1)')} m from arc group by 1), "
            "vx as materialized (select o.k, o.cov, coalesce(pa1.m,0)::int parents, coalesce(ch1.m,0)::int children from o left join pa1 on pa1.k=o.k left join ch1 on ch1.k=o.k)"
        )
        self.edges = f"{self.unitig}, edge as materialized (select m.src,m.dst from mut m where m.src in (select k from u) and m.dst in (select k from u))"
        self.paths = (
            f"{self.edges}, walk(cur,s) as (select k,k from u where k not in (select dst from edge) union all select e.dst, walk.s||right(e.dst,1) from walk join edge e on e.src=walk.cur), "
            f"p as (select distinct least(s,{rc('s')}) seq from walk where cur not in (select src from edge))"
        )
        # from every vertex once around, as long as none is met that is lower than the first
        self.cycles = (
            f"{self.edges}, ring(start,cur,s,m,closed) as (select src,src,src,least(src,{rc('src')}),false from edge "
            f"union all select start, e.dst, case when e.dst=start then s else s||right(e.dst,1) end, least(m, e.dst, {rc('e.dst')}), e.dst=start from ring join edge e on e.src=ring.cur where not closed and e.dst>=start), "
            "c as (select min(s) seq from ring where closed group by m)"
        )


G = GraphSql()
R, KM, V, ARC, CHOICE, UNITIG, VERTEX, PATHS = G.reads, G.kmers, G.counts, G.arcs, G.choice, G.unitig, G.vertex, G.paths
#: The other k of the registered queries, of words that are text, and the coverage asked for there.
LONG_K, COVERED = 43, 2
LONG = GraphSql(LONG_K, least=COVERED)
#: Circular reads: each visited k-mer followed by its own beginning.
RINGS = GraphSql(reads=f"n as (select distinct regexp_replace(upper(main_kmer),'[^ACGT]','A','g') s from vertex_neighborhoods where length(main_kmer)>={K}), r as materialized (select 0 read_id, s||left(s,{K}) s from n)")


def murmur_sql(table: str, text: str, seed: int, out: str, ending: int = 1) -> str:
    """CTEs from `table` to `out`, which has its columns and h, MurmurHash64A of an ASCII text and `ending` zero bytes
    after it, as the engine has it."""
    m, mod, n = f"{MULTIPLIER}::uhugeint", f"{1 << 64}::uhugeint", f"(length({text})+{ending})"
    byte = f"greatest(0,ord(substr({text},(i*8+j)::int,1)))::uhugeint"  # 0 beyond the end
    word = f"list_reduce(list_transform([8,7,6,5,4,3,2,1], lambda j: {byte}), lambda a, b: a*256::uhugeint+b)"
    return (
        f"{out}_1 as (select *, list_transform(range(0,{n}//8), lambda i: ({word}*{m})%{mod}) w_, case when {n}%8>0 then (select {word} from (select {n}//8 i)) end t_ from {table}), "
        f"{out}_2 as (select * exclude (w_), list_reduce(list_transform(w_, lambda x: (xor(x,x>>{SHIFT})*{m})%{mod}), lambda a, b: (xor(a,b)*{m})%{mod}, xor({seed}::uhugeint,{n}::uhugeint)) a_ from {out}_1), "
        f"{out}_3 as (select * exclude (a_, t_), case when t_ is null then a_ else (xor(a_,t_)*{m})%{mod} end b_ from {out}_2), "
        f"{out}_4 as (select * exclude (b_), (xor(b_,b_>>{SHIFT})*{m})%{mod} c_ from {out}_3), {out} as (select * exclude (c_), xor(c_,c_>>{SHIFT}) h from {out}_4)"
    )


#: Rows of kmers that count, each once, with their key.
COUNTING = (
    "c0 as (select distinct obs_id, block_id, kmer_length, regexp_replace(translate(kmer,'acgt','ACGT'),'[^ACGT]','A','g') k from kmers where length(kmer)=kmer_length), "
    f"c as materialized (select obs_id, block_id, kmer_length, least(k,{rc('k')}) key from c0)"
)

# ---- sequences -----------------------------------------------------------------------------------------------


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return sequences.reads(spark, d)


@query(sql=f"with {R} select read_id, s seq from r")
def seq_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d)


@query(sql=f"with {R} select read_id, translate(s,'ACGT','TGCA') complement, {rc('s')} revcomp, translate(s,'ACGT','0123') codes, left(s,1) first_base, right(s,1) last_base, substr(s,4,1) base_3, length(s)::int n, substr(s,1,2)||lower(substr(s,3,4))||substr(s,7) marked from r")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return _reads(spark, d).select(
        "read_id", dna.complement(s).alias("complement"), dna.reverse_complement(s).alias("revcomp"), dna.codes(s).alias("codes"),
        dna.first_letter(s).alias("first_base"), dna.last_letter(s).alias("last_base"), dna.letter_at(s, F.lit(3)).alias("base_3"),
        F.length(s).alias("n"), dna.lower_range(s, 2, 5).alias("marked"),
    )


@query(sql=f"with {R} select read_id, case when length(s)>0 then round(length(regexp_replace(s,'[^GC]','','g'))/length(s), 9) end gc from r")
def gc_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_id", F.round(dna.gc_ratio(F.col("seq")), 9).alias("gc"))


@query(sql=f"with {R} select read_id, (length(s)*2//8+1)::int two_bit, (length(s)+1)::int ascii, case when length(s)>0 then substr(s, 3%length(s)+1)||substr(s,1,3%length(s)) else s end rotated from r")
def sequence_encoding(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return _reads(spark, d).select("read_id", dna.encoded_length(s).alias("two_bit"), dna.encoded_length(s, False).alias("ascii"), dna.rotate(s, 3).alias("rotated"))


@query(sql="select main_kmer, upper(main_kmer)<=reverse(translate(upper(main_kmer),'ACGT','TGCA')) canonical, substr(upper(main_kmer),2)||'G' child_g, 'C'||left(upper(main_kmer),length(main_kmer)-1) parent_c from vertex_neighborhoods where main_kmer is not null")
def kmer_moves(spark: SparkSession, d: str) -> DataFrame:
    k = F.upper("main_kmer")
    return read_table(spark, d, "vertex_neighborhoods").where("main_kmer is not null").select(
        "main_kmer", dna.is_canonical(k).alias("canonical"), dna.child(k, F.lit("G")).alias("child_g"), dna.parent(k, F.lit("C")).alias("parent_c")
    )


@query(sql=f"with {R} select read_id, s seq, (length(s)*2//8+1)::int bytes, case when length(s)>2 then 'T'||substr(s,2) else s end changed from r")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    out = _reads(spark, d).withColumn("data", codec.packed(s))
    changed = F.when(F.length(s) > 2, dna.set_letter(s, F.lit(0), F.lit("T"))).otherwise(s)
    return out.select("read_id", codec.unpacked(F.col("data"), F.length(s)).alias("seq"), F.octet_length("data").alias("bytes"), changed.alias("changed"))


@query(sql="select file, count(*) reads from sequence_reads where regexp_matches(file, '\\.(fq|fastq)(\\.gz)?$') group by 1")
def fastq_files(spark: SparkSession, d: str) -> DataFrame:
    return of_format(read_table(spark, d, "sequence_reads"), "fastq").groupBy("file").agg(F.count(F.lit(1)).alias("reads"))


@query(sql="select visit_id, main_kmer, flags from vertex_neighborhoods where coalesce(flags,0)&5=0")
def unused_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_flags(read_table(spark, d, "vertex_neighborhoods"), 5).select("visit_id", "main_kmer", "flags")


@query(sql="select kmer_length, count(*) n, count(distinct main_kmer) kmers, min(coverage_depth) low, max(coverage_depth) high, round(avg(coverage_depth),6) mean from vertex_neighborhoods where coverage_depth>=2 group by 1")
def covered_visits(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "vertex_neighborhoods").where("coverage_depth >= 2").groupBy("kmer_length")
    c = F.col("coverage_depth")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("main_kmer").alias("kmers"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 6).alias("mean"))


@query(sql="select read_id, file, seq, loaded_at from (select *, row_number() over (partition by read_id order by loaded_at) n from sequence_reads) where n=1")
def first_loads(spark: SparkSession, d: str) -> DataFrame:
    """Each read as it was loaded first."""
    rows = read_table(spark, d, "sequence_reads").select("read_id", "file", "seq", "loaded_at")
    one = F.min_by(F.struct("file", "seq", "loaded_at"), "loaded_at").alias("r")
    return rows.groupBy("read_id").agg(one).select("read_id", "r.file", "r.seq", "r.loaded_at")


@query(sql="select file, count(*) reads from (select file from sequence_reads union all select file from input_streams union all select file from store_entries) group by 1")
def merged_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all inputs by file."""
    names = [read_table(spark, d, t).select("file") for t in ("sequence_reads", "input_streams", "store_entries")]
    return names[0].union(names[1]).union(names[2]).groupBy("file").agg(F.count(F.lit(1)).alias("reads"))


@query(sql="select file, count(*) reads, coalesce(sum(length(seq)),0)::bigint bases, count_if(coalesce(pair,-1)<>-1)::bigint paired from sequence_reads group by 1")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return sequences.dataset_summary(read_table(spark, d, "sequence_reads"))


_FASTQ = "regexp_matches(coalesce(file,''), '\\.(fq|fastq)(\\.gz)?$')"


@query(sql=f"""with b as (select stream_id, string_split(chr(10)||buffer, chr(10)||'>') p from input_streams where buffer is not null and not {_FASTQ}),
q as (select distinct stream_id, i::int - 2 record, p[i::int] t from b, unnest(range(2,len(p)+1)) x(i))
select stream_id, record, rtrim(case when contains(t,chr(10)) then split_part(t,chr(10),1) else t end, chr(13)) name, case when contains(t,chr(10)) then regexp_replace(substr(t,strpos(t,chr(10))+1),'[\r\n]','','g') else '' end seq from q""")
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records of the buffers of FASTA files."""
    return records_of_buffers(read_table(spark, d, "input_streams"), "fasta", "stream_id", "file", "buffer").distinct()


@query(sql=f"""with b as (select stream_id, string_split(buffer, chr(10)) l from input_streams where buffer is not null and {_FASTQ}),
q as (select distinct stream_id, i::int record, rtrim(l[i*4+1],chr(13)) a, rtrim(l[i*4+2],chr(13)) s, l[i*4+3] p from b, unnest(range(0,len(l)//4+1)) x(i))
select stream_id, record, substr(a,2) name, s seq from q where a like '@%' and p like '+%'""")
def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records of the buffers of FASTQ files."""
    return records_of_buffers(read_table(spark, d, "input_streams"), "fastq", "stream_id", "file", "buffer").distinct()


@query(sql=f"with {R}, t as (select read_id, s, case when length(s)>=6 then substr(s,1,1)||reverse(substr(s,2,4))||substr(s,6) else s end turned, case when length(s)>=6 then substr(s,5,1)||substr(s,2,3)||substr(s,1,1)||substr(s,6) else s end swapped from r) select read_id, turned, swapped from t")
def string_ops(spark: SparkSession, d: str) -> DataFrame:
    """A range of letters reversed, and two letters swapped."""
    s = F.col("seq")
    long = F.length(s) >= 6
    return _reads(spark, d).select("read_id", F.when(long, dna.reverse_range(s, 1, 4)).otherwise(s).alias("turned"), F.when(long, dna.swap(s, 0, 4)).otherwise(s).alias("swapped"))


@query(sql="select read_id, loaded_at, translate(regexp_replace(buffer_for_sequence,'[^ACGT]','C','g'),'ACGT','TGCA') complement from sequence_reads")
def complement_raw(spark: SparkSession, d: str) -> DataFrame:
    """Complement of reads as met: whatever isn't a capital letter of the alphabet gives G."""
    return read_table(spark, d, "sequence_reads").select("read_id", "loaded_at", dna.complement_any(F.col("buffer_for_sequence")).alias("complement"))


@query(sql=f"with n as (select distinct upper(main_kmer) n from vertex_neighborhoods where length(main_kmer)>={K}), t as (select n, substr(n,8)||left(n,7) t from n) select n cycle, t||left(t,{K - 1}) turned from t")
def path_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Circular paths turned by seven letters."""
    n = F.col("cycle")
    rows = read_table(spark, d, "vertex_neighborhoods").where(F.length("main_kmer") >= K).select(F.upper("main_kmer").alias("cycle")).distinct()
    return rows.select("cycle", dna.rotate_path(F.concat(n, n.substr(1, K - 1)), F.lit(7), K).alias("turned"))


@query(sql="select o_orderkey, case when v>=1e9 then printf('%.3f G', v/1e9) when v>=1e6 then printf('%.3f M', v/1e6) when v>=1e3 then printf('%.3f k', v/1e3) else v::varchar end shown from (select o_orderkey, (o_orderkey*o_orderkey//100)*1000+1 v from orders)")
def unit_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Counts as they are displayed."""
    key = F.col("o_orderkey")
    return read_table(spark, d, "orders").select("o_orderkey", dna.unit_prefix(F.floor(key * key / 100).cast("long") * 1000 + 1).alias("shown"))


# ---- files and the command line ----


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}/{name}"


def _fastq(spark: SparkSession, d: str, **options: str) -> str:
    """The reads as a folder of FASTQ files; a null sequence is left out."""
    path, s = _folder(spark, "reads.fq"), F.col("seq")
    rows = _reads(spark, d).where("seq is not null")
    rows.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), s, F.lit("\n+\n"), F.repeat(F.lit("@"), F.length(s)))).write.options(**options).text(path)
    return path


@query(sql=f"with {R} select read_id::varchar as name, s seq from r where s is not null")
def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as FASTA of 60 letters a line and read again."""
    path, rows = _folder(spark, "reads.fa"), _reads(spark, d).where("seq is not null")
    lines = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), lines)).write.text(path)
    return read_sequences(spark, [path]).select("name", "seq")


@query(sql=f"with {R} select read_id::varchar as name, s seq from r where s is not null")
def fastq_gzip_files(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as compressed FASTQ, with quality lines that look like identifiers, and read again."""
    return read_sequences(spark, [_fastq(spark, d, compression="gzip")]).select("name", "seq")


@query(sql=f"with {V} select cov coverage, count(*) frequency from v group by 1")
def command_count(spark: SparkSession, d: str) -> DataFrame:
    """The canonical distribution that the command line writes; an even k is made odd."""
    from strandframe.cli import main

    out = _folder(spark, "out")
    main(["count", "-k", str(K - 1), "-o", out, _fastq(spark, d)], spark)
    cut = F.split("value", " ")
    return spark.read.text(f"{out}/coverage_distribution.txt-canonical").select(cut[0].cast("long").alias("coverage"), cut[1].cast("long").alias("frequency"))


@query(sql=f"with recursive {PATHS} select 'contig' kind, seq as value from p where length(seq)>=100 union all select 'vertex_count', (select count(*) from o)::varchar union all select 'arc_count', (select count(*) from arc)::varchar union all select 'vertex_observation_count', (select sum(cov) from o)::varchar")
def command_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Contigs and graph summary that the command line writes."""
    from strandframe.cli import main

    out = _folder(spark, "out")
    main(["assemble", "-k", str(K), "-o", out, "-minimum-coverage", "1", _fastq(spark, d)], spark)
    contigs = read_fasta(spark, f"{out}/unitigs.fasta").select(F.lit("contig").alias("kind"), F.col("seq").alias("value"))
    found = F.regexp_extract("value", "^<(vertex_count|arc_count|vertex_observation_count)>([0-9]+)<", 1)
    summary = spark.read.text(f"{out}/assembly_graph_summary.xml").where(found != "")
    return contigs.where("value is not null").unionByName(summary.select(found.alias("kind"), F.regexp_extract("value", ">([0-9]+)<", 1).alias("value")))


# ---- k-mers --------------------------------------------------------------------------------------------------


@query(sql=f"with {KM} select read_id, pos, k kmer from km")
def kmer_extract(spark: SparkSession, d: str) -> DataFrame:
    return kmers.extract(_reads(spark, d), K, positions=True).select("read_id", "pos", "kmer")


@query(sql=f"with {V} select key kmer, cov coverage from v")
def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count(_reads(spark, d), K)


@query(sql=f"with {V} select cov coverage, count(*) frequency from v group by 1")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kmers.histogram(kmers.count(_reads(spark, d), K))


@query(sql=f"with {V} select cov coverage, 2*count(*) frequency from v group by 1")
def coverage_histogram_both_strands(spark: SparkSession, d: str) -> DataFrame:
    return kmers.histogram_both_strands(kmers.count(_reads(spark, d), K))


@query(sql=f"with {V} select key kmer, cov coverage from v order by cov desc, key limit 20")
def topk_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.top(kmers.count(_reads(spark, d), K), 20)


@query(sql=f"with {V} select key kmer, cov coverage from v where cov>=2")
def min_coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    return kmers.minimum_coverage(kmers.count(_reads(spark, d), K), 2)


@query(sql=f"with {V}, m as (select key, (select min(least(substr(key,j::int,19),{rc('substr(key,j::int,19)')})) from unnest(range(1,{K}-19+2)) t(j)) minimizer from v) select key kmer, minimizer from m")
def minimizer_partition(spark: SparkSession, d: str) -> DataFrame:
    return kmers.partition_by_minimizer(kmers.count(_reads(spark, d), K), K, 64).select("kmer", "minimizer")


@query(sql="with n as (select *, row_number() over (order by read_id, loaded_at)-1 i from sequence_reads) select * exclude (i), ((i//64)%7)::int store_index, ((i//64)//7*64+i%64)::bigint index_in_store from n")
def block_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the reads, dealt to stores in blocks."""
    rows = ordered.block_round_robin(read_table(spark, d, "sequence_reads"), ["read_id", "loaded_at"], 64, 7)
    return rows.drop("row_index")


@query(sql="with n as (select row_number() over ()-1 i from sequence_reads) select ((i//64)%7)::int store_index, count(*) size from n group by 1")
def store_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the stores, known from the number of reads alone."""
    sizes = ordered.store_sizes(read_table(spark, d, "sequence_reads").count(), 7, 64)
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "store_index int, size long")


@query(sql=f"with {KM} select least(k,{rc('k')}) kmer, count(*) n, 1 places from km group by 1")
def hash_partition(spark: SparkSession, d: str) -> DataFrame:
    """k-mers of both strands by hash: all that are one vertex lie in one partition."""
    placed = kmers.partition_by_hash(kmers.extract(_reads(spark, d), K), 16).withColumn("part", F.spark_partition_id())
    return placed.groupBy(dna.canonical(F.col("kmer")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").cast("int").alias("places"))


@query(sql="select main_kmer, count(*) visits, count(distinct kmer_length) lengths from vertex_neighborhoods group by 1")
def kmer_visits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "vertex_neighborhoods").groupBy("main_kmer").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("kmer_length").alias("lengths"))


# ---- statistics ----------------------------------------------------------------------------------------------


@query(sql="select round(avg(x),6) mean, round(sqrt(var_pop(x)*count(x))/count(x),6) ref_stddev, round(stddev_pop(x),6) stddev_pop from (select length_in_nucleotides x from sequence_reads)")
def mean_stddev_ref(spark: SparkSession, d: str) -> DataFrame:
    out = stats.ref_stddev(read_table(spark, d, "sequence_reads"), "length_in_nucleotides")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


S = "s as (select length_in_nucleotides x from sequence_reads where length_in_nucleotides is not null), i as (select x, row_number() over (order by x)-1 r, count(*) over () n from s)"


@query(sql=f"with {S} select x median from i where r=n//2")
def median(spark: SparkSession, d: str) -> DataFrame:
    return stats.median(read_table(spark, d, "sequence_reads"), "length_in_nucleotides")


def _index_sql(p: int) -> str:
    return f"floor({p / 100}::double*n)::bigint-1" if p < 50 else f"n-floor({(100 - p) / 100}::double*n)::bigint"


@query(sql=f"with {S} select " + ", ".join(f"max(x) filter (r=greatest(0,least(n-1,{_index_sql(p)}))) p{p}" for p in stats.REPORT) + " from i")
def percentiles_int(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(read_table(spark, d, "sequence_reads"), "length_in_nucleotides")


@query(sql="with i as (select value x, row_number() over (order by value)-1 r, count(*) over () n from events where value is not null) select " + ", ".join(f"max(x) filter (r=floor({p / 100}::double*(n-1))) p{p}" for p in stats.REPORT) + " from i")
def percentiles_float(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(read_table(spark, d, "events"), "value", "float")


@query(sql=f"""with {V}, h as (select cov, count(*) f from v group by 1), c as (select cov, f, sum(f) over (order by cov)-f b, sum(f) over () n from h)
select p::int percentile, min(cov) "value" from c, unnest([{','.join(map(str, stats.REPORT))}]) t(p) where b<=round(p/100.0::double*n) and round(p/100.0::double*n)<=b+f group by 1""")
def weighted_percentile(spark: SparkSession, d: str) -> DataFrame:
    return stats.weighted_percentiles(kmers.histogram(kmers.count(_reads(spark, d), K)), "coverage", "frequency")


# ---- graph ---------------------------------------------------------------------------------------------------


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(_reads(spark, d), K)


@query(sql=f"with {ARC} select src, dst from arc")
def arcs_distinct(spark: SparkSession, d: str) -> DataFrame:
    return graph.arcs(_vertices(spark, d))


@query(sql=f"with {VERTEX} select k kmer, cov::int coverage, parents, children from vx where k<={rc('k')}")
def vertex_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return _vertices(spark, d)


@query(sql=f"with {ARC} select src kmer, 'CHILD' \"type\", right(dst,1) base from arc where src<={rc('src')} union all select dst, 'PARENT', left(src,1) from arc where dst<={rc('dst')}")
def arcs_oriented(spark: SparkSession, d: str) -> DataFrame:
    return graph.observed_arcs(_reads(spark, d), K)


@query(sql=f"with {VERTEX}, g as (select bit_count(parents) p, bit_count(children) c, count(*) f from vx group by all) select p.i::int parent_count, c.i::int child_count, coalesce(f,0)::bigint frequency from unnest(range(5)) p(i) cross join unnest(range(5)) c(i) left join g on g.p=p.i and g.c=c.i")
def degree_matrix(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_matrix(_vertices(spark, d))


@query(sql=f"with {ARC} select (select count(*) from o) vertex_count, (select sum(cov)::bigint from o) vertex_observation_count, (select count(*) from arc) arc_count")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_vertices(spark, d))


def _near(side: str) -> str:
    a, b = ("src", "dst") if side == "children" else ("dst", "src")
    return f"with {ARC} select a.{a} kmer, x.cov::int coverage, a.{b} neighbour, y.cov::int neighbour_coverage from arc a join o x on x.k=a.{a} join o y on y.k=a.{b} where a.{a}<={rc('a.' + a)}"


@query(sql=f"with {ARC}, t as (select src kmer, 'CHILD' \"type\", right(dst,1) base from arc where src<={rc('src')} union all select dst, 'PARENT', left(src,1) from arc where dst<={rc('dst')}) select t.*, o.cov::int coverage from t join o on o.k=t.kmer")
def copartitioned_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs with the coverage of their vertex, from two tables bucketed alike, which join without an exchange."""
    name = f"{ensure_checkpoint_dir(spark)}/buckets-{uuid4().hex}"
    tables = {"arcs": graph.observed_arcs(_reads(spark, d), K), "vertices": _vertices(spark, d).select("kmer", "coverage")}
    arcs, vertices = (sinks.write_bucketed(df, f"{t}_{uuid4().hex}", "kmer", 16, f"{name}/{t}") for t, df in tables.items())
    return arcs.join(vertices, "kmer")


@query(sql=_near("parents"))
def vertex_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_vertices(spark, d), "parents")


@query(sql=_near("children"))
def vertex_children(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_vertices(spark, d), "children")


@query(sql=f"with {ARC} select o.k kmer, o.cov::int coverage, (select count(*) from arc where dst=o.k)::int parents, (select count(*) from arc where src=o.k)::int children, coalesce((select string_agg(left(src,1),'' order by src) from arc where dst=o.k),'') parent_bases from o where o.k<={rc('o.k')}")
def vertex_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    n = graph.neighbourhoods(_vertices(spark, d))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    bases = F.array_join(F.transform("parents", lambda x: x["neighbour"].substr(1, 1)), "")
    return n.select("kmer", "coverage", F.greatest(size("parents"), F.lit(0)).alias("parents"), F.greatest(size("children"), F.lit(0)).alias("children"), F.coalesce(bases, F.lit("")).alias("parent_bases"))


@query(sql=f"with {ARC}, o2 as materialized (select k from o where cov>=2) select src, dst from arc where src in (select k from o2) and dst not in (select k from o2)")
def dangling_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs of vertices of coverage 2 at least whose end has less. Of all vertices no arc ends nowhere."""
    return graph.dangling_arcs(_vertices(spark, d).where("coverage >= 2"))


@query(sql=f"with {CHOICE} select src, dst from ch")
def flow_split_choice(spark: SparkSession, d: str) -> DataFrame:
    return unitigs.choices(_reads(spark, d), K)


@query(sql=f"with {ARC}, x as (select a.src, a.dst, row_number() over (partition by a.src order by n.cov desc, a.dst) r from arc a join o n on n.k=a.dst) select src, dst from x where r=1")
def highest_coverage_choice(spark: SparkSession, d: str) -> DataFrame:
    return unitigs.choices(_reads(spark, d), K, unitigs.highest_coverage)


@query(sql=f"with {UNITIG} select k kmer from u")
def unitig_vertices(spark: SparkSession, d: str) -> DataFrame:
    return unitigs.unitig_vertices(_reads(spark, d), K)


@query(sql=f"with recursive {PATHS} select seq from p")
def unitig_paths(spark: SparkSession, d: str) -> DataFrame:
    return unitigs.assemble(_reads(spark, d), K, minimum_length=0).where("circular = 0").select("seq")


@query(sql=f"with recursive {PATHS} select seq, length(seq)::int n from p where length(seq)>=100")
def unitig_assembly(spark: SparkSession, d: str) -> DataFrame:
    return unitigs.assemble(_reads(spark, d), K).where("circular = 0").select("seq", F.length("seq").alias("n"))


@query(sql=f"with recursive {RINGS.cycles} select seq, length(seq)::int n from c")
def unitig_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Circular unitigs of reads that end as they begin."""
    s = dna.normalize(F.col("main_kmer"))
    rings = read_table(spark, d, "vertex_neighborhoods").where(F.length("main_kmer") >= K).select(F.concat(s, s.substr(1, K)).alias("seq")).distinct()
    return unitigs.assemble(rings, K, minimum_length=0).where("circular = 1").select("seq", F.length("seq").alias("n"))


@query(sql=f"with {LONG.counts} select key kmer, cov coverage from v where cov>={COVERED}")
def long_kmer_count(spark: SparkSession, d: str) -> DataFrame:
    """k = 43: k-mers as text."""
    return kmers.minimum_coverage(kmers.count(_reads(spark, d), LONG_K), COVERED)


@query(sql=f"with {LONG.vertex} select k kmer, cov::int coverage, parents, children from vx where k<={rc('k')}")
def long_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(_reads(spark, d), LONG_K)


@query(sql=f"with {LONG.choice} select src, dst from ch")
def covered_choice(spark: SparkSession, d: str) -> DataFrame:
    """k = 43 and neighbours of coverage 2 at least."""
    return unitigs.choices(_reads(spark, d), LONG_K, minimum_coverage=COVERED)


@query(sql=f"with recursive {LONG.paths} select seq, length(seq)::int n from p where length(seq)>=60")
def covered_assembly(spark: SparkSession, d: str) -> DataFrame:
    """k = 43, neighbours of coverage 2 at least, unitigs of 60 letters at least."""
    return unitigs.assemble(_reads(spark, d), LONG_K, COVERED, 60).where("circular = 0").select("seq", F.length("seq").alias("n"))


_ENDS = f"e as (select seq, least(least(left(seq,{K}),{rc(f'left(seq,{K})')}), least(right(seq,{K}),{rc(f'right(seq,{K})')})) low from p where length(seq)>=100)"


@query(sql=f"with recursive {PATHS}, {_ENDS}, {murmur_sql('e', 'low', KMER_SEED, 'n')}, n2 as (select seq, h as name from n), {murmur_sql('n2', 'seq', SIGNATURE_SEED, 'z', 0)} select seq, name::varchar as name, h::varchar as signature from z")
def unitig_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of contigs, the hash of the lower of the two end k-mers, and signatures, the hash of the whole."""
    paths = unitigs.assemble(_reads(spark, d), K).where("circular = 0")
    signature = murmur64a_column(F.col("seq"), SIGNATURE_SEED).cast("string")
    return paths.select("seq", sinks.path_name_column(F.col("seq"), K).cast("string").alias("name"), signature.alias("signature"))


_VISITED = "v as (select distinct upper(main_kmer) kmer from vertex_neighborhoods where main_kmer is not null), w as (select kmer, least(kmer,reverse(translate(kmer,'ACGT','TGCA'))) low from v)"


@query(sql=f"with {_VISITED}, {murmur_sql('w', 'kmer', KMER_SEED, 'a')}, a2 as (select kmer, low, h own from a), {murmur_sql('a2', 'low', KMER_SEED, 'b')} select kmer, own::varchar hash, h::varchar canonical_hash from b")
def kmer_hashes(spark: SparkSession, d: str) -> DataFrame:
    """MurmurHash64A of visited k-mers and of their canonical form."""
    k = F.col("kmer")
    rows = read_table(spark, d, "vertex_neighborhoods").where("main_kmer is not null").select(F.upper("main_kmer").alias("kmer")).distinct()
    return rows.select("kmer", kmer_hash(k).cast("string").alias("hash"), canonical_hash(k).cast("string").alias("canonical_hash"))


# ---- containers ----------------------------------------------------------------------------------------------


@query(sql="with a as (select o_custkey, list(o_orderkey order by o_orderkey) v from orders group by 1) select o_custkey, (select string_agg(x::varchar, ',' order by x%10, x desc) from unnest(v) z(x)) by_last_digit, v[1] first_key, v[len(v)//2+1] middle_key, v[len(v)] last_key, (coalesce(list_position(v, v[2]),0)-1)::int at_second, len(v[2:3])::int copied, array_to_string(list_reverse_sort(v),',') descending from a")
def vector_ops(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    v = F.col("v")
    at = F.coalesce(ct.index_of(v, F.get(v, F.lit(1))), F.lit(-1))
    return a.select(
        "o_custkey", ct.first(v).alias("first_key"), ct.middle(v).alias("middle_key"), ct.last(v).alias("last_key"), at.alias("at_second"),
        F.size(ct.copy_range(v, 1, 2)).alias("copied"), F.array_join(F.sort_array(v, False), ",").alias("descending"),
        F.array_join(ct.sort_by(v, lambda a, b: (a % 10 - b % 10) * 2 + F.signum(b - a)), ",").alias("by_last_digit"),
    )


@query(sql="with a as (select l_orderkey, list(distinct l_returnflag) f, list(distinct l_linestatus) s from lineitem group by 1) select l_orderkey, len(list_distinct(list_concat(f,s)))::int n_union, len(list_intersect(f,['A','R']))::int n_common, list_contains(f,'N') has_n, len(list_filter(f, lambda x: x<>'N'))::int n_without, true any_is_in from a")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s"))
    ar = F.array(F.lit("A"), F.lit("R"))
    return a.select(
        "l_orderkey", F.size(F.array_union("f", "s")).alias("n_union"), F.size(F.array_intersect("f", ar)).alias("n_common"),
        F.array_contains("f", "N").alias("has_n"), F.size(F.array_except("f", F.array(F.lit("N")))).alias("n_without"),
        F.array_contains("f", ct.any_element(F.col("f"))).alias("any_is_in"),
    )


@query(sql="with c as (select user_id, event_type, count(*) n from events group by all) select user_id, count(*)::int kinds, coalesce(max(n) filter (event_type=(select min(event_type) from events)),0) n_first, string_agg(event_type||'='||n, ',' order by event_type) entries, (count(*) filter (n>1))::int repeated from c group by 1")
def map_ops(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    low = e.agg(F.min("event_type")).scalar()
    m = e.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    entries = F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return m.withColumn("low", low).select(
        "user_id", F.size("m").alias("kinds"), F.coalesce(F.try_element_at("m", F.col("low")), F.lit(0)).alias("n_first"), entries.alias("entries"),
        F.size(F.map_keys(F.map_filter("m", lambda _, v: v > 1))).alias("repeated"),
    )


@query(sql="select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def heap_topk(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(sql="select c_nationkey, min(c_custkey) lowest, arg_max(c_custkey, c_acctbal) richest, count(distinct c_mktsegment) segments from customer group by 1")
def ordered_map_lowest(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("lowest"), F.max_by("c_custkey", "c_acctbal").alias("richest"), F.count_distinct("c_mktsegment").alias("segments"))


@query(sql="select visit_id, visited_at, (flags>>1)&1 flag_1, flags|8 with_3, (flags & (~1)) without_0, bit_count(parents::int)::int n_parents, bit_count(children::int)::int n_children from vertex_neighborhoods")
def bitmap_ops(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flags")
    return read_table(spark, d, "vertex_neighborhoods").select(
        "visit_id", "visited_at", ct.bit_get(f, 1).alias("flag_1"), ct.bit_set(f, 3).alias("with_3"), ct.bit_clear(f, 0).alias("without_0"),
        F.bit_count("parents").alias("n_parents"), F.bit_count("children").alias("n_children"),
    )


@query(sql=f"with r as (select regexp_replace(upper(regexp_replace(buffer_for_sequence,'[\\r\\n]+$','')),'[^ACGT]','A','g') s from sequence_reads), k as (select substr(s,i::int,{K}) k from r, unnest(range(1,length(s)-{K}+2)) t(i) where length(s)>={K}) select least(k,{rc('k')}) kmer, count(*) coverage from k group by 1")
def streaming_kmer_count(spark: SparkSession, d: str) -> DataFrame:
    from strandframe.streaming.kmers import count_available

    schema = read_table(spark, d, "sequence_reads").schema
    # the glob finds the table as one file and as a folder of part files
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/sequence_reads.parque[t]")
    return count_available(spark, stream.select(dna.normalize(F.col("buffer_for_sequence")).alias("seq")), K)


@query(sql="select file, count(*) reads, coalesce(sum(length(seq)),0)::bigint bases from sequence_reads where file is not null group by 1")
def streaming_read_totals(spark: SparkSession, d: str) -> DataFrame:
    """Reads and bases of each file, by an operator that keeps state of its own."""
    from strandframe.streaming.kmers import last_updates
    from strandframe.streaming.state import read_totals

    schema = read_table(spark, d, "sequence_reads").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/sequence_reads.parque[t]")
    return last_updates(spark, read_totals(stream), "file", "reads")


# ---- p3: a few keys holding most records ---------------------------------------------------------------------


def _p3_kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = counting(read_table(spark, d, "kmers"), "obs_id", "block_id")
    return skew.totals_by_key(rows, "key", "block_id", "obs_id")


def _p3_stores(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "store_entries").where("store is not null").select("store", "file", "command_id", "store_entries")
    return skew.totals_by_key(rows, "store", "file", "command_id", "store_entries")


@query(sql=f"with {COUNTING} select length(key)::int kmer_length, key kmer, count(*) \"rows\", count(distinct block_id) blocks from c group by key")
def p3_kmer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and blocks of every key."""
    return _p3_kmers(spark, d).select(F.length("key").alias("kmer_length"), F.col("key").alias("kmer"), "rows", F.col("subs").alias("blocks"))


@query(sql="with e as (select distinct store, file, command_id, store_entries from store_entries where store is not null) select store, count(*) commands, count(distinct coalesce(file,'')) files, coalesce(sum(store_entries),0)::bigint entries from e group by 1")
def p3_store_totals(spark: SparkSession, d: str) -> DataFrame:
    """Commands, files and entries of every store; a null file counts as one file."""
    return _p3_stores(spark, d).select(F.col("key").alias("store"), F.col("rows").alias("commands"), F.col("subs").alias("files"), F.col("total").alias("entries"))


@query(sql=f"with {COUNTING}, s as (select distinct command_id, store from store_entries where store is not null) select 'kmer' field, key from c group by key having count(*)*50>=(select count(*) from c) union all select 'store', store::varchar from s group by store having count(*)*50>=(select count(*) from s)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least a fiftieth of the counting rows, and stores that hold as much of the commands."""
    km = skew.heavy_keys(_p3_kmers(spark, d), HEAVY).select(F.lit("kmer").alias("field"), "key")
    st = skew.heavy_keys(_p3_stores(spark, d), HEAVY).select(F.lit("store").alias("field"), F.col("key").cast("string").alias("key"))
    return km.unionByName(st)
