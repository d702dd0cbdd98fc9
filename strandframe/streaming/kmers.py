"""K-mer counts that grow as reads arrive (an extension: the batch engine is bounded)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import words
from strandframe.operators import kmers
from strandframe.session import ensure_checkpoint_dir
from strandframe.sources import sinks


def incremental_counts(stream: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, coverage) of a stream of reads; use it with complete or update output mode."""
    return kmers.count(stream, k, seq)


def last_updates(spark: SparkSession, updates: DataFrame, key: str, order: str) -> DataFrame:
    """What a stream of updates has come to after one availableNow run: for each key the row with the largest `order`,
    which must grow from batch to batch."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    query = updates.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in updates.columns if c != key]
    rows = spark.read.schema(updates.schema).parquet(f"{base}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def count_available(spark: SparkSession, stream: DataFrame, k: int) -> DataFrame:
    """All that a stream holds now, counted by one availableNow run. A batch writes what its own tasks have counted, to
    a folder of its number in the shared folder, so that a batch that is run again replaces its rows; the sum is taken
    once, over all batches. No state is kept: what a batch costs doesn't depend on the batches before it."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    system, place = sinks.at(spark, f"{base}/out")
    system.mkdirs(place)  # a stream without files has no batch

    def write(batch: DataFrame, i: int) -> None:
        kmers.partial_counts(batch, k).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/out/batch={i}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return kmers.summed(spark.read.schema(f"word {words.of(k).kind}, n long").parquet(f"{base}/out"), k)
