"""Session configuration and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the files of the exchanges of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "strandframe", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC set. master None leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names in spark.checkpoint.dir. Only a local session
    without that setting, as in tests, gets a temporary folder; on a cluster it would be seen by one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="strandframe-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder; a lost executor loses nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once and written to the shared folder as a compressed columnar table. Against a checkpoint, later
    steps read only the columns that they need, and the size of the table is known when they are planned. The table
    goes when the session ends. by: a column by which it is parted."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame, part: str = "") -> None:
    """Removes tables that written() made and that nothing reads any more, or one part of them, as column=value."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {m[0] for m in map(re.compile(r".*/table-[0-9a-f]{32}/").match, table.inputFiles()) if m}:
            place = context._jvm.org.apache.hadoop.fs.Path(folder + part)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def settled(df: DataFrame, *over: DataFrame, by: str | None = None) -> DataFrame:
    """written(df), after which the files of its exchanges are gone, and so are the tables `over`, that only it read."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        table = written(df, by)
    finally:
        conf.set(CLEANUP, before)
    dropped(*over)
    return table


class Steps:
    """settled() of one table after the other, of which each is made of the one before, which goes then, and of others."""

    def __init__(self) -> None:
        self.last: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.last = [settled(df, *self.last)]
        return self.last[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
