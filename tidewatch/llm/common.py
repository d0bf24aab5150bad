"""What several operators share: durable intermediate tables, ids and components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
NOT_WORD = r"[\x20\x09-\x0D]"
OWN: dict[str, str] = {}
#: Spark's setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and everything runs in one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or OWN.setdefault("dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return f"{found.rstrip('/')}/tidewatch-{spark.sparkContext.applicationId}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again.

    Cuts the lineage: a lost executor costs its running tasks, not the stages
    before, and whatever reads the result twice computes it once. The shuffle
    files of the write go with its end, since nothing reads them again: for as
    long as it runs, CLEANUP is on in the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    try:
        before = spark.conf.get(CLEANUP)
    except PySparkException:  # a Spark without this setting
        before = None
    try:
        if before is not None:
            spark.conf.set(CLEANUP, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns an operator needs, under its own names; whatever else `df` has cannot clash."""
    return df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in wanted.items()))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b): a row (id, component) for each node of an edge.

    Alternates large-star and small-star steps until nothing changes, which
    takes a number of rounds logarithmic in the component's size. Every step is
    a partially aggregated minimum and an equi-join, so hubs neither gather in
    one task before the join nor stop Spark from splitting a skewed partition.
    component is the smallest id reachable.
    """
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # Done when the edges are stars: each node below one root, no root below another.
        ends = state.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty():
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state, before = written(small.distinct()), state
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
