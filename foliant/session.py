"""Sessions, table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "foliant") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOLIANT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python need not
    have it on its path."""
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foliant-")
    with zipfile.ZipFile(at := f"{folder}/foliant.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(at)
    sc._foliant_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir;
    where that is unset (tests, one machine) a folder of this process is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, partitioned ``by`` columns, and read it back: lineage
    ends in files that outlive any executor, and nothing upstream runs twice."""
    path = f"{shared_dir(df.sparkSession)}/foliant-{name}-{uuid.uuid4().hex}"
    sc = df.sparkSession.sparkContext
    sc._foliant_written = [*getattr(sc, "_foliant_written", []), path]
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    stored._foliant_path = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether the table ``df`` was cut to is still there."""
    path, sc = getattr(df, "_foliant_path", None), df.sparkSession.sparkContext
    if path is None:
        return False
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def keep(*tables: DataFrame) -> None:
    """These tables stay when others are swept: a stored index, say."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        sc._foliant_written = [p for p in getattr(sc, "_foliant_written", []) if p != getattr(df, "_foliant_path", None)]


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; for stored tables of narrow
    rows, whose count is read from their footers. Beyond it the planner joins as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


HOT_ROWS = 10_000


def join_hot(left: DataFrame, groups: DataFrame, keys: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """``left`` with the row of its group from ``groups``, an aggregate of it that has a count n.
    Groups of more than ``hot`` rows, of which there are at most one for each ``hot`` rows of
    ``left``, are joined by broadcast, so that none of them is one task's."""
    known = cut(groups, "groups")
    big = known.filter(F.col("n") > hot)
    few = big.count()
    if not few or few > 1_000_000:  # none, or so many that none can be a large share
        return left.join(known, keys)
    rest = left.join(F.broadcast(big.select(*keys)), keys, "left_anti").join(known.filter(F.col("n") <= hot), keys)
    return left.join(F.broadcast(big), keys).unionByName(rest)


def deal(members: DataFrame, hot: int = 2000) -> DataFrame:
    """(id, group, shares, own): members (id, group) dealt to shares of their group, about one
    for each ``hot`` members."""
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / hot).cast("int"))
    return cut(join_hot(members, sizes, ["group"]).select("id", "group", "shares", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("own")), "members")


def _each(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def pairs_within(dealt: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of dealt members of a group. Every share of a group meets every
    other in a cell of its own, so a large group is many tasks' work."""
    left = dealt.select(F.col("id").alias("a"), "group", F.col("own").alias("x"), _each("shares").alias("y"))
    right = dealt.select(F.col("id").alias("b"), "group", F.col("own").alias("y"), _each("shares").alias("x"))
    return left.join(right, ["group", "x", "y"]).filter("a < b").select("a", "b")


def pairs_across(dealt: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): dealt members of group_a with those of group_b, for each link (group_a, group_b),
    by shares as above."""
    sizes = dealt.groupBy("group").agg(F.first("shares").alias("shares"))
    sized = links.join(sizes.withColumnsRenamed({"group": "group_a", "shares": "down"}), "group_a").join(sizes.withColumnsRenamed({"group": "group_b", "shares": "across"}), "group_b")
    cells = sized.withColumn("x", _each("down")).withColumn("y", _each("across")).select("group_a", "group_b", "x", "y")
    first = cells.join(dealt.select(F.col("id").alias("a"), F.col("group").alias("group_a"), F.col("own").alias("x")), ["group_a", "x"])
    return first.join(dealt.select(F.col("id").alias("b"), F.col("group").alias("group_b"), F.col("own").alias("y")), ["group_b", "y"]).select("a", "b")


def sweep(spark: SparkSession) -> int:
    """Delete the tables this application has cut so far; results built on them must have been
    written or collected. Returns how many there were."""
    sc = spark.sparkContext
    paths, sc._foliant_written = getattr(sc, "_foliant_written", []), []
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
