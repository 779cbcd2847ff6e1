"""Frame helpers: tables in the cluster's shared folder, connected components, arrow maps."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import shared_root

#: Rows in an Arrow batch; with texts of a few kB a batch stays in the low megabytes.
BATCH_ROWS = 512


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def per_worker(key: tuple, make: Callable):
    """What ``make`` gives, once per worker process: classes travel by value, so a task cannot keep it in one of their attributes."""
    kept = sys.__dict__.setdefault("_barloom_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


#: The 256 remainders of the byte-wise crc32, as a list of the one row of ``crc_table`` (a CTE for SQL twins).
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def crc_sql(text: str, t: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a text's UTF-8 bytes; ``t`` is the list of ``CRC_TABLE``."""
    data = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c // 256, {t}[xor(c, b) % 256 + 1])), 4294967295)"


def numbered(df: DataFrame, order: list[str], group: str | None = None, name: str = "numbered") -> DataFrame:
    """``df`` with ``i``, the place from 0 in ascending ``order`` (nulls first) within ``group``, and ``n``, the rows of the group.

    A range partitioning by group and order spreads a group that holds a third of all rows; each range counts its own rows, and the
    rows before a range come from a table with one row per range and group. Equal rows may stand in either order.
    """
    whole = group or "__whole"
    if group is None:
        df = df.withColumn(whole, F.lit(0))
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(whole, *order, "__tie")
    ranged = saved(ranged.withColumn("__range", F.spark_partition_id()), name)
    counts = ranged.groupBy("__range", whole).agg(F.count("*").alias("rows"))
    ranges = Window.partitionBy(whole).orderBy("__range")
    starts = counts.select(
        F.col("__range").alias("__r"), F.col(whole).alias("__g"), (F.sum("rows").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("__before"),
        F.sum("rows").over(Window.partitionBy(whole)).alias("__n"))
    own = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range", whole).orderBy(*order)).cast("long"))
    out = own.join(starts, (F.col("__range") == F.col("__r")) & F.col(whole).eqNullSafe(F.col("__g")))
    return out.select(*[c for c in df.columns if c != "__whole"], (F.col("__before") + F.col("__place") - 1).alias("i"), F.col("__n").alias("n"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) links to (node, component), component being the smallest node reached; nodes without links are left out.

    Alternating large-star and small-star rounds: each node sees only the smallest of its neighbours, found by a pre-aggregated
    minimum, so a node with a third of all links is an aggregate and a join that Spark can split, never a collected list.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    while True:
        e = saved(e, name)
        # done once no smaller end of a link is the larger end of another one
        if e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and e.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.filter("m <> a").select("a", F.col("m").alias("b")))
        large = saved(large.filter("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
