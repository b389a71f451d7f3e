"""What the operators share: staging, folds, word patterns and lower-casing of A-Z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.session import cut_lineage as _cut, staging_path

#: The contract's word patterns (Java syntax).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["LOWER", "PLAIN_WORD", "SPACED_WORD", "UPPER", "cut_lineage", "discard", "fold", "lower_ascii", "null_safe_join", "positions", "staging_path", "table"]


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    out = _cut(df, name)
    out._staged = True
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `cut_lineage` wrote, once everything that reads them is written itself."""
    for frame in frames:
        files = frame.inputFiles() if getattr(frame, "_staged", False) else []
        if files:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the faster `lower`, which agrees there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_key_{k}" for k in keys])


def positions(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` with `pos` (from 0) and, per entry of `sums`, the total of all rows before, along a global order.

    Rows are dealt out by range; only one row of totals per range is put in order in one task.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    terms = {"pos": F.lit(1).cast("long"), **sums}
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in terms.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in terms])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in terms.items()])
    return placed.join(totals, "_range").select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in terms])
