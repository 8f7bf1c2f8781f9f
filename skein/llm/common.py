"""Column expressions and small plans that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skein.session import ship, stage

ARROW_ROWS = 1000  # rows of one batch between Spark and Python: texts may be long

# A word is a run of digits, a-z and characters beyond ASCII, after A-Z became a-z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ready(df: DataFrame) -> DataFrame:
    """``df`` in a session whose tasks can import this package and take few rows at a time."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` is the fast way but also folds letters beyond ASCII; texts that hold such capitals go through ``translate``.
    """
    folds = text.rlike(r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]")
    return F.when(folds, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none. Splitting between words is linear in the text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP_PATTERN), "")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in range partitions by ``order``, staged with its partition number in ``__part``.

    The table is written before anything reads the number, because sampling could draw other bounds a second time.
    """
    parted = df.repartitionByRange(partitions(df), *[F.col(c).asc_nulls_first() for c in order])
    return stage(parted.withColumn("__part", F.spark_partition_id()), name)


def running_start(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group, without one task for a whole group.

    Rows are cut into ranges of (group, order); sums of whole ranges are added up in a small table of one row for each range
    and group, and the window runs inside a range only. ``order`` must tell rows apart, or tied rows must be equal.
    """
    parts = ranged(df, [*group, *order], name)
    keys = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    totals = parts.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
                            F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = parts.withColumn(out, F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(offsets, [F.col("__part") == F.col("__p"), *keys], "left")
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__p", "__before", *[f"__g{i}" for i in range(len(group))])
