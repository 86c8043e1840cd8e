"""Running totals that hold up when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(frame: DataFrame, key: str, order: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` along the whole-number column ``order``.

    A key's rows are cut into spans of ``order``. Totals run inside spans in parallel;
    span sums, combined before their shuffle, give each span its start. Even a key with
    a third of all rows is spread over many tasks.
    """
    cut = frame.withColumn("_span", F.floor(F.col(order) / span))
    sums = cut.groupBy(key, "_span").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy(key, "_span").orderBy(order))
    totals = cut.withColumn("_inside", inside).join(starts, [key, "_span"])
    return totals.withColumn(name, F.col("_start") + F.col("_inside")).drop("_span", "_start", "_inside")


def gaps(frame: DataFrame, key: str, time: str, name: str, span_sec: int = 86_400) -> DataFrame:
    """Seconds since the previous row of the same ``key``, null for a key's first row (STM-09).

    Rows are cut into time spans so that a busy key is spread over tasks; a span's first
    row looks at the end of the key's last earlier span, of which there is one row each.
    """
    cut = frame.withColumn("_span", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / span_sec))
    ends = cut.groupBy(key, "_span").agg(F.max(time).alias("_end"))
    earlier = ends.select(key, "_span", F.lag("_end").over(Window.partitionBy(key).orderBy("_span")).alias("_before"))
    inside = F.lag(time).over(Window.partitionBy(key, "_span").orderBy(time))
    linked = cut.withColumn("_inside", inside).join(earlier, [key, "_span"])
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.coalesce("_inside", "_before").cast("timestamp"))
    return linked.withColumn(name, seconds / 1_000_000).drop("_span", "_inside", "_before")


def best_per_key(rows: DataFrame, key: str, line: str, *order: str) -> DataFrame:
    """WIN-08: of the rows of a key, the line with most letters, then the longest, then the one seen first by ``order``.

    Gives ``key``, ``line``, ``letters``, ``lines`` (rows of the key), the best row's place ``best_<order>`` and the place
    the key was first seen at ``first_<order>``. Both are least structs, combined before the shuffle, so a key with a third
    of all rows costs one row a task. A null line is the least of its key; nulls of ``order`` come first.
    """
    letters = F.length(F.regexp_replace(F.col(line), "[^A-Za-z]", "")).cast("long")
    found = rows.groupBy(F.col(key).alias("key")).agg(
        F.min(F.when(F.col(line).isNotNull(), F.struct((-letters).alias("letters"), (-F.length(line)).alias("length"), *order, F.col(line).alias("line")))).alias("known"),
        F.min(F.struct(*order)).alias("first"),
        F.count("*").alias("lines"),
    )
    return found.select(
        "key", F.col("known.line").alias("line"), (-F.col("known.letters")).alias("letters"), "lines",
        *(F.coalesce(F.col(f"known.{o}"), F.when(F.col("known").isNull(), F.col(f"first.{o}"))).alias(f"best_{o}") for o in order),
        *(F.col(f"first.{o}").alias(f"first_{o}") for o in order),
    )
