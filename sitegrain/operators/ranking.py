"""Top-n, ordinals and running sums that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key. The rank filter lets Spark cut every partition to n rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def count_with_examples(df: DataFrame, keys: Sequence[str], item: str, n: int, order: str | None = None) -> DataFrame:
    """Rows per key (``count``) and its first n items (``examples``); no group is ever collected whole."""
    order = order or item
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    ranked = top_n(df.select(*keys, F.col(item).alias("_item"), F.col(order).alias("_order")), keys, [F.col("_order"), F.col("_item")], n, "_pos")
    firsts = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_e"))
    return counts.join(firsts, list(keys)).withColumn("examples", F.transform("_e", lambda e: e["_item"])).drop("_e")


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_part: int) -> DataFrame | None:
    """Keys with more rows than one part should hold, and their number of parts; None when there are none.

    Rows are counted by a hash of their key first: only keys whose hash has so many rows are counted themselves, so keys aren't shuffled if none has.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(4096))
    full = [r["_slot"] for r in df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_part).collect()]
    if not full:
        return None
    counts = df.where(slot.isin(full)).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_part)
    hot = counts.select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    return None if hot.isEmpty() else hot


def spread(df: DataFrame, hot: DataFrame | None, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds ``_part``: rows of a hot key are dealt over its parts by a hash of ``by``."""
    if hot is None:
        return df.withColumn("_part", F.lit(0))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    return df.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")


def fan_out(df: DataFrame, hot: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The other side of ``spread``: one copy of a row for each part of its key."""
    if hot is None:
        return df.withColumn("_part", F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return df.join(hot, list(keys), "left").withColumn("_part", F.explode(parts)).drop("_parts")


def with_ordinal(df: DataFrame, lead: Column, tie: str, name: str = "ordinal", buckets: int = 128) -> DataFrame:
    """Zero-based position in the global order (lead, tie) without sorting everything in one task.

    Range limits are read from 4,096 keys picked by hash and become literals, so every task agrees on them; ``tie``
    must be unique, which lets a lead value that half the rows share be split as well.
    """
    keyed = df.withColumn("_key", F.struct(lead.alias("lead"), F.col(tie).alias("tie")))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(4096).collect()
    keys = sorted((r["_key"]["lead"], r["_key"]["tie"]) for r in sample)
    step = max(1, len(keys) // buckets)
    lead_type, tie_type = (f.dataType for f in keyed.schema["_key"].dataType.fields)
    limits = F.array(*[
        F.struct(F.lit(k).cast(lead_type).alias("lead"), F.lit(t).cast(tie_type).alias("tie")) for k, t in keys[step::step]
    ])
    bucketed = keyed.withColumn("_bucket", F.size(F.filter(limits, lambda b: b <= F.col("_key"))) if len(keys) > step else F.lit(0))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # at most `buckets` + 1 rows
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) - 1
    numbered = bucketed.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_key", "_bucket", "_inside", "_offset")


def page_of(df: DataFrame, lead: Column, tie: str, page: int, size: int) -> DataFrame:
    """One page of a sorted table."""
    first = (page - 1) * size
    ranked = with_ordinal(df, lead, tie, "position")
    return ranked.where(F.col("position").between(first, first + size - 1))


def peak_running_sum(events: DataFrame, keys: Sequence[str], at: str, delta: str, slice_seconds: int = 3600) -> DataFrame:
    """Highest running sum of ``delta`` per key. Time slices are summed apart, so one busy key is many small windows."""
    sliced = events.withColumn("_slice", F.floor(F.unix_timestamp(at) / slice_seconds))
    inner = Window.partitionBy(*keys, "_slice").orderBy(at, delta).rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.withColumn("_run", F.sum(delta).over(inner))
    per_slice = running.groupBy(*keys, "_slice").agg(F.max("_run").alias("_peak"), F.sum(delta).alias("_net"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_net").over(earlier), F.lit(0))
    return per_slice.withColumn("_top", offset + F.col("_peak")).groupBy(*keys).agg(F.max("_top").alias("peak"))
