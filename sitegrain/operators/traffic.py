"""Popularity ranks to visit estimates, tiers, summaries and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import js_round
from sitegrain.operators.ranking import top_n

# Fixed values: (rank, monthly visits) anchors, tier bands and the ceiling for unranked sites.
ANCHORS = [(1, 80e9), (10, 2.5e9), (100, 300e6), (1_000, 30e6), (10_000, 2.5e6), (100_000, 180e3), (1_000_000, 9e3)]
TIERS = [(100, "Top 100"), (1_000, "Top 1K"), (10_000, "Top 10K"), (100_000, "Top 100K")]
UNRANKED_CEILING = 9e3


def visit_estimate(rank: Column) -> Column:
    """struct<low, mid, high, factor> of monthly visits: log-log interpolation between anchors; null below rank 1."""
    log_rank = F.log10(rank.cast("double"))
    mid: Column = F.when(rank <= 1, F.lit(ANCHORS[0][1]))
    for i, ((r1, v1), (r2, v2)) in enumerate(zip(ANCHORS, ANCHORS[1:])):
        lr1, lv1, lv2 = math.log10(r1), math.log10(v1), math.log10(v2)
        line = F.pow(F.lit(10.0), F.lit(lv1) + (log_rank - F.lit(lr1)) * F.lit((lv2 - lv1) / (math.log10(r2) - lr1)))
        mid = mid.otherwise(line) if i == len(ANCHORS) - 2 else mid.when(rank <= r2, line)
    factor = js_round((F.lit(2.0) + F.lit(0.25) * log_rank) * 10) / 10
    return F.when(rank >= 1, F.struct((mid / factor).alias("low"), mid.alias("mid"), (mid * factor).alias("high"), factor.alias("factor")))


def popularity_tier(rank: Column) -> Column:
    tier = F.when(F.coalesce(rank, F.lit(0)) == 0, "Unranked")
    for top, label in TIERS:
        tier = tier.when(rank <= top, label)
    return tier.otherwise("Top 1M")


def rank_summary(history: DataFrame) -> DataFrame:
    """Latest, best, worst and change (first minus latest; null for one point) per domain."""
    point = F.struct("date", "rank")
    return history.groupBy("domain").agg(
        F.max("date").alias("latest_date"), F.max_by("rank", point).alias("latest"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
        F.when(F.count("*") > 1, F.min_by("rank", point) - F.max_by("rank", point)).alias("change"))


def daily_visits(history: DataFrame) -> DataFrame:
    visits = F.coalesce(js_round(visit_estimate(F.col("rank"))["mid"]), F.lit(0))
    return history.select("domain", "date", "rank", visits.alias("visits"))


def traffic_section(domains: DataFrame, history: DataFrame) -> DataFrame:
    """Rank summary, visit estimate and tier per requested domain; unranked domains keep a row."""
    joined = domains.join(rank_summary(history), "domain", "left")
    return joined.withColumn("estimate", visit_estimate(F.col("latest"))).withColumn("tier", popularity_tier(F.col("latest")))


def comparison(sections: DataFrame) -> DataFrame:
    """Compare table: rank, change, rounded visits and tier, or the error."""
    visits = lambda f: F.nullif(js_round(F.col(f"estimate.{f}")), F.lit(0).cast("bigint"))
    return sections.select(
        "domain", F.col("latest").alias("rank"), F.col("change").alias("rank_change"), visits("mid").alias("est_monthly_visits"),
        visits("low").alias("est_low"), visits("high").alias("est_high"), "tier")


def aligned_series(history: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Ranks of a few domains side by side on the union of their dates; a comparison holds at most eight."""
    if len(domains) > 8:
        raise ValueError("at most 8 domains are compared")
    return history.where(F.col("domain").isin(list(domains))).groupBy("date").pivot("domain", list(domains)).agg(F.first("rank"))


def requested_domains(requests: DataFrame, limit: int = 8) -> DataFrame:
    """Requested domains per comparison: the first of each, capped, later repeats flagged."""
    first = requests.groupBy("request_id", "domain").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))
    return top_n(first, ["request_id"], [F.col("pos"), F.col("domain")], limit, "position")
