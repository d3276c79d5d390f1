"""robots.txt: landed files to rule rows, agent groups, and verdicts per URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions import urls as ur

# The directive names a robots file may hold.
KNOWN = ["user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host", "clean-param", "noindex", "request-rate", "visit-time"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(site, line, raw, key, value, known)``: one row per line that holds more than a comment."""
    body = F.regexp_replace("text", r"^\x{FEFF}", "")
    lines = robots.select("site", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("pos", "raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("raw", r"#.*$", ""), r"^\s+|\s+$", ""))
    has_colon = F.col("clean").contains(":")
    key = F.lower(F.trim(F.substring_index("clean", ":", 1)))
    value = F.trim(F.expr("substr(clean, instr(clean, ':') + 1)"))
    return (
        lines.withColumn("clean", clean)
        .where("clean <> ''")
        .select("site", (F.col("pos") + 1).alias("line"), "raw", key.alias("key"), value.alias("value"),
                (has_colon & key.isin(KNOWN)).alias("known"))
    )


def robots_rules(lines: DataFrame) -> DataFrame:
    """Lines inside agent groups with their ``group_no``. A file is small by nature, so a window per file is bounded."""
    order = Window.partitionBy("site").orderBy("line")
    agent = F.col("key") == "user-agent"
    opens = agent & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    return (
        lines.where(F.col("known") & (F.col("key") != "sitemap"))
        .withColumn("opens", opens.cast("int"))
        .withColumn("group_no", F.sum("opens").over(order))
        .where((F.col("group_no") > 0) & ((F.col("key") != "disallow") | (F.col("value") != "")))
        .drop("opens", "known")
    )


def robots_summary(lines: DataFrame) -> DataFrame:
    """Sitemap list and number of lines that could not be read, per site."""
    return lines.groupBy("site").agg(
        F.array_sort(F.collect_set(F.when((F.col("key") == "sitemap") & F.col("known") & (F.col("value") != ""), F.col("value")))).alias("sitemaps"),
        F.count_if(~F.col("known")).alias("invalid_lines"),
    )


def _decode(path: Column) -> Column:
    """Percent-decoding that leaves reserved characters escaped; undecodable text stays as it is."""
    guarded = F.regexp_replace(path, r"(?i)%(?=23|24|26|2B|2C|2F|3A|3B|3D|3F|40)", "%25")
    return F.coalesce(F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B"))), path)


def _pattern(path: Column) -> Column:
    decoded = _decode(path)
    body = F.regexp_replace(decoded, r"\$$", "")
    escaped = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), escaped, F.when(decoded.endswith("$"), "$").otherwise(""))


def agent_rules(rules: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """One row per site: for each crawler token its rule list and crawl delay, groups naming the same agent merged."""
    agents = rules.where("key = 'user-agent'").select("site", "group_no", "line", F.lower("value").alias("agent"))
    wanted = agents.select("*", F.explode(F.array(*[F.lit(t.lower()) for t in tokens])).alias("token"))
    named = (F.col("agent") != "*") & (F.col("agent") != "") & F.contains("token", "agent")
    best = wanted.groupBy("site", "token").agg(
        F.coalesce(
            F.max_by("agent", F.when(named, F.struct(F.length("agent"), -F.col("line")))),
            F.max(F.when(F.col("agent") == "*", "*")),
        ).alias("agent")
    ).where("agent is not null")
    groups = best.join(agents, ["site", "agent"]).select("site", "token", "group_no").distinct()
    delay = F.when(F.col("value") == "", F.lit(0.0)).when(F.col("value").rlike(NUMBER), F.col("value").try_cast("double"))
    lines = rules.select(
        "site", "group_no", "line",
        F.when(F.col("key").isin("allow", "disallow") & (F.col("value") != ""),
               F.struct(F.length("value").alias("size"), (F.col("key") == "allow").alias("allow"), _pattern(F.col("value")).alias("pattern"))).alias("rule"),
        F.when((F.col("key") == "crawl-delay") & (delay >= 0), delay).alias("delay"),
    )
    per_group = lines.groupBy("site", "group_no").agg(
        F.collect_list("rule").alias("rules"), F.max_by("delay", F.when(F.col("delay").isNotNull(), F.col("line"))).alias("delay"))
    per_token = groups.join(per_group, ["site", "group_no"]).groupBy("site", "token").agg(
        F.flatten(F.collect_list("rules")).alias("rules"),
        F.min_by("delay", F.when(F.col("delay").isNotNull(), F.col("group_no"))).alias("delay"))
    return per_token.groupBy("site").agg(
        F.map_from_entries(F.collect_list(F.struct("token", F.struct("rules", "delay")))).alias("by_token"))


def verdict(by_token: Column, token: str, url: Column) -> Column:
    """Whether a crawler may fetch the URL: the longest matching rule decides and allow wins a tie."""
    target = ur.path_and_query(url)
    decoded = _decode(target)
    rules = F.element_at(by_token, F.lit(token.lower()))["rules"]
    hits = F.filter(rules, lambda r: F.rlike(decoded, r["pattern"]))
    winner = F.array_max(F.transform(hits, lambda r: F.struct(r["size"], r["allow"])))
    free = ~url.rlike(ur.HTTP_URL) | (target == "/robots.txt")
    return F.when(free, True).otherwise(F.coalesce(winner["allow"], F.lit(True)))


def robots_access(urls: DataFrame, robots: DataFrame, search_bots: Sequence[str] = ("googlebot", "bingbot"), own_token: str = "sitegrainbot") -> DataFrame:
    """Verdict columns per URL. Sites without a file allow everything; a failed fetch (``fetched`` false) stays unknown.

    Rules travel as one row per site, so a site with many URLs never multiplies rows by rules.
    """
    tokens = [*search_bots, own_token]
    rules = agent_rules(robots_rules(robots_lines(robots.where("text is not null"))), tokens)
    state = robots.groupBy("site").agg(F.max("fetched").alias("_fetched"))
    joined = urls.join(state.join(rules, "site", "left"), "site", "left")
    known = F.coalesce(F.col("_fetched"), F.lit(False))
    columns = {b: F.when(known, verdict(F.col("by_token"), b, F.col("url"))) for b in search_bots}
    columns["other_bots"] = F.when(known, verdict(F.col("by_token"), own_token, F.col("url")))
    return joined.withColumns(columns).drop("by_token", "_fetched")
