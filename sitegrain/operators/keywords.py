"""Keyword mining: n-grams of texts, idea scoring and clusters, target phrases of a site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import phrases as ph
from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur
from sitegrain.operators.ranking import top_n
from sitegrain.session import cut_lineage


def top_ngrams(texts: DataFrame, key: str, text: str, n: int, limit: int = 15) -> DataFrame:
    """Most frequent phrases of n words per text with their share of its words.

    A text whose key no other row has is counted and cut to its best phrases within its row, so no phrase is shuffled and a task holds one text at
    a time. Only rows that share a key are turned into phrases that meet by key.
    """
    tokens = F.filter(tx.tokenize(F.col(text)), lambda t: ~t.rlike(r"^\d+$"))
    repeated = cut_lineage(texts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    parts = lambda how: texts.select(key, text).join(repeated, same, how).select(key, tx.let(tokens, lambda t: F.struct(F.size(t).alias("total"), tx.ngrams(t, n).alias("phrases"))).alias("t"))
    best = F.slice(F.array_sort(tx.repetitions(F.col("t.phrases"))), 1, limit)
    own = parts("left_anti").select(key, F.col("t.total").alias("total"), F.posexplode(best).alias("at", "b")).select(
        key, F.col("b.phrase").alias("phrase"), (-F.col("b.less")).cast("bigint").alias("count"), "total", (F.col("at") + 1).alias("rank"))
    rows = parts("left_semi").select(key, F.col("t.total").alias("total"), F.explode("t.phrases").alias("phrase"))
    counted = rows.groupBy(key, "phrase").agg(F.count("*").alias("count"), F.max("total").alias("total")).where("count >= 2")
    ranked = own.unionByName(top_n(counted, [key], [F.col("count").desc(), F.col("phrase")], limit, "rank"))
    share = F.floor(F.col("count") * n / F.col("total") * 10000 + 0.5) / 100
    return ranked.select(key, "phrase", "count", share.alias("density"), "rank")


def idea_scores(suggestions: DataFrame, longest: int | None = None) -> DataFrame:
    """Scores of all suggested keywords per seed from ``(seed, source, query, suggestions)`` lists.

    Every appearance adds 1/position; each further source adds a quarter; the best keyword of a seed is 100. The maximum per
    seed is a partial aggregate joined back, so a seed with very many ideas is never one task. Ideas of more than ``longest``
    characters are left out, if it is given.
    """
    # Cleaned inside the array, so that each text is cleaned once and filters see the finished column.
    clean = F.transform("suggestions", lambda s: tx.squeeze(F.lower(s)))
    rows = suggestions.select("seed", "source", F.posexplode(clean).alias("at", "keyword")).where("keyword <> ''")
    rows = rows.where(F.length("keyword") <= longest) if longest else rows
    position = F.col("at") + 1
    # Shares are summed as integers (units of 2^-40), so the sum does not depend on the order of rows.
    share = F.sum(F.floor(F.lit(2.0**40) / position))
    # Per source first: plain sums shrink before they are shuffled, and sets are gathered of what is left.
    placed = rows.groupBy("seed", "keyword", "source").agg(share.alias("_share"), F.min(position).alias("_best"), F.count("*").alias("_n"))
    ideas = placed.groupBy("seed", "keyword").agg(
        F.sum("_share").alias("_share"), F.min("_best").alias("best_position"), F.sum("_n").alias("appearances"), F.collect_set("source").alias("_sources"))
    named = ideas.select("seed", "keyword", "_share", "best_position", "appearances", F.array_sort("_sources").alias("sources"))
    weighted = named.withColumn("raw", F.col("_share") / F.lit(2.0**40) * (1 + 0.25 * (F.size("sources") - 1)))
    # Scores, clusters and counts read the ideas several times; they are written once so that no text is read again.
    weighted = cut_lineage(weighted)
    best = weighted.groupBy("seed").agg(F.max("raw").alias("best"))
    score = F.greatest(F.lit(1), F.floor(F.col("raw") / F.greatest(F.col("best"), F.lit(1e-9)) * 100 + 0.5)).cast("int")
    return weighted.join(best, "seed").select(
        "seed", "keyword", score.alias("score"), "sources", "best_position", "appearances",
        F.size(F.split("keyword", tx.SPACE + "+")).alias("words"),
        ph.group(F.col("keyword")).alias("group"), ph.intent(F.col("keyword")).alias("intent"))


def ranked_ideas(ideas: DataFrame, limit: int) -> DataFrame:
    """The best ideas of each seed with their ``rank``: highest score first, of equals the keyword that sorts first."""
    return top_n(ideas, ["seed"], [F.col("score").desc(), F.col("keyword")], limit, "rank")


def idea_terms(keyword: Column, seed: Column) -> Column:
    """Distinct words of an idea that could name a cluster."""
    words = F.array_distinct(F.array_except(tx.tokenize(keyword), tx.tokenize(seed)))
    ignored = tx.STOPWORDS + ph.QUESTION_WORDS + ph.CLUSTER_IGNORE
    return F.filter(words, lambda t: ~t.isin(ignored) & (F.length(t) > 2) & ~t.rlike(r"^\d+$"))


def assign_clusters(ideas: DataFrame) -> DataFrame:
    """Adds ``cluster``: the idea's term that most ideas of the seed share (at least two), else "Other"."""
    terms = ideas.select("seed", "keyword", F.explode(idea_terms(F.col("keyword"), F.col("seed"))).alias("term"))
    shared = terms.groupBy("seed", "term").agg(F.count("*").alias("df")).where("df >= 2")
    # Smallest (-df, term) is the most shared term, alphabetical on ties.
    choice = terms.join(shared, ["seed", "term"]).groupBy("seed", "keyword").agg(F.min(F.struct((-F.col("df")).alias("d"), "term")).alias("c"))
    joined = ideas.join(choice, ["seed", "keyword"], "left")
    return joined.withColumn("cluster", F.coalesce("c.term", F.lit("Other"))).drop("c")


def cluster_sizes(ideas: DataFrame, limit: int = 24) -> DataFrame:
    sizes = ideas.where("cluster <> 'Other'").groupBy("seed", "cluster").agg(F.count("*").alias("ideas"))
    return top_n(sizes, ["seed"], [F.col("ideas").desc(), F.col("cluster")], limit, "rank")


def group_counts(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy("seed", "group").agg(F.count("*").alias("ideas"))


def source_health(suggestions: DataFrame) -> DataFrame:
    """Queries, answers, failures and suggestions per source; the error only when nothing was answered."""
    ok = F.count_if("ok")
    return suggestions.groupBy("seed", "source").agg(
        F.count("*").alias("queries"), ok.alias("ok"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.coalesce(F.size("suggestions"), F.lit(0))).alias("suggestions"),
        F.when(ok == 0, F.max_by("error", "ord")).alias("error"))


def filter_ideas(ideas: DataFrame, group: str | None = None, intent: str | None = None, cluster: str | None = None, text: str | None = None) -> DataFrame:
    out = ideas
    for column, wanted in (("group", group), ("intent", intent), ("cluster", cluster)):
        out = out.where(F.col(column) == wanted) if wanted else out
    return out.where(F.contains("keyword", F.lit(text.lower()))) if text else out


def candidate_phrases(sites: DataFrame, limit: int = 14) -> DataFrame:
    """Phrases a site targets, from ``(domain, title, site_name, headings, phrases)`` rows, one row per domain.

    ``phrases`` are the frequent three- and two-word phrases of its text with their counts, in that order. The topic
    vocabulary comes from brand, name, title and first two main headings; other headings and text count only on topic.
    """
    hosts = ur.with_registrable_domain(sites.select(F.col("domain").alias("host")).distinct(), "host")
    label = hosts.select(F.col("host").alias("domain"), F.coalesce(
        F.expr("left(domain, length(domain) - length(public_suffix) - 1)"), F.substring_index("host", ".", 1)).alias("label"))
    h1 = F.slice(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), 1, 2)
    h2 = F.slice(F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: h["text"]), 1, 6)
    name, title = F.coalesce("site_name", F.lit("")), F.coalesce("title", F.lit(""))
    brand = ph.brand_of(F.col("label"))
    texts = F.transform(F.concat(brand, F.array(name, title), h1), ph.normalize_phrase)
    words = F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, " "))), lambda w: (F.length(w) > 2) & ~w.isin(tx.STOPWORDS))
    tag = lambda arr, origin: F.transform(arr, lambda p: F.struct(p.alias("raw"), F.lit(origin).alias("origin")))
    stems = lambda text: F.flatten(F.transform(ph.title_segments(text), ph.with_stems))
    frequent = F.slice(F.transform(F.filter("phrases", lambda p: p["count"] >= 3), lambda p: p["phrase"]), 1, 4)
    found = F.concat(
        tag(brand, "brand"), tag(F.filter(F.array(name), lambda n: n != ""), "brand"), tag(stems(title), "title"),
        tag(F.flatten(F.transform(h1, stems)), "h1"), tag(h2, "h2"), tag(frequent, "content"))
    # Normalised inside the array: the filter below then reads a finished column instead of repeating the work per condition.
    cleaned = F.transform(found, lambda f: F.struct(ph.drop_year(ph.normalize_phrase(f["raw"])).alias("phrase"), f["origin"].alias("origin")))
    rows = sites.join(label, "domain").select("domain", F.transform(words, ph.stem).alias("topic"), F.posexplode(cleaned).alias("ord", "f"))
    on_topic = F.arrays_overlap(F.transform(F.split("f.phrase", " "), ph.stem), F.col("topic"))
    kept = rows.where(ph.acceptable(F.col("f.phrase")) & (~F.col("f.origin").isin("h2", "content") | on_topic)).select("domain", "ord", "f.phrase", "f.origin")
    merged = kept.groupBy("domain", "phrase").agg(F.collect_set("origin").alias("_o"), F.min("ord").alias("ord"))
    listed = merged.select("domain", F.col("phrase").alias("keyword"), ph.origin_list(F.col("_o")).alias("found_in"), "ord")
    order = F.array_position(F.array(*[F.lit(o) for o in ph.ORIGINS]), F.get("found_in", F.lit(0)))
    return top_n(listed.withColumn("origin_order", order), ["domain"], [F.col("origin_order"), F.col("ord")], limit, "position").drop("ord")


def _best_keywords(rows: DataFrame, limit: int) -> DataFrame:
    levelled = rows.withColumn("level", ph.volume_level(F.col("volume")))
    return top_n(levelled, ["domain"], [F.col("volume").desc(), F.col("origin_order"), F.col("position")], limit, "rank")


def keywords_from_volumes(candidates: DataFrame, volumes: DataFrame, limit: int = 10) -> DataFrame:
    """Target keywords with known search volumes; phrases without searches drop out.

    Where both tables name a market (country ``gl``, language ``hl``), a keyword meets the volume of its own market; else the highest of
    all markets.
    """
    markets = [c for c in ("gl", "hl") if c in volumes.columns and c in candidates.columns]
    known = volumes.where("volume > 0").groupBy("keyword", *markets).agg(F.max("volume").alias("volume"))
    rows = candidates.join(known, ["keyword", *markets]).withColumn("estimated", F.lit(False)).withColumn("typed_prefix", F.lit(None).cast("string"))
    return _best_keywords(rows, limit)


def shortest_prefixes(candidates: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Per phrase the shortest typed prefix whose suggestions hold it, from landed ``(prefix, suggestions)`` lists.

    Equal to a binary search when longer prefixes keep suggesting the phrase. Phrase and lists meet on the compacted text, so
    no phrase is compared with a list that does not hold it.
    """
    markets = [c for c in ("engine", "gl", "hl") if c in prefixes.columns and c in candidates.columns]
    listed = prefixes.select(*markets, "prefix", "suggestions", F.posexplode("suggestions").alias("at", "s"))
    listed = listed.select(*markets, "prefix", "suggestions", (F.col("at") + 1).alias("position"), ph.compact(F.col("s")).alias("compact"))
    wanted = candidates.select("keyword", *markets).distinct().withColumn("compact", ph.compact(F.col("keyword")))
    hits = wanted.join(listed, ["compact", *markets]).where(F.startswith("keyword", "prefix"))
    best = hits.groupBy("keyword", *markets).agg(F.min_by(F.struct("prefix", "position", "suggestions"), F.struct(F.length("prefix"), F.col("position"), F.col("prefix"), F.col("suggestions"))).alias("b"))
    # A phrase that is not suggested when typed in full has too few searches to count.
    full = hits.where(F.col("prefix") == F.col("keyword")).select("keyword", *markets).distinct()
    return best.join(full, ["keyword", *markets], "left_semi").select("keyword", *markets, "b.*")


def keywords_from_estimates(candidates: DataFrame, prefixes: DataFrame, limit: int = 10) -> DataFrame:
    """Target keywords with rough volumes from search suggestions."""
    best = shortest_prefixes(candidates, prefixes)
    volume = ph.estimate_volume(F.length("prefix"), F.col("position"), ph.competitors(F.col("keyword"), F.col("suggestions")))
    markets = [c for c in best.columns if c in ("engine", "gl", "hl")]
    scored = best.select("keyword", *markets, volume.alias("volume"), F.col("prefix").alias("typed_prefix"))
    return _best_keywords(candidates.join(scored, ["keyword", *markets]).withColumn("estimated", F.lit(True)), limit)


def site_keywords(candidates: DataFrame, prefixes: DataFrame, volumes: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Known volumes when a volume table is given, else estimates."""
    return keywords_from_volumes(candidates, volumes, limit) if volumes is not None else keywords_from_estimates(candidates, prefixes, limit)


def merge_volumes(requested: DataFrame, volumes: DataFrame) -> DataFrame:
    """Requested keywords with their volume; null where there is none."""
    norm = lambda c: tx.squeeze(F.lower(c))
    left = requested.withColumn("_k", norm("keyword"))
    right = volumes.groupBy(norm("keyword").alias("_k")).agg(F.max_by("volume", "ord").alias("volume"))
    return left.join(right, "_k", "left").drop("_k")


def union_phrases(three: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Three-word phrases before two-word phrases, as one array per key."""
    both = reduce(DataFrame.unionByName, [three.withColumn("n", F.lit(0)), two.withColumn("n", F.lit(1))])
    packed = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "rank", "phrase", "count"))).alias("_p"))
    return packed.select(key, F.transform("_p", lambda p: F.struct(p["phrase"].alias("phrase"), p["count"].alias("count"))).alias("phrases"))


def recent_searches(log: DataFrame, stored: int = 30) -> DataFrame:
    """Newest entry per user, tool and lower-cased query; the newest 30 per user."""
    once = log.where(F.trim("query") != "").groupBy("user_id", "tool", F.lower(F.trim("query")).alias("_q")).agg(
        F.max("at").alias("at"), F.max_by("query", F.struct("at", "query")).alias("query"))
    return top_n(once, ["user_id"], [F.col("at").desc(), F.col("tool"), F.col("_q")], stored, "position").drop("_q")


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Percent of the column total per row, one decimal; the total is a scalar subquery."""
    total = F.nullif(df.agg(F.sum(value)).scalar(), F.lit(0))
    return df.withColumn("pct", F.floor(F.col(value) / total * 1000 + 0.5) / 10)


def duplicates_flagged(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key wins; later rows are flagged."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key).withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")
