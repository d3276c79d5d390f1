"""Keyword, traffic, third-party JSON, domain and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.functions import dates, phrases as ph
from sitegrain.functions import text as tx
from sitegrain.operators import domains, keywords, traffic
from sitegrain.operators.ranking import top_n
from sitegrain.plans.catalog import query
from sitegrain.plans.content import STOP, TOKENS
from sitegrain.plans.landed import derive, landed, table
from sitegrain.sources import json_sources as js
from sitegrain.sources import responses
from sitegrain import streaming

AS_OF = "2024-06-01 00:00:00"
#: Two words of any script, as a suggestion.
PAIR = r"[\p{L}\p{N}]+ [\p{L}\p{N}]+"
PAIRS = f"regexp_extract_all(lower(text), '{PAIR}')"


def suggestion_lists(spark, d):
    return landed(spark, d, "suggestion_texts").select(
        "seed", F.col("engine").alias("source"), F.col("doc_id").cast("string").alias("query"), "ok", F.col("doc_id").alias("ord"),
        F.when(F.col("ok"), F.regexp_extract_all(F.lower("text"), F.lit(PAIR), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("suggestions"),
        F.when(~F.col("ok"), F.concat(F.lit("error "), "doc_id")).alias("error"))


IDEAS = f"""placed AS MATERIALIZED (SELECT seed, engine, keyword, position, count(*) AS n FROM (SELECT seed, engine, unnest(l) AS keyword, unnest(range(1, len(l) + 1)) AS position FROM
    (SELECT seed, engine, {PAIRS} AS l FROM suggestion_texts WHERE ok) x) y GROUP BY ALL),
    raw AS (SELECT seed, keyword, sum(n * floor(1099511627776.0::DOUBLE / position)) / 1099511627776.0::DOUBLE * (1 + 0.25 * (count(DISTINCT engine) - 1)) AS raw,
    array_to_string(list_sort(list_distinct(list(engine))), ' ') AS sources, min(position) AS best_position, CAST(sum(n) AS BIGINT) AS appearances FROM placed GROUP BY seed, keyword),
    ideas AS MATERIALIZED (SELECT *, CAST(greatest(1, floor(raw / max(raw) OVER (PARTITION BY seed) * 100 + 0.5)) AS INT) AS score FROM raw)"""


@query("suggestion_scores", f"WITH {IDEAS} SELECT seed, keyword, score, sources, best_position, appearances, 2 AS words FROM ideas")
def suggestion_scores(spark, d):
    ideas = keywords.idea_scores(suggestion_lists(spark, d))
    return ideas.select("seed", "keyword", "score", F.array_join("sources", " ").alias("sources"), F.col("best_position").cast("bigint").alias("best_position"), "appearances", "words")


@query("ranked_ideas", f"WITH {IDEAS} SELECT seed, keyword, score, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, keyword) AS INT) AS rank FROM ideas QUALIFY rank <= 50")
def ranked_ideas(spark, d):
    return keywords.ranked_ideas(keywords.idea_scores(suggestion_lists(spark, d)), 50).select("seed", "keyword", "score", "rank")


IGNORED = STOP + ", " + ", ".join(f"'{w}'" for w in ph.QUESTION_WORDS + ph.CLUSTER_IGNORE)
CLUSTERS = f"""{IDEAS}, terms AS MATERIALIZED (SELECT DISTINCT seed, keyword, term FROM (SELECT seed, keyword, unnest(string_split(keyword, ' ')) AS term FROM ideas) t
    WHERE length(term) > 2 AND NOT regexp_matches(term, '^[0-9]+$') AND term <> seed AND term NOT IN ({IGNORED})), df AS (SELECT seed, term, count(*) AS df FROM terms GROUP BY ALL HAVING count(*) >= 2),
    best AS (SELECT seed, keyword, min(struct_pack(d := -df, term := term)).term AS term FROM terms JOIN df USING (seed, term) GROUP BY seed, keyword),
    clustered AS (SELECT i.seed, i.keyword, coalesce(b.term, 'Other') AS cluster FROM ideas i LEFT JOIN best b USING (seed, keyword))"""


@query("keyword_clusters", f"WITH {CLUSTERS} SELECT * FROM clustered")
def keyword_clusters(spark, d):
    return keywords.assign_clusters(keywords.idea_scores(suggestion_lists(spark, d))).select("seed", "keyword", "cluster")


@query("cluster_sizes", f"""WITH {CLUSTERS} SELECT seed, cluster, count(*) AS ideas, CAST(row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, cluster) AS INT) AS rank FROM clustered
    WHERE cluster <> 'Other' GROUP BY seed, cluster QUALIFY rank <= 24""")
def cluster_sizes(spark, d):
    return keywords.cluster_sizes(keywords.assign_clusters(keywords.idea_scores(suggestion_lists(spark, d))))


INTENT = f"""CASE WHEN regexp_matches(k, '{ph.TRANSACTIONAL}') THEN 'Transactional' WHEN regexp_matches(k, '{ph.COMMERCIAL}') THEN 'Commercial'
    WHEN regexp_matches(k, '{ph.NAVIGATIONAL}') THEN 'Navigational' ELSE 'Informational' END"""
QWORDS = ", ".join(f"'{w}'" for w in ph.QUESTION_WORDS)
GROUP = rf"""CASE WHEN regexp_extract(lower(k), '^\S*') IN ({QWORDS}) OR strpos(k, '?') > 0 OR regexp_matches(' ' || lower(k) || ' ', '\b(how to|what is|why do|is it)\b') THEN 'Questions'
    WHEN regexp_matches(' ' || lower(k) || ' ', '\s(vs\.?|versus|or|alternative|alternatives|compared to|comparison)\s') THEN 'Comparisons'
    WHEN regexp_matches(' ' || lower(k) || ' ', '\s(for|with|without|to|near|like|from|in|on)\s') THEN 'Prepositions' WHEN len(regexp_extract_all(k, '\S+')) >= 4 THEN 'Long-tail' ELSE 'Related' END"""
@query("intent_group_turns", f"SELECT conv_id, turn, {INTENT} AS intent, {GROUP} AS grp FROM (SELECT conv_id, turn, text AS k FROM conversations) c")
def intent_group_turns(spark, d):
    """Intent and group of the whole text of every turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", ph.intent(F.col("text")).alias("intent"), ph.group(F.col("text")).alias("grp"))


@query("group_counts", f"WITH {IDEAS} SELECT seed, grp, count(*) AS ideas FROM (SELECT seed, {GROUP} AS grp FROM (SELECT seed, keyword AS k FROM ideas) i) g GROUP BY ALL")
def group_counts(spark, d):
    return keywords.group_counts(keywords.idea_scores(suggestion_lists(spark, d))).withColumnRenamed("group", "grp")


@query("filtered_ideas", f"WITH {IDEAS} SELECT seed, keyword FROM (SELECT seed, keyword, keyword AS k FROM ideas) i WHERE {GROUP} = 'Prepositions' AND keyword LIKE '%the%'")
def filtered_ideas(spark, d):
    return keywords.filter_ideas(keywords.idea_scores(suggestion_lists(spark, d)), group="Prepositions", text="The").select("seed", "keyword")


@query("source_health", f"""SELECT seed, engine AS source, count(*) AS queries, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed,
    CAST(sum(CASE WHEN ok THEN len({PAIRS}) ELSE 0 END) AS BIGINT) AS suggestions, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'error ' || max(doc_id) END AS error FROM suggestion_texts GROUP BY ALL""")
def source_health(spark, d):
    return keywords.source_health(suggestion_lists(spark, d))


QUERIES_SQL = "[s, s || ' '" + "".join(f", '{w} ' || s" for w in ph.QUESTION_WORDS) + "".join(f", s || ' {p} '" for p in ph.PREPOSITIONS) + \
    "".join(f", '{m} ' || s" for m in ph.PREFIX_MODIFIERS) + "".join(f", s || ' {c}'" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@query("query_expansion", f"SELECT DISTINCT s_suppkey, unnest({QUERIES_SQL}) AS query FROM (SELECT s_suppkey, lower(trim(s_name)) AS s FROM supplier) x")
def query_expansion(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.explode(ph.expand_queries(F.col("s_name"), deep=True)).alias("query"))


SITE_TEXTS = """SELECT 'best-' || lower(replace(p_type, ' ', '-')) || CAST(p_partkey AS STRING) || '.com' AS domain, p_name || ' for home use today | ' || p_brand AS title, p_brand AS site_name,
    p_name || ' guide' AS h1, p_name || ' reviews 2024' AS h2, p_partkey FROM part"""


def candidates_of(spark, d):
    head = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).alias("text"))
    frequent = F.array(F.struct(F.concat(F.split("title", " ")[0], F.lit(" price")).alias("phrase"), F.lit(3).cast("bigint").alias("count")),
                       F.struct(F.lit("unrelated words").alias("phrase"), F.lit(9).cast("bigint").alias("count")))
    rows = derive(spark, d, SITE_TEXTS).withColumns({"headings": F.array(head(1, "h1"), head(2, "h2")), "phrases": frequent})
    return keywords.candidate_phrases(rows)


PHRASE_ROWS = f"""cand AS (SELECT domain, k AS keyword, string_agg(o, ' ' ORDER BY p) AS found_in, min(p) AS first_place, min(i) AS ord FROM (SELECT domain, k, o, min(p) AS p, min(i) AS i FROM (
    SELECT 'best-' || lower(p_type) || p_partkey || '.com' AS domain, unnest(['best ' || lower(p_type) || p_partkey, 'best' || lower(p_type) || p_partkey, replace(lower(p_brand), '#', ' '),
    p_name || ' for home use today', split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2), replace(lower(p_brand), '#', ' '), p_name || ' guide', p_name || ' reviews',
    split_part(p_name, ' ', 1) || ' price']) AS k, unnest(['brand', 'brand', 'brand', 'title', 'title', 'title', 'h1', 'h2', 'content']) AS o, unnest([1, 1, 1, 2, 2, 2, 3, 4, 5]) AS p, unnest(range(9)) AS i FROM part) x
    WHERE o <> 'content' OR split_part(k, ' ', 1) NOT IN ({STOP}) GROUP BY domain, k, o) y GROUP BY domain, k)"""


@query("target_phrases", f"WITH {PHRASE_ROWS} SELECT domain, keyword, found_in FROM cand")
def target_phrases(spark, d):
    return candidates_of(spark, d).select("domain", "keyword", F.array_join("found_in", " ").alias("found_in"))


VOLUME_ROWS = """SELECT DISTINCT split_part(p_name, ' ', 1) || ' price' AS keyword, 'us' AS gl, length(p_name) * 700 AS volume FROM part UNION ALL SELECT DISTINCT p_name || ' guide', 'us', 0 FROM part
    UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1) || ' price', 'de', length(p_name) * 900 FROM part"""
VOLUMES_BEST = "SELECT keyword, max(volume) AS volume FROM (" + VOLUME_ROWS + ") v WHERE gl = CASE WHEN length(keyword) % 2 = 0 THEN 'us' ELSE 'de' END GROUP BY keyword"


@query("keywords_from_volumes", f"""WITH {PHRASE_ROWS}, vol AS ({VOLUMES_BEST}) SELECT domain, keyword, volume, CASE WHEN volume >= 10000 THEN 'High' WHEN volume >= 1000 THEN 'Medium' ELSE 'Low' END AS level,
    CAST(row_number() OVER (PARTITION BY domain ORDER BY volume DESC, first_place, ord) AS INT) AS rank FROM cand JOIN vol USING (keyword) WHERE volume > 0 QUALIFY rank <= 10""")
def keywords_from_volumes(spark, d):
    asked = candidates_of(spark, d).withColumn("gl", F.when(F.length("keyword") % 2 == 0, "us").otherwise("de"))
    return keywords.keywords_from_volumes(asked, derive(spark, d, VOLUME_ROWS)).select("domain", "keyword", "volume", "level", "rank")


# Prefix lists: every start of a part name of at least half its length suggests it, third after two rivals.
def prefix_lists(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    starts = F.explode(F.sequence(F.ceil(F.length("name") / 2).cast("int"), F.length("name")))
    typed = names.select("name", starts.alias("n")).select("name", F.substring("name", F.lit(1), F.col("n")).alias("prefix"))
    return typed.select("prefix", F.array(F.lit("weather"), F.concat("name", F.lit(" shop")), F.col("name")).alias("suggestions"))


VOLUME_FORMULA = "(7.6::DOUBLE - 0.45::DOUBLE * (plen + 3 * (1 - least(10, 1)::DOUBLE / 10)) - log10(3.0::DOUBLE))"


ESTIMATES = f"""SELECT keyword, prefix, CAST(floor(v / pow(10, floor(log10(v))) + 0.5) * pow(10, floor(log10(v))) AS BIGINT) AS volume FROM (SELECT keyword, substr(keyword, 1, CAST(plen AS INT)) AS prefix,
    pow(10.0, least(8.0, greatest(1.0, {VOLUME_FORMULA}))) AS v FROM (SELECT DISTINCT p_name AS keyword, ceil(length(p_name) / 2) AS plen FROM part) p) q"""


@query("volume_estimates", ESTIMATES)
def volume_estimates(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("keyword")).distinct()
    best = keywords.shortest_prefixes(names, prefix_lists(spark, d))
    volume = ph.estimate_volume(F.length("prefix"), F.col("position"), ph.competitors(F.col("keyword"), F.col("suggestions")))
    return best.select("keyword", "prefix", volume.alias("volume"))


@query("keywords_from_estimates", f"""WITH est AS ({ESTIMATES}) SELECT 'p' || p_partkey || '.com' AS domain, keyword, volume, prefix AS typed_prefix,
    CASE WHEN volume >= 10000 THEN 'High' WHEN volume >= 1000 THEN 'Medium' ELSE 'Low' END AS level, 1 AS rank FROM part JOIN est ON keyword = p_name""")
def keywords_from_estimates(spark, d):
    named = derive(spark, d, "SELECT 'p' || CAST(p_partkey AS STRING) || '.com' AS domain, p_name AS keyword FROM part").withColumns(
        {"found_in": F.array(F.lit("title")), "origin_order": F.lit(2), "position": F.lit(1)})
    return keywords.keywords_from_estimates(named, prefix_lists(spark, d)).select("domain", "keyword", "volume", "typed_prefix", "level", "rank")


@query("merged_volumes", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS volume FROM part""")
def merged_volumes(spark, d):
    part = table(spark, d, "part")
    requested = part.select("p_partkey", F.concat(F.lit("Part  "), "p_partkey").alias("keyword"))
    result = F.struct(F.concat(F.lit("part "), "p_partkey").alias("text"), F.array(F.concat(F.lit("parts "), "p_partkey")).alias("closeVariants"),
                      F.struct(F.floor("p_retailprice").cast("string").alias("avgMonthlySearches")).alias("keywordMetrics"))
    raw = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ord"), F.to_json(F.struct(F.array(result).alias("results"))).alias("body"))
    return keywords.merge_volumes(requested, js.parse_volumes(raw)).select("p_partkey", "volume")


def rank_bodies(spark, d):
    """One rank answer per domain and year, as the service would have sent it."""
    rows = landed(spark, d, "rank_history").withColumns({"date": F.col("date").cast("string"), "year": F.year("date")})
    body = F.to_json(F.struct(F.collect_list(F.struct("date", F.col("rank").cast("string").alias("rank"))).alias("ranks")))
    return rows.groupBy(F.col("domain").alias("key"), "year").agg(body.alias("body"))


@query("json_rank", "SELECT domain, CAST(date AS VARCHAR) AS date, rank FROM rank_history")
def json_rank(spark, d):
    return js.parse_ranks(rank_bodies(spark, d))


SUMMARY = """summary AS (SELECT domain, max(date) AS latest_date, arg_max(rank, {'d': date, 'r': rank}) AS latest, min(rank) AS best, max(rank) AS worst,
    CASE WHEN count(*) > 1 THEN arg_min(rank, {'d': date, 'r': rank}) - arg_max(rank, {'d': date, 'r': rank}) END AS change FROM rank_history GROUP BY domain)"""


@query("rank_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def rank_summary(spark, d):
    return traffic.rank_summary(landed(spark, d, "rank_history"))


def visits_sql(rank: str) -> str:
    case = f"CASE WHEN {rank} <= 1 THEN 80e9::DOUBLE"
    for i, ((r1, v1), (r2, v2)) in enumerate(zip(traffic.ANCHORS, traffic.ANCHORS[1:])):
        line = f"pow(10, log10({v1}::DOUBLE) + (log10({rank}::DOUBLE) - log10({r1}::DOUBLE)) * (log10({v2}::DOUBLE) - log10({v1}::DOUBLE)))"
        case += f" ELSE {line}" if i == len(traffic.ANCHORS) - 2 else f" WHEN {rank} <= {r2} THEN {line}"
    return case + " END"


FACTOR = "floor((2 + 0.25::DOUBLE * log10({0}::DOUBLE)) * 10 + 0.5) / 10"


@query("visit_estimates", f"SELECT domain, date, rank, floor({visits_sql('rank')} + 0.5) AS mid, {FACTOR.format('rank')} AS factor FROM rank_history")
def visit_estimates(spark, d):
    e = traffic.visit_estimate(F.col("rank"))
    return landed(spark, d, "rank_history").select("domain", "date", "rank", e.alias("e")).select(
        "domain", "date", "rank", tx.js_round(F.col("e.mid")).cast("double").alias("mid"), F.col("e.factor").alias("factor"))


@query("daily_visits", f"SELECT domain, date, rank, CAST(floor({visits_sql('rank')} + 0.5) AS BIGINT) AS visits FROM rank_history")
def daily_visits(spark, d):
    return traffic.daily_visits(landed(spark, d, "rank_history"))


TIER = "CASE WHEN coalesce(latest, 0) = 0 THEN 'Unranked' WHEN latest <= 100 THEN 'Top 100' WHEN latest <= 1000 THEN 'Top 1K' WHEN latest <= 10000 THEN 'Top 10K' WHEN latest <= 100000 THEN 'Top 100K' ELSE 'Top 1M' END"


@query("traffic_compare", f"""WITH {SUMMARY} SELECT x.domain, latest AS rank, change AS rank_change, CAST(floor({visits_sql('latest')} + 0.5) AS BIGINT) AS est_monthly_visits, {TIER} AS tier FROM
    (SELECT DISTINCT ranked AS domain FROM domains) x LEFT JOIN summary s ON s.domain = x.domain""")
def traffic_compare(spark, d):
    wanted = landed(spark, d, "domains").select(F.col("ranked").alias("domain")).distinct()
    sections = traffic.traffic_section(wanted, landed(spark, d, "rank_history"))
    return traffic.comparison(sections).select("domain", "rank", "rank_change", "est_monthly_visits", "tier")


@query("compare_pivot", """SELECT date, max(rank) FILTER (WHERE domain = 'c1.example.com') AS c1, max(rank) FILTER (WHERE domain = 'c2.example.com') AS c2 FROM
    (SELECT domain, date, max(rank) AS rank FROM rank_history GROUP BY ALL) r WHERE domain IN ('c1.example.com', 'c2.example.com') GROUP BY date""")
def compare_pivot(spark, d):
    daily = landed(spark, d, "rank_history").groupBy("domain", "date").agg(F.max("rank").alias("rank"))
    wide = traffic.aligned_series(daily, ["c1.example.com", "c2.example.com"])
    return wide.select("date", F.col("`c1.example.com`").alias("c1"), F.col("`c2.example.com`").alias("c2"))


@query("requested_domains", """SELECT request_id, domain, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos, domain) AS INT) AS position FROM (SELECT user_id AS request_id,
    'd' || (event_id % 12) AS domain, min(event_id) AS pos FROM events GROUP BY ALL) e QUALIFY position <= 8""")
def requested_domains(spark, d):
    requests = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.concat(F.lit("d"), F.col("event_id") % 12).alias("domain"), F.col("event_id").alias("pos"))
    return traffic.requested_domains(requests).select("request_id", "domain", "position")


@query("duplicate_inputs", """SELECT event_id, event_id > min(event_id) OVER (PARTITION BY user_id, event_type) AS is_duplicate FROM events""")
def duplicate_inputs(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("domain"))
    return keywords.duplicates_flagged(rows, "domain", "event_id").select("event_id", "is_duplicate")


@query("share_of_total", """SELECT event_type, n, floor(n / sum(n) OVER () * 1000 + 0.5) / 10 AS pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) e""")
def share_of_total(spark, d):
    return keywords.share_of_total(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n")


@query("json_suggestions_whole")
def json_suggestions_whole(spark, d):
    """All words of every text as an engine's answer in its own format; no SQL, as tags and entities are taken out of answers."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    source = F.element_at(F.array(F.lit("google"), F.lit("duckduckgo"), F.lit("amazon")), (F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) + 1).cast("int"))
    each = lambda name: F.transform(words, lambda w: F.struct(w.alias(name)))
    body = (
        F.when(source == "google", F.concat(F.lit('["q",'), F.to_json(words), F.lit("]")))
        .when(source == "duckduckgo", F.to_json(each("phrase")))
        .otherwise(F.to_json(F.struct(each("value").alias("suggestions"))))
    )
    return js.parse_suggestions(table(spark, d, "documents").select("doc_id", source.alias("source"), body.alias("body"))).select("doc_id", "suggestions")


@query("json_authority", """SELECT c_name AS domain, floor(c_acctbal * 100 + 0.5) / 100 AS score, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS rank FROM customer WHERE c_custkey % 4 <> 1""")
def json_authority(spark, d):
    row = F.struct(F.when(F.col("c_custkey") % 4 == 1, 404).otherwise(200).alias("status_code"), F.col("c_acctbal").cast("string").alias("page_rank_decimal"),
                   F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).alias("rank"))
    raw = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.to_json(F.struct(F.array(row).alias("response"))).alias("body"))
    return js.parse_authority(raw)


@query("json_registration", f"""SELECT o_orderkey AS domain, 'Registrar ' || (o_orderkey % 7) AS registrar, floor(epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / (365.25 * 86400) * 10 + 0.5) / 10 AS age_years,
    'ns1.' || (o_orderkey % 50) || '.net' AS nameservers, o_orderkey % 2 = 0 AS dnssec FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 4) o
    UNION ALL SELECT o_orderkey, NULL, NULL, '', NULL FROM orders WHERE o_orderkey % 5 = 4""")
def json_registration(spark, d):
    k = F.col("o_orderkey")
    good = F.concat(
        F.lit('{"events":[{"eventAction":"Registration","eventDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}],"entities":[{"roles":["abuse"]},{"roles":["registrar"],'
        '"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text",'), F.when(k % 2 == 0, '""').otherwise(F.concat(F.lit('"Registrar '), k % 7, F.lit('"'))),
        F.lit('],["org",{},"text","Registrar '), k % 7, F.lit('"]]]}],"nameservers":[{"ldhName":"NS1.'), k % 50, F.lit('.NET"},{}],"secureDNS":{"delegationSigned":'),
        F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}}"))
    raw = table(spark, d, "orders").select(k.alias("key"), F.when(k % 5 == 4, '{"status":null}').otherwise(good).alias("body"))
    found = js.parse_registrations(raw, F.lit(AS_OF).cast("timestamp"))
    return found.select("domain", "registrar", "age_years", F.array_join("nameservers", " ").alias("nameservers"), "dnssec")


CAPTURES = "SELECT o_custkey, strftime(o_orderdate, '%Y%m%d') || '120000' AS stamp FROM orders"


@query("json_captures", f"""SELECT o_custkey AS domain, min(y) AS first_year, max(y) AS last_year, count(DISTINCT y) AS n_years,
    floor(epoch(TIMESTAMP '{AS_OF}' - min(o_orderdate) - INTERVAL 12 HOUR) / (365.25 * 86400) * 10 + 0.5) / 10 AS age_years FROM (SELECT *, year(o_orderdate) AS y FROM orders) o GROUP BY o_custkey""")
def json_captures(spark, d):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000"))
    per_year = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("y")).agg(F.min(stamp).alias("stamp"))
    rows = F.concat(F.array(F.array(F.lit("timestamp")), F.array(F.lit("bad"))), F.collect_list(F.array("stamp")))
    raw = per_year.groupBy("key").agg(F.to_json(rows).alias("body"))
    stamps = js.parse_captures(raw).select("domain", "stamps", F.get("stamps", F.lit(0)).alias("first"), F.element_at("stamps", -1).alias("latest"))
    out = js.archive_summary(stamps, F.lit(AS_OF).cast("timestamp"))
    return out.select("domain", F.get("years", F.lit(0)).alias("first_year"), "last_year", F.size("years").alias("n_years"), "age_years")


@query("json_page_speed", """SELECT s_suppkey AS url, CAST(s_suppkey % 101 AS INT) AS performance, CAST(NULL AS INT) AS seo, CASE WHEN s_suppkey % 3 = 0 THEN 'origin' ELSE 'url' END AS field_scope,
    (s_suppkey % 40) / 100 AS cls, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'unused-css:' || (s_suppkey % 5 * 100) END AS opportunities, 'speed-index' AS lab FROM supplier""")
def json_page_speed(spark, d):
    k = F.col("s_suppkey")
    metrics = F.concat(F.lit('{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":'), k % 40, F.lit(',"category":"FAST"}},"overall_category":"FAST"'))
    body = F.concat(
        F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), (k % 101) / 100, F.lit('},"seo":{"score":null}},"audits":{"speed-index":{"id":"speed-index","title":"Speed","score":0.5},'
        '"unused-css":{"id":"unused-css","title":"CSS","score":0.3,"details":{"type":"opportunity","overallSavingsMs":'), k % 5 * 100, F.lit('}},"good":{"id":"good","title":"G","score":0.95,'
        '"details":{"type":"opportunity","overallSavingsMs":900}}}},"loadingExperience":'), metrics, F.when(k % 3 == 0, ',"origin_fallback":true}').otherwise("}"),
        F.lit(',"originLoadingExperience":'), metrics, F.lit("}}"))
    out = js.parse_page_speed(table(spark, d, "supplier").select(k.alias("key"), body.alias("body")))
    gains = F.array_join(F.transform("opportunities", lambda o: F.concat(o["id"], F.lit(":"), o["savings_ms"].cast("string"))), " ")
    return out.select("url", "performance", "seo", "field_scope", F.col("cls.percentile").alias("cls"), gains.alias("opportunities"), F.array_join(F.transform("lab", lambda a: a["id"]), " ").alias("lab"))


@query("json_ranked", """SELECT o_custkey AS domain, keyword, position, traffic FROM (SELECT o_custkey, 'order ' || o_orderkey AS keyword, CAST(o_orderkey % 100 + 1 AS INT) AS position,
    CAST(floor(o_totalprice + 0.5) AS BIGINT) AS traffic, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice + 0.5) DESC, o_orderkey) AS rn FROM orders WHERE o_orderkey % 10 <> 3) q WHERE rn <= 10""")
def json_ranked(spark, d):
    item = F.struct(
        F.struct(F.concat(F.lit("order "), "o_orderkey").alias("keyword")).alias("keyword_data"),
        F.struct(F.struct(F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderkey") % 100 + 1).alias("rank_group"), F.col("o_totalprice").alias("etv")).alias("serp_item")).alias("ranked_serp_element"))
    # Answers come in pages of one year each, so no answer grows with the whole history of a domain.
    pages = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate")).agg(F.collect_list(item).alias("items"))
    task = F.struct(F.lit(20000).alias("status_code"), F.array(F.struct(F.col("items"))).alias("result"))
    raw = pages.select("key", F.to_json(F.struct(F.lit(20000).alias("status_code"), F.array(task).alias("tasks"))).alias("body"))
    rows = js.parse_ranked_keywords(raw).select("domain", F.explode("keywords").alias("k")).select("domain", "k.*")
    number = F.substring_index("keyword", " ", -1).cast("bigint")
    return top_n(rows, ["domain"], [F.col("traffic").desc(), number], 10).select("domain", "keyword", "position", "traffic")


@query("bootstrap_servers", """SELECT lower(n_name) AS tld, 'https://rdap' || n_nationkey || '.net/' AS server FROM nation""")
def bootstrap_servers(spark, d):
    service = F.array(F.array("n_name"), F.array(F.concat(F.lit("http://old"), "n_nationkey"), F.concat(F.lit("https://rdap"), "n_nationkey", F.lit(".net"))))
    raw = table(spark, d, "nation").select(F.to_json(F.struct(F.array(service).alias("services"))).alias("body"))
    return js.registration_servers(raw)


@query("closest_captures", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS stamp FROM orders""")
def closest_captures(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"archived_snapshots":{"closest":{"available":'), F.when(k % 3 == 0, "false").otherwise("true"), F.lit(',"timestamp":"'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('"}}}'))
    return table(spark, d, "orders").select("o_orderkey", js.closest_capture(body).alias("stamp"))


@query("stamp_times", """SELECT o_orderkey, o_orderdate AS at, floor(epoch(TIMESTAMP '2024-06-01 00:00:00' - o_orderdate) / 86400) AS days FROM orders""")
def stamp_times(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", dates.stamp_to_timestamp(F.date_format("o_orderdate", "yyyyMMdd")).alias("at"))
    tls = F.struct(F.lit(AS_OF).cast("timestamp").alias("valid_to"))
    left = responses.certificate(tls, F.col("at"))["days_remaining"]
    return rows.select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("at"), left.cast("double").alias("days"))


DNS = """SELECT c_name AS domain, 'MX' AS type, CASE c_custkey % 4 WHEN 0 THEN 'aspmx.l.google.com.' WHEN 1 THEN 'mx.zoho.eu' WHEN 2 THEN 'mail.example.net' ELSE 'x.protection.outlook.com' END AS value, 10 AS priority, 1 AS ord,
    c_custkey % 11 = 0 AS failed FROM customer UNION ALL SELECT c_name, 'MX', 'backup.mimecast.com', 20, 0, false FROM customer UNION ALL SELECT c_name, 'NS', 'NS2.Cloudflare.com', NULL, 1, false FROM customer
    UNION ALL SELECT c_name, 'NS', 'ns1.awsdns-' || CAST(c_custkey % 9 AS STRING) || '.org', NULL, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END, false FROM customer
    UNION ALL SELECT c_name, 'TXT', 'v=spf1 include:' || c_mktsegment, NULL, 0, false FROM customer UNION ALL SELECT c_name, 'DMARC', 'v=DMARC1; p=Reject', NULL, 0, false FROM customer WHERE c_custkey % 3 = 0"""


@query("dns_summary", """SELECT c_name AS domain, CASE WHEN c_custkey % 11 = 0 THEN 'Mimecast' ELSE CASE c_custkey % 4 WHEN 0 THEN 'Google Workspace' WHEN 1 THEN 'Zoho Mail' WHEN 2 THEN 'Mimecast' ELSE 'Microsoft 365' END END AS mail_provider,
    CASE WHEN c_custkey % 2 = 0 THEN 'Amazon Route 53' ELSE 'Cloudflare' END AS dns_provider, 'ns1.awsdns-' || (c_custkey % 9) || '.org ns2.cloudflare.com' AS ns, 'v=spf1 include:' || c_mktsegment AS spf,
    CASE WHEN c_custkey % 3 = 0 THEN 'reject' END AS dmarc_policy, CASE WHEN c_custkey % 11 = 0 THEN 'MX' ELSE '' END AS failed FROM customer""")
def dns_summary(spark, d):
    out = domains.dns_summary(derive(spark, d, DNS))
    return out.select("domain", "mail_provider", "dns_provider", F.array_join("ns", " ").alias("ns"), "spf", "dmarc_policy", F.array_join("failed", " ").alias("failed"))


@query("domain_markets", """SELECT domain, gl, hl FROM (SELECT domain, CASE c_custkey % 6 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'br' ELSE CASE c_custkey % 5 WHEN 0 THEN 'gb' WHEN 1 THEN 'fr' WHEN 2 THEN 'br' ELSE 'us' END END AS gl,
    CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'pt' END ELSE CASE c_custkey % 6 WHEN 1 THEN 'de' WHEN 2 THEN 'pt' ELSE 'en' END END AS hl FROM domains) m""")
def domain_markets(spark, d):
    return domains.markets(landed(spark, d, "domains")).select("domain", "gl", "hl")


LOOKUPS = """SELECT user_id AS key, ts AS fetched_at, event_id AS value, CASE WHEN event_id % 2 = 0 THEN 864000 ELSE 86400 END AS ttl, event_type = 'error' AS failed FROM events"""


@query("latest_lookups", f"""SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, value DESC) AS rn FROM ({LOOKUPS}) l
    WHERE NOT failed AND epoch(date_trunc('second', fetched_at)) + ttl >= epoch(TIMESTAMP '2024-01-20 00:00:00')) q WHERE rn = 1""")
def latest_lookups(spark, d):
    return domains.latest_lookups(derive(spark, d, LOOKUPS), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("key", "value")


@query("homepages", """SELECT host, url FROM (SELECT 'h' || s_suppkey AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'http' WHEN s_suppkey % 4 IN (1, 2) THEN 'https' ELSE 'https' END || '://h' || s_suppkey || '/' AS url FROM supplier) h""")
def homepages(spark, d):
    code = "CASE WHEN s_suppkey % 4 = 0 THEN 'TIMEOUT' WHEN s_suppkey % 4 = 2 THEN 'NOT_HTML' WHEN s_suppkey % 4 = 3 THEN 'ECONNRESET' END"
    rows = derive(spark, d, f"""SELECT 'h' || CAST(s_suppkey AS STRING) AS host, 'https://h' || CAST(s_suppkey AS STRING) || '/' AS url, {code} AS error_code FROM supplier
        UNION ALL SELECT 'h' || CAST(s_suppkey AS STRING), 'http://h' || CAST(s_suppkey AS STRING) || '/', CASE WHEN s_suppkey % 4 = 3 THEN 'ECONNRESET' END FROM supplier""")
    return domains.pick_homepage(rows).select("host", "url")


@query("overview", f"""WITH {SUMMARY} SELECT x.domain, s.latest AS rank, CASE WHEN s.domain IS NULL THEN 'error' ELSE 'ok' END AS traffic_status, 'ok' AS dns_status, 'error' AS history_status, 'error' AS homepage_status,
    CASE WHEN c_custkey % 2 = 0 THEN 'Amazon Route 53' ELSE 'Cloudflare' END AS dns_provider FROM (SELECT ranked AS domain, c_custkey FROM domains) x LEFT JOIN summary s ON s.domain = x.domain""")
def overview(spark, d):
    dns = domains.dns_summary(derive(spark, d, DNS.replace("c_name", "'c' || CAST(c_custkey AS STRING) || '.example.com'")))
    wanted = landed(spark, d, "domains").select(F.col("ranked").alias("domain"))
    out = domains.overview(wanted, {"traffic": traffic.rank_summary(landed(spark, d, "rank_history")), "dns": dns})
    return out.select("domain", F.col("traffic.latest").alias("rank"), "traffic_status", "dns_status", "history_status", "homepage_status", F.col("dns.dns_provider").alias("dns_provider"))


@query("section_status", f"""WITH {SUMMARY} SELECT section, status, count(*) AS domains FROM (SELECT unnest(['traffic', 'registration', 'dns']) AS section,
    unnest([CASE WHEN s.domain IS NULL THEN 'error' ELSE 'ok' END, 'error', 'error']) AS status FROM (SELECT DISTINCT ranked AS domain FROM domains) x LEFT JOIN summary s ON s.domain = x.domain) q GROUP BY ALL""")
def section_status(spark, d):
    wanted = landed(spark, d, "domains").select(F.col("ranked").alias("domain"))
    out = domains.overview(wanted, {"traffic": traffic.rank_summary(landed(spark, d, "rank_history"))}, "traffic,registration,dns,unknown")
    return domains.section_rows(out).groupBy("section", "status").agg(F.count("*").alias("domains"))


@query("recent_searches", """SELECT user_id, tool, query, CAST(rn AS INT) AS position FROM (SELECT user_id, tool, query, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, tool, lower(query)) AS rn FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, tool, lower(query) ORDER BY "at" DESC) AS k FROM search_log) l WHERE k = 1) q WHERE rn <= 30""")
def recent_searches(spark, d):
    return keywords.recent_searches(landed(spark, d, "search_log")).select("user_id", "tool", "query", "position")


EVENTS = """SELECT 'a' || CAST(user_id AS STRING) AS audit_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'phase' WHEN 'purchase' THEN 'done' ELSE 'info' END AS type,
    CASE WHEN event_type = 'click' THEN 'phase ' || CAST(event_id AS STRING) END AS phase, CASE WHEN event_type = 'view' THEN CAST(event_id % 500 AS INT) END AS crawled,
    CASE WHEN event_type = 'view' THEN CAST(event_id % 70 AS INT) END AS queued, 'https://e/' || CAST(event_id AS STRING) AS page_url FROM events"""


@query("audit_progress", f"""SELECT audit_id, arg_max(phase, seq) FILTER (WHERE phase IS NOT NULL) AS phase, arg_max(crawled, seq) FILTER (WHERE crawled IS NOT NULL) AS crawled,
    count(*) FILTER (WHERE type = 'page') AS pages, arg_max(page_url, seq) FILTER (WHERE type = 'page') AS last_page, bool_or(type = 'done') AS finished FROM ({EVENTS}) e GROUP BY audit_id""")
def audit_progress(spark, d):
    events = derive(spark, d, EVENTS).withColumn("page", F.struct(F.col("page_url").alias("url")))
    return streaming.audit_progress(events).drop("queued")


@query("last_pages", f"""SELECT audit_id, seq, CAST(rn AS INT) AS newest FROM (SELECT audit_id, seq, row_number() OVER (PARTITION BY audit_id ORDER BY seq DESC) AS rn FROM ({EVENTS}) e WHERE type = 'page') q WHERE rn <= 8""")
def last_pages(spark, d):
    return streaming.last_pages(derive(spark, d, EVENTS)).select("audit_id", "seq", "newest")
