"""Landed third-party JSON to typed columns. Schemas are explicit; a missing or odd field becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.dates import age_years, stamp_to_timestamp
from sitegrain.functions.text import js_round, squeeze

RANKS = "struct<ranks:array<struct<date:string,rank:string>>>"
AUTHORITY = "struct<response:array<struct<status_code:int,page_rank_decimal:string,rank:string>>>"
REGISTRATION = (
    "struct<events:array<struct<eventAction:string,eventDate:string>>,entities:array<struct<roles:array<string>,vcardArray:string>>,"
    "nameservers:array<struct<ldhName:string>>,status:array<string>,secureDNS:struct<delegationSigned:boolean>>"
)
BOOTSTRAP = "struct<services:array<array<array<string>>>>"
AVAILABILITY = "struct<archived_snapshots:struct<closest:struct<available:boolean,timestamp:string>>>"
_METRICS = "struct<metrics:map<string,struct<percentile:double,category:string>>,overall_category:string,origin_fallback:boolean>"
PAGE_SPEED = (
    "struct<lighthouseResult:struct<categories:map<string,struct<score:double>>,audits:map<string,struct<id:string,title:string,score:double,"
    f"displayValue:string,details:struct<type:string,overallSavingsMs:double>>>>,loadingExperience:{_METRICS},originLoadingExperience:{_METRICS}>"
)
VOLUMES = "struct<results:array<struct<text:string,closeVariants:array<string>,keywordMetrics:struct<avgMonthlySearches:string>>>>"
RANKED = (
    "struct<status_code:int,status_message:string,tasks:array<struct<status_code:int,status_message:string,result:array<struct<total_count:bigint,"
    "metrics:struct<organic:struct<etv:double,count:bigint>>,items:array<struct<keyword_data:struct<keyword:string,keyword_info:struct<search_volume:bigint>>,"
    "ranked_serp_element:struct<serp_item:struct<type:string,rank_group:int,etv:double,url:string>>>>>>>>>"
)
# Lab audits in report order and field metric names.
LAB_AUDITS = ["first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index", "server-response-time"]
FIELD_METRICS = {"lcp": "LARGEST_CONTENTFUL_PAINT_MS", "inp": "INTERACTION_TO_NEXT_PAINT", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE",
                 "fcp": "FIRST_CONTENTFUL_PAINT_MS", "ttfb": "EXPERIMENTAL_TIME_TO_FIRST_BYTE"}
STAMP = r"^\d{8,14}$"


def _json(body: str, schema: str) -> Column:
    return F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"})


def _words(items: Column) -> Column:
    return F.filter(items, lambda s: F.coalesce(s, F.lit("")) != "")


def open_search(body: Column) -> Column:
    """Suggestions of ``[query, [..]]``; an entry may itself be a list whose first item is the text."""
    doc = F.try_parse_json(body)

    def text(item: Column) -> Column:
        inner = F.try_variant_get(item, "$[0]", "variant")
        whole = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        first = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(inner, "$", "string"))
        return F.trim(F.regexp_replace(F.coalesce(whole, first, F.lit("")), "</?b>", ""))

    items = F.coalesce(F.try_variant_get(doc, "$[1]", "array<variant>"), F.array().cast("array<variant>"))
    return _words(F.transform(items, text))


def phrase_list(body: Column) -> Column:
    """Suggestions of ``[{phrase}]``, else of the OpenSearch form."""
    rows = F.from_json(body, "array<struct<phrase:string>>")
    return F.when(body.rlike(r"^\s*\[\s*\{"), _words(F.transform(rows, lambda r: r["phrase"]))).otherwise(open_search(body))


def value_list(body: Column) -> Column:
    """Suggestions of ``{suggestions:[{value}]}``."""
    rows = F.from_json(body, "struct<suggestions:array<struct<value:string>>>")["suggestions"]
    return F.coalesce(_words(F.transform(rows, lambda r: r["value"])), F.array().cast("array<string>"))


def parse_suggestions(raw: DataFrame) -> DataFrame:
    """Adds ``suggestions`` to raw autocomplete answers by the format their engine uses."""
    by_source = F.when(F.col("source") == "duckduckgo", phrase_list(F.col("body"))).when(F.col("source") == "amazon", value_list(F.col("body"))).otherwise(open_search(F.col("body")))
    return raw.withColumn("suggestions", by_source).drop("body")


def parse_ranks(raw: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """``(domain, date, rank)``; blank dates and ranks that are not positive numbers are dropped."""
    rows = raw.select(F.col(key).alias("domain"), F.explode(_json(body, RANKS)["ranks"]).alias("r"))
    typed = rows.select("domain", F.col("r.date").alias("date"), F.try_to_number("r.rank", F.lit("999999999999")).cast("bigint").alias("rank"))
    return typed.where((F.coalesce("date", F.lit("")) != "") & (F.col("rank") > 0))


def parse_authority(raw: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    row = F.get(_json(body, AUTHORITY)["response"], F.lit(0))
    score = row["page_rank_decimal"].try_cast("double")
    rows = raw.select(F.col(key).alias("domain"), row["status_code"].alias("s"), score.alias("raw"), row["rank"].try_cast("bigint").alias("rank"))
    return rows.where("s = 200 and raw is not null").select("domain", (js_round(F.col("raw") * 100) / 100).alias("score"), "rank")


def parse_registrations(raw: DataFrame, as_of: Column, key: str = "key", body: str = "body") -> DataFrame:
    doc = raw.select(F.col(key).alias("domain"), _json(body, REGISTRATION).alias("d"))

    def event(*names: str) -> Column:
        pick = [F.get(F.filter("d.events", lambda e: F.lower(e["eventAction"]) == n), F.lit(0))["eventDate"] for n in names]
        return F.coalesce(*pick)

    registrar = F.get(F.filter("d.entities", lambda e: F.coalesce(F.array_contains(e["roles"], "registrar"), F.lit(False))), F.lit(0))
    card = F.from_json(F.get_json_object(registrar["vcardArray"], "$[1]"), "array<array<string>>")

    def card_name(prop: str) -> Column:
        hits = F.filter(card, lambda p: (F.get(p, F.lit(0)) == prop) & (F.trim(F.coalesce(F.get(p, F.lit(3)), F.lit(""))) != ""))
        return F.trim(F.get(F.get(hits, F.lit(0)), F.lit(3)))

    registered = F.try_to_timestamp(event("registration"))
    servers = _words(F.transform("d.nameservers", lambda n: F.lower(n["ldhName"])))
    nothing = F.array().cast("array<string>")
    return doc.select(
        "domain", F.coalesce(card_name("fn"), card_name("org")).alias("registrar"), registered.alias("registered_at"),
        event("expiration").alias("expires_at"), event("last changed", "last update of rdap database").alias("updated_at"),
        age_years(registered, as_of).alias("age_years"), F.coalesce("d.status", nothing).alias("status"),
        F.coalesce(servers, nothing).alias("nameservers"), F.col("d.secureDNS.delegationSigned").alias("dnssec"))


def registration_servers(raw: DataFrame, body: str = "body") -> DataFrame:
    """``(tld, server)`` of a bootstrap list: https preferred, always with a final slash."""
    services = raw.select(F.explode(_json(body, BOOTSTRAP)["services"]).alias("s"))
    urls = F.col("s")[1]
    base = F.coalesce(F.get(F.filter(urls, lambda u: u.startswith("https://")), F.lit(0)), F.get(urls, F.lit(0)))
    rows = services.select(F.explode(F.col("s")[0]).alias("tld"), base.alias("base")).where("base is not null")
    return rows.select(F.lower("tld").alias("tld"), F.when(F.col("base").endswith("/"), F.col("base")).otherwise(F.concat("base", F.lit("/"))).alias("server"))


def parse_captures(raw: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """Sorted capture stamps per domain; the header row and malformed stamps are skipped."""
    rows = F.from_json(F.col(body), "array<array<string>>")
    stamps = F.filter(F.transform(rows, lambda r: F.get(r, F.lit(0))), lambda t: F.coalesce(t.rlike(STAMP), F.lit(False)))
    return raw.select(F.col(key).alias("domain"), F.sort_array(F.coalesce(stamps, F.array().cast("array<string>"))).alias("stamps"))


def closest_capture(body: Column) -> Column:
    closest = F.from_json(body, AVAILABILITY)["archived_snapshots"]["closest"]
    good = F.coalesce(closest["available"], F.lit(True)) & closest["timestamp"].rlike(STAMP)
    return F.when(good, closest["timestamp"])


def archive_summary(captures: DataFrame, as_of: Column) -> DataFrame:
    """``(domain, first, latest, stamps)`` to first and last capture, years with captures and age."""
    years = F.sort_array(F.array_distinct(F.transform("stamps", lambda t: F.substring(t, 1, 4).cast("int"))))
    first = F.array_min(F.filter(F.array("first", F.get("stamps", F.lit(0))), lambda t: t.isNotNull()))
    opened = stamp_to_timestamp(first)
    last_year = F.greatest(F.try_element_at(years, F.lit(-1)), F.substring("latest", 1, 4).try_cast("int"))
    return captures.select(
        "domain", opened.alias("first_capture"), stamp_to_timestamp(F.col("latest")).alias("last_capture"),
        age_years(opened, as_of).alias("age_years"), last_year.alias("last_year"),
        F.when(opened.isNotNull(), years).otherwise(F.array().cast("array<int>")).alias("years"))


def parse_page_speed(raw: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    doc = raw.select(F.col(key).alias("url"), _json(body, PAGE_SPEED).alias("d"))
    category = lambda n: F.element_at("d.lighthouseResult.categories", F.lit(n))["score"]
    audit = lambda n: F.element_at(F.col("d.lighthouseResult.audits"), n)
    lab = F.filter(F.transform(F.array(*[F.lit(a) for a in LAB_AUDITS]), audit), lambda a: a.isNotNull())
    savings = lambda a: F.coalesce(a["details"]["overallSavingsMs"], F.lit(0.0))
    gains = F.filter(F.map_values("d.lighthouseResult.audits"), lambda a: (a["details"]["type"] == "opportunity") & (savings(a) > 0) & (F.coalesce(a["score"], F.lit(1.0)) < 0.9))
    keyed = F.transform(gains, lambda a, i: F.struct((-savings(a)).alias("k"), i.alias("i"), a["id"].alias("id"), a["title"].alias("title"), js_round(savings(a)).alias("savings_ms")))
    best = F.transform(F.slice(F.array_sort(keyed), 1, 8), lambda k: F.struct(k["id"].alias("id"), k["title"].alias("title"), k["savings_ms"].alias("savings_ms")))
    own = F.col("d.loadingExperience.metrics").isNotNull() & ~F.coalesce("d.loadingExperience.origin_fallback", F.lit(False))
    origin = F.col("d.originLoadingExperience.metrics").isNotNull()
    metrics = F.when(own, F.col("d.loadingExperience.metrics")).when(origin, F.col("d.originLoadingExperience.metrics"))

    def metric(name: str) -> Column:
        value = F.element_at(metrics, F.lit(FIELD_METRICS[name]))
        scale = F.lit(100.0 if name == "cls" else 1.0)
        return F.when(value["percentile"].isNotNull(), F.struct((value["percentile"] / scale).alias("percentile"), value["category"].alias("category"))).alias(name)

    scores = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo"}
    return doc.select(
        "url", *[js_round(category(v) * 100).cast("int").alias(k) for k, v in scores.items()],
        F.transform(lab, lambda a: F.struct(a["id"].alias("id"), a["title"].alias("title"), F.coalesce(a["displayValue"], F.lit("")).alias("display_value"), a["score"].alias("score"))).alias("lab"),
        F.when(own, "url").when(origin, "origin").alias("field_scope"),
        F.when(own, F.col("d.loadingExperience.overall_category")).when(origin, F.col("d.originLoadingExperience.overall_category")).alias("field_overall"),
        *[metric(n) for n in FIELD_METRICS], best.alias("opportunities"))


def parse_volumes(raw: DataFrame, body: str = "body") -> DataFrame:
    """``(keyword, volume, ord)`` of search-volume answers, close variants included; on repeats the last one counts."""
    rows = raw.select("ord", F.posexplode(_json(body, VOLUMES)["results"]).alias("i", "r"))
    volume = F.coalesce(F.coalesce("r.keywordMetrics.avgMonthlySearches", F.lit("0")).try_cast("double"), F.lit(0.0)).cast("bigint")
    texts = F.concat(F.array("r.text"), F.coalesce("r.closeVariants", F.array().cast("array<string>")))
    names = rows.select(F.struct("ord", "i").alias("at"), volume.alias("volume"), F.posexplode(texts).alias("j", "text")).where("coalesce(text, '') <> ''")
    order = F.struct("at", "j")
    return names.groupBy(squeeze(F.lower("text")).alias("keyword")).agg(F.max_by("volume", order).alias("volume"), F.max(order).alias("ord"))


def parse_ranked_keywords(raw: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """One row per answer: ``error`` or totals and the list of ranked keywords."""
    doc = raw.select(F.col(key).alias("domain"), _json(body, RANKED).alias("d"))
    task = F.get("d.tasks", F.lit(0))
    result = F.get(task["result"], F.lit(0))
    error = F.when(F.coalesce(F.col("d.status_code"), F.lit(0)) != 20000, F.coalesce("d.status_message", F.lit("unexpected response"))).when(
        F.coalesce(task["status_code"], F.lit(0)) != 20000, F.coalesce(task["status_message"], F.lit("the task failed")))
    items = F.filter(result["items"], lambda i: (F.coalesce(i["keyword_data"]["keyword"], F.lit("")) != "") & i["ranked_serp_element"]["serp_item"]["rank_group"].isNotNull())
    keywords = F.transform(items, lambda i: F.struct(
        i["keyword_data"]["keyword"].alias("keyword"), i["ranked_serp_element"]["serp_item"]["rank_group"].alias("position"),
        i["keyword_data"]["keyword_info"]["search_volume"].alias("volume"), js_round(i["ranked_serp_element"]["serp_item"]["etv"]).alias("traffic"),
        i["ranked_serp_element"]["serp_item"]["url"].alias("url")))
    organic = result["metrics"]["organic"]
    ok = error.isNull()
    empty = result.isNull()
    return doc.select(
        "domain", error.alias("error"),
        F.when(ok, F.when(empty, F.lit(0).cast("bigint")).otherwise(F.coalesce(organic["count"], result["total_count"]))).alias("total_keywords"),
        F.when(ok, F.when(empty, F.lit(0).cast("bigint")).otherwise(js_round(organic["etv"]))).alias("organic_traffic"),
        F.when(ok, F.coalesce(keywords, F.array().cast("array<struct<keyword:string,position:int,volume:bigint,traffic:bigint,url:string>>"))).alias("keywords"))
