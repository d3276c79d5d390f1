"""Content files: front matter, publication filter, related posts and the document rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls as ur
from sitegrain.functions.text import js_round
from sitegrain.operators.ranking import page_of

# Names of post files, and times as posts write them.
FILE_NAME = r"^(\d{4}-\d{2}-\d{2})-([a-z0-9]+(?:-[a-z0-9]+)*)\.md$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
# Reserved addresses, house-style phrases and limits of the document rules.
RESERVED = ["page", "how-we-write", "rss", "rss-xml", "feed"]
BANNED_PHRASES = [
    "in today's fast-paced", "in today's digital", "in the ever-evolving", "ever-changing landscape", "rapidly evolving landscape",
    "the world of tech", "delve", "game-changer", "game changer", "revolutionize", "unlock the power", "harness the power", "a testament to",
    "it's worth noting that", "it is worth noting", "it's important to note", "in conclusion", "to sum up", "in summary", "buckle up",
    "navigating the", "seamless", "cutting-edge", "paradigm shift", "tapestry", "embark on", "only time will tell", "stay tuned", "as an ai",
    "as a language model",
]
MIN_WORDS, MAX_WORDS, MIN_SOURCES = 400, 1600, 2


def word_count(markdown: Column) -> Column:
    return F.regexp_count(F.regexp_replace(markdown, r"[#>*_`\[\]()\-]", " "), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), js_round(words / 230)).cast("int")


def parse_posts(files: DataFrame) -> DataFrame:
    """``(file, raw)`` to slug, front-matter fields and body measures. Files with another name pattern are left out."""
    front = F.regexp_extract("raw", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    body = F.regexp_replace("raw", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_front", rf"(?m)^{k}:[ \t]*(.*)$", 1), r"^[\"']|[\"']\s*$", "")), F.lit(""))
    listed = F.regexp_extract("_front", r"(?m)^tags:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract_all(F.regexp_extract("_front", r"(?m)^tags:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1))
    strip = lambda arr: F.filter(F.transform(arr, lambda t: F.regexp_replace(t, r"^[\s\"']+|[\s\"']+$", "")), lambda t: t != "")
    staged = files.where(F.col("file").rlike(FILE_NAME)).withColumn("_front", front).withColumn("markdown", body)
    words = word_count(F.col("markdown"))
    return staged.select(
        "file", F.regexp_extract("file", FILE_NAME, 2).alias("slug"), F.coalesce(field("title"), F.lit("")).alias("title"),
        F.coalesce(field("description"), F.lit("")).alias("description"), F.coalesce(field("date"), F.lit("")).alias("date"), field("updated").alias("updated"),
        F.when(listed != "", strip(F.split(listed, ","))).otherwise(strip(block)).alias("tags"), (F.coalesce(field("draft"), F.lit("")) == "true").alias("draft"),
        words.alias("words"), reading_minutes(words).alias("reading_minutes"), "markdown")


def published(posts: DataFrame, as_of: Column) -> DataFrame:
    return posts.where(~F.col("draft") & (F.try_to_timestamp("date") <= as_of))


def latest_posts(posts: DataFrame, n: int) -> DataFrame:
    return posts.orderBy(F.try_to_timestamp("date").desc(), F.col("slug")).limit(n)


def post_page(posts: DataFrame, page: int, size: int = 12) -> DataFrame:
    """One page (from 1) of the list of posts, newest first, with the zero-based ``position`` of each."""
    return page_of(posts, -F.unix_micros(F.try_to_timestamp("date")), "slug", page, size)


def _related(sent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slugs, lists = sent.value
        place_of = {slug: i for i, slug in enumerate(slugs)}
        inverted: dict[str, list[int]] = {}
        for i, tags in enumerate(lists):
            for tag in tags:
                inverted.setdefault(tag, []).append(i)
        places = {tag: np.asarray(at) for tag, at in inverted.items()}
        for batch in batches:
            rows: list[tuple] = []
            for slug, tags in zip(batch.column("slug").to_pylist(), batch.column("tags").to_pylist(), strict=True):
                reach = min(len(slugs), 100 * len(tags) + n + 1)  # beyond, no post can be among the best
                shared = np.zeros(reach, np.int64)
                for tag in tags:
                    at = places.get(tag, places_of_none)
                    shared[at[: np.searchsorted(at, reach)]] += 1
                own = place_of.get(slug, len(slugs))
                index = np.arange(reach)
                score = 100 * shared - (index - (index > own))
                others = index[index != own]
                least = np.partition(score[others], max(0, len(others) - n))[max(0, len(others) - n)] if len(others) else 0
                best = sorted((-int(score[i]), slugs[i], int(shared[i])) for i in others[score[others] >= least])[:n]
                rows += [(slug, related, s, -lost, rank) for rank, (lost, related, s) in enumerate(best, 1)]
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slug", "related", "shared", "score", "rank"])

    places_of_none = np.zeros(0, np.int64)
    return run


def related_posts(posts: DataFrame, n: int = 3) -> DataFrame:
    """For every post the n others with the best score, shared tags times 100 minus recency place (of equals the first slug): slug, related, shared, score, rank.

    A post with t tags scores at most 100 t less the other's place, and the newest n others score more than -n, so only the newest
    ``100 t + n + 1`` posts can be among its best. Of the posts as many as the longest list of tags asks for are sent to the tasks as inverted
    tag lists; their number follows the tags of one post and not the number of posts, and nothing is shuffled. A slug names one post; posts without a date
    are the oldest, null tags are none. ``posts(slug, published_at, tags)``.
    """
    tags = F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>"))))
    rows = posts.select("slug", "published_at", tags.alias("tags"))
    most = rows.agg(F.max(F.size("tags"))).first()[0] or 0
    head = rows.orderBy(F.col("published_at").desc_nulls_last(), "slug").limit(100 * most + n + 1).select("slug", "tags").toArrow()
    sent = posts.sparkSession.sparkContext.broadcast((head.column("slug").to_pylist(), head.column("tags").to_pylist()))
    return rows.select("slug", "tags").mapInArrow(_related(sent, n), "slug string, related string, shared int, score long, rank int")


def tag_overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def document_problems(posts: DataFrame) -> Column:
    """Array of rule names a post breaks; empty means it may be published. Rules run on the columns that exist."""
    c, have = F.col, set(posts.columns)
    text = lambda n: F.coalesce(c(n), F.lit(""))
    rules: list[tuple[str, Column]] = []
    if "slug" in have:
        rules.append(("reserved-slug", c("slug").isin(RESERVED)))
    if "title" in have:
        rules.append(("title", (text("title") == "") | (F.length("title") > 110)))
    if "description" in have:
        rules.append(("description", ~F.length(text("description")).between(50, 170)))
    if {"date", "file"} <= have:
        iso = text("date").rlike(ISO_TIME) & F.try_to_timestamp("date").isNotNull()
        rules += [("date", ~iso), ("date-file", iso & (F.substring("date", 1, 10) != F.substring("file", 1, 10)))]
    if "updated" in have:
        rules.append(("updated", (text("updated") != "") & F.try_to_timestamp("updated").isNull()))
    if "tags" in have:
        rules.append(("tags", ~F.coalesce(F.size("tags"), F.lit(0)).between(1, 5)))
    if "sources" in have:
        host = lambda s: ur.strip_www(ur.host_of(s["url"]))
        hosts = F.filter(F.transform("sources", host), lambda h: h != "")
        rules += [
            ("sources", F.size("sources") < MIN_SOURCES),
            ("source-fields", F.exists("sources", lambda s: (F.coalesce(s["publisher"], F.lit("")) == "") | (F.coalesce(s["title"], F.lit("")) == ""))),
            ("source-url", F.exists("sources", lambda s: ~s["url"].startswith("https://"))),
            ("source-hosts", F.size(F.array_distinct(hosts)) < MIN_SOURCES),
        ]
        if "key_facts" in have:
            cited = lambda k: F.transform(F.array_distinct(k["sources"]), lambda n: F.get("sources", n - 1)["url"])
            fact_hosts = lambda k: F.array_distinct(F.transform(F.filter(cited(k), lambda u: u.isNotNull()), lambda u: ur.strip_www(ur.host_of(u))))
            rules += [
                ("key-facts", F.size("key_facts") < 3),
                ("fact-text", F.exists("key_facts", lambda k: F.coalesce(k["text"], F.lit("")) == "")),
                ("fact-source", F.exists("key_facts", lambda k: F.exists(k["sources"], lambda n: ~n.between(1, F.size("sources"))))),
                ("fact-hosts", F.exists("key_facts", lambda k: F.size(fact_hosts(k)) < 2)),
            ]
    if "cover" in have:
        field = lambda k: F.coalesce(c(f"cover.{k}"), F.lit(""))
        rules += [
            ("cover-motif", field("motif") == ""), ("cover-kicker", F.length(field("kicker")) > 22), ("cover-stat", F.length(field("stat")) > 9),
            ("cover-label", F.length(field("stat_label")) > 48), ("cover-label-alone", (field("stat_label") != "") & (field("stat") == "")),
            ("cover-alt", ~F.length(field("alt")).between(20, 200)),
        ]
    body = c("markdown")
    words = c("words") if "words" in have else word_count(body)
    lower = F.lower(F.concat_ws("\n", *[c(k) for k in ("title", "description", "markdown") if k in have]))
    rules += [
        ("words", ~words.between(MIN_WORDS, MAX_WORDS)), ("top-heading", body.rlike(r"(?m)^#\s")), ("no-section", ~body.rlike(r"(?m)^##\s")),
        ("raw-html", body.rlike(r"(?i)<[a-z][^>]*>")),
    ]
    rules += [(f"banned:{p}", F.contains(lower, F.lit(p))) for p in BANNED_PHRASES]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]), lambda r: r.isNotNull())
