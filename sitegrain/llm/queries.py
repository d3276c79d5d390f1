"""Registered queries of the ten operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import alignment, cross_entropy, html_text, impact_index, language, near_dups, packing, personal_data, pieces, quality, spelling, token_counts, vector_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_near_dups", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS item FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  WHERE 100 * least(m.n, n.n) >= 80 * greatest(m.n, n.n)
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.seen)
SELECT s.doc_id, s.n AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
""")
def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole texts in ids of a byte-level BPE, found by their separators in flat 16-bit files."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op7_top_k", """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.fit(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal_data.KINDS), F.sha2(listed(F.filter("spans", lambda s: s.rule)), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op4_pieces")
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = pieces.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return both.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "parity", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_cross_entropy", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS chosen FROM documents),
grams AS MATERIALIZED (SELECT doc_id, chosen, substr(t, greatest(1, i - 3), least(4, i)) AS g FROM (SELECT doc_id, chosen, t, unnest(range(1, n + 1)) AS i FROM d)),
g4 AS MATERIALIZED (SELECT g, count(*) AS nb, count(*) FILTER (WHERE chosen) AS nt FROM grams GROUP BY g),
g3 AS (SELECT right(g, 3) AS g, sum(nb) AS nb, sum(nt) AS nt FROM g4 GROUP BY 1),
g2 AS (SELECT right(g, 2) AS g, sum(nb) AS nb, sum(nt) AS nt FROM g4 GROUP BY 1),
g1 AS (SELECT right(g, 1) AS g, sum(nb) AS nb, sum(nt) AS nt FROM g4 GROUP BY 1),
h4 AS (SELECT left(g, length(g) - 1) AS h, sum(nb) AS nb, sum(nt) AS nt FROM g4 GROUP BY 1),
h3 AS (SELECT left(g, length(g) - 1) AS h, sum(nb) AS nb, sum(nt) AS nt FROM g3 GROUP BY 1),
h2 AS (SELECT left(g, length(g) - 1) AS h, sum(nb) AS nb, sum(nt) AS nt FROM g2 GROUP BY 1),
h1 AS (SELECT sum(nb) AS nb, sum(nt) AS nt, count(*) AS v FROM g1),
p1 AS (SELECT g, (g1.nb + 10.0 / v) / (h1.nb + 10.0) AS pb, (g1.nt + 10.0 / v) / (h1.nt + 10.0) AS pt FROM g1, h1),
p2 AS (SELECT x.g, (x.nb + 10.0 * pb) / (h.nb + 10.0) AS pb, (x.nt + 10.0 * pt) / (h.nt + 10.0) AS pt FROM g2 x JOIN h2 h ON h.h = left(x.g, length(x.g) - 1) JOIN p1 p ON p.g = right(x.g, 1)),
p3 AS (SELECT x.g, (x.nb + 10.0 * pb) / (h.nb + 10.0) AS pb, (x.nt + 10.0 * pt) / (h.nt + 10.0) AS pt FROM g3 x JOIN h3 h ON h.h = left(x.g, length(x.g) - 1) JOIN p2 p ON p.g = right(x.g, 2)),
p4 AS MATERIALIZED (SELECT x.g, -ln(CAST((x.nb + 10.0 * pb) / (h.nb + 10.0) AS DOUBLE)) AS lb, -ln(CAST((x.nt + 10.0 * pt) / (h.nt + 10.0) AS DOUBLE)) AS lt FROM g4 x JOIN h4 h ON h.h = left(x.g, length(x.g) - 1) JOIN p3 p ON p.g = right(x.g, 3)),
s AS (SELECT doc_id, count(*) AS n, avg(lt) AS lt, avg(lb) AS lb FROM grams JOIN p4 USING (g) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS score FROM d LEFT JOIN s USING (doc_id)
""".replace("10.0", "CAST(10 AS DOUBLE)"))
def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under character models of all of them and of those labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = cross_entropy.cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


@query("op11_spelling", """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM hexed, crc),
erased AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM erased WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_way AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest),
near AS MATERIALIZED (SELECT * FROM one_way UNION ALL SELECT near, near_n, word, n FROM one_way),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word, n),
named AS MATERIALIZED (SELECT word, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM best),
ways AS (SELECT word, form AS root FROM named WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM ways w JOIN named f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM ways w LEFT JOIN named f ON f.word = w.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN named USING (word) LEFT JOIN ends USING (word)
""")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by both tokenizers; links are counted over all documents."""
    return alignment.aligned_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_quality", r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
seq AS MATERIALIZED (SELECT r, lang, i, ws[i] AS word, translate(ws[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
triples AS MATERIALIZED (SELECT r, i, row(a, b, c) AS g FROM (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM seq WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM triples) WHERE n >= 2),
repeated AS (SELECT r, count(DISTINCT i) AS n FROM again GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
kinds AS MATERIALIZED (SELECT r, lang, length(t) AS n, list_transform(['[a-z]', '[A-Z]', '[0-9]', '[.,;:?!''"()-]', '[\x20\x09-\x0D]', '[\x{C0}-\x{24F}]', '[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]'], lambda p: length(t) - length(regexp_replace(t, p, '', 'g'))) AS k FROM d),
classes AS MATERIALIZED (SELECT r, lang, n, list_append(k, n - list_sum(k)) AS k FROM kinds),
totals AS (SELECT lang, count(*) AS n FROM seq WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 1000 ORDER BY n DESC, lang LIMIT 100),
common AS MATERIALIZED (SELECT lang, low, c, n FROM (SELECT lang, low, count(*) AS c, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, low) AS p FROM seq GROUP BY lang, low) JOIN totals USING (lang) WHERE p <= 50),
own AS (SELECT r, low, count(*) AS c FROM seq GROUP BY r, low),
size AS (SELECT r, count(*) AS n FROM seq GROUP BY r),
pairs AS (
  SELECT s.r, m.lang, CAST(m.c AS DOUBLE) / m.n AS p, coalesce(o.c, 0) / CAST(s.n AS DOUBLE) AS q FROM size s CROSS JOIN common m LEFT JOIN own o ON o.r = s.r AND o.low = m.low),
parts AS (SELECT r, lang, p, q FROM pairs UNION ALL SELECT r, lang, 1 - sum(p), 1 - sum(q) FROM pairs GROUP BY r, lang),
word_far AS (SELECT r, min(far) AS far FROM (
  SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM parts GROUP BY r, lang) GROUP BY r),
sums AS (SELECT lang, i, sum(k[i]) AS c FROM (SELECT lang, k, unnest(range(1, 9)) AS i FROM classes JOIN totals USING (lang)) GROUP BY lang, i),
ref AS (SELECT lang, i, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY lang) AS p FROM sums),
char_far AS (SELECT r, min(far) AS far FROM (
  SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far
  FROM (SELECT c.r, ref.lang, p, k[i] / CAST(c.n AS DOUBLE) AS q FROM classes c CROSS JOIN ref WHERE c.n > 0) GROUP BY r, lang) GROUP BY r),
base AS (SELECT d.r, doc_id, coalesce(size.n, 0) AS n_words, c.n - k[5] AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, c.n AS n_chars, char_far.far AS cf, word_far.far AS wf
  FROM d JOIN classes c USING (r) LEFT JOIN size USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r) LEFT JOIN char_far USING (r) LEFT JOIN word_far USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= 200 AND coalesce(cf, 0) > 0.25) AND NOT (n_words >= 100 AND coalesce(wf, 0) > 0.36) AS kept
FROM failed
""")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
