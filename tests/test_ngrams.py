"""Phrases of texts: counted within a row, and over rows that share a key."""

from compare import compare, connect
from pyspark.sql import functions as F

from sitegrain.functions import text as tx
from sitegrain.operators import keywords
from sitegrain.plans import ORACLES, QUERIES
from sitegrain.plans.landed import TABLES

TEXTS = [
    (1, "red fox red fox red fox blue cat blue cat 12 12 x y"), (2, "red fox"), (2, "red fox red fox red fox and many more words here"), (2, None), (3, None), (4, ""), (None, "green owl green owl"),
    (None, "green owl"), (5, "of the of the of the"), (6, "éa éb éa éb Éa éB zz zz"), (7, " ".join(f"w{i} v{i}" for i in [*range(40), *range(40)])),
]


def test_ngrams_of_odd_rows_match_sql(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet/")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert "documents" in TABLES
    for n in (1, 2, 3):
        ok, note = compare(spark, con, str(tmp_path), f"top_ngrams_{n}", QUERIES[f"top_ngrams_{n}"], ORACLES[f"top_ngrams_{n}"])
        assert ok, note


def test_texts_with_a_key_of_their_own_move_no_phrase(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.repeat(F.lit("one two three "), 20).alias("t"))
    plan = keywords.top_ngrams(rows, "k", "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    own = plan[plan.index("Union") :].split("Aggregate")[0]
    assert "posexplode" in own and "Window" not in own.split("posexplode")[0]


def test_repetitions(spark):
    row = spark.sql("SELECT array('b', 'a', 'b', 'c', 'b', 'a') AS a, array('x') AS x, CAST(array() AS array<string>) AS e, CAST(NULL AS array<string>) AS n").select(
        *[tx.repetitions(F.col(c)).alias(c) for c in "axen"]).first()
    assert [tuple(r) for r in row.a] == [(-2, "a"), (-3, "b")] and row.x == row.e == [] and row.n is None
