"""Pages that share an address stay pages of their own, as their SQL says."""

import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

from sitegrain.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["page_checks", "page_scores", "ordered_checks"])
def test_pages_of_one_address_match_sql(spark, tmp_path, name):
    d = str(tmp_path)
    for table in ("pages",):
        rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
        if table == "pages":
            rows = rows.withColumn("url", F.when(F.col("page_id") < 6, "https://twin.example.com/a").otherwise(F.col("url")))
        rows.toPandas().to_parquet(f"{d}/{table}.parquet")
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    ok, note = compare(spark, con, d, name, QUERIES[name], ORACLES[name])
    assert ok, note
