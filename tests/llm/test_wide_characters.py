"""Characters beyond the basic plane against the query's own SQL."""

import duckdb
import pytest

from sitegrain.llm import cross_entropy
from sitegrain.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sent", [cross_entropy.SENT, 20])
def test_each_has_its_own_entry(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(cross_entropy, "SENT", sent)
    texts = ["😀a😁b😀a😁", "😁😁😁😁😁", "𠀀𠀁𠀀x𠀂￿", "plain text", "\0\x01\0x", "\x01x", "", None, "😀😀😀a\U0010ffff"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (2, 1), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    near = lambda rows: [tuple(pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in r) for r in sorted(rows, key=lambda r: r[0])]
    got = sorted((tuple(r) for r in QUERIES["op8_cross_entropy"](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == near(con.execute(ORACLES["op8_cross_entropy"]).fetchall())
