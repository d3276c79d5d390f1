import json
import random

from pyspark.sql import functions as F

from sitegrain import streaming
from sitegrain.operators import audit
from sitegrain.plans.audits import full_pages
from conftest import SMALL


def brute_force(rows, most, window):
    state, out = {}, {}
    for key, event, t in sorted(rows, key=lambda r: (r[2], r[1])):
        count, reset = state.get(key, (0, float("-inf")))
        if reset <= t:
            state[key], out[event] = (1, t + window), True
        elif count >= most:
            out[event] = False
        else:
            state[key], out[event] = (count + 1, reset), True
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "key string, event_id long, t double").select("key", "event_id", F.timestamp_micros(((F.col("t") + 1.7e9) * 1e6).cast("long")).alias("ts"))


def test_limit_with_a_hot_key_in_slices(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}", i, float(rnd.randrange(4000)) / 4) for i in range(4000)]
    for slices in (1, 3, 256):
        got = streaming.fixed_window_limit_batch(requests(spark, rows), 3, 10.0, slices)
        assert {r["event_id"]: r["ok"] for r in got.collect()} == brute_force(rows, 3, 10.0)


def run(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_limit_as_a_stream(spark, tmp_path):
    rows = [("a", i, float(i)) for i in range(30)] + [("b", 100 + i, float(i * 7)) for i in range(10)]
    requests(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    run(streaming.fixed_window_limit(stream, 3, 10.0), "limited", "append")
    assert {r["event_id"]: r["ok"] for r in spark.table("limited").collect()} == brute_force(rows, 3, 10.0)


def test_page_findings_as_a_stream_equal_the_batch(spark, tmp_path):
    pages = full_pages(spark, SMALL)
    batch = audit.page_issues(pages)
    pages.coalesce(2).write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    run(audit.page_issues(stream), "findings", "append")
    key = lambda r: (r["site"], r["issue"], r["url"], r["detail"] or "")
    assert sorted(map(key, spark.table("findings").collect())) == sorted(map(key, batch.collect()))


def test_progress_sections_and_first_lookups(spark, tmp_path):
    lines = [{"audit_id": "x", "seq": i, "type": t, "phase": p, "crawled": i, "page": {"site": "e", "url": f"u{i}", "status": 200}}
             for i, (t, p) in enumerate([("start", None), ("phase", "crawling"), ("page", None), ("page", None), ("phase", "analyzing"), ("done", None)])]
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    from sitegrain.sources.responses import read_events

    run(streaming.audit_progress(read_events(spark, str(tmp_path / "ev"), streaming.EVENT_SCHEMA, stream=True)), "progress", "complete")
    row = spark.table("progress").first()
    assert (row["phase"], row["pages"], row["last_page"], row["finished"]) == ("analyzing", 2, "u3", True)
    assert read_events(spark, str(tmp_path / "ev"), streaming.EVENT_SCHEMA).count() == 6

    spark.createDataFrame([("d", s) for s in "abcdefgh"] + [("e", "a"), ("e", "a")], "domain string, section string").write.parquet(str(tmp_path / "sec"))
    run(streaming.completed_overviews(spark.readStream.schema("domain string, section string").parquet(str(tmp_path / "sec"))), "arrived", "complete")
    assert {r["domain"]: r["complete"] for r in spark.table("arrived").collect()} == {"d": True, "e": False}

    spark.createDataFrame([("k", 0), ("k", 5), ("j", 6)], "key string, t long").select("key", F.timestamp_seconds("t").alias("fetched_at")).coalesce(1).write.parquet(str(tmp_path / "look"))
    run(streaming.first_lookups(spark.readStream.schema("key string, fetched_at timestamp").parquet(str(tmp_path / "look")), "1 hour"), "firsts", "append")
    assert sorted(r["key"] for r in spark.table("firsts").collect()) == ["j", "k"]
