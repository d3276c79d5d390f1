"""What the audit's queries leave on disk: no links once their findings are written, no shuffle files of finished steps, findings shuffled once."""

import os
import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sitegrain.operators import audit
from sitegrain.plans import QUERIES
from sitegrain.session import cut_lineage, shared_folder
from sitegrain.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["health_score", "issue_rollup", "issues_export"])
def test_links_are_deleted_once_their_findings_are_written(spark, name):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = QUERIES[name](spark, SMALL)
    left = [spark.read.parquet(f"{folder}/{t}") for t in set(os.listdir(folder)) - before]
    assert left and not [t.columns for t in left if "dst" in t.columns or "item" in t.columns or {"code", "status"} == {*t.columns} - {"site", "url"}]
    assert found.count() > 0


def test_lean_tables_keep_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffled(), spark.conf.get(setting, None)
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), lean=True)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 7 and spark.conf.get(setting, None) == given


def test_findings_are_rolled_up_in_one_shuffle(spark):
    rows = [("a", "missing-title", "error", "u2", None), ("a", "missing-title", "error", "u1", "x"), ("a", "missing-title", "error", "u1", None), ("b", "dead-end", "notice", "u", "y")]
    findings = spark.createDataFrame(rows, "site string, issue string, severity string, url string, detail string")
    rolled = audit.issue_rollup(findings)
    assert plan_of(rolled).count("Exchange") == 1
    assert sorted((r.site, r["count"], [tuple(u) for u in r.urls]) for r in rolled.collect()) == [("a", 3, [("u1", None), ("u1", "x"), ("u2", None)]), ("b", 1, [("u", "y")])]
    exported = sinks.findings_export(findings)
    assert exported.columns == sinks.issues_export(rolled).columns
    assert sorted(map(tuple, exported.collect())) == sorted(map(tuple, sinks.issues_export(rolled).collect()))


def test_exported_findings_are_not_grouped(spark):
    assert "collect_list" not in plan_of(QUERIES["issues_export"](spark, SMALL))
