"""Readability measures each text once."""

from compare import compare, connect
from conftest import SMALL

from sitegrain.plans import ORACLES, QUERIES


def test_texts_are_measured_once(spark):
    frame = QUERIES["readability"](spark, SMALL)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z][A-Za-z'’-]*") == 1
    ok, note = compare(spark, connect(SMALL), SMALL, "readability", QUERIES["readability"], ORACLES["readability"])
    assert ok, note
