"""Derived tables over tables that were made before are the same rows."""

from conftest import SMALL

from sitegrain.plans.landed import landed, over


def test_link_checks_over_landed_links(spark):
    made = {n: landed(spark, SMALL, n) for n in ("image_links", "external_links")}
    got, want = over(spark, "link_checks", **made), landed(spark, SMALL, "link_checks")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
