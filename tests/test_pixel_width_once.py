"""Pixel widths go through a text once, not once for each class of width, and are the sums of the widths of its characters."""

import math
import random
import re

from pyspark.sql import functions as F

from sitegrain.functions import text as tx


def test_widths_are_sums_from_one_translation(spark):
    table = tx._width_of()
    known = "".join(table)
    rnd = random.Random(3)
    others = "éß中文字\U0001f600⺀⺁ \n"
    texts = ["", known, others, *known, *("".join(rnd.choice(known if rnd.random() < 0.8 else others) for _ in range(rnd.randrange(60))) for _ in range(200))]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", tx.pixel_width(F.col("t"), 20).alias("px"))
    got = {r["t"]: r["px"] for r in frame.collect()}

    def width(ch):
        return table.get(ch, tx.WIDE_WIDTH if ord(ch) > tx.WIDE_FROM else tx.DEFAULT_WIDTH)

    assert got == {**{t: math.floor(sum(map(width, t)) / 1000 * 20 + 0.5) for t in texts}, None: None}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"translate\(t#\d+, .", plan))) == 1
