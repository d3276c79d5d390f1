"""Ideas are made of their texts once, however often they are read."""

from sitegrain.operators import keywords


def test_ideas_read_their_texts_once(spark):
    rows = [("s", "google", "q", ["s one", "s  two", "s one"]), ("s", "bing", "q", ["s two x", ""]), ("t", "bing", "r", ["t two", "t two"])]
    lists = spark.createDataFrame(rows, "seed string, source string, query string, suggestions array<string>")
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    counted = lists.coalesce(1).mapInArrow(count, lists.schema)
    got = {(r.seed, r.keyword): r.cluster for r in keywords.assign_clusters(keywords.idea_scores(counted)).collect()}
    assert got == {("s", "s one"): "Other", ("s", "s two"): "two", ("s", "s two x"): "two", ("t", "t two"): "Other"}
    assert met.value == len(rows)
