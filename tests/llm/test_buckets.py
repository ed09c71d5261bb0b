"""Buckets of winnowed seeds hold about equal shares."""

import numpy as np

from motionlake.llm import cells as C


def test_seeds_are_dealt_evenly():
    rng = np.random.default_rng(5)
    grams = C.gram_hashes(rng.integers(97, 123, 400_000).astype(np.uint8), 24)
    seeds = grams[C.distinct_places(C.winnow(grams, 27))]
    sizes = {}
    for b, body in zip(*C.ask_seeds(0, seeds, 32).select(["bucket", "body"]).to_pydict().values()):
        assert b not in sizes  # one message a bucket
        own = C.unpack(body, np.uint64)[0]
        assert (C.seed_bucket(own, 32) == b).all() and (own[1:] > own[:-1]).all()
        sizes[b] = len(own)
    assert sum(sizes.values()) == len(np.unique(seeds)) and len(sizes) == 32
    assert max(sizes.values()) < 1.2 * np.mean(list(sizes.values()))


def test_buckets_are_not_put_together(spark):
    asked = spark.range(64).selectExpr("id AS cell", "id % 32 AS bucket", "CAST('' AS BINARY) AS body")
    met = C.meet(asked, 32).applyInArrow(lambda keys, table: table, C.MESSAGE)
    assert met.rdd.getNumPartitions() > 32
