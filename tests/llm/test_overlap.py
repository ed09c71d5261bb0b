"""Near duplicates of the pipeline against all pairs in plain Python."""

import random
import sys

import brute
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from motionlake.llm import overlap

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_near_dedup_takes_every_pair_from_a_similarity_of_0_8(spark):
    rng = random.Random(8)
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(240)]
        docs.append((10 * k, " ".join(words)))
        for n in range(1, 4):  # edits that leave similarities from about 0.7 to 1
            other = list(words)
            for at in rng.sample(range(240), rng.randint(0, 8)):
                other[at] = f"x{rng.randrange(5000)}"
            docs.append((10 * k + n, " ".join(other)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "/nowhere").collect())
    assert got == brute.similar_groups(docs)
    prints = np.array([brute.print_of(t, 5) for _, t in docs], dtype=np.uint64)
    assert (np.bitwise_count(prints[1::4] ^ prints[::4]) > 5).any()


def test_large_bucket_of_chained_copies(spark):
    """Neighbours are similar, ends are not: one group, though no member is near to all."""
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(base[i * 5 : i * 5 + 200])) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "/nowhere").collect())
    assert got == brute.similar_groups(docs) == [0]


def test_many_texts_just_below_the_limit(spark, monkeypatch):
    """Hundreds of texts that share buckets but few links: blocks decide, in several chunks."""
    monkeypatch.setattr(overlap, "CHUNK_ROWS", 40)
    monkeypatch.setattr(overlap, "GROUP", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(4, 9)):
            words[at] = f"x{rng.randrange(9)}"
        docs.append((i, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "/nowhere").collect()) == brute.similar_groups(docs)


def test_blocks_return_spanning_edges_only():
    """2,000 texts of similarity about 0.7 and a few close ones: edges, never pairs."""
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**40, 160)
    sets = [np.unique(np.concatenate([common, rng.integers(2**41, 2**60, 34)])) for _ in range(1000)]
    sets += [np.unique(np.concatenate([s, rng.integers(2**61, 2**62, 3)])) for s in sets[:50]]
    n = len(sets)
    a, b = overlap._spanning(np.arange(n), np.arange(n), np.zeros(n, dtype=np.int32), 0, sets)
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, 1000 + i) for i in range(50)]
    same = [common] * 300
    a, b = overlap._spanning(np.arange(300), np.arange(300), np.zeros(300, dtype=np.int32), 0, same)
    assert len(a) == 299


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties and repeats, against all pairs."""
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long + " end"), (8, long.replace("w1", "v1")),
            (None, "one two three four five six"), (None, "other"), (9, "one two three four five six"), (10, "one two three four five six seven")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = corpus_pipeline.near_dedup(spark, table, "/nowhere").collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted([(1, None), (4, "one two"), (6, long), (8, docs[8][1]), (9, docs[11][1]), (10, docs[12][1]), (None, "other")], key=repr)
    assert corpus_pipeline.near_dedup(spark, table.limit(0), "/nowhere").count() == 0


def test_simhash_groups_are_candidates_and_the_similarity_decides(spark, monkeypatch):
    """Without minimum hashes the pairs within two bits are still found, and only similar ones."""
    monkeypatch.setattr(overlap, "HUB_ROUNDS", 0)
    monkeypatch.setattr(overlap, "_in_blocks", _no_blocks)
    rng = random.Random(3)
    docs = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + [f"x{k}"]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    near = [k for k in range(40) if (brute.print_of(docs[2 * k][1], 5) ^ brute.print_of(docs[2 * k + 1][1], 5)).bit_count() <= 2]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "/nowhere").collect()}
    assert len(near) > 10 and got == set(range(80)) - {2 * k + 1 for k in near}
    monkeypatch.undo()
    version = table.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("version"), F.lit(0).alias("group"))
    found = overlap.distinct_documents(table, 5, version)  # all of them one group: no link by that alone
    assert sorted(r.doc_id for r in found.collect()) == brute.similar_groups(docs) == list(range(0, 80, 2))


def _no_blocks(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
