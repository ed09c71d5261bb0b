"""Toxicity with many toxic labels, near copies and long disguises."""

import numpy as np

from motionlake.llm import toxicity


def test_half_of_the_labels_toxic(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        words = [f"common{''.join(chr(97 + int(d)) for d in str(w))}" for w in rng.integers(0, 400, 40)]
        if i % 2:
            words[int(rng.integers(0, 40))] = ["idiot", "moron", "clown"][i % 3]
        rows.append((i, " ".join(words), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.join(table, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) >= 0.95 * (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.05 * (counts.get((0, 1), 0) + counts.get((0, 0), 0))


def test_weights_change_nothing_at_a_low_share():
    assert toxicity.class_weights(0.12) == (1.0, 1.0, 0.12)
    toxic, clean, share = toxicity.class_weights(0.5)
    assert abs(toxic / (toxic + clean) - share) < 1e-9  # a chance word keeps the lower share


def test_only_near_copies_of_one_label_are_one_row(spark):
    """Every text starts and ends with the same frequent pairs, which hold the least hashes of some."""
    rng = np.random.default_rng(9)
    frequent = " ".join(f"the{k} of{k}" for k in range(30))
    rows = [(i, frequent + " " + " ".join(f"w{w}" for w in rng.integers(0, 10**6, 30)), i % 2) for i in range(200)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(50)]  # copies
    rows += [(2000 + i, rows[i][1], 1 - rows[i][2]) for i in range(50)]  # copies with another label
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = table.where("crc32(cast(doc_id AS string)) % 3 <> 1")
    got = toxicity.training_rows(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert got.count() >= 0.97 * train.select("text", "toxic").distinct().count()
    assert got.count() <= train.select("text", "toxic").distinct().count() < train.count()


def test_disguises_of_any_length(spark):
    text = "the stupid idiot is a moron and a clown and they are worthless trash " * 3
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    assert "stupid" in toxicity.readings("st" + "u" * 60 + "pid", model)
    assert "idiot" in toxicity.readings("i" + "." * 40 + "d.i.o.t", model)
    stretched = " ".join("they are i" + "d" * 40 + "i0t").replace("   ", " ")
    assert "idiot" in [w for t in toxicity.tokens(stretched, model) for w in toxicity.readings(t, model)]
    assert len(toxicity.restore("a" + "*" * 3000 + "b", model)) >= 2
    assert toxicity.readings("https://example.org/a1b2/" + "c3d4" * 10, model) == ["https://example.org/a1b2/" + "c3d4" * 10]
    assert toxicity.readings("0123456789abcdef" * 4, model) == ["0123456789abcdef" * 4]
