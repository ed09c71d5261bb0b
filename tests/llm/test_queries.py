"""The registered corpus queries against their SQL, or against plain Python."""

import os

import brute
import pytest
from compare import compare

import corpus_pipeline
from motionlake.llm import catalog, mixing, pages, pieces, quality, simhash
from motionlake.llm.common import read

ENTRIES = catalog.entries()


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, ENTRIES[name].run, ENTRIES[name].sql) is None


def test_all_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_suffix_dedup(spark, sf_dir):
    got = rows(ENTRIES["op2_suffix_dedup"].run(spark, sf_dir))
    assert got == sorted(brute.bytes_removed(documents(spark, sf_dir)), key=repr)


def test_phrase_dedup(spark, sf_dir):
    got = rows(ENTRIES["op7_phrase_dedup"].run(spark, sf_dir))
    assert got == sorted(brute.words_removed(documents(spark, sf_dir)), key=repr)


def test_simhash(spark, sf_dir):
    got = rows(ENTRIES["op5_simhash"].run(spark, sf_dir))
    assert got == sorted(brute.simhash_groups(documents(spark, sf_dir), 3, 2), key=repr)


def test_embedding_caps(spark, sf_dir):
    vectors = [tuple(r) for r in read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = rows(ENTRIES["op10_embedding_caps"].run(spark, sf_dir))
    assert got == sorted(brute.cosine_links(vectors), key=repr)


def test_piece_codec(spark, sf_dir):
    import hashlib

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    want = []
    for d, t in documents(spark, sf_dir):
        ids = model.encode(t or "", add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((d, len(ids), digest, hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert rows(ENTRIES["op9_piece_codec"].run(spark, sf_dir)) == sorted(want, key=repr)


def test_page_text_is_the_article(spark, sf_dir):
    import html
    import re

    source = {r.page_id: r.html for r in read(spark, sf_dir, "pages").collect()}
    for row in ENTRIES["op3_page_text"].run(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", source[row.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", article)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_toxicity_on_held_out_rows(spark):
    sf_dir = os.environ.get("LEARN_SF_DIR", "/root/testdata/sf0.1")
    scored = ENTRIES["op4_toxicity"].run(spark, sf_dir)
    counts = {
        (r.toxic, r.predicted): r["count"]
        for r in scored.where("held_out").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    }
    found, missed = counts.get((1, 1), 0), counts.get((1, 0), 0)
    wrong, clean = counts.get((0, 1), 0), counts.get((0, 0), 0)
    assert found >= 0.88 * (found + missed) and wrong <= 0.03 * (wrong + clean)


def test_pipeline_stages(spark, sf_dir):
    """Every stage against a plain version of it on what its predecessor kept."""
    docs = read(spark, sf_dir, "documents")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, sf_dir)
    verdicts = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id: r for r in kept.collect()} == {d: r for d, r in before.items() if d in verdicts}
    cut = stage["line_dedup"](spark, kept, sf_dir)
    assert cut.columns == docs.columns and cut.count() == len(verdicts)
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    single = stage["near_dedup"](spark, cut, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == brute.similar_groups([(r.doc_id, r.text) for r in cut.collect()])
    mixed = stage["source_mix"](spark, single, sf_dir)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(single).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and all(got.count(d) == n for d, n in copies.items())
    assert stage["piece_codec"](spark, mixed, sf_dir).count() == len(got)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(got)


def test_mix_meets_targets(spark):
    mix = ENTRIES["op8_source_mixing"].run(spark, "/root/testdata/sf0.01")
    assert mix.where("taken > 2 * size").count() == 0
    per = mixing.mix_sources(read(spark, "/root/testdata/sf0.01", "documents")).groupBy("source", "target").sum("taken")
    assert all(abs(r["sum(taken)"] - r.target) <= 0.02 * r.target for r in per.collect())


def test_style_tree_finds_repeated_branches(spark):
    page = "<body><div class=x><p>Same words on every page</p></div><div class=y><p>Own text {}</p></div></body>"
    table = spark.createDataFrame([(i, "http://a.b/c", page.format(f"{i} " * 9)) for i in range(12)], "page_id long, url string, html string")
    texts = {r.text for r in pages.extract_pages(table).collect()}
    assert len(texts) == 12 and not any("Same" in t for t in texts)


def test_distinct_documents_keep_columns(spark):
    table = spark.createDataFrame(
        [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "other words stand here now ok", "z")],
        "doc_id long, text string, fp string",
    )
    assert sorted((r.doc_id, r.fp) for r in simhash.distinct_documents(table, 5, 3).collect()) == [(1, "y"), (3, "z")]
