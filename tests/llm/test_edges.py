"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import brute
import pytest

import corpus_pipeline
from motionlake.llm import caps, lines, mixing, pages, phrases, pieces, quality, simhash, suffixes, toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, version long, cell string,"
    " votes int, fp string, r int, kept string, starts int, size string, sid int, copies int, taken string"
)
RNG = random.Random(5)
LONG = " ".join("".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 9))) for _ in range(60_000))
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + "\nsecond line here\nthird line here\nfourth line"),
    (2, "start " + PASSAGE + "\nsecond line here\nthird line here\nfourth line"),
    (2, "start " + PASSAGE + "\nsecond line here\nthird line here\nfourth line"),
    (2, "another text under the same id " + PASSAGE),
    (None, PASSAGE + " with no id"),
    (None, "nothing else"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "one"),
    (7, "nul \x00 byte \x00 " * 30),
    (8, "nul \x00 byte \x00 " * 30 + "x"),
    (9, "é" * 40),
    (10, "a " + "é" * 40 + "b"),
    (11, LONG),
    (12, LONG[: len(LONG) // 2] + " cut"),
    (-5, "same same same same " * 40),
    (13, "!!! ??? ###"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "k", 1, "c", 2, "f", 3, "no", 4, "z", 5, 6, "t") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality(docs, none):
    got = quality.quality_rules(docs)
    assert got.count() == len(TEXTS) and got.where("n_words = 0 AND NOT base_failed").count() == 0
    echo = got.where("doc_id = -5").first()
    assert (echo.n_words, echo.n_repeat_words, echo.n_dup_lines, echo.kept) == (160, 160, 0, False)
    assert quality.quality_rules(none).count() == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_suffixes(docs, none):
    assert rows(suffixes.remove_repeats(docs).drop("kept")) == sorted(brute.bytes_removed(TEXTS), key=repr)
    assert suffixes.remove_repeats(none).count() == 0


def test_phrases(docs, none):
    assert rows(phrases.remove_repeats(docs).drop("kept")) == sorted(brute.words_removed(TEXTS), key=repr)
    assert phrases.remove_repeats(none).count() == 0


def test_simhash(docs, none):
    for radius in (2, 5):
        got = rows(simhash.near_duplicates(docs, 3, radius))
        assert got == sorted(brute.simhash_groups(TEXTS, 3, radius), key=repr)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.distinct_documents(docs, 5, 5).columns == docs.columns


def test_lines(docs, none):
    got = lines.deduplicated_documents(docs)
    assert got.columns == docs.columns and got.count() == len(TEXTS)
    text = {r.doc_id: r.text for r in got.where("doc_id IN (1, 3, 5)").collect()}
    assert text[1] == TEXTS[0][1] and text[3] is None and text[5] == TEXTS[8][1]
    # Two rows of id 2 lose nothing to each other; their first lines differ from row 1.
    twice = got.where("doc_id = 2").groupBy("text").count().collect()
    assert sorted(r["count"] for r in twice) == [1, 2]
    assert lines.line_report(none).count() == 0


def test_long_lines_go_and_short_pairs_stay(spark):
    line = " ".join(f"long{i}" for i in range(25))
    half = " ".join(f"half{i}" for i in range(13))
    rows = [
        (1, line), (2, "own\n" + line), (3, line + " more"), (4, "a b\nc d"), (5, "x\na b\n\nc d\ny"), (6, half + "\n" + half + " end"),
        (7, half + "\nother"), (8, "start\n" + half + "\n\n" + half + " end\n"), (9, line + "\n" + line),
    ]
    got = {r.doc_id: r.text for r in lines.deduplicated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == line and got[2] == "own" and got[3] == line + " more" and got[5] == rows[4][1] and got[7] == rows[6][1]
    assert got[8] == "start\n\n" and got[9] == ""


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs)
    assert got.count() == len(TEXTS) and got.where("taken > 2 * size OR size = 0 AND taken > 0").count() == 0
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]


def test_pieces(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    got = pieces.coded_documents(docs, pieces.public_model(), full=True)
    want = sorted(((d, model.encode(t or "", add_eos=True)) for d, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr) == want
    assert pieces.coded_documents(none, pieces.public_model()).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (4, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == len(TEXTS) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_pages(spark):
    table = spark.createDataFrame(
        [
            (1, None, None, 1),
            (2, "", "", 1),
            (None, "no host", "plain &amp; text", 1),
            (3, "http://h/x", "<p>a<p>b  c<br>d<div class='comments'><p>no</p></div><script>var a='</p>'</script>", 1),
            (3, "http://h/x", "<p>a<p>b  c<br>d<div class='comments'><p>no</p></div><script>var a='</p>'</script>", 1),
            (4, "https://u:p@h:8/x", "<nav>menu</nav><main><h1>T&eacute;</h1><form>f</form><ul><li>x<li>y</ul></main>out", 1),
            (5, "http://h", "<article><p>" + "long " * 200_000 + "</article>", 1),
            (6, "http://h", "< not a tag <b>bold</b> 1 < 2 <!-- gone", 1),
        ],
        "page_id long, url string, html string, host int",
    )
    got = {(r.page_id, r.url): r.text for r in pages.extract_pages(table).collect()}
    assert got[1, None] == got[2, ""] == "" and got[None, "no host"] == "plain & text"
    assert got[3, "http://h/x"] == "a\nb c\nd"
    assert got[4, "https://u:p@h:8/x"] == "Té\nx\ny"
    assert len(got[5, "http://h"]) == 5 * 200_000 - 1 and got[6, "http://h"] == "< not a tag bold 1 < 2"
    assert pages.extract_pages(table.limit(0)).count() == 0


def test_caps(spark):
    near = [1.0] * 8
    close = [1.0] * 7 + [1.1]
    vectors = [
        (1, near, 0), (2, close, 0), (3, near, 0), (4, near, 1), (5, near, None), (6, None, 0), (7, [], 0),
        (8, [0.0] * 8, 0), (9, [float("nan")] + [1.0] * 7, 0), (10, [None] + [1.0] * 7, 0), (11, [2.0] * 8, 0),
        (12, [1.0] * 4, 0), (13, [-1.0] * 8, 0), (14, [float("inf")] * 8, 0),
    ]
    table = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<double>, label int, node int, cap int")
    assert rows(caps.near_duplicates(table)) == sorted(brute.cosine_links(vectors), key=repr)
    assert caps.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_on_edges(spark, docs, none):
    for table in (docs, none):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "/nowhere")
            if name != "piece_codec":
                assert out.columns == docs.columns
        out.collect()
