"""Building blocks: merge tree, masks, components, paired blocks, piece merging, channel."""

import heapq
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motionlake.llm import caps, cells, components, pages, pieces, simhash, suffixes, toxicity
from motionlake.llm.common import paired_blocks


@given(st.lists(st.lists(st.binary(min_size=6, max_size=6), max_size=20), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges_front_coded_runs(lists):
    lists = [sorted(x) for x in lists if x]
    runs = []
    for x in lists:
        shared, rest = suffixes.front_code(np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, 6))
        runs.append(suffixes.read_run(shared.tolist(), rest, 6))
    merged = list(suffixes.merge_runs(runs)) if runs else []
    assert [e for _, _, e in merged] == list(heapq.merge(*lists))
    for (_, _, a), (_, n, b) in zip(merged, merged[1:]):
        assert a[:n] == b[:n] and (n == 6 or a[n] != b[n])


@given(st.lists(st.integers(0, 63), max_size=5), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_covering_masks(flips, value):
    other = value
    for b in set(flips):
        other ^= 1 << b
    for radius in (2, 3, 5):
        if len(set(flips)) <= radius:
            assert any((value & m) == (other & m) for m in simhash.covering_masks(radius, radius <= 3))


def test_large_bucket_links_equal_small_ones():
    rng = np.random.default_rng(1)
    free = sum(1 << b for b in range(0, 54, 3))
    prints = np.unique(np.array([sum(1 << int(b) for b in rng.choice(range(0, 54, 3), 5)) for _ in range(4000)], dtype=np.uint64))
    left, right = simhash._bucket_links(prints, free, 2)
    more, rest = simhash._bucket_links(np.repeat(prints, 1)[:2000], free, 2)
    assert len(prints) > 2048 and len(left) and len(more) and len(right) == len(left) and len(rest) == len(more)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    sets = brute.Sets({x for p in pairs for x in p})
    for a, b in pairs:
        sets.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for p in pairs if p[0] != p[1] for x in p}


def test_paired_blocks_meet_and_stay_small(spark):
    table = spark.createDataFrame([(0, i) for i in range(100)] + [(1, 1), (2, 1), (2, 2)], "g int, m long")
    blocks = {}
    for r in paired_blocks(table, ["g"], "m", 10).collect():
        blocks.setdefault((r.g, r.block), set()).add(r.m)
    met = {(a, b) for (g, _), s in blocks.items() if g == 0 for a in s for b in s}
    assert len(met) == 100 * 100 and max(map(len, blocks.values())) <= 45 and all(g != 1 for g, _ in blocks)


def test_winnow_picks_the_first_smallest():
    hashes = np.random.default_rng(2).integers(0, 50, 5000).astype(np.uint64) << np.uint64(40)
    got = cells.winnow(hashes, 9)
    assert all(got[s] == s + int(np.argmin(hashes[s : s + 9])) for s in range(len(got)))


def test_cap_lists_are_complete():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((50, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotation, words = caps.codebooks(24, 8)[0]
    row, cap = caps.decode(unit, rotation, words)
    turned = (unit @ rotation).reshape(50, caps.BLOCKS, -1)
    products = np.einsum("nbd,bcd->nbc", turned, words)
    every = (products[:, 0, :, None, None] + products[:, 1, None, :, None] + products[:, 2, None, None, :]).reshape(50, -1)
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(every >= every.max(axis=1, keepdims=True) - caps.MARGIN + 1e-12))}
    assert want <= set(zip(row.tolist(), cap.tolist())) and len(row) <= len(want) + 5


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_caps_of_any_dimension_are_few_and_find_close_pairs(dim):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((300, dim))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    met, caps_of = set(), 0
    for rotation, words in caps.codebooks(dim, 64):
        left, right = (set(zip(*(x.tolist() for x in caps.decode(v, rotation, words)))) for v in (a, b))
        met |= {row for row, _ in left & right}
        caps_of += len(left)
    assert len(met) >= 0.99 * 300 and caps_of < 40 * 300


@given(st.lists(st.text(alphabet=st.sampled_from("abehint ▁\n\té執😀01!-=._ͅ\x00"), max_size=60), max_size=20))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(texts):
    import pyarrow as pa
    import sentencepiece

    path = pieces.public_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["a", "b"])
    (out,) = pieces._coded(iter([batch]), path, True)
    want = [model.encode(t, add_eos=True) for t in texts]
    assert out.column("ids").to_pylist() == want
    assert out.column("decoded").to_pylist() == [model.decode(w) for w in want]


def test_channel_restores_disguised_words(spark):
    text = "the stupid idiot is a moron and a clown and they are worthless trash " * 3
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    for word, disguised in {"idiot": "1d10t", "stupid": "$tup1d", "moron": "m0r0n", "clown": "c.l.o.w.n", "trash": "tr4sh"}.items():
        assert word in toxicity.readings(disguised, model)
    assert toxicity.restore("stuuuupid", model) == "stupid" and toxicity.restore("st*pid", model) == "stupid"
    assert "idiot!" in toxicity.tokens("you i d i o t ! then")
    assert "idiot" in toxicity.tokens("y o u i d i o t")


def test_page_parts():
    assert pages.main_text("<header>top</header><article><header><h1>A</h1></header><p>b</article><footer>c") == "A\nb"
    assert pages.main_text("<div class='cookie-notice'>x</div><p>y &lt; z</p><aside>q</aside>") == "y < z"
    assert pages.main_text("<article>a<p title='>'>b<img src=x>c</p></article>") == "a\nbc"
