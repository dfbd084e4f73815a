import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoplens.llm import chunks, simhash, suffix_dedup
from shoplens.llm.arrow import BYTE_CODES
from shoplens.llm.components import components
from tests.llm.util import EDGE, PASSAGE, empty, frame, groups, key, near_duplicates, repeated_bytes


# ---- simhash -------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=3))
def test_covering_masks_miss_no_pair(bits):
    diff = sum(1 << b for b in bits)
    assert any(m & diff == 0 for m in simhash.covering_masks(3))
    for m in simhash.covering_masks(3):
        if m & diff == 0:
            assert any(f & diff == 0 for f in simhash.split_mask(m, 3))


def test_simhash_equals_brute_force(spark):
    copies = [(100 + i, PASSAGE + " ".join(f"tail{j}" for j in range(i % 4))) for i in range(8)]
    rows = EDGE + copies
    assert key(simhash.near_duplicates(frame(spark, rows)).collect()) == key(near_duplicates(rows))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket,free_bits", [(1024, 12), (4, 20)])
def test_dense_buckets_are_split_without_loss(spark, bucket, free_bits):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(10)}
    for b in list(fps)[:3]:
        fps |= {b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {x.node: x.root for x in components(simhash.links(df, 3, bucket, free_bits)).collect()}
    want = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    same = {}
    for f, w in zip(signed, want):
        assert same.setdefault(w, root.get(f, f)) == root.get(f, f)
    assert len(set(same.values())) == len(same)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


# ---- suffix buckets --------------------------------------------------------------

def _rows():
    r = random.Random(1)
    letters = "abcdefghij klmnop"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared, rows, k = text(1000), list(EDGE), 1000
    for size in (199, 200, 201, 260, 400):
        for _ in range(3):
            a = r.randint(0, 1000 - size)
            rows.append((k, text(r.randint(0, 300)) + shared[a:a + size] + text(r.randint(0, 300))))
            k += 1
    return rows + [(k, shared), (k + 1, shared[:300] + "Z" + shared[300:]), (k + 2, "x" * 200), (k + 3, shared[:200]), (k + 4, "ab" * 400), (k + 5, "é" * 150)]


@pytest.mark.parametrize("hot,block", [(50_000, 12_000), (2, 50)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = _rows()
    got = suffix_dedup.digests(suffix_dedup.deduplicate(frame(spark, rows), hot=hot)).collect()
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, repeated_bytes(rows))]
    assert key(got) == key(want)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_cover_is_a_difference_cover():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in d for b in d} == set(range(suffix_dedup.PERIOD))


def test_ranks_survive_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_WORDS", np.zeros(suffix_dedup.REACH // 8, np.uint64))
    x = np.random.RandomState(0).randint(0, 3, (40, suffix_dedup.WIDTH)).astype(np.uint8)
    x[7] = x[3]
    rank = suffix_dedup._ranks(x, 5)
    assert rank[7] == rank[3] and len(set(rank.tolist())) == 39


# ---- chunks ------------------------------------------------------------------------

def _ends(b, horizon=32, gear=16):
    codes, h = [int(c) for c in BYTE_CODES], []
    for i in range(len(b)):
        v = 0
        if i >= gear - 1 and not (i + 1 < len(b) and b[i + 1] & 0xC0 == 0x80):
            for j in range(i - gear + 1, i + 1):
                v = ((v << 4) + codes[b[j]]) & ((1 << 64) - 1)
        h.append(v)
    cut = [i + 1 for i in range(len(b)) if h[i] and all(h[i] > x for x in h[max(0, i - horizon):i]) and all(h[i] >= x for x in h[i + 1:i + horizon + 1])]
    return sorted({*cut, len(b)} - {0})


def _chunk_brute(rows, run_bytes=chunks.RUN_BYTES):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for d in order:
        b, a = d[1].encode(), 0
        for e in _ends(b):
            first.setdefault(b[a:e], (d, a))
            a = e
    for d in order:
        b, a, runs = d[1].encode(), 0, []
        for e in _ends(b):
            if first[b[a:e]] != (d, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = e
                else:
                    runs.append([a, e])
            a = e
        runs = [r for r in runs if r[1] - r[0] >= run_bytes]
        kept = bytearray(b)
        for x, y in reversed(runs):
            del kept[x:y]
        out[d] = (d[0], len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return [out[i, t or ""] for i, t in rows]


@pytest.mark.parametrize("run_bytes", [chunks.RUN_BYTES, 1])
def test_chunk_dedup_equals_brute_force(spark, run_bytes):
    rows = EDGE + [(50, "qrs " + PASSAGE + PASSAGE), (51, "é😀" * 100)]
    assert key(chunks.digests(chunks.deduplicate(frame(spark, rows), run_bytes=run_bytes)).collect()) == key(_chunk_brute(rows, run_bytes))
    assert chunks.deduplicate(empty(spark)).count() == 0


def test_chunks_resist_an_insertion():
    def cut(t):
        b = np.frombuffer(t.encode(), np.uint8)
        e = chunks.boundaries(b, np.array([0, len(b)]))
        return {t.encode()[a:z] for a, z in zip([0, *e], e)}

    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(800))
    a, b = cut(text), cut(text[:2000] + "inserted " + text[2000:])
    assert len(a - b) <= 3


def test_repeated_passages_are_caught_and_clean_texts_left(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    passages = [" ".join(word() for _ in range(55)) for _ in range(20)]
    planted = [(100 + 2 * i + k, f"{' '.join(word() for _ in range(30))} {p} {' '.join(word() for _ in range(30))}") for i, p in enumerate(passages) for k in (0, 1)]
    got = {x.doc_id: x.n_removed for x in chunks.deduplicate(frame(spark, clean + planted)).collect()}
    assert not any(got[i] for i, _ in clean)
    assert sum(got[101 + 2 * i] > 0 for i in range(20)) >= 19 and not any(got[100 + 2 * i] for i in range(20))
