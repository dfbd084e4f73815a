"""Phrases, language-model scores and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import gru, lm, phrases, resample
from shoplens.llm.store import stored
from tests.llm.util import EDGE, LONG, WORD, empty, key

SCHEMA = "doc_id long, text string, lang string, word string, n long, f long, gram binary, m int, row long, rank long, score long, weight long, bucket int, k int, a long"


def docs_frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g, "w", 1, 2, b"g", 3, 4, 5, 6, 7, 8, 9, 10) for i, t, g in rows], SCHEMA).repartition(parts)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- phrases -----------------------------------------------------------------------

def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, 5):
                counts.update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if 2 <= len(p) <= 4 and a >= least}
        inside = {}
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside.get(p[i:i + m], 0), a)
        best = []
        for p, a in often.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return out


def _phrase_rows():
    r = random.Random(7)
    vocab = ["the", "of", "and", "New", "york", "city", "état", "日本", "x_y", "#", "rare%d"]
    rows = [(i, " ".join((w % r.randint(0, 99) if "%" in w else w) + r.choice(["", "", "", "", ",", ".", "\n", "!\t"]) for w in r.choices(vocab, k=r.randint(0, 60))),
             r.choice(["en", "fr", None])) for i in range(160)]
    rows += [(1000 + i, "to be or not to be that is the question of all, and so on it goes", "en") for i in range(40)]
    return rows + [(i, t, "en") for i, t in EDGE] + [(2000, "a b " * 4000, "en"), (2001, "z" * 40_000 + " of the", "fr")]


@pytest.mark.parametrize("codes, hot", [(65_000, 2_000), (3, 2_000), (0, 5), (65_000, 3)])
def test_phrases_equal_brute_force(spark, monkeypatch, codes, hot):
    monkeypatch.setattr(phrases, "HOT_SHARE", hot)
    rows = _phrase_rows()
    docs = docs_frame(spark, rows, 5)
    words, seed = phrases.proved_vocabulary(docs)
    monkeypatch.setattr(phrases, "token_table", lambda w, least, table=phrases.token_table: table(w, least, codes))
    got = phrases.mine(docs, least=12, top=25)
    assert key(got.collect()) == key(brute_phrases(rows, 12, 25))


def test_runs_are_added_up_over_batches(spark):
    rows = _phrase_rows()
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = phrases.mine(docs_frame(spark, rows), least=5, top=400).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert key(got) == key(brute_phrases(rows, 5, 400))


def test_tokens_are_proved_unique(spark, monkeypatch):
    docs = docs_frame(spark, [(1, "a b c d a b", "en")])
    plain = phrases.Pieces.hashes
    monkeypatch.setattr(phrases, "vocabulary", lambda d, seed, *a: (
        spark.sql("select 'en' as lang, w as word, 1L as id, 1L as n from values ('a'), ('b') as t(w)") if seed == 0
        else spark.sql("select 'en' as lang, w as word, id, 1L as n from values ('a', 1L), ('b', 2L) as t(w, id)")))
    assert phrases.proved_vocabulary(docs)[1] == 1
    assert phrases.Pieces.hashes is plain


def test_unary_paths(spark):
    line = "one two three four five six seven"
    rows = [(i, f"{line}. one two three eight", "en") for i in range(30)]
    got = {(r.phrase, r.n_words, r.f) for r in phrases.paths(docs_frame(spark, rows)).collect()}
    assert got == {("two three four five six seven", 6, 30)} or got == {(line, 7, 30)}
    assert phrases.paths(docs_frame(spark, [(1, None, "en")])).count() == 0
    assert phrases.mine(docs_frame(spark, [], 1)).count() == 0


# ---- language model -----------------------------------------------------------------

def test_gradients_equal_differences():
    rng = np.random.RandomState(0)
    counts = np.sort(rng.randint(1, 50, 12))[::-1].astype(float)
    m = gru.new_model(counts, hidden=4, classes=3)
    m = {k: v.astype(np.float64) if k in gru.TRAINED else v for k, v in m.items()}
    x, first = rng.randint(0, 12, 20), np.array([0, 8, 8, 20])
    loss = lambda: -gru.score(m, x, first, 0).sum()
    grads = {}
    laid = gru.Laid(x, first, 0, 2)
    (place, some, before, clear), = laid.windows(100)
    states, _ = gru._steps(m, before, clear, np.zeros((laid.wide, 4)))
    gru._predict(m, states[some], x[place[some]], grads)
    for k in ("c", "bc", "w", "bw"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, eps = m[k][at], 1e-3
        m[k][at] = old + eps
        up = loss()
        m[k][at] = old - eps
        down = loss()
        m[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grads[k][at], rel=2e-2, abs=1e-3)


def test_training_learns_an_order():
    x = np.tile([1, 2, 3, 0], 400)
    first = np.arange(0, len(x) + 1, 40)
    m = gru.new_model(np.array([400.0, 400, 400, 400]), hidden=8, classes=2)
    before = gru.score(m, x, first, 0).mean()
    memory = None
    for _ in range(80):
        memory = gru.train(m, x, first, 0, memory)
    assert before == pytest.approx(math.log(0.25), abs=0.05) and gru.score(m, x, first, 0).mean() > -0.3


def test_scores_do_not_depend_on_lanes_or_windows(monkeypatch):
    rng = np.random.RandomState(1)
    lens = np.array([0, 1, 500, 3, 70, 64, 65])
    first = np.concatenate([[0], np.cumsum(lens)])
    x = rng.randint(0, 30, first[-1])
    m = gru.new_model(np.arange(30, 0, -1).astype(float))
    whole = gru.score(m, x, first, 2)
    monkeypatch.setattr(gru, "SCORE_LANES", 2)
    monkeypatch.setattr(gru, "SCORE_WINDOW", 5)
    assert np.allclose(whole, gru.score(m, x, first, 2), atol=1e-4)
    each = np.concatenate([gru.score(m, x[a:b], np.array([0, b - a]), 2) for a, b in zip(first, first[1:])])
    assert np.allclose(whole, each, atol=1e-4)
    # A proper distribution: the probabilities of all symbols after one history add up to one.
    after = [gru.score(m, np.array([5, 7, s]), np.array([0, 3]), 2)[2] for s in range(30)]
    assert np.exp(after).sum() == pytest.approx(1, abs=1e-4)


def brute_base(rows):
    tokens = [WORD.findall(lower(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for (i, _), h, ts in zip(rows, held, tokens):
        if i is not None and not h:
            c.update(ts)
    size, distinct = sum(c.values()), len(c)
    return [(i, h, len(ts), sum(t in c for t in ts), size, round(sum(math.log10((c[t] + 1) / (size + distinct + 1)) for t in ts), 6))
            for (i, _), h, ts in zip(rows, held, tokens)]


@pytest.mark.parametrize("common", [65_536, 12, 0])
def test_base_scores_equal_brute_force(spark, common):
    rows = EDGE + [(20 + i, f"the {i} of w{i % 7} new words unseen{i}") for i in range(60)]
    docs = docs_frame(spark, [(i, t, "en") for i, t in rows])
    c = lm.counted(docs, common=common, symbols=10)
    got = lm.scores(docs, c, gru.new_model(c["symbol_counts"])).collect()
    assert key([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == key(brute_base(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    c = lm.counted(docs)
    own = lm.scores(docs, c, lm.train(docs, c, share=4)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert own.s / own.n > own.b / own.n + 0.02


def test_training_uses_every_training_document(spark):
    docs = docs_frame(spark, [(i, f"w{i} " * 9, "en") for i in range(80)])
    c = lm.counted(docs)
    moved = np.abs(lm.train(docs, c)["x"] - gru.new_model(c["symbol_counts"])["x"]).max(axis=1)
    own = {w: moved[p] for w, p in zip(c["common"].to_pylist(), c["place"])}
    assert set(own) == {f"w{i}" for i in range(80) if zlib.crc32(str(i).encode()) % 7 != 2}
    assert min(own.values()) > 1e-4


def test_no_training_documents(spark):
    rows = [(None, "a b"), (None, None)]
    got = lm.score_documents(docs_frame(spark, [(i, t, None) for i, t in rows])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out) for r in got) == [(1, 0, 0, 0.0, False), (3, 0, 0, 0.0, False)]
    assert lm.score_documents(docs_frame(spark, [], 1)).count() == 0


# ---- resampling ----------------------------------------------------------------------

def brute_resample(rows, target, longest, buckets, share, least):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(ws), [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    own, s, t = [features(x) for _, x in rows], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, own):
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = Counter()
    for r, x in enumerate(pool[:len(pool) * share[0] // share[1]], 1):
        drawn[(x, r)] += 1
    ranks = {}
    for (x, r), _ in drawn.items():
        ranks.setdefault(x, []).append(r)
    return [(*x, ranks[x].pop(0) if ranks.get(x) else None) for x in out]


@pytest.mark.parametrize("longest, buckets, share", [(1, 10_000, (10, 100)), (3, 64, (60, 100)), (2, 997, (100, 100))])
def test_resampling_equals_brute_force(spark, longest, buckets, share):
    r = random.Random(5)
    rows = EDGE + [(100 + i, " ".join(r.choice(["Paris", "été", "a1", "zz", "x" * 70, "42", "-", "the"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, "null id " * 30), (500, LONG[:3000]), (500, LONG[:3000]), (501, "")]
    target = ["a1 zz été the", None, "", "paris " * 10]
    got = resample.resample(docs_frame(spark, [(i, t, "en") for i, t in rows]), spark.createDataFrame([(t, 1) for t in target], "text string, n int"),
                            longest=longest, buckets=buckets, share=share)
    want = brute_resample(rows, target, longest, buckets, share, 20)
    assert key((x.doc_id, x.n_words, x.n_features, x.weight, x.score, x.rank) for x in got.collect()) == key(want)


def test_the_bracket_is_widened_until_counts_prove_it(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id as doc_id", "20L as n_words", "1L as n_features", "0L as weight", "id % 50 as score")
    monkeypatch.setattr(resample, "HALF_WIDTH", 1e-9)
    monkeypatch.setattr(resample, "ACCURACY", 3)
    got = resample.draw(stored(rows, "rows"), (333, 1000)).where("rank is not null").orderBy("rank").collect()
    want = sorted(range(4000), key=lambda i: (-(i % 50), i))[:1332]
    assert [x.doc_id for x in got] == want and [x.rank for x in got] == list(range(1, 1333))


def test_empty_tables(spark):
    none = empty(spark)
    assert resample.resample(none, none).count() == 0
    got = resample.resample(docs_frame(spark, [(1, "a " * 30, "en"), (2, None, None)]), none, share=(1, 1)).collect()
    assert sorted((x.doc_id, x.rank) for x in got) == [(1, 1), (2, None)]
