import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import langid, pii, quality_rules, rule_ensemble
from shoplens.llm.arrow import span_hashes
from shoplens.llm.stats import STATISTICS, Slice, repeated_words
from tests.llm.util import EDGE, KINDS, base_counts, base_spans, empty, frame, key

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")


def _held(i, folds, at):
    return i is not None and zlib.crc32(str(i).encode()) % folds == at


# ---- personal data ---------------------------------------------------------------

def _fuzz(n):
    r = random.Random(3)
    parts = list("124075") * 3 + [" ", "-", ".", "@", "+", "(", ")", "a", "_", "%", "é", "😀", "\n", "x.com", "@b.c", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "+1 (555) 555-1234"]
    return [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(n)]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = EDGE + _fuzz(1500) + [(1, "1" * 50_000), (2, "a@b.c " * 1500), (3, "12 " * 9000), (4, "a@b.c_d@e.f"), (5, "+" + "1-" * 20_000), (6, "1.2.3.4.5.6.7.8")]
    want = []
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *[sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(text.encode()).hexdigest(), text))
    assert key(pii.find(frame(spark, rows), None).collect()) == key(want)
    assert pii.find(empty(spark), pii.fit(empty(spark))).count() == 0


def test_learned_spans_are_added_and_redacted(spark):
    r = random.Random(4)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = [(i, f"please call +1 ({num(3)}) 555-{num(4)} now") for i in range(300)]
    rows += [(1000 + i, f"order {num(5)} {num(4)} was sent") for i in range(300)]
    rows += [(2000, "please call 1 (212) 555-0199 now"), (2001, "mail a@b.org and 1.2.3.4 end")]
    docs = frame(spark, rows)
    fitted = pii.fit(docs)
    assert set(fitted[1]) >= {3}
    got = {x.doc_id: x.spans for x in pii.find(docs, fitted).where("doc_id >= 1000").collect()}
    assert got[2000] == "phone:12:28" and got[2001] == "email:5:12,ip:17:24"
    assert not any(got[1000 + i] for i in range(300))
    red = {x.doc_id: x.text for x in pii.redact(docs, fitted).where("doc_id >= 2000").collect()}
    assert red == {2000: "please call <phone> now", 2001: "mail <email> and <ip> end"}
    assert pii.redact(frame(spark, EDGE), fitted).columns == frame(spark, EDGE).columns


def test_pii_runs_no_python_on_executors(spark):
    docs = frame(spark, EDGE)
    for plan in (pii.find(docs, None), pii.examples(docs)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", text)


# ---- quality rules -----------------------------------------------------------------

def test_character_grams_equal_plain_python():
    texts = ["", "é", "日本語", "ab", "naïve café 😀😀x", "aaaa", "x" * 50, "", "señor"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = {kind: (slots, first) for kind, slots, first in quality_rules._grams(Slice(np.frombuffer(b"".join(raw), np.uint8), off))}
    for kind, k in (("tri", 3), ("four", 4)):
        slots, first = got[kind]
        for i, t in enumerate(texts):
            want = []
            for j in range(len(t) - k + 1):
                code = 0
                for c in t[j:j + k]:
                    code = code * 0x100000001B3 + ord(c)
                want.append(((code + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
            assert slots[first[i]:first[i + 1]].tolist() == want, (kind, t)


def test_base_counts_equal_brute_force(spark, tables):
    docs, _ = tables
    rows = EDGE + [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 1").collect()]
    got = quality_rules.judge(frame(spark, rows), None).select("doc_id", *quality_rules.COLUMNS, "base_failed", "kept").collect()
    want = []
    for i, t in rows:
        c = base_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((i, *c, failed, not failed))
    assert key(got) == key(want)


def test_windows_with_colliding_hashes_are_told_apart(monkeypatch):
    from shoplens.llm import stats

    monkeypatch.setattr(stats, "_FACTORS", [np.uint64(0)] * 8)
    words = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 20], np.uint64)
    assert repeated_words(words, np.array([0, 18])).tolist() == [16]


def test_quality_model_on_held_out_labels(tables):
    docs, labels = tables
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in quality_rules.judge(docs, model).collect()}
    held = [r for r in labels.collect() if _held(r.doc_id, 5, 0)]
    good = [got[r.doc_id] for r in held if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert sum(r.kept for r in bad) <= 0.25 * len(bad)
    assert all(0 <= r.probability <= 1 for r in got.values())


def test_models_without_labels(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    assert quality_rules.train(docs, none) is None
    assert rule_ensemble.train(docs, none) == ([], 30.0)
    only = rule_ensemble.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in rule_ensemble.classify(frame(spark, EDGE), only).collect()} == {1}
    assert quality_rules.judge(empty(spark), None).count() == 0 and rule_ensemble.classify(empty(spark), only).count() == 0


# ---- rule ensemble -------------------------------------------------------------------

def test_compiled_rules_equal_plain_evaluation(spark, tables):
    docs, labels = tables
    rules, intercept = rule_ensemble.train(docs, labels)
    assert 0 < len(rules) < 100
    rows = EDGE + [(r.doc_id, r.text) for r in docs.where("doc_id % 7 = 1").collect()]
    got = rule_ensemble.classify(frame(spark, rows), (rules, intercept)).collect()
    want = []
    for i, t in rows:
        b = np.frombuffer((t or "").encode(), np.uint8)
        s = Slice(b, np.array([0, len(b)])).statistics()
        x = [float(s[c][0]) for c in STATISTICS]
        z = intercept
        for rule, w in rules:
            if all((x[f] > at) == above for f, above, at in rule):
                z += w
        p = 1 / (1 + math.exp(-z))
        want.append((i, _held(i, 5, 0), p, int(p >= 0.3)))
    for a, b in zip(key((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in got), key((i, h, round(p, 9), k) for i, h, p, k in want)):
        assert a == b


def test_rule_ensemble_on_held_out_labels(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in rule_ensemble.classify(docs, rule_ensemble.train(docs, labels)).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if _held(r.doc_id, 5, 0)]
    assert all(g.held_out for g, _ in held)
    assert sum(g.predicted == q for g, q in held) >= 0.97 * len(held)


def test_statistics_of_known_texts():
    texts = ["AB cd, cd cd!", "", "a#b | c\na#b | c"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s = Slice(data, off).statistics()
    assert s["upper_share"].tolist() == [2 / 13, 0, 0]
    assert s["again_share"].tolist() == [0, 0, 0] and s["distinct_share"].tolist() == [1, 0, 0.5]
    assert s["dup_line_share"].tolist() == [0, 0, 0.5] and s["symbol_share"][2] == 4 / 15


def test_span_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abc xabc abd", np.uint8)
    h = span_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] != h[2]


# ---- language --------------------------------------------------------------------------

def _best(scores, switch):
    v = scores[0].copy()
    for s in scores[1:]:
        v = np.maximum(v, v.max() - switch) + s
    return v.max()


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_path_has_the_best_value(chunk):
    r = np.random.RandomState(chunk)
    lens = r.randint(0, 150, 9)
    first = np.concatenate([[0], np.cumsum(lens)])
    scores = -np.abs(r.randn(first[-1], 4) * 4)
    path = langid.best_path(scores, first, 3.0, chunk)
    for a, b in zip(first, first[1:]):
        if b > a:
            own = scores[np.arange(a, b), path[a:b]].sum() - 3.0 * (path[a + 1:b] != path[a:b - 1]).sum()
            assert own == pytest.approx(_best(scores[a:b], 3.0))


def test_language_accuracy_and_spans(spark, tables):
    docs, _ = tables
    model = langid.train(docs)
    truth = {r.doc_id: r for r in docs.collect()}
    got = langid.identify(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == _held(r.doc_id, 4, 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    en, de = (next(r.text[:300] for r in truth.values() if r.lang == lang and len(r.text) > 400 and "$" not in r.text) for lang in ("en", "de"))
    mixed = langid.identify(frame(spark, [(1, f"{en} {de} {en}"), (2, "123 !!"), (3, None)]), model, spans=True).collect()
    by = {r.doc_id: r for r in mixed}
    assert [s.lang for s in by[1].spans] == ["en", "de", "en"]
    assert abs(by[1].spans[1].start - 301) < 25 and abs(by[1].spans[1].end - 601) < 25
    assert [(by[i].lang_pred, by[i].score, by[i].spans) for i in (2, 3)] == [("und", 0.0, [])] * 2


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(40)] + [(100 + i, "hello world how are you", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, [(1, "неизвестное слово"), (2, "unseen things"), (3, "漢字")]), langid.train(docs)).collect()}
    assert got[1] == "ru" and got[2] == "en" and got[3] in ("en", "ru")


def test_language_without_training_rows(spark):
    rows = langid.identify(frame(spark, EDGE), langid.train(frame(spark, EDGE).withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in rows} == {"und"} and len(rows) == len(EDGE)
    assert langid.identify(empty(spark), None).count() == 0


def test_pii_fit_on_examples_that_do_not_differ(spark):
    same = frame(spark, [(1, "paid 4111111111111111 ok"), (2, "paid 4111111111111112 ok")])     # one passes Luhn, one fails
    fitted = pii.fit(same)
    assert fitted[1] == {}
    assert {r.doc_id: r.spans for r in pii.find(same, fitted).collect()} == {1: "card:5:21", 2: ""}


def test_training_samples_are_bounded_and_stable(spark):
    from shoplens.llm.labelled import training_rows

    docs = frame(spark, [(i, f"text {i}") for i in range(3000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, text int")
    rows = training_rows(docs, labels, "quality", 5, 0, 400).collect()
    assert 300 < len(rows) < 500 and not any(_held(r.doc_id, 5, 0) for r in rows)
    assert key(rows) == key(training_rows(docs.repartition(7), labels, "quality", 5, 0, 400).collect())
    assert len(training_rows(docs, labels, "quality", 5, 0, 10_000).collect()) == sum(not _held(i, 5, 0) for i in range(3000))
