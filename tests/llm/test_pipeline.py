import hashlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from shoplens.llm import decontam, pii, registry, rule_ensemble
from shoplens.llm.store import stored
from tests.llm.util import EDGE, PASSAGE, base_spans, empty, frame, key, near_duplicates

D = "/root/testdata/sf0.001"


# ---- benchmark search ------------------------------------------------------------------

def _shingles(words, n):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def _contained(rows, items):
    lower = lambda t: (t or "").encode().lower().split()
    out = []
    for i, t in rows:
        for j, u in sorted(set(items), key=str):
            w = lower(u)
            n = min(5, len(w))
            if n:
                want = _shingles(w, n)
                shared = len(want & _shingles(lower(t), n))
                if 5 * shared >= 4 * len(want):
                    out.append((i, j, len(want), shared, shared / len(want)))
    return out


ITEMS = [(1, PASSAGE), (2, PASSAGE.upper().replace(" ", "\n")), (3, "two words"), (3, "two words"), (4, None), (5, ""), (6, "one"),
         (7, " ".join(PASSAGE.split()[:20])), (8, " ".join(PASSAGE.split()[:18]) + " quite other words follow"), (9, "nowhere at all is this found")]


@pytest.mark.parametrize("block", [5000, 2])
def test_containment_equals_brute_force(spark, block):
    rows = EDGE + [(50, "x " + " ".join(PASSAGE.split()[:30]) + " y"), (51, " ".join(PASSAGE.split()[10:]))]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, source int")
    assert key(decontam.contained_items(frame(spark, rows), items, block=block).collect()) == key(_contained(rows, ITEMS))
    assert decontam.contained_items(frame(spark, rows), items.limit(0)).count() == 0
    assert decontam.contained_items(empty(spark), items).count() == 0
    kept = decontam.decontaminate(frame(spark, rows), items, block=block)
    # Every row is judged by its own text, also without an id.
    assert key(kept.select("doc_id", "text").collect()) == key((i, t) for i, t in rows if not _contained([(i, t)], ITEMS))
    assert kept.where("doc_id is null").count() == 0
    assert kept.columns == frame(spark, rows).columns


def test_decontamination_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["op9_decontamination"]).fetchall()
    got = registry.op9_decontamination(spark, D).collect()
    assert key(got) == key(want)


# ---- pipeline ----------------------------------------------------------------------------

def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = rule_ensemble.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    good = {r.doc_id for r in rule_ensemble.classify(docs, model).collect() if r.score >= 0.3}
    kept = stored(cp.keep_good(spark, docs, D), "t")
    assert kept.columns == columns and {r.doc_id: r for r in kept.collect()} == {i: rows[i] for i in good}

    texts = [(i, rows[i].text) for i in sorted(good)]
    first = {c for _, _, c in near_duplicates(texts)}
    kept = stored(cp.drop_near_duplicates(spark, kept, D), "t")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == first

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {r[0] for r in _contained([t for t in texts if t[0] in first], items)}
    kept = stored(cp.drop_contaminated(spark, kept, D), "t")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == first - bad

    left = {r.doc_id: r.text for r in kept.collect()}
    spans = {r.doc_id: r.spans for r in pii.find(kept, pii.fit(kept)).collect()}
    kept = stored(cp.redact_personal_data(spark, kept, D), "t")
    clean = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(clean) == first - bad
    for i, t in left.items():
        want, at = "", 0
        for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)):
            if a >= at:
                want += t[at:a] + f"<{k}>"
            at = max(at, b)
        assert clean[i].text == want + t[at:] and clean[i].n_chars == len(clean[i].text)
        assert not base_spans(clean[i].text)

    lib, out = Tokenizer.from_file(registry.BYTE_BPE), []
    for i, r in clean.items():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert key(cp.encode_tokens(spark, kept, D).collect()) == key(out)
    assert key(cp.run(spark, D).collect()) == key(out)


def test_stages_take_any_rows(spark):
    docs = frame(spark, EDGE)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        assert stage(spark, empty(spark), D).count() == 0, name
    one = cp.drop_near_duplicates(spark, docs, D).select("doc_id", "text").collect()
    assert sum(r.text == PASSAGE for r in one) == 2 and {r.doc_id for r in one if r.text == PASSAGE} == {9, None}
    assert sum(r.doc_id == 8 for r in one) == 1             # two equal rows with one id


def test_stages_keep_further_columns_as_they_are(spark):
    docs = frame(spark, [(i, t) for i, t in EDGE if i is not None])
    before = {(r.doc_id, r.text): tuple(r)[2:-1] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, D).collect()
        assert out and all(tuple(r)[2:-1] == next(iter(before.values())) for r in out), name


def test_registry_and_stage_names():
    assert len(cp.STAGES) == 5 and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registry.queries()}
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_returns_all_documents(spark, name):
    n = spark.read.parquet(f"{D}/documents.parquet").count()
    got = entry.queries()[name](spark, D)
    if name not in ("op9_decontamination", "op11_phrases"):
        assert got.count() == n and got.select("doc_id").distinct().count() == n
