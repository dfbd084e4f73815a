"""Language-model scoring of whole documents (operator 12).

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, then one end. *Counts*: all
tokens of the training documents (id outside the held-out fold), exact, in a stored vocabulary
that grows with the corpus. *Base score*: log10 probabilities of the counts, smoothed by one.
*Model*: a gated recurrent network (``gru``) over the ``SYMBOLS`` most frequent words, the end
and one symbol for the rest, with a class-factored softmax; a rest word's probability is that of
the symbol times its smoothed count among the rest, so the model is a distribution over the same
open set of words as the base. Its state runs through a whole document, however long.

*Training.* Every token of every training document, once, in ``ROUNDS`` parts by a hash of the id:
every task trains a copy of the weights on its documents of the part by truncated backpropagation, and the
copies are averaged by their numbers of tokens, block by block over the cluster, before the next round. Each
round reads the table again instead of storing its texts. The weights depend on how the table is partitioned.

*Scoring.* One pass over the texts. The ``COMMON`` most frequent words, with counts, are broadcast (a
bounded table); the words beyond them leave the pass as (row, word, times) and meet the
vocabulary in an equi-join, whose rows adaptive execution can split; their sums come back by row
number, so repeated ids and copies stay apart. The pass is a written table: a row's number and its
words come from one committed task.

Defined results: NULL and empty texts are one end token; a NULL id is neither held out nor learned from;
further columns are ignored; without training documents every token has probability 1 by the base
rule and the untrained model is used. A task holds its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm import gru
from shoplens.llm.arrow import binary, lower_ascii, spread, text_slices, word_bounds
from shoplens.llm.labelled import fold
from shoplens.llm.store import stored

FOLDS, HELD_OUT = 7, 2
COMMON = 65_536
SYMBOLS = 1_000
ROUNDS = 3
SLICE = 8 << 20
BLOCK = 1 << 13


def _words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice as a string array, and each text's first word."""
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, off)
    lens = ends - starts
    return binary(low[spread(starts, lens)], np.cumsum(lens), pa.string()), first


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _learned(own: DataFrame) -> DataFrame:
    return own.where(fold("doc_id", FOLDS) != HELD_OUT)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the training documents, not stored."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in text_slices(batches, SLICE):
            got = _words(data, off)[0].value_counts()
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    return _learned(_own(docs, id_col, text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, symbols: int = SYMBOLS) -> dict:
    """The stored vocabulary and what tasks need of it: sums, and the most frequent words with their counts."""
    words = stored(vocabulary(docs, id_col, text_col), "lm-words")
    ends = _learned(_own(docs, id_col, text_col)).count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(16 * F.log2("n"))
    left, lowest = common, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        lowest = r.level
    top = [] if lowest is None else sorted(((r.n, r.word) for r in words.where(level >= lowest).collect()), key=lambda x: (-x[0], x[1]))
    m = min(symbols, len(top))
    n = np.array([x[0] for x in top], np.int64)
    sym = np.concatenate([n[:m], [total - n[:m].sum(), ends]])            # words, the rest, the end
    order = np.argsort(-sym, kind="stable")
    place = np.empty(m + 2, np.int64)
    place[order] = np.arange(m + 2)
    return {"words": words, "lowest": lowest, "level": level, "common": pa.array([x[1] for x in top], pa.string()), "n": n, "symbols": m, "place": place,
            "symbol_counts": sym[order].astype(np.float64), "ends": ends, "tokens": int(total) + ends, "distinct": int(distinct) + (ends > 0),
            "rest_size": float(total - n[:m].sum() + distinct - m + 1)}


def _task_table(c: dict) -> dict:
    return {k: c[k] for k in ("common", "n", "symbols", "place", "ends", "tokens", "distinct", "rest_size")}


def _symbols(words: pa.Array, first: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word or -1, symbols with an end after each text, each text's first symbol)."""
    code = pc.index_in(words, value_set=t["common"]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    m, docs = t["symbols"], len(first) - 1
    begin = first + np.arange(docs + 1)
    out = np.full(begin[-1], t["place"][m + 1], np.int32)
    inner = np.ones(begin[-1], bool)
    inner[begin[1:] - 1] = False
    out[inner] = t["place"][np.where((code >= 0) & (code < m), code, m)]
    return code, out, begin


def train(docs: DataFrame, c: dict, id_col: str = "doc_id", text_col: str = "text", share: int = 1, rounds: int = ROUNDS) -> dict:
    """The trained weights: ``rounds`` rounds of training in all tasks and averaging.

    All training documents are used; a ``share`` above 1 asks for one in so many.
    """
    weights = gru.new_model(c["symbol_counts"])
    own = _learned(_own(docs, id_col, text_col))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(share * rounds))
    sc = docs.sparkSession.sparkContext
    sizes = [weights[k].size for k in gru.TRAINED]

    def flat(m: dict) -> np.ndarray:
        return np.concatenate([m[k].ravel() for k in gru.TRAINED])

    for r in range(rounds):
        shared = sc.broadcast((weights, _task_table(c)))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, t = shared.value
            m = {k: v.copy() for k, v in m.items()}
            seen, memory = 0, None
            for _, data, off in text_slices(batches, SLICE):
                words, first = _words(data, off)
                _, symbols, begin = _symbols(words, first, t)
                memory = gru.train(m, symbols, begin, int(t["place"][t["symbols"] + 1]), memory)
                seen += len(symbols)
            if seen:
                w = flat(m)
                at = range(0, len(w), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([float(seen)] * len(at)), pa.array([w[i:i + BLOCK].tobytes() for i in at])], ["block", "seen", "w"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for rb in batches:
                for b, n, w in zip(*(rb.column(k).to_pylist() for k in ("block", "seen", "w"))):
                    x = np.frombuffer(w, np.float32).astype(np.float64) * n
                    held = sums.setdefault(b, [0.0, np.zeros(len(x))])
                    held[0] += n
                    held[1] += x
            for b, (n, x) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n]), pa.array([(x / n).astype(np.float32).tobytes()])], ["block", "seen", "w"])

        schema = "block int, seen double, w binary"
        got = own.where(part == r).select("text").mapInArrow(learn, schema).repartition("block").mapInArrow(average, schema).collect()
        if got:
            w = np.concatenate([np.frombuffer(x.w, np.float32) for x in sorted(got, key=lambda x: x.block)])
            parts = np.split(w, np.cumsum(sizes)[:-1])
            weights = weights | {k: p.reshape(weights[k].shape).copy() for k, p in zip(gru.TRAINED, parts)}
        shared.unpersist()
    return weights


def scores(docs: DataFrame, c: dict, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, _task_table(c)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, t = shared.value
        row = TaskContext.get().partitionId() << 40
        base_of = np.log10(t["n"] + 1.0)
        end_base, rest = np.log10(t["ends"] + 1.0), np.log10(t["rest_size"])
        bottom = np.log10(t["tokens"] + t["distinct"] + 1.0)
        for rb, data, off in text_slices(batches, SLICE):
            words, first = _words(data, off)
            code, symbols, begin = _symbols(words, first, t)
            docs_here = len(first) - 1
            lp = gru.score(m, symbols, begin, int(t["place"][t["symbols"] + 1]))
            model = np.add.reduceat(lp, begin[:-1]) / np.log(10) if docs_here else np.zeros(0)
            doc = np.repeat(np.arange(docs_here), np.diff(first))
            local = np.where(code >= 0, base_of[np.maximum(code, 0)] if len(base_of) else 0.0, 0.0)
            beyond = (code < 0) | (code >= t["symbols"])
            per = lambda x: np.bincount(doc, x, docs_here)
            base = per(local) + end_base - (np.diff(first) + 1) * bottom
            model = model + per(np.where(beyond, local - rest, 0.0))
            known = per((code >= 0).astype(float)).astype(np.int64) + (t["ends"] > 0)
            rows = row + np.arange(docs_here)
            row += docs_here
            none = lambda kind, n=docs_here: pa.nulls(n, kind)
            names = ["row", "doc_id", "n_tokens", "n_known", "base", "model", "word", "m"]
            yield pa.RecordBatch.from_arrays([pa.array(rows), rb.column("doc_id"), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(model),
                                              none(pa.string()), none(pa.int64())], names)
            far = np.flatnonzero(code < 0)
            if len(far):
                got = pa.table({"row": rows[doc[far]], "word": words.take(pa.array(far))}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
                for b in got.to_batches():
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column("row"), none(pa.int64(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.float64(), n), none(pa.float64(), n),
                                                      b.column("word"), b.column("count_all")], names)

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double, word string, m long"
    both = stored(_own(docs, id_col, text_col).mapInArrow(run, schema), "lm-scores")
    far = both.where("word is not null").select("row", "word", "m")
    rare = c["words"] if c["lowest"] is None else c["words"].where(c["level"] < c["lowest"])
    sums = far.join(rare, "word").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("far"), F.sum("m").alias("far_known"))
    out = both.where("word is null").join(sums, "row", "left")
    more = F.coalesce("far", F.lit(0.0))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens",
                      (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(c["tokens"]).cast("long").alias("train_tokens"),
                      (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    c = counted(docs, id_col, text_col)
    return scores(docs, c, train(docs, c, id_col, text_col), id_col, text_col)
