"""Benchmark decontamination: size-partitioned MinHash containment search (operator 9).

A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``SHINGLE`` words
(an item of fewer words has one shingle, all its words). An item is found in a
document if the document holds ``CONTAIN`` (4 of 5) or more of the item's distinct
shingles, wherever in the document they stand.

*Partitions.* Items are partitioned by the size m of their shingle sets, by powers of
two. A partition has one sketch length k: the k least shingle hashes of an item
(bottom-k MinHash) are its sketch. A document that holds at least ceil(0.8 m) of
the m shingles misses floor(0.2 m) at most, so it meets at least k - floor(0.2 m) of the
sketch; k is the partition's largest floor(0.2 m) plus ``EXTRA``. The search is
therefore complete: no item above the threshold is missed, whatever the lengths.

*Search.* Tasks hash all shingles of their documents, look them up in the sketches,
and verify documents that meet enough of a sketch by their exact shingle sets.
No shuffle of the documents.

*Bound of the broadcast.* Items are processed in blocks of about ``BLOCK`` items, as
many blocks as the benchmark needs, one pass over the documents each; a block's
shingles are all that the driver and the tasks hold.

NULL texts have no words; items without words are found nowhere. Repeated items
(equal id and text) count once; repeated documents give repeated rows. Further
columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import binary, lower_ascii, mix64, span_hashes, text_slices, word_bounds
from shoplens.llm.store import unwrapped, wrapped

SHINGLE = 5
#: Containment as a fraction (numerator, denominator).
CONTAIN = (4, 5)
EXTRA = 2
BLOCK = 5_000
_FACTORS = [np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1) for k in range(64)]
_FILTER_BITS = 22


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    m = max(0, len(words) - n + 1)
    h = np.full(m, np.uint64(n))
    for k in range(n):
        h += words[k:k + m] * _FACTORS[k]
    return mix64(h)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _sets(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def build_sketches(items: list[tuple[int, str | None]], shingle: int = SHINGLE, contain: tuple[int, int] = CONTAIN) -> dict | None:
    """Sketch hashes with the items they stand for, by shingle length; None if no item has a word."""
    num, den = contain
    sets, lengths = {}, {}
    for at, (_, text) in enumerate(items):
        words = _words(text)
        if words:
            lengths[at] = min(shingle, len(words))
            sets[at] = sorted(_sets(words, lengths[at]))
    if not sets:
        return None
    spare = {at: len(s) - -(-num * len(s) // den) for at, s in sets.items()}
    most: dict[int, int] = {}
    for at, s in sets.items():
        part = len(s).bit_length()
        most[part] = max(most.get(part, 0), spare[at])
    pairs: dict[int, list[tuple[int, int]]] = {}
    need = {}
    for at, s in sets.items():
        flat, ends = b"".join(w for t in s for w in t), np.cumsum([len(w) for t in s for w in t])
        data = np.frombuffer(flat, np.uint8)
        h = _shingles(span_hashes(data, np.concatenate([[0], ends[:-1]]), ends), lengths[at])[::lengths[at]]
        k = min(len(s), most[len(s).bit_length()] + EXTRA)
        need[at] = k - spare[at]
        pairs.setdefault(lengths[at], []).extend((int(x), at) for x in np.sort(h)[:k])
    tables = {}
    for n, p in pairs.items():
        p.sort()
        h = np.array([x for x, _ in p], np.uint64)
        hits = np.zeros(1 << _FILTER_BITS, bool)
        hits[h >> np.uint64(64 - _FILTER_BITS)] = True
        tables[n] = (h, np.array([a for _, a in p], np.int64), np.flatnonzero(hits))
    return {"ids": [i for i, _ in items], "sets": sets, "lengths": lengths, "need": need, "tables": tables, "contain": contain}


def _find(block: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = block["contain"]
    filters = {}
    for n, (_, _, on) in block["tables"].items():
        filters[n] = np.zeros(1 << _FILTER_BITS, bool)
        filters[n][on] = True
    need = np.zeros(len(block["ids"]), np.int64)
    need[list(block["need"])] = list(block["need"].values())
    for rb, data, off in text_slices(batches):
        data = lower_ascii(data)
        starts, ends, first = word_bounds(data, off)
        words = span_hashes(data, starts, ends)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        out: list[tuple[int, int, int, int]] = []
        for n, (hashes, owner, _) in block["tables"].items():
            h = _shingles(words, n)
            at = np.flatnonzero(filters[n][h >> np.uint64(64 - _FILTER_BITS)])
            at = at[doc[at] == doc[at + n - 1]]
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            # A repeated shingle of a document counts once.
            meets = {(int(d), int(owner[j]), int(hashes[j])) for d, a, c in zip(doc[at], lo, count) for j in range(a, a + c)}
            tally: dict[tuple[int, int], int] = {}
            for d, item, _ in meets:
                tally[d, item] = tally.get((d, item), 0) + 1
            held: dict[int, set] = {}
            for (d, item), k in sorted(tally.items()):
                if k >= need[item]:
                    if d not in held:
                        held = {d: _sets(data[off[d]:off[d + 1]].tobytes().split(), n)}
                    shared = sum(s in held[d] for s in block["sets"][item])
                    if den * shared >= num * len(block["sets"][item]):
                        out.append((d, item, len(block["sets"][item]), shared))
        if out:
            d, item, m, shared = (np.array(x, np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").take(pa.array(d)), pa.array([block["ids"][i] for i in item], pa.int64()),
                                              pa.array(m), pa.array(shared), pa.array(shared / m)],
                                             ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])


SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text", shingle: int = SHINGLE, contain: tuple[int, int] = CONTAIN, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every item found in a document."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for sketches in _blocks(items, item_id, item_text, shingle, contain, block):
        shared = spark.sparkContext.broadcast(sketches)
        found.append(own.mapInArrow(lambda batches, s=shared: _find(s.value, batches), SCHEMA))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], SCHEMA)


def _blocks(items: DataFrame, item_id: str, item_text: str, shingle: int, contain: tuple[int, int], block: int) -> Iterator[dict]:
    """The sketches of all items, a block of about ``block`` items at a time."""
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    blocks = max(1, -(-tests.count() // block))
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else tests
        sketches = build_sketches(sorted((tuple(r) for r in part.collect()), key=str), shingle, contain)
        if sketches:
            yield sketches


def _without(block: dict, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows whose text, a field of ``row``, holds no item of the block; a row is named by its place, so ids don't matter."""
    for rb, data, off in text_slices(batches, text=text_col, within="row"):
        probe = pa.RecordBatch.from_arrays([pa.array(np.arange(rb.num_rows)), binary(data, off[1:], pa.string())], ["doc_id", "text"])
        hit = np.zeros(rb.num_rows, bool)
        for found in _find(block, iter([probe])):
            hit[found.column("doc_id").to_numpy()] = True
        yield rb.filter(pa.array(~hit))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  shingle: int = SHINGLE, contain: tuple[int, int] = CONTAIN, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, in whose text no item is found.

    Rows are judged one by one where they are read: nothing is shuffled, and a NULL or repeated id changes nothing.
    """
    left = wrapped(docs)
    schema = left.schema
    for sketches in _blocks(items, item_id, item_text, shingle, contain, block):
        shared = docs.sparkSession.sparkContext.broadcast(sketches)
        left = left.mapInArrow(lambda batches, s=shared: _without(s.value, batches, text_col), schema)
    return unwrapped(left, docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(5, len(w)) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
bm AS (SELECT item_id, count(*) AS m FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n))
SELECT doc_id, item_id, any_value(m) AS n_shingles, count(*) AS n_shared, count(*) / any_value(m)::DOUBLE AS containment
FROM ds JOIN bs USING (n, s) JOIN bm USING (item_id)
GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(m)
"""
