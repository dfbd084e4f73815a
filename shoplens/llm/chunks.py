"""Substring deduplication by content-defined chunks (operator 5).

*Chunking.* A gear hash (a table value per byte, shifted in; ``GEAR_BYTES`` bytes long) is
taken at every place of a text. A chunk ends where the hash is greater than at the
``HORIZON`` places before and not less than at the ``HORIZON`` after: a rule that looks at
some dozens of bytes only, so an insertion moves the boundaries near it and no
others, and equal passages are cut alike wherever they stand. Boundaries fall on
whole code points. There is no least or greatest length to be cut at: chunks have
over ``HORIZON`` bytes (but a text's first and last) and twice that on average; a
stretch without any boundary, such as one repeated byte, is one chunk.

*Deduplication.* Chunks meet by a 128-bit digest (XXH3); of equal ones the first, by
(doc_id, place), stays and later ones are repeats. Repeats that adjoin in a text
form a run; runs of ``run_bytes`` or more are removed. Shorter ones (a stock phrase,
a common line) say too little and stay by default (``RUN_BYTES``); with ``run_bytes=1`` every
repeated chunk goes. Equal digests are taken as equal chunks.

*Scale.* Only (digest, id, place) is shuffled, not text. A first pass counts digests,
combined before the shuffle, and keeps those seen twice or more with their first
place; a second meets the chunks with it by an equi-join, of which adaptive execution
splits a hot digest. The removals are then joined to the texts by document.

A document is keyed by its id and a hash of its text, so rows that repeat an id are
told apart by text; rows equal in both are the same document, and each copy of the
row gets the same result (what is kept is kept in each). A NULL id counts as the
least long and so comes first. NULL text counts as empty. Further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import BYTE_CODES, binary, spread, text_slices
from shoplens.llm.store import stored

GEAR_BYTES = 16
HORIZON = 32
RUN_BYTES = 64
_KEY = ("id_key", "text_hash")


def gear(data: np.ndarray) -> np.ndarray:
    """At each place the hash of the ``GEAR_BYTES`` bytes that end there: each step shifts by 64 / ``GEAR_BYTES`` bits."""
    h = BYTE_CODES[data]
    step, width = 64 // GEAR_BYTES, 1
    while width < GEAR_BYTES:                          # twice as many bytes at a time
        older = np.zeros_like(h)
        older[width:] = h[:-width] if width < len(h) else h[:0]
        h = h + (older << np.uint64(step * width))
        width *= 2
    return h


def _greatest_before(h: np.ndarray, n: int) -> np.ndarray:
    """The greatest of the n values before each place (0 where there is none)."""
    out, width = h, 1
    pad = lambda x, k: np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[:max(0, len(x) - k)]])
    while 2 * width <= n:
        out = np.maximum(out, pad(out, width))
        width *= 2
    return pad(np.maximum(out, pad(out, n - width)), 1)


def boundaries(data: np.ndarray, off: np.ndarray, horizon: int = HORIZON) -> np.ndarray:
    """Ends of all chunks of a slice of texts, ascending; text ends are among them.

    Each text is cut as if it stood alone: between texts lie gaps as long as what
    a decision looks at, filled with the least hash.
    """
    docs, gap = len(off) - 1, horizon + 1
    lens = np.diff(off)
    at = spread(off[:-1] + gap * np.arange(1, docs + 1), lens)
    wide = np.zeros(len(data) + gap * (docs + 1), np.uint64)
    h = gear(data)
    new = np.zeros(len(data), np.int64)                # bytes since the text began, up to the gear's reach
    new = np.arange(len(data)) - np.repeat(off[:-1], lens)
    h[new < GEAR_BYTES - 1] = 0                        # no full window yet
    last = np.ones(len(data), bool)                    # the last byte of a code point
    last[:-1] = data[1:] & 0xC0 != 0x80
    h[~last] = 0
    wide[at] = h
    before = _greatest_before(wide, horizon)
    after = _greatest_before(wide[::-1], horizon)[::-1]
    cut = (wide > before) & (wide >= after) & (wide > 0)
    ends = np.flatnonzero(cut[at]) + 1
    return np.union1d(ends, off[1:][lens > 0])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, data, off in text_slices(batches):
        ends = boundaries(data, off)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        doc = np.searchsorted(off, starts, "right") - 1
        raw, digest = data.tobytes(), xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([rb.column(k).take(pa.array(doc)) for k in _KEY]
                                         + [pa.array((starts - off[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)),
                                            pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(np.ascontiguousarray(hashes[:, 1]))],
                                         [*_KEY, "start", "size", "d1", "d2"])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text ('' for NULL), and what tells documents apart: the id (the least long for NULL) and a hash of the text."""
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1 << 63)).alias("id_key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def chunks(own: DataFrame) -> DataFrame:
    """(id_key, text_hash, start, size, d1, d2): the chunks of each text."""
    return own.mapInArrow(_chunk_rows, "id_key long, text_hash long, start int, size int, d1 long, d2 long")


def repeats(own: DataFrame) -> DataFrame:
    """(id_key, text_hash, removed): per document the (start, size) of chunks seen before, as an array."""
    found = chunks(own)
    place = F.struct(*_KEY, "start")
    seen = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # Stored, so that both sides of the join are plain shuffles: adaptive execution can then split a hot digest's rows.
    seen = stored(seen, "seen-digests")
    again = found.join(seen, ["d1", "d2"]).where(place > F.col("first"))
    return again.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("removed"))


def _runs(spans) -> list[tuple[int, int]]:
    """Spans (start, size) in order, those that adjoin as one (start, end)."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and out[-1][1] == s["start"]:
            out[-1] = (out[-1][0], s["start"] + s["size"])
        else:
            out.append((s["start"], s["start"] + s["size"]))
    return out


def _cut(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    for rb, data, off in text_slices(batches):
        removed = rb.column("removed")
        keep = np.ones(len(data), bool)
        n_removed, n_spans = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        for i, spans in enumerate(removed.to_pylist()):
            for a, b in _runs(spans or ()):
                if b - a >= run_bytes:
                    keep[off[i] + a:off[i] + b] = False
                    n_removed[i] += b - a
                    n_spans[i] += 1
        ends = np.concatenate([[0], np.cumsum(keep)])[off[1:]]
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(np.diff(off)), pa.array(n_removed), pa.array(n_spans), binary(data[keep], ends, pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text without the runs of ``run_bytes`` or more of chunks that stand earlier in the table."""
    own = keyed(docs, id_col, text_col)
    return (own.join(repeats(own), list(_KEY), "left").select("doc_id", "text", "removed")
            .mapInArrow(lambda batches: _cut(batches, run_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string"))


def digests(kept: DataFrame) -> DataFrame:
    """The per-document columns of query op5."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
