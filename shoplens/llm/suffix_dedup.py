"""Exact removal of repeated 200-byte strings by blockwise sorting of suffix buckets (operator 4).

Every byte covered by a ``LENGTH``-byte string that starts anywhere else, in the same
or another document, is removed; overlaps count and strings are judged on the input.

*Buckets.* Of the ``GRAM``-byte grams of each ``LENGTH``-byte string the one with the least
hash (leftmost on a tie) is the string's *anchor*. Equal strings have equal anchors at
equal offsets, so all occurrences of a string are suffixes of one bucket: those that
hold one anchor gram. Anchors are about 2 / (LENGTH - GRAM + 2) of all positions, and
each position's string belongs to one of them. Buckets with a single occurrence
hold no repeat and end here.

*Contexts.* A row of a bucket is one occurrence of the gram with the bytes of the strings
anchored there. Equal rows are counted before the shuffle, so that of exact copies,
however many, one row moves and their strings are known to repeat.

*Sorting a bucket.* A task sorts one block of whole buckets at a time. Rows are aligned at
their gram. Columns in a difference cover (``COVER`` modulo ``PERIOD``: every residue is a
difference of two of its members) are sampled, and the rank of each row's
``REACH``-byte substring is computed once for each sampled column. The strings
beginning at a column are then sorted by two sample ranks, which span all but a few
bytes, and the bytes before and after: long ties cost one comparison of ranks, and
memory is bounded by the block, whatever the text. Equal neighbours repeat. Ranks
come from hashes that are verified byte by byte.

*Hot buckets.* A gram with over ``HOT`` occurrences is not gathered in a task: its strings
are counted by digest over the whole cluster, combined before the shuffle.

Equal rows are recognised by the gram's 64-bit hash together with a 64-bit hash of
the row. Documents are keyed by id and text hash, as in ``chunks.py``: rows
that repeat both are copies of each other, and so removed. NULL text counts as empty.
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import BYTE_CODES, _P, _PINV, _powers, binary, mix64, spread, text_slices, utf8_view
from shoplens.llm.chunks import keyed
from shoplens.llm.store import stored

LENGTH, GRAM = 200, 50
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
COVER, PERIOD = (0, 1, 3, 9), 13
REACH = 104
BLOCK = 12_000
HOT = 200_000
_KEY = ("id_key", "text_hash")
_PLACE = 21
_SLICE = 1 << 20


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, place, and first and last start of the strings anchored there, in order of place."""
    n = len(data)
    lens = np.diff(off)
    count = np.maximum(lens - LENGTH + 1, 0)
    if not count.any():
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _powers(_P, n), out=prefix[1:])
    h = mix64((prefix[GRAM:] - prefix[:-GRAM]) * _powers(_PINV, n)[:n - GRAM + 1])
    bits = max(_PLACE, n.bit_length())                 # room for any place of the slice
    packed = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= LEFT + 1:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    rest = LEFT + 1 - width
    packed = np.minimum(packed[:len(packed) - rest], packed[rest:])
    starts = spread(off[:-1], count)
    place = (packed[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return h[place[first]], place[first], starts[first], starts[last]


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 16 | (place - first) << 8 | (place - last)


#: Set in the packed anchors of hot buckets.
_HOT_BIT = 1 << 62


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, and the first and last start relative to it (not above 0)."""
    return (x & ~_HOT_BIT) >> 16, -(x >> 8 & 255), -(x & 255)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, data, off in text_slices(batches, _SLICE):
        h, place, first, last = anchors(data, off)
        doc = np.searchsorted(off, place, "right") - 1
        at = off[doc]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[rb.column(k).take(pa.array(doc)) for k in _KEY],
                                          pa.array(_pack(place - at, first - at, last - at))], ["gram", *_KEY, "anchor"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, off in text_slices(batches, _SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(anchors(data, off)[0].view(np.int64))], ["gram"])


def _anchored(batches: Iterator[pa.RecordBatch], hot: bool | None = None) -> Iterator[tuple]:
    """Of all anchors, or those in hot buckets or the others: for each part of a slice: the rows, anchors' documents, grams, places, first starts, row hashes, and the strings' bytes with their ends."""
    for rb, data, off in text_slices(batches, _SLICE):
        lists = rb.column("own")
        per = np.diff(np.asarray(lists.offsets))
        flat = lists.flatten()
        gram, packed = np.asarray(flat.field("gram")), np.asarray(flat.field("anchor"))
        doc = np.repeat(np.arange(len(per)), per)
        if hot is not None:
            mine = (packed & _HOT_BIT != 0) == hot
            gram, packed, doc = gram[mine], packed[mine], doc[mine]
        for lo in range(0, len(doc), BLOCK):
            part = slice(lo, lo + BLOCK)
            place, first, last = _unpack(packed[part])
            size = last - first + LENGTH
            raw = data[spread(off[doc[part]] + place + first, size)]
            ends = np.cumsum(size)
            view = raw.tobytes()
            row = np.array([xxhash.xxh3_64_intdigest(view[b - k:b]) for b, k in zip(ends.tolist(), size.tolist())], np.uint64).view(np.int64)
            yield rb, doc[part], gram[part], place, first, row, raw, ends


_ROWS = "gram long, first int, row long, bytes binary, n long"
#: Contexts that a task remembers to have sent; beyond that it starts anew.
SENT = 300_000


def _contexts(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
    """The contexts, combined within the task: each goes out once with its bytes; how often it came again, without them."""
    again: dict[tuple[int, int, int], int] = {}

    def counts() -> pa.RecordBatch:
        rows = [(*k, b"", n) for k, n in again.items() if n]
        again.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))],
                                          ["gram", "first", "row", "bytes", "n"])

    for _, _, gram, _, first, row, raw, ends in _anchored(batches, hot):
        new = []
        for k, key in enumerate(zip(gram.tolist(), first.tolist(), row.tolist())):
            if key in again:
                again[key] += 1
            else:
                again[key] = 0
                new.append(k)
        at = np.array(new, np.int64)
        size = np.diff(np.concatenate([[0], ends]))[at]
        yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(first[at].astype(np.int32)), pa.array(row[at]),
                                          binary(raw[spread(ends[at] - size, size)], np.cumsum(size)), pa.array(np.ones(len(at), np.int64))],
                                         ["gram", "first", "row", "bytes", "n"])
        if len(again) > SENT:
            yield counts()
    yield counts()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each context stands."""
    for rb, doc, gram, place, first, row, _, _ in _anchored(batches):
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(first.astype(np.int32)), pa.array(row),
                                          *[rb.column(k).take(pa.array(doc)) for k in _KEY], pa.array(place)], ["gram", "first", "row", *_KEY, "place"])


def _cover_columns() -> np.ndarray:
    return np.array([c for c in range(WIDTH - REACH + 1) if c % PERIOD in COVER])


def _ranks(x: np.ndarray, column: int) -> np.ndarray:
    """A number for each row's ``REACH`` bytes from the column on; equal bytes, equal numbers."""
    part = np.ascontiguousarray(x[:, column:column + REACH])
    words = part.view(np.uint64)
    _, rep, rank = np.unique(mix64((words * _WORDS).sum(axis=1, dtype=np.uint64)), return_index=True, return_inverse=True)
    if not (part[rep[rank]] == part).all():            # two strings met in one hash: sort the bytes themselves
        _, rank = np.unique(part.view(f"V{REACH}")[:, 0], return_inverse=True)
    return rank.astype(np.int64)


_WORDS = np.random.RandomState(4).randint(0, 1 << 62, REACH // 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _few(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Up to 8 bytes of each row as one number."""
    out = np.zeros(len(x), np.uint64)
    for c in range(a, b):
        out = out << np.uint64(8) | x[:, c]
    return out


def repeated(first: np.ndarray, data: np.ndarray, ends: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the first and last start (relative to the gram) of a string that repeats; last < first if none does.

    Rows are different contexts, ``data`` cut at ``ends``; ``many`` tells which occur more than once.
    """
    n = len(first)
    size = np.diff(np.concatenate([[0], ends]))
    last = first + size - LENGTH
    x = np.zeros((n, WIDTH), np.uint8)
    x.reshape(-1)[spread(np.arange(n) * WIDTH + LEFT + first, size)] = data
    lo, hi = np.where(many, first, 1), np.where(many, last, -WIDTH)
    cover = _cover_columns()
    ranks: dict[int, np.ndarray] = {}
    for s in range(-LEFT, 1):
        at = s + LEFT
        rows = np.flatnonzero((first <= s) & (last >= s))
        if len(rows) < 2:
            continue
        c1 = int(cover[np.searchsorted(cover, at)]) if at <= cover[-1] else at
        c2 = int(cover[np.searchsorted(cover, at + LENGTH - REACH, "right") - 1])
        for c in (c1, c2):
            if c not in ranks:
                ranks[c] = _ranks(x, c)
        key = ranks[c1][rows] << 31 | ranks[c2][rows]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        tied = np.zeros(len(rows), bool)
        tied[1:] |= same
        tied[:-1] |= same
        rows, key = rows[order[tied]], key[order[tied]]
        if len(rows) < 2:
            continue
        near = x[rows]
        before, after = _few(near, at, c1), _few(near, c2 + REACH, at + LENGTH)
        order = np.lexsort((after, before, key))
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (before[a] == before[b]) & (after[a] == after[b])
        hit = np.unique(rows[np.concatenate([a[same], b[same]])])
        lo[hit] = np.minimum(lo[hit], s)
        hi[hit] = np.maximum(hi[hit], s)
    return lo, hi


_FOUND = "gram long, first int, row long, lo int, hi int"


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole buckets from rows in order of gram, first and row."""
    def out(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table[c].to_numpy() for c in ("gram", "first", "row", "n")}
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("gram", "first", "row")])
        head = np.flatnonzero(new)
        n = np.add.reduceat(cols["n"], head)
        _, off = utf8_view(table["bytes"])
        full = np.flatnonzero(np.diff(off))            # of equal rows, one that came with its bytes
        _, one = np.unique(np.cumsum(new)[full], return_index=True)
        data, off = utf8_view(table["bytes"].take(pa.array(full[one])))
        lo, hi = repeated(cols["first"][head].astype(np.int64), data[off[0]:off[-1]], off[1:] - off[0], n > 1)
        some = np.flatnonzero(hi >= lo)
        return pa.RecordBatch.from_arrays([*[pa.array(cols[c][head[some]]) for c in ("gram", "first", "row")], pa.array(lo[some].astype(np.int32)),
                                           pa.array(hi[some].astype(np.int32))], ["gram", "first", "row", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    for rb in batches:
        for at in range(0, rb.num_rows, BLOCK):
            held.append(rb.slice(at, BLOCK))
            if sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                grams = table["gram"].to_numpy()
                cut = int(np.searchsorted(grams, grams[-1], "left"))       # the last bucket may go on
                if cut:
                    yield out(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield out(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts of hot buckets by its digest."""
    for rb in batches:
        data, off = utf8_view(rb.column("bytes"))
        size = np.diff(off)
        for i in range(rb.num_rows):
            raw = data[off[i]:off[i + 1]].tobytes()
            k = int(size[i]) - LENGTH + 1
            d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[j:j + LENGTH]) for j in range(k)]), ">i8").astype(np.int64).reshape(-1, 2)
            first = rb.column("first")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([rb.column(c)[i].as_py()] * k, t) for c, t in (("gram", pa.int64()), ("first", pa.int32()), ("row", pa.int64()), ("n", pa.int64()))]
                                             + [pa.array(np.arange(first, first + k, dtype=np.int32)), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))],
                                             ["gram", "first", "row", "n", "s", "d1", "d2"])


def _hot_found(distinct: DataFrame) -> DataFrame:
    strings = distinct.mapInArrow(_strings, "gram long, first int, row long, n long, s int, d1 long, d2 long")
    twice = strings.groupBy("gram", "s", "d1", "d2").agg(F.sum("n").alias("all_n")).where("all_n > 1").drop("all_n")
    return strings.join(twice, ["gram", "s", "d1", "d2"]).groupBy("gram", "first", "row").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))


def removed_spans(own: DataFrame, hot: int = HOT) -> DataFrame:
    """(id_key, text_hash, spans): per document the (start, end) bytes that its repeated strings cover."""
    grams = stored(own.select("text").mapInArrow(_gram_rows, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    any_hot = not grams.where(F.col("n") > hot).isEmpty()
    anchor = F.when(F.col("n") > hot, F.col("anchor").bitwiseOR(F.lit(_HOT_BIT))).otherwise(F.col("anchor")).alias("anchor")
    found = own.mapInArrow(_anchor_rows, "gram long, id_key long, text_hash long, anchor long").join(grams, "gram")
    lists = found.groupBy(*_KEY).agg(F.collect_list(F.struct(F.col("gram"), anchor)).alias("own"))
    texts = _with(own, lists, "own", "inner")
    rows = texts.mapInArrow(lambda b: _contexts(b, False), _ROWS)
    repeats = rows.repartition("gram").sortWithinPartitions("gram", "first", "row").mapInArrow(_sorted_blocks, _FOUND)
    if any_hot:
        rows = texts.mapInArrow(lambda b: _contexts(b, True), _ROWS)
        distinct = rows.groupBy("gram", "first", "row").agg(F.max("bytes").alias("bytes"), F.sum("n").alias("n"))
        repeats = repeats.unionByName(_hot_found(distinct))
    places = texts.mapInArrow(_places, "gram long, first int, row long, id_key long, text_hash long, place long")
    spans = places.join(repeats, ["gram", "first", "row"]).select(
        *_KEY, F.struct((F.col("place") + F.col("lo")).alias("start"), (F.col("place") + F.col("hi") + LENGTH).alias("end")).alias("span"))
    return spans.groupBy(*_KEY).agg(F.collect_set("span").alias("spans"))


def _with(own: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
    return own.join(side, list(_KEY), how).select("doc_id", *_KEY, "text", column)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, data, off in text_slices(batches):
        lists = rb.column("spans")
        flat = lists.flatten()
        per = np.diff(np.asarray(lists.offsets))
        if lists.null_count:
            per = np.where(np.asarray(lists.is_null()), 0, per)
        at = off[np.repeat(np.arange(len(per)), per)]
        mark = np.zeros(len(data) + 1, np.int64)
        np.add.at(mark, at + np.asarray(flat.field("start")), 1)
        np.add.at(mark, at + np.asarray(flat.field("end")), -1)
        gone = np.cumsum(mark)[:-1] > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        begin[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
        total = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(begin)])
        keep = ~gone
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(runs[off])),
                                          binary(data[keep], np.concatenate([[0], np.cumsum(keep)])[off[1:]])],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that no repeated string covers, per text."""
    own = keyed(docs, id_col, text_col)
    return (_with(own, removed_spans(own, hot), "spans", "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def digests(kept: DataFrame) -> DataFrame:
    """The per-document columns of query op4."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
