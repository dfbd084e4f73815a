"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

*Fingerprint.* A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; shingles of
``shingle`` words, repeats included, joined by a space (a shorter text is one
shingle of all its words). Bit b of the fingerprint is 1 if bit b is set in over
half of the shingles' XXH64 values (UTF-8, seed 42). No word: fingerprint zero.

*Covering tables.* Bit position i carries a code c(i) of radius + 1 bits. For each
non-zero vector w of that length there is a table whose mask keeps the positions
with c(i) . w odd. Any ``radius`` codes span less than the whole space, so some w
is orthogonal to all of them: two fingerprints at most ``radius`` bits apart agree
under some mask. 2**(radius + 1) - 1 tables find every pair, with certainty.

*Scale.* Only distinct fingerprints enter the tables, so exact copies cost one row.
A bucket of over ``BUCKET`` fingerprints is split: its free bits are cut into
radius + 1 blocks, and by the pigeonhole principle a linked pair agrees on one of
them; this repeats until buckets are small or have at most ``FREE_BITS`` free bits,
hence at most 2**FREE_BITS fingerprints. Nothing is dropped, and no task holds
more. Of each bucket only a spanning forest of its links is kept (n - 1 edges at
most), which connects what all its pairs would.

Empty table: empty result. NULL text: like an empty text. A NULL doc_id keeps its
row and is not counted as smallest. Repeated rows stay repeated. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import text_slices
from shoplens.llm.components import components
from shoplens.llm.store import stored

SHINGLE, RADIUS, SEED = 3, 3, 42
BUCKET = 1024
FREE_BITS = 12
_ONES = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per document the bits set in over half of its hashes; ``count`` hashes each."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    n = count[some]
    pieces = -(-n // 255)                              # at most 255 hashes, so that byte lanes can't overflow
    doc = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(n) - n)[doc] + 255 * nth
    first = np.cumsum(pieces) - pieces
    got = np.zeros(len(some), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _ONES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, first, axis=0)
        over = (2 * sums > n[:, None]).astype(np.uint64)
        got |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    out[some] = got
    return out


def _fingerprints(data: bytes, off: list[int], shingle: int) -> np.ndarray:
    digest, hashes, count = xxhash.xxh64_intdigest, [], []
    for a, b in zip(off, off[1:]):
        words = data[a:b].lower().split()
        if len(words) <= shingle:
            hashes += [digest(b" ".join(words), SEED)] if words else []
            count.append(int(bool(words)))
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:len(words) - shingle] + 1).tolist()]
        hashes += [digest(flat[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())]
        count.append(len(starts))
    return _majority(np.array(hashes, np.uint64), np.array(count, np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, off in text_slices(batches):
            fp = _fingerprints(data.tobytes(), off.tolist(), shingle)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks of all tables; the code of bit position i is 1 + i mod (2**(radius + 1) - 1)."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % top) & w).bit_count() & 1) for w in range(1, top + 1)]


def split_mask(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks with one more block of the free bits each; a pair within the radius agrees under one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[k::radius + 1] for k in range(radius + 1)]
    return [mask | sum(1 << i for i in p) for p in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    return (rows.select("fp", F.explode(masks).alias("mask"))
            .select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    rest, out = fps, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            f = queue.pop()
            near = np.bitwise_count(rest ^ f) <= radius
            if near.any():
                got, rest = rest[near], rest[~near]
                out.append((np.full(len(got), f), got))
                queue += list(got)
    return out


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            col = rb.column("fps")
            offs, flat = np.asarray(col.offsets), col.values.to_numpy().view(np.uint64)
            n = np.diff(offs)
            two = offs[:-1][n == 2]
            a, b = flat[two], flat[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            found = [(a[near], b[near])]
            for lo, k in zip(offs[:-1][n > 2], n[n > 2]):
                found += _forest(flat[lo:lo + k], radius)
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, free_bits: int = FREE_BITS) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) at most ``radius`` bits apart."""
    spark = distinct.sparkSession
    masks = covering_masks(radius)
    keyed = _keyed(distinct, F.array(*[F.lit(_signed(m)) for m in masks]))
    found = None
    while True:
        done = [_signed(m) for m in masks if 64 - m.bit_count() <= free_bits]
        big = (F.col("n") > bucket) & ~F.col("mask").isin(done)
        sizes = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        small = keyed.join(sizes.where(~big).select("mask", "key"), ["mask", "key"])
        part = stored(_links(small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")), radius), "links")
        found = part if found is None else found.union(part)
        hot = sizes.where(big).select("mask", "key")
        if hot.isEmpty():
            return found.distinct()
        finer = {m: split_mask(m, radius) for m in masks if _signed(m) not in done}
        table = F.create_map(*[F.lit(_signed(m)) if k == 0 else F.array(*[F.lit(_signed(x)) for x in v])
                               for m, v in finer.items() for k in (0, 1)])
        rows = keyed.join(hot, ["mask", "key"]).select("fp", table[F.col("mask")].alias("finer"))
        keyed = stored(_keyed(rows, F.col("finer")).distinct(), "hot-buckets")
        masks = sorted({x for v in finer.values() for x in v})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET, free_bits: int = FREE_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest doc_id reachable over links."""
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(links(distinct.select("fp"), radius, bucket, free_bits))
    linked = groups.select(F.col("node").alias("fp"), "root").join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    place = distinct.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # Stored, so that both sides of the join are plain shuffles: adaptive execution can then split a hot fingerprint's rows.
    return own.join(stored(place, "places"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
