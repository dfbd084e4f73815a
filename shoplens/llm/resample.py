"""Target-distribution importance resampling (operator 13).

*Features* of a text are its runs of 1 to ``longest`` consecutive words (ASCII letters
and digits and all non-ASCII characters, A-Z lower-cased), joined by one blank; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. Two passes over the
tables count the buckets of the raw and of the target texts; a bucket's *gain* is the
log ratio of both shares, smoothed by one, in whole thousandths. The gains are one
array (``buckets`` numbers, broadcast), and scoring a text is a lookup and a sum in
numpy: its *weight* is the floored mean gain, its *score* that plus Gumbel noise from
a hash of seed and id, so taking the highest scores draws without replacement in
proportion to the weights.

*The draw.* A quantile sketch of the scores (``percentile_approx``) gives a bracket around the
cutoff; exact counts of the scores above and in it say whether the cutoff lies
inside, otherwise the bracket is widened on the side that missed, up to all scores. Only the
bracket's rows are then sorted, over ranges, to find the row at which the draw ends.
The drawn rows, a fixed share of all, are numbered by ``shoplens.operators.ranks``.

Defined results: NULL and empty texts have no feature, weight 0 and are never drawn; so
are texts under ``least_words`` words. A NULL id hashes as the empty text and comes last
among ties; rows that repeat an id are separate rows, in the order of (score,
id, features, weight). Empty tables give empty results, an empty target table equal
chances up to the noise of the raw counts. Further columns are ignored. A text is never
split, so a task holds its longest text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import lower_ascii, text_slices
from shoplens.llm.store import stored
from shoplens.operators.ranks import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = "2024"
SHARE = (10, 100)
#: First half-width of the bracket, as a share of all scores, and the sketch's accuracy.
HALF_WIDTH, ACCURACY = 0.002, 10_000
_LONG_WORD = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-32 states after the byte runs, all runs a byte at a time; long runs one by one by zlib."""
    order = np.argsort(np.minimum(lens, _LONG_WORD + 1).astype(np.uint8), kind="stable")[::-1]
    s, at, n = state[order], starts[order], lens[order]
    long = int(np.searchsorted(-n, -_LONG_WORD, "left")) if len(n) else 0
    live = np.searchsorted(-np.minimum(n, _LONG_WORD + 1), -np.arange(_LONG_WORD + 1), "left")
    for k in range(_LONG_WORD):
        m = int(live[k])
        if m == long:
            break
        s[long:m] = _CRC[(s[long:m] ^ data[at[long:m] + k]) & np.uint32(0xFF)] ^ (s[long:m] >> np.uint32(8))
    for i in range(long):
        s[i] = zlib.crc32(data[at[i]:at[i] + n[i]].tobytes(), int(~s[i])) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def feature_buckets(data: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its bucket, words per document) of a slice of texts."""
    low = lower_ascii(data)
    inside = (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(low) else inside
    after = np.concatenate([inside[1:], [False]]) if len(low) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    lens = np.flatnonzero(inside & (~after | edge[1:])) + 1 - starts
    doc = np.searchsorted(off, starts, "right") - 1
    state = _fed(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, lens)
    docs, hashes = [doc], [~state]
    for n in range(1, longest):
        own = np.flatnonzero(doc[:len(doc) - n] == doc[n:]) if len(doc) > n else np.zeros(0, np.int64)
        blank = _CRC[(state[own] ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state[own] >> np.uint32(8))
        grown = np.zeros_like(state)
        grown[own] = _fed(blank, low, starts[own + n], lens[own + n])
        state = grown
        docs.append(doc[own])
        hashes.append(~state[own])
    return np.concatenate(docs), np.concatenate(hashes) % np.uint32(buckets), np.bincount(doc, minlength=len(off) - 1)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in a column of texts: one small array from each task, summed by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for _, data, off in text_slices(batches):
            n += np.bincount(feature_buckets(data, off, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the smoothed log ratio of the target's share to the raw share, by bucket."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)))) for s, t in zip(raw, target)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for rb, data, off in text_slices(batches):
            doc, bucket, words = feature_buckets(data, off, longest, len(g))
            n = np.bincount(doc, minlength=len(off) - 1)
            total = np.zeros(len(off) - 1, np.int64)
            np.add.at(total, doc, g[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return out.withColumn("score", F.col("weight") + noise)


def _bracket(pool: DataFrame, total: int, wanted: int) -> tuple[int, int, int]:
    """(low, high, rows above high): scores between which the ``wanted``-th highest lies, proved by counts."""
    down = up = HALF_WIDTH
    while True:
        at = 1 - wanted / total
        lo_q, hi_q = max(0.0, at - down), min(1.0, at + up)
        lo, hi, least, most = pool.agg(F.percentile_approx("score", [lo_q, hi_q], ACCURACY).alias("q"), F.min("score").alias("a"), F.max("score").alias("b")).select(F.col("q")[0], F.col("q")[1], "a", "b").first()
        lo, hi = (least if lo_q == 0.0 else lo), (most if hi_q == 1.0 else hi)
        above, inside = pool.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < wanted <= above + inside:
            return lo, hi, above
        if wanted <= above:
            up = min(1.0, up * 8)
        else:
            down = min(1.0, down * 8)


ORDER = (F.desc, "score"), (F.asc_nulls_last, "doc_id"), (F.asc, "n_features"), (F.asc, "weight")


def _order() -> list[Column]:
    return [way(c) for way, c in ORDER]


def draw(rows: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (a stored result of ``scored``) with ``rank``: 1, 2, 3 ... of the drawn ones, NULL for the others.

    Of the N rows with ``least_words`` words or more, floor(N * share) are drawn: the highest scores, ties to the lesser id.
    """
    fits = F.col("n_words") >= least_words
    pool = rows.where(fits)
    total = pool.count()
    wanted = total * share[0] // share[1]
    nobody = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select("*", nobody)
    lo, hi, above = _bracket(pool, total, wanted)
    inside = numbered(stored(pool.where(F.col("score").between(lo, hi)).select("score", "doc_id", "n_features", "weight"), "bracket"), _order(), name="at")
    end = inside.where(F.col("at") == wanted - above).first()
    # A NULL id is the last of its score.
    upto = F.lit(True) if end.doc_id is None else F.col("doc_id").isNotNull() & (F.col("doc_id") <= end.doc_id)
    first = fits & ((F.col("score") > end.score) | ((F.col("score") == end.score) & upto))
    drawn = numbered(rows.where(first), _order(), name="rank")
    ranks = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranks.unionByName(rows.where(~first).select("*", nobody))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, share: tuple[int, int] = SHARE,
             least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank in the draw."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return draw(stored(scored(docs, gain, longest, seed), "resample-scores"), share, least_words)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: The query in DuckDB SQL. CRC-32 is taken of distinct words, byte by byte through a table made from its rule.
ORACLE_SQL = """
with tab as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t),
texts as (
  select 'd' as side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as s from documents
  union all
  select 'b', null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (select side, doc_id, unnest(regexp_extract_all(s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from texts),
crcs as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 as bucket
  from (select distinct w from words), tab),
hits as (select side, doc_id, bucket from words join crcs using (w)),
sizes as (select count(*) filter (side = 'd') as s_all, count(*) filter (side = 'b') as t_all from hits),
counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from hits group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as g from counts, sizes),
weights as (select doc_id, count(*) as n, floor(sum(g)::double / count(*))::bigint as w from hits join gain using (bucket) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(w, 0)::bigint as weight,
    (coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from documents d left join weights using (doc_id)),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as total from scored where n_features >= 20)
select doc_id, n_features, weight, score, (case when r <= 10 * total // 100 then r end)::bigint as rank from scored left join drawn using (doc_id)
"""
