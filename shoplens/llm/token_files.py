"""Token ids in ordered files of Simple-8b blocks (operator 3).

``write_tokens`` deals the documents out by range of doc_id, so that each task
(a *shard*) holds a contiguous stretch of ids in order, encodes its texts with
the tokenizers library, and cuts its id stream into blocks. A table of the
shared file system carries the blocks (Spark's commit protocol covers lost
executors); a block is one row:

* ``shard``, ``block``: place in the stream (shards in doc_id order);
* ``words``: Simple-8b words (``simple8b.py``), little-endian;
* ``doc_ids``, ``counts``: documents of the block, and ids of each in it;
* ``word_offsets``, ``id_offsets``: every ``MARK`` words, how many words and ids
  came before: a reader can decode any part of a block on its own.

A block ends with the document that brings it to ``BLOCK_IDS`` ids, so it is
bounded by that and the longest document. ``read_tokens`` gives the ids of each document back, with ``start``, the
number of ids before it in the whole stream: a prefix sum over the shards'
totals (as many rows as shards) and, within a shard, over its blocks.

NULL text counts as empty: only the end id is written. Rows with equal doc_id
stay separate documents, in text order. Further columns are ignored; an empty
table gives empty files. The library is called on distinct words: no token of
its word-level vocabularies crosses a space, so a text's ids are its words'
ids in turn; a vocabulary for which this does not hold takes ``by_words=False``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.llm import simple8b
from shoplens.llm.arrow import binary, spread, text_slices
from shoplens.llm.bpe import byte_chars

BLOCK_IDS = 1 << 16
MARK = 1 << 10
#: Words whose ids a task remembers at most; then it starts anew.
MEMO = 400_000
SCHEMA = ("shard int, block int, first_id long, n_ids long, doc_ids array<long>, counts array<long>, "
          "words binary, word_offsets array<long>, id_offsets array<long>")

_LOADED: dict = {}
_BYTE_LETTERS = {b: c for c, b in byte_chars().items()}
#: Bytes of text encoded at a time.
SLICE = 6 << 20


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), _Memo())
    return _LOADED[path]


class _Memo:
    """Words with their ids, as arrays: a slice's distinct words are looked up all at once."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: pa.Array, encode) -> np.ndarray:
        """The places of ``words``; those not known yet are encoded by ``encode(list) -> (ids, ids per word)``."""
        if len(self.words) > MEMO:
            self.__init__()
        place = pc.index_in(words, value_set=self.words)
        unknown = pc.is_null(place)
        new = words.filter(unknown)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, n = encode(new.to_pylist())
            place[unknown.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        return place


#: Lower-case letters of ASCII and Latin-1 only.
_LOWER_WORD = regex.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def _byte_letters(word: str) -> str:
    """The word in the byte-level alphabet of such vocabularies, where printable Latin-1 stands for itself."""
    return word if word.isascii() else "".join([_BYTE_LETTERS[b] for b in word.encode()])


def _encode(col: pa.Array, path: str, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in row order, and ids per text."""
    tok, memo = _tokenizer(path)
    col = col.fill_null("")
    if not by_words:
        ids = [e.ids for e in tok.encode_batch(col.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
    lists = _pieces(col)
    per = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    place = memo.learn(coded.dictionary, lambda words: _encode_words(tok, words))[coded.indices.to_numpy()]
    n = (memo.ends[1:] - memo.ends[:-1])[place]
    ends = np.concatenate([[0], np.cumsum(n)])
    return memo.ids[spread(memo.ends[place], n)], np.diff(ends[np.concatenate([[0], np.cumsum(per)])])


def _encode_words(tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words in order, and ids per word."""
    model, plain = tok.model.tokenize, list(map(_LOWER_WORD, words))
    hard = [w for w, p in zip(words, plain) if not p]
    slow = iter([e.ids for lo in range(0, len(hard), 1000) for e in tok.encode_batch(hard[lo:lo + 1000], add_special_tokens=False)])
    flat: list[int] = []
    n = np.zeros(len(words), np.int64)
    for k, w in enumerate(words):
        # A lower-case word needs nothing normalised or cut: straight to the library's model.
        ids = [t.id for t in model(_byte_letters(w))] if plain[k] else next(slow)
        flat += ids
        n[k] = len(ids)
    return np.array(flat, np.uint32), n


def _pieces(col: pa.Array) -> pa.ListArray:
    """Texts cut at white space and, where that changes nothing, lower-cased and cut around runs of marks.

    The vocabulary lower-cases and makes a run of marks a token of its own. Texts
    with an apostrophe (contractions), a special token's opening, or characters
    beyond Latin-1's letters (normal forms) are only cut at white space.
    """
    col = col.cast(pa.large_string())
    plain = pc.invert(pc.match_substring_regex(col, r"[^\x00-\x7f\x{c0}-\x{ff}]|'|<\|"))
    cut = pc.replace_substring_regex(pc.utf8_lower(col), r"([^\s\p{L}\p{N}]+)", r" \1 ")
    return pc.ascii_split_whitespace(pc.if_else(plain, cut, col))


class _Blocks:
    """Cuts one shard's id stream into block rows."""

    def __init__(self, shard: int):
        self.shard, self.block, self.before = shard, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids)))
        self.held += len(ids)

    def close(self) -> pa.RecordBatch:
        words = simple8b.encode(np.concatenate(self.ids))
        ends = np.cumsum(simple8b.COUNTS[(words >> np.uint64(60)).astype(np.int64)])
        marks = np.arange(0, len(words), MARK)
        row = {"shard": self.shard, "block": self.block, "first_id": self.before, "n_ids": self.held,
               "doc_ids": [d for d, _ in self.docs], "counts": [n for _, n in self.docs],
               "words": words.astype("<u8").tobytes(),
               "word_offsets": marks.tolist(), "id_offsets": np.concatenate([[0], ends])[marks].tolist()}
        self.before += self.held
        self.block += 1
        self.ids, self.docs, self.held = [], [], 0
        return pa.RecordBatch.from_pylist([row], _ARROW)


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.binary()),
                    ("word_offsets", pa.list_(pa.int64())), ("id_offsets", pa.list_(pa.int64()))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id",
                 text_col: str = "text", by_words: bool = True) -> None:
    """Write the ids of all texts, each followed by ``end_id``, as blocks in doc_id order below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks, tail = _Blocks(TaskContext.get().partitionId()), np.array([] if end_id is None else [end_id], np.uint32)
        for rb, _, _ in text_slices(batches, SLICE):
            ids, count = _encode(rb.column("text"), tokenizer, by_words)
            at = np.concatenate([[0], np.cumsum(count)])
            for k, doc_id in enumerate(rb.column("doc_id").to_pylist()):
                blocks.add(doc_id, np.concatenate([ids[at[k]:at[k + 1]], tail]))
                if blocks.held >= BLOCK_IDS:
                    yield blocks.close()
        if blocks.docs:
            yield blocks.close()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    (own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, SCHEMA).write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files by ``write_tokens``; ``ids`` as little-endian unsigned 32-bit integers."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = F.coalesce(F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per written shard, so its size is bounded by the number of write tasks: no shuffle of the blocks.
    placed = blocks.join(F.broadcast(shards.select("shard", before.alias("shard_start"))), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                ids = decode_block(r["words"], r["n_ids"])
                counts = np.array(r["counts"], np.int64)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["shard_start"] + r["first_id"] + ends - counts),
                     pa.array(counts), binary(ids.astype("<u4").view(np.uint8), 4 * ends)],
                    ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("first_id", "n_ids", "doc_ids", "counts", "words", "shard_start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def decode_block(words: bytes, n_ids: int) -> np.ndarray:
    """All ids of one block (the last word may be padded)."""
    return simple8b.decode(np.frombuffer(words, "<u8"))[:n_ids]


def digests(tokens: DataFrame) -> DataFrame:
    """The per-document columns of query op3."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
