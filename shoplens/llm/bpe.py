"""Byte-level BPE encoding and decoding through a transducer lexicon (operator 7).

1. *Count*: every document is cut into words (a word keeps the single space
   before it), and the words of all documents are counted in Spark.
2. *Compile*: the ``LEXICON_WORDS`` most frequent words are merged exactly on
   the driver and compiled, with their ids, into a minimal acyclic transducer
   (``lexicon.py``). Its size is bounded by that parameter; it is broadcast and
   memory-mapped by the tasks. It only saves work: the ids do not depend on it.
3. *Encode*: per slice of text, distinct words are looked up in the transducer;
   the others are split into pre-tokens and merged exactly, lowest rank first,
   many at a time.
4. *Decode*: ids are turned back to bytes by table, then to text.

NULL text counts as empty (no ids, empty text). Literal special tokens in a text
get their ids, as the tokenizers library does by default. Rows are independent:
repeated rows and ties give equal results, further columns are ignored, an
empty table gives an empty result. No shuffle but that of the word counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import binary, spread, text_slices, utf8_view
from shoplens.llm.lexicon import Lexicon, compile_lexicon
from shoplens.llm.store import stored

#: Words in the lexicon at most (a fixed model size, not a share of the data).
LEXICON_WORDS = 131_072
#: Longer words are not counted, and longer pre-tokens are merged one by one.
LONG_WORD = 64
#: Distinct words that a counting task holds before it hands on its counts.
COUNT_HELD = 200_000

_PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PAIRS = tuple(f"{a}{b}" for a in " \t\n\v\f\r" for b in " \t\n\v\f\r" if " " in (a, b))
# Code points that some definition counts as white space, beside the plain ones; texts with one take the careful way.
_RARE_SPACE = regex.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C),
                                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")


def byte_chars() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


NO_RANK = 1 << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair_table(rank: dict[tuple[int, int], tuple[int, int]]) -> tuple:
    """Pairs of ids with rank and merged id in one open-addressing table."""
    bits = max(4, (4 * len(rank)).bit_length())
    size, shift, mask = 1 << bits, 64 - bits, (1 << bits) - 1
    keys, ranks, ids = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for (a, b), (r, new) in rank.items():
        k = a << 20 | b
        at = ((k * int(_MIX)) & ((1 << 64) - 1)) >> shift
        while keys[at] >= 0:
            at = (at + 1) & mask
        keys[at], ranks[at], ids[at] = k, r, new
    return keys, ranks, ids, np.uint64(shift), mask


class ByteBpe:
    """Exact merges, pre-tokens and the id table of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab = {w: i for w, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(chars[c] for c in w) for w, i in vocab.items()}
        self.bytes_of |= {i: w.encode() for w, i in self.special.items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        top = max(self.bytes_of) + 1
        table = [self.bytes_of.get(i, b"") for i in range(top)]
        self.lens = np.array([len(b) for b in table], np.int64)
        self.offs = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self._pairs = _pair_table(self.rank)
        self._single = np.array([self.single[b] for b in range(256)], np.int64)

    def merge(self, token: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        ids, rank, none = [self.single[b] for b in token], self.rank, (1 << 60, 0)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, token: bytes) -> list[int]:
        """The same merges by a heap over linked symbols: n log n for very long pre-tokens."""
        import heapq

        ids: list = [self.single[b] for b in token]
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = new, None, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if r := self.rank.get((new, ids[nxt[i]])):
                    heapq.heappush(heap, (*r, i, new, ids[nxt[i]]))
            if prev[i] >= 0 and (r := self.rank.get((ids[prev[i]], new))):
                heapq.heappush(heap, (*r, prev[i], ids[prev[i]], new))
        return [i for i in ids if i is not None]

    def word(self, text: str) -> list[int]:
        """Ids of a stretch without special tokens that ends where a pre-token does."""
        out: list[int] = []
        for t in _PRETOKENS.findall(text):
            raw = t.encode()
            out += self.merge(raw) if len(raw) <= LONG_WORD else self.merge_long(raw)
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; ``NO_RANK`` where it does not merge."""
        keys, ranks, ids, shift, mask = self._pairs
        want = a << 20 | b
        slot = ((want.astype(np.uint64) * _MIX) >> shift).astype(np.int64)
        open_ = np.flatnonzero((keys[slot] != want) & (keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            got = keys[slot[open_]]
            open_ = open_[(got != want[open_]) & (got >= 0)]
        hit = keys[slot] == want
        return np.where(hit, ranks[slot], NO_RANK), ids[slot]

    def merge_many(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for many pre-tokens side by side, a row each: their ids in turn, and ids per pre-token."""
        size = np.array([len(t) for t in tokens], np.int64)
        out_len = np.zeros(len(tokens), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        for width in (4, 8, 16, 32, LONG_WORD):
            rows = np.flatnonzero((size > lo) & (size <= width))
            lo = width
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join([tokens[i] for i in rows]), np.uint8)
            n = size[rows].copy()
            col = np.arange(width)
            ids = np.zeros((len(rows), width), np.int64)
            ids[col < n[:, None]] = self._single[raw]
            rank = np.full((len(rows), width), NO_RANK, np.int64)
            merged = np.zeros((len(rows), width), np.int64)
            r, c = np.nonzero(col[None, :] < n[:, None] - 1)
            rank[r, c], merged[r, c] = self._rank_of(ids[r, c], ids[r, c + 1])
            live = np.arange(len(rows))
            while len(live):
                at = rank[live].argmin(axis=1)
                some = rank[live, at] < NO_RANK
                live, at = live[some], at[some]
                if not len(live):
                    break
                ids[live, at] = merged[live, at]
                take = np.minimum(col + (col > at[:, None]), width - 1)
                ids[live] = np.take_along_axis(ids[live], take, 1)
                take = np.minimum(col + (col >= at[:, None]), width - 1)
                rank[live] = np.take_along_axis(rank[live], take, 1)
                merged[live] = np.take_along_axis(merged[live], take, 1)
                n[live] -= 1
                rank[live, np.minimum(n[live] - 1, width - 1)] = NO_RANK
                for shift in (-1, 0):
                    left = at + shift
                    ok = (left >= 0) & (left + 1 < n[live])
                    i, j = live[ok], left[ok]
                    rank[i, j], merged[i, j] = self._rank_of(ids[i, j], ids[i, j + 1])
            out_len[rows] = n
            parts.append((rows, ids[col < n[:, None]]))
        for i in np.flatnonzero(size > LONG_WORD):
            got = self.merge_long(tokens[i])
            out_len[i] = len(got)
            parts.append((np.array([i]), np.array(got, np.int64)))
        out = np.zeros(int(out_len.sum()), np.uint32)
        start = np.cumsum(out_len) - out_len
        for rows, flat in parts:
            out[spread(start[rows], out_len[rows])] = flat
        return out, out_len

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and ids per word."""
        place: dict[str, int] = {}
        codes, per = [], []
        for w in words:
            found = _PRETOKENS.findall(w)
            per.append(len(found))
            codes += [place.setdefault(t, len(place)) for t in found]
        ids, count = self.merge_many([t.encode() for t in place])
        code = np.array(codes, np.int64)
        lens = count[code]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per, dtype=np.int64)])]
        return ids[spread((np.cumsum(count) - count)[code], lens)], np.diff(ends)

    def whole(self, text: str) -> list[int]:
        """Ids of any text, special tokens included."""
        if self._cut is None or not any(s in text for s in self.special):
            return self.word(text)
        out: list[int] = []
        for part in self._cut.split(text):
            out += [self.special[part]] if part in self.special else self.word(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        raw = self.flat[spread(self.offs[ids], self.lens[ids])].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


_LOADED: dict[str, ByteBpe] = {}


def load_bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _regular(texts: list[str], special) -> np.ndarray:
    """Texts where each space stands alone between visible characters: their words can be cut at spaces."""
    return np.array([bool(t) and t[0] != " " and t[-1] != " " and not any(p in t for p in _PAIRS)
                     and not _RARE_SPACE.search(t) and not any(s in t for s in special) for t in texts], bool)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as codes, and words per text; a text's first word has no space before it."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    per = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    first = np.zeros(len(flat), bool)
    first[np.cumsum(per) - per] = True
    spaced = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " ").cast(pa.large_string()), flat, pa.scalar("", pa.large_string()))
    coded = spaced.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), per


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for rb, _, _ in text_slices(batches):
        col = rb.column("text").fill_null("")
        texts = col.to_pylist()
        good = _regular(texts, ())
        words, codes, _ = _words(col.filter(pa.array(good)))
        for w, n in zip(words.to_pylist(), np.bincount(codes, minlength=len(words)).tolist()):
            if len(w) <= LONG_WORD:
                held[w] = held.get(w, 0) + n
        for i in np.flatnonzero(~good):
            for w in _PRETOKENS.findall(texts[i]):
                if len(w) <= LONG_WORD:
                    held[w] = held.get(w, 0) + 1
        if len(held) >= COUNT_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents: partial counts per task, then summed by word."""
    part = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of ``docs``, at most ``words`` of them.

    A histogram of the counts gives the least count whose words, all together, are
    not too many; only those words reach the driver.
    """
    bpe = load_bpe(path)
    counts = stored(word_counts(docs, text_col).where("n > 1"), "word-counts")
    level = F.floor(4 * F.log2("n"))
    left, least = words, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    top = [] if least is None else counts.where(level >= least).select("word").collect()
    words = [r.word for r in top]
    ids, count = bpe.many(words)
    return compile_lexicon({w.encode(): x.tolist() for w, x in zip(words, np.split(ids, np.cumsum(count)[:-1]))} if words else {})


class Encoder:
    """Encodes slices of rows with a lexicon; one per task."""

    def __init__(self, path: str, blob: bytes):
        self.bpe, self.lexicon = load_bpe(path), Lexicon(blob)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in row order, and ids per text."""
        col = col.fill_null("")
        texts = col.to_pylist()
        good = _regular(texts, self.bpe.special)
        words, codes, per = _words(col.filter(pa.array(good)))
        data, off = utf8_view(words)
        number = self.lexicon.find(data, off[:-1], off[1:])
        found = number >= 0
        offs = self.lexicon.offs
        more, per_word = self.bpe.many(words.filter(pa.array(~found)).to_pylist())
        lens, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lens[found], start[found] = offs[number[found] + 1] - offs[number[found]], offs[number[found]]
        lens[~found] = per_word
        start[~found] = len(self.lexicon.ids) + np.cumsum(lens[~found]) - lens[~found]
        table = np.concatenate([self.lexicon.ids, more])
        odd = [self.bpe.whole(texts[i]) for i in np.flatnonzero(~good)]
        word_len = lens[codes]
        easy = table[spread(start[codes], word_len)]
        count = np.zeros(len(texts), np.int64)
        ends = np.concatenate([[0], np.cumsum(word_len)])[np.concatenate([[0], np.cumsum(per)])]
        count[good] = np.diff(ends)
        count[~good] = [len(x) for x in odd]
        if good.all():
            return easy, count
        out = np.empty(int(count.sum()), np.uint32)
        mine = np.repeat(good, count)
        out[mine] = easy
        out[~mine] = np.array([i for x in odd for i in x], np.uint32)
        return out, count


def encode(docs: DataFrame, path: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text",
           decode: bool = False) -> DataFrame:
    """(doc_id, ids) and, with ``decode``, the text that the ids give back.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, shared.value)
        for rb, _, _ in text_slices(batches):
            ids, count = coder.encode(rb.column("text"))
            ends = np.cumsum(count)
            cols = [rb.column("doc_id"), binary(ids.astype("<u4").view(np.uint8), 4 * ends)]
            if decode:
                cols.append(_decoded(coder.bpe, ids, ends))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decode)


def _decoded(bpe: ByteBpe, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    wide = ids.astype(np.int64)
    lens = bpe.lens[wide]
    raw = bpe.flat[spread(bpe.offs[wide], lens)]
    at = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends])]
    try:
        raw.tobytes().decode()
        whole = bool((raw[at[:-1][at[:-1] < len(raw)]] & 0xC0 != 0x80).all())
    except UnicodeDecodeError:
        whole = False
    if whole:
        return binary(raw, at[1:], pa.string())
    return pa.array([bpe.decode(ids[a:b]).decode() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)], pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of packed ids; NULL ids give empty text, invalid UTF-8 becomes U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for rb, data, off in text_slices(batches, text="ids"):
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), _decoded(bpe, np.frombuffer(data.tobytes(), "<u4"), off[1:] // 4)], ["doc_id", "text"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(coded: DataFrame) -> DataFrame:
    """The per-document columns of query op7: counts and SHA-256 of ids and decoded text."""
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
