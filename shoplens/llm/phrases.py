"""Phrase collocation mining over a weighted de Bruijn graph of words (operator 11).

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``, A-Z
lower-cased; everything is per language (NULL: ``und``). The graph of a language has the runs of
``LONGEST - 1`` words as nodes and the runs of ``LONGEST`` words as edges, weighted by how often
they occur; an edge joins the two nodes that overlap in it.

1. **Vocabulary.** All words are counted over all documents. Words that occur ``least``
   times or more may be part of a phrase. The ``CODES`` most frequent get two-byte tokens in
   the order of their counts, the others ten-byte tokens that hold a 64-bit hash; the vocabulary
   itself proves that no two words share a token, otherwise another seed is taken. A bitmap of
   bounded size tells most rare words apart, without ever missing a word of the graph.
2. **Edges.** Every position of every piece emits one edge: the tokens of up to ``LONGEST`` words,
   cut where the piece ends or a rare word follows (such edges are the *piece-end
   corrections*: weight that leaves the graph there). Tasks add up equal edges, then
   all edges are shuffled once and sorted.
3. **Node flow.** The count of a shorter run is the weight that flows out of it: the sum
   of all edges that begin with it, cut ones included. In sorted order that is one pass
   over neighbouring rows; runs that a task holds completely are kept if they reach ``least``,
   partial ones are added up over the tasks.
4. **Unary paths.** A node through which the whole weight of one edge goes on into one other
   edge is passed, not chosen: such edges are compacted, by pointer doubling, into
   paths (``paths``), and the nodes within a path are dropped as phrases at once, since the
   edges around them have the same count.
5. **Scores.** Candidates meet the counts of both parts of each cut in equi-joins; a candidate goes
   if a longer one around it has ``100 * f(longer) >= 80 * a`` (an extension by one word is
   the most frequent one, so those suffice). Scores are exact, in decimals.

*Skew.* An edge is dealt by its shortest prefix that holds a word of less than ``1 / HOT_SHARE`` of all
words (all of it, if there is none), so a frequent word or run never gathers in one task; what is then
partial is added up by a combining aggregate. Ranks use Spark's window group limit:
each task passes on ``top`` rows a language at most.

Defined results: NULL and empty texts have no pieces; repeated rows count as often as they occur;
texts of any length are read whole (one text is never split over tasks); further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shoplens.llm.arrow import binary, lower_ascii, mix64, span_hashes, spread, text_slices
from shoplens.llm.store import stored

LONGEST = 4
LEAST = 30
TOP = 2_000
INSIDE = (80, 100)
UNDETERMINED = "und"
#: Two-byte tokens 1 .. CODES; 0 opens a ten-byte token.
CODES = 65_000
BITMAP_BITS = 24
HOT_SHARE = 2_000
SLICE = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


class Pieces:
    """The words of the texts of one language in a slice: a string array and the piece of each word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = _GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        inside = ~gap[1:-1]
        self.starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        breaks = np.cumsum(_BREAK[data])
        self.piece = breaks[self.starts] + np.searchsorted(off, self.starts, "right") if n else self.starts
        self.data = data
        lens = self.ends - self.starts
        self.words = binary(data[spread(self.starts, lens)], np.cumsum(lens), pa.string())

    def hashes(self, at: np.ndarray, lang: str, seed: int) -> np.ndarray:
        own = np.frombuffer(lang.encode(), np.uint8)
        salt = span_hashes(own, np.array([0]), np.array([len(own)]))[0] if len(own) else np.uint64(0)
        h = span_hashes(self.data, self.starts[at], self.ends[at])
        return mix64(h ^ mix64(np.atleast_1d(salt + np.uint64(seed * 2 + 1)))[0])


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Pieces]]:
    for rb, data, off in text_slices(batches, SLICE):
        if not len(off) - 1:
            continue
        low = lower_ascii(data)
        langs = rb.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        lens = np.diff(off)
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == c)
            at = low if len(rows) == len(codes) else low[spread(off[rows], lens[rows])]
            yield lang, Pieces(at, np.concatenate([[0], np.cumsum(lens[rows])]))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    # Batches of one language each would be better still; slices of some megabytes are close to it.
    return docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("lang")).where(F.length("text") > 0)


def vocabulary(docs: DataFrame, seed: int = 0, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, id, n) of all words; the ids are 64-bit hashes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, p in _by_lang(batches):
            got = p.words.dictionary_encode()
            codes = got.indices.to_numpy(zero_copy_only=False)
            first = np.full(len(got.dictionary), len(codes), np.int64)
            np.minimum.at(first, codes, np.arange(len(codes)))
            n = np.bincount(codes, minlength=len(got.dictionary))
            ids = p.hashes(first, lang, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), got.dictionary, pa.array(ids), pa.array(n)], ["lang", "word", "id", "n"])

    rows = _texts(docs, lang_col, text_col).mapInArrow(count, "lang string, word string, id long, n long")
    return rows.groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("n"))


def proved_vocabulary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, int]:
    """The stored vocabulary and the seed for which no two of its words share an id."""
    seed = 0
    while True:
        words = stored(vocabulary(docs, seed, lang_col, text_col), "phrase-words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def token_table(words: DataFrame, least: int = LEAST, codes: int = CODES) -> dict:
    """What tasks need of the vocabulary, of bounded size: coded words by language, the limit of hot codes, the bitmap."""
    often = words.where(F.col("n") >= least)
    level = F.floor(16 * F.log2("n"))
    left, lowest, any_word = codes, None, words.agg(F.sum("n").alias("n")).first().n or 0
    for r in sorted(often.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        lowest = r.level
    top = [] if lowest is None else often.where(level >= lowest).select("lang", "word", "n").collect()
    top.sort(key=lambda r: (-r.n, r.lang, r.word))
    bits = BITMAP_BITS
    slot = F.shiftrightunsigned("id", 64 - bits)
    marks = often.groupBy((slot / 64).cast("int").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(id, {64 - bits}) % 64 as int)))").alias("m")).collect()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    for r in marks:
        bitmap[r.at] = r.m & 0xFFFFFFFFFFFFFFFF
    by_lang: dict[str, tuple[list, list]] = {}
    for code, r in enumerate(top, 1):
        held = by_lang.setdefault(r.lang, ([], []))
        held[0].append(r.word)
        held[1].append(code)
    return {"coded": {k: (pa.array(w, pa.string()), np.array(c, np.int64)) for k, (w, c) in by_lang.items()}, "bitmap": bitmap,
            "hot": sum(r.n * HOT_SHARE >= any_word for r in top), "words": [(r.lang, r.word) for r in top]}


def _tokens(lang: str, p: Pieces, table: dict, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, id, rare) per word: code 1 .. CODES, or 0 and an id; rare words can't be part of a phrase."""
    n = len(p.words)
    code = np.zeros(n, np.int64)
    if lang in table["coded"]:
        words, codes = table["coded"][lang]
        at = pc.index_in(p.words, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        code = np.where(at >= 0, codes[at], 0)
    ids = np.zeros(n, np.uint64)
    open_ = np.flatnonzero(code == 0)
    ids[open_] = p.hashes(open_, lang, seed)
    slot = (ids[open_] >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    rare = np.zeros(n, bool)
    rare[open_] = (table["bitmap"][slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 0
    return code, ids, rare


def edges(docs: DataFrame, table: dict, seed: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(deal, gram, n): the weighted edges, as sums of slices; ``deal`` is the hash they are dealt by."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for lang, p in _by_lang(batches):
            code, ids, rare = _tokens(lang, p, t, seed)
            n = len(code)
            if not n:
                continue
            # How many words the edge at each position has: up to the piece's end or the next rare word.
            stop = np.concatenate([np.flatnonzero(np.r_[p.piece[1:] != p.piece[:-1], True]) + 1, np.flatnonzero(rare)])
            stop.sort()
            here = np.arange(n)
            size = np.minimum(stop[np.searchsorted(stop, here, "right")] - here, LONGEST)
            size[rare] = 0
            at = np.flatnonzero(~rare)
            width = np.where(code > 0, 2, 10)
            ends = np.concatenate([[0], np.cumsum(width)])
            stream = np.zeros(ends[-1], np.uint8)
            short = code > 0
            stream[ends[:-1][short]] = code[short] >> 8
            stream[ends[:-1][short] + 1] = code[short] & 255
            stream[(ends[:-1][~short] + 2)[:, None] + np.arange(8)] = ids[~short].astype(">u8").view(np.uint8).reshape(-1, 8)
            lens = ends[at + size[at]] - ends[at]
            # Dealt by the shortest prefix with a word that is not hot.
            mixed = mix64(np.where(short, code.astype(np.uint64), ids))
            hot = short & (code <= t["hot"])
            deal, going = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
            for k in range(LONGEST):
                take = np.flatnonzero(going & (size[at] > k))
                w = at[take] + k
                deal[take] = mix64(deal[take] * np.uint64(31) + mixed[w])
                going[take] = hot[w]
            grams = binary(stream[spread(ends[at], lens)], np.cumsum(lens))
            rows = pa.table({"deal": (deal >> np.uint64(33)).astype(np.int32), "gram": grams})
            yield from rows.group_by(["deal", "gram"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["deal", "gram", "n"]).to_batches()

    return _texts(docs, lang_col, text_col).mapInArrow(emit, "deal int, gram binary, n long")


def _flow(hot: int, least: int):
    """Counts of all runs of words from sorted edges, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = rb.num_rows
            if not rows:
                continue
            gram = rb.column("gram")
            off = np.frombuffer(gram.buffers()[1], np.int32)[gram.offset:gram.offset + rows + 1].astype(np.int64)
            data = np.concatenate([np.frombuffer(gram.buffers()[2], np.uint8), np.zeros(10, np.uint8)])
            n = rb.column("n").to_numpy()
            at, end = off[:-1].copy(), off[1:]
            new = np.zeros(rows, bool)
            new[0] = True
            whole = np.zeros(rows, bool)                # the prefix holds a word that is not hot
            for k in range(1, LONGEST + 1):
                have = at < end
                here = np.minimum(at, len(data) - 10)
                code = data[here].astype(np.int64) << 8 | data[here + 1]
                long = code == 0
                token = code.astype(np.uint64)
                if long.any():
                    raw = data[here[long][:, None] + np.arange(2, 10)]
                    token[long] = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
                at = np.where(have, at + np.where(long, 10, 2), at)
                token = np.where(have, token, np.uint64(0))
                new[1:] |= (token[1:] != token[:-1]) | (have[1:] != have[:-1]) | (long[1:] != long[:-1])
                whole |= have & (long | (code > hot))
                first = np.flatnonzero(new)
                sums = np.add.reduceat(n, first)
                keep = have[first] & (~whole[first] | (sums >= least))
                keep[0], keep[-1] = have[first[0]], have[first[-1]]       # may go on in the batches around
                r = first[keep]
                lens = at[r] - off[:-1][r]
                yield pa.RecordBatch.from_arrays([binary(data[spread(off[:-1][r], lens)], np.cumsum(lens)), pa.array(np.full(len(r), k, np.int32)), pa.array(sums[keep])], ["gram", "m", "f"])
    return run


def grams(docs: DataFrame, table: dict, seed: int, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(gram, m, f): all runs of 1 to LONGEST words that occur ``least`` times or more, in tokens."""
    dealt = edges(docs, table, seed, lang_col, text_col).repartition("deal").sortWithinPartitions("gram").select("gram", "n")
    runs = dealt.mapInArrow(_flow(table["hot"], least), "gram binary, m int, f long")
    return runs.groupBy("gram", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


_HEAD = "if(substring(gram, 1, 2) = X'0000', 10, 2)"                  # bytes of the first token


def _with_ends(rows: DataFrame) -> DataFrame:
    """``ends``: the byte at which each token of a gram ends."""
    step = "aggregate(sequence(1, m), array(0), (e, k) -> concat(e, array(element_at(e, -1) + if(substring(gram, element_at(e, -1) + 1, 2) = X'0000', 10, 2))))"
    return rows.withColumn("ends", F.expr(f"slice({step}, 2, m)"))


def _unary_links(rows: DataFrame) -> DataFrame:
    """(gram, next): an edge and the one edge on into which its whole weight flows."""
    tail = F.expr(f"substring(gram, {_HEAD} + 1)")
    head = F.expr(f"substring(gram, 1, element_at(ends, {LONGEST - 1}))")
    full = rows.where(F.col("m") == LONGEST)
    out = full.select(F.col("gram").alias("edge"), tail.alias("node"), F.col("f").alias("weight"))
    into = full.select(F.col("gram").alias("next"), head.alias("node"), F.col("f").alias("weight"))
    nodes = rows.where(F.col("m") == LONGEST - 1).select(F.col("gram").alias("node"), F.col("f").alias("weight"))
    return out.join(into, ["node", "weight"]).join(nodes, ["node", "weight"], "left_semi").select("edge", "next", "node")


def compacted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary paths by pointer doubling: (edge, last, hops) and the nodes that lie within a path.

    ``last`` is the path's last edge and ``hops`` the edges up to it; each round doubles the reach, so
    their number grows with the logarithm of the longest path. Pieces are finite, so no path is a circle.
    """
    links = stored(_unary_links(rows), "phrase-links")
    now = links.select("edge", F.col("next").alias("last"), F.lit(1).alias("hops"))
    while True:
        ahead = now.select(F.col("edge").alias("last"), F.col("last").alias("then"), F.col("hops").alias("more"))
        far = stored(now.join(ahead, "last", "left").select("edge", F.coalesce("then", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                                                              F.col("then").isNotNull().alias("moved")), "phrase-paths")
        now = far.drop("moved")
        if far.where("moved").isEmpty():
            return now, links.select(F.col("node").alias("gram")).distinct()


def _phrases(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``rows`` (with ``gram`` and ``ends``) with their language and their words, joined by blanks."""
    spelled = words.where(F.col("n") >= least).select("token", "lang", "word")
    tokens = F.expr("transform(ends, (e, i) -> struct(i as i, substring(gram, if(i = 0, 0, ends[i - 1]) + 1, e - if(i = 0, 0, ends[i - 1])) as token))")
    parts = rows.select("gram", F.explode(tokens).alias("t")).select("gram", "t.i", "t.token")
    # A gram has LONGEST words at most, so the lists here are short.
    text = (parts.join(spelled, "token").groupBy("gram")
            .agg(F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("phrase")))
    return rows.join(text, "gram")


def collocations(rows: DataFrame, inner: DataFrame, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """(gram, m, a, l, r, score) of the candidates among ``rows`` that no longer candidate covers."""
    rows = _with_ends(rows)
    longer = rows.where("m > 1").select("m", "f", F.explode(F.array(
        F.expr("substring(gram, 1, element_at(ends, m - 1))"), F.expr(f"substring(gram, {_HEAD} + 1)"))).alias("gram"))
    around = longer.groupBy("gram").agg(F.max("f").alias("most"))
    own = rows.where("m > 1").join(inner, "gram", "left_anti").join(around, "gram", "left")
    own = own.where(F.col("most").isNull() | ~(F.lit(inside[1]) * F.col("most") >= F.lit(inside[0]) * F.col("f"))).withColumnRenamed("f", "a")
    cuts = own.select("gram", "a", "ends", F.posexplode(F.expr("slice(ends, 1, m - 1)")).alias("k", "e"))
    cuts = cuts.select("gram", "a", "k", F.expr("substring(gram, 1, e)").alias("first"), F.expr("substring(gram, e + 1)").alias("rest"))
    count = rows.select(F.col("gram").alias("part"), "f")
    cut = (cuts.join(count.withColumnsRenamed({"part": "first", "f": "l"}), "first").join(count.withColumnsRenamed({"part": "rest", "f": "r"}), "rest"))
    score = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as long)")
    best = cut.groupBy("gram").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return own.select("gram", "m", "ends", "a").join(best, "gram").select("gram", "m", "ends", "a", "c.l", "c.r", "c.score")


def _token_column(words: DataFrame, table: dict) -> DataFrame:
    """The vocabulary's words with their tokens; the codes come as a table of bounded size."""
    spark = words.sparkSession
    coded = spark.createDataFrame([(lang, w, c) for c, (lang, w) in enumerate(table["words"], 1)], "lang string, word string, code int")
    token = F.expr("unhex(if(code is null, concat('0000', lpad(hex(id), 16, '0')), lpad(hex(code), 4, '0')))")
    return words.join(coded, ["lang", "word"], "left").withColumn("token", token)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: tuple[int, int] = INSIDE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    words, seed = proved_vocabulary(docs, lang_col, text_col)
    table = token_table(words, least)
    rows = stored(grams(docs, table, seed, least, lang_col, text_col), "phrase-grams")
    _, inner = compacted(_with_ends(rows))
    found = _phrases(collocations(rows, inner, inside), _token_column(words, table), least)
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def paths(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, n_words, f) of the unary paths: fixed expressions of any length.

    A path's words are those of its first edge and the last word of each edge after it.
    """
    words, seed = proved_vocabulary(docs, lang_col, text_col)
    table = token_table(words, least)
    rows = stored(_with_ends(grams(docs, table, seed, least, lang_col, text_col)), "phrase-grams")
    hops, _ = compacted(rows)
    ends = hops.select(F.col("last").alias("gram")).distinct().select("gram", F.col("gram").alias("last"), F.lit(0).alias("hops"))
    members = hops.select(F.col("edge").alias("gram"), "last", "hops").unionByName(ends)
    spelled = _phrases(rows.where(F.col("m") == LONGEST).join(members, "gram"), _token_column(words, table), least)
    # A path is a piece's part at most, so its list of words is no longer than a piece.
    line = spelled.groupBy("last", "lang", "f").agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "phrase"))).alias("p"))
    text = F.expr("concat_ws(' ', p[0].phrase, transform(slice(p, 2, size(p)), x -> substring_index(x.phrase, ' ', -1)))")
    return line.select("lang", text.alias("phrase"), (F.size("p") + LONGEST - 1).alias("n_words"), "f")


#: The query in DuckDB SQL: all runs of words are counted as lists.
ORACLE_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
lists as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces),
runs as (
  select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase
  from lists, (select unnest([1, 2, 3, 4]) as m)),
f as (select lang, m, phrase, count(*) as f from runs group by all having count(*) >= 30),
sizes as (select lang, sum(len(ws))::bigint as n from lists group by lang),
split as (select lang, m, phrase, f, string_split(phrase, ' ') as ws from f),
longer as (
  select lang, part, max(f) as most from (
    select lang, f, unnest([array_to_string(ws[1:m - 1], ' '), array_to_string(ws[2:m], ' ')]) as part from split where m > 1
    union all select lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' ')]) from split where m = 4)
  group by lang, part),
own as (select s.* from split s left join longer x on x.lang = s.lang and x.part = s.phrase where m > 1 and (most is null or 100 * most < 80 * f)),
cuts as (select lang, phrase, f as a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:m], ' ') as tail
  from own, (select unnest([1, 2, 3]) as k) where k < m),
scores as (
  select c.*, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f + y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail),
best as (select lang, phrase, a, arg_min(l, score * 4 + k) as l, arg_min(r, score * 4 + k) as r, min(score) as score from scores group by all),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""
