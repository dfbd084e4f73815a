import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoplens.llm import bpe, simple8b, token_files
from shoplens.llm.lexicon import Lexicon, compile_lexicon
from shoplens.llm.registry import BYTE_BPE, END_ID, WORD_BPE
from tests.llm.util import EDGE, empty, frame, key

ODD = ["", " ", "a  b", " lead", "trail ", "x\n\ny", "a \n b", "it's we'll 'tis", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|startoftext|>", "É́ é ΣΑΣ ΟΔΟΣ",
       "\x1c\x1d a\x85b\xa0c", "123 4567 ١٢٣ Ⅷ ²", "!!! ??? $$$", "a" * 3000, "👩‍👩‍👧 ok", "tab\tsep \t x", "\x00\x01", "ab" * 300 + " " + "x" * 70, "ß.,ñ! ÀÉ."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 60) - 1)), max_size=700))
def test_simple8b_round_trip(values):
    words = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words)[:len(values)].tolist() == values


def test_simple8b_packs_and_refuses():
    assert len(simple8b.encode(np.zeros(2400, np.uint64))) == 10
    with pytest.raises(ValueError):
        simple8b.encode(np.array([1 << 60], np.uint64))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_lexicon_finds_its_words_only(entries, others):
    lexicon = Lexicon(compile_lexicon(entries))
    words = [*entries, *others]
    data, ends = np.frombuffer(b"".join(words) or b"\0", np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64)
    got = lexicon.find(data, np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends, ends)
    for w, n in zip(words, got):
        assert (n >= 0) == (w in entries)
        if n >= 0:
            assert lexicon.ids[lexicon.offs[n]:lexicon.offs[n + 1]].tolist() == entries[w]


def test_lexicon_shares_suffixes():
    from shoplens.llm.lexicon import _minimal_states

    words = sorted(a + b"tioning" for a in (b"xa", b"yb", b"zc"))
    arcs, _, _ = _minimal_states(words)
    assert len(arcs) < 3 * 3 + 8


@pytest.mark.parametrize("lexicon_words", [[], ["a", " b", " c", "x", " lead", " ok", "it's", " the"]])
def test_bpe_equals_library_on_odd_texts(lexicon_words):
    lib, own = Tokenizer.from_file(BYTE_BPE), bpe.load_bpe(BYTE_BPE)
    coder = bpe.Encoder(BYTE_BPE, compile_lexicon({w.encode(): own.word(w) for w in lexicon_words}))
    ids, count = coder.encode(pa.array([*ODD, None]))
    for text, a, b in zip([*ODD, ""], np.cumsum(count) - count, np.cumsum(count)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, text
        assert own.decode(ids[a:b]).decode() == lib.decode(want, skip_special_tokens=False)


def test_bpe_decode_replaces_invalid_utf8():
    lib, own = Tokenizer.from_file(BYTE_BPE), bpe.load_bpe(BYTE_BPE)
    for ids in ([244, 1, 50256], [160], [35, 187, 35]):
        assert own.decode(np.array(ids)).decode() == lib.decode(ids, skip_special_tokens=False)


def test_bpe_query_columns(spark):
    lib, docs = Tokenizer.from_file(BYTE_BPE), frame(spark, EDGE)
    coded = bpe.encode(docs, BYTE_BPE, bpe.build_lexicon(docs, BYTE_BPE, words=50), decode=True).cache()
    want = []
    for i, t in EDGE:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(bpe.digests(coded).collect()) == key(want)
    assert key(bpe.decode(coded, BYTE_BPE).collect()) == key((i, t or "") for i, t in EDGE)
    none = empty(spark)
    assert bpe.digests(bpe.encode(none, BYTE_BPE, bpe.build_lexicon(none, BYTE_BPE), decode=True)).count() == 0


def test_lexicon_size_is_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(200)], "doc_id long, text string")
    blob = bpe.build_lexicon(docs, BYTE_BPE, words=7)
    assert 1 <= len(Lexicon(blob).offs) - 1 <= 7


@pytest.mark.parametrize("by_words", [True, False])
def test_word_pieces_equal_library(by_words):
    lib = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, "ﬁ Å ǅ İ", "x̀́ y", "a ́b"]
    ids, count = token_files._encode(pa.array(texts), WORD_BPE, by_words)
    for text, a, b in zip(texts, np.cumsum(count) - count, np.cumsum(count)):
        assert ids[a:b].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, scratch, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    lib = Tokenizer.from_file(WORD_BPE)
    path = f"file://{scratch}/tokens"
    token_files.write_tokens(frame(spark, EDGE), path, WORD_BPE, END_ID)
    got = token_files.digests(token_files.read_tokens(spark, path)).collect()
    start, want = 0, []
    for i, t in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert key(got) == key(want)
    blocks = spark.read.schema(token_files.SCHEMA).parquet(path).collect()
    for b in blocks:                                   # any part of a block can be decoded on its own
        whole = token_files.decode_block(b.words, b.n_ids)
        for w, k in zip(b.word_offsets, b.id_offsets):
            assert simple8b.decode(np.frombuffer(b.words, "<u8")[w:w + 3]).tolist() == whole[k:k + len(simple8b.decode(np.frombuffer(b.words, "<u8")[w:w + 3]))].tolist()
    token_files.write_tokens(empty(spark), path + "-none", WORD_BPE, END_ID)
    assert token_files.read_tokens(spark, path + "-none").count() == 0


def test_tokenizer_paths_are_parameters():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
