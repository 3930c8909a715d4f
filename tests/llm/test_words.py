"""Encoding, packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chapterloom.llm import packing, textbytes as B, tokens
from chapterloom.llm.encoding import Encoder

from .helpers import alnum_words, no_docs, odd_docs, odd_rows, visible_words

BYTE, WORD = (Encoder(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
PIECES = [
    "a", "B", "é", "ñ", " ", "  ", "\n", ".", ",", "'s", "'", " ", "　", " ", "1", "12", "!", "?", "<|", "<|endoftext|>",
    "的", "한", "и", "😀", "́", "̸", "\t", "\r\n", "word", " the", "ß", "İ", "\u0085", "-", "_", "=", "\x00",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=8))
def test_chunks_encode_like_whole_texts(texts):
    raw, offsets = B.flat(pa.array(texts, pa.string()))
    for coder in (BYTE, WORD):
        ids, rows, _, _ = coder.encode(raw, offsets)
        for i, text in enumerate(texts):
            assert ids[rows[i] : rows[i + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=6))
def test_word_hashes_agree_with_words(texts):
    raw, offsets = B.flat(pa.array(texts, pa.string()))
    seen = {}
    for members, cut in ((B.ALNUM, alnum_words), (B.VISIBLE, visible_words)):
        hashes, first = B.word_hashes(raw, offsets, members)
        for i, text in enumerate(texts):
            words = cut(text)
            assert first[i + 1] - first[i] == len(words)
            for word, value in zip(words, hashes[first[i] : first[i + 1]].tolist()):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def _ids(path, text):
    coder = BYTE if "byte" in path else WORD
    return [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_tokens(odd_docs(spark), str(tmp_path / "t"), path)
    got = tokens.digests(tokens.read_tokens(spark, str(tmp_path / "t"))).orderBy("start").collect()
    start = 0
    for row, (doc_id, text, *_) in zip(
        got, sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True
    ):
        ids = _ids(path, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), _crc(ids))
        start += len(ids)
    found = tokens.find_tokens(spark, str(tmp_path / "t"), [104, 9999])
    assert [r.doc_id for r in found.collect()] == [104]
    assert "PushedFilters: [" in found._jdf.queryExecution().toString()
    tokens.write_tokens(no_docs(spark), str(tmp_path / "none"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_pieces_rebuild_every_document(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(odd_docs(spark), path).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        assert [p.offset for p in found] == list(np.cumsum([0, *(p.length for p in found[:-1])]))
        size = sum(p.length for p in found)
        assert size <= 2048 and all(p.padded == (size if size & (size - 1) == 0 else 2048) for p in found)
    rows = odd_rows()
    assert sum(p.length for p in pieces) == sum(len(_ids(path, r[1])) for r in rows)
    for doc_id, text, *_ in rows:
        ids = _ids(path, text)
        cuts = {(p.start, p.length, p.ids_crc32) for p in by_doc[doc_id, len(ids)]}
        assert all(_crc(ids[a : a + n]) == crc for a, n, crc in cuts)
        assert sorted({i for a, n, _ in cuts for i in range(a, a + n)}) == list(range(len(ids)))
    assert packing.pack(no_docs(spark), path).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        at = [0]
        for _ in range(rng.randint(1, 14)):
            at.append(at[-1] + rng.choice([3, 16, 64, 128, rng.randint(1, 200)]))
        cost = [0] + [rng.choice([0, 4, 24]) for _ in at[1:]]
        window = 256

        def price(i, j):
            size = at[j] - at[i]
            pad = 0 if size >= 128 and size & (size - 1) == 0 else window - size
            return pad + cost[j] + packing.WINDOW_COST

        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + price(i, j) for i in range(j) if at[j] - at[i] <= window)
        cuts = [0, *packing.best_cuts(at, cost, window)]
        assert sum(price(i, j) for i, j in zip(cuts[:-1], cuts[1:])) == best[-1]
