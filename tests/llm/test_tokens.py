"""Token counts, coded ids, packing and piece encoding, against the libraries."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tributary.llm import nnls_packing, simple8b, suffix_pieces, token_cache  # noqa: E402
from tributary.llm.common import fresh_path  # noqa: E402
from tributary.llm.vocab import MemoTokenizer  # noqa: E402

from .conftest import rows  # noqa: E402

BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = "ab CD'stéßŁ\n\n\t  .,!9²½日本▁the ing <|endoftext|>İ'reLL \x1c_-\x00𝔘 ²."


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a<|endoftext|>b", "", " ", "  ", "▁"]


@lru_cache
def loaded(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_is_the_library(path):
    memo, texts = MemoTokenizer(path, capacity=200), odd_texts(600)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert [x.tolist() for x in memo.encode(part)] == [library(path, t) for t in part]
        assert memo.count(part) == [len(library(path, t)) for t in part]


def test_counts_and_cache(spark, docs, nothing, table):
    cache = fresh_path(spark, "test-cache")
    got = token_cache.count_tokens(docs, BYTE, cache).collect()
    want = sorted((i if i is not None else -99, len((t or "").encode()), len(library(BYTE, t))) for i, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in rows()})
    again = token_cache.count_tokens(docs, BYTE, cache).collect()  # all hits: nothing is appended
    assert sorted(map(repr, again)) == sorted(map(repr, got)) and spark.read.parquet(cache).count() == stored
    more = token_cache.count_tokens(docs.limit(0).unionByName(docs.selectExpr("doc_id", "concat(coalesce(text, ''), '!') text", *docs.columns[2:])), BYTE, cache)
    assert more.count() == len(rows()) and spark.read.parquet(cache).count() > stored
    assert token_cache.count_tokens(docs, WORD, cache).count() == len(rows())  # another version's counts don't serve
    assert token_cache.count_tokens(nothing, BYTE, fresh_path(spark, "test-cache")).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(120):
        n = int(rng.integers(0, 700))
        v = rng.integers(0, 2 ** int(rng.integers(1, 63)), n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        if n and k % 3 == 0:  # escapes, some of which look like selectors
            v[rng.integers(0, n, 6)] = np.array([2**64 - 1, 2**60, 2**63, 2**61 + 5, 2**60 - 1, 0], np.uint64)
        segment = simple8b.encode(v)
        assert (simple8b.decode(segment) == v).all()
        if n > 300:
            assert (simple8b.decode(segment, 1, 2) == v[128:256]).all()
    assert len(simple8b.encode(np.zeros(6000, np.uint64))) < 6000 / 60 * 8 + 6000 / 128 * 28 + 20
    with pytest.raises(ValueError):
        simple8b.decode(b"none of it")


def coded(texts):
    at, out = 0, []
    for i, t in texts:
        ids = [*library(BYTE, t), 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_coded_ids(docs, nothing, table):
    got = sorted(map(tuple, simple8b.coded_ids(table, BYTE).collect()))
    assert got == coded(sorted((r.doc_id, r.text) for r in table.collect()))
    mine = simple8b.coded_ids(docs, BYTE).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in mine) == sorted(x[2:] for x in coded([(i, t) for i, t, *_ in rows()]))
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in mine)
    assert starts[0][2] is None and [s[0] for s in starts] == np.cumsum([0, *(s[1] for s in starts[:-1])]).tolist()
    assert [s[2] for s in starts[1:]] == sorted(s[2] for s in starts[1:])
    assert simple8b.coded_ids(nothing, BYTE).count() == 0


def check_packing(pieces, docs, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at & (at - 1) == 0  # no padding at all
    for i, t in docs.items():
        ids, at = np.array([*library(WORD, t), 1], "<u4"), 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc


def test_packing(docs, nothing, table):
    check_packing(nnls_packing.pack(table, WORD).collect(), {r.doc_id: r.text for r in table.collect()})
    unique = docs.where("doc_id <> 17 or doc_id is null")
    check_packing(nnls_packing.pack(unique, WORD).collect(), {i: t for i, t, *_ in rows() if i != 17})
    assert len({(p.sequence_id, p.offset) for p in nnls_packing.pack(docs.where("doc_id = 17"), WORD).collect()}) >= 2
    assert nnls_packing.pack(nothing, WORD).count() == 0


def test_nnls_and_place():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, x = rng.random((12, 8)), np.maximum(0, rng.normal(size=8))
        got = nnls_packing.nnls(a, a @ x)
        assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
        b = rng.normal(size=12)
        z = nnls_packing.nnls(a, b)
        slope = a.T @ (b - a @ z)
        assert (slope <= 1e-6).all() and np.allclose(slope[z > 0], 0, atol=1e-6)
    lengths = (rng.pareto(1.1, 3000) * 200 + 1).astype(int).tolist()
    hist = np.zeros(nnls_packing.BINS)
    for n in lengths:
        if n % 2048:
            hist[-(-(n % 2048) // 32) - 1] += 1
    pieces = nnls_packing.place(lengths, 2048, nnls_packing.solve(hist), hist.sum())
    filled = defaultdict(int)
    for _, _, n, seq, _ in pieces:
        filled[seq] += n
    assert sum(filled.values()) == sum(lengths) and sum(v != 2048 for v in filled.values()) <= 11
    whole = sum(1 for d, s, n, _, _ in pieces if n == lengths[d])
    assert whole > 0.5 * sum(n < 2048 for n in lengths)  # most rests stay in one piece


def test_pieces_are_the_library(spark, docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    e = suffix_pieces.Encoder(suffix_pieces.load(PIECE), capacity=500)
    texts = odd_texts(800, 9) + ["x" * 300, " " * 77 + "the", *(t or "" for _, t, *_ in rows())]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for t, raw, want in zip(part, e.encode(part), sp.encode(part)):
            ids = np.frombuffer(raw, "<u4")
            assert ids.tolist() == want, t
            assert suffix_pieces.decode(e.v, ids) == sp.decode(want) == t.replace("▁", " ")
    got = suffix_pieces.encoded_and_decoded(docs, PIECE).collect()
    assert all(r.round_trip for r in got)
    assert sorted((r.n_pieces, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in (sp.encode(t or "") for _, t, *_ in rows()))
    assert {r.doc_id: r.ids for r in suffix_pieces.encoded(docs, PIECE).collect()}[11] == sp.encode("a")
    assert suffix_pieces.encoded_and_decoded(nothing, PIECE).count() == 0


def test_occurrences_by_brute_force():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 300)
    order = suffix_pieces.suffix_order(text, 8)
    assert all(text[a : a + 8].tolist() <= text[b : b + 8].tolist() for a, b in zip(order, order[1:]))
    words = [rng.integers(1, 4, int(n)) for n in rng.integers(1, 7, 50)]
    rows_ = np.full((50, 6), -1)
    for i, w in enumerate(words):
        rows_[i, : len(w)] = w
    low, high = suffix_pieces.occurrences(text, order, rows_, np.array([len(w) for w in words]))
    for w, a, b in zip(words, low, high):
        want = [i for i in range(len(text) - len(w) + 1) if (text[i : i + len(w)] == w).all()]
        assert sorted(order[a:b].tolist()) == want
