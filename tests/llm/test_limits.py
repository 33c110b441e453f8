"""Long texts, and batches of any size, through every operator."""

import zlib

import pyarrow as pa
import pytest

from tributary.llm import chunk_dedup, common, mincut_html, nnls_packing, ppm, simhash, simple8b, suffix_pieces, token_cache, transport_stream, weak_quality

P = pytest.importorskip("public_tokenizers")
BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_slices():
    texts = ["a" * n for n in (1, 5, 3, 40, 0, 2, 2)] + [None, "b" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], names=["t", "k"])
    for rows, size in ((100, 8), (2, 1000), (1, 1), (100, 1 << 30), (3, 41)):
        parts = list(common.slices([batch, batch.slice(0, 0), batch.slice(3, 4)], "t", rows, size))
        assert [x for p in parts for x in p.column("k").to_pylist()] == [*range(9), 3, 4, 5, 6]
        for p in parts:
            assert 0 < p.num_rows <= rows and (p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= size)


@pytest.fixture(scope="module")
def long_docs(spark):
    words = [f"word{i * 7919 % 30011}" for i in range(100_000)]
    long = " ".join(words) + ". "
    rows = [(1, long, "en"), (2, long + "and one more", "en"), (3, None, None), (4, "short one", "en"), (5, "x" * 1_000_000, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1), {i: t or "" for i, t, _ in rows}


def test_operators_do_not_touch_the_session(spark, long_docs):
    """Frames are built, then the largest batches are set, then they run; long texts are whole."""
    docs, texts = long_docs
    before = spark.conf.get(ROWS)
    model = ppm.train(docs)
    quality = weak_quality.train(docs)
    built = {
        "media": transport_stream.stream_features(transport_stream.store_streams(docs)),
        "ids": simple8b.coded_ids(docs, BYTE),
        "pieces": suffix_pieces.encoded_and_decoded(docs.where("doc_id <> 5"), PIECE),
        "packed": nnls_packing.pack(docs, WORD),
        "counts": token_cache.count_tokens(docs, BYTE, common.fresh_path(spark, "cache")),
        "near": simhash.near_groups(docs),
        "exact": chunk_dedup.exact_groups(docs),
        "language": docs.select("doc_id", ppm.identify(spark, model, docs["text"]).alias("x")),
        "quality": docs.select("doc_id", weak_quality.quality(spark, quality, docs["text"]).alias("x")),
    }
    assert spark.conf.get(ROWS) == before
    spark.conf.set(ROWS, "10000")
    try:
        got = {name: {r.doc_id: r for r in df.collect()} for name, df in built.items() if name != "packed"}
        pieces = built["packed"].collect()
    finally:
        spark.conf.set(ROWS, before)
    size = {i: len(t) for i, t in texts.items()}
    assert {i: r.n_bytes for i, r in got["media"].items()} == size and all(r.status == "ok" for r in got["media"].values())
    assert {i: r.n_bytes for i, r in got["counts"].items()} == size
    assert {i: r.n_tokens for i, r in got["ids"].items()} == {i: r.n_tokens + 1 for i, r in got["counts"].items()}
    assert all(r.round_trip for r in got["pieces"].values())
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {p.doc_id: p.doc_tokens for p in pieces} and len(lengths) == 5
    assert got["near"][1].component_id == got["near"][2].component_id == 1 and got["near"][5].component_id == 5
    assert all(r.kept for r in got["exact"].values())
    assert got["language"][1].x.lang_pred == "en" and 0 <= got["quality"][1].x <= 1
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {1, 3, 4, 5}


def test_long_page():
    html = "<article>" + "".join(f"<p>Paragraph {i} of a page that goes on and on, for quite a while.</p>" for i in range(20_000)) + "</article><footer>end</footer>"
    text = mincut_html.main_text(html)
    assert text.count("\n") == 19_999 and text.endswith("for quite a while.")


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "one two"), ("7", "three"), (None, "four")], "doc_id string, text string")
    for frame in (simple8b.coded_ids(docs, BYTE), suffix_pieces.encoded_and_decoded(docs, PIECE), nnls_packing.pack(docs, WORD).select("doc_id", "doc_tokens").distinct(), simhash.near_groups(docs)):
        assert sorted(r.doc_id or 0 for r in frame.collect()) == [0, 0, 7]
    pages = docs.selectExpr("doc_id page_id", "'u' url", "text html")
    assert sorted(r.page_id or 0 for r in mincut_html.extracted(pages).collect()) == [0, 0, 7]
    for stage in (chunk_dedup.deduplicated, simhash.deduplicated):
        assert stage(docs).count() == 3


def test_cache_with_repeated_entries(spark, docs):
    """A retried or second writer stores entries twice: results stay one row a document."""
    path = common.fresh_path(spark, "cache")
    first = token_cache.count_tokens(docs, BYTE, path).collect()
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    assert sorted(map(repr, token_cache.count_tokens(docs, BYTE, path + "-twice").collect())) == sorted(map(repr, first))


def test_other_tokenizers_go_to_the_library(tmp_path):
    """A file with other rules takes no shortcut; a piece model with other rules is refused."""
    import json

    from tokenizers import Tokenizer

    from tributary.llm.vocab import MemoTokenizer

    with open(BYTE, encoding="utf-8") as f:
        stated = json.load(f)
    stated["normalizer"] = {"type": "Lowercase"}
    stated["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    (tmp_path / "other.json").write_text(json.dumps(stated), encoding="utf-8")
    memo = MemoTokenizer(str(tmp_path / "other.json"))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    library.no_truncation()
    for text in ("Some WORDS in Capitals", "", "naïve café"):
        assert memo.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECE, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="identity"):
        suffix_pieces.load(str(tmp_path / "other.model"))


def test_texts_are_checked_by_crc(spark, long_docs):
    """Coded ids of a long text are those of the library."""
    import numpy as np
    from tokenizers import Tokenizer

    docs, texts = long_docs
    row = simple8b.coded_ids(docs.where("doc_id = 2"), BYTE).first()
    ids = Tokenizer.from_file(BYTE).encode(texts[2], add_special_tokens=False).ids
    assert row.ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
