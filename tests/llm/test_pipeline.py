import math
import re

import pytest

from tributary.llm import ppm, weak_quality
from tributary.llm.common import stored
from tributary.llm.queries import learnable

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, docs, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]
    for frame in (docs, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() >= frame.count()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    kept = got.select("doc_id").distinct().count()
    assert 0.5 * n < kept <= n
    assert got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0


def planted(spark, sf_dir):
    """The smallest table's documents with null and repeated ids, exact and near copies."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [r for r in rows if len((r[1] or "").split()) > 120][:8]
    extra = []
    for k, (i, text, lang, source, n) in enumerate(long):
        words = text.split(" ")
        extra += [(5000 + k, text, lang, source, n), (None, text, lang, source, n), (6000 + k, " ".join(["Begin", *words[3:]]), lang, source, n)]
        extra += [(i, text, lang, source, n)] * 2 + [(i, " ".join(reversed(words)), lang, source, n), (None, " ".join(words[: len(words) // 2]), lang, source, n)]
    extra += [(7000, None, None, None, None), (7001, "", "en", None, 0), (7002, "a b", "en", "s", 3)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def near_groups(texts):
    """Of distinct texts the connected groups at four fifths of five-word shingles or more."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_kept_rows_of_every_stage(spark, sf_dir):
    """Each stage's rows, as (id, text), are what a plain loop over its input keeps."""
    stage = dict(corpus_pipeline.STAGES)
    docs = planted(spark, sf_dir)

    model = weak_quality.train(docs)
    features = weak_quality.Features()

    def good(text):
        which, values = features((text or "").encode())
        return 1 / (1 + math.exp(-(sum(model.weights[i] * v for i, v in zip(which, values)) + model.weights[-1]))) >= 0.3

    kept = stored(stage["quality_classifier"](spark, docs, sf_dir), "one")
    assert pairs(kept) == [p for p in pairs(docs) if good(p[1])] and 0 < kept.count() < docs.count()

    languages = ppm.train(kept.where(learnable()))
    scorer = ppm.Scorer(languages)

    def known(text):
        if text is None or not any(c.isalpha() for c in text):
            return False
        return scorer.bits([text.encode()])[0].min() / len(text.encode()) <= 7.0

    before, kept = kept, stored(stage["language_id"](spark, kept, sf_dir), "two")
    assert pairs(kept) == [p for p in pairs(before) if known(p[1])]

    winners = {}
    for i, text in pairs(kept):
        winners[text] = i if winners.get(text) is None else max(winners[text], i if i is not None else winners[text])
    kept = stored(stage["exact_dedup"](spark, kept, sf_dir), "three")
    assert pairs(kept) == sorted(((i, t) for t, i in winners.items()), key=str)

    rows = pairs(kept)
    labels, least = near_groups([t for _, t in rows]), {}
    for label, row in zip(labels, rows):
        least.setdefault(label, []).append(row)
    groups = list(least.values())
    assert any(len(g) > 1 for g in groups)
    kept = stored(stage["simhash_near_dedup"](spark, kept, sf_dir), "four")
    found = pairs(kept)
    assert len(found) == len(groups)
    for group in groups:  # the smallest id; among null ids any one
        (row,) = [r for r in group if r in found]
        ids = [i for i, _ in group if i is not None]
        assert row[0] == (min(ids) if ids else None)

    pieces = stage["packing"](spark, kept, sf_dir).toPandas()
    assert pieces.groupby("doc_id", dropna=False)["length"].sum().sum() == pieces[pieces["start"] == 0]["doc_tokens"].sum()
    assert sorted(pieces[pieces["start"] == 0]["doc_id"].dropna().astype(int)) == sorted(i for i, _ in found if i is not None)
