import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import ppm, queries, weak_quality


def slow_bits(train, text, order):
    """Code length by the definition, symbol by symbol, with exclusion."""
    zeros = bytes(order)
    seen = {k: {} for k in range(order + 1)}
    for t in (zeros + t for t in train):
        for i in range(order, len(t)):
            for k in seen:
                ctx = seen[k].setdefault(t[i - k : i], {})
                ctx[t[i]] = ctx.get(t[i], 0) + 1
    total, t = 0.0, zeros + text
    for i in range(order, len(t)):
        out = set()
        for k in range(order, -1, -1):
            ctx = {s: n for s, n in seen[k].get(t[i - k : i], {}).items() if s not in out}
            if not ctx:
                continue
            n, q = sum(ctx.values()), len(ctx)
            if t[i] in ctx:
                total -= np.log2(ctx[t[i]] / (n + q))
                break
            total -= np.log2(q / (n + q))
            out |= set(ctx)
        else:
            total += np.log2(256 - len(out))
    return total


def frozen(corpora, order):
    lang, code = [], []
    for k, texts in corpora.items():
        for t in texts:
            c = ppm.strings(t, order)
            lang += [k] * len(c)
            code += c.tolist()
    rows, n = np.unique(np.array([lang, code], np.uint64), axis=1, return_counts=True)
    return ppm.freeze(["a", "b"][: len(corpora)], rows[0].astype(int), rows[1], n, order)


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 6])
def test_code_lengths_by_definition(order):
    corpora = {0: [b"the cat sat on the mat", b"then that", bytes(range(256))], 1: ["der Bär und die Öl".encode(), b"und der"]}
    scorer = ppm.Scorer(frozen(corpora, order))
    texts = [b"the mat", b"und", b"", "Öxyz\0".encode(), b"qqqq", bytes(range(256)), b"the cat sat on the mat"]
    for _ in range(2):  # the second time from the memo
        for t, row in zip(texts, scorer.bits(texts)):
            assert row.tolist() == pytest.approx([slow_bits(corpora[k], t, order) for k in (0, 1)], rel=1e-5, abs=1e-4)


def test_slices_add_up(monkeypatch):
    model = frozen({0: [b"the hat", b"that"]}, 3)
    texts = [b"the the" * 20, b"", b"h", b"zz" * 50, b""]
    whole = ppm.Scorer(model).bits(texts)
    monkeypatch.setattr(ppm, "SLICE", 7)
    monkeypatch.setattr(ppm, "MEMO_BYTES", 1)  # places are taken over again and again
    assert np.allclose(ppm.Scorer(model).bits(texts), whole)


def test_languages(spark, sf_dir, docs, nothing):
    got = queries.op8_ppm_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in held)
    model = ppm.train(docs.where(F.col("doc_id").isNotNull()))
    assert model.langs == ["de", "en"] and ppm.train(docs, languages=1).langs == ["en"]
    rows = {r.doc_id: r.x for r in docs.select("doc_id", ppm.identify(spark, model, F.col("text")).alias("x")).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 13))
    assert rows[17].lang_pred == "de" and rows[7].lang_pred == "en"
    empty = ppm.train(nothing)
    assert empty.langs == [] and {r[0] for r in docs.select(ppm.identify(spark, empty, F.col("text"))["lang_pred"]).collect()} == {"und"}


def test_ids_that_are_missing(spark, docs):
    assert docs.select(queries.held_out().alias("h"), queries.learnable().alias("l")).where("h is null or l is null or h and l").count() == 0
    assert docs.where("doc_id is null").where(queries.learnable()).count() == 0


def test_language_stage(docs, nothing):
    kept = ppm.accepted(docs, F.lit(True))
    assert kept.columns == docs.columns and not {1, 2, 3, 13} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 17").count() == 2
    assert ppm.accepted(nothing, F.lit(True)).count() == 0


FAULT_OF = tuple(1 + weak_quality.FAULTS.index(x.fault) for x in weak_quality.LABELLERS)


def planted(n=20_000, seed=1):
    """Texts that are good or have one of two faults, and three labellers for each fault."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=[0.8, 0.15, 0.05])
    hit, alarm = (0.95, 0.9, 0.7, 0.95, 0.9, 0.7), (0.001, 0.03, 0.1, 0.001, 0.02, 0.05)
    votes = np.zeros((n, 6), np.int64)
    for j in range(6):
        bad = rng.random(n) < np.where(kind == 1 + j // 3, hit[j], alarm[j])
        votes[:, j] = np.where(rng.random(n) < 0.9, np.where(bad, weak_quality.BAD, weak_quality.GOOD), weak_quality.NOTHING)
    return kind, votes, np.array(hit), np.array(alarm)


def test_em_finds_accuracies():
    kind, votes, hit, alarm = planted()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float), (1, 1, 1, 2, 2, 2))
    assert np.abs(model.shares - [0.8, 0.15, 0.05]).max() < 0.02
    assert np.abs(model.alarms[0] - alarm).max() < 0.02 and np.abs(model.alarms[1, :3] - hit[:3]).max() < 0.03
    right = np.mean([(v != 0) & ((v == weak_quality.GOOD) == (k == 0)) for k, v in zip(kind, votes)], 0) / (votes != 0).mean(0)
    assert np.abs(model.accuracy - right).max() < 0.02
    good = model.posterior(votes) > 0.5
    plain = ~(votes == weak_quality.BAD).any(1)
    assert np.mean(good == (kind == 0)) > 0.98 > np.mean(plain == (kind == 0)) + 0.05


def test_em_by_brute_force():
    """The same rounds over single texts instead of patterns, vote by vote."""
    _, votes, _, _ = planted(300, 2)
    fault = (1, 1, 1, 2, 2, 2)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    for rounds in (1, 4):
        p = []
        for v in votes.tolist():
            share = [sum(x == 1 for x, f in zip(v, fault) if f == k) / max(1, sum(x != 0 for x, f in zip(v, fault) if f == k)) for k in (1, 2)]
            raw = [0.01 + 1 - max(share), *(0.01 + x for x in share)]
            p.append([x / sum(raw) for x in raw])
        for _ in range(rounds):
            shares = [(sum(q[k] for q in p) + 1) / (len(p) + 3) for k in range(3)]
            rate = [[0.0] * 6 for _ in range(3)]
            for k in range(3):
                for j in range(6):
                    a, b = weak_quality.PRIORS[0] if k == 0 else weak_quality.PRIORS[1] if fault[j] == k else weak_quality.PRIORS[2]
                    a += sum(q[k] for q, v in zip(p, votes) if v[j] == 1)
                    b += sum(q[k] for q, v in zip(p, votes) if v[j] == 2)
                    rate[k][j] = a / (a + b)
            new = []
            for v in votes:
                raw = list(shares)
                for k in range(3):
                    for j in range(6):
                        raw[k] *= rate[k][j] if v[j] == 1 else 1 - rate[k][j] if v[j] == 2 else 1
                new.append([x / sum(raw) for x in raw])
            p = new
        model = weak_quality.fit_labels(patterns, counts.astype(float), fault, rounds)
        assert np.allclose(model.kinds(votes), p) and np.allclose(model.alarms, rate) and np.allclose(model.shares, shares)


def test_scorer_by_brute_force():
    texts = [b"one two two ab12!! " * 3, b"A B C", b"x", b"q" * 5 + b"#1" * 40]
    features = weak_quality.Features()
    pairs = [features(t) for t in texts]
    assert len(pairs[3][0]) > 2  # a long shape has several pieces
    assert features(b"#1" * 40 + b"a")[0].tolist() != features(b"#1" * 40 + b"Z")[0].tolist()
    assert all(np.isclose((v[i > 0] ** 2).sum(), 1) for i, v in pairs)
    target = np.array([1.0, 0.0, 0.3, 0.8])
    w, seen = {-1: 0.0}, {-1: 1e-8}
    for _ in range(5):
        slope = {k: 1e-5 * x for k, x in w.items()}
        for (index, value), y in zip(pairs, target):
            z = w[-1] + sum(w.get(i, 0.0) * v for i, v in zip(index.tolist(), value))
            error = (1 / (1 + np.exp(-z)) - y) / 4
            slope[-1] += error
            for i, v in zip(index.tolist(), value):
                slope[i] = slope.get(i, 0.0) + error * v
        for k, g in slope.items():
            seen[k] = seen.get(k, 1e-8) + g * g
            w[k] = w.get(k, 0.0) - 0.5 * g / np.sqrt(seen[k])
    got = weak_quality.fit_scorer([i for i, _ in pairs], [v for _, v in pairs], target, rounds=5)
    assert np.isclose(got[-1], w.pop(-1)) and all(np.isclose(got[k], x) for k, x in w.items())


def test_posterior_is_no_worse_than_the_plain_rule(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select text, quality from '{d}/documents.parquet' left join '{d}/labels.parquet' using (doc_id)").fetchall()
    votes = weak_quality.votes_of(np.array([weak_quality.pattern((t or "").encode()) for t, _ in rows]))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float), FAULT_OF)
    known = np.array([q is not None for _, q in rows])
    truth = np.array([q == 1 for _, q in rows])[known]
    em, plain = (model.posterior(votes) > 0.5)[known], ~(votes == weak_quality.BAD).any(1)[known]
    assert np.mean(em == truth) > np.mean(plain == truth) > 0.99 and (em != plain).any()


def test_model_does_not_depend_on_how_rows_are_dealt_out(docs):
    one, two = (weak_quality.train(x, train_docs=10) for x in (docs.repartition(7), docs.coalesce(1)))
    assert (one.weights == two.weights).all() and (one.labels.alarms == two.labels.alarms).all()


def test_quality(spark, docs, nothing):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op9_weak_label_quality(spark, "/root/testdata/sf0.01").withColumnRenamed("quality", "score").join(labels, "doc_id").collect()
    assert np.mean([r.accepted for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.accepted for r in rows if r.quality == 0]) < 0.1
    assert big.count() > len(rows)
    model = weak_quality.train(docs)
    scores = docs.select(weak_quality.quality(spark, model, F.col("text"))).collect()
    assert len(scores) == docs.count() and all(0 <= s[0] <= 1 for s in scores)
    kept = weak_quality.accepted(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert weak_quality.accepted(nothing).count() == 0
