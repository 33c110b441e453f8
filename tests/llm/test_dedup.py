import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import chunk_dedup, queries, shingle_join, simhash

from .conftest import rows


def groups(fps, budget=4):
    """Labels by brute force: the first value of each connected group."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget):
            x, y = sorted((find(i), find(i + 1 + int(j))))
            root[y] = x
    return [find(i) for i in range(len(fps))]


def test_chunks_are_the_text(spark, docs):
    joined = docs.select(F.coalesce("text", F.lit("")).alias("t"), chunk_dedup.chunks(F.coalesce("text", F.lit(""))).alias("c"))
    assert joined.where(F.array_join("c", "") != F.col("t")).count() == 0
    assert joined.where(F.array_max(F.transform("c", lambda x: F.length(x))) > 4098).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, weak):
    """Also with a hash that tells almost nothing apart."""
    got = chunk_dedup.exact_groups(docs, **({"identifiers": (lambda c: F.length(c) % 3, *chunk_dedup.IDENTIFIERS[2:])} if weak else {})).collect()
    texts = {}
    for i, t, *_ in rows():
        texts.setdefault(t or "", []).append(i)
    assert len(got) == len(rows())
    for r in got:
        (ids,) = [v for t, v in texts.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_exact_on_table(spark, sf_dir, nothing):
    got = sorted(map(tuple, queries.op5_chunk_recipes(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(c.execute(queries.ORACLE_SQL["op5_chunk_recipes"]).fetchall())
    assert chunk_dedup.exact_groups(nothing).count() == 0


def test_exact_stage(docs, nothing):
    kept = chunk_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17])  # one of the row that is there twice
    assert chunk_dedup.deduplicated(nothing).count() == 0


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_near_groups(docs, table, nothing):
    for frame in (docs, table):
        data = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        fps = [slow_fingerprint(t) for _, t in data]
        label = groups(fps)
        least = {}
        for (i, _), g in zip(data, label):
            if i is not None:
                least[g] = min(least.get(g, i), i)
        want = sorted((repr(i), f"{fp:016x}", repr(least.get(g))) for (i, _), fp, g in zip(data, fps, label))
        assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in simhash.near_groups(frame).collect()) == want
    assert simhash.near_groups(nothing).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and simhash.deduplicated(nothing).count() == 0
    assert {r.doc_id for r in kept.collect()} >= {-5, 1, 4} and not {2, 3, 5, 9, 11} & {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("root_rows", [20_000, 20, 1])
def test_links_of_clusters(spark, root_rows):
    """Chains and clusters of fingerprints; with small limits, roots are cut again and again."""
    r = random.Random(5)
    fps = set()
    for _ in range(4):
        chain = [r.getrandbits(64)]
        for _ in range(80):
            x = r.choice(chain[-40:])
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            chain.append(x)
        fps |= set(chain)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), root_rows))
    label = {row.node: row.label for row in found.collect()}
    mine, want = {}, {}
    for x, g in zip(signed, groups(fps)):
        mine.setdefault(label.get(x, x), set()).add(x)
        want.setdefault(g, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in mine.items())


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_stage_takes_five_words(spark, monkeypatch):
    """All pairs with similarity 0.8 or more link, however far their fingerprints are apart,
    and no others; also where a list of candidates is dealt out in blocks."""
    r = random.Random(3)
    texts = []
    for base in range(25):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((3, 30, 60, 300)))]
        for _ in range(6):
            changed = list(words)
            for _ in range(r.choice((0, 1, 1, 2, 5))):
                changed[r.randrange(len(changed))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(changed) + (" and this common line is in many of them too" if base % 2 else ""))
    sets = [five_words(t) for t in texts]
    least = list(range(len(texts)))
    far = 0
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in near:
        far += ((simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[j].encode())) & (2**64 - 1)).bit_count() > 4
        a, b = sorted((least[i], least[j]))
        least = [a if x == b else x for x in least]
    assert far > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(d.doc_id for d in simhash.deduplicated(docs).collect()) == sorted(set(least))
    nodes = shingle_join.shingle_nodes(docs, "doc_id", "text")
    node = {d._id: d.node for d in nodes.select("_id", "node").collect()}
    for block in (3, 1024):
        monkeypatch.setattr(shingle_join, "LONG", block)  # with 3, long lists are passed on row by row
        groups = shingle_join.candidates(nodes, shingle_join.shared_prefixes(docs, "text"), block)
        links = shingle_join.links(docs, nodes, groups, "text", block)
        label = {d.node: d.label for d in simhash.components(links).collect()}
        assert len({label.get(n, n) for n in node.values()}) == len(set(least))


def test_near_stage_goes_on_where_the_tries_end(spark, monkeypatch):
    """What the tries found and the sets confirm is not compared again; what lies further apart
    is, and so is a list that only partly hangs together."""
    r = random.Random(7)

    def changed(words, n):
        for _ in range(500):
            out = [f"x{r.randrange(10**6)}" if i in places else w for places in [set(r.sample(range(len(words)), n))] for i, w in enumerate(words)]
            one, two = ([simhash.folded(simhash.shingle_hashes(" ".join(t).encode(), 5)) for t in (words, out)])
            a, b = five_words(" ".join(words)), five_words(" ".join(out))
            if 5 * len(a & b) >= 4 * len(a | b):
                yield " ".join(out), ((one ^ two) & (2**64 - 1)).bit_count()

    words = [[f"w{k}x{r.randrange(10**6)}" for _ in range(200)] for k in range(3)]
    close = [next(t for t, bits in changed(w, 1) if bits <= 4) for w in words[:2]]
    apart = [next(t for t, bits in changed(w, 3) if bits > 8) for w in words[1:]]
    docs = spark.createDataFrame(list(enumerate([*map(" ".join, words), *close, *apart])), "doc_id long, text string")
    seen, candidates = [], shingle_join.candidates

    def watched(nodes, lists, *rest):
        seen.append({d.node for d in lists.select("node").collect()})
        return candidates(nodes, lists, *rest)

    monkeypatch.setattr(shingle_join, "candidates", watched)
    assert sorted(d.doc_id for d in simhash.deduplicated(docs).collect()) == [0, 1, 2]
    node = {d._id: d.node for d in shingle_join.shingle_nodes(docs, "doc_id", "text").collect()}
    assert seen[0] == {node[i] for i in (0, 1, 3, 4)}
    assert seen[1] == {node[i] for i in (1, 2, 4, 5, 6)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(500, 500), (600, 601)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 600: 600, 601: 600}


def test_components_join_edges_about_once(spark, monkeypatch):
    """A round takes up the edges between the groups that are left, not all of them again."""
    rng, root = random.Random(5), list(range(3000))
    edges = {tuple(sorted(rng.sample(range(3000), 2))) for _ in range(2000)} | {(i, 2999) for i in range(50)} | {(i, i + 1) for i in range(1000, 1200)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    held, kept = [], simhash.stored

    def counted(df, label):
        out = kept(df, label)
        held.extend([out.count()] if label == "edges" else [])
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert held[0] == len(edges) and held[-1] == 0 and sum(held[1:]) < len(edges) / 2


def test_only_the_judged_row_goes(spark):
    """Rows that share an id, also a null one, with a dropped row keep their own text; of a
    row that is there more than once one stays."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven", "red green blue black white grey brown")
    other = "unlike all others in this table"
    data = [(None, a), (None, b), (5, a), (7, c), (9, c), (7, other), (None, "a text with null id alone"), (7, other), (9, c), (7, c), (None, b), (11, None), (11, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    rest = [(None, b), (5, a), (7, other), (None, "a text with null id alone"), (11, None)]
    for stage, kept in ((chunk_dedup.deduplicated, (9, c)), (simhash.deduplicated, (7, c))):
        assert sorted(map(repr, map(tuple, stage(docs).collect()))) == sorted(map(repr, [*rest, kept]))


def test_chunk_ends_depend_on_content(spark):
    """Texts without sentences, or even spaces, that differ at the front share later chunks."""
    r = random.Random(2)
    for signs in ("的一是不了人在有我他国中大来上个到说们为子和你地出道也时年得就那要下", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefg;(){}=", "ab, "):
        text = "".join(r.choice(signs) for _ in range(20_000))
        cut = spark.createDataFrame([(text,), (text[:10] + "+" + text[10:],)], "t string").select(chunk_dedup.chunks(F.col("t"))).collect()
        one, two = (set(x[0]) for x in cut)
        assert len(one & two) > 0.5 * len(one) > 2


def test_parts_of_long_texts(monkeypatch):
    r = random.Random(4)
    texts = [b"", b" \n ", b"one", b"One two  three", b"x" * 300, *(" ".join(r.choice(["a", "bc", "def" * 9, "\t", "B"]) for _ in range(n)).encode() for n in (3, 4, 5, 50, 400))]
    whole = [(simhash.fingerprint(t), shingle_join.shingle_set(list(simhash.shingle_hashes(t, 5))).tolist()) for t in texts]
    for part in (1, 7, 64):
        monkeypatch.setattr(simhash, "PART", part)
        assert [(simhash.fingerprint(t), shingle_join.shingle_set(list(simhash.shingle_hashes(t, 5))).tolist()) for t in texts] == whole


def test_partners_by_brute_force():
    r = random.Random(6)
    for n in (1, 2, 3, 30, 700):
        pairs = [(size, r.randrange(max(1, size // 3))) for size in (r.choice((5, 50, 52, 200)) for _ in range(n))]
        got = shingle_join.partners(np.array([s << 32 | p for s, p in pairs], np.int64))
        for i, (s, p) in enumerate(pairs):
            assert got[i] == any(9 * (min(p, q) + min(s - p, t - q)) >= 4 * (s + t) for j, (t, q) in enumerate(pairs) if j != i)


def test_sketches_lose_no_near_pair():
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(-(2**63), 2**63 - 1, int(n))) for n in (0, 1, 3, 20, 21, 90, 400, 3000, 70_000)]
    for base in list(sets):
        for share in (0.02, 0.1, 0.13, 0.3):
            gone = r.random(len(base)) < share
            sets.append(np.unique(np.concatenate([base[~gone], r.integers(-(2**63), 2**63 - 1, int(gone.sum() * r.random()))])))
    sizes = np.array(list(map(len, sets)))
    every = np.arange(len(sets))
    sketches = [np.frombuffer(shingle_join.sketch_of(s), np.uint8) for s in sets]
    x, y = shingle_join.sketch_pairs(sizes, sketches, every, every)
    maybe = set(zip(x.tolist(), y.tolist()))
    near = 0
    for i in every.tolist():
        for j in every.tolist():
            common = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 5 * common >= 4 * (sizes[i] + sizes[j] - common):
                near += 1
                assert (i, j) in maybe
    assert near > 40 and len(maybe) < 3 * near


def test_scratch_tables_go(spark, docs):
    from tributary.llm import common

    before = common.left()
    kept = simhash.deduplicated(docs)
    assert common.left() - before == 2 and kept.count()  # what the result reads
    common.clear(spark, before)
    assert common.left() == before
