"""Source mixing against a plain queue and the reference SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tributary.llm import source_mixing as sm

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "copies"]


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in stopped}
        left = total - sum(stopped.values())
        share = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = [s for s, t in share.items() if t > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sm.reference_sql()})").fetchall()
    return sorted(got, key=str)


def test_given_documents(spark, table):
    rows = [tuple(r) for r in table.select("doc_id", "text", "source").collect()]
    got = rows_of(sm.taken(table))
    assert got == by_sql(rows)
    sizes, took, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in rows}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    for i, size, _, goal, taken, _ in got:
        assert size == words[i] and 0 <= taken <= 3 * size
        sizes[source[i]] += size
        took[source[i]] += taken
        target[source[i]] = goal
    want = filled(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(took[s] - target[s]) <= 1 for s in sizes)


def odd():
    rows = [(i, "w " * (i % 7), f"s{i % 5}" if i % 11 else None) for i in range(300)]
    rows += [(1, "same words here", "s1")] * 9 + [(None, "no id", "s2")] * 3 + [(7, None, "s3"), (7, "", ""), (8, " \t\x0b ", "empty"), (9, "x " * 5000, "É"), (10, "\x0bword\x0c", "z")]
    return rows


@pytest.mark.parametrize("rows", [odd(), [(1, None, None)], [(1, "a b", "s"), (2, "", None)], [(1, "a", "a"), (2, "b c", "b"), (3, "d", "c"), (4, "e", "d")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], "doc_id long, text string, source string, key string, nth int, finish double").repartition(3)
    got = rows_of(sm.taken(df))
    assert len(got) == len(rows) and got == by_sql(rows)


def test_no_rows(spark, nothing):
    assert sm.taken(nothing).count() == 0 and sm.mixed(nothing).count() == 0


def test_order_of_the_mix(spark):
    """One queue after another by finish time, no gaps, and no source far behind its share."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = sorted(sm.mixed(df).collect(), key=lambda r: r["position"])
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    goal, budget, at = filled(sizes), sum(sizes.values()), 0
    so_far = defaultdict(int)
    for r in mix:
        assert r["position"] == at
        at += r["words"]
        so_far[r["source"]] += r["words"]
        for s, t in goal.items():
            assert abs(so_far[s] - at * t / budget) <= 3 * 9
    assert budget - len(sizes) <= at <= budget
    assert [r["finish"] for r in mix] == sorted(r["finish"] for r in mix)
    assert {r["epoch"] for r in mix if r["source"] == "s0"} == {0, 1, 2} and {r["epoch"] for r in mix if r["source"] == "s2"} == {0}


def test_whole_mix_does_not_depend_on_partitions(spark, table):
    one, two = (sorted(map(tuple, sm.mixed(table.repartition(n)).collect()), key=str) for n in (1, 7))
    assert one == two
