"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tributary.llm import turn_repair as tr

WS = " \t\n\x0b\x0c\r"


def plain_codes(turns):
    seen, codes, counts = [], [], [0, 0, 0]
    for role, text in turns:
        body = text.strip(WS)
        if not body:
            fault = 0
        elif (role, text) in seen:
            fault = 1
        elif body[-1] not in ".!?":
            fault = 2
        else:
            fault = None
        seen.append((role, text))
        if fault is not None:
            counts[fault] += 1
        codes.append(fault)
    return codes, counts


def plain_repair(turns):
    """Dijkstra over (turn, output so far as grammar state), ordered by cost, then audit."""
    codes, counts = plain_codes(turns)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(turns) and state in ("", "a"):
            return counts, cost, audit, list(lines)
        done.add((i, state))
        for role in ("user", "assistant"):
            if (to := step.get((state, role[0]))) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if codes[i] in (None, 2):
                more = 5 if codes[i] == 2 else 0
                if (to := step.get((state, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := step.get((state, new[0]))) is not None:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*lines, f"{new}:{text}")))
    raise AssertionError


def random_turns(rng, n):
    roles = ["system", "user", "assistant", "tool", "", " ", "s", "User"]
    texts = ["Yes.", "No", " ", "", "Why?", "ok!\n", "x", "é.", "...", "!"]
    return [(rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice('.!? x')}") for _ in range(n)]


def test_repair_equals_search():
    rng = random.Random(1)
    for trial in range(3000):
        turns = random_turns(rng, rng.randrange(12))
        counts, wrong, cost, audit, lines = tr.repair(turns)
        assert (counts, cost, audit, lines) == plain_repair(turns), turns
        assert wrong == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))


def plain_result(rows):
    """From (conv, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [(r, t) for _, r, t in some]
        numbers = [n for n, _, _ in some if n is not None]
        counts, cost, audit, lines = plain_repair(turns)
        wrong = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, times string, gaps string"


def odd_rows():
    rng = random.Random(2)
    rows = [(None, None, None, None), (None, 1, "user", "Hm."), (5, None, "system", "Be good."), (5, None, "user", "Hi."), (5, 3, "user", "Hi."), (7, 0, "user", ""), (8, 2, None, "x" * 20000 + ".")]
    rows += [(9, 4, "user", "Again and again.")] * 6
    for conv in range(100, 160):
        rows += [(conv, t, *x) for t, x in enumerate(random_turns(rng, rng.randrange(1, 9))) if rng.random() < 0.9]
    rows += [(33, t // 2, *x) for t, x in enumerate(random_turns(rng, 300))]  # ties in turn
    return rows


@pytest.mark.parametrize("limit", [tr.CHUNK_TURNS, 7])
def test_whole_tables(spark, limit):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA).repartition(3)
    assert found(tr.damaged_and_repaired(df, turns=limit)) == plain_result(rows)


def test_no_rows(spark):
    assert tr.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_in_chunks(spark):
    """The answer does not depend on the cuts, also where one conversation has all rows."""
    rng = random.Random(3)
    rows = [(1, t, *x) for t, x in enumerate(random_turns(rng, 3000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = found(tr.damaged_and_repaired(df))
    assert found(tr.damaged_and_repaired(df, chars=100)) == whole == plain_result(rows)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(tr.damaged_and_repaired(df)) == plain_result([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_all_dropped(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    got = found(tr.damaged_and_repaired(spark.createDataFrame([(4, dropped, "user", "Hi.")], "conv_id long, turn long, role string, text string")))
    assert got == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_layers_hold_all_costs():
    """Costs of states after any turns stay within the layers that are kept."""

    @lru_cache(maxsize=None)
    def reach(v):
        return {tr.before(v, forced, i, t)[0] for forced in (True, False) for i in ("s", "u", "a", "") for t in (True, False)}

    seen, todo = set(), [tr.END]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            assert all(tr.cost_in(v, s) is not None for s in tr.STATES)
            todo += reach(v)
    assert len(seen) < 1000
