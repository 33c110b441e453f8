"""Repair of conversation structure by the cheapest edits.

For each place between two turns there are layers of bitsets: layer c holds the grammar
states from which the rest can be brought to its end at cost c.  Layers are kept from the
cheapest on, packed in one integer; a turn takes the layers after it to those before it by
shifts (an edit's cost) and masks (its move of states).  The first layer with the beginning's
state gives the cost; a trace through the bits from the beginning gives the least audit.

Costs of states never differ by more than twelve: two insertions lead from any state to any
other that matters, and a kept system turn saves a deletion.  So thirteen layers are whole.

Conversations are cut into chunks of bounded size by a range sort.  Those that lie in one
chunk are done there; the others are worked on by chunk, and small tables of costs and states
pass from chunk to chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

# Costs of the edits, white space, ends of sentences, allowed neighbours.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: States: nothing so far, a system turn, an ending in a user's, in an assistant's turn.
BEGIN, SYSTEM, USER, ASSISTANT = STATES = (1, 2, 4, 8)
LAYERS = 13
BAND = (1 << 4 * LAYERS) - 1
#: A chunk has about so many turns at most, and characters unless one turn has more.
CHUNK_TURNS, CHUNK_CHARS = 4096, 4 << 20
#: Characters of a text that a range sort compares before its digest.
HEAD = 64

_EACH = int("1" * LAYERS, 16)
_OF = {s: _EACH * s for s in STATES}


def kept_before(v: int, initial: str) -> int:
    """The states that a turn of this role leads to a state of ``v``, in every layer."""
    if initial == "s":
        return (v & _OF[SYSTEM]) >> 1
    if initial == "u":
        to = v & _OF[USER]
        return to >> 2 | to >> 1 | to << 1
    return (v & _OF[ASSISTANT]) >> 1 if initial == "a" else 0


def written_before(v: int) -> int:
    """The same for a turn whose role is free to choose."""
    return kept_before(v, "u") | kept_before(v, "a")


def next_state(state: int, initial: str) -> int:
    """0 where the grammar has none."""
    if initial == "s":
        return SYSTEM if state == BEGIN else 0
    if initial == "u":
        return USER if state != USER else 0
    return ASSISTANT if initial == "a" and state == USER else 0


def written_role(state: int) -> str:
    return "assistant" if state == USER else "user"


def inserted(v: int) -> int:
    """Layers with what insertions lead to them; two are enough."""
    for _ in range(2):
        v |= written_before(v) << 4 * INSERT
    return v


def first_layers(v: int) -> tuple[int, int]:
    """Layers from the first that holds a state, each state in its first layer only, and how
    many empty layers went."""
    if not v:
        return 0, 0
    gone = ((v & -v).bit_length() - 1) // 4
    v, out, seen = v >> 4 * gone & BAND, 0, 0
    for k in range(LAYERS):
        new = v >> 4 * k & 15 & ~seen
        out |= new << 4 * k
        seen |= new
    return out, gone


#: At the end a conversation is empty or ends with an assistant's turn.
END, _ = first_layers(inserted(BEGIN | ASSISTANT))


@lru_cache(maxsize=None)
def before(v: int, forced: bool, initial: str, truncated: bool) -> tuple[int, int]:
    """Layers before a turn from those after it, and by how much the cheapest cost rises.
    There are few different layers, so this is a table that fills as it is used."""
    w = v << 4 * DELETE
    if not forced:
        more = TRUNCATED if truncated else 0
        w |= kept_before(v, initial) << 4 * more
        w |= written_before(v) << 4 * (more + REROLE)
    return first_layers(inserted(w))


def cost_in(v: int, state: int) -> int | None:
    """The first layer with a state."""
    for k in range(LAYERS):
        if v >> 4 * k & state:
            return k
    return None


@lru_cache(maxsize=None)
def least_edits(v: int, forced: bool, initial: str, truncated: bool, state: int) -> tuple[str, int]:
    """The least cheapest edits up to and with a turn, from ``state`` before it and the layers
    after it, and the state after it."""
    here, gone = before(v, forced, initial, truncated)
    more, edits = TRUNCATED if truncated else 0, ""
    while True:
        cost = cost_in(here, state) + gone

        def leads(to: int, price: int) -> bool:
            return bool(to) and (at := cost_in(v, to)) is not None and at + price == cost

        if leads(state, DELETE):
            return edits + "D", state
        after = ASSISTANT if state == USER else USER
        if (at := cost_in(here, after)) is not None and at + gone + INSERT == cost:
            edits, state = edits + "I", after
        elif leads(next_state(state, initial), more):
            return edits + "K", next_state(state, initial)
        else:
            return edits + "R", after


def last_edits(state: int) -> str:
    return {USER: "I", SYSTEM: "II"}.get(state, "")


Code = tuple[bool, str, bool]


def layers_after(codes: list[Code], end: int = END) -> tuple[list[int], int, int]:
    """Layers after each turn; those before the first, and what their cheapest costs."""
    out, base = [], 0
    for code in reversed(codes):
        out.append(end)
        end, rise = before(end, *code)
        base += rise
    return out[::-1], end, base


def traced(codes: list[Code], after: list[int], state: int) -> tuple[list[str], int]:
    """Edits up to and with each turn, and the state after the last."""
    edits = []
    for v, code in zip(after, codes):
        some, state = least_edits(v, *code, state)
        edits.append(some)
    return edits, state


def repaired(turns: Iterable[tuple[str, str]], edits: Iterable[str], state: int) -> Iterator[str]:
    """``role:text`` of the turns that edits leave, change or put in."""
    for (role, text), some in zip(turns, edits):
        for edit in some:
            if edit == "K":
                state = next_state(state, role[:1])
                yield f"{role}:{text}"
            elif edit != "D":
                role_now = written_role(state)
                state = next_state(state, role_now[0])
                yield f"{role_now}:{text if edit == 'R' else ''}"


def ending(state: int) -> list[str]:
    """The turns that ``last_edits`` put in."""
    return ["user:", "assistant:"][2 - len(last_edits(state)) :]


def judged(turns: list[tuple[str, str]], seen: set) -> tuple[list[Code], list[int]]:
    """What each turn's first fault demands, and counts of blank, repeated and truncated
    turns; ``seen`` holds the turns before, and takes these up."""
    codes, counts = [], [0, 0, 0]
    for turn in turns:
        role, text = turn
        body = text.rstrip(SPACE)
        again = turn in seen
        seen.add(turn)
        fault = 0 if not body else 1 if again else 2 if body[-1] not in ENDS else None
        if fault is not None:
            counts[fault] += 1
        codes.append((fault in (0, 1), role[:1] if role[:1] in "sua" else "", fault == 2))
    return codes, counts


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repair(turns: list[tuple[str, str]]) -> tuple[list[int], int, int, str, list[str]]:
    """Counts of faults, illegal neighbours, cost, audit and the repaired turns of one
    conversation of (role, text)."""
    codes, counts = judged(turns, set())
    after, first, base = layers_after(codes)
    edits, state = traced(codes, after, BEGIN)
    audit = "".join(edits) + last_edits(state)
    return counts, illegal([r[:1] for r, _ in turns]), base + cost_in(first, BEGIN), audit, [*repaired(turns, edits, BEGIN), *ending(state)]


# --- On Spark ---------------------------------------------------------------------------


def digest(turn: tuple[str, str]) -> bytes:
    role, text = (x.encode() for x in turn)
    return hashlib.sha256(len(role).to_bytes(8, "little") + role + text).digest()[:16]


def damage(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, times): each row after damage and how often it is there; a
    dropped one is kept with ``times`` 0, so that its conversation is not lost."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    t = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, blank).alias("_role"), F.coalesce(text_col, blank).alias("_text"), kind.alias("_kind"))
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("_text", ENDS, "")).otherwise(F.col("_text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    times = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return t.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


class Turns:
    """Turns of one conversation that lie together: its whole, or a chunk of it."""

    def __init__(self):
        self.numbers: list[int | None] = []  # of all rows that are left, in order
        self.turns: list[tuple[str, str]] = []
        self.chars = 0

    def add(self, number, role: str, text: str, times: int) -> None:
        self.numbers += [number] * times
        self.turns += [(role, text)] * times
        self.chars += len(text) * times

    def full(self, turns: int, chars: int) -> bool:
        return len(self.turns) >= turns or self.chars >= chars

    def span(self) -> tuple:
        """Least and largest turn number, and how many there are."""
        there = {n for n in self.numbers if n is not None}
        return (min(there), max(there), len(there)) if there else (None, None, 0)


def gap(low, high, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "part int, seq int, low long, high long, distinct_turns long, roles array<string>, texts array<string>, digests array<binary>"


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(df: DataFrame, *schemas: str) -> tuple[str, pa.Schema]:
    """The schema of a table of conversations for Spark and for Arrow."""
    fields = [f.split(" ") for s in schemas for f in s.split(", ")]
    kinds = [(n, pa.list_(_TYPES[k[6:-1]]) if k.startswith("array<") else _TYPES[k]) for n, k in fields]
    conv = to_arrow_type(df.schema["conv"].dataType)
    return ", ".join((f"conv {dict(df.dtypes)['conv']}", *schemas)), pa.schema([("conv", conv), *kinds])


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += weight(row)
        if len(some) >= 2048 or size >= CHUNK_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _finished(part: Turns) -> tuple:
    counts, wrong, cost, audit, lines = repair(part.turns)
    return gap(*part.span()), *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def chunks(damaged: DataFrame, turns: int = CHUNK_TURNS, chars: int = CHUNK_CHARS) -> DataFrame:
    """Results of conversations that lie within a range of the sort, and chunks of those that
    cross its ends or are long; stored."""
    head, mark = F.substring("text", 1, HEAD), F.md5(F.col("text").cast("binary"))
    keyed = damaged.select("*", head.alias("_head"), mark.alias("_mark"))
    # Equal rows can be in any order, so a number of its own may deal them over ranges.
    ranged = keyed.repartitionByRange("conv", "turn", "role", "_head", "_mark", F.monotonically_increasing_id())
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "_head", "_mark").select("conv", "turn", "role", "text", "times")

    schema, arrow = _arrow(damaged, "open boolean", _RESULT, _CHUNK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()

        def conversations() -> Iterator[tuple]:
            seq, first, cut = 0, True, False
            now, part = None, None

            def chunk() -> tuple:
                nonlocal seq
                seq += 1
                marks = list(dict.fromkeys(map(digest, part.turns)))
                return (now, True, *[None] * 8, number, seq, *part.span(), [r for r, _ in part.turns], [t for _, t in part.turns], marks)

            for conv, turn, role, text, times in _rows(batches):
                if part is None or conv != now:
                    if part is not None:
                        yield chunk() if first or cut else (now, False, *_finished(part), *[None] * 8)
                        first = False
                    now, part, cut = conv, Turns(), False
                elif part.full(turns, chars):
                    yield chunk()
                    part, cut = Turns(), True
                part.add(turn, role, text, times)
            if part is not None:
                yield chunk()

        yield from _batches(conversations(), arrow, lambda row: sum(map(len, row[16] or [row[8] or ""])))

    return stored(ordered.mapInArrow(pack, schema), "turns")


_JUDGED = "part int, seq int, low long, high long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>"


def across(opened: DataFrame) -> DataFrame:
    """Results of conversations in several chunks, or at the ends of ranges.

    Sums pass from chunk to chunk in streams that are sorted by conversation and place, so no
    task holds a conversation: costs of states from the last chunk to the first, then states
    from the first to the last, at last the repaired text through its digest."""
    # A turn that an earlier chunk of its conversation has.
    marks = opened.select("conv", "part", "seq", F.explode("digests").alias("mark"))
    firsts = marks.groupBy("conv", "mark").agg(F.min(F.struct("part", "seq")).alias("x")).select(F.col("conv").alias("_conv"), F.col("mark").alias("_mark"), "x")
    later = marks.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark"))).where(F.struct("part", "seq") != F.col("x"))
    later = later.groupBy("part", "seq").agg(F.collect_list("mark").alias("earlier"))
    known = stored(opened.select("conv", "part", "seq", "low", "high", "distinct_turns", "roles", "texts").join(later, ["part", "seq"], "left").select("conv", "part", "seq", "low", "high", "distinct_turns", "roles", "texts", "earlier"), "opened")

    def codes_of(roles: list[str], texts: list[str], earlier) -> tuple[list[Code], list[int]]:
        turns, before_it = list(zip(roles, texts)), set(earlier or ())
        return judged(turns, {t for t in set(turns) if digest(t) in before_it} if before_it else set())

    def stream(df: DataFrame, columns: list[str], last_first: bool = False) -> DataFrame:
        order = [F.col(c).desc() if last_first else F.col(c) for c in ("part", "seq")]
        return df.select("conv", "part", "seq", *columns).repartition("conv").sortWithinPartitions("conv", *order)

    def each(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
        """Rows of ``work(rows)``, which goes through a partition's rows in order."""
        spark_schema, arrow = _arrow(opened, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(work(_rows(batches)), arrow, lambda row: sum(len(x) for x in row if isinstance(x, str)))

        return df.select("conv", *columns).mapInArrow(run, spark_schema)

    def judge(rows):
        for conv, part, seq, low, high, distinct, roles, texts, earlier in rows:
            codes, counts = codes_of(roles, texts, earlier)
            costs = []
            for end in STATES:  # from each state before the chunk to each after it
                _, v, base = layers_after(codes, end)
                costs += [None if (at := cost_in(v, s)) is None else base + at for s in STATES]
            initials = [r[:1] for r in roles]
            yield conv, part, seq, low, high, distinct, *counts, illegal(initials), *((initials[0], initials[-1]) if initials else (None, None)), costs

    def from_the_end(rows):
        now, after = object(), []
        for conv, part, seq, costs in rows:
            if conv != now:
                now, after = conv, [cost_in(END, s) for s in STATES]
            least = min(x for x in after if x is not None)
            yield conv, part, seq, sum(s << 4 * (x - least) for s, x in zip(STATES, after) if x is not None and x - least < LAYERS), least
            ways = [costs[4 * e : 4 * e + 4] for e in range(4)]
            after = [min((w[s] + x for w, x in zip(ways, after) if w[s] is not None and x is not None), default=None) for s in range(4)]

    def exits(rows):
        for conv, part, seq, roles, texts, earlier, layers in rows:
            codes, _ = codes_of(roles, texts, earlier)
            after, first, _ = layers_after(codes, layers)
            yield conv, part, seq, [traced(codes, after, s)[1] if cost_in(first, s) is not None else 0 for s in STATES]

    def from_the_start(rows):
        now, state = object(), BEGIN
        for conv, part, seq, out in rows:
            if conv != now:
                now, state = conv, BEGIN
            yield conv, part, seq, state
            state = out[STATES.index(state)]

    def edit(rows):
        for conv, part, seq, roles, texts, earlier, layers, state in rows:
            codes, _ = codes_of(roles, texts, earlier)
            edits, out = traced(codes, layers_after(codes, layers)[0], state)
            lines = list(repaired(zip(roles, texts), edits, state))
            yield conv, part, seq, "".join(edits), "\n".join(lines), bool(lines), out

    def combine(rows):
        whole = None
        for conv, _, _, *row in rows:
            if whole is None or conv != whole.conv:
                if whole is not None:
                    yield whole.row()
                whole = Whole(conv)
            whole.add(*row)
        if whole is not None:
            yield whole.row()

    place, texts = ["part", "seq"], ["roles", "texts", "earlier"]
    facts = stored(each(known, [*place, "low", "high", "distinct_turns", *texts], judge, _JUDGED), "judged")
    behind = stored(each(stream(facts, ["costs"], last_first=True), [*place, "costs"], from_the_end, "part int, seq int, layers long, rest long"), "behind").drop("conv")
    layered = known.join(behind, place)
    ways_out = each(layered, [*place, *texts, "layers"], exits, "part int, seq int, exits array<int>")
    entered = stored(each(stream(ways_out, ["exits"]), [*place, "exits"], from_the_start, "part int, seq int, state int"), "entered").drop("conv")
    edited = each(layered.join(entered, place), [*place, *texts, "layers", "state"], edit, "part int, seq int, edits string, lines string, some boolean, out int")
    columns = ["low", "high", "distinct_turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "layers", "rest", "edits", "lines", "some", "out"]
    joined = facts.drop("conv").join(behind, place).join(edited, place)
    return each(stream(joined, columns), [*place, *columns], combine, _RESULT)


class Whole:
    """What the chunks of a conversation add up to."""

    def __init__(self, conv):
        self.conv, self.counts, self.wrong = conv, [0, 0, 0], 0
        self.low = self.high = self.last = self.cost = None
        self.distinct, self.edits, self.state, self.some = 0, [], BEGIN, False
        self.text = hashlib.sha256()

    def add(self, low, high, distinct, blank, duplicate, truncated, wrong, first, last, costs, layers, rest, edits, lines, some, out) -> None:
        if low is not None:
            self.distinct += distinct - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated))]
        if first is not None:
            self.wrong += wrong + (self.last is not None and self.last + first not in LEGAL)
            self.last = last
        if self.cost is None:
            ends = [cost_in(layers, s) for s in STATES]
            self.cost = rest + min(costs[4 * e] + x for e, x in enumerate(ends) if x is not None and costs[4 * e] is not None)
        self.edits.append(edits)
        if some:
            self._write(lines)
        self.state = out

    def _write(self, lines: str) -> None:
        self.text.update((("\n" if self.some else "") + lines).encode())
        self.some = True

    def row(self) -> tuple:
        for line in ending(self.state):
            self._write(line)
        return self.conv, gap(self.low, self.high, self.distinct), *self.counts, self.wrong, self.cost, "".join(self.edits) + last_edits(self.state), self.text.hexdigest()


def repairs(damaged: DataFrame, turns: int = CHUNK_TURNS, chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each
    conversation of (conv, turn, role, text, times).

    Turns are taken in order of their number, nulls first; of equal numbers by role, then
    text (its first 64 characters, then a digest), so repeated rows lie together.  A
    conversation of any length is worked on in chunks; only the digest of its repaired text
    must pass through one task, piece by piece.  Conversations without rows have zeros, an
    empty audit and the digest of an empty text; an empty table gives no rows.
    """
    found = chunks(damaged, turns, chars)
    columns = ["conv", *(f.split(" ")[0] for f in _RESULT.split(", "))]
    return found.where("not open").select(*columns).unionByName(across(found.where("open")))


def damaged_and_repaired(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: int = CHUNK_TURNS, chars: int = CHUNK_CHARS
) -> DataFrame:
    """``repairs`` of conversations that ``damage`` was done to; null roles and texts are one
    space, a null conversation is one of its own.  Other columns are not read."""
    return repairs(damage(rows, conv_col, turn_col, role_col, text_col), turns, chars).withColumnRenamed("conv", conv_col)
