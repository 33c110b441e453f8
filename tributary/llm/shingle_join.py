"""Exact self-join of texts by the Jaccard similarity of their word shingles.

Two sets with similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles of
each, whatever order all shingles are put in.  Common shingles come last, so lists of sets
that share such a shingle are short.  Which shingles are common is counted over all texts,
less what occurs once in a task's run of ``RUN`` shingles: that decides how long the lists
are, never which pairs are found.

Members of a list are first compared by sketches, counts of a set's shingles by their last
bits, about a byte for four shingles.  Two sets differ in as many shingles as their sketches
do or more, so no near pair is lost; what is left is compared on the whole sets.  Sets are
not stored: each pass hashes the texts again, which costs less than moving them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nothing_heavy, ragged, slices, stored, text_digest, utf8_list, whole_text
from .simhash import Stars, components, folded, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction.
NEAR = (4, 5)
#: Sets of a list that are compared at a time; a longer list is dealt out as pairs of blocks.
BLOCK = 1024
#: Sets of a list that a task holds; a longer list is passed on row by row, unfiltered.
LONG = 1 << 20
#: Shingles that every task knows as common, at most: 16 bytes each.
COMMON = 500_000
#: Shingles that are counted together.
RUN = 4_000_000
#: A sketch has a power of two of counts, between these.
LEAST_SKETCH, MOST_SKETCH = 16, 4096


def shingle_set(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def node_of(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(tokens.tobytes())


def sketch_of(tokens: np.ndarray) -> bytes:
    """Four to eight shingles a count, where the limits allow; counts end at 255, which only
    makes sets look more alike."""
    size = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << max(0, len(tokens).bit_length() - 3)))
    return np.minimum(np.bincount(tokens & (size - 1), minlength=size), 255).astype(np.uint8).tobytes()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, digest, place, fp, node, size, sketch) for each row: the text's SHA-256 and
    xxHash, its SimHash, and its set of five-word shingles by hash, size and sketch; rows with
    the same set have the same node."""
    kind = dict(docs.dtypes)[id_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_heavy()
        for b in slices(batches, "_text"):
            fps, sets = [], []
            for t in utf8_list(b.column("_text")):
                parts = list(shingle_hashes(t, WORDS))
                fps.append(folded(parts))
                sets.append(shingle_set(parts))
            columns = [b.column("_id"), b.column("digest"), b.column("place"), pa.array(fps, pa.int64()), _signed(list(map(node_of, sets))), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch_of, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "digest", "place", "fp", "node", "size", "sketch"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text_digest(text_col).alias("digest"), F.xxhash64(text).alias("place"), text.alias("_text"))
    return stored(rows.mapInArrow(compute, f"_id {kind}, digest binary, place long, fp long, node long, size long, sketch binary"), "shingle-nodes")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(whole_text(text_col).alias("_text"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    nothing_heavy()
    for b in slices(batches, "_text"):
        yield [shingle_set(list(shingle_hashes(t, WORDS))) for t in utf8_list(b.column("_text"))]


def _each(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles in ascending order, and how many sets have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            token, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            held.clear()
            for at in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 100_000]), pa.array(n[at : at + 100_000], pa.int64())], names=["token", "n"])

        for sets in _sets(batches):
            held += sets
            size += sum(map(len, sets))
            if size >= RUN:
                yield from settled()
                size = 0
        yield from settled()

    counts = _texts(docs, text_col).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "token").limit(COMMON).toPandas().sort_values("token")
    return most["token"].to_numpy(np.int64), most["n"].to_numpy(np.int64)


def partners(at: np.ndarray) -> np.ndarray:
    """Which of the sets with one shingle in common, at a place in the order of each (size in
    the upper half of ``at``, place in the lower), may be near another one: as many shingles
    as can be common besides are enough."""
    kind, which, copies = np.unique(at, return_inverse=True, return_counts=True)
    size, place = kind >> 32, kind & 0xFFFFFFFF
    keep = np.zeros(len(kind), bool)
    for k in range(0, len(kind), 512):
        mine = slice(k, k + 512)
        most = np.minimum(place[mine, None], place) + np.minimum((size - place)[mine, None], size - place)
        fine = most * sum(NEAR) >= (size[mine, None] + size) * NEAR[0]
        own = np.arange(k, k + len(fine))
        fine[np.arange(len(fine)), own] &= copies[own] > 1
        keep[mine] = fine.any(1)
    return keep[which]


def shared_prefixes(docs: DataFrame, text_col: str) -> DataFrame:
    """(list, node): nodes with a prefix shingle in common, each list once.  A list of more
    than ``LONG`` is passed on row by row, so no task holds it."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for sets in _sets(batches):
            out = []
            for tokens in sets:
                n = len(tokens)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    heavy = np.where(known[at] == tokens, weight[at], 0)
                    tokens = tokens[np.argsort(heavy, kind="stable")]
                out.append(tokens[: n + (-n * NEAR[0]) // NEAR[1] + 1] if n else tokens)
            taken, sizes = list(map(len, out)), np.fromiter(map(len, sets), np.int64, len(sets))
            nodes = np.array(list(map(node_of, sets)), np.uint64).view(np.int64)
            at = np.repeat(sizes << 32, taken) + ragged(np.zeros(len(out), np.int64), np.array(taken, np.int64))
            columns = [np.concatenate([np.zeros(0, np.int64), *out]), np.repeat(nodes, taken), at]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "node", "at"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        long_token = None

        def rows(keys: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in (keys, members)], names=["list", "node"])

        def found(token: np.ndarray, node: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))[: len(token)]
            token, node, at = token[fresh], node[fresh], at[fresh]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            end = np.append(begin[1:], len(token))
            several = end - begin > 1
            short: dict[int, np.ndarray] = {}
            for a, z in zip(begin[several].tolist(), end[several].tolist()):
                near = node[a:z][partners(at[a:z])]
                if len(near):
                    short.setdefault(node_of(near), near)
            return rows([np.full(len(x), np.uint64(k)).view(np.int64) for k, x in short.items()], list(short.values()))

        for b in batches:  # sorted by token and node
            new = [b.column(c).to_numpy() for c in ("token", "node", "at")]
            if long_token is not None:
                n = int(np.searchsorted(new[0] != long_token, True)) if (new[0] != long_token).any() else len(new[0])
                if n:
                    yield rows([new[0][:n]], [new[1][:n]])
                new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            long_token = None
            c = [np.concatenate([h, x]) for h, x in zip(held, new)]
            last = int(np.searchsorted(c[0], c[0][-1]))
            if last:
                yield found(*(x[:last] for x in c))
            held = [x[last:] for x in c]
            if len(held[0]) > LONG:
                long_token = int(held[0][0])
                yield rows([held[0]], [held[1]])
                held = [np.zeros(0, np.int64)] * 3
        yield found(*held)

    dealt_out = _texts(docs, text_col).mapInArrow(prefixes, "token long, node long, at long").repartition("token").sortWithinPartitions("token", "node")
    return dealt_out.mapInArrow(lists, "list long, node long").distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists whose members ``labels`` (node, label) does not already put in one group; in the
    others every two members are connected."""
    known = lists.join(labels, "node", "left").select("list", F.coalesce("label", "node").alias("group"))
    several = known.groupBy("list").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most")
    return lists.join(several.select("list"), "list", "left_semi").select("list", "node")


def merged(lists: DataFrame, most: int = 4 * BLOCK) -> DataFrame:
    """Lists that have members in common as one, where that has at most so many members;
    every pair within a list stays within one, and a set is compared once for all its lists."""
    first = lists.groupBy("list").agg(F.min("node").alias("a"))
    edges = lists.join(first, "list").select("a", F.col("node").alias("b"))
    labels = components(stored(edges.where("a <> b").distinct(), "list-edges"))
    sizes = stored(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "list-sizes")
    known = lists.join(labels.join(sizes, "label"), "node")
    return known.select(F.when(F.col("n") <= most, F.col("label")).otherwise(F.col("list")).alias("list"), "node").distinct()


def near_pairs(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of ``left`` and ``right`` whose similarity is enough."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(several) - 1
    keep = several[at]
    at, owner = column[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    step = max(1, (1 << 22) // len(sets))
    for low in range(0, int(several.sum()), step):
        a, z = np.searchsorted(at, (low, low + step))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[a:z], at[a:z] - low] = 1
        common += has[left] @ has[right].T
    both = sizes[left][:, None] + sizes[right][None]
    near = common * sum(NEAR) >= both * NEAR[0]
    near &= left[:, None] != right[None]
    x, y = np.nonzero(near)
    return left[x], right[y]


def sketch_pairs(sizes: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of ``left`` and ``right`` that may be near: sets of a and b
    shingles differ in at most (a + b) / 9 then."""
    far = sum(NEAR)
    fold = lambda x, n: x.reshape(-1, n).sum(0, dtype=np.int32)
    coarse = np.stack([fold(x, LEAST_SKETCH) for x in sketches])
    found = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        fine = (rows[:, None] != right[None]) & (np.minimum(sizes[rows][:, None], sizes[right][None]) * NEAR[1] >= np.maximum(sizes[rows][:, None], sizes[right][None]) * NEAR[0])
        i, j = np.nonzero(fine)
        i, j = rows[i], right[j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.abs(coarse[x] - coarse[y]).sum(1) * far <= sizes[x] + sizes[y]
            found.append((x[near], y[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(c) for c in zip(*found))
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    least = np.minimum(width[x], width[y])
    keep = np.ones(len(x), bool)
    for n in np.unique(least[least > LEAST_SKETCH]).tolist():
        which = np.flatnonzero(least == n)
        used = np.unique(np.concatenate([x[which], y[which]]))
        table = np.stack([fold(sketches[u], n) for u in used])
        a, b = np.searchsorted(used, x[which]), np.searchsorted(used, y[which])
        step = max(1, (1 << 22) // n)
        for k in range(0, len(which), step):
            apart = np.abs(table[a[k : k + step]] - table[b[k : k + step]]).sum(1)
            keep[which[k : k + step]] = apart * far <= sizes[x[which[k : k + step]]] + sizes[y[which[k : k + step]]]
    return x[keep], y[keep]


def dealt(lists: DataFrame, block: int) -> DataFrame:
    """(list, s, t, mine, node): members of a list in blocks of about ``block``; each pair of
    blocks is a job, with the members of both."""
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = lists.join(sizes, "list").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("list", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), "mine", "node")


def compared(jobs: DataFrame, near, columns: str) -> DataFrame:
    """(a, b): connects exactly the nodes that the pairs of each job that ``near`` finds
    connect.  ``near`` gets a job's columns as arrays and its members on either side."""
    names = [c.split()[0] for c in columns.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars, held, job = Stars(), [], None

        def settle():
            if len(held) > 1:
                node, mine, *rest = zip(*held)
                node, mine = np.array(node), np.array(mine)
                x, y = near(*rest, np.flatnonzero(mine == job[1]), np.flatnonzero(mine == job[2]))
                stars.add(node[x], node[y])
            held.clear()

        for b in batches:
            jobs = zip(*(b.column(c).to_pylist() for c in ("list", "s", "t")))
            values = [_each(b.column(c)) if pa.types.is_list(b.schema.field(c).type) else b.column(c).to_pylist() for c in names]
            for now, *row in zip(jobs, b.column("node").to_pylist(), b.column("mine").to_pylist(), *values):
                if now != job:
                    settle()
                    job = now
                held.append(row)
        settle()
        a, b = stars.reduce()
        for at in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000]), pa.array(b[at : at + 10_000])], names=["a", "b"])

    sorted_ = jobs.repartition("list", "s", "t").sortWithinPartitions("list", "s", "t")
    return sorted_.select("list", "s", "t", "mine", "node", *names).mapInArrow(work, "a long, b long").distinct()


def candidates(nodes: DataFrame, lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """(list, node): groups that together hold every pair of nodes within ``lists`` whose
    sketches allow it; a node is in one of them at most."""

    def near(size: tuple, sketch: tuple, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sketch_pairs(np.array(size), [np.frombuffer(x, np.uint8) for x in sketch], left, right)

    jobs = stored(dealt(merged(lists), block), "jobs")
    sketches = nodes.select("node", "size", "sketch").dropDuplicates(["node"])
    found = stored(compared(jobs.join(sketches, "node"), near, "size long, sketch binary"), "alike")
    return components(found).select(F.col("label").alias("list"), "node")


def links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(a, b): connects exactly the nodes that pairs of enough similarity within ``groups``
    connect.  ``nodes`` tells which text a node's set is taken from."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _sets(batches):
            yield pa.RecordBatch.from_arrays([_signed(list(map(node_of, found))), _lists(found)], names=["node", "tokens"])

    def near(tokens: tuple, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return near_pairs(np.array(list(map(len, tokens))), list(tokens), left, right)

    jobs = stored(dealt(groups, block), "jobs")
    wanted = stored(nodes.join(jobs.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("place").alias("place")).select("place").distinct(), "wanted")
    # The list grows with the table, so it is joined by sorting, never broadcast.
    chosen = _texts(docs.join(wanted.hint("merge"), F.xxhash64(whole_text(text_col)) == wanted["place"], "left_semi"), text_col)
    needed = stored(chosen.mapInArrow(sets, "node long, tokens array<long>").dropDuplicates(["node"]), "needed-sets")
    return compared(jobs.join(needed, "node"), near, "tokens array<long>")
