"""SimHash near-deduplication by a self-join of binary tries.

Distinct fingerprints are cut into six blocks of bits.  Two fingerprints that differ in at
most four bits agree in two whole blocks, so for each of the 15 pairs of blocks the bits are
reordered with that pair in front, and fingerprints that share it form the root of a trie.
The bits below a root with many fingerprints are cut into six blocks again, and so on; what
is left of 64 bits after three cuts bounds every trie.  From each root, pairs of nodes are
traversed together, level by level: differing bits are added up, and a pair whose sum
exceeds the budget is dropped with all that is below it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, scratch, slices, stored, utf8_list, whole_text, without

# Fixed values of the contract.
WORDS, SEED, BUDGET = 4, 42, 4

BLOCKS = 6
PAIRS = tuple(combinations(range(BLOCKS), 2))
#: A root with more fingerprints than this is cut again.
ROOT_ROWS = 20_000
CUTS = 3
#: Node pairs that are held at a time.
FRONTIER = 1 << 20
#: Bytes of a text that are hashed at a time.
PART = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The hash of every shingle of so many words, part by part; a text of fewer words is
    one shingle, one of none has no hash."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    text = text.lower()  # bytes: A-Z only, as white space below is the six ASCII signs
    at, held, first = 0, [], True
    while at < len(text):
        end = _SPACE.search(text, at + PART)
        end = end.start() if end else len(text)
        held += text[at:end].split()
        at = end
        last = at >= len(text)
        if len(held) < words and not (last and first and held):
            continue
        line = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        k = min(words, len(held))
        begin = np.concatenate(([0], ends[: len(held) - k])).tolist()
        yield np.array([digest(line[a : b - 1], SEED) for a, b in zip(begin, ends[k - 1 :].tolist())], np.uint64)
        held, first = held[len(held) - words + 1 :], False


def folded(parts: list[np.ndarray]) -> int:
    """Bit k is set if it is in more than half of the hashes; signed 64 bits."""
    sums, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            sums += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n).view(">i8")[0])


def fingerprint(text: bytes) -> int:
    return folded(shingle_hashes(text, WORDS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) for each row, null texts as empty; other columns are not read."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            values = [fingerprint(t) for t in utf8_list(b.column("_text"))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(values, pa.int64())], names=["_id", "fp"])

    rows = docs.select(row_id(docs, id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return stored(rows.mapInArrow(compute, "_id long, fp long"), "fingerprints")


def widths(bits: int) -> list[int]:
    """Six blocks of so many bits, the wider ones first."""
    return [bits // BLOCKS + (i < bits % BLOCKS) for i in range(BLOCKS)]


def reordered(bits: np.ndarray, used: int, pair: tuple[int, int]) -> np.ndarray:
    """The first ``used`` bits as they are, then the blocks of ``pair`` among the others."""
    sizes = widths(64 - used)
    tops = used + np.cumsum((0, *sizes))
    out = bits >> np.uint64(64 - used) << np.uint64(64 - used) if used else np.zeros_like(bits)
    left = 64 - used
    for block in (*pair, *(i for i in range(BLOCKS) if i not in pair)):
        width = sizes[block]
        left -= width
        out |= (bits >> np.uint64(64 - tops[block] - width) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out


def joined_nodes(bits: np.ndarray, first: np.ndarray, second: np.ndarray, depth: np.ndarray, errors: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within the budget, from pairs of nodes.

    ``bits`` are sorted within each node; a node is a range (begin, end) of positions; the
    two nodes of a pair stand at the same depth and are equal or apart.
    """
    todo = [(first, second, depth, errors)]
    while todo:
        a, b, d, e = todo.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [(a[:half], b[:half], d[:half], e[:half]), (a[half:], b[half:], d[half:], e[half:])]
            continue
        leaf = (a[:, 1] - a[:, 0] == 1) & (b[:, 1] - b[:, 0] == 1)
        x, y = a[leaf, 0], b[leaf, 0]
        near = (x != y) & (np.bitwise_count(bits[x] ^ bits[y]) <= budget)
        if near.any():
            yield x[near], y[near]
        a, b, d, e = a[~leaf], b[~leaf], d[~leaf], e[~leaf]
        open_ = d < 64
        a, b, d, e = a[open_], b[open_], d[open_], e[open_]
        if not len(a):
            continue
        split_a, split_b = _split(bits, a, d), _split(bits, b, d)
        same = a[:, 0] == b[:, 0]
        children = []
        for i in (0, 1):
            for j in (0, 1):
                u = np.stack([a[:, 0], split_a] if i == 0 else [split_a, a[:, 1]], 1)
                v = np.stack([b[:, 0], split_b] if j == 0 else [split_b, b[:, 1]], 1)
                cost = e + (i != j)
                keep = (u[:, 0] < u[:, 1]) & (v[:, 0] < v[:, 1]) & (cost <= budget)
                if i > j:
                    keep &= ~same  # of two equal nodes the mirrored pair
                if i == j:
                    keep &= ~(same & (u[:, 1] - u[:, 0] == 1))
                children.append((u[keep], v[keep], d[keep] + 1, cost[keep]))
        todo.append(tuple(np.concatenate(c) for c in zip(*children)))


def _split(bits: np.ndarray, nodes: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where in each node the bit at its depth turns from 0 to 1, by binary search."""
    low, high = nodes[:, 0].copy(), nodes[:, 1].copy()
    shift = (63 - depth).astype(np.uint64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        one = (bits[np.minimum(middle, len(bits) - 1)] >> shift & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)


class Stars:
    """Links among values, kept as one link from each value to its group's smallest."""

    def __init__(self):
        self.a, self.b, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.size > 4 * FRONTIER:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes, at = np.unique(np.concatenate([*self.a, *self.b]), return_inverse=True)
        u, v = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(nodes))
        a, b = nodes[far], nodes[root[far]]
        self.a, self.b, self.size = [a], [b], len(a)
        return a, b


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under 15 roots below the root that it is in."""
    for batch in batches:
        path, used, bits, fp = (batch.column(c).to_numpy() for c in ("path", "used", "bits", "fp"))
        for before in np.unique(used).tolist():
            mine = used == before
            for p, pair in enumerate(PAIRS):
                width = before + sum(widths(64 - before)[i] for i in pair)
                new = reordered(bits[mine].view(np.uint64), before, pair)
                root = (new >> np.uint64(64 - width)).view(np.int64)
                columns = [path[mine] * 16 + p + 1, np.full(len(new), width, np.int32), root, new.view(np.int64), fp[mine]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["path", "used", "root", "bits", "fp"])


ROOTED = "path long, used int, root long, bits long, fp long"


def rooted(distinct: DataFrame, root_rows: int) -> DataFrame:
    """Fingerprints by root (path of block pairs and the bits that it fixes)."""
    rows = distinct.select(F.lit(0).cast("long").alias("path"), F.lit(0).alias("used"), F.col("fp").alias("bits"), "fp").mapInArrow(_spread, ROOTED)
    done = None
    for level in range(CUTS):
        heavy = None
        if level + 1 < CUTS:
            heavy = stored(rows.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > root_rows).select("path", "root"), "heavy-roots")
            heavy = None if heavy.isEmpty() else heavy
        light = rows if heavy is None else rows.join(heavy, ["path", "root"], "left_anti").select("path", "used", "root", "bits", "fp")
        done = light if done is None else done.unionByName(light)
        if heavy is None:
            break
        rows = rows.join(heavy, ["path", "root"], "left_semi").select("path", "used", "bits", "fp").mapInArrow(_spread, ROOTED)
    return done


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut only where one of ``keys`` changes."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = {n: b.column(n).to_numpy() for n in b.schema.names}
        if held and any(held[-1][k][-1] != new[k][0] for k in keys):
            yield {n: np.concatenate([h[n] for h in held]) for n in new}
            held = []
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= new[k][1:] != new[k][:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            held.append({n: x[:last] for n, x in new.items()})
            yield {n: np.concatenate([h[n] for h in held]) for n in new}
            held = []
        held.append({n: x[last:] for n, x in new.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def links(distinct: DataFrame, root_rows: int = ROOT_ROWS) -> DataFrame:
    """(a, b) over a table of distinct ``fp``: connects exactly those fingerprints that a
    chain of steps of at most four bits connects.  Within a task, a group of fingerprints is
    linked to its smallest instead of all to all."""

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars()
        for c in whole_groups(batches, ("path", "root")):  # each root is whole and sorted
            bits = c["bits"].view(np.uint64)
            change = np.zeros(len(bits), bool)
            for n in ("path", "root"):
                change[1:] |= c[n][1:] != c[n][:-1]
            begin = np.concatenate(([0], np.flatnonzero(change)))
            node = np.stack([begin, np.append(begin[1:], len(bits))], 1)
            node = node[node[:, 1] - node[:, 0] > 1]
            # Unsigned order below a root is that of the signed bits: all share the first.
            depth = c["used"][node[:, 0]].astype(np.int64)
            for x, y in joined_nodes(bits, node, node, depth, np.zeros(len(node), np.int64)):
                stars.add(c["fp"][x], c["fp"][y])
        a, b = stars.reduce()
        for at in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000]), pa.array(b[at : at + 10_000])], names=["a", "b"])

    dealt = rooted(distinct, root_rows).repartition("path", "root").sortWithinPartitions("path", "root", "bits")
    return dealt.mapInArrow(traverse, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is its component's smallest
    node.  Each round every node points to its smallest neighbour, if that is smaller, and so
    to the smallest of its tree; trees become nodes, and only edges between them go on.  So
    edges are joined about once, not in every round."""
    left = stored(_ordered(edges), "edges")
    labels = None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        roots = stored(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "roots")
        while True:
            onward = roots.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = stored(roots.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "roots")
            roots = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            onward = roots.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stored(labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        root = lambda end: roots.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        apart = left.join(root("a"), "a").join(root("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = stored(_ordered(apart), "edges")
        if left.isEmpty():
            return labels


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other.  component_id is
    the smallest non-null id that can be reached; repeated rows keep a row each.  Ids that
    are no numbers are null.  Other columns are not read.
    """
    prints = fingerprints(docs, id_col, text_col)
    with scratch(docs.sparkSession) as outliving:
        nodes = stored(prints.groupBy("fp").agg(F.min("_id").alias("least_id")), "nodes")
        labels = components(stored(links(nodes), "links"))
        known = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        known = stored(known.select("fp", "least_id", F.coalesce("label", "fp").alias("label")), "labelled")
        smallest = stored(known.groupBy("label").agg(F.min("least_id").alias("component_id")), "smallest")
        table = outliving(known.join(smallest, "label").select("fp", "component_id"), "components")
    return prints.join(table, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of texts that pairs with a
    similarity of 0.8 or more in five-word shingles connect, the one with the smallest id,
    and one row of it.

    The tries come first: what they group is compared, by sketches and then, for every link,
    on the whole sets.  Near copies also lie further apart than four bits, so all sets with a
    prefix shingle in common are compared too, but for lists that the tries' links already
    connect.  Null ids never win against others.
    """
    from . import shingle_join

    with scratch(docs.sparkSession) as outliving:
        nodes = shingle_join.shingle_nodes(docs, id_col, text_col)
        prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "nodes")
        tries = stored(components(stored(links(prints), "links")), "tries")
        grouped = nodes.select("fp", "node").distinct().join(tries.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        starred = grouped.join(prints.select(F.col("fp").alias("label"), F.col("node").alias("centre")), "label").where("node <> centre")
        starred = starred.select(F.xxhash64("centre", "node").alias("list"), F.explode(F.array("centre", "node")).alias("node"))
        compared = lambda lists: stored(shingle_join.links(docs, nodes, stored(shingle_join.candidates(nodes, lists), "candidates"), text_col), "links")
        found = compared(stored(starred, "tried"))
        lists = stored(shingle_join.open_lists(stored(shingle_join.shared_prefixes(docs, text_col), "lists"), components(found)), "open-lists")
        labels = components(found.unionByName(compared(lists)))

        rows = nodes.join(labels, "node", "left").select("_id", "digest", F.coalesce("label", "node").alias("label"))
        rows = stored(rows.groupBy("_id", "digest", "label").agg(F.count(F.lit(1)).alias("copies")), "labelled")
        place = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("digest").alias("digest"))
        keep = stored(rows.groupBy("label").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "keep")
        gone = outliving(rows.join(keep, "label").where(~place.eqNullSafe(F.col("keep"))).select("_id", "digest"), "dropped")
        twice = outliving(rows.where("copies > 1").select("_id", "digest"), "repeated")
    return without(docs, gone, twice, id_col, text_col)
