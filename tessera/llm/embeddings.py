"""Embedding near-duplicates by a random-projection tree forest.

Trees are fitted in tasks, each on a bounded sample: a node splits at the median of a random projection, and vectors
within a margin of it go to both sides (spill), down to leaves of about LEAF vectors. Leaves that hold more
than FULL times as many, as the sample grows thin in a large table, are split again by trees of their own,
fitted in a task on a bounded sample of that leaf, until none is too full or can be split. Dense groups that no
margin splits without parting their pairs stay whole, as larger leaves. All vectors are compared within their
leaves in double precision, and pairs with a cosine of at least the threshold are kept. The number of trees
follows from the fitted nodes, so that a pair at the threshold shares a leaf with the target probability.

A leaf over TILE vectors is compared in square blocks, a task each, so no task holds more than two blocks. A
pair that shares several leaves counts in the first of them alone, which both its vectors' lists of leaves
tell; so a task returns one row a vector with its links counted, and pairs never leave it. Equal vectors are one
class, whose first member stands for it. Comparing a dense group costs the square of its size, as each of
its pairs may be a link.

Cases: null or empty vectors, zero vectors and vectors with null or non-finite components link with
nothing and are components of their own; vectors of other lengths never link; repeated ids are rows of
their own, and an id is linked where any of its rows is; a null id counts as the smallest, so a component
with one has a null component_id; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cleared, spread, stored
from tessera.llm.components import connected_components

LEAF, TILE, SAMPLE, SPILL, TARGET = 400, 1024, 20_000, 0.15, 0.99
#: A leaf is split again beyond so many times LEAF, in so many rounds at most; CHUNK vectors a task are routed.
FULL, ROUNDS, CHUNK = 8, 12, 50_000
#: Stands for a null id.
NO_ID = -(1 << 63)
#: The quantile of rows that margins and trees must suit, the planes tried at a node, and the share of its comparisons a split may leave.
LOW, PLANES, PAYS = 0.05, 3, 0.9


class Tree:
    """Nodes in arrays: seed of the direction, threshold, margin, children; negative children are leaves. A
    direction is drawn from its seed again wherever it is needed, so a tree is small at any number of dimensions.

    A margin is at least `spill` of a node's spread, and so wide that a pair at the threshold near the
    node's mean parts no more often than one in a node of spread 1. Where that leaves both sides nearly
    whole, as in dense groups, the node is a leaf, whatever its size. `meets` holds for each leaf's sample
    rows the probability that such a pair at that row was parted by no node on its way."""

    def __init__(self, sample: np.ndarray, leaf: float, spill: float, seed: int, gap: float):
        self.seed, self.tried, self.leaf, self.spill, self.gap = seed, 0, leaf, spill, gap
        self.seeds, self.cuts, self.margins, self.sides, self.leaves, self.depth = [], [], [], [], 0, 0
        self.meets = np.ones(len(sample))
        self.root = self._grow(sample, np.arange(len(sample)), np.ones(len(sample), bool), 0)
        self.seeds, self.cuts, self.margins = np.array(self.seeds, "i8"), np.array(self.cuts), np.array(self.margins)

    def direction(self, number: int, dims: int) -> np.ndarray:
        return np.random.default_rng((self.seed, number)).standard_normal(dims)

    def _grow(self, sample: np.ndarray, at_rows: np.ndarray, home: np.ndarray, depth: int) -> int:
        """Rows reach a node by the margin too; `home` marks those on their own side of all cuts above."""
        self.depth = max(self.depth, depth)
        if len(at_rows) > self.leaf and depth < 40:
            rows = sample[at_rows]
            radii = np.linalg.norm(rows - rows.mean(0), axis=1)
            allowed = parted(self.gap, 1.0, self.spill)
            least = margin_for(self.gap, float(np.quantile(radii, LOW)), allowed)
            for _ in range(PLANES):
                self.tried += 1
                at = rows @ self.direction(self.tried, rows.shape[1])
                cut, margin = float(np.median(at)), max(float(self.spill * at.std()), least)
                left, right = at <= cut + margin, at > cut - margin
                if left.sum() ** 2 + right.sum() ** 2 < PAYS * len(rows) ** 2 and left.any() and right.any():
                    node = len(self.seeds)
                    self.seeds.append(self.tried)
                    self.cuts.append(cut)
                    self.margins.append(margin)
                    self.sides.append([0, 0])
                    own = at_rows[home]
                    self.meets[own] *= 1 - parted(self.gap, radii[home], margin)
                    low = at <= cut
                    self.sides[node] = [self._grow(sample, at_rows[left], (home & low)[left], depth + 1), self._grow(sample, at_rows[right], (home & ~low)[right], depth + 1)]
                    return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions) of all leaves that rows reach."""
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield -node, own
                continue
            at = rows[own] @ self.direction(int(self.seeds[node]), rows.shape[1])
            todo.append((self.sides[node][0], own[at <= self.cuts[node] + self.margins[node]]))
            todo.append((self.sides[node][1], own[at > self.cuts[node] - self.margins[node]]))


def _beyond(a: float) -> float:
    """E max(0, |z| - a) of a standard normal z."""
    return 2 * (math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * math.erfc(a / math.sqrt(2)) / 2)


def parted(gap: float, radius, margin: float):
    """Probability that a node parts a pair `gap` apart that lies `radius` from the node's mean: the cut falls
    between its projections by more than the margin on both sides."""
    return np.minimum(0.999, gap * _beyond(2 * margin / gap) * 0.4 / np.maximum(radius, 1e-12)) if gap else 0.0 * radius


def margin_for(gap: float, radius: float, allowed: float) -> float:
    """The least margin that parts such a pair with at most the allowed probability."""
    low, high = 0.0, 4 * gap
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if parted(gap, radius, middle) <= allowed else (middle, high)
    return high


def trees_for(meets: np.ndarray, target: float, deeper: float = 1.0) -> int:
    """Trees needed so that pairs at the threshold meet in a leaf with the target probability, even where
    the sample's rows are least likely to; deeper: how many times as deep as the fitted tree the whole one is."""
    meet = float(np.quantile(meets, LOW)) ** deeper
    return max(4, math.ceil(math.log(1 - target) / math.log(1 - min(max(meet, 0.02), 0.999))))


def _unit(column: pa.Array) -> tuple[list[bytes | None], list[int]]:
    out, dims = [], []
    for v in column.to_pylist():
        a = np.asarray(v, "f8") if v and None not in v else np.zeros(0)
        a = np.where(a == 0, 0.0, a)
        top = np.abs(a).max() if len(a) and np.isfinite(a).all() else 0.0
        out.append((a / top / np.linalg.norm(a / top)).tobytes() if top > 0 else None)
        dims.append(len(a))
    return out, dims


@cleared
def near_vectors(vectors: DataFrame, threshold: float = 0.9, leaf: int = LEAF, spill: float = SPILL, target: float = TARGET, sample: int = SAMPLE, tile: int = TILE, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims = _unit(batch.column(1))
            keys = [hashlib.blake2b(u, digest_size=16).digest() if u else None for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "key", "dim", "unit"])

    own_id = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id")
    rows = stored(vectors.select(own_id, "embedding").mapInArrow(prepare, "vec_id long, key binary, dim int, unit binary"), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("vec_id", "dim", "unit")).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select("key", "copies", "first.*").withColumnRenamed("vec_id", "rep"), "vector-classes")
    placed = _split_full(_placed(classes, threshold, leaf, spill, target, sample, seed), classes, threshold, leaf, spill, seed)
    linked = stored(_linked(placed, classes, threshold, tile), "vector-links")
    reached = linked.groupBy("key").agg(F.sum("links").alias("others"))
    parts = connected_components(linked.select("rep", "root").distinct(), "rep", "root")
    about = classes.join(reached, "key", "left").join(parts, classes.rep == parts.node, "left")
    about = about.select("key", F.col("rep").alias("_rep"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    found = rows.select("vec_id", "key").join(about, "key", "left")
    own, known = F.coalesce("_component", "vec_id"), lambda c: F.nullif(c, F.lit(NO_ID))
    return found.select(known(F.col("vec_id")).alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), known(own).alias("component_id"), (F.col("vec_id") == own).alias("kept"))


def _points(units: pa.ChunkedArray | pa.Array) -> np.ndarray:
    held = units.to_pylist()
    return np.frombuffer(b"".join(held), "f8").reshape(len(held), -1)


def _fitted(drawn: DataFrame, numbers: Iterable[int], n: int, leaf: int, spill: float, target: float, seed: int, gap: float) -> list:
    """(number, needed, tree): the trees of these numbers, each fitted in a task on the whole sample, and how many are needed."""

    def fit(table: pa.Table) -> pa.Table:
        points, number = _points(table.column("unit")), table.column("number")[0].as_py()
        points = points[np.lexsort(points.T[:8][::-1])]  # rows come in any order
        scaled = max(8.0, leaf * len(points) / n)
        tree = Tree(points, scaled, spill, seed + number, gap)
        deeper = 1 + max(0.0, math.log2(scaled * n / len(points) / leaf)) / max(tree.depth, 1)
        needed = trees_for(tree.meets, target, deeper) if tree.depth else 1
        del tree.meets
        return pa.table({"number": pa.array([number], pa.int32()), "needed": pa.array([needed], pa.int32()), "tree": pa.array([cloudpickle.dumps(tree)], pa.binary())})

    each = drawn.withColumn("number", F.explode(F.array(*map(F.lit, numbers))))
    return spread(each, "number").groupBy("number").applyInArrow(fit, "number int, needed int, tree binary").orderBy("number").collect()


def _placed(classes: DataFrame, threshold: float, leaf: int, spill: float, target: float, sample: int, seed: int) -> DataFrame:
    """(leaf, key) of every class in the leaves of all trees."""
    spark = classes.sparkSession
    forests: dict[int, list[Tree]] = {}
    gap = math.sqrt(max(2 - 2 * threshold, 0.0))
    for dim, n in classes.groupBy("dim").count().filter(F.col("count") > leaf).collect():  # one row for each length of many vectors
        drawn = stored(classes.filter(F.col("dim") == dim).orderBy("key").select("unit").limit(sample), "vector-sample")  # digests order at random

        fitted = lambda numbers: _fitted(drawn, numbers, n, leaf, spill, target, seed, gap)  # noqa: E731,B023
        trees = fitted([0])
        if trees[0].needed > 1:
            trees += fitted(range(1, trees[0].needed))
        forests[dim] = [cloudpickle.loads(r.tree) for r in trees]  # some numbers a node, whatever the vectors' length
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(forests))  # nodes of trees on a bounded sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_forests = cloudpickle.loads(shared.value)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                keys, trees = batch.column(0).take(own), own_forests.get(int(dim))
                if trees is None:  # few vectors are one leaf
                    yield pa.RecordBatch.from_arrays([pa.array([f"{dim}.0.0"] * len(keys)), keys], ["leaf", "key"])
                    continue
                points = _points(batch.column(2).take(own))
                for t, tree in enumerate(trees):
                    for leaf_id, at in tree.place(points):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{dim}.{t}.{leaf_id}"] * len(at)), keys.take(pa.array(at))], ["leaf", "key"])

    return stored(classes.select("key", "dim", "unit").mapInArrow(place, "leaf string, key binary"), "vector-leaves")


def _split_full(placed: DataFrame, classes: DataFrame, threshold: float, leaf: int, spill: float, seed: int) -> DataFrame:
    """The same with leaves of more than FULL * leaf classes split by trees of their own."""
    gap, most = math.sqrt(max(2 - 2 * threshold, 0.0)), 2 * FULL * leaf

    def fit(table: pa.Table) -> pa.Table:
        name, n = table.column("leaf")[0].as_py(), table.column("n")[0].as_py()
        points = _points(table.column("unit"))
        number = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little")
        tree = Tree(points, max(8.0, leaf * len(points) / n), spill, seed + number, gap)
        del tree.meets
        blob = cloudpickle.dumps(tree) if tree.depth else None
        return pa.table({"leaf": pa.array([name]), "n": pa.array([n], pa.int64()), "tree": pa.array([blob], pa.binary())})

    def route(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, keys = [], []
        if left.num_rows and right.num_rows:
            tree, name = cloudpickle.loads(right.column("tree")[0].as_py()), right.column("leaf")[0].as_py()
            own = left.column("key").combine_chunks()
            for leaf_id, at in tree.place(_points(left.column("unit"))):
                names += [f"{name}.{leaf_id}"] * len(at)
                keys.append(own.take(pa.array(at)))
        return pa.table({"leaf": pa.array(names, pa.string()), "key": pa.chunked_array(keys, pa.binary())})

    done = None
    for _ in range(ROUNDS):
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
        full = stored(sizes.filter(F.col("n") > FULL * leaf), "full-leaves")
        if full.isEmpty():
            break
        # A bounded sample of each leaf, by a top-k that every task applies before the shuffle too.
        first = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("key", "leaf"), "key"))
        drawn = placed.join(full, "leaf").withColumn("_r", first).filter(F.col("_r") <= most).drop("_r")
        trees = stored(spread(drawn.join(classes.select("key", "unit"), "key"), "leaf").groupBy("leaf").applyInArrow(fit, "leaf string, n long, tree binary"), "leaf-trees").filter("tree IS NOT NULL")
        names = trees.select("leaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        own = placed.join(names, "leaf").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        own = own.select("leaf", "chunk", "key").join(classes.select("key", "unit"), "key")
        each = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK).cast("int") - 1))).select("leaf", "chunk", "tree")
        routed = own.groupBy("leaf", "chunk").cogroup(each.groupBy("leaf", "chunk")).applyInArrow(route, "leaf string, key binary")
        stays = placed.join(names.select("leaf"), "leaf", "left_anti")
        done = stays if done is None else done.unionByName(stays)
        placed = stored(routed, "vector-leaves")
    return placed if done is None else done.unionByName(placed)


def _linked(placed: DataFrame, classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(key, rep, links, root) for each block and class with links in it; links count each pair in one block alone."""
    numbered = placed.withColumn("leaf", F.xxhash64("leaf"))
    lists = numbered.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # some for each tree
    sizes = numbered.groupBy("leaf").agg(F.count("*").alias("n"))
    split = numbered.join(sizes, "leaf").filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    # A leaf of k blocks is k * (k + 1) / 2 tasks; a vector goes to those of its own block.
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    split = split.select("key", "leaf", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sent = split.join(classes.select("key", "rep", "copies", "unit").join(lists, "key"), "key")

    def compare(table: pa.Table) -> pa.Table:
        leaf, low, high = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
        keys, own = table.column("key").combine_chunks(), table.column("own").to_numpy()
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        points = _points(table.column("unit"))
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, root = np.zeros(len(reps), "i8"), reps.copy()
        before = [[x for x in leaves if x < leaf] for leaves in table.column("leaves").to_pylist()]
        found = []
        for i in range(0, len(left), 512):
            part = left[i : i + 512]
            hit = points[part] @ points[right].T >= threshold
            if low == high:
                hit[np.arange(len(part)), i + np.arange(len(part))] = False
            if hit.any():
                hit &= ~_meet_before(before, part, right)
                links[part] += hit @ copies[right]
                if low != high:
                    links[right] += copies[part] @ hit
                found.append((part, hit))
        moved = bool(found)
        while moved:  # the smallest id that each row reaches in this block
            old = root.copy()
            for part, hit in found:
                ids = np.where(hit, root[right][None, :], np.iinfo("i8").max).min(1, initial=np.iinfo("i8").max)
                root[part] = np.minimum(root[part], ids)
                ids = np.where(hit, root[part][:, None], np.iinfo("i8").max).min(0, initial=np.iinfo("i8").max)
                root[right] = np.minimum(root[right], ids)
            moved = bool((old != root).any())
        out = np.flatnonzero(links)
        return pa.table({"key": keys.take(pa.array(out)), "rep": pa.array(reps[out]), "links": pa.array(links[out]), "root": pa.array(root[out])})

    return spread(sent, "leaf", "low", "high").groupBy("leaf", "low", "high").applyInArrow(compare, "key binary, rep long, links long, root long")


def _meet_before(before: list[list[int]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of left and right rows shares one of the leaves listed before this one."""
    shared = np.zeros((len(left), len(right)), bool)
    a, b = {}, {}
    for rows, held in ((left, a), (right, b)):
        for k, r in enumerate(rows.tolist()):
            for x in before[r]:
                held.setdefault(x, []).append(k)
    common = [x for x in a if x in b]
    for i in range(0, len(common), 512):
        some = common[i : i + 512]
        x, y = np.zeros((len(left), len(some)), "f4"), np.zeros((len(right), len(some)), "f4")
        for k, name in enumerate(some):
            x[a[name], k] = y[b[name], k] = 1
        shared |= x @ y.T > 0
    return shared
