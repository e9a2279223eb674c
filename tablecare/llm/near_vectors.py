"""Near duplicates among vectors by a forest of random-projection trees.

Each tree splits the vectors level by level along random directions at the median of its node;
rows within ``spill`` (a share of the node's rows) of the cut go to both sides. Medians are
fitted on a sample of about ``sample_rows`` rows taken by hash, as deep as the sample carries;
every row is routed through every tree. Rows that meet in a leaf are compared by cosine in double
precision; a leaf above ``leaf_rows`` is first split further the same way inside its task. Pairs
found in any tree are united.

Dense clusters never enter the forest, whose cuts would part them. A pivot is set wherever the
sample shows more links than fill half a leaf. A cell's radius is the largest angle at which the sample
has a row that is nearest to the pivot, the link angle at most. Rows within it are the core of the
cell (a row has one core at most); whatever they link to lies within the radius plus the link
angle. Core and surroundings are compared whole, in pairs of slices dealt over tasks, so that core
rows have all of their links; core rows within half the link angle all link and are counted
without being compared. Cells give link counts and enough links to connect their rows, not a row
per link. Rows beyond every radius take part in the forest.

Equal vectors are one throughout and count as links of each other. Vectors that are null, empty,
zero or hold null or non-finite numbers link with nothing; vectors of different length neither.
Rows with a null id take part; a component's id is its smallest id. What a pair's trees all
separate is missed: with the defaults, recall on the given tables is above 0.99 (see the tests).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.components import components
from tablecare.llm.frames import durable

SAMPLE_BYTES = 32 * 1024 * 1024
SLICE_BYTES = 32 * 1024 * 1024
SLICE_ROWS = 4096
INNER, OUTER, OWNED, FREE, REST = range(5)  # core within half the link angle, other core; others' core, no core; outside


@dataclass
class Forest:
    """For ``trees`` trees of ``depth`` levels: directions per level, lower and upper cut per node."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trees: int
    depth: int

    def route(self, vectors: np.ndarray):
        """(tree, rows, leaves) for each tree."""
        projected = vectors @ self.directions.reshape(self.trees * self.depth, -1).T if self.depth else None
        for tree in range(self.trees):
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                at = projected[row, tree * self.depth + level]
                cut = (1 << level) - 1 + node
                left, right = at <= self.high[tree, cut], at >= self.low[tree, cut]
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            yield tree, row, node


def fit_forest(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int = 11) -> Forest:
    draw = np.random.default_rng(seed)
    directions = draw.normal(size=(trees, depth, sample.shape[1]))
    low, high = (np.zeros((trees, max(1, (1 << depth) - 1))) for _ in range(2))
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            at = sample @ directions[tree, level]
            middle = np.zeros(1 << level)
            for k in range(1 << level):
                own = at[node == k]
                if len(own):
                    cut = (1 << level) - 1 + k
                    low[tree, cut], middle[k], high[tree, cut] = np.quantile(own, [0.5 - spill, 0.5, 0.5 + spill])
            node = 2 * node + (at > middle[node])
    return Forest(directions, low, high, trees, depth)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, scaled first so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def blocks(vectors: np.ndarray, rows: np.ndarray, most: int, spill: float, draw) -> list[np.ndarray]:
    """``rows`` cut into blocks of at most ``most`` by random splits with spill."""
    if len(rows) <= most:
        return [rows]
    at = vectors[rows] @ draw.normal(size=vectors.shape[1])
    low, high = np.quantile(at, [0.5 - spill, 0.5 + spill])
    left, right = rows[at <= high], rows[at >= low]
    if len(left) == len(rows) or len(right) == len(rows):  # no cut exists between equal projections
        half = np.argsort(at, kind="stable")
        left, right = rows[half[: len(rows) * 5 // 8]], rows[half[len(rows) * 3 // 8 :]]
    return blocks(vectors, left, most, spill, draw) + blocks(vectors, right, most, spill, draw)


@dataclass
class Cells:
    """Unit pivots of dense clusters, the cosine that bounds an inner core, and per pivot those of core and surroundings."""

    pivots: np.ndarray
    inner: float
    core: np.ndarray
    around: np.ndarray

    def owners(self, cosines: np.ndarray) -> np.ndarray:
        """The cell whose core each row belongs to, or -1."""
        nearest = cosines.argmax(axis=1)
        return np.where(cosines[np.arange(len(cosines)), nearest] >= self.core[nearest], nearest, -1)


def fit_cells(sample: np.ndarray, threshold: float, least: float) -> Cells:
    """A pivot wherever a row of the sample has at least ``least`` links among the rows not yet in a core."""
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    core = min(threshold, np.cos(angle)) - 1e-9
    inner = float(np.cos(angle / 2 - 1e-7)) if angle > 2e-7 else 2.0
    left, tried, pivots = sample.astype(np.float32), 0, []
    while tried < len(left):
        asked = left[tried : tried + 512]
        links = np.zeros(len(asked), np.int64)
        for lo in range(0, len(left), 8192):
            links += np.count_nonzero(asked @ left[lo : lo + 8192].T >= core, axis=1)
        if links.max() < least:
            tried += len(asked)
            continue
        best = asked[links.argmax()]
        middle = left[left @ best >= core].mean(axis=0)
        middle /= max(np.linalg.norm(middle), 1e-30)
        near = left @ middle >= core
        if near.sum() < least:
            middle, near = best, left @ best >= core
        tried -= np.count_nonzero(near[:tried])
        left = left[~near]
        pivots.append(middle.astype(np.float64))
    pivots = unit(np.array(pivots)) if pivots else np.zeros((0, sample.shape[1]))
    farthest = np.ones(len(pivots))
    for lo in range(0, len(sample) if len(pivots) else 0, 4096):
        cosines = sample[lo : lo + 4096] @ pivots.T
        nearest = cosines.argmax(axis=1)
        at = cosines[np.arange(len(cosines)), nearest]
        np.minimum.at(farthest, nearest[at >= core], at[at >= core])
    # rows that the sample does not show reach a little further
    radius = np.minimum(angle, np.arccos(np.clip(farthest, -1, 1)) * 1.05 + 1e-6)
    return Cells(pivots, inner, np.maximum(core, np.cos(radius)), np.cos(np.minimum(np.pi, radius + angle)) - 1e-6)


def _placed(cells: Cells, length: int):
    """Every row as core, with its cell, or as outside; and once for each other cell that it is near to."""

    def places(batches):
        for batch in batches:
            key, copies, column = (batch.column(k) for k in range(3))
            for lo in range(0, batch.num_rows, 4096):
                part = column.slice(lo, 4096)
                cosines = unit(_matrix(part, length)) @ cells.pivots.T
                owner = cells.owners(cosines)
                own = np.arange(len(owner))
                kind = np.where(cosines[own, np.maximum(owner, 0)] >= cells.inner, INNER, OUTER)
                kind[owner < 0] = REST
                row, cell = np.nonzero((cosines >= cells.around) & (np.arange(len(cells.pivots)) != owner[:, None]))
                kind = np.concatenate([kind, np.where(owner[row] < 0, FREE, OWNED)])
                take, cell = np.concatenate([own, row]), np.concatenate([owner, cell])
                for at in range(0, len(take), 4096):
                    some = pa.array(take[at : at + 4096])
                    marks = [pa.array(v[at : at + 4096].astype(np.int32)) for v in (cell, kind)]
                    rows = [v.take(some) for v in (key.slice(lo, 4096), copies.slice(lo, 4096), part)]
                    yield pa.RecordBatch.from_arrays([*marks, *rows], names=["cell", "kind", "key", "copies", "vector"])

    return places


def _slice_pair(length: int, threshold: float):
    """Link counts of the rows of two slices of a cell, and links that connect what is linked."""

    def links(task: pa.Table) -> pa.Table:
        part, kind, key, copies = (task.column(c).to_numpy() for c in ("slice", "kind", "key", "copies"))
        vectors, weight = unit(_matrix(task.column("vector"), length)), copies.astype(np.float64)
        one = np.flatnonzero(part == part.min())
        two = np.flatnonzero(part == part.max())
        same = part.min() == part.max()
        label, near = np.arange(len(key)), np.zeros(len(key))
        edges = []
        for lo in range(0, len(one), 512):
            rows = one[lo : lo + 512]
            for start in range(0, len(two), 8192):
                others = two[start : start + 8192]
                linked = vectors[rows] @ vectors[others].T >= threshold
                if same:
                    linked &= rows[:, None] != others
                if not linked.any():
                    continue
                counted = linked.astype(np.float64)
                near[rows] += counted @ weight[others]
                if not same:
                    near[others] += weight[rows] @ counted
                for k in np.flatnonzero(linked.any(axis=1)):
                    names = label[others[linked[k]]]
                    if names.min() == names.max() == label[rows[k]]:
                        continue
                    names = np.unique(np.append(names, label[rows[k]]))
                    edges.append(np.stack([np.full(len(names) - 1, names[0]), names[1:]]))
                    label[np.isin(label, names)] = names[0]
        counts = np.flatnonzero((near > 0) & (kind != OWNED))
        a, b = key[np.concatenate(edges, axis=1)] if edges else np.zeros((2, 0), np.int64)
        none = pa.nulls(len(counts), pa.int64())
        ends = [pa.concat_arrays([pa.array(a), pa.array(key[counts])]), pa.concat_arrays([pa.array(b), none])]
        near = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(near[counts].astype(np.int64))])
        return pa.table([*ends, near], names=["a", "b", "near"])

    return links


def _cell_links(placed: DataFrame, length: int, threshold: float) -> DataFrame:
    """(a, b, near): links that connect the rows of cells, where ``near`` is null, and link counts of ``a``, where ``b`` is."""
    spark = placed.sparkSession
    inside = placed.where(F.col("kind") != REST)
    group = F.when(F.col("kind") == OWNED, FREE).otherwise(F.col("kind"))
    sizes = inside.groupBy("cell", group.alias("part")).agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("key").alias("one"))
    most = max(1, SLICE_BYTES // (8 * length))
    cells: dict[int, dict] = {}
    for r in sizes.collect():
        cells.setdefault(r["cell"], {})[r["part"]] = r
    plan = []  # at most three rows a cell
    for cell, parts in cells.items():
        core = sum(parts[p]["n"] for p in (INNER, OUTER) if p in parts)
        rows = max(1, min(most, max(SLICE_ROWS, -(-core // 8))))
        slices = {p: -(-parts[p]["n"] // rows) if p in parts else 0 for p in (INNER, OUTER, FREE)}
        whole, base = slices[INNER] + slices[OUTER], 0
        for p, k in slices.items():
            if k:
                first = slices[INNER] if p == INNER else 0
                last = whole if p == FREE else whole + slices[FREE]
                plan.append((cell, p, base, k, first, last, parts[p]["copies"], parts[p]["one"]))
            base += k
    schema = "cell int, part int, base int, slices int, first int, last int, all_copies long, rep long"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    dealt = inside.withColumn("part", group).join(plan, ["cell", "part"])
    number = F.col("base") + F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    dealt = dealt.withColumn("slice", number)
    other = F.when(F.col("first") < F.col("last"), F.sequence("first", F.col("last") - 1))
    tasks = dealt.select("cell", "kind", "key", "copies", "vector", "slice", F.explode(other).alias("other"))
    tasks = tasks.withColumn("one", F.least("slice", "other")).withColumn("two", F.greatest("slice", "other"))
    tasks = tasks.groupBy("cell", "one", "two").applyInArrow(_slice_pair(length, threshold), "a long, b long, near long")
    inner = dealt.where(F.col("kind") == INNER)
    none = F.lit(None).cast("long")
    stars = inner.where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"), none.alias("near"))
    counts = inner.select(F.col("key").alias("a"), none.alias("b"), (F.col("all_copies") - F.col("copies")).alias("near"))
    return tasks.union(stars).union(counts)


def _compared(length: int, threshold: float, leaf_rows: int, spill: float):
    """The linked pairs of one leaf."""

    def pairs(leaf: pa.Table) -> pa.Table:
        key = leaf.column("key").to_numpy()
        vectors = unit(_matrix(leaf.column("vector"), length))
        draw = np.random.default_rng(leaf.num_rows)
        found = [np.zeros((0, 2), np.int64)]
        for own in blocks(vectors, np.arange(len(key)), leaf_rows, spill, draw):
            for lo in range(0, len(own), 1024):
                part = own[lo : lo + 1024]
                a, b = np.nonzero(vectors[part] @ vectors[own].T >= threshold)
                a, b = key[part[a]], key[own[b]]
                found.append(np.stack([a[a < b], b[a < b]], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return pairs


def _routed(forest: Forest, length: int):
    def routes(batches):
        for batch in batches:
            key, column = batch.column(0), batch.column(1)
            for tree, row, leaf in forest.route(unit(_matrix(column, length))):
                trees = pa.array(np.full(len(row), tree, np.int32))
                for lo in range(0, len(row), 4096):
                    take = pa.array(row[lo : lo + 4096])
                    parts = [trees[lo : lo + 4096], pa.array(leaf[lo : lo + 4096]), key.take(take), column.take(take)]
                    yield pa.RecordBatch.from_arrays(parts, names=["tree", "leaf", "key", "vector"])

    return routes


def near_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    trees: int = 10,
    leaf_rows: int = 1024,
    spill: float = 0.05,
    sample_rows: int = 65_536,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    marks = [F.when(F.col("sound"), F.xxhash64(v)).alias(n) for n, v in (("k1", F.col("vector")), ("k2", F.reverse("vector")))]
    keyed = keyed.select("vec_id", "vector", "sound", *marks)
    distinct = keyed.where("sound").groupBy("k1", "k2").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("one")
    )
    distinct = durable(distinct.withColumn("key", F.monotonically_increasing_id()), "vectors")
    pairs = whole = None
    for r in distinct.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).collect():
        same = distinct.where(F.size("vector") == r["length"]).select("key", "copies", "vector")
        found, cells = _links(same, r["length"], r["n"], threshold, trees, leaf_rows, spill, sample_rows)
        pairs = found if pairs is None else pairs.union(found)
        if cells is not None:
            whole = cells if whole is None else whole.union(cells)
    if pairs is None:
        pairs = table.sparkSession.createDataFrame([], "a long, b long")
    pairs = durable(pairs.distinct(), "pairs")
    either = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = either.join(distinct.select(F.col("key").alias("b"), "copies"), "b")
    degree = degree.select(F.col("a").alias("key"), F.col("copies").alias("near"))
    if whole is not None:
        whole = durable(whole, "cells")
        degree = degree.union(whole.where("b IS NULL").select("a", "near"))
        pairs = pairs.union(whole.where("b IS NOT NULL").select("a", "b"))
    degree = degree.groupBy("key").agg(F.sum("near").alias("near"))
    named = distinct.select("k1", "k2", "key", "copies", "one").join(components(pairs).toDF("key", "label"), "key", "left")
    named = named.withColumn("label", F.coalesce("label", "key")).join(degree, "key", "left")
    smallest = named.groupBy("label").agg(F.min("one").alias("component"))
    named = named.join(smallest, "label").select(
        "k1", "k2", "copies", "component", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    named = durable(named, "named")
    total = named.agg(F.sum("copies").alias("n")).first()["n"] or 0
    # fewer than a thousand vectors have more than a thousandth of all rows each
    hot = F.col("copies") > total / 1000
    often = named.where(hot).select("k1", "k2", F.col("component").alias("hot_component"), F.col("links").alias("hot_links"))
    seldom = named.where(~hot).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "component", "links")
    out = keyed.drop("vector").join(F.broadcast(often), ["k1", "k2"], "left")
    # rows that are settled by now, or link with nothing, are spread by their own id and find no partner
    open_row = F.col("sound") & F.col("hot_links").isNull()
    out = out.withColumn("open_row", open_row).withColumn("j1", F.when(open_row, F.col("k1")).otherwise(F.xxhash64("vec_id", F.rand(7))))
    asked, found = out.alias("asked"), seldom.alias("found")
    same = (F.col("asked.j1") == F.col("found.j1")) & (F.coalesce("asked.k2", F.lit(0)) == F.col("found.j2")) & F.col("asked.open_row")
    out = asked.join(found, same, "left")
    component = F.when(F.col("sound"), F.coalesce("hot_component", "component")).otherwise(F.col("vec_id"))
    links = F.coalesce("hot_links", "links", F.lit(0)).cast("long")
    out = out.select("vec_id", links.alias("n_links"), component.alias("component_id"))
    kept = F.when(F.col("vec_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("vec_id") == F.col("component_id"))
    return out.withColumn("kept", kept)


def _links(same, length, n, threshold, trees, leaf_rows, spill, sample_rows) -> tuple[DataFrame, DataFrame | None]:
    """The linked pairs of distinct vectors of one length outside of dense clusters, and what ``_cell_links`` gives for these."""
    wanted = max(1, min(sample_rows, SAMPLE_BYTES // (8 * length)))
    share = min(1.0, wanted / n)
    chosen = same.where(F.pmod(F.xxhash64("key"), 1_000_000) < int(share * 1_000_000) + 1)
    sample = unit(_matrix(chosen.select("vector").toArrow().column(0), length))
    cells, whole = fit_cells(sample, threshold, max(32, leaf_rows * share / 2)), None
    if len(cells.pivots):
        schema = "cell int, kind int, key long, copies long, vector array<double>"
        placed = durable(same.mapInArrow(_placed(cells, length), schema), "placed")
        whole = _cell_links(placed, length, threshold)
        same = placed.where(F.col("kind") == REST)
        n = same.count()
        free = [cells.owners(part @ cells.pivots.T) < 0 for part in np.array_split(sample, max(1, len(sample) // 4096))]
        sample = sample[np.concatenate(free)]
    same = same.select("key", "vector")
    # as many levels as leave ``leaf_rows`` a leaf, and at least 32 rows of the sample to each cut
    levels = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    depth = min(levels, max(0, int(np.log2(max(1, len(sample) / 32)))))
    forest = fit_forest(sample, trees if depth else 1, depth, spill)
    routed = same.mapInArrow(_routed(forest, length), "tree int, leaf long, key long, vector array<double>")
    compare = _compared(length, threshold, 2 * leaf_rows, spill)
    return routed.groupBy("tree", "leaf").applyInArrow(compare, "a long, b long"), whole
