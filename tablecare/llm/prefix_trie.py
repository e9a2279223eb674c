"""A Z-fast trie over conversations: which conversations share which first turns.

A turn is known by 128 bits of the SHA-256 of its role and text, a prefix of ``d`` turns by two
polynomial sums of its turns modulo 2**64. Such sums add up across tasks, so prefixes come from one
range sort of narrow rows with a carry per partition, and one conversation with a third of all
rows is no group of its own anywhere.

The trie is compacted: a node stands for the edge above it, the depths ``(top, depth]`` over which
the same conversations stay together. A hash table holds each node under its handle, the prefix at
the two-fattest depth of its edge (the number with most trailing zero bits). Conversations are
inserted in batches. Each distinct one finds its exit node by fat binary search, a logarithm of
its turns in probes, all of a batch at a time as joins with the table; its last common depth with
the exit edge follows from the rows of the edge's representative. Edges are split where
conversations leave or end inside, and what lies below becomes new edges: of the prefixes there,
those with equal owner (smallest conversation) and equal count form one edge.

Sums over subtrees take a logarithm of the trie's height in rounds, each node adding what its
ancestor pointer's other nodes hold and doubling its pointer. At last edges are expanded to one
row per depth from their representative's rows. Every step of a batch ends as a written table.

Null roles and texts count as empty. Turns of one conversation are ordered by turn (null first),
equal turns by digest. Rows without conversation id take no part; other columns are not read. Rows
that repeat whole are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.frames import durable

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that powers can be undone modulo 2**64
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)
IDS_PER_CHUNK = 4096
DEPTHS_PER_CHUNK = 4096
SUMS = ("n_convs", "weight", "edge_bytes", "n_leaves")


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2**64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square, left = np.uint64(int(square) * int(square) % 2**64), left >> np.uint64(1)
    return out


def _column(batch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _u(batch, name: str) -> np.ndarray:
    return _column(batch, name).astype(np.int64).view(np.uint64)


def _record(**columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


# -- prefixes --------------------------------------------------------------------------------


def _within_partition(batches):
    """Position and prefix sums of each row inside its conversation's run in this partition."""
    conv, count, sums, size, run = None, 0, np.zeros(2, np.uint64), 0, 0
    for batch in batches:
        ident, n = _column(batch, "conv_id"), batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = ident[1:] != ident[:-1]
        new[0] = ident[0] != conv
        number = np.cumsum(new)
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        goes_on = start < 0  # rows of the run that the last batch ended in
        pos = np.where(goes_on, np.arange(n) + 1 + count, np.arange(n) + 1 - start)
        bytes_ = _column(batch, "bytes")
        total = np.cumsum(bytes_)
        before = np.where(goes_on, 0, (total - bytes_)[np.maximum(start, 0)])
        columns = {"conv_id": ident, "run": run + number, "pos": pos, "bytes": bytes_}
        columns["upto"] = total - before + np.where(goes_on, size, 0)
        for lane, base in enumerate(BASES):
            terms = _u(batch, f"t{lane + 1}") * _powers(base, pos)
            whole = np.cumsum(terms)
            skipped = np.where(goes_on, np.uint64(0), (whole - terms)[np.maximum(start, 0)])
            columns[f"s{lane + 1}"] = whole - skipped + np.where(goes_on, sums[lane], np.uint64(0))
            columns[f"w{lane + 1}"] = terms
        conv, count, size, run = ident[-1], int(pos[-1]), int(columns["upto"][-1]), run + int(number[-1])
        sums = np.array([columns["s1"][-1], columns["s2"][-1]])
        yield _record(**columns)


LOCAL = "conv_id long, run long, pos long, bytes long, upto long, s1 long, w1 long, s2 long, w2 long"
ROWS = "conv_id long, pos long, bytes long, upto long, s1 long, s2 long, b1 long, b2 long"


def _carried(local: DataFrame) -> DataFrame:
    """What the first run of each partition goes on from: one short row per partition."""
    ends = local.groupBy("part", "conv_id", "run").agg(F.max_by(F.struct("pos", "upto", "s1", "s2"), "pos").alias("end"))
    ends = ends.groupBy("part").agg(F.min_by(F.struct("conv_id", "run", "end"), "run").alias("a"), F.max_by(F.struct("conv_id", "run", "end"), "run").alias("z"))
    conv, held, out = None, (0, 0, 0, 0), []
    for row in ends.orderBy("part").collect():
        if conv == row.a.conv_id:
            out.append((row.part, *held))
        else:
            held = (0, 0, 0, 0)
        goes_on = row.a.run == row.z.run and conv == row.a.conv_id
        pos, upto, *sums = row.z.end
        if goes_on:
            powers = [pow(b, held[0], 2**64) for b in BASES]
            sums = [(h + s * p) % 2**64 for h, s, p in zip(held[2:], sums, powers, strict=True)]
            pos, upto = pos + held[0], upto + held[1]
        conv, held = row.z.conv_id, (pos, upto, *(s - 2**64 if s >= 2**63 else s for s in (x % 2**64 for x in sums)))
    return local.sparkSession.createDataFrame(out, "part int, c_pos long, c_upto long, c1 long, c2 long")


def _shifted(batches):
    """Rows of a partition's first run, moved behind what came before; ``b`` is the prefix before the row."""
    for batch in batches:
        c_pos = _column(batch, "c_pos")
        columns = {"conv_id": _column(batch, "conv_id"), "pos": _column(batch, "pos") + c_pos, "bytes": _column(batch, "bytes")}
        columns["upto"] = _column(batch, "upto") + _column(batch, "c_upto")
        for lane, base in enumerate(BASES, 1):
            power = _powers(base, c_pos)
            columns[f"s{lane}"] = _u(batch, f"s{lane}") * power + _u(batch, f"c{lane}")
            columns[f"b{lane}"] = columns[f"s{lane}"] - _u(batch, f"w{lane}") * power
        yield _record(**{c.split()[0]: columns[c.split()[0]] for c in ROWS.split(", ")})


def prefixes(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, bytes, upto, s1, s2, b1, b2) of every turn: its place, its bytes and those up to
    it, the prefix sums with and before it. Written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lanes = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(f"t{k}") for k, at in ((1, 1), (2, 17))]
    narrow = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.octet_length(text).cast("long").alias("bytes"), *lanes
    )
    narrow = durable(narrow, "turns")
    order = ["conv_id", F.asc_nulls_first("turn"), "t1", "t2"]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    local = dealt.mapInArrow(_within_partition, LOCAL).withColumn("part", F.spark_partition_id())
    local = durable(local, "runs")
    carry = F.broadcast(_carried(local))  # at most one row per partition
    first = local.join(carry, "part", "left").withColumn("own", F.col("run") == 1)
    moved = [F.when(F.col("own"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("c_pos", "c_upto", "c1", "c2")]
    return durable(first.select(*[c for c in local.columns if c not in ("part", "run")], *moved).mapInArrow(_shifted, ROWS), "prefixes")


PATHS = "conv_id long, depth long, bytes long, upto long, p1 long, p2 long, b1 long, b2 long"


def _spliced(batches):
    """Prefix sums of own turns behind a head of ``k`` borrowed turns instead of the own first ``h``."""
    for batch in batches:
        k, h, pos = (_column(batch, c) for c in ("k", "h", "pos"))
        columns = {"conv_id": _column(batch, "conv_id"), "depth": pos - h + k, "bytes": _column(batch, "bytes")}
        columns["upto"] = _column(batch, "upto") - _column(batch, "h_upto") + _column(batch, "k_upto")
        for lane, inverse in enumerate(INVERSES, 1):
            undo, head, cut = _powers(inverse, h - k), _u(batch, f"k{lane}"), _u(batch, f"h{lane}")
            columns[f"p{lane}"] = (_u(batch, f"s{lane}") - cut) * undo + head
            columns[f"b{lane}"] = (_u(batch, f"b{lane}") - cut) * undo + head
        yield _record(**{c.split()[0]: columns[c.split()[0]] for c in PATHS.split(", ")})


def rebuilt(rows: DataFrame, donor: Column, head: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, depth, bytes, upto, p1, p2, b1, b2) of conversations rebuilt from another's first
    ``head`` turns and their own after their first ``head``; and (conv_id, n, key, upto) of their ends.

    ``donor`` and ``head`` (at most ``longest_head``) are columns over ``conv_id``. Both written.
    """
    entry = F.struct("pos", "bytes", "upto", "s1", "s2", "b1", "b2")
    heads = rows.groupBy("conv_id").agg(
        F.max_by(entry, "pos").alias("last"), F.array_sort(F.collect_list(F.when(F.col("pos") <= longest_head, entry))).alias("first")
    )
    heads = durable(heads, "heads")  # at most longest_head entries each
    lent = heads.select(F.col("conv_id").alias("donor"), F.col("first").alias("lent"))
    h = head.cast("long")
    info = heads.withColumn("donor", donor).withColumn("h", h).join(lent, "donor", "left")
    info = info.withColumn("lent", F.slice(F.coalesce("lent", F.expr("slice(first, 1, 0)")), 1, F.col("h").cast("int")))
    info = info.withColumn("k", F.size("lent").cast("long"))
    nothing = F.lit(0).cast("long")

    def at(array: str, place: Column, field: str, name: str) -> Column:
        found = F.get(F.col(array), (place - 1).cast("int"))[field]
        return F.when(place > 0, F.coalesce(found, nothing)).otherwise(nothing).alias(name)

    own = [at("first", F.col("h"), f, f"h{n}") for f, n in (("s1", "1"), ("s2", "2"), ("upto", "_upto"))]
    borrowed = [at("lent", F.col("k"), f, f"k{n}") for f, n in (("s1", "1"), ("s2", "2"), ("upto", "_upto"))]
    info = durable(info.select("conv_id", "h", "k", "lent", "last", *own, *borrowed), "splices")
    needed = info.select("conv_id", "h", "k", "h1", "h2", "h_upto", "k1", "k2", "k_upto")
    tail = rows.join(needed, "conv_id").where(F.col("pos") > F.col("h")).mapInArrow(_spliced, PATHS)
    e = F.explode("lent")
    front = info.select("conv_id", e.alias("e")).select("conv_id", "e.pos", "e.bytes", "e.upto", "e.s1", "e.s2", "e.b1", "e.b2")
    paths = durable(tail.union(front), "paths")
    beyond = F.col("last.pos") > F.col("h")
    ends = info.where(beyond).select("conv_id", "last.*", "h", "k", "h1", "h2", "h_upto", "k1", "k2", "k_upto").mapInArrow(_spliced, PATHS)
    ends = ends.select("conv_id", key("depth", "p1", "p2"), "upto")
    short = info.where(~beyond).select("conv_id", key("k", "k1", "k2"), F.col("k_upto").alias("upto"))
    return paths, durable(ends.union(short), "ends")


def key(depth: str | Column, p1: str | Column, p2: str | Column, name: str = "key") -> Column:
    """The identity of a prefix."""
    d, a, b = (F.col(x) if isinstance(x, str) else x for x in (depth, p1, p2))
    return F.struct(d.alias("d"), a.alias("p1"), b.alias("p2")).alias(name)


def root(name: str = "key") -> Column:
    zero = F.lit(0).cast("long")
    return key(zero, zero, zero, name)


def two_fattest(above: Column, upto: Column) -> Column:
    """The number in (above, upto] with the most trailing zero bits."""
    shift = F.length(F.bin(above.bitwiseXOR(upto))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", upto, shift), shift)


# -- the trie --------------------------------------------------------------------------------
# An edge: rep (a conversation that runs through it), top, parent (key at top), key (at its end),
# top_upto and upto (bytes up to either end).


def _edges_below(rows: DataFrame) -> DataFrame:
    """Compacted edges of the prefixes in ``rows`` (distinct conversations): equal owner and count make one edge."""
    nodes = rows.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.first("b1").alias("b1"), F.first("b2").alias("b2"),
        F.first("bytes").alias("bytes"), F.first("upto").alias("upto"),
    )
    first = F.struct((F.col("depth") - 1).alias("d"), F.col("b1").alias("p1"), F.col("b2").alias("p2"))
    edges = nodes.groupBy("rep", "n").agg(
        F.min_by(F.struct(first.alias("parent"), (F.col("upto") - F.col("bytes")).alias("top_upto")), "depth").alias("a"),
        F.max_by(F.struct(key("depth", "p1", "p2"), "upto"), "depth").alias("z"),
    )
    return edges.select("rep", F.col("a.parent.d").alias("top"), "a.parent", "z.key", "a.top_upto", "z.upto")


def _indexed(edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hash tables of a trie: edges by the key of their handle, and by the key of their first depth."""
    handle = two_fattest(F.col("top"), F.col("key.d"))
    wanted = edges.withColumn("at", F.explode(F.array(handle, F.col("top") + 1))).withColumn("is_handle", F.col("at") == handle)
    path = rows.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), key("depth", "p1", "p2", "probe"))
    found = durable(wanted.distinct().join(path, ["rep", "at"]), "handles")
    handles = found.where("is_handle").select("probe", F.col("key.d").alias("bottom"), F.col("key").alias("node"))
    firsts = found.where(F.col("at") == F.col("top") + 1).select("probe", F.col("key").alias("node"))
    return handles, firsts


def _located(convs: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, shared, node): the depth each conversation shares with the trie and the edge where it leaves.

    ``convs`` are (conv_id, n), ``rows`` their paths and those of the edges' representatives.
    """
    handles, firsts = _indexed(edges, rows)
    probes = rows.select("conv_id", F.col("depth").alias("at"), key("depth", "p1", "p2", "probe"))
    search = convs.select("conv_id", "n", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), root("node"))
    ended = []
    while True:
        # fat binary search: one probe for every conversation that is still searching
        step = search.withColumn("at", two_fattest(F.col("a"), F.col("b"))).join(probes, ["conv_id", "at"])
        step = step.withColumnRenamed("node", "old").join(handles, "probe", "left")
        hit = F.col("bottom").isNotNull()
        step = step.select(
            "conv_id", "n", F.when(hit, F.col("bottom")).otherwise(F.col("a")).alias("a"),
            F.when(hit, F.col("b")).otherwise(F.col("at") - 1).alias("b"), F.when(hit, F.col("node")).otherwise(F.col("old")).alias("node"),
        )
        step = durable(step, "search")
        ended.append(step.where("a >= b"))
        search = step.where("a < b")
        if not search.limit(1).count():
            break
    exits = reduce(DataFrame.union, ended).select("conv_id", "n", "node")
    # where the whole extent matches, the child by the next turn is the edge to leave from
    bottom = probes.select("conv_id", F.col("at").alias("d"), F.col("probe").alias("own"))
    here = exits.withColumn("d", F.col("node.d")).join(bottom, ["conv_id", "d"], "left")
    whole = (F.col("d") == 0) | F.coalesce(F.col("own") == F.col("node"), F.lit(False))
    here = here.select("conv_id", "n", "node", whole.alias("whole"), F.when(whole & (F.col("n") > F.col("d")), F.col("d") + 1).alias("at"))
    # rows without a next turn stay out of the joins: as nulls they would all meet in one task
    child = firsts.withColumnRenamed("node", "child")
    going = here.where("at IS NOT NULL").join(probes, ["conv_id", "at"]).join(child, "probe", "left")
    going = going.select("conv_id", "n", F.coalesce("child", "node").alias("node"), F.col("child").isNull().alias("done"))
    here = durable(going.union(here.where("at IS NULL").select("conv_id", "n", "node", F.col("whole").alias("done"))), "exits")
    done = here.where("done").select("conv_id", F.col("node.d").alias("shared"), "node")
    # compare with the representative's path over the exit edge
    inside = here.where("NOT done").join(edges.select(F.col("key").alias("node"), "rep", "top"), "node")
    inside = inside.withColumn("upto", F.least(F.col("n"), F.col("node.d")))
    each = _each_depth(inside, "top", "upto")
    own = probes.select("conv_id", F.col("at").alias("depth"), F.col("probe").alias("own"))
    other = probes.select(F.col("conv_id").alias("rep"), F.col("at").alias("depth"), F.col("probe").alias("own"))
    equal = each.select("conv_id", "rep", "depth", "node").join(own, ["conv_id", "depth"]).join(other, ["rep", "depth", "own"])
    shared = equal.groupBy("conv_id").agg(F.max("depth").alias("shared"), F.first("node").alias("node"))
    return durable(done.union(shared), "located")


def _each_depth(edges: DataFrame, top: str, bottom: str) -> DataFrame:
    """Edges expanded to a row for every depth in (top, bottom], a bounded number at a time."""
    chunk = F.explode(F.sequence(F.col(top) + 1, F.col(bottom), F.lit(DEPTHS_PER_CHUNK).cast("long")))
    some = edges.where(F.col(top) < F.col(bottom)).withColumn("from", chunk)
    last = F.least(F.col("from") + DEPTHS_PER_CHUNK - 1, F.col(bottom))
    return some.withColumn("depth", F.explode(F.sequence(F.col("from"), last))).drop("from")


def insert(edges: DataFrame | None, convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges of a trie after a batch of distinct conversations has gone in; written.

    ``convs`` are (conv_id, n) of the batch, ``rows`` the paths of it and of all earlier batches.
    """
    own = rows.join(convs.select("conv_id"), "conv_id", "left_semi")
    if edges is None:
        return durable(_edges_below(own), "edges")
    located = _located(convs.where("n > 0"), rows, edges)
    below = own.join(located.select("conv_id", "shared"), "conv_id").where(F.col("depth") > F.col("shared"))
    # a conversation that leaves or ends inside an edge splits it
    cuts = located.where(F.col("shared") < F.col("node.d")).groupBy("node", "shared").agg(F.min("conv_id").alias("by"))
    path = rows.select(F.col("conv_id").alias("by"), F.col("depth").alias("shared"), key("depth", "p1", "p2", "cut"), F.col("upto").alias("cut_upto"))
    cuts = cuts.join(path, ["by", "shared"]).select("node", "cut", "cut_upto")
    edge = edges.withColumnRenamed("key", "node")
    points = cuts.join(edge, "node").select("node", "rep", F.col("cut").alias("key"), F.col("cut_upto").alias("upto"), "parent", "top_upto")
    hurt = cuts.select("node").distinct()
    bottoms = edge.join(hurt, "node").select("node", "rep", F.col("node").alias("key"), "upto", "parent", "top_upto")
    upward = Window.partitionBy("node").orderBy("key.d")
    pieces = points.union(bottoms).select(
        "rep", "key", "upto", F.lag("key").over(upward).alias("above"), F.lag("upto").over(upward).alias("above_upto"), "parent", "top_upto"
    )
    parent = F.coalesce("above", "parent")
    pieces = pieces.select("rep", parent["d"].alias("top"), parent.alias("parent"), "key", F.coalesce("above_upto", "top_upto").alias("top_upto"), "upto")
    whole = edge.join(hurt, "node", "left_anti").withColumnRenamed("node", "key").select(*pieces.columns)
    return durable(whole.union(pieces).union(_edges_below(below)), "edges")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, up, conv_id and SUMS of their own) with SUMS and smallest conv_id over their subtrees."""
    while True:
        if not nodes.where("up IS NOT NULL").limit(1).count():
            return nodes.drop("up")
        given = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key"))
        given = given.agg(*(F.sum(c).alias(f"more_{c}") for c in SUMS), F.min("conv_id").alias("least"))
        higher = nodes.select(F.col("key").alias("up"), F.col("up").alias("next"))
        moved = nodes.join(higher, "up", "left").join(given, "key", "left")
        sums = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in SUMS]
        nodes = durable(moved.select("key", F.col("next").alias("up"), F.least("conv_id", "least").alias("conv_id"), *sums), "subtrees")


def _id_digest(batches):
    """SHA-256 of each node's ids, from its chunks in ascending order."""
    node, sha = None, None
    for batch in batches:
        nodes = batch.column(batch.schema.get_field_index("key")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("ids"))
        done, out = [], []
        for at, this in enumerate(nodes):
            if this != node:
                if sha is not None:
                    done.append(node), out.append(sha.hexdigest())
                node, sha = this, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids[at].as_buffer())
        yield _digests(done, out)
    if sha is not None:
        yield _digests([node], [sha.hexdigest()])


def _digests(nodes, digests) -> pa.RecordBatch:
    kind = pa.struct([(c, pa.int64()) for c in ("d", "p1", "p2")])
    return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(digests, pa.string())], ["key", "ends_sha256"])


def _id_chunks(batches):
    """Runs of sorted (key, conv_id) as comma-joined texts of at most IDS_PER_CHUNK ids."""
    kind = pa.struct([(c, pa.int64()) for c in ("d", "p1", "p2")])
    for batch in batches:
        ident = _column(batch, "conv_id")
        node = batch.column(batch.schema.get_field_index("key"))
        parts = [c.to_numpy(zero_copy_only=False) for c in node.flatten()]
        new = np.ones(len(ident), bool)
        new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        new |= np.arange(len(ident)) % IDS_PER_CHUNK == 0
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(ident))
        texts = [",".join(map(str, ident[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [node.take(pa.array(starts)).cast(kind), pa.array(ident[starts]), pa.array(texts, pa.string())], ["key", "first", "ids"]
        )


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the comma-joined ascending ids that end at each prefix.

    A prefix's ids travel as chunks in order and stream through one digest, so memory stays bounded.
    """
    order = ["key.d", "key.p1", "key.p2", "conv_id"]
    node = "struct<d: long, p1: long, p2: long>"
    dealt = ends.select("key", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = durable(dealt.mapInArrow(_id_chunks, f"key {node}, first long, ids string"), "id-chunks")
    dealt = chunks.repartition("key").sortWithinPartitions("key.d", "key.p1", "key.p2", "first")
    return dealt.mapInArrow(_id_digest, f"key {node}, ends_sha256 string")


def prefix_nodes(
    turns: DataFrame,
    donor: Column | None = None,
    head: Column | None = None,
    longest_head: int = 0,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    batches: int = 2,
) -> DataFrame:
    """One row per distinct prefix of the conversations, the textless root included.

    conv_id (smallest conversation with the prefix), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (prefixes without children in its subtree), saved_tokens (bytes
    of last texts that copies of prefixes in its subtree repeat), ends_sha256 (of the ids that end
    there). ``donor`` and ``head``, columns over ``conv_id``, rebuild conversations first: the
    first ``head`` (at most ``longest_head``) turns of ``donor``, then the own turns after that.
    """
    rows = prefixes(turns, conv_id, turn, role, text)
    own = F.col("conv_id")
    paths, ends = rebuilt(rows, own if donor is None else donor, F.lit(0) if head is None else head, longest_head)
    # conversations of equal turns count as one with a weight
    distinct = ends.groupBy("key").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.first("upto").alias("upto"))
    distinct = durable(distinct, "distinct")
    convs = distinct.select("conv_id", F.col("key.d").alias("n"))
    paths = durable(paths.join(convs.select("conv_id"), "conv_id", "left_semi"), "distinct-paths")
    dealt = F.pmod(F.xxhash64("conv_id"), F.lit(batches))
    edges = None
    for number in range(batches):
        edges = insert(edges, convs.where(dealt == number), paths)
    # own values of every node; the root stands above the edges
    local = edges.select("key", F.col("parent").alias("up"), (F.col("upto") - F.col("top_upto")).alias("edge_bytes"))
    no_key = F.lit(None).cast("struct<d: long, p1: long, p2: long>")
    top = convs.limit(1).select(root(), no_key.alias("up"), F.lit(0).cast("long").alias("edge_bytes"))
    children = edges.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    ending = distinct.select("key", F.col("copies").alias("n_convs"), (F.col("copies") * F.col("upto")).alias("weight"), "conv_id")
    nodes = local.union(top).join(children, "key", "left").join(ending, "key", "left").fillna(0, ["n_children", "n_convs", "weight"])
    nodes = durable(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    sums = _subtrees(nodes.select("key", "up", "conv_id", *SUMS))
    edge = edges.select("key", "rep", "top", "top_upto", "parent").union(
        convs.limit(1).select(root(), no_key["d"].alias("rep"), F.lit(-1).cast("long").alias("top"), F.lit(0).cast("long").alias("top_upto"), no_key.alias("parent"))
    )
    above = sums.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    full = edge.join(sums, "key").join(nodes.select("key", "n_children"), "key").join(above, "parent", "left")
    full = durable(full.join(end_digests(ends), "key", "left"), "full-nodes")
    each = _each_depth(full.withColumn("bottom", F.col("key.d")), "top", "bottom")
    path = paths.select(F.col("conv_id").alias("rep"), "depth", "bytes", "upto")
    each = each.join(path, ["rep", "depth"], "left")
    bottom, n = F.col("depth") == F.col("key.d"), F.col("n_convs")
    before = F.coalesce(F.col("upto") - F.col("bytes"), F.lit(0))  # bytes above this depth
    saved = (F.col("weight") - n * before) - (F.col("edge_bytes") - (before - F.col("top_upto")))
    parent = F.when(F.col("depth") > F.col("top") + 1, F.col("conv_id")).otherwise(F.col("above"))
    return each.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends_sha256")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
