"""Exact similarity join of word n-gram sets, by skipping inside index lists and between sets.

Two sets link when ``|A & B| / |A | B| >= p / q``. With ``n`` members, a set differs from any
partner in at most ``n * (q - p) / p`` members.

* **Block-skip lists.** A set is ordered by the members' hashes and cut by position, at fixed
  places of the hash range, into more blocks than it may differ in members. So two linked sets
  agree in whole blocks, and an index list is kept not for a member but for a block: everything
  else that holds one of its members is skipped. Of its blocks a set enters the largest ones,
  one more than it may differ in, which still must hold a common one. Block counts depend on size
  classes; a set whose partners may lie in the next class enters that too.
* **Answers from similar sets.** Each list names a leader, the set that shares most lists; all
  sets of its lists form the leader's group. A first round compares leaders with their groups,
  which is linear. Groups that became one component are done. In the others, sets are written as
  their differences from the leader, and the answer for two of them follows from the two small
  differences alone. A group is dealt out by pairs of bounded slices; a task returns a spanning
  forest of the links between different components, never the pairs.

A set's members move only where an answer can depend on them. Every set has a parity sketch, a bit
for each of some buckets that tells whether it holds an odd number of members. In at least as many
members as their sketches have unequal bits two sets differ, so the sketches, some twentieth of
the members' bytes, rule pairs out without error: leaders meet only sets they may link to, and of
an open group only sets stay that may link to one of another component.

Texts that give equal sets are one node throughout. A row without words links with nothing and is
its own component. Rows with a null id take part; a component's id is its smallest id, or null
where it has none. Members are 64-bit hashes of word sequences; sets are told apart by 63-bit
hashes, so ``N`` distinct sets mix up two of them with a chance of about ``N**2 / 2**64``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.components import components
from tablecare.llm.frames import durable, fresh
from tablecare.llm.textnum import each_chunk, mix
from tablecare.operators.sizing import MAX_BROADCAST_BYTES

CLASS_RATIO = 2
# A slice of a group: at most so many sets or members, on average.
SLICE_SETS, SLICE_MEMBERS = 1024, 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def budget(n: int, p: int, q: int) -> int:
    """In how many members a set of ``n`` may differ from a partner."""
    return n * (q - p) // p


def set_key(members: np.ndarray) -> int:
    """An even 63-bit hash of a whole set."""
    length = np.full(1, len(members), np.uint64)
    value = mix(np.sum(mix(members), keepdims=True) + length * ODD)[0]
    return int(value & np.uint64(0xFFFFFFFFFFFFFFFE)) - (1 << 64 if value >> np.uint64(63) else 0)


def block_keys(members: np.ndarray, size_class: int, p: int, q: int) -> np.ndarray:
    """The hashes of the ``budget + 1`` largest blocks of a set, cut for a size class."""
    blocks = budget(CLASS_RATIO ** (size_class + 1), p, q) + 1
    place = ((members >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    edge = np.searchsorted(place, np.arange(blocks + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members))])
    key = mix(total[edge[1:]] - total[edge[:-1]] + np.arange(blocks, dtype=np.uint64) * ODD)
    key = mix(key + np.uint64(size_class))
    wanted = budget(len(members), p, q) + 1
    return key[np.lexsort((key, -np.diff(edge)))[:wanted]]


def entries(members: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Block keys for the own size class and, where partners may lie there, for the next."""
    n = len(members)
    none = np.zeros(0, np.uint64)
    if budget(n, p, q) == 0:
        return none, none
    own = n.bit_length() - 1
    above = (n * q // p).bit_length() - 1 > own
    return block_keys(members, own, p, q), block_keys(members, own + 1, p, q) if above else none


def parity(members: np.ndarray) -> bytes:
    """A bit per bucket, set where the bucket holds an odd number of members; at least two buckets a member."""
    width = 1 << max(6, (2 * len(members) - 1).bit_length())
    held = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of fewer buckets, ``size`` bytes of them."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def may_link(a: bytes, b: bytes, n: int, m: int, p: int, q: int) -> bool:
    """False only for sets of ``n`` and ``m`` members whose sketches show that they do not link."""
    size = min(len(a), len(b))
    apart = max(abs(n - m), int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()))
    return q * (n + m - apart) >= p * (n + m + apart)


def _summaries(words: int, p: int, q: int):
    def summed(batches):
        for batch, chunk in each_chunk(batches, "text"):
            n, rec, own, above, odd = [], [], [], [], []
            for members in chunk.shingles(words):
                a, b = entries(members, p, q)
                n.append(len(members))
                rec.append(set_key(members) if len(members) else None)
                own.append(a.view(np.int64))
                above.append(b.view(np.int64))
                odd.append(parity(members) if len(members) else None)
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (own, above)]
            ids, digests = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest"))
            arrays = [ids, digests, pa.array(n, pa.int64()), pa.array(rec, pa.int64()), *lists, pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "n", "rec", "own", "above", "odd"])

    return summed


def _member_sets(words: int):
    """(rec, members) of texts whose set is the wanted one."""

    def sets(batches):
        for batch, chunk in each_chunk(batches, "text"):
            wanted = batch.column(batch.schema.get_field_index("rec")).to_pylist()
            rec, data = [], []
            for want, members in zip(wanted, chunk.shingles(words), strict=True):
                if len(members) and set_key(members) == want:
                    rec.append(want)
                    data.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(data, pa.binary())], names=["rec", "members"])

    return sets


def _linked(common: int, n: int, m: int, p: int, q: int) -> bool:
    return q * common >= p * (n + m - common)


def _beside(p: int, q: int):
    """The pairs of a leader and a set of its group that may link."""

    def possible(batches):
        for batch in batches:
            pairs = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = [may_link(a, b, n, m, p, q) for a, b, n, m in pairs]
            yield batch.select(["leader", "rec"]).filter(pa.array(keep, pa.bool_()))

    return possible


def _among(p: int, q: int):
    """The sets in two slices of a group that may link to one of another component."""

    def possible(group: pa.Table) -> pa.Table:
        label, part, n = (group.column(k).to_numpy() for k in ("label", "slice", "n"))
        sketches = group.column("odd").to_pylist()
        width = np.array([len(s) for s in sketches])
        first, second = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        found = np.zeros(len(n), bool)
        for size in np.unique(width).tolist():
            # sets that link have sketches of one width or of neighbouring ones
            at = np.flatnonzero((width == size) | (width == 2 * size))
            bits = np.unpackbits(np.stack([_folded(sketches[i], size) for i in at]), axis=1).astype(np.float32)
            held = bits.sum(axis=1)
            apart = held[:, None] + held[None, :] - 2 * (bits @ bits.T)
            total = n[at][:, None] + n[at][None, :]
            apart = np.maximum(apart.astype(np.int64), np.abs(n[at][:, None] - n[at][None, :]))
            close = q * (total - apart) >= p * (total + apart)
            close &= (part[at][:, None] == first) & (part[at][None, :] == second)
            close &= label[at][:, None] != label[at][None, :]
            found[at[close.any(axis=0) | close.any(axis=1)]] = True
        return group.select(["leader", "rec", "label", "n"]).filter(pa.array(found))

    return possible


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of each group, dealt out to every pair of bounded slices of it."""
    slices = F.ceil(F.greatest(F.count("*") / SLICE_SETS, F.sum("n") / SLICE_MEMBERS)).cast("int").alias("slices")
    dealt = rows.join(rows.groupBy("leader").agg(slices), "leader")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("rec"), "slices").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumn("one", F.least("slice", "other")).withColumn("two", F.greatest("slice", "other"))
    return dealt.drop("other")


def _against_leader(p: int, q: int):
    """The pairs of a leader and a set of its group that link."""

    def linked(batches):
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            keep = []
            for i in range(len(batch)):
                x, y = np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(_linked(int((y[at] == x).sum()), len(x), len(y), p, q))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _within(p: int, q: int):
    """Links between components inside two slices of a group, from differences to the leader."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        lead = np.frombuffer(group.loc[group["leads"], "members"].iloc[0], np.uint64)
        rows = group[~group["leads"]]
        rec, label, part = rows["rec"].to_numpy(), rows["label"].to_numpy(), rows["slice"].to_numpy()
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        size = np.array([len(s) for s in sets], np.int64)
        apart = [np.setxor1d(s, lead, assume_unique=True) for s in sets]
        width = np.array([len(d) for d in apart], np.int64)
        row = np.repeat(np.arange(len(sets)), width)
        token, at = np.unique(np.concatenate(apart), return_inverse=True) if len(row) else (np.zeros(0), row)
        shared = np.bincount(at, minlength=len(token)) > 1
        place = np.cumsum(shared) - 1
        row, at = row[shared[at]], place[at[shared[at]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(shared.sum()), 2048):
            inside = (at >= lo) & (at < lo + 2048)
            dense = np.zeros((len(sets), 2048), np.float32)
            dense[row[inside], at[inside] - lo] = 1
            both += dense @ dense.T
        between = width[:, None] + width[None, :] - 2 * both.astype(np.int64)
        common = (size[:, None] + size[None, :] - between) // 2
        close = q * common >= p * (size[:, None] + size[None, :] - common)
        first, second = group["one"].iloc[0], group["two"].iloc[0]
        facing = (part[:, None] == first) & (part[None, :] == second)
        a, b = np.nonzero(close & facing & (label[:, None] != label[None, :]))
        # a spanning forest of the components is enough
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        edges = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            u, v = root(int(label[i])), root(int(label[j]))
            if u != v:
                parent[u] = v
                edges.append((int(label[i]), int(label[j])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return compare


def _index_groups(found: DataFrame, p: int, q: int) -> DataFrame:
    """(leader, rec) of all sets that share an index list with a leader, each once."""
    entry = lambda column, bit: F.transform(column, lambda k: F.struct(k.alias("block"), F.col("rec").bitwiseOR(F.lit(bit)).alias("entry")))
    rows = found.where("rec IS NOT NULL").select(F.explode(F.concat(entry("own", 0), entry("above", 1))).alias("r")).select("r.*")
    counted = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    lists = rows.join(counted, "block").distinct()
    lists = lists.groupBy("block").agg(F.count("*").alias("size")).where("size > 1").join(lists, "block")
    lists = durable(lists.select("block", "entry"), "lists")
    standing = lists.groupBy("entry").agg(F.count("*").alias("shared"))
    ranked = lists.join(standing, "entry").withColumn("rec", F.col("entry").bitwiseAND(F.lit(-2)))
    leaders = ranked.groupBy("block").agg(F.max_by("rec", F.struct("shared", "rec")).alias("leader"))
    groups = ranked.select("block", "rec").join(leaders, "block").select("leader", "rec").distinct()
    return durable(groups.where("leader <> rec"), "groups")


def _members(plain: DataFrame, recs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rec, members) of the wanted sets, from one text each, found by its id and digest."""
    asked = wanted.distinct().join(recs, "rec").select("rec", F.col("one.doc_id").alias("_one"), F.col("one.digest").alias("digest"))
    asked = durable(asked, "asked")
    width = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("_one").cast("string"))).alias("b")).first()
    small = (width["n"] * 64 + (width["b"] or 0)) <= MAX_BROADCAST_BYTES
    side = F.broadcast(asked) if small else asked
    # the digest is the key, since many rows may share an id or have none
    texts = plain.join(side, "digest").where(F.col("doc_id").eqNullSafe(F.col("_one"))).select("rec", "text")
    return durable(texts.mapInArrow(_member_sets(words), "rec long, members binary").dropDuplicates(["rec"]), "members")


def jaccard_components(
    docs: DataFrame,
    words: int = 5,
    p: int = 80,
    q: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return _verdict(docs, words, p, q, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _digest(text: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _verdict(docs: DataFrame, words: int, p: int, q: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, digest, n_shingles, component_id, and the digest of the component's first text."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _digest(text).alias("digest"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, digest long, n long, rec long, own array<long>, above array<long>, odd binary"
    found = durable(plain.mapInArrow(_summaries(words, p, q), schema), "summaries")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest")))
    of_set = (first.alias("first"), F.min(F.struct("doc_id", "digest")).alias("one"), F.max("n").alias("n"), F.first("odd").alias("odd"))
    recs = durable(found.where("rec IS NOT NULL").groupBy("rec").agg(*of_set), "sets")
    groups = _index_groups(found, p, q)

    # leaders and the sets that they may link to
    sketch = recs.select("rec", "odd", "n")
    left = sketch.toDF("leader", "of_leader", "n_leader")
    beside = groups.join(left, "leader").join(sketch, "rec")
    beside = beside.select("leader", "rec", "of_leader", "odd", "n_leader", "n")
    beside = durable(beside.mapInArrow(_beside(p, q), "leader long, rec long"), "beside")
    sets = _members(plain, recs, beside.select("rec").union(beside.select("leader")), words)
    left = sets.select(F.col("rec").alias("leader"), F.col("members").alias("of_leader"))
    pairs = beside.join(left, "leader").join(sets, "rec").select("leader", "rec", "of_leader", "members")
    star = components(pairs.mapInArrow(_against_leader(p, q), "a long, b long"))

    # the sets of open groups that may link to one of another component
    label = F.coalesce("label", "rec").alias("label")
    whole = groups.union(groups.select("leader", F.col("leader").alias("rec")).distinct())
    whole = whole.join(star.withColumnRenamed("node", "rec"), "rec", "left").select("leader", "rec", label)
    open_groups = whole.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    whole = whole.join(open_groups.where("lo <> hi").select("leader"), "leader", "left_semi")
    whole = durable(whole.join(recs.select("rec", "n"), "rec"), "labelled")
    among = _dealt(whole).join(recs.select("rec", "odd"), "rec").groupBy("leader", "one", "two")
    among = among.applyInArrow(_among(p, q), "leader long, rec long, label long, n long")
    among = durable(among.distinct(), "among")

    # their links; the leader goes to every pair of slices, as the measure of the others
    sets = _members(plain, recs, among.select("rec").union(among.select("leader")), words)
    dealt = _dealt(among).select("leader", "rec", "label", "slice", F.lit(False).alias("leads"), "one", "two")
    guides = dealt.select("leader", "one", "two").distinct()
    whole_set = (F.col("leader").alias("rec"), F.lit(0).cast("long").alias("label"), F.lit(-1).alias("slice"), F.lit(True).alias("leads"))
    tasks = dealt.union(guides.select("leader", *whole_set, "one", "two")).join(sets, "rec")
    crossing = tasks.groupBy("leader", "one", "two").applyInPandas(_within(p, q), "a long, b long")
    joined = components(crossing)

    final = star.join(joined.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "full")
    final = final.select(F.coalesce("node", "label").alias("rec"), F.coalesce("further", "label").alias("label"))
    named = recs.join(final, "rec", "left").select("rec", "first", F.coalesce("label", "rec").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("first"))
    smallest = smallest.select("label", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("first_digest"))
    named = durable(named.drop("first").join(smallest, "label").select("rec", "component_id", "first_digest"), "components")
    out = found.select("doc_id", "digest", "n", "rec").join(named, "rec", "left")
    component = F.when(F.col("rec").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), component.alias("component_id"), "first_digest")


def one_per_component(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, p: int = 80, q: int = 100
) -> DataFrame:
    """The rows of ``docs`` whose document stays: of each component the one with the smallest id.

    A document is an id with its text, so rows that repeat an id with other texts are judged apart,
    and of near copies with one id one stays. Rows without id stay unless their component has an
    id. Rows that repeat both id and text stay together.
    """
    found = durable(_verdict(docs, words, p, q, doc_id, text), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("digest").eqNullSafe(F.col("first_digest"))
    lost = found.where(F.col("first_digest").isNotNull() & ~stays)
    mark, ident, of_lost = (fresh(docs.columns, n) for n in ("digest", "lost_id", "lost_digest"))
    lost = lost.select(F.col("doc_id").alias(ident), F.col("digest").alias(of_lost)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(ident)) & (F.col(mark) == F.col(of_lost))
    return docs.withColumn(mark, _digest(text)).join(lost, same, "left_anti").drop(mark)
