"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case (A-Z), one blank between them, and an end symbol. A byte is
eight binary decisions; each is predicted in the contexts of the last 0 to ``depth`` bytes. In
every context a Krichevsky-Trofimov estimator counts, and at every inner node of the tree the
block probability is half that estimate and half the product over the contexts one byte longer.
Because block probabilities depend on counts alone, they come from one distributed count of byte
sequences, whatever the order of the texts; the weights of all depths along a path then give the
probability of the next byte, and its logarithm the code length.

The tree keeps every context of the training texts, so it grows with them. It is a table of
(byte with its context, log10 of its probability) for all that occur in any text, computed by
subtrees: all contexts that share their last two bytes lie in one task, which works through them
pair by pair; the two depths above are 256 by 255 binary decisions on the driver, whatever the
size of the corpus. Frequent entries are looked up in a bounded broadcast, all others by a join;
words for the base scores go the same way. Words are known by 64-bit hash.

Null and empty texts score the end symbol alone. Rows need no unique ids. Without training texts
every byte has probability 1/256. Columns other than the id and the text are not read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.frames import durable
from tablecare.llm.textnum import Words, each_chunk, mix

DEPTH = 5
END = 0xFF  # no byte of UTF-8
WORDS, GRAMS = 0, 1
FLUSH = 1_000_000  # entries that a task holds before it merges them, and passes them on if that leaves as many
TEXT_BYTES = 256 * 1024  # bytes of text that are worked on at a time: a byte takes some hundred bytes of arrays
SENT = 131_072  # entries that leave a task in one piece
BINS_PER_DOUBLING = 16
TOP = 2  # contexts of this many bytes are the roots of the subtrees
SLICE = 400_000  # entries of whole subtrees that are worked on at a time


def stream(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a chunk's normalised texts with their ends, the starts of the texts, and each byte's place in its text."""
    n_words = np.diff(words.first)
    row = np.repeat(np.arange(words.rows), n_words)
    weight = np.maximum(np.bincount(row, words.lengths + 1, words.rows).astype(np.int64), 1)
    start = np.concatenate([[0], np.cumsum(weight)])
    out = np.full(start[-1], 32, np.uint8)
    if len(row):
        before = np.concatenate([[0], np.cumsum(words.lengths + 1)])[:-1]
        at = start[row] + before - before[words.first[row]]
        source = np.flatnonzero(words.kind)
        word = np.repeat(np.arange(len(row)), words.lengths)
        out[source - words.starts[word] + at[word]] = words.bytes[source]
    out[start[1:] - 1] = END
    place = np.arange(len(out)) - np.repeat(start[:-1], weight)
    return out, start[:-1], place


def context_byte(out: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """The byte ``back`` places before each one; beyond a text's start, the end symbol."""
    got = np.full(len(out), END, np.uint8)
    got[back:] = out[:-back]
    got[place < back] = END
    return got


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # the parts are sorted already
    keys, counts = keys[order], counts[order]
    start = _runs(keys)
    return keys[start], np.add.reduceat(counts, start, axis=0) if len(start) else counts


def tallied(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order; how often each comes, and how often among ``learned`` ones."""
    every, other = np.sort(keys), np.sort(keys[~learned])
    start, other_start = _runs(every), _runs(other)
    distinct, seen = every[start], np.diff(np.append(start, len(every)))
    n = seen.copy()
    n[np.searchsorted(distinct, other[other_start])] -= np.diff(np.append(other_start, len(other)))
    return distinct, np.stack([seen, n], axis=1)


def _counted(depth: int):
    """Per task, how often it holds each word and each byte with its context: in all texts, and in those to learn from."""

    def counts(batches):
        held = {WORDS: [], GRAMS: []}

        def flush(kind: int, least: int):
            if sum(len(k) for k, _ in held[kind]) <= least:
                return
            keys, n = (np.concatenate(v) for v in zip(*held[kind], strict=True))
            held[kind] = []
            keys, n = _merged(keys, n)
            held[kind] = [(keys, n)]
            if len(keys) > FLUSH or least == 0:
                held[kind] = []
                for at in range(0, len(keys), SENT):
                    part = slice(at, at + SENT)
                    numbers = [pa.array(np.ascontiguousarray(v)) for v in (keys[part].view(np.int64), n[part, 0], n[part, 1])]
                    kinds = pa.array(np.full(len(numbers[0]), kind, np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, *numbers], names=["kind", "key", "seen", "n"])

        for batch, words in each_chunk(batches, "text", limit=TEXT_BYTES):
            learned = batch.column(batch.schema.get_field_index("training")).to_numpy(zero_copy_only=False).astype(bool)
            out, start, place = stream(words)
            key = grams_of(out, place, depth)
            for kind, values, first in ((WORDS, words.hash, words.first), (GRAMS, key, np.append(start, len(out)))):
                held[kind].append(tallied(values, np.repeat(learned, np.diff(first))))
                yield from flush(kind, FLUSH)
        for kind in (WORDS, GRAMS):
            yield from flush(kind, 0)

    return counts


def grams_of(out: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Every byte with its context: the byte itself lowest, the byte ``k`` places before it at bit ``8 k``."""
    key = out.astype(np.uint64)
    for k in range(1, depth + 1):
        key |= context_byte(out, place, k).astype(np.uint64) << np.uint64(8 * k)
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x >= 1/2, by Stirling's series at x + 6."""
    y = x + 6
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def nearest_first(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys with the nearest context byte highest and the byte itself lowest, so that subtrees are ranges."""
    out = keys & np.uint64(255)
    for k in range(1, depth + 1):
        out |= (keys >> np.uint64(8 * k) & np.uint64(255)) << np.uint64(8 * (depth - k + 1))
    return out


@dataclass
class Nodes:
    """The binary decisions of one bit place in all contexts of one length."""

    of: np.ndarray  # the decision that an entry (context, byte) takes part in
    first: np.ndarray  # a decision's first entry
    up: np.ndarray  # the same decision in the context one byte shorter
    zeros: np.ndarray
    ones: np.ndarray
    mixed: np.ndarray  # log of the weighted block probability
    own: np.ndarray  # weight of the context itself against all that are longer

    @property
    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted block probability (log) of inner nodes and the weight of their own estimates."""
    block = _block(zeros, ones)
    mixed = np.logaddexp(block, below) - np.log(2)
    return mixed, np.exp(block - np.log(2) - mixed)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For context lengths ``depth`` down to ``TOP``: sorted entries, their counts, and their places one length up."""
    out = []
    for d in range(depth, TOP - 1, -1):
        shorter = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
        up_keys, up = np.unique(shorter, return_inverse=True) if d > TOP else (keys, np.arange(len(keys)))
        out.append((keys, n, up))
        keys, n = up_keys, np.bincount(up, n, len(up_keys))
    return out


def bit_place(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], j: int) -> list[Nodes]:
    """The decisions on bit ``j`` (0: highest) of a byte, from the longest contexts up, weighted bottom-up."""
    cut = []
    for keys, _, _ in levels:
        group = keys >> np.uint64(8 - j)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        cut.append((np.cumsum(new) - 1, np.flatnonzero(new)))
    out, below = [], None
    for i, (keys, n, up) in enumerate(levels):
        of, first = cut[i]
        total = np.add.reduceat(n, first)
        ones = np.add.reduceat(n * (keys >> np.uint64(7 - j) & np.uint64(1)), first)
        if below is None:
            mixed, own = _block(total - ones, ones), np.ones(len(first))
        else:
            mixed, own = weigh(total - ones, ones, below)
        parent = cut[i + 1][0][up[first]] if i + 1 < len(levels) else first
        out.append(Nodes(of, first, parent, total - ones, ones, mixed, own))
        if i + 1 < len(levels):
            below = np.bincount(parent, mixed, len(cut[i + 1][1]))
    return out


def _root_places(levels, nodes: list[Nodes], j: int) -> tuple[np.ndarray, np.ndarray]:
    """The last byte and the decision (1 to 255, as in a heap) of the shortest contexts' nodes."""
    keys = levels[-1][0][nodes[-1].first]
    return (keys >> np.uint64(16)).astype(np.int64), ((keys & np.uint64(255)) >> np.uint64(8 - j) | np.uint64(1 << j)).astype(np.int64)


def subtree_roots(keys: np.ndarray, n: np.ndarray, depth: int) -> list[np.ndarray]:
    """(last byte, decision, zeros, ones, mixed) of all contexts of two bytes, from whole subtrees in sorted order."""
    levels = _levels(keys, n, depth)
    parts = []
    for j in range(8):
        nodes = bit_place(levels, j)
        parts.append((*_root_places(levels, nodes, j), nodes[-1].zeros, nodes[-1].ones, nodes[-1].mixed))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


@dataclass
class Trunk:
    """For every last byte and decision: the estimate of a one from contexts of 0 and 1 bytes, and the weight left for longer ones."""

    seen: np.ndarray
    left: np.ndarray


def trunk(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Trunk:
    """From counts and block probabilities (last byte, decision) of the contexts of one byte."""
    mixed, own = weigh(zeros, ones, below)
    one = (ones + 0.5) / (zeros + ones + 1)
    z, o = zeros.sum(axis=0), ones.sum(axis=0)
    _, root = weigh(z, o, mixed.sum(axis=0))
    return Trunk(root * (o + 0.5) / (z + o + 1) + (1 - root) * own * one, (1 - root) * (1 - own))


def entry_scores(keys: np.ndarray, n: np.ndarray, depth: int, top: Trunk) -> np.ndarray:
    """log10 of the probability of every entry (context, byte) of whole subtrees in sorted order."""
    levels = _levels(keys, n, depth)
    out = np.zeros(len(keys))
    for j in range(8):
        nodes = bit_place(levels, j)
        place = _root_places(levels, nodes, j)
        seen, left = top.seen[place], top.left[place]
        for i in range(len(nodes) - 1, -1, -1):
            at = nodes[i]
            if i + 1 < len(nodes):
                seen, left = seen[at.up], left[at.up]
            seen = seen + left * at.own * at.one
            left = left * (1 - at.own)
        p = np.clip(seen, 1e-15, 1 - 1e-15)[nodes[0].of]
        out += np.log10(np.where(keys >> np.uint64(7 - j) & np.uint64(1), p, 1 - p))
    return out


def _subtrees(batches, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Keys nearest first, training counts, and the other columns after the keys as given, of some whole subtrees at a time."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    given, n, *others = (np.concatenate(v) for v in zip(*parts, strict=True))
    keys = nearest_first(given.view(np.uint64), depth)
    order = np.argsort(keys)
    keys, n, columns = keys[order], n[order].astype(np.float64), [c[order] for c in (given, *others)]
    root = keys >> np.uint64(8 * (depth - TOP + 1))
    ends = np.append(np.flatnonzero(root[1:] != root[:-1]) + 1, len(keys))
    lo = 0
    while lo < len(keys):
        fits = ends[(ends > lo) & (ends <= lo + SLICE)]
        hi = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, lo, "right")])
        yield keys[lo:hi], n[lo:hi], [c[lo:hi] for c in columns]
        lo = hi


def _rooted(depth: int):
    def roots(batches):
        for keys, n, _ in _subtrees(batches, depth):
            last, node, *numbers = subtree_roots(keys, n, depth)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (last, node, *numbers)], names=["last", "node", "zeros", "ones", "mixed"])

    return roots


def _entries(depth: int, shared, beside: list[str]):
    def entries(batches):
        for keys, n, (given, *others) in _subtrees(batches, depth):
            values = entry_scores(keys, n, depth, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (given, values, *others)], names=["key", "value", *beside])

    return entries


def context_tree(grams: DataFrame, depth: int = DEPTH, beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, value): log10 of the probability of each byte in its context, from counts (key, n); n may be 0.

    The long columns ``beside`` go along.
    """
    if not TOP <= depth <= 7:
        raise ValueError(f"depth must lie between {TOP} and 7")
    root = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    roots = grams.select("key", "n").repartition(root).mapInArrow(_rooted(depth), "last long, node long, zeros double, ones double, mixed double")
    # at most 256 last bytes by 255 decisions
    sums = roots.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "mixed"))).toArrow()
    last, node, *numbers = (sums.column(c).to_numpy() for c in ("last", "node", "zeros", "ones", "mixed"))
    tables = [np.zeros((256, 256)) for _ in numbers]
    for table, values in zip(tables, numbers, strict=True):
        table[last, node] = values
    shared = grams.sparkSession.sparkContext.broadcast(trunk(*tables))
    schema = ", ".join(["key long, value double", *(f"{c} long" for c in beside)])
    return grams.select("key", "n", *beside).repartition(root).mapInArrow(_entries(depth, shared, list(beside)), schema)


class Lookup:
    """Values of 64-bit keys in a few hashed tables without chains; what finds no place is left out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, levels: int = 5):
        self.tables = []
        for level in range(levels):
            bits = max(1, int(len(keys)).bit_length())
            table, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)
            at = self._slots(keys, level, bits)
            table[at], value[at] = keys, values
            self.tables.append((bits, table, value))
            out = table[at] != keys
            keys, values = keys[out], values[out]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64(level)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where it is not held."""
        out = np.full(len(keys), np.nan)
        on, asked = np.arange(len(keys)), keys
        for level, (bits, table, value) in enumerate(self.tables):
            at = self._slots(asked, level, bits)
            same = table[at] == asked
            out[on[same]] = value[at[same]]
            on, asked = on[~same], asked[~same]
        return out


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of a written table with the largest ``seen``, at most ``most``; rows of about equal ``seen`` come together or not at all."""
    size = F.floor(F.log2("seen") * BINS_PER_DOUBLING).cast("int")
    bins = counts.groupBy(size.alias("bin")).agg(F.count("*").alias("rows")).orderBy(F.desc("bin")).collect()
    kept, least = 0, None
    for r in bins:
        kept += r["rows"]
        if kept > most:
            break
        least = r["bin"]
    return counts.where(size >= least) if least is not None else counts.limit(0)


def _totals(plain: DataFrame, depth: int) -> DataFrame:
    """(kind, key, seen, n) of every word and byte; a task has merged its own, so they meet in the shuffle, in no table before it."""
    counts = plain.select("text", "training").mapInArrow(_counted(depth), "kind int, key long, seen long, n long")
    return counts.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n"))


def _scored(shared, end_score: float, end_known: bool, depth: int):
    """Per text: tokens, the scores of its frequent words and bytes, and its other words (with their counts) and bytes."""

    def scores(batches):
        top_words, top_scores, top_known, top_grams = shared.value
        for batch, words in each_chunk(batches, "text", limit=TEXT_BYTES):
            row = np.repeat(np.arange(words.rows), np.diff(words.first))
            at = np.minimum(np.searchsorted(top_words, words.hash), max(len(top_words) - 1, 0))
            hit = top_words[at] == words.hash if len(top_words) else np.zeros(len(row), bool)
            base = np.bincount(row[hit], top_scores[at[hit]], words.rows) + end_score
            known = np.bincount(row[hit], top_known[at[hit]], words.rows).astype(np.int64) + int(end_known)
            r, h = row[~hit], words.hash[~hit]
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(r)))
            ends = np.searchsorted(r[new], np.arange(words.rows + 1)).astype(np.int32)
            out, start, place = stream(words)
            key = grams_of(out, place, depth)
            value = top_grams.find(key)
            missed = np.flatnonzero(np.isnan(value))
            value[missed] = 0
            missed_ends = np.searchsorted(missed, np.append(start, len(out))).astype(np.int32)
            score = np.add.reduceat(value, start) if len(out) else np.zeros(0)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (h[new].view(np.int64), times)]
            lists.append(pa.ListArray.from_arrays(pa.array(missed_ends), pa.array(key[missed].view(np.int64))))
            tokens = np.diff(words.first).astype(np.int64) + 1
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            names = ["doc_id", "n_tokens", "known", "base", "top_score", "words", "times", "grams"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in (tokens, known, base, score)), *lists], names=names)

    return scores


def language_model_scores(
    docs: DataFrame,
    training: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    max_frequent_grams: int = 1_048_576,
    max_frequent_words: int = 131_072,
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score; ``training`` marks the rows to learn from.

    The two maxima bound what is broadcast (16 bytes an entry); all other words and bytes are joined.
    """
    spark = docs.sparkSession
    marked = F.coalesce(training, F.lit(False))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), marked.alias("training"))
    counts = durable(_totals(plain, depth), "counts")
    grams = counts.where(F.col("kind") == GRAMS)
    words = counts.where(F.col("kind") == WORDS)
    # every text ends once, so the ends are counted with the bytes
    ends = grams.where(F.col("key").bitwiseAND(F.lit(255)) == END).agg(F.sum("n").alias("n")).first()["n"] or 0
    total = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    train_tokens = (total["n"] or 0) + ends
    scale = train_tokens + 0.1 * (total["v"] + (ends > 0) + 1)
    share = F.log10((F.col("n") + 0.1) / scale)
    values = words.select("kind", "key", share.alias("value"), (F.col("n") > 0).alias("seen_before"))
    tree = durable(context_tree(grams, depth, ("seen",)), "context-tree")
    bytes_of = tree.select(F.lit(GRAMS).alias("kind"), "key", "value", F.lit(True).alias("seen_before"))
    top = _most_frequent(words, max_frequent_words).select("key", "n").toArrow()
    top_words, top_counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(top_words)
    # at most max_frequent_grams rows of 16 bytes
    top_grams = _most_frequent(tree, max_frequent_grams).select("key", "value").toArrow()
    lookup = Lookup(top_grams.column(0).to_numpy().view(np.uint64), top_grams.column(1).to_numpy())
    top_scores = np.log10((top_counts[order] + 0.1) / scale)
    del top_grams
    shared = spark.sparkContext.broadcast((top_words[order], top_scores, top_counts[order] > 0, lookup))
    end_score = float(np.log10((ends + 0.1) / scale))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, known long, base double, top_score double, words array<long>, times array<long>, grams array<long>"
    scored = plain.select("doc_id", "text").mapInArrow(_scored(shared, end_score, ends > 0, depth), schema)
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    other_words = scored.select("row", F.lit(WORDS).alias("kind"), F.explode(F.arrays_zip("words", "times")).alias("w"))
    other_words = other_words.select("row", "kind", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    other_bytes = scored.select("row", F.lit(GRAMS).alias("kind"), F.explode("grams").alias("key"), F.lit(1).cast("long").alias("times"))
    rare = other_words.unionByName(other_bytes).join(values.unionByName(bytes_of), ["kind", "key"])
    worth = F.col("times") * F.col("value")
    is_word = F.col("kind") == WORDS
    rare = rare.groupBy("row").agg(
        F.sum(F.when(is_word, worth)).alias("rare_base"),
        F.sum(F.when(is_word & F.col("seen_before"), F.col("times"))).alias("rare_known"),
        F.sum(F.when(~is_word, worth)).alias("rare_score"),
    )
    return scored.drop("words", "times", "grams").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("top_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
