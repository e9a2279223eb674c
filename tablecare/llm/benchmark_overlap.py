"""Benchmark passages in training texts, found by a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. A training text streams through
it word by word; the state says how long a run ending here occurs in some item. A run of at least
``window`` words, or a whole item of fewer words, marks all its words as hit. States whose words
are exactly the last ``window`` carry the ids of the items that contain them.

Words are known by 64-bit hash. Before the automaton, numpy leaves only stretches in which every
pair of neighbouring words also neighbours in an item (single words where an item is one word):
outside of them no match of two words exists, so nothing is lost, and inside the automaton decides.

The items are dealt into shards of about half of ``SHARD_WORDS`` words (long items in pieces that
overlap by ``window - 1`` words, which keeps all their windows); a task builds the automaton of each,
a broadcast of bounded size carries it, and the texts stream past one shard at a time. Between
shards the marked texts are a written table. One shard, the usual case, is one pass without a
shuffle, whatever sources or copies the texts hold.

Null texts have no words. Items without words match nothing; items with a null id mark words but
appear in no list; an id that several items share is listed once. Empty tables give empty results.
Extra columns stay, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.llm.frames import append_columns, durable, extended, fresh
from tablecare.llm.textnum import LOWER, each_chunk, mix

SHARD_WORDS = 200_000
# Kinds of bytes: 1 where a word goes on (digits, letters, all of UTF-8 beyond ASCII).
RUNS = np.zeros(256, np.uint8)
RUNS[0x30:0x3A] = RUNS[0x61:0x7B] = RUNS[0x80:] = 1
SPAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("first_word", "end_word", "start", "end")])


class Automaton:
    """Suffix automaton of several word sequences; ``state 0`` is the empty run."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._new(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: int) -> int:
        """The state of the run that ends in ``word`` after the state ``last``."""
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return state


class Matcher:
    """The automaton of some items, with what each state says about windows and short items."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        """``items``: (id, word hashes); pieces of one item share its id."""
        self.window = window
        self.words = np.unique(np.fromiter((w for _, words in items for w in words), np.uint64))
        auto = Automaton()
        items = [(ident, np.searchsorted(self.words, np.array(words, np.uint64)).tolist()) for ident, words in items]
        self.least = min([window, *(len(words) for _, words in items if words)])
        for _, words in items:
            state = 0
            for word in words:
                state = auto.extend(state, word)
        self.next, self.link, self.length = auto.next, auto.link, auto.length
        self.single = np.zeros(len(self.words), bool)
        self.found: dict[int, set[str]] = {}  # items by the state of a window or of a whole short item
        pairs = []
        for ident, words in items:
            own = set() if ident is None else {ident}
            if len(words) == 1 and window > 1:
                self.single[words[0]] = True
            pairs.append(np.array(words, np.int64)[:-1] * len(self.words) + np.array(words, np.int64)[1:])
            state = length = 0
            for word in words:
                state, length = self.next[state][word], length + 1
                if length >= window:
                    self.found.setdefault(self._of_length(state, window), set()).update(own)
            if 0 < length < window:
                self.found.setdefault(state, set()).update(own)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        if window == 1:
            self.single[:] = True
        # nearest state on the way to the root, itself included, that is a whole short item
        self.short = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = state in self.found and self.length[state] < window
            self.short[state] = state if own else self.short[self.link[state]]

    def _of_length(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, run length, state) for each run that must go, as word after word streams past."""
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            state, matched = (0, 0) if to is None else (to, matched + 1)
            if matched >= self.window:
                yield at + 1, matched, self._of_length(state, self.window)
            # a state's longest run is matched whole only if ``matched`` reaches it
            short = self.short[state] if matched >= self.length[state] else self.short[self.link[state]] if state else -1
            while short > 0:
                yield at + 1, self.length[short], short
                short = self.short[self.link[short]]

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and the starts and ends of stretches that may hold a match."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        joined = np.zeros(len(hashes) + 1, bool)  # word i goes with word i - 1
        if len(self.pairs) and len(hashes) > 1:
            both = np.flatnonzero(known[1:] & known[:-1]) + 1
            pair = at[both - 1] * len(self.words) + at[both]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[place] == pair]] = True
        joined[first] = False
        live = joined[:-1] | joined[1:] | (known & self.single[at] if len(self.words) else known)
        start = np.flatnonzero(live & ~joined[:-1])
        end = np.flatnonzero(live & ~joined[1:]) + 1
        long = end - start >= self.least
        return at, start[long], end[long]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marking(shard, text: str, names: tuple[str, str, str], again: bool):
    """Batches with number of words, hit spans and item ids; united with those of earlier shards if ``again``."""
    count, spans, found = names

    def work(batches):
        matcher = pickle.loads(shard.value) if shard else None
        for batch, words in each_chunk(batches, text, LOWER, RUNS):
            hit: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            if again:
                for row, old in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                    if old:
                        hit[row] = [(s["first_word"], s["end_word"]) for s in old]
                        items[row] = set(batch.column(batch.schema.get_field_index(found))[row].as_py())
                batch = batch.select([c for c in batch.schema.names if c not in names])
            if matcher is not None and len(words.hash):
                number, starts, ends = matcher.stretches(words.hash, words.first)
                rows = np.searchsorted(words.first, starts, "right") - 1
                for lo, hi, row in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
                    base, here = lo - int(words.first[row]), []
                    for end, length, state in matcher.stream(number[lo:hi].tolist()):
                        here.append((base + end - length, base + end))
                        items.setdefault(row, set()).update(matcher.found[state])
                    if here:
                        hit.setdefault(row, []).extend(merged(here))
            lists = [_placed(words, row, merged(hit[row])) if row in hit else [] for row in range(words.rows)]
            columns = {
                count: pa.array(np.diff(words.first), pa.int64()),
                spans: pa.array(lists, pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN]))),
                found: pa.array([sorted(items.get(row, ())) for row in range(words.rows)], pa.list_(pa.string())),
            }
            yield append_columns(batch, **columns)

    return work


def _placed(words, row: int, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans with their places in the text, in characters."""
    at, chars, out = int(words.row_start[row]), 0, []

    def upto(byte: int) -> int:
        nonlocal at, chars
        chars += int(np.count_nonzero((words.bytes[at:byte] & 0xC0) != 0x80))
        at = byte
        return chars

    for first, end in spans:
        a, b = int(words.first[row]) + first, int(words.first[row]) + end - 1
        start = upto(int(words.starts[a]))
        out.append({"first_word": first, "end_word": end, "start": start, "end": upto(int(words.starts[b] + words.lengths[b]))})
    return out


def _item_words(items: DataFrame) -> DataFrame:
    def work(batches):
        for batch, words in each_chunk(batches, "text", LOWER, RUNS):
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])

    return items.mapInArrow(work, "item_id string, words array<long>")


def automata(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> tuple[DataFrame, int]:
    """(shard, automaton) with one row per shard, written, and the number of shards."""
    words = _item_words(items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")))
    words = durable(words.where(F.size("words") > 0), "item-words")
    total = words.agg(F.sum(F.size("words")).alias("n")).collect()[0]["n"] or 0
    n_shards = math.ceil(2 * total / shard_words)
    step = max(1, shard_words // 32 - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(step))
    pieces = words.select("item_id", "words", F.explode(starts).alias("at"))
    pieces = pieces.select("item_id", F.slice("words", F.col("at") + 1, step + window - 1).alias("words")).distinct()
    # by id and words, so that neither one id nor copies of one item gather in a shard
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, n_shards))).cast("int"))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = zip(table["item_id"].to_pylist(), table["words"].to_pylist(), strict=True)
        blob = pickle.dumps(Matcher([(n, np.array(w, np.int64).view(np.uint64).tolist()) for n, w in rows], window))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "automaton": pa.array([blob], pa.binary())})

    return durable(pieces.groupBy("shard").applyInArrow(build, "shard int, automaton binary"), "automata"), n_shards


def benchmark_overlap(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_words: int = SHARD_WORDS,
    names: tuple[str, str, str] = ("n_words", "hit_spans", "item_ids"),
) -> DataFrame:
    """``docs`` with its number of words, its hit spans, and the distinct ids of the items found, as sorted texts.

    A span names words (first, behind the last) and characters (start, end) of the text. Where
    ``docs`` has a column of one of the ``names``, underscores go in front of the new one.
    """
    names = tuple(fresh(docs.columns, n) for n in names)
    built, n_shards = automata(items, item_id, item_text, window, shard_words)
    kinds = (T.LongType(), T.ArrayType(SPAN), T.ArrayType(T.StringType()))
    schema = extended(docs.schema, **dict(zip(names, kinds, strict=True)))
    marked, again = docs, False
    for shard in range(max(1, n_shards)):
        rows = built.where(F.col("shard") == shard).select("automaton").collect()
        if rows or not n_shards:
            held = docs.sparkSession.sparkContext.broadcast(bytes(rows[0]["automaton"])) if rows else None
            marked, again = marked.mapInArrow(_marking(held, text, names, again), schema), True
            marked = durable(marked, "marked") if n_shards > 1 else marked
    return marked


def without_overlap(
    docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5, max_words: int | None = None, **options
) -> DataFrame:
    """``docs`` with the hit passages cut out of their texts; documents above a limit are left out.

    A document goes whole if the share of its words that is hit is above ``max_coverage``, or if
    one span is longer than ``max_words``. Columns stay as they are; other texts stay unchanged.
    """
    names = tuple(fresh(docs.columns, n) for n in ("n_words", "hit_spans", "item_ids"))
    marked = benchmark_overlap(docs, items, text, names=names, **options)
    spans: Column = F.col(names[1])
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    stays = hit <= F.col(names[0]) * max_coverage
    if max_words is not None:
        stays &= ~F.exists(spans, lambda s: s["end_word"] - s["first_word"] > max_words)
    # what stands between the spans: from each end to the next start
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(F.col(text)).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    parts = F.zip_with(ends, starts, lambda a, b: F.substr(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return marked.where(stays).withColumn(text, cut).select(*docs.columns)
