import random
import re

from pyspark.sql import functions as F

from tablecare.llm.benchmark_overlap import Matcher, benchmark_overlap, without_overlap
from tests.llm.tables import LOWER, awkward, empty

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return RUN.findall((text or "").translate(LOWER))


def brute(text, items, window):
    """(number of words, hit word numbers, ids) by trying every place."""
    own, hit, found = words(text), set(), set()
    for ident, item in items:
        item = words(item)
        size = min(window, len(item))
        for at in range(len(item) - size + 1) if item else ():
            for k in range(len(own) - size + 1):
                if own[k : k + size] == item[at : at + size]:
                    hit.update(range(k, k + size))
                    found |= {str(ident)} if ident is not None else set()
    return len(own), hit, sorted(found)


def same(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    window = options.get("window", 10)
    for r in benchmark_overlap(docs, table, **options).collect():
        n, hit, ids = brute(r.text, items, window)
        assert r.n_words == n and r.item_ids == ids
        assert {w for s in r.hit_spans for w in range(s.first_word, s.end_word)} == hit
        for s in r.hit_spans:
            assert words(r.text[s.start : s.end]) == words(r.text)[s.first_word : s.end_word]
            assert not r.text[s.start : s.end].startswith(" ") and not r.text[s.start : s.end].endswith(" ")


def test_random_words_against_brute_force(spark):
    draw = random.Random(4)

    def some(n):
        return " ".join(draw.choice(["a", "B", "c", "é", "D1"]) + draw.choice(["", "", ",", "\n"]) for _ in range(n))

    items = [(i if i % 5 else None, some(draw.choice([0, 1, 2, 3, 4, 6, 9, 30]))) for i in range(12)]
    items += [(7, items[8][1]), (7, "zz"), (90, None)]
    texts = [some(draw.choice([0, 1, 5, 40, 200])) for _ in range(60)] + [None, "", "x " + items[11][1] + " y"]
    for window in (1, 3, 5):
        same(spark, texts, items, window=window)
        same(spark, texts, items, window=window, shard_words=24)  # several shards, items in pieces


def test_automaton_is_linear_in_its_items():
    matcher = Matcher([("1", [1, 2] * 3000), ("2", [2, 1] * 3000)], 10)
    assert len(matcher.length) <= 2 * 12_000


def test_passages_of_a_benchmark(spark):
    draw = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(pool, k=draw.choice([4, 12, 40])))) for i in range(30)]
    texts = []
    for i in range(60):
        parts = draw.choices(pool, k=200)
        if i % 2:
            parts[50:50] = items[draw.randrange(30)][1].upper().split()[draw.choice([0, 1]) :]
        texts.append(" ".join(parts))
    same(spark, texts, items)


def test_awkward_tables(spark):
    docs = awkward(spark).withColumns({"n_words": F.lit("x"), "hit_spans": F.lit(None).cast("int"), "item_ids": F.lit(1)})
    items = spark.createDataFrame([(1, "The QUICK brown, fox"), (None, "one"), (3, None), (4, " .,"), (4, "日本語")], "item_id long, text string")
    got = benchmark_overlap(docs, items).collect()
    assert len(got) == docs.count() and all(r.n_words == "x" and r.item_ids == 1 for r in got)
    for r in got:
        n, hit, ids = brute(r.text, [(1, "the quick brown fox"), (None, "one"), (4, "日本語")], 10)
        assert (r._n_words, r._item_ids) == (n, ids) and sum(s.end_word - s.first_word for s in r._hit_spans) == len(hit)
    nothing = spark.createDataFrame([], items.schema)
    assert all(r.hit_spans == [] and r.item_ids == [] for r in benchmark_overlap(awkward(spark), nothing).collect())
    assert benchmark_overlap(empty(spark), items).count() == 0


def test_cutting(spark):
    passage = " ".join(f"t{i}" for i in range(20))
    rows = [
        (1, "before " * 30 + passage + ", after " * 30, "a"), (2, passage + " end", "b"), (3, "clean text", None), (4, None, "d"), (5, "", "e"),
        (6, "é " * 40 + passage.upper() + " ü" + " x" * 40 + " " + passage, "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in without_overlap(docs, items).collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[3].text == "clean text" and got[4].text is None and got[1].n_words == "a"
    assert got[1].text == "before " * 30 + ", after " * 30
    assert got[6].text == "é " * 40 + " ü" + " x" * 40 + " "
    assert {r.doc_id for r in without_overlap(docs, items, max_words=19).collect()} == {3, 4, 5}
