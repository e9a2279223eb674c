import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tablecare.llm import prefix_trie as module
from tablecare.llm.prefix_trie import end_digests, prefix_nodes, prefixes, two_fattest

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, spliced=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    if not spliced:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def brute(convs):
    """Every node by listing all prefixes of all conversations."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def under(p):
        todo = [p]
        while todo:
            q = todo.pop()
            yield q
            todo += children.get(q, [])

    out = []
    for p, ids in members.items():
        sub = list(under(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        leaves = sum(q not in children for q in sub)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children.get(p, [])), leaves, saved, digest))
    return sorted(out, key=str)


def nodes(spark, rows, spliced=True, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "key": F.lit(1), "bytes": F.lit(None).cast("int")})
    ident = F.col("conv_id")
    if spliced:
        options |= {"donor": ident - ident % 5, "head": F.crc32(ident.cast("string").cast("binary")) % 9, "longest_head": 8}
    return sorted((tuple(r) for r in prefix_nodes(table, **options).collect()), key=str)


def some(seed, n, longest=9, words=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(3 * n), n):
        for turn in range(draw.randrange(longest + 1)):
            rows.append((c, turn, draw.choice(["user", None]), draw.choice(["ä" * k for k in range(words)])))
    draw.shuffle(rows)
    return rows


def test_few_words_make_deep_sharing(spark):
    rows = some(1, 60)
    assert nodes(spark, rows, spliced=False, batches=3) == brute(rebuilt(rows, spliced=False))


def test_spliced_conversations(spark):
    rows = some(2, 80, longest=20, words=5)
    rows += [(1000 + i, t, "user", f"first {t}") for i in range(40) for t in range(3)]  # a large group of copies
    assert nodes(spark, rows) == brute(rebuilt(rows))


def test_one_long_conversation_among_many(spark):
    rows = [(5, t, "user", "same") for t in range(700)] + [(c, t, "user", "same") for c in range(6, 30) for t in range(c * 7)]
    rows += [(7, 1000, "x", "end"), (31, None, None, None), (32, 3, "user", "same")]
    assert nodes(spark, rows, spliced=False, batches=2) == brute(rebuilt(rows, spliced=False))


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "x"), (3, None, None, None), (3, 0, "user", None), (3, 1, None, "a"), (8, 0, "", ""), (9, None, None, None),
        (0, 0, "user", "long " * 20_000), (1, 0, "user", "long " * 20_000), (1, 1, "user", "t"), (1, 2, "user", "t"), (-7, 0, "user", "n"),
        (None, None, None, None), (4, 5, "us", "ertext"), (2, 5, "user", "text"),
    ]
    assert nodes(spark, rows, spliced=False) == brute(rebuilt(rows, spliced=False))
    equal = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]  # whole rows repeat
    assert nodes(spark, equal, spliced=False) == brute(rebuilt(equal, spliced=False))
    assert nodes(spark, []) == nodes(spark, [(None, 1, "user", "x")]) == []
    # all turns may go to the head of an absent conversation
    turnless = [(c, 0, "user", "a") for c in (1, 2, 3, 4, 6)]
    assert nodes(spark, turnless) == brute(rebuilt(turnless))


def test_prefix_sums_do_not_depend_on_partitions(spark):
    rows = [(c, t, "u", str(t % 4)) for c in (1, 2) for t in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefixes(table, "conv_id", "turn", "role", "text")
        seen.append({r.pos: tuple(r)[1:] for r in got.where("conv_id = 2").collect()})
        ones = {r.pos: tuple(r)[1:] for r in got.where("conv_id = 1").collect()}
        assert ones == seen[-1] and sorted(ones) == list(range(1, 301))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1]


def test_handles(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 70)] + [(2**40, 2**41 + 5)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got[:-1]:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)
    assert got[-1].f == 2**41


def test_digests_stream_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "IDS_PER_CHUNK", 3)
    ends = spark.range(0, 100).selectExpr("id AS conv_id", "named_struct('d', id % 2, 'p1', 0L, 'p2', 5L) AS key").repartition(5)
    got = {r.key.d: r.ends_sha256 for r in end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 100, 2)).encode()).hexdigest() for k in (0, 1)}
