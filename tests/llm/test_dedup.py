import hashlib
import random
import re

from pyspark.sql import functions as F

from tablecare.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tablecare.llm.jaccard import block_keys, budget, entries, jaccard_components, may_link, one_per_component, parity
from tests.llm.tables import SCHEMA, awkward, empty, jaccard_labels


def test_exact_copies_of_awkward_rows(spark):
    docs = awkward(spark)
    got = exact_duplicates(docs).collect()
    assert len(got) == docs.count()
    text_of = {}
    for r in docs.collect():
        plain = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        text_of.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append(r.doc_id)
    for r in got:
        ids = text_of[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    # one row of each text stays, repeated rows and rows without id included
    assert sum(r.kept for r in got) == len(text_of)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(text_of)
    assert exact_duplicates(empty(spark)).count() == 0 and drop_exact_duplicates(empty(spark)).count() == 0


def test_runs_merge_to_one_whatever_their_number(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = sorted(map(tuple, exact_duplicates(docs, run_bits=1).collect()))
    many = sorted(map(tuple, exact_duplicates(docs, run_bits=10).collect()))
    assert few == many


def test_no_python_runs_in_exact_dedup(spark, sf_dir):
    plan = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_linked_sets_share_a_block():
    import numpy as np

    draw = random.Random(3)
    for p, q in ((90, 100), (80, 100)):
        for _ in range(300):
            n = draw.randint(5, 400)
            base = [draw.getrandbits(64) for _ in range(n)]
            away = draw.randint(0, budget(n, p, q))
            lost = draw.randint(0, away)
            other = base[lost:] + [draw.getrandbits(64) for _ in range(away - lost)]
            a, b = (np.unique(np.array(v, np.uint64)) for v in (base, other))
            common = len(np.intersect1d(a, b))
            if q * common < p * (len(a) + len(b) - common) or away == 0:
                continue
            left, right = ({*x.tolist(), *y.tolist()} for x, y in (entries(a, p, q), entries(b, p, q)))
            assert left & right
        assert len(block_keys(a, 8, p, q)) == budget(len(a), p, q) + 1


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.getrandbits(30)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    draw = random.Random(7)
    texts = {}
    for family in range(12):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([6, 20, 60, 150]))]
        for _ in range(25):
            texts[len(texts) + 1] = edited(draw, words, draw.randrange(0, 6))
    line = " ".join(f"common{i}" for i in range(12))
    for _ in range(60):
        texts[len(texts) + 1] = line + " " + " ".join(f"u{draw.getrandbits(20)}" for _ in range(draw.randrange(0, 30)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words, p, q in ((3, 90, 100), (5, 80, 100)):
        want = jaccard_labels(texts, words, p, q)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, words, p, q).collect()}
        assert got == want


def test_open_groups_are_compared_across_slices(spark, monkeypatch):
    monkeypatch.setattr("tablecare.llm.jaccard.SLICE_SETS", 8)
    draw = random.Random(1)
    words = [f"w{i}" for i in range(80)]
    texts = {i + 1: edited(draw, words, draw.randrange(0, 5)) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_labels(texts, 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == want


def test_near_copies_of_awkward_rows(spark):
    docs = awkward(spark)
    got = jaccard_components(docs, 3, 90, 100).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[10].component_id == 9
    assert by_id[3].n_shingles == 0 and by_id[3].component_id == 3 and by_id[4].component_id == 4
    assert by_id[6].component_id == by_id[7].component_id == 6
    assert {r.component_id for r in got if r.doc_id is None} == {8, None}
    kept = one_per_component(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 2 not in ids and 10 not in ids and {1, 3, 4, 5, 9} <= ids
    assert one_per_component(empty(spark)).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    near = " ".join(f"w{i}" for i in range(60))
    clean = " ".join(f"other{i}" for i in range(60))
    twin = " ".join(f"twin{i}" for i in range(60))
    rows = [(3, near), (5, near + " end"), (5, clean), (7, twin), (7, twin + " end"), (9, clean + " x"), (9, clean + " x"), (None, near)]
    rows += [(11, "whole row twice and nothing like it"), (11, "whole row twice and nothing like it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in one_per_component(docs).collect())
    assert [i for i, _ in got] == [3, 5, 7, 11, 11]
    assert (5, clean) in got and got[2][1] in (twin, twin + " end")


def test_two_slices_of_equal_sets_are_one_node(spark):
    rows = [(i, "same words again and again here", None, None, None, None, None, None, None) for i in range(1, 200)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).agg(F.max("component_id"), F.count("*")).first()
    assert tuple(got) == (1, 199)


def test_sketches_rule_out_no_link():
    import numpy as np

    draw = np.random.default_rng(5)
    fresh = lambda n: draw.integers(0, 2**63, n).astype(np.uint64)
    ruled_out = 0
    for p, q in ((90, 100), (80, 100)):
        for n in (1, 2, 5, 31, 32, 33, 120, 500, 3000):
            for share in (0.0, 0.5, 0.85, 0.95, 1.0):
                base = fresh(n)
                a, b = np.unique(base), np.unique(np.concatenate([base[: int(n * share)], fresh(int(n * (1 - share)))]))
                if not len(b):
                    continue
                common = len(np.intersect1d(a, b))
                links = q * common >= p * (len(a) + len(b) - common)
                possible = may_link(parity(a), parity(b), len(a), len(b), p, q)
                assert possible or not links
                assert possible == may_link(parity(b), parity(a), len(b), len(a), p, q)
                ruled_out += not possible
    assert ruled_out > 30


def test_stages_leave_helper_names_alone(spark):
    taken = ["_id", "_sha", "_lost", "_digest", "digest", "lost_id", "lost_digest", "verdict_id", "verdict_sha", "text_sha256"]
    docs = awkward(spark).withColumns({name: F.lit(name) for name in taken})
    for stage in (drop_exact_duplicates, one_per_component):
        plain, named = stage(awkward(spark)), stage(docs)
        assert named.columns == docs.columns
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        assert sorted(map(key, plain.collect())) == sorted(map(key, named.collect()))


def test_many_texts_under_one_id(spark):
    """Near copies and strangers under one id, and without id: as many texts are fetched as there are sets."""
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base[: k % 60], f"x{k}", *base[k % 60 + 1 :]]) for k in range(1500)]
    far = [" ".join(f"{k}y{i}" for i in range(8)) for k in range(1500)]
    for ident in (7, None):
        docs = spark.createDataFrame([(ident, t) for t in near + far], "doc_id long, text string")
        got = jaccard_components(docs, words=3, p=90, q=100).collect()
        assert len(got) == 3000 and {r.component_id for r in got} == {ident}
    docs = spark.createDataFrame([(7, t) for t in near[:300] + far[:50]], "doc_id long, text string")
    kept = one_per_component(docs, words=3, p=80, q=100)
    want = jaccard_labels(dict(enumerate(near[:300] + far[:50])), 3, 80, 100)
    assert kept.count() == len({label for _, label in want.values()})
