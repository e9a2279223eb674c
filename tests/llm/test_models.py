import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablecare.llm.context_tree import (
    DEPTH,
    END,
    SENT,
    WORDS,
    Lookup,
    _block,
    _counted,
    _scored,
    _totals,
    context_tree,
    language_model_scores,
    log_gamma,
    tallied,
)
from tablecare.llm.frames import crc_fold, labelled_texts
from tablecare.llm.quality import fit_quality, score_quality
from tablecare.llm.queries import QUERIES
from tablecare.llm.textnum import LOWER, Words, hashed_words, raw
from tablecare.llm.toxicity import IDENTITY_SETS, _features, _fit, _telling, fit_toxicity, score_toxicity
from tests.llm.tables import LOWER as LOWERED
from tests.llm.tables import TEXTS, WORD, awkward, empty, shingles


def words_of(texts, table=LOWER):
    offsets, data = raw(pa.array([t or "" for t in texts], pa.large_string()))
    return Words(offsets, data, 0, len(texts), table)


def test_words_and_shingles_are_those_of_the_texts():
    words = words_of(TEXTS)
    lists = [WORD.findall((t or "").translate(LOWERED)) for t in TEXTS]
    assert np.diff(words.first).tolist() == list(map(len, lists))
    flat = [w for ws in lists for w in ws]
    assert (words.hash == hashed_words(flat)).all()
    assert len(set(words.hash.tolist())) == len(set(flat))
    for n in (1, 3, 5):
        assert [len(s) for s in words.shingles(n)] == [len(shingles(t, n)) for t in TEXTS]


def held_out_accuracy(spark, sf_dir, name, label):
    got = QUERIES[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_on_unseen_labels(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01", "op3_quality", "quality") > 0.95


def test_toxicity_on_unseen_labels(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01", "op9_toxicity", "toxic") > 0.9


def test_naming_a_group_does_not_move_the_score(spark):
    groups = [g for s in IDENTITY_SETS for g in s]
    rows, labels = [], []
    for i in range(400):
        # a biased corpus: texts that name the first group of a set are mostly toxic
        biased = i % 4 == 0
        group = IDENTITY_SETS[0][1 if biased else 2 + i % 5]
        toxic = biased or i % 16 == 1
        rows.append((i, f"some {group} people say word{i % 17} " + ("you idiot scum" if toxic and i % 3 else "hello there")))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(g, f"the {g} people say hello there") for g in IDENTITY_SETS[0]], "g string, text string")

    def gap(fairness):
        model = fit_toxicity(docs, marks, fairness=fairness)
        got = [r.score for r in score_toxicity(probe, model).collect()]
        return max(got) - min(got)

    assert gap(50.0) < 0.5 * gap(0.0)
    assert len(set(groups)) == len(groups)


def test_classifiers_on_awkward_rows(spark):
    docs = awkward(spark)
    for fit, score in ((fit_toxicity, score_toxicity), (fit_quality, score_quality)):
        label = "toxic" if fit is fit_toxicity else "quality"
        labels = docs.select("doc_id", F.col("label").alias(label))
        got = score(docs, fit(docs, labels))
        assert got.columns == [*docs.columns, "_score"]
        assert all(0 <= r["_score"] <= 1 for r in got.collect())
        none = score(empty(spark), fit(empty(spark), labels))
        assert none.count() == 0
        unlabelled = score(docs, fit(docs, labels.where("false")))
        assert unlabelled.where("_score IS NULL OR _score < 0 OR _score > 1").count() == 0


def test_log_gamma_and_block_probability():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    # one zero and one one: 1/2 * (1/2) / 2
    assert math.isclose(float(np.exp(_block(np.array([1.0]), np.array([1.0])))[0]), 1 / 8)


class PlainTree:
    """Context-tree weighting over bytes by the textbook recursion, one decision at a time."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for text in texts:
            padded = bytes([END]) * depth + text
            for i in range(depth, len(padded)):
                for d in range(depth + 1):
                    context = padded[i - d : i]
                    if d:
                        self.children.setdefault(context[1:], set()).add(context)
                    for j in range(8):
                        self.counts[context, j, padded[i] >> (8 - j), padded[i] >> (7 - j) & 1] += 1
        self.blocks = {}

    def split(self, context, j, high):
        return self.counts[context, j, high, 0], self.counts[context, j, high, 1]

    def own_block(self, context, j, high):
        z, o = self.split(context, j, high)
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def block(self, context, j, high):
        key = context, j, high
        if key not in self.blocks:
            own = self.own_block(*key)
            if len(context) < self.depth:
                below = sum(self.block(c, j, high) for c in self.children.get(context, ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.blocks[key] = own
        return self.blocks[key]

    def log10(self, context, byte):
        total = 0.0
        for j in range(8):
            high, bit, p, left = byte >> (8 - j), byte >> (7 - j) & 1, 0.0, 1.0
            for d in range(self.depth + 1):
                here = context[len(context) - d :]
                z, o = self.split(here, j, high)
                own = 1.0 if d == self.depth else math.exp(self.own_block(here, j, high) - math.log(2) - self.block(here, j, high))
                p, left = p + left * own * (o + 0.5) / (z + o + 1), left * (1 - own)
            total += math.log10(p if bit else 1 - p)
        return total

    def score(self, text):
        padded = bytes([END]) * self.depth + text
        return sum(self.log10(padded[i - self.depth : i], padded[i]) for i in range(self.depth, len(padded)))


def key_of(context, byte):
    return byte | sum(b << (8 * k) for k, b in enumerate(reversed(context), 1))


def test_tree_matches_the_recursion_and_sums_to_one(spark):
    text = b"abracadabra abracadabra banana bandana"
    for depth in (2, 3):
        plain = PlainTree([text], depth)
        padded = bytes([END]) * depth + text
        entries = Counter((padded[i - depth : i], padded[i]) for i in range(depth, len(padded)))
        # every byte after a known context, after one known in part, and after an unknown one
        whole = [b"abr"[-depth:], b"xra"[-depth:], b"xyz"[-depth:]]
        entries.update({(c, b): 0 for c in whole for b in range(256)})
        rows = [(key_of(c, b), n) for (c, b), n in entries.items()]
        got = dict(map(tuple, context_tree(spark.createDataFrame(rows, "key long, n long"), depth).collect()))
        assert len(got) == len(entries)
        for context, byte in entries:
            assert math.isclose(got[key_of(context, byte)], plain.log10(context, byte), rel_tol=1e-6, abs_tol=1e-9)
        for c in whole:
            assert math.isclose(sum(10 ** got[key_of(c, b)] for b in range(256)), 1, rel_tol=1e-6)


def test_document_scores_equal_the_recursion(spark):
    texts = ["the cat sat on the mat", "The  cat ate\tthe rat", "", None, "zebra crossing the cat", "the cat sat on the mat", "naïve café the cat"]
    learned = {0, 1, 2, 3, 5}
    normal = [" ".join(WORD.findall((t or "").translate(LOWERED))).encode() + bytes([END]) for t in texts]
    plain = PlainTree([normal[i] for i in learned], DEPTH)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # all entries joined, a part of them, all of them looked up
    for most in (0, 40, 10_000):
        got = language_model_scores(docs, F.col("doc_id").isin(*learned), max_frequent_grams=most).collect()
        assert len(got) == len(texts)
        for r in got:
            assert math.isclose(r.score, plain.score(normal[r.doc_id]), rel_tol=1e-6)


def peak_mb(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_a_task_counts_and_scores_in_bounded_memory():
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"etaoin shrdlu ", np.uint8)
    texts = [letters[rng.integers(0, len(letters), 4000)].tobytes().decode() for _ in range(2000)]
    columns = [pa.array(range(2000)), pa.array(texts), pa.array(rng.random(2000) < 0.9)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "training"])

    largest, peak = peak_mb(lambda: max(b.num_rows for b in _counted(DEPTH)([batch])))
    assert peak < 250  # 445 with two MB of text and two million entries at a time
    assert largest <= SENT
    sent = list(_counted(DEPTH)([batch]))
    got = pa.Table.from_batches(sent).group_by(["kind", "key"]).aggregate([("seen", "sum"), ("n", "sum")]).to_pydict()
    words = Counter()
    for text, learned in zip(texts, columns[2].to_pylist(), strict=True):
        for w in text.split():
            words[w, 0] += 1
            words[w, 1] += learned
    spelled = sorted({w for w, _ in words})
    found = {key: (seen, n) for kind, key, seen, n in zip(*got.values(), strict=True) if kind == WORDS}
    assert found == {int(h): (words[w, 0], words[w, 1]) for w, h in zip(spelled, hashed_words(spelled).view(np.int64), strict=True)}

    keys = np.unique(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    shared = SimpleNamespace(value=(keys, np.ones(len(keys)), np.ones(len(keys), bool), Lookup(keys, np.ones(len(keys)))))
    scored, peak = peak_mb(lambda: sum(b.num_rows for b in _scored(shared, 0.0, True, DEPTH)([batch])))
    assert scored == 2000 and peak < 100  # 215 before


def test_tallies_equal_a_plain_count():
    rng = np.random.default_rng(9)
    for size, share in ((0, 0.5), (1, 0.0), (1, 1.0), (5000, 0.0), (5000, 0.3), (5000, 1.0)):
        keys, learned = rng.integers(0, 900, size).astype(np.uint64), rng.random(size) < share
        distinct, counts = tallied(keys, learned)
        every, some = Counter(keys.tolist()), Counter(keys[learned].tolist())
        assert distinct.tolist() == sorted(every)
        assert counts.tolist() == [[every[k], some[k]] for k in distinct.tolist()]


def test_lookup_holds_what_it_returns():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000).astype(np.uint64))
    values = rng.normal(size=len(keys))
    found = Lookup(keys, values).find(keys)
    assert (np.isnan(found) | (found == values)).all() and np.isnan(found).mean() < 0.01
    assert np.isnan(Lookup(keys[::2], values[::2]).find(keys[1::2])).all()
    assert np.isnan(Lookup(keys[:0], values[:0]).find(keys)).all()


def test_base_scores_equal_a_plain_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 10) == 0
    learned = {r.doc_id for r in docs.where(~held_out).collect()}
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWERED)), None] for r in docs.collect()}
    c = Counter(t for i in learned for t in tokens[i])
    total = sum(c.values())
    # a small table of frequent words sends most words through the join
    rows = language_model_scores(docs, ~held_out, max_frequent_words=50, max_frequent_grams=500).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((c[t] + 0.1) / (total + 0.1 * (len(c) + 1))) for t in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[t] > 0 for t in own), total)
        assert r.score < 0


def test_language_model_on_awkward_rows(spark):
    docs = awkward(spark)
    assert language_model_scores(docs, F.lit(True)).count() == docs.count()
    assert language_model_scores(empty(spark), F.lit(True)).count() == 0
    for r in language_model_scores(docs.where("doc_id = 4"), F.lit(False)).collect():
        assert math.isclose(r.score, -8 * math.log10(2), rel_tol=1e-4) and r.n_known == 0 and r.base_score == 0


def test_toxicity_gradient_and_scores_equal_a_plain_computation(spark):
    rows = [(i, f"w{i % 5} w{i % 3} " + ("awful man" if i % 4 == 0 else "fine woman")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, marks)
    known = {int(h): w for h, w in zip(model.vocabulary, model.weights, strict=True)}
    # every word of the labelled texts is a feature, however rare
    for _, text in rows:
        assert {int(h) for h in hashed_words(text.split())} <= set(known)
    for r in score_toxicity(docs, model).collect():
        z = model.bias + sum(known[int(h)] for h in set(hashed_words(r.text.split()).tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)


def test_fitted_weights_are_where_the_loss_is_flat():
    draw = np.random.default_rng(3)
    y = (draw.random(60) < 0.4).astype(float)
    row = np.repeat(np.arange(60), 4)
    col = np.concatenate([draw.choice(12, 4, replace=False) for _ in range(60)])
    twins = {0: [1], 1: [0]}
    scaled, bias = _fit(y, row, col, 12, twins, fairness=2.0, ridge=0.05, steps=4000)
    scale = _telling(y, row, col, 12)

    def loss(w, b):
        z = b + np.bincount(row, (w * scale)[col], 60)
        shift = np.zeros(60)
        for i, f in zip(row, col, strict=True):
            if f in twins:
                shift[i] += w[1 - f] * scale[1 - f] - w[f] * scale[f]
        return np.mean(np.logaddexp(0, z) - y * z) + 2.0 * np.mean(shift**2) + 0.025 * (w**2).sum()

    w = np.divide(scaled, scale, out=np.zeros(12), where=scale > 0)
    for f in range(12):
        step = np.zeros(12)
        step[f] = 1e-5
        assert abs(loss(w + step, bias) - loss(w - step, bias)) / 2e-5 < 2e-3


def test_a_labelled_id_with_many_texts_is_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = labelled_texts(docs, marks, "doc_id", "text", "toxic", 10).orderBy("doc_id").collect()
    assert [(r.doc_id, r.label) for r in got] == [(1, 1), (2, 0), (3, 1)]
    assert got[1].text == "" and labelled_texts(docs, marks, "doc_id", "text", "toxic", 2).count() <= 2


def test_the_fit_holds_few_bytes_of_each_word_of_a_text(spark):
    word = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(50_000))))
    docs = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", word))
    labels = docs.select("doc_id", F.pmod("doc_id", F.lit(5)).cast("int").alias("toxic")).where("toxic < 2")
    labels = labels.union(docs.selectExpr("doc_id", "0 AS toxic").where("doc_id % 5 > 1"))
    model, peak = peak_mb(lambda: fit_toxicity(docs, labels, steps=3))
    assert len(model.vocabulary) > 50_000 and peak < 32  # 43 before


def test_features_are_those_of_the_batches_in_the_order_of_the_ties():
    rng = np.random.default_rng(12)
    sets = [np.array([5, 900], np.uint64), np.array([7], np.uint64)]
    ties = rng.permutation(40)
    texts = [np.unique(rng.integers(0, 300, rng.integers(0, 30)).astype(np.uint64) << np.uint64(55)) for _ in ties]
    batches = []
    for part in (slice(0, 0), slice(0, 1), slice(1, 25), slice(25, 40)):
        words = pa.array([t.view(np.int64).tolist() for t in texts[part]], pa.list_(pa.int64()))
        columns = [pa.array(ties[part], pa.int64()), pa.array(ties[part] % 2, pa.int32()), words]
        batches.append(pa.RecordBatch.from_arrays(columns, names=["tie", "label", "words"]))
    y, row, col, vocabulary = _features(batches, sets)
    assert not batches and set(vocabulary.tolist()) == {5, 7, 900, *(int(h) for t in texts for h in t)}
    assert y.tolist() == [i % 2 for i in range(40)]
    want = [(i, int(h)) for i, k in enumerate(np.argsort(ties)) for h in texts[k]]
    assert list(zip(row.tolist(), vocabulary[col].tolist(), strict=True)) == want
    assert [len(v) for v in _features([], sets)] == [0, 0, 0, 3]


def test_frequent_bytes_need_no_join_and_counts_no_table_before_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 7}") for i in range(40)], "doc_id long, text string")
    plan = _totals(docs.withColumn("training", F.lit(True)), DEPTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]

    def unwanted(_):
        raise AssertionError("a broadcast table")

    want = {r.doc_id: r.score for r in language_model_scores(docs, F.col("doc_id") > 3, max_frequent_grams=0).collect()}
    monkeypatch.setattr(F, "broadcast", unwanted)
    got = {r.doc_id: r.score for r in language_model_scores(docs, F.col("doc_id") > 3).collect()}
    assert len(got) == 40 and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
