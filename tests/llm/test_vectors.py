import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablecare.llm.components import components
from tablecare.llm.near_vectors import fit_cells, near_vectors, unit


def brute(vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    return close


def clustered(n, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 20, 32))
    return centres[draw.integers(0, len(centres), n)] + draw.normal(size=(n, 32)) * draw.uniform(0.05, 0.5, (n, 1))


def test_recall_and_precision_against_brute_force(spark):
    vectors = clustered(3000)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = near_vectors(table, leaf_rows=128).orderBy("vec_id").collect()
    want = brute(vectors).sum(axis=1)
    links = np.array([r.n_links for r in got])
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()


def test_a_cluster_of_a_third_of_the_rows_keeps_its_links(spark, tmp_path):
    draw = np.random.default_rng(5)
    n, size = 60_000, 64
    centre = draw.normal(size=size)
    cluster = centre + draw.normal(size=(n // 3, size)) * 0.25
    tight = draw.normal(size=size) + draw.normal(size=(3000, size)) * 0.02  # all within half the link angle
    others = np.repeat(draw.normal(size=(n // 100, size)), 62, axis=0)
    others = others + draw.normal(size=others.shape) * 0.25
    vectors = np.concatenate([cluster, tight, others])[draw.permutation(n // 3 + 3000 + len(others))]
    column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), size).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": column}), str(tmp_path / "v.parquet"))
    got = near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).orderBy("vec_id").toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = draw.choice(len(vectors), 3000, replace=False)
    close = unit[rows] @ unit.T >= 0.9
    want, links = close.sum(axis=1) - 1, got.n_links.to_numpy()[rows]
    dense = want > 1000
    assert dense.any() and (links[dense] == want[dense]).all()
    assert (links <= want).all() and links[~dense].sum() >= 0.97 * want[~dense].sum()
    component = got.component_id.to_numpy()
    alike = [(component[c][component[c] == component[r]].size, c.sum()) for r, c in zip(rows[dense], close[dense], strict=True)]
    assert all(a == b for a, b in alike)


def test_clusters_that_share_a_direction_are_not_copied_to_each_other():
    draw = np.random.default_rng(3)
    shared = draw.normal(size=64) * 1.5
    centres = shared + draw.normal(size=(40, 64))
    rows = unit(np.repeat(unit(centres), 500, axis=0) + draw.normal(size=(20_000, 64)) * 0.02)
    between = unit(centres) @ unit(centres).T
    assert np.median(between) > 0.6
    cells = fit_cells(rows, 0.9, 128)
    assert len(cells.pivots) == 40
    cosines = rows @ cells.pivots.T
    assert (cells.owners(cosines) >= 0).all()
    assert (cosines >= cells.around).sum() <= 4 * len(rows)
    # what a core row links to lies within its cell's surroundings
    ask = draw.choice(len(rows), 500, replace=False)
    a, b = np.nonzero(rows[ask] @ rows.T >= 0.9)
    owner = cells.owners(cosines)[ask[a]]
    assert (cosines[b, owner] >= cells.around[owner]).all()


def test_clusters_seen_through_a_small_sample(spark, tmp_path):
    draw = np.random.default_rng(6)
    size = 64
    centres = np.repeat(draw.normal(size=(12, size)), 5000, axis=0)
    vectors = (centres + draw.normal(size=centres.shape) * 0.25)[draw.permutation(len(centres))]
    column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), size).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": column}), str(tmp_path / "v.parquet"))
    # one row of thirty is in the sample, as of two million with the default
    got = near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")), sample_rows=2000).orderBy("vec_id").toPandas()
    rows = draw.choice(len(vectors), 2000, replace=False)
    normal = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (normal[rows] @ normal.T >= 0.9).sum(axis=1) - 1
    links = got.n_links.to_numpy()[rows]
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [1e300, 1e299]), (3, [1.0, 0.0]), (None, None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))
    got = near_vectors(table).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    # 1, 3 (twice) and one without id are equal; 2 and 12 are close to them and to each other
    assert by_id[1].n_links == by_id[2].n_links == by_id[12].n_links == 5
    assert {by_id[i].component_id for i in (1, 2, 3, 12)} == {1}
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert [by_id[i].kept for i in (1, 2, 3)] == [True, False, False]
    assert near_vectors(table.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(300, 300), (None, 3), (5, None)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(7, 60)} == {7} and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
