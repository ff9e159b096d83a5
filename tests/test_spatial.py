"""Proximity joins on clouds that are hard for grids, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import filters, index, registration, spatial
from cloudframe.operators.spatial import knn_join, knn_padded, nearest, radius_count, radius_join

SCHEMA = "pid long, x double, y double, z double"


def frame(spark, array, first=0):
    return spark.createDataFrame([(first + k, *map(float, r)) for k, r in enumerate(array)], SCHEMA)


def brute(points, queries, k, skip_self=False):
    out = {}
    for i, q in enumerate(queries):
        d2 = ((points - q) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(points)), d2)) if not (skip_self and i == j)][:k]
        out[i] = [(j, float(np.sqrt(d2[j]))) for j in order]
    return out


def check(found, want):
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.pid, r.d))
    for i, rows in want.items():
        mine = got.get(i, [])
        assert [p for p, _ in mine] == [p for p, _ in rows], i
        assert np.allclose([d for _, d in mine], [d for _, d in rows])


def clouds():
    rng = np.random.default_rng(3)
    even = rng.uniform(-5, 5, (900, 3))
    crowds = np.concatenate([rng.normal(size=(500, 3)) * 1e-3 + c for c in ([0, 0, 0], [100, 0, 0])] + [rng.uniform(-200, 200, (40, 3))])
    flat = np.concatenate([rng.uniform(0, 1, (600, 2)), np.zeros((600, 1))], axis=1)
    copies = np.concatenate([np.repeat([[1.0, 2.0, 3.0]], 700, axis=0), rng.uniform(0, 4, (60, 3))])
    return {"even": even, "crowds": crowds, "flat": flat, "copies": copies}


@pytest.mark.parametrize("name", list(clouds()))
@pytest.mark.parametrize("k,skip", [(1, False), (8, True)])
def test_knn(spark, name, k, skip):
    a = clouds()[name]
    cloud = frame(spark, a).repartition(3)
    check(knn_join(cloud, cloud, k, skip, "tree"), brute(a, a, k, skip))


def test_knn_of_queries_far_outside_and_with_many_neighbours(spark):
    a = clouds()["crowds"]
    far = np.array([[1e4, 0, 0], [-3e3, 2e3, 50], [50, 0, 0], [0, 0, 0]])
    check(knn_join(frame(spark, a), frame(spark, far), 5, strategy="tree"), brute(a, far, 5))
    check(knn_join(frame(spark, a), frame(spark, far), 900, strategy="tree"), brute(a, far, 900))


@pytest.mark.parametrize("strategy", ["auto", "tree", "brute"])
def test_knn_edge_cases(spark, strategy):
    few = np.array([[0, 0, 0], [1, 0, 0], [3, 0, 0]], float)
    check(knn_join(frame(spark, few), frame(spark, few), 10, strategy=strategy), brute(few, few, 10))
    one = frame(spark, few[:1])
    assert [r.pid for r in knn_join(one, one, 4, strategy=strategy).collect()] == [0]
    assert knn_join(one, one, 4, skip_self=True, strategy=strategy).count() == 0
    empty = frame(spark, few[:1]).limit(0)
    assert knn_join(empty, one, 3, strategy=strategy).count() == knn_join(one, empty, 3, strategy=strategy).count() == knn_join(one, one, 0, strategy=strategy).count() == 0
    odd = frame(spark, np.array([[np.nan, 0, 0], [np.inf, 0, 0], [1, 1, 1]]))
    assert [r.pid for r in knn_join(odd, one, 3, strategy=strategy).collect()] == [2]
    with pytest.raises(Exception, match="not finite"):
        knn_join(one, odd, 1, strategy=strategy).collect()


def test_brute_broadcasts_the_smaller_side(spark):
    large, small = spark.range(30_000).selectExpr("id pid", "double(id) x", "0d y", "0d z"), frame(spark, np.zeros((2, 3)))
    plan = knn_join(large, small, 3, strategy="brute")._jdf.queryExecution().toString()
    assert "BuildLeft" in plan and "Cartesian" not in plan
    assert [r.pid for r in knn_join(large, small, 2, strategy="brute").where("qid = 0").orderBy("rank").collect()] == [0, 1]


def test_nearest_and_padded(spark):
    a = np.array([[0, 0, 0], [0, 0, 0], [2, 0, 0]], float)
    assert sorted((r.qid, r.pid) for r in nearest(frame(spark, a), frame(spark, a)).collect()) == [(0, 0), (1, 0), (2, 2)]
    assert sorted((r.qid, r.pid) for r in nearest(frame(spark, a), frame(spark, a), skip_self=True).collect()) == [(0, 1), (1, 0), (2, 0)]
    assert [r.pid for r in nearest(frame(spark, a).limit(0), frame(spark, a)).collect()] == [-1, -1, -1]
    rows = sorted((r.qid, r.rank, r.pid) for r in knn_padded(frame(spark, a[:2]), frame(spark, a[:1]), 4).collect())
    assert rows == [(0, 1, 0), (0, 2, 1), (0, 3, -1), (0, 4, -1)]


def test_radius(spark):
    a = np.array([[0, 0, 0], [0, 0, 0], [1, 0, 0], [0, 2, 0]], float)
    cloud = frame(spark, a)
    pairs = lambda r, **o: sorted((x.qid, x.pid) for x in radius_join(cloud, cloud, r, **o).collect())
    assert pairs(0) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3)]
    assert pairs(1, skip_self=True) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]  # the radius itself counts
    with pytest.raises(ValueError):
        radius_join(cloud, cloud, -1)
    assert {r.n for r in radius_count(cloud, cloud, 0).collect()} == {0}
    assert sorted((r.qid, r.n) for r in radius_count(cloud, cloud, 5, early_stop=3).collect()) == [(k, 3) for k in range(4)]


@pytest.mark.parametrize("name", list(clouds()))
def test_radius_pairs_in_small_tiles(spark, monkeypatch, name):
    for key, value in {"TILE": 64, "COMPARED": 10_000, "SORTED": 500, "ROWS": 100}.items():
        monkeypatch.setattr(index, key, value)
    a = clouds()[name]
    b, r = a[::3] + 0.25, {"even": 1.0, "crowds": 1e-3, "flat": 0.3, "copies": 0.5}[name]
    for queries, points in ((a, a), (b, a)):
        cloud = frame(spark, points).repartition(3)
        found = radius_join(cloud, cloud if queries is points else frame(spark, queries, 10_000), r).collect()
        d = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(axis=2))
        want = {(i + (0 if queries is points else 10_000), j): d[i, j] for i, j in zip(*np.nonzero(d <= r), strict=True)}
        assert len(found) == len(want) and {(x.qid, x.pid): x.d for x in found} == pytest.approx(want)


def test_radius_pairs_of_odd_points(spark):
    odd = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (None, 0.1, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("inf"), 0.0, 0.0)], SCHEMA)
    good = odd.where("pid = 1 or pid is null")
    ids = lambda df: sorted((str(x.qid), str(x.pid)) for x in df.collect())
    assert ids(radius_join(odd, good, 0.2)) == ids(radius_join(good, good, 0.2)) == [("1", "1"), ("1", "None"), ("None", "1"), ("None", "None")]
    assert radius_join(good.limit(0), good, 1.0).count() == radius_join(good, good.limit(0), 1.0).count() == 0
    with pytest.raises(Exception, match="not finite"):
        radius_join(good, odd, 0.2).collect()


def test_radius_pairs_are_small_where_they_are_written(spark, tmp_path):
    """All pairs are quadratic, so they must not be shuffled, and equal distances and few ids must lie together in a file."""
    cloud = frame(spark, np.random.default_rng(8).uniform(0, 0.2, (2_500, 3)))
    found = radius_join(cloud, cloud, 0.1).select("qid", "pid", F.round("d", 6).alias("d"))
    found.write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    n = back.count()
    assert n > 1_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * n  # 9.5 bytes a pair by cells
    d = found.where(F.spark_partition_id() == 0).toPandas()["d"].to_numpy()
    assert len(d) > 10_000 and (np.diff(d) > 0).sum() <= 4


def test_outliers(spark):
    line = frame(spark, [[i * 0.01, 0, 0] for i in range(10)] + [[100, 0, 0]])
    sor = filters.StatisticalOutlierRemoval(4, 1.0)
    assert sorted(r.pid for r in sor.apply(line).collect()) == list(range(10)) and [r.pid for r in sor.removed(line).collect()] == [10]
    near = knn_join(line, line, 5)
    assert sorted(r.pid for r in filters.StatisticalOutlierRemoval(4, 1.0, near).apply(line).collect()) == list(range(10))
    odd = line.unionByName(frame(spark, [[np.nan, 0, 0]], 11))
    assert 11 not in {r.pid for r in sor.apply(odd).collect()} | {r.pid for r in filters.radius_outlier_removal(odd, 0.02, 1).collect()}
    assert sorted(r.pid for r in filters.radius_outlier_removal(line, 0.0, 1).collect()) == list(range(11))


def test_registration(spark):
    ten = np.array([[i, i % 3, i % 2] for i in range(10)], float)
    found = registration.icp(frame(spark, ten), frame(spark, ten))
    assert np.allclose(found.transformation, np.eye(4)) and found.converged and (found.fitness, found.rmse) == (1.0, 0.0)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(80, 3)) * 0.5
    angle = 0.1
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    b = a @ turn.T + [0.02, 0.01, -0.02]
    found = registration.icp(frame(spark, a), frame(spark, b), iterations=30)
    assert np.allclose(found.transformation[:3, :3], turn, atol=1e-4) and np.allclose(found.transformation[:3, 3], [0.02, 0.01, -0.02], atol=1e-4)
    assert np.allclose(found.transformation[:3, :3] @ found.transformation[:3, :3].T, np.eye(3))
    line = frame(spark, [[i, 0, 0] for i in range(6)])
    with pytest.raises(RuntimeError, match="line"):
        registration.icp(line, line)
    with pytest.raises(ValueError):
        registration.icp(line, line.limit(0))
    with pytest.raises(ValueError):
        registration.correspondences(line, line, overlap=0.0)
    trimmed = registration.correspondences(frame(spark, a), frame(spark, b), overlap=0.25).collect()
    every = sorted((r.d, r.src) for r in registration.correspondences(frame(spark, a), frame(spark, b)).collect())
    assert sorted((r.d, r.src) for r in trimmed) == every[:20]
    row = registration.metrics(frame(spark, a), registration.correspondences(frame(spark, a), frame(spark, b + 100), most=1.0)).first()
    assert (row.fitness, row.rmse) == (0.0, float("inf"))


def test_horn_agrees_with_the_step(spark):
    """The rotation by quaternions, the largest eigenvector of a 4x4 matrix, is the one by singular values."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        p, q = rng.normal(size=(2, 30, 3))
        s = (p - p.mean(0)).T @ (q - q.mean(0)) / 30
        row = {f"h{a}{b}": s[i, j] for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
        row |= {f"m{n}{c}": v[i] for n, v in (("p", p.mean(0)), ("q", q.mean(0))) for i, c in enumerate("xyz")}
        d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
        m = np.block([[np.array([[np.trace(s)]]), d[None]], [d[:, None], s + s.T - np.trace(s) * np.eye(3)]])
        w, x, y, z = np.linalg.eigh(m)[1][:, -1]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(registration.rigid_step(row)[:3, :3], r, atol=1e-6)


def places(name):
    """Clouds that partitions find hard, with queries in them, between them and far outside."""
    a = clouds()[name]
    far = np.array([[1e4, 0, 0], [-3e3, 2e3, 50], [50, 0, 0], [1.0, 2.0, 3.0]])
    return a, np.concatenate([a[::9], far])


@pytest.mark.parametrize("name", list(clouds()))
@pytest.mark.parametrize("k,most,pieces", [(1, np.inf, 1000), (5, 0.4, 7), (40, np.inf, 1000)])
def test_index_of_many_partitions(spark, monkeypatch, name, k, most, pieces):
    monkeypatch.setattr(index, "QUERIES", pieces)  # few queries a task: points go to several
    monkeypatch.setattr(index, "NEXT", 2)
    a, q = places(name)
    built = index.SpatialIndex(spatial._points(frame(spark, a)), parts=13)
    assert built.n == len(a) and built.parts.n.max() < 4 * len(a) / 13  # crowded places are dealt out, too
    want = {i: [(p, d) for p, d in rows if d <= most] for i, rows in brute(a, q, k).items()}
    found = knn_join(built, frame(spark, q), k, strategy="tree", most=most)
    assert {r.qid for r in found.collect()} == {i for i, rows in want.items() if rows}
    check(found, want)


@pytest.mark.parametrize("name", list(clouds()))
@pytest.mark.parametrize("stop,skip", [(None, False), (6, False), (6, True)])
def test_counts_by_boxes(spark, name, stop, skip):
    a, q = places(name)
    built = index.SpatialIndex(spatial._points(frame(spark, a)), parts=13)
    for radius in (0.0015, 1.0, 90.0):
        found = {r.qid: r.n for r in radius_count(built, frame(spark, q), radius, stop, skip).collect()}
        near = np.sqrt((((a[None] - q[:, None]) ** 2)[..., 0] + ((a[None] - q[:, None]) ** 2)[..., 1]) + ((a[None] - q[:, None]) ** 2)[..., 2]) <= radius
        if skip:
            near[np.arange(min(len(q), len(a))), np.arange(min(len(q), len(a)))] = False
        n = near.sum(axis=1)
        assert found == {i: min(int(c), stop) if stop else int(c) for i, c in enumerate(n)}


def test_dense_cell_takes_linear_work():
    """100,000 points in one ball: leaves within it are counted unseen, and few points are compared."""
    rng = np.random.default_rng(4)
    a = rng.uniform(0, 1e-3, (100_000, 3))
    cloud, compared = index._Cloud(np.arange(len(a)), a), []
    pairs, index._pairs = index._pairs, lambda axes, q: compared.append(axes.shape[1] * len(q)) or pairs(axes, q)
    try:
        assert (cloud.within(a, 0.01, None) == len(a)).all() and sum(compared) == 0
        assert (cloud.within(a, 2e-4, 100) >= 100).all() and sum(compared) < 100 * len(a)
    finally:
        index._pairs = pairs


def test_index_of_nothing(spark):
    empty = spatial.index(frame(spark, np.zeros((1, 3))).limit(0))
    one = frame(spark, np.zeros((1, 3)))
    assert empty.n == 0 and knn_join(empty, one, 2, strategy="tree").count() == 0
    assert [tuple(r) for r in radius_count(empty, one, 1.0).collect()] == [(0, 0)]
