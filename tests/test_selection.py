"""Order statistics, and correspondences that use them, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import registration, selection, spatial
from cloudframe.operators.selection import kth_smallest, smallest
from cloudframe.plans.lineage import cut


def columns():
    rng = np.random.default_rng(2)
    return {
        "even": rng.uniform(-1, 1, 3000), "scales": np.exp(rng.normal(size=3000) * 100), "two": rng.choice([0.25, 4.0], 3000), "one": np.full(3000, -7.5),
        "mixed": np.concatenate([np.full(1500, 1.0), rng.normal(size=1500)]), "few": np.array([3.0, 1.0, 2.0]),
    }


@pytest.mark.parametrize("name", list(columns()))
def test_kth(spark, monkeypatch, name):
    monkeypatch.setattr(selection, "FEW", 20)
    v = columns()[name]
    order = np.lexsort((np.arange(len(v)), v))
    df = cut(spark.createDataFrame([(float(x), k) for k, x in enumerate(v)] + [(None, -1)], "d double, src long").repartition(3))
    for k in {1, 2, len(v) // 3, len(v) // 2 + 1, len(v)}:
        assert kth_smallest(df, k, "d", "src") == (v[order[k - 1]], order[k - 1])
        assert kth_smallest(df, k, "d") == (v[order[k - 1]], None)
        assert {r.src for r in smallest(df.where("d is not null"), k, "d", "src").collect()} == set(order[:k].tolist())
    assert kth_smallest(df, len(v) + 1, "d") is None and kth_smallest(df, 0, "d") is None
    assert smallest(df, len(v) + 5, "d", "src").count() == len(v) + 1 and smallest(df, 0, "d", "src").count() == 0


SCHEMA = "pid long, x double, y double, z double"


def frame(spark, a):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(a)], SCHEMA)


@pytest.mark.parametrize("indexed", [False, True])
@pytest.mark.parametrize("most", [0.3, 100.0])
def test_correspondences_against_brute_force(spark, monkeypatch, indexed, most):
    """The bound may be the width of the cloud: no pair is compared for it."""
    rng = np.random.default_rng(8)
    t, s = rng.uniform(0, 4, (700, 3)), np.round(rng.uniform(0, 4, (500, 3)), 1)
    source, target = frame(spark, s), frame(spark, t)
    if indexed:
        monkeypatch.setattr(spatial, "BRUTE_PAIRS", 0)
    d = np.sqrt(((s[:, None] - t[None]) ** 2).sum(axis=2))
    near = [(i, int(d[i].argmin()), d[i].min()) for i in range(len(s)) if d[i].min() <= most]
    mutual = [x for x in near if d[:, x[1]].argmin() == x[0]]
    single = {}
    for i, j, x in sorted(near, key=lambda r: (r[2], r[0])):
        single.setdefault(j, (i, j, x))
    trimmed = sorted(near, key=lambda r: (r[2], r[0]))[:200]
    built = spatial.index(target) if indexed else None
    for options, want in (({}, near), ({"reciprocal": True}, mutual), ({"one_to_one": True}, single.values()), ({"overlap": 0.4}, trimmed)):
        found = registration.correspondences(source, target, most, index=built, **options)
        plan = found._jdf.queryExecution().toString()
        assert "TakeOrdered" not in plan and "Cartesian" not in plan
        assert sorted((r.src, r.tgt) for r in found.collect()) == sorted((i, j) for i, j, _ in want)
        assert np.allclose(sorted(r.d for r in found.collect()), sorted(x for _, _, x in want))


def test_registration_indexes_its_target_once(spark, monkeypatch):
    monkeypatch.setattr(registration, "BRUTE_PAIRS", 0)
    monkeypatch.setattr(spatial, "BRUTE_PAIRS", 0)
    built, build = [], spatial.SpatialIndex.__init__
    monkeypatch.setattr(spatial.SpatialIndex, "__init__", lambda self, *a, **o: built.append(1) or build(self, *a, **o))
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 1, (400, 3))
    found = registration.icp(frame(spark, a), frame(spark, a + [0.01, -0.02, 0.005]), iterations=4, most=5.0)
    assert np.allclose(found.transformation[:3, 3], [0.01, -0.02, 0.005], atol=1e-6) and found.fitness == 1.0 and len(built) == 1
    assert found.aligned.agg(F.count("*")).first()[0] == 400
