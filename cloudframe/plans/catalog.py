"""Registered queries over the driver tables, with their DuckDB counterparts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, NORMAL, XYZ, cross, dot, vector
from ..operators import features, filters, grid, iso, mesh, points, registration, report, spatial
from .lineage import cut
from .inputs import E_SQL, L_SQL, O_SQL, V_SQL, embeddings_cloud, events_cloud, lineitem_points, orders_cloud, rounded, table

_QUERIES: dict = {}
_ORACLE: dict = {}
SIDE, RADIUS, NEIGHBOURS = 32, 0.1, 8
#: A known motion, and a step of the registration queries that is smaller than the gaps between points.
MOTION = np.array([[0.8, -0.6, 0, 0.5], [0.6, 0.8, 0, -0.25], [0, 0, 1, 0.125], [0, 0, 0, 1]])
SHIFT = np.array([[1, 0, 0, 0.01], [0, 1, 0, -0.005], [0, 0, 1, 0.0025], [0, 0, 0, 1]])


def query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = "WITH RECURSIVE " + oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLE)


def _r(*columns: str, digits: int = 6) -> list:
    return [rounded(c, digits).alias(c) for c in columns]


def _rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# Voxels, statistics, row access

_VOXELS = "floor(x / {0})::BIGINT AS kx, floor(y / {1})::BIGINT AS ky, floor(z / {2})::BIGINT AS kz"


@query("voxel_downsample", f"{L_SQL}, k AS (SELECT *, {_VOXELS.format('5.0', '1.0', '10.0')} FROM l), a AS (SELECT kx, ky, kz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM k GROUP BY ALL) SELECT kx, ky, kz, {_rs(*XYZ)}, n FROM a")
def _(spark, d):
    return points.voxel_cells(lineitem_points(spark, d), (5.0, 1.0, 10.0)).select("kx", "ky", "kz", *_r(*XYZ), "n")


@query(
    "voxel_cloud",
    f"{E_SQL}, k AS (SELECT *, {_VOXELS.format('0.1', '0.1', '0.1')} FROM e), a AS (SELECT kx, ky, kz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz, avg(label) AS label FROM k GROUP BY ALL) SELECT row_number() OVER (ORDER BY kx, ky, kz) - 1 AS pid, {_rs(*XYZ, *NORMAL, 'label')} FROM a",
)
def _(spark, d):
    return points.voxel_downsample(embeddings_cloud(spark, d), 0.1).select("pid", *_r(*XYZ, *NORMAL, "label"))


@query("uniform_downsample", f"{V_SQL} SELECT pid, x, y, z FROM v WHERE pid % 7 = 0")
def _(spark, d):
    return points.uniform_downsample(events_cloud(spark, d), 7)


@query("sample_rows", f"{O_SQL}, n AS (SELECT count(*) AS n FROM o) SELECT pid, x, y, z FROM o, n WHERE pid % CAST(ceil(n / 1000.0) AS BIGINT) = 0")
def _(spark, d):
    cloud = orders_cloud(spark, d)
    return points.sample_rows(cloud, cloud.count(), 1000)


@query("cloud_bounds", f"{O_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM o")
def _(spark, d):
    return points.bounds(orders_cloud(spark, d))


@query(
    "cloud_stats",
    f"{V_SQL}, w AS (SELECT v.*, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS i FROM v JOIN events ON event_id = pid) SELECT count(*) AS point_count, round(avg(CASE WHEN isfinite(x) AND isfinite(y) AND isfinite(z) THEN 1.0 ELSE 0 END), 6) AS finite_ratio, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}" for c in XYZ)
    + ", round(avg(z), 6) AS error_mean, round(max(z), 6) AS error_max, round(avg(i), 6) AS intensity_mean, round(min(i), 6) AS intensity_min, round(max(i), 6) AS intensity_max FROM w",
)
def _(spark, d):
    k = table(spark, d, "events").select(F.col("event_id").alias("pid"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    out = points.statistics(events_cloud(spark, d).join(k, "pid"), "z", "k")
    return out.select(*[F.col(c) if c == "point_count" else F.round(c, 6).alias(c) for c in out.columns])


@query("transform_points", f"{E_SQL} SELECT pid, round(0.8 * x - 0.6 * y + 0.5, 6) + 0.0 AS x, round(0.6 * x + 0.8 * y - 0.25, 6) + 0.0 AS y, round(z + 0.125, 6) + 0.0 AS z FROM e")
def _(spark, d):
    return points.transform(embeddings_cloud(spark, d).select("pid", *XYZ), MOTION).select("pid", *_r(*XYZ))


@query("gather_points", f"{O_SQL}, p AS (SELECT pid AS position, pid // 3 AS pid FROM o) SELECT position, pid, x, y, z FROM p JOIN o USING (pid)")
def _(spark, d):
    cloud = orders_cloud(spark, d)
    picks = cloud.select(F.col("pid").alias("position"), F.floor(F.col("pid") / 3).cast("long").alias("pid"))
    return points.gather(cloud, picks).select("position", "pid", *XYZ)


@query("merge_clouds", f"{O_SQL}, {V_SQL}, m AS (SELECT max(pid) + 1 AS m FROM o) SELECT pid, x, y, z FROM o UNION ALL SELECT pid + m, x, y, z FROM v, m")
def _(spark, d):
    return points.merge_clouds(orders_cloud(spark, d), events_cloud(spark, d))


@query(
    "orient_viewpoint",
    f"{E_SQL}, s AS (SELECT *, CASE WHEN (1 - x) * nx + (2 - y) * ny + (3 - z) * nz < 0 THEN -1.0 ELSE 1.0 END AS s FROM e) SELECT pid, round(s * nx, 6) + 0.0 AS nx, round(s * ny, 6) + 0.0 AS ny, round(s * nz, 6) + 0.0 AS nz FROM s",
)
def _(spark, d):
    return points.orient_to_viewpoint(embeddings_cloud(spark, d), (1.0, 2.0, 3.0)).select("pid", *_r(*NORMAL))


# Proximity

_DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
_PAIRS = f"pairs AS (SELECT a.pid AS qid, b.pid AS pid, {_DIST} AS d FROM e a, e b)"
_KNN = f"{_PAIRS}, knn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS rank FROM pairs)"


@query("radius_pairs", f"{E_SQL}, {_PAIRS} SELECT qid, pid, round(d, 6) AS d FROM pairs WHERE d <= {RADIUS}")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.radius_join(e, e, RADIUS).select("qid", "pid", F.round("d", 6).alias("d"))


@query("radius_count", f"{E_SQL}, {_PAIRS} SELECT qid, least(count(*) FILTER (d <= {RADIUS} AND qid <> pid), 20) AS n FROM pairs GROUP BY qid")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.radius_count(e, e, RADIUS, 20, skip_self=True)


@query("radius_outlier", f"{E_SQL}, {_PAIRS}, n AS (SELECT qid FROM pairs WHERE d <= {RADIUS} GROUP BY qid HAVING count(*) >= 5) SELECT pid, {_rs(*XYZ)} FROM e WHERE pid IN (SELECT qid FROM n)")
def _(spark, d):
    return filters.radius_outlier_removal(embeddings_cloud(spark, d), RADIUS, 5).select("pid", *_r(*XYZ))


@query("knn_join", f"{E_SQL}, {_KNN} SELECT qid, pid, round(d, 6) AS d, rank FROM knn WHERE rank <= {NEIGHBOURS}")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.knn_join(e, e, NEIGHBOURS, strategy="tree").select("qid", "pid", F.round("d", 6).alias("d"), "rank")


@query("knn_skip_self", f"{E_SQL}, {_PAIRS}, knn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS rank FROM pairs WHERE qid <> pid) SELECT qid, pid, round(d * d, 6) AS d2, rank FROM knn WHERE rank <= {NEIGHBOURS}")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.knn_join(e, e, NEIGHBOURS, skip_self=True).select("qid", "pid", F.round("d2", 6).alias("d2"), "rank")


@query("knn_padded", f"{E_SQL}, {_KNN}, s AS (SELECT pid AS qid, r AS rank FROM e, range(1, 7) t(r)) SELECT s.qid, s.rank, coalesce(k.pid, -1) AS pid, round(coalesce(d * d, 1.7976931348623157e308), 6) AS d2 FROM s LEFT JOIN knn k USING (qid, rank)")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.knn_padded(e, e, 6).select("qid", "rank", "pid", F.round("d2", 6).alias("d2"))


@query("nearest_point", f"{E_SQL}, pairs AS (SELECT a.pid AS qid, b.pid AS pid, sqrt((a.x + 0.01 - b.x) ** 2 + (a.y - 0.005 - b.y) ** 2 + (a.z + 0.0025 - b.z) ** 2) AS d FROM e a, e b) SELECT qid, pid, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS r FROM pairs) WHERE r = 1")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return spatial.nearest(e, points.transform(e, SHIFT)).select("qid", "pid", F.round("d", 6).alias("d"))


_SOR = f"{E_SQL}, {_KNN}, m AS (SELECT qid, avg(d) AS d FROM knn WHERE rank <= {NEIGHBOURS + 1} AND qid <> pid GROUP BY qid), t AS (SELECT avg(d) + 1.0 * stddev_pop(d) AS t FROM m)"


@query("statistical_outlier", f"{_SOR} SELECT pid, {_rs(*XYZ)} FROM e WHERE pid IN (SELECT qid FROM m, t WHERE d <= t)")
def _(spark, d):
    return filters.statistical_outlier_removal(embeddings_cloud(spark, d), NEIGHBOURS, 1.0).select("pid", *_r(*XYZ))


@query("statistical_outlier_removed", f"{_SOR} SELECT pid FROM e WHERE pid NOT IN (SELECT qid FROM m, t WHERE d <= t)")
def _(spark, d):
    return filters.StatisticalOutlierRemoval(NEIGHBOURS, 1.0).removed(embeddings_cloud(spark, d))


# Features

_COVARIANCE = ", ".join(f"round(covar_pop(b.{p[0]}, b.{p[1]}), 6) + 0.0 AS {p}" for p in features.PAIRS)


@query("knn_covariance", f"{E_SQL}, {_KNN} SELECT qid AS pid, count(*) AS n, {_COVARIANCE} FROM knn k JOIN e b ON b.pid = k.pid WHERE rank <= {NEIGHBOURS} GROUP BY qid")
def _(spark, d):
    return features.knn_covariance(embeddings_cloud(spark, d), NEIGHBOURS).select("pid", "n", *_r(*features.PAIRS))


@query("smooth_normals", f"{E_SQL}, {_KNN}, s AS (SELECT qid AS pid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM knn k JOIN e b ON b.pid = k.pid WHERE rank <= {NEIGHBOURS} GROUP BY qid), u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM s) SELECT pid, round(nx / l, 6) + 0.0 AS nx, round(ny / l, 6) + 0.0 AS ny, round(nz / l, 6) + 0.0 AS nz FROM u")
def _(spark, d):
    return features.smooth_normals(embeddings_cloud(spark, d), NEIGHBOURS).select("pid", *_r(*NORMAL))


# A unit normal n is right if n.C.n is the least root of the covariance C, which trigonometry gives in closed form.
@query(
    "estimate_normals",
    f"""{E_SQL}, {_KNN}, c AS (SELECT qid AS pid, {', '.join(f'covar_pop(b.{p[0]}, b.{p[1]}) AS {p}' for p in features.PAIRS)} FROM knn k JOIN e b ON b.pid = k.pid WHERE rank <= {NEIGHBOURS} GROUP BY qid),
    m AS (SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS off FROM c), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6) AS p FROM m),
    r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3) AS r FROM p)
    SELECT pid, 1.0 AS length, round(q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3), 6) + 0.0 AS spread FROM r""",
)
def _(spark, d):
    e = embeddings_cloud(spark, d)
    near = cut(spatial.knn_join(e, e, NEIGHBOURS))
    n = features.estimate_normals(e, NEIGHBOURS, near).select("pid", *NORMAL).join(features.knn_covariance(e, NEIGHBOURS, near), "pid")
    nx, ny, nz = vector(NORMAL)
    spread = nx * nx * F.col("xx") + ny * ny * F.col("yy") + nz * nz * F.col("zz") + 2 * (nx * ny * F.col("xy") + nx * nz * F.col("xz") + ny * nz * F.col("yz"))
    return n.select("pid", rounded(nx * nx + ny * ny + nz * nz).alias("length"), rounded(spread).alias("spread"))


# Registration

_MOVED = "m AS (SELECT pid, x + 0.01 AS x, y - 0.005 AS y, z + 0.0025 AS z FROM e)"
_NEAR = f"near AS (SELECT src, tgt, d FROM (SELECT a.pid AS src, b.pid AS tgt, {_DIST} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {_DIST}, b.pid) AS r FROM m a, e b) WHERE r = 1 AND d <= {RADIUS})"
_BACK = f"back AS (SELECT src, tgt FROM (SELECT b.pid AS src, a.pid AS tgt, row_number() OVER (PARTITION BY a.pid ORDER BY {_DIST}, b.pid) AS r, {_DIST} AS d FROM e a, m b) WHERE r = 1 AND d <= {RADIUS})"


def _pairs(spark, d, **options):
    e = embeddings_cloud(spark, d).select("pid", *XYZ)
    moved = points.transform(e, SHIFT)
    return moved, e, registration.correspondences(moved, e, RADIUS, **options)


@query("icp_correspondences", f"{E_SQL}, {_MOVED}, {_NEAR} SELECT src, tgt, round(d, 6) AS d FROM near")
def _(spark, d):
    return _pairs(spark, d)[2].select("src", "tgt", F.round("d", 6).alias("d"))


@query("icp_reciprocal", f"{E_SQL}, {_MOVED}, {_NEAR}, {_BACK} SELECT src, tgt, round(d, 6) AS d FROM near SEMI JOIN back USING (src, tgt)")
def _(spark, d):
    return _pairs(spark, d, reciprocal=True)[2].select("src", "tgt", F.round("d", 6).alias("d"))


@query("icp_one_to_one", f"{E_SQL}, {_MOVED}, {_NEAR} SELECT src, tgt, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY d, src) AS r FROM near) WHERE r = 1")
def _(spark, d):
    return _pairs(spark, d, one_to_one=True)[2].select("src", "tgt", F.round("d", 6).alias("d"))


_MEANS = {f"m{s}{c}": f"avg({s}.{c})" for s in "pq" for c in XYZ}
_COVARIANCES = {f"h{a}{b}": f"covar_pop(p.{a}, q.{b})" for a in XYZ for b in XYZ} | {f"{s}{a}{b}": f"covar_pop({s}.{a}, {s}.{b})" for s in "pq" for a, b in features.PAIRS}


@query("icp_moments", f"{E_SQL}, {_MOVED}, {_NEAR} SELECT count(*) AS n, round(sum(d * d), 6) AS sum_d2, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in (_MEANS | _COVARIANCES).items())} FROM near JOIN m p ON p.pid = src JOIN e q ON q.pid = tgt")
def _(spark, d):
    return registration.moments(*_pairs(spark, d)).select("n", *_r("sum_d2", *_MEANS, *_COVARIANCES))


@query("ordered_pairs", f"{E_SQL}, {_MOVED} SELECT a.pid AS src, b.pid AS tgt, round({_DIST}, 6) AS d FROM m a JOIN e b ON a.pid = b.pid")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    return registration.ordered_correspondences(points.transform(e, SHIFT), e).select("src", "tgt", F.round("d", 6).alias("d"))


# The motion that was put in comes out, inverted.
@query("icp_align", "t(i, m0, m1, m2, m3) AS (VALUES (0, 1.0, 0.0, 0.0, -0.01), (1, 0.0, 1.0, 0.0, 0.005), (2, 0.0, 0.0, 1.0, -0.0025), (3, 0.0, 0.0, 0.0, 1.0)) SELECT CAST(i AS INT) AS i, CAST(m0 AS DOUBLE) AS m0, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2, CAST(m3 AS DOUBLE) AS m3, true AS converged, 1.0::DOUBLE AS fitness FROM t")
def _(spark, d):
    e = embeddings_cloud(spark, d)
    found = registration.icp(points.transform(e, SHIFT), e, iterations=8, most=0.3, epsilon=1e-6)
    rows = [(i, *map(float, np.round(found.transformation[i], 5) + 0.0), bool(found.converged), float(found.fitness)) for i in range(4)]
    return spark.createDataFrame(rows, "i int, m0 double, m1 double, m2 double, m3 double, converged boolean, fitness double")


@query("icp_trimmed", f"{E_SQL}, {_MOVED}, {_NEAR}, n AS (SELECT greatest(3, ceil(count(*) * 0.4 - 1e-6)) AS n FROM m) SELECT src, tgt, round(d, 6) AS d FROM (SELECT *, row_number() OVER (ORDER BY d, src) AS r FROM near), n WHERE r <= n")
def _(spark, d):
    return _pairs(spark, d, overlap=0.4)[2].select("src", "tgt", F.round("d", 6).alias("d"))


@query("icp_metrics", f"{E_SQL}, {_MOVED}, {_NEAR} SELECT round(count(*) / (SELECT count(*) FROM m), 6) AS fitness, round(sqrt(avg(d * d)), 6) AS rmse FROM near")
def _(spark, d):
    moved, _, pairs = _pairs(spark, d)
    return registration.metrics(moved, pairs).select(F.round("fitness", 6).alias("fitness"), F.round("rmse", 6).alias("rmse"))


@query("icp_flatness", "t(shape, flat) AS (VALUES ('cloud', false), ('plane', false), ('line', true), ('point', true)) SELECT shape, flat FROM t")
def _(spark, d):
    e = embeddings_cloud(spark, d).select("pid", *XYZ)
    shapes = {"cloud": e, "plane": e.withColumn("z", F.lit(0.0)), "line": e.withColumns({"y": F.col("x") * 2, "z": F.lit(1.0)}), "point": e.withColumns({n: F.lit(1.0) for n in XYZ})}
    rows = [(name, bool(registration.flat(registration.moments(s, s, registration.ordered_correspondences(s, s)).first(), "p"))) for name, s in shapes.items()]
    return spark.createDataFrame(rows, "shape string, flat boolean")


# Height grids and meshes

def _grid_sql(aggregate: str, bilinear: bool = True, side: int = SIDE, name: str = "grid") -> str:
    box = f"box AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), 1e-6) / {side - 1} AS sx, greatest(max(y) - min(y), 1e-6) / {side - 1} AS sy FROM o)"
    at = f"spots AS (SELECT (x - x0) / sx AS gx, (y - y0) / sy AS gy, z FROM o, box), inside AS (SELECT * FROM spots WHERE gx BETWEEN 0 AND {side - 1} AND gy BETWEEN 0 AND {side - 1})"
    if bilinear:
        splat = f"cell AS (SELECT *, least(floor(gx), {side - 2}) AS cx, least(floor(gy), {side - 2}) AS cy FROM inside), splat AS (SELECT (cx + dx)::BIGINT AS ix, (cy + dy)::BIGINT AS iy, z, (CASE WHEN dx = 1 THEN gx - cx ELSE 1 - (gx - cx) END) * (CASE WHEN dy = 1 THEN gy - cy ELSE 1 - (gy - cy) END) AS w FROM cell, range(0, 2) a(dx), range(0, 2) b(dy))"
    else:
        splat = "splat AS (SELECT round(gx)::BIGINT AS ix, round(gy)::BIGINT AS iy, z, 1.0 AS w FROM inside)"
    value = {"mean": "sum(z * w) / sum(w)", "min": "min(z)", "max": "max(z)"}[aggregate]
    return f"{O_SQL}, {box}, {at}, {splat}, {name} AS (SELECT ix, iy, {value} AS z, sum(w) AS weight FROM splat WHERE w > 0 GROUP BY ix, iy HAVING sum(w) > 1e-9)"


def _orders_grid(spark, d, side=SIDE, **options):
    return grid.height_grid(orders_cloud(spark, d), side, side, **options)


for _name, _options in {"mean": {}, "min": {"aggregate": "min"}, "max": {"aggregate": "max"}, "nearest": {"bilinear": False}}.items():

    @query(f"height_grid_{_name}", f"{_grid_sql(_options.get('aggregate', 'mean'), _options.get('bilinear', True))} SELECT ix, iy, {_rs('z', 'weight')} FROM grid")
    def _(spark, d, options=_options):
        return _orders_grid(spark, d, **options).cells.select("ix", "iy", *_r("z", "weight"))


#: A grid so fine that points leave holes in it.
FINE = 200


def _fill_sql(passes: int, least: int, side: int) -> str:
    """Filled cells ``grid(ix, iy, z, fill_pass)`` of ``grid0``, a table for each pass."""
    out = "steps AS (SELECT dx, dy, 1 / sqrt(dx * dx + dy * dy) AS w FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0), f0 AS MATERIALIZED (SELECT ix, iy, z, 0 AS fill_pass FROM grid0)"
    for k in range(passes):
        out += f", f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION ALL SELECT ix + dx, iy + dy, sum(z * w) / sum(w), {k + 1} FROM f{k}, steps WHERE ix + dx BETWEEN 0 AND {side - 1} AND iy + dy BETWEEN 0 AND {side - 1} AND (ix + dx, iy + dy) NOT IN (SELECT (ix, iy) FROM f{k}) GROUP BY 1, 2 HAVING count(*) >= {least})"
    return f"{out}, grid AS (SELECT * FROM f{passes})"


for _passes, _least in ((1, 1), (8, 3)):

    @query(f"fill_holes_{_passes}pass", f"{_grid_sql('mean', side=FINE, name='grid0')}, {_fill_sql(_passes, _least, FINE)} SELECT ix, iy, {_rs('z')}, fill_pass FROM grid")
    def _(spark, d, passes=_passes, least=_least):
        return grid.fill_holes(_orders_grid(spark, d, FINE), passes, least).cells.select("ix", "iy", *_r("z"), "fill_pass")


@query(
    "height_grid_explicit",
    f"{O_SQL}, b AS (SELECT 100.0 AS x0, 50.0 AS y0, 700.0 / {SIDE - 1} AS sx, 250.0 / {SIDE - 1} AS sy), s AS (SELECT (x - x0) / sx AS gx, (y - y0) / sy AS gy, z, pid % 256 AS r FROM o, b), i AS (SELECT *, least(floor(gx), {SIDE - 2}) AS cx, least(floor(gy), {SIDE - 2}) AS cy FROM s WHERE gx BETWEEN 0 AND {SIDE - 1} AND gy BETWEEN 0 AND {SIDE - 1}), w AS (SELECT (cx + dx)::BIGINT AS ix, (cy + dy)::BIGINT AS iy, z, r, (CASE WHEN dx = 1 THEN gx - cx ELSE 1 - (gx - cx) END) * (CASE WHEN dy = 1 THEN gy - cy ELSE 1 - (gy - cy) END) AS w FROM i, range(0, 2) p(dx), range(0, 2) q(dy)) SELECT ix, iy, round(sum(z * w) / sum(w), 6) + 0.0 AS z, round(sum(w), 6) AS weight, CAST(round(round(sum(r * w) / sum(w), 9)) AS INT) AS red FROM w WHERE w > 0 GROUP BY ix, iy HAVING sum(w) > 1e-9",
)
def _(spark, d):
    byte = (F.col("pid") % 256).cast("smallint")
    painted = orders_cloud(spark, d).withColumns({c: byte for c in COLOR})
    return grid.height_grid(painted, SIDE, SIDE, explicit=(100.0, 800.0, 50.0, 300.0)).cells.select("ix", "iy", *_r("z", "weight"), F.col("red").cast("int").alias("red"))


@query("height_grid_padded", f"{O_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM o), g AS (SELECT x0 - 0.25 * (x1 - x0) AS x0, y0 - 0.25 * (y1 - y0) AS y0, 1.5 * (x1 - x0) / {SIDE - 1} AS sx, 1.5 * (y1 - y0) / {SIDE - 1} AS sy FROM b) SELECT round((x - x0) / sx)::BIGINT AS ix, round((y - y0) / sy)::BIGINT AS iy, max(z) AS z, CAST(count(*) AS DOUBLE) AS weight FROM o, g GROUP BY 1, 2")
def _(spark, d):
    return _orders_grid(spark, d, padding=0.25, aggregate="max", bilinear=False).cells.select("ix", "iy", "z", "weight")


_POINTS = "verts AS (SELECT row_number() OVER (ORDER BY iy, ix) - 1 AS pid, ix, iy, x0 + ix * sx AS x, y0 + iy * sy AS y, z FROM grid, box)"


@query("grid_to_points", f"{_grid_sql('mean')}, {_POINTS} SELECT pid, ix, iy, {_rs(*XYZ)} FROM verts")
def _(spark, d):
    return grid.grid_to_points(_orders_grid(spark, d)).select("pid", "ix", "iy", *_r(*XYZ))


# A triangle is flat enough if its normal, of steps (sx, sy) and heights, leans no more than allowed.
_FACES = f"""{_POINTS}, rises AS (SELECT abs(a.z - b.z) AS s FROM verts a JOIN verts b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)),
    jump AS (SELECT greatest(greatest(1e-6, 1.5 * sqrt(sx * sx + sy * sy)), 4 * (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM rises) WHERE r = (SELECT count(*) // 2 FROM rises))) AS jump, sx, sy FROM box),
    quads AS (SELECT p.ix, p.iy, p.pid AS i00, q.pid AS i10, r.pid AS i01, s.pid AS i11, p.z AS z00, q.z AS z10, r.z AS z01, s.z AS z11 FROM verts p JOIN verts q ON q.ix = p.ix + 1 AND q.iy = p.iy JOIN verts r ON r.ix = p.ix AND r.iy = p.iy + 1 JOIN verts s ON s.ix = p.ix + 1 AND s.iy = p.iy + 1),
    tri AS (
        SELECT ix, iy, 0 AS n, i00 AS a, i10 AS b, i11 AS c, z00 AS za, z10 AS zb, z11 AS zc, z10 - z00 AS zx, z11 - z10 AS zy FROM quads WHERE abs(z00 - z11) <= abs(z10 - z01)
        UNION ALL SELECT ix, iy, 1, i00, i11, i01, z00, z11, z01, z11 - z01, z01 - z00 FROM quads WHERE abs(z00 - z11) <= abs(z10 - z01)
        UNION ALL SELECT ix, iy, 0, i00, i10, i01, z00, z10, z01, z10 - z00, z01 - z00 FROM quads WHERE abs(z00 - z11) > abs(z10 - z01)
        UNION ALL SELECT ix, iy, 1, i10, i11, i01, z10, z11, z01, z11 - z01, z11 - z10 FROM quads WHERE abs(z00 - z11) > abs(z10 - z01)),
    faces AS (SELECT row_number() OVER (ORDER BY iy, ix, n) - 1 AS fid, a, b, c FROM tri, jump WHERE greatest(abs(za - zb), abs(za - zc), abs(zb - zc)) <= jump AND 1 / sqrt((zx / sx) ** 2 + (zy / sy) ** 2 + 1) >= 0.08)"""
_MESH = f"{_grid_sql('mean')}, {_FACES}"
_CORNERS = """cross_ AS (SELECT f.fid, f.a, f.b, f.c, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz
    FROM faces f JOIN verts p ON p.pid = f.a JOIN verts q ON q.pid = f.b JOIN verts r ON r.pid = f.c),
    fn AS (SELECT *, uy * vz - uz * vy AS fx, uz * vx - ux * vz AS fy, ux * vy - uy * vx AS fz FROM cross_)"""
_NORMALS = f"{_MESH}, {_CORNERS}, sums AS (SELECT pid, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM (SELECT unnest([a, b, c]) AS pid, fx, fy, fz FROM fn) GROUP BY pid), lens AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM sums), normals AS (SELECT v.pid, v.x, v.y, v.z, coalesce(sx / l, 0) AS nx, coalesce(sy / l, 0) AS ny, coalesce(sz / l, 1) AS nz FROM verts v LEFT JOIN lens USING (pid))"
_EDGES = "sides AS (SELECT fid, least(u, v) AS u, greatest(u, v) AS v FROM (SELECT fid, unnest([a, b, c]) AS u, unnest([b, c, a]) AS v FROM faces))"


def _mesh(spark, d):
    return grid.grid_to_mesh(_orders_grid(spark, d))


@query("grid_to_mesh", f"{_MESH} SELECT fid, a, b, c FROM faces")
def _(spark, d):
    return _mesh(spark, d)[1]


@query("mesh_vertex_normals", f"{_NORMALS} SELECT pid, {_rs(*NORMAL)} FROM normals")
def _(spark, d):
    return mesh.vertex_normals(*_mesh(spark, d)).select("pid", *_r(*NORMAL))


@query("orient_outward", f"{_NORMALS}, mid AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM normals), vote AS (SELECT CASE WHEN sum(nx * (x - cx) + ny * (y - cy) + nz * (z - cz)) < 0 THEN -1.0 ELSE 1.0 END AS s FROM normals, mid) SELECT pid, round(s * nx, 6) + 0.0 AS nx, round(s * ny, 6) + 0.0 AS ny, round(s * nz, 6) + 0.0 AS nz FROM normals, vote")
def _(spark, d):
    v, f = _mesh(spark, d)
    return mesh.orient_outward(mesh.vertex_normals(v, f), f)[0].select("pid", *_r(*NORMAL))


@query("degenerate_faces", f"{_MESH}, {_CORNERS}, m AS (SELECT avg(0.5 * sqrt(fx * fx + fy * fy + fz * fz)) AS m FROM fn) SELECT fid, a, b, c FROM fn, m WHERE 0.5 * sqrt(fx * fx + fy * fy + fz * fz) > round(m)")
def _(spark, d):
    v, f = _mesh(spark, d)
    n = mesh.face_normals(v, f)
    area = 0.5 * F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2)
    return mesh.remove_degenerate_faces(v, f, float(round(n.agg(F.avg(area)).first()[0])))


@query("voxel_cluster_mesh", f"{_MESH}, low AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM verts), k AS (SELECT pid, x, y, z, floor((x - lx) / 150)::BIGINT AS kx, floor((y - ly) / 150)::BIGINT AS ky, floor((z - lz) / 150)::BIGINT AS kz FROM verts, low), g AS (SELECT row_number() OVER (ORDER BY kx, ky, kz) - 1 AS new, kx, ky, kz FROM (SELECT DISTINCT kx, ky, kz FROM k)), n AS (SELECT pid, new FROM k JOIN g USING (kx, ky, kz)) SELECT fid, p.new AS a, q.new AS b, r.new AS c FROM faces JOIN n p ON p.pid = a JOIN n q ON q.pid = b JOIN n r ON r.pid = c WHERE p.new <> q.new AND q.new <> r.new AND p.new <> r.new")
def _(spark, d):
    return mesh.cluster_vertices(*_mesh(spark, d), 150.0)[1].select("fid", "a", "b", "c")


@query("boundary_edges", f"{_MESH}, {_EDGES} SELECT u, v FROM sides GROUP BY u, v HAVING count(*) = 1")
def _(spark, d):
    return mesh.boundary_edges(_mesh(spark, d)[1])


@query("taubin_1", f"{_MESH}, near AS (SELECT DISTINCT unnest([a, b, b, c, c, a]) AS p, unnest([b, a, c, b, a, c]) AS q FROM faces), m1 AS (SELECT p, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM near JOIN verts ON pid = q GROUP BY p), s1 AS (SELECT v.pid, v.x + coalesce(0.5 * (m.x - v.x), 0) AS x, v.y + coalesce(0.5 * (m.y - v.y), 0) AS y, v.z + coalesce(0.5 * (m.z - v.z), 0) AS z FROM verts v LEFT JOIN m1 m ON m.p = v.pid), m2 AS (SELECT p, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM near JOIN s1 ON pid = q GROUP BY p) SELECT v.pid, round(v.x + coalesce(-0.53 * (m.x - v.x), 0), 6) + 0.0 AS x, round(v.y + coalesce(-0.53 * (m.y - v.y), 0), 6) + 0.0 AS y, round(v.z + coalesce(-0.53 * (m.z - v.z), 0), 6) + 0.0 AS z FROM s1 v LEFT JOIN m2 m ON m.p = v.pid")
def _(spark, d):
    return mesh.taubin_smooth(*_mesh(spark, d), 1).select("pid", *_r(*XYZ))


# Labels travel over shared edges; more rounds than the mesh is wide.
_COMPONENTS = f"{_EDGES}, links AS (SELECT DISTINCT s.fid AS f, t.fid AS g FROM sides s JOIN sides t USING (u, v)), lab AS (SELECT 0 AS k, fid, fid AS c FROM faces UNION ALL SELECT k + 1, g, min(c) FROM lab JOIN links ON f = fid WHERE k < 400 GROUP BY k + 1, g), comp AS (SELECT fid, c AS component FROM lab WHERE k = 400)"


@query("mesh_components", f"{_MESH}, {_COMPONENTS} SELECT fid, component FROM comp")
def _(spark, d):
    return mesh.face_components(_mesh(spark, d)[1])


@query(
    "mesh_compact",
    f"""{_MESH}, {_COMPONENTS}, large AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= 3), kept AS (SELECT row_number() OVER (ORDER BY component, fid) - 1 AS fid, a, b, c FROM faces JOIN comp USING (fid) SEMI JOIN large USING (component)),
    used AS (SELECT pid, min(pos) AS pos FROM (SELECT unnest([a, b, c]) AS pid, unnest([3 * fid, 3 * fid + 1, 3 * fid + 2]) AS pos FROM kept) GROUP BY pid), named AS (SELECT pid, row_number() OVER (ORDER BY pos) - 1 AS new FROM used)
    SELECT fid, p.new AS a, q.new AS b, r.new AS c, round(v.x, 6) + 0.0 AS x, round(v.y, 6) + 0.0 AS y, round(v.z, 6) + 0.0 AS z FROM kept JOIN named p ON p.pid = a JOIN named q ON q.pid = b JOIN named r ON r.pid = c JOIN verts v ON v.pid = a""",
)
def _(spark, d):
    v, f = mesh.remove_small_components(*_mesh(spark, d), 3)
    return mesh.with_corners(v, f).select("fid", "a", "b", "c", *[rounded(f"pa.{n}").alias(n) for n in XYZ])


_KEPT = f"{_MESH}, {_EDGES}, edge AS (SELECT DISTINCT unnest([u, v]) AS p FROM (SELECT u, v FROM sides GROUP BY u, v HAVING count(*) = 1)), near AS (SELECT DISTINCT unnest([a, b, b, c, c, a]) AS p, unnest([b, a, c, b, a, c]) AS q FROM faces)"
_STEP_SQL = lambda c, w: f"v.{c} + coalesce({w} * (m.{c} - v.{c}), 0)"
_AVERAGES = ", ".join(f"avg({c}) AS {c}" for c in XYZ)


@query(
    "taubin_fixed_boundary",
    f"{_KEPT}, m1 AS (SELECT p, {_AVERAGES} FROM near JOIN verts ON pid = q ANTI JOIN edge USING (p) GROUP BY p), s1 AS (SELECT v.pid, {', '.join(f'{_STEP_SQL(c, 0.5)} AS {c}' for c in XYZ)} FROM verts v LEFT JOIN m1 m ON m.p = v.pid), m2 AS (SELECT p, {_AVERAGES} FROM near JOIN s1 ON pid = q ANTI JOIN edge USING (p) GROUP BY p) SELECT v.pid, {', '.join(f'round({_STEP_SQL(c, -0.53)}, 6) + 0.0 AS {c}' for c in XYZ)} FROM s1 v LEFT JOIN m2 m ON m.p = v.pid",
)
def _(spark, d):
    return mesh.taubin_smooth(*_mesh(spark, d), 1, fix_boundary=True).select("pid", *_r(*XYZ))


_STEPS = 32


def _smooth_sql(n: int) -> str:
    """Vertices ``s{n}`` after n steps, a table for each."""
    out = f"s0 AS MATERIALIZED (SELECT pid, {', '.join(XYZ)} FROM verts)"
    for k in range(n):
        moved = ", ".join(f"{_STEP_SQL(c, (0.5, -0.53)[k % 2])} AS {c}" for c in XYZ)
        out += f", s{k + 1} AS MATERIALIZED (SELECT v.pid, {moved} FROM s{k} v LEFT JOIN (SELECT p, {_AVERAGES} FROM near JOIN s{k} ON pid = q ANTI JOIN edge USING (p) GROUP BY p) m ON m.p = v.pid)"
    return out


@query("taubin_rings", f"{_KEPT}, {_smooth_sql(_STEPS)} SELECT pid, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in XYZ)} FROM s{_STEPS}")
def _(spark, d):
    return mesh.taubin_smooth(*_mesh(spark, d), _STEPS // 2, fix_boundary=True).select("pid", *_r(*XYZ))


@query("cluster_vertices", f"{_MESH}, low AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM verts), k AS (SELECT x, y, z, pid, floor((x - lx) / 150)::BIGINT AS kx, floor((y - ly) / 150)::BIGINT AS ky, floor((z - lz) / 150)::BIGINT AS kz FROM verts, low) SELECT row_number() OVER (ORDER BY kx, ky, kz) - 1 AS pid, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in XYZ)}, CAST(round(avg(pid % 256)) AS INT) AS red FROM k GROUP BY kx, ky, kz")
def _(spark, d):
    v, f = _mesh(spark, d)
    painted = v.drop("ix", "iy").withColumns({c: (F.col("pid") % 256).cast("smallint") for c in COLOR})
    return mesh.cluster_vertices(painted, f, 150.0)[0].select("pid", *_r(*XYZ), F.col("red").cast("int").alias("red"))


@query("cloud_to_mesh", f"{_grid_sql('mean', name='grid0')}, {_fill_sql(8, 1, SIDE)}, {_FACES} SELECT fid, a, b, c FROM faces")
def _(spark, d):
    return grid.cloud_to_mesh(orders_cloud(spark, d), SIDE, SIDE)[1]


# Attributes that a grid lacks come from the nearest point of its source, the lowest id first.
@query("mesh_nearest_source", f"{_MESH}, near AS (SELECT v.pid, o.pid AS s, row_number() OVER (PARTITION BY v.pid ORDER BY sqrt((o.x - v.x) ** 2 + (o.y - v.y) ** 2 + (o.z - v.z) ** 2), o.pid) AS r FROM verts v, o) SELECT pid, CAST(s % 65536 AS INT) AS intensity, CAST(s % 200 AS INT) AS green FROM near WHERE r = 1")
def _(spark, d):
    source = orders_cloud(spark, d)
    source = source.withColumns({"intensity": (F.col("pid") % 65536).cast("int"), **{c: (F.col("pid") % 200).cast("smallint") for c in COLOR}})
    return grid.grid_to_mesh(_orders_grid(spark, d), source)[0].select("pid", "intensity", F.col("green").cast("int").alias("green"))


_QUALITY = f"{_MESH}, {_CORNERS}, v AS (SELECT count(*) AS vertex_count, max(abs(sqrt(x * x + y * y + z * z) - 9000)) AS far, avg(abs(sqrt(x * x + y * y + z * z) - 9000)) AS mean FROM verts), f AS (SELECT count(*) AS face_count, count(*) FILTER (sqrt(fx * fx + fy * fy + fz * fz) <= 1e-10) AS degenerate_faces, avg(CASE WHEN fx * (3 * ax + ux + vx) + fy * (3 * ay + uy + vy) + fz * (3 * az + uz + vz) > 0 THEN 1.0 ELSE 0 END) AS outward FROM fn), w AS (SELECT max(greatest(abs(x), abs(y), abs(z))) AS widest FROM verts)"
_FIGURES = "vertex_count, face_count, 0 AS invalid_faces, degenerate_faces, round(degenerate_faces / face_count, 6) AS degenerate_ratio, round(far, 6) AS max_radius_error, round(mean, 6) AS mean_radius_error, round(widest, 6) AS max_abs_coordinate, round(outward, 6) AS outward_ratio, round(greatest(outward, 1 - outward), 6) AS dominant_ratio"
_COUNTS, _SHARES = ("vertex_count", "face_count", "invalid_faces", "degenerate_faces"), ("degenerate_ratio", "max_radius_error", "mean_radius_error", "max_abs_coordinate", "outward_ratio", "dominant_ratio")


@query("mesh_quality", f"{_QUALITY} SELECT {_FIGURES} FROM v, f, w")
def _(spark, d):
    return mesh.quality(*_mesh(spark, d), 9000.0).select(*_COUNTS, *[F.round(c, 6).alias(c) for c in _SHARES])


@query("mesh_report", f"{_QUALITY} SELECT {_FIGURES} FROM v, f, w")
def _(spark, d):
    out = report.mesh_report(mesh.quality(*_mesh(spark, d), 9000.0))
    figure = lambda c: F.get_json_object("json", f"$.{c}")
    return out.select(*[figure(c).cast("long").alias(c) for c in _COUNTS], *[F.round(figure(c).cast("double"), 6).alias(c) for c in _SHARES])


@query("validate_faces", f"{O_SQL}, n AS (SELECT max(pid) AS n FROM o) SELECT pid AS fid, 1 AS corner, pid + 1 AS pid FROM o, n WHERE pid + 1 > n UNION ALL SELECT pid, 2, pid + 2 FROM o, n WHERE pid + 2 > n")
def _(spark, d):
    cloud = orders_cloud(spark, d)
    faces = cloud.select(F.col("pid").alias("fid"), F.col("pid").alias("a"), (F.col("pid") + 1).alias("b"), (F.col("pid") + 2).alias("c"))
    return points.validate_faces(cloud, faces)


@query("with_attributes", f"{O_SQL} SELECT pid, x, y, z, z / 7 AS heat FROM o")
def _(spark, d):
    cloud = orders_cloud(spark, d)
    return points.with_attributes(cloud, cloud.select("pid", (F.col("z") / 7).alias("heat"))).select("pid", *XYZ, "heat")


@query("mask_ids", f"{O_SQL} SELECT pid, y > 150 AS kept FROM o")
def _(spark, d):
    masked = orders_cloud(spark, d).withColumn("keep", F.col("y") > 150)
    return points.kept_ids(masked).withColumn("kept", F.lit(True)).unionByName(points.removed_ids(masked).withColumn("kept", F.lit(False)))


@query("point_row", f"{O_SQL} SELECT pid, x, y, z FROM o WHERE pid = 7")
def _(spark, d):
    return points.row(orders_cloud(spark, d), 7)


# Iso-surfaces

_TABLE = ", ".join(f"({k}, {t}, {e[0]}, {e[1]}, {e[2]})" for k, found in enumerate(iso.triangles()) for t, e in enumerate(found))
_CUBE = ", ".join(f"({k}, {c[0]}, {c[1]}, {c[2]})" for k, c in enumerate(iso.CORNERS))
_EDGE = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(iso.EDGES))


# The surface where the weight of splatted points exceeds a level. Its vertices are the places at which the
# field crosses the level on edges of the grid, which SQL finds from pairs of samples, without triangles.
_FIELD_LOW, _FIELD_STEP, _FIELD_SIZE, _LEVEL = -1.1, 0.05, 44, 0.8
_CROSSINGS = f"""{E_SQL}, g AS (SELECT (x - {_FIELD_LOW}) / {_FIELD_STEP} AS gx, (y - {_FIELD_LOW}) / {_FIELD_STEP} AS gy, (z - {_FIELD_LOW}) / {_FIELD_STEP} AS gz FROM e), bits(b) AS (VALUES (0), (1)),
    s AS (SELECT floor(gx)::BIGINT + a.b AS ix, floor(gy)::BIGINT + b.b AS iy, floor(gz)::BIGINT + c.b AS iz, sum((CASE a.b WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END)
          * (CASE b.b WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE c.b WHEN 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END)) AS w FROM g, bits a, bits b, bits c GROUP BY ALL),
    steps(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
    p AS (SELECT s.ix, s.iy, s.iz, dx, dy, dz, ({_LEVEL} - s.w) / (coalesce(n.w, 0) - s.w) AS t FROM s JOIN steps ON s.w > {_LEVEL} LEFT JOIN s n ON (n.ix, n.iy, n.iz) = (s.ix + dx, s.iy + dy, s.iz + dz) WHERE coalesce(n.w, 0) <= {_LEVEL}),
    v AS (SELECT {_FIELD_LOW} + (ix + t * dx) * {_FIELD_STEP} AS x, {_FIELD_LOW} + (iy + t * dy) * {_FIELD_STEP} AS y, {_FIELD_LOW} + (iz + t * dz) * {_FIELD_STEP} AS z FROM p)"""


def _surface(spark, d):
    return iso.density_surface(embeddings_cloud(spark, d), (_FIELD_LOW,) * 3, (_FIELD_STEP,) * 3, (_FIELD_SIZE,) * 3, _LEVEL)


@query("marching_cubes_points", f"{_CROSSINGS} SELECT DISTINCT {_rs(*XYZ)} FROM v")
def _(spark, d):
    return _surface(spark, d)[0].select(*_r(*XYZ)).distinct()


# The surface is closed if every edge has an even number of triangles, and looks outwards if it encloses a positive volume.
@query("marching_cubes_closed", f"{_CROSSINGS} SELECT count(*) AS vertices, 0 AS open_edges, true AS outward FROM (SELECT DISTINCT {_rs(*XYZ)} FROM v)")
def _(spark, d):
    v, f = _surface(spark, d)
    met = mesh.with_corners(v, f)
    name = {k: F.concat_ws(",", *[rounded(F.col(f"{k}.{n}")).cast("string") for n in XYZ]) for k in ("pa", "pb", "pc")}
    sides = F.explode(F.array(*[F.struct(F.least(name[a], name[b]).alias("u"), F.greatest(name[a], name[b]).alias("v")) for a, b in (("pa", "pb"), ("pb", "pc"), ("pc", "pa"))]))
    used = met.select(sides.alias("s")).where("s.u <> s.v").groupBy("s.u", "s.v").agg(F.count(F.lit(1)).alias("n"))
    odd = used.agg(F.coalesce(F.sum((F.col("n") % 2).cast("long")), F.lit(0)).alias("open_edges"))
    a, b, c = (tuple(F.col(f"{k}.{n}") for n in XYZ) for k in ("pa", "pb", "pc"))
    outward = met.agg((F.sum(dot(a, cross(b, c))) > 0).alias("outward"))
    return v.select(*_r(*XYZ)).distinct().agg(F.count(F.lit(1)).alias("vertices")).join(F.broadcast(odd)).join(F.broadcast(outward))


_DEPTH = 4
_BOX = f"b0 AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM e), b1 AS (SELECT *, 0.2 * greatest(x1 - x0, y1 - y0, z1 - z0, 1e-6) AS pad FROM b0), b2 AS (SELECT (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (z0 + z1) / 2 AS cz, greatest(x1 - x0, y1 - y0, z1 - z0) + 2 * pad AS side FROM b1), box AS (SELECT cx - side / 2 AS lx, cy - side / 2 AS ly, cz - side / 2 AS lz, side / {2**_DEPTH} AS h FROM b2)"
_CELLS = f"{E_SQL}, {_BOX}, spots AS (SELECT *, floor((x - lx) / h)::BIGINT AS ix, floor((y - ly) / h)::BIGINT AS iy, floor((z - lz) / h)::BIGINT AS iz FROM e, box), sp AS (SELECT *, greatest((1 - abs(x - (lx + (ix + 0.5) * h)) / (h / 2)) * (1 - abs(y - (ly + (iy + 0.5) * h)) / (h / 2)) * (1 - abs(z - (lz + (iz + 0.5) * h)) / (h / 2)), 0) AS w FROM spots), cells AS (SELECT ix, iy, iz, sum(w) AS weight, sum(w * nx) / greatest(sum(w), 1e-10) AS vx, sum(w * ny) / greatest(sum(w), 1e-10) AS vy, sum(w * nz) / greatest(sum(w), 1e-10) AS vz FROM sp GROUP BY ix, iy, iz)"


def _cells(spark, d):
    e = embeddings_cloud(spark, d)
    low, side = iso.poisson_box(e)
    return iso.poisson_cells(e, _DEPTH, low, side), side / 2**_DEPTH


@query("poisson_cells", f"{_CELLS} SELECT ix, iy, iz, {_rs('weight', 'vx', 'vy', 'vz')} FROM cells")
def _(spark, d):
    return _cells(spark, d)[0].select("ix", "iy", "iz", *_r("weight", "vx", "vy", "vz"))


def _difference(n: str) -> str:
    return f"(coalesce(p{n}.v{n}, c.v{n}) - coalesce(m{n}.v{n}, c.v{n})) / (2 * h)"


def _side(n: str, name: str, step: int) -> str:
    return f"LEFT JOIN cells {name}{n} ON " + " AND ".join(f"{name}{n}.i{a} = c.i{a}" + (f" + {step}" if a == n else "") for a in XYZ)


@query("poisson_divergence", f"{_CELLS} SELECT c.ix, c.iy, c.iz, round({' + '.join(map(_difference, XYZ))}, 4) + 0.0 AS divergence FROM cells c {' '.join(_side(n, s, k) for n in XYZ for s, k in (('p', 1), ('m', -1)))} JOIN box ON true")
def _(spark, d):
    cells, h = _cells(spark, d)
    return iso.poisson_divergence(cells, h).select("ix", "iy", "iz", *_r("divergence", digits=4))


def _solution(iterations: int, in_order: int | None = None) -> str:
    """``field(ix, iy, iz, value)``: red-black half sweeps, a table for each; or, in a grid of so many cells a side, planes of equal index sums that follow each other."""
    last = 2 * iterations if in_order is None else 3 * (in_order - 1) + 2 * iterations - 1
    due = "true" if in_order is None else f"{{k}} BETWEEN s.ix + s.iy + s.iz AND s.ix + s.iy + s.iz + {2 * iterations - 1}"
    out = f"div AS (SELECT c.ix, c.iy, c.iz, h, {' + '.join(map(_difference, XYZ))} AS divergence FROM cells c {' '.join(_side(n, s, k) for n in XYZ for s, k in (('p', 1), ('m', -1)))} JOIN box ON true)"
    out += ", s0 AS MATERIALIZED (SELECT ix, iy, iz, divergence * h * h AS load, CAST(0 AS DOUBLE) AS value FROM div)"
    around = " OR ".join(f"({' AND '.join(f'q.i{b} = p.i{b}' + (f' + {k}' if a == b else '') for b in XYZ)})" for a in XYZ for k in (-1, 1))
    for k in range(last):
        near = f"SELECT p.ix, p.iy, p.iz, sum(q.value) AS near, count(*) AS n FROM s{k} p JOIN s{k} q ON {around} GROUP BY ALL" if k == 0 else f"SELECT p.ix, p.iy, p.iz, sum(q.value) AS near, count(*) AS n FROM links p JOIN s{k} q ON (q.ix, q.iy, q.iz) = (p.jx, p.jy, p.jz) GROUP BY ALL"
        if k == 0:
            out += f", links AS MATERIALIZED (SELECT p.ix, p.iy, p.iz, q.ix AS jx, q.iy AS jy, q.iz AS jz FROM s0 p JOIN s0 q ON {around})"
        out += f", s{k + 1} AS MATERIALIZED (SELECT s.ix, s.iy, s.iz, s.load, CASE WHEN (s.ix + s.iy + s.iz) % 2 = {k % 2} AND {due.format(k=k)} AND n IS NOT NULL THEN (near - load) / n ELSE value END AS value FROM s{k} s LEFT JOIN ({near}) USING (ix, iy, iz))"
    return f"{out}, field AS (SELECT ix, iy, iz, value FROM s{last})"


_SWEEPS = 30


@query("poisson_solution", f"{_CELLS}, {_solution(_SWEEPS)} SELECT ix, iy, iz, round(value, 6) + 0.0 AS value FROM field")
def _(spark, d):
    cells, h = _cells(spark, d)
    return iso.poisson_solve(iso.poisson_divergence(cells, h), h, _DEPTH, _SWEEPS).select("ix", "iy", "iz", *_r("value"))


_ORDERED = 4


@query("poisson_in_order", f"{_CELLS}, {_solution(_ORDERED, 2**_DEPTH)} SELECT ix, iy, iz, round(value, 6) + 0.0 AS value FROM field")
def _(spark, d):
    cells, h = _cells(spark, d)
    return iso.poisson_solve(iso.poisson_divergence(cells, h), h, _DEPTH, _ORDERED, in_order=True).select("ix", "iy", "iz", *_r("value"))


#: The same cells at the operator's own depth.
_SURFACE_DEPTH = 6
_SURFACE_CELLS = _CELLS.replace(f"side / {2**_DEPTH} AS h", f"side / {2**_SURFACE_DEPTH} AS h")


# The surface of such a field: the sums of each triangle's corners, which no orientation changes.
@query(
    "poisson_surface",
    f"""{_SURFACE_CELLS}, {_solution(_SWEEPS)}, tt(kind, t, e0, e1, e2) AS (VALUES {_TABLE}), cc(k, dx, dy, dz) AS (VALUES {_CUBE}), ee(e, a, b) AS (VALUES {_EDGE}),
    cubes AS (SELECT DISTINCT ix - dx AS ix, iy - dy AS iy, iz - dz AS iz FROM field, cc WHERE least(ix - dx, iy - dy, iz - dz) >= 0 AND greatest(ix - dx, iy - dy, iz - dz) <= {2**_SURFACE_DEPTH - 1}),
    f AS (SELECT q.ix, q.iy, q.iz, k, lx + (q.ix + dx) * h AS x, ly + (q.iy + dy) * h AS y, lz + (q.iz + dz) * h AS z, coalesce(value, 0) AS v FROM cubes q JOIN cc ON true JOIN box ON true LEFT JOIN field s ON (s.ix, s.iy, s.iz) = (q.ix + dx, q.iy + dy, q.iz + dz)),
    kinds AS (SELECT ix, iy, iz, sum(CASE WHEN v < 0 THEN 1 << k ELSE 0 END) AS kind FROM f GROUP BY ix, iy, iz),
    ends AS (SELECT n.ix, n.iy, n.iz, t, unnest([e0, e1, e2]) AS e FROM kinds n JOIN tt USING (kind)),
    p AS (SELECT d.ix, d.iy, d.iz, d.t, u.x + (0 - u.v) / (w.v - u.v) * (w.x - u.x) AS x, u.y + (0 - u.v) / (w.v - u.v) * (w.y - u.y) AS y, u.z + (0 - u.v) / (w.v - u.v) * (w.z - u.z) AS z
          FROM ends d JOIN ee USING (e) JOIN f u ON (u.ix, u.iy, u.iz, u.k) = (d.ix, d.iy, d.iz, a) JOIN f w ON (w.ix, w.iy, w.iz, w.k) = (d.ix, d.iy, d.iz, b))
    SELECT fid, round(sum(x), 6) + 0.0 AS x, round(sum(y), 6) + 0.0 AS y, round(sum(z), 6) + 0.0 AS z FROM (SELECT dense_rank() OVER (ORDER BY iz, iy, ix, t) - 1 AS fid, x, y, z FROM p) GROUP BY fid""",
)
def _(spark, d):
    v, f = iso.poisson(embeddings_cloud(spark, d))
    met = mesh.with_corners(v, f)
    return met.select("fid", *[rounded(F.col(f"pa.{n}") + F.col(f"pb.{n}") + F.col(f"pc.{n}")).alias(n) for n in XYZ])


# Reports

_BENCH = "before AS (SELECT event_type AS benchmark, avg(value) AS best_ms FROM events GROUP BY 1), after AS (SELECT event_type || CASE WHEN event_type = 'error' THEN '2' ELSE '' END AS benchmark, avg(value + user_id * (length(event_type) - 5) * 0.01) AS best_ms FROM events GROUP BY 1)"


def _bench(spark, d):
    e = table(spark, d, "events")
    name = F.concat("event_type", F.when(F.col("event_type") == "error", "2").otherwise(""))
    before = e.groupBy(F.col("event_type").alias("benchmark")).agg(F.avg("value").alias("best_ms"))
    return before, e.groupBy(name.alias("benchmark")).agg(F.avg(F.col("value") + F.col("user_id") * (F.length("event_type") - 5) * 0.01).alias("best_ms"))


@query("benchmark_gate", f"{_BENCH}, j AS (SELECT benchmark, b.best_ms AS before_ms, a.best_ms AS after_ms, a.best_ms / b.best_ms AS ratio FROM before b FULL JOIN after a USING (benchmark)) SELECT benchmark, round(before_ms, 6) AS before_ms, round(after_ms, 6) AS after_ms, round(ratio, 6) AS ratio, CASE WHEN before_ms IS NULL THEN 'added' WHEN after_ms IS NULL THEN 'missing' WHEN ratio >= 1.05 THEN 'regressed' WHEN ratio <= 0.95 THEN 'improved' ELSE 'unchanged' END AS status FROM j")
def _(spark, d):
    return report.benchmark_gate(*_bench(spark, d), tolerance=0.05).select("benchmark", *[F.round(c, 6).alias(c) for c in ("before_ms", "after_ms", "ratio")], "status")


_HALVES = "r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'gpu_' WHEN event_type = 'error' THEN 'other_' ELSE 'cpu_' END || event_type AS benchmark, avg(value) AS best_ms FROM events GROUP BY 1)"


@query("hotspots", f"{_HALVES} SELECT g.benchmark, round(g.best_ms, 6) AS best_ms, round(c.best_ms, 6) AS cpu_ms, round(g.best_ms / c.best_ms, 6) AS ratio FROM r g LEFT JOIN r c ON c.benchmark = 'cpu_' || substr(g.benchmark, 5) WHERE g.benchmark LIKE 'gpu\\_%' ESCAPE '\\' ORDER BY g.best_ms DESC, g.benchmark LIMIT 3")
def _(spark, d):
    half = F.when(F.col("user_id") % 2 == 0, "gpu_").when(F.col("event_type") == "error", "other_").otherwise("cpu_")
    rows = table(spark, d, "events").groupBy(F.concat(half, "event_type").alias("benchmark")).agg(F.avg("value").alias("best_ms"))
    return report.hotspots(rows, 3).select("benchmark", *[F.round(c, 6).alias(c) for c in ("best_ms", "cpu_ms", "ratio")])


_MEASURED = "measured AS (SELECT event_type AS path, 'mean' AS metric, avg(value) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'most', max(value) FROM events GROUP BY 1)"


def _measured(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("path"))
    return e.agg(F.avg("value").alias("value")).withColumn("metric", F.lit("mean")).unionByName(e.agg(F.max("value").alias("value")).withColumn("metric", F.lit("most")))


@query("threshold_gate", f"{_MEASURED}, m AS (SELECT avg(value) AS v, metric FROM measured GROUP BY metric) SELECT path, metric, round(value, 6) AS value, 0.0::DOUBLE AS low, round(v, 6) AS high FROM measured JOIN m USING (metric) WHERE value < 0 OR value > v")
def _(spark, d):
    measured = _measured(spark, d)
    limits = measured.groupBy("metric").agg(F.lit(0.0).alias("low"), F.avg("value").alias("high"))
    return report.threshold_gate(measured, limits).select("path", "metric", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


@query("compare_statistics", f"{_MEASURED}, again AS (SELECT CASE WHEN path = 'error' THEN 'new' ELSE path END AS path, metric, value + CASE WHEN metric = 'most' THEN length(path) ELSE 0 END AS value FROM measured) SELECT path, metric, round(a.value, 6) AS expected, round(b.value, 6) AS actual FROM measured a FULL JOIN again b USING (path, metric) WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 5.5")
def _(spark, d):
    measured = _measured(spark, d)
    again = measured.select(F.when(F.col("path") == "error", "new").otherwise(F.col("path")).alias("path"), "metric", (F.col("value") + F.when(F.col("metric") == "most", F.length("path")).otherwise(0)).alias("value"))
    return report.compare_statistics(measured, again, 5.5).select("path", "metric", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"))


from . import catalog_files  # noqa: E402, F401  registers the queries of readers and writers
