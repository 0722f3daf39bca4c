"""DuckDB SQL of the queries on neighbouring windows: each returns the text of a whole WITH statement or a part of one."""

from __future__ import annotations

from . import fixtures as fx

ZNORMED = "greatest(0, 2 * {m} * (1 - (array_inner_product(a.x, b.x) - {m} * a.mu * b.mu) / ({m} * a.sd * b.sd)))"


def windows(m: int, every: int = 1) -> str:
    """s: the windows (series_id, i, x, mu, sd) of m points of the event series, of which each `every`-th point counts."""
    return f"""WITH RECURSIVE {fx.EVENTS}, g AS (SELECT series_id, list(v ORDER BY t) AS vals FROM fx WHERE t % {every} = 0 GROUP BY 1),
r AS (SELECT series_id, vals, unnest(range(len(vals) - {m - 1})) AS i FROM g WHERE len(vals) >= {m}), w AS (SELECT series_id, i, vals[i + 1 : i + {m}] AS l FROM r),
s AS MATERIALIZED (SELECT series_id, i, CAST(l AS DOUBLE[{m}]) AS x, list_avg(l) AS mu, CASE WHEN list_stddev_pop(l) < 1e-4 THEN 0.1 ELSE list_stddev_pop(l) END AS sd FROM w)"""


def neighbours(m: int, k: int, every: int = 1) -> str:
    """nb: (series_id, start, rank, nbr, dist), the k nearest starts taken one after another, each outside the zones of those before."""
    h, dist = m // 2, ZNORMED.format(m=m)
    parts = [windows(m, every), f"e AS MATERIALIZED (SELECT a.series_id, a.i AS i, b.i AS j, {dist} AS d FROM s a JOIN s b ON a.series_id = b.series_id AND (b.i < a.i - {h} OR b.i >= a.i + {h}))"]
    for n in range(1, k):
        before = "".join(f" JOIN r{q} ON r{q}.series_id = e.series_id AND r{q}.i = e.i AND (e.j < r{q}.p.j - {h} OR e.j >= r{q}.p.j + {h})" for q in range(1, n))
        parts.append(f"r{n} AS MATERIALIZED (SELECT e.series_id, e.i, min({{'d': e.d, 'j': e.j}}) AS p FROM e{before} GROUP BY ALL)")
    ranks = "".join(f" UNION ALL SELECT series_id, i, {n}, p.j, p.d FROM r{n}" for n in range(1, k))
    parts.append(f"nb AS MATERIALIZED (SELECT series_id, i AS start, 0 AS rank, i AS nbr, 0.0::DOUBLE AS dist FROM s{ranks})")
    return ",\n".join(parts)


def closest_sets(m: int, k_max: int, every: int = 1) -> str:
    """ms: for each size k from 2 to k_max - 1 the start whose first k neighbours lie closest together."""
    dist = ZNORMED.format(m=m)
    return neighbours(m, k_max - 1, every) + f""",
q AS (SELECT n1.series_id, n1.start, n2.rank AS top, {dist} AS d FROM nb n1 JOIN nb n2 ON n1.series_id = n2.series_id AND n1.start = n2.start AND n1.rank < n2.rank
  JOIN s a ON a.series_id = n1.series_id AND a.i = n1.nbr JOIN s b ON b.series_id = n2.series_id AND b.i = n2.nbr),
x AS (SELECT series_id, start, top, max(max(d)) OVER (PARTITION BY series_id, start ORDER BY top) AS extent FROM q GROUP BY series_id, start, top),
ms AS (SELECT x.series_id, x.top + 1 AS k, x.extent, nb.dist AS kth_dist, x.start FROM x JOIN nb ON nb.series_id = x.series_id AND nb.start = x.start AND nb.rank = x.top
  QUALIFY row_number() OVER (PARTITION BY x.series_id, x.top ORDER BY round(x.extent, 8), round(nb.dist, 8), x.start) = 1)"""


def best_length(lengths: list[int], k_max: int, every: int) -> str:
    """The length, of points of the whole series, whose scaled extent function has the least mean, the shortest on ties."""
    one = [f"SELECT series_id, {m * every} AS m, k, extent FROM ({closest_sets(m, k_max, every)} SELECT series_id, k, extent FROM ms)" for m in lengths]
    return f"""WITH u AS ({' UNION ALL '.join(one)}), l AS (SELECT series_id, m, list(extent ORDER BY k) AS f FROM u GROUP BY ALL),
f AS (SELECT series_id, m, list_concat([f[1], f[1]], f) AS f FROM l),
a AS (SELECT series_id, m, CASE WHEN list_max(f) = list_min(f) THEN 1 ELSE list_avg([(x - list_min(f)) / (list_max(f) - list_min(f)) FOR x IN f]) END AS au FROM f)
SELECT series_id, 0 AS attr_id, CAST(m AS INTEGER) AS m FROM a QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY au, m) = 1"""


def similarity(radius: int, least: float) -> str:
    """Pairs of centred windows scaled to their own range, over the shorter length."""
    return f"""WITH {fx.EVENTS}, g AS (SELECT series_id, list(v ORDER BY t) AS vals FROM fx GROUP BY 1),
r AS (SELECT series_id, vals, unnest(range(len(vals))) AS i FROM g), w AS (SELECT series_id, i, vals[greatest(1, i + 1 - {radius}) : i + 1 + {radius}] AS l FROM r),
s AS MATERIALIZED (SELECT series_id, i, len(l) AS n, [CASE WHEN list_max(l) = list_min(l) THEN 0 ELSE (v - l[1]) / (list_max(l) - list_min(l)) END FOR v IN l] AS l FROM w),
f AS (SELECT series_id, i, CAST(l AS DOUBLE[{2 * radius + 1}]) AS x FROM s WHERE n = {2 * radius + 1}),
p AS (SELECT a.series_id, a.i AS i, b.i AS j, array_distance(a.x, b.x) AS d FROM f a JOIN f b ON a.series_id = b.series_id AND a.i < b.i
  UNION ALL SELECT a.series_id, a.i, b.i, list_distance(a.l[1 : least(a.n, b.n)], b.l[1 : least(a.n, b.n)]) FROM s a JOIN s b ON a.series_id = b.series_id AND a.i < b.i WHERE a.n < {2 * radius + 1} OR b.n < {2 * radius + 1})
SELECT series_id, i, j, round(1 / (1 + d), 5) AS similarity FROM p WHERE 1 / (1 + d) >= {least}"""


#: The peaks of each row's extents from the fourth on; the highest is taken with its neighbours until none is over 2.
ELBOWS = f"""WITH RECURSIVE {fx.EVENTS}, d AS (SELECT series_id, CAST(t % 7 AS INTEGER) AS m, list_sort(list(DISTINCT abs(v))) AS d FROM fx GROUP BY ALL),
p AS (SELECT series_id, m, [CASE WHEN d[k + 1] > 0 AND d[k + 2] / d[k + 1] > 1 THEN (d[k + 2] - d[k + 1] + 1e-5) / (d[k + 1] - d[k] + 1e-5) ELSE 0 END FOR k IN range(3, len(d) - 1)] AS p FROM d),
z AS (SELECT series_id, m, p, list_position(p, list_max(p)) AS top, CAST([] AS BIGINT[]) AS found FROM p
UNION ALL SELECT series_id, m, q, list_position(q, list_max(q)), f FROM (SELECT series_id, m, [CASE WHEN abs(y - top) <= 1 THEN 0 ELSE p[y] END FOR y IN range(1, len(p) + 1)] AS q, list_append(found, top + 2) AS f FROM z WHERE p[top] > 2))
SELECT series_id, m, CASE WHEN len(found) = 0 THEN '2' ELSE array_to_string(list_sort(found), ',') END AS elbows FROM z QUALIFY row_number() OVER (PARTITION BY series_id, m ORDER BY len(found) DESC) = 1"""

LSTSQ = """WITH l AS (SELECT l_returnflag, CAST(l_orderkey % 16 AS BIGINT) AS part, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS p, l_tax::DOUBLE AS t FROM lineitem),
c AS (SELECT l_returnflag, part, avg(a) AS ma, avg(b) AS mb, avg(p) AS mp, avg(t) AS mt, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, p) AS ap, covar_pop(b, p) AS bp, covar_pop(a, t) AS at_, covar_pop(b, t) AS bt FROM l GROUP BY ALL),
w AS (SELECT *, (bb * ap - ab * bp) / (aa * bb - ab * ab) AS p1, (aa * bp - ab * ap) / (aa * bb - ab * ab) AS p2, (bb * at_ - ab * bt) / (aa * bb - ab * ab) AS t1, (aa * bt - ab * at_) / (aa * bb - ab * ab) AS t2 FROM c)
SELECT l_returnflag, part, round(mp - p1 * ma - p2 * mb, 3) + 0.0 AS p0, round(p1, 3) + 0.0 AS p1, round(p2, 3) + 0.0 AS p2, round(mt - t1 * ma - t2 * mb, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1, round(t2, 6) + 0.0 AS t2 FROM w"""

CUBIC = """WITH l AS (SELECT l_returnflag, CAST(l_orderkey % 16 AS BIGINT) AS part, l_quantity::DOUBLE / 50 AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
c AS (SELECT l_returnflag, part, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(y) AS my, var_pop(x) AS s11, covar_pop(x, x * x) AS s12, covar_pop(x, x * x * x) AS s13, var_pop(x * x) AS s22,
  covar_pop(x * x, x * x * x) AS s23, var_pop(x * x * x) AS s33, covar_pop(x, y) AS y1, covar_pop(x * x, y) AS y2, covar_pop(x * x * x, y) AS y3 FROM l GROUP BY ALL),
d AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det FROM c),
b AS (SELECT *, (y1 * (s22 * s33 - s23 * s23) - s12 * (y2 * s33 - s23 * y3) + s13 * (y2 * s23 - s22 * y3)) / det AS b1,
  (s11 * (y2 * s33 - s23 * y3) - y1 * (s12 * s33 - s23 * s13) + s13 * (s12 * y3 - y2 * s13)) / det AS b2, (s11 * (s22 * y3 - y2 * s23) - s12 * (s12 * y3 - y2 * s13) + y1 * (s12 * s23 - s22 * s13)) / det AS b3 FROM d)
SELECT l_returnflag, part, round(my - b1 * m1 - b2 * m2 - b3 * m3, 1) + 0.0 AS c0, round(b1, 1) + 0.0 AS c1, round(b2, 1) + 0.0 AS c2, round(b3, 1) + 0.0 AS c3 FROM b"""

#: Orders as occurrences of three attributes, and a two-sided and a one-sided rule for each series; rp has the predictions.
PREDICTIONS = f"""{fx.ORDERS}, oc AS (SELECT CAST(key % 20 AS VARCHAR) AS series_id, CAST(id % 3 AS INTEGER) AS attr_id, a AS t1, b - a AS delta, CAST(1 + id % 5 AS DOUBLE) AS lam, id AS occ_id FROM oi),
sz AS (SELECT series_id, max(t1 + delta) AS n FROM oc WHERE attr_id = 1 GROUP BY 1),
one AS (SELECT series_id, 1 AS rule_id, occ_id AS o0, CAST(0 AS BIGINT) AS o1, t1 + 3 AS t2, delta + 2 AS delta2, 0.5 + 2 * lam + 0.1 * delta AS lam2, (CAST(series_id AS INTEGER) % 4) / 10.0 + 0.2 AS avg_err FROM oc WHERE attr_id = 0),
two AS (SELECT x.series_id, 2 AS rule_id, x.occ_id AS o0, y.occ_id AS o1, CAST(round_even((x.t1 + y.t1) * 0.5 + 4, 0) AS BIGINT) AS t2, CAST(round_even((x.delta + y.delta) * 0.5, 0) AS BIGINT) AS delta2, x.lam + y.lam AS lam2, 0.3 AS avg_err
  FROM oc x JOIN oc y ON x.series_id = y.series_id AND x.attr_id = 0 AND y.attr_id = 2 AND x.t1 = y.t1),
rp AS (SELECT r.* FROM (SELECT * FROM one UNION ALL SELECT * FROM two) r JOIN sz ON sz.series_id = r.series_id WHERE t2 >= 0 AND delta2 > 0 AND t2 + delta2 <= n)"""

#: The rows each forecast point is checked against: the largest end of the orders that start on a day.
VIOLATIONS = f"""{PREDICTIONS}, ac AS (SELECT CAST(key % 20 AS VARCHAR) AS series_id, CAST(id % 3 AS INTEGER) AS attr_id, a AS t, CAST(max(b - a) AS DOUBLE) AS v FROM oi GROUP BY ALL),
az AS (SELECT series_id, max(t) + 1 AS n FROM ac WHERE attr_id = 1 GROUP BY 1),
bs AS (SELECT rp.*, coalesce(x.v, y.v) AS base FROM rp JOIN az ON az.series_id = rp.series_id AND rp.t2 + rp.delta2 <= az.n LEFT JOIN ac x ON x.series_id = rp.series_id AND x.attr_id = 1 AND x.t = rp.t2 LEFT JOIN ac y ON y.series_id = rp.series_id AND y.attr_id = 1 AND y.t = rp.t2 - 1),
pt AS (SELECT series_id, rule_id, o0, o1, avg_err, t2 + i AS t, base + lam2 * (CASE WHEN delta2 > 1 THEN 1 - i / (delta2 - 1)::DOUBLE ELSE 1 END) AS pred FROM (SELECT *, unnest(range(delta2)) AS i FROM bs WHERE base IS NOT NULL)),
fo AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY avg_err, rule_id, o0, o1) = 1),
bd AS (SELECT fo.series_id, fo.t, max(CASE WHEN abs(pred - v) > 6 THEN 1 ELSE 0 END) AS y FROM fo JOIN ac ON ac.series_id = fo.series_id AND ac.attr_id = 1 AND ac.t = fo.t GROUP BY ALL)"""

def trimmed(epsilon: float, least: int, run: int = 128, monotone: int = 4) -> str:
    """What is left of each run of events after its flat ends are cut; d counts what is given back, in turn from the left."""
    limit = "coalesce(list_position([abs(list_sum([sign(x[j + 1] - x[j]) FOR j IN range(1, k + 1)])) >= {m} FOR k IN range(1, len(x))], true) - 1, len(x))".replace("{m}", str(monotone))
    flat = f"coalesce(list_position([list_max(x[1 : k]) - list_min(x[1 : k]) >= {epsilon} FOR k IN range(1, len(x) + 1)], true) - 1, len(x))"
    return f"""WITH {fx.EVENTS}, g AS (SELECT series_id || '/' || CAST(t // {run} AS VARCHAR) AS series_id, list(v ORDER BY t) AS v FROM fx GROUP BY ALL),
e AS (SELECT series_id, 0 AS side, v AS x FROM g UNION ALL SELECT series_id, 1, list_reverse(v) FROM g),
c AS (SELECT series_id, side, len(x) AS n, list_max(x) - list_min(x) AS span, {limit} AS most, {flat} AS flat FROM e),
s AS (SELECT series_id, any_value(n) AS n, any_value(span) AS span, sum(most) AS ends, max(least(most, flat)) FILTER (side = 0) AS l, max(least(most, flat)) FILTER (side = 1) AS r FROM c GROUP BY 1),
d AS (SELECT *, least(l + r, greatest(0, {least} - (n - l - r))) AS d FROM s),
b AS (SELECT *, least(l, greatest(d - d // 2, d - r)) AS dl FROM d)
SELECT series_id, 0 AS attr_id, CAST(CASE WHEN ends >= n AND span < {epsilon} OR l + r > n THEN 0 ELSE greatest(l - dl - 1, 0) END AS BIGINT) AS a,
  CAST(CASE WHEN ends >= n AND span < {epsilon} OR l + r > n THEN n ELSE least(n - (r - (d - dl)) + 1, n) END AS BIGINT) AS b FROM b"""
