"""Queries: reports on an engine run over orders."""

from __future__ import annotations

import uuid

from lattiq.operators import engine, report
from lattiq.plans.engine import BASE, CONFIG, EXTREME, orders
from lattiq.plans.maps import ROOK
from lattiq.plans.registry import query
from lattiq.session import scratch_root

ABOUT = "Orders of a trading company.\nx0 is the price, x1 a section of customers, x2 the priority."


def view(spark, d):
    root = f"{scratch_root(spark)}/report-{uuid.uuid4().hex}"
    rows = orders(spark, d)
    engine.run(rows, CONFIG, root, "orders")
    return report.RunView(spark, root, "orders", rows)


def _num(x: str, places: int = 4, sign: str = "") -> str:
    return f"coalesce(printf('%{sign}.{places}f', round(({x})::DOUBLE, {places}) + 0.0::DOUBLE), 'n/a')"


_PARTS = f"""{EXTREME}, rl AS (SELECT id, 'x0' AS f, a AS v FROM raw UNION ALL SELECT id, 'x1', b FROM raw WHERE b IS NOT NULL),
gl AS (SELECT f, avg(v) AS mu, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM rl GROUP BY 1), cl AS (SELECT bmu_key, count(*) AS n, round(avg(qe), 6) AS q FROM bmu GROUP BY 1),
cz AS (SELECT bmu_key, f, round(m, 4) AS m, CASE WHEN sd > 0 THEN round((m - mu) / sd, 3) + 0.0::DOUBLE END AS z FROM (SELECT bmu_key, f, avg(v) AS m FROM rl JOIN bmu USING (id) GROUP BY 1, 2) JOIN gl USING (f)),
cc AS (SELECT bmu_key, cat, count(*) AS n FROM bmu GROUP BY 1, 2), dom AS (SELECT bmu_key, arg_min(cat, struct_pack(a := -n, b := cat)) AS cat, max(n) / sum(n)::DOUBLE AS p FROM cc GROUP BY 1),
lb AS (SELECT id, bmu_key, f, v FROM l JOIN bmu USING (id) WHERE v IS NOT NULL), ls AS (SELECT bmu_key, f, avg(v) AS mu, stddev_samp(v) AS sd, count(*) AS n FROM lb GROUP BY 1, 2),
loc AS (SELECT id, f, round((v - mu) / sd, 4) AS z FROM lb JOIN ls USING (bmu_key, f) WHERE n >= 3 AND sd > 0 AND abs((v - mu) / sd) > 2.5),
ex AS (SELECT id, unnest([CASE WHEN abs(v - mu) > 2.5 * sd THEN printf('%s outlier: %.4f', f, v) END, CASE WHEN lo < hi AND v = lo THEN printf('%s minimum: %.4f', f, v) END, CASE WHEN lo < hi AND v = hi THEN printf('%s maximum: %.4f', f, v) END]) AS reason FROM l JOIN st USING (f) WHERE v IS NOT NULL),
k AS (SELECT id, count(DISTINCT f) AS nd, CASE WHEN count(DISTINCT f) > 1 THEN 0 ELSE 2 END AS p FROM loc GROUP BY 1),
fa AS (SELECT id, p, nd, f || ': ' || {_num('z', 2, '+')} || ' deviations' AS reason FROM loc JOIN k USING (id) UNION ALL SELECT id, 3, 0, reason FROM ex WHERE reason IS NOT NULL),
fr AS (SELECT id, bmu_key, min(p) AS p, max(nd) AS n_dims, round(any_value(qe), 6) AS qe, list(DISTINCT reason ORDER BY reason) AS reasons FROM fa JOIN bmu USING (id) GROUP BY 1, 2),
ra AS (SELECT id, bmu_key, CASE p WHEN 0 THEN 'multi_dim' WHEN 2 THEN 'numeric' ELSE 'global_extreme' END AS kind, n_dims, qe, reasons, row_number() OVER (ORDER BY p, n_dims DESC, qe DESC, id)::INTEGER AS place FROM fr)"""


@query(f"""{BASE}, {_PARTS}, cp AS (SELECT *, row_number() OVER (ORDER BY n DESC, bmu_key)::INTEGER AS place FROM cl)
SELECT place, bmu_key, n AS sample_count, q AS qe_mean, f AS feature, m AS mean, z, abs(coalesce(z, 0)) > 1.5 AS highlighted FROM cp JOIN cz USING (bmu_key) WHERE place <= 40""")
def v7_o13_cluster_table(spark, d):
    return report.cluster_table(view(spark, d))


@query(f"{BASE}, {_PARTS} SELECT place, id, bmu_key, kind, n_dims, qe, reasons FROM ra WHERE place <= 20")
def v7_o13_anomaly_table(spark, d):
    return report.anomaly_table(view(spark, d))


_FAR = "(abs((a.j - a.i // 2) - (b.j - b.i // 2)) + abs((-(a.j - a.i // 2) - a.i) - (-(b.j - b.i // 2) - b.i)) + abs(a.i - b.i)) / 2 > 1"
_FIGURES = " || ', ' || ".join(f"'{n} ' || {_num(x)}" for n, x in (("min", "round(min(v), 4)"), ("max", "round(max(v), 4)"), ("mean", "round(avg(v), 4)"), ("std", "round(stddev_samp(v), 4)"), ("median", "round(quantile_cont(v, 0.5), 4)"), ("p25", "round(quantile_cont(v, 0.25), 4)"), ("p75", "round(quantile_cont(v, 0.75), 4)")))


@query(f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, {_PARTS}, {ROOK}, hit AS (SELECT cb.i || '_' || cb.j AS neuron_key, count(bmu.id) AS hits FROM cb LEFT JOIN bmu USING (nid) GROUP BY 1),
dead AS (SELECT count(*) AS n, string_agg(neuron_key, ', ' ORDER BY neuron_key) AS names FROM hit WHERE hits = 0), held AS (SELECT avg(sqrt(a.d2)) AS mqe, avg(({_FAR})::INTEGER) AS te FROM ranked a JOIN ranked b ON a.id = b.id AND a.r = 1 AND b.r = 2),
cells AS (SELECT nid, i, j, cat AS category FROM cb JOIN dom ON bmu_key = i || '_' || j), same AS (SELECT a, b FROM rook JOIN cells x ON x.nid = a JOIN cells y ON y.nid = b AND x.category = y.category),
reach(nid, r) AS (SELECT nid, nid FROM cells UNION SELECT same.b, reach.r FROM reach JOIN same ON same.a = reach.nid), lab AS (SELECT nid, min(r) AS region FROM reach GROUP BY 1),
reg AS (SELECT region, category, count(*) AS size, round(avg(i), 4) AS ci, round(avg(j), 4) AS cj FROM cells JOIN lab USING (nid) GROUP BY 1, 2),
rec AS (SELECT place, id, string_agg(t, ' | ' ORDER BY t) AS t FROM (SELECT place, id, f || '=' || {_num('v')} || ' [' || {_num('round(v - mu, 4)', 4, '+')} || ', ' || {_num('round(CASE WHEN mu <> 0 THEN (v - mu) / abs(mu) * 100 END, 2)', 2, '+')} || ' %]'
 || CASE WHEN v = lo THEN ' min' WHEN v = hi THEN ' max' WHEN abs((v - mu) / abs(mu) * 100) >= 50 THEN ' strong' WHEN abs((v - mu) / abs(mu) * 100) >= 20 THEN ' moderate' ELSE '' END AS t FROM ra JOIN rl USING (id) JOIN gl USING (f) WHERE place <= 10) GROUP BY 1, 2),
gaps AS (SELECT id, ['x1'] AS g FROM raw WHERE b IS NULL), cat AS (SELECT cat, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cat) AS r FROM bmu GROUP BY 1)
SELECT section, place::INTEGER AS place, line FROM (
SELECT 1 AS section, 1 AS place, 'Orders of a trading company.' AS line UNION ALL SELECT 1, 2, 'x0 is the price, x1 a section of customers, x2 the priority.'
UNION ALL SELECT 2, 1, 'size: 4 x 4 hex' UNION ALL SELECT 2, 2, 'rows: ' || count(*) FROM bmu
UNION ALL SELECT 2, 3, 'neurons: 16, without rows: ' || n || ' (' || {_num('n * 100 / 16.0::DOUBLE', 1)} || ' %)' || CASE WHEN n BETWEEN 1 AND 15 THEN ': ' || names ELSE '' END FROM dead
UNION ALL SELECT 2, 4, 'mean error: ' || {_num('round(mqe, 6)')} FROM held UNION ALL SELECT 2, 5, 'topographic error: ' || {_num('round(te, 6)')} FROM held
UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, bmu_key), bmu_key || ': ' || n || ' rows, error ' || {_num('q')} || ', mostly x2=' || cat || ' (' || {_num('p', 3)} || '); ' || t FROM cl JOIN dom USING (bmu_key)
 JOIN (SELECT bmu_key, string_agg(f || ' ' || {_num('m')} || ' (z ' || {_num('z', 3, '+')} || ')', ', ' ORDER BY abs(coalesce(z, 0)) DESC, f) AS t FROM cz GROUP BY 1) USING (bmu_key)
UNION ALL SELECT 4, 0, 'global extremes: ' || (SELECT count(*) FROM ext) || ', outliers of a cluster: ' || (SELECT count(DISTINCT id) FROM loc)
UNION ALL SELECT 4, place, id || ' (' || bmu_key || ', ' || kind || '): ' || array_to_string(reasons, '; ') FROM ra WHERE place <= 10 UNION ALL SELECT 5, place, id || ': ' || t FROM rec
UNION ALL SELECT 6, CASE f WHEN 'x0' THEN 1 ELSE 2 END, f || ': ' || {_FIGURES} FROM rl GROUP BY f
UNION ALL SELECT 7, 1, 'x2: ' || string_agg(cat || ' ' || {_num('n / (SELECT count(*) FROM bmu)::DOUBLE')}, ', ' ORDER BY r) FROM cat
UNION ALL (SELECT 8, row_number() OVER (ORDER BY size DESC, region), category || ': ' || size || ' neurons around ' || {_num('ci', 2)} || ', ' || {_num('cj', 2)} FROM reg ORDER BY size DESC, region LIMIT 10)
UNION ALL SELECT 9, 1, 'rows with missing values: ' || (SELECT count(*) FROM gaps) || ' of ' || (SELECT count(*) FROM raw) UNION ALL SELECT 9, 3, 'x1: ' || count(*) FROM gaps
UNION ALL (SELECT 9, 5 + row_number() OVER (ORDER BY id), id || ' misses x1' FROM gaps ORDER BY id LIMIT 5))""")
def v4_context_text(spark, d):
    """The lines of a plain-text report on a run, in nine sections."""
    return report.context_lines(view(spark, d), ABOUT)
