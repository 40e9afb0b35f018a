"""Queries: preparation of sequences and rows for models."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lattiq.operators import sequences as N
from lattiq.operators.pareto import first_front
from lattiq.plans.registry import query
from lattiq.session import table

CP = """cp AS (SELECT user_id AS uid, event_id AS it, row_number() OVER w / count(*) OVER (PARTITION BY user_id)::DOUBLE AS progress, value AS mqe, value / 200 AS te, value / 400 AS dead, event_id % 10 + 1 AS lr, event_id % 7 + 1 AS radius FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def checkpoints(spark, d):
    """Events of a user as the checkpoints of a training."""
    w = Window.partitionBy("user_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("uid"),
        F.col("event_id").alias("it"),
        (F.row_number().over(w.orderBy("event_id")) / F.count(F.lit(1)).over(w)).alias("progress"),
        F.col("value").alias("mqe"),
        (F.col("value") / 200).alias("topographic_error"),
        (F.col("value") / 400).alias("dead_neuron_ratio"),
        (F.col("event_id") % 10 + 1).alias("learning_rate"),
        (F.col("event_id") % 7 + 1).alias("radius"),
    )


@query(f"""WITH {CP}, k AS (SELECT uid FROM cp GROUP BY 1 HAVING count(*) >= 2) SELECT uid, round(progress, 6) AS progress, round(mqe / greatest(first_value(mqe) OVER w, 1e-10), 6) AS mqe_rel, round(te, 6) AS te, round(dead, 6) AS dead,
 round(lr / greatest(first_value(lr) OVER w, 1e-10)::DOUBLE, 6) AS lr_rel, round(radius / greatest(first_value(radius) OVER w, 1e-10)::DOUBLE, 6) AS radius_rel FROM cp SEMI JOIN k USING (uid) WINDOW w AS (PARTITION BY uid ORDER BY it)""")
def n1_normalise_checkpoints(spark, d):
    x = N.normalise_checkpoints(checkpoints(spark, d), "uid", "it")
    return x.select("uid", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query("""WITH g AS (SELECT user_id AS uid, count(*) AS n, round(avg(value), 6) AS v FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) >= 4)
SELECT uid, n, v, NOT EXISTS (SELECT 1 FROM g p WHERE p.v <= q.v AND p.n >= q.n AND (p.v < q.v OR p.n > q.n)) AS is_pareto FROM g q""")
def n2_load_individuals(spark, d):
    g = table(spark, d, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("v")).where("n >= 4")
    best = first_front(g.select("uid", "v", (-F.col("n")).alias("few"), F.lit(0.0).alias("cv")), "uid", ["v", "few"], "cv")
    flag = best.select("uid", F.lit(True).alias("is_pareto"))
    return g.join(flag, "uid", "left").select("uid", "n", "v", F.coalesce("is_pareto", F.lit(False)).alias("is_pareto"))


@query("""WITH r AS (SELECT p_partkey, p_type, percent_rank() OVER (PARTITION BY p_type ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS r FROM part) SELECT p_partkey, p_type, CASE WHEN r < 0.7 THEN 'train' WHEN r < 0.85 THEN 'val' ELSE 'test' END AS split FROM r""")
def n3_n12_stratified_split(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_type")
    return N.split(x, "p_partkey", "p_type").select("p_partkey", "p_type", "split")


@query("""WITH x AS (SELECT DISTINCT user_id AS uid FROM events), r AS (SELECT uid, percent_rank() OVER (ORDER BY md5(uid::VARCHAR), uid) AS r FROM x) SELECT CASE WHEN r < 0.7 THEN 'train' WHEN r < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS rows FROM events JOIN r ON uid = user_id GROUP BY 1""")
def n7_split_by_individual(spark, d):
    return N.split(table(spark, d, "events").select("user_id", "event_id"), "user_id").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, value / 20 AS lr_factor, (event_id % 5) / 2.0::DOUBLE AS radius_factor, round(abs(value / 20 - 1), 9) > 0.01 OR abs((event_id % 5) / 2.0::DOUBLE - 1) > 0.01 AS perturbed FROM events")
def n5_perturb_mask(spark, d):
    lr, radius = F.col("value") / 20, (F.col("event_id") % 5) / 2.0
    x = table(spark, d, "events")
    return x.select("event_id", lr.alias("lr_factor"), radius.alias("radius_factor"), ((F.round(F.abs(lr - 1), 9) > 0.01) | (F.abs(radius - 1) > 0.01)).alias("perturbed"))


@query("""WITH s AS (SELECT stddev_pop(l_discount) AS a, stddev_pop(l_tax) AS b FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount / a + l_tax / b AS raw FROM lineitem, s), m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round((raw - lo) / (hi - lo), 6) AS advantage FROM r, m""")
def n6_advantage(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return N.advantage(x, ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("advantage", 6).alias("advantage"))


@query("""WITH t AS (SELECT l_suppkey AS uid, l_linenumber AS variant, avg(l_discount) AS mqe, avg(l_tax) AS te, avg(l_quantity) / 100 AS dead FROM lineitem GROUP BY 1, 2), a AS (SELECT t.uid, t.variant, round((b.mqe - t.mqe) + 0.5 * (b.te - t.te) + 0.3 * (b.dead - t.dead), 6) AS advantage FROM t JOIN t b ON t.uid = b.uid AND b.variant = 1 WHERE t.variant <> 1)
SELECT uid, arg_min(variant, {'a': -advantage, 'v': variant}) AS variant, max(advantage) AS advantage FROM a GROUP BY 1""")
def n8_best_variant(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("uid"), F.col("l_linenumber").alias("variant")).agg(F.avg("l_discount").alias("mqe"), F.avg("l_tax").alias("te"), (F.avg("l_quantity") / 100).alias("dead"))
    b = t.where("variant = 1").select("uid", *[F.col(c).alias(f"b_{c}") for c in ("mqe", "te", "dead")])
    gain = (F.col("b_mqe") - F.col("mqe")) + 0.5 * (F.col("b_te") - F.col("te")) + 0.3 * (F.col("b_dead") - F.col("dead"))
    a = t.where("variant <> 1").join(b, "uid").select("uid", "variant", F.round(gain, 6).alias("advantage"))
    return a.groupBy("uid").agg(F.min_by("variant", F.struct(-F.col("advantage"), "variant")).alias("variant"), F.max("advantage").alias("advantage"))


@query("""SELECT user_id, list_resize(list(value ORDER BY event_id)[1:100], 100, 0.0) AS seq FROM events GROUP BY 1""")
def n9_padded_sequences(spark, d):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    return table(spark, d, "events").groupBy("user_id").agg(N.pad(seq, 100, F.lit(0.0)).alias("seq"))


@query(f"WITH {CP} SELECT uid, it, round((1 - mqe / 100) + te + 0.5 * dead, 9) AS badness, round((1 - mqe / 100) + te + 0.5 * dead, 9) > 0.9 AS stop FROM cp")
def n10_badness(spark, d):
    b = N.badness(F.col("mqe") / 100, F.col("topographic_error"), F.col("dead_neuron_ratio"))
    return checkpoints(spark, d).select("uid", "it", F.round(b, 9).alias("badness"), (F.round(b, 9) > 0.9).alias("stop"))


@query("""WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linenumber < 5) SELECT l_linenumber, round(avg((l_quantity - m) / s), 6) + 0.0::DOUBLE AS mean, round(stddev_pop((l_quantity - m) / s), 6) AS std FROM lineitem, f GROUP BY 1""")
def n12_standardise_on_train(spark, d):
    x = N.standardise(table(spark, d, "lineitem").select("l_linenumber", "l_quantity"), ["l_quantity"], F.col("l_linenumber") < 5)
    return x.groupBy("l_linenumber").agg((F.round(F.avg("l_quantity"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"))


@query("SELECT p_size, count(*) AS items, ceil(count(*) / 16.0::DOUBLE)::BIGINT AS batches FROM part GROUP BY 1")
def n14_batches_by_size(spark, d):
    return N.batches_by_size(table(spark, d, "part"), "p_size", 16)


@query(f"WITH {CP} SELECT band, count(*) AS n FROM (SELECT CASE WHEN mqe / 100 + te + 0.5 * dead > 1 THEN 'terminate' WHEN mqe / 100 + te + 0.5 * dead > 0.5 THEN 'caution' ELSE 'continue' END AS band FROM cp) GROUP BY 1")
def n16_recommendation_bands(spark, d):
    band = N.recommendation(F.col("mqe") / 100, F.col("topographic_error"), F.col("dead_neuron_ratio"))
    return checkpoints(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (SELECT 'top' AS side, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)""")
def n17_prediction_extremes(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    top = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.lit("top").alias("side"), "*")
    return top.unionByName(p.orderBy("p_retailprice", "p_partkey").limit(10).select(F.lit("bottom").alias("side"), "*"))


@query("SELECT l_returnflag, round(corr(l_extendedprice, l_quantity * 1500), 6) AS r, round(avg(l_extendedprice - l_quantity * 1500), 4) AS bias FROM lineitem GROUP BY 1")
def n20_residuals(spark, d):
    p = F.col("l_quantity") * 1500
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_extendedprice", p), 6).alias("r"), F.round(F.avg(F.col("l_extendedprice") - p), 4).alias("bias"))


@query()
def n4_n19_windows_dataset(spark, d):
    """Prefix windows of resampled, normalised sequences, with the split and oversampled Pareto members."""
    from lattiq.operators.windows import prefix_windows, resample

    x = N.normalise_checkpoints(checkpoints(spark, d), "uid", "it")
    grid = resample(x, "uid", "progress", "mqe_rel", 20)
    seq = grid.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]).alias("seq"))
    wins = prefix_windows(N.split(seq, "uid"), "seq", [0.2, 0.3, 0.5, 0.7])
    return N.oversample(wins, (F.col("uid") % 10 == 0) & (F.col("split") == "train"), 3).select("uid", "split", "share", "copy", "prefix")


_W = "WITH cb AS (SELECT k AS nid, k // 4 AS i, k % 4 AS j, " + ", ".join(f"((k * 37 + {c * 11}) % 16) / 16.0::DOUBLE + 1 / 32.0::DOUBLE AS w{c}" for c in range(3)) + " FROM range(16) t(k))"


@query(f"""{_W}, e AS (SELECT sqrt((a.w0-b.w0)*(a.w0-b.w0)+(a.w1-b.w1)*(a.w1-b.w1)+(a.w2-b.w2)*(a.w2-b.w2)) AS d FROM cb a JOIN cb b ON abs(a.i-b.i)+abs(a.j-b.j)=1 AND a.nid < b.nid), f AS (SELECT unnest([w0,w1,w2]) AS v FROM cb)
SELECT (SELECT avg((sqrt(w0*w0+w1*w1+w2*w2) < 0.01)::INTEGER) FROM cb)::DOUBLE AS dead_share, (SELECT round(avg(d), 6) FROM e) AS mean_distance, (SELECT round(var_pop(v), 6) FROM f) AS variance""")
def n18_weight_quality(spark, d):
    from lattiq.operators.grid import euclid
    from lattiq.plans.maps import BOOK, GRID

    f = BOOK.frame(spark)
    a, b = f.alias("a"), f.alias("b")
    near = GRID.edges(spark, rook=True).where("a < b").alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid")).agg(F.round(F.avg(euclid(F.col("a.w"), F.col("b.w"))), 6).alias("mean_distance"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, v: s + v * v))
    dead = f.agg(F.avg((norm < 0.01).cast("double")).alias("dead_share"))
    return dead.join(F.broadcast(near)).join(F.broadcast(f.select(F.explode("w").alias("v")).agg(F.round(F.var_pop("v"), 6).alias("variance"))))  # one row each


@query(f"""{_W}, m AS (SELECT least(min(w0), min(w1), min(w2)) AS lo, greatest(max(w0), max(w1), max(w2)) AS hi FROM cb) SELECT nid::INTEGER AS nid, round((w0 - lo) / (hi - lo) * 255)::INTEGER AS r, round((w1 - lo) / (hi - lo) * 255)::INTEGER AS g, round((w2 - lo) / (hi - lo) * 255)::INTEGER AS b FROM cb, m""")
def n13_weights_to_rgb(spark, d):
    from lattiq.plans.maps import BOOK

    f = BOOK.frame(spark)
    span = f.agg(F.min(F.array_min("w")).alias("lo"), F.max(F.array_max("w")).alias("hi"))
    level = [F.round((F.col("w")[k] - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int").alias(c) for k, c in enumerate("rgb")]
    return f.join(F.broadcast(span)).select("nid", *level)  # one row
