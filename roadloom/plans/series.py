"""Frames over time and evaluation on events, labels and lineitems."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import evaluate as V
from roadloom.operators import frames as R
from roadloom.operators.quantiles import quantiles
from roadloom.operators.scans import Scan
from roadloom.plans.catalogue import register
from roadloom.plans.roles import table

SPINE = """m AS (SELECT user_id, floor(epoch(ts) / 21600)::BIGINT AS slot, avg(value) AS value FROM events GROUP BY 1, 2), b AS (SELECT user_id, min(slot) AS a, max(slot) AS z FROM m GROUP BY 1),
s AS (SELECT b.user_id, g.slot, m.value FROM b, LATERAL (SELECT unnest(range(a, z + 1)) AS slot) g LEFT JOIN m ON m.user_id = b.user_id AND m.slot = g.slot)"""


def _frames(spark, sf):
    return R.resample(table(spark, sf, "events"), "user_id", "ts", "value", 360)


@register(f"WITH {SPINE} SELECT user_id, slot, round(value, 6) AS value FROM s")
def resample(spark, sf):
    return _frames(spark, sf).withColumn("value", F.round("value", 6))


@register(f"""WITH {SPINE}, i AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {{'s': slot, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS p,
first_value(CASE WHEN value IS NOT NULL THEN {{'s': slot, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s)
SELECT user_id, slot, round(coalesce(value, p.v + (n.v - p.v) * (slot - p.s) / nullif(n.s - p.s, 0), p.v, n.v, 0), 6) AS value FROM i""")
def resample_interpolate(spark, sf):
    return R.interpolate(_frames(spark, sf), "user_id").withColumn("value", F.round("value", 6))


@register("""SELECT ts::DATE AS day, round(sum(value), 2) AS total FROM events GROUP BY 1 HAVING count(*) >= 12 ORDER BY sum(value) DESC, 1 LIMIT 1""")
def busiest_day(spark, sf):
    return R.busiest_day(table(spark, sf, "events"), "ts", "value", 12).withColumn("total", F.round("total", 2))


@register("""SELECT hour(ts)::INT AS frame, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (value > 0) AS active, round(avg(value) FILTER (value > 0), 6) AS active_mean, max(value) AS max FROM events GROUP BY 1""")
def frame_stats(spark, sf):
    out = R.frame_stats(table(spark, sf, "events").select(F.hour("ts").alias("frame"), "value"), "frame", "value")
    return out.select("frame", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), "active", F.round("active_mean", 6).alias("active_mean"), "max")


@register("""WITH f AS (SELECT user_id, hour(ts)::INT AS frame, avg(value) AS s, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), q AS (SELECT user_id, quantile_cont(s, 0.9) FILTER (s <> 0) AS free FROM f GROUP BY 1), p AS (SELECT quantile_cont(v, 0.95) AS p95 FROM f)
SELECT f.user_id, frame, round(greatest(0, least(1, coalesce(greatest(0, least(1, 1 - s / nullif(free, 0))), 0) * greatest(0, least(1, ln(1 + v) / ln(1 + greatest(1, p95)))))), 6)::DOUBLE AS congestion FROM f JOIN q ON q.user_id = f.user_id CROSS JOIN p""")
def congestion_frames(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("frame")).agg(F.avg("value").alias("s"), F.count("*").cast("double").alias("v"))
    return R.congestion_frames(f, "user_id", "frame", "s", "v").withColumn("congestion", F.round("congestion", 6))


HOURLY = """h AS (SELECT user_id, floor(epoch(ts) / 7200)::BIGINT AS k, count(*)::DOUBLE AS x FROM events GROUP BY 1, 2)"""


def _hourly(spark, sf):
    k = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 7200)
    return table(spark, sf, "events").groupBy("user_id", k.alias("k")).agg(F.count("*").cast("double").alias("x"))


@register(f"""WITH {HOURLY}, b AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT DISTINCT k FROM h)), c AS (SELECT user_id, h.k, r, r - row_number() OVER (PARTITION BY user_id ORDER BY r) AS g FROM h JOIN b ON b.k = h.k WHERE x >= 1)
SELECT user_id, k, row_number() OVER (PARTITION BY user_id, g ORDER BY r) AS streak FROM c""")
def congestion_streak(spark, sf):
    return R.congestion_runs(_hourly(spark, sf), "user_id", "k", "x", 1.0).withColumn("streak", F.col("streak").cast("bigint"))


DELTA = f"""WITH {HOURLY}, b AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT DISTINCT k FROM h)), n AS (SELECT r, user_id, x FROM h JOIN b ON b.k = h.k),
d AS (SELECT coalesce(a.r, c.r + 1) AS r, coalesce(a.user_id, c.user_id) AS user_id, coalesce(a.x, 0) - coalesce(c.x, 0) AS delta FROM n a FULL JOIN n c ON a.r = c.r + 1 AND a.user_id = c.user_id),
e AS (SELECT b.k, user_id, delta FROM d JOIN b ON b.r = d.r WHERE d.r > 1 AND abs(delta) >= 1e-4)"""


@register(DELTA + " SELECT k, user_id, delta FROM e")
def frame_delta(spark, sf):
    return R.deltas(_hourly(spark, sf), "user_id", "k", "x")


@register(DELTA + " SELECT k, count(*) FILTER (delta >= 0.05) AS worsened, count(*) FILTER (delta <= -0.05) AS improved, max(delta) AS max_rise, min(delta) AS max_drop FROM e GROUP BY k")
def delta_summary(spark, sf):
    return R.delta_summary(frame_delta(spark, sf), "k")


@register("""SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC, l_partkey)::INT AS rank FROM (SELECT month(l_shipdate)::INT AS frame, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) QUALIFY rank <= 10""")
def hotspots_topk(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.month("l_shipdate").alias("frame"), "l_partkey").agg(F.sum("l_quantity").alias("v"))
    return R.hot_spots(v, "frame", "l_partkey", "v", 10)


@register("""WITH q AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, v[least(len(v), floor(len(v) * 0.2)::BIGINT + 1)] AS b1, v[least(len(v), floor(len(v) * 0.5)::BIGINT + 1)] AS b2, v[least(len(v), floor(len(v) * 0.9)::BIGINT + 1)] AS b3 FROM q""")
def nearest_rank_breaks(spark, sf):
    out = R.nearest_rank(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", (0.2, 0.5, 0.9))
    return out.select("l_returnflag", *(F.get("breaks", F.lit(i)).alias(f"b{i + 1}") for i in range(3)))


@register("""SELECT floor(value / 20)::INT AS kind, count(*) AS n, sum((value > 10)::INT + (value > 30)::INT + (value > 60)::INT)::BIGINT AS classes FROM events GROUP BY 1""")
def color_classes(spark, sf):
    e = table(spark, sf, "events").withColumn("b", F.array(*map(F.lit, (10.0, 30.0, 60.0))))
    return e.groupBy(F.floor(F.col("value") / 20).cast("int").alias("kind")).agg(F.count("*").alias("n"), F.sum(S.color_class("value", "b")).cast("bigint").alias("classes"))


@register("""WITH b AS (SELECT min(p_size) AS lx, max(p_size) AS hx, min(p_retailprice) AS ly, max(p_retailprice) AS hy FROM part), v AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey, v, greatest(0, least(33, floor((p_size - lx) / nullif(hx - lx, 0)::DOUBLE * 34)))::INT AS cx, greatest(0, least(21, floor((p_retailprice - ly) / nullif(hy - ly, 0) * 22)))::INT AS cy FROM part JOIN v ON l_partkey = p_partkey CROSS JOIN (SELECT min(p_size) AS lx, max(p_size) AS hx, min(p_retailprice) AS ly, max(p_retailprice) AS hy FROM part JOIN v ON l_partkey = p_partkey)),
d AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY v DESC, p_partkey) = 1 AS first FROM c) SELECT p_partkey, cx, cy, v, first FROM d ORDER BY first DESC, v DESC, p_partkey LIMIT 720""")
def grid_thinning_topk(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("v"))
    return R.thin(table(spark, sf, "part").join(v, "p_partkey"), "p_size", "p_retailprice", "v", "p_partkey")


@register("""WITH n AS (SELECT s_nationkey, s_suppkey, s_acctbal, lead(s_suppkey) OVER w AS next_key, lead(s_acctbal) OVER w AS b, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS v, CASE WHEN lead(s_suppkey) OVER w % 3 <> 0 THEN lead(s_suppkey) OVER w END AS v2 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey))
SELECT s_nationkey, s_suppkey, next_key, round(b - s_acctbal, 4) AS dist, coalesce((v + v2) / 2, v, v2)::DOUBLE AS link_value FROM n WHERE next_key IS NOT NULL AND b - s_acctbal <= 850""")
def sensor_links_lead(spark, sf):
    sensors = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("double")).alias("v"))
    out = R.sensor_links(sensors, "s_suppkey", ["s_nationkey"], "s_acctbal", lambda a, b: b("s_acctbal") - a("s_acctbal"), 850.0, "v")
    return out.withColumn("dist", F.round("dist", 4))


@register("""WITH v AS (SELECT l_partkey, month(l_shipdate)::INT AS f, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, f AS peak_frame, v AS peak FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY v DESC, f) = 1""")
def peak_frames(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_partkey", F.month("l_shipdate").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return R.peaks(v, "l_partkey", "f", "v")


@register("""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS r FROM (SELECT DISTINCT ts::DATE AS day FROM events)), k AS (SELECT day FROM d WHERE r % 4 = 0 ORDER BY day LIMIT 5)
SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE IN (FROM k) GROUP BY 1""")
def every_nth_frame(spark, sf):
    return R.every_nth(table(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", 4, 5).groupBy("day").agg(F.count("*").alias("n"))


@register("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2""")
def confusion(spark, sf):
    return V.confusion(table(spark, sf, "labels"), "quality", "toxic")


@register("""WITH t AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), a AS (SELECT sum(s * (s - 1) / 2) AS a FROM (SELECT sum(n) AS s FROM t GROUP BY quality)), b AS (SELECT sum(s * (s - 1) / 2) AS b FROM (SELECT sum(n) AS s FROM t GROUP BY toxic)),
c AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM t) SELECT round((c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM a, b, c""")
def adjusted_rand(spark, sf):
    return V.adjusted_rand(table(spark, sf, "labels"), "quality", "toxic").select(F.round("ari", 9).alias("ari"))


@register("""SELECT round(greatest(avg((quality = toxic)::INT), avg((quality <> toxic)::INT)), 9) AS accuracy FROM labels""")
def best_label_accuracy(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("quality") + 1).alias("a"), (F.col("toxic") + 1).alias("b"))
    return V.best_label_accuracy(rows, "a", "b", 2).select(F.round("accuracy", 9).alias("accuracy"))


@register("""SELECT e.user_id, arg_max(label, (n, -label)) AS mode, max(n) AS votes FROM (SELECT user_id, event_id % 7 AS label, count(*) AS n FROM events GROUP BY 1, 2) e GROUP BY 1""")
def posterior_mode(spark, sf):
    return V.posterior_mode(table(spark, sf, "events").select("user_id", (F.col("event_id") % 7).alias("label")), "user_id", "label")


DRAWS = """r AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iter, value FROM events)"""


def _draws(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("chain"), "event_id", "value")
    return Scan(rows, ["chain"], ["event_id"]).number("iter").done().select("chain", "iter", "value")


@register(f"""WITH {DRAWS} SELECT chain, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS upper FROM r WHERE iter > 10 AND (iter - 10) % 2 = 0 GROUP BY 1""")
def draw_quantiles(spark, sf):
    out = V.draw_summary(V.kept(_draws(spark, sf), 10, 2), ["chain"], "value")
    return out.select("chain", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "lower", "median", "upper")))


@register(f"""WITH {DRAWS}, b AS (SELECT chain, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, var_pop(value) AS v FROM r GROUP BY 1), c AS (SELECT x.chain, y.iter - x.iter AS lag, sum((x.value - m) * (y.value - m)) AS c FROM r x JOIN r y ON y.chain = x.chain AND y.iter - x.iter IN (1, 10, 30) JOIN b ON b.chain = x.chain GROUP BY 1, 2),
a AS (SELECT b.*, (SELECT c FROM c WHERE c.chain = b.chain AND lag = 1) / (n * v) AS a1, (SELECT c FROM c WHERE c.chain = b.chain AND lag = 10) / (n * v) AS a10, (SELECT c FROM c WHERE c.chain = b.chain AND lag = 30) / (n * v) AS a30 FROM b),
e AS (SELECT *, n * (1 - r) / (1 + r) AS ess FROM (SELECT *, greatest(0, least(0.999, coalesce(a1, 0))) AS r FROM a))
SELECT chain, n, round(CASE WHEN n >= 10 THEN m END, 6) AS mean, round(CASE WHEN n >= 10 THEN sd END, 6) AS sd, round(CASE WHEN n >= 10 THEN a1 END, 6) AS acf_1, round(CASE WHEN n >= 10 THEN a10 END, 6) AS acf_10, round(CASE WHEN n >= 10 THEN a30 END, 6) AS acf_30,
round(CASE WHEN n >= 10 THEN ess END, 5) AS ess, round(CASE WHEN n >= 10 THEN sd / sqrt(ess) END, 6) AS mcse FROM e""")
def mcmc_diag(spark, sf):
    out = V.chain_diagnostics(_draws(spark, sf), "chain", "iter", "value")
    return out.select("chain", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "acf_1", "acf_10", "acf_30")), F.round("ess", 5).alias("ess"), F.round("mcse", 6).alias("mcse"))


@register("""SELECT user_id, round(m + ln(s), 6) AS lse FROM (SELECT user_id, max(value) AS m, sum(exp(value - mx)) AS s FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS mx FROM events) GROUP BY 1)""")
def log_sum_exp(spark, sf):
    return V.log_sum_exp(table(spark, sf, "events"), ["user_id"], "value").withColumn("lse", F.round("lse", 6))


@register("""SELECT user_id, round(ln(n) - (m + ln(s)), 6) AS log_marginal FROM (SELECT user_id, count(*) AS n, max(-value) AS m, sum(exp(-value - mx)) AS s FROM (SELECT *, max(-value) OVER (PARTITION BY user_id) AS mx FROM events) GROUP BY 1)""")
def log_harmonic_mean(spark, sf):
    return V.log_harmonic_mean(table(spark, sf, "events"), ["user_id"], "value").withColumn("log_marginal", F.round("log_marginal", 6))


DAILY = """y AS (SELECT e.edge, g.t::INT AS t, coalesce(c.y, 0)::DOUBLE AS y FROM (SELECT DISTINCT user_id AS edge FROM events) e CROSS JOIN range(1, 31) g(t) LEFT JOIN (SELECT user_id, day(ts) AS t, count(*) AS y FROM events GROUP BY 1, 2) c ON c.user_id = e.edge AND c.t = g.t)"""


def daily(spark, sf):
    """edge (user), t (day), y (events) of all users."""
    e = table(spark, sf, "events")
    counts = e.groupBy(F.col("user_id").alias("edge"), F.dayofmonth("ts").alias("t")).agg(F.count("*").cast("double").alias("y"))
    spine = e.select(F.col("user_id").alias("edge")).distinct().select("edge", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("t"))
    return spine.join(counts, ["edge", "t"], "left").na.fill(0.0, ["y"])


@register(f"""WITH {DAILY}, p AS (SELECT a.edge AS target, b.edge AS source FROM (SELECT DISTINCT edge FROM y) a JOIN (SELECT DISTINCT edge FROM y) b ON a.edge = b.edge OR b.edge = a.edge + 1),
j AS (SELECT p.target, p.source, u.y AS x, v.y AS y FROM p JOIN y u ON u.edge = p.source JOIN y v ON v.edge = p.target AND v.t = u.t + 1), s AS (SELECT target, source, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM j GROUP BY 1, 2)
SELECT target, source, n, round(CASE WHEN n * xx - sx * sx > 1e-9 AND n * yy - sy * sy > 1e-9 THEN (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) END, 6) AS correlation FROM s""")
def lag_correlation(spark, sf):
    y = daily(spark, sf)
    ids = y.select("edge").distinct()
    pairs = ids.select(F.col("edge").alias("target"), F.explode(F.array(F.col("edge"), F.col("edge") + 1)).alias("source"))
    return V.lag_correlation(y, pairs).withColumn("correlation", F.round("correlation", 6))


@register(f"""WITH {DAILY} SELECT edge, t, y, round((ln(1 + coalesce(lag(y) OVER (PARTITION BY edge ORDER BY t), 3)) - ln(8)) / 2, 9) AS x FROM y""")
def lag_inputs(spark, sf):
    rows = Scan(daily(spark, sf), ["edge"], ["t"]).lag("before", F.col("y")).done()
    return rows.select("edge", "t", "y", F.round(S.lag_input(F.coalesce("before", F.lit(3.0))), 9).alias("x"))


def _half_hours(spark, sf):
    """t: the half hours that have events, counted from the first of 2024."""
    return table(spark, sf, "events").select((F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 1800) + 1).cast("int").alias("t")).distinct()


@register(f"""SELECT t::INT AS t, {', '.join(f"round({f}(2 * {math.pi!r} * {j} * ((t - 1) % 48) / 48), 9) + 0 AS {f}{j}" for j in (1, 2) for f in ("sin", "cos"))} FROM (SELECT DISTINCT floor((epoch(ts) - 1704067200) / 1800)::BIGINT + 1 AS t FROM events)""")
def season_features(spark, sf):
    s = _half_hours(spark, sf).withColumn("f", S.season("t"))
    return s.select("t", *((F.round(F.get("f", F.lit(i)), 9) + 0.0).alias(n) for i, n in enumerate(("sin1", "cos1", "sin2", "cos2"))))


@register("""SELECT t::INT AS t, round(1.5 + 0.4 * (t % 24 IN (7, 8, 9))::INT - 0.3 * (t % 7 IN (6, 0))::INT, 9)::DOUBLE AS eta, round(exp(1.5 + 0.4 * (t % 24 IN (7, 8, 9))::INT - 0.3 * (t % 7 IN (6, 0))::INT), 9) AS lam FROM (SELECT DISTINCT floor((epoch(ts) - 1704067200) / 1800)::BIGINT + 1 AS t FROM events)""")
def design_eta(spark, sf):
    t = F.col("t")
    f = F.array(F.lit(1.0), (t % 24).isin(7, 8, 9).cast("double"), (t % 7).isin(6, 0).cast("double"))
    eta = S.dot(f, F.array(*map(F.lit, (1.5, 0.4, -0.3))))
    return _half_hours(spark, sf).select("t", F.round(eta, 9).alias("eta"), F.round(F.exp(eta), 9).alias("lam"))


@register(f"""WITH {DAILY}, r AS (SELECT c::INT AS cluster, t::INT AS t, 0.3 * c + 0.01 * t AS eta FROM range(1, 4) a(c), range(1, 31) b(t)), s AS (SELECT edge, cluster, sum(y * eta - exp(eta)) + ln(cluster / 6.0 + 1e-16) AS s FROM y JOIN r ON r.t = y.t GROUP BY 1, 2)
SELECT edge, cluster, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY edge), 9) AS prob FROM (SELECT *, max(s) OVER (PARTITION BY edge) AS m FROM s)""")
def allocation_logscore(spark, sf):
    c = spark.range(1, 4).select(F.col("id").cast("int").alias("cluster"))
    rates = c.select("cluster", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("t")).withColumn("eta", 0.3 * F.col("cluster") + 0.01 * F.col("t"))
    return V.allocation(daily(spark, sf), rates, c.withColumn("pi", F.col("cluster") / 6.0)).withColumn("prob", F.round("prob", 9))


@register(f"""WITH {DAILY}, z AS (SELECT DISTINCT edge, (edge % 3 + 1)::INT AS z FROM y) SELECT k.c::INT AS cluster, g.t::INT AS t, count(z.edge) AS size, coalesce(sum(y.y), 0)::DOUBLE AS total
FROM range(1, 5) k(c) CROSS JOIN range(1, 31) g(t) LEFT JOIN z ON z.z = k.c LEFT JOIN y ON y.edge = z.edge AND y.t = g.t GROUP BY 1, 2""")
def cluster_stats(spark, sf):
    y = daily(spark, sf)
    z = y.select("edge").distinct().withColumn("z", (F.col("edge") % 3 + 1).cast("int"))
    return V.cluster_stats(y, z, 4, 30)


SCORED = f"""WITH {DAILY}, r AS (SELECT t, y, avg(y) OVER (PARTITION BY edge) + 0.1 AS lam FROM y), t AS (SELECT avg(abs(d)) AS total_mae FROM (SELECT sum(lam) - sum(y) AS d FROM r GROUP BY t))"""


@register(SCORED + """ SELECT round(avg(y * ln(lam) - lam - lgamma(y + 1)), 6) AS log_score, round(sqrt(avg(pow(lam - y, 2))), 6) AS rmse, round(avg(abs(lam - y)), 6) AS mae, round(avg(abs(lam - y)), 6) AS count_mae, round(any_value(total_mae), 6) AS total_mae FROM r, t""")
def poisson_scores(spark, sf):
    y = daily(spark, sf)
    mean = y.groupBy("edge").agg((F.avg("y") + 0.1).alias("lam"))
    out = V.fit_scores(y.join(mean, "edge"), "t", "y", "lam")
    return out.select(*(F.round(c, 6).alias(c) for c in ("log_score", "rmse", "mae", "count_mae", "total_mae")))


@register(f"""WITH {DAILY}, q AS (SELECT edge, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.9) AS b FROM y GROUP BY 1) SELECT round(avg((y.y BETWEEN a AND b)::INT), 6) AS coverage FROM y JOIN q ON q.edge = y.edge""")
def interval_coverage(spark, sf):
    y = daily(spark, sf)
    return y.join(quantiles(y, ["edge"], "y", (0.1, 0.9)), "edge").select("y", F.col("q")[0].alias("a"), F.col("q")[1].alias("b")).agg(F.round(V.coverage(None, "y", "a", "b"), 6).alias("coverage"))


@register("""SELECT p_partkey, round(density, 6) AS density, round(congestion, 6) AS congestion, round(rate, 6) AS rate, round(saturation, 6) AS saturation, round(storage, 6) AS storage, round(capacity_ratio, 6) AS capacity_ratio FROM (SELECT p_partkey, greatest(len, 1e-6) * 2 * 150 AS storage, x * 12 / 1800.0 AS capacity_ratio, x / (greatest(len, 1e-6) * 2) AS density, x / (greatest(len, 1e-6) * 2 * 150) AS congestion, x * 12 AS rate, x / greatest(cap, 1) AS saturation
FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 1000 AS len, p_size / 30.0 AS cap FROM part))""")
def flow_measures(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("len"), (F.col("p_size") / 30.0).alias("cap"), F.lit(2.0).alias("lanes"), F.lit(150.0).alias("jam"), F.lit(1800.0).alias("lc"))
    m = S.flow_measures("x", "len", "lanes", "jam", "lc", "cap")
    return p.select("p_partkey", *(F.round(m[k], 6).alias(k) for k in ("density", "congestion", "rate", "saturation", "storage", "capacity_ratio")))


@register("""SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 3000)), 4) AS mae, round(1 - sum(pow(l_extendedprice - l_quantity * 3000, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 3000)
    return V.regression_metrics(rows, "l_extendedprice", "p", ["l_returnflag"]).select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@register("""WITH d AS (SELECT user_id AS target, event_id % 3 AS source, value / 1000 AS l, value AS theta FROM events) SELECT target, source, round(avg(l) + 1e-9, 6) AS mean, round(quantile_cont(l, 0.025) + 1e-9, 6) AS lower, round(quantile_cont(l, 0.5) + 1e-9, 6) AS median, round(quantile_cont(l, 0.975) + 1e-9, 6) AS upper, round(avg(abs(theta)) + 1e-8, 5) AS abs_theta, avg(l) > 0.03 AS selected, target % 3 = source AS true_active,
CASE WHEN avg(l) > 0.03 AND target % 3 = source THEN 'TP' WHEN avg(l) > 0.03 THEN 'FP' WHEN target % 3 = source THEN 'FN' ELSE 'TN' END AS outcome FROM d GROUP BY 1, 2""")
def shrinkage_summary(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("target"), (F.col("event_id") % 3).alias("source"), (F.col("value") / 1000).alias("lambda"), F.col("value").alias("theta"))
    truth = d.select("target", (F.col("target") % 3).alias("source")).distinct().withColumn("true_active", F.lit(True))
    return V.shrinkage_summary(d, truth).select("target", "source", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "lower", "median", "upper")), F.round(F.col("abs_theta") + 1e-8, 5).alias("abs_theta"), "selected", "true_active", "outcome")


@register("""SELECT event_type, hour(ts)::INT AS hour, dayofweek(ts) IN (0, 6) AS weekend, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def hourly_profile(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour"), F.dayofweek("ts").isin(1, 7).alias("weekend"))
    return e.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count("*").alias("n"))


@register(f"""WITH {DAILY} SELECT t, sum(y) AS total FROM y GROUP BY t""")
def total_flow(spark, sf):
    return V.total_flow(daily(spark, sf), "t", "y")


@register(f"""WITH {DAILY} SELECT CASE WHEN t <= 20 THEN 'train' ELSE 'test' END AS split, ((t - 1) % 6 * 4)::INT AS hour, round(avg(y) + 1e-9, 6) AS mean, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90 FROM y GROUP BY 1, 2""")
def split_hour_profile(spark, sf):
    out = V.split_profile(daily(spark, sf), "t", "y", 20, 6)
    return out.select("split", "hour", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@register("""WITH m AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(v, 3), event_type)::INT AS label FROM m""")
def relabel_by_intensity(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 3).alias("v"))
    return V.relabel(m, ["user_id"], "event_type", "v").select("user_id", "event_type", "label")


@register("""SELECT unnest([round_even(x, 1) FOR x IN quantile_cont(value, [0.15, 0.30, 0.45, 0.60, 0.75, 0.90])]) AS brk, unnest(range(6))::INT AS i FROM events""")
def region_breaks(spark, sf):
    return R.color_breaks(table(spark, sf, "events"), "value").select(F.posexplode("breaks").alias("i", "brk"))


@register("""SELECT count(*) AS shown, count(value) FILTER (event_id % 5 <> 0) AS with_value, round(avg(value) FILTER (event_id % 5 <> 0), 6) AS mean FROM events WHERE event_type IN ('click', 'view') AND user_id = 7 AND contains(event_id::VARCHAR, '1')""")
def view_filter(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")).otherwise(F.lit(float("nan")))).withColumn("id", F.col("event_id").cast("string"))
    return R.view_mean(R.in_view(e, ("click", "view"), ("user_id", 7), ("id", "1"), "event_type"), "v").withColumn("mean", F.round("mean", 6))


@register("""WITH f AS (SELECT user_id, hour(ts)::INT AS h, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT user_id FROM events) SELECT s.user_id, '{"user_id":' || s.user_id || ',"values":[' || string_agg(CASE WHEN n IS NULL THEN 'null' ELSE n || '.0' END, ',' ORDER BY g.h) || ']}' AS payload FROM s CROSS JOIN range(24) g(h) LEFT JOIN f ON f.user_id = s.user_id AND f.h = g.h GROUP BY 1""")
def frames_payload(spark, sf):
    e = table(spark, sf, "events")
    f = e.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").cast("double").alias("n"))
    return R.frames_payload(e.select("user_id").distinct(), f, "user_id", "h", "n")


@register("""WITH f AS (SELECT day(ts)::INT AS h, user_id AS edge, avg(value) AS m, min(value) AS r FROM events GROUP BY 1, 2) SELECT h, edge, round(abs(m - r), 6) AS error FROM f""")
def forecast_error(spark, sf):
    f = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("h"), F.col("user_id").alias("edge")).agg(F.avg("value").alias("mean"), F.min("value").alias("rate"))
    return V.forecast_error(f.select("h", "edge", "mean"), f.select("h", "edge", "rate")).withColumn("error", F.round("error", 6))
