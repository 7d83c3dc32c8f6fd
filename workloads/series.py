"""Queries of the ordered operators, preparation, features and outliers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import features as ft, ordered as o, outliers as ol, prepare as pr
from tidemark.plans.supplier import supplier_features
from tidemark.series import Series
from workloads import fixtures as fx
from workloads.fixtures import ctes, table
from workloads.registry import flat, query

# One row per calendar day: short by construction, no measuring needed.
TYPE_DAY = Series.of(["event_type"], "d")
SEG_DAY = Series.of(["seg"], "d")
W = "OVER (PARTITION BY event_type ORDER BY d)"


@query("e1_lags", ctes("daily_events") + f"""
, x AS (SELECT event_type, d, lag(v, 1) {W} AS v_lag1, lag(v, 3) {W} AS v_lag3, lag(n, 2) {W} AS n_lag2, row_number() {W} AS rn FROM daily_events)
SELECT event_type, CAST(d AS VARCHAR) AS d, round(v_lag1, 6) AS v_lag1, round(v_lag3, 6) AS v_lag3, n_lag2 FROM x WHERE rn > 3""")
def e1(spark, sf):
    d = o.add_lags(fx.daily_events(spark, sf), TYPE_DAY, ["v", "n"], {"v": [1, 3], "n": [2]})
    return flat(d.select("event_type", "d", "v_lag1", "v_lag3", "n_lag2"))


@query("e1_lags_long_series", """
WITH x AS (SELECT event_id, lag(value, 1) OVER (ORDER BY ts) AS value_lag1, lag(value, 24) OVER (ORDER BY ts) AS value_lag24, row_number() OVER (ORDER BY ts) AS rn FROM events)
SELECT event_id, rn, value_lag1, value_lag24 FROM x WHERE rn > 24""")
def e1_long(spark, sf):
    """All events as one series without keys, in slices."""
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    s = Series.measure(e, (), "ts", rows=2_000)
    d = o.add_lags(o.number_rows(e, s, "rn"), s, ["value"], [1, 24])
    return flat(d.select("event_id", "rn", "value_lag1", "value_lag24"))


@query("e2_diffs", ctes("daily_events") + f"""
, x AS (SELECT event_type, d, v - lag(v, 1) {W} AS v_diff1, v - lag(v, 2) {W} AS v_diff2 FROM daily_events)
SELECT event_type, CAST(d AS VARCHAR) AS d, round(v_diff1, 6) AS v_diff1, round(v_diff2, 6) AS v_diff2 FROM x""")
def e2(spark, sf):
    d = o.add_diffs(fx.daily_events(spark, sf), TYPE_DAY, ["v"], [1, 2], dropna=False)
    return flat(d.select("event_type", "d", "v_diff1", "v_diff2"))


@query("e3_difference", ctes("market") + """
, x AS (SELECT d, target - lag(target) OVER (ORDER BY d) AS target, exo - lag(exo) OVER (ORDER BY d) AS exo, row_number() OVER (ORDER BY d) AS rn FROM market)
SELECT CAST(d AS VARCHAR) AS d, round(target, 6) AS target, round(exo, 6) AS exo FROM x WHERE rn > 1""")
def e3(spark, sf):
    d = fx.one_type(spark, sf, "purchase", "target").join(fx.one_type(spark, sf, "view", "exo"), "d")
    return flat(o.difference(d, Series.of((), "d"), ["target", "exo"]).select("d", "target", "exo"))


@query("e4_rolling_sum", ctes("segment_orders") + """
SELECT seg, CAST(d AS VARCHAR) AS d, lag(n, 1) OVER w + lag(n, 2) OVER w AS two FROM segment_orders WINDOW w AS (PARTITION BY seg ORDER BY d)""")
def e4(spark, sf):
    return flat(o.rolling_sum(fx.segment_orders(spark, sf), SEG_DAY, "n", 2, 1, "two").select("seg", "d", "two"))


@query("e5_trailing_mean", ctes("holed_events") + f"""
SELECT event_type, CAST(d AS VARCHAR) AS d, round((lag(v, 1) {W} + lag(v, 2) {W} + lag(v, 3) {W}) / 3, 6) AS m FROM holed_events""")
def e5(spark, sf):
    return flat(o.trailing_mean(fx.holed_events(spark, sf), TYPE_DAY, "v", 3, "m").select("event_type", "d", "m"))


@query("e6_fill", ctes("holed_events") + """
SELECT event_type, CAST(d AS VARCHAR) AS d, round(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v,
       round(first_value(a IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS a
FROM holed_events WINDOW w AS (PARTITION BY event_type ORDER BY d)""")
def e6(spark, sf):
    d = o.fill(fx.holed_events(spark, sf), TYPE_DAY, ["v"], "ffill")
    return flat(o.fill(d, TYPE_DAY, ["a"], "bfill").select("event_type", "d", "v", "a"))


@query("e6_fill_long_series", """
SELECT event_id, last_value(CASE WHEN event_id % 7 IN (0, 3, 4) THEN NULL ELSE value END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""")
def e6_long(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.when(~(F.col("event_id") % 7).isin(0, 3, 4), F.col("value")).alias("value"))
    return flat(o.fill(e, Series.measure(e, (), "ts", rows=2_000), ["value"], "ffill").select("event_id", "value"))


@query("e7_fill_values", ctes("holed_events") + """
SELECT CASE WHEN event_type = 'view' THEN 'Not Available' ELSE event_type END AS kind, CAST(d AS VARCHAR) AS d, round(coalesce(v, -1), 6) AS v, round(coalesce(a, 0), 6) AS a FROM holed_events""")
def e7(spark, sf):
    d = fx.holed_events(spark, sf).withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return flat(pr.fill_values(d, {"v": -1.0}).select("kind", "d", "v", "a"))


_SPLIT_DAYS = ("2024-01-19", "2024-01-25")
_SPLIT_CASE = "CASE WHEN d < DATE '2024-01-19' THEN 'train' WHEN d < DATE '2024-01-25' THEN 'val' ELSE 'test' END"


@query("e8_context", ctes("daily_events") + f"""
, x AS (SELECT event_type, d, n, {_SPLIT_CASE} AS split FROM daily_events),
v AS (SELECT event_type, d, n, 'val' AS split FROM x WHERE split = 'val' UNION ALL
      SELECT event_type, d, n, 'val' FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS b FROM x WHERE split = 'train') WHERE b <= 8),
t AS (SELECT event_type, d, n, 'test' AS split FROM x WHERE split = 'test' UNION ALL
      SELECT event_type, d, n, 'test' FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS b FROM v) WHERE b <= 8)
SELECT event_type, CAST(d AS VARCHAR) AS d, n, split FROM x WHERE split = 'train'
UNION ALL SELECT event_type, CAST(d AS VARCHAR), n, split FROM v UNION ALL SELECT event_type, CAST(d AS VARCHAR), n, split FROM t""")
def e8(spark, sf):
    d = pr.split(fx.daily_events(spark, sf), "d", *_SPLIT_DAYS)
    return flat(o.with_context(d, TYPE_DAY, 8).select("event_type", "d", "n", "split"))


@query("g2_gap_rows", ctes("segment_orders") + """
, r AS (SELECT seg, min(d) AS lo, max(d) AS hi FROM segment_orders GROUP BY 1)
SELECT seg, CAST(CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS d FROM r
EXCEPT SELECT seg, CAST(d AS VARCHAR) FROM segment_orders""")
def g2(spark, sf):
    return flat(pr.gap_rows(fx.segment_orders(spark, sf), SEG_DAY, "1 day"))


@query("h2_calendar_yesterday", ctes("daily_orders") + """
, x AS (SELECT d, n, isodow(d) - 1 AS weekday, month(d) AS month, year(d) AS year, lag(n) OVER (ORDER BY d) AS yesterday FROM daily_orders)
SELECT CAST(d AS VARCHAR) AS d, n AS orders, weekday, month, year, yesterday FROM x WHERE yesterday IS NOT NULL""")
def h2(spark, sf):
    d = fx.daily_orders(spark, sf).select("d", F.col("n").alias("orders"))
    return flat(supplier_features(d, Series.of((), "d"), "orders"))

# --- preparation

_GRID = ctes("segment_orders") + """
, r AS (SELECT seg, min(d) AS lo, max(d) AS hi FROM segment_orders GROUP BY 1),
g AS (SELECT seg, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM r),
x AS (SELECT g.seg, g.d, s.total, s.n, s.seg IS NULL AS fresh FROM g LEFT JOIN segment_orders s ON g.seg = s.seg AND g.d = s.d)"""


@query("i1_gap_fill", _GRID + """
SELECT seg, CAST(d AS VARCHAR) AS d, round(CASE WHEN fresh THEN last_value(total IGNORE NULLS) OVER (PARTITION BY seg ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       ELSE total END, 6) AS total, n FROM x""")
def i1(spark, sf):
    return flat(pr.fill_gaps(fx.segment_orders(spark, sf).drop("bal"), SEG_DAY, "total", "1 day", "ffill"))


@query("i1_gap_fill_constant", _GRID + " SELECT seg, CAST(d AS VARCHAR) AS d, coalesce(n, 0) AS n, round(total, 6) AS total FROM x")
def i1c(spark, sf):
    return flat(pr.fill_gaps(fx.segment_orders(spark, sf).drop("bal"), SEG_DAY, "n", "1 day", 0))


@query("i1_gap_fill_off_grid", """
WITH x AS (SELECT user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
r AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM x GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM r),
u AS (SELECT user_id, ts, value, false AS fresh FROM x UNION ALL
      SELECT user_id, ts, NULL, true FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = g.user_id AND x.ts = g.ts))
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
       CASE WHEN fresh THEN first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE value END AS value FROM u""")
def i1o(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    s = Series.measure(e, ["user_id"], "ts")
    return flat(pr.fill_gaps(e, s, "value", "1 hour", "bfill"))


_TIMELESS = """
WITH e AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey = (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = p.o_custkey)
                  THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, count(*) AS n FROM orders p GROUP BY 1, 2),
r AS (SELECT k, min(d) AS lo, max(d) AS hi FROM e GROUP BY 1 HAVING min(d) IS NOT NULL),
g AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 30 DAY)) AS DATE) AS d FROM r)
SELECT k, CAST(d AS VARCHAR) AS d, n FROM e UNION ALL
SELECT k, CAST(d AS VARCHAR), 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = g.k AND e.d = g.d)"""


def _timeless(spark, sf, slice_micros):
    p = table(spark, sf, "orders")
    first = F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    d = F.when(~((F.col("o_orderkey") % 5 == 0) & first), F.col("o_orderdate").cast("date"))
    e = p.select(F.col("o_custkey").alias("k"), d.alias("d")).groupBy("k", "d").agg(F.count(F.lit(1)).alias("n"))
    return flat(pr.fill_gaps(e, Series(("k",), "d", slice_micros), "n", "30 days", 0))


@query("i1_gap_fill_timeless_rows_all", _TIMELESS)
def i1ta(spark, sf):
    """Rows without a timestamp stay and bound no gap."""
    return _timeless(spark, sf, None)


@query("i1_gap_fill_timeless_rows_all_sliced", _TIMELESS)
def i1sa(spark, sf):
    return _timeless(spark, sf, 100 * 86_400_000_000)


@query("i2_split", ctes("daily_orders") + """
SELECT CAST(d AS VARCHAR) AS d, n, CASE WHEN d < DATE '1999-01-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS split FROM daily_orders""")
def i2(spark, sf):
    return flat(pr.split(fx.daily_orders(spark, sf), "d", "1999-01-01", "2000-06-01").select("d", "n", "split"))


@query("i3_default_dates", """
WITH r AS (SELECT user_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY 1)
SELECT e.event_id, CASE WHEN epoch_us(ts) < hi - (3 * (hi - lo)) // 10 THEN 'train' WHEN epoch_us(ts) < hi - (hi - lo) // 10 THEN 'val' ELSE 'test' END AS split
FROM events e JOIN r USING (user_id)""")
def i3(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return flat(pr.split_default(e, Series.of(["user_id"], "ts")).select("event_id", "split"))


@query("i3_default_dates_global", ctes("daily_orders") + """
, r AS (SELECT epoch_us(CAST(min(d) AS TIMESTAMP)) AS lo, epoch_us(CAST(max(d) AS TIMESTAMP)) AS hi FROM daily_orders),
x AS (SELECT epoch_us(CAST(d AS TIMESTAMP)) AS t, n, lo, hi FROM daily_orders, r)
SELECT CASE WHEN t < hi - (3 * (hi - lo)) // 10 THEN 'train' WHEN t < hi - (hi - lo) // 10 THEN 'val' ELSE 'test' END AS split, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1""")
def i3g(spark, sf):
    d = pr.split_default(fx.daily_orders(spark, sf), Series.of((), "d"))
    return flat(d.groupBy("split").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n")))


@query("i4_impute_fill", ctes("holed_events") + f"""
, x AS (SELECT *, {_SPLIT_CASE} AS split FROM holed_events)
SELECT event_type, CAST(d AS VARCHAR) AS d, split, round(v, 6) AS v,
       round(last_value(a IGNORE NULLS) OVER (PARTITION BY event_type, split ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS a FROM x""")
def i4(spark, sf):
    d = pr.split(fx.holed_events(spark, sf), "d", *_SPLIT_DAYS)
    return flat(pr.impute(d, "ffill", TYPE_DAY, "v").select("event_type", "d", "split", "v", "a"))


@query("i5_impute_mean", ctes("holed_events") + f"""
, x AS (SELECT *, {_SPLIT_CASE} AS split FROM holed_events), m AS (SELECT avg(v) AS mv, avg(a) AS ma FROM x WHERE split = 'train')
SELECT event_type, CAST(d AS VARCHAR) AS d, split, round(coalesce(v, mv), 6) AS v, round(coalesce(a, ma), 6) AS a FROM x, m""")
def i5(spark, sf):
    d = pr.split(fx.holed_events(spark, sf), "d", *_SPLIT_DAYS)
    return flat(pr.impute(d, "mean", TYPE_DAY, "v", ["v", "a"]).select("event_type", "d", "split", "v", "a"))


@query("i6_impute_one_column", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS p,
                  CASE WHEN l_shipdate < DATE '2000-01-01' THEN 'train' WHEN l_shipdate < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM lineitem),
m AS (SELECT avg(p) AS mp, avg(q) AS mq FROM x WHERE split = 'train'),
s AS (SELECT count(*) AS n, sum(q - mq) AS sx, sum(p - mp) AS sy, sum((q - mq) * (q - mq)) AS sxx, sum((q - mq) * (p - mp)) AS sxy
      FROM x, m WHERE split = 'train' AND p IS NOT NULL),
w AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 1e-3) AS w, n, sx, sy FROM s)
SELECT l_orderkey, l_linenumber, split, round(coalesce(p, mp + (sy - w * sx) / n + w * (q - mq)), 4) AS price, round(q, 4) AS quantity FROM x, m, w""")
def i6o(spark, sf):
    """One column with holes: the chained regressions are a single one."""
    li = table(spark, sf, "lineitem").withColumns({
        "price": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")), "quantity": F.col("l_quantity")})
    d = pr.split(li, "l_shipdate", "2000-01-01", "2001-01-01").select("l_orderkey", "l_linenumber", "split", "price", "quantity")
    return flat(pr.impute(d, "iterative", Series.of((), "l_shipdate"), "price", ["price", "quantity"]), 4)


@query("i6_impute_chained")
def i6(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "price": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")),
        "quantity": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity"))})
    d = pr.split(li, "l_shipdate", "2000-01-01", "2001-01-01").select("l_orderkey", "l_linenumber", "split", "price", "quantity", "l_discount")
    return flat(pr.impute(d, "iterative", Series.of((), "l_shipdate"), "price", ["price", "quantity", "l_discount"]))


@query("i7_sequences", ctes("daily_events") + """
, x AS (SELECT event_type, d, v, n, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i FROM daily_events)
SELECT a.event_type, a.i, a.n AS target, CAST(round(sum(b.v * (b.i + 1)), 4) AS DOUBLE) AS weighted, count(*) AS steps, min(b.i) AS first
FROM x a JOIN x b ON a.event_type = b.event_type AND b.i BETWEEN a.i - 6 AND a.i - 1 AND (b.i - (a.i - 6)) % 2 = 0
WHERE a.i >= 6 AND (a.i - 6) % 3 = 0 GROUP BY 1, 2, 3""")
def i7(spark, sf):
    d = pr.to_sequences(fx.daily_events(spark, sf), TYPE_DAY, ["v", "n"], "n", 6, 2, 3)
    # A checkable summary: each step weighted by its own position.
    pos = d.withColumn("first", F.col("i") - 6)
    value = F.aggregate(F.transform("seq", lambda e, k: e[0] * (F.col("first") + k * 2 + 1)), F.lit(0.0), lambda a, b: a + b)
    return flat(pos.select("event_type", "i", F.col("target").cast("long").alias("target"), value.alias("weighted"),
                           F.size("seq").alias("steps"), "first"), 4)

# --- features


@query("j1_features_per_split", ctes("daily_events") + f"""
, x AS (SELECT *, {_SPLIT_CASE} AS split FROM daily_events), y AS (
SELECT event_type, split, d, lag(v, 1) OVER w AS v_lag1, lag(v, 2) OVER w AS v_lag2, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY event_type, split ORDER BY d))
SELECT event_type, split, CAST(d AS VARCHAR) AS d, round(v_lag1, 6) AS v_lag1, round(v_lag2, 6) AS v_lag2 FROM y WHERE rn > 2""")
def j1(spark, sf):
    d = pr.split(fx.daily_events(spark, sf), "d", *_SPLIT_DAYS)
    hook = lambda params, x, s: o.add_lags(x, s, ["v"], params["lags"])
    return flat(ft.apply_features(d, TYPE_DAY, hook, {"lags": [1, 2]}).select("event_type", "split", "d", "v_lag1", "v_lag2"))


_CATEGORICAL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, p_type, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag, p_brand,
           CASE WHEN l_shipdate < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def categorical(spark, sf, *more):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "p_type", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("flag"),
                    "p_brand", F.when(F.col("l_shipdate") < "2000-01-01", "train").otherwise("test").alias("split"), *more)


@query("j2_one_hot", _CATEGORICAL + """
SELECT l_orderkey, l_linenumber, l_partkey, split,
       CASE WHEN flag = 'A' THEN 1.0::DOUBLE ELSE 0 END AS "flag_A", CASE WHEN flag = 'N' THEN 1.0::DOUBLE ELSE 0 END AS "flag_N",
       CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS "flag_R", CASE WHEN flag IS NULL THEN 1.0::DOUBLE ELSE 0 END AS "flag_None" FROM x""")
def j2(spark, sf):
    d = categorical(spark, sf).drop("p_brand", "p_type")
    return flat(ft.one_hot(d, ["flag"], 0.02))


@query("j2_one_hot_infrequent", _CATEGORICAL + """
, t AS (SELECT p_brand, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1), m AS (SELECT sum(n) AS total FROM t)
SELECT split, count(*) AS n, CAST(sum(CASE WHEN x.p_brand IN (SELECT p_brand FROM t, m WHERE t.n < 0.04 * total) THEN 1 ELSE 0 END) AS BIGINT) AS rare,
       (SELECT count(*) FROM t, m WHERE t.n >= 0.04 * total) AS columns FROM x GROUP BY 1""")
def j2i(spark, sf):
    d = categorical(spark, sf).select("split", "p_brand")
    enc = ft.OneHot.fit(d, ["p_brand"], 0.04)
    names = [n for n in enc.names() if not n.endswith(ft.INFREQUENT)]
    out = enc.transform(d)
    rare = F.sum(f"p_brand_{ft.INFREQUENT}") if enc.rare else F.lit(0)
    return flat(out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), rare.cast("long").alias("rare"), F.lit(len(names)).alias("columns")))


_RARE_MISSING = """
WITH x AS (SELECT CASE WHEN o_custkey % 50 = 7 THEN NULL ELSE 'c' || o_custkey END AS c FROM orders),
t AS (SELECT c, count(*) AS n FROM x GROUP BY 1), m AS (SELECT sum(n) AS total FROM t)
SELECT CAST(sum(CASE WHEN n < 0.03 * total THEN n ELSE 0 END) AS BIGINT) AS rare,
       CAST(sum(CASE WHEN n < 0.03 * total AND c IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing FROM t, m"""


def _rare_missing(spark, sf, max_listed):
    c = F.when(F.col("o_custkey") % 50 != 7, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    d = table(spark, sf, "orders").select(c.alias("c"), c.isNull().cast("int").alias("gone"))
    hit = F.col(f"c_{ft.INFREQUENT}")
    out = ft.OneHot.fit(d, ["c"], 0.03, max_listed=max_listed).transform(d)
    return flat(out.agg(F.sum(hit).cast("long").alias("rare"), F.sum(hit * F.col("gone")).cast("long").alias("missing")))


@query("j2_one_hot_rare_missing", _RARE_MISSING)
def j2m(spark, sf):
    return _rare_missing(spark, sf, 10**9)


@query("j2_one_hot_rare_missing_unlisted", _RARE_MISSING)
def j2u(spark, sf):
    """The path for more rare values than are listed."""
    return _rare_missing(spark, sf, 5)


@query("j3_min_max", """
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem WHERE l_shipdate < DATE '2000-01-01')
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (e - c), 6) AS l_extendedprice FROM lineitem, r""")
def j3(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("split", F.when(F.col("l_shipdate") < "2000-01-01", "train").otherwise("test"))
    d = ft.scale(d, ["l_quantity", "l_extendedprice"])
    return flat(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))


@query("j5_scale_sequences", ctes("daily_events") + """
, x AS (SELECT event_type, d, v, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS len FROM daily_events),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM x WHERE i < len - 1)
SELECT a.event_type, a.i, round(sum((b.v - lo) / (hi - lo)), 6) AS total, round(max((b.v - lo) / (hi - lo)), 6) AS top
FROM x a JOIN x b ON a.event_type = b.event_type AND b.i BETWEEN a.i - 4 AND a.i - 1, r WHERE a.i >= 4 GROUP BY 1, 2""")
def j5(spark, sf):
    d = pr.to_sequences(fx.daily_events(spark, sf), TYPE_DAY, ["v"], "v", 4)
    d = ft.scale_sequences(d)[0].withColumn("seq", F.flatten("seq"))
    return flat(d.select("event_type", "i", F.aggregate("seq", F.lit(0.0), lambda a, b: a + b).alias("total"), F.array_max("seq").alias("top")))

# --- outliers

_PLANTED = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, l_extendedprice * CASE WHEN l_orderkey % 97 = 0 THEN 50 ELSE 1 END AS price FROM lineitem)"""


def planted(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount",
        (F.col("l_extendedprice") * F.when(F.col("l_orderkey") % 97 == 0, 50).otherwise(1)).alias("price"))


@query("j6_boxplot_limits", _PLANTED + """
, q AS (SELECT l_returnflag, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM x GROUP BY 1)
SELECT l_returnflag, round(a - 1.5 * (b - a), 4) AS lower, round(b + 1.5 * (b - a), 4) AS upper FROM q""")
def j6(spark, sf):
    return flat(ol.boxplot_limits(planted(spark, sf), ["l_returnflag"], "price"), 4)


@query("j6_boxplot_limits_large_groups", _PLANTED + """
, q AS (SELECT l_returnflag, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM x GROUP BY 1)
SELECT l_returnflag, round(a - 1.5 * (b - a), 4) AS lower, round(b + 1.5 * (b - a), 4) AS upper FROM q""")
def j6l(spark, sf):
    """The path for groups too large for one task, forced by a low limit."""
    q = ol.exact_quantiles(planted(spark, sf), ["l_returnflag"], "price", (0.25, 0.75), group_rows=1_000, accuracy=500)
    iqr = F.col("q")[1] - F.col("q")[0]
    return flat(q.select("l_returnflag", (F.col("q")[0] - 1.5 * iqr).alias("lower"), (F.col("q")[1] + 1.5 * iqr).alias("upper")), 4)


_MIXED = """
WITH x AS (SELECT CASE WHEN l_orderkey % 4 <> 0 THEN 0 ELSE l_orderkey % 600 END AS g, l_extendedprice AS price FROM lineitem),
q AS (SELECT g, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM x GROUP BY 1)
SELECT g, round(a - 1.5 * (b - a), 6) AS lower, round(b + 1.5 * (b - a), 6) AS upper FROM q"""


@query("j6_boxplot_limits_mixed_groups", _MIXED)
def j6m(spark, sf):
    """A group over the limit beside many small ones, at the default accuracy."""
    g = F.when(F.col("l_orderkey") % 4 != 0, 0).otherwise(F.col("l_orderkey") % 600).alias("g")
    d = table(spark, sf, "lineitem").select(g, F.col("l_extendedprice").alias("price"))
    return flat(ol.boxplot_limits(d, ["g"], "price", group_rows=1_000), 6)


@query("j7_remove_boxplot", _PLANTED + """
, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(price, 4) AS price FROM x, q WHERE price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def j7(spark, sf):
    return flat(ol.remove_outliers(planted(spark, sf), "boxplot", ["price"]).select("l_orderkey", "l_linenumber", "l_partkey", "price"), 4)


@query("j7_remove_zscore", _PLANTED + """
, q AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(price, 4) AS price FROM x, q WHERE NOT abs(price - m) > 3 * s""")
def j7z(spark, sf):
    return flat(ol.remove_outliers(planted(spark, sf), "zscore", ["price"]).select("l_orderkey", "l_linenumber", "l_partkey", "price"), 4)


@query("j8_isolation_forest")
def j8(spark, sf):
    d = planted(spark, sf)
    return flat(ol.remove_outliers(d, "isolationforest", ["price", "l_quantity", "l_discount"],
                                   id_cols=["l_orderkey", "l_linenumber", "l_partkey"]), 4)


@query("j8_planted_recall", _PLANTED + """
, m AS (SELECT max(price) AS most FROM x WHERE l_orderkey % 97 <> 0)
SELECT l_returnflag, count(*) AS planted, count(*) AS found FROM x, m WHERE price > most GROUP BY 1""")
def j8r(spark, sf):
    """Every row whose planted price is above all others is told apart."""
    d = planted(spark, sf)
    most = d.filter(F.col("l_orderkey") % 97 != 0).select(F.max("price").alias("most"))
    marked = ol.flag_outliers(d, "isolationforest", ["price"], id_cols=["l_orderkey", "l_linenumber", "l_partkey"])
    far = marked.filter(F.col("price") > most.scalar())
    return flat(far.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("planted"), F.count_if("is_outlier").alias("found")))


@query("j9_flag_outliers", _PLANTED + """
, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(l_quantity, 0.25) AS c, quantile_cont(l_quantity, 0.75) AS e FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) OR l_quantity < c - 1.5 * (e - c) OR l_quantity > e + 1.5 * (e - c) AS BIGINT) AS is_outlier FROM x, q""")
def j9(spark, sf):
    return flat(ol.flag_outliers(planted(spark, sf), "boxplot", ["price", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "is_outlier"))
