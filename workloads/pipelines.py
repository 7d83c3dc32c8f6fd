"""Queries of whole pipelines and of the hooks users plug in."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_features
from tidemark.operators import clean, features as ft, linear as ln, metrics as mt, ordered as o, prepare as pr
from tidemark.plans import contact as pc, market as pm, shipments as ps
from tidemark.plans.experiment import Experiment, search_pipelines
from tidemark.plans.supplier import supplier_features
from tidemark.series import Series
from tidemark.session import shared_dir
from tidemark.sources.store import Store
from workloads import fixtures as fx
from workloads.fixtures import ctes, table
from workloads.registry import flat, query
from workloads.tables import contact_tables

DAY = Series.of((), "d")

_HALVES = """
, h AS (SELECT week, coalesce(sum(CASE WHEN isodow(date) - 1 NOT IN (3, 4, 5) THEN {c} END), 0)::DOUBLE AS early,
        coalesce(sum(CASE WHEN isodow(date) - 1 IN (3, 4, 5) THEN {c} END), 0)::DOUBLE AS late FROM contact GROUP BY 1),
g AS (SELECT *, early + late AS tot, late / (early + late) AS perc FROM h),
{out} AS (SELECT *, (lag(perc, 1) OVER w + lag(perc, 2) OVER w) / 2 AS avg_perc,
        round_even(early / nullif(1 - (lag(perc, 1) OVER w + lag(perc, 2) OVER w) / 2, 0), 0) AS est FROM g WINDOW w AS (ORDER BY week))"""


@query("p1_partial_week", ctes("contact") + _HALVES.format(c="presentedVolume", out="e") + """
SELECT CAST(week AS VARCHAR) AS week, tot AS "presentedVolume", est AS "est_presentedVolume", early, late, round(perc, 6) AS perc, round(avg_perc, 6) AS avg_perc FROM e""")
def p1(spark, sf):
    return flat(pc.partial_week(clean.day_group(fx.contact(spark, sf), "date"), [], "presentedVolume", details=True))


_HOLIDAY_SUMS = ", ".join(
    f"sum(CASE WHEN holiday_us = '{v}' THEN 1 ELSE 0 END)::BIGINT AS {k}" for k, v in pc.HOLIDAY_FLAGS.items())


@query("p2_contact_features", ctes("contact") + _HALVES.format(c="presentedVolume", out="v")
       + _HALVES.format(c="cnt_orders", out="c").replace("h AS", "h2 AS").replace("FROM h)", "FROM h2)").replace("g AS", "g2 AS").replace("FROM g ", "FROM g2 ") + f"""
, f AS (SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week, round(sum(o_totalprice), 2) / 1e6 AS fc FROM orders GROUP BY 1),
hol AS (SELECT week, {_HOLIDAY_SUMS}, sum(CASE WHEN holiday_us IN ('Thanksgiving Day', 'Christmas Eve') THEN 1 ELSE 0 END)::BIGINT AS thanksgiving_christmas FROM contact GROUP BY 1),
j AS (SELECT v.week, v.tot AS presentedVolume, v.est AS ev, c.tot AS ct, c.est AS ec, pow(fc, 1.5) AS tot_na_fcst FROM v JOIN f ON v.week = f.week JOIN c ON v.week = c.week),
k AS (SELECT week, presentedVolume, tot_na_fcst, (lag(presentedVolume, 2) OVER w + lag(presentedVolume, 3) OVER w + lag(ev, 1) OVER w) / 3 AS exp_mov_avg,
      (lag(ct, 2) OVER w + lag(ct, 3) OVER w + lag(ec, 1) OVER w) / 3 AS exp_ma_orders, lag(ec, 1) OVER w AS exp_cnt_orders_lag1 FROM j WINDOW w AS (ORDER BY week))
SELECT CAST(k.week AS VARCHAR) AS week, presentedVolume AS "presentedVolume", round(exp_mov_avg, 6) AS exp_mov_avg, round(exp_ma_orders, 6) AS exp_ma_orders,
       round(tot_na_fcst, 6) AS tot_na_fcst, exp_cnt_orders_lag1, holiday_wf, memo_day, bf_july, july_4, thanksgiving, cyber_monday, thanksgiving_christmas, christmas_eve,
       new_years_eve, new_year FROM k JOIN hol ON k.week = hol.week
WHERE exp_mov_avg IS NOT NULL AND exp_ma_orders IS NOT NULL AND exp_cnt_orders_lag1 IS NOT NULL""")
def p2(spark, sf):
    return flat(pc.contact_features(fx.contact(spark, sf), fx.contact_forecast(spark, sf), 1.5))


@query("p3_daily_contacts", ctes("contact") + """
, presented AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber % 2 = o_orderkey % 2
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND l_shipdate >= DATE '1996-01-07' AND l_shipdate < DATE '2001-03-07' GROUP BY 1),
cb AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_orderkey % 3) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
bb AS (SELECT CAST(ts - INTERVAL 25 YEAR AS DATE) AS d, count(DISTINCT user_id) AS n FROM events
    WHERE event_type = 'error' AND event_id % 3 = 0 AND ts - INTERVAL 25 YEAR >= DATE '1996-01-07' AND ts - INTERVAL 25 YEAR < DATE '1999-01-22' GROUP BY 1),
vol AS (SELECT p.d, CASE WHEN p.d - CAST(dayofweek(p.d) AS INTEGER) <= DATE '1998-08-23' THEN round((q - coalesce(cb.n, 0) - coalesce(bb.n, 0)) * 0.97)
    ELSE q - coalesce(cb.n, 0) - coalesce(bb.n, 0) END AS volume FROM presented p LEFT JOIN cb ON p.d = cb.d LEFT JOIN bb ON p.d = bb.d),
ord AS (SELECT CAST(o_orderdate AS DATE) AS d, count(DISTINCT o_orderkey) AS n FROM orders
    WHERE o_custkey % 4 IN (0, 1, 2) AND (o_orderkey % 7 = 0 OR o_orderkey % 5 <> 0) AND o_orderdate >= DATE '1996-01-07' AND o_orderdate < DATE '2001-03-07' GROUP BY 1),
cl AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority = '1-URGENT' AS fresh, count(DISTINCT o_orderkey) AS n FROM orders
    WHERE o_orderkey % 13 <> 0 AND o_orderstatus <> 'P' AND o_custkey % 4 IN (0, 1, 2) AND o_orderdate >= DATE '1996-01-07' AND o_orderdate < DATE '2001-03-07' GROUP BY 1, 2),
sh AS (SELECT d, sum(CASE WHEN fresh THEN n END) / sum(n) AS s FROM cl GROUP BY 1),
us AS (SELECT DISTINCT date AS d, holiday_us AS name FROM contact WHERE holiday_us IS NOT NULL),
ca AS (SELECT DISTINCT date AS d, holiday_ca AS name FROM contact WHERE holiday_ca IS NOT NULL),
al AS (SELECT coalesce(vol.d, us.d) AS d, volume, ord.n AS orders, s, us.name AS us FROM vol LEFT JOIN ord ON vol.d = ord.d LEFT JOIN sh ON vol.d = sh.d FULL JOIN us ON vol.d = us.d),
fin AS (SELECT coalesce(al.d, ca.d) AS d, volume, orders, s, us, ca.name AS ca FROM al FULL JOIN ca ON al.d = ca.d)
SELECT CAST(d - CAST(dayofweek(d) AS INTEGER) AS VARCHAR) AS week, CAST(d AS VARCHAR) AS date, volume, orders, round(s, 6) AS new_share, us AS us_holiday, ca AS ca_holiday
FROM fin WHERE d - CAST(dayofweek(d) AS INTEGER) < DATE '2001-03-04' + 14 AND d - CAST(dayofweek(d) AS INTEGER) > DATE '1996-01-01'""")
def p3(spark, sf):
    return flat(pc.daily_contacts(contact_tables(spark, sf), as_of="2001-03-07", report="ASIA", callback_report="NA Frontline", since="1996-01-07",
                                  b2b_until="1999-01-21", level_cut="1998-08-23", weeks_after="1996-01-01"))


def shipment_tables(spark, sf):
    """The mapped sources of the shipment arrivals."""
    o, li, sup, part = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier", "part"))
    key, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    return {
        "purchase_orders": o.select(key.alias("spoid"), F.when(key % 11 == 0, key - 1).otherwise(key).alias("parentid"), (key % 100).alias("warehouseid"),
                                    F.col("o_orderdate").alias("created"), (key % 2 == 0).alias("own_account"), (key % 13 == 0).alias("cancelled"), pri.alias("levelid")),
        "items": li.select(F.col("l_orderkey").alias("spoid"), F.col("l_partkey").alias("productid"), (F.col("l_quantity") - 5).alias("qty"), (F.col("l_suppkey") % 45).alias("reasonid")),
        "levels": o.select(pri.alias("levelid")).distinct().filter("levelid <> '5-LOW'").withColumn("levelcode", F.when(F.col("levelid") == "2-HIGH", "ACI").otherwise(F.upper("levelid"))),
        "products": part.select(F.col("p_partkey").alias("productid"), (F.col("p_partkey") + 7).alias("partid")),
        "cartons": part.select((F.col("p_partkey") + 7).alias("partid"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("cartontype")),
        "warehouses": sup.select((F.col("s_suppkey")).alias("warehouseid"), F.col("s_name").alias("warehousename"), F.when(F.col("s_nationkey") % 3 == 0, 6).when(F.col("s_nationkey") % 3 == 1, 1).otherwise(2).alias("storetype"),
                                 (F.col("s_nationkey") % 2 == 0).alias("breakbulk"), (F.col("s_nationkey") % 5 == 0).alias("spo_enabled")),
        "report": li.select(F.col("l_orderkey").alias("spoid"), F.col("l_shipdate").alias("arrivaldate"), F.col("l_quantity").alias("qty"), F.when(F.col("l_returnflag") == "A", "ISC").otherwise("other").alias("element")),
        "journey": li.select(F.col("l_orderkey").alias("spoid"), F.concat(F.lit("CFS"), (F.col("l_suppkey") % 5).cast("string")).alias("CFSLocation"), F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("Origin"),
                             F.concat(F.lit("D"), (F.col("l_suppkey") % 3).cast("string")).alias("Destination"), *[(F.col("l_shipdate") + F.make_dt_interval(F.lit(k))).alias(c) for k, c in enumerate(ps.EVENTS[:6])]),
    }


_JOURNEY = ", ".join([f"min(l_shipdate) AS {ps.EVENTS[0]}"] + [f"max(l_shipdate) + to_days({k}) AS {c}" for k, c in enumerate(ps.EVENTS[:6]) if k])
_TYPES = ", ".join([f"sum(CASE WHEN t = {k} THEN q ELSE 0 END) AS Type_{k}_Units" for k in ps.CARTON_TYPES] + ["sum(CASE WHEN t IS NULL THEN q ELSE 0 END) AS No_Type_Units"])
_HEAD = "spo, servicelevel, wh, name, created, breakbulk"


@query("p4_shipment_arrivals", f"""
WITH po AS (SELECT o_orderkey AS spo, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS parent, o_orderkey % 100 AS wh, o_orderdate AS created,
    o_orderkey % 2 = 0 AS own, o_orderkey % 13 = 0 AS cancelled, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN 'ACI' ELSE upper(o_orderpriority) END AS code FROM orders),
w AS (SELECT s_suppkey AS wh, s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 1 ELSE 2 END AS st, s_nationkey % 2 = 0 AS breakbulk, s_nationkey % 5 = 0 AS enabled FROM supplier),
li AS (SELECT l_orderkey AS spo, l_quantity - 5 AS q, l_suppkey % 45 AS reason, nullif(p_size % 5, 0) AS t FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
x AS (SELECT li.spo, q, reason, t, parent, po.wh, created, cancelled, code, name, st, breakbulk, enabled,
    CASE WHEN reason IN (2, 3, 4, 10, 12, 33, 34, 36, 13, 24, 26, 28, 30, 38) AND own THEN 'Freight Collect Stocking Domestic'
         WHEN reason IN (2, 3, 4, 10, 12, 33, 34, 36, 13, 24, 26, 28, 30, 38) AND NOT own THEN 'Non Freight Collect Stocking Domestic'
         WHEN reason = 40 AND own THEN 'Freight Collect CG Domestic' WHEN reason = 40 AND NOT own THEN 'Non Freight Collect CG Domestic'
         WHEN reason = 23 THEN 'Warehouse Transfer' ELSE code END AS servicelevel
    FROM li JOIN po ON li.spo = po.spo LEFT JOIN w ON po.wh = w.wh),
ar AS (SELECT l_orderkey AS spo, min(l_shipdate) AS arrivaldate, sum(l_quantity) AS arrived FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
jo AS (SELECT l_orderkey AS spo, max('CFS' || (l_suppkey % 5)) AS CFSLocation, max('P' || l_linenumber) AS OriginPortCode, max('D' || (l_suppkey % 3)) AS DestinationPortCode, {_JOURNEY} FROM lineitem GROUP BY 1),
a AS (SELECT {", ".join("x." + c.strip() for c in _HEAD.split(","))}, min(ar.arrivaldate) AS arrivaldate, coalesce(max(arrived), sum(q)) AS Total_units, {_TYPES} FROM x JOIN ar ON x.spo = ar.spo
    WHERE x.spo = parent AND NOT cancelled AND (code <> 'ACI' OR code IS NULL) AND created > DATE '1999-06-01' AND st IN (1, 6) AND (enabled OR breakbulk)
      AND (reason IN (2, 3, 4, 10, 12, 33, 34, 36, 13, 24, 26, 28, 30, 38, 40, 23) OR code IS NOT NULL) AND q > 0 GROUP BY ALL),
b AS (SELECT {", ".join("x." + c.strip() for c in _HEAD.split(","))}, min(ar.arrivaldate) AS arrivaldate, max(arrived) AS Total_units, {_TYPES} FROM x JOIN ar ON x.spo = ar.spo
    WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.spo = x.spo) GROUP BY ALL),
u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT u.spo AS spoid, servicelevel, u.wh AS "Original_WH", name AS "Original_WH_Name", CFSLocation, OriginPortCode, DestinationPortCode,
       {", ".join(f"strftime({c}, '%Y-%m-%d') AS {a}" for c, a in [("created", "DateEntered"), ("arrivaldate", "arrivaldate"), *[(e, e) for e in ps.EVENTS[:6]]])},
       CAST(breakbulk AS BIGINT) AS breakbulk, Total_units AS "Total_units", Type_1_Units, Type_2_Units, Type_3_Units, Type_4_Units, No_Type_Units FROM u LEFT JOIN jo ON u.spo = jo.spo""")
def p4(spark, sf):
    d = ps.shipment_arrivals(shipment_tables(spark, sf), as_of="2001-06-01")
    return flat(clean.to_dates(d, ["DateEntered", "arrivaldate", *ps.EVENTS[:6]]))


@query("p5_market_features", ctes("market") + """
, a AS (SELECT d, target - lag(target) OVER (ORDER BY d) AS t, exo - lag(exo) OVER (ORDER BY d) AS e, row_number() OVER (ORDER BY d) AS rn FROM market),
b AS (SELECT d, t, day(d) AS day, isodow(d) - 1 AS dayofweek, weekofyear(d) AS week, month(d) AS month, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2, lag(t, 3) OVER w AS t3,
      lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, row_number() OVER w AS rn FROM a WHERE rn > 1 WINDOW w AS (ORDER BY d)),
c AS (SELECT *, """ + ", ".join(f"{c} - lag({c}, {k}) OVER w AS {c}d{k}" for c in ("t1", "t2", "t3", "e1", "e2") for k in (1, 2)) + """, row_number() OVER w AS r2 FROM b WHERE rn > 3 WINDOW w AS (ORDER BY d))
SELECT CAST(d AS VARCHAR) AS d, round(t, 6) AS target, day, dayofweek, week, month, """ + ", ".join(
    [f"round({c}, 6) AS {n}_lag{c[1]}" for c, n in (("t1", "target"), ("t2", "target"), ("t3", "target"), ("e1", "exo"), ("e2", "exo"))]
    + [f"round({c}d{k}, 6) AS {n}_lag{c[1]}_diff{k}" for c, n in (("t1", "target"), ("t2", "target"), ("t3", "target"), ("e1", "exo"), ("e2", "exo")) for k in (1, 2)])
       + " FROM c WHERE r2 > 2")
def p5(spark, sf):
    d = pm.market_changes(fx.one_type(spark, sf, "purchase", "target"), fx.one_type(spark, sf, "view", "exo"), DAY, ["target", "exo"])
    return flat(pm.market_features(d, DAY, "target", "exo"))


@query("p6_logistics_rows", ctes("shipments") + """
SELECT SPOID AS "SpoID", line, servicelevel AS "ServiceLevel", CAST(Original_WH AS VARCHAR) AS "WarehouseId", trim(Original_WH_Name) AS "DestinationWarehouse", trim(CFSLocation) AS "CFSLocation",
       trim(OriginPortCode) AS "Origin", CAST(CAST(arrivaldate AS DATE) AS VARCHAR) AS "CompletedTime", Total_units AS "SpiQty",
       date_diff('day', CAST(GateOutDestinationPort AS DATE), CAST(arrivaldate AS DATE)) AS destination_port_to_fc FROM shipments
WHERE Total_units > 0 AND servicelevel IN ('ACN', 'ACI', 'NVO', 'BCO', 'DRA')""")
def p6r(spark, sf):
    d = ps.tidy_shipments(fx.shipments(spark, sf))
    return flat(d.select("SpoID", "line", "ServiceLevel", "WarehouseId", "DestinationWarehouse", "CFSLocation", "Origin", "CompletedTime", "SpiQty", "destination_port_to_fc"))


@query("p6_logistics_daily_units", ctes("shipments") + """
SELECT CAST(CAST(arrivaldate AS DATE) AS VARCHAR) AS date, sum(Total_units) AS units FROM shipments
WHERE Total_units > 0 AND servicelevel IN ('ACN', 'ACI', 'NVO', 'BCO', 'DRA') GROUP BY 1""")
def p6(spark, sf):
    return flat(ps.daily_units(ps.tidy_shipments(fx.shipments(spark, sf))))


@query("p7_supplier_features", """
WITH s AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, lag(orders) OVER (PARTITION BY l_suppkey ORDER BY d) AS yesterday FROM s)
SELECT l_suppkey, CAST(d AS VARCHAR) AS d, orders, isodow(d) - 1 AS weekday, month(d) AS month, year(d) AS year, yesterday FROM x WHERE yesterday IS NOT NULL""")
def p7(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.count_distinct("l_orderkey").alias("orders"))
    return flat(supplier_features(d, Series.of(["l_suppkey"], "d")))

# --- hooks and plugged-in estimators


@query("u2_preprocessing_hook", ctes("daily_orders") + """
, x AS (SELECT d, pow(total, 2) AS total, n FROM daily_orders WHERE n > 1)
SELECT CAST(d AS VARCHAR) AS d, round(total, 6) AS total, CASE WHEN d < DATE '1999-01-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS split FROM x""")
def u2(spark, sf):
    hook = lambda params, df, s: clean.power(df.filter("n > 1"), "total", params["power"])
    d = hook({"power": 2.0}, fx.daily_orders(spark, sf), DAY)
    return flat(pr.split(d, "d", "1999-01-01", "2000-06-01").select("d", "total", "split"))


@query("u3_feature_hook", ctes("segment_orders") + """
, x AS (SELECT *, CASE WHEN d < DATE '1999-06-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS split FROM segment_orders),
y AS (SELECT *, lag(n) OVER (PARTITION BY seg, split ORDER BY d) AS n_lag1 FROM x)
SELECT seg, split, count(*) AS rows, CAST(sum(n_lag1) AS BIGINT) AS lagged, CAST(sum(isodow(d) - 1) AS BIGINT) AS weekdays FROM y WHERE n_lag1 IS NOT NULL GROUP BY 1, 2""")
def u3(spark, sf):
    hook = lambda params, x, s: o.add_lags(calendar_features(x, s.ts), s, ["n"], [params["k"]])
    d = pr.split(fx.segment_orders(spark, sf), "d", "1999-06-01", "2000-06-01")
    d = ft.apply_features(d, Series.of(["seg"], "d"), hook, {"k": 1})
    return flat(d.groupBy("seg", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_lag1").alias("lagged"), F.sum("dayofweek").alias("weekdays")))


@query("u5_ml_estimators", ctes("holed_events") + """
, x AS (SELECT *, CASE WHEN d < DATE '2024-01-19' THEN 'train' WHEN d < DATE '2024-01-25' THEN 'val' ELSE 'test' END AS split FROM holed_events),
m AS (SELECT avg(v) AS mv, avg(a) AS ma FROM x WHERE split = 'train'), f AS (SELECT event_type, d, split, coalesce(v, mv) AS v, coalesce(a, ma) AS a FROM x, m),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM f WHERE split = 'train')
SELECT event_type, CAST(d AS VARCHAR) AS d, split, round((v - lo) / (hi - lo), 6) AS v, round(a, 6) AS a FROM f, r""")
def u5(spark, sf):
    d = pr.split(fx.holed_events(spark, sf), "d", "2024-01-19", "2024-01-25")
    d = pr.impute(d, Imputer(strategy="mean", inputCols=["v", "a"], outputCols=["v_in", "a_in"]), Series.of(["event_type"], "d"), "v")
    d = d.select("event_type", "d", "split", F.col("v_in").alias("v"), F.col("a_in").alias("a"))
    scaler = Pipeline(stages=[VectorAssembler(inputCols=["v"], outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="unit")])
    d = ft.scale(d, ["v"], scaler)
    return flat(d.select("event_type", "d", "split", vector_to_array("unit")[0].alias("v"), "a"))

# --- the whole way


def _daily_totals(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.round(F.sum("value"), 2).alias("v")).filter(F.dayofmonth("d") % 4 != 0)


@query("p8_flagship", ctes("daily_events") + """
, x AS (SELECT event_type, d, v FROM daily_events WHERE day(d) % 4 <> 0), r AS (SELECT event_type, min(d) AS lo, max(d) AS hi FROM x GROUP BY 1),
g AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM r),
f AS (SELECT g.event_type, g.d, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v
      FROM g LEFT JOIN x ON g.event_type = x.event_type AND g.d = x.d),
z AS (SELECT *, CASE WHEN d < DATE '2024-01-18' THEN 'train' WHEN d < DATE '2024-01-24' THEN 'val' ELSE 'test' END AS split FROM f),
l AS (SELECT *, isodow(d) - 1 AS dow, lag(v, 1) OVER (PARTITION BY event_type, split ORDER BY d) AS lag1 FROM z),
c AS (SELECT event_type, regr_slope(v, lag1) AS w, regr_intercept(v, lag1) AS b FROM l WHERE split = 'train' AND lag1 IS NOT NULL GROUP BY 1),
p AS (SELECT l.event_type, split, v, b + w * lag1 AS predicted FROM l JOIN c ON l.event_type = c.event_type WHERE lag1 IS NOT NULL)
SELECT event_type, split, count(*) AS rows, round(avg(abs(v - predicted)), 6) AS mae, round(avg(pow(v - predicted, 2)), 4) AS mse FROM p GROUP BY 1, 2""")
def p8_flagship(spark, sf):
    """Gap fill, split, calendar and lag features, least squares, losses."""
    s = Series.of(["event_type"], "d")
    d = pr.split(pr.fill_gaps(_daily_totals(spark, sf), s, "v", "1 day", "ffill"), "d", "2024-01-18", "2024-01-24")
    d = ft.apply_features(d, s, lambda params, x, ser: o.add_lags(calendar_features(x, ser.ts), ser, ["v"], params["lags"]), {"lags": [1]})
    m = ln.fit_linear(d.filter("split = 'train'"), ["event_type"], "v", ["v_lag1"])
    p = mt.actual_vs_predicted(ln.predict_linear(d, m, ["event_type"], ["v_lag1"]), ["event_type"], "d", "v")
    losses = mt.evaluate(p, {"mae": "neg_mean_absolute_error", "mse": "neg_mean_squared_error"}, ["event_type"])
    return flat(losses.withColumns({"mae": F.round("mae", 6), "mse": F.round("mse", 4)}))


@query("p8_pipeline_search")
def p8_search(spark, sf):
    return flat(experiment_trials(spark, sf, 6))


def experiment(sf, **changes):
    """Daily orders of each market segment, with calendar and lag features."""

    def load(spark):
        return fx.segment_orders(spark, sf)

    def hook(params, df, s):
        d = o.add_lags(calendar_features(df, s.ts), s, ["total", "n", "bal"], [1, 2])
        return d.drop("n", "bal")

    settings = dict(loader=load, target="total", keys=("seg",), ts="d", every="1 day", target_gap_fill="ffill",
                    train_val_date="2000-01-01", val_test_date="2000-09-01", make_features=hook, categorical=("dayofweek",),
                    imputers=("mean", "ffill"), outlier_methods=(None, "boxplot", "svmoneclass"), scalers=("minmax", None),
                    models=("ridge", "lasso", "elasticnet", "linear_regression"), inner_trials=10)
    return Experiment(**{**settings, **changes})


def experiment_trials(spark, sf, n_trials, **changes):
    store = Store(spark, shared_dir(spark))
    return search_pipelines(spark, experiment(sf, **changes), store, n_trials)[0]


@query("k13_search_on_cv_score")
def k13(spark, sf):
    return flat(experiment_trials(spark, sf, 6, scored_on="train_cv_score", models=("ridge", "lasso"), outlier_methods=(None,)))
