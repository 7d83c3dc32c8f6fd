"""Queries of the sources, projections, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import aggregate as ag, clean, joins, search
from tidemark.plans import contact as pc, shipments as ps
from tidemark.session import shared_dir
from tidemark.sources.csv import read_csv_series
from tidemark.sources.sql import create_view, run_query
from tidemark.sources.store import Store, artifact_name, land
from tidemark.operators import prepare
from workloads import fixtures as fx
from workloads.fixtures import ctes, table
from workloads.registry import flat, query

# --- sources and sinks


@query("a1_land", ctes("daily_orders") + " SELECT CAST(d AS VARCHAR) AS d, round(total, 8) AS total, n, customers FROM daily_orders")
def a1(spark, sf):
    store = Store(spark, shared_dir(spark))
    return flat(land(spark, lambda s: fx.daily_orders(s, sf), store), 8)


@query("a2_csv_series", ctes("daily_orders") + """
SELECT CASE WHEN day(d) % 7 = 0 THEN NULL ELSE CAST(d AS VARCHAR) END AS date,
       CASE WHEN day(d) % 5 = 0 THEN NULL ELSE n END AS open FROM daily_orders""")
def a2(spark, sf):
    path = f"{Store(spark, shared_dir(spark)).path('csv')}"
    d = fx.daily_orders(spark, sf)
    # Days divisible by 7 get an offset, which the strict layout refuses.
    stamp = F.concat(F.date_format("d", "yyyy-MM-dd HH:mm:ss"), F.when(F.dayofmonth("d") % 7 == 0, "-05:00").otherwise(""))
    text = F.when(F.dayofmonth("d") % 5 == 0, "n/a").otherwise(F.col("n").cast("string"))
    d.select(stamp.alias("Date"), text.alias("Open"), F.col("total").alias("Close")).write.csv(path, header=True)
    return flat(read_csv_series(spark, path, "Date", "Open", "open").withColumn("open", F.col("open").cast("long")))


@query("a3_store_stage", ctes("daily_orders") + """
SELECT CAST(d AS VARCHAR) AS d, n, 'val' AS split FROM daily_orders WHERE d >= DATE '1999-01-01' AND d < DATE '2000-01-01'""")
def a3(spark, sf):
    store = Store(spark, shared_dir(spark))
    store.write(prepare.split(fx.daily_orders(spark, sf), "d", "1999-01-01", "2000-01-01"), "processed", trial=3)
    return flat(store.read("processed", trial=3, split="val").select("d", "n", F.col("split").cast("string").alias("split")))


@query("a4_artifact_name", """
SELECT o_orderkey, left('modeling_' || o_orderpriority || '_' || o_orderstatus || '_' || repeat(o_orderpriority || '-', 12)
       || '_' || o_custkey, 100) AS name FROM orders""")
def a4(spark, sf):
    d = table(spark, sf, "orders")
    long = F.expr("repeat(o_orderpriority || '-', 12)")
    return flat(d.select("o_orderkey", artifact_name(
        F.lit("modeling"), "o_orderpriority", "o_orderstatus", long, F.col("o_custkey").cast("string")).alias("name")))


@query("a5_run_query", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def a5(spark, sf):
    create_view(table(spark, sf, "orders"), "query_orders")
    text = """SELECT date_format(o_orderdate, 'yyyy-MM-01') AS month, count(*) AS n, sum(o_totalprice) AS total
              FROM query_orders GROUP BY 1"""
    return flat(run_query(spark, text, parse_dates=["month"], use_cache=False), 2)


@query("a6_views", """
WITH late AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, CAST(max(CAST(last AS DATE)) AS VARCHAR) AS last
FROM orders JOIN late ON o_orderkey = l_orderkey GROUP BY 1""")
def a6(spark, sf):
    create_view(table(spark, sf, "lineitem"), "view_items")
    create_view(table(spark, sf, "orders"), "view_orders")
    create_view(spark.sql("SELECT l_orderkey, max(l_shipdate) AS last FROM view_items GROUP BY 1"), "view_late")
    return flat(spark.sql("""SELECT o_orderstatus, count(*) AS n, max(CAST(last AS DATE)) AS last
                             FROM view_orders JOIN view_late ON o_orderkey = l_orderkey GROUP BY 1"""))

# --- projections and filters


@query("b1_rename", """SELECT o_orderkey AS spo, o_custkey, o_orderpriority AS level FROM orders""")
def b1(spark, sf):
    d = clean.rename(table(spark, sf, "orders"), {"o_orderkey": "spo", "o_orderpriority": "level", "absent": "x"})
    return flat(d.select("spo", "o_custkey", "level"))


@query("b2_keep", ctes("shipments") + """
SELECT SPOID, line, servicelevel, Total_units FROM shipments
WHERE Total_units > 0 AND servicelevel IN ('ACN', 'ACI', 'NVO', 'BCO', 'DRA')""")
def b2(spark, sf):
    d = clean.keep(fx.shipments(spark, sf), "Total_units", "servicelevel", ps.SERVICE_LEVELS)
    return flat(d.select("SPOID", "line", "servicelevel", "Total_units"))


@query("b3_clean_text", ctes("shipments") + """
SELECT trim(CFSLocation) AS CFSLocation, trim(OriginPortCode) AS OriginPortCode,
       CAST(Original_WH AS VARCHAR) AS Original_WH, count(*) AS n FROM shipments GROUP BY 1, 2, 3""")
def b3(spark, sf):
    d = clean.clean_text(fx.shipments(spark, sf), ["CFSLocation", "OriginPortCode"], ["Original_WH"])
    return flat(d.groupBy("CFSLocation", "OriginPortCode", "Original_WH").agg(F.count(F.lit(1)).alias("n")))


@query("b4_to_dates", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, CAST(CAST(ts + INTERVAL 36 HOUR AS DATE) AS VARCHAR) AS later FROM events""")
def b4(spark, sf):
    d = table(spark, sf, "events").withColumn("later", F.col("ts") + F.expr("INTERVAL '36' HOUR"))
    return flat(clean.to_dates(d, ["ts", "later"]).select("event_id", "ts", "later"))


_LEGS_SQL = ", ".join(
    f"date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE)) AS {n}" for n, a, b in zip(
        ps.LEGS, ("ActualDeliveryCFS", "ActualDepartureCFS", "GateInOriginPort", "DepartureOriginPort", "ArrivalDestinationPort",
                  "GateOutDestinationPort"),
        ("ActualDepartureCFS", "GateInOriginPort", "DepartureOriginPort", "ArrivalDestinationPort", "GateOutDestinationPort",
         "arrivaldate")))


@query("b5_leg_durations", ctes("shipments") + f" SELECT SPOID, line, {_LEGS_SQL} FROM shipments")
def b5(spark, sf):
    d = clean.rename(fx.shipments(spark, sf), {"arrivaldate": "CompletedTime"})
    return flat(clean.leg_durations(clean.to_dates(d, ps.EVENTS), clean.journey_legs(ps.EVENTS, ps.LEGS)).select("SPOID", "line", *ps.LEGS))


@query("b6_map_values", """
SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN r_name END AS area
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def b6(spark, sf):
    lookup = table(spark, sf, "nation").filter("n_nationkey < 20").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # The lookup file repeats its rows, as hand-kept lists do.
    lookup = lookup.select("n_nationkey", "r_name").unionAll(lookup.select("n_nationkey", "r_name"))
    d = table(spark, sf, "supplier").withColumn("area", F.col("s_nationkey"))
    return flat(clean.map_values(d, "area", lookup, "n_nationkey", "r_name").select("s_suppkey", "area"))


@query("b7_flags", ctes("contact") + """
SELECT CAST(date AS VARCHAR) AS date, label,
       CASE WHEN label = 'Christmas Eve' THEN 1 ELSE 0 END AS christmas_eve,
       CASE WHEN label = 'Thanksgiving Day' THEN 1 ELSE 0 END AS thanksgiving,
       CASE WHEN label IN ('Christmas Eve', 'Thanksgiving Day') THEN 1 ELSE 0 END AS both_days
FROM (SELECT date, CASE WHEN date IN (DATE '1998-04-27', DATE '1998-04-28') THEN 'Christmas Eve' ELSE holiday_us END AS label FROM contact)""")
def b7(spark, sf):
    d = fx.contact(spark, sf).withColumn("label", F.col("holiday_us"))
    d = clean.override_on_dates(d, "label", "date", ["1998-04-27", "1998-04-28"], "Christmas Eve")
    d = clean.flag_values(d, "label", {"christmas_eve": "Christmas Eve", "thanksgiving": "Thanksgiving Day"})
    return flat(clean.add_flags(d, "both_days", ["thanksgiving", "christmas_eve"]).select("date", "label", "christmas_eve", "thanksgiving", "both_days"))


@query("b8_day_group", """
SELECT o_orderkey, CASE WHEN isodow(o_orderdate) - 1 IN (3, 4, 5) THEN 0 ELSE 1 END AS day FROM orders""")
def b8(spark, sf):
    return flat(clean.day_group(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "day"))


@query("b9_ceil_product", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(l_quantity * l_discount) AS BIGINT) AS units FROM lineitem""")
def b9(spark, sf):
    d = clean.ceil_product(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "units")
    return flat(d.select("l_orderkey", "l_linenumber", "l_partkey", "units"))


@query("b10_power", ctes("daily_orders") + " SELECT CAST(d AS VARCHAR) AS d, round(pow(total, 2.35), 6) AS total FROM daily_orders")
def b10(spark, sf):
    return flat(clean.power(fx.daily_orders(spark, sf), "total", 2.35).select("d", "total"))


@query("b11_select_complete", ctes("holed_events") + """
SELECT event_type, CAST(d AS VARCHAR) AS d, round(v, 6) AS v, round(a, 6) AS a FROM holed_events WHERE v IS NOT NULL AND a IS NOT NULL""")
def b11(spark, sf):
    return flat(clean.select_complete(fx.holed_events(spark, sf), ["event_type", "d", "v", "a"]))


@query("b12_predicates", """
WITH x AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS b2b,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS level, o_orderkey - o_orderkey % 3 AS parent FROM orders)
SELECT o_orderkey, level FROM x
WHERE 1 = 1 AND o_orderkey = parent AND b2b IS NOT TRUE AND (level IS NULL OR level <> '2-HIGH')
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2000-01-01'
  AND (o_orderstatus = 'F' OR o_custkey % 2 = 0) AND o_orderstatus IN ('F', 'O')""")
def b12(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").withColumns({
        "b2b": F.when(k % 7 != 0, k % 2 == 0), "level": F.when(k % 5 != 0, F.col("o_orderpriority")), "parent": k - k % 3})
    level, status = F.col("level"), F.col("o_orderstatus")
    return flat(d.filter(
        (k == F.col("parent")) & ~F.coalesce("b2b", F.lit(False)) & (level.isNull() | (level != "2-HIGH"))
        & (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "2000-01-01")
        & ((status == "F") | (F.col("o_custkey") % 2 == 0)) & status.isin("F", "O")).select("o_orderkey", "level"))


@query("b13_case", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'NA Phone' WHEN '2-HIGH' THEN 'UK Phone' ELSE 'NA Specialized' END AS geo,
       CASE WHEN o_orderstatus IN ('F') THEN 0 ELSE 1 END AS new_customer FROM orders""")
def b13(spark, sf):
    geo = clean.label_case("o_orderpriority", {"1-URGENT": "NA Phone", "2-HIGH": "UK Phone"}, "NA Specialized")
    return flat(table(spark, sf, "orders").select("o_orderkey", geo.alias("geo"), F.when(
        F.col("o_orderstatus").isin("F"), 0).otherwise(1).alias("new_customer")))

# --- joins


@query("c1_align", ctes("holed_events") + """
SELECT CAST(x.d AS VARCHAR) AS d, round(x.v, 6) AS buys, round(y.v, 6) AS views
FROM (SELECT * FROM holed_events WHERE event_type = 'purchase') x FULL JOIN (SELECT * FROM holed_events WHERE event_type = 'view') y ON x.d = y.d
WHERE x.v IS NOT NULL AND y.v IS NOT NULL""")
def c1(spark, sf):
    d = fx.holed_events(spark, sf)
    one = lambda kind, name: d.filter(F.col("event_type") == kind).select("d", F.col("v").alias(name))
    return flat(joins.align([one("purchase", "buys"), one("view", "views")], ["d"]))


@query("c2_merge_chain", """
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS shipped FROM lineitem GROUP BY 1),
c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT CAST(a.d AS VARCHAR) AS d, n, shipped, urgent FROM a JOIN b ON a.d = b.d JOIN c ON a.d = c.d""")
def c2(spark, sf):
    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    per_day = lambda d, c, name: d.groupBy(F.to_date(c).alias("d")).agg(F.count(F.lit(1)).alias(name))
    return flat(joins.merge_all([per_day(o, "o_orderdate", "n"), per_day(i, "l_shipdate", "shipped"),
                                 per_day(o.filter("o_orderpriority = '1-URGENT'"), "o_orderdate", "urgent")], ["d"]))


@query("c3_left_merge", """
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def c3(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return flat(joins.merge_all([table(spark, sf, "customer").select("c_custkey"), done], ["c_custkey"], "left").na.fill(0))


@query("c4_outer_fill", ctes("contact") + """
, e AS (SELECT week, sum(presentedVolume) AS early FROM contact WHERE isodow(date) - 1 NOT IN (3, 4, 5) GROUP BY 1),
l AS (SELECT week, sum(presentedVolume) AS late FROM contact WHERE isodow(date) - 1 IN (3, 4, 5) GROUP BY 1)
SELECT CAST(coalesce(e.week, l.week) AS VARCHAR) AS week, coalesce(early, 0) AS early, coalesce(late, 0) AS late FROM e FULL JOIN l ON e.week = l.week""")
def c4(spark, sf):
    d = pc.partial_week(clean.day_group(fx.contact(spark, sf), "date"), [], "presentedVolume", details=True)
    return flat(d.select("week", "early", "late"))


_CHAIN_SQL = """
WITH facts AS (SELECT l_orderkey AS queueid, l_linenumber % 2 AS router, l_shipdate AS ts, l_quantity AS presented, l_linenumber AS abandoned FROM lineitem),
queue_map AS (SELECT CAST(o_orderkey AS VARCHAR) AS queueid, o_orderkey % 2 AS router, o_custkey AS groupid FROM orders),
group_map AS (SELECT c_custkey AS groupid, n_regionkey AS reportid FROM customer JOIN nation ON c_nationkey = n_nationkey),
reports AS (SELECT r_regionkey AS reportid, r_name AS reportname FROM region)"""


def contact_tables(spark, sf):
    """The mapped sources of the daily contact table."""
    o, c, li = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    e, nation, region = (table(spark, sf, t) for t in ("events", "nation", "region"))
    shifted = F.col("ts") - F.make_ym_interval(F.lit(25))
    hol = fx.contact(spark, sf)
    return {
        "facts": li.select(F.col("l_orderkey").alias("queueid"), (F.col("l_linenumber") % 2).alias("router"), F.col("l_shipdate").alias("ts"),
                           F.col("l_quantity").alias("presented"), F.col("l_linenumber").alias("abandoned")),
        "queue_map": o.select(F.col("o_orderkey").cast("string").alias("queueid"), (F.col("o_orderkey") % 2).alias("router"), F.col("o_custkey").alias("groupid")),
        "group_map": c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("groupid"), F.col("n_regionkey").alias("reportid")),
        "reports": region.select(F.col("r_regionkey").alias("reportid"), F.col("r_name").alias("reportname")),
        "callbacks": o.filter("o_orderstatus = 'F'").select(F.col("o_orderdate").alias("calldate"), F.lit("NA Frontline").alias("reportname"), (F.col("o_orderkey") % 3).alias("callbacks")),
        "routed": e.filter("event_type = 'error'").select(shifted.alias("ts"), F.col("user_id").alias("contactid"), F.lit(2).alias("sourceid"),
                                                          F.when(F.col("event_id") % 3 == 0, 6).otherwise(5).alias("routingid")),
        "orders": o.select(F.col("o_orderkey").alias("orderid"), F.col("o_orderdate").alias("completed"), (F.col("o_custkey") % 4).alias("storeid"),
                           F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5 == 0).alias("isb2b")),
        "stores": nation.filter("n_nationkey < 4").select(F.col("n_nationkey").alias("storeid"), F.when(F.col("n_nationkey") < 2, 1).when(F.col("n_nationkey") == 2, 6).otherwise(3).alias("storetype")),
        "clicks": o.select(F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")).alias("orderid"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", "New").otherwise("Activated Customer").alias("visitor"),
                           F.when(F.col("o_orderstatus") == "P", "Basic").otherwise("None").alias("level"), (F.col("o_custkey") % 4).alias("storeid")),
        "holidays": hol.filter("holiday_us IS NOT NULL").select(F.col("date").alias("eventdate"), F.lit("US").alias("country"), F.col("holiday_us").alias("name")).unionAll(
            hol.filter("holiday_ca IS NOT NULL").select("date", F.lit("CA"), "holiday_ca")),
    }


@query("c5_cast_key_join", _CHAIN_SQL + """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, sum(presented) AS presented, CAST(sum(abandoned) AS BIGINT) AS abandoned
FROM facts f JOIN queue_map q ON f.queueid = CAST(q.queueid AS BIGINT) AND f.router = q.router JOIN group_map USING (groupid)
JOIN reports USING (reportid) WHERE reportname = 'ASIA' AND ts >= DATE '1996-01-01' GROUP BY 1""")
def c5(spark, sf):
    return flat(pc.presented_by_day(contact_tables(spark, sf), "ASIA", "1996-01-01"))


@query("c6_outer_chain", ctes("contact") + """
, us AS (SELECT DISTINCT date, holiday_us FROM contact WHERE holiday_us IS NOT NULL),
ca AS (SELECT DISTINCT date, holiday_ca FROM contact WHERE holiday_ca IS NOT NULL),
base AS (SELECT date, presentedVolume FROM contact WHERE month(date) <> 7)
SELECT CAST(coalesce(coalesce(b.date, us.date), ca.date) AS VARCHAR) AS date, presentedVolume AS volume, holiday_us AS us, holiday_ca AS ca
FROM base b FULL JOIN us ON b.date = us.date FULL JOIN ca ON coalesce(b.date, us.date) = ca.date""")
def c6(spark, sf):
    d = fx.contact(spark, sf)
    us, ca = [d.filter(f"{c} IS NOT NULL").select("date", F.col(c).alias(n)).distinct() for c, n in (("holiday_us", "us"), ("holiday_ca", "ca"))]
    base = d.filter(F.month("date") != 7).select("date", F.col("presentedVolume").alias("volume"))
    return flat(joins.merge_all([base, us, ca], ["date"], "full"))


@query("c7_join_to_aggregate", """
SELECT o_orderkey, o_orderstatus, CAST(CAST(first AS DATE) AS VARCHAR) AS first, qty
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON o_orderkey = l_orderkey""")
def c7(spark, sf):
    report = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("spoid"), F.col("l_shipdate").alias("arrivaldate"),
                                                 F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("element"))
    d = table(spark, sf, "orders").join(ps.arrivals(report, "A"), F.col("o_orderkey") == F.col("spoid"))
    return flat(d.select("o_orderkey", "o_orderstatus", F.to_date("arrivaldate").alias("first"), F.col("arrived").alias("qty")))


@query("c8_anti_join", """
SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_custkey IS NULL""")
def c8(spark, sf):
    other = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return flat(joins.without_match(table(spark, sf, "customer"), other, ["c_custkey"]).select("c_custkey"))


@query("c9_not_exists", """
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def c9(spark, sf):
    create_view(table(spark, sf, "part"), "exists_part")
    create_view(table(spark, sf, "lineitem"), "exists_items")
    return flat(spark.sql("""SELECT p_partkey FROM exists_part
                             WHERE NOT EXISTS (SELECT 1 FROM exists_items WHERE l_partkey = p_partkey AND l_quantity > 48)"""))

# --- aggregates


@query("d1_sum_by", "SELECT l_shipmode_free AS flag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_quantity) AS l_quantity FROM (SELECT *, l_returnflag AS l_shipmode_free FROM lineitem) GROUP BY 1, 2")
def d1(spark, sf):
    d = ag.sum_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"])
    return flat(d.withColumnRenamed("l_returnflag", "flag"), 2)


@query("d2_units_by_event", ctes("shipments") + """
SELECT CAST(CAST(ArrivalDestinationPort AS DATE) AS VARCHAR) AS date, trim(DestinationPortCode) AS Destination, sum(Total_units) AS units
FROM shipments WHERE Total_units > 0 AND servicelevel IN ('ACN', 'ACI', 'NVO', 'BCO', 'DRA') GROUP BY 1, 2""")
def d2(spark, sf):
    return flat(ps.daily_units(ps.tidy_shipments(fx.shipments(spark, sf)), "Destination", "arrival", keep_node=True))


@query("d3_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def d3(spark, sf):
    return flat(table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users")))


@query("d4_min_max", """
SELECT l_orderkey, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last,
       max(l_returnflag) AS flag FROM lineitem GROUP BY 1""")
def d4(spark, sf):
    return flat(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"), F.max("l_returnflag").alias("flag")))


@query("d5_conditional_sums", """
SELECT l_suppkey, sum(CASE WHEN t = 1 THEN l_quantity ELSE 0 END) AS Type_1_Units, sum(CASE WHEN t = 2 THEN l_quantity ELSE 0 END) AS Type_2_Units,
       sum(CASE WHEN t = 3 THEN l_quantity ELSE 0 END) AS Type_3_Units, sum(CASE WHEN t = 4 THEN l_quantity ELSE 0 END) AS Type_4_Units,
       sum(CASE WHEN t IS NULL THEN l_quantity ELSE 0 END) AS No_Type_Units
FROM lineitem JOIN (SELECT p_partkey, nullif(p_size % 5, 0) AS t FROM part) ON l_partkey = p_partkey GROUP BY 1""")
def d5(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("t"))
    d = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return flat(d.groupBy("l_suppkey").agg(*ag.conditional_sums("l_quantity", "t", ps.CARTON_TYPES)))


@query("d6_max_or_sum", """
SELECT l_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_quantity END), sum(l_quantity)) AS units FROM lineitem GROUP BY 1""")
def d6(spark, sf):
    return flat(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.coalesce(
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))), F.sum("l_quantity")).alias("units")))


@query("d7_two_levels", """
SELECT month, sum(n) AS orders, max(n) AS top FROM (
  SELECT month(o_orderdate) AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def d7(spark, sf):
    inner = table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return flat(inner.groupBy("month").agg(F.sum("n").alias("orders"), F.max("n").alias("top")))


@query("d8_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def d8(spark, sf):
    return flat(ag.distinct_lookup(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]))


@query("d9_ratio", """
WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS fresh, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(t.d AS VARCHAR) AS d, round(f.n / t.n, 6) AS part FROM (SELECT d, sum(n) AS n FROM x GROUP BY 1) t
JOIN (SELECT d, sum(n) AS n FROM x WHERE fresh = 1 GROUP BY 1) f ON t.d = f.d""")
def d9(spark, sf):
    fresh = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("fresh")
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d"), fresh).agg(F.count_distinct("o_orderkey").alias("n"))
    return flat(ag.share_by(d, ["d"], "n", F.col("fresh") == 1, "part"))


@query("d10_missing_profile", ctes("holed_events") + """
, x AS (SELECT avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0 END) AS event_type, avg(CASE WHEN d IS NULL THEN 1.0 ELSE 0 END) AS d,
       avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS v, avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0 END) AS n FROM holed_events)
SELECT name AS "column", round(missing, 6) AS missing, CAST(missing > 0.16 AS BIGINT) AS high FROM x UNPIVOT (missing FOR name IN (event_type, d, v, a, n))""")
def d10(spark, sf):
    return flat(ag.missing_profile(fx.holed_events(spark, sf), 0.16))


@query("d11_category_histogram", """
WITH x AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE p_type END AS kind
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'brand' AS "column", coalesce(brand, 'Not Available') AS value, count(*) AS count FROM x GROUP BY 1, 2
UNION ALL SELECT 'kind', coalesce(kind, 'none'), count(*) FROM x GROUP BY 1, 2""")
def d11(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = d.select(F.when(F.col("l_orderkey") % 7 != 0, F.col("p_brand")).alias("brand"), F.when(F.col("l_orderkey") % 5 != 0, F.col("p_type")).alias("kind"))
    return flat(ag.category_histogram(d, fill={"kind": "none"}))


@query("d12_class_distribution", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1),
k AS (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error' UNION ALL SELECT 'never')
SELECT t.user_id, k.event_type, round(coalesce(n, 0) / total, 6) AS prob FROM t CROSS JOIN k LEFT JOIN c ON c.user_id = t.user_id AND c.event_type = k.event_type""")
def d12(spark, sf):
    e = table(spark, sf, "events")
    classes = e.filter("event_type <> 'error'").select("event_type").unionAll(e.select(F.lit("never"))).distinct()
    return flat(ag.class_distribution(e, ["user_id"], "event_type", classes))

# --- sorts, limits, unions


@query("f1_sort", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey")
def f1(spark, sf):
    return flat(table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey"))


@query("f2_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def f2(spark, sf):
    return flat(table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).select("o_orderkey", "o_totalprice"))


@query("f3_best_trial", """
SELECT o_orderkey AS trial, round(score, 6) AS score FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS score FROM orders) ORDER BY 2, 1 LIMIT 1""")
def f3(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))
    return flat(search.best_trial(d))


@query("g1_union_distinct", """
SELECT o_custkey AS id, o_orderpriority AS level FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def g1(spark, sf):
    d = table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    part = lambda side: d.filter(side).select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("level"))
    return flat(part(done).union(part(~done)).distinct())

# --- scalar functions


@query("h1_calendar", """
SELECT event_id, day(ts) AS day, isodow(ts) - 1 AS dayofweek, weekofyear(ts) AS week, month(ts) AS month FROM events""")
def h1(spark, sf):
    return flat(cal.calendar_features(table(spark, sf, "events"), "ts").select("event_id", "day", "dayofweek", "week", "month"))


@query("h3_sunday_week", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS VARCHAR) AS week FROM orders")
def h3(spark, sf):
    return flat(table(spark, sf, "orders").select("o_orderkey", cal.sunday_week("o_orderdate").alias("week")))


@query("h4_monday_week", "SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week FROM orders")
def h4(spark, sf):
    return flat(table(spark, sf, "orders").select("o_orderkey", cal.monday_week("o_orderdate").alias("week")))


@query("h5_week_cut", """
SELECT CAST(week AS VARCHAR) AS week, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week FROM orders)
WHERE week < DATE '1999-05-02' + 14 GROUP BY 1""")
def h5(spark, sf):
    d = table(spark, sf, "orders").withColumn("week", cal.sunday_week("o_orderdate")).filter(cal.before_week_cut("week", "1999-05-05"))
    return flat(d.groupBy("week").agg(F.count(F.lit(1)).alias("n")))


@query("h6_date_math", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later, CAST(CAST(o_orderdate - INTERVAL 24 MONTH AS DATE) AS VARCHAR) AS before,
       year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy FROM orders""")
def h6(spark, sf):
    d = F.to_date("o_orderdate")
    part = lambda name: F.extract(F.lit(name), F.col("o_orderdate"))
    return flat(table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(d, 10).alias("later"), F.add_months(d, -24).alias("before"), part("YEAR").alias("y"),
        part("QUARTER").alias("q"), part("DOY").alias("doy")))


@query("h7_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS even, round(l_quantity / 2) AS away FROM lineitem""")
def h7(spark, sf):
    half = F.col("l_quantity") / 2
    return flat(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", cal.round_half_even(half).alias("even"), F.round(half).alias("away")))


@query("h8_coalesce", ctes("holed_events") + " SELECT event_type, CAST(d AS VARCHAR) AS d, round(coalesce(v, a, 0), 6) AS v FROM holed_events")
def h8(spark, sf):
    return flat(fx.holed_events(spark, sf).select("event_type", "d", F.coalesce("v", "a", F.lit(0)).alias("v")))


@query("h9_level_adjustment", ctes("contact") + """
SELECT CAST(date AS VARCHAR) AS date, CASE WHEN week <= DATE '1998-08-23' THEN round(presentedVolume * 0.97) ELSE presentedVolume END AS v FROM contact""")
def h9(spark, sf):
    return flat(fx.contact(spark, sf).select("date", cal.level_adjusted(F.col("presentedVolume"), F.col("week"), "1998-08-23").alias("v")))
