"""The series the queries run on, derived from the given tables.

Each fixture exists twice: as a DataFrame and as SQL text for the check. SQL
texts are CTE bodies; sums of money are rounded to cents on both sides, so
that later steps start from equal numbers; `ctes("a", "b")` turns them into a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SQL = {
    "daily_events": """
        SELECT event_type, CAST(ts AS DATE) AS d, round(sum(value), 2) AS v, round(sum(value), 2) / count(*) AS a, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "holed_events": """
        SELECT event_type, d,
               CASE WHEN day(d) % 7 = 0 THEN NULL ELSE v END AS v,
               CASE WHEN day(d) % 5 = 0 THEN NULL ELSE a END AS a, n
        FROM daily_events""",
    "hourly_user": """
        SELECT user_id, date_trunc('hour', ts) AS h, round(sum(value), 2) AS v FROM events GROUP BY 1, 2""",
    "daily_orders": """
        SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) / 1e6 AS total, count(*) AS n,
               count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY 1""",
    "segment_orders": """
        SELECT c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) / 1e6 AS total,
               count(*) AS n, round(sum(c_acctbal), 2) / count(*) / 1e4 AS bal
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "market": """
        SELECT x.d, x.a AS target, y.a AS exo
        FROM daily_events x JOIN daily_events y ON x.d = y.d AND x.event_type = 'purchase' AND y.event_type = 'view'""",
    "contact": """
        SELECT d - CAST(dayofweek(d) AS INTEGER) AS week, d AS date, CAST(n AS DOUBLE) AS presentedVolume,
               customers AS cnt_orders, urgent AS perc_new_cust_orders,
               CASE WHEN month(d) = 12 AND day(d) = 24 THEN 'Christmas Eve'
                    WHEN month(d) = 12 AND day(d) = 31 THEN 'New Years Eve'
                    WHEN month(d) = 1 AND day(d) = 1 THEN 'New Years Day'
                    WHEN month(d) = 7 AND day(d) = 4 THEN 'Independence Day'
                    WHEN month(d) = 11 AND day(d) BETWEEN 22 AND 28 AND isodow(d) = 4 THEN 'Thanksgiving Day'
                    WHEN month(d) = 5 AND day(d) >= 25 AND isodow(d) = 1 THEN 'Memorial Day' END AS holiday_us,
               CASE WHEN month(d) = 7 AND day(d) = 1 THEN 'Canada Day' END AS holiday_ca
        FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(DISTINCT o_custkey) AS customers,
                     avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent
              FROM orders GROUP BY 1)""",
    "shipments": """
        SELECT o_orderkey AS SPOID, l_linenumber AS line,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ACN' WHEN '2-HIGH' THEN 'ACI' WHEN '3-MEDIUM' THEN 'NVO'
                    WHEN '4-NOT SPECIFIED' THEN 'BCO' ELSE 'NRV' END AS servicelevel,
               l_suppkey % 10 AS Original_WH, '  WH ' || (l_suppkey % 10) || ' ' AS Original_WH_Name,
               ' CFS ' || (l_partkey % 5) || '  ' AS CFSLocation, '  P' || l_linenumber || ' ' AS OriginPortCode,
               'D' || (l_suppkey % 3) || '   ' AS DestinationPortCode,
               o_orderdate AS ActualDeliveryCFS, o_orderdate + to_days(l_linenumber) AS ActualDepartureCFS,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days(2 * l_linenumber) END AS GateInOriginPort,
               o_orderdate + to_days(3 * l_linenumber) AS DepartureOriginPort,
               o_orderdate + to_days(3 * l_linenumber + 10) AS ArrivalDestinationPort,
               o_orderdate + to_days(3 * l_linenumber + 12) AS GateOutDestinationPort,
               l_shipdate AS arrivaldate, l_quantity - 5 AS Total_units
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
_NEEDS = {"holed_events": ["daily_events"], "market": ["daily_events"]}


def ctes(*names: str) -> str:
    """`WITH a AS (…), b AS (…)` including what those fixtures build on."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.round(F.sum("value"), 2).alias("v"), (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("a"), F.count(F.lit(1)).alias("n"))


def holed_events(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("d")
    return daily_events(spark, sf).withColumns({
        "v": F.when(day % 7 != 0, F.col("v")), "a": F.when(day % 5 != 0, F.col("a"))})


def hourly_user(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(
        F.round(F.sum("value"), 2).alias("v"))


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1e6).alias("total"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("customers"))


def segment_orders(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("seg"), F.to_date("o_orderdate").alias("d")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1e6).alias("total"), F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 2) / F.count(F.lit(1)) / 1e4).alias("bal"))


def one_type(spark: SparkSession, sf: str, kind: str, name: str) -> DataFrame:
    return daily_events(spark, sf).filter(F.col("event_type") == kind).select("d", F.col("a").alias(name))


def contact(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("presentedVolume"), F.count_distinct("o_custkey").alias("cnt_orders"),
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("perc_new_cust_orders"))
    month, day, dow = F.month("date"), F.dayofmonth("date"), F.weekday("date")
    us = (F.when((month == 12) & (day == 24), "Christmas Eve").when((month == 12) & (day == 31), "New Years Eve")
          .when((month == 1) & (day == 1), "New Years Day").when((month == 7) & (day == 4), "Independence Day")
          .when((month == 11) & day.between(22, 28) & (dow == 3), "Thanksgiving Day")
          .when((month == 5) & (day >= 25) & (dow == 0), "Memorial Day"))
    return d.select(F.date_sub("date", F.dayofweek("date") - 1).alias("week"), "date", "presentedVolume", "cnt_orders",
                    "perc_new_cust_orders", us.alias("holiday_us"),
                    F.when((month == 7) & (day == 1), "Canada Day").alias("holiday_ca"))


def contact_forecast(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.date_sub(d, F.dayofweek(d) - 1).alias("week")).agg(
        (F.round(F.sum("o_totalprice"), 2) / 1e6).alias("tot_na_fcst"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    after = lambda days: F.col("o_orderdate") + F.make_dt_interval(days)
    ln = F.col("l_linenumber")
    level = (F.when(F.col("o_orderpriority") == "1-URGENT", "ACN").when(F.col("o_orderpriority") == "2-HIGH", "ACI")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "NVO").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "BCO")
             .otherwise("NRV"))
    return d.select(
        F.col("o_orderkey").alias("SPOID"), ln.alias("line"), level.alias("servicelevel"),
        (F.col("l_suppkey") % 10).alias("Original_WH"),
        F.concat(F.lit("  WH "), (F.col("l_suppkey") % 10).cast("string"), F.lit(" ")).alias("Original_WH_Name"),
        F.concat(F.lit(" CFS "), (F.col("l_partkey") % 5).cast("string"), F.lit("  ")).alias("CFSLocation"),
        F.concat(F.lit("  P"), ln.cast("string"), F.lit(" ")).alias("OriginPortCode"),
        F.concat(F.lit("D"), (F.col("l_suppkey") % 3).cast("string"), F.lit("   ")).alias("DestinationPortCode"),
        F.col("o_orderdate").alias("ActualDeliveryCFS"), after(ln).alias("ActualDepartureCFS"),
        F.when(F.col("o_orderkey") % 11 != 0, after(2 * ln)).alias("GateInOriginPort"),
        after(3 * ln).alias("DepartureOriginPort"), after(3 * ln + 10).alias("ArrivalDestinationPort"),
        after(3 * ln + 12).alias("GateOutDestinationPort"), F.col("l_shipdate").alias("arrivaldate"),
        (F.col("l_quantity") - 5).alias("Total_units"))
