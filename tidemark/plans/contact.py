"""Contact volume: partial-week estimates, weekly features, daily source table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import join_on, small_side
from tidemark.functions.calendar import before_week_cut, level_adjusted, round_half_even, sunday_week
from tidemark.operators.aggregate import share_by
from tidemark.operators.clean import add_flags, ceil_product, day_group, flag_values, override_on_dates, power, select_complete
from tidemark.operators.ordered import add_lags, rolling_sum, trailing_mean
from tidemark.series import Series

# Holiday labels and the flag each one sets.
HOLIDAY_FLAGS = {
    "holiday_wf": "Wayday",
    "memo_day": "Memorial Day",
    "bf_july": "Black Friday In July",
    "july_4": "Independence Day",
    "thanksgiving": "Thanksgiving Day",
    "christmas_eve": "Christmas Eve",
    "cyber_monday": "Cyber Monday",
    "new_years_eve": "New Years Eve",
    "new_year": "New Years Day",
}
# Two dates whose label is set by hand, and that label.
LABEL_DATES, LABEL = ("2022-04-27", "2022-04-28"), "Wayday"
# Columns of the weekly model table.
TARGET = "presentedVolume"
FEATURES = (
    "exp_mov_avg", "exp_ma_orders", "tot_na_fcst", "exp_cnt_orders_lag1", "holiday_wf", "memo_day", "bf_july",
    "july_4", "thanksgiving", "cyber_monday", "thanksgiving_christmas", "christmas_eve", "new_years_eve", "new_year",
)
# Fixed values of the daily source: stores, customers, dates.
STORE_TYPES, KNOWN_CUSTOMER, RETAIL_LEVEL = (1, 6), "Activated Customer", "None"
SINCE, B2B_UNTIL, LEVEL_CUT, WEEKS_AFTER = "2018-01-07", "2021-09-22", "2018-08-26", "2018-01-01"


def _half_weeks(col: str) -> list[Column]:
    """Sums of the two day groups of a week in one pass."""
    side = lambda g: F.coalesce(F.sum(F.when(F.col("day") == g, F.col(col))), F.lit(0))
    return [side(1).cast("double").alias(f"__early_{col}"), side(0).cast("double").alias(f"__late_{col}")]


def _estimate(df: DataFrame, s: Series, col: str, n: int) -> DataFrame:
    early, late = F.col(f"__early_{col}"), F.col(f"__late_{col}")
    df = df.withColumn(f"__tot_{col}", early + late).withColumn(f"__perc_{col}", F.try_divide(late, F.col(f"__tot_{col}")))
    df = trailing_mean(df, s, f"__perc_{col}", n - 1, f"__avg_{col}")
    return df.withColumn(f"__est_{col}", round_half_even(F.try_divide(early, 1 - F.col(f"__avg_{col}"))))


def partial_week(df: DataFrame, keys: Sequence[str], col: str, n: int = 3, details: bool = False) -> DataFrame:
    """Weekly total and an estimate of it from the first part of the week.

    Input has `week`, `day` (1 = early part, 0 = late part) and the value. The
    estimate divides the early sum by one minus the mean late share of the
    n-1 weeks before.
    """
    weekly = df.groupBy(*keys, "week").agg(*_half_weeks(col))
    out = _estimate(weekly, Series.of(keys, "week"), col, n)
    plain = {f"__tot_{col}": col, f"__est_{col}": f"est_{col}"}
    extra = {f"__early_{col}": "early", f"__late_{col}": "late", f"__perc_{col}": "perc", f"__avg_{col}": "avg_perc"}
    names = {**plain, **(extra if details else {})}
    return out.select(*keys, "week", *[F.col(a).alias(b) for a, b in names.items()])


def mark_days(df: DataFrame) -> DataFrame:
    """Day group, new-customer count and holiday flags of the daily table."""
    df = ceil_product(day_group(df, "date"), "cnt_orders", "perc_new_cust_orders", "new_cust")
    df = override_on_dates(df, "holiday_us", "date", LABEL_DATES, LABEL)
    df = flag_values(df, "holiday_us", HOLIDAY_FLAGS)
    return add_flags(df, "thanksgiving_christmas", ["thanksgiving", "christmas_eve"])


def contact_features(daily: DataFrame, forecast: DataFrame, exponent: float, keys: Sequence[str] = ()) -> DataFrame:
    """Weekly model table. Both estimates and all holiday sums come from one
    aggregate over the days of a week."""
    flags = [*HOLIDAY_FLAGS, "thanksgiving_christmas"]
    weekly = mark_days(daily).groupBy(*keys, "week").agg(
        *_half_weeks("presentedVolume"), *_half_weeks("cnt_orders"), *[F.sum(f).alias(f) for f in flags])
    s = Series.of(keys, "week")
    for c in ("presentedVolume", "cnt_orders"):
        weekly = _estimate(weekly, s, c, 3).withColumn(c, F.col(f"__tot_{c}"))
    d = weekly.join(forecast, [*keys, "week"])
    for c, out in (("presentedVolume", "exp_mov_avg"), ("cnt_orders", "exp_ma_orders")):
        d = rolling_sum(d, s, c, 2, 1, "__two").withColumn("__sum", F.col("__two") + F.col(f"__est_{c}"))
        d = add_lags(d, s, ["__sum"], [1], dropna=False).withColumn(out, F.col("__sum_lag1") / 3).drop("__two", "__sum", "__sum_lag1")
    d = add_lags(d, s, ["__est_cnt_orders"], [1], dropna=False).withColumnRenamed("__est_cnt_orders_lag1", "exp_cnt_orders_lag1")
    return select_complete(power(d, "tot_na_fcst", exponent), [*keys, "week", TARGET, *FEATURES])


def contact_hook(forecast: DataFrame):
    """The weekly table as an experiment hook with its searched exponent."""
    return lambda params, df, s: contact_features(df, forecast, params["na_fcst_pow"], s.keys)


def _day(c: str) -> Column:
    return F.to_date(c)


def presented_by_day(t: Mapping[str, DataFrame], report: str, since: str = SINCE, as_of: str | None = None) -> DataFrame:
    """Offered and abandoned contacts of one report: interval facts through the
    two mapping tables. The mapping chain is reduced first and is small."""
    chain = (t["queue_map"].select(F.col("queueid").cast("long").alias("queueid"), "router", "groupid")
             .join(t["group_map"], "groupid")
             .join(t["reports"].filter(F.col("reportname") == report), "reportid").select("queueid", "router", "reportname"))
    facts = t["facts"].withColumn("date", _day("ts")).filter(F.col("date") >= F.lit(since).cast("date"))
    if as_of is not None:
        facts = facts.filter(F.col("date") < F.lit(as_of).cast("date"))
    by_report = facts.join(small_side(chain), ["queueid", "router"]).groupBy("date", "reportname").agg(
        F.sum("presented").alias("presented"), F.sum("abandoned").alias("abandoned"))
    return by_report.groupBy("date").agg(F.sum("presented").alias("presented"), F.sum("abandoned").alias("abandoned"))


def contacts_by_day(t: Mapping[str, DataFrame], callback_report: str, source: int, routing: int, as_of: str,
                    report: str, since: str = SINCE, b2b_until: str = B2B_UNTIL) -> DataFrame:
    """Offered contacts less callbacks and business calls, per day."""
    presented = presented_by_day(t, report, since, as_of)
    callbacks = t["callbacks"].filter(F.col("reportname") == callback_report).groupBy(
        _day("calldate").alias("date")).agg(F.sum("callbacks").alias("callbacks"))
    business = t["routed"].filter((F.col("sourceid") == source) & (F.col("routingid") == routing)).withColumn(
        "date", _day("ts")).filter(F.col("date").between(F.lit(since).cast("date"), F.lit(b2b_until).cast("date"))).groupBy(
        "date").agg(F.count_distinct("contactid").alias("b2b_contacts"))
    d = presented.join(callbacks, "date", "left").join(business, "date", "left").na.fill(0)
    return d.withColumns({"week": sunday_week("date"),
                          "adjusted": F.col("presented") - F.col("callbacks") - F.col("b2b_contacts")})


def orders_by_day(t: Mapping[str, DataFrame], as_of: str, since: str = SINCE, store_types: Sequence[int] = STORE_TYPES) -> DataFrame:
    """Retail orders of the chosen store types, per day."""
    stores = small_side(t["stores"].filter(F.col("storetype").isin(list(store_types))).select("storeid"))
    d = t["orders"].filter(~F.coalesce(F.col("isb2b"), F.lit(False))).withColumn("date", _day("completed"))
    d = d.filter((F.col("date") >= F.lit(since).cast("date")) & (F.col("date") < F.lit(as_of).cast("date")))
    return d.join(stores, "storeid").groupBy("date").agg(F.count_distinct("orderid").alias("orders"))


def new_customer_share(t: Mapping[str, DataFrame], as_of: str, since: str = SINCE, store_types: Sequence[int] = STORE_TYPES,
                       known: str = KNOWN_CUSTOMER, level: str = RETAIL_LEVEL) -> DataFrame:
    """Share of orders by new customers per day, for days that have any."""
    stores = small_side(t["stores"].filter(F.col("storetype").isin(list(store_types))).select("storeid"))
    d = t["clicks"].filter(F.col("orderid").isNotNull() & (F.col("level") == level)).withColumn("date", _day("ts"))
    d = d.filter((F.col("date") >= F.lit(since).cast("date")) & (F.col("date") < F.lit(as_of).cast("date")))
    is_new = F.when(F.col("visitor") == known, 0).otherwise(1).alias("new")
    counts = d.join(stores, "storeid").groupBy("date", is_new).agg(F.count_distinct("orderid").alias("orders"))
    return share_by(counts, ["date"], "orders", F.col("new") == 1, "new_share")


def daily_contacts(t: Mapping[str, DataFrame], as_of: str, report: str, callback_report: str, source: int = 2,
                   routing: int = 6, since: str = SINCE, b2b_until: str = B2B_UNTIL,
                   level_cut: str = LEVEL_CUT, weeks_after: str = WEEKS_AFTER, store_types: Sequence[int] = STORE_TYPES,
                   known: str = KNOWN_CUSTOMER, level: str = RETAIL_LEVEL) -> DataFrame:
    """The daily source table: adjusted contacts, orders, new-customer share and
    the holidays of two countries, up to a week cut relative to `as_of`."""
    contacts = contacts_by_day(t, callback_report, source, routing, as_of, report, since, b2b_until).select(
        "date", level_adjusted(F.col("adjusted"), F.col("week"), level_cut).alias("volume"))
    base = contacts.join(orders_by_day(t, as_of, since, store_types), "date", "left").join(
        new_customer_share(t, as_of, since, store_types, known, level), "date", "left")
    us, ca = [t["holidays"].filter(F.col("country") == c).select(
        F.col("eventdate").alias("date"), F.col("name").alias(out)).distinct()
        for c, out in (("US", "us_holiday"), ("CA", "ca_holiday"))]
    # `using` coalesces the date after each outer join, so the second join
    # stays an equi-join on one column.
    d = base.join(us, "date", "full").join(ca, "date", "full").withColumn("week", sunday_week("date"))
    d = d.filter(before_week_cut("week", as_of) & (F.col("week") > F.lit(weeks_after).cast("date")))
    return d.select("week", "date", "volume", "orders", "new_share", "us_holiday", "ca_holiday")
