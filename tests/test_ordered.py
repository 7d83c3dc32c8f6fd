"""Sliced operators equal plain windows and equal pandas, on a skewed panel."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from tidemark.operators import ordered as o
from tidemark.operators import prepare
from tidemark.series import Series, require_unique


def panel(seed=0):
    """Three series; the first holds most rows; one key is NULL."""
    rng = np.random.default_rng(seed)
    frames = []
    for key, n in (("hot", 700), ("cold", 40), (None, 15)):
        steps = rng.integers(1, 5000, n).cumsum()
        v = rng.normal(size=n).round(3)
        v[rng.random(n) < 0.3] = np.nan
        frames.append(pd.DataFrame({"k": key, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(steps, unit="s"),
                                    "v": v, "u": rng.integers(0, 9, n).astype(float)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(panel(), "k string, ts timestamp_ntz, v double, u double").withColumn(
        "v", F.when(~F.isnan("v"), F.col("v"))).cache()


@pytest.fixture(scope="module")
def both(df):
    plain, sliced = Series.measure(df, ["k"], "ts"), Series.measure(df, ["k"], "ts", rows=50)
    assert not plain.sliced and sliced.sliced
    return plain, sliced


def rows(d):
    p = d.toPandas()
    return p.sort_values(["k", "ts"], na_position="first").reset_index(drop=True)[sorted(p.columns)]


OPS = {
    "number": lambda d, s: o.number_rows(d, s),
    "lags": lambda d, s: o.add_lags(d, s, ["v", "u"], {"v": [1, 3], "u": [2]}),
    "lags_keep": lambda d, s: o.add_lags(d, s, ["v"], [1, 60], dropna=False),
    "diffs": lambda d, s: o.add_diffs(d, s, ["u"], [1, 2]),
    "difference": lambda d, s: o.difference(d, s, ["u"]),
    "rolling": lambda d, s: o.rolling_sum(d, s, "u", 2, 1, "r"),
    "trailing": lambda d, s: o.trailing_mean(d, s, "v", 2, "r"),
    "ffill": lambda d, s: o.fill(d, s, ["v"], "ffill"),
    "bfill": lambda d, s: o.fill(d, s, ["v", "u"], "bfill"),
    "totals": lambda d, s: o.running_totals(d, s, {"a": ("sum", F.col("u")), "b": ("min", F.col("v")), "c": ("max", F.col("v"))}),
    "sequences": lambda d, s: prepare.to_sequences(d, s, ["u"], "u", 4, 2, 3).withColumn("seq", F.col("seq").cast("string")),
    "gaps": lambda d, s: prepare.fill_gaps(d, s, "v", "1 hour", "ffill"),
    "gaps_b": lambda d, s: prepare.fill_gaps(d, s, "v", "1 hour", "bfill"),
    "context": lambda d, s: o.with_context(prepare.split_default(d, s), s, 7),
}


@pytest.mark.parametrize("name", OPS)
def test_sliced_equals_plain(df, both, name):
    plain, sliced = (rows(OPS[name](df, s)) for s in both)
    if name == "context":
        plain, sliced = (x.sort_values(["k", "ts", "split"]).reset_index(drop=True) for x in (plain, sliced))
    pd.testing.assert_frame_equal(plain, sliced)
    assert len(plain)


def test_lags_against_pandas(df, both):
    got = rows(o.add_lags(df, both[1], ["u"], [1, 3]))
    want = panel()
    groups = want.groupby("k", dropna=False)["u"]
    want["u_lag1"], want["u_lag3"] = groups.shift(1), groups.shift(3)
    want = want[want.groupby("k", dropna=False).cumcount() >= 3].sort_values(["k", "ts"], na_position="first").reset_index(drop=True)
    np.testing.assert_allclose(got["u_lag1"], want["u_lag1"])
    np.testing.assert_allclose(got["u_lag3"], want["u_lag3"])


def test_positional_drop_is_not_a_null_drop(spark):
    d = spark.sql("SELECT * FROM VALUES (1, 1.0D), (2, NULL), (3, 3.0D), (4, 4.0D) AS t(ts, v)").withColumn(
        "ts", F.expr("date_add(DATE'2024-01-01', ts)"))
    got = o.add_lags(d, Series.of((), "ts"), ["v"], [1]).orderBy("ts").collect()
    assert [r.v_lag1 for r in got] == [1.0, None, 3.0]


def test_future_values_do_not_change_features(df, both):
    cut = pd.Timestamp("2024-01-05")
    changed = df.withColumn("u", F.when(F.col("ts") > F.lit(cut), F.lit(99.0)).otherwise(F.col("u")))
    make = lambda d: rows(o.rolling_sum(o.add_lags(d, both[0], ["u"], [1, 2]), both[0], "u", 2, 1, "r").filter(F.col("ts") <= F.lit(cut)))
    pd.testing.assert_frame_equal(make(df), make(changed))


def test_context_uses_extended_middle_part(spark):
    d = spark.range(10).select(F.expr("date_add(DATE'2024-01-01', int(id))").alias("ts"), F.col("id").alias("v"))
    d = prepare.split(d, "ts", "2024-01-07", "2024-01-08")
    got = o.with_context(d, Series.of((), "ts"), 3).orderBy("split", "ts").collect()
    parts = {n: [r.v for r in got if r.split == n] for n in ("train", "val", "test")}
    assert parts == {"train": list(range(6)), "val": [3, 4, 5, 6], "test": [4, 5, 6, 7, 8, 9]}


def test_gap_fill_matches_reindex(spark):
    stamps = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 02:30", "2024-01-01 04:00", "2024-01-01 06:00"])
    p = pd.DataFrame({"ts": stamps, "y": [1.0, None, 3.0, None, 5.0], "x": [1.0, 2, 3, 4, 5]})
    d = spark.createDataFrame(p, "ts timestamp_ntz, y double, x double").withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    full = pd.date_range(stamps.min(), stamps.max(), freq="1h").union(stamps)
    for how in ("ffill", "bfill", 0):
        want = p.set_index("ts").reindex(full)
        new = full.difference(stamps)
        filled = want["y"].fillna(how) if how == 0 else getattr(want["y"], how)()
        want.loc[new, "y"] = filled.loc[new]
        got = prepare.fill_gaps(d, Series.of((), "ts"), "y", "1 hour", how).toPandas().set_index("ts").sort_index()
        pd.testing.assert_frame_equal(got[["y", "x"]], want, check_freq=False, check_names=False)


def test_long_gaps_come_in_pieces(spark, monkeypatch):
    d = spark.sql("SELECT DATE'2024-01-01' ts, 1 y UNION ALL SELECT DATE'2024-03-05', 2 UNION ALL SELECT DATE'2024-03-06', 3")
    want = [(str(r.ts), r.y) for r in prepare.fill_gaps(d, Series.of((), "ts"), "y", "1 day", "ffill").orderBy("ts").collect()]
    assert len(want) == 66 and len(set(want)) == 66
    for chunk in (1, 7, 63, 64):
        monkeypatch.setattr(prepare, "GRID_CHUNK", chunk)
        got = [(str(r.ts), r.y) for r in prepare.fill_gaps(d, Series.of((), "ts"), "y", "1 day", "ffill").orderBy("ts").collect()]
        assert got == want


def test_gap_fill_on_dates_and_errors(spark):
    d = spark.sql("SELECT DATE'2024-01-01' ts, 1 y UNION ALL SELECT DATE'2024-01-05', 2")
    assert prepare.fill_gaps(d, Series.of((), "ts"), "y", "2 days", 0).count() == 3
    with pytest.raises(ValueError):
        require_unique(d.unionAll(d), Series.of((), "ts"))
    with pytest.raises(Exception, match="duplicate timestamp"):
        prepare.fill_gaps(d.unionAll(d), Series.of((), "ts"), "y", "1 day", 0).collect()
    with pytest.raises(ValueError):
        prepare.interval_micros("1 month")


def test_equal_cuts_leave_val_empty(spark):
    d = spark.range(10).select(F.expr("date_add(DATE'2024-01-01', int(id))").alias("ts"))
    got = {r.split: r["count"] for r in prepare.split(d, "ts", "2024-01-04", "2024-01-04").groupBy("split").count().collect()}
    assert got == {"train": 3, "test": 7}


def test_panel_equals_loop(df, both):
    for key in ("hot", "cold"):
        alone = df.filter(F.col("k") == key)
        one = rows(o.add_diffs(alone, Series.of((), "ts"), ["u"], [1, 2]))
        many = rows(o.add_diffs(df, both[0], ["u"], [1, 2]).filter(F.col("k") == key))
        pd.testing.assert_frame_equal(one, many)


def test_fill_values_with_directions(spark):
    d = spark.sql("""SELECT * FROM VALUES (1, NULL, 'x', 1.0D, NULL), (2, 5.0D, NULL, NULL, 7L), (3, NULL, NULL, NULL, NULL) AS t(i, v, c, w, n)""")
    d = d.withColumn("ts", F.expr("date_add(DATE'2024-01-01', i)"))
    got = prepare.fill_values(d, {"v": "bfill", "c": "ffill", "w": -1.0}, s=Series.of((), "ts")).orderBy("ts").collect()
    assert [(r.v, r.c, r.w, r.n) for r in got] == [(5.0, "x", 1.0, 0), (5.0, "x", -1.0, 7), (None, "x", -1.0, 0)]
    with pytest.raises(ValueError):
        prepare.fill_values(d, {"v": "ffill"})


def test_backward_fill_takes_one_pass(spark):
    """A frame that reaches forward would take time with the square of the series."""
    d = spark.range(300_000).selectExpr("1 AS k", "timestamp_seconds(id) AS ts", "CAST(NULL AS DOUBLE) AS v")
    d = d.union(spark.sql("SELECT 1, timestamp_seconds(300000), 5.0D"))
    got = o.fill(d, Series.of(["k"], "ts"), ["v"], "bfill")
    assert got.filter("v = 5").count() == 300_001
    assert "UNBOUNDED FOLLOWING" not in got._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING", "UNBOUNDED FOLLOWING")


@pytest.mark.parametrize("name", ["i1_gap_fill_timeless_rows_all", "i1_gap_fill_timeless_rows_all_sliced"])
def test_timeless_rows_of_every_customer(spark, name):
    sf = "/root/testdata/sf0.001"
    got = {r[0] for r in entry.queries()[name](spark, sf).select("k").distinct().collect()}
    want = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()}
    assert got == want and len({k % 3 for k in want}) == 3
