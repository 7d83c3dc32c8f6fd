"""A whole forecasting experiment: land, regularise, search, keep the best.

Stages that several trials share are computed once: trials are grouped by the
parameters that shape their data, each group's table is persisted, and all
linear candidates of a group are scored from one set of moments.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.columns import attach, join_on, numeric_columns, quoted
from tidemark.operators import arima, boost, features, folds as fold_ops, linear, metrics, models, outliers, prepare, search
from tidemark.operators.aggregate import MISSING_THRESHOLD, missing_profile
from tidemark.operators.ordered import number_rows
from tidemark.series import Series
from tidemark.session import TEST, TRAIN, VAL
from tidemark.sources.store import Store, land

LINEAR = linear.KINDS
BOOSTED = ("xgb", "lgbm")
MODELS = (*LINEAR, *BOOSTED, "sarimax")
Hook = Callable[[Mapping[str, Any], DataFrame, Series], DataFrame]


def _unchanged(params: Mapping[str, Any], df: DataFrame, s: Series) -> DataFrame:
    return df


@dataclass(frozen=True)
class Experiment:
    """Everything that defines an experiment; nothing is read from globals."""

    loader: Callable[[SparkSession], DataFrame]
    target: str
    keys: tuple[str, ...] = ()
    ts: str = "ts"
    every: str = "1 day"
    target_gap_fill: str | float = 0
    train_val_date: Any = None
    val_test_date: Any = None
    preprocess: Hook = _unchanged
    make_features: Hook = _unchanged
    hook_space: Mapping[str, tuple] = field(default_factory=dict)
    categorical: tuple[str, ...] = ()
    imputers: tuple[Any, ...] = ("mean",)
    outlier_methods: tuple[str | None, ...] = (None,)
    scalers: tuple[str | None, ...] = ("minmax",)
    models: tuple[str, ...] = ("ridge",)
    model_spaces: Mapping[str, Mapping[str, tuple]] = field(default_factory=lambda: search.SEARCH_SPACES)
    metric: str = "neg_mean_squared_error"
    scored_on: str = VAL
    inner_trials: int = 100
    inner_search: str = "random"
    model_grids: Mapping[str, Mapping[str, Sequence[Any]]] = field(default_factory=lambda: search.SEARCH_GRIDS)
    cv_scheme: str = "equal"
    cv_folds: int = 5
    cv_mode: str = fold_ops.EXPANDING
    cv_window: int | None = None
    cv_step: int | None = None
    horizons: tuple[int, ...] | None = None
    seq_len: int = 6
    seq_sampling: int = 1
    seed: int = 0
    threads: int = 4

    def __post_init__(self) -> None:
        unknown = [m for m in self.models if m not in MODELS]
        if unknown or not self.models:
            raise ValueError(f"unknown models {unknown}; known: {MODELS}")
        # Unknown outlier names are left out, as the search has always done.
        object.__setattr__(self, "outlier_methods", tuple(m for m in self.outlier_methods if m in outliers.METHODS))
        if not self.outlier_methods:
            raise ValueError("no known outlier method is left")
        if self.inner_search not in ("random", "grid"):
            raise ValueError(f"unknown inner search {self.inner_search!r}")
        if self.scored_on not in (TRAIN, VAL, TEST, "train_cv_score"):
            raise ValueError(f"cannot score on {self.scored_on!r}")


@dataclass
class Prepared:
    """Landed and regularised data, with its missing profile."""

    data: DataFrame
    series: Series
    missing: DataFrame


def prepare_data(spark: SparkSession, e: Experiment, store: Store) -> Prepared:
    raw = land(spark, e.loader, store)
    s = Series.measure(raw, e.keys, e.ts)
    regular = store.write(prepare.fill_gaps(raw, s, e.target, e.every, e.target_gap_fill), "eda")
    return Prepared(regular, s, missing_profile(regular, MISSING_THRESHOLD))


def _split(e: Experiment, df: DataFrame, original: DataFrame, s: Series) -> DataFrame:
    """Split at given dates, or at 70 % and 90 % of the range before the hook."""
    if e.train_val_date is not None and e.val_test_date is not None:
        return prepare.split(df, e.ts, e.train_val_date, e.val_test_date)
    cut = prepare.default_split_dates(original, Series.of((), e.ts)).first()
    at = prepare.epoch_micros(df, e.ts)
    first = at < F.lit(cut.cut1) if e.train_val_date is None else F.col(e.ts) < F.lit(e.train_val_date).cast(df.schema[e.ts].dataType)
    second = at < F.lit(cut.cut2) if e.val_test_date is None else F.col(e.ts) < F.lit(e.val_test_date).cast(df.schema[e.ts].dataType)
    return df.withColumn("split", F.when(first, TRAIN).when(second, VAL).otherwise(TEST))


def build_features(e: Experiment, p: Prepared, params: Mapping[str, Any]) -> DataFrame:
    """Hook, split, imputation and features of one trial."""
    d = _split(e, e.preprocess(params, p.data, p.series), p.data, p.series)
    d = prepare.impute(d, params["imputer"], p.series, e.target)
    return features.apply_features(d, p.series, e.make_features, params)


def to_encode(e: Experiment, d: DataFrame) -> list[str]:
    return features.encodable(d, e.categorical, [*e.keys, e.ts])


def finish_table(e: Experiment, s: Series, d: DataFrame, encoder: features.OneHot, outlier_method: str | None) -> DataFrame:
    """Encoding and outlier removal."""
    d = encoder.transform(d)
    options = {"id_cols": [*s.keys, s.ts]} if outlier_method == "isolationforest" else {}
    return outliers.remove_outliers(d, outlier_method, numeric_columns(d, {*s.keys, s.ts}), e.seq_len, e.seq_sampling, **options)


def build_table(e: Experiment, p: Prepared, params: Mapping[str, Any]) -> DataFrame:
    """Everything between landing and modelling for one trial."""
    d = build_features(e, p, params)
    encoder = features.OneHot.fit(d, to_encode(e, d), params["min_frequency"])
    return finish_table(e, p.series, d, encoder, params["outlier_method"])


def _inner_candidates(spark: SparkSession, e: Experiment, model: str) -> list[dict[str, Any]]:
    """The inner search of one model, the same in every trial: random draws, or
    every combination of its grid."""
    if e.inner_search == "grid":
        return search.expand_grid(e.model_grids[model])
    space = e.model_spaces[model]
    drawn = sorted(search.sample_space(spark, space, e.inner_trials, e.seed).collect(), key=lambda r: r["trial"])
    seen = {json.dumps({k: r[k] for k in space}, sort_keys=True, default=str): {k: r[k] for k in space} for r in drawn}
    return list(seen.values())


def _losses(pred: DataFrame, e: Experiment) -> dict[str, float | None]:
    return {r["split"]: r["loss"] for r in metrics.evaluate(pred, {"loss": e.metric}).collect()}


Draws = Mapping[str, Sequence[Mapping[str, Any]]]


def run_linear(e: Experiment, table: DataFrame, s: Series, names: Sequence[str], scaler: str | None, drawn: Draws,
               save: Callable[[DataFrame], Any] | None = None) -> dict[str, dict[str, Any]]:
    """Tune, fit and score several linear models together.

    All candidates of all models are scored from one set of fold moments, the
    winners are fitted from one more, and one pass over the table scores them.
    """
    tried = [(m, c) for m in names for c in drawn[m]]
    cols = numeric_columns(table, {*s.keys, s.ts, e.target})
    train = table.filter(F.col("split") == TRAIN)
    options = [linear.candidate(m, **c) for m, c in tried]
    shift = linear.centre(train, [*cols, e.target])
    scores = linear.cross_validate(train, s, e.target, cols, options, e.cv_scheme, e.cv_folds, e.cv_mode, None, e.cv_window,
                                   e.cv_step, e.horizons, e.metric, scaled=scaler == "minmax", shift=shift,
                                   target_units=True)  # one unit, whatever the scaler
    # One row per candidate.
    cv = {r["candidate"]: r["cv_score"] for r in linear.cv_score(scores).collect()}
    best = {}
    for m in names:
        mine = [i for i, (n, _) in enumerate(tried) if n == m and cv.get(i) is not None]
        if not mine:
            raise ValueError("too few train rows for the cross-validation folds")
        best[m] = min(mine, key=lambda i: (cv[i], i))
    fitted = linear.fit_linear(train, s.keys, e.target, cols, [options[best[m]] for m in names],
                               scaled=scaler == "minmax", shift=shift)
    per_series = fitted.groupBy(*s.keys).agg(
        F.array_sort(F.collect_list(F.struct("candidate", "coef", "intercept"))).alias("__fits"))
    d = attach(linear.complete_rows(table, [*cols, e.target]), per_series, s.keys)
    y = F.col(quoted(e.target)).cast("double")
    guesses = {m: linear.dot(F.col("__fits")[k]["coef"], cols) + F.col("__fits")[k]["intercept"] for k, m in enumerate(names)}
    if save is not None:
        save(d.select(*s.keys, s.ts, "split", y.alias("actual"), guesses[names[0]].alias("predicted")))
    row = d.agg(*[metrics.split_losses(y, g, {"loss": e.metric}).alias(m) for m, g in guesses.items()]).first()
    out = {}
    for m in names:
        loss = {p["split"]: p["loss"] for p in row[m]}
        out[m] = search.performance_row(tried[best[m]][1], loss[TRAIN], loss[VAL], loss[TEST], cv[best[m]])
    return out


# Grid step of a row in model tables of autoregressions.
STEP = "tm_step"


def with_steps(table: DataFrame, s: Series, grid: DataFrame | None) -> DataFrame:
    """Number the rows of a model table by their place in the data before any
    hook, so that rows a hook drops leave holes. Rows of a table whose hook made
    other timestamps are numbered as they are."""
    if grid is not None:
        places = number_rows(grid.select(*s.keys, s.ts), s, STEP)
        placed = join_on(table, places, [*s.keys, s.ts], "left")
        if placed.filter(F.col(STEP).isNull()).isEmpty():
            return placed
    return number_rows(table, s, STEP)


def run_model(e: Experiment, table: DataFrame, s: Series, model: str, scaler: str | None, drawn: Draws,
              save: Callable[[DataFrame], Any] | None = None, grid: DataFrame | None = None) -> dict[str, Any]:
    """Tune by cross-validation on train, fit on all of train, score every split.

    `grid` is the data before the hooks; autoregressions count its steps.
    """
    if model in LINEAR:
        return run_linear(e, table, s, [model], scaler, drawn, save)[model]
    candidates = drawn[model]
    cols = numeric_columns(table, {*s.keys, s.ts, e.target})
    train = table.filter(F.col("split") == TRAIN)
    if model in BOOSTED:
        params, cv, fitted = _tune_boosted(e, train, s, cols, candidates, model)
        pred = models.predict_gbt(fitted, table.na.drop(subset=[e.target]))
    else:
        table = with_steps(table, s, grid)
        train = table.filter(F.col("split") == TRAIN)
        params, cv = _tune_arima(e, train, s, cols, candidates)
        fitted = arima.fit_arimax(train, s, e.target, cols, **params, step=STEP)
        later = table.filter(F.col("split") != TRAIN)
        pred = arima.forecast_arimax(fitted, later, s, cols, step=STEP)
        pred = pred.unionByName(arima.fitted_arimax(fitted, train, s, e.target, cols, step=STEP)).filter("predicted IS NOT NULL")
    pred = metrics.actual_vs_predicted(pred, s.keys, s.ts, e.target)
    if save is not None:
        save(pred)
    loss = _losses(pred, e)
    return search.performance_row(params, loss[TRAIN], loss[VAL], loss[TEST], cv)


@dataclass(frozen=True)
class Folds:
    """Numbered train rows and the row bounds of every fold of every series.

    Rows are never copied per fold: a fold is a filter on the row number.
    """

    rows: DataFrame
    bounds: DataFrame
    keys: tuple[str, ...]
    count: int

    @classmethod
    def of(cls, e: Experiment, train: DataFrame, s: Series) -> Folds:
        n, keys = fold_ops.series_length(train, s), list(s.keys)
        none = F.lit(None).cast("array<long>").alias("horizons")
        if e.cv_scheme == "rolling":
            d = fold_ops.folds_rolling(n, keys, e.cv_window, e.cv_step, e.horizons, e.cv_mode)
            d = d.select(*keys, "fold", "train_lo", "train_hi", F.col("train_hi").alias("test_lo"),
                         (F.col("train_hi") + F.array_max("horizons")).alias("test_hi"), "horizons")
        elif e.cv_scheme == "kfold":
            d = fold_ops.folds_plain(n, keys, e.cv_folds)
            d = d.select(*keys, "fold", F.lit(0).cast("long").alias("train_lo"), F.lit(2**62).alias("train_hi"), "test_lo", "test_hi", none)
        else:
            d = fold_ops.folds_equal(n, keys, e.cv_folds)
            if e.cv_mode == fold_ops.SLIDING:
                # A window of test length, unless one is given.
                width = F.lit(e.cv_window).cast("long") if e.cv_window else F.col("test_hi") - F.col("test_lo")
                d = d.withColumn("train_lo", F.greatest(F.col("train_hi") - width, F.lit(0).cast("long")))
            d = d.select(*keys, "fold", "train_lo", "train_hi", "test_lo", "test_hi", none)
        d = d.persist()
        last = d.agg(F.max("fold")).first()[0]
        rows = number_rows(train, s, "__rn").persist()
        return cls(rows, d, tuple(keys), 0 if last is None else int(last) + 1)

    def parts(self, fold: int) -> tuple[DataFrame, DataFrame]:
        """Train and test rows of one fold, the latter with `__used`, false
        for rows that lie between the horizons asked for."""
        d = attach(self.rows, self.bounds.filter(F.col("fold") == fold).drop("fold"), self.keys)
        at = F.col("__rn") - 1
        test = (at >= F.col("test_lo")) & (at < F.col("test_hi"))
        used = F.col("horizons").isNull() | F.array_contains("horizons", at - F.col("train_hi") + 1)
        names = [c for c in self.rows.columns if c != "__rn"]
        train = d.filter((at >= F.col("train_lo")) & (at < F.col("train_hi")) & ~test).select(*names)
        return train, d.filter(test).select(*names, used.alias("__used"))

    def marked(self) -> DataFrame:
        """The rows with `__marks`: for each fold whether they train or are tested
        in it, and one entry more that trains on all."""
        bound = F.struct("train_lo", "train_hi", "test_lo", "test_hi", "horizons")
        of = self.bounds.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("fold").cast("int"), bound))).alias("__of"))
        d, at = attach(self.rows, of, self.keys), F.col("__rn") - 1

        def mark(fold: Column) -> Column:
            b = F.try_element_at("__of", fold)
            test = (at >= b["test_lo"]) & (at < b["test_hi"])
            used = b["horizons"].isNull() | F.array_contains(b["horizons"], at - b["train_hi"] + 1)
            train = (at >= b["train_lo"]) & (at < b["train_hi"])
            return F.when(test, F.when(used, boost.TESTED).otherwise(0)).when(train, boost.TRAINED).otherwise(0).cast("tinyint")

        folds = F.transform(F.sequence(F.lit(0), F.lit(self.count - 1)), mark)
        return d.withColumn("__marks", F.concat(folds, F.array(F.lit(boost.TRAINED).cast("tinyint")))).drop("__of", "__rn")

    def release(self) -> None:
        self.rows.unpersist()
        self.bounds.unpersist()


def _mean_losses(e: Experiment, folds: Folds, candidates: int, loss: Callable[[int, DataFrame, DataFrame], DataFrame]) -> dict[int, float]:
    """Mean loss of each candidate over all folds; `loss` gives predictions.
    Independent fits share a thread pool."""
    def one(job: tuple[int, int]) -> tuple[int, float | None]:
        c, f = job
        train, test = folds.parts(f)
        got = loss(c, train, test).filter("__used")
        return c, got.agg(metrics.metric_of(e.metric)(F.col(quoted(e.target)).cast("double"), F.col("predicted"))).first()[0]

    jobs = [(c, f) for c in range(candidates) for f in range(folds.count)]
    with ThreadPoolExecutor(max(1, e.threads)) as pool:
        results = list(pool.map(inheritable_thread_target(one), jobs))
    found = {c: [v for k, v in results if k == c and v is not None] for c in range(candidates)}
    means = {c: sum(v) / len(v) for c, v in found.items() if v}
    if not means:
        raise ValueError("too few train rows for the cross-validation folds")
    return means


def _tune_boosted(e: Experiment, train: DataFrame, s: Series, cols: Sequence[str], candidates: Sequence[Mapping[str, Any]],
                  model: str) -> tuple[dict, float, boost.Boosted]:
    """All candidates on all folds and on the whole of train grow together."""
    folds = Folds.of(e, train, s)
    try:
        if not folds.count:
            raise ValueError("too few train rows for the cross-validation folds")
        n = folds.count + 1
        row_id = F.xxhash64(*[F.col(quoted(c)) for c in (*s.keys, s.ts)])
        fitted, blocks = boost.fit_many(folds.marked(), e.target, cols, candidates, F.col("__marks"), n, row_id, **models.ADAPTERS[model])
        loss = metrics.metric_of(e.metric)(F.col("actual"), F.col("predicted"))
        rows = boost.tested(fitted, blocks, n).groupBy("model").agg(loss.alias("loss")).collect()
    finally:
        folds.release()
    found = {c: [r["loss"] for r in rows if r["model"] // n == c and r["loss"] is not None] for c in range(len(candidates))}
    means = {c: sum(v) / len(v) for c, v in found.items() if v}
    best = min(means, key=lambda c: (means[c], c))
    return dict(candidates[best]), means[best], fitted.only(best * n + folds.count)


def _tune_arima(e: Experiment, train: DataFrame, s: Series, cols: Sequence[str], candidates: Sequence[Mapping[str, Any]]) -> tuple[dict, float]:
    folds = Folds.of(e, train, s)
    try:
        means = _mean_losses(e, folds, len(candidates), lambda c, fit, test: arima.forecast_arimax(
            arima.fit_arimax(fit, s, e.target, cols, **candidates[c], step=STEP), test, s, cols, step=STEP))
    finally:
        folds.release()
    best = min((c for c in means if means[c] is not None), key=lambda c: (means[c], c))
    return dict(candidates[best]), means[best]


def _run_trials(e: Experiment, p: Prepared, trials: Sequence[Mapping[str, Any]], drawn: Draws) -> list[tuple]:
    """Score all trials, computing every shared stage once.

    Trials share features by imputer and hook parameters, and a model table
    when their frequency thresholds pick the same categories. Independent
    tables run in a small thread pool.
    """
    shared: dict[str, list[Mapping[str, Any]]] = {}
    for t in trials:
        shape = {k: str(t[k]) for k in ("imputer", *e.hook_space)}
        shared.setdefault(json.dumps(shape, sort_keys=True), []).append(t)

    def encoders(members: list[Mapping[str, Any]]) -> tuple[DataFrame, list[tuple[Any, list[Mapping[str, Any]]]]]:
        d = build_features(e, p, members[0]).persist()
        cols = to_encode(e, d)
        groups: dict[str, tuple[Any, list[Mapping[str, Any]]]] = {}
        fitted: dict[float, features.OneHot] = {}
        counts = features.category_counts(d.filter(F.col("split") == TRAIN), cols).limit(2_001).collect() if cols else []
        for t in members:
            f = t["min_frequency"]
            if f not in fitted:
                few = len(counts) <= 2_000
                fitted[f] = (features.OneHot.from_counts(cols, [tuple(c) for c in counts], f) if few
                             else features.OneHot.fit(d, cols, f))
            same = repr((fitted[f].frequent, fitted[f].rare, t["outlier_method"]))
            groups.setdefault(same, (fitted[f], []))[1].append(t)
        return d, list(groups.values())

    def run_group(job: tuple[DataFrame, features.OneHot, list[Mapping[str, Any]]]) -> list[tuple]:
        d, encoder, members = job
        table = finish_table(e, p.series, d, encoder, members[0]["outlier_method"]).persist()
        done: dict[tuple, dict[str, Any]] = {}
        try:
            for scaler in {t["scaler"]: None for t in members}:
                wanted = list(dict.fromkeys(t["model"] for t in members if t["scaler"] == scaler))
                together = [m for m in wanted if m in LINEAR]
                got = run_linear(e, table, p.series, together, scaler, drawn) if together else {}
                # Scaling changes neither trees nor ARIMA: one run serves all scalers.
                for m in (m for m in wanted if m not in LINEAR):
                    same = next((r for (name, _), r in done.items() if name == m), None)
                    got[m] = same or run_model(e, table, p.series, m, scaler, drawn, grid=p.data)
                done |= {(m, scaler): r for m, r in got.items()}
            return [_trial_row(t, done[t["model"], t["scaler"]], e) for t in members]
        finally:
            table.unpersist()

    # No more feature tables are alive than threads.
    waiting, out = list(shared.values()), []
    with ThreadPoolExecutor(max(1, e.threads)) as pool:
        for k in range(0, len(waiting), max(1, e.threads)):
            stages = list(pool.map(inheritable_thread_target(encoders), waiting[k: k + max(1, e.threads)]))
            jobs = [(d, encoder, members) for d, groups in stages for encoder, members in groups]
            try:
                out += [r for part in pool.map(inheritable_thread_target(run_group), jobs) for r in part]
            finally:
                for d, _ in stages:
                    d.unpersist()
    return out


def search_pipelines(spark: SparkSession, e: Experiment, store: Store, n_trials: int = 100,
                     direction: str = "minimize") -> tuple[DataFrame, dict[str, Any]]:
    """Random search over whole pipelines.

    Returns the table of all trials and the best choice with its model
    parameters and cross-validation score.
    """
    prepared = prepare_data(spark, e, store)
    store.write(prepared.missing, "missing")
    names = {"imputer": e.imputers, "outlier_method": e.outlier_methods, "scaler": e.scalers, "model": e.models}
    space = {k: ("cat", tuple(range(len(v)))) for k, v in names.items()}
    space |= {"min_frequency": ("float", 0.0, 0.5, None), **e.hook_space}
    drawn = sorted(search.sample_space(spark, space, n_trials, e.seed).collect(), key=lambda r: r["trial"])
    trials = []
    for r in drawn:
        params = {**r.asDict(), **{k: v[r[k]] for k, v in names.items()}}
        trials.append(params)
    inner = {m: _inner_candidates(spark, e, m) for m in {t["model"]: None for t in trials}}
    rows = _run_trials(e, prepared, trials, inner)
    schema = ("trial long, imputer string, outlier_method string, scaler string, min_frequency double, model string, "
              "hook_params string, model_params string, train double, val double, test double, train_cv_score double, score double")
    table = store.write(spark.createDataFrame(rows, schema), "trials")
    best = search.best_trial(table, direction=direction).first()
    if best is None:
        raise ValueError(f"no trial has a score on {e.scored_on}")
    chosen = next(t for t in trials if t["trial"] == best.trial)
    final_table = build_table(e, prepared, chosen)
    # The rerun keeps what the search did not: the predictions of every split.
    final = run_model(e, final_table, prepared.series, chosen["model"], chosen["scaler"], inner,
                      save=lambda pred: store.write(pred, "modeling", chosen["trial"]), grid=prepared.data)
    store.write_result(final, "_".join(["modeling", *[f"{k}_{v}" for k, v in final["best_params"].items()]]))
    return table, {**{k: chosen[k] for k in ("imputer", "outlier_method", "scaler", "min_frequency", *e.hook_space)},
                   "model": (chosen["model"], (json.loads(best.model_params), best.train_cv_score)), "performance": final}


def _trial_row(t: Mapping[str, Any], r: Mapping[str, Any], e: Experiment) -> tuple:
    score = r[e.scored_on]
    text = lambda v: None if v is None else str(v)
    return (t["trial"], text(t["imputer"]), text(t["outlier_method"]), text(t["scaler"]), t["min_frequency"], t["model"],
            json.dumps({k: t[k] for k in e.hook_space}, sort_keys=True), json.dumps(r["best_params"], sort_keys=True),
            r["train"], r["val"], r["test"], r["train_cv_score"], score)
