"""Structural fits: trend, level, calendar effects and holiday distortion.

Parameter sets that agree on what a step depends on share that step: effects per
recency, lookback and weekday shrinkage, the in-sample mean also per interaction
shrinkage, the distortion also per exponent and tilt. The remaining parameters
enter horizon expressions only, so a grid of 6,561 points needs 27 sets of effects
per run. The shared parameters are spelled out in string keys, since Spark
normalises floating-point grouping keys and would exchange the rows again.

A run reads at most one row per day, so a group (run, parameters) is bounded by
the length of the calendar, never by the fact tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidecast.functions.dates import business_day_add, month_start
from tidecast.functions.numeric import clip
from tidecast.schemas import PARAM_NAMES
from tidecast.staging import days_of, join_sharded, salts, sharded, spread, stage

TREND_KEY = ["run_id", "recency_strength"]
LEVEL_KEY = [*TREND_KEY, "level_lookback_days"]
EFFECT_PARAMS = ["recency_strength", "level_lookback_days", "dow_shrinkage"]
SEASONAL_PARAMS = [*EFFECT_PARAMS, "interaction_shrinkage"]
DISTORTION_PARAMS = [*SEASONAL_PARAMS, "seasonal_exponent", "trend_seasonal_tilt"]
# the key that differs early comes first: sorts then decide on its first bytes
EFFECT_KEY = ["effect_key", "run_id", "salt"]
SEASONAL_KEY = ["seasonal_key", "run_id"]
DISTORTION_KEY = ["distortion_key", "run_id"]

TREND_COLUMNS = ["intercept", "slope", "n_train", "last_day"]
WEEKDAYS = range(5)
MOY_SLOTS = 13  # (weekday, month) pairs share one integer key


@dataclass(frozen=True)
class ModelSpec:
    """What distinguishes one model from another, apart from the swept parameters."""

    name: str
    defaults: dict[str, float]
    # rows that shape the seasonal effects
    completed_months_only: bool = True
    exclude_halo: bool = False
    december_only: bool = False
    exclude_months: tuple[int, ...] = ()
    # effects
    use_dom: bool = True
    use_moy: bool = True
    dow_shrinkage_multipliers: dict[int, float] = field(default_factory=dict)
    moy_recency_strength: float = 0.0
    rank_weighted_level: bool = False
    target_scale: float = 1.0
    # in-sample expectation
    expected_normalised: bool = True
    expected_uses_moy: bool = True
    # holiday distortion
    holiday_before: int = 2
    holiday_after: int = 4
    holiday_shrinkage: float = 0.3
    distortion_min_obs: int = 2
    distortion_max_factor: float | None = None
    distortion_lookback_days: int | None = None
    per_key_caps: dict[tuple[int, int], float] = field(default_factory=dict)
    december_holidays_only: bool = False
    mon_thu_fraction: float | None = None
    # horizon
    mom_dampening: float = 0.0
    cliff_day: int | None = None
    cliff_shrinkage: float = 0.5
    # week-of-year guard
    woy_cliff: bool = False
    woy_shrinkage: float = 0.50
    woy_min: float = 0.70
    woy_max: float = 1.30
    woy_min_obs: int = 2
    woy_weeks: tuple[int, ...] = (*range(47, 53), *range(1, 14))

    @property
    def learns_distortion(self) -> bool:
        """With full shrinkage every factor is exactly 1."""
        return self.holiday_shrinkage < 1.0

    @property
    def n_offsets(self) -> int:
        return self.holiday_before + self.holiday_after + 1

    def offsets(self) -> list[int]:
        return [o for o in range(-self.holiday_before, self.holiday_after + 1) if o != 0]


def _params(recency, dow, inter, expo, damp, lift, lookback, tilt) -> dict[str, float]:
    return dict(zip(PARAM_NAMES, (recency, dow, inter, expo, damp, lift, lookback, tilt)))


# The defaults of the four models.
MODEL_A = ModelSpec("A", _params(0.35, 0.25, 0.35, 1.02, 0.83, 0.0025, 60, 0.08))
MODEL_B = ModelSpec(
    "B",
    _params(1.0, 0.05, 0.2, 1.0, 0.70, 0.0, 60, 0.0),
    exclude_halo=True,
    expected_normalised=False,
    holiday_shrinkage=0.2,
    distortion_min_obs=3,
    distortion_max_factor=1.1,
    distortion_lookback_days=730,
)
MODEL_C = ModelSpec(
    "C",
    _params(3.0, 0.15, 0.25, 1.0, 0.80, 0.0, 60, 0.0),
    exclude_halo=True,
    december_only=True,
    use_moy=False,
    expected_normalised=False,
    expected_uses_moy=False,
    holiday_before=2,
    holiday_after=6,
    holiday_shrinkage=0.2,
    distortion_max_factor=1.4,
    december_holidays_only=True,
    cliff_day=18,
)
MODEL_R = ModelSpec(
    "R",
    _params(0.55, 0.15, 0.60, 1.02, 0.75, 0.004, 30, 0.12),
    completed_months_only=False,
    use_dom=False,
    dow_shrinkage_multipliers={0: 0.50, 1: 1.60, 2: 0.80, 3: 0.90, 4: 0.80},
    rank_weighted_level=True,
    target_scale=1_000_000.0,
    expected_uses_moy=False,
    holiday_before=1,
    holiday_after=2,
    holiday_shrinkage=1.0,
)


def default_fits(runs: DataFrame, spec: ModelSpec, param_id: int = 0) -> DataFrame:
    """One parameter set per run: the defaults of the model."""
    return runs.select(
        "run_id",
        F.lit(param_id).cast("long").alias("param_id"),
        *[
            F.lit(spec.defaults[p]).cast("int" if p == "level_lookback_days" else "double")
            .alias(p)
            for p in PARAM_NAMES
        ],
    )


def with_step_keys(fits: DataFrame) -> DataFrame:
    """Name the parameters each step depends on; the salt follows from the effect key."""
    def key(params: list[str]) -> Column:
        return F.concat_ws("|", *[F.col(p).cast("string") for p in params])

    keyed = fits.withColumns(
        {
            "effect_key": key(EFFECT_PARAMS),
            "seasonal_key": key(SEASONAL_PARAMS),
            "distortion_key": key(DISTORTION_PARAMS),
        }
    )
    return keyed.withColumn("salt", F.pmod(
        F.xxhash64("effect_key"), F.lit(salts(fits.sparkSession))).cast("int"))


def holiday_halo(holidays: DataFrame, before: int, after: int) -> DataFrame:
    """Weekdays within calendar days -before..+after of any holiday."""
    near = F.sequence(F.date_sub("calendar_date", before), F.date_add("calendar_date", after))
    return (
        holidays.select(F.explode(near).alias("day")).filter(F.weekday("day") < 5).distinct()
    )


def holiday_days(calendar: DataFrame) -> DataFrame:
    return calendar.filter("is_holiday = 1").select("calendar_date")


def training_rows(history: DataFrame, runs: DataFrame, calendar: DataFrame,
                  spec: ModelSpec) -> DataFrame:
    """Weekday rows of every run with their masks and positions."""
    return for_model(training_table(history, runs, calendar, [spec]), spec)


#: What differs between models that are trained on the same days.
MODEL_COLUMNS = ["in_halo", "seasonal", "year_weight", "t_expected"]


def training_table(history: DataFrame, runs: DataFrame, calendar: DataFrame,
                   specs: list[ModelSpec]) -> DataFrame:
    """Weekday rows of every run, once for all models, with a set of masks for each.

    ``t`` counts all days of the run, ``p`` its production days, ``pos`` its
    weekdays; weekends only matter for ``t`` and are dropped at the end. Models share
    their rows, so they must scale the target and leave out months alike.
    """
    shared = specs[0]
    if any((s.exclude_months, s.target_scale) != (shared.exclude_months, shared.target_scale)
           for s in specs):
        raise ValueError("these models are trained on different rows")
    holidays = holiday_days(calendar)
    flag = holidays.select(F.col("calendar_date").alias("day"), F.lit(1).alias("hol"))
    span = runs.select("run_id", "series_id", "train_start", "train_end")
    rows = days_of(span, "train_start", "train_end").join(history, ["series_id", "day"])
    if shared.exclude_months:
        rows = rows.filter(~F.month("day").isin(*shared.exclude_months))
    rows = rows.join(F.broadcast(flag), "day", "left")
    halos = {(s.holiday_before, s.holiday_after) for s in specs if s.exclude_halo}
    for before, after in sorted(halos):
        halo = holiday_halo(holidays, before, after).withColumn(f"halo_{before}_{after}", F.lit(1))
        rows = rows.join(F.broadcast(halo), "day", "left")

    work = F.weekday("day") < 5
    prod = work & F.col("hol").isNull() & (F.col("amount") > 0)
    run = Window.partitionBy("run_id")
    by_day = run.orderBy("day")
    rows = rows.select(
        "run_id",
        "series_id",
        "day",
        (F.col("amount") / shared.target_scale).alias("y"),
        F.weekday("day").alias("dow"),
        F.dayofmonth("day").alias("dom"),
        F.month("day").alias("moy"),
        F.col("hol").isNotNull().alias("is_holiday"),
        F.coalesce(prod, F.lit(False)).alias("prod"),
        (F.row_number().over(by_day) - 1).alias("t"),
        (F.count_if(prod).over(by_day) - 1).alias("p"),
        (F.count_if(work).over(by_day) - 1).alias("pos"),
        F.count_if(prod).over(run).alias("n_prod"),
        F.count("*").over(run).alias("n_train"),
        F.max("day").over(run).alias("last_day"),
        *[f"halo_{before}_{after}" for before, after in sorted(halos)],
    )
    for spec in specs:
        rows = rows.withColumns({f"{c}_{spec.name}": v for c, v in _masks(spec, run).items()})
        rows = rows.withColumns(
            {f"{c}_{spec.name}": v for c, v in _positions(spec, run).items()})
    own = [f"{c}_{s.name}" for s in specs for c in MODEL_COLUMNS]
    return rows.filter(F.col("dow") < 5).select(*TRAIN_COLUMNS, *own)


TRAIN_COLUMNS = ["run_id", "series_id", "day", "y", "dow", "dom", "moy", "is_holiday", "prod", "t", "p",
                 "pos", "n_prod", "n_train", "last_day"]


def _masks(spec: ModelSpec, run: WindowSpec) -> dict[str, Column]:
    """Days near a holiday, and the rows that a model's seasonal effects come from."""
    halo = F.lit(False)
    if spec.exclude_halo:
        halo = F.col(f"halo_{spec.holiday_before}_{spec.holiday_after}").isNotNull()
    seasonal = F.col("prod") & ~halo
    if spec.completed_months_only:
        seasonal = seasonal & (F.col("day") < month_start(F.col("last_day")))
    if spec.december_only:
        seasonal = seasonal & (F.col("moy") == 12)
    return {"in_halo": halo, "seasonal": seasonal}


def _positions(spec: ModelSpec, run: WindowSpec) -> dict[str, Column]:
    """Weight of a row's year, and its position in the slice that expectations use."""
    weight, t_expected = F.lit(1.0), F.col("t")
    if spec.moy_recency_strength:
        year, seasonal = F.year("day"), F.col(f"seasonal_{spec.name}")
        first = F.min(F.when(seasonal, year)).over(run)
        last = F.max(F.when(seasonal, year)).over(run)
        weight = F.exp(
            spec.moy_recency_strength * (year - first) / F.greatest(last - first, F.lit(1))
        )
    if spec.distortion_lookback_days is not None:
        # the expectation of the lookback slice counts its own days from 0
        cut = F.date_sub("last_day", spec.distortion_lookback_days)
        t_expected = F.col("t") - F.min(F.when(F.col("day") >= cut, F.col("t"))).over(run)
    return {"year_weight": weight, "t_expected": t_expected}


def for_model(table: DataFrame, spec: ModelSpec) -> DataFrame:
    """The training table as one model sees it."""
    return table.select(*TRAIN_COLUMNS, *[F.col(f"{c}_{spec.name}").alias(c) for c in MODEL_COLUMNS])


def _with_recency(rows: DataFrame) -> DataFrame:
    """Recency weight and centred index of production rows. Centring keeps the 2x2
    solution well conditioned."""
    return rows.withColumns(
        {
            "w": F.exp(F.col("recency_strength") * F.col("p") / F.col("n_prod")),
            "u": F.col("p") - (F.col("n_prod") - 1) / 2,
        }
    )


def _trend_sums() -> dict[str, Column]:
    """The five weighted sums that the least squares line needs."""
    w, u, ly = F.col("w"), F.col("u"), F.col("ly")
    return {
        "sw": F.sum(w), "sx": F.sum(w * u), "sxx": F.sum(w * u * u),
        "sy": F.sum(w * ly), "sxy": F.sum(w * u * ly),
    }


def _with_line(sums: DataFrame) -> DataFrame:
    """Slope and intercept of the weighted least squares line from its sums."""
    c = F.col
    return sums.withColumn(
        "slope",
        F.try_divide(
            c("sw") * c("sxy") - c("sx") * c("sy"), c("sw") * c("sxx") - c("sx") * c("sx")
        ),
    ).withColumn(
        "intercept",
        (c("sy") - c("slope") * c("sx")) / c("sw") - c("slope") * (c("n_prod") - 1) / 2,
    )


def fit_trend(train: DataFrame, fits: DataFrame) -> DataFrame:
    """Recency-weighted log-linear least squares, in one aggregation."""
    rows = (
        train.filter("prod")
        .select("run_id", "p", "n_prod", "n_train", "last_day", F.ln("y").alias("ly"))
        .join(fits.select(*TREND_KEY).distinct(), "run_id")
    )
    sums = (
        _with_recency(rows)
        .groupBy(*TREND_KEY)
        .agg(
            *[c.alias(n) for n, c in _trend_sums().items()],
            *[F.max(n).alias(n) for n in ("n_prod", "n_train", "last_day")],
        )
    )
    return _with_line(sums).select(
        *TREND_KEY, "intercept", "slope", "n_train", "last_day", "n_prod"
    )


def mean_effect(rows: DataFrame, keys: list[str], by: list[str], value: Column) -> DataFrame:
    """Group means over the unweighted mean of the group means."""
    means = rows.groupBy(*keys, *by).agg(F.avg(value).alias("raw"))
    overall = F.avg("raw").over(Window.partitionBy(*keys))
    return means.withColumn("effect", F.try_divide(F.col("raw"), overall))


def fitted_trend(t: Column) -> Column:
    return F.exp(F.col("intercept") + F.col("slope") * t)


def _level_weight(spec: ModelSpec) -> Column:
    """Weight of a production row in the base level, null outside the lookback."""
    rank = F.col("n_prod") - F.col("p")
    if spec.rank_weighted_level:
        n = F.least(F.col("level_lookback_days"), F.col("n_prod"))
        position = F.try_divide(F.lit(2.0) * (n - rank), (n - 1).cast("double"))
        weight = F.exp(F.coalesce(position, F.lit(0.0)))
    else:
        weight = F.lit(1.0)
    return F.when(rank <= F.col("level_lookback_days"), weight)


def fit_base_level(train: DataFrame, trend: DataFrame, fits: DataFrame,
                   spec: ModelSpec) -> DataFrame:
    """Recent target over recent trend, over the last production days."""
    rows = (
        fits.select(*LEVEL_KEY).distinct()
        .join(trend.drop("n_prod", "n_train", "last_day"), TREND_KEY)
        .join(train.filter("prod"), "run_id")
        .withColumns({"weight": _level_weight(spec), "fitted": fitted_trend(F.col("t"))})
    )
    return rows.groupBy(*LEVEL_KEY).agg(
        (F.sum(F.col("y") * F.col("weight")) / F.sum(F.col("fitted") * F.col("weight"))).alias(
            "base_level"
        ),
        *[F.max(c).alias(c) for c in TREND_COLUMNS],
    )


def seasonal_cells(train: DataFrame, fits: DataFrame, spec: ModelSpec) -> DataFrame:
    """Per effect key, (day of month, month) sums with one column per weekday.

    This is all that the effects need: at most 372 rows per key. The rows of a run
    meet its keys in the tasks of (run, salt), so what is exchanged is a run's rows
    once per salt in use, never the rows unfolded per key. The trend is a window over
    the unfolded rows and everything up to the effects keeps their partitioning.
    """
    dom = F.col("dom") if spec.use_dom else F.lit(0)
    moy = F.lit(12) if spec.december_only else F.col("moy")
    keys = fits.select(*EFFECT_KEY, *EFFECT_PARAMS).distinct()
    per_key = Window.partitionBy(*EFFECT_KEY)
    prod = train.filter("prod").select(
        "run_id", "y", F.ln("y").alias("ly"), "t", "p", "n_prod", "n_train", "dow", "dom", "moy",
        "seasonal", "year_weight",
    )
    prod = prod.join(keys.select("run_id", "salt").distinct(), "run_id")
    rows = _with_recency(prod.join(keys, ["run_id", "salt"]))
    rows = _with_line(
        rows.select("*", *[c.over(per_key).alias(n) for n, c in _trend_sums().items()])
    )
    rows = rows.withColumns(
        {"fitted": fitted_trend(F.col("t")), "weight": _level_weight(spec)}
    ).withColumn("detrended", F.when(F.col("seasonal"), F.col("y") / F.col("fitted")))
    x = F.col("detrended")

    def per_weekday(name: str, value: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(F.col("dow") == k, value)), F.lit(0.0)).alias(f"{name}{k}")
            for k in WEEKDAYS
        ]

    sums = per_weekday("s", x) + per_weekday("n", F.when(x.isNotNull(), F.lit(1.0)))
    if spec.moy_recency_strength:
        w = F.when(x.isNotNull(), F.col("year_weight"))
        sums += per_weekday("ws", x * w) + [F.sum(w).alias("wn")]
    return rows.groupBy(*EFFECT_KEY, dom.alias("dom"), moy.alias("moy")).agg(
        *sums,
        F.sum(F.col("y") * F.col("weight")).alias("level_y"),
        F.sum(F.col("fitted") * F.col("weight")).alias("level_fitted"),
        *[F.max(c).alias(c) for c in ("intercept", "slope", "n_train", "dow_shrinkage")],
    )


def _total(*cols: Column) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _weekday_effects(spec: ModelSpec) -> dict[str, Column]:
    """e0..e4: weekday means pulled toward the base level, over their plain mean.
    A weekday without rows has no effect and does not enter the mean."""
    pulled = []
    for k in WEEKDAYS:
        shrink = F.col("dow_shrinkage") * spec.dow_shrinkage_multipliers.get(k, 1.0)
        raw = F.try_divide(f"t{k}", f"c{k}")
        pulled.append((1 - shrink) * raw + shrink * F.col("base_level"))
    present = _total(*[p.isNotNull().cast("double") for p in pulled])
    mean = F.try_divide(_total(*[F.coalesce(p, F.lit(0.0)) for p in pulled]), present)
    return {f"e{k}": p / mean for k, p in zip(WEEKDAYS, pulled)}


FIT_COLUMNS = ["base_level", "intercept", "slope", "n_train"]


def fit_effects(train: DataFrame, fits: DataFrame, spec: ModelSpec) -> DataFrame:
    """Trend, level and weekday, day, month and interaction effects: one row per key.

    Each effect is a group mean of what the earlier effects leave, divided by the
    unweighted mean of the group means. Rows shrink from (day, month) over month to
    one per key without another exchange. Groups without seasonal rows stay null and
    drop out of every mean; their effects later count as 1.
    """
    whole = Window.partitionBy(*EFFECT_KEY)
    cells = seasonal_cells(train, fits, spec)
    x = cells.select(
        *cells.columns,
        *[F.sum(f"s{k}").over(whole).alias(f"t{k}") for k in WEEKDAYS],
        *[F.sum(f"n{k}").over(whole).alias(f"c{k}") for k in WEEKDAYS],
        (F.sum("level_y").over(whole) / F.sum("level_fitted").over(whole)).alias("base_level"),
    ).withColumns(_weekday_effects(spec))

    def left_over(name: str) -> list[Column]:
        return [F.coalesce(F.col(f"{name}{k}") / F.col(f"e{k}"), F.lit(0.0)) for k in WEEKDAYS]

    x = x.withColumns(
        {
            **{f"x{k}": c for k, c in zip(WEEKDAYS, left_over("s"))},
            "n": _total(*[F.col(f"n{k}") for k in WEEKDAYS]),
        }
    ).withColumn("x", _total(*[F.col(f"x{k}") for k in WEEKDAYS]))

    if spec.use_dom:
        same_dom = Window.partitionBy(*EFFECT_KEY, "dom")
        n_dom = F.sum("n").over(same_dom)
        # a cell's share of its day sums to 1 per day: summing over shares counts days
        x = x.withColumns(
            {
                "dom_raw": F.try_divide(F.sum("x").over(same_dom), n_dom),
                "part": F.try_divide(F.col("n"), n_dom),
            }
        )
        mean = F.sum(F.col("dom_raw") * F.col("part")).over(whole) / F.sum("part").over(whole)
        x = x.withColumn("dom_e", F.col("dom_raw") / mean)
    else:
        x = x.withColumn("dom_e", F.lit(1.0))

    # from here one row per month
    if spec.moy_recency_strength:
        weighted = _total(*left_over("ws")) / F.col("dom_e")
        moy_raw = F.try_divide(F.sum(weighted), F.sum("wn"))
    else:
        moy_raw = F.try_divide(F.sum(F.col("x") / F.col("dom_e")), F.sum("n"))
    months = x.groupBy(*EFFECT_KEY, "moy").agg(
        moy_raw.alias("moy_raw"),
        *[F.sum(F.col(f"x{k}") / F.col("dom_e")).alias(f"x{k}") for k in WEEKDAYS],
        *[F.sum(f"n{k}").alias(f"n{k}") for k in WEEKDAYS],
        *[F.max(f"e{k}").alias(f"e{k}") for k in WEEKDAYS],
        *[F.max(c).alias(c) for c in FIT_COLUMNS],
        F.collect_list(F.struct(F.col("dom").alias("k"), F.col("dom_e").alias("e"))).alias(
            "dom_pairs"
        ),
    )
    moy_e = F.col("moy_raw") / F.avg("moy_raw").over(whole) if spec.use_moy else F.lit(1.0)
    months = months.withColumn("moy_e", moy_e)
    # shrinking toward the mean leaves the mean, so the raw ratio is all that is kept
    raws = [F.try_divide(F.col(f"x{k}") / F.col("moy_e"), F.col(f"n{k}")) for k in WEEKDAYS]
    months = months.withColumns({f"r{k}": r for k, r in zip(WEEKDAYS, raws)})
    total = _total(*[F.coalesce(f"r{k}", F.lit(0.0)) for k in WEEKDAYS])
    number = _total(*[F.col(f"r{k}").isNotNull().cast("int") for k in WEEKDAYS])
    int_mean = F.try_divide(F.sum(total).over(whole), F.sum(number).over(whole))
    pairs = [
        F.struct((F.lit(k * MOY_SLOTS) + F.col("moy")).alias("k"),
                 (F.col(f"r{k}") / F.col("int_mean")).alias("e"))
        for k in WEEKDAYS
    ]
    weekdays = [F.struct(F.lit(k).alias("k"), F.col(f"e{k}").alias("e")) for k in WEEKDAYS]

    def as_map(entries: Column) -> Column:
        return F.map_from_entries(F.filter(entries, lambda p: p["e"].isNotNull()))

    return (
        months.withColumn("int_mean", int_mean)
        .groupBy(*EFFECT_KEY)
        .agg(
            *[F.max(f"e{k}").alias(f"e{k}") for k in WEEKDAYS],
            *[F.max(c).alias(c) for c in FIT_COLUMNS],
            F.collect_list("dom_pairs").alias("dom_pairs"),
            F.collect_list(F.struct(F.col("moy").alias("k"), F.col("moy_e").alias("e"))).alias(
                "moy_pairs"
            ),
            F.collect_list(F.array(*pairs)).alias("int_pairs"),
        )
        .select(
            *EFFECT_KEY,
            *FIT_COLUMNS,
            as_map(F.array(*weekdays)).alias("dow_effect"),
            as_map(F.array_distinct(F.flatten("dom_pairs"))).alias("dom_effect"),
            as_map(F.col("moy_pairs")).alias("moy_effect"),
            as_map(F.flatten("int_pairs")).alias("int_ratio"),
        )
    )


def lookup(effects: str, key: Column) -> Column:
    """Effect of a key (a map has at most 60 entries); 1 where it was never seen."""
    return F.coalesce(F.try_element_at(F.col(effects), key), F.lit(1.0))


def interaction(dow: Column, moy: Column) -> Column:
    s = F.col("interaction_shrinkage")
    return (1 - s) * lookup("int_ratio", dow * MOY_SLOTS + moy) + s


def seasonal_product(spec: ModelSpec, dow: Column, dom: Column, moy: Column,
                     with_moy: bool) -> Column:
    """Product of the effects; unseen keys count as 1 and weekends as 0."""
    month = F.lit(12) if spec.december_only else moy
    out = lookup("dow_effect", dow)
    if spec.use_dom:
        out = out * lookup("dom_effect", dom)
    if spec.use_moy and with_moy:
        out = out * lookup("moy_effect", moy)
    out = out * interaction(dow, month)
    return F.when(dow < 5, out).otherwise(F.lit(0.0))


def expected_mean(train: DataFrame, effects: DataFrame, fits: DataFrame,
                  spec: ModelSpec) -> DataFrame:
    """Effects per seasonal key with the mean in-sample seasonal (weekends count as 0)."""
    keys = fits.select(*SEASONAL_KEY, "effect_key", "salt", "interaction_shrinkage").distinct()
    keyed = spread(keys.join(effects, EFFECT_KEY), SEASONAL_KEY)
    if not spec.expected_normalised:
        return keyed.withColumn("mean_seasonal", F.lit(1.0))
    dom = F.col("dom") if spec.use_dom else F.lit(0)
    days = train.groupBy("run_id", "dow", dom.alias("dom"), "moy").agg(
        F.count("*").alias("n_days")
    )
    s = seasonal_product(spec, F.col("dow"), F.col("dom"), F.col("moy"), spec.expected_uses_moy)
    shards = sharded(fits.select("run_id", "seasonal_key"), "seasonal_key")
    means = (
        join_sharded(sharded(keyed, "seasonal_key"), days, shards)
        .groupBy(*SEASONAL_KEY, "shard")
        .agg((F.sum(s * F.col("n_days")) / F.max("n_train")).alias("mean_seasonal"))
    )
    return keyed.join(means.drop("shard"), SEASONAL_KEY)


def is_positive(name: str) -> Column:
    """Above zero and a number: a shrinkage beyond 1 can make a seasonal negative, and its power none."""
    return (F.col(name) > 0) & ~F.isnan(name)


def expected_value(spec: ModelSpec, t: Column) -> Column:
    """In-sample expectation of a row that carries dow, dom, moy and the fit."""
    s = seasonal_product(
        spec, F.col("dow"), F.col("dom"), F.col("moy"), spec.expected_uses_moy
    )
    base = F.col("base_level") * fitted_trend(t)
    if not spec.expected_normalised:
        return base * s
    scaled = F.pow(s / F.col("mean_seasonal"), F.col("seasonal_exponent"))
    return base * scaled * (1 + F.col("trend_seasonal_tilt") * (scaled - 1))


def _distortion_fits(train: DataFrame, effects: DataFrame, fits: DataFrame,
                     spec: ModelSpec) -> DataFrame:
    """One row per distortion key with all that its expectation needs."""
    keys = fits.select(
        *DISTORTION_KEY, "seasonal_key", "seasonal_exponent", "trend_seasonal_tilt"
    ).distinct()
    means = expected_mean(train, effects, fits, spec)
    return spread(keys.join(means, SEASONAL_KEY), DISTORTION_KEY)


def expected_baseline(train: DataFrame, effects: DataFrame, fits: DataFrame,
                      spec: ModelSpec) -> DataFrame:
    """Expectation of every weekday training row, per distortion key.

    A model that looks back a limited time counts days from there and leaves out earlier rows.
    """
    keyed = _distortion_fits(train, effects, fits, spec)
    shards = sharded(fits.select("run_id", "distortion_key"), "distortion_key")
    rows = train.filter("t_expected >= 0").drop("n_train", "last_day", "series_id")
    return join_sharded(sharded(keyed, "distortion_key"), rows, shards).select(
        *DISTORTION_KEY, "day", "y", "dow", "moy", "prod",
        expected_value(spec, F.col("t_expected")).alias("expected"),
    )


def holiday_neighbours(train: DataFrame, spec: ModelSpec) -> DataFrame:
    """Weekday rows at business offsets around each holiday of the training rows.

    Offsets count weekday rows, holidays included; holidays and zero targets drop.
    """
    rows = train
    if spec.distortion_lookback_days is not None:
        rows = rows.filter("t_expected >= 0")
    holidays = rows.filter("is_holiday")
    if spec.december_holidays_only:
        holidays = holidays.filter("moy = 12")
    offsets = F.explode(F.array(*[F.lit(o) for o in spec.offsets()]))
    anchors = holidays.select(
        "run_id", F.col("dow").alias("holiday_dow"), F.col("pos").alias("holiday_pos"),
        offsets.alias("offset"),
    ).withColumn("pos", F.col("holiday_pos") + F.col("offset"))
    if spec.mon_thu_fraction is not None:
        anchors = anchors.filter(~((F.col("holiday_dow") == 0) & (F.col("offset") == 3)))
    work = rows.filter(~F.col("is_holiday") & (F.col("y") > 0))
    return anchors.drop("holiday_pos").join(work, ["run_id", "pos"])


def days_near_holidays(days: DataFrame, day: str, holidays: DataFrame,
                       spec: ModelSpec) -> DataFrame:
    """Pairs of a weekday and the holiday that lies ``offset`` weekdays before it.

    Stepping back from the day finds the holiday with an equality lookup.
    """
    offsets = F.explode(F.array(*[F.lit(o) for o in spec.offsets()]))
    flag = holidays.select(
        F.col("calendar_date").alias("holiday"),
        F.weekday("calendar_date").alias("holiday_dow"),
    )
    return (
        days.filter(F.weekday(day) < 5)
        .withColumn("offset", offsets)
        .withColumn("holiday", business_day_add(F.col(day), -F.col("offset")))
        .join(F.broadcast(flag), "holiday")
    )


def holiday_neighbours_stepwise(train: DataFrame, calendar: DataFrame,
                                spec: ModelSpec) -> DataFrame:
    """Neighbours by calendar weekdays, also of holidays outside the training rows;
    zero targets and holidays stay."""
    return days_near_holidays(train, "day", holiday_days(calendar), spec)


def fit_holiday_distortion(train: DataFrame, effects: DataFrame, fits: DataFrame,
                           spec: ModelSpec, neighbours: DataFrame | None = None) -> DataFrame:
    """Median actual/expected per (holiday weekday, business offset), shrunk to 1."""
    near = holiday_neighbours(train, spec) if neighbours is None else neighbours
    near = near.select(
        "run_id", "holiday_dow", "offset", "y", "dow", "dom", "moy", "t_expected"
    )
    keyed = _distortion_fits(train, effects, fits, spec)
    k = spec.holiday_shrinkage
    shards = sharded(fits.select("run_id", "distortion_key"), "distortion_key")
    ratios = (
        join_sharded(sharded(keyed, "distortion_key"), near, shards)
        .withColumn("expected", expected_value(spec, F.col("t_expected")))
        .filter(is_positive("expected"))
        .groupBy(*DISTORTION_KEY, "holiday_dow", "offset")
        .agg(
            F.median(F.col("y") / F.col("expected")).alias("median_ratio"),
            F.count("*").alias("n_obs"),
        )
        .filter(F.col("n_obs") >= spec.distortion_min_obs)
        .withColumn("factor", (1 - k) * F.col("median_ratio") + k)
    )
    if spec.distortion_max_factor is None:
        return ratios
    cap = F.lit(spec.distortion_max_factor)
    for (dow, offset), key_cap in spec.per_key_caps.items():
        cap = F.when(
            (F.col("holiday_dow") == dow) & (F.col("offset") == offset),
            F.lit(max(key_cap, spec.distortion_max_factor)),
        ).otherwise(cap)
    return ratios.withColumn("factor", clip(F.col("factor"), 1 / cap, cap))


def distortion_slot(spec: ModelSpec, holiday_dow: Column, offset: Column) -> Column:
    return holiday_dow * spec.n_offsets + offset + spec.holiday_before


def fit_cliff_ratio(train: DataFrame, spec: ModelSpec) -> DataFrame:
    """Mean seasonal target after over before the cliff day; 1 without either."""
    after = F.avg(F.when(F.col("dom") > spec.cliff_day, F.col("y")))
    before = F.avg(F.when(F.col("dom") <= spec.cliff_day, F.col("y")))
    return (
        train.filter("seasonal")
        .groupBy("run_id")
        .agg(F.coalesce(F.try_divide(after, before), F.lit(1.0)).alias("cliff_ratio"))
    )


def fit_monthly_totals(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Target per run and calendar month of its training rows."""
    span = runs.select("run_id", "series_id", "train_start", "train_end")
    return (
        days_of(span, "train_start", "train_end")
        .join(history, ["series_id", "day"])
        .groupBy("run_id", month_start(F.col("day")).alias("month"))
        .agg(F.sum("amount").alias("total"))
    )


def fit_woy_cliff(train: DataFrame, effects: DataFrame, fits: DataFrame,
                  spec: ModelSpec) -> DataFrame:
    """Median actual/expected per (ISO week, weekday) of the active weeks, shrunk
    to 1 and clamped."""
    rows = expected_baseline(train, effects, fits, spec)
    k = spec.woy_shrinkage
    return (
        rows.withColumn("woy", F.weekofyear("day"))
        .filter(F.col("prod") & is_positive("expected") & F.col("woy").isin(*spec.woy_weeks))
        .groupBy(*DISTORTION_KEY, "woy", "dow")
        .agg(
            F.median(F.col("y") / F.col("expected")).alias("median_ratio"),
            F.count("*").alias("n_obs"),
        )
        .filter(F.col("n_obs") >= spec.woy_min_obs)
        .withColumn(
            "factor", clip((1 - k) * F.col("median_ratio") + k, spec.woy_min, spec.woy_max)
        )
    )


@dataclass(frozen=True)
class Fit:
    """A fitted model: one row per (run, parameter set), plus the staged inputs."""

    spec: ModelSpec
    train: DataFrame
    fits: DataFrame
    effects: DataFrame
    model: DataFrame


def fit_model(history: DataFrame, runs: DataFrame, fits: DataFrame, calendar: DataFrame,
              spec: ModelSpec) -> Fit:
    """Fit every (run, parameter set).

    ``runs`` holds run_id, series_id, train_start, train_end; ``fits`` holds run_id,
    param_id and the eight parameters.
    """
    return fit_models(history, runs, calendar, [(spec, fits)])[0]


def fit_models(history: DataFrame, runs: DataFrame, calendar: DataFrame,
               models: list[tuple[ModelSpec, DataFrame]]) -> list[Fit]:
    """Fit several models, each with its own (run, parameter set) rows.

    Training rows, parameters and effects are staged, since the later steps read them more
    than once, as three tables whatever the number of models.
    """
    specs = [spec for spec, _ in models]
    # by month, so that the cells of a single run also unfold in parallel
    rows = training_table(history, runs, calendar, specs)
    train = stage(spread(rows, ["run_id", "moy"]), "train")
    # written keys keep their partitioning through the steps; folded literals would not
    fits = _staged_by_model([with_step_keys(f) for _, f in models], specs, "fits")
    trains = [for_model(train, spec) for spec in specs]
    effects = _staged_by_model(
        [fit_effects(t, f, spec) for t, f, spec in zip(trains, fits, specs)], specs, "effects")
    return [
        Fit(spec, t, f, e, _model(history, runs, t, f, e, spec))
        for spec, t, f, e in zip(specs, trains, fits, effects)
    ]


def _staged_by_model(tables: list[DataFrame], specs: list[ModelSpec], name: str) -> list[DataFrame]:
    """Tables of several models, written as one."""
    if len(tables) == 1:
        return [stage(tables[0], name)]
    named = [t.withColumn("model", F.lit(s.name)) for t, s in zip(tables, specs)]
    whole = stage(reduce(DataFrame.unionByName, named), name)
    return [whole.filter(F.col("model") == s.name).drop("model") for s in specs]


def _model(history: DataFrame, runs: DataFrame, train: DataFrame, fits: DataFrame,
           effects: DataFrame, spec: ModelSpec) -> DataFrame:
    """One row per (run, parameter set) with effects, distortion and cliffs."""
    model = fits.join(effects, EFFECT_KEY)
    if spec.learns_distortion:
        factors = (
            fit_holiday_distortion(train, effects, fits, spec)
            .groupBy(*DISTORTION_KEY)
            .agg(
                F.collect_list(
                    F.struct(
                        distortion_slot(spec, F.col("holiday_dow"), F.col("offset")).alias("k"),
                        F.col("factor").alias("e"),
                    )
                ).alias("pairs")
            )
            .select(*DISTORTION_KEY, F.map_from_entries("pairs").alias("distortion"))
        )
        model = model.join(factors, DISTORTION_KEY, "left")
    else:
        model = model.withColumn("distortion", F.lit(None).cast("map<int,double>"))
    if spec.cliff_day is not None:
        model = model.join(fit_cliff_ratio(train, spec), "run_id", "left").fillna(
            1.0, subset=["cliff_ratio"]
        )
    if spec.woy_cliff:
        table = (
            fit_woy_cliff(train, effects, fits, spec)
            .groupBy(*DISTORTION_KEY)
            .agg(
                F.collect_list(
                    F.struct((F.col("woy") * 5 + F.col("dow")).alias("k"),
                             F.col("factor").alias("e"))
                ).alias("pairs")
            )
            .select(*DISTORTION_KEY, F.map_from_entries("pairs").alias("woy_factor"))
        )
        model = model.join(table, DISTORTION_KEY, "left")
    if spec.mom_dampening:
        totals = (
            fit_monthly_totals(history, runs)
            .groupBy("run_id")
            .agg(
                F.map_from_entries(F.collect_list(F.struct("month", "total"))).alias(
                    "monthly_totals"
                )
            )
        )
        model = model.join(totals, "run_id", "left")
    return spread(model, ["run_id", "param_id"])
