"""Signatures of trailing windows and the search for similar past windows.

Signatures are differences of running totals, over a dense spine or looked up by day, so a
window costs as much as a day. Everything per series or run is bounded by the days of
its history, and runs of one series meet its days or candidates in many tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.numeric import safe_pct, safe_ratio
from tidecast.staging import blocks, carried_days, join_salted

# metric prefix -> (count column, volume column) of the funnel
KINDS = {
    "apps": ("application_count", "application_volume"),
    "uw": ("underwriting_submission_events", "underwriting_submission_event_volume"),
    "appr": ("approval_events", "approval_event_volume"),
}
MEASURES = {f"{k}_{m}": cols[i] for k, cols in KINDS.items() for i, m in enumerate(("count", "vol"))}
LEVELS = [f"{k}_{m}_per_biz_day" for m in ("count", "vol") for k in KINDS]
CHANGES = [f"{k}_{m}_pct_chg" for m in ("count", "vol") for k in KINDS]
FEATURES = (
    [f"{x}_1m" for x in LEVELS]
    + [f"{x}_2m" for x in LEVELS]
    + [f"{x}_1m" for x in CHANGES]
    + [f"{x}_2m" for x in CHANGES]
    + ["biz_day_count_forecast"]
)
# Fixed values of the distance.
SHORT_LEVEL_WEIGHT = 0.50
REVERSAL_WEIGHT = 0.30
REVERSAL_BAND = 0.02
MAD_TO_SIGMA = 1.4826
DISTANCE_WARNING = 4.0


def _signature_columns(current: dict[str, Column], prior: dict[str, Column], biz: Column,
                       prior_biz: Column, suffix: str = "") -> list[Column]:
    """Levels per business day and their change against the prior window."""
    out = []
    for m in MEASURES:
        level = safe_ratio(current[m], biz)
        before = safe_ratio(prior[m], prior_biz)
        out.append(level.alias(f"{m}_per_biz_day{suffix}"))
        out.append(safe_pct(level, before).alias(f"{m}_pct_chg{suffix}"))
    return out


def running_totals(funnel: DataFrame, columns: list[str], until: dt.date | None) -> DataFrame:
    """Totals of every series up to each day (``as_of``), as exact decimals, and ``n_rows``.

    The difference of two rows is the sum of any window.
    """
    so_far = Window.partitionBy("series_id").orderBy("filedt")
    rows = funnel.select(
        "series_id", "filedt", F.count("*").over(so_far).alias("n_rows"),
        *[F.sum(exact(c)).over(so_far).alias(c) for c in columns],
    )
    return carried_days(rows, "filedt", F.lit(until).cast("date")).drop("filedt")


def exact(c: str) -> Column:
    """Amounts of up to six decimals, so that sums and their differences lose nothing."""
    return F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(28,6)")


def _window_sums(funnel: DataFrame, windows: DataFrame, means: dict[str, str] | None = None) -> DataFrame:
    """Sums of the current (``_c``) and the prior (``_p``) window, and means over the current one.

    A window meets the running totals at its ends and the days before its starts: three days if
    the prior window ends where the current one begins.
    """
    means = means or {}
    bounds = ["start", "end", "prior_start", "prior_end"]
    windows = windows.select("window_id", "series_id", *bounds)
    until = windows.agg(F.max(F.greatest("end", "prior_end"))).first()[0]
    columns = ["biz_day", *MEASURES.values()]
    totals = running_totals(
        funnel.withColumns({f"_has_{c}": F.when(F.col(c).isNotNull(), 1.0) for c in means.values()}),
        [*columns, *means.values(), *[f"_has_{c}" for c in means.values()]], until)
    spans = {"c": ("start", "end"), "p": ("prior_start", "prior_end")}
    days = [d for lo, hi in spans.values() for d in (F.date_sub(lo, 1), F.col(hi))]
    points = windows.withColumn("as_of", F.explode(F.array_distinct(F.array(*days))))
    met = points.join(totals, ["series_id", "as_of"], "left")

    def total(c: str, tag: str) -> Column:
        lo, hi = spans[tag]

        def at(day: Column) -> Column:
            return F.coalesce(F.max(F.when(F.col("as_of") == day, F.col(c))), F.lit(0))

        # an empty window, one that ends before it starts, has no rows
        return F.when(F.col(lo) <= F.col(hi), at(F.col(hi)) - at(F.date_sub(lo, 1))).otherwise(
            F.lit(0)).cast("double")

    aggs = []
    for tag in spans:
        aggs += [total(c, tag).alias(f"{m}_{tag}") for m, c in MEASURES.items()]
        aggs += [total("biz_day", tag).alias(f"biz_{tag}"), total("n_rows", tag).alias(f"rows_{tag}")]
    for n, c in means.items():
        mean = F.try_divide(total(c, "c"), total(f"_has_{c}", "c"))
        aggs.append(F.coalesce(mean, F.lit(0.0)).alias(n))
    return met.groupBy("window_id", "series_id", *bounds).agg(*aggs)


def _biz(tag: str) -> Column:
    return F.when(F.col(f"biz_{tag}") > 0, F.col(f"biz_{tag}")).otherwise(F.col(f"rows_{tag}"))


def volume_features(funnel: DataFrame, windows: DataFrame) -> DataFrame:
    """Twelve metrics and the business-day count of arbitrary windows."""
    sums = _window_sums(funnel, windows)
    cur = {m: F.col(f"{m}_c") for m in MEASURES}
    pri = {m: F.col(f"{m}_p") for m in MEASURES}
    return sums.select(
        "window_id", "series_id",
        *_signature_columns(cur, pri, _biz("c"), _biz("p")),
        _biz("c").alias("biz_day_count"),
    )


def legacy_volume_signature(funnel: DataFrame, todays: DataFrame) -> DataFrame:
    """Thirteen volume features of the window from last month's date to yesterday."""
    end = F.date_sub("today", 1)
    start = F.add_months(end, -1)
    windows = todays.select(
        F.concat_ws("@", "series_id", F.col("today").cast("string")).alias("window_id"),
        "series_id",
        start.alias("start"),
        end.alias("end"),
        F.add_months(start, -1).alias("prior_start"),
        F.date_sub(start, 1).alias("prior_end"),
    )
    sizes = {
        "avg_app_loan_size": "avg_application_loan_size",
        "avg_uw_loan_size": "avg_underwriting_submission_loan_size",
        "avg_appr_loan_size": "avg_approval_loan_size",
    }
    sums = _window_sums(funnel, windows, sizes)
    out = []
    for k in KINDS:
        level = safe_ratio(F.col(f"{k}_vol_c"), _biz("c"))
        before = safe_ratio(F.col(f"{k}_vol_p"), _biz("p"))
        out += [
            F.col(f"{k}_vol_c").alias(f"{k}_vol_total"),
            level.alias(f"{k}_vol_per_biz_day"),
            safe_pct(level, before).alias(f"{k}_vol_pct_chg"),
        ]
    return sums.select("window_id", "series_id", *out, _biz("c").alias("biz_day_count"), *sizes)


def funnel_spine(funnel: DataFrame, until: dt.date | Column) -> DataFrame:
    """Every day of a series from its first funnel row to ``until``."""
    until = F.lit(until) if isinstance(until, dt.date) else until
    first = funnel.groupBy("series_id").agg(F.min("filedt").alias("first"))
    days = first.select(
        "series_id", F.explode(F.sequence("first", F.greatest("first", until))).alias("filedt")
    )
    cols = ["biz_day", *MEASURES.values()]
    return days.join(
        funnel.select("series_id", "filedt", F.lit(1.0).alias("has_row"), *cols),
        ["series_id", "filedt"],
        "left",
    ).fillna(0.0, subset=["has_row", *cols])


def two_window_signature(funnel: DataFrame, until: dt.date | Column) -> DataFrame:
    """25 features of every origin day from its trailing 30 and 60 days and the equal
    windows before them. The windows end the day before the origin, and their sums are
    differences of running totals."""
    by_day = Window.partitionBy("series_id").orderBy("filedt")
    columns = ["biz_day", "has_row", *MEASURES.values()]
    # the spine has every day, so totals up to n days ago stand n rows back
    spine = funnel_spine(funnel, until).select(
        "series_id", "filedt", *[F.sum(exact(c)).over(by_day).alias(c) for c in columns])

    def between(c: str, last: int, first: int) -> Column:
        ago = [F.coalesce(F.lag(c, n).over(by_day), F.lit(0)) for n in (last, first + 1)]
        return (ago[0] - ago[1]).cast("double")

    sums = []
    for tag, (first, last) in {"a": (30, 1), "b": (60, 31), "c": (60, 1), "d": (120, 61)}.items():
        named = {f"{m}_{tag}": c for m, c in MEASURES.items()}
        named |= {f"biz_{tag}": "biz_day", f"rows_{tag}": "has_row"}
        sums += [between(c, last, first).alias(n) for n, c in named.items()]
    rows = spine.select("series_id", F.col("filedt").alias("origin"), *sums)

    def measures(tag: str) -> dict[str, Column]:
        return {m: F.col(f"{m}_{tag}") for m in MEASURES}

    return rows.select(
        "series_id",
        "origin",
        *_signature_columns(measures("a"), measures("b"), _biz("a"), _biz("b"), "_1m"),
        *_signature_columns(measures("c"), measures("d"), _biz("c"), _biz("d"), "_2m"),
        _biz("c").alias("biz_day_count_forecast"),
    ).select("series_id", "origin", *FEATURES)


def candidate_window_index(signatures: DataFrame, funnel: DataFrame, history: DataFrame,
                           step_days: int = 1, min_history_days: int = 90,
                           horizon_days: int = 30) -> DataFrame:
    """Weekday origins with enough history before them and a whole target after."""
    bounds = (
        funnel.groupBy("series_id").agg(F.min("filedt").alias("first_row"))
        .join(
            history.groupBy("series_id").agg(
                F.min("day").alias("first_day"), F.max("day").alias("last_day")
            ),
            "series_id",
        )
        .select(
            "series_id",
            F.date_add(F.greatest("first_row", "first_day"), min_history_days).alias("earliest"),
            F.date_sub("last_day", horizon_days).alias("latest"),
        )
    )
    on_step = F.datediff("origin", "earliest") % step_days == 0
    return (
        signatures.join(bounds, "series_id")
        .filter(F.col("origin").between(F.col("earliest"), F.col("latest")))
        .filter((F.weekday("origin") < 5) & on_step)
        .select(
            "series_id", "origin",
            F.col("origin").alias("target_start"),
            F.date_add("origin", horizon_days - 1).alias("target_end"),
            *FEATURES,
        )
    )


def long_features(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.unpivot(ids, FEATURES, "feature", "value")


def robust_norm_stats(candidates: DataFrame) -> DataFrame:
    """Median and scale per series and feature; the scale is the larger of the
    scaled median absolute deviation and a floor.

    The scales use all candidates, also those after a backtest's date; pass
    candidates cut to the past to avoid that.
    """
    values = long_features(candidates, ["series_id"])
    center = values.groupBy("series_id", "feature").agg(
        F.median("value").alias("median"), F.stddev_pop("value").alias("sd")
    )
    spread = (
        values.join(center.select("series_id", "feature", "median"), ["series_id", "feature"])
        .groupBy("series_id", "feature")
        .agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    )
    floor = (
        F.when(F.col("feature") == "biz_day_count_forecast", F.lit(5.0))
        .when(F.col("feature").contains("_pct_chg_"), F.lit(0.05))
        .otherwise(F.greatest(F.abs("median") * 0.10, F.col("sd") * 0.5))
    )
    return center.join(spread, ["series_id", "feature"]).select(
        "series_id", "feature", "median", "mad",
        F.greatest(MAD_TO_SIGMA * F.col("mad"), floor, F.lit(1e-9)).alias("scale"),
    )


def zscore_norm_stats(features: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Mean and sample deviation per feature."""
    return (
        features.unpivot(list(keys), names, "feature", "value")
        .groupBy(*keys, "feature")
        .agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"))
    )


def feature_weights() -> Column:
    """Weights of the query row in feature order: short levels count half, and a
    short-term change that contradicts the longer one is damped."""
    out = []
    for f in FEATURES:
        if f.endswith("_per_biz_day_1m"):
            out.append(F.lit(SHORT_LEVEL_WEIGHT))
        elif f.endswith("_pct_chg_1m"):
            short, long = F.col(f), F.col(f.replace("_1m", "_2m"))
            reversal = (
                (F.abs(short) > REVERSAL_BAND)
                & (F.abs(long) > REVERSAL_BAND)
                & (short * long < 0)
            )
            out.append(F.when(reversal, REVERSAL_WEIGHT).otherwise(1.0))
        else:
            out.append(F.lit(1.0))
    return F.array(*out)


def feature_array() -> Column:
    return F.array(*[F.col(f).cast("double") for f in FEATURES])


def analog_queries(signatures: DataFrame, runs: DataFrame, norm: DataFrame,
                   as_of: str = "forecast_start") -> DataFrame:
    """The live signature of every run with its squared-difference coefficients."""
    order = F.create_map(*[F.lit(x) for i, f in enumerate(FEATURES) for x in (f, i)])
    scales = (
        norm.groupBy("series_id")
        .agg(F.sort_array(F.collect_list(F.struct(order[F.col("feature")].alias("i"),
                                                  F.col("scale").alias("v")))).alias("s"))
        .select("series_id", F.transform("s", lambda x: x["v"]).alias("scales"))
    )
    live = runs.select("run_id", "series_id", F.col(as_of).alias("origin")).join(
        signatures, ["series_id", "origin"])
    return join_salted(live, scales, "series_id", "run_id").select(
        "run_id", "series_id", F.col("origin").alias("as_of"),
        feature_array().alias("live"),
        F.zip_with(feature_weights(), "scales", lambda w, s: w / (s * s)).alias("coef"),
    )


def analog_distance(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Weighted distance of every run to its series' candidates that end before it.

    Pairs per run are bounded by the days of the series' history. Candidates are cut into
    blocks by a hash of their origin and a run meets each block on its own, so the pairs of
    a series with many runs are spread over as many tasks.
    """
    n = blocks(queries.sparkSession)
    cand = candidates.select(
        "series_id", "origin", "target_start", "target_end", feature_array().alias("cand"),
        F.pmod(F.xxhash64("origin"), F.lit(n)).cast("int").alias("block"),
    )
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    square = F.lit(0.0)
    for i in range(len(FEATURES)):
        gap = F.get("cand", F.lit(i)) - F.get("live", F.lit(i))
        square = square + F.get("coef", F.lit(i)) * gap * gap
    return (
        asked.join(cand, ["series_id", "block"])
        .filter(F.col("target_end") < F.col("as_of"))
        .select("run_id", "series_id", "block", "origin", "target_start", "target_end",
                F.sqrt(square).alias("distance"))
    )


def analog_topk_min_gap(distances: DataFrame, k: int = 5, min_gap_days: int = 14) -> DataFrame:
    """The k nearest origins of every run that lie at least ``min_gap_days`` apart.

    One pass over a run's candidates in order of (distance, origin): a candidate is
    taken unless k are taken or one of them is too near. Only the first
    (k - 1) * (2 * gap - 1) + 1 candidates of that order can be taken: origins are distinct
    days, so each one taken rules out at most 2 * gap - 1 of them, itself included, and
    before the last at most k - 1 are taken. A ranked window keeps those, so a
    collected group has that bound, whatever the length of the history. Where ``distances`` has
    blocks, that many of each block leave their task before a run's blocks meet.
    """
    reach = (k - 1) * (2 * max(min_gap_days, 1) - 1) + 1

    def first(rows: DataFrame, *by: str) -> DataFrame:
        nearest = Window.partitionBy("run_id", "series_id", *by).orderBy("distance", "origin")
        return rows.withColumn("place", F.row_number().over(nearest)).filter(
            F.col("place") <= reach).drop("place")

    if "block" in distances.columns:
        distances = first(distances, "block")
    distances = first(distances)
    pair = F.struct("distance", "origin", "target_start", "target_end")

    def take(picked: Column, x: Column) -> Column:
        near = F.exists(
            picked, lambda p: F.abs(F.datediff(x["origin"], p["origin"])) < min_gap_days
        )
        return F.when((F.size(picked) >= k) | near, picked).otherwise(
            F.concat(picked, F.array(x))
        )

    ordered = distances.groupBy("run_id", "series_id").agg(
        F.sort_array(F.collect_list(pair)).alias("ordered")
    )
    empty = F.slice("ordered", 1, 0)
    return (
        ordered.select("run_id", "series_id",
                       F.aggregate("ordered", empty, take).alias("picked"))
        .select("run_id", "series_id", F.posexplode("picked").alias("i", "p"))
        .select("run_id", "series_id", (F.col("i") + 1).alias("rank"), "p.*")
    )


def distance_warning(matches: DataFrame, threshold: float = DISTANCE_WARNING) -> DataFrame:
    """Runs whose best match is far away."""
    return matches.groupBy("run_id").agg(
        F.min("distance").alias("best_distance"),
        (F.min("distance") > threshold).alias("far"),
    )


def anchor_feature_table(anchors: DataFrame, funnel: DataFrame) -> DataFrame:
    """Signature of the two months that lead into each anchor's window."""
    start = F.add_months("window_start", -2)
    windows = anchors.select(
        F.col("label").alias("window_id"),
        F.col("channel").alias("series_id"),
        start.alias("start"),
        F.date_sub("window_start", 1).alias("end"),
        F.add_months(start, -2).alias("prior_start"),
        F.date_sub(start, 1).alias("prior_end"),
    )
    return volume_features(funnel, windows)


ANCHOR_FEATURES = [*LEVELS, *CHANGES, "biz_day_count"]


def live_anchor_windows(runs: DataFrame) -> DataFrame:
    """The two months that end the day before a run, on the anchors' footing."""
    start = F.add_months("today", -2)
    return runs.select(
        F.col("run_id").alias("window_id"),
        "series_id",
        start.alias("start"),
        F.date_sub("today", 1).alias("end"),
        F.add_months(start, -2).alias("prior_start"),
        F.date_sub(start, 1).alias("prior_end"),
    )


def anchor_lookup(runs: DataFrame, anchors: DataFrame, funnel: DataFrame,
                  force_month: int | None = None) -> DataFrame:
    """Nearest anchor of every run by z-scored features.

    January targets see January anchors only, others the rest. Ties go to the
    anchor whose window ends nearest to the live window's end. Anchors are tuned
    windows, a few dozen per series. What a run looks for depends on its series and date
    alone, so each date is matched once, however many runs share it.
    """
    key = F.concat_ws("@", "series_id", F.col("today").cast("string"))
    dates = runs.select("series_id", "today").distinct().withColumn("run_id", key)
    table = anchor_feature_table(anchors, funnel)
    live = volume_features(funnel, live_anchor_windows(dates))
    stats = table.groupBy("series_id").agg(
        F.array(*[F.avg(f) for f in ANCHOR_FEATURES]).alias("means"),
        F.array(*[F.stddev(f) for f in ANCHOR_FEATURES]).alias("stds"),
    )

    def scored(rows: DataFrame, name: str, z: str) -> DataFrame:
        values = [
            F.coalesce(F.try_divide(F.col(f) - F.get("means", F.lit(i)), F.get("stds", F.lit(i))),
                       F.lit(0.0))
            for i, f in enumerate(ANCHOR_FEATURES)
        ]
        return rows.join(stats, "series_id").select(
            "series_id", F.col("window_id").alias(name), F.array(*values).alias(z))

    pool = anchors.select(
        F.col("label"), F.col("channel").alias("series_id"), "window_end", "january_only"
    )
    if force_month is None:
        start_month, end_month = F.month(F.add_months("today", -2)), F.month(
            F.date_sub("today", 1)
        )
        month = F.when((start_month == 1) | (end_month == 1), F.lit(1)).otherwise(
            F.month("today")
        )
    else:
        month = F.lit(force_month)
    targets = dates.select(
        "run_id", "series_id", "today", (month == 1).alias("wants_january")
    )
    # a date meets the anchors of its series and kind once, with all features in one array
    square = F.lit(0.0)
    for i in range(len(ANCHOR_FEATURES)):
        gap = F.get("z", F.lit(i)) - F.get("za", F.lit(i))
        square = square + gap * gap
    known = scored(table, "label", "za").join(pool, ["series_id", "label"])
    wanted = scored(live, "run_id", "z").join(targets, ["run_id", "series_id"])
    best = (
        wanted.join(known.withColumnRenamed("january_only", "wants_january"),
                    ["series_id", "wants_january"])
        .withColumn("d", F.sqrt(square))
        .withColumn("gap", F.abs(F.datediff("window_end", F.date_sub("today", 1))))
        .groupBy("series_id", "today")
        .agg(
            F.min_by(
                F.struct("label", F.col("d").alias("distance")),
                F.struct(F.round("d", 9), F.col("gap"), F.col("label")),
            ).alias("b")
        )
    )
    return runs.select("run_id", "series_id", "today").join(best, ["series_id", "today"]).select(
        "run_id", "series_id", "b.label", "b.distance")


def nearest_anchor(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchor of the same series whose window starts nearest to the target.

    On a tie the earlier window. Targets are reduced to their dates and lie with the anchors on
    one line per series; the last anchor before and the next one after a date are the only
    ones to compare, so nothing multiplies.
    """
    row = F.struct(*[F.col(c) for c in anchors.columns if c != "channel"])
    known = anchors.groupBy(F.col("channel").alias("series_id"), "window_start").agg(
        F.min(row).alias("anchor"))
    asked = targets.select("run_id", "series_id", "target_start").distinct()
    dates = asked.select("series_id", F.col("target_start").alias("at")).distinct()
    line = dates.withColumn("wanted", F.lit(True)).unionByName(
        known.withColumnRenamed("window_start", "at"), allowMissingColumns=True)
    series = Window.partitionBy("series_id")

    def upto(order: Column) -> Column:  # rows of one date see each other
        return F.last("anchor", ignorenulls=True).over(series.orderBy(order))

    both = line.withColumns({"before": upto(F.col("at")), "after": upto(F.col("at").desc())}).filter("wanted")
    nearer = F.when(
        F.col("after").isNull()
        | (F.datediff("at", "before.window_start") <= F.datediff("after.window_start", "at")),
        F.col("before")).otherwise(F.col("after"))
    found = both.select("series_id", F.col("at").alias("target_start"), nearer.alias("a")).filter("a IS NOT NULL")
    return asked.join(found, ["series_id", "target_start"]).select(
        "run_id", "series_id", "target_start", "a.*")
