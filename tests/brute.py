"""Brute force on one series in numpy, loop by loop, for the default flags of a spec."""

from __future__ import annotations

import datetime as dt
import math
from statistics import mean, median

import numpy as np


def weekdays_step(day: dt.date, n: int) -> dt.date:
    step = 1 if n > 0 else -1
    left = abs(n)
    while left:
        day += dt.timedelta(days=step)
        left -= day.weekday() < 5
    return day


def grouped(rows, key, value):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(value(r))
    return out


def normal(table):
    m = mean(table.values())
    return {k: v / m for k, v in table.items()}


def forecast_one(series, holidays, spec, params, start, end):
    """``series``: list of (day, amount) of one run's training rows, in day order."""
    s, q = spec, params
    hol = set(holidays)
    rows = [
        {"t": t, "day": d, "y": a / s.target_scale, "dow": d.weekday(), "dom": d.day, "moy": d.month}
        for t, (d, a) in enumerate(series)
    ]
    prod = [r for r in rows if r["dow"] < 5 and r["day"] not in hol and r["y"] > 0]
    p = np.arange(len(prod))
    w = np.exp(q["recency_strength"] * p / len(prod))
    x = np.vstack([np.ones(len(p)), p]).T * np.sqrt(w)[:, None]
    yy = np.log([r["y"] for r in prod]) * np.sqrt(w)
    a, b = np.linalg.lstsq(x, yy, rcond=None)[0]
    for r in rows:
        r["trend"] = math.exp(a + b * r["t"])
    tail = prod[-int(q["level_lookback_days"]):]
    lw = np.exp(np.linspace(0, 2, len(tail))) if s.rank_weighted_level else np.ones(len(tail))
    level = np.dot(lw, [r["y"] for r in tail]) / np.dot(lw, [r["trend"] for r in tail])

    last = rows[-1]["day"]
    halo = {h + dt.timedelta(days=k) for h in hol
            for k in range(-s.holiday_before, s.holiday_after + 1)} if s.exclude_halo else set()
    seas = [
        r for r in prod
        if r["day"] not in halo
        and (not s.completed_months_only or r["day"] < last.replace(day=1))
        and (not s.december_only or r["moy"] == 12)
    ]
    left = {id(r): r["y"] / r["trend"] for r in seas}

    def fit(key):
        return {k: mean(v) for k, v in grouped(seas, key, lambda r: left[id(r)]).items()}

    def divide(key, effect):
        for r in seas:
            left[id(r)] /= effect[key(r)]

    def pull(k, v):
        shrink = q["dow_shrinkage"] * s.dow_shrinkage_multipliers.get(k, 1.0)
        return (1 - shrink) * v + shrink * level

    by_dow = lambda r: r["dow"]
    dow = normal({k: pull(k, v) for k, v in fit(by_dow).items()}) if seas else {}
    divide(by_dow, dow)
    dom, moy = {}, {}
    if s.use_dom and seas:
        dom = normal(fit(lambda r: r["dom"]))
        divide(lambda r: r["dom"], dom)
    if s.use_moy and seas:
        moy = normal(fit(lambda r: r["moy"]))
        divide(lambda r: r["moy"], moy)
    raw = fit(lambda r: (r["dow"], r["moy"])) if seas else {}
    c = q["interaction_shrinkage"]
    inter = normal({k: (1 - c) * v + c * mean(raw.values()) for k, v in raw.items()}) if raw else {}

    def season(r, with_moy):
        if r["dow"] > 4:
            return 0.0
        out = dow.get(r["dow"], 1.0) * inter.get((r["dow"], 12 if s.december_only else r["moy"]), 1)
        out *= dom.get(r["dom"], 1.0)
        return out * (moy.get(r["moy"], 1.0) if with_moy else 1.0)

    factors = {}
    if s.learns_distortion:
        part = rows
        if s.distortion_lookback_days is not None:
            cut = last - dt.timedelta(days=s.distortion_lookback_days)
            part = [r for r in rows if r["day"] >= cut]
        values = [season(r, s.expected_uses_moy) for r in part]
        scale = mean(values)
        for i, (r, v) in enumerate(zip(part, values)):
            base = level * math.exp(a + b * i)
            if s.expected_normalised:
                z = (v / scale) ** q["seasonal_exponent"]
                r["expected"] = base * z * (1 + q["trend_seasonal_tilt"] * (z - 1))
            else:
                r["expected"] = base * v
        work = [r for r in part if r["dow"] < 5]
        ratios = {}
        for i, h in enumerate(work):
            if h["day"] not in hol or (s.december_holidays_only and h["moy"] != 12):
                continue
            for k in s.offsets():
                if 0 <= i + k < len(work):
                    r = work[i + k]
                    if r["day"] not in hol and r["y"] > 0 and r["expected"] > 0:
                        ratios.setdefault((h["dow"], k), []).append(r["y"] / r["expected"])
        for key, v in ratios.items():
            if len(v) >= s.distortion_min_obs:
                f = (1 - s.holiday_shrinkage) * median(v) + s.holiday_shrinkage
                if s.distortion_max_factor is not None:
                    f = min(max(f, 1 / s.distortion_max_factor), s.distortion_max_factor)
                factors[key] = f

    cliff = 1.0
    if s.cliff_day is not None:
        before = [r["y"] for r in seas if r["dom"] <= s.cliff_day]
        after = [r["y"] for r in seas if r["dom"] > s.cliff_day]
        cliff = mean(after) / mean(before) if before and after else 1.0

    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    ahead = [{"day": d, "dow": d.weekday(), "dom": d.day, "moy": d.month} for d in days]
    values = [season(r, True) for r in ahead]
    scale = mean(values)
    distortion = {}
    first = start - dt.timedelta(days=2 * (s.holiday_before + 1))
    for h in sorted(x for x in hol if first <= x <= end):
        for k in s.offsets():
            distortion[weekdays_step(h, k)] = factors.get((h.weekday(), k), 1.0)
    out = {}
    for i, (r, v) in enumerate(zip(ahead, values)):
        z = (v / scale) ** q["seasonal_exponent"]
        value = (level * z * math.exp(a + b * q["trend_dampening"] * (len(rows) + i))
                 * (1 + q["trend_seasonal_tilt"] * (z - 1))
                 * (1 + q["forward_lift_daily"] * i))
        if s.cliff_day is not None and r["moy"] == 12 and r["dom"] > s.cliff_day:
            value *= cliff + (1 - cliff) * s.cliff_shrinkage
        if r["dow"] > 4 or r["day"] in hol:
            value = 0.0
        out[r["day"]] = value * distortion.get(r["day"], 1.0) * s.target_scale
    return out
