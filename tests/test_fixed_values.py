"""Fixed values written out a second time, so that a wrong constant cannot hide in both library and SQL."""

import math

from tidecast.functions.predicates import EXCLUDED_STATUS_CODES
from tidecast.operators import structural as st
from tidecast.operators import study as sy
from tidecast.operators import sweep as sw
from tidecast.plans.backtest import DATE_RANGES
from tidecast.sources import binding as b


def test_sizes_of_grids_and_lists():
    assert math.prod(map(len, sw.MONTHLY_GRID.values())) == 128
    assert math.prod(map(len, sw.WINDOW_GRID.values())) == 6561
    assert len(DATE_RANGES) == 23 and len(EXCLUDED_STATUS_CODES) == 27
    assert len(sy.TARGETS) == 9 and sy.LEADS == (0, 1, 2, 3)


def test_25_months_are_swept():
    first, last = b.ANCHOR_MONTHS
    assert (last.year - first.year) * 12 + last.month - first.month + 1 == 25


def test_defaults_of_model_r():
    assert st.MODEL_R.defaults == {
        "recency_strength": 0.55, "dow_shrinkage": 0.15, "interaction_shrinkage": 0.60,
        "seasonal_exponent": 1.02, "trend_dampening": 0.75, "forward_lift_daily": 0.004,
        "level_lookback_days": 30, "trend_seasonal_tilt": 0.12}
    assert st.MODEL_R.dow_shrinkage_multipliers == {0: 0.5, 1: 1.6, 2: 0.8, 3: 0.9, 4: 0.8}
    assert (st.MODEL_R.holiday_before, st.MODEL_R.holiday_after) == (1, 2)
    assert (st.MODEL_C.holiday_before, st.MODEL_C.holiday_after, st.MODEL_C.cliff_day) == (2, 6, 18)
