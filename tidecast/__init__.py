"""tidecast: daily-volume histories, funnel metrics and short-horizon forecasts as Spark jobs.

Every step takes and returns DataFrames keyed by ``series_id``, ``run_id`` and
``param_id``, so one job covers all series, run dates and parameter sets.
"""
