"""Analytic cases of the measurement operators. Deviations that tests name: counts are totalled once a group, quantile
settings are honoured, results are kept by method, reports survive a null r squared, and types are checked."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError, DataValidationError, InputValidationError, SchemaError, UnitError
from tidemark.functions import quality, units
from tidemark.operators import correlate, describe, timeops, trend
from tidemark.plans import jobs
from tidemark.plans.provenance import config_hash
from tidemark.sources.series import Measurements, map_columns

T0 = datetime(2024, 1, 1)
SCHEMA = "datetime timestamp_ntz, site_id string, pollutant string, conc double, flag string"


def rows(spark, values, site="S1", cat="PM25", flag="valid", start=0):
    flags = flag if isinstance(flag, list) else [flag] * len(values)
    return spark.createDataFrame([(T0 + timedelta(hours=start + i), site, cat, float(v), f) for i, (v, f) in enumerate(zip(values, flags))], SCHEMA)


def test_describe_basic_and_emptied_group(spark):
    df = rows(spark, [float(i) for i in range(1, 11)]).union(rows(spark, [1.0] * 5, "S2", flag="invalid"))
    out = describe.describe(df, ["conc"], ["site_id"], "pollutant").collect()
    s1 = {r["stat"]: r["value"] for r in out if r["site_id"] == "S1"}
    assert len(s1) == 9 and s1["mean"] == s1["median"] == 5.5 and (s1["min"], s1["max"]) == (1.0, 10.0)
    assert (s1["q05"], s1["q25"], s1["q75"], s1["q95"]) == (1.0, 3.0, 8.0, 10.0)
    s2 = [r for r in out if r["site_id"] == "S2"]
    assert len(s2) == 9 and all((r["value"], r["n_total"], r["n_valid"], r["n_missing"]) == (None, 5, 0, 5) for r in s2)


def test_null_flag_counts_as_valid_in_describe_only(spark):
    df = rows(spark, [1.0, 2.0, 3.0, 4.0, 5.0], flag=[None] * 5)
    assert describe.describe(df, ["conc"]).first()["n_valid"] == 5
    assert correlate.correlate(df, ["datetime"], allow_missing_units=True).count() == 0
    assert quality.filter_by_qc_flags(df, "flag").count() == 0


def test_nan_is_null_and_types_are_checked(spark):
    m = Measurements(rows(spark, [1.0, float("nan"), 3.0, 4.0, 4.0]))
    assert describe.describe(m.frame, ["conc"]).first()["n_missing"] == 1
    with pytest.raises(DataValidationError):
        describe.describe(m.frame, ["site_id"])
    with pytest.raises(DataValidationError):
        Measurements(rows(spark, [1.0]).limit(0))
    with pytest.raises(SchemaError):
        Measurements(rows(spark, [1.0]), time_col="when")


def test_correlation_pairs_by_place(spark):
    df = rows(spark, [1.0, 2, 3, 4, 5], "a").union(rows(spark, [2.0, 4, 6, 8, 10], "a", "PM10", start=5))
    df = df.union(rows(spark, [1.0, 2, 3, 4, 5], "b")).union(rows(spark, [5.0, 4, 3, 2, 1], "b", "PM10", start=5))
    out = {(r["site_id"], r["var_x"], r["var_y"]): (r["correlation"], r["n"]) for r in correlate.correlate(df, ["datetime"], ["site_id"], allow_missing_units=True).collect()}
    assert len(out) == 6
    assert out["a", "PM10", "PM25"] == (pytest.approx(1), 5) and out["b", "PM10", "PM25"] == (pytest.approx(-1), 5)


def test_correlation_thresholds_ties_and_constants(spark):
    df = rows(spark, [1.0, 2, 3, 4, 5]).union(rows(spark, [1.0, 2, 3], cat="PM10"))
    assert correlate.correlate(df, ["datetime"], allow_missing_units=True).count() == 3
    only = correlate.correlate(df, ["datetime"], min_samples=5, allow_missing_units=True).collect()
    assert [(r["var_x"], r["n"]) for r in only] == [("PM25", 5)]
    ties = rows(spark, [1.0, 2, 2, 3, 3, 3]).union(rows(spark, [1.0, 2, 2, 3, 3, 3], cat="X"))
    assert {round(r["correlation"], 9) for r in correlate.correlate(ties, ["datetime"], method="spearman", allow_missing_units=True).collect()} == {1.0}
    flat = correlate.correlate(rows(spark, [5.0] * 5), ["datetime"], allow_missing_units=True).first()
    assert flat["n"] == 5 and flat["correlation"] != flat["correlation"]
    with pytest.raises(UnitError):
        correlate.correlate(df, ["datetime"])
    with pytest.raises(ConfigurationError):
        correlate.correlate(df, ["datetime"], method="kendall", allow_missing_units=True)


def test_trend(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=i), "A", 2.0 * i + 5, "valid") for i in range(10)] + [(T0 + timedelta(days=i), "B", 42.0, "valid") for i in range(10)], "datetime timestamp_ntz, pollutant string, concentration double, flag string")
    a, b = trend.linear_trend(df, "day", "pollutant", units={"concentration": "ppb"}).collect()
    assert (a["slope"], a["intercept"], a["r_squared"], a["n"]) == (pytest.approx(2), pytest.approx(5), pytest.approx(1), 10)
    assert (b["slope"], b["intercept"], b["r_squared"]) == (0, pytest.approx(42), None) and a["slope_units"] == "ppb/day" and a["short_duration_flag"]


def test_elapsed_and_units(spark):
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    m, y, h = spark.range(1).select(units.elapsed(t, t, "calendar_month"), units.elapsed(t, t, "calendar_year"), units.elapsed(t, t, "hour")).first()
    assert (m, y, h) == (pytest.approx(1 / 31), pytest.approx(1 / 366), 0)
    assert units.get_factor("mg/m3", "ug/m3") == 1000 and not units.can_convert("ppb", "ug/m3") and units.format_time_unit("calendar_year") == "year"
    with pytest.raises(UnitError):
        units.Unit.parse("PPB")
    with pytest.raises(UnitError):
        units.get_factor("ppb", "ug/m3")


def test_rolling_and_resample(spark):
    df = rows(spark, [1.0, 2, 3, 4, 5])
    assert [r["conc"] for r in timeops.rolling_window_mean(df, 3, columns=["conc"]).orderBy("datetime").collect()] == [1.5, 2, 3, 4, 4.5]
    assert [r["conc"] for r in timeops.rolling_window_mean(df, 1, columns=["conc"]).orderBy("datetime").collect()] == [1, 2, 3, 4, 5]
    gap = rows(spark, [1.0]).union(rows(spark, [3.0], start=3))
    assert [r["conc"] for r in timeops.resample_mean(gap, "1H", columns=["conc"]).orderBy("datetime").collect()] == [1, None, None, 3]
    with pytest.raises(ValueError):
        timeops.rolling_window_mean(df, 0)
    with pytest.raises(ConfigurationError):
        timeops.resample_mean(df, "1W")


def test_resample_gaps_takes_all_users_and_fills_the_whole_range(spark, tmp_path):
    from tidemark.plans import catalogue

    events = [(i, T0 + timedelta(seconds=47 * i * i), 5 * i % 11, "view", float(i)) for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    bins = {}
    for _, t, _, _, v in events:
        bins.setdefault(t.replace(second=0), []).append(v)
    n = 1 + (max(bins) - min(bins)) // timedelta(minutes=1)
    want = {t: round(sum(bins[t]) / len(bins[t]), 6) if t in bins else None for t in (min(bins) + timedelta(minutes=k) for k in range(n))}
    got = catalogue.QUERIES["resample_gaps"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > len(bins) and {r["datetime"]: r["conc"] for r in got} == want


def test_mapping(spark):
    df = spark.createDataFrame([(1, 2)], "Timestamp int, value int")
    assert map_columns(df, required=["timestamp", "conc"], synonyms={"conc": ["VALUE"]}).frame.columns == ["timestamp", "conc"]
    for bad in ({"required": ["x"]}, {"required": ["value"], "synonyms": {"value": ["timestamp"]}}, {"required": [], "explicit": {"a": "nope"}}):
        with pytest.raises(SchemaError):
            map_columns(df, **bad)
    with pytest.raises(InputValidationError):
        map_columns([1], required=[])


def test_jobs(spark):
    df = rows(spark, [float(i) for i in range(1, 11)])
    job = jobs.DescriptiveJob.from_dataset(Measurements(df))
    with pytest.raises(RuntimeError):
        job.report_cli()
    payload = job.run().report_dashboard()
    assert payload["metrics"]["totals"] == {"n_total": 10, "n_valid": 10, "n_missing": 0} and json.dumps(payload)
    with pytest.raises(RuntimeError):
        job.run()
    with pytest.raises(ConfigurationError):
        jobs.TrendJob(Measurements(df), {"time_unit": "day"})
    t = jobs.TrendJob(Measurements(rows(spark, [1.0] * 4)), {jobs.TrendJob.Config.VALUE_COL: "conc", jobs.TrendJob.Config.ALLOW_MISSING_UNITS: True}).run()
    assert "linear_trend" in t.report_cli() and t.report_dashboard()["metrics"]["linear_trend"][0]["r_squared"] is None
    c = jobs.CorrelationJob(Measurements(df), {jobs.CorrelationJob.Config.ALLOW_MISSING_UNITS: True}).run(["pearson", "spearman"])
    assert set(c.results) == {"pearson", "spearman", "units_status"} and c.results["units_status"] == "overridden"
    assert jobs.RowCountJob(Measurements(df)).run().results["row_count"] == 10
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})


def test_spread_ranks_match_one_sort(spark):
    r = random.Random(7)
    values = [r.choice([-1e60, -2.5, -0.0, 0.0, 1e-300, 3.0, r.uniform(-9, 9), r.gauss(1e6, 1)]) for _ in range(300)]
    df = rows(spark, values).union(rows(spark, values[:170], cat="X")).union(rows(spark, values[5:100], cat="Y"))
    for method in ("pearson", "spearman"):
        got = [sorted((r["var_x"], r["var_y"], r["n"], round(r["correlation"], 9)) for r in correlate.correlate(df, ["datetime"], method=method, allow_missing_units=True, spread=s).collect()) for s in (True, False)]
        assert got[0] == got[1] and len(got[0]) == 6 and {n for *_, n, _ in got[0]} == {300, 170, 95}
    want = sorted(values)
    out = {r["stat"]: r["value"] for r in describe.describe(df.where("pollutant = 'PM25'"), ["conc"]).collect()}
    assert out["median"] == (want[149] + want[150]) / 2
    assert [out[f"q{q:02d}"] for q in (5, 25, 75, 95)] == [want[int(299 * q / 100 + 0.5)] for q in (5, 25, 75, 95)]
    odd = rows(spark, [float("inf"), float("-inf"), float("nan"), 1.0])
    got = {r["stat"]: r["value"] for r in describe.describe(odd, ["conc"], quantiles=(0.0, 0.5, 1.0)).collect()}
    assert (got["q00"], got["q50"]) == (float("-inf"), float("inf")) and got["q100"] != got["q100"]
    for spot in (describe.describe(df, ["conc"]), correlate.correlate(df, ["datetime"], allow_missing_units=True)):
        assert "collect_list" not in spot._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_python(spark):
    df = rows(spark, [1.0, 2, 3])
    for out in (describe.describe(df, ["conc"]), correlate.correlate(df, ["datetime"], allow_missing_units=True), timeops.rolling_window_mean(df, keys=["site_id"])):
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_times_are_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_seconds(1704067200 + 3600 * id) AS datetime, CAST(id AS DOUBLE) AS v FROM range(30)")
        b = timeops.time_bounds(df)
        assert b.start.isoformat() == "2024-01-01T00:00:00+00:00" and b.end.isoformat() == "2024-01-02T05:00:00+00:00"
        days = timeops.resample_mean(df, "1D").orderBy("datetime").collect()
        assert [(r["datetime"].isoformat(), r["v"]) for r in days] == [("2024-01-01T00:00:00", 11.5), ("2024-01-02T00:00:00", 26.5)]
        naive = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS datetime")
        assert timeops.time_bounds(naive).start.isoformat() == "2024-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_calendar_rules(spark):
    df = spark.sql("SELECT to_timestamp_ntz(d) AS datetime, v FROM VALUES ('2024-01-31 12:00:00', 1.0), ('2024-03-01 00:00:00', 3.0), ('2024-03-31 23:00:00', 5.0), ('2025-02-01 00:00:00', 7.0) AS t(d, v)")
    got = {rule: [(r["datetime"].date().isoformat(), r["v"]) for r in timeops.resample_mean(df, rule).orderBy("datetime").collect() if r["v"] is not None] for rule in ("MS", "ME", "QS", "Y", "2MS")}
    assert got["MS"] == [("2024-01-01", 1.0), ("2024-03-01", 4.0), ("2025-02-01", 7.0)]
    assert got["ME"] == [("2024-01-31", 1.0), ("2024-03-31", 4.0), ("2025-02-28", 7.0)]
    assert got["QS"] == [("2024-01-01", 3.0), ("2025-01-01", 7.0)] and got["Y"] == [("2024-12-31", 3.0), ("2025-12-31", 7.0)]
    assert got["2MS"] == [("2024-01-01", 1.0), ("2024-03-01", 4.0), ("2025-01-01", 7.0)]
    for rule in ("W", "0h", "2ME", "x"):
        with pytest.raises(ConfigurationError):
            timeops.resample_mean(df, rule)


def test_trend_keys_of_any_name(spark):
    rows = [(g, datetime(2024, 1, 1 + i), 2.0 * i + 5, "valid", "c") for g in ("a", "b") for i in range(5)]
    for key in ("x", "n", "t", "y", "_t", "slope0"):
        df = spark.createDataFrame(rows, f"`{key}` string, datetime timestamp_ntz, concentration double, flag string, pollutant string")
        got = trend.linear_trend(df, "day", "pollutant", group_by=[key], allow_missing_units=True).collect()
        assert [(r[1], round(r[2], 9), round(r[3], 9), r[5]) for r in got] == [("a", 2.0, 5.0, 5), ("b", 2.0, 5.0, 5)]


def test_checks_of_settings_and_types(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, v double")
    with pytest.raises(TypeError):
        units.convert_column(df, "s", "ug/m3", "mg/m3")
    assert units.convert_column(df, "v", "mg/m3", "ug/m3").first()["v"] == 1000.0 and units.convert_column(df, "s", "ppb", "ppb") is df
    with pytest.raises(TypeError):
        units.convert_values([1.0], "ppb", "ppm")
    with pytest.raises(ValueError):
        units.elapsed_between(datetime(2024, 1, 2), datetime(2024, 1, 1), "day")
    same = datetime(2024, 1, 1)
    assert units.elapsed_between(same, same, "calendar_month") == pytest.approx(1 / 31) and units.elapsed_between(same, same, "calendar_year") == pytest.approx(1 / 366)
    ts = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, "valid", "p")], "datetime timestamp_ntz, concentration double, flag string, pollutant string")
    data = Measurements(ts)
    with pytest.raises(ValueError):
        jobs.TrendJob(data, {jobs.TrendJob.Config.TIME_UNIT: "week"})
    with pytest.raises(ConfigurationError):
        jobs.TrendJob(data, metadata={"title": "t"})


def test_correlation_report_and_hooks(spark):
    rows = [(datetime(2024, 1, 1, i), s, c, float(i * k), "valid") for s in ("s1", "s2") for c, k in (("a", 1), ("b", -2), ("c", 3)) for i in range(5)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, site_id string, pollutant string, conc double, flag string")
    seen = []

    class Own(jobs.CorrelationJob):
        def post_process(self):
            seen.append(set(self.results))

    c = jobs.CorrelationJob.Config
    text = Own(Measurements(df), {c.ALLOW_MISSING_UNITS: True, c.ORDER_BY: ["datetime", "site_id"]}).run().report_cli()
    assert seen == [{"pearson", "units_status"}] and "Strongest positive:" in text and "a - c: 1.000" in text and "a - b: -1.000" in text
    grouped = jobs.CorrelationJob(Measurements(df), {c.ALLOW_MISSING_UNITS: True, c.GROUP_BY: ["site_id"]}).run().report_cli()
    assert "site_id=s1" in grouped and "site_id=s2" in grouped


def test_public_names():
    import tidemark

    assert all(callable(getattr(tidemark, n)) for n in tidemark.__all__ if n != "__version__") and tidemark.hello()
