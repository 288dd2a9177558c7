"""The registered queries over the driver's tables, each beside the SQL that says the same.

The tables carry no quality flag; FLAG derives one from a key by the same CASE on both sides. Doubles are rounded to six
decimals, since the engines sum in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, units
from ..operators import correlate, describe, timeops, trend
from ..sources.series import map_columns

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _flag(key: str) -> str:
    return f"CASE WHEN {key} % 20 = 0 THEN 'invalid' WHEN {key} % 20 = 1 THEN 'outlier' WHEN {key} % 20 = 2 THEN 'below_dl' WHEN {key} % 20 = 3 THEN NULL ELSE 'valid' END"


EVENTS = f"SELECT ts AS datetime, user_id AS site_id, event_type AS pollutant, value AS conc, {_flag('event_id')} AS flag, event_id FROM events"
ORDERS = f"SELECT o_orderdate AS datetime, o_orderpriority AS pollutant, o_orderstatus AS status, o_totalprice AS conc, {_flag('o_orderkey')} AS flag, o_orderkey FROM orders"
LINES = f"SELECT l_shipdate AS datetime, l_returnflag AS pollutant, l_extendedprice AS price, l_quantity AS qty, {_flag('l_orderkey')} AS flag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"
_SOURCES = {"events": EVENTS, "orders": ORDERS, "lineitem": LINES}
LINE_ORDER = ["datetime", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table in canonical columns."""
    select, _, _ = _SOURCES[table].rpartition(" FROM ")
    cols, depth, at, text = [], 0, 0, select.removeprefix("SELECT ")
    for i, c in enumerate(text + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            cols.append(text[at:i].strip())
            at = i + 1
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*cols)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits) + F.lit(0.0) for c in names})


# -- projection and quality flags
query("map_columns", "SELECT ts AS datetime, user_id AS site_id, event_type AS pollutant, value AS conc FROM events")(
    lambda s, d: map_columns(s.read.parquet(f"{d}/events.parquet"), required=["datetime", "site_id", "pollutant", "conc"], synonyms={"datetime": ["ts"], "pollutant": ["EVENT_TYPE"], "conc": ["value"]}, explicit={"site_id": "user_id"}).frame.select("datetime", "site_id", "pollutant", "conc")
)
query("qc_exclude", f"SELECT event_id, conc, flag FROM ({EVENTS}) WHERE flag NOT IN ('invalid', 'outlier')")(
    lambda s, d: quality.filter_by_qc_flags(source(s, d, "events"), "flag").select("event_id", "conc", "flag")
)
query("qc_mask", f"SELECT event_id, CASE WHEN flag = 'below_dl' THEN NULL ELSE conc END AS conc, flag FROM ({EVENTS})")(
    lambda s, d: quality.mark_missing_by_flags(source(s, d, "events"), "conc", "flag").select("event_id", "conc", "flag")
)
query("qc_null_valid", f"SELECT event_id, CASE WHEN coalesce(flag, 'valid') = 'valid' THEN conc END AS conc FROM ({EVENTS})")(
    lambda s, d: source(s, d, "events").select("event_id", quality.valid_value(F.col("conc"), F.col("flag")).alias("conc"))
)

# -- descriptive statistics
_STATS = {"mean": "avg(v)", "median": "median(v)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)"} | {
    f"q{round(q * 100):02d}": f"list_sort(list(v) FILTER (v IS NOT NULL))[1 + round((count(v) - 1) * {q}::DOUBLE)::INT]" for q in describe.QUANTILES
}


def _valid(col: str) -> str:
    return f"CASE WHEN coalesce(flag, 'valid') NOT IN ('invalid', 'outlier', 'below_dl') THEN {col} END"


def _describe_sql(source_sql: str, keys: list[str], cols: list[str], stats=tuple(_STATS), wide: bool = False) -> str:
    ks, by = "".join(f"{k}, " for k in keys), f" GROUP BY {', '.join(keys)}" if keys else ""
    parts = []
    for c in cols:
        base = f"(SELECT *, {_valid(c)} AS v FROM ({source_sql}))"
        counts = f"{ks}count(*) AS n_total, count(v) AS n_valid, count(*) - count(v) AS n_missing, '{c}' AS value_col_name"
        if wide:
            parts.append(f"SELECT {counts}, " + ", ".join(f"round({_STATS[s]}, 6) AS {s}" for s in stats) + f" FROM {base}{by}")
        else:
            parts += [f"SELECT {counts}, '{s}' AS stat, round({_STATS[s]}, 6) AS value FROM {base}{by}" for s in stats]
    return " UNION ALL ".join(parts)


def _describe(name: str, table: str, cols: list[str], group_by: list[str], category: str | None, stats=None, names=tuple(_STATS), wide: bool = False) -> None:
    def run(s, d):
        out = describe.describe(source(s, d, table), cols, group_by, category, stats=stats, output="wide" if wide else "tidy")
        return _rounded(out, *(names if wide else ["value"]))

    query(name, _describe_sql(_SOURCES[table], [*group_by, *([category] if category else [])], cols, names, wide))(run)


_describe("describe_global", "events", ["conc"], [], None)
_describe("describe_by_category", "events", ["conc"], [], "pollutant")
_describe("describe_by_site_category", "events", ["conc"], ["site_id"], "pollutant")
_describe("describe_wide", "lineitem", ["price"], [], "pollutant", wide=True)
_describe("describe_multi_value", "lineitem", ["price", "qty"], [], "pollutant")
_describe("describe_selective", "lineitem", ["price"], [], "pollutant", [describe.Stat.MEAN, describe.Stat.MAX], ("mean", "max"))
_describe("describe_quantiles", "lineitem", ["qty"], [], "pollutant", [describe.Stat.QUANTILES], tuple(list(_STATS)[5:]))


# -- correlation
def _corr_sql(source_sql: str, cols: list[str], order: str, groups: tuple[str, ...] = (), spearman: bool = False, least: int = 3) -> str:
    parts = []
    for c in cols:
        g, ag = "".join(f"{x}, " for x in groups), "".join(f"a.{x}, " for x in groups)
        on = "".join(f" AND a.{x} IS NOT DISTINCT FROM b.{x}" for x in groups)
        over = f"{ag}a.pollutant, b.pollutant"
        rank = lambda v: f"rank() OVER (PARTITION BY {over} ORDER BY {v}) + (count(*) OVER (PARTITION BY {over}, {v}) - 1) / 2.0"
        x, y = (rank("a.v"), rank("b.v")) if spearman else ("a.v", "b.v")
        parts.append(
            f"""SELECT {g}var_x, var_y, '{c}' AS value_col_name, count(*) AS n,
            round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END, 6) + 0.0::DOUBLE AS correlation
            FROM (WITH k AS (SELECT * FROM (SELECT {g}pollutant, {order}, CASE WHEN flag = 'below_dl' THEN NULL ELSE {c} END AS v FROM ({source_sql}) WHERE flag NOT IN ('invalid', 'outlier')) WHERE v IS NOT NULL AND pollutant IS NOT NULL),
            e AS (SELECT DISTINCT pollutant FROM (SELECT {g}pollutant FROM k GROUP BY {g}pollutant HAVING count(*) >= {least})),
            r AS (SELECT *, row_number() OVER (PARTITION BY {g}pollutant ORDER BY {order}, v) AS rn FROM k WHERE pollutant IN (SELECT pollutant FROM e))
            SELECT {ag}a.pollutant AS var_x, b.pollutant AS var_y, {x} AS x, {y} AS y FROM r a JOIN r b ON a.rn = b.rn{on} AND a.pollutant <= b.pollutant) GROUP BY {g}var_x, var_y"""
        )
    return " UNION ALL ".join(parts)


def _corr(name: str, table: str, cols: list[str], order: list[str], groups: tuple[str, ...] = (), method: str = "pearson", least: int = 3) -> None:
    def run(s, d):
        return _rounded(correlate.correlate(source(s, d, table), order, list(groups), method, value_cols=cols, min_samples=least, allow_missing_units=True), "correlation")

    query(name, _corr_sql(_SOURCES[table], cols, ", ".join(order), groups, method == "spearman", least))(run)


_corr("pearson_global", "events", ["conc"], ["datetime", "event_id"])
_corr("pearson_by_site", "events", ["conc"], ["datetime", "event_id"], ("site_id",))
_corr("pearson_min_samples", "events", ["conc"], ["datetime", "event_id"], ("site_id",), least=20)
_corr("pearson_multi_value", "lineitem", ["price", "qty"], LINE_ORDER)
_corr("spearman_global", "events", ["conc"], ["datetime", "event_id"], method="spearman")
_corr("spearman_by_site", "events", ["conc"], ["datetime", "event_id"], ("site_id",), "spearman")
_TYPES = ("click", "error", "purchase", "signup", "view")


@query("corr_wide", "SELECT value_col_name, var_x, " + ", ".join(f"max(CASE WHEN var_y = '{t}' THEN correlation END) AS {t}" for t in _TYPES) + f" FROM ({_corr_sql(EVENTS, ['conc'], 'datetime, event_id')}) GROUP BY value_col_name, var_x")
def _corr_wide(s, d):
    return _rounded(correlate.correlate(source(s, d, "events"), ["datetime", "event_id"], allow_missing_units=True, wide=True), *_TYPES)


@query("top_correlations", f"SELECT var_x, var_y, correlation FROM ({_corr_sql(EVENTS, ['conc'], 'datetime, event_id')}) WHERE var_x <> var_y ORDER BY correlation DESC, var_x, var_y LIMIT 3")
def _top(s, d):
    return correlate.top_correlations(QUERIES["pearson_global"](s, d)).select("var_x", "var_y", "correlation")


# -- trends
def _elapsed_sql(a: str, b: str, unit: str) -> str:
    years = f"(year({b}) - year({a}))"
    return {
        "hour": f"date_diff('microsecond', {a}, {b}) / 3.6e9::DOUBLE",
        "day": f"date_diff('microsecond', {a}, {b}) / 8.64e10::DOUBLE",
        "calendar_month": f"12 * {years} + month({b}) - month({a}) + day({b})::DOUBLE / day(last_day({b}))",
        "calendar_year": f"{years} + dayofyear({b})::DOUBLE / dayofyear(make_date(year({b}), 12, 31))",
    }[unit]


def _trend(name: str, table: str, unit: str, keys: tuple[str, ...] = ("pollutant",)) -> None:
    def run(s, d):
        out = trend.linear_trend(source(s, d, table), unit, keys[0], value_col="conc", group_by=list(keys[1:]), allow_missing_units=True)
        return _rounded(_rounded(out, "slope", "r_squared", "duration_years"), "intercept", digits=4)

    k = ", ".join(keys)
    query(
        name,
        f"""SELECT {k}, round(CASE WHEN flat THEN 0.0::DOUBLE ELSE slope END, 6) AS slope, round(CASE WHEN flat THEN my ELSE my - slope * mx END, 4) AS intercept,
        round(CASE WHEN flat OR n * vy < 1e-12 THEN NULL ELSE r2 END, 6) AS r_squared, n, round({_elapsed_sql('start_time', 'end_time', 'calendar_year')}, 6) AS duration_years, start_time, end_time,
        {_elapsed_sql('start_time', 'end_time', 'calendar_year')} < 1.0 AS short_duration_flag, false AS low_n_flag, 'unknown/{unit}' AS slope_units
        FROM (SELECT {k}, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(y) AS vy, count(*) * count(*) * var_pop(x) < 1e-12 AS flat, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, min(t) AS start_time, max(t) AS end_time
        FROM (SELECT *, {_elapsed_sql('t0', 't', unit)} AS x FROM (SELECT {k}, datetime AS t, conc AS y, min(datetime) OVER (PARTITION BY {k}) AS t0 FROM ({_SOURCES[table]}) WHERE flag = 'valid' AND conc IS NOT NULL)) GROUP BY {k}) WHERE n >= 3""",
    )(run)


_trend("trend_hour", "events", "hour")
_trend("trend_day", "orders", "day")
_trend("trend_calendar_month", "orders", "calendar_month")
_trend("trend_calendar_year", "orders", "calendar_year")
_trend("trend_by_group", "orders", "day", ("pollutant", "status"))

# -- time
query("time_bounds", 'SELECT min(ts) AS "start", max(ts) AS "end" FROM events')(lambda s, d: timeops.bounds_frame(source(s, d, "events")))


def _resample(name: str, rule: str, width: int, keys: tuple[str, ...] = ()) -> None:
    k, kp = "".join(f"{x}, " for x in keys), f"PARTITION BY {', '.join(keys)}" if keys else ""
    using = ", ".join([*keys, "bin"])
    query(
        name,
        f"""WITH b AS (SELECT {k}conc, date_trunc('day', min(datetime) OVER ({kp}))::TIMESTAMP AS origin, datetime FROM ({EVENTS})),
        i AS (SELECT *, floor(date_diff('second', origin, datetime) / {width}.0)::BIGINT AS bin FROM b),
        s AS (SELECT {k}any_value(origin) AS origin, unnest(generate_series(min(bin), max(bin))) AS bin FROM i {'GROUP BY ' + ', '.join(keys) if keys else ''}),
        m AS (SELECT {k}bin, avg(conc) AS conc FROM i GROUP BY {k}bin)
        SELECT {k}origin + to_seconds(bin * {width}) AS datetime, round(conc, 6) AS conc FROM s LEFT JOIN m USING ({using})""",
    )(lambda s, d: _rounded(timeops.resample_mean(source(s, d, "events"), rule, columns=["conc"], keys=list(keys)), "conc"))


_resample("resample_1h", "1h", 3600)
_resample("resample_gaps", "1min", 60)
_resample("resample_7h", "7h", 25200)
_resample("resample_by_category", "1D", 86400, ("pollutant",))


def _rolling(name: str, window: int, keys: tuple[str, ...] = ()) -> None:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    query(
        name,
        f"SELECT event_id, round(avg(conc) OVER ({part}ORDER BY datetime, event_id ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING), 6) AS conc FROM ({EVENTS})",
    )(lambda s, d: _rounded(timeops.rolling_window_mean(source(s, d, "events"), window, columns=["conc"], keys=list(keys), tiebreak=["event_id"]), "conc").select("event_id", "conc"))


_rolling("rolling_3", 3)
_rolling("rolling_even", 4)
_rolling("rolling_by_site", 5, ("site_id",))

# -- units
query("convert_units", "SELECT event_id, round(value * 0.001, 9) AS conc FROM events")(
    lambda s, d: _rounded(source(s, d, "events").select("event_id", units.convert_values(F.col("conc"), "ug/m3", "mg/m3").alias("conc")), "conc", digits=9)
)
query("round_reporting", "SELECT event_id, round_even(value, 1) AS conc FROM events")(
    lambda s, d: source(s, d, "events").select("event_id", units.round_for_reporting(F.col("conc"), "ug/m3").alias("conc"))
)
_FIRST = "TIMESTAMP '1992-02-10 00:00:00'"
query(
    "elapsed_time",
    "SELECT o_orderkey, " + ", ".join(f"round({_elapsed_sql(_FIRST, 'o_orderdate', u.value)}, 6) AS in_{u.value}" for u in units.TimeUnit) + " FROM orders",
)(
    lambda s, d: source(s, d, "orders").select("o_orderkey", *(F.round(units.elapsed(F.expr("TIMESTAMP_NTZ '1992-02-10 00:00:00'"), F.col("datetime"), u), 6).alias(f"in_{u.value}") for u in units.TimeUnit))
)
query("row_count", "SELECT count(*) AS row_count FROM events")(lambda s, d: source(s, d, "events").agg(F.count(F.lit(1)).alias("row_count")))
