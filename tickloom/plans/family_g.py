"""Formula operators and the alpha library."""

from pyspark.sql import functions as F

from ..core.slices import over_rows
from ..functions import formulaic as fx
from ..operators import formulas as G
from ..operators.metrics import simple_return
from .inputs import BARS, bars
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"


def rank_sql(src: str, x: str, out: str) -> str:
    return f"""SELECT *, (rank() OVER (PARTITION BY ts ORDER BY {x}) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0)
  / count({x}) OVER (PARTITION BY ts) AS {out} FROM {src} WHERE {x} IS NOT NULL
  UNION ALL BY NAME SELECT *, NULL AS {out} FROM {src} WHERE {x} IS NULL"""


def ts_rank_sql(src: str, x: str, n: int, out: str) -> str:
    return f"""SELECT * EXCLUDE (l), CASE WHEN {x} IS NULL THEN NULL WHEN len(l) > 1 THEN (len(list_filter(l, lambda v: v < {x}))
  + (len(list_filter(l, lambda v: v = {x})) + 1) / 2 - 1) / (len(l) - 1) ELSE 0.5 END AS {out}
  FROM (SELECT *, list({x}) FILTER ({x} IS NOT NULL) OVER ({W} ROWS {n - 1} PRECEDING) AS l FROM {src})"""


@query("g01_rank", "symbol ts! r:8", BARS + """, b AS MATERIALIZED (SELECT symbol, ts, volume FROM bars), n AS MATERIALIZED (SELECT ts, volume, count(*) AS n FROM b WHERE volume IS NOT NULL GROUP BY 1, 2),
k AS MATERIALIZED (SELECT ts, volume, (sum(n) OVER (PARTITION BY ts ORDER BY volume) - (n - 1) / 2.0) / sum(n) OVER (PARTITION BY ts) AS r FROM n),
result AS (SELECT symbol, b.ts, r FROM b LEFT JOIN k ON b.ts = k.ts AND b.volume = k.volume)""")
def g01(spark, d):
    return G.rank(bars(spark, d), "volume", "r")


@query("g02_delay_delta", "symbol ts! delay_3:8 delta_5:8", BARS + f""", result AS (
  SELECT symbol, ts, lag(close, 3) OVER ({W}) AS delay_3, close - lag(close, 5) OVER ({W}) AS delta_5 FROM bars)""")
def g02(spark, d):
    return over_rows(bars(spark, d), lambda f, w: f.withColumns({"delay_3": fx.delay("close", 3, w), "delta_5": fx.delta("close", 5, w)}), back=5)


@query("g03_ts_statistics", "symbol ts! m:7 s:7 hi:8 lo:8 t:7", BARS + f""", result AS (
  SELECT symbol, ts, avg(close) OVER f AS m, stddev_samp(close) OVER f AS s, max(close) OVER f AS hi, min(close) OVER f AS lo, sum(close) OVER f AS t
  FROM (SELECT symbol, ts, ln(close) AS close FROM bars) WINDOW f AS ({W} ROWS 9 PRECEDING))""")
def g03(spark, d):
    f = lambda x, w: x.withColumns({"m": fx.ts_mean("close", 10, w), "s": fx.ts_std("close", 10, w), "hi": fx.ts_max("close", 10, w),
                                    "lo": fx.ts_min("close", 10, w), "t": fx.ts_sum("close", 10, w)})
    return over_rows(bars(spark, d).withColumn("close", F.log("close")), f, back=10)


@query("g04_ts_rank", "symbol ts! r:8", BARS + f", result AS ({ts_rank_sql('bars', 'close', 10, 'r')})")
def g04(spark, d):
    return over_rows(bars(spark, d), lambda x, w: x.withColumn("r", fx.ts_rank("close", 10, w)), back=10)


@query("g05_correlation_covariance", "symbol ts! c:6 v:6", BARS + f""", result AS (
  SELECT symbol, ts, corr(close, volume) OVER f AS c, covar_samp(close, volume) OVER f AS v FROM (SELECT symbol, ts, ln(close) AS close, volume FROM bars) WINDOW f AS ({W} ROWS 9 PRECEDING)
  QUALIFY row_number() OVER ({W}) >= 10)""")
def g05(spark, d):
    f = lambda x, w: x.withColumns({"c": fx.correlation("close", "volume", 10, w), "v": fx.covariance("close", "volume", 10, w), "rn": fx.delay("close", 9, w)})
    return over_rows(bars(spark, d).withColumn("close", F.log("close")), f, back=10).where("rn is not null")


@query("g06_scalar_functions", "symbol ts! a:8 l:8 s:1 p:2", BARS + """, result AS (
  SELECT symbol, ts, abs(open - close) AS a, ln(volume + 1e-8) AS l, sign(close - open) AS s, pow(volume, 1.5) AS p FROM bars)""")
def g06(spark, d):
    c = F.col("close") - F.col("open")
    return bars(spark, d).withColumns({"a": fx.absolute(c), "l": fx.log("volume"), "s": fx.sign(c), "p": fx.power("volume", 1.5)})


@query("g07_scale", "symbol ts! w:8", BARS + ", result AS (SELECT symbol, ts, volume / sum(abs(volume)) OVER (PARTITION BY ts) AS w FROM bars)")
def g07(spark, d):
    return G.scale(bars(spark, d), "volume", "w")


@query("g08_arithmetic", "symbol ts! q:6 lt:1 gt:1 le:1", BARS + """, result AS (SELECT symbol, ts, close / (open + 1e-8) AS q,
  CASE WHEN close < open THEN 1.0 ELSE 0.0 END AS lt, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS gt,
  CASE WHEN close <= open THEN 1.0 ELSE 0.0 END AS le FROM bars)""")
def g08(spark, d):
    return bars(spark, d).withColumns({"q": fx.divide("close", "open"), "lt": fx.less("close", "open"), "gt": fx.greater("close", "open"),
                                       "le": fx.less_equal("close", "open")})


def _one(name):
    def run(spark, d):
        out = G.ALPHAS[name](bars(spark, d))
        # in units of the close, so that rounding never meets an exact decimal tie
        return out.withColumn(name, F.col(name) / F.col("close")) if name == "alpha009" else out
    return run


SQL = {
    "alpha001": f"t AS ({ts_rank_sql('(SELECT *, ln(volume + 1e-8) AS x FROM bars)', 'x', 10, 'y')}), result AS ({rank_sql('t', 'y', 'alpha001')})",
    "alpha002": f"""t AS (SELECT symbol, ts, ln(volume + 1e-8) - ln(lag(volume, 2) OVER ({W}) + 1e-8) AS a, ln(close + 1e-8) - ln(lag(close, 2) OVER ({W}) + 1e-8) AS b FROM bars),
result AS (SELECT symbol, ts, a / (b + 1e-8) AS alpha002 FROM t)""",
    "alpha004": f"t AS ({rank_sql('bars', 'low', 'r')}), result AS ({ts_rank_sql('t', 'r', 9, 'alpha004')})",
    "alpha005": f"t AS (SELECT *, close / (avg(volume) OVER ({W} ROWS 9 PRECEDING) + 1e-8) AS x FROM bars), result AS ({rank_sql('t', 'x', 'alpha005')})",
    "alpha006": f"""t AS (SELECT symbol, ts, corr(open, volume) OVER ({W} ROWS 9 PRECEDING) AS alpha006, row_number() OVER ({W}) AS rn FROM bars),
result AS (SELECT symbol, ts, CASE WHEN rn > 1 AND NOT isnan(alpha006) THEN alpha006 END AS alpha006 FROM t)""",
    "alpha007": f"""t AS (SELECT *, close - lag(close, 7) OVER ({W}) AS x, abs(x) AS a FROM bars), r AS ({rank_sql('t', 'a', 'r')}),
result AS (SELECT symbol, ts, r * sign(x) AS alpha007 FROM r)""",
    "alpha009": f"""t AS (SELECT *, avg(close) OVER ({W} ROWS 9 PRECEDING) AS m FROM bars),
result AS (SELECT symbol, ts, (m - lag(m) OVER ({W})) / close AS alpha009 FROM t)""",
    "alpha010": f"""t AS (SELECT *, close - lag(close) OVER ({W}) AS x, abs(x) AS a FROM bars), r AS ({rank_sql('t', 'a', 'r')}),
result AS (SELECT symbol, ts, r * sign(x) AS alpha010 FROM r)""",
}
# 003 and 008 rank rolling results whose ties depend on the last bits: rows are checked, values in unit tests
for _n in G.ALPHAS:
    query(f"g09_{_n}", f"symbol ts! {_n}:{4 if _n in ('alpha002',) else 6}", BARS + ",\n" + SQL[_n] if _n in SQL else None)(_one(_n))


def monthly(b, names):
    return b.groupBy(F.to_date(F.date_trunc("month", "ts")).alias("ts")).pivot("symbol", names).agg(F.max("close"))


@query("g10_wide_to_long", "ts! symbol value:8", BARS + """,
m AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS ts, max(close) AS value FROM bars GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT ts FROM m) CROSS JOIN (SELECT DISTINCT symbol FROM m)),
result AS (SELECT ts, symbol, value FROM g LEFT JOIN m USING (ts, symbol))""")
def g10(spark, d):
    b = bars(spark, d)
    return G.wide_to_long(monthly(b, sorted(r[0] for r in b.select("symbol").distinct().collect())))


@query("g11_combine_alphas", "symbol ts! combined:6", BARS + f""",
t AS (SELECT symbol, ts, close / lag(close) OVER ({W}) - 1 AS a, close / open - 1 AS b FROM bars),
result AS (SELECT symbol, ts, a * 0.7 + b * 0.3 AS combined FROM t)""")
def g11(spark, d):
    b = simple_return(bars(spark, d), out="a").withColumn("b", F.col("close") / F.col("open") - 1)
    return G.combine(b, {"a": 0.7, "b": 0.3})


@query("g12_neutralize", "symbol ts! resid:6", BARS + f""",
t AS (SELECT symbol, ts, close / open - 1 AS y, ln(volume) AS x FROM bars),
g AS (SELECT ts, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM t GROUP BY ts),
result AS (SELECT symbol, ts, CASE WHEN n > 1 THEN y - my - CASE WHEN v > 1e-12 THEN c / v ELSE 0 END * (x - mx) END AS resid FROM t JOIN g USING (ts))""")
def g12(spark, d):
    b = bars(spark, d).withColumns({"y": F.col("close") / F.col("open") - 1, "x": F.log("volume")})
    return G.neutralize(b, "y", "x", "resid")
