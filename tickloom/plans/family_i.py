"""Series filters."""

from pyspark.sql import functions as F

from ..operators import filters as X
from .family_j import PAIR, pairs
from .inputs import BARS, RETURNS, bars, returns
from .registry import query


def logs(spark, d):
    return bars(spark, d).select("symbol", "ts", F.log("close").alias("z"))


def level(name: str, q: str) -> str:
    """A random-walk filter of ``n`` as a recursive table: level x, its variance p, smoothing factor c."""
    return f"""{name} AS (SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS x, 1.0::DOUBLE AS p, 0.0::DOUBLE AS c FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL
  SELECT n.symbol, n.i, f.x + (f.p + {q}) / (f.p + {q} + 1e-2) * (n.z - f.x), (1 - (f.p + {q}) / (f.p + {q} + 1e-2)) * (f.p + {q}),
    (1 - (f.p + {q}) / (f.p + {q} + 1e-2)) * (f.p + {q}) / ((1 - (f.p + {q}) / (f.p + {q} + 1e-2)) * (f.p + {q}) + {q})
  FROM {name} f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)"""


NUMBERED = "RECURSIVE " + BARS + """,
n AS MATERIALIZED (SELECT symbol, ts, ln(close) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM bars)"""


@query("i01_kalman_level", "symbol ts! level:6", NUMBERED + ", " + level("f", "1e-5") + """,
result AS (SELECT symbol, ts, x AS level FROM f JOIN n USING (symbol, i))""")
def i01(spark, d):
    return X.kalman_level(logs(spark, d), "z")


@query("i02_kalman_smooth", "symbol ts! trend:6", NUMBERED + ", " + level("f", "1e-5") + """,
g AS MATERIALIZED (SELECT symbol, i, x, c, n.ts, n.m FROM f JOIN n USING (symbol, i)),
b AS (SELECT symbol, i, x AS trend FROM g WHERE i = m UNION ALL SELECT g.symbol, g.i, (1 - g.c) * g.x + g.c * b.trend FROM b JOIN g ON g.symbol = b.symbol AND g.i = b.i - 1),
result AS (SELECT symbol, g.ts, trend FROM b JOIN g USING (symbol, i))""")
def i02(spark, d):
    return X.kalman_smooth(logs(spark, d), "z")


@query("i03_kalman_crossover", "symbol ts! fast:6 slow:6 signal:1", NUMBERED + ", " + level("f", "1e-4") + ", " + level("s", "1e-6") + """,
result AS (SELECT symbol, ts, f.x AS fast, s.x AS slow, sign(f.x - s.x) AS signal FROM f JOIN s USING (symbol, i) JOIN n USING (symbol, i))""")
def i03(spark, d):
    return X.kalman_crossover(logs(spark, d), "z")


@query("i04_dynamic_hedge", "pair ts! hedge:6 intercept:6 error:6", "RECURSIVE " + PAIR + """,
n AS MATERIALIZED (SELECT pair, ts, ln(close_a) AS y, ln(close_b) AS x, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM pairs),
f AS (SELECT pair, 0::BIGINT AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS e FROM (SELECT DISTINCT pair FROM n)
  UNION ALL
  SELECT pair, i, b0 + k0 * e, b1 + k1 * e, q00 - k0 * h0, q01 - k0 * h1, q11 - k1 * h1, e FROM (
    SELECT *, h0 / s AS k0, h1 / s AS k1, y - x * b0 - b1 AS e FROM (
      SELECT *, x * q00 + q01 AS h0, x * q01 + q11 AS h1, x * (x * q00 + q01) + x * q01 + q11 + 1e-3 AS s FROM (
        SELECT n.pair, n.i, n.x, n.y, f.b0, f.b1, f.p00 + 1e-5 / (1 - 1e-5) AS q00, f.p01 AS q01, f.p11 + 1e-5 / (1 - 1e-5) AS q11
        FROM f JOIN n ON n.pair = f.pair AND n.i = f.i + 1)))),
result AS (SELECT pair, ts, b0 AS hedge, b1 AS intercept, e AS error FROM f JOIN n USING (pair, i))""")
def i04(spark, d):
    return X.dynamic_hedge(pairs(spark, d))


@query("i05_adaptive_kalman", "symbol ts! level:6 noise:6")
def i05(spark, d):
    return X.adaptive_kalman(logs(spark, d), "z")


@query("i06_wavelet_components", "symbol ts! trend:6 detail_1:6 detail_2:6 detail_3:6")
def i06(spark, d):
    return X.wavelet_components(logs(spark, d), "z")


@query("i07_wavelet_denoise", "symbol ts! denoised:6")
def i07(spark, d):
    return X.wavelet_denoise(logs(spark, d), "z")


@query("i07_adaptive_denoise", "symbol ts! denoised:6")
def i07b(spark, d):
    return X.wavelet_denoise(logs(spark, d), "z", adaptive=True)


@query("i08_wavelet_variance", "symbol component variance:6 share:5")
def i08(spark, d):
    return X.wavelet_variance(logs(spark, d), "z")


LAM = "0.9659363289248456"


@query("i09_ewm_volatility", "symbol ts! volatility:6 low:6 high:6", RETURNS + f""",
x AS (SELECT symbol, ts, ln(1 + ret) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM rets),
s AS (SELECT a.symbol, a.ts, sum(pow({LAM}, a.rn - b.rn)) AS w, sum(pow({LAM}, 2 * (a.rn - b.rn))) AS w2, sum(pow({LAM}, a.rn - b.rn) * b.r) / sum(pow({LAM}, a.rn - b.rn)) AS m,
  sum(pow({LAM}, a.rn - b.rn) * b.r * b.r) / sum(pow({LAM}, a.rn - b.rn)) AS q FROM x a JOIN x b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.rn > a.rn - 1200 GROUP BY 1, 2),
v AS (SELECT symbol, ts, sqrt((q - m * m) * w * w / CASE WHEN w * w - w2 > 1e-12 THEN w * w - w2 END) AS sd FROM s),
result AS (SELECT symbol, ts, coalesce(sd, lead(sd) OVER (PARTITION BY symbol ORDER BY ts)) AS volatility, volatility * 0.8 AS low, volatility * 1.2 AS high FROM v)""")
def i09(spark, d):
    return X.ewm_volatility(returns(spark, d).withColumn("ret", F.log1p("ret")))
