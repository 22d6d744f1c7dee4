"""Technical indicators."""

from ..operators import indicators as I
from .inputs import BARS, bars
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"


def ema_sql(src: str, value: str, n: int, name: str) -> str:
    """An exponential mean in plain SQL: weighted sum over the last 600 rows."""
    a = 2.0 / (n + 1)
    return f"""{name} AS (SELECT x.symbol, x.ts, sum(y.{value} * pow({1 - a!r}, x.rn - y.rn) * CASE WHEN y.rn = 1 THEN 1.0 ELSE {a!r} END) AS {name}
  FROM (SELECT *, row_number() OVER ({W}) AS rn FROM {src}) x JOIN (SELECT *, row_number() OVER ({W}) AS rn FROM {src}) y
  ON x.symbol = y.symbol AND y.rn <= x.rn AND y.rn > x.rn - 600 GROUP BY x.symbol, x.ts)"""


def roll(e: str, n: int, src: str | None = None) -> str:
    """A full-window aggregate: null until n rows."""
    f = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    cnt = f"count({src})" if src else "count(*)"
    return f"CASE WHEN {cnt} {f} >= {n} THEN {e} {f} END"


SMA = ", ".join(f"{roll('avg(close)', n)} AS sma_{n}" for n in (20, 50, 200))


@query("e01_sma", "symbol ts! sma_20:4 sma_50:4 sma_200:4", BARS + f", result AS (SELECT symbol, ts, {SMA} FROM bars)")
def e01(spark, d):
    return I.sma(bars(spark, d))


EMAS = BARS + ",\n" + ema_sql("bars", "close", 12, "ema_12") + ",\n" + ema_sql("bars", "close", 26, "ema_26")


@query("e02_ema", "symbol ts! ema_12:4 ema_26:4", EMAS + ", result AS (SELECT * FROM ema_12 JOIN ema_26 USING (symbol, ts))")
def e02(spark, d):
    return I.ema(bars(spark, d))


BB = f"""b0 AS (SELECT symbol, ts, close, {roll('avg(close)', 20)} AS bb_middle, {roll('stddev_samp(close)', 20)} AS s FROM bars),
bb AS (SELECT *, bb_middle + 2 * s AS bb_upper, bb_middle - 2 * s AS bb_lower, 4 * s / bb_middle AS bb_width,
  (close - (bb_middle - 2 * s)) / (4 * s) AS bb_position FROM b0)"""


@query("e03_bollinger", "symbol ts! bb_middle:4 bb_upper:4 bb_lower:4 bb_width:6 bb_position:6", BARS + f",\n{BB}, result AS (SELECT * FROM bb)")
def e03(spark, d):
    return I.bollinger(bars(spark, d))


@query("e04_sar", "symbol ts! sar:8", BARS + f""", result AS (SELECT symbol, ts,
  coalesce(min(low) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low) AS sar FROM bars)""")
def e04(spark, d):
    return I.sar(bars(spark, d))


RSI = f"""r0 AS (SELECT symbol, ts, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
r1 AS (SELECT symbol, ts, {roll('avg(greatest(d, 0))', 14)} AS g, {roll('avg(greatest(-d, 0))', 14)} AS l FROM r0),
rsi AS (SELECT symbol, ts, 100 - 100 / (1 + g / (l + 1e-10)) AS rsi FROM r1)"""


@query("e05_rsi", "symbol ts! rsi:5", BARS + f",\n{RSI}, result AS (SELECT * FROM rsi)")
def e05(spark, d):
    return I.rsi(bars(spark, d))


MACD = (EMAS + """,
m0 AS (SELECT symbol, ts, ema_12, ema_26, ema_12 - ema_26 AS macd FROM ema_12 JOIN ema_26 USING (symbol, ts)),
""" + ema_sql("m0", "macd", 9, "macd_signal") + ",\nmacd AS (SELECT *, macd - macd_signal AS macd_hist FROM m0 JOIN macd_signal USING (symbol, ts))")


@query("e06_macd", "symbol ts! macd:4 macd_signal:4 macd_hist:4", MACD + ", result AS (SELECT * FROM macd)")
def e06(spark, d):
    return I.macd(bars(spark, d))


STOCH = f"""s0 AS (SELECT symbol, ts, 100 * (close - {roll('min(low)', 14)}) / ({roll('max(high)', 14)} - {roll('min(low)', 14)} + 1e-10) AS stoch_k FROM bars),
stoch AS (SELECT *, {roll('avg(stoch_k)', 3, 'stoch_k')} AS stoch_d FROM s0)"""


@query("e07_stochastic", "symbol ts! stoch_k:5 stoch_d:5", BARS + f",\n{STOCH}, result AS (SELECT * FROM stoch)")
def e07(spark, d):
    return I.stochastic(bars(spark, d))


TR = f"""t0 AS (SELECT *, lag(close) OVER ({W}) AS pc, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM bars),
t1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS md FROM t0)"""
ADX = f"""a0 AS (SELECT symbol, ts, {roll('avg(tr)', 14)} AS a, {roll('avg(pd)', 14)} AS p, {roll('avg(md)', 14)} AS m FROM t1),
a1 AS (SELECT symbol, ts, 100 * p / (a + 1e-10) AS plus_di, 100 * m / (a + 1e-10) AS minus_di FROM a0),
a2 AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM a1),
adx AS (SELECT *, {roll('avg(dx)', 14, 'dx')} AS adx FROM a2)"""


@query("e08_adx", "symbol ts! adx:5 plus_di:5 minus_di:5", BARS + f",\n{TR},\n{ADX}, result AS (SELECT * FROM adx)")
def e08(spark, d):
    return I.adx(bars(spark, d))


CCI = f"""c0 AS (SELECT symbol, ts, (high + low + close) / 3 AS tp, row_number() OVER ({W}) AS rn FROM bars),
c1 AS (SELECT *, {roll('avg(tp)', 14)} AS m FROM c0),
c2 AS (SELECT x.symbol, x.ts, avg(abs(y.tp - x.m)) AS mad FROM c1 x JOIN c0 y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - 13 AND x.rn GROUP BY 1, 2),
cci AS (SELECT symbol, ts, (tp - m) / (0.015 * mad + 1e-10) AS cci FROM c1 JOIN c2 USING (symbol, ts))"""


@query("e09_cci", "symbol ts! cci:5", BARS + f",\n{CCI}, result AS (SELECT * FROM cci)")
def e09(spark, d):
    return I.cci(bars(spark, d))


MFI = f"""f0 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
f1 AS (SELECT *, tp - lag(tp) OVER ({W}) AS dt FROM f0),
f2 AS (SELECT *, CASE WHEN dt > 0 THEN tp * volume ELSE 0 END AS pf, CASE WHEN dt < 0 THEN tp * volume ELSE 0 END AS nf FROM f1),
mfi AS (SELECT symbol, ts, 100 - 100 / (1 + {roll('sum(pf)', 14)} / ({roll('sum(nf)', 14)} + 1e-10)) AS mfi FROM f2)"""


@query("e10_mfi", "symbol ts! mfi:5", BARS + f",\n{MFI}, result AS (SELECT * FROM mfi)")
def e10(spark, d):
    return I.mfi(bars(spark, d))


OBV = f"""o0 AS (SELECT symbol, ts, coalesce(sign(close - lag(close) OVER ({W})), 0) * volume AS v FROM bars),
obv AS (SELECT symbol, ts, sum(v) OVER ({W}) AS obv FROM o0)"""


@query("e11_obv", "symbol ts! obv:2", BARS + f",\n{OBV}, result AS (SELECT * FROM obv)")
def e11(spark, d):
    return I.obv(bars(spark, d))


AD = f"ad AS (SELECT symbol, ts, sum(((close - low) - (high - close)) / (high - low + 1e-10) * volume) OVER ({W}) AS ad FROM bars)"


@query("e12_accumulation", "symbol ts! ad:5", BARS + f",\n{AD}, result AS (SELECT * FROM ad)")
def e12(spark, d):
    return I.accumulation(bars(spark, d))


ADO = (AD + ",\n" + ema_sql("ad", "ad", 3, "e3") + ",\n" + ema_sql("ad", "ad", 10, "e10")
       + ",\nado AS (SELECT symbol, ts, e3 - e10 AS adosc FROM e3 JOIN e10 USING (symbol, ts))")


@query("e13_ad_oscillator", "symbol ts! adosc:5", BARS + f",\n{ADO}, result AS (SELECT * FROM ado)")
def e13(spark, d):
    return I.ad_oscillator(bars(spark, d))


ATR = f"atr AS (SELECT symbol, ts, tr, {roll('avg(tr)', 14)} AS atr, {roll('avg(tr)', 14)} / close * 100 AS natr FROM t1)"


@query("e14_atr", "symbol ts! tr:8 atr:4 natr:4", BARS + f",\n{TR},\n{ATR}, result AS (SELECT * FROM atr)")
def e14(spark, d):
    return I.atr(bars(spark, d))


ALL = "sma_20:4 sma_200:4 ema_12:4 ema_26:4 bb_upper:4 bb_lower:4 rsi:5 macd_hist:4 stoch_k:5 stoch_d:5 adx:5 cci:5 mfi:5 obv:2 ad:5 adosc:5 atr:4 natr:4"


@query("e15_all_indicators", "symbol ts! " + ALL, MACD + f""",
sm AS (SELECT symbol, ts, {SMA} FROM bars), {BB}, {RSI}, {STOCH}, {TR}, {ADX}, {CCI}, {MFI}, {OBV}, {ADO}, {ATR},
result AS (SELECT * FROM sm JOIN bb USING (symbol, ts) JOIN rsi USING (symbol, ts) JOIN macd USING (symbol, ts) JOIN stoch USING (symbol, ts)
  JOIN adx USING (symbol, ts) JOIN cci USING (symbol, ts) JOIN mfi USING (symbol, ts) JOIN obv USING (symbol, ts) JOIN ad USING (symbol, ts)
  JOIN ado USING (symbol, ts) JOIN atr USING (symbol, ts))""")
def e15(spark, d):
    return I.compute_all(bars(spark, d))


@query("e16_ml_features", "symbol ts! rsi:5 macd:4 bb_pct:6 atr:4 volume_sma_20:4 volume_ratio:6 return_1d:8 return_5d:8 return_10d:8 return_21d:8",
       MACD + f""",
{BB}, r0 AS (SELECT symbol, ts, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
r1 AS (SELECT symbol, ts, {roll('avg(greatest(d, 0))', 14)} AS g, {roll('avg(greatest(-d, 0))', 14)} AS l FROM r0),
rsi AS (SELECT symbol, ts, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE 100 - 100 / (1 + g / l) END AS rsi FROM r1),
{TR}, {ATR},
vr AS (SELECT symbol, ts, {roll('avg(volume)', 20)} AS volume_sma_20, volume / {roll('avg(volume)', 20)} AS volume_ratio,
  """ + ", ".join(f"close / lag(close, {n}) OVER ({W}) - 1 AS return_{n}d" for n in (1, 5, 10, 21)) + """ FROM bars),
result AS (SELECT *, bb_position AS bb_pct FROM bb JOIN rsi USING (symbol, ts) JOIN macd USING (symbol, ts) JOIN atr USING (symbol, ts) JOIN vr USING (symbol, ts))""")
def e16(spark, d):
    return I.ml_features(bars(spark, d))
