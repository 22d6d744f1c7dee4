"""Cleaning and preparation."""

from pyspark.sql import functions as F

from ..operators import cleaning as K
from .family_e import W, roll
from .inputs import BARS, bars, table
from .registry import query

GAPS = BARS + ",\ngp AS (SELECT symbol, ts, CASE WHEN volume % 7 <> 0 THEN close END AS close, CASE WHEN volume % 5 <> 0 THEN open END AS open FROM bars)"


def gaps(spark, d):
    b = bars(spark, d)
    return b.select("symbol", "ts", F.when(F.col("volume") % 7 != 0, F.col("close")).alias("close"), F.when(F.col("volume") % 5 != 0, F.col("open")).alias("open"))


def ffill(c):
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("b01_fill_forward", "symbol ts! close:8 open:8", GAPS + f", result AS (SELECT symbol, ts, {ffill('close')} AS close, {ffill('open')} AS open FROM gp)")
def b01(spark, d):
    return K.fill_forward(gaps(spark, d), ["close", "open"])


INTER = GAPS + f""",
g2 AS (SELECT symbol, ts, close, last_value(close IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt,
  first_value(close IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS nt FROM gp
  WINDOW p AS ({W} ROWS UNBOUNDED PRECEDING), n AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("b02_interpolate", "symbol ts! close:7", INTER + """, result AS (
  SELECT symbol, ts, ln(coalesce(close, pv + (nv - pv) * (ts - pt)::DOUBLE / (nt - pt)::DOUBLE, pv, nv)) AS close FROM g2)""")
def b02(spark, d):
    return K.interpolate(gaps(spark, d), "close").withColumn("close", F.log("close"))


@query("b03_drop_missing", "symbol ts! close:8 open:8", GAPS + ", result AS (SELECT * FROM gp WHERE close IS NOT NULL AND open IS NOT NULL)")
def b03(spark, d):
    return K.drop_missing(gaps(spark, d))


OUT = f"""o1 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM src),
o2 AS (SELECT symbol, avg(r) - 3 * stddev_samp(r) AS a, avg(r) + 3 * stddev_samp(r) AS b, max(r) AS hi, min(r) AS lo, arg_min(close, ts) AS c0 FROM o1 GROUP BY symbol),
o3 AS (SELECT o1.*, c0, hi > b OR lo < a AS anyout, sum(CASE WHEN r IS NOT NULL THEN ln(1 + least(greatest(r, a), b)) END) OVER ({W}) AS g FROM o1 JOIN o2 USING (symbol)),
clipped AS (SELECT * EXCLUDE (close), CASE WHEN anyout AND r IS NOT NULL THEN c0 * exp(g) ELSE close END AS close FROM o3)"""


@query("b04_clip_outliers", "symbol ts! close:6", BARS + f", src AS (SELECT * FROM bars), {OUT}, result AS (SELECT symbol, ts, ln(close) AS close FROM clipped)")
def b04(spark, d):
    return K.clip_outliers(bars(spark, d), 3.0).withColumn("close", F.log("close"))


@query("b05_validate", "symbol ts! open:8 high:8 low:8 close:8 volume:2", BARS + """,
x AS (SELECT symbol, ts, open - 2000 AS open, CASE WHEN volume % 2 = 0 THEN low ELSE high END AS high, CASE WHEN volume % 2 = 0 THEN high ELSE low END AS low, close, volume - 20 AS volume FROM bars),
result AS (SELECT symbol, ts, greatest(open, 0) AS open, greatest(high, low, 0) AS high, greatest(least(high, low), 0) AS low, close, greatest(volume, 0) AS volume FROM x)""")
def b05(spark, d):
    even = F.col("volume") % 2 == 0
    b = bars(spark, d).select("symbol", "ts", (F.col("open") - 2000).alias("open"), F.when(even, F.col("low")).otherwise(F.col("high")).alias("high"),
                              F.when(even, F.col("high")).otherwise(F.col("low")).alias("low"), "close", (F.col("volume") - 20).alias("volume"))
    return K.validate(b)


@query("b06_preprocess", "symbol ts! open:8 high:8 low:8 close:6 volume:2", BARS + f""",
gp AS (SELECT * REPLACE (CASE WHEN volume % 7 <> 0 THEN close END AS close, CASE WHEN volume % 5 <> 0 THEN open END AS open) FROM bars),
src AS (SELECT * REPLACE ({ffill('close')} AS close, {ffill('open')} AS open) FROM gp), {OUT}, result AS (SELECT * REPLACE (ln(close) AS close) FROM clipped)""")
def b06(spark, d):
    b = bars(spark, d).withColumns({"close": F.when(F.col("volume") % 7 != 0, F.col("close")), "open": F.when(F.col("volume") % 5 != 0, F.col("open"))})
    return K.preprocess(b, k=3.0).withColumn("close", F.log("close"))


@query("b07_adjust_splits", "symbol ts! close:10 volume:2", BARS + """,
sp AS (SELECT DISTINCT p_brand AS symbol, DATE '1997-06-01' AS date, 2.0 AS ratio FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT DISTINCT p_brand, DATE '1999-06-01', 4.0 FROM part UNION ALL SELECT DISTINCT p_brand, DATE '2000-01-01', 0.0 FROM part),
f AS (SELECT symbol, ts, close, volume, product(ratio) AS f FROM (SELECT b.*, s.ratio FROM bars b LEFT JOIN sp s ON b.symbol = s.symbol AND b.ts < s.date AND s.ratio NOT IN (0, 1)) GROUP BY ALL),
result AS (SELECT symbol, ts, close / coalesce(f, 1) AS close, volume * coalesce(f, 1) AS volume FROM f)""")
def b07(spark, d):
    p = table(spark, d, "part")
    one = lambda f, day, r: f.select(F.col("p_brand").alias("symbol"), F.lit(day).cast("date").alias("date"), F.lit(r).alias("ratio")).distinct()
    s = one(p.where("p_size % 2 = 0"), "1997-06-01", 2.0).unionByName(one(p, "1999-06-01", 4.0)).unionByName(one(p, "2000-01-01", 0.0))
    return K.adjust_splits(bars(spark, d), s)


@query("b08_quality_report", "symbol completeness:6 missing_pct:6 coverage_days# median_gap:2 rows#", GAPS + f""",
g AS (SELECT *, datediff('day', lag(ts) OVER ({W}), ts) AS gap FROM gp),
result AS (SELECT symbol, (count(close) + count(open)) / (2.0 * count(*)) * 100 AS completeness, 100 - (count(close) + count(open)) / (2.0 * count(*)) * 100 AS missing_pct,
  datediff('day', min(ts), max(ts)) AS coverage_days, quantile_cont(gap, 0.5) AS median_gap, count(*) AS rows FROM g GROUP BY symbol)""")
def b08(spark, d):
    return K.quality_report(gaps(spark, d))


@query("b09_technical_report", "bytes# rows# columns# numeric_columns# bytes_per_row:4")
def b09(spark, d):
    return K.technical_report(bars(spark, d))


@query("b10_training_windows", "symbol ts! x_first:8 x_last:8 x_len# y:8", BARS + f""", r AS (SELECT symbol, ts, lag(close, 30) OVER ({W}) AS x_first, lag(close) OVER ({W}) AS x_last, close AS y FROM bars),
result AS (SELECT *, 30 AS x_len FROM r WHERE x_first IS NOT NULL)""")
def b10(spark, d):
    t = K.training_windows(bars(spark, d), "close", "close", 30)
    return t.withColumns({"x_first": F.element_at("x", 1), "x_last": F.element_at("x", -1), "x_len": F.size("x")})


@query("b11_window_images", "symbol ts! height# width# first:6")
def b11(spark, d):
    i = K.window_images(bars(spark, d))
    return i.withColumns({"height": F.size("image"), "width": F.size(F.element_at("image", 1)), "first": F.element_at(F.element_at("image", 4), 1)})


@query("b12_class_weights", "quality# n# weight:8", """g AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
result AS (SELECT quality, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM g)""")
def b12(spark, d):
    return K.class_weights(table(spark, d, "labels"), "quality")


@query("b13_feature_frame", "symbol ts! ret:8 log_ret:8 vol_5:6 vol_20:6 ratio_5:7 ratio_20:7 volume_ratio:7", BARS + f""",
r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, ln(close / lag(close) OVER ({W})) AS log_ret FROM bars),
result AS (SELECT symbol, ts, ret, log_ret, {roll('stddev_samp(ret)', 5, 'ret')} AS vol_5, {roll('stddev_samp(ret)', 20, 'ret')} AS vol_20,
  close / {roll('avg(close)', 5)} AS ratio_5, close / {roll('avg(close)', 20)} AS ratio_20, volume / {roll('avg(volume)', 20)} AS volume_ratio FROM r)""")
def b13(spark, d):
    return K.feature_frame(bars(spark, d))
