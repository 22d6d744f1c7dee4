"""Alpha factors."""

from pyspark.sql import functions as F

from ..operators import factors as A
from .family_e import W, roll
from .inputs import BARS, bars, table
from .registry import query

FUND = BARS + """,
fund AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, sum(l_extendedprice) AS revenue,
  sum(l_extendedprice * (l_discount - 0.04)) AS net_income, sum(l_quantity) * 1000 AS assets, sum(l_quantity) * 400 AS equity,
  sum(l_quantity * l_tax) * 9000 AS liabilities, avg(l_extendedprice / l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def fundamentals(spark, d):
    """Monthly stand-ins for statements, one row per brand and month."""
    l = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy(
        F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("ts")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("net_income"),
        (F.sum("l_quantity") * 1000).alias("assets"), (F.sum("l_quantity") * 400).alias("equity"),
        (F.sum(F.col("l_quantity") * F.col("l_tax")) * 9000).alias("liabilities"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


MOM = f"""m0 AS (SELECT symbol, ts, close, """ + ", ".join(f"close / lag(close, {n}) OVER ({W}) - 1 AS mom_{n}" for n in (5, 10, 21, 63, 252)) + f""",
  CASE WHEN close / lag(close) OVER ({W}) - 1 > 0 THEN 1.0 WHEN lag(close) OVER ({W}) IS NOT NULL THEN 0.0 END AS up FROM bars),
mom AS (SELECT *, mom_21 / (abs(mom_252) + 1e-8) AS mom_ratio, mom_21 - mom_252 AS mom_diff, mom_21 - lag(mom_21) OVER ({W}) AS mom_accel,
  {roll('avg(up)', 21, 'up')} AS trend_strength FROM m0)"""


@query("f01_momentum_factors", "symbol ts! mom_5:8 mom_10:8 mom_21:8 mom_63:8 mom_252:8 mom_ratio:5 mom_diff:8 mom_accel:8 trend_strength:8",
       BARS + f",\n{MOM}, result AS (SELECT * FROM mom)")
def f01(spark, d):
    return A.momentum(bars(spark, d))


VALUE_SPEC = "symbol ts! pe_ratio:8 earnings_yield:6 pb_ratio:8 book_yield:6 ev_ebitda:6 ps_ratio:8 mcap_revenue:6"


@query("f02_value_factors", VALUE_SPEC, FUND + """, result AS (SELECT symbol, ts, price / (net_income + 1e-8) AS pe_ratio,
  net_income / (price + 1e-8) AS earnings_yield, price / (equity + 1e-8) AS pb_ratio, equity / (price + 1e-8) AS book_yield,
  assets / (revenue + 1e-8) AS ev_ebitda, price / (revenue + 1e-8) AS ps_ratio, assets / (revenue + 1e-8) AS mcap_revenue FROM fund)""")
def f02(spark, d):
    return A.value(prices(spark, d))


def prices(spark, d):
    """Inputs of the value factors."""
    return fundamentals(spark, d).select("symbol", "ts", "price", F.col("net_income").alias("earnings"), F.col("equity").alias("book_value"),
                                         F.col("assets").alias("enterprise_value"), F.col("revenue").alias("ebitda"), "revenue",
                                         F.col("assets").alias("market_cap"))


VOLS = f"""v0 AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS lr, pow(ln(high / low), 2) AS hl,
  0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk FROM bars),
v1 AS (SELECT symbol, ts, """ + ", ".join(f"""{roll('stddev_samp(lr)', n, 'lr')} * sqrt(252) AS realized_vol_{n},
  sqrt({roll('avg(hl)', n)} / (4 * ln(2))) * sqrt(252) AS parkinson_vol_{n}, {roll('avg(gk)', n)} AS g{n}""" for n in (21, 63)) + f""" FROM v0),
vols AS (SELECT *, CASE WHEN g21 >= 0 THEN sqrt(g21) * sqrt(252) END AS gk_vol_21, CASE WHEN g63 >= 0 THEN sqrt(g63) * sqrt(252) END AS gk_vol_63,
  realized_vol_21 / (realized_vol_63 + 1e-8) AS vol_ratio, realized_vol_21 / lag(realized_vol_21) OVER ({W}) - 1 AS vol_trend FROM v1)"""


@query("f03_volatility_factors", "symbol ts! realized_vol_21:6 realized_vol_63:6 parkinson_vol_21:5 parkinson_vol_63:5 gk_vol_63:5 vol_ratio:6 vol_trend:6",
       BARS + f",\n{VOLS}, result AS (SELECT * FROM vols)")
def f03(spark, d):
    return A.volatility(bars(spark, d))


QUALITY_SQL = """SELECT symbol, ts, net_income / (equity + 1e-8) AS roe, net_income / (assets + 1e-8) AS roa, net_income / (revenue + 1e-8) AS profit_margin,
  revenue / (assets + 1e-8) AS asset_turnover, liabilities / (equity + 1e-8) AS debt_to_equity, assets / (equity + 1e-8) AS leverage FROM fund"""


@query("f04_quality_factors", "symbol ts! roe:8 roa:8 profit_margin:8 asset_turnover:6 debt_to_equity:8 leverage:8", FUND + f", result AS ({QUALITY_SQL})")
def f04(spark, d):
    return A.quality(fundamentals(spark, d))


@query("f05_all_factors", "symbol ts! mom_21:8 mom_diff:8 realized_vol_21:6 vol_ratio:6 roe:8 leverage:8", FUND + f",\n{MOM},\n{VOLS}, q AS ({QUALITY_SQL}), " + """
result AS (SELECT * FROM mom FULL JOIN vols USING (symbol, ts) FULL JOIN q USING (symbol, ts))""")
def f05(spark, d):
    return A.all_factors(bars(spark, d), prices(spark, d), fundamentals(spark, d))


@query("f05_all_factors_value", "symbol ts! mom_21:8 realized_vol_21:6 roe:8 leverage:8 pe_ratio:8 earnings_yield:6 pb_ratio:8 book_yield:6 ev_ebitda:6 ps_ratio:8 mcap_revenue:6",
       FUND + f",\n{MOM},\n{VOLS}, q AS ({QUALITY_SQL}), " + """
v AS (SELECT symbol, ts, price / (net_income + 1e-8) AS pe_ratio, net_income / (price + 1e-8) AS earnings_yield, price / (equity + 1e-8) AS pb_ratio, equity / (price + 1e-8) AS book_yield,
  assets / (revenue + 1e-8) AS ev_ebitda, price / (revenue + 1e-8) AS ps_ratio, assets / (revenue + 1e-8) AS mcap_revenue FROM fund),
result AS (SELECT * FROM mom FULL JOIN vols USING (symbol, ts) FULL JOIN q USING (symbol, ts) FULL JOIN v USING (symbol, ts))""")
def f05b(spark, d):
    return f05(spark, d)


@query("f06_financial_ratios", "symbol net_margin:8 gross_margin:6 roe:8 roa:8 debt_to_equity:8 debt_to_assets:8 current_ratio:8 price_to_book:6", FUND + """,
l AS (SELECT symbol, arg_max(net_income, ts) AS ni, arg_max(revenue, ts) AS rev, arg_max(equity, ts) AS eq, arg_max(assets, ts) AS a,
  arg_max(liabilities, ts) AS li, arg_max(price, ts) AS p FROM fund GROUP BY symbol),
result AS (SELECT symbol, CASE WHEN ni <> 0 THEN ni / rev END AS net_margin, 0.3 AS gross_margin, CASE WHEN ni <> 0 THEN ni / eq END AS roe,
  CASE WHEN ni <> 0 THEN ni / a END AS roa, CASE WHEN li <> 0 THEN li / eq END AS debt_to_equity, CASE WHEN li <> 0 THEN li / a END AS debt_to_assets,
  CASE WHEN li <> 0 THEN a / li END AS current_ratio, CASE WHEN ni <> 0 THEN p / (eq / 1000000) END AS price_to_book FROM l)""")
def f06(spark, d):
    l = A.latest_statement(fundamentals(spark, d), "symbol", "ts")
    return A.ratios(l.withColumns({"gross_profit": F.col("revenue") * 0.3, "current_assets": F.col("assets"), "current_liabilities": F.col("liabilities")}))


@query("f07_point_in_time", "symbol ts! close:8 roe:8 leverage:8", FUND + f""", q AS ({QUALITY_SQL}),
result AS (SELECT b.symbol, b.ts, b.close, q.roe, q.leverage FROM bars b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.ts >= q.ts)""")
def f07(spark, d):
    return A.point_in_time(bars(spark, d).select("symbol", "ts", "close"), A.quality(fundamentals(spark, d)), ["roe", "leverage"])
