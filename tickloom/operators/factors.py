"""Alpha factors from prices and fundamentals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.asof import asof
from ..core.slices import over_rows
from .indicators import change, mean, std

EPS = 1e-8
C = F.col
ROOT_YEAR = 252.0 ** 0.5
LN2 = 0.6931471805599453


def momentum(bars: DataFrame, windows: Sequence[int] = (5, 10, 21, 63, 252), value: str = "close") -> DataFrame:
    def f(d, w):
        d = d.withColumns({f"mom_{n}": change(value, n, w) for n in windows})
        if 21 in windows and 252 in windows:
            d = d.withColumns({"mom_ratio": C("mom_21") / (F.abs("mom_252") + EPS), "mom_diff": C("mom_21") - C("mom_252")})
        if 21 in windows:
            d = d.withColumn("mom_accel", C("mom_21") - F.lag("mom_21").over(w))
        d = d.withColumn("_r", change(value, 1, w))
        d = d.withColumn("_up", F.when(C("_r") > 0, 1.0).when(C("_r").isNotNull(), 0.0))
        return d.withColumn("trend_strength", mean("_up", 21, w)).drop("_r", "_up")
    return over_rows(bars, f, back=max(windows) + 22)


def _ratio(df: DataFrame, out: str, num: str, den: str) -> DataFrame:
    """num / (den + eps) when both columns exist; a non-finite value becomes null."""
    if num in df.columns and den in df.columns:
        below = C(den) + EPS
        df = df.withColumn(out, F.when(below != 0, C(num) / below))
    return df


def value(fundamentals: DataFrame) -> DataFrame:
    d = fundamentals
    for out, num, den in [("pe_ratio", "price", "earnings"), ("earnings_yield", "earnings", "price"), ("pb_ratio", "price", "book_value"),
                          ("book_yield", "book_value", "price"), ("ev_ebitda", "enterprise_value", "ebitda"),
                          ("ps_ratio", "price", "revenue"), ("mcap_revenue", "market_cap", "revenue")]:
        d = _ratio(d, out, num, den)
    return d


def quality(financials: DataFrame) -> DataFrame:
    d = financials
    for out, num, den in [("roe", "net_income", "equity"), ("roa", "net_income", "assets"), ("profit_margin", "net_income", "revenue"),
                          ("asset_turnover", "revenue", "assets"), ("accruals_ratio", "total_accruals", "assets"),
                          ("cash_flow_to_income", "operating_cash_flow", "net_income"), ("debt_to_equity", "liabilities", "equity"),
                          ("leverage", "assets", "equity")]:
        d = _ratio(d, out, num, den)
    return d


def volatility(bars: DataFrame, windows: Sequence[int] = (21, 63)) -> DataFrame:
    def f(d, w):
        d = d.withColumns({"_lr": F.log(C("close") / F.lag("close").over(w)), "_hl": F.pow(F.log(C("high") / C("low")), F.lit(2.0))})
        d = d.withColumn("_gk", 0.5 * C("_hl") - (2 * LN2 - 1) * F.pow(F.log(C("close") / C("open")), F.lit(2.0)))
        for n in windows:
            gk = mean("_gk", n, w)
            d = d.withColumns({f"realized_vol_{n}": std("_lr", n, w) * ROOT_YEAR,
                               f"parkinson_vol_{n}": F.sqrt(mean("_hl", n, w) / (4 * LN2)) * ROOT_YEAR,
                               f"gk_vol_{n}": F.when(gk >= 0, F.sqrt(gk) * ROOT_YEAR)})
        if len(windows) > 1:
            d = d.withColumn("vol_ratio", C(f"realized_vol_{min(windows)}") / (C(f"realized_vol_{max(windows)}") + EPS))
        return d.withColumn("vol_trend", change(f"realized_vol_{windows[0]}", 1, w)).drop("_lr", "_hl", "_gk")
    return over_rows(bars, f, back=max(windows) + 2)


def all_factors(bars: DataFrame, fundamentals: DataFrame | None = None, financials: DataFrame | None = None) -> DataFrame:
    """Momentum, volatility, value and quality on (ts, symbol), fully outer joined."""
    keys = ["ts", "symbol"]
    drop = ["open", "high", "low", "close", "volume"]
    out = momentum(bars).drop(*drop).join(volatility(bars).drop(*drop), keys, "full")
    for frame, fn in ((fundamentals, value), (financials, quality)):
        if frame is not None:
            new = fn(frame)
            out = out.join(new.select(*keys, *[c for c in new.columns if c not in out.columns]), keys, "full")
    return out


def ratios(latest: DataFrame) -> DataFrame:
    """Financial ratios from one latest row per company; a missing or zero term gives null.

    price_to_book keeps the fixed divisor of one million shares.
    """
    def r(num: str, den: str) -> Column:
        return F.when((C(num) != 0) & (C(den) != 0), C(num) / C(den))
    return latest.withColumns({
        "net_margin": r("net_income", "revenue"), "gross_margin": r("gross_profit", "revenue"), "roe": r("net_income", "equity"),
        "roa": r("net_income", "assets"), "debt_to_equity": r("liabilities", "equity"), "debt_to_assets": r("liabilities", "assets"),
        "current_ratio": r("current_assets", "current_liabilities"),
        "price_to_book": F.when((C("price") != 0) & (C("net_income") != 0) & (C("equity") > 0), C("price") / (C("equity") / 1_000_000))})


def latest_statement(statements: DataFrame, by: str = "symbol", on: str = "date") -> DataFrame:
    cols = [c for c in statements.columns if c not in (by, on)]
    return statements.groupBy(by).agg(*[F.max_by(c, on).alias(c) for c in cols])


def point_in_time(bars: DataFrame, fundamentals: DataFrame, take: Sequence[str]) -> DataFrame:
    """Each bar with the latest statement known at its time."""
    return asof(bars, fundamentals, ["symbol"], "ts", take)
