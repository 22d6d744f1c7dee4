"""Portfolio statistics from return panels and weight tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.pairs import pair_moments

C = F.col


def covariance(returns: DataFrame, value: str = "ret", blocks: int | None = None) -> DataFrame:
    """Sample covariance and correlation of every pair (a <= b) over common dates, with means."""
    m = pair_moments(returns, value, blocks)
    n = C("n")
    cov = (C("sxy") - C("sx") * C("sy") / n) / (n - 1)
    va, vb = (C("sxx") - C("sx") * C("sx") / n) / (n - 1), (C("syy") - C("sy") * C("sy") / n) / (n - 1)
    return m.where("n > 1").select("a", "b", n.cast("long").alias("n"), cov.alias("cov"),
                                   F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("corr"))


def full_matrix(cov: DataFrame) -> DataFrame:
    return cov.select("a", "b", "cov").unionByName(cov.where("a <> b").select(C("b").alias("a"), C("a").alias("b"), "cov"))


def portfolio_stats(weights: DataFrame, means: DataFrame, cov: DataFrame, risk_free: float = 0.0, by: str = "portfolio") -> DataFrame:
    """Return w'mu, risk sqrt(w'Sw) and Sharpe per portfolio of (portfolio, symbol, w)."""
    ret = weights.join(means, "symbol").groupBy(by).agg(F.sum(C("w") * C("mu")).alias("ret"))
    risk = marginal(weights, cov, by).groupBy(by).agg(F.sqrt(F.sum(C("w") * C("marginal"))).alias("risk"))
    return ret.join(risk, by).withColumn("sharpe", F.when(C("risk") > 0, (C("ret") - risk_free) / C("risk")).otherwise(0.0))


def marginal(weights: DataFrame, cov: DataFrame, by: str = "portfolio") -> DataFrame:
    """Sw per asset: the covariance table joined once on each side."""
    s = full_matrix(cov)
    sw = weights.select(by, C("symbol").alias("b"), C("w").alias("_wb")).join(s, "b").groupBy(by, "a").agg(F.sum(C("_wb") * C("cov")).alias("marginal"))
    return weights.join(sw.withColumnRenamed("a", "symbol"), [by, "symbol"])


def risk_contribution(weights: DataFrame, cov: DataFrame, by: str = "portfolio") -> DataFrame:
    d = marginal(weights, cov, by).withColumn("contribution", C("w") * C("marginal"))
    t = d.groupBy(by).agg(F.sum("contribution").alias("_t"))
    return d.join(t, by).withColumn("share", F.when(C("_t") != 0, C("contribution") / C("_t"))).drop("_t")


def inverse_volatility(returns: DataFrame, value: str = "ret") -> DataFrame:
    v = returns.groupBy("symbol").agg((1 / F.stddev_samp(value)).alias("_i"))
    t = v.agg(F.sum("_i").alias("_t"))
    return v.join(t).select("symbol", (C("_i") / C("_t")).alias("w"))  # one-row total


def diversification_ratio(weights: DataFrame, cov: DataFrame, by: str = "portfolio") -> DataFrame:
    sd = cov.where("a = b").select(C("a").alias("symbol"), F.sqrt("cov").alias("_sd"))
    top = weights.join(sd, "symbol").groupBy(by).agg(F.sum(C("w") * C("_sd")).alias("_top"))
    risk = marginal(weights, cov, by).groupBy(by).agg(F.sqrt(F.sum(C("w") * C("marginal"))).alias("_risk"))
    return top.join(risk, by).select(by, F.when(C("_risk") > 0, C("_top") / C("_risk")).otherwise(0.0).alias("ratio"))


def candidates(spark, symbols: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """n long-only weight vectors summing to one: normalised exponentials of hashed uniforms."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "portfolio", "symbol"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    d = spark.range(n).withColumnRenamed("id", "portfolio").join(symbols.select("symbol")).withColumn("_e", -F.log(u))
    t = d.groupBy("portfolio").agg(F.sum("_e").alias("_t"))
    return d.join(t, "portfolio").select("portfolio", "symbol", (C("_e") / C("_t")).alias("w"))


def frontier(stats: DataFrame, buckets: int = 50) -> DataFrame:
    """Least risk per return bucket, with the maximum-Sharpe and least-variance candidates marked."""
    r = stats.agg(F.min("ret").alias("_lo"), F.max("ret").alias("_hi"), F.max_by("portfolio", "sharpe").alias("_ms"), F.min_by("portfolio", "risk").alias("_mv"))
    d = stats.join(r).withColumn("bucket", F.least(F.floor((C("ret") - C("_lo")) / (C("_hi") - C("_lo")) * buckets), F.lit(buckets - 1)))
    best = d.groupBy("bucket").agg(F.min_by(F.struct("portfolio", "ret", "risk", "sharpe", "_ms", "_mv"), "risk").alias("s"))
    return best.select("bucket", "s.portfolio", "s.ret", "s.risk", "s.sharpe", (C("s.portfolio") == C("s._ms")).alias("max_sharpe"),
                       (C("s.portfolio") == C("s._mv")).alias("min_variance"))
