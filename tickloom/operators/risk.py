"""Risk limits, value at risk, sizing, stops and pre-trade checks as table operators."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.asof import asof
from ..core.crossing import first_crossing
from ..core.ranking import quantiles
from ..core.slices import match, spread
from ..session import durable
from .calendar import market_open
from .metrics import drawdown

C = F.col


def drawdown_check(equity: DataFrame, limit: float = 0.1, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    keys = list(keys)
    last = drawdown(equity, "equity", keys).groupBy(*keys).agg(F.max_by("drawdown", "ts").alias("drawdown"))
    return last.withColumn("drawdown", F.abs("drawdown")).withColumn("ok", C("drawdown") <= limit)


def exposure_check(positions: DataFrame, limit: float, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    g = positions.groupBy(*by).agg(F.sum(F.abs("value")).alias("gross"), F.max("portfolio_value").alias("portfolio_value"))
    return g.withColumn("exposure", F.when(C("portfolio_value") != 0, C("gross") / C("portfolio_value")).otherwise(0.0)).withColumn("ok", C("exposure") <= limit)


def circuit_breaker(equity: DataFrame, threshold: float, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Latched: halted from the first row whose drawdown reaches the threshold."""
    s = spread(equity, keys=keys).run(_peak=("max", C("equity")))
    hit = F.when((C("_peak") - C("equity")) / C("_peak") >= threshold, 1).otherwise(0)
    s = s.run(_hit=("max", hit))
    return s.col(drawdown=(C("_peak") - C("equity")) / C("_peak"), halted=C("_hit") == 1).done("_peak", "_hit")


def value_at_risk(returns: DataFrame, confidence: float = 0.95, method: str = "historical", by: Sequence[str] = ("symbol",), r: str = "ret") -> DataFrame:
    """Loss threshold as a return: the linear (1 - confidence) quantile, or mean + z * std."""
    if method == "historical":
        return quantiles(returns, by, r, [1 - confidence], "_q").select(*by, C("_q")[0].alias("var"))
    z = NormalDist().inv_cdf(1 - confidence)
    return returns.groupBy(*by).agg((F.avg(r) + z * F.stddev_samp(r)).alias("var"))


def expected_shortfall(returns: DataFrame, confidence: float = 0.95, by: Sequence[str] = ("symbol",), r: str = "ret") -> DataFrame:
    by = list(by)
    returns = durable(returns.select(*by, r))
    v = value_at_risk(returns, confidence, "historical", by, r)
    tail = returns.join(v, by).where(C(r) <= C("var")).groupBy(*by).agg(F.avg(r).alias("es"))
    return v.join(tail, by, "left").withColumn("es", F.coalesce("es", "var"))


def concentration(positions: DataFrame, by: str = "portfolio") -> DataFrame:
    t = positions.groupBy(by).agg(F.sum(F.abs("value")).alias("_t"))
    d = positions.join(t, by).withColumn("_w", F.when(C("_t") != 0, F.abs("value") / C("_t")))
    g = d.groupBy(by).agg(F.sum(C("_w") * C("_w")).alias("hhi"), F.max("_w").alias("max_weight"), F.count("*").alias("positions"))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_w"), "symbol"))
    top = d.withColumn("_rn", rn).where("_rn <= 5").groupBy(by).agg(F.sum("_w").alias("top5"))
    return g.join(top, by)


def fixed_fractional(df: DataFrame, equity: str = "equity", risk_pct: str = "risk_pct", stop: str = "stop_distance") -> DataFrame:
    ok = (C(equity) > 0) & (C(risk_pct) > 0) & (C(risk_pct) <= 1) & (C(stop) > 0)
    return df.withColumns({"size": F.when(ok, C(equity) * C(risk_pct) / C(stop)), "rejected": ~ok})


def kelly(df: DataFrame, win_rate: str = "win_rate", ratio: str = "win_loss_ratio", fraction: float = 0.5) -> DataFrame:
    ok = (C(win_rate) >= 0) & (C(win_rate) <= 1) & (C(ratio) > 0)
    k = (C(win_rate) * C(ratio) - (1 - C(win_rate))) / C(ratio) * fraction
    return df.withColumns({"kelly": F.when(ok, F.least(F.greatest(k, F.lit(0.0)), F.lit(1.0))), "rejected": ~ok})


def volatility_size(df: DataFrame, equity: str = "equity", risk_pct: str = "risk_pct", atr: str = "atr", multiplier: float = 2.0) -> DataFrame:
    ok = (C(equity) > 0) & (C(risk_pct) > 0) & (C(risk_pct) <= 1) & (C(atr) > 0)
    return df.withColumns({"size": F.when(ok, C(equity) * C(risk_pct) / (C(atr) * multiplier)), "rejected": ~ok})


def stop_paths(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars at and after each entry up to the position's horizon: (id, symbol, entry_ts, entry_price, side, horizon).

    The join is an equi-join on (symbol, month): a position is exploded to the months it is held, so
    it never meets bars outside its life.
    """
    p = positions.withColumn("_month", F.explode(F.sequence(F.date_trunc("month", "entry_ts"), F.date_trunc("month", "horizon"), F.expr("interval 1 month"))))
    b = bars.withColumn("_month", F.date_trunc("month", "ts"))
    j = p.join(b, ["symbol", "_month"]).where((C("ts") > C("entry_ts")) & (C("ts") <= C("horizon"))).drop("_month")
    long = C("side") == "long"
    s = spread(j, keys=["id"]).run(_hi=("max", C("close")), _lo=("min", C("close"))).position("_n")
    best = F.when(long, F.greatest("entry_price", "_hi")).otherwise(F.least("entry_price", "_lo"))
    return s.col(best=best, held_bars=C("_n") + 1).done("_n", "_hi", "_lo")


def _level(anchor: Column, distance: Column) -> Column:
    return F.when(C("side") == "long", anchor - distance).otherwise(anchor + distance)


def stop_levels(paths: DataFrame, fixed_pct: float = 0.05, trail_pct: float = 0.1, atr_multiplier: float = 2.0, max_bars: int = 20) -> DataFrame:
    """Levels and breach flags of every stop on every bar of a position (an ``atr`` column is used if present)."""
    long = C("side") == "long"
    d = paths.withColumns({"fixed_stop": _level(C("entry_price"), C("entry_price") * fixed_pct), "trailing_stop": _level(C("best"), C("best") * trail_pct)})
    if "atr" in paths.columns:
        d = d.withColumn("atr_stop", _level(C("best"), C("atr") * atr_multiplier))
    breach = lambda lvl: F.when(long, C("close") <= C(lvl)).otherwise(C("close") >= C(lvl))
    flags = {f"hit_{n}": breach(f"{n}_stop") for n in ("fixed", "trailing", "atr") if f"{n}_stop" in d.columns}
    return d.withColumns({**flags, "hit_time": C("held_bars") >= max_bars})


def stop_exit(levels: DataFrame, rule: str) -> DataFrame:
    """First bar on which one rule fires, per position."""
    return levels.where(C(f"hit_{rule}")).groupBy("id").agg(F.min("ts").alias("exit_ts"), F.min_by("close", "ts").alias("exit_price"))


def combined_exit(levels: DataFrame) -> DataFrame:
    """Earliest exit over all rules with the first rule that fired (fixed, trailing, atr, time)."""
    rules = [r for r in ("fixed", "trailing", "atr", "time") if f"hit_{r}" in levels.columns]
    which = F.coalesce(*[F.when(C(f"hit_{r}"), F.lit(r)) for r in rules])
    d = levels.withColumn("rule", which).where("rule is not null")
    return d.groupBy("id").agg(F.min("ts").alias("exit_ts"), F.min_by("close", "ts").alias("exit_price"), F.min_by("rule", "ts").alias("rule"))


RULES = ("fixed", "trailing", "atr", "time")


def _best_since(found: DataFrame, value: str = "_f") -> DataFrame:
    """(symbol, pos): the earliest hit over all anchors from ``pos`` on, a running minimum from the end of the series."""
    d = found.select("symbol", C("_ref").alias("pos"), value, (-C("_ref")).alias("_neg"))
    return spread(d, order=["_neg"], bin=F.floor(C("_neg") / 65_536)).run(_g=("min", C(value))).done("_neg", value)


def stop_exits(positions: DataFrame, bars: DataFrame, fixed_pct: float = 0.05, trail_pct: float = 0.1, atr_multiplier: float = 2.0, max_bars: int = 20,
               rules: Sequence[str] = RULES) -> DataFrame:
    """(id, rule, exit_ts, exit_price): the first bar after the entry, and up to the horizon, on which each rule fires.

    Positions are (id, symbol, entry_ts, entry_price, side, horizon); bars are unique per symbol and ts, with an ``atr`` column for that rule.
    No position meets the bars of its life. A fixed stop is a search for the first bar beyond a level. A trailing
    stop fires at the earliest bar that lies far enough below any earlier close: every bar is an anchor with a search of its
    own, and the earliest answer over all anchors after an entry is a running minimum from the end, looked up once;
    the entry price is one more anchor. Searches cost two block lookups however long a position is held.
    """
    has_atr = "atr" in bars.columns and "atr" in rules
    b = spread(bars.select("symbol", "ts", C("close").cast("double"), *(["atr"] if has_atr else []))).position("pos").done()
    b = durable(b)
    p = positions.select("id", "symbol", C("entry_ts").alias("ts"), C("entry_price").cast("double").alias("_entry"), (C("side") == "long").alias("_long"), "horizon")
    p = asof(p, b.select("symbol", "ts", "pos"), ["symbol"], "ts", ["pos"]).withColumn("_start", F.coalesce(C("pos") + 1, F.lit(0).cast("long"))).drop("pos", "ts")
    p = durable(p)
    none = F.lit(None).cast(p.schema["id"].dataType).alias("id")
    found = []
    for long in (True, False):
        mine = p.where("_long" if long else "not coalesce(_long, false)")
        off = (lambda x, part: x - part) if long else (lambda x, part: x + part)
        ask = lambda df, key, at, kind, level: df.select(key, "symbol", at.alias("_ref"), F.lit(kind).alias("_kind"), level.alias("_lv"))
        entry, close = C("_entry"), C("close")
        fixed = ask(mine, C("id"), C("_start"), "fixed", off(entry, entry * fixed_pct))
        trail = ask(b, none, C("pos"), "anchor", off(close, close * trail_pct)).unionAll(ask(mine, C("id"), C("_start"), "trailing", off(entry, entry * trail_pct)))
        by_close = trail.unionAll(fixed) if "trailing" in rules and "fixed" in rules else trail if "trailing" in rules else fixed
        runs = [("trailing", by_close, close)] if {"trailing", "fixed"} & set(rules) else []
        if has_atr:
            by_atr = ask(b, none, C("pos"), "anchor", close).unionAll(ask(mine, C("id"), C("_start"), "atr", entry))
            runs.append(("atr", by_atr, close + C("atr") * atr_multiplier if long else close - C("atr") * atr_multiplier))
        for rule, searches, value in runs:
            hit = durable(first_crossing(b, searches, ["symbol"], value, "_lv", "_ref", "_f", up=not long))
            own = hit.where("_kind <> 'anchor'").select("id", "symbol", C("_kind").alias("rule"), "_ref", "_f")
            if rule not in rules:
                found.append(own.select("id", "symbol", "rule", C("_f").alias("pos")))
                continue
            moved = match(own, _best_since(hit.where("_kind = 'anchor'")).withColumnRenamed("pos", "_ref"), ["symbol", "_ref"])
            found.append(moved.select("id", "symbol", "rule", F.when(C("rule") == rule, F.least("_f", "_g")).otherwise(C("_f")).alias("pos")))
    every = p.where(F.lit("time" in rules)).select("id", "symbol", F.lit("time").alias("rule"), (C("_start") + (max_bars - 1)).alias("pos"))
    for f in found:
        every = every.unionByName(f)
    out = match(every.where("pos is not null"), b.select("symbol", "pos", C("ts").alias("exit_ts"), C("close").alias("exit_price")), ["symbol", "pos"], "inner")
    held = p.select("id", C("_start"), "horizon")
    out = match(out, held, ["id"], "inner").where((C("exit_ts") <= C("horizon")) & (C("pos") >= C("_start")))
    return out.select("id", "rule", "exit_ts", "exit_price")


def first_exit(exits: DataFrame) -> DataFrame:
    """(id, exit_ts, exit_price, rule): the earliest exit of :func:`stop_exits`; on one bar the first of fixed, trailing, atr and time."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), C("rule"))
    first = F.min_by(F.struct("exit_ts", "exit_price", "rule"), F.struct("exit_ts", order))
    return exits.groupBy("id").agg(first.alias("_e")).select("id", "_e.*")


def pre_trade(orders: DataFrame, max_order: float, max_position: float, max_total: float, max_loss: float) -> DataFrame:
    """Orders (qty, price, held_qty, total_value, daily_pnl) with ok and the first failing rule."""
    after = F.abs(C("held_qty") + F.when(C("side") == "buy", C("qty")).otherwise(-C("qty")))
    value = C("qty") * C("price")
    reason = (F.when(C("qty") > max_order, "order_size").when(after > max_position, "position_size")
              .when(C("total_value") + value > max_total, "total_value").when(C("daily_pnl") < -max_loss, "daily_loss"))
    return orders.withColumn("reason", reason).withColumn("ok", C("reason").isNull())


def position_share(orders: DataFrame, limit: float = 0.25, fallback: float = 100.0) -> DataFrame:
    """New position value as a share of the portfolio; price falls back to the limit price, then to a constant."""
    px = F.coalesce(C("price"), C("limit_price"), F.lit(fallback))
    new = F.abs(C("held_qty") + F.when(C("side") == "buy", C("qty")).otherwise(-C("qty"))) * px
    return orders.withColumn("share", F.when(C("portfolio_value") > 0, new / C("portfolio_value"))).withColumn("ok", C("share") <= limit)


def whitelist(orders: DataFrame, symbols: DataFrame) -> DataFrame:
    w = symbols.select(F.upper("symbol").alias("_s")).distinct().withColumn("ok", F.lit(True))
    return orders.join(w, F.upper(orders["symbol"]) == C("_s"), "left").drop("_s").fillna(False, ["ok"])


def trading_hours(orders: DataFrame, extended: bool = False) -> DataFrame:
    return market_open(orders, "ts", extended).withColumnRenamed("is_open", "ok")
