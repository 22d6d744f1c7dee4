"""Moments of lagged pairs of series, and Dickey-Fuller regressions that need nothing else.

A pair's own calendar is the dates both series have. The products of its values at the last few of
those dates are summed inside blocks of series and stretches of time, so a pair is one row per
stretch, never one row per date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import block_count

C = F.col


def _pair_stretch(y: np.ndarray, x: np.ndarray, back: int):
    """Dates by pairs in; counts, first and last ``back`` common values and Gram sums of (1, y0, x0, ..., y_back, x_back) out."""
    both = ~(np.isnan(y) | np.isnan(x))
    y, x = np.where(both, y, 0.0), np.where(both, x, 0.0)
    dates, pairs = both.shape
    at = np.where(both, np.arange(dates)[:, None], -1)
    last = np.maximum.accumulate(at, axis=0)
    before = np.vstack([np.full((1, pairs), -1), last[:-1]])
    count = both.sum(axis=0)
    step, lag, full = [], at, both
    for _ in range(back):
        lag = np.where(lag >= 0, np.take_along_axis(before, np.maximum(lag, 0), 0), -1)
        step.append(lag)
        full = full & (lag >= 0)
    z = [full.astype(float), y * full, x * full]
    for lag in step:
        z += [np.take_along_axis(v, np.maximum(lag, 0), 0) * full for v in (y, x)]
    z = np.stack(z).transpose(2, 0, 1)
    sums = z @ z.transpose(0, 2, 1)
    rank, head, tail, end = np.cumsum(both, axis=0) * both, [], [], last[-1]
    pick = lambda v, i: np.take_along_axis(v, np.maximum(i, 0)[None], 0)[0]
    for k in range(back):
        first = (rank == k + 1).argmax(axis=0)
        head.append(np.stack([pick(y, first), pick(x, first)], axis=1))
        tail.append(np.stack([pick(y, end), pick(x, end)], axis=1))
        end = np.where(end >= 0, pick(before, end), -1)
    held = np.minimum(count, back)
    shaped = lambda parts: np.stack(parts, axis=1).reshape(pairs, -1)
    return count, held, shaped(head), shaped(tail), sums.reshape(pairs, -1)


def lagged_pair_moments(panel: DataFrame, value: str, back: int = 2, blocks: int | None = None, chunk: str | Column = "year") -> DataFrame:
    """(a, b, parts) for a < b: per stretch of time the count, the first and last ``back`` common values and the Gram sums.

    Values are taken from their series' mean. Rows without a value or a date take no part; ``parts`` is sorted by time and as
    long as the panel has stretches.
    """
    blocks = blocks or block_count(panel)
    d = panel.where(C(value).isNotNull() & C("ts").isNotNull() & C("symbol").isNotNull())
    mean = d.groupBy("symbol").agg(F.avg(value).alias("_mean"))
    when = F.date_trunc(chunk, C("ts")) if isinstance(chunk, str) else chunk
    d = d.join(mean, "symbol").select("symbol", F.unix_micros(C("ts").cast("timestamp")).alias("t"), (C(value) - C("_mean")).cast("double").alias("v"),
                                      when.cast("string").alias("chunk"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("blk"))
    d = d.withColumn("o", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    d = d.select("symbol", "t", "v", "chunk", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
    names = ["a", "b", "chunk", "n", "held", "head", "tail", "sums"]

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, when = pdf["bi"].iat[0], pdf["bj"].iat[0], pdf["chunk"].iat[0]
        wide = pdf.pivot(index="t", columns="symbol", values="v").sort_index()
        left = sorted(pdf.loc[pdf["blk"] == i, "symbol"].unique())
        right = sorted(pdf.loc[pdf["blk"] == j, "symbol"].unique())
        out = [pd.DataFrame(columns=names)]
        for one in left:
            others = [s for s in right if s > one] if i == j else right
            if not others:
                continue
            mine, theirs = wide[one].to_numpy()[:, None], wide[others].to_numpy()
            first = np.array([one < s for s in others])
            n, held, head, tail, sums = _pair_stretch(np.where(first, mine, theirs), np.where(first, theirs, mine), back)
            part = pd.DataFrame({"a": [min(one, s) for s in others], "b": [max(one, s) for s in others], "chunk": when, "n": n, "held": held,
                                 "head": list(head), "tail": list(tail), "sums": list(sums)})
            out.append(part[part["n"] > 0])
        return pd.concat([o for o in out if len(o)] or out, ignore_index=True)

    parts = d.groupBy("bi", "bj", "chunk").applyInPandas(
        multiply, "a string, b string, chunk string, n long, held int, head array<double>, tail array<double>, sums array<double>")
    return parts.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct(*names[2:]))).alias("parts"))


def _joined(parts, back: int):
    """Count, first values and Gram sums of a pair over all stretches, rows that look back across a border included."""
    size = 2 * (back + 1) + 1
    total, n, first, carry = np.zeros((size, size)), 0, np.empty((0, 2)), np.empty((0, 2))
    for p in parts:
        held = int(p["held"])
        head = np.asarray(p["head"], float).reshape(back, 2)[:held]
        tail = np.asarray(p["tail"], float).reshape(back, 2)[:held][::-1]
        total += np.asarray(p["sums"], float).reshape(size, size)
        line = np.vstack([carry, head])
        for i in range(max(back, len(carry)), len(line)):
            z = np.concatenate([[1.0], line[i - back:i + 1][::-1].ravel()])
            total += np.outer(z, z)
        first = np.vstack([first, head])[:back]
        carry = np.vstack([carry, tail])[-back:]
        n += int(p["n"])
    return n, first, total


def dickey_fuller(cross: np.ndarray, rows: int, constant: bool, criterion: str | None = None):
    """(slope, t statistic, lag) from the Gram sums of ([1,] level, lagged differences..., difference).

    With a criterion (aic or bic) the lag is the best of 0 up to the given ones, all on the same rows. None where the
    regression has no solution.
    """
    lead, most = (2 if constant else 1), cross.shape[0] - (3 if constant else 2)
    best = None
    for lag in range(0 if criterion else most, most + 1):
        k = lead + lag
        a, c, yy = cross[:k, :k], cross[:k, -1], cross[-1, -1]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        inv = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
        beta = inv @ c
        rss = float(yy - beta @ c)
        if rows <= k or rss <= 0 or inv[lead - 1, lead - 1] <= 0:
            continue
        score = rows * np.log(rss / rows) + k * (2.0 if criterion == "aic" else np.log(rows))
        if best is None or score < best[0]:
            best = (score, float(beta[lead - 1]), float(beta[lead - 1] / np.sqrt(rss / (rows - k) * inv[lead - 1, lead - 1])), lag)
    return best[1:] if best else (None, None, None)


def residual_tests(moments: DataFrame, lags: int, least: int = 50, criterion: str | None = None) -> DataFrame:
    """(a, b, n, hedge, slope, statistic, lag, phi) from ``lagged_pair_moments`` with ``back`` = lags + 1.

    ``n`` counts the rows of the regression, ``phi`` is the slope of the residual on the one before it, with a constant and over
    all dates but the first. Pairs of fewer than ``least`` common dates, or whose x does not move, have no row.
    """
    back = lags + 1
    size = 2 * (back + 1) + 1

    def one(a, b, parts):
        n, first, g = _joined(parts, back)
        if n < max(least, back + 1):
            return None
        base = g[:3, :3] + sum((np.outer(z, z) for z in np.column_stack([np.ones(len(first)), first])), np.zeros((3, 3)))
        my, mx = base[0, 1] / n, base[0, 2] / n
        sxx, sxy = base[2, 2] - n * mx * mx, base[1, 2] - n * mx * my
        if sxx <= 1e-12 * base[2, 2]:
            return None
        hedge = sxy / sxx
        level = np.zeros((back + 1, size))  # the residual at each lag in terms of the summed values
        level[:, 0] = hedge * mx - my
        for k in range(back + 1):
            level[k, 1 + 2 * k], level[k, 2 + 2 * k] = 1.0, -hedge
        steps = level[:-1] - level[1:]
        use = np.vstack([level[1:2], steps[1:], steps[:1]])
        slope, stat, lag = dickey_fuller(use @ g @ use.T, n - back, False, criterion)
        const = np.eye(size)[:1]
        use = np.vstack([const, level[1:2], steps[:1]])
        s = use @ g @ use.T
        e = first @ [1.0, -hedge] + level[0, 0]
        for was, now in zip(e[:-1], e[1:]):
            z = np.array([1.0, was, now - was])
            s = s + np.outer(z, z)
        spread = s[1, 1] - s[0, 1] ** 2 / s[0, 0]
        phi = 1 + (s[1, 2] - s[0, 1] * s[0, 2] / s[0, 0]) / spread if spread > 0 else None
        return a, b, n - back, float(hedge), slope, stat, lag, None if phi is None else float(phi)

    def solve(batches):
        for pdf in batches:
            rows = [r for r in map(one, pdf["a"], pdf["b"], pdf["parts"]) if r]
            out = pd.DataFrame(rows, columns=["a", "b", "n", "hedge", "slope", "statistic", "lag", "phi"])
            yield out.astype({"lag": "Int64"})

    return moments.mapInPandas(solve, "a string, b string, n long, hedge double, slope double, statistic double, lag long, phi double")


def series_tests(sums: DataFrame, keys: list[str], lags: int, constant: bool, criterion: str | None = None) -> DataFrame:
    """(*keys, n, slope, statistic, lag) from the Gram sums of difference, level and lagged differences (``core.regress.gram``)."""
    k = lags + (2 if constant else 1)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys]

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = np.zeros((k + 1, k + 1))
                for i in range(k):
                    g[i, k] = g[k, i] = r[f"_c{i}"]
                    for j in range(i, k):
                        g[i, j] = g[j, i] = r[f"_g{i}_{j}"]
                g[k, k] = r["_yy"]
                rows.append([*[r[c] for c in keys], int(r["n"]), *dickey_fuller(g, int(r["n"]), constant, criterion)])
            yield pd.DataFrame(rows, columns=[*keys, "n", "slope", "statistic", "lag"]).astype({"lag": "Int64"})

    return sums.mapInPandas(solve, ", ".join([*kinds, "n long, slope double, statistic double, lag long"])).select(*keys, "n", "slope", "statistic", "lag")
