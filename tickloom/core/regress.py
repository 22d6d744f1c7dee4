"""Least squares as one partial aggregate: Gram sums per group, a k x k solve per result row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distributions import f_sf, t_sf


def gram(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """Sums X'X, X'y, y'y, y and n per group; every sum combines on the map side."""
    cols = (["_one"] if intercept else []) + list(xs)
    d = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs])).withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"_g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"_c{i}") for i, a in enumerate(cols)]
    sums += [F.sum(F.col(y) * F.col(y)).alias("_yy"), F.sum(y).alias("_y"), F.count(F.lit(1)).alias("n")]
    return d.groupBy(*by).agg(*sums)


def ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True, min_extra: int = 1) -> DataFrame:
    """Per group: coefficients, t, p, r2, adj_r2, mse, f, f_p, aic, bic and n.

    The array columns follow the order (intercept,) + xs.
    """
    by = list(by)
    names = (["const"] if intercept else []) + list(xs)
    k = len(names)
    g = gram(df, by, y, xs, intercept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema.fields if f.name in by] + [
        "n long", "names array<string>", "coef array<double>", "t array<double>", "p array<double>", "r2 double",
        "adj_r2 double", "mse double", "f double", "f_p double", "aic double", "bic double", "rss double"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.empty((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = r[f"_g{i}_{j}"]
                c = np.array([r[f"_c{i}"] for i in range(k)])
                n = int(r["n"])
                if n < k + min_extra:
                    continue
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                inv = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
                beta = inv @ c
                rss = max(float(r["_yy"] - beta @ c), 0.0)
                tss = float(r["_yy"] - (r["_y"] ** 2 / n if intercept else 0.0))
                dof = n - k
                mse = rss / dof if dof else None
                se = np.sqrt(np.maximum(np.diag(inv) * (mse or 0.0), 0.0))
                t = [float(b / s) if s > 0 else None for b, s in zip(beta, se)]
                r2 = 1 - rss / tss if tss > 0 else None
                q = k - (1 if intercept else 0)
                f = ((tss - rss) / q / mse) if q and mse else None
                ll = -n / 2 * (np.log(2 * np.pi * rss / n) + 1) if rss > 0 else None
                rows.append({
                    **{b: r[b] for b in by}, "n": n, "names": names, "coef": [float(b) for b in beta], "t": t,
                    "p": [None if v is None else 2 * t_sf(abs(v), dof) for v in t], "r2": r2,
                    "adj_r2": None if r2 is None or not dof else 1 - (1 - r2) * (n - (1 if intercept else 0)) / dof,
                    "mse": mse, "f": f, "f_p": None if f is None else f_sf(f, q, dof),
                    "aic": None if ll is None else -2 * ll + 2 * k, "bic": None if ll is None else -2 * ll + k * np.log(n),
                    "rss": rss})
            names_ = [f.split("`")[1] for f in schema.split(", ") if f.startswith("`")]
            cols = names_ + ["n", "names", "coef", "t", "p", "r2", "adj_r2", "mse", "f", "f_p", "aic", "bic", "rss"]
            yield pd.DataFrame(rows, columns=cols)

    return g.mapInPandas(solve, schema)
