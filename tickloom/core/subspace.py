"""Leading eigenvectors of large symmetric matrices by block subspace iteration.

The matrix is a table of its entries, one triangle of (a, b, value); a round multiplies it with a
block of a few vectors, one join and one partial aggregate. Only matrices as wide as the block
leave the rows, and only one number a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

C = F.col
SPARE = 64  # vectors carried beside the wanted ones: the residual of a component falls by |first eigenvalue left out| / |its own| a round


def _products(keys: Sequence[str], p: int):
    """W'W, W'Y and Y'Y of the rows of a batch, flattened, one row per key."""

    def run(batches):
        for pdf in batches:
            for key, g in pdf.groupby(list(keys), sort=False):
                w, y = np.stack(g["w"].to_numpy()), np.stack(g["y"].to_numpy())
                flat = np.concatenate([(w.T @ w).ravel(), (w.T @ y).ravel(), (y.T @ y).ravel()])
                yield pd.DataFrame([[*key, flat]], columns=[*keys, "flat"])

    return run


def _ritz(keys: Sequence[str], p: int, k: int):
    """Best vectors inside the block: eigenvalues, their combinations of W and the residual of the first k."""

    def one(flat):
        b, s, q = (np.asarray(flat, float).reshape(3, p, p))
        d, u = np.linalg.eigh((b + b.T) / 2)
        keep = d > d.max() * 1e-11 if d.max() > 0 else np.zeros(p, bool)
        t = u[:, keep] / np.sqrt(d[keep])
        value, r = np.linalg.eigh(t.T @ ((s + s.T) / 2) @ t)
        order = np.argsort(-value, kind="stable")
        value, m = value[order], t @ r[:, order]
        off = np.einsum("ij,ij->j", m, q @ m) - value ** 2
        largest = np.abs(value).max(initial=0.0)
        resid = float(np.sqrt(np.maximum(off[:k], 0.0)).max(initial=0.0) / largest) if largest > 0 else 0.0
        return [float(v) for v in value], [[float(v) for v in c] for c in m.T], resid

    def run(batches):
        for pdf in batches:
            out = pdf[list(keys)].copy()
            out["value"], out["mix"], out["resid"] = zip(*[one(f) for f in pdf["flat"]]) if len(pdf) else ((), (), ())
            yield out

    return run


def leading(entries: DataFrame, k: int, keys: Sequence[str] = (), value: str = "cov", tol: float = 1e-7, rounds: int = 100) -> DataFrame:
    """(*keys, component, symbol, loading, value): the k largest eigenvalues of each matrix, from 0 on.

    ``entries`` has one row per unordered pair (a, b) with a <= b; missing pairs and null entries
    count as 0. Loadings of a component have length one and their largest is positive. A matrix of
    fewer than k assets has fewer components. Rounds end once every residual is below ``tol`` times the
    largest eigenvalue; matrices that do not get there within ``rounds`` raise an error.
    """
    spare = [] if keys else ["_all"]
    by, p = [*keys, *spare], k + SPARE
    e = entries.where(C(value).isNotNull()).withColumn("_all", F.lit(0)).select(*by, "a", "b", C(value).cast("double").alias("_v"))
    full = durable(e.unionByName(e.where("a <> b").select(*by, C("b").alias("a"), C("a").alias("b"), "_v")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema.fields if f.name in by)
    start = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.xxhash64(C("a"), i) / F.lit(2.0 ** 63))
    w = full.select(*by, "a").distinct().withColumn("w", start)
    for _ in range(rounds):
        y = full.join(w.withColumnRenamed("a", "b"), [*by, "b"]).groupBy(*by, "a").agg(F.array(*[F.sum(C("_v") * C("w")[i]) for i in range(p)]).alias("y"))
        z = durable(w.join(y, [*by, "a"]))
        parts = z.select(*by, "w", "y").mapInPandas(_products(by, p), f"{kinds}, flat array<double>")
        sums = parts.select(*by, F.posexplode("flat")).groupBy(*by, "pos").agg(F.sum("col").alias("s"))
        flat = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("flat"))  # 3 p p numbers
        ritz = durable(flat.mapInPandas(_ritz(by, p, k), f"{kinds}, value array<double>, mix array<array<double>>, resid double"))
        worst = ritz.agg(F.max("resid")).first()[0]
        if worst is None or worst < tol:
            break
        dot = lambda c: F.aggregate(F.zip_with("y", c, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        # a vector's image has the length of its eigenvalue; scaled back, no column outgrows the others
        cols = F.transform(F.arrays_zip("mix", "value"), lambda m: F.when(F.abs(m["value"]) > 0, dot(m["mix"]) / m["value"]).otherwise(0.0))
        padded = F.slice(F.concat(cols, F.array_repeat(F.lit(0.0), p)), 1, p)
        w = z.join(ritz, by).select(*by, "a", padded.alias("w"))
    else:
        raise ArithmeticError(f"subspace iteration: residual {worst:.1e} after {rounds} rounds")
    dot = lambda c: F.aggregate(F.zip_with("w", c, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    top = F.slice(F.arrays_zip(F.transform("mix", dot).alias("loading"), "value"), 1, k)
    v = z.join(ritz, by).select(*by, "a", F.posexplode(top).alias("component", "_c"))
    v = durable(v.select(*by, "component", C("a").alias("symbol"), C("_c")["loading"].alias("loading"), C("_c")["value"].alias("value")))
    sign = v.groupBy(*by, "component").agg(F.signum(F.max_by("loading", F.struct(F.abs("loading"), C("symbol")))).alias("_s"))
    return v.join(sign, [*by, "component"]).withColumn("loading", C("loading") * C("_s")).drop("_s", *spare)
