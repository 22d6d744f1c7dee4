"""Trees, ensembles, components and clusters with spark.ml."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import density
from ..core.pairs import pair_moments
from ..core.regress import ols
from ..core.slices import over_rows, spread
from ..core.subspace import leading
from ..session import durable
from .evaluation import classification_metrics, regression_metrics, time_folds

C = F.col
MODELS = {("forest", "classification"): RandomForestClassifier, ("forest", "regression"): RandomForestRegressor,
          ("boosting", "classification"): GBTClassifier, ("boosting", "regression"): GBTRegressor}


def features(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip").transform(df)


def estimator(kind: str, task: str, **params):
    params = {"seed": 3, "maxDepth": 5 if kind == "boosting" else 10, **({"numTrees": 100} if kind == "forest" else {"maxIter": 50}), **params}
    return MODELS[(kind, task)](labelCol="label", **params)


def fit(df: DataFrame, y: str, xs: Sequence[str], kind: str = "forest", task: str = "classification", **params):
    """Fit on complete rows only."""
    d = durable(features(df.where(C(y).isNotNull()).withColumn("label", C(y).cast("double")), xs).select("features", "label"))
    return estimator(kind, task, **params).fit(d)


def predict(model, df: DataFrame, xs: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with its prediction, null where a feature is null."""
    p = model.transform(features(df, xs)).select(*key, "prediction")
    return df.join(p, list(key), "left")


def cross_validate(df: DataFrame, y: str, xs: Sequence[str], order: Sequence, kind: str = "forest", task: str = "classification", folds: int = 5, bin=None, **params) -> DataFrame:
    """Metrics per time-ordered fold of one model."""
    base = features(df.where(C(y).isNotNull()).withColumn("label", C(y).cast("double")), xs)
    d = durable(time_folds(base, order, folds, bin).select("fold", "role", "features", "label"))
    out = None
    for k in range(1, folds + 1):
        m = estimator(kind, task, **params).fit(d.where((C("fold") == k) & (C("role") == "train")))
        p = m.transform(d.where((C("fold") == k) & (C("role") == "test"))).withColumn("fold", F.lit(k))
        r = classification_metrics(p, by=["fold"]) if task == "classification" else regression_metrics(p, by=["fold"])
        out = r if out is None else out.unionByName(r)
    return out


def tune(df: DataFrame, y: str, xs: Sequence[str], order: Sequence, grid: Mapping[str, Sequence], kind: str = "boosting", task: str = "regression", folds: int = 3, bin=None) -> DataFrame:
    """Mean score per grid point over time-ordered folds, best first."""
    score = "rmse" if task == "regression" else "accuracy"
    out = None
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        r = cross_validate(df, y, xs, order, kind, task, folds, bin, **params).agg(F.avg(score).alias("score"), F.stddev_samp(score).alias("std"))
        r = r.select(F.lit(",".join(f"{k}={v}" for k, v in params.items())).alias("params"), "score", "std")
        out = r if out is None else out.unionByName(r)
    return out.orderBy(F.asc("score") if task == "regression" else F.desc("score"))


def importances(spark: SparkSession, models: Mapping[str, object], xs: Sequence[str]) -> DataFrame:
    """Feature importances of several models side by side with their mean (one row per feature)."""
    rows = [(x, n, float(m.featureImportances[i])) for n, m in models.items() for i, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "feature string, model string, importance double")
    p = d.groupBy("feature").pivot("model", list(models)).agg(F.first("importance"))
    total = sum([C(n) for n in list(models)[1:]], C(next(iter(models))))
    return p.withColumn("mean", total / len(models)).orderBy(F.desc("mean"), "feature")


def save_model(model, path: str, metadata: Mapping[str, str]) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(path, dict(metadata))], "path string, metadata map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata_table")


def model_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("path string, metadata map<string,string>").json(f"{root}/*/metadata_table")


def complete_dates(returns: DataFrame, value: str = "ret", order: str = "ts") -> DataFrame:
    """Rows of the dates on which every asset has a value."""
    d = returns.where(C(value).isNotNull() & C(order).isNotNull())
    size = d.agg(F.count_distinct("symbol").alias("_size"))
    full = d.groupBy(order).agg(F.count_distinct("symbol").alias("_size")).join(size, "_size").select(order)
    return d.join(full, order, "left_semi")


def pair_covariance(moments: DataFrame) -> DataFrame:
    """Moments with the sample covariance ``cov`` over the dates of each pair, null for a single date."""
    n = C("n")
    return moments.withColumn("cov", F.when(n > 1, (C("sxy") - C("sx") * C("sy") / n) / (n - 1)))


def with_loadings(df: DataFrame, loadings: DataFrame) -> DataFrame:
    """Rows with the loadings of their asset as one array ``_load``."""
    own = loadings.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "loading"))), lambda e: e["loading"]).alias("_load"))
    return df.join(own, "symbol")


def component_scores(returns: DataFrame, loadings: DataFrame, means: DataFrame, k: int, value: str = "ret", order: str = "ts") -> DataFrame:
    """(date, scores) of a panel on given loadings and means; assets without a value on a date add nothing."""
    centred = with_loadings(returns.where(C(value).isNotNull()).join(means, "symbol").withColumn("_c", C(value) - C("mean")), loadings)
    sums = F.array(*[F.sum(C("_c") * F.get("_load", F.lit(i))) for i in range(k)])
    return centred.groupBy(order).agg(sums.alias("scores")).withColumn("scores", F.filter("scores", lambda x: x.isNotNull()))


def market_pca(returns: DataFrame, k: int, value: str = "ret", order: str = "ts", complete: bool = False):
    """Centred components: (scores, loadings, variance ratios, means).

    Covariances come from the blocked pair moments, eigenvectors from block subspace iteration. Gaps
    stay gaps: a pair is measured on the dates both assets have, and an asset without a value adds
    nothing to a date's scores. With ``complete`` only dates that every asset has are read. Signs follow the
    largest loading, so that runs agree.
    """
    d = complete_dates(returns, value, order) if complete else returns.where(C(value).isNotNull() & C(order).isNotNull())
    d = d.select("symbol", C(order).alias("ts"), C(value).cast("double").alias("_v"))
    cov = durable(pair_covariance(pair_moments(d, "_v")))
    means = cov.where("a = b").select(C("a").alias("symbol"), (C("sx") / C("n")).alias("mean"))
    loadings = leading(cov, k)
    total = cov.where("a = b").agg(F.sum("cov").alias("_total"))  # one row
    ratios = loadings.groupBy("component").agg(F.max("value").alias("value")).join(F.broadcast(total)).select("component", (C("value") / C("_total")).alias("ratio"), "value")
    scores = component_scores(d, loadings, means, k, "_v").withColumnRenamed("ts", order)
    return scores, loadings.select("symbol", "component", "loading"), ratios, means


def variance_table(ratios: DataFrame) -> DataFrame:
    """Cumulative ratios and whether a component is among those needed for 95 per cent (one row per component)."""
    from pyspark.sql import Window
    w = Window.orderBy("component")
    d = ratios.withColumn("cumulative", F.sum("ratio").over(w))
    return d.withColumn("needed_95", F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)) < 0.95)


def eigenportfolios(loadings: DataFrame) -> DataFrame:
    """Absolute loadings scaled to one per component."""
    t = loadings.groupBy("component").agg(F.sum(F.abs("loading")).alias("_t"))
    return loadings.join(t, "component").select("component", "symbol", (F.abs("loading") / C("_t")).alias("w"))


def reconstruct(scores: DataFrame, loadings: DataFrame, means: DataFrame, k: int, order: str = "ts", panel: DataFrame | None = None) -> DataFrame:
    """Values from the first k components: for the rows of ``panel``, or without one for every asset on every date."""
    if panel is not None:
        j = with_loadings(panel.select("symbol", order).join(scores, order), loadings.where(C("component") < k)).join(means, "symbol")
        part = F.aggregate(F.zip_with(F.slice("scores", 1, F.size("_load")), "_load", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return j.select(order, "symbol", (part + C("mean")).alias("value"))
    s = scores.select(order, F.posexplode("scores").alias("component", "s")).where(C("component") < k)
    d = s.join(loadings, "component").groupBy(order, "symbol").agg(F.sum(C("s") * C("loading")).alias("_v"))
    return d.join(means, "symbol").select(order, "symbol", (C("_v") + C("mean")).alias("value"))


def factor_returns(scores: DataFrame, order: str = "ts") -> DataFrame:
    k = len(scores.first()["scores"])
    return scores.select(order, *[C("scores")[i].alias(f"f{i + 1}") for i in range(k)])


def exposures(returns: DataFrame, factors: DataFrame, value: str = "ret", order: str = "ts") -> DataFrame:
    """Loadings of every asset on the factors, without a constant."""
    names = [c for c in factors.columns if c != order]
    return ols(returns.join(factors, order), ["symbol"], value, names, intercept=False)


def attribution(returns: DataFrame, factors: DataFrame, value: str = "ret", order: str = "ts") -> DataFrame:
    """Per asset and date: the factor part and the rest of the return."""
    names = [c for c in factors.columns if c != order]
    j = durable(returns.join(factors, order))
    b = ols(j, ["symbol"], value, names, intercept=False).select("symbol", "coef")
    part = sum([C("coef")[i] * C(n) for i, n in enumerate(names)], F.lit(0.0))
    return j.join(b, "symbol").select("symbol", order, C(value), part.alias("factor_return"), (C(value) - part).alias("specific_return"))


def variance_decomposition(attributed: DataFrame, value: str = "ret") -> DataFrame:
    """Total, factor and specific variance per asset with shares and the annual specific risk."""
    g = attributed.groupBy("symbol").agg(F.var_samp(value).alias("total"), F.var_samp("factor_return").alias("factor"), F.var_samp("specific_return").alias("specific"))
    return g.withColumns({"factor_pct": C("factor") / C("total") * 100, "specific_pct": C("specific") / C("total") * 100, "specific_risk": F.sqrt(C("specific") * 252)})


def factor_timing(factors: DataFrame, factor: str = "f1", n: int = 21, order: str = "ts", bin="month") -> DataFrame:
    d = factors.select(order, factor).withColumn("_k", F.lit(0))
    f = lambda x, w: x.withColumn("signal", F.signum(F.when(F.count(factor).over(w.rowsBetween(-n + 1, 0)) >= n, F.avg(factor).over(w.rowsBetween(-n + 1, 0)))))
    return over_rows(d, f, back=n, keys=["_k"], order=[order], bin=bin).drop("_k")


def rolling_exposure(returns: DataFrame, months: int = 12, k: int = 3, value: str = "ret") -> DataFrame:
    """Loadings and variance ratios of k components over the trailing ``months`` months at each month end.

    Pair moments are taken once per month; a month's moments go to the windows that hold it and are summed
    there, so no window reads its dates again. Windows start once the panel has that many months. On
    a window without gaps the loadings are the regression coefficients of the assets on the component scores.
    The sign follows the largest loading.
    """
    d = returns.where(C(value).isNotNull() & C("ts").isNotNull()).select("symbol", "ts", C(value).cast("double").alias("_v"))
    number = lambda t: F.year(t) * 12 + F.month(t)
    m = pair_moments(d, "_v", chunk="month", per_chunk=True).withColumn("_m", number(F.to_date("chunk")))
    ends = d.groupBy(number(C("ts")).alias("_w")).agg(F.max("ts").alias("window_end"))
    first = ends.agg((F.min("_w") + (months - 1)).alias("_first"))  # one row
    ends = ends.join(F.broadcast(first)).where(C("_w") >= C("_first")).select("_w", "window_end")
    spread_out = m.withColumn("_w", F.explode(F.sequence(C("_m"), C("_m") + (months - 1)))).join(ends, "_w")
    sums = spread_out.groupBy("window_end", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    cov = durable(pair_covariance(sums))
    total = cov.where("a = b").groupBy("window_end").agg(F.sum("cov").alias("_total"))
    out = leading(cov, k, ["window_end"]).join(total, "window_end")
    return out.select("window_end", "component", "symbol", "loading", (C("value") / C("_total")).alias("ratio"))


def asset_vectors(returns: DataFrame, value: str = "ret", dims: int | None = None) -> DataFrame:
    """One vector per asset: its return on every date of the panel, 0 where it has none.

    With ``dims`` the coordinates of these vectors on their first so many singular directions instead, for
    models that need far fewer dimensions than assets. They come from the inner products of the assets,
    so no vector is built; dimensions beyond the number of assets are 0.
    """
    day = returns.where(C("ts").isNotNull()).groupBy("symbol", "ts").agg(F.avg(value).alias("_v")).where("_v is not null")
    if dims is None:
        own = day.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("ts", "_v"))).alias("_m"))
        dates = day.agg(F.array_sort(F.collect_set("ts")).alias("_d"))  # one row, as long as a vector
        x = F.transform("_d", lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0.0)))
        return own.join(F.broadcast(dates)).select("symbol", array_to_vector(x).alias("features"))
    v = leading(pair_moments(durable(day), "_v"), dims, value="sxy")
    at = lambda i: F.coalesce(F.sum(F.when(C("component") == i, C("loading") * F.sqrt(F.greatest("value", F.lit(0.0))))), F.lit(0.0))
    return v.groupBy("symbol").agg(array_to_vector(F.array(*[at(i) for i in range(dims)])).alias("features"))


def cluster(vectors: DataFrame, k: int, method: str = "kmeans") -> DataFrame:
    est = {"kmeans": KMeans, "gmm": GaussianMixture, "hierarchical": BisectingKMeans}[method](k=k, seed=3, predictionCol="cluster")
    return est.fit(vectors).transform(vectors)


def choose_k(vectors: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Silhouette and within-cluster cost per k."""
    v = durable(vectors)
    ev = ClusteringEvaluator(predictionCol="cluster")
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=3, predictionCol="cluster").fit(v)
        rows.append((k, float(ev.evaluate(m.transform(v))), float(m.summary.trainingCost)))
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def dbscan(points: DataFrame, eps: float, least: int, key: str = "vec_id", vector: str = "x", cells: int = 1) -> DataFrame:
    """Density clusters of array points; noise is -1.

    Points are put in grid cells of width eps on their first ``cells`` coordinates; only neighbouring
    cells are compared, block by block (``core.density``), so no pair becomes a row. Core points are joined into components
    by passing on the smallest label, each round cut by a checkpoint. A border point joins the cluster of its nearest core.
    Rows of one key are one point with several places; rows without a key or with a component that is no number are noise.
    """
    rows, pairs = density.blocked(points, key, vector, eps, cells)
    of = rows.select("_r", C(key).alias("_k"))
    count = density.neighbour_counts(rows, pairs, eps).join(of, "_r").groupBy("_k").agg(F.sum("_n").alias("_n"))
    core = durable(count.where((C("_n") >= least) & C("_k").isNotNull()).select(C("_k").alias(key)))
    if core.isEmpty():
        return points.select(key, F.lit(-1).cast("long").alias("cluster"))
    inner = rows.join(core, key)
    name = lambda c, n: of.select(C("_r").alias(c), C("_k").alias(n))
    one = density.links(inner, pairs, eps).join(name("_u", "_a"), "_u").join(name("_v", "_b"), "_v").select(C("_a").alias(key), C("_b").alias("_o")).distinct()
    one = durable(one)
    edges = durable(one.unionByName(one.select(C("_o").alias(key), C(key).alias("_o"))).unionByName(core.select(key, C(key).alias("_o"))).distinct())
    label = durable(core.withColumn("label", C(key)))
    while True:
        nxt = edges.join(label.select(C(key).alias("_o"), "label"), "_o").groupBy(key).agg(F.min("label").alias("label"))
        # pointer jump: take the label of the label as well
        jump = nxt.join(label.select(C(key).alias("label"), C("label").alias("_l2")), "label", "left").select(key, F.least("label", F.coalesce("_l2", "label")).alias("label"))
        jump = durable(jump)
        moved = jump.join(label.select(key, C("label").alias("_was")), key).where(C("label") != C("_was")).limit(1).count()
        label = jump
        if not moved:
            break
    marked = rows.join(core.select(key, C(key).alias("_core")), key, "left")
    near = density.nearest_cores(marked, pairs, eps).join(of, "_r").groupBy("_k").agg(F.min_by("_o", F.struct("_d", "_o")).alias("_o"))
    border = near.join(label.select(C(key).alias("_o"), "label"), "_o").select(C("_k").alias(key), C("label").alias("_b"))
    out = points.select(key).join(label, key, "left").join(border, key, "left")
    return out.select(key, F.coalesce("label", "_b", F.lit(-1)).cast("long").alias("cluster"))


def cluster_summary(returns: DataFrame, labels: DataFrame, value: str = "ret") -> DataFrame:
    """Count, mean annual return and volatility, Sharpe and the first five names of each cluster."""
    a = returns.groupBy("symbol").agg((F.avg(value) * 252).alias("_r"), (F.stddev_samp(value) * F.sqrt(F.lit(252.0))).alias("_v"))
    j = a.join(labels, "symbol")
    from pyspark.sql import Window
    rn = F.row_number().over(Window.partitionBy("cluster").orderBy("symbol"))
    head = j.select("cluster", "symbol", rn.alias("_rn")).where(C("_rn") <= 5).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("symbol")), " ").alias("names"))
    g = j.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("_r").alias("mean_return"), F.avg("_v").alias("mean_volatility"))
    return g.withColumn("sharpe", C("mean_return") / C("mean_volatility")).join(head, "cluster")


def cluster_correlation(corr: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean pair correlation per cluster pair (an asset with itself included) from (a, b, corr), a <= b."""
    both = corr.select("a", "b", "corr").unionByName(corr.where("a <> b").select(C("b").alias("a"), C("a").alias("b"), "corr"))
    l = lambda n, c: labels.select(C("symbol").alias(n), C("cluster").alias(c))
    return both.join(l("a", "ca"), "a").join(l("b", "cb"), "b").groupBy("ca", "cb").agg(F.avg("corr").alias("corr"))


def kolmogorov_tail(x):
    """Chance that the limit of the scaled Kolmogorov-Smirnov gap exceeds ``x``; 1 below 0.2, where the series is slow."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * x * x))
    tail = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, F.lit(1.0)).when(x.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def autocorrelation_gap(real: DataFrame, synthetic: DataFrame, by: Sequence[str], value: str, lags: int = 20) -> DataFrame:
    """Mean absolute difference of the two autocorrelations per group, over lags 0 to ``lags`` that both series have.

    A correlation is the mean product of deviations from the series' mean, divided by its variance; 0 for a flat series.
    """
    by = list(by)

    def acf(d, name):
        m = d.where(C(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
        e = d.where(C(value).isNotNull()).join(m, by).withColumn("_e", C(value) - C("_mean"))
        e = over_rows(e, lambda x, w: x.withColumns({f"_l{i}": F.lag("_e", i).over(w) for i in range(1, lags + 1)}), back=lags, keys=by)
        one = lambda i: F.when(F.max("_var") > 0, F.avg(C("_e") * C(f"_l{i}")) / F.max("_var")).otherwise(F.when(F.count(f"_l{i}") > 0, 0.0))
        return e.groupBy(*by).agg(F.array(F.lit(0.0), *[one(i) for i in range(1, lags + 1)]).alias(name))  # lag 0 is 1 on both sides

    j = acf(real, "_r").join(acf(synthetic, "_s"), by)
    gaps = F.filter(F.zip_with("_r", "_s", lambda a, b: F.abs(a - b)), lambda x: x.isNotNull())
    return j.select(*by, (F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / F.size(gaps)).alias("acf_gap"))


def component_gap(real: DataFrame, synthetic: DataFrame, k: int = 5, value: str = "ret", order: str = "ts") -> DataFrame:
    """(component, variance_gap, ks, p): both panels on the components of the real one.

    Scores are floating sums, so equal panels may differ in their last bits and show a gap of one row.
    """
    scores, loadings, _, means = market_pca(real, k, value, order)
    long = lambda s: durable(s.select(F.posexplode("scores").alias("component", "score")))
    r, s = long(scores), long(component_scores(synthetic, loadings, means, k, value, order))
    var = lambda d, n: d.groupBy("component").agg(F.var_pop("score").alias(n))
    j = ks_statistic(r, s, ["component"], "score").join(var(r, "_r"), "component").join(var(s, "_s"), "component")
    return j.select("component", F.abs(C("_r") - C("_s")).alias("variance_gap"), "ks", "p")


def ks_statistic(real: DataFrame, synthetic: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Largest gap of the two empirical distribution functions per group, its p value, and mean and std gaps.

    The p value is that of the limit distribution for large samples.
    """
    by = list(by)
    r = real.select(*by, C(value).alias("_v"), F.lit(1).alias("_r"))
    s = synthetic.select(*by, C(value).alias("_v"), F.lit(0).alias("_r"))
    u = r.unionByName(s).groupBy(*by, "_v").agg(F.sum("_r").alias("_nr"), F.sum(1 - C("_r")).alias("_ns"))
    u = durable(u)
    t = u.groupBy(*by).agg(F.sum("_nr").alias("_tr"), F.sum("_ns").alias("_ts"))
    from ..core.slices import value_bin
    c = spread(u, keys=by, order=["_v"], bin=value_bin("_v")).run(_cr=("sum", C("_nr")), _cs=("sum", C("_ns"))).done()
    gap = c.join(t, by).groupBy(*by).agg(F.max(F.abs(C("_cr") / C("_tr") - C("_cs") / C("_ts"))).alias("ks"), F.max(C("_tr") * C("_ts") / (C("_tr") + C("_ts"))).alias("_n"))
    gap = gap.withColumn("p", kolmogorov_tail(F.sqrt("_n") * C("ks")))
    st = lambda d, p: d.groupBy(*by).agg(F.avg(value).alias(f"_m{p}"), F.stddev_samp(value).alias(f"_s{p}"))
    j = gap.join(st(real, "r"), by).join(st(synthetic, "s"), by)
    return j.select(*by, "ks", "p", F.abs(C("_mr") - C("_ms")).alias("mean_gap"), F.abs(C("_sr") - C("_ss")).alias("std_gap"))
