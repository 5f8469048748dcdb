"""MLlib learners, closed forms over grouped sums, and cross-validation loops.

Loops run over folds and candidates (a handful each); every fit and score inside them is a
Spark job over the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.operators.neighbours import nearest
from diurna.operators.ranking import one_row
from diurna.operators.screen import anova_f, best_k
from diurna.sources.carriers import stack_columns


def assemble(df: DataFrame, columns, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_class) as column ``weight``."""
    c = df.groupBy(label).agg(F.count("*").alias("_c"))
    t = c.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    w = c.transform(one_row, t).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(w, label)


# Registry: name -> estimator factory; a user adds an entry to plug in another learner.
LEARNERS = {
    "logistic": lambda **k: C.LogisticRegression(**{"maxIter": 50, "regParam": 0.01, **k}),
    "elastic": lambda **k: C.LogisticRegression(**{"maxIter": 50, "regParam": 0.05, "elasticNetParam": 0.5, **k}),
    "forest": lambda **k: C.RandomForestClassifier(**{"numTrees": 20, "maxDepth": 4, "seed": 7, **k}),
    "extra": lambda **k: C.RandomForestClassifier(**{"numTrees": 20, "maxDepth": 4, "seed": 7, "bootstrap": False, "featureSubsetStrategy": "sqrt", "maxBins": 8, **k}),
    "boosting": lambda **k: C.GBTClassifier(**{"maxIter": 8, "maxDepth": 3, "seed": 7, **k}),
    "svm": lambda **k: C.LinearSVC(**{"maxIter": 50, "regParam": 0.01, **k}),
    "tree": lambda **k: C.DecisionTreeClassifier(**{"maxDepth": 4, "seed": 7, **k}),
}


def fit_score(name: str, train: DataFrame, test: DataFrame, columns, label: str, weight: str | None = None, **params) -> DataFrame:
    """Fit on train, return test with ``score`` (probability, or margin for the SVM)."""
    est = LEARNERS[name](labelCol=label, featuresCol="features", **({"weightCol": weight} if weight else {}), **params)
    out = est.fit(assemble(train, columns)).transform(assemble(test, columns))
    return out.withColumn("score", vector_to_array("rawPrediction" if name == "svm" else "probability")[1]).drop("features", "rawPrediction", "probability")


def fit_probabilities(name: str, train: DataFrame, test: DataFrame, columns, label: str, classes: int, **params) -> DataFrame:
    model = LEARNERS[name](labelCol=label, featuresCol="features", **params).fit(assemble(train, columns))
    p = vector_to_array("probability")
    out = model.transform(assemble(test, columns))
    return out.withColumns({f"p{i}": p[i] for i in range(classes)}).drop("features", "rawPrediction", "probability")


def auc(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=label, numBins=0).evaluate(scored.withColumn(label, F.col(label).cast("double")))


def gaussian_nb(train: DataFrame, test: DataFrame, columns, label: str, classes, smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes from class moments: one aggregation, then a projection."""
    wide = train.groupBy(label).agg(F.count("*").alias("n"), *[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    rows = {r[label]: r.asDict() for r in wide.toLocalIterator()}  # one row per class
    top = train.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    eps = smoothing * max(top)
    total = sum(r["n"] for r in rows.values())

    def log_joint(k):
        r = rows[k]
        e = F.lit(float(np.log(r["n"] / total)))
        for c in columns:
            v = r[f"v_{c}"] + eps
            e = e - 0.5 * (float(np.log(2 * np.pi * v)) + (F.col(c) - r[f"m_{c}"]) * (F.col(c) - r[f"m_{c}"]) / v)
        return e

    d = test.withColumns({f"_l{k}": log_joint(k) for k in classes})
    top_l = F.greatest(*[F.col(f"_l{k}") for k in classes])
    norm = sum((F.exp(F.col(f"_l{k}") - top_l) for k in classes[1:]), F.exp(F.col(f"_l{classes[0]}") - top_l))
    return d.withColumns({f"p{k}": F.exp(F.col(f"_l{k}") - top_l) / norm for k in classes}).drop(*[f"_l{k}" for k in classes])


def selected_nb(train: DataFrame, test: DataFrame, columns, label: str, classes, k: int, min_variance: float = 1e-10) -> DataFrame:
    """Gaussian naive Bayes on the ``k`` columns of largest ANOVA F among those that vary in the train rows."""
    spread = train.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    varying = [c for c in columns if spread[c] is not None and spread[c] > min_variance]
    scores = anova_f(stack_columns(train, [label], varying, "feature"), [], "feature", label, "value")
    chosen = {r.feature for r in best_k(scores, [], "feature", "f_value", k).collect()}  # k names
    return gaussian_nb(train, test, [c for c in columns if c in chosen], label, classes)


def lda(train: DataFrame, test: DataFrame, columns, label: str, shrinkage: float = 0.1) -> DataFrame:
    """Linear discriminant with shrinkage: Spark sums, then a p x p solve on the driver."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    g = train.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    rows = {r[label]: r.asDict() for r in g.toLocalIterator()}  # one row per class
    n = sum(r["n"] for r in rows.values())
    p = len(columns)
    s = np.zeros((p, p))
    for r in rows.values():
        for a, b in pairs:
            i, j = columns.index(a), columns.index(b)
            s[i, j] += r["n"] * r[f"c_{a}_{b}"] / n
            s[j, i] = s[i, j]
    s = (1 - shrinkage) * s + shrinkage * np.trace(s) / p * np.eye(p)
    mu = {k: np.array([r[f"m_{c}"] for c in columns]) for k, r in rows.items()}
    w = np.linalg.solve(s, mu[1] - mu[0])
    b = -0.5 * float(w @ (mu[0] + mu[1])) + float(np.log(rows[1]["n"] / rows[0]["n"]))
    margin = sum((F.col(c) * float(x) for c, x in zip(columns, w)), F.lit(b))
    return test.withColumn("score", 1 / (1 + F.exp(-margin)))


def mlp(train: DataFrame, test: DataFrame, columns, label: str, hidden: int = 6, iterations: int = 30) -> DataFrame:
    est = C.MultilayerPerceptronClassifier(layers=[len(columns), hidden, 2], maxIter=iterations, seed=7, labelCol=label)
    out = est.fit(assemble(train, columns)).transform(assemble(test, columns))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def knn_vote(train: DataFrame, test: DataFrame, columns, row_id: str, label: str, k: int = 5) -> DataFrame:
    nn = nearest(test, train, columns, k, row_id, row_id)
    lab = train.select(F.col(row_id).alias("rid"), F.col(label).alias("_y"))
    v = nn.join(lab, "rid").groupBy("qid").agg(F.avg("_y").alias("score")).withColumnRenamed("qid", row_id)
    return test.join(v, row_id, "left")


def unsupervised(df: DataFrame, columns, components: int = 5, clusters: int = 3) -> DataFrame:
    """Principal components, cluster labels, distances to centres and mixture probabilities as columns."""
    d = assemble(df, columns)
    d = PCA(k=components, inputCol="features", outputCol="pcs").fit(d).transform(d)
    km = K.KMeans(k=clusters, seed=7, predictionCol="km").fit(d)
    d = km.transform(d)
    v = vector_to_array("features")
    for i, c in enumerate(km.clusterCenters()):
        centre = F.array(*[F.lit(float(x)) for x in c])
        d = d.withColumn(f"km_dist_{i}", F.sqrt(F.aggregate(F.zip_with(v, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    d = K.GaussianMixture(k=clusters, seed=7, probabilityCol="gmm_p", predictionCol="gmm").fit(d).transform(d)
    d = K.BisectingKMeans(k=clusters, seed=7, predictionCol="tree_label").fit(d).transform(d)
    g, pcs = vector_to_array("gmm_p"), vector_to_array("pcs")
    return d.withColumns({**{f"pc_{i}": pcs[i] for i in range(components)}, **{f"gmm_p_{i}": g[i] for i in range(clusters)}}).drop("features", "pcs", "gmm_p")


# ------------------------------------------------------------------ cross-validation
def oof(df: DataFrame, columns, label: str, fold: str, folds, learner: str, **params) -> DataFrame:
    """Out-of-fold scores over the listed folds."""
    out = None
    for f in folds:
        s = fit_score(learner, df.where(F.col(fold).isin([x for x in folds if x != f])), df.where(F.col(fold) == f), columns, label, **params)
        out = s if out is None else out.unionByName(s)
    return out


def choose(scores: dict[str, float], tolerance: float = 0.005) -> str:
    """First (simplest) candidate within the tolerance of the best."""
    best = max(scores.values())
    return next(k for k, v in scores.items() if v >= best - tolerance)


def nested_cv(df: DataFrame, label: str, fold: str, folds, candidates: dict[str, dict], tolerance: float = 0.005) -> DataFrame:
    """Candidate chosen by inner out-of-fold AUC inside each outer fold; outer scores with the choice."""
    out = None
    for f in folds:
        inner = [x for x in folds if x != f]
        tr = df.where(F.col(fold) != f)
        scores = {k: auc(oof(tr, c["columns"], label, fold, inner, c["learner"], **c.get("params", {})), label) for k, c in candidates.items()}
        pick = choose(scores, tolerance)
        c = candidates[pick]
        s = fit_score(c["learner"], tr, df.where(F.col(fold) == f), c["columns"], label, **c.get("params", {}))
        s = s.withColumns({"outer_fold": F.lit(f), "candidate": F.lit(pick), "inner_auc": F.lit(scores[pick])})
        out = s if out is None else out.unionByName(s)
    return out


def grid_search(df: DataFrame, columns, label: str, fold: str, folds: int, grid: dict[str, list]) -> DataFrame:
    """Mean AUC for each grid point with MLlib's cross-validator on given folds."""
    est = C.LogisticRegression(labelCol=label, maxIter=30)
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(est.getParam(k), v)
    maps = b.build()
    ev = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, foldCol=fold, parallelism=2)
    m = cv.fit(assemble(df.withColumn(label, F.col(label).cast("double")), columns))
    rows = [({p.name: float(v) for p, v in mp.items()}, float(a)) for mp, a in zip(maps, m.avgMetrics)]
    best = max(a for _, a in rows)
    return df.sparkSession.createDataFrame([(*[r[k] for k in grid], a, int(a == best)) for r, a in rows], ", ".join(f"{k} double" for k in grid) + ", auc double, best int")


def by_importance(df: DataFrame, columns, label: str) -> list[str]:
    m = LEARNERS["forest"](labelCol=label).fit(assemble(df, columns))
    return [columns[i] for i in np.argsort(-m.featureImportances.toArray(), kind="stable")]


def forward_path(df: DataFrame, columns, label: str, fold: str, folds, learner: str = "logistic") -> DataFrame:
    """Cross-validated AUC of the k most important features for each k."""
    order = by_importance(df, columns, label)
    rows = [(k, order[k - 1], auc(oof(df, order[:k], label, fold, folds, learner), label)) for k in range(1, len(order) + 1)]
    best = max(r[2] for r in rows)
    return df.sparkSession.createDataFrame([(*r, int(r[2] == best)) for r in rows], "k int, feature string, auc double, best int")


def elimination_order(df: DataFrame, columns, label: str, step: int = 5) -> DataFrame:
    """Features in the order a logistic model drops them by smallest |coefficient|; the survivors rank first."""
    left, gone = list(columns), []
    while left:
        m = LEARNERS["logistic"](labelCol=label).fit(assemble(df, left))
        order = [left[i] for i in np.argsort(np.abs(m.coefficients.toArray()), kind="stable")]
        drop = order[:step]
        gone += drop
        left = [c for c in left if c not in drop]
    n = len(gone)
    return df.sparkSession.createDataFrame([(c, n - i) for i, c in enumerate(gone)], "feature string, rank int")


def leakage_ladder(df: DataFrame, columns, label: str, fold: str, folds, keep: int, candidates: dict[str, dict]) -> DataFrame:
    """Same metric with selection and tuning inside folds (L0), selection outside (L1), both outside (L2)."""
    def select(d):
        f = anova_f(stack_columns(d, [label], columns, "feature"), [], "feature", label, "value")
        return [r.feature for r in f.orderBy(F.col("f_value").desc(), "feature").limit(keep).toLocalIterator()]

    l0 = None
    for f in folds:
        tr = df.where(F.col(fold) != f)
        cols, inner = select(tr), [x for x in folds if x != f]
        pick = choose({k: auc(oof(tr, cols, label, fold, inner, "logistic", **c), label) for k, c in candidates.items()})
        s = fit_score("logistic", tr, df.where(F.col(fold) == f), cols, label, **candidates[pick])
        l0 = s if l0 is None else l0.unionByName(s)
    cols = select(df)
    l1 = oof(df, cols, label, fold, folds, "logistic")
    tuned = {k: oof(df, cols, label, fold, folds, "logistic", **c) for k, c in candidates.items()}
    l2 = tuned[max(tuned, key=lambda k: auc(tuned[k], label))]
    parts = [(name, auc(d, label)) for name, d in (("L0", l0), ("L1", l1), ("L2", l2))]
    return df.sparkSession.createDataFrame([(n, a, a - parts[0][1]) for n, a in parts], "level string, auc double, gap double")


# ------------------------------------------------------------------ calibration
def per_group(calibrate, train: DataFrame, test: DataFrame, keys, score: str, label: str) -> DataFrame:
    """One calibration for each of the few combinations of the keys; without training rows ``calibrated`` is null."""
    fitted, out = {tuple(r) for r in train.select(*keys).distinct().collect()}, None
    for r in sorted(test.select(*keys).distinct().collect(), key=str):
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, r)])
        own = test.where(same)
        d = calibrate(train.where(same), own, score, label) if tuple(r) in fitted else own.withColumn("calibrated", F.lit(None).cast("double"))
        d = d.select(*test.columns, "calibrated")
        out = d if out is None else out.unionAll(d)
    return test.withColumn("calibrated", F.lit(None).cast("double")) if out is None else out


def platt(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """Logistic on the logit with unit C; identity when the slope is not positive."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-5)), F.lit(1e-5))
    logit = F.log(p / (1 - p))
    d = assemble(train.withColumn("_z", logit), ["_z"])
    m = C.LogisticRegression(labelCol=label, regParam=1.0 / max(1, train.count()), standardization=False, maxIter=100).fit(d)
    slope, b = float(m.coefficients[0]), float(m.intercept)
    if not slope > 0:
        return test.withColumn("calibrated", p)
    return test.withColumn("calibrated", F.greatest(F.least(1 / (1 + F.exp(-(slope * logit + b))), F.lit(1 - 1e-7)), F.lit(1e-7)))


def ordinal(train: DataFrame, test: DataFrame, columns, severity: str, strategy: str) -> DataFrame:
    """binary, ordinal (1 - P(class 0) of a 3-class fit) or hard_boundary (most severe class left out of training)."""
    if strategy == "ordinal":
        d = fit_probabilities("logistic", train, test, columns, severity, 3)
        return d.withColumn("score", 1 - F.col("p0")).drop("p0", "p1", "p2", "prediction")
    tr = train.where(F.col(severity) < 2) if strategy == "hard_boundary" else train
    y = (F.col(severity) > 0).cast("int")
    return fit_score("logistic", tr.withColumn("_y", y), test.withColumn("_y", y), columns, "_y").drop("_y", "prediction")


def linear_contributions(train: DataFrame, test: DataFrame, columns, row_id: str, label: str) -> DataFrame:
    """coefficient x standardised value per row and feature: exact for a linear model."""
    m = train.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()

    def z(d):
        return d.withColumns({c: (F.col(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0) for c in columns})

    coef = LEARNERS["logistic"](labelCol=label).fit(assemble(z(train), columns)).coefficients.toArray()
    d = z(test)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("z"), (F.col(c) * float(w)).alias("contribution")) for c, w in zip(columns, coef)])
    return d.select(row_id, F.inline(rows))
