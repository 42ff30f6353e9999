"""Clustering and classification with Spark ML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.joins import sized_join
from tidemill.sources.scratch import materialise

#: Deepest tree there is; stands for "unlimited".
DEEPEST = 30
#: Split candidates of a feature; one with more different values is thinned to so many.
BINS = 256
CENTRES = "cluster int, centre array<double>, size long"


def kmeans(vectors: DataFrame, key: str, vector: str, k: int = 3, seed: int | None = None, starts: int = 3) -> tuple[DataFrame, DataFrame]:
    """``key, vector, cluster`` and ``cluster, centre, size``: the cheapest of ``starts`` seeded runs. Rows whose vector
    is NULL or holds a NULL are left out."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("the number of clusters must be a whole number above 0")
    if seed is not None and not isinstance(seed, int):
        raise ValueError("the seed must be a whole number")
    clean = vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    rows = clean.select(key, F.col(vector).alias("vector"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    # no more clusters than different vectors; Spark's k-means needs two of them
    different = rows.select("vector").distinct().limit(k).count()
    if different <= 1 or k == 1:
        cells = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()
        one = [(0, [r["x"] for r in cells], rows.count())] if cells else []
        return rows.select(key, "vector", F.lit(0).alias("cluster")), vectors.sparkSession.createDataFrame(one, CENTRES)
    k, first = min(k, different), 0 if seed is None else seed
    fits = [KMeans(k=k, seed=first + i, maxIter=50).fit(rows) for i in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    members = model.transform(rows).select(key, "vector", F.col("prediction").alias("cluster"))
    sizes = dict(enumerate(model.summary.clusterSizes))
    centres = [(i, [float(x) for x in c], int(sizes.get(i, 0))) for i, c in enumerate(model.clusterCenters())]
    return members, vectors.sparkSession.createDataFrame(centres, CENTRES)


def pattern_vectors(locations: DataFrame) -> DataFrame:
    """``pattern_id, paa``: the mean of the averages of each pattern's windows, place by place. ``locations`` has
    ``pattern_id, location.paa``."""
    cells = locations.select("pattern_id", F.posexplode("location.paa").alias("at", "x"))
    means = cells.groupBy("pattern_id", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("pattern_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("paa")
    )


def _sums(points: DataFrame, size: int, middle: np.ndarray | None = None) -> np.ndarray:
    """Of ``v`` the sums and last the number of rows; with ``middle`` the sums of products of deviations from it. Each
    partition gives its own sums, which are added up in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1 if middle is None else size * size)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += [*x.sum(axis=0), len(x)] if middle is None else ((x - middle).T @ (x - middle)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "x"])

    rows = points.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["at"])])


def project(members: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """``key, cluster, x, y`` of members and (NULL key) centres: classical scaling of their Euclidean distances to two
    dimensions, which is the projection on their principal axes. Means and products are summed in the plan, and only
    these come to the driver; the number of vectors isn't limited."""
    kind = members.schema[key].dataType
    points = members.select(key, F.col("cluster").cast("int").alias("cluster"), F.col("vector").cast("array<double>").alias("v")).unionByName(
        centres.select(F.lit(None).cast(kind).alias(key), "cluster", F.col("centre").alias("v"))
    )
    some = members.select(F.size("vector").alias("n")).first()
    if some is None:
        return points.select(key, "cluster", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where(F.lit(False))
    sums = _sums(points, some["n"])
    middle = sums[:-1] / sums[-1]
    _, axes = np.linalg.eigh(_sums(points, some["n"], middle).reshape(len(middle), -1))
    axes = axes.T[::-1][:2]
    axes = np.vstack([axes, np.zeros((2 - len(axes), len(middle)))])
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    at = F.zip_with("v", F.array(*(F.lit(float(x)) for x in middle)), lambda x, m: x - m)
    along = [F.aggregate(F.zip_with(at, F.array(*(F.lit(float(x)) for x in axis)), lambda x, e: x * e), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    flat = points.select(key, "cluster", along[0].alias("x"), along[1].alias("y"))
    ends = flat.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    turn = [-1.0 if -ends[k] > ends[k + 1] * (1 + 1e-9) else 1.0 for k in (0, 2)]  # signs are free: fixed here
    return flat.withColumns({"x": F.col("x") * turn[0], "y": F.col("y") * turn[1]})


def _features(population: DataFrame, target: str, identifier: str | None) -> list[str]:
    if target not in population.columns or (identifier and identifier not in population.columns):
        raise ValueError("the target or identifier column is missing")
    return [c for c in population.columns if c not in (target, identifier)]


def _prepared(population: DataFrame, target: str, features: Sequence[str], balanced: bool) -> DataFrame:
    rows = population.select(
        F.col(target).cast("string").alias("label_text"), *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in features)
    ).dropna()
    if not balanced:
        return rows.withColumn("weight", F.lit(1.0))
    counts = rows.groupBy("label_text").agg(F.count(F.lit(1)).alias("n_c"))
    n, k = counts.agg(F.sum("n_c"), F.count(F.lit(1))).first()
    weights = counts.select("label_text", (F.lit(float(n or 0)) / (F.lit(k) * F.col("n_c"))).alias("weight"))
    return sized_join(rows, weights, "label_text")


def tree_fit(population: DataFrame, target: str, identifier: str | None = None, max_depth: int | None = None, balanced: bool = False, bins: int = BINS):
    """A fitted pipeline of a gini decision tree over all other columns as numbers. Depth 0 or None is unlimited. With at
    least as many ``bins`` as a feature has different values every split between two of them is tried."""
    features = _features(population, target, identifier)
    rows = _prepared(population, target, features, balanced)
    stages = [
        StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
        DecisionTreeClassifier(maxDepth=min(max_depth or DEEPEST, DEEPEST), maxBins=bins, weightCol="weight", seed=0),
    ]
    return Pipeline(stages=stages).fit(rows)


def tree_dot(model, features: Sequence[str]) -> str:
    """The tree as graphviz text."""
    labels, tree = model.stages[0].labels, model.stages[-1]
    lines, nodes, depth_of = ["digraph Tree {", "node [shape=box] ;"], 0, []
    for line in tree.toDebugString.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip())) // 1
        text = line.strip()
        if text.startswith("Else"):
            while depth_of and depth_of[-1][0] > depth:
                depth_of.pop()
            continue
        name = re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], text)
        name = re.sub(r"Predict: ([\d.]+)", lambda m: f"class = {labels[int(float(m.group(1)))]}", name)
        lines.append(f'{nodes} [label="{name.removeprefix("If ")}"] ;')
        while depth_of and depth_of[-1][0] >= depth:
            depth_of.pop()
        if depth_of:
            lines.append(f"{depth_of[-1][1]} -> {nodes} ;")
        depth_of.append((depth, nodes))
        nodes += 1
    return "\n".join([*lines, "}"])


def tree_predict(model, population: DataFrame, target: str, identifier: str | None = None) -> DataFrame:
    """``actual, predicted`` per row with a readable population row."""
    features = _features(population, target, identifier)
    rows = _prepared(population, target, features, False)
    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    predicted = F.element_at(labels, F.col("prediction").cast("int") + 1)
    return model.transform(rows).select(F.col("label_text").alias("actual"), predicted.alias("predicted"))


def confusion(predictions: DataFrame, limit: int = 1000) -> DataFrame:
    """``actual, predicted, n`` of all pairs of classes that occur on either side, 0 included. At most ``limit`` classes."""
    names = predictions.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct().orderBy("c").limit(limit + 1).collect()
    if len(names) > limit:
        raise ValueError(f"more than {limit} classes")
    cells = predictions.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    classes = predictions.sparkSession.createDataFrame([(r["c"],) for r in names], "actual string")
    every = classes.select("actual", F.explode(F.array(*(F.lit(r["c"]) for r in names))).alias("predicted")) if names else cells.select("actual", "predicted")
    return every.join(cells, ["actual", "predicted"], "left").fillna(0, subset=["n"])


def accuracy(predictions: DataFrame) -> float:
    return predictions.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]


def depths_of(text: str) -> list[int]:
    """Depths from ``"3;5;0"`` or ``"range(4)"`` or ``"range(2,6)"``; 0 is unlimited."""
    if found := re.fullmatch(r"\s*range\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*", text):
        low, high = (0, int(found[1])) if found[2] is None else sorted((int(found[1]), int(found[2])))
        return list(range(low, high))
    return [int(x) for x in text.split(";") if x.strip()]


def tree_grid(population: DataFrame, target: str, identifier: str | None = None, depths: str = "3;5", balancing: str = "False", folds: int = 3, bins: int = BINS) -> tuple[DataFrame, str]:
    """``rank, max_depth, balancing, mean_score, std_score`` of each setting over stratified folds, best first, and the
    best setting as JSON. ``depths`` as in ``depths_of``, ``balancing`` as ``"True;False"``."""
    features = _features(population, target, identifier)
    rows = []
    for balanced in [x.strip() == "True" for x in balancing.split(";")]:
        data = _prepared(population, target, features, balanced)
        # stratified: rows of a class take the folds in turn within small parts of it, which are ordered apart
        hashed = data.withColumn("h", F.xxhash64("label_text", *features)).withColumn("part", F.pmod(F.shiftright("h", 7), F.lit(1024)))
        turn = F.row_number().over(Window.partitionBy("label_text", "part").orderBy("h")) + F.col("part")
        buckets = hashed.withColumn("fold", F.pmod(turn, F.lit(folds)).cast("int")).drop("h", "part")
        buckets = materialise(buckets, "folds")  # read by every fit
        tree = DecisionTreeClassifier(maxBins=bins, weightCol="weight", seed=0)
        steps = [
            StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(features), outputCol="features"),
        ]
        ready = Pipeline(stages=steps).fit(buckets).transform(buckets)
        wanted = depths_of(depths)
        grid = ParamGridBuilder().addGrid(tree.maxDepth, [min(d or DEEPEST, DEEPEST) for d in wanted]).build()
        scorer = MulticlassClassificationEvaluator(metricName="accuracy")
        fit = CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, foldCol="fold", parallelism=2, seed=0).fit(ready)
        rows += [(d, balanced, float(m), float(s)) for d, m, s in zip(wanted, fit.avgMetrics, fit.stdMetrics, strict=True)]
    rows.sort(key=lambda r: (-r[2], r[0] or DEEPEST, r[1]))
    ranked = [(1 + sum(o[2] > r[2] for o in rows), *r) for r in rows]
    best = json.dumps({"max_depth": rows[0][0] or None, "balancing": rows[0][1]})
    schema = "rank int, max_depth int, balancing boolean, mean_score double, std_score double"
    return population.sparkSession.createDataFrame(ranked, schema), best


__all__ = [
    "accuracy", "confusion", "depths_of", "kmeans", "pattern_vectors", "project", "tree_dot", "tree_fit", "tree_grid", "tree_predict",
]
