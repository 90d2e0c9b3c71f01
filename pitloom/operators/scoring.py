"""Training, evaluation and batch scoring on Spark.

Training uses Spark ML (``RandomForestClassifier``, distributed tree induction)
on the W2 hold-out; metrics are A4-A6 computed as aggregates over the scored
validation rows. Batch scoring is ``PipelineModel.transform``; any other Python
model plugs in through ``score_with_pandas`` (``mapInPandas``, Arrow batches).

Spark's forest keeps a bootstrap count and a node per row and tree, and passes over them at every level. A tree sees
of a row only its bins and its class, so where there are few bins, rows beyond ``ROW_TREES`` are first counted by
bins and class (``_cell_forest``): every row counts, and the trees are those of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, inf, isfinite, nextafter
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.operators.metrics import accuracy, confusion, log_loss, stratified_split
from pitloom.session import ensure_checkpoint_dir, scratch_path

MODEL_IMPLEMENTATION = "spark-random-forest-1"

# Bins of a feature, Spark's default.
BINS = 32
# Rows times trees up to which Spark's forest takes the rows themselves.
ROW_TREES = 64 << 20
# Cells (bins of every feature, and class) up to which rows are counted instead.
CELLS = 1 << 16
# Trees that grow side by side on the cells.
TREES_AT_ONCE = 8


@dataclass(frozen=True)
class TrainingResult:
    model: PipelineModel
    metrics: DataFrame  # one row: accuracy, macro_f1, log_loss, validation_rows, train_rows
    holdout: DataFrame  # the rows the metrics were taken on


def constant_baseline(frame: DataFrame, cls: str) -> DataFrame:
    """M2: the constant-class champion."""
    return frame.withColumn("prediction_class", F.lit(cls))


def _feature_vector(frame: DataFrame, features: Sequence[str] | str) -> tuple[DataFrame, list]:
    """A vector column from an array column or from numeric columns."""
    if isinstance(features, str):
        return frame.withColumn("__features", array_to_vector(F.col(features))), []
    return frame, [VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error")]


def training_tasks(rows: int, width: float, task_bytes: int, max_tasks: int) -> int:
    """Partitions of the training rows: by their vectors' bytes, and for small tables some tasks of 250 rows or more."""
    by_bytes = ceil(rows * (8 * width + 64) / task_bytes)
    return max(1, min(max_tasks, max(by_bytes, min(32, rows // 250))))


def train_classifier(
    training: DataFrame,
    *,
    features: Sequence[str] | str,
    label: str = "quantity_class",
    key: Sequence[str],
    seed: int = 17,
    num_trees: int = 160,
    max_depth: int = 12,
    min_rows: int = 12,
    task_bytes: int = 64 << 20,
    max_tasks: int = 20_000,
    row_trees: int = ROW_TREES,
) -> TrainingResult:
    """M1: stratified 25 % hold-out (W2), random forest, metrics on the hold-out.

    ``task_bytes`` is what the feature vectors of one task hold on average, ``max_tasks`` the most tasks of a tree level.
    More rows times trees than ``row_trees``, with no more than ``CELLS`` cells, train on counted cells.
    """
    width = F.avg(F.size(features)) if isinstance(features, str) else F.max(F.lit(float(len(features))))
    support = training.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k"), width.alias("width")).first()
    if support["n"] < min_rows:
        raise ValueError(f"a stratified hold-out needs {min_rows} labelled rows, not {support['n']}")
    if support["k"] < 2:
        raise ValueError(f"a classifier needs two classes to tell apart; {label} has {support['k']}")
    labelled = training.withColumn(label, F.col(label).cast("string"))
    # Tree induction passes over its input many times: cut the lineage once, into the
    # shared checkpoint folder (survives executor loss, unlike a local checkpoint).
    ensure_checkpoint_dir(training.sparkSession)
    few = not isinstance(features, str) and BINS ** len(features) * support["k"] <= CELLS
    if few and support["n"] * num_trees > row_trees:
        path = scratch_path(training.sparkSession, "split")  # read column by column, again and again
        dealt = stratified_split(labelled, label, list(key), seed=seed, few=True)
        dealt.write.parquet(path)
        split = training.sparkSession.read.schema(dealt.schema).parquet(path)
        cuts = cut_points(split.where(F.col("split") == "train"), features)
        if cuts is not None:
            return _cell_forest(split, cuts, features, label, seed=seed, num_trees=num_trees, max_depth=max_depth)
    # Tree induction runs one task per input partition at every level, and draws its samples
    # per partition. Rows are dealt by their key and sorted there, so the model depends on the rows alone, not on the cluster.
    parts = training_tasks(support["n"], support["width"], task_bytes, max_tasks)
    dealt = stratified_split(labelled, label, list(key), seed=seed).repartition(parts, *key).sortWithinPartitions(*key)
    split = dealt.checkpoint(eager=True)
    frame, stages = _feature_vector(split, features)
    # The label index is fitted on every labelled row, so a class that the hold-out puts
    # only in validation (a class of one row) still has an index; the forest gives it 0.
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(frame)
    forest = RandomForestClassifier(
        featuresCol="__features",
        labelCol="__label",
        numTrees=num_trees,
        maxDepth=max_depth,
        minInstancesPerNode=1,
        seed=seed,
        maxMemoryInMB=1024,  # larger node groups: fewer passes per tree level
        cacheNodeIds=True,
        checkpointInterval=10,
        probabilityCol="__probability",
        rawPredictionCol="__raw",
        predictionCol="__prediction",
    )
    train = frame.where(F.col("split") == "train")
    model = Pipeline(stages=[*stages, indexer, forest]).fit(train)
    labels = indexer.labels
    decoded = IndexToString(inputCol="__prediction", outputCol="prediction_class", labels=labels)
    validation = decoded.transform(model.transform(frame.where(F.col("split") == "validation")))
    p_true = F.element_at(vector_to_array(F.col("__probability")), F.col("__label").cast("int") + 1)
    scored = validation.select(label, "prediction_class", p_true.alias("p_true"))
    conf = confusion(scored, "prediction_class", label)
    f1 = conf.agg(F.avg("f1").alias("macro_f1"))
    base = scored.agg(
        accuracy(scored, "prediction_class", label).alias("accuracy"),
        log_loss(F.col("p_true")).alias("log_loss"),
        F.count(F.lit(1)).alias("validation_rows"),
    )
    rows = train.agg(F.count(F.lit(1)).alias("train_rows"))
    metrics = (
        base.unionByName(f1, allowMissingColumns=True)
        .unionByName(rows, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("accuracy", "macro_f1", "log_loss", "validation_rows", "train_rows")])
    )
    # The scoring model needs no label: features (assembler if any) -> forest -> class text.
    scoring = PipelineModel(stages=[*model.stages[: len(stages)], model.stages[-1], decoded])
    return TrainingResult(model=scoring, metrics=metrics, holdout=split.where(F.col("split") == "validation"))


def cut_points(frame: DataFrame, features: Sequence[str], bins: int = BINS, parts: int = 256, rounds: int = 12) -> list[list[float]] | None:
    """Per feature, up to ``bins - 1`` values that cut the rows evenly, between two values that occur; None if a value is infinite.

    Rows are counted in buckets of a grid, with the least and greatest value in each. A bucket of more than 1/256 of the rows
    and of several values gets a finer grid, until there is none. All rows take part, and the result does not depend on
    their order or on the tasks. As in Spark's forest a null or NaN fails, and few values are all told apart.
    """
    bad = [F.count_if(F.col(f).isNull() | F.isnan(f)) for f in features]
    ends = frame.agg(F.count(F.lit(1)), *bad, *[g(F.col(f).cast("double")) for f in features for g in (F.min, F.max)]).first()
    if any(ends[1 : len(features) + 1]):
        raise ValueError(f"a training feature is null or not a number: {', '.join(features)}")
    spans = [tuple(ends[len(features) + 1 + 2 * i :][:2]) for i in range(len(features))]
    if not all(v is not None and isfinite(v) and isfinite(2 * v) for span in spans for v in span):
        return None
    edges = [_grid(lo, hi, parts) for lo, hi in spans]
    for _ in range(rounds):
        binned = _bucketizer(features, edges).transform(frame)
        each = F.array(
            *[F.struct(F.lit(i).alias("i"), F.col(f"__bin_{i}").alias("b"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]
        )
        counted = binned.select(F.inline(each)).groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = sorted(counted.collect(), key=lambda r: (r["i"], r["b"]))  # parts times bins of a feature, or fewer
        buckets = [[r for r in found if r["i"] == i] for i in range(len(features))]
        finer = [[_grid(r["lo"], r["hi"], parts) for r in b if r["n"] * parts > ends[0] and r["lo"] < r["hi"]] for b in buckets]
        if not any(finer):
            break
        edges = [sorted({*_between(b), *(x for grid in new for x in grid)}) for b, new in zip(buckets, finer, strict=True)]
    return [_even(b, bins, ends[0]) for b in buckets]


def _grid(lo: float, hi: float, parts: int) -> list[float]:
    return sorted({float(x) for x in np.linspace(lo, hi, parts + 1)[:-1]})


def _between(buckets: Sequence) -> list[float]:
    """Halfway between neighbouring buckets, as Spark's forest places its splits."""
    return [max(a["hi"], min(a["hi"] / 2 + b["lo"] / 2, nextafter(b["lo"], -inf))) for a, b in zip(buckets, buckets[1:])]


def _even(buckets: Sequence, bins: int, rows: int) -> list[float]:
    """Those places between buckets that come nearest to even shares of the rows."""
    places = _between(buckets)
    if len(places) < bins:
        return places
    below = np.cumsum([r["n"] for r in buckets])[:-1]
    return sorted({places[int(np.argmin(np.abs(below - rows * k / bins)))] for k in range(1, bins)})


def _bucketizer(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> Bucketizer:
    """Bins of (cut, next cut], as a tree's splits read; a null or NaN fails."""
    # Its buckets are [split, next split), and there must be one split.
    splits = [[-inf, *(nextafter(c, inf) for c in cs or [0.0]), inf] for cs in cuts]
    return Bucketizer(
        inputCols=list(features), outputCols=[f"__bin_{i}" for i in range(len(features))], splitsArray=splits, handleInvalid="error"
    )


def _cell_forest(
    split: DataFrame, cuts: Sequence[Sequence[float]], features: Sequence[str], label: str, *, seed: int, num_trees: int, max_depth: int
) -> TrainingResult:
    """The forest and its metrics from rows counted by bins, class and side of the split.

    A bootstrap draws each row a Poisson(1) number of times for each tree, so a cell of n rows is drawn a Poisson(n) number
    of times: the draws that the trees of all rows see. Each tree is grown by Spark on the cells weighted by its draws.
    """
    bucketizer = _bucketizer(features, cuts)
    bins = bucketizer.getOutputCols()
    binned = bucketizer.transform(split).groupBy("split", *bins, label).agg(F.count(F.lit(1)).alias("__n"))
    # CELLS on each side at most. The number is known here; a tree's tasks take some thousand cells.
    cells = binned.checkpoint(eager=True)
    tasks = ceil(cells.count() / 8192)
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(cells)
    labels = indexer.labels
    assembler = VectorAssembler(inputCols=bins, outputCol="__features", handleInvalid="error")
    indexed = indexer.transform(cells)

    def draw(batches):
        for pdf in batches:
            cell = pdf[["__label", *bins]].to_numpy().astype(int)
            pdf["__drawn"] = [np.random.default_rng([seed, *c]).poisson(n, num_trees) for c, n in zip(cell, pdf["__n"], strict=True)]
            yield pdf[["__label", *bins, "__drawn"]]

    schema = ", ".join(f"{c} double" for c in ["__label", *bins]) + ", __drawn array<bigint>"
    train = indexed.where(F.col("split") == "train").select("__label", *bins, "__n").repartition(tasks, *bins)
    drawn = train.mapInPandas(draw, schema).checkpoint(eager=True)
    # The class column keeps the indexer's metadata, which tells the trees the number of classes.
    classes = indexed.schema["__label"].metadata

    def grow(tree: int):
        weighted = drawn.withColumn("__weight", F.col("__drawn")[tree].cast("double")).where(F.col("__weight") > 0)
        forest = RandomForestClassifier(
            featuresCol="__features",
            labelCol="__label",
            weightCol="__weight",
            numTrees=1,
            bootstrap=False,
            featureSubsetStrategy="sqrt" if num_trees > 1 else "all",
            maxDepth=max_depth,
            maxBins=1 << 9,  # a bin has a value of its own; more than CELLS in square, so that none is left out
            minInstancesPerNode=1,
            seed=seed + tree,
            maxMemoryInMB=1024,
        )
        points = assembler.transform(weighted).select("__features", F.col("__label").alias("__label", metadata=classes), "__weight")
        return forest.fit(points)

    with ThreadPool(min(TREES_AT_ONCE, num_trees)) as pool:
        trees = pool.map(inheritable_thread_target(split.sparkSession)(grow), range(num_trees), chunksize=1)
    model = _forest(trees, split, seed=seed, max_depth=max_depth)
    decoded = IndexToString(inputCol="__prediction", outputCol="prediction_class", labels=labels)
    validation = indexed.where(F.col("split") == "validation").select(label, "__label", *bins, "__n")
    scored = decoded.transform(model.transform(assembler.transform(validation)))
    p_true = F.element_at(vector_to_array(F.col("__probability")), F.col("__label").cast("int") + 1)
    scored = scored.select(label, "prediction_class", p_true.alias("p_true"), "__n")
    n = F.col("__n")
    f1 = confusion(scored, "prediction_class", label, n).agg(F.avg("f1").alias("macro_f1"))
    base = scored.agg(
        accuracy(scored, "prediction_class", label, n).alias("accuracy"),
        log_loss(F.col("p_true"), weight=n).alias("log_loss"),
        F.coalesce(F.sum(n), F.lit(0)).alias("validation_rows"),
    )
    rows = indexed.where(F.col("split") == "train").agg(F.coalesce(F.sum(n), F.lit(0)).alias("train_rows"))
    metrics = (
        base.unionByName(f1, allowMissingColumns=True)
        .unionByName(rows, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("accuracy", "macro_f1", "log_loss", "validation_rows", "train_rows")])
    )
    scoring = PipelineModel(stages=[bucketizer, assembler, model, decoded])
    return TrainingResult(model=scoring, metrics=metrics, holdout=split.where(F.col("split") == "validation"))


def _forest(
    trees: Sequence[RandomForestClassificationModel], frame: DataFrame, *, seed: int, max_depth: int
) -> RandomForestClassificationModel:
    """One forest of forests of one tree each (Spark's own model class, by the constructor that its trainer calls)."""
    context = frame.sparkSession.sparkContext
    package = context._jvm.org.apache.spark.ml.classification
    every = context._gateway.new_array(package.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        every[i] = tree._java_obj.trees()[0]
    made = package.RandomForestClassificationModel(trees[0].uid, every, trees[0].numFeatures, trees[0].numClasses)
    for name, value in (("numTrees", len(trees)), ("maxDepth", max_depth), ("seed", seed)):
        made.set(made.getParam(name), value)
    model = RandomForestClassificationModel(made)
    model.setFeaturesCol("__features").setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return model.setPredictionCol("__prediction")


def batch_score(
    model: PipelineModel,
    frame: DataFrame,
    *,
    features: Sequence[str] | str,
    entity: str = "entity_id",
    timestamp: str = "feature_ts",
    correlation: str = "correlation_id",
    batch: str = "source_batch_id",
) -> DataFrame:
    """M3: score a population and emit the five text columns of the scorer contract."""
    wanted = [entity, timestamp, correlation, batch, *([features] if isinstance(features, str) else features)]
    missing = [c for c in wanted if c not in frame.columns]
    if missing:
        raise ValueError(f"the scorer needs {', '.join(missing)}, which the batch does not have")
    vec = frame.withColumn("__features", array_to_vector(F.col(features))) if isinstance(features, str) else frame
    scored = model.transform(vec)
    return scored.select(
        F.col(entity).cast("string").alias("entity_id"),
        F.col(timestamp).cast("string").alias("prediction_ts"),
        F.col(batch).cast("string").alias("source_batch_id"),
        F.col(correlation).cast("string").alias("correlation_id"),
        F.col("prediction_class").cast("string").alias("prediction_class"),
    )


def score_with_pandas(
    frame: DataFrame,
    predict: Callable[[pd.DataFrame], pd.Series],
    *,
    features: Sequence[str],
    keys: Sequence[str] = ("entity_id", "feature_ts", "source_batch_id", "correlation_id"),
) -> DataFrame:
    """Any Python model over Arrow batches; batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``. Output: keys as text + class."""
    missing = [c for c in (*keys, *features) if c not in frame.columns]
    if missing:
        raise ValueError(f"the scorer needs {', '.join(missing)}, which the batch does not have")
    out_schema = ", ".join(
        [f"{k if k != 'feature_ts' else 'prediction_ts'} string" for k in keys] + ["prediction_class string"]
    )

    def run(batches):
        for pdf in batches:
            pred = pd.Series(predict(pdf.loc[:, list(features)])).astype(str).to_numpy()
            out = pdf.loc[:, list(keys)].astype(str)
            out.columns = [k if k != "feature_ts" else "prediction_ts" for k in keys]
            out["prediction_class"] = pred
            yield out

    return frame.select(*keys, *features).mapInPandas(run, out_schema)
