"""Models on Spark's own learners: training, scoring over time grids, importance, sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.times import hourly_grid
from tidemark.operators.evaluate import regression_metrics
from tidemark.operators.targets import event_weights, group_time_split, prune_by_importance
from tidemark.sources.tables import scratch, stored


def grid_argmin(events: DataFrame, event: str, start: str, days: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each event the lowest score over the hours before its start (of equal ones, the latest hour), at least 0, its time, and six
    hours on either side. score adds ``predicted`` to rows with at (a time) and hours_before."""
    grid = events.withColumn("at", F.explode(hourly_grid(F.col(start), days)))
    grid = grid.withColumn("hours_before", F.expr(f"cast((unix_micros(cast({start} as timestamp)) - unix_micros(cast(at as timestamp))) / 3600000000 as bigint)"))
    best = score(grid).groupBy(event).agg(F.min(F.struct(F.greatest("predicted", F.lit(0.0)).alias("p"), F.col("hours_before").alias("h"), F.col("at").alias("t"))).alias("b"))
    six = F.expr("interval 6 hours")
    return best.select(event, F.col("b.p").alias("best_price"), F.col("b.h").alias("hours_before"), F.col("b.t").alias("best_at"), (F.col("b.t") - six).alias("window_from"), (F.col("b.t") + six).alias("window_to"))


def gap_model(numbers: list[str], categories: list[str], label: str, weight: str | None = None, validation: str | None = None, **settings) -> Pipeline:
    """M1: boosted trees on absolute loss; categories by target encoding, missing numbers by the median."""
    encoded = [f"{c}_te" for c in categories]
    stages: list = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_im" for c in numbers])]
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"{c}_ix" for c in categories], handleInvalid="keep")]
        stages += [TargetEncoder(inputCols=[f"{c}_ix" for c in categories], outputCols=encoded, labelCol=label, targetType="continuous", handleInvalid="keep", smoothing=10.0)]
        # the encoder leaves the nominal metadata of its input, which trees would take for categories
        from pyspark.ml.feature import SQLTransformer

        stages += [SQLTransformer(statement="SELECT *, " + ", ".join(f"{c} + 0.0D AS {c}_n" for c in encoded) + " FROM __THIS__")]
        encoded = [f"{c}_n" for c in encoded]
    stages += [VectorAssembler(inputCols=[f"{c}_im" for c in numbers] + encoded, outputCol="features")]
    more = {k: v for k, v in (("weightCol", weight), ("validationIndicatorCol", validation)) if v}
    stages += [GBTRegressor(labelCol=label, lossType="absolute", seed=1, **{"maxIter": 10, "maxDepth": 4, **more, **settings})]
    return Pipeline(stages=stages)


def with_missing_flags(df: DataFrame, numbers: list[str]) -> tuple[DataFrame, list[str]]:
    """M1: for each number a column that tells whether it is missing, and the names of those columns."""
    return df.withColumns({f"{c}_missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in numbers}), [f"{c}_missing" for c in numbers]


def fit_gap_model(
    rows: DataFrame, numbers: list[str], categories: list[str], label: str, event: str = "event_key", start: str = "start_ts", price: str = "lowest_price", validation: float = 0.1,
    cutoff: float | None = 0.95, pinned: tuple[str, ...] = (), **settings,
) -> tuple[PipelineModel, list[str]]:
    """M1 whole: missing flags; weights that balance events and favour low prices; the last share of the training events as validation, on
    which boosting stops early; and, with a cutoff, a second fit on the features that a first one found to matter (pinned ones always).

    Returns the model and its features. The training rows are written once, as all passes read them."""
    rows, flags = with_missing_flags(rows, numbers)
    rows = group_time_split(event_weights(rows, price, event), validation, event, start).withColumnRenamed("is_test", "is_validation")
    rows, numbers, categories = stored(rows, "training"), [*numbers, *flags], list(categories)
    how = dict(weight="weight", validation="is_validation", **settings)
    model = gap_model(numbers, categories, label, **how).fit(rows)
    if cutoff is not None:
        found = importances(model, rows).withColumn("feature", F.regexp_replace("feature", "_(im|te_n)$", "")).groupBy("feature").agg(F.sum("importance").alias("importance"))
        kept = {r.feature for r in prune_by_importance(found, cutoff, list(pinned)).where("kept").collect()}  # a row a feature
        fewer = [c for c in numbers if c in kept], [c for c in categories if c in kept]
        if fewer[0] and fewer != (numbers, categories):
            numbers, categories = fewer
            model = gap_model(numbers, categories, label, **how).fit(rows)
    return model, [*numbers, *categories]


def monotone_by_event(scored: DataFrame, event: str, hours: str, predicted: str) -> DataFrame:
    """Scores that do not fall as there are more hours left: each event's running largest one, from the fewest hours on. It is what a
    monotone constraint of the learner would give; rows of equal hours share a score."""
    w = Window.partitionBy(event).orderBy(hours).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return scored.withColumn(predicted, F.max(predicted).over(w))


def price_model(numbers: list[str], categories: list[str], label: str, trees: int = 300, depth: int = 5) -> Pipeline:
    """M2: a random forest; numbers by the median, categories one-hot with unseen values kept."""
    stages: list = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_im" for c in numbers])]
    stages += [StringIndexer(inputCols=categories, outputCols=[f"{c}_ix" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_ix" for c in categories], outputCols=[f"{c}_oh" for c in categories], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[f"{c}_im" for c in numbers] + [f"{c}_oh" for c in categories], outputCol="features")]
    stages += [RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=1)]
    return Pipeline(stages=stages)


def importances(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M4: feature, importance by the assembler's attribute names."""
    spark = rows.sparkSession
    attrs = model.transform(rows).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    values = model.stages[-1].featureImportances
    return spark.createDataFrame([(names[i], float(values[i])) for i in range(values.size)], "feature string, importance double")


def training_report(scored: DataFrame, label: str, predicted: str, absolute: float = 0.05, relative: float = 0.05) -> DataFrame:
    """One row."""
    return regression_metrics(scored, label, predicted, absolute, relative)


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: list[str], label: str, key: str, repeats: int = 3) -> DataFrame:
    """For each column how much the mean absolute error grows when its values change places, mean and deviation over repeats. Values
    go to the row of the same number in a random order: two numberings joined, within partitions of the key's hash."""
    spark = rows.sparkSession
    base = model.transform(rows).agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]
    out = []
    for c in columns:
        drops = []
        for r in range(repeats):
            part = F.pmod(F.xxhash64(key, F.lit(r)), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("__p")
            a = rows.withColumn("__p", part).withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
            b = rows.select(part, F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(key, F.lit(r + 100)))).alias("__n"), F.col(c).alias("__v"))
            moved = a.join(b, ["__p", "__n"]).withColumn(c, F.col("__v")).drop("__p", "__n", "__v")
            drops.append(model.transform(moved).agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0] - base)
        mean = sum(drops) / repeats
        out.append((c, mean, (sum((x - mean) ** 2 for x in drops) / repeats) ** 0.5))
    return spark.createDataFrame(out, "feature string, importance double, deviation double")


def partial_dependence(model: PipelineModel, rows: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """The mean prediction with each value of the grid put into all rows; the grid is a short list, exploded per row."""
    at = rows.drop(column).withColumn(column, F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    return model.transform(at).groupBy(column).agg(F.avg("prediction").alias("mean_prediction"))


def sweep(train: DataFrame, test: DataFrame, settings: dict[str, Pipeline], label: str) -> DataFrame:
    """Each setting's report, the best first."""
    out = None
    train = train.persist()
    for name, pipeline in settings.items():
        row = training_report(pipeline.fit(train).transform(test), label, "prediction").withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    train.unpersist()  # reports read the test rows only
    return rank_runs(out)


def rank_runs(runs: DataFrame) -> DataFrame:
    """By share within tolerance, then by error; the number of runs is that of settings."""
    return runs.orderBy(F.col("within_rel").desc(), F.col("mae"), "run")


def event_sequences(df: DataFrame, event: str, ts: str, tie: str, features: list[str], least: int = 2) -> DataFrame:
    """Per event its observations in order, as arrays of values (0 for missing ones) and of masks; events of one row are left out. A
    sequence is one row by its nature; it has one event's observations."""
    rows = df.groupBy(event).agg(F.array_sort(F.collect_list(F.struct(ts, tie, *features))).alias("rows")).where(F.size("rows") >= least)
    values = F.transform("rows", lambda r: F.array(*(F.coalesce(r[f].cast("double"), F.lit(0.0)) for f in features)))
    masks = F.transform("rows", lambda r: F.array(*(r[f].isNotNull().cast("int") for f in features)))
    return rows.select(event, F.size("rows").alias("length"), values.alias("features"), masks.alias("masks"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Values numbered from 1 in alphabetical order; 0 stands for unknown ones. Numbers over ranges, which
    are written once so that both passes see the same ones: no single partition sorts all."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().repartitionByRange("value").withColumn("__p", F.spark_partition_id())
    path = scratch(df.sparkSession, "vocabulary")
    values.write.parquet(path)
    values = df.sparkSession.read.parquet(path)
    counts = values.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return values.join(F.broadcast(before), "__p").select("value", (F.row_number().over(Window.partitionBy("__p").orderBy("value")) + F.col("__before")).cast("long").alias("index"))


def encode(df: DataFrame, column: str, vocab: DataFrame, to: str) -> DataFrame:
    """The number of a value, 0 for unknown and missing ones."""
    return df.join(vocab.withColumnRenamed("value", column), column, "left").withColumn(to, F.coalesce("index", F.lit(0))).drop("index")
