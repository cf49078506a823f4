"""M2: forecasts of daily sales.

A series is gap-filled (a row for every calendar day of its span), so its
length is bounded by the calendar and windows over one series are small.
The trend is a least-squares line from exact whole sums; lag features feed
linear and forest regressors of ``pyspark.ml``, judged on rolling origins:
each fold trains on all days before its cut and is tested on the horizon
after it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAGS = (1, 7, 28)
MEANS = (7, 28)
FOLDS = 3
HORIZON = 28
SEED = 7


def daily_series(scan: DataFrame, key: str | None = None) -> DataFrame:
    """(series, day, t, total): the daily totals of each value of ``key``
    (NULL dropped; without a key one series, 'all') from its first to its
    last day with sales, 0 on days without, t counting from 0."""
    name = F.lit("all") if key is None else F.col(key)
    totals = scan.select(name.alias("series"), F.to_date("sales_date").alias("day"), "sales_amount").where("series IS NOT NULL AND day IS NOT NULL") \
        .groupBy("series", "day").agg(F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total"))
    span = totals.groupBy("series").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.select("series", "first", F.explode(F.sequence("first", "last")).alias("day"))
    return days.join(totals, ["series", "day"], "left").select(
        "series", "day", F.date_diff("day", "first").cast("long").alias("t"), F.coalesce("total", F.lit(0)).cast("decimal(28,2)").alias("total"))


def trend(series: DataFrame) -> DataFrame:
    """Per series: days, slope (a day), intercept (at t = 0) and r2 of the
    least-squares line through its totals.  With u = 2 t - (days - 1), whose
    sum is 0, all sums are whole numbers of cents."""
    sized = series.withColumn("days", F.count(F.lit(1)).over(Window.partitionBy("series")))
    u = (2 * F.col("t") - (F.col("days") - 1)).cast("decimal(10,0)")
    y = (F.col("total") * 100).cast("decimal(18,0)")
    sums = sized.groupBy("series", "days").agg(
        F.sum((u * y).cast("decimal(28,0)")).alias("uy"), F.sum((u * u).cast("decimal(18,0)")).alias("uu"),
        F.sum(y).alias("y"), F.sum((y * y).cast("decimal(36,0)")).alias("yy"))
    uy, uu, total = (F.col(c).cast("double") for c in ("uy", "uu", "y"))
    slope = 2.0 * uy / uu / 100.0
    # days * sum(y^2) - sum(y)^2 is exact before it becomes a double.
    spread = (F.col("days").cast("decimal(6,0)") * F.col("yy").cast("decimal(30,0)") - F.col("y").cast("decimal(18,0)") * F.col("y").cast("decimal(18,0)")).cast("double")
    return sums.select(
        "series", "days", F.when(uu > 0, slope).alias("slope"),
        F.when(uu > 0, total / F.col("days") / 100.0 - slope * ((F.col("days") - 1) / 2.0)).alias("intercept"),
        F.when((uu > 0) & (spread > 0), uy * uy / uu * (F.col("days").cast("double") / spread)).alias("r2"))


def lag_features(series: DataFrame, lags=LAGS, means=MEANS) -> DataFrame:
    """The series with the totals of earlier days, the means of the days
    before and the day of the week (1: Sunday); days without all of them are
    left out."""
    w = Window.partitionBy("series").orderBy("day")
    out = series.withColumn("weekday", F.dayofweek("day").cast("long"))
    out = out.withColumns({f"lag_{n}": F.lag("total", n).over(w) for n in lags})
    out = out.withColumns({f"mean_{n}": F.when(F.col("t") >= n, F.sum("total").over(w.rowsBetween(-n, -1)).cast("double") / n) for n in means})
    return out.where(F.col("t") >= max(*lags, *means))


def cuts(series: DataFrame, folds: int = FOLDS, horizon: int = HORIZON) -> DataFrame:
    """(series, fold, cut): the first test day of each fold; the last fold
    ends with the series, earlier ones a horizon earlier each."""
    ends = series.groupBy("series").agg(F.max("day").alias("last"))
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    return ends.select("series", "last", fold.alias("fold")).select(
        "series", F.col("fold").cast("long").alias("fold"), F.date_add("last", (1 - (folds + 1 - F.col("fold")) * horizon).cast("int")).alias("cut"))


def naive_scores(series: DataFrame, *, lag: int = 7, folds: int = FOLDS, horizon: int = HORIZON) -> DataFrame:
    """(series, fold, days, mse) of forecasting each test day by the total
    ``lag`` days before: what a model has to beat."""
    w = Window.partitionBy("series").orderBy("day")
    rows = series.withColumn("guess", F.lag("total", lag).over(w)).join(cuts(series, folds, horizon), "series") \
        .where((F.col("day") >= F.col("cut")) & (F.date_diff("day", "cut") < horizon) & F.col("guess").isNotNull())
    off = ((F.col("total") - F.col("guess")) * 100).cast("decimal(18,0)")
    return rows.groupBy("series", "fold").agg(
        F.count(F.lit(1)).alias("days"), ((F.sum((off * off).cast("decimal(36,0)")).cast("double") / F.count(F.lit(1))) / 10000.0).alias("mse"))


def model_scores(spark: SparkSession, series: DataFrame, *, folds: int = FOLDS, horizon: int = HORIZON, seed: int = SEED) -> DataFrame:
    """(series, model, fold, cut, days, mse, r2) of the linear and the forest
    regressor on one series (others: one call each).  Fits models, so it runs
    jobs when called; their rows are bounded by the calendar."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    inputs = ["t", "weekday", *[f"lag_{n}" for n in LAGS], *[f"mean_{n}" for n in MEANS]]
    rows = lag_features(series).select("series", "day", F.col("total").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in inputs])
    # A few thousand rows, read by every fit: one ordered partition, so that a rerun samples the same rows.
    made = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).repartition(1).sortWithinPartitions("day").cache()
    try:
        last = made.agg(F.max("day"), F.max("series")).first()
        out = []
        for fold in range(1, folds + 1) if last[0] else ():
            cut = last[0] + dt.timedelta(days=1 - (folds + 1 - fold) * horizon)
            train = made.where(F.col("day") < F.lit(cut))
            test = made.where((F.col("day") >= F.lit(cut)) & (F.col("day") < F.lit(cut + dt.timedelta(days=horizon))))
            days = test.count()
            if not days or train.isEmpty():
                continue
            for name, model in (("linear", LinearRegression(regParam=0.01)), ("forest", RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed))):
                found = model.fit(train).transform(test)
                mse, r2 = (RegressionEvaluator(metricName=m).evaluate(found) for m in ("mse", "r2"))
                out.append((last[1], name, fold, cut, days, mse, r2))
    finally:
        made.unpersist()
    return spark.createDataFrame(out, "series string, model string, fold long, cut date, days long, mse double, r2 double")
