"""M1: customer segments by recency, frequency and money.

K-means over standardised features in whole millionths, so that sums, means
and distances are exact and neither the order of the rows nor their
partitions change a label.  Starts are drawn as in k-means++, each customer's
draw from a hash of its id and the seed; segments are numbered by the money
of their centre.  Every step is one aggregation; the driver holds the centres.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.session import checkpoint_dir

FEATURES = ("recency", "frequency", "money")
K = 4
SEED = 11
MAX_STEPS = 50
UNIT = 1_000_000


def rfm(scan: DataFrame, *, as_of) -> DataFrame:
    """(customer_id, recency, frequency, money): days since the last sale,
    sales, cents spent, of every customer with a sale."""
    return scan.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.date_diff(F.to_date(X.ts_lit(as_of)), F.to_date(F.max("sales_date"))).cast("long").alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        (F.coalesce(F.sum("sales_amount"), F.lit(0)) * 100).cast("long").alias("money"))


def standardised(features: DataFrame) -> DataFrame:
    """The features less their mean, over their standard deviation (of the
    population), in millionths; 0 where all are alike."""
    sums = features.agg(F.count(F.lit(1)).alias("n"), *[x for c in FEATURES for x in (
        F.sum(c).cast("decimal(19,0)").alias(f"s_{c}"), F.sum((F.col(c).cast("decimal(19,0)") * F.col(c)).cast("decimal(38,0)")).alias(f"q_{c}"))]).first()
    out = {}
    for c in FEATURES:
        n, s, q = sums["n"], int(sums[f"s_{c}"] or 0), int(sums[f"q_{c}"] or 0)
        spread = n * q - s * s                                      # exact: n^2 times the variance
        scale = UNIT / math.sqrt(spread) if spread else 0.0         # (n x - s) / sqrt(spread)
        out[f"z_{c}"] = F.round(((F.col(c).cast("decimal(19,0)") * F.lit(n) - F.lit(str(s)).cast("decimal(19,0)")).cast("double")) * F.lit(scale)).cast("long")
    return features.withColumns(out)


def _distance(centre) -> Column:
    """Squared distance to a centre, a whole number."""
    out = None
    for c, v in zip(FEATURES, centre):
        d = (F.col(f"z_{c}") - F.lit(int(v))).cast("decimal(12,0)")
        out = d * d if out is None else out + d * d
    return out.cast("decimal(28,0)")


def _starts(points: DataFrame, k: int, seed: int) -> list[tuple]:
    """k-means++: the next start is drawn with chances in proportion to the
    squared distance from the nearest one so far, as the customer with the
    smallest exponential draw of that rate."""
    draw = lambda step: -F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "customer_id"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40))
    chosen: list[tuple] = []
    for step in range(k):
        near = F.least(*map(_distance, chosen)) if len(chosen) > 1 else _distance(chosen[0]) if chosen else F.lit(1).cast("decimal(28,0)")
        rate = near.cast("double")
        first = points.where(near > 0).agg(F.min_by(F.struct(*[f"z_{c}" for c in FEATURES]), F.struct((draw(step) / rate).alias("d"), "customer_id"))).first()[0]
        if first is None:           # fewer different customers than segments
            break
        chosen.append(tuple(first))
    return chosen


def _assigned(points: DataFrame, centres: list[tuple]) -> DataFrame:
    """Points with the nearest centre (ties: the first) and its distance."""
    best = F.array_min(F.array(*[F.struct(_distance(c).alias("distance"), F.lit(i).alias("segment")) for i, c in enumerate(centres)]))
    return points.withColumn("_b", best).select(*points.columns, F.col("_b.segment").alias("segment"), F.col("_b.distance").alias("distance"))


def cluster(points: DataFrame, *, k: int = K, seed: int = SEED, max_steps: int = MAX_STEPS) -> tuple[list[tuple], list[int]]:
    """(centres, inertia of every step).  ``points`` is read once a step;
    k rows reach the driver."""
    centres, inertia = _starts(points, k, seed), []
    for _ in range(max_steps if centres else 0):
        rows = _assigned(points, centres).groupBy("segment").agg(
            F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"), *[F.sum(f"z_{c}").alias(f"z_{c}") for c in FEATURES]).collect()
        inertia.append(sum(int(r["inertia"]) for r in rows))
        moved = list(centres)
        for r in rows:
            moved[r["segment"]] = tuple((2 * r[f"z_{c}"] + r["n"]) // (2 * r["n"]) for c in FEATURES)
        if moved == centres:
            break
        centres = moved
    return centres, inertia


def customer_segments(scan: DataFrame, *, as_of, k: int = K, seed: int = SEED) -> DataFrame:
    """(customer_id, recency, frequency, money, segment): segment 1 has the
    centre with the most money.  The features are written once under the
    shared checkpoint folder and read by every step."""
    spark = scan.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidewater-segments/{uuid.uuid4().hex}"
    features = rfm(scan, as_of=as_of)
    features.write.parquet(path)
    points = standardised(spark.read.schema(features.schema).parquet(path))
    centres, _ = cluster(points, k=k, seed=seed)
    if not centres:
        return points.select("customer_id", *FEATURES, F.lit(None).cast("int").alias("segment"))
    order = sorted(range(len(centres)), key=lambda i: (-centres[i][2], centres[i]))
    centres = [centres[i] for i in order]
    return _assigned(points, centres).select("customer_id", *FEATURES, (F.col("segment") + 1).alias("segment"))
