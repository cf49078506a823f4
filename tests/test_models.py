"""Quantiles by counting, the report cube, anomalies, forecasts, pairs and segments."""

import datetime as dt
import itertools
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import quantile as Z
from tidewater.models import anomalies, forecast, recommend, segments
from tidewater.operators import insights as I
from tidewater.operators.cube import Cube
from test_insights import scan


def test_quantiles_per_group(spark):
    rng = random.Random(4)
    groups = {"a": [rng.randrange(-10**12, 10**12) for _ in range(501)], "b": [7], "c": [5, 5, 5, 9], None: [1, 2, 3, 10],
              "wide": [-4 * 10**17, 4 * 10**17, 0], "hot": [rng.randrange(50) for _ in range(4000)]}
    rows = [(k, Decimal(v).scaleb(-2)) for k, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x decimal(20,2)").repartition(5)
    got = {(r["k"], r["p"]): (r["n"], r["q"]) for r in Z.quantiles(df, "x", [0.0, 0.25, 0.5, 0.8, 1.0], ["k"]).collect()}
    assert set(got) == {(k, p) for k in groups for p in (0.0, 0.25, 0.5, 0.8, 1.0)}
    for (k, p), (n, q) in got.items():
        want = np.quantile(np.array(sorted(groups[k]), float) / 100, p)
        assert n == len(groups[k]) and q == pytest.approx(want, rel=1e-12, abs=1e-9), (k, p)
    whole = [v / 100 for vs in groups.values() for v in vs]
    assert Z.exact_quantile(df, "x", 0.8).first()["q"] == pytest.approx(np.quantile(whole, 0.8), rel=1e-12)
    assert Z.exact_quantile(df.limit(0), "x", 0.8).first()["q"] is None
    with pytest.raises(ValueError):
        Z.quantiles(df.select(F.col("x").cast("double").alias("x")), "x", [0.5])


def test_quantile_windows_hold_digits_only(spark):
    """No plan node orders rows: windows run over counts per digit."""
    df = spark.range(10).select(F.col("id").alias("x"))
    plan = Z.quantiles(df, "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("Window") >= Z.ROUNDS
    assert all("_digit" in line for line in plan.splitlines() if "Window " in line)


def cube_scan(spark):
    rng = random.Random(3)
    rows = [dict(customer_id=f"C{rng.randrange(6)}", product_code=f"P{rng.randrange(4)}", region=rng.choice(["N", "S", None]), sales_rep=rng.choice(["r1", "r2", None]),
                 sales_date=dt.datetime(2001, 1, 1) + dt.timedelta(hours=rng.randrange(200)), sales_amount=Decimal(rng.randrange(1, 99999)).scaleb(-2),
                 sales_quantity=Decimal(rng.randrange(1, 9)), unit_price=rng.choice([None, Decimal("1.25"), Decimal("3.10")])) for _ in range(400)]
    rows += [dict(customer_id="C9", product_code="P9", region=None, sales_rep=None, unit_price=None)]
    return scan(spark, rows)


def test_cube_equals_the_flat_reports(spark):
    s = cube_scan(spark)
    dims = (spark.createDataFrame([(f"C{i}", f"s{i % 2}") for i in range(5)], "customer_id string, customer_segment string"),
            spark.createDataFrame([(f"P{i}", f"c{i % 2}") for i in range(4)], "product_code string, product_category string"))
    cube = Cube(s)
    for flat, shared in ((I.daily_sales(s), cube.daily_sales()), (I.customer_analysis(s, dims[0]), cube.customer_analysis(dims[0])),
                         (I.product_analysis(s, dims[1]), cube.product_analysis(dims[1])), (I.region_analysis(s), cube.region_analysis()),
                         (I.rep_analysis(s), cube.rep_analysis())):
        assert flat.columns == shared.columns
        assert sorted(map(str, flat.collect())) == sorted(map(str, shared.collect()))
    assert cube.distinct_customers().first()[0] == s.select("customer_id").distinct().count()
    cube.remove()
    empty = Cube(s.limit(0))
    assert empty.daily_sales().collect() == [] and len(I.insight_rows(empty, *dims, as_of="2001-02-01").collect()) == 5


def test_cube_reads_the_sales_once(spark, tmp):
    from tidewater.operators.cube import report_cube
    cube_scan(spark).write.parquet(f"{tmp}/s")
    plan = report_cube(spark.read.parquet(f"{tmp}/s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_cube_sends_rows_and_keeps_sums(spark, tmp):
    """The groups of a customer are made after the shuffle, and days and reps are written added up."""
    from tidewater.operators.cube import report_cube
    s = cube_scan(spark)
    plan = report_cube(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("Exchange hashpartitioning(of_product") and plan.count("Exchange") == 1
    cube = Cube(s)
    days, reps = s.selectExpr("to_date(sales_date)").distinct().count(), s.select("sales_rep").distinct().count()
    assert (cube.part("day").count(), cube.part("rep").count()) == (days, reps)
    assert cube.part("region_rep").count() == s.select("region", "sales_rep").distinct().count()
    assert {r["customers"] for r in cube.part("rep").collect()} == {r["n"] for r in s.groupBy("sales_rep").agg(F.count_distinct("customer_id").alias("n")).collect()}
    cube.remove()


def test_anomalies_equal_numpy(spark):
    rng = random.Random(8)
    values = {"a": [rng.gauss(100, 5) for _ in range(200)] + [300, -50], "flat": [5.0] * 20 + [6.0], None: [1.0, 2.0, 3.0, 100.0], "one": [4.0]}
    rows = [(k, Decimal(round(v, 2)).quantize(Decimal("0.01"))) for k, vs in values.items() for v in vs] + [("a", None)]
    got = sorted((str(r["k"]), float(r["x"]), r["median"], r["mad"]) for r in anomalies.anomalies(spark.createDataFrame(rows, "k string, x decimal(10,2)"), "x", ["k"]).collect())
    want = []
    for k, vs in values.items():
        x = np.array([float(v) for g, v in rows if g == k and v is not None])
        med = np.median(x)
        mad = np.median(np.abs(x - med))
        want += [(str(k), v, med, mad) for v in x.tolist() if abs(v - med) > 3 * 1.4826 * mad + 1e-9]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in sorted(want)])
    with pytest.raises(ValueError):
        anomalies.anomalies(spark.createDataFrame(rows, "k string, x decimal(10,2)"), "x", [])


def test_forecast(spark):
    day = lambda i: dt.datetime(2001, 1, 1) + dt.timedelta(days=i)
    line = scan(spark, [dict(region="N", sales_date=day(i), sales_amount=Decimal(100 + 3 * i)) for i in range(0, 60)]
                + [dict(region="S", sales_date=day(0), sales_amount=Decimal(5)), dict(region="S", sales_date=day(4), sales_amount=Decimal(7)), dict(region=None)])
    series = forecast.daily_series(line, "region")
    got = {r["series"]: r for r in forecast.trend(series).collect()}
    assert (got["N"]["slope"], got["N"]["intercept"], got["N"]["r2"]) == pytest.approx((3.0, 100.0, 1.0)) and got["N"]["days"] == 60
    t, y = np.arange(5), np.array([5.0, 0, 0, 0, 7])
    a, b = np.polyfit(t, y, 1)
    assert (got["S"]["slope"], got["S"]["intercept"]) == pytest.approx((a, b)) and got["S"]["r2"] == pytest.approx(np.corrcoef(t, y)[0, 1] ** 2)
    rows = {r["t"]: r for r in forecast.lag_features(series.where("series = 'N'")).collect()}
    assert sorted(rows) == list(range(28, 60)) and float(rows[30]["lag_7"]) == 100 + 3 * 23 and rows[30]["mean_7"] == pytest.approx(100 + 3 * 26)
    assert {r["mse"] for r in forecast.naive_scores(series.where("series = 'N'"), folds=2, horizon=7).collect()} == {441.0}


def test_models_on_rolling_origins(spark):
    day = lambda i: dt.datetime(2001, 1, 1) + dt.timedelta(days=i)
    s = scan(spark, [dict(sales_date=day(i), sales_amount=Decimal(1000 + 2 * i + 50 * (i % 7))) for i in range(200)])
    got = forecast.model_scores(spark, forecast.daily_series(s), folds=2, horizon=14).collect()
    assert [(r["model"], r["fold"], r["days"]) for r in got] == [(m, f, 14) for f in (1, 2) for m in ("linear", "forest")]
    assert all(r["r2"] > 0.99 for r in got if r["model"] == "linear")
    assert [r["cut"] for r in got[::2]] == [day(200 - 28).date(), day(200 - 14).date()]
    again = forecast.model_scores(spark, forecast.daily_series(s.repartition(7)), folds=2, horizon=14).collect()
    assert [r["mse"] for r in again] == pytest.approx([r["mse"] for r in got])
    assert forecast.model_scores(spark, forecast.daily_series(s.limit(0))).collect() == []


@pytest.mark.parametrize("block", [2, 64])
def test_pairs_equal_brute_force(spark, block):
    rng = random.Random(block)
    orders = {f"O{i}": {f"P{min(rng.randrange(1, 12), rng.randrange(1, 40))}" for _ in range(rng.randrange(1, 7))} for i in range(120)}
    orders["big"] = {f"P{i}" for i in range(60)}
    orders["bigger"] = {f"P{i}" for i in range(20, 90)}
    items = spark.createDataFrame([(o, p) for o, ps in orders.items() for p in ps], "order_number string, product_code string")
    count = Counter(p for ps in orders.values() for p in itertools.combinations(sorted(ps), 2))
    want = {p: n for p, n in count.items() if n >= 2}
    got = {(r["a"], r["b"]): r["orders"] for r in recommend.product_pairs(items, block=block).collect()}
    assert got == want and len(want) > 500
    top = {(r["product_code"], r["rank"]): (r["recommended"], r["orders"], r["confidence"]) for r in recommend.recommendations(items, k=2, block=block).collect()}
    for p in {x for pair in want for x in pair}:
        best = sorted((-n, (set(pair) - {p}).pop()) for pair, n in want.items() if p in pair)[:2]
        held = sum(p in ps for ps in orders.values())
        assert [top.get((p, i + 1)) for i in range(len(best))] == [(b, -n, -n / held) for n, b in best]


def test_segments(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        n, late, amount = [(1, 200, 10), (5, 20, 100), (12, 2, 1000)][i % 3]
        rows += [dict(customer_id=f"C{i}", sales_date=dt.datetime(2001, 12, 1) - dt.timedelta(days=late + rng.randrange(5) + j), sales_amount=Decimal(amount + rng.randrange(amount)))
                 for j in range(n)]
    s = scan(spark, rows)
    label = lambda df: {r["customer_id"]: r["segment"] for r in segments.customer_segments(df, as_of="2001-12-02", k=3).collect()}
    got = label(s)
    assert got == {f"C{i}": 3 - i % 3 for i in range(90)}
    assert label(s.orderBy(F.rand(1)).repartition(11)) == got           # another order, other partitions
    points = segments.standardised(segments.rfm(s, as_of="2001-12-02"))
    centres, inertia = segments.cluster(points, k=5, seed=3)
    assert len(centres) == 5 and all(b <= a + 90 * 9 for a, b in zip(inertia, inertia[1:]))      # centres are rounded to whole millionths
    z = np.array([[r[f"z_{c}"] for c in segments.FEATURES] for r in points.collect()], float) / segments.UNIT
    assert np.allclose(z.mean(0), 0, atol=1e-5) and np.allclose(z.std(0), 1, atol=1e-5)
    assert label(s.limit(0)) == {} and len(set(label(s.where("customer_id = 'C1'")).values())) == 1


@pytest.mark.parametrize("values", [[5], [0, 1], [7, 7, 7], [0, 2**21 - 1, 2**21, 2**21 + 1], [-(10**15), 3, 10**15, 4], [None], []])
def test_measured_quantiles_take_as_few_rounds_as_the_values_need(spark, values):  # F8, F9
    from tidewater.functions import quantile as Z
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("b", 1)], "k string, v long")
    ps = [0.0, 0.3, 0.5, 1.0]
    rows = lambda d: sorted(((r["k"], r["p"], r["n"], r["q"]) for r in d.collect()), key=lambda r: (str(r[0]), r[1]))
    assert rows(Z.quantiles(df, "v", ps, ["k"], measured=True)) == rows(Z.quantiles(df, "v", ps, ["k"]))
    bits = Z.span_bits(df, df.v)
    whole = [v for v in values if v is not None] + [1]
    assert bits == max(1, (max(whole) - min(whole)).bit_length())
    buf = Z.order_statistics(df, df.v, [0.5], ["k"], bits=bits)._jdf.queryExecution().optimizedPlan().toString()
    full = Z.order_statistics(df, df.v, [0.5], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert full.count("Window [") == 3 and buf.count("Window [") == -(-bits // 21)


def test_values_further_apart_than_said_fail(spark):  # F8, F9
    from tidewater.functions import quantile as Z
    df = spark.createDataFrame([("a", 0), ("a", 100)], "k string, v long")
    with pytest.raises(Exception, match="further apart"):
        Z.order_statistics(df, df.v, [0.5], ["k"], bits=3).collect()
