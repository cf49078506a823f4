"""The scheduled runs end to end on landed raw files."""

import os

from tidewater.plans import jobs
from tidewater.sources import sinks as K
from tidewater.sources.tables import load_tables, raw_from_tpch

SF = "/root/testdata/sf0.001"
AS_OF = "2001-11-05"


def test_nightly_runs(spark, tmp):
    ecc, bw = raw_from_tpch(load_tables(spark, SF))
    K.land_raw(ecc, f"{tmp}/raw/raw_ecc", granularity="month")
    K.land_raw(bw, f"{tmp}/raw/raw_bw", granularity="month")
    run = dict(as_of=AS_OF, lookback_days=None, granularity="month")
    first = jobs.run_etl(spark, f"{tmp}/raw", f"{tmp}/wh", **run)
    assert first["customers"] == 1 and first["products"] == 1 and first["sales_rows"] > 0
    again = jobs.run_etl(spark, f"{tmp}/raw", f"{tmp}/wh", **run)
    assert again["customers"] == 2                                     # upsert = new version
    sales = K.read_processed(spark, f"{tmp}/wh")[0]
    assert sales.count() == first["sales_rows"]                         # re-run is idempotent
    c1 = K.read_current(spark, f"{tmp}/wh/customers").count()
    assert c1 == spark.read.parquet(f"{tmp}/wh/customers/version=1").count()
    cached_before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ins = jobs.run_insights(spark, f"{tmp}/wh", f"{tmp}/insights", as_of=AS_OF, days=30)
    assert ins["insight_rows"] == spark.read.parquet(f"{tmp}/insights").count() > 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached_before   # scan released
    docs = jobs.run_documents(spark, f"{tmp}/wh", f"{tmp}/docs", as_of=AS_OF)
    assert docs["documents"] == K.read_current(spark, f"{tmp}/docs").count() > 0
    assert os.path.isdir(f"{tmp}/raw/raw_ecc")


def test_command_line(spark, tmp, capsys):
    from tidewater.__main__ import main
    ecc, bw = raw_from_tpch(load_tables(spark, SF))
    K.land_raw(ecc.where("processed_date >= timestamp_ntz'2001-06-01'"), f"{tmp}/raw/raw_ecc", granularity="month")
    K.land_raw(bw.where("processed_date >= timestamp_ntz'2001-06-01'"), f"{tmp}/raw/raw_bw", granularity="month")
    main(["etl", "--raw", f"{tmp}/raw", "--out", f"{tmp}/wh", "--as-of", AS_OF, "--lookback-days", "30"])
    main(["insights", "--processed", f"{tmp}/wh", "--out", f"{tmp}/ins", "--as-of", AS_OF])
    main(["documents", "--processed", f"{tmp}/wh", "--out", f"{tmp}/docs", "--as-of", AS_OF])
    lines = [ln for ln in capsys.readouterr().out.splitlines() if ln.startswith("{")]
    assert len(lines) == 3 and '"documents"' in lines[2]
