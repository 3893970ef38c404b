"""Readers and writers: the original CSV layout round trip, the whole analysis run."""

import json
import os
import tempfile

from test_edges import P, star  # noqa: F401  (module fixture reused)

from repsight.operators import whitespace
from repsight.plans.analysis import RESULTS, SINGLE_FILE, run_analysis
from repsight.sources.readers import read_star
from repsight.sources.sinks import write_result, write_star


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_layout_round_trip(spark, star):  # noqa: F811
    d = tempfile.mkdtemp(prefix="repsight-csv-")
    write_star(star, d, fmt="csv")
    back = read_star(spark, d, fmt="csv")
    for name, df in star.tables().items():
        assert back.tables()[name].schema == df.schema, name
    want = whitespace.whitespace_analysis(star.territories, star.sales, star.call_logs, P)
    got = whitespace.whitespace_analysis(back.territories, back.sales, back.call_logs, P)
    assert _rows(got) == _rows(want)


def test_run_analysis_writes_every_result(spark, star):  # noqa: F811
    out = tempfile.mkdtemp(prefix="repsight-out-")
    written = run_analysis(star, P, out, fmt="csv")
    assert written == list(RESULTS)
    for name in RESULTS:
        files = [f for f in os.listdir(os.path.join(out, name)) if f.endswith(".csv")]
        assert files, name
        if name in SINGLE_FILE or name in ("m3_sfe_metrics", "m4_hcp_coverage_gap", "m5_product_portfolio", "m5b_product_monthly_trend"):
            assert len(files) == 1, name
    m4 = spark.read.option("header", True).option("inferSchema", True).csv(os.path.join(out, "m4_hcp_coverage_gap"))
    tiers = [(r.prescriber_tier, r.monthly_rx_volume) for r in m4.collect()]
    assert tiers == sorted(tiers, key=lambda t: (t[0], -t[1]))       # sink order: tier, then Rx desc
    kpi = spark.read.option("header", True).option("inferSchema", True).csv(os.path.join(out, "kpi_summary"))
    row = kpi.collect()[0]
    assert row.whitespace_territories == 1 and row.critical_gap_hcps == 1
    assert row.total_revenue_all_years == 840.0          # 440 (2023) + 400 (2024)
    summary_dir = os.path.join(out, "dataset_summary_json")
    js = [json.loads(ln) for f in os.listdir(summary_dir) if f.endswith(".json")
          for ln in open(os.path.join(summary_dir, f))]
    assert js and js[0]["sales"] == 10 and js[0]["territories"] == 6


def test_write_result_formats(spark, star):  # noqa: F811
    d = tempfile.mkdtemp(prefix="repsight-fmt-")
    for fmt in ("csv", "parquet", "json"):
        write_result(star.territories, os.path.join(d, fmt), fmt)
        assert os.listdir(os.path.join(d, fmt))


def test_command_line_run(spark, star):  # noqa: F811
    from repsight.__main__ import main
    d = tempfile.mkdtemp(prefix="repsight-cli-")
    write_star(star, os.path.join(d, "star"), fmt="csv")
    out = os.path.join(d, "out")
    assert main(["--star", os.path.join(d, "star"), "--out", out, "--only", "kpi_summary", "m6_promotional_response",
                 "--set", "revenue_per_mpi_point=9000.0"]) == 0
    assert sorted(os.listdir(out)) == ["kpi_summary", "m6_promotional_response"]


def test_parquet_layout_round_trip(spark, star):  # noqa: F811
    d = tempfile.mkdtemp(prefix="repsight-pq-")
    write_star(star, d)                       # facts partitioned by year
    back = read_star(spark, d, fmt="parquet")
    for name, df in star.tables().items():
        assert back.tables()[name].schema == df.schema, name
        assert _rows(back.tables()[name].select(df.columns)) == _rows(df), name


def test_reads_original_style_csv(spark):
    from repsight.sources.readers import read_table
    d = tempfile.mkdtemp(prefix="repsight-orig-")
    with open(os.path.join(d, "call_logs.csv"), "w") as f:
        f.write("call_id,rep_id,hcp_id,territory_id,product_promoted,call_date,month,year,month_num,channel,"
                "call_outcome,converted,call_duration_min,samples_dropped\n"
                "C0000001,R001,H0001,T001,P003,2023-01-17,2023-01-01,2023,1,In-Person Visit,"
                "Positive - Prescription Written,True,23,False\n")
    with open(os.path.join(d, "sales.csv"), "w") as f:
        f.write("sale_id,rep_id,territory_id,product_id,month,year,month_num,units_sold,revenue_usd,discount_pct,"
                "net_revenue_usd\nS000001,R001,T001,P003,2023-01-01,2023,1,12,15234.56,0.125,13330.24\n")
    calls = read_table(spark, os.path.join(d, "call_logs.csv"), "call_logs").collect()[0]
    sales = read_table(spark, os.path.join(d, "sales.csv"), "sales").collect()[0]
    assert calls.converted is True and calls.samples_dropped is False and calls.call_duration_min == 23
    assert str(calls.call_date) == "2023-01-17" and calls.year == 2023
    assert str(sales.revenue_usd) == "15234.56" and str(sales.discount_pct) == "0.125"


def test_written_star_reads_back_through_a_url(spark, star001, tmp_path):
    from repsight.sources.readers import exists, read_star
    from repsight.sources.schema import Star
    from repsight.sources.sinks import write_star
    few = Star(**{n: df.limit(20) for n, df in star001.tables().items()})
    url = f"file://{tmp_path}/star"
    write_star(few, url)
    assert exists(spark, f"{url}/territories") and not exists(spark, f"{url}/territories.parquet")
    for path in (url, f"{tmp_path}/star"):
        assert read_star(spark, path, fmt="parquet").sales.count() == 20


def test_command_line_keeps_the_submitted_master(tmp_path):
    import subprocess
    import sys

    from conftest import ROOT, SF0001
    code = ("import sys; sys.argv = ['repsight']\n"
            "from pyspark.sql import SparkSession\n"
            "import repsight.__main__ as m\n"
            "m.run_analysis = lambda *a, **k: print('MASTER', SparkSession.getActiveSession().sparkContext.master) or []\n"
            f"m.main(['--tpch', '{SF0001}', '--out', '{tmp_path}/out'])\n")
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--master local[2] --conf spark.ui.enabled=false pyspark-shell")
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "MASTER local[2]" in out.stdout, out.stderr[-2000:]
