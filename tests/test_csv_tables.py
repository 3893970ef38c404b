"""CSV by header name: reordered, missing, extra and repeated columns, bad records, compressed files."""

import gzip
import os

import pytest

from repsight.sources.csv_tables import HeaderError, headers, read_csv_table
from repsight.sources.readers import ingest_star, quarantine, read_star, read_table
from repsight.sources.schema import SCHEMAS
from repsight.sources.sinks import write_star
from test_edges import P, star  # noqa: F401  (module fixture reused)

TERR = SCHEMAS["territories"]
NAMES = TERR.fieldNames()
ROW = {"territory_id": "T001", "region": "North, far", "state": 'the "old" one', "market_potential_index": "54.5", "urban_index": "0.25",
       "competitor_intensity": "0.75", "num_target_hcps": "12", "population_000s": "900"}
VALUES = ("T001", "North, far", 'the "old" one', 54.5, 0.25, 0.75, 12, 900)


def quoted(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"') else v


def put(path, names, rows, head=None):
    lines = [head or ",".join(names), *(",".join(quoted(r.get(n, "x")) for n in names) if isinstance(r, dict) else r for r in rows)]
    opened = gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")
    with opened as f:
        f.write("\n".join(lines) + "\n")


def test_columns_are_bound_by_name_in_every_file(spark, tmp_path):
    d = tmp_path / "territories.csv"
    d.mkdir()
    swapped = [*NAMES]
    i, j = swapped.index("urban_index"), swapped.index("competitor_intensity")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    put(d / "a.csv", NAMES, [ROW])
    put(d / "b.csv", swapped, [ROW])
    put(d / "c.csv", ["note", *reversed(NAMES), "more"], [ROW])
    put(d / "d.csv", NAMES, [ROW], head="﻿" + ", ".join(n.upper() for n in NAMES))
    put(d / "e.csv.gz", swapped, [ROW, ROW])
    (d / "empty.csv").write_text("")
    (d / "_SUCCESS").write_text("")
    table = read_csv_table(spark, str(d), TERR)
    assert [tuple(r) for r in table.good.collect()] == [VALUES] * 6 and table.good.schema == TERR
    assert table.bad.collect() == [] and len(headers(spark, str(d))) == 4
    assert [tuple(r) for r in read_table(spark, str(d / "b.csv"), "territories").collect()] == [VALUES]
    assert table.good.select("region").collect() == [("North, far",)] * 6


def test_missing_and_repeated_columns_fail_and_name_the_file(spark, tmp_path):
    put(tmp_path / "less.csv", NAMES[:-1], [ROW])
    with pytest.raises(HeaderError, match=r"less\.csv .*lacks population_000s"):
        read_csv_table(spark, str(tmp_path / "less.csv"), TERR)
    put(tmp_path / "twice.csv", [*NAMES, "region"], [ROW])
    with pytest.raises(HeaderError, match="region more than once"):
        read_csv_table(spark, str(tmp_path / "twice.csv"), TERR)
    with pytest.raises(FileNotFoundError):
        read_csv_table(spark, str(tmp_path / "none.csv"), TERR)


def test_a_bad_record_costs_itself_in_every_query(spark, tmp_path):
    path = tmp_path / "t.csv"
    put(path, NAMES, [ROW, {**ROW, "num_target_hcps": "many", "urban_index": "high"}, "T9,only,three", {**ROW, "state": ""}, ",".join(["1"] * 11)])
    table = read_csv_table(spark, str(path), TERR)
    assert table.good.count() == 2 and sorted(str(r.state) for r in table.good.collect()) == ["None", 'the "old" one']
    # the same rows whatever columns a query needs
    assert table.good.select("region").collect() == [("North, far",)] * 2
    assert table.good.groupBy("state").count().count() == 2
    bad = {r.record[:9]: sorted(r.columns) for r in table.bad.collect()}
    assert bad == {'T001,"Nor': ["num_target_hcps", "urban_index"], "T9,only,t": [], "1,1,1,1,1": []}
    assert all(r.file.endswith("t.csv") for r in table.bad.collect())


def test_empty_folder_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    table = read_csv_table(spark, str(tmp_path / "x.csv"), TERR)
    assert table.good.collect() == [] and table.bad.collect() == [] and table.good.schema == TERR


def test_ingest_writes_typed_tables_and_the_quarantine(spark, star, tmp_path):  # noqa: F811
    src, out = str(tmp_path / "csv"), str(tmp_path / "pq")
    write_star(star, src, fmt="csv")
    names = SCHEMAS["sales"].fieldNames()
    sale = {"sale_id": "S9", "rep_id": "R1", "territory_id": "T1", "product_id": "P1", "month": "2024-13-77", "year": "2024", "month_num": "1", "units_sold": "1",
            "revenue_usd": "10.00", "discount_pct": "0.1", "net_revenue_usd": "9.00"}
    put(os.path.join(src, "sales.csv", "more.csv"), names[::-1], [sale, {**sale, "month": "2024-01-01"}])
    back, bad = ingest_star(spark, src, out)
    assert back.sales.count() == star.sales.count() + 1 and back.sales.schema == star.sales.schema
    assert [(r.table, r.columns) for r in bad.collect()] == [("sales", ["month"])]
    assert quarantine(spark, src).count() == 1
    for name in ("territories", "reps", "physicians", "call_logs", "products"):
        assert sorted(map(str, back.tables()[name].collect())) == sorted(map(str, star.tables()[name].collect()))
    assert read_star(spark, src).sales.count() == back.sales.count()


def test_command_line_reports_the_quarantine(spark, star, tmp_path, capsys):  # noqa: F811
    from repsight.__main__ import main
    src = str(tmp_path / "csv")
    write_star(star, src, fmt="csv")
    put(os.path.join(src, "territories.csv", "more.csv"), NAMES, ["T9,short"])
    assert main(["--star", src, "--ingest", str(tmp_path / "pq"), "--out", str(tmp_path / "out"), "--only", "whitespace_kpis"]) == 0
    assert "territories: 1 records don't fit" in capsys.readouterr().out
