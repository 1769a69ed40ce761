import json
import subprocess
import sys
import xml.dom.minidom
from concurrent.futures import CancelledError
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.functions.parsing import parse
from palimpsest.jobs import JobManager
from palimpsest.operators import paths as P
from palimpsest.operators.flatten import from_
from palimpsest.plans import traversal as t
from palimpsest.sources import render
from palimpsest.sources.sample import SCHEMA, sample_graph

from .helpers import assert_same, canonical

ROOT = Path(__file__).resolve().parent.parent
SOME = "overlap_hop multi_range_hop where_history intersect_versions history_extract range_union order_by_history_max choice opt sub_collect_count matches_exists take_per_input flat_map switch repeat_cycle degree weighted_edges type_counts extract_null_label extract_multi_label sql_rollup sql_setops scd2_differential scd2_incremental scd2_revive parse_types".split()


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["scd2_full", "scd2_differential", "scd2_incremental", "scd2_revive"])
def test_histories_of_every_event_day(spark, sf_dir, tmp_path, name):
    for p in Path(sf_dir).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "events.parquet").unlink()
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    spark.read.parquet(f"{sf_dir}/events.parquet").filter((day < 8) & (day != 6)).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")  # day 6 is a snapshot of nothing
    df = queries.QUERIES[f"{name}_all_days"](spark, f"file://{tmp_path}")
    assert df.agg(F.max("f")).first()[0] == 8  # a row that opens after the first five days
    assert_same(df, queries.ORACLES[f"{name}_all_days"], tmp_path)


def test_history_filter_counts_days_of_one_value(spark, sf_dir, tmp_path):
    for p in Path(sf_dir).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "events.parquet").unlink()
    rows = [(1, "view", 60.0, 1), (2, "click", 60.0, 1), (3, "view", 40.0, 1), (5, "view", 60.0, 1), (6, "error", 60.0, 1), (7, "view", 60.0, 1), (7, "view", 60.0, 1), (1, "view", 60.0, 2), (2, "view", 60.0, 2), (1, "view", 50.0, 3)]
    events = pd.DataFrame([(i, pd.Timestamp(2024, 1, day), *row) for i, (day, *row) in enumerate(rows)], columns=["event_id", "ts", "event_type", "value", "user_id"])
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    df = queries.QUERIES["history_filter"](spark, f"file://{tmp_path}")
    assert {x["id"]: x["n"] for x in df.collect()} == {1: 4, 2: 2}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert canonical(df.toPandas()) == canonical(con.sql(queries.ORACLES["history_filter"]).df())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry_works_without_the_optional_operators():
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith(('palimpsest.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'flagship' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).returncode == 0


@pytest.mark.parametrize(
    ("kind", "cell", "wanted"),
    [
        ("boolean", "TRUE", True), ("boolean", "0", False), ("boolean", "t", None), ("int", "+7", 7), ("int", " 7", None), ("byte", "200", None), ("long", "-9", -9), ("double", "1.5", 1.5), ("char", "ab", None), ("char", "a", "a"),
        ("string", "", ""), ("enum(a|b)", "b", "b"), ("enum(a|b)", "1", "b"), ("enum(a|b)", "c", None), ("array<int>", "[1,2]", [1, 2]), ("array<int>", "[]", []), ("array<int>", "[1,x]", None), ("array<int>", "1", None),
        ("option<int>", "[3]", 3), ("option<int>", "3", None), ("decimal", "1e-3", "0.001000000000000000"), ("timestamp", "2020-01-02T03:04:05Z", "2020-01-02 03:04:05"),
    ],
)
def test_parsing(spark, kind, cell, wanted):
    got = spark.createDataFrame([(cell,)], "c string").select(parse(F.col("c"), kind).alias("p")).select("p.ok", "p.v").first()
    assert got["ok"] == (wanted is not None) and (str(got["v"]) if isinstance(wanted, str) and not isinstance(got["v"], str) else got["v"]) == wanted


def test_none_is_a_value_of_an_option(spark):
    assert spark.createDataFrame([("None",), (None,)], "c string").select(parse(F.col("c"), "option<int>")["ok"]).collect() == [(True,), (False,)]


def test_renderers(spark, sf_dir):
    g = sample_graph(spark, sf_dir)
    df = t.paths(g, t.V("Region") >> t.in_("in_region") >> t.ex("n_name"))
    body = json.loads(render.paths_json(df, timings=[("execute", 3)]))
    assert len(body["paths"]) == 25 and len(body["elementInfo"]) == 25 * 2 + 5 * 1 + 25 * 0 - 0 and body["paths"][0][1].startswith("-")
    for text in (render.paths_dot(df, "a"), render.paths_dot_aggregated(df), render.schema_dot(SCHEMA)):
        assert text.startswith("digraph") and text.endswith("}")
    assert "pseudo" in render.paths_dot(t.paths(g, t.V("Region") >> t.in_e("in_region")))
    assert xml.dom.minidom.parseString(render.paths_graphml(df)).getElementsByTagName("edge").length == 25
    table = from_(t.V("Nation") >> t.ex("n_name")).extract().run(g)
    assert render.table_csv(table).splitlines()[0] == "n_name,VERSION.FROM,VERSION.TO"
    assert json.loads(render.table_json(table))["columnTypes"] == ["string", "int", "int"]
    with pytest.raises(render.TooLarge):
        render.table_csv(table, limit=3)
    assert json.loads(render.schema_json(SCHEMA))["name"] == "trade" and render.schema_meta(SCHEMA)["nodeCount"] == 8
    assert json.loads(render.element_schema_json(SCHEMA, "contains"))["fromCardinality"] == "*"
    assert json.loads(render.element_json(g, "node", "Nation", 3))["validAtHead"]
    weights = P.weighted_edges(df)
    assert weights.agg(F.sum("weight")).first()[0] == 25


def test_jobs(spark, sf_dir):
    m = JobManager(spark, lambda v: sample_graph(spark, sf_dir), workers=2)
    job = m.submit(from_(t.V("Nation") >> t.ex("n_name")).extract())
    assert m.result(job, 120).count() == 25 and m.info(job)["state"] == "done"
    assert m.present(job, render.table_csv).count("\n") == 26 and [p for p, _ in m.info(job)["timings"]] == ["open", "compile", "execute", "present"]
    bad = m.submit(t.V("Nothing"))
    with pytest.raises(t.TraversalError):
        m.result(bad, 120)
    assert m.info(bad)["state"] == "failed" and m.count() == 2 and m.count(alive=True) == 0
    slow = m.submit(lambda g: spark.range(0, 10**13, 1, 4).select(F.sum("id")))
    m.cancel(slow)
    with pytest.raises(CancelledError):
        m.result(slow, 120)
    m.forget(job)
    m.close()
