"""What plans must not do again: read a table for each branch, sort before a shuffle, repeat an expression in those built on it."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from galley import registry
from galley.operators import graph, matching, recipe_audit
from galley.plans import adapters
from galley.plans.adapters import table, tasks_for, view

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(extended=True)
    return said.getvalue().split("== Optimized Logical Plan ==")[1]


@pytest.mark.parametrize("name", ["graph_refs", "loose_refs"])
def test_line_items_are_read_once(spark, name):
    physical = plan(view(spark, SF, name)).split("== Physical Plan ==")[1]
    assert physical.count("FileScan parquet") == physical.count("Exchange hashpartitioning") == 1


def test_uses_and_networks_deal_each_frame_once(spark):
    f = [view(spark, SF, n) for n in ("graph_steps", "graph_refs", "graph_ingredients")]
    for df in (graph.unused_flags(graph.consumers(*f)), graph.unused_items(graph.consumers(*f)), graph.acyclicity(graph.networks(*f, ["rid"]))):
        assert plan(df).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("name", ["JOI-23_step_references", "JOI-23_step_references_in_order"])
def test_references_deal_each_frame_once(spark, name):
    assert plan(registry.queries()[name](spark, SF)).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 4


def test_values_of_a_line_are_worked_out_once(spark):
    logical = plan(registry.queries()["STR-25_preformat_lines"](spark, SF)).split("== Physical Plan ==")[0]
    assert logical.count("regexp_extract(") < 20


def test_keys_of_a_name_are_worked_out_once(spark):
    listed = spark.createDataFrame([(1, "Peppers, sweet, red, raw")], "id int, name string")
    logical = plan(matching.with_lookup_keys(listed)).split("== Physical Plan ==")[0]
    assert len(logical) < 100_000 and logical.count("split(") < 20


def test_issues_are_looked_for_once(spark):
    physical = plan(registry.queries()["AGG-22_recipe_audit_summary"](spark, SF)).split("== Physical Plan ==")[1]
    assert "lineitem.parquet" not in physical


def test_documents_deal_line_items_and_orders_once(spark):
    physical = plan(recipe_audit._docs(spark, SF)).split("== Physical Plan ==")[1]
    assert physical.count("lineitem.parquet") == physical.count("orders.parquet") == 1 and physical.count("Exchange hashpartitioning") == 2
    assert "ObjectHashAggregate" not in physical and physical.count("Sort [") <= 2  # lines as they were dealt, and orders


def test_lines_of_documents_hold_what_three_views_tell(spark):
    lines, key = view(spark, SF, "doc_lines"), ["rid", "pos"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(lines.select(*key, "ingredient.*")) == rows(view(spark, SF, "doc_ingredients"))
    assert rows(lines.select(*key, "step.*")) == rows(view(spark, SF, "doc_steps"))
    refs = [lines.select(*key, F.lit(k).alias("kind"), F.explode(k).alias("ref")).where("ref IS NOT NULL") for k in ("uses", "requires")]
    assert rows(refs[0].unionAll(refs[1])) == rows(view(spark, SF, "graph_refs"))


def test_summary_keeps_a_row_for_a_recipe(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(recipe_audit, "stored", lambda df: kept.append(df) or df)
    issues = spark.createDataFrame([("a", "ERROR", "steps", ""), ("a", "ERROR", "graph", ""), ("a", "WARNING", "graph", ""), (None, "CRITICAL", "json", "")], "slug string, severity string, category string, message string")
    got = sorted((r.section, r.name, r.n, r.detail) for r in recipe_audit.audit_summary(spark.range(3), issues, 1).collect())
    assert kept[0].where("recipe").count() == 2 and kept[0].count() == 2 + 4  # recipes, and pairs of severity and category
    assert got == [("category", "graph", 2, None), ("category", "json", 1, None), ("category", "steps", 1, None), ("severity", "CRITICAL", 1, None), ("severity", "ERROR", 2, None), ("severity", "WARNING", 1, None),
        ("total", "issues", 4, None), ("total", "recipes", 3, None), ("total", "with issues", 2, None), ("worst", "a", 3, "ERROR:2, WARNING:1")]


def test_portions_read_what_was_kept(spark):
    physical = plan(registry.queries()["JOI-7_portion_validation"](spark, SF)).split("== Physical Plan ==")[1]
    assert "lineitem.parquet" not in physical and "/part.parquet" not in physical


def test_plans_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "FEW_ROWS", 500)
    tasks = tasks_for(sum(table(spark, SF, n).count() for n in ("lineitem", "orders", "customer")))
    physical = plan(registry.queries()["AGG-41_shared_ingredients"](spark, SF)).split("== Physical Plan ==")[1]
    assert tasks > 10 and physical.count(f", {tasks}), REPARTITION_BY_NUM") == 2
    assert physical.count("Exchange hashpartitioning") == 3


def test_tasks_take_few_rows_until_there_are_200(spark):
    assert [tasks_for(n) for n in (1, 250_001, 45_900_000, 275_400_000, 3_000_000_000)] == [1, 2, 184, 200, 2000]
