"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import contextlib
import io
from pathlib import Path

import pytest

import __spark_entry__ as contract
import check
from cairn.plans.catalog.registry import all_queries, all_sql

SMALL = "/root/testdata/sf0.001"
NAMES = list(all_queries())

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    good, note = check.compare(spark, con, name, SMALL)
    assert good, note


def test_every_sql_has_its_query():
    assert set(all_sql()) <= set(NAMES) <= set(contract.queries())
    assert set(NAMES) - set(all_sql()) == {
        "optimized_routes", "planned_routes", "explore_routes"}


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and "position" in rows.columns


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["discover_by_distance", "place_clusters", "nearby_visit",
                                  "nearest_place", "region_coverage", "region_cache",
                                  "duplicate_submissions", "research_dedupe", "grouped_visits"])
def test_spatial_plans_have_no_nested_loop(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["note_averages"](spark, SMALL))
    assert "EqualTo(event_type,view)" in text
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "user_id" not in schema and "props" not in schema


def test_page_is_pruned_before_the_shuffle(spark):
    text = plan(contract.queries()["discover_by_confidence"](spark, SMALL))
    assert "WindowGroupLimit" in text
