"""Every registered query against its SQL check, and what registration promises."""

import pathlib
import re

import pytest
from check import difference, tables_of
from conftest import ROOT, plan_of

import __spark_entry__ as contract
from fieldmosaic import registry

CHECKS = contract.oracle_sql()
LEARNING = {"train_score"}
#: Queries that train or write while they are built.
BUILDING = {"train_tree", "grid_search", "importance", "scenario_summary", "model_round_trip", "select_model", "train_boosted", "pool_codes", "listed_mosaic"}


@pytest.fixture(scope="module")
def connection(small):
    return tables_of(small)


OWN = set(CHECKS) & set(registry.QUERIES)


def test_only_learning_goes_unchecked():
    assert set(CHECKS) <= set(contract.queries())
    assert set(registry.QUERIES) - set(CHECKS) == LEARNING


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_its_check(spark, small, connection, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    assert difference(got, connection.execute(CHECKS[name]).df()) is None
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(OWN - BUILDING - {"read_csv", "read_csv_inferred", "publish", "staged_resume", "results_json"}))
def test_plans_hold_no_cross_join_and_no_python(spark, small, name):
    plan = plan_of(registry.QUERIES[name](spark, small))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["label", "n", "weight"] and got.count() == 9


#: Fetches of a bounded number of rows, and why each is bounded.
ALLOWED = {
    "fieldmosaic/operators/boosting.py": 3,  # two rows of losses, a row per open node, the trees of a model
    "fieldmosaic/operators/pools.py": 3,  # a row of borders, MAX_CLASSES + 1 names, one document
    "fieldmosaic/operators/learn.py": 1,  # the highest class number
    "fieldmosaic/operators/metrics.py": 1,  # class names, at most MAX_MATRIX_CLASSES + 1
    "fieldmosaic/operators/tiles.py": 1,  # levels of boxes, at most MAX_LEVELS + 1
    "fieldmosaic/plans/stages.py": 3,  # zones of the index, at most MAX_ZONES + 1; a hash of rows; one lost tile
    "fieldmosaic/session.py": 1,  # a side to broadcast, max_rows + 1 rows
    "fieldmosaic/sources/samples.py": 1,  # one row on the types of the columns
}


def test_library_keeps_off_the_driver():
    found = {}
    for path in sorted(pathlib.Path(ROOT, "fieldmosaic").rglob("*.py")):
        name = str(path.relative_to(ROOT))
        if not name.startswith("fieldmosaic/llm/"):
            calls = re.findall(r"\.(?:collect|first|toArrow|toPandas|toLocalIterator|take|localCheckpoint|crossJoin)\(|\.rdd\b", path.read_text())
            if calls:
                found[name] = len(calls)
    assert found == ALLOWED
