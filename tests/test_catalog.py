"""Registered queries against their SQL on the smallest tables, and the entry points of the check tool."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__
from check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_entry_has_rows_and_a_stable_schema(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
    assert frame.columns == ["series_id", "day", "hours", "temp_hours", "temp", "dew"]


def test_sql_names_are_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_other_queries_register_where_packages_of_the_operators_are_absent():
    """Without what the training-data operators import, or without them, all other queries are there."""
    hide = "import sys; sys.modules.update(dict.fromkeys(['regex', 'xxhash']))"
    code = f"{hide}; sys.path.insert(0, {str(Path(__spark_entry__.__file__).parent)!r}); import __spark_entry__ as e; print('QUERIES', *e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    names = out.stdout.split("QUERIES")[1].split()
    assert set(__spark_entry__.REGISTRY) <= set(names) and "op7_bpe" not in names


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    assert compare(spark, db, SF_DIR, name) is None
