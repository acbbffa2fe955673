"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from emberlane.catalog.registry import QUERIES
from tests.conftest import SMALL

# The text operators' queries have tests of their own.
ALL = sorted(QUERIES)


# On the smallest data a feature tells the classes apart without error, so the likelihood has no maximum and its estimates
# grow until the iterations end. These are compared on data where there is one.
NO_MAXIMUM = {"ml_logit", "ml_logit_scores", "ml_logit_weighted", "job_box_scores", "eval_model_table"}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cons():
    return {folder: duck(folder) for folder in (SMALL, LARGER)}


@pytest.mark.parametrize("name", ALL)
def test_query_matches_sql(spark, cons, name):
    folder = LARGER if name in NO_MAXIMUM else SMALL
    good, note = compare(spark, cons[folder], folder, name)
    assert good, note


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_zip_features(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "ZIPCODE" and df.count() == 11
