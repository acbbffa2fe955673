"""CSV readers on raw text, and the schemas."""

import pytest

from emberlane.sources import SCHEMAS, read_csv_blank, read_csv_null

TEXT = 'BIN,COMMUNITY.BOARD,PREM ADDR,n\n1,"",a,1\n2,,NA,\n3,"x, y",b,NA\n'


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(TEXT)
    return str(path)


def test_blank_and_na_are_null(spark, csv_file):
    df = read_csv_null(spark, csv_file, "BIN int, `COMMUNITY.BOARD` string, `PREM ADDR` string, n int")
    assert [tuple(r) for r in df.orderBy("BIN").collect()] == [(1, None, "a", 1), (2, None, None, None), (3, "x, y", "b", None)]


def test_blank_text_is_kept_and_names_cleaned(spark, csv_file):
    df = read_csv_blank(spark, csv_file, "BIN int, `COMMUNITY.BOARD` string, `PREM ADDR` string, n int")
    assert df.columns == ["BIN", "COMMUNITY_BOARD", "PREM_ADDR", "n"]
    assert [tuple(r) for r in df.orderBy("BIN").collect()] == [(1, "", "a", 1), (2, "", None, None), (3, "x, y", "b", None)]


def test_types_can_be_inferred(spark, csv_file):
    assert dict(read_csv_null(spark, csv_file).dtypes)["BIN"] == "int"
    assert read_csv_blank(spark, csv_file).columns == ["BIN", "COMMUNITY_BOARD", "PREM_ADDR", "n"]


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schemas_parse(spark, name):
    df = spark.read.schema(SCHEMAS[name]).parquet  # the reader accepts the DDL
    assert df is not None and len(spark.createDataFrame([], SCHEMAS[name]).columns) > 5
