"""Every registered query against its SQL twin, and against itself with another partitioning."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_every_query_is_checked():
    from stackloom.plans import catalog, oracle

    assert set(ORACLES) <= set(QUERIES)
    assert set(catalog.QUERIES) == set(oracle.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["error_families", "log_file_groups", "history_new", "source_budget", "recall_blocked", "occurrence_number", "log_groups_merged", "resolve_indexed", "recall_approx"])
def test_result_does_not_depend_on_partitions(spark, name):
    results = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = QUERIES[name](spark, SF)
            results.append(rows(df.columns, df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


@pytest.mark.parametrize("name", ["error_groups", "parse_frames", "context_json", "parse_sections", "detect_language"])
def test_per_document_work_is_not_shuffled(spark, name):
    """The only exchanges are those of the derived input."""
    from stackloom.plans import inputs

    view = inputs.errors if name != "parse_sections" else lambda s, d: inputs.responses(s, d).unionByName(inputs.turns(s, d))

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(QUERIES[name](spark, SF)) == exchanges(view(spark, SF))
