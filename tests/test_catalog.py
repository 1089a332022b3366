"""Every query against its SQL on the stored tables."""

import duckdb
import pytest
from conftest import DATA

from webloom.catalog import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            missing = v is None or v != v or str(v) == "<NA>"
            cells.append("-" if missing else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
        rows.append(tuple(cells))
    return list(frame.columns), sorted(rows)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sql, name):
    columns, rows = normal(all_queries()[name](spark, DATA).toPandas())
    want_columns, want_rows = normal(sql.execute(all_oracles()[name]).df())
    assert columns == want_columns
    assert rows == want_rows


def test_repeated_patterns_tell_targets_apart(spark):
    """Every clicked target in full, as many rows as the unranked query has."""
    found = all_queries()["repeated_patterns"](spark, DATA).collect()
    assert {r.pattern for r in found if r.pattern.startswith("clicking")} == {f"clicking #e{k}" for k in range(4)}
    assert len(found) == all_queries()["repeated_patterns_intended"](spark, DATA).count()
