import pytest


@pytest.fixture
def table(spark):
    """A small table from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def docs(table):
    """Documents with all columns, some of which clash with names that operators use."""

    def build(*rows, extra="score double, n_lines bigint, node bigint, gram bigint, words string, key bigint"):
        width = len(extra.split(","))
        rows = [(i, t, lang, source, None if t is None else len(t), *[None] * width) for i, t, lang, source in rows]
        return table(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")

    return build
