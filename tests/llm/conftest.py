import duckdb
import pandas as pd
import pytest

LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(12_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and count the passing clouds until night falls over the quiet valley and the river turns to silver"


@pytest.fixture
def awkward(spark):
    """Documents with nulls in every column, empty, very long, repeated and near texts, and columns with clashing names."""
    rows = [
        (0, BASE, "en", "a", len(BASE), 1.0, "x", "y"),
        (1, BASE, "en", "a", len(BASE), 2.0, "x", "y"),
        (2, BASE + " indeed", "en", None, 1, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0.0, "", ""),
        (5, " \t\n\x0b\x0c\r ", "en", "b", 7, 0.0, "", ""),
        (6, LONG, "de", "b", len(LONG), 0.0, "", ""),
        (7, "one two three", "de", "b", 13, 0.0, "", ""),
        (8, "ONE two  three", "de", "b", 14, 0.0, "", ""),
        (9, "émigré naïve     日本語 👩‍👩‍👧 $$$ ***", "fr", "c", 5, 0.0, "", ""),
        (9, "émigré naïve     日本語 👩‍👩‍👧 $$$ ***", "fr", "c", 5, 0.0, "", ""),
        (None, BASE, "en", "a", 1, 0.0, "", ""),
        (11, "lead in words " + BASE + " some other tail", "en", "a", 1, 0.0, "", ""),
        (12, "a line\n" * 40 + BASE, "en", "a", 1, 0.0, "", ""),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words double, key string, row string")


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture
def sql():
    def run(query, **tables):
        connection = duckdb.connect()
        for name, pdf in tables.items():
            connection.register(f"{name}_in", pdf)
            connection.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_in")
        return connection.execute(query).df()

    return run


def records(df):
    """Rows as a sorted list of tuples, by column name."""
    pdf = df.toPandas() if hasattr(df, "toPandas") else df
    cols = sorted(pdf.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v)
    out = [tuple(clean(v) for v in row) for row in pdf[cols].itertuples(index=False)]
    out = [tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in row) for row in out]
    return sorted(out, key=repr)
