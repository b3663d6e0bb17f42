import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", SMALL)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def duck():
    """duck(sql, **tables): rows of the SQL over pandas tables, as sorted tuples by sorted column names."""

    def run(sql, **tables):
        con = duckdb.connect()
        for k, v in tables.items():
            con.register(k, v)
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)

    return run


def sorted_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
