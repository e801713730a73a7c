"""Every frame query over the smallest tables against its SQL."""

import os

import pytest

from framemill.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("the tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def said(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]).lower() for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert said([tuple(r) for r in df.collect()], df.columns) == said(got.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_entry_without_training_data():
    import subprocess
    import sys

    code = "import sys; sys.modules['framemill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n == 'pipeline' or n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
