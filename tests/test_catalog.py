import duckdb
import pytest

import __spark_entry__ as entry
from quaestor.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    assert rows
    if name in catalog.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        at = [names.index(c) for c in sorted(names)]
        assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
