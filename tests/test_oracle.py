"""Every query of the dialect against its SQL in DuckDB."""

import pytest

from marlwick import queries


def same(rows, names, cursor):
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(names)

    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    ours = sorted(repr([plain(r[n]) for n in sorted(names)]) for r in rows)
    theirs = sorted(repr([plain(r[columns.index(n)]) for n in sorted(names)]) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    same(df.collect(), df.columns, duck.execute(queries.ORACLE[name]))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)
