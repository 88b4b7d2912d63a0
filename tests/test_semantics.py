"""Values and types of expressions over one literal row, and their errors."""

import datetime

import pytest
from pyspark.errors import PySparkException

from marlwick.errors import BindError, EngineError
from marlwick.session import Session


@pytest.fixture(scope="module")
def one(spark):
    s = Session(spark)
    s.register("one", spark.sql("SELECT 1L AS i, CAST(NULL AS BIGINT) AS n, 'Text a\\\\b' AS t, CAST(NULL AS STRING) AS nt, 1.5D AS f, -0.0D AS z, 9223372036854775807L AS big, true AS y, CAST(NULL AS BOOLEAN) AS u, CAST(NULL AS MAP<STRING, STRING>) AS nh, TIMESTAMP_NTZ'2024-02-29 01:02:03.5' AS ts, 1e308D AS huge, CAST(5 AS DECIMAL(20,0)) AS un"))
    return s


VALUES = {
    "i = 1": True, "i = n": False, "i <> n": False, "n < 3": False, "NOT (n = 1)": True, "NOT (i = n AND y)": True, "u AND FALSE": False, "u OR TRUE": True, "u AND TRUE": None, "NOT u": None,
    "i / 2": 0, "(0 - 7) / 2": -3, "(0 - 7) % 3": -1, "7 % (0 - 3)": 1, "i + n": None, "f * 2": 3.0, "i / 2.0": 0.5, "z + 0": 0.0, "- f": -1.5, "+ i": 1, "f > i": True, "i = 1.0": True,
    "t || '!'": "Text a\\b!", "t || nt": None, "t LIKE 'Text%'": True, "t LIKE '%a\\b'": True, "t LIKE 'text%'": False, "'É' LIKE '_'": True, "nt LIKE 'a'": None, "'a%b' LIKE 'a\\%b'": False,
    "5 BETWEEN 10 AND n": None, "NOT (5 BETWEEN 10 AND n)": None, "i BETWEEN 0 AND 1.5": True, "i IN (2, NULL)": None, "i IN (1, NULL)": True, "i NOT IN (2, NULL)": None,
    "n IS NULL": True, "i IS NOT NULL": True, "u IS UNKNOWN": True, "u IS NOT TRUE": True, "(n = 1) IS FALSE": True, "n IS DISTINCT FROM NULL": False, "n IS DISTINCT FROM 1": True,
    "COALESCE(n, 4)": 4, "NULLIF(i, 1)": None, "NULLIF(i, n)": 1, "CASE n WHEN NULL THEN 1 ELSE 2 END": 2, "CASE WHEN u THEN 1 WHEN y THEN 2 END": 2, "CASE WHEN u THEN 1 END": None,
    "CAST(1.0 AS TEXT)": "1", "CAST(f AS TEXT)": "1.5", "CAST(20000000.0 AS TEXT)": "20000000", "CAST(0.0001 AS TEXT)": "0.0001", "CAST('+12' AS INT64)": 12, "CAST('1e3' AS FLOAT64)": 1000.0, "CAST(y AS TEXT)": "true", "CAST('FALSE' AS BOOL)": False,
    "CAST(ts AS TEXT)": "2024-02-29T01:02:03.5Z", "CAST('2024-01-01 00:00:00.25' AS TIMESTAMP)": datetime.datetime(2024, 1, 1, 0, 0, 0, 250000), "CAST(CAST('{\"b\": 1, \"a\": [2.5, null]}' AS JSON) AS TEXT)": '{"a":[2.5,null],"b":1}', "CAST(NULL AS INT64)": None,
    "ARRAY[1, 2, NULL] @> ARRAY[NULL]": True, "ARRAY[1, 2] @> ARRAY[NULL]": False, "ARRAY[1, 2] @> ARRAY[2, 2]": True, "ARRAY['a'] @> ARRAY['b']": False, "ARRAY[1] = ARRAY[1]": True,
    "HSTORE('a' => '1', 'a' => '2') @> HSTORE('a' => '2')": True, "HSTORE('a' => NULL) @> HSTORE('a' => NULL)": True, "HSTORE('a' => NULL) ? 'a'": True, "HSTORE('a' => '1') ? 'b'": False, "nh ? 'a'": False, "NOT (nh ? 'a')": True, "nh @> HSTORE('a' => '1')": False, "HSTORE('a' => '1') = HSTORE('a' => '1')": True,
    "RANGE(1, 3, '[)') && RANGE(3, 5, '[)')": False, "RANGE(1, 3, '[]') && RANGE(3, 5, '[)')": True, "RANGE(NULL, 3, '[)') && RANGE(2, NULL, '[)')": True, "RANGE(3, 1, '[]') && RANGE(NULL, 9, '[]')": False, "RANGE(2, 2, '[)') && RANGE(1, 9, '[]')": False, "RANGE(1, 3, '[)') && RANGE(2, 2, '[]')": True,
    "ARRAY[RANGE(1, 3, '[)'), RANGE(0, 9, '[]')] && ARRAY[RANGE(3, 4, '[)'), RANGE(9, 10, '()')]": True, "ARRAY[RANGE(1, 2, '[)')] && ARRAY[RANGE(3, 4, '[)')]": False,
    "'The cat, the DOG' @@ 'cat & !bird'": True, "nt @@ 'cat'": False, "'The cat' @@ '(bird | cat) & the'": True, "text_rank('a b a', 'a | z')": 15 + 10 + 4, "text_rank('a b', 'z')": None, "text_rank('x', '!a')": 0, "text_rank(nt, 'a')": None,
    "text_phrase_match('one two three', 'one three', 2)": True, "text_phrase_match('one two three', 'one three', 1)": False, "text_phrase_match('a a b a c', 'a, c!', 1)": True, "text_phrase_match(nt, 'a', 1)": False, "text_contains('x y', 'y')": True, "'x y' @@ ('y' || '')": True, "text_rank(t, 'te' || 'xt')": 27, "text_phrase_match(t, 'text ' || 'a', i)": True,
    "un = un": True,
}


@pytest.mark.parametrize("text", VALUES)
def test_value(one, text):
    got = one.sql(f"SELECT {text} AS x FROM one").collect()[0][0]
    assert got == VALUES[text] and type(got) is type(VALUES[text])


@pytest.mark.parametrize("text", ["big + 1", "big * 2", "1 / 0", "1 % 0", "f / 0.0", "huge * 10.0", "CAST('x' AS INT64)", "CAST(' 1' AS INT64)", "CAST('maybe' AS BOOL)", "CAST('2024-02-30 00:00:00' AS TIMESTAMP)", "CAST('nope' AS UUID)", "CAST('{' AS JSON)", "CAST('1e999' AS FLOAT64)", "ARRAY[RANGE(1, 2, '[)')] && ARRAY[RANGE(1, 2, '[)'), RANGE(1, 2, '[)')]", "nt @@ (nt || '')"])
def test_raises(one, text):
    with pytest.raises(PySparkException):
        one.sql(f"SELECT {text} AS x FROM one").collect()


@pytest.mark.parametrize("text", ["i = t", "i || t", "f % 2", "t + 1", "NOT i", "nosuch", "one.nosuch", "ARRAY[]", "ARRAY[1, 'a']", "CAST(f AS INT64)", "un + 1", "un = i", "COALESCE(i, t)", "i IN ('a')", "nh < nh", "t @@ 'a b'", "t @@ 'a &'", "text_phrase_match(t, 'a', 0)", "text_phrase_match(t, '!!', 1)", "nosuch(i)", "SUM(f)", "SUM(SUM(i))", "i <~> i", "RANGE(NULL, NULL, '[)')", "RANGE(1, 'a', '[)')", "MIN(nh)"])
def test_does_not_bind(one, text):
    with pytest.raises(EngineError):
        one.sql(f"SELECT {text} AS x FROM one")


@pytest.mark.parametrize("text", ["SELECT i FROM one HAVING i > 1", "SELECT i FROM one WHERE COUNT(*) > 1", "SELECT nh FROM one GROUP BY nh", "SELECT i FROM one ORDER BY nh", "SELECT i FROM one ORDER BY 5", "SELECT i FROM one UNION SELECT t FROM one", "SELECT i FROM one UNION SELECT i, t FROM one", "SELECT i FROM nosuch", "SELECT i FROM one WHERE i IN (SELECT i, t FROM one)", "SELECT i FROM one WHERE RANK() OVER (ORDER BY i) = 1", "SELECT RANK() OVER (ORDER BY i) AS r FROM one ORDER BY r", "WITH RECURSIVE c(a) AS (SELECT i FROM one UNION ALL SELECT a FROM one) SELECT a FROM c", "SELECT i FROM one JOIN LATERAL one ON i > 1"])
def test_query_does_not_bind(one, text):
    with pytest.raises(EngineError):
        one.sql(text)


def test_names(one):
    assert one.sql("SELECT i, i + 1, one.t, COUNT(*) AS c FROM one GROUP BY i, t, one.t").columns == ["i", "expr2", "t", "c"]


def test_scalar_subquery_with_two_rows_is_an_error(one, spark):
    one.register("two", spark.range(2))
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        one.sql("SELECT (SELECT id FROM two) AS x FROM one").collect()
    assert one.sql("SELECT (SELECT id FROM two WHERE id > 9) AS x FROM one").collect()[0][0] is None


def test_strict_refuses_what_the_default_accepts(spark, data):
    texts = ["SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL", "SELECT COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey", "SELECT o_orderkey FROM orders JOIN LATERAL customer ON customer.c_custkey = orders.o_custkey"]
    loose = Session(spark).register_parquet(data, "customer", "orders")
    strict = Session(spark, strict=True).register_parquet(data, "customer", "orders")
    for t in texts:
        loose.sql(t)
        with pytest.raises(BindError):
            strict.sql(t)
    for t in ("WITH RECURSIVE n(i) AS (SELECT c_custkey FROM customer UNION ALL SELECT i + 1 FROM n WHERE i BETWEEN 0 AND 3) SELECT i FROM n", "WITH RECURSIVE n(i) AS (SELECT c_custkey FROM customer UNION ALL SELECT i + 1 FROM n WHERE i < 3) SELECT COUNT(*) FROM n", "CREATE TABLE t (a INT64, b BOOL GENERATED ALWAYS AS (a IS NULL) STORED)", "CREATE INDEX e ON customer (CASE WHEN c_custkey = 1 THEN 1 ELSE 2 END)"):
        with pytest.raises(BindError):
            strict.execute(t)
        loose.execute(t)
    strict.execute("CREATE INDEX by_key ON customer (c_custkey)")
    assert strict.sql(texts[2]).count() == loose.sql(texts[2]).count()


def test_recursion_limit(spark, data, monkeypatch):
    s = Session(spark).register_parquet(data, "region")
    text = "WITH RECURSIVE n(i) AS (SELECT r_regionkey FROM region WHERE r_regionkey = 0 UNION ALL SELECT i + 1 FROM n WHERE i < {}) SELECT i FROM n"
    assert s.sql(text.format(150)).count() == 151  # beyond Spark's own default of 100 levels
    monkeypatch.setattr("marlwick.session.RECURSION_LIMIT", 20)
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        s.sql(text.format(50)).count()


def test_comparisons_keep_equi_joins_and_pushdown(spark, data):
    s = Session(spark).register_parquet(data, "orders", "customer")
    plan = s.execute("EXPLAIN PHYSICAL SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000.0 AND c_acctbal < 5.0").text
    assert "NestedLoop" not in plan and "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


# --- laws


@pytest.mark.parametrize("p", ["v = 3", "v < 10", "etype >= 'm'", "value > 50.0"])
def test_a_comparison_or_its_negation_holds(spark, data, p):
    from marlwick.queries import session

    s = session(spark, data, "events_null")
    n = [s.sql(f"SELECT COUNT(*) AS n FROM events_null{w}").collect()[0][0] for w in ("", f" WHERE {p}", f" WHERE NOT ({p})")]
    assert n[0] == n[1] + n[2]


def test_except_all_and_intersect_all_make_the_left_side(spark, data):
    s = Session(spark).register_parquet(data, "customer", "supplier")
    n = [s.sql(f"SELECT c_nationkey FROM customer {op} SELECT s_nationkey FROM supplier").count() for op in ("EXCEPT ALL", "INTERSECT ALL")]
    assert sum(n) == s.sql("SELECT c_nationkey FROM customer").count()


def test_cube_is_a_union_of_groupings(spark, data):
    s = Session(spark).register_parquet(data, "orders")
    cube = s.sql("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)").collect()
    parts = s.sql("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())").collect()
    assert sorted(map(repr, cube)) == sorted(map(repr, parts))
