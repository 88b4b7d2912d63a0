"""Queries over the supplied tables, one or more for each operator of the dialect, and the same in plain SQL.

Every query runs over whole tables through the dialect's own parser and binder.  Fixtures that the tables don't hold as such
(arrays, hstores, ranges, null values) are projections of them, given for both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import BindError, ConstraintError, SecurityError
from .functions import fts
from .session import Session
from .sources.store import load_parquet
from .udf import Registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _range(low, high) -> F.Column:
    empty = F.coalesce(low >= high, F.lit(False))
    return F.struct(low.alias("lower"), high.alias("upper"), F.lit(True).alias("lower_inc"), F.lit(False).alias("upper_inc"), empty.alias("is_empty"))


def _fixtures(spark: SparkSession, d: str, wanted: set[str]) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    out: dict[str, DataFrame] = {}
    if "events_null" in wanted:
        out["events_null"] = read("events").select("event_id", F.expr("nullif(event_type, 'error')").alias("etype"), F.expr("nullif(user_id, 8)").alias("v"), "value")
    if "part_tags" in wanted:
        out["part_tags"] = read("part").select("p_partkey", F.array("p_brand", "p_type", F.expr("nullif(p_name, 'red widget')")).alias("tags"))
    if "event_attrs" in wanted:
        out["event_attrs"] = read("events").select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("flag"), F.expr("if(event_type = 'error', NULL, 'ok')")).alias("attrs"))
    if "order_range" in wanted:
        out["order_range"] = read("orders").select("o_orderkey", _range(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 50).alias("r"))
    if "line_box" in wanted:
        n, s = F.col("l_linenumber").cast("long"), F.col("l_suppkey")
        out["line_box"] = read("lineitem").select("l_orderkey", "l_linenumber", F.array(_range(n, n + 2), _range(s, s + 10)).alias("box"))
    if "doc_vector" in wanted:
        out["doc_vector"] = read("documents").select("doc_id", F.expr(fts.vector("text")).alias("tv"))
    if "ts_text" in wanted:
        out["ts_text"] = read("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("s"), F.col("o_orderkey").cast("string").alias("k"))
    return out


def session(spark: SparkSession, d: str, text: str, encryption_key: str | None = None) -> Session:
    """A session that knows the tables that a text speaks of."""
    words = set(text.lower().replace(",", " ").replace("(", " ").replace(".", " ").split())
    s = Session(spark, encryption_key=encryption_key)
    s.register_parquet(d, *(t for t in TABLES if t in words))
    for n, df in _fixtures(spark, d, words).items():
        s.register(n, df)
    return s


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: session(spark, d, text).sql(text)


EVENTS_NULL = "(SELECT event_id, nullif(event_type, 'error') AS etype, nullif(user_id, 8) AS v, value FROM events)"
TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"
DOC_TOKENS = f"(SELECT doc_id, {TOKENS} AS k FROM documents)"

#: name: (dialect, SQL); None for SQL means the dialect's text itself.
_PAIRS: dict[str, tuple[str, str | None]] = {
    # scans, projection, filters
    "pricing_summary": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag ORDER BY l_returnflag", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag"),
    "scan_wildcard": ("SELECT * FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "project_expression": ("SELECT o_orderkey + o_custkey AS k, o_totalprice * 2 AS p FROM orders", None),
    "filter_project": ("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", None),
    "filter_equality": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77", None),
    "filter_range": ("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_totalprice < 200000.0", None),
    "like_no_escape": ("SELECT p_partkey, p_name LIKE '%e_ w%' AS hit, 'a\\b' LIKE 'a\\b' AS slash, 'a%b' LIKE 'a\\%b' AS percent FROM part", "SELECT p_partkey, p_name LIKE '%e_ w%' AS hit, true AS slash, false AS percent FROM part"),
    "between_not": ("SELECT event_id, v BETWEEN 5 AND 20 AS b, v NOT BETWEEN 5 AND 20 AS nb, 5 BETWEEN 10 AND v AS half FROM events_null", f"SELECT event_id, v BETWEEN 5 AND 20 AS b, v NOT BETWEEN 5 AND 20 AS nb, CASE WHEN v IS NOT NULL THEN 5 BETWEEN 10 AND v END AS half FROM {EVENTS_NULL}"),
    "in_list_null": ("SELECT event_id FROM events_null WHERE etype IN ('view', 'click') AND v NOT IN (1, 2, 3)", f"SELECT event_id FROM {EVENTS_NULL} WHERE etype IN ('view', 'click') AND v NOT IN (1, 2, 3)"),
    "case_coalesce_nullif": ("SELECT event_id, CASE etype WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS c, CASE WHEN v > 10 THEN 'hi' WHEN v <= 10 THEN 'lo' END AS h, COALESCE(etype, 'none') AS e, NULLIF(v, 9) AS n FROM events_null", f"SELECT event_id, CASE etype WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END::BIGINT AS c, CASE WHEN v > 10 THEN 'hi' WHEN v <= 10 THEN 'lo' END AS h, coalesce(etype, 'none') AS e, nullif(v, 9) AS n FROM {EVENTS_NULL}"),
    "null_comparison_not": ("SELECT event_id, v = 3 AS eq, v <> 3 AS ne, v < 3 AS lt, NOT (v = 3) AS neq, NOT (etype >= 'signup') AS nge FROM events_null", f"SELECT event_id, coalesce(v = 3, false) AS eq, coalesce(v <> 3, false) AS ne, coalesce(v < 3, false) AS lt, NOT coalesce(v = 3, false) AS neq, NOT coalesce(etype >= 'signup', false) AS nge FROM {EVENTS_NULL}"),
    "is_tests": ("SELECT event_id, v IS NULL AS a, v IS NOT NULL AS b, (v IN (1, 2)) IS UNKNOWN AS c, (v IN (1, 2)) IS NOT TRUE AS d, (v > 5) IS FALSE AS e, v IS DISTINCT FROM 3 AS f FROM events_null", f"SELECT event_id, v IS NULL AS a, v IS NOT NULL AS b, (v IN (1, 2)) IS NULL AS c, coalesce(v IN (1, 2), false) = false AS d, NOT coalesce(v > 5, false) AS e, v IS DISTINCT FROM 3 AS f FROM {EVENTS_NULL}"),
    "logic_null": ("SELECT event_id FROM events_null WHERE (v > 10 OR etype = 'view') AND NOT (v < 3)", f"SELECT event_id FROM {EVENTS_NULL} WHERE (v > 10 OR etype = 'view') AND NOT coalesce(v < 3, false)"),
    "int_division_modulo": ("SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, (3 - l_orderkey) % 7 AS m, - l_linenumber AS neg, l_quantity / 4 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey // 7 AS q, (3 - l_orderkey) % 7 AS m, -l_linenumber::BIGINT AS neg, l_quantity / 4 AS f FROM lineitem"),
    "concat": ("SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS label FROM orders", None),
    "cast_pairs": ("SELECT o_orderkey, CAST(k AS INT64) AS i, CAST(o_orderkey AS FLOAT64) AS f, CAST(CAST(s AS TIMESTAMP) AS TEXT) AS t, CAST('tRuE' AS BOOL) AS b, CAST(CAST(o_orderkey AS FLOAT64) AS TEXT) AS ft FROM ts_text", "SELECT o_orderkey, o_orderkey AS i, o_orderkey::DOUBLE AS f, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t, true AS b, o_orderkey::VARCHAR AS ft FROM orders"),
    "json_uuid_casts": ("SELECT event_id, CAST(CAST(props AS JSON) AS TEXT) AS j, CAST(CAST('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11' AS UUID) AS TEXT) AS u FROM events", "SELECT event_id, replace(props, ' ', '') AS j, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS u FROM events"),
    # joins and subqueries
    "hash_join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000.0", None),
    "hash_join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000.0", None),
    "theta_join": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey OR n_nationkey = r_regionkey", None),
    "join_renamed_columns": ("SELECT * FROM region LEFT JOIN region ON region.r_regionkey = inner_r_regionkey", "SELECT a.r_regionkey::BIGINT AS r_regionkey, a.r_name, b.r_regionkey::BIGINT AS inner_r_regionkey, b.r_name AS inner_r_name FROM region a LEFT JOIN region b ON a.r_regionkey = b.r_regionkey"),
    "lateral_join": ("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN LATERAL orders ON orders.o_orderkey = lineitem.l_orderkey", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey"),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000.0)", None),
    "not_in_null": ("SELECT event_id FROM events_null WHERE v NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 9)", f"SELECT event_id FROM {EVENTS_NULL} WHERE v NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 9)"),
    "in_corr": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE orders.o_orderkey > customer.c_nationkey AND o_orderstatus = 'P')", None),
    "exists_uncorrelated": ("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey = 3)", None),
    "exists_corr": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_totalprice > 300000.0)", None),
    "not_exists_corr": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_totalprice > 100000.0)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)", None),
    "scalar_subquery_corr": ("SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE orders.o_custkey = customer.c_custkey) AS m FROM customer", None),
    # aggregation
    "agg_scalar": ("SELECT COUNT(*) AS n, COUNT(v) AS nv, COUNT(DISTINCT etype) AS d, SUM(v) AS s, MIN(value) AS lo, MAX(etype) AS hi FROM events_null", f"SELECT count(*) AS n, count(v) AS nv, count(DISTINCT etype) AS d, CAST(sum(v) AS BIGINT) AS s, min(value) AS lo, max(etype) AS hi FROM {EVENTS_NULL}"),
    "agg_scalar_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_grouped": ("SELECT etype, COUNT(*) AS n, SUM(v) AS s, MAX(value) AS hi FROM events_null GROUP BY etype", f"SELECT etype, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, max(value) AS hi FROM {EVENTS_NULL} GROUP BY etype"),
    "group_by_ordinal_alias": ("SELECT o_custkey % 10 AS b, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY b, 2", "SELECT o_custkey % 10 AS b, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"),
    "count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag", None),
    "having_hidden": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 450000.0 AND n > 5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 450000.0 AND count(*) > 5"),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, SUM(o_custkey) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), (o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), (o_orderpriority), ())"),
    "grouping_sets_empty": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY GROUPING SETS ((o_orderstatus), ())", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)"),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus) HAVING COUNT(*) > 10", None),
    # windows, order, limits
    "row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", None),
    "rank": ("SELECT s_suppkey, RANK() OVER (ORDER BY s_nationkey) AS rk, DENSE_RANK() OVER (ORDER BY s_nationkey DESC) AS dr FROM supplier", None),
    "dense_rank": ("SELECT o_orderkey, DENSE_RANK() OVER (ORDER BY o_orderpriority) AS dr FROM orders", None),
    "row_number_ties": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus) AS rn FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey DESC) AS rn FROM orders"),
    "topk_nulls_first": ("SELECT event_id, v FROM events_null ORDER BY v DESC, event_id LIMIT 25", f"SELECT event_id, v FROM {EVENTS_NULL} ORDER BY v DESC NULLS FIRST, event_id LIMIT 25"),
    "order_nulls_explicit": ("SELECT event_id, etype FROM events_null ORDER BY etype NULLS FIRST, event_id DESC LIMIT 30", f"SELECT event_id, etype FROM {EVENTS_NULL} ORDER BY etype ASC NULLS FIRST, event_id DESC LIMIT 30"),
    "limit_offset": ("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 7", None),
    "fetch_first": ("SELECT p_partkey FROM part ORDER BY 1 DESC OFFSET 3 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY 1 DESC LIMIT 5 OFFSET 3"),
    "order_by_scalar_subquery": ("SELECT n_name FROM nation ORDER BY (SELECT MAX(r_name) FROM region WHERE region.r_regionkey = nation.n_regionkey), n_nationkey LIMIT 7", "SELECT n_name FROM nation ORDER BY (SELECT max(r_name) FROM region WHERE region.r_regionkey = nation.n_regionkey) ASC NULLS LAST, n_nationkey LIMIT 7"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_order_limit": ("SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 4", "SELECT p_brand FROM (SELECT p_brand, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS f FROM part) WHERE f = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 4"),
    # set operations, recursion
    "union_all": ("SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union": ("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "intersect_all": ("SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "except": ("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0.0", None),
    "except_all": ("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "setop_left_assoc": ("SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1 ORDER BY n_regionkey", "(SELECT n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region) INTERSECT (SELECT r_regionkey FROM region WHERE r_regionkey > 1)"),
    "recursive_series": ("WITH RECURSIVE n(i, label) AS (SELECT r_regionkey, r_name FROM region UNION ALL SELECT i + 5, label FROM n WHERE i < 600) SELECT i, label FROM n WHERE i % 2 = 0", "WITH RECURSIVE n(i, label) AS (SELECT r_regionkey::BIGINT, r_name FROM region UNION ALL SELECT i + 5, label FROM n WHERE i < 600) SELECT i, label FROM n WHERE i % 2 = 0"),
    # nested types
    "array_contains_all": ("SELECT p_partkey, tags @> ARRAY['Brand#11'] AS one, tags @> ARRAY[NULL] AS nul, tags @> ARRAY['Brand#11', 'none'] AS none FROM part_tags", "SELECT p_partkey, p_brand = 'Brand#11' OR p_type = 'Brand#11' AS one, p_name = 'red widget' AS nul, false AS none FROM part"),
    "hstore_key": ("SELECT event_id FROM event_attrs WHERE attrs ? 'flag' AND NOT (attrs ? 'other')", "SELECT event_id FROM events"),
    "hstore_contains": ("SELECT event_id, attrs @> HSTORE('flag' => NULL) AS err, attrs @> HSTORE('type' => 'click', 'flag' => 'ok') AS click FROM event_attrs", "SELECT event_id, event_type = 'error' AS err, event_type = 'click' AS click FROM events"),
    "range_overlap": ("SELECT o_orderkey, r && RANGE(100, 160, '[]') AS a, r && RANGE(NULL, 50, '[)') AS b, r && RANGE(20, 20, '[)') AS c FROM order_range", "SELECT o_orderkey, w > 0 AND o_orderkey <= 160 AND o_orderkey + w > 100 AS a, w > 0 AND o_orderkey < 50 AS b, false AS c FROM (SELECT o_orderkey, o_custkey % 50 AS w FROM orders)"),
    "bounds_overlap": ("SELECT l_orderkey, l_linenumber FROM line_box WHERE box && ARRAY[RANGE(3, 4, '[)'), RANGE(20, 30, '()')]", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_linenumber <= 4 AND l_linenumber + 2 >= 3 AND l_suppkey <= 30 AND l_suppkey + 10 >= 20"),
    # text search
    "fts_match": ("SELECT doc_id FROM documents WHERE text @@ 'the & (and | !of) & !disgusting'", f"SELECT doc_id FROM {DOC_TOKENS} WHERE list_contains(k, 'the') AND (list_contains(k, 'and') OR NOT list_contains(k, 'of')) AND NOT list_contains(k, 'disgusting')"),
    "fts_rank": ("SELECT doc_id, text_rank(text, 'the & !trash | and') AS r FROM documents", f"SELECT doc_id, CASE WHEN list_contains(k, 'the') AND NOT list_contains(k, 'trash') OR list_contains(k, 'and') THEN (CASE WHEN list_contains(k, 'the') THEN 26 - least(list_position(k, 'the'), 16) + 2 * len(list_filter(k, lambda x: x = 'the')) ELSE 0 END + CASE WHEN list_contains(k, 'and') THEN 26 - least(list_position(k, 'and'), 16) + 2 * len(list_filter(k, lambda x: x = 'and')) ELSE 0 END)::BIGINT END AS r FROM {DOC_TOKENS}"),
    "fts_phrase": ("SELECT doc_id, text_phrase_match(text, 'of the', 1) AS near, text_phrase_match(text, 'of the', 4) AS far FROM documents", f"SELECT doc_id, list_contains(list_transform(range(1, len(k)), lambda i: k[i] = 'of' AND k[i + 1] = 'the'), true) AS near, list_contains(list_transform(range(1, len(k) + 1), lambda i: k[i] = 'of' AND list_contains(k[i + 1 : i + 4], 'the')), true) AS far FROM {DOC_TOKENS}"),
    "fts_phrase_terms": ("SELECT doc_id FROM documents WHERE text_phrase_match(text, 'Of, THE!', 20)", f"SELECT doc_id FROM {DOC_TOKENS} WHERE list_contains(list_transform(range(1, len(k) + 1), lambda i: k[i] = 'of' AND list_contains(k[i + 1 : i + 20], 'the')), true)"),
    "fts_optional": ("SELECT doc_id FROM documents WHERE text @@ '(licensed | warranty) & !password'", f"SELECT doc_id FROM {DOC_TOKENS} WHERE (list_contains(k, 'licensed') OR list_contains(k, 'warranty')) AND NOT list_contains(k, 'password')"),
    "subquery_in_on": ("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > (SELECT MIN(s_acctbal) FROM supplier )", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > (SELECT min(s_acctbal) FROM supplier)"),
    "fts_vector": ("SELECT doc_id, text_rank(tv, 'the | and') AS r, tv @@ '!the' AS absent FROM doc_vector", f"SELECT doc_id, CASE WHEN list_contains(k, 'the') OR list_contains(k, 'and') THEN (CASE WHEN list_contains(k, 'the') THEN 26 - least(list_position(k, 'the'), 16) + 2 * len(list_filter(k, lambda x: x = 'the')) ELSE 0 END + CASE WHEN list_contains(k, 'and') THEN 26 - least(list_position(k, 'and'), 16) + 2 * len(list_filter(k, lambda x: x = 'and')) ELSE 0 END)::BIGINT END AS r, NOT list_contains(k, 'the') AS absent FROM {DOC_TOKENS}"),
}


# --- policies, mutations and functions


def row_policy_filter(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "orders")
    for text in ("CREATE ROLE clerk", "GRANT SELECT ON TABLE orders TO clerk", "CREATE POLICY open ON orders USING (o_orderstatus = 'O')", "CREATE POLICY small ON orders USING (o_totalprice < 250000.0)"):
        s.execute(text)
    return s.as_role("clerk").sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'")


def _copied(spark: SparkSession, d: str) -> Session:
    """A session with a table of the customers that can be changed."""
    s = session(spark, d, "customer")
    s.execute("CREATE TABLE accounts (id INT64 NOT NULL, segment TEXT, nation INT64, twice INT64 GENERATED ALWAYS AS (nation + nation) STORED)")
    s.insert_rows("accounts", s.sql("SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer"))
    return s


def generated_column(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("UPDATE accounts SET nation = nation + 100 WHERE segment = 'BUILDING'")
    return s.sql("SELECT id, nation, twice FROM accounts")


def dml_update_delete(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("DELETE FROM accounts WHERE nation < 3")
    s.execute("UPDATE accounts SET segment = segment || '!' WHERE nation BETWEEN 10 AND 12")
    s.execute("INSERT INTO accounts (id, segment) VALUES (-1, 'NEW')")
    return s.sql("SELECT id, segment, nation, twice FROM accounts")


def transaction_rollback(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("BEGIN")
    s.execute("DELETE FROM accounts")
    s.execute("ROLLBACK")
    return s.sql("SELECT segment, COUNT(*) AS n FROM accounts GROUP BY segment")


def fk_violation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a foreign key lets in, after others were refused."""
    s = session(spark, d, "orders customer")
    s.execute("CREATE TABLE parents (id INT64 NOT NULL)")
    s.execute("CREATE UNIQUE INDEX parent ON parents (id)")
    s.execute("CREATE TABLE children (k INT64, parent INT64 REFERENCES parents (id))")
    s.insert_rows("parents", s.sql("SELECT c_custkey AS id FROM customer WHERE c_custkey > 100"))
    s.insert_rows("children", s.sql("SELECT o_orderkey AS k, o_custkey AS parent FROM orders WHERE o_custkey > 100"))
    _refused(ConstraintError, s.insert_rows, "children", s.sql("SELECT o_orderkey AS k, o_custkey AS parent FROM orders"))
    _refused(ConstraintError, s.execute, "DELETE FROM parents")
    return s.sql("SELECT k, parent FROM children")


def _refused(kind: type, call: Callable, *args) -> None:
    try:
        call(*args)
    except kind:
        return
    raise AssertionError(f"no {kind.__name__}")


def unique_violation(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("CREATE UNIQUE INDEX by_id ON accounts (id)")
    _refused(ConstraintError, s.insert_rows, "accounts", s.sql("SELECT c_custkey AS id, c_name AS segment, c_nationkey AS nation FROM customer"))
    _refused(ConstraintError, s.execute, "UPDATE accounts SET id = 1")
    s.execute("INSERT INTO accounts (id, segment) VALUES (-1, 'NEW')")
    return s.sql("SELECT segment, COUNT(*) AS n FROM accounts GROUP BY segment")


def policy_on_write(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    for text in ("CREATE ROLE clerk", "GRANT SELECT ON TABLE accounts TO clerk", "GRANT INSERT ON TABLE accounts TO clerk", "CREATE POLICY few ON accounts USING (nation < 5)"):
        s.execute(text)
    clerk = s.as_role("clerk")
    clerk.execute("INSERT INTO accounts (id, segment, nation) VALUES (-1, 'NEW', 4)")
    _refused(SecurityError, clerk.execute, "INSERT INTO accounts (id, segment, nation) VALUES (-2, 'NEW', 9)")
    return clerk.sql("SELECT id, segment, nation FROM accounts")


def drop_and_create(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("DROP TABLE accounts")
    _refused(BindError, s.sql, "SELECT id FROM accounts")
    s.execute("CREATE TABLE accounts (name TEXT)")
    s.insert_rows("accounts", s.sql("SELECT c_name AS name FROM customer"))
    return s.sql("SELECT name FROM accounts")


def overloaded_function(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "orders")
    s.create_function("doubled", ("int64",), "int64", lambda x: x * 2)
    s.create_function("doubled", ("text",), "text", lambda x: x + x)
    return s.sql("SELECT o_orderkey, doubled(o_custkey) AS n, doubled(o_orderstatus) AS t FROM orders")


def _width(v: pd.Series) -> int:
    return int(v.max() - v.min())


def _long_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"k": f["c_custkey"], "size": f["c_name"].str.len() + f["c_mktsegment"].str.len()})


def aggregate_udf(spark: SparkSession, d: str) -> DataFrame:
    r, kinds = Registry(), ("int64",)
    r.define("width", "aggregate", kinds, "int64", _width)
    return load_parquet(spark, d, "orders").groupBy("o_orderpriority").agg(r.column("width", kinds, "o_custkey").alias("width"))


def window_udf(spark: SparkSession, d: str) -> DataFrame:
    r, kinds = Registry(), ("int64",)
    r.define("width", "window", kinds, "int64", _width)
    return load_parquet(spark, d, "orders").select("o_orderkey", r.column("width", kinds, "o_orderkey").over(Window.partitionBy("o_custkey")).alias("width"))


def table_udf(spark: SparkSession, d: str) -> DataFrame:
    r, kinds = Registry(), ("int64", "text", "text")
    r.define("sizes", "table", kinds, (("k", "int64"), ("size", "int64")), _long_names)
    return r.table("sizes", kinds, load_parquet(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def scalar_udf(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "orders")
    s.create_function("twice_plus", ("int64",), "int64", lambda x: x * 2 + 1)
    return s.sql("SELECT o_orderkey, twice_plus(o_custkey) AS t FROM orders WHERE twice_plus(o_orderkey) > 1000")


def custom_operator(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "orders")
    s.create_function("distance", ("int64", "int64"), "int64", lambda a, b: (a - b).abs())
    s.execute("CREATE OPERATOR <-> (LEFTARG = INT64, RIGHTARG = INT64, RETURNS = INT64, FUNCTION = distance)")
    return s.sql("SELECT o_orderkey, o_orderkey <-> o_custkey AS away FROM orders")


def insert_values(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("INSERT INTO accounts (id, segment, nation) VALUES (-7, 'O''Neil', 3)")
    s.execute("INSERT INTO accounts (nation, id) VALUES (NULL, -8)")
    return s.sql("SELECT id, segment, nation, twice FROM accounts WHERE id < 10")


def add_column(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("ALTER TABLE accounts ADD COLUMN note TEXT")
    s.execute("UPDATE accounts SET note = segment WHERE id < 700")
    return s.sql("SELECT note, COUNT(*) AS n FROM accounts GROUP BY note")


def encrypted_column(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d, "customer", encryption_key=uuid.uuid4().hex)
    s.execute("CREATE TABLE vault (id INT64, name TEXT ENCRYPTED, balance FLOAT64 ENCRYPTED)")
    s.insert_rows("vault", s.sql("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"))
    return s.sql("SELECT id, name, balance FROM vault WHERE balance > 5000.0")


def trigger_after_update(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("CREATE TABLE log (n INT64)")
    s.execute("CREATE TRIGGER noted AFTER UPDATE ON accounts EXECUTE SQL 'INSERT INTO log (n) VALUES (1)'")
    s.execute("UPDATE accounts SET nation = 0 WHERE nation = 1")
    s.execute("UPDATE accounts SET nation = 0 WHERE nation = 1")
    return s.sql("SELECT COUNT(*) AS n FROM log")


def procedure_call(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    s.execute("CREATE PROCEDURE move(INT64, INT64) AS 'UPDATE accounts SET nation = $2 WHERE nation = $1'")
    s.execute("CALL move(4, 40)")
    return s.sql("SELECT nation, COUNT(*) AS n FROM accounts GROUP BY nation")


def checkpoint_restore(spark: SparkSession, d: str) -> DataFrame:
    s = _copied(spark, d)
    folder = f"{s.store.folder}/image"
    s.checkpoint(folder)
    s.execute("DELETE FROM accounts")
    s.restore(folder)
    return s.sql("SELECT id, segment, nation, twice FROM accounts")


def _indexed(tables: str, index: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose table has an index.  Indexes are metadata: the scan's filter is pushed to the files' statistics."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d, f"{tables} {text}")
        s.execute(index)
        return s.sql(text)

    return run


_INDEXED: dict[str, tuple[str, str, str]] = {
    "index_scan": ("CREATE INDEX i ON orders USING hash (o_custkey)", "SELECT o_orderkey FROM orders WHERE o_custkey = 5", "SELECT o_orderkey FROM orders WHERE o_custkey = 5"),
    "expression_index_scan": ("CREATE INDEX i ON orders (o_custkey + o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_custkey + o_orderkey = 1000", "SELECT o_orderkey FROM orders WHERE o_custkey + o_orderkey = 1000"),
    "index_range_scan": ("CREATE UNIQUE INDEX i ON orders (o_orderkey)", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 40 AND o_orderkey < 90", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 40 AND o_orderkey < 90"),
    "index_skip_scan": ("CREATE INDEX i ON lineitem (l_returnflag, l_suppkey)", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 3", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 3"),
    "inverted_text_scan": ("CREATE INDEX i ON documents USING gin (text)", "SELECT doc_id FROM documents WHERE text @@ 'licensed & apache'", f"SELECT doc_id FROM {DOC_TOKENS} WHERE list_contains(k, 'licensed') AND list_contains(k, 'apache')"),
    "inverted_value_scan": ("CREATE INDEX i ON event_attrs USING gin (attrs)", "SELECT event_id FROM event_attrs WHERE attrs @> HSTORE('type' => 'signup')", "SELECT event_id FROM events WHERE event_type = 'signup'"),
    "block_summary_scan": ("CREATE INDEX i ON orders USING brin (o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 300 AND 310", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 300 AND 310"),
    "range_overlap_scan": ("CREATE INDEX i ON order_range USING gist (r)", "SELECT o_orderkey FROM order_range WHERE r && RANGE(500, 520, '()')", "SELECT o_orderkey FROM orders WHERE o_custkey % 50 > 0 AND o_orderkey < 520 AND o_orderkey + o_custkey % 50 > 500"),
    "bounds_overlap_scan": ("CREATE INDEX i ON line_box USING gist (box)", "SELECT l_orderkey FROM line_box WHERE box && ARRAY[RANGE(0, 1, '[]'), RANGE(5, 6, '[]')]", "SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 1 AND l_suppkey <= 6 AND l_suppkey + 10 >= 5"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(text) for n, (text, _) in _PAIRS.items()}
QUERIES |= {n: _indexed("", index, text) for n, (index, text, _) in _INDEXED.items()}
QUERIES |= {f.__name__: f for f in (row_policy_filter, generated_column, dml_update_delete, transaction_rollback, fk_violation_rows, unique_violation, policy_on_write, drop_and_create, overloaded_function, aggregate_udf, window_udf, table_udf, scalar_udf, custom_operator, insert_values, add_column, encrypted_column, trigger_after_update, procedure_call, checkpoint_restore)}

ORACLE: dict[str, str] = {n: sql or text for n, (text, sql) in _PAIRS.items()}
ORACLE |= {n: sql for n, (_, _, sql) in _INDEXED.items()}
ORACLE |= {
    "insert_values": "SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey::BIGINT AS nation, 2 * c_nationkey::BIGINT AS twice FROM customer WHERE c_custkey < 10 UNION ALL SELECT -7, 'O''Neil', 3, 6 UNION ALL SELECT -8, NULL, NULL, NULL",
    "add_column": "SELECT CASE WHEN c_custkey < 700 THEN c_mktsegment END AS note, count(*) AS n FROM customer GROUP BY 1",
    "encrypted_column": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000.0",
    "trigger_after_update": "SELECT CAST(least(count(*), 1) AS BIGINT) AS n FROM customer WHERE c_nationkey = 1",
    "procedure_call": "SELECT CASE WHEN c_nationkey = 4 THEN 40 ELSE c_nationkey END::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1",
    "checkpoint_restore": "SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey::BIGINT AS nation, 2 * c_nationkey::BIGINT AS twice FROM customer",
    "row_policy_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 250000.0 AND o_orderpriority <> '5-LOW'",
    "generated_column": "SELECT id, nation, 2 * nation AS twice FROM (SELECT c_custkey AS id, c_nationkey::BIGINT + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END AS nation FROM customer)",
    "dml_update_delete": "SELECT c_custkey AS id, c_mktsegment || CASE WHEN c_nationkey BETWEEN 10 AND 12 THEN '!' ELSE '' END AS segment, c_nationkey::BIGINT AS nation, 2 * c_nationkey::BIGINT AS twice FROM customer WHERE c_nationkey >= 3 UNION ALL SELECT -1, 'NEW', NULL, NULL",
    "transaction_rollback": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1",
    "fk_violation_rows": "SELECT o_orderkey AS k, o_custkey AS parent FROM orders WHERE o_custkey > 100",
    "unique_violation": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'NEW', 1",
    "policy_on_write": "SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey::BIGINT AS nation FROM customer WHERE c_nationkey < 5 UNION ALL SELECT -1, 'NEW', 4",
    "drop_and_create": "SELECT c_name AS name FROM customer",
    "overloaded_function": "SELECT o_orderkey, 2 * o_custkey AS n, o_orderstatus || o_orderstatus AS t FROM orders",
    "aggregate_udf": "SELECT o_orderpriority, max(o_custkey) - min(o_custkey) AS width FROM orders GROUP BY 1",
    "window_udf": "SELECT o_orderkey, max(o_orderkey) OVER w - min(o_orderkey) OVER w AS width FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "table_udf": "SELECT c_custkey AS k, (length(c_name) + length(c_mktsegment))::BIGINT AS size FROM customer",
    "scalar_udf": "SELECT o_orderkey, 2 * o_custkey + 1 AS t FROM orders WHERE 2 * o_orderkey + 1 > 1000",
    "custom_operator": "SELECT o_orderkey, abs(o_orderkey - o_custkey) AS away FROM orders",
}
