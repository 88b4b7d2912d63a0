"""Range algebra, ranking at scale, the command line, asynchronous statements, type mapping, and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from marlwick import cli
from marlwick.errors import BindError
from marlwick.functions import fts, nested
from marlwick.functions.fts import text_vector
from marlwick.session import Session
from marlwick.streaming.events import windowed_counts
from marlwick.types import from_name, from_spark, name_of, widened

R = lambda lo, hi, b="[)": nested.make_range(str(lo), str(hi), b, "BIGINT")
KIND = "STRUCT<lower: BIGINT, upper: BIGINT, lower_inc: BOOLEAN, upper_inc: BOOLEAN, is_empty: BOOLEAN>"


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS x").collect()[0][0]


@pytest.mark.parametrize(
    "sql, want",
    [
        (nested.contains_value(R(1, 3), "1L"), True), (nested.contains_value(R(1, 3), "3L"), False), (nested.contains_value(R(1, 3, "[]"), "3L"), True), (nested.contains_value(R("NULL", 3), "-99L"), True),
        (nested.contains_value(R(3, 1), "2L"), False), (nested.contains_value(R(1, 3), "CAST(NULL AS BIGINT)"), False),
        (nested.adjacent(R(1, 3), R(3, 5)), True), (nested.adjacent(R(1, 3, "[]"), R(3, 5, "[]")), False), (nested.adjacent(R(1, 3), R(3, 5, "(]")), False), (nested.adjacent(R(3, 5), R(1, 3)), True), (nested.adjacent(R(1, 2), R(3, 4)), False), (nested.adjacent(R(2, 2), R(2, 3)), False),
        (nested.intersection(R(1, 5), R(3, 9)), (3, 5, True, False, False)), (nested.intersection(R(1, 5), R(1, 5, "(]")), (1, 5, False, False, False)), (nested.intersection(R(1, 3), R(3, 5)), (3, 3, True, False, True)), (nested.intersection(R("NULL", 5), R(2, "NULL")), (2, 5, True, False, False)),
        (nested.union(R(1, 3), R(3, 5), KIND), (1, 5, True, False, False)), (nested.union(R(1, 2), R(9, 9), KIND), (1, 2, True, False, False)), (nested.union(R("NULL", 2), R(1, 4, "[]"), KIND), (None, 4, True, True, False)),
    ],
)
def test_range_algebra(spark, sql, want):
    got = value(spark, sql)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_union_with_a_gap_is_an_error(spark):
    for b in (R(4, 5), R(3, 5, "(]")):
        with pytest.raises(Exception, match="gap"):
            value(spark, nested.union(R(1, 3), b, KIND))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderpriority) AS rn, RANK() OVER (ORDER BY o_orderstatus DESC) AS rk, DENSE_RANK() OVER (ORDER BY o_orderstatus, o_orderpriority) AS dr FROM orders ORDER BY o_orderkey DESC LIMIT 700 OFFSET 3",
        "SELECT event_id, RANK() OVER (ORDER BY v DESC) AS r, DENSE_RANK() OVER (ORDER BY etype NULLS FIRST) AS d FROM events_null WHERE event_id > 5",
        "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderkey < 0",
    ],
)
def test_ranks_by_partition_are_those_of_one_task(spark, data, text):
    from marlwick.queries import session

    s = session(spark, data, text)
    want = sorted(map(tuple, s.sql(text).collect()))
    s.one_task_bytes = -1
    assert sorted(map(tuple, s.sql(text).collect())) == want


def test_ties_do_not_gather_in_one_task(spark, monkeypatch):
    """Partitions are about as large as one another whatever the keys, also where rows are equal as a whole."""
    from marlwick.operators.ranking import with_rank

    sizes, kind = [], type(spark.range(1))
    real = kind.checkpoint

    def seen(df, eager=True):
        out = real(df, eager)
        sizes.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(kind, "checkpoint", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 40_000, numPartitions=4).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("t"))
        got = {f: with_rank(df, "n", f, [("t", True, False)]).groupBy("t").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect() for f in ("row_number", "rank", "dense_rank")}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {f: sorted(map(tuple, r), key=str) for f, r in got.items()} == {
        "row_number": [("x", 1, 26_666, 26_666), (None, 26_667, 40_000, 13_334)],
        "rank": [("x", 1, 1, 1), (None, 26_667, 26_667, 1)],
        "dense_rank": [("x", 1, 1, 1), (None, 2, 2, 1)],
    }
    assert max(sizes) <= 10_000  # the frame itself has four partitions of 10,000


def test_one_task_ranks_a_small_input_only(spark, tmp_path):
    spark.range(400_000).select("id", F.rand(3).alias("v")).write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = Session(spark).register_parquet(str(tmp_path), "t").sql("SELECT id, v, ROW_NUMBER() OVER (ORDER BY v DESC, id) AS n FROM t")
        held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 400_000 and max(held) < 200_000
    df.createOrReplaceTempView("ranked_rows")
    assert spark.sql("SELECT count(*) FROM ranked_rows a JOIN ranked_rows b ON b.n = a.n + 1 WHERE a.v > b.v OR a.v = b.v AND a.id < b.id").collect()[0][0] == 399_999


def test_rows_decide_what_one_task_ranks(spark, tmp_path):
    """A million rows in a few KB of file: its size, as an estimate of the rows, left them all to one task."""
    spark.range(0, 1_000_000, numPartitions=1).select(F.expr("id div 1000 AS k"), F.expr("id div 250000 AS v")).write.option("parquet.enable.dictionary", "true").parquet(f"{tmp_path}/t.parquet")
    assert sum(p.stat().st_size for p in (tmp_path / "t.parquet").iterdir()) < 1 << 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = Session(spark).register_parquet(str(tmp_path), "t").sql("SELECT k, ROW_NUMBER() OVER (ORDER BY v DESC, k) AS n FROM t").cache()
        held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        got = df.groupBy("k").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        df.unpersist()
    assert sum(held) == 1_000_000 and max(held) < 600_000
    first = lambda k: (3 - k // 250) * 250_000 + k % 250 * 1000
    assert sorted(map(tuple, got)) == [(k, first(k) + 1, first(k) + 1000, 1000) for k in range(1000)]


@pytest.mark.parametrize("function", ["row_number", "rank", "dense_rank"])
def test_partitions_grow_with_the_rows(spark, monkeypatch, function):
    """Also those of rows that come from other than a plain scan, and of long texts."""
    from marlwick.operators import ranking

    sizes, kind = [], type(spark.range(1))
    real = kind.checkpoint
    monkeypatch.setattr(ranking, "TASK_BYTES", 64 << 10)
    monkeypatch.setattr(ranking, "FEW_KEYS", 10)
    for df in (spark.range(40_000), spark.range(8_000).select("id", F.repeat(F.lit("x"), 300).alias("t"))):
        n = df.count()
        monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: sizes.append((out := real(df, eager)).rdd.getNumPartitions()) or out)
        got = ranking.with_rank(df, "n", function, [("id", True, False)])
        assert got.where(F.col("n") + F.col("id") == n).count() == got.count() == n
        if function == "row_number" or df.columns == ["id"]:  # ranks are made of the keys alone
            assert max(sizes) >= 8 * n * (len(df.columns) + 4) // (64 << 10)
        sizes.clear()


def test_order_of_ranked_rows_is_made_in_small_partitions(spark, monkeypatch):
    from marlwick.operators import ranking

    monkeypatch.setattr(ranking, "TASK_BYTES", 64 << 10)
    s = Session(spark)
    s.register("many_rows", spark.range(40_000).select("id", (F.col("id") % 3).alias("k")))
    s.one_task_bytes = -1
    df = s.sql("SELECT id, k, ROW_NUMBER() OVER (ORDER BY id DESC) AS n FROM many_rows ORDER BY k DESC")
    parts = df.rdd.glom().map(len).collect()
    assert len(parts) > 24 and max(parts) < 8_000  # a key alone has 13,333
    rows = df.collect()
    assert [r["k"] for r in rows] == [2] * 13_333 + [1] * 13_333 + [0] * 13_334 and {(r["id"], r["n"]) for r in rows} == {(i, 40_000 - i) for i in range(40_000)}


def test_sorted_bytes_counts_rows_and_texts(spark):
    from marlwick.operators.ranking import sorted_bytes

    df = spark.createDataFrame([("ab", 1, [1, 22], b"xyz"), (None, None, None, None)], "s string, n int, a array<int>, b binary")
    assert sorted_bytes(df.select("n")) == 2 * 40 and sorted_bytes(df) == 2 * 64 + 2 + len("[1, 22]") + 3
    assert sorted_bytes(df.where("n > 5")) == sorted_bytes(df.select("s").where("n > 5")) == 0


def test_ranks_of_many_keys(spark, monkeypatch):
    from marlwick.operators import ranking

    monkeypatch.setattr(ranking, "FEW_KEYS", 10)
    df = spark.range(3_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 40).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3 - 0.5).alias("b"))
    df.createOrReplaceTempView("many_keys")
    for f in ("rank", "dense_rank"):
        want = spark.sql(f"SELECT *, CAST({f}() OVER (ORDER BY a DESC NULLS LAST, b NULLS FIRST) AS BIGINT) AS n FROM many_keys")
        got = ranking.with_rank(df, "n", f, [("a", True, False), ("b", False, True)])
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_command_line(spark):
    out = []
    s = Session(spark)
    failed = cli.run(s, "CREATE TABLE t (a INT64, b TEXT); -- a; comment\nINSERT INTO t (a, b) VALUES (1, 'x;y'); SELECT * FROM t;\nSELECT nosuch FROM t", out.append)
    assert failed == 1 and out[:4] == ["ok", "1 rows", "a\tb", "1\tx;y"] and out[4].startswith("error")


def test_async(spark):
    s = Session(spark)
    s.register("r", spark.range(5))
    assert len(s.execute_async("SELECT id FROM r").result(60)) == 5
    with pytest.raises(BindError):
        s.execute_async("SELECT x FROM r").result(60)
    slow = spark.range(4).repartition(4).withColumn("v", F.pandas_udf(lambda x: __import__("time").sleep(30) or x, "long")("id"))
    s.register("slow", slow)
    p = s.execute_async("SELECT v FROM slow")
    with pytest.raises(TimeoutError):
        p.result(2)
    p.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        p.result(60)


def test_types(spark):
    df = spark.sql("SELECT 1 AS I, CAST(1 AS TINYINT) AS b, 1.5F AS f, TIMESTAMP'2024-01-01 00:00:00' AS t, array(1) AS a, map('k', 'v') AS m, X'00' AS x, CAST(1 AS DECIMAL(20,0)) AS u")
    out, columns = widened(df)
    assert [(n, t) for n, t, _ in columns] == [("i", "int64"), ("b", "int64"), ("f", "float64"), ("t", "timestamp"), ("a", ("array", "int64")), ("m", "hstore"), ("x", "bytes"), ("u", "uint64")]
    assert out.schema["i"].dataType.simpleString() == "bigint" and out.schema["a"].dataType.simpleString() == "array<bigint>"
    with pytest.raises(BindError):
        widened(spark.sql("SELECT DATE'2024-01-01' AS d"))
    for t in ("int64", ("array", ("range", "int64")), ("array", ("array", "text"))):
        assert from_name(name_of(t)) == t
    with pytest.raises(BindError):
        from_spark(spark.sql("SELECT struct(1 AS a) AS s").schema["s"].dataType)


def test_text_vectors(spark):
    assert text_vector("The cat, the DOG", frozenset({"the"}), lambda t: t.rstrip("s")) == [{"term": "cat", "positions": [2], "weight": "D"}, {"term": "dog", "positions": [4], "weight": "D"}]
    s = Session(spark)
    weighted = spark.sql("SELECT array(named_struct('term', 'a', 'positions', array(1, 20), 'weight', 'A'), named_struct('term', 'b', 'positions', array(17), 'weight', 'C')) AS v")
    s.register("vectors", weighted)
    assert tuple(s.sql("SELECT text_rank(v, 'a | b') AS r, text_rank(v, 'a & z') AS n, text_phrase_match(v, 'b a', 3) AS p, v @@ 'a & !z' AS m FROM vectors").collect()[0]) == (15 + 40 + 4 + 0 + 20 + 2, None, True, True)
    assert fts.positive_terms(fts.parse_query("a & !(b | !c) | a")) == ["a", "c"]


def test_vectors_of_a_batch_take_little_memory(spark):
    """Large batches are made in Arrow's buffers; as Python objects they took over 50 times the text."""
    import random
    import tracemalloc

    import pyarrow as pa

    from marlwick.functions import fts

    odd = [None, "", "  ", "The cat, the DOG", "É é ß İ 1२ a_b 日本", "x" * 5000, None]
    kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32())), ("weight", pa.string())]))
    for texts in (odd, odd[2:5], [], [None], [""]):
        got = fts.text_vectors(pa.array(texts, pa.string()))
        got.validate(full=True)
        assert got.type == kind and got.to_pylist() == [text_vector(x) for x in texts]
    assert fts.text_vectors(pa.array(odd, pa.string())[3:5]).to_pylist() == [text_vector(x) for x in odd[3:5]]
    r = random.Random(1)
    words = [f"{r.randrange(1 << 20):x}" for _ in range(3000)]
    batch = pa.array([" ".join(r.choices(words, k=150)) for _ in range(2000)])
    register = {}
    fts.register(type("Spark", (), {"udf": type("Udf", (), {"register": staticmethod(lambda n, f: register.setdefault(n, f))})})())
    tracemalloc.start()
    try:
        register["mw_text_vector"].func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * batch.nbytes


def test_stream(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), "ts", ["event_type"], "1 day")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_counts(table, "ts", ["event_type"], "1 day")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))


def test_function_registry(spark):
    from marlwick.udf import Registry

    r = Registry()
    r.define("f", "scalar", ("int64",), "int64", lambda x: x + 1)
    r.define("f", "scalar", ("text",), "text", lambda x: x + "!")

    def total(x):
        return x.sum()

    total.__annotations__ = {"x": __import__("pandas").Series, "return": int}
    r.define("total", "aggregate", ("int64",), "int64", total)
    r.define("twice", "table", ("int64",), (("id", "int64"),), lambda it: (x for pdf in it for x in (pdf, pdf)))
    df = spark.range(4)
    assert [x[0] for x in df.select(r.column("f", ("int64",), "id")).collect()] == [1, 2, 3, 4]
    assert df.agg(r.column("total", ("int64",), "id")).collect()[0][0] == 6
    assert r.table("twice", ("int64",), df).count() == 8
    for bad in (lambda: r.resolve("f", ("bool",)), lambda: r.define("F", "scalar", ("int64",), "int64", total), lambda: r.define("g", "odd", (), "int64", total), lambda: r.table("f", ("int64",), df), lambda: r.column("twice", ("int64",), "id")):
        with pytest.raises(BindError):
            bad()
