"""Tables that change: constraints, triggers, procedures, roles, policies, encryption, transactions, checkpoints."""

import pytest

from marlwick.errors import BindError, ConstraintError, SecurityError, StoreError
from marlwick.session import Session
from marlwick.sources.store import shared_folder


@pytest.fixture
def s(spark, tmp_path):
    s = Session(spark, folder=str(tmp_path / "tables"), encryption_key="0123456789abcdef")
    for text in (
        "CREATE TABLE accounts (id INT64 NOT NULL, owner TEXT, balance INT64, twice INT64 GENERATED ALWAYS AS (balance + balance) STORED)",
        "CREATE UNIQUE INDEX by_id ON accounts (id)",
        "CREATE TABLE transfers (id INT64, account_id INT64 REFERENCES accounts (id), amount INT64)",
        "INSERT INTO accounts (id, owner, balance) VALUES (1, 'ann', 10)",
        "INSERT INTO accounts (id, owner, balance) VALUES (2, 'bob', 20)",
        "INSERT INTO transfers (id, account_id, amount) VALUES (1, 1, 5)",
    ):
        s.execute(text)
    return s


def rows(s, text="SELECT * FROM accounts ORDER BY id"):
    return [tuple(r) for r in s.sql(text).collect()]


def test_generated_values_follow(s):
    assert s.execute("UPDATE accounts SET balance = balance + 1 WHERE owner = 'ann'").affected == 1
    assert rows(s) == [(1, "ann", 11, 22), (2, "bob", 20, 40)]
    with pytest.raises(BindError):
        s.execute("INSERT INTO accounts (id, twice) VALUES (3, 4)")
    with pytest.raises(BindError):
        s.execute("UPDATE accounts SET twice = 4")


def test_delete_and_missing_rows(s):
    assert s.execute("DELETE FROM accounts WHERE balance > 15").affected == 1
    assert s.execute("DELETE FROM accounts WHERE balance > 15").affected == 0
    assert s.execute("UPDATE accounts SET balance = 0 WHERE owner = NULL").affected == 0
    assert rows(s) == [(1, "ann", 10, 20)]


@pytest.mark.parametrize("text", ["INSERT INTO accounts (id) VALUES (2)", "INSERT INTO accounts (owner) VALUES ('eve')", "UPDATE accounts SET id = 1", "INSERT INTO transfers (id, account_id) VALUES (2, 9)", "DELETE FROM accounts", "UPDATE accounts SET id = 7 WHERE id = 1", "DROP TABLE accounts", "UPDATE accounts SET id = NULL WHERE id = 2"])
def test_constraints_undo_the_statement(s, text):
    before = rows(s), rows(s, "SELECT * FROM transfers")
    with pytest.raises(ConstraintError):
        s.execute(text)
    assert (rows(s), rows(s, "SELECT * FROM transfers")) == before


def test_null_child_and_null_unique_keys_pass(s):
    s.execute("INSERT INTO transfers (id, account_id) VALUES (2, NULL)")
    s.execute("CREATE UNIQUE INDEX t ON transfers (amount)")
    s.execute("INSERT INTO transfers (id, account_id) VALUES (3, NULL)")
    assert len(rows(s, "SELECT * FROM transfers")) == 3


def test_index_rules(s):
    for text in ("CREATE UNIQUE INDEX g ON accounts USING gin (owner)", "CREATE INDEX g ON accounts USING hash (id, owner)", "CREATE INDEX by_id ON accounts (id)", "CREATE INDEX g ON accounts (nosuch)"):
        with pytest.raises(BindError):
            s.execute(text)
    s.execute("CREATE INDEX IF NOT EXISTS by_id ON accounts (id)")
    s.execute("DROP INDEX by_id")
    s.execute("INSERT INTO accounts (id) VALUES (2)")
    with pytest.raises(ConstraintError):
        s.execute("CREATE UNIQUE INDEX again ON accounts (id)")


def test_triggers_run_and_undo(s):
    s.execute("CREATE TRIGGER pay AFTER INSERT ON transfers EXECUTE SQL 'UPDATE accounts SET balance = balance - 1'")
    s.execute("INSERT INTO transfers (id, account_id) VALUES (2, 2)")
    assert [r[2] for r in rows(s)] == [9, 19]
    s.execute("CREATE TRIGGER again AFTER UPDATE ON accounts EXECUTE SQL 'UPDATE accounts SET balance = 0'")
    with pytest.raises(BindError):
        s.execute("INSERT INTO transfers (id, account_id) VALUES (3, 2)")
    assert [r[2] for r in rows(s)] == [9, 19] and len(rows(s, "SELECT id FROM transfers")) == 2
    s.execute("UPDATE accounts SET balance = 1 WHERE id = 99")  # no rows, no trigger


def test_procedures(s):
    s.execute("CREATE PROCEDURE pay(INT64, TEXT) AS 'UPDATE accounts SET balance = balance + $1 WHERE owner = $2 AND owner <> ''$1'''")
    assert s.execute("CALL pay(100, 'bob')").affected == 1
    assert rows(s)[1][2] == 120
    with pytest.raises(BindError):
        s.execute("CALL pay('x', 'bob')")
    s.execute("CREATE PROCEDURE loop() AS 'CALL loop()'")
    with pytest.raises(BindError):
        s.execute("CALL loop()")
    s.execute("CREATE ROLE eve")
    with pytest.raises(SecurityError):
        s.as_role("eve").execute("CALL pay(1, 'bob')")
    s.execute("GRANT EXECUTE ON PROCEDURE pay(INT64, TEXT) TO eve")
    s.execute("GRANT UPDATE ON TABLE accounts TO eve")
    assert s.as_role("eve").execute("CALL pay(1, 'bob')").affected == 1


def test_rights_and_policies(s):
    s.execute("CREATE ROLE ann")
    ann = s.as_role("ann")
    with pytest.raises(SecurityError):
        ann.sql("SELECT id FROM accounts")
    for p in ("SELECT", "INSERT", "UPDATE", "DELETE"):
        s.execute(f"GRANT {p} ON TABLE accounts TO ann")
    s.execute("CREATE POLICY own ON accounts USING (owner = 'ann')")
    s.execute("CREATE POLICY some ON accounts USING (balance < 100)")
    assert rows(ann) == [(1, "ann", 10, 20)] and len(rows(s)) == 2
    assert rows(ann, "SELECT COUNT(*) AS n FROM accounts WHERE id IN (SELECT id FROM accounts)") == [(1,)]
    assert ann.execute("UPDATE accounts SET balance = balance + 1").affected == 1
    for text in ("UPDATE accounts SET owner = 'bob'", "UPDATE accounts SET balance = 500", "INSERT INTO accounts (id, owner, balance) VALUES (3, 'bob', 1)", "INSERT INTO accounts (id, owner) VALUES (3, 'ann')"):
        with pytest.raises(SecurityError):
            ann.execute(text)
    with pytest.raises(SecurityError):
        ann.execute("CREATE POLICY mine ON accounts USING (TRUE)")
    assert ann.execute("DELETE FROM accounts WHERE id = 2").affected == 0
    s.execute("CREATE TABLE other (a INT64)")
    s.execute("GRANT SELECT ON TABLE other TO ann")
    s.execute("INSERT INTO other (a) VALUES (1)")
    assert rows(ann, "SELECT a FROM other") == [(1,)]
    s.catalog.deny_by_default = True
    assert rows(ann, "SELECT a FROM other") == []


def test_encryption(s, spark):
    s.execute("CREATE TABLE secrets (id INT64, pin TEXT ENCRYPTED, n INT64 ENCRYPTED)")
    s.execute("INSERT INTO secrets (id, pin, n) VALUES (1, '1234', 7)")
    assert rows(s, "SELECT pin, n + 1 FROM secrets WHERE pin = '1234'") == [("1234", 8)]
    stored = spark.read.parquet(*s.catalog.table((None, "secrets")).paths).collect()[0]
    assert isinstance(stored["pin"], (bytes, bytearray)) and b"1234" not in bytes(stored["pin"])
    s.execute("CREATE ROLE eve")
    s.execute("GRANT SELECT ON TABLE secrets TO eve")
    with pytest.raises(SecurityError):
        s.as_role("eve").sql("SELECT id FROM secrets")
    s.catalog.decryptors.add("eve")
    assert rows(s.as_role("eve"), "SELECT n FROM secrets") == [(7,)]
    with pytest.raises(ConstraintError):
        s.execute("ALTER TABLE secrets ALTER COLUMN pin DROP ENCRYPTED")
    s.execute("DELETE FROM secrets")
    s.execute("ALTER TABLE secrets ALTER COLUMN pin DROP ENCRYPTED")


def test_the_key_is_in_no_plan(s, spark):
    s.execute("CREATE TABLE secrets (id INT64, pin TEXT ENCRYPTED)")
    s.execute("INSERT INTO secrets (id, pin) VALUES (1, '1234')")
    df = s.sql("SELECT pin FROM secrets")
    assert "0123456789abcdef" not in df._jdf.queryExecution().toString()
    assert "0123456789abcdef" not in s.execute("EXPLAIN SELECT pin FROM secrets").text
    with pytest.raises(SecurityError):
        Session(spark, catalog=s.catalog).sql("SELECT pin FROM secrets")


def test_checkpoints_replace_one_another(s, tmp_path):
    folder = str(tmp_path / "image")
    s.checkpoint(folder)
    s.execute("DELETE FROM transfers")
    s.checkpoint(folder)
    s.execute("INSERT INTO transfers (id, account_id, amount) VALUES (7, 2, 1)")
    s.restore(folder)
    assert rows(s, "SELECT * FROM transfers") == []
    assert [p.name for p in (tmp_path / "image").glob("catalog*")] == ["catalog.json"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Spark:
        sparkContext, conf = Context(), {}

    with pytest.raises(StoreError):
        shared_folder(Spark())


def test_transactions(s):
    s.execute("BEGIN")
    with pytest.raises(BindError):
        s.execute("BEGIN")
    s.execute("DELETE FROM transfers")
    s.execute("CREATE TABLE more (a INT64)")
    s.execute("ROLLBACK")
    assert len(rows(s, "SELECT id FROM transfers")) == 1
    with pytest.raises(BindError):
        s.sql("SELECT a FROM more")
    s.execute("BEGIN")
    s.execute("DELETE FROM transfers")
    s.execute("COMMIT")
    assert rows(s, "SELECT id FROM transfers") == []
    for text in ("COMMIT", "ROLLBACK"):
        with pytest.raises(BindError):
            s.execute(text)


def test_alter_and_drop(s):
    s.execute("ALTER TABLE accounts ADD COLUMN note TEXT")
    assert rows(s, "SELECT id, note FROM accounts ORDER BY id") == [(1, None), (2, None)]
    s.execute("UPDATE accounts SET note = 'x' WHERE id = 1")
    assert rows(s, "SELECT note FROM accounts ORDER BY id") == [("x",), (None,)]
    with pytest.raises(ConstraintError):
        s.execute("ALTER TABLE accounts ADD COLUMN must TEXT NOT NULL")
    s.execute("DROP TABLE transfers")
    s.execute("DROP TABLE IF EXISTS transfers")
    with pytest.raises(BindError):
        s.execute("DROP TABLE transfers")


def test_checkpoint_and_restore(s, spark, tmp_path):
    s.execute("CREATE ROLE ann")
    s.execute("GRANT SELECT ON TABLE accounts TO ann")
    s.execute("CREATE POLICY own ON accounts USING (owner = 'ann')")
    s.execute("CREATE TRIGGER t AFTER DELETE ON transfers EXECUTE SQL 'UPDATE accounts SET balance = 0'")
    s.checkpoint(str(tmp_path / "image"))
    s.execute("DELETE FROM transfers")
    other = Session(spark, folder=str(tmp_path / "other"))
    other.restore(str(tmp_path / "image"))
    assert rows(other) == [(1, "ann", 10, 20), (2, "bob", 20, 40)]
    assert rows(other.as_role("ann")) == [(1, "ann", 10, 20)]
    with pytest.raises(ConstraintError):
        other.execute("INSERT INTO accounts (id) VALUES (1)")
    other.execute("DELETE FROM transfers")
    assert [r[2] for r in rows(other)] == [0, 0]


def test_functions_and_operators(s):
    s.execute("CREATE FUNCTION f(INT64) RETURNS INT64")
    with pytest.raises(BindError):
        s.sql("SELECT f(id) FROM accounts")
    s.create_function("f", ("int64",), "int64", lambda x: x * 3)
    assert rows(s, "SELECT f(id) FROM accounts ORDER BY id") == [(3,), (6,)]
    with pytest.raises(BindError):
        s.sql("SELECT f(owner) FROM accounts")
    with pytest.raises(BindError):
        s.execute("CREATE FUNCTION g(TEXT) RETURNS INT64 LANGUAGE wasm AS '00' WITH (fuel = 1)")


def test_registered_frames_are_read_only(s, spark):
    s.register("r", spark.range(3))
    with pytest.raises(BindError):
        s.execute("DELETE FROM r")
    assert rows(s, "SELECT COUNT(*) AS n FROM r") == [(3,)]


def test_explain(s):
    text = s.execute("EXPLAIN ANALYZE COSTS SELECT id FROM accounts WHERE balance > 3").text
    assert "Analyze rows=2 elapsed_us=" in text and "sizeInBytes" in text


def test_many_inserts_keep_few_files(s, monkeypatch):
    monkeypatch.setattr("marlwick.session.MOST_FILES", 3)
    for i in range(10, 16):
        s.execute(f"INSERT INTO accounts (id, balance) VALUES ({i}, {i})")
    assert len(s.catalog.table((None, "accounts")).paths) <= 4
    assert [r[0] for r in rows(s)] == [1, 2, 10, 11, 12, 13, 14, 15] and rows(s)[-1][3] == 30
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO accounts (id) VALUES (12)")
