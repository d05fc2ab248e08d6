"""Statements end to end: catalog, DML, constraints, transactions, persistence, the command line."""

import json

import pytest

from tessera import cli
from tessera.errors import CatalogError, EngineError, ParseError, RangeViolation, TransactionConflict, TypeMismatch, UniqueViolation
from tessera.plans.catalog import Catalog
from tessera.plans.engine import Engine, split_script
from tessera.sources.store import Transaction

SETUP = "CREATE SCHEMA analytics; CREATE TABLE analytics.inventory (id INT PRIMARY KEY, sku TEXT NOT NULL, quantity INT NOT NULL)"


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "data"), str(tmp_path / "log"))


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def test_smoke_script_and_restart(spark, engine, tmp_path):
    engine.script(SETUP + """;
        INSERT INTO analytics.inventory (id, sku, quantity) VALUES (1, 'widget', 5), (2, 'gadget', 3), (3, 'it''s; odd', 9);
        UPDATE analytics.inventory SET quantity = quantity + 1 WHERE id = 2;
        DELETE FROM analytics.inventory WHERE id = 3 -- the last one""")
    want = [(1, "widget", 5), (2, "gadget", 4)]
    assert rows(engine, "SELECT * FROM analytics.inventory ORDER BY id") == want
    again = Engine(spark, str(tmp_path / "data"))
    assert rows(again, "SELECT * FROM analytics.inventory ORDER BY id") == want
    log = [json.loads(x) for x in open(tmp_path / "log")]
    assert [x["rows"] for x in log if x["text"].startswith(("INSERT", "UPDATE", "DELETE"))] == [3, 1, 1]
    assert len({x["correlation_id"] for x in log}) == len(log)
    assert again.store.vacuum() >= 1
    assert rows(again, "SELECT count(*) FROM analytics.inventory") == [(2,)]


def test_queries(engine):
    engine.script(SETUP + "; INSERT INTO analytics.inventory (quantity, id, sku) VALUES (5, 1, 'a'), (7, 2, 'b'), (5, 3, 'c')")
    q = lambda t: rows(engine, t)
    assert q("SELECT inv.quantity AS qty FROM analytics.inventory AS inv WHERE inv.quantity > 5 ORDER BY qty LIMIT 5") == [(7,)]
    assert sorted(q("SELECT DISTINCT quantity FROM analytics.inventory")) == [(5,), (7,)]
    assert sorted(q("SELECT inv.quantity FROM analytics.inventory AS inv GROUP BY inv.quantity")) == [(5,), (7,)]
    assert q("SELECT count(*) FROM analytics.inventory a, analytics.inventory b JOIN analytics.inventory c ON b.id = c.id") == [(9,)]
    assert q("WITH x (n) AS (SELECT id FROM analytics.inventory) SELECT max(n) FROM x") == [(3,)]
    assert q("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT sum(n) FROM r") == [(15,)]
    engine.sql("CREATE VIEW five AS SELECT id FROM analytics.inventory WHERE quantity = 5")
    assert sorted(q("SELECT * FROM five")) == [(1,), (3,)]
    assert "Physical Plan" in engine.explain("SELECT * FROM five")


def test_checks(engine):
    engine.script(SETUP + "; CREATE TABLE small (a SMALLINT, b UINT32); INSERT INTO analytics.inventory (id, sku, quantity) VALUES (1, 'a', 1)")
    for text, error in [
        ("INSERT INTO analytics.inventory (id, sku, quantity) VALUES (2, 'b', 1), (1, 'c', 1)", UniqueViolation),
        ("INSERT INTO analytics.inventory (id, sku, quantity) VALUES (NULL, 'b', 1)", UniqueViolation),
        ("INSERT INTO analytics.inventory (id, sku, quantity) VALUES (3, NULL, 1)", EngineError),
        ("INSERT INTO analytics.inventory (id, sku) VALUES (2, 'b')", ParseError),
        ("INSERT INTO analytics.inventory (id, sku, quantity) VALUES (1 + 1, 'b', 1)", ParseError),
        ("UPDATE analytics.inventory SET sku = 1 WHERE id = 1", TypeMismatch),
        ("DELETE FROM analytics.inventory WHERE sku = 5", TypeMismatch),
        ("DELETE FROM analytics.inventory", ParseError),
        ("INSERT INTO small (a, b) VALUES (65536, 1)", RangeViolation),
        ("INSERT INTO small (a, b) VALUES (1, -1)", RangeViolation),
        ("SELECT nothing FROM small", EngineError),
        ("FROB x", ParseError),
    ]:
        with pytest.raises(error):
            engine.sql(text)
    assert rows(engine, "SELECT * FROM analytics.inventory") == [(1, "a", 1)]
    engine.sql("UPDATE analytics.inventory SET id = 1 WHERE id = 1")  # a row does not conflict with itself


def test_foreign_and_partial_keys(engine):
    engine.script("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT, p INT REFERENCES p (id)); INSERT INTO p (id) VALUES (999); INSERT INTO c (id, p) VALUES (1, 999), (2, NULL)")
    with pytest.raises(EngineError, match="Foreign key constraint"):
        engine.sql("INSERT INTO c (id, p) VALUES (3, 404)")
    engine.script("CREATE TABLE u (k INT); CREATE UNIQUE INDEX big ON u (k) WHERE k > 10; INSERT INTO u (k) VALUES (4), (4), (11)")
    with pytest.raises(UniqueViolation):
        engine.sql("INSERT INTO u (k) VALUES (11)")


def test_transactions(spark, engine, tmp_path):
    other = Engine(spark, str(tmp_path / "data"))
    engine.script("CREATE TABLE t (k INT); INSERT INTO t (k) VALUES (1)")
    engine.script("BEGIN; INSERT INTO t (k) VALUES (2)")
    assert len(rows(engine, "SELECT * FROM t")) == 2 and len(rows(other, "SELECT * FROM t")) == 1
    engine.sql("ROLLBACK")
    assert rows(engine, "SELECT * FROM t") == [(1,)]
    engine.sql("BEGIN ISOLATION LEVEL SNAPSHOT")
    other.sql("INSERT INTO t (k) VALUES (5)")
    assert len(rows(engine, "SELECT * FROM t")) == 1
    engine.sql("DELETE FROM t WHERE k = 1")
    with pytest.raises(TransactionConflict):
        engine.sql("COMMIT")
    engine.sql("ROLLBACK")
    engine.sql("BEGIN ISOLATION LEVEL READ COMMITTED")
    assert len(rows(engine, "SELECT * FROM t")) == 2
    other.sql("INSERT INTO t (k) VALUES (6)")
    assert len(rows(engine, "SELECT * FROM t")) == 3
    with pytest.raises(EngineError):
        engine.sql("SELECT x FROM nowhere")
    engine.sql("ROLLBACK")
    with pytest.raises(EngineError):
        engine.sql("COMMIT")


def test_catalog(engine):
    engine.script("CREATE DATABASE IF NOT EXISTS d; CREATE SCHEMA d.s; CREATE TABLE d.s.t (id INT, name VARCHAR(20) DEFAULT 'x')")
    with pytest.raises(CatalogError, match="schema contains tables"):
        engine.sql("DROP SCHEMA d.s RESTRICT")
    engine.script("CREATE INDEX IF NOT EXISTS i ON d.s.t USING int64 (id) INCLUDE (name) WITH (FANOUT=8)")
    with pytest.raises(CatalogError, match="has indexes"):
        engine.sql("DROP TABLE d.s.t")
    engine.script("INSERT INTO d.s.t (id, name) VALUES (1, 'a'); ALTER TABLE d.s.t RENAME COLUMN name TO label; ALTER TABLE d.s.t ADD COLUMN extra INT; ALTER TABLE d.s.t RENAME TO t2")
    assert rows(engine, "SELECT id, label, extra FROM d.s.t2") == [(1, "a", None)]
    engine.script("ALTER TABLE d.s.t2 DROP COLUMN label; DROP INDEX d.s.i")
    assert rows(engine, "SELECT * FROM d.s.t2") == [(1, None)]
    assert [tuple(r)[:3] for r in engine.sql("\\dt T2").collect()] == [("d", "s", "t2")]
    engine.script("DROP DATABASE d CASCADE; DROP DATABASE IF EXISTS d; CREATE SCHEMA e { CREATE TABLE e.x (id INT); CREATE VIEW e.v AS SELECT id FROM x }")
    assert engine.sql("\\dv").count() == 1
    txn = Transaction(engine.store)
    catalog = Catalog(txn)
    catalog.create_sequence("q", maximum=2)
    point = txn.savepoint()
    assert catalog.next_value("q") == 1
    txn.restore(point)
    assert [catalog.next_value("q"), catalog.next_value("q")] == [1, 2]
    for bad in ("1x", "a-b", ""):
        with pytest.raises(CatalogError):
            catalog.create_database(bad)


def test_scripts_and_command_line(engine, tmp_path, capsys):
    assert split_script("a; 'b;c' -- d;\n; /* e; */ f") == ["a", "'b;c'", "f"]
    assert cli.main(["--data-dir", str(tmp_path / "x"), "-c", "CREATE TABLE t (id INT); INSERT INTO t (id) VALUES (1); SELECT * FROM t"]) == 0
    assert cli.main(["--data-dir", str(tmp_path / "x"), "-c", "SELECT * FROM nowhere"]) == 1
    assert "error" in capsys.readouterr().out


def test_names_in_text(engine):
    engine.script("CREATE TABLE t (id INT, name TEXT); INSERT INTO t (id, name) VALUES (1, 'came from t'), (2, 'x'), (3, 'it''s, join t')")
    q = lambda text: rows(engine, text)
    assert q("SELECT id FROM t WHERE name = 'came from t'") == [(1,)] and q("SELECT 'join t', 'from t, t' FROM t WHERE id = 2 -- from t") == [("join t", "from t, t")]
    assert q("WITH t AS (SELECT 99 AS id) SELECT id FROM t") == [(99,)]
    assert q("WITH t AS (SELECT id + 1 AS id FROM t) SELECT max(id) FROM t") == [(4,)]  # its own body sees the table
    assert q("WITH u AS (SELECT max(id) AS m FROM t) SELECT t.id FROM t, u WHERE t.id = u.m") == [(3,)]
    assert q("SELECT main.public.t.id, public.t.name FROM main.public.t WHERE main.public.t.id = 2") == [(2, "x")]
    assert len(engine.sql("SELECT main.public.t.* FROM main.public.t").columns) == 2
    assert q("SELECT a.id FROM t a WHERE EXISTS (SELECT 1 FROM t WHERE t.id = a.id + 2) AND a.id IN (SELECT id FROM public.t)") == [(1,)]
    engine.sql("UPDATE t SET name = 'a where b' WHERE name = 'x'")
    engine.sql("DELETE FROM t WHERE name = 'came from t'")
    assert sorted(q("SELECT id, name FROM t")) == [(2, "a where b"), (3, "it's, join t")]
    assert q("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 300) SELECT count(*) FROM r") == [(300,)]


def test_select_lists(engine):
    engine.script("CREATE TABLE t (id INT, name TEXT); INSERT INTO t (id, name) VALUES (1, 'a')")
    assert engine.sql("SELECT id, t.name, id + 1, id AS k, 'x' FROM t ORDER BY id LIMIT 1").columns == ["id", "t.name", "column_3", "k", "column_5"]
    assert engine.sql("SELECT * FROM t").columns == ["id", "name"]
    with pytest.raises(ParseError, match="alias"):
        engine.sql("SELECT id AS k, name AS K FROM t")
    for text in ("SELECT id FROM t WHERE name = 5", "SELECT name > 1 FROM t", "SELECT a.id FROM t a JOIN t b ON a.id = b.name"):
        with pytest.raises(TypeMismatch):
            engine.sql(text)
    assert rows(engine, "SELECT id FROM t WHERE id < 1.5 AND CAST(id AS STRING) = '1' AND (name = NULL OR id = 1)") == [(1,)]
    for values in ("(1.7, 'a')", "('1', 'a')", "(true, 'a')", "(1, 2)"):
        with pytest.raises(TypeMismatch):
            engine.sql(f"INSERT INTO t (id, name) VALUES {values}")
    with pytest.raises(ParseError):
        engine.sql("SELECT id FROM (SELECT")


def test_whole_numbers(spark, engine):
    engine.sql("CREATE TABLE t (id INT)")
    for frame, error in ((spark.createDataFrame([(1.5,)], "id double"), Exception), (spark.createDataFrame([("1",)], "id string"), TypeMismatch)):
        txn = Transaction(engine.store)
        with pytest.raises(error):
            txn.insert("main.public.t", frame)
    txn = Transaction(engine.store)
    assert txn.insert("main.public.t", spark.createDataFrame([(2.0,), (None,)], "id double")) == 2


def test_plans_and_telemetry(engine):
    seen = []
    engine.sink = seen.append
    engine.script("CREATE TABLE t (id INT, k INT); INSERT INTO t (id, k) VALUES (1, 1), (2, 1), (3, 2)")
    assert engine.metrics[-1].rows == 3 and engine.metrics[-1].bytes > 0
    text = "SELECT a.k AS k, count(*) AS n FROM t a JOIN t b ON a.id = b.id WHERE a.id > 1 GROUP BY a.k"
    assert sorted(engine.collect(text)) == [(1, 1), (2, 1)]
    counts = engine.telemetry.snapshot()
    assert counts["operators"]["scan"]["rows"] >= 3 and counts["operators"]["hash_join"]["rows"] == 2 and counts["operators"]["insert"]["rows"] == 3
    assert counts["verbs"]["create table"]["succeeded"] == 1
    plan = engine.explain(text, "logical")
    assert "Scan table=main.public.t" in plan and "Join type=INNER" in plan and "Filter predicate=" in plan and "Aggregate groups=" in plan
    assert "numOutputRows=" in engine.explain(text, "analyze") and json.loads(engine.explain(text, "rules"))["rules_applied"] > 0
    assert "Physical Plan" in engine.sql("EXPLAIN FORMATTED SELECT id FROM t WHERE k = 1").first()[0]
    assert seen[0]["text"] == text and "Scan table" in seen[0]["logical"] and "rules_attempted" in seen[0]["diagnostics"]
    with pytest.raises(ParseError):
        engine.sql("FROB")
    assert engine.telemetry.statements["rejected"] == 1


def test_indexes_order_rows(engine):
    from tessera.operators import comparators

    engine.script("CREATE TABLE t (id INT, name TEXT); INSERT INTO t (id, name) VALUES (2, 'b'), (10, 'a'), (1, 'C')")
    engine.script("CREATE INDEX i ON t USING bytelex (name); CREATE INDEX j ON t USING int64 (id)")
    assert [r.name for r in engine.index_rows("i").collect()] == ["C", "a", "b"] and [r.id for r in engine.index_rows("j").collect()] == [1, 2, 10]
    with pytest.raises(CatalogError, match="Unknown comparator"):
        engine.sql("CREATE INDEX k ON t USING nocase (name)")
    if "nocase" not in comparators.COMPARATORS:
        comparators.register("nocase", lambda c: c.cast("string").substr(1, 1) < "a")
    engine.sql("CREATE INDEX k ON t USING nocase (name)")
    assert [r.name for r in engine.index_rows("k").collect()][-1] == "C"


def test_two_writers(spark, engine, tmp_path):
    """Both have seen the same head; the one that comes second finds its version taken, looks again, and neither is lost."""
    engine.script("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT)")
    one, two, three = (Transaction(engine.store) for _ in range(3))
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    one.insert("main.public.a", values(1))
    two.insert("main.public.b", values(2))
    three.insert("main.public.a", values(3))
    head, calls = engine.store.head, []

    def stale():
        """The first look is from before the other's commit."""
        calls.append(1)
        return old if len(calls) == 1 else head()

    old = head()
    one.commit()
    engine.store.head = stale
    two.commit()
    calls.clear()
    with pytest.raises(TransactionConflict):
        three.commit()
    engine.store.head = head
    assert rows(engine, "SELECT id FROM a") == [(1,)] and rows(engine, "SELECT id FROM b") == [(2,)]
    assert not engine.store.files.create(engine.store.files.names("manifest-")[-1], "{}")


def test_inserts_do_not_shuffle_the_table(spark, engine):
    from tessera.operators import constraints

    engine.script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t (id) VALUES (1), (2)")
    txn = Transaction(engine.store)
    keys = spark.createDataFrame([(5,)], "__0 long")
    plan = constraints._present(keys, txn.rows("main.public.t"), ["id"], True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    with pytest.raises(UniqueViolation):
        engine.sql("INSERT INTO t (id) VALUES (3), (2)")


def test_definition_scripts_are_atomic(engine):
    with pytest.raises(EngineError):
        engine.script("CREATE TABLE a (id INT); CREATE TABLE a (id INT)")
    assert engine.system("relations").count() == 0


def test_shell_ends_with_its_input(engine, monkeypatch, capsys):
    lines = iter(["CREATE TABLE t (id INT, s TEXT);", "INSERT INTO t (id, s)", "VALUES (1, 'a;", "b');", "SELECT s FROM t"])

    def typed(prompt):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    monkeypatch.setattr("builtins.input", typed)
    engine.log = "-"
    assert cli.shell(engine) == 0
    out = capsys.readouterr().out
    assert "a;" in out and '"kind": "ddl"' in out
