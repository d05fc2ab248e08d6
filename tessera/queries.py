"""The relational queries by name, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import compare
from .operators import aggregates, constraints, joins, probe, recursion, sequences, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[f.__name__] = sql
        return f

    return keep


def money(c):
    return F.col(c).cast("decimal(18,2)")


# scans and sources
@query("SELECT r_regionkey, r_name FROM region")
def scan_region(t):
    return t.region.select("r_regionkey", "r_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def scan_lineitem(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT count(*) AS n FROM region WHERE r_regionkey < 0")
def scan_empty(t):
    return t.region.filter("r_regionkey < 0").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'one'), (2, 'two'), (3, NULL)) AS v(id, name)")
def values_rows(t):
    return t.spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id long, name string")


# projections
@query("SELECT c_custkey, c_name FROM customer")
def project_columns(t):
    return t.customer.select("c_custkey", "c_name")


@query("SELECT * FROM nation")
def project_star(t):
    return t.nation.select("*")


@query("SELECT p.p_partkey, p.p_name FROM part p")
def project_qualified(t):
    return t.part.alias("p").select("p.p_partkey", "p.p_name")


@query("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def project_qualified_star(t):
    return t.nation.alias("n").join(t.region.alias("r"), F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def project_alias(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("SELECT r_regionkey, CAST(1 AS BIGINT) AS i, CAST(2.5 AS DECIMAL(2,1)) AS d, 'it''s' AS s, TRUE AS b, CAST(NULL AS BIGINT) AS n FROM region")
def project_literals(t):
    return t.region.select("r_regionkey", F.lit(1).cast("long").alias("i"), F.lit(Decimal("2.5")).alias("d"), F.lit("it's").alias("s"), F.lit(True).alias("b"), F.lit(None).cast("long").alias("n"))


@query("SELECT p_partkey, p_size > 25 AS big FROM part")
def project_boolean(t):
    return t.part.select("p_partkey", (F.col("p_size") > 25).alias("big"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, o_custkey + 1 AS next_cust FROM orders")
def project_derived(t):
    return t.orders.select("o_orderkey", F.upper("o_orderpriority").alias("priority"), (F.col("o_custkey") + 1).alias("next_cust"))


# filters
def _filter(name: str, op: str) -> None:
    def f(t):
        return t.part.filter(compare(t.part, F.col("p_size"), op, F.lit(25))).select("p_partkey", "p_size")

    f.__name__ = name
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25")(f)


for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _filter(f"filter_{_name}", _op)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_string_eq(t):
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 24.5")
def filter_decimal_promotion(t):
    return t.part.filter(compare(t.part, F.col("p_size"), ">", F.lit(Decimal("24.5")))).select("p_partkey", "p_size")


@query("SELECT count(*) AS n FROM part WHERE p_size = NULL")
def filter_null_compare(t):
    return t.part.filter(compare(t.part, F.col("p_size"), "=", F.lit(None))).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')")
def filter_contains(t):
    return t.part.filter(F.contains("p_name", F.lit("a"))).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity <= 25")
def filter_selectivity(t):
    return t.lineitem.filter("l_quantity <= 25").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + 1 AS more FROM lineitem WHERE l_quantity <= 25")
def scan_filter_project(t):
    return t.lineitem.filter("l_quantity <= 25").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 1).alias("more"))


# joins
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_hash_inner(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


def _outer(name: str, how: str) -> None:
    def f(t):
        c, o = t.customer.filter("c_acctbal > 0"), t.orders.filter("o_totalprice > 300000")
        return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")

    f.__name__ = name
    query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")(f)


for _how in ("left", "right", "full"):
    _outer(f"join_{_how}", _how)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def join_comma(t):
    return t.sql("SELECT r_name, n_name FROM {region}, {nation} WHERE r_regionkey < n_regionkey", "region", "nation")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
def join_theta(t):
    return joins.theta(t.supplier, t.nation, F.col("s_nationkey") < F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_lateral_probe(t):
    return joins.lateral(t.customer, t.orders.filter("o_totalprice > 100000"), lambda a, b: a["c_custkey"] == b["o_custkey"]).select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey")
def join_chain_4way(t):
    out = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    return out.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("r_name", "n_name", "c_custkey", "o_orderkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_strategy_hints(t):
    """The same join by merge; a broadcast or hash hint gives the same rows."""
    return joins.equi(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey"), strategy="merge").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_greedy_reorder(t):
    o, c, n = t.orders.withColumnRenamed("o_custkey", "k"), t.customer.withColumnsRenamed({"c_custkey": "k", "c_nationkey": "nk"}), t.nation.withColumnRenamed("n_nationkey", "nk")
    return joins.greedy({"o": o, "c": c, "n": n}, {frozenset("oc"): ["k"], frozenset("cn"): ["nk"]}).select("o_orderkey", "c_name", "n_name")


@query("SELECT r.r_name, n.n_name, s.s_suppkey FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey, supplier s JOIN nation m ON s.s_nationkey = m.n_nationkey")
def join_comma_chain(t):
    return t.sql("SELECT r.r_name, n.n_name, s.s_suppkey FROM {region} r JOIN {nation} n ON r.r_regionkey = n.n_regionkey, {supplier} s JOIN {nation} m ON s.s_nationkey = m.n_nationkey", "region", "nation", "supplier")


# aggregation
@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY c_mktsegment")
def join_group_count(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy("c_mktsegment")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_group_count(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def agg_group_sum(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("SELECT l_partkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_partkey")
def agg_count_sum_many_groups(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("total"))


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_first_row(t):
    return aggregates.first_row(t.orders, ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT p_brand, CAST(sum(p_size * p_size) AS BIGINT) - CAST(sum(p_size) AS BIGINT) AS spread FROM part GROUP BY p_brand")
def agg_udaf_custom(t):
    size = F.col("p_size").cast("long")
    return aggregates.Aggregate("spread", {"s": size, "q": size * size}, F.col("q") - F.col("s")).over(t.part, "p_brand")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_by_column(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY region")
def group_by_alias(t):
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))


@query("SELECT p_size > 25 AS big, count(*) AS n FROM part GROUP BY p_size > 25")
def group_by_comparison(t):
    return t.part.groupBy((F.col("p_size") > 25).alias("big")).agg(F.count("*").alias("n"))


@query("SELECT p_brand FROM part GROUP BY p_brand")
def group_by_no_agg(t):
    return t.part.groupBy("p_brand").agg(F.count("*")).select("p_brand")


@query("SELECT o_orderstatus, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey GROUP BY o_orderstatus")
def group_null_key(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_single(t):
    return t.customer.select("c_mktsegment").distinct()


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_multi(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


# order and limit
@query("SELECT n_name FROM nation ORDER BY n_name")
def sort_single_asc(t):
    return t.nation.select("n_name").orderBy("n_name")


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_custkey DESC")
def sort_multi_key(t):
    return t.customer.select("c_mktsegment", "c_custkey").orderBy("c_mktsegment", F.desc("c_custkey"))


@query("SELECT s_suppkey AS id FROM supplier ORDER BY id DESC")
def sort_alias_desc(t):
    return t.supplier.select(F.col("s_suppkey").alias("id")).orderBy(F.desc("id"))


@query("SELECT n_name FROM nation ORDER BY n_nationkey")
def sort_unselected_column(t):
    return t.nation.orderBy("n_nationkey").select("n_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def limit_rows(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(5)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# common table expressions and recursion
def _sql(name: str, text: str, *tables: str) -> None:
    def f(t):
        return t.sql(text.format(**{n: "{" + n + "}" for n in tables}), *tables)

    f.__name__ = name
    query(text.format(**{n: n for n in tables}))(f)


_sql("cte_simple", "WITH big AS (SELECT p_partkey, p_size FROM {part} WHERE p_size > 40) SELECT p_partkey FROM big", "part")
_sql("cte_column_list", "WITH items (item_id, item_name) AS (SELECT p_partkey, p_name FROM {part}) SELECT item_id, item_name FROM items", "part")
_sql("cte_chained", "WITH a AS (SELECT * FROM {orders} WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, count(*) AS n FROM a GROUP BY o_custkey) SELECT o_custkey, n FROM b WHERE n > 3", "orders")
_sql("cte_reused", "WITH c AS (SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey) SELECT x.n_regionkey AS a, y.n_regionkey AS b FROM c x JOIN c y ON x.n = y.n", "nation")
_sql("cte_recursive_counter", "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 50) SELECT i FROM n")
_sql("cte_recursive_tree", "WITH RECURSIVE tree(k) AS (SELECT p_partkey FROM {part} WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey FROM {part} p JOIN tree t ON p.p_partkey = 2 * t.k + 1) SELECT k FROM tree", "part")
_sql("union_all_recursive", "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i * 2 FROM r WHERE i < 1000) SELECT i FROM r")


@query("WITH RECURSIVE tree(k, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, d + 1 FROM part p JOIN tree t ON p.p_partkey = 2 * t.k + 1) SELECT max(d) AS depth FROM tree")
def cte_recursive_depth(t):
    part = t.part.select("p_partkey")

    def step(level):
        return part.join(level, F.col("p_partkey") == 2 * F.col("k") + 1).select(F.col("p_partkey").alias("k"), (F.col("d") + 1).alias("d"))

    anchor = part.filter("p_partkey = 1").select(F.col("p_partkey").alias("k"), F.lit(0).alias("d"))
    return recursion.with_recursive(anchor, step).agg(F.max("d").alias("depth"))


@query("SELECT * FROM (VALUES (CAST(11 AS BIGINT)), (22), (33), (44)) v(id)")
def worktable_delta(t):
    w = recursion.Worktables(t.spark)
    w.spool("w", lambda: t.spark.createDataFrame([(11,), (22,)], "id long"), 1)
    for x in (33, 44):
        w.append_delta("w", t.spark.createDataFrame([(x,)], "id long"))
    return w.spool("w", lambda: None, 1)


@query("WITH s AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.n_regionkey, a.n + b.n AS two FROM s a JOIN s b ON a.n_regionkey = b.n_regionkey")
def spool_reuse(t):
    w = recursion.Worktables(t.spark)
    child = lambda: t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    a, b = w.spool("s", child, 1).alias("a"), w.spool("s", child, 1).alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select("a.n_regionkey", (F.col("a.n") + F.col("b.n")).alias("two"))


# snapshots and probes
_stamped = "SELECT o_orderkey, o_orderkey % 100 + 1 AS c, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 90 + 5 ELSE 0 END AS d FROM orders"
_visible = "(c = {r} OR (c <> 0 AND (c < {lo} OR (c < {hi} AND c NOT IN (30, 40))))) AND NOT (d <> 0 AND (d = {r} OR d < {lo} OR (d < {hi} AND d NOT IN (30, 40))))"


def _rows(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", (k % 100 + 1).alias("created_txn"), F.when(k % 7 == 0, k % 90 + 5).otherwise(0).alias("deleted_txn"))


@query(f"SELECT o_orderkey FROM ({_stamped}) WHERE {_visible.format(r=90, lo=20, hi=80)}")
def mvcc_visible(t):
    return snapshot.visible(_rows(t), snapshot.Snapshot(20, 80, (30, 40), 90)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_stamped}) WHERE {_visible.format(r=95, lo=5, hi=10)}")
def mvcc_own_writes(t):
    return snapshot.visible(_rows(t), snapshot.Snapshot(5, 10, (30, 40), 95)).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def index_probe_unique(t):
    return probe.probe(t.orders, {"o_orderkey": 77}).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 77 AND l_linenumber = 1")
def index_probe_composite(t):
    return probe.probe(t.lineitem, {"l_orderkey": 77, "l_linenumber": 1}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS from_probe FROM nation ORDER BY from_probe DESC")
def index_probe_fallback(t):
    return probe.probe_then_rest(t.nation, {"n_regionkey": 2}).select("n_nationkey", "from_probe").orderBy(F.desc("from_probe"))


# constraints
@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations_batch(t):
    return constraints.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unique_conflicts_existing(t):
    return constraints.existing_conflicts(t.orders, t.orders.filter("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_composite(t):
    return constraints.duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer o WHERE o.c_nationkey = c.c_nationkey AND o.c_mktsegment = c.c_mktsegment AND o.c_custkey <> c.c_custkey)")
def unique_update_self(t):
    return constraints.existing_conflicts(t.customer, t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL HAVING count(*) > 1")
def partial_unique_predicate(t):
    return constraints.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"], "l_quantity > 25")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000)")
def fk_orphans(t):
    return constraints.orphans(t.lineitem, ["l_orderkey"], t.orders.filter("o_totalprice > 50000"), ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k FROM customer) WHERE k IS NOT NULL AND k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)")
def fk_null_skipped(t):
    child = t.customer.select("c_custkey", F.expr("CASE WHEN c_acctbal > 0 THEN c_nationkey END").alias("k"))
    return constraints.orphans(child, ["k"], t.nation.filter("n_regionkey > 0"), ["n_nationkey"]).select("c_custkey")


# statements and queries by the engine itself, over a table of all nations
def _engine(t):
    from .plans.engine import Engine

    e = Engine(t.spark, f"{recursion.shared_dir(t.spark)}/{recursion.unique_name('engine')}")
    e.sql("CREATE TABLE nation (id INT PRIMARY KEY, name TEXT, region INT)")
    e.sql("BEGIN")
    e.txn.insert("main.public.nation", t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    e.sql("COMMIT")
    return e


def _dml(name: str, statement: str, sql: str) -> None:
    def f(t):
        e = _engine(t)
        e.sql(statement)
        return e.sql("SELECT * FROM nation")

    f.__name__ = name
    query(sql)(f)


_n = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"
_dml("dml_insert", "INSERT INTO nation (id, name, region) VALUES (100, 'O''Land', 1), (101, 'Utopia', 2)", f"{_n} UNION ALL SELECT 100, 'O''Land', 1 UNION ALL SELECT 101, 'Utopia', 2")
_dml("dml_update_const", "UPDATE nation SET region = 9 WHERE id = 3", f"SELECT id, name, CASE WHEN id = 3 THEN 9 ELSE region END AS region FROM ({_n})")
_dml("dml_update_text", "UPDATE nation SET name = 'renamed' WHERE id = 3", f"SELECT id, CASE WHEN id = 3 THEN 'renamed' ELSE name END AS name, region FROM ({_n})")
_dml("dml_update_add", "UPDATE nation SET region = region + 5 WHERE region = 2", f"SELECT id, name, CASE WHEN region = 2 THEN region + 5 ELSE region END AS region FROM ({_n})")
_dml("dml_update_sub", "UPDATE nation SET region = region - 1 WHERE region = 2", f"SELECT id, name, CASE WHEN region = 2 THEN region - 1 ELSE region END AS region FROM ({_n})")
_dml("dml_delete_eq", "DELETE FROM nation WHERE region = 2", f"SELECT * FROM ({_n}) WHERE region <> 2")


_dml("dml_update_quoted", "UPDATE nation SET name = 'a where b' WHERE name = 'FRANCE'", f"SELECT id, CASE WHEN name = 'FRANCE' THEN 'a where b' ELSE name END AS name, region FROM ({_n})")


def _select(name: str, text: str, sql: str) -> None:
    def f(t):
        return _engine(t).sql(text)

    f.__name__ = name
    query(sql)(f)


_select("cte_shadowing", "WITH nation AS (SELECT id + 100 AS id FROM main.public.nation) SELECT id AS id FROM nation", f"SELECT id + 100 AS id FROM ({_n})")
_select("literal_with_from", "SELECT 'from nation, join nation' AS text, name AS name FROM nation WHERE name <> 'came from nation'", f"SELECT 'from nation, join nation' AS text, name FROM ({_n})")
_select("project_three_parts", "SELECT main.public.nation.id AS id, n.name AS name FROM main.public.nation JOIN nation n ON main.public.nation.id = n.id", f"SELECT id, name FROM ({_n})")
_select("cte_recursive_deep", "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 150) SELECT i AS i FROM r", "SELECT CAST(range AS INT) AS i FROM range(1, 151)")


@query(f"SELECT id + 1 AS column_1, name FROM ({_n})")
def project_unnamed(t):
    return _engine(t).sql("SELECT id + 1, name FROM nation")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100 * c_acctbal")
def join_mixed_predicates(t):
    """The equality becomes the join's key, the rest its condition."""
    return t.sql("SELECT o_orderkey, c_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > 100 * c_acctbal", "orders", "customer")


@query("SELECT n_regionkey AS k, n_nationkey AS child FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 100 FROM nation")
def worktable_levels(t):
    w = recursion.Worktables(t.spark)
    w.spool("w", lambda: t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("child")), 1)
    w.append_delta("w", w.next_seed("w").select(F.col("child").alias("k"), (F.col("child") + 100).alias("child")))
    w.next_delta("w")
    return w.spool("w", lambda: None, 1)


# transactions and persistence
def _steps(name: str, sql: str, text: str = "SELECT * FROM nation"):
    """f runs statements on an engine with all nations; the result is what an engine opened anew on its folder sees."""

    def keep(f):
        def run(t):
            from .plans.engine import Engine

            e = _engine(t)
            f(e)
            return Engine(t.spark, e.store.files.root).sql(text)

        run.__name__ = name
        query(sql)(run)

    return keep


def _refused(e, statement: str) -> None:
    from .errors import EngineError

    try:
        e.sql(statement)
    except EngineError:
        return
    raise AssertionError(f"not refused: {statement}")


_steps("persist_reopen", _n)(lambda e: None)
_steps("txn_commit", f"{_n} UNION ALL SELECT 100, 'new', 1 UNION ALL SELECT 101, 'newer', 1")(lambda e: e.script("BEGIN; INSERT INTO nation (id, name, region) VALUES (100, 'new', 1); INSERT INTO nation (id, name, region) VALUES (101, 'newer', 1); COMMIT"))
_steps("txn_rollback", _n)(lambda e: e.script("BEGIN TRANSACTION; DELETE FROM nation WHERE region = 1; UPDATE nation SET region = 0 WHERE region = 2; ROLLBACK"))


@_steps("txn_conflict", f"SELECT * FROM ({_n}) WHERE region <> 1")
def _conflict(e):
    from .plans.engine import Engine

    e.script("BEGIN ISOLATION LEVEL SNAPSHOT; UPDATE nation SET region = 7 WHERE region = 2")
    Engine(e.spark, e.store.files.root).sql("DELETE FROM nation WHERE region = 1")
    _refused(e, "COMMIT")
    e.sql("ROLLBACK")


@_steps("savepoint_statement", f"SELECT * FROM ({_n}) UNION ALL SELECT 100, 'kept', 1")
def _savepoint(e):
    """A statement that fails takes nothing back but itself."""
    from .errors import EngineError
    from .plans.catalog import Catalog

    e.sql("BEGIN")
    e.sql("INSERT INTO nation (id, name, region) VALUES (100, 'kept', 1)")
    point = e.txn.savepoint()
    try:
        Catalog(e.txn).drop_table("nation")
        e.txn.insert("main.public.nation", e.spark.range(1))
    except (EngineError, TypeError):
        e.txn.restore(point)
    e.sql("COMMIT")


_steps("check_primary_key", _n)(lambda e: _refused(e, "INSERT INTO nation (id, name, region) VALUES (200, 'x', 1), (3, 'taken', 1)"))
_steps("check_foreign_key_first", _n)(lambda e: [e.sql("CREATE TABLE city (id INT PRIMARY KEY, nation INT REFERENCES nation (id))"), _refused(e, "INSERT INTO city (id, nation) VALUES (1, 999), (1, 999)")])
_steps("check_type_mismatch", _n)(lambda e: [_refused(e, x) for x in ("SELECT id FROM nation WHERE name = 5", "DELETE FROM nation WHERE name = 5", "UPDATE nation SET name = 5 WHERE id = 1", "INSERT INTO nation (id, name, region) VALUES (1.7, 'x', 1)")])
_steps("check_duplicate_alias", _n)(lambda e: _refused(e, "SELECT id AS a, name AS a FROM nation"))
_steps("vacuum_keeps_rows", f"SELECT * FROM ({_n}) WHERE region <> 3")(lambda e: [e.sql("DELETE FROM nation WHERE region = 3"), e.store.vacuum()])
_steps("alter_table", f"SELECT id, name AS label, CAST(NULL AS BIGINT) AS extra FROM ({_n})", "SELECT * FROM country")(lambda e: e.script("ALTER TABLE nation RENAME COLUMN name TO label; ALTER TABLE nation ADD COLUMN extra INT; ALTER TABLE nation DROP COLUMN region; ALTER TABLE nation RENAME TO country"))
_steps("databases_and_schemas", f"SELECT count(*) AS n FROM ({_n})", "SELECT count(*) AS n FROM nation")(lambda e: [e.script("CREATE DATABASE d; CREATE SCHEMA d.s; CREATE TABLE d.s.t (id INT, name TEXT DEFAULT 'x')"), _refused(e, "DROP SCHEMA d.s RESTRICT"), _refused(e, "DROP DATABASE d"), e.script("DROP TABLE d.s.t; DROP SCHEMA d.s; DROP DATABASE d; DROP DATABASE IF EXISTS d")])
_steps("script_is_atomic", f"SELECT count(*) AS n FROM ({_n})", "SELECT count(*) AS n FROM nation")(lambda e: _refused_script(e, "CREATE TABLE a (id INT); CREATE TABLE a (id INT)"))


def _refused_script(e, text: str) -> None:
    from .errors import EngineError

    try:
        e.script(text)
    except EngineError:
        return _refused(e, "SELECT * FROM a")
    raise AssertionError(f"not refused: {text}")


@query("SELECT * FROM (VALUES ('create table', 1, 0, 1), ('insert', 1, 1, 1), ('delete', 0, 0, 1), ('select', 1, 0, 0)) v(verb, succeeded, n_rows, bad)")
def command_metrics(t):
    from .plans.engine import Engine

    e = Engine(t.spark, f"{recursion.shared_dir(t.spark)}/{recursion.unique_name('metrics')}")
    e.script("CREATE TABLE t (id INT PRIMARY KEY)")
    e.sql("INSERT INTO t (id) VALUES (1)")
    for bad in ("CREATE TABLE t (id INT)", "INSERT INTO t (id) VALUES (1)", "DELETE FROM t"):
        _refused(e, bad)
    e.sql("SELECT id FROM t")
    held = e.telemetry.snapshot()
    rows = [(v, int(x["succeeded"]), held["operators"].get(v, {}).get("rows", 0), int(x["failed"])) for v, x in held["verbs"].items()]
    return t.spark.createDataFrame(rows, "verb string, succeeded int, n_rows int, bad int")


@query("SELECT * FROM (VALUES ('filter', 3), ('scan', 5)) v(operator, n_rows)")
def operator_telemetry(t):
    from .plans.engine import Engine

    e = Engine(t.spark, f"{recursion.shared_dir(t.spark)}/{recursion.unique_name('telemetry')}")
    e.script("CREATE TABLE t (id INT); INSERT INTO t (id) VALUES (1), (2), (3), (4), (5)")
    e.collect("SELECT id FROM t WHERE id % 2 = 1")
    held = e.telemetry.snapshot()["operators"]
    return t.spark.createDataFrame([(k, held[k]["rows"]) for k in ("filter", "scan")], "operator string, n_rows int")


@query("SELECT * FROM (VALUES ('main', 'public', 'nation')) v(database, schema, name)")
def meta_list_tables(t):
    return _engine(t).sql("\\dt NAT").select("database", "schema", "name")


@query(f"SELECT name FROM ({_n})")
def index_rows(t):
    e = _engine(t)
    e.sql("CREATE INDEX by_name ON nation USING bytelex (name)")
    return e.index_rows("by_name").select("name")


# catalog
@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def view_query(t):
    t.nation.createOrReplaceTempView(name := recursion.unique_name("nation"))
    t.spark.sql(f"CREATE OR REPLACE TEMP VIEW {name}_v AS SELECT n_name FROM {name} WHERE n_regionkey = 1")
    out = t.spark.table(f"{name}_v")
    for view in (f"{name}_v", name):
        t.spark.catalog.dropTempView(view)  # the plan is bound already
    return out


@query("SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS seq FROM customer")
def sequence_assign(t):
    return sequences.assign(t.customer.select("c_custkey"), ["c_custkey"], "seq", 100, 5)


@query("SELECT n_nationkey, 3 + (row_number() OVER (ORDER BY n_nationkey) - 1) % 7 AS seq FROM nation")
def sequence_cycle(t):
    numbered = sequences.assign(t.nation.select("n_nationkey"), ["n_nationkey"], "i", 0)
    return numbered.select("n_nationkey", (F.col("i") % 7 + 3).alias("seq"))


def _catalog(t):
    from .plans.engine import Engine

    e = Engine(t.spark, f"{recursion.shared_dir(t.spark)}/{recursion.unique_name('catalog')}")
    e.script("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT, name TEXT); CREATE UNIQUE INDEX i ON b USING utf8 (name); CREATE VIEW v AS SELECT id FROM a")
    return e


@query("SELECT * FROM (VALUES ('main', 'public', 'a', 1), ('main', 'public', 'b', 2)) v(database, schema, name, columns)")
def sys_relations(t):
    return _catalog(t).system("relations").select("database", "schema", "name", "columns")


@query("SELECT * FROM (VALUES ('main', 'public', 'i', 'b', 'name', TRUE)) v(database, schema, name, \"table\", columns, is_unique)")
def sys_indexes(t):
    return _catalog(t).system("indexes")


@query("SELECT * FROM (VALUES ('main', 'public', 'v', 'SELECT id FROM a')) v(database, schema, name, text)")
def sys_views(t):
    return _catalog(t).system("views")


@query("SELECT * FROM (VALUES ('a', 'primary_key', 'id'), ('b', 'unique', 'name')) v(\"table\", kind, columns)")
def sys_constraints(t):
    return _catalog(t).system("constraints").select("table", "kind", "columns")
