"""SQL text to results: queries go to Catalyst, DML and DDL to the store and the catalog, with metrics for each command."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError, EngineError, ParseError, TypeMismatch
from ..functions.types import compare
from ..operators.comparators import ordered
from ..operators.recursion import Worktables
from ..sources.store import Store, Transaction
from . import telemetry
from .binding import Plans, masked
from .catalog import Catalog

LITERAL = r"(?:'(?:[^']|'')*'|[^\s,()']+)"
QUERY = ("select", "with", "values", "explain", "table")


@dataclass
class CommandMetrics:
    text: str
    kind: str
    ok: bool = True
    verb: str = ""
    rows: int = 0
    bytes: int = 0
    seconds: float = 0.0
    correlation_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    message: str = ""
    severity: str = "info"
    hints: list[str] = field(default_factory=list)

    def json(self) -> str:
        return json.dumps(asdict(self))


def split_script(text: str) -> list[str]:
    """Statements between semicolons outside of quotes, comments and braces."""
    out, part, i, depth = [], "", 0, 0
    while i < len(text):
        depth += (text[i] == "{") - (text[i] == "}")
        if text[i] == "'":
            end = i + 1
            while end < len(text) and (text[end] != "'" or text[end : end + 2] == "''"):
                end += 2 if text[end : end + 2] == "''" else 1
            part, i = part + text[i : end + 1], end + 1
        elif text.startswith("--", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
        elif text[i] == ";" and not depth:
            out, part, i = [*out, part], "", i + 1
        else:
            part, i = part + text[i], i + 1
    return [s.strip() for s in [*out, part] if s.strip()]


def split_list(text: str) -> list[str]:
    """Parts between commas outside of quotes and brackets."""
    out, depth, quoted, part = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out, part = [*out, part], ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


#: Spark's bounds on recursive queries, which the engine lifts.
RECURSION = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


class Engine:
    """Runs statements.  log: a path for one JSON line a command, or - for standard output; sink: is given each query's
    text with its logical plan, physical plan and planner diagnostics."""

    def __init__(self, spark: SparkSession, root: str, log: str | None = None, sink=None) -> None:
        self.spark, self.store, self.log, self.sink = spark, Store(spark, root), log, sink
        self.plans, self.telemetry, self.worktables = Plans(spark), telemetry.Telemetry(), Worktables(spark)
        self.txn: Transaction | None = None
        self.metrics: list[CommandMetrics] = []
        for key in RECURSION:
            spark.conf.set(key, "-1")

    # statements
    def sql(self, text: str) -> DataFrame | None:
        """Run one statement: a DataFrame for queries, None for others; raises EngineError."""
        text = text.strip().rstrip(";").strip()
        word = text.split(None, 1)[0].lower() if text else ""
        kind = "meta" if text.startswith("\\") else "dml" if word in (*QUERY, "insert", "update", "delete") else "txn" if word in ("begin", "commit", "rollback") else "ddl"
        verb = " ".join(text.split(None, 2)[:2]).lower() if kind == "ddl" else word
        m, began, out = CommandMetrics(text, kind, verb=verb), time.time(), None
        rejected = False
        try:
            out = self._run(word, text, m)
        except PySparkException as e:
            rejected = type(e).__name__ == "ParseException"
            m.ok, m.severity, m.message = False, "error", str(e).split("\n")[0]
            if self.txn:
                self.txn.failed = True
            raise (ParseError if rejected else EngineError)(m.message) from e
        except EngineError as e:
            rejected = isinstance(e, ParseError)
            m.ok, m.severity, m.message, m.hints = False, e.severity, str(e), e.hints
            if self.txn:
                self.txn.failed = True
            raise
        finally:
            m.seconds = time.time() - began
            self.metrics.append(m)
            self.telemetry.verb(verb, m.ok, m.seconds, rejected)
            if m.ok and word in ("insert", "update", "delete"):
                self.telemetry.wrote(word, m.rows, m.bytes, m.seconds)
            if self.log == "-":
                print(m.json())
            elif self.log:
                with open(self.log, "a") as f:
                    f.write(m.json() + "\n")
        return out

    def script(self, text: str) -> list[DataFrame | None]:
        """All statements in order; a script of definitions only takes effect as a whole or not at all."""
        statements = split_script(text)
        words = [s.split(None, 1)[0].lower() for s in statements]
        if self.txn or len(words) < 2 or not all(w in ("create", "drop", "alter") for w in words):
            return [self.sql(s) for s in statements]
        self.sql("BEGIN")
        try:
            out = [self.sql(s) for s in statements]
        except EngineError:
            self.sql("ROLLBACK")
            raise
        self.sql("COMMIT")
        return out

    def collect(self, text: str) -> list:
        """Rows of a query, whose operators' rows and times go to the telemetry."""
        df = self.sql(text)
        rows = df.collect()
        self.telemetry.ran(telemetry.executed(df))
        return rows

    def _run(self, word: str, text: str, m: CommandMetrics) -> DataFrame | None:
        if word == "begin":
            if self.txn:
                raise EngineError("A transaction is open already.", "COMMIT or ROLLBACK first.")
            found = re.fullmatch(r"begin(?:\s+(?:transaction|work))?(?:\s+isolation\s+level\s+(snapshot|read\s+committed))?", text, re.I)
            if not found:
                raise ParseError("Expected BEGIN [ISOLATION LEVEL SNAPSHOT | READ COMMITTED]")
            self.txn = Transaction(self.store, " ".join((found[1] or "snapshot").upper().split()))
            return None
        if word in ("commit", "rollback"):
            if not self.txn:
                raise EngineError("No transaction is open.")
            txn = self.txn
            if word == "commit":
                txn.commit()
            self.txn = None
            return None
        txn = self.txn or Transaction(self.store)
        if txn.failed:
            raise EngineError("The transaction has failed; roll it back.", "ROLLBACK")
        txn.refresh()
        point = txn.savepoint()
        catalog = Catalog(txn)
        try:
            out = self._statement(word, text, catalog, m)
        except Exception:
            txn.restore(point)  # a statement takes effect as a whole or not at all
            raise
        if not self.txn:
            txn.commit()
        return out

    def _statement(self, word: str, text: str, catalog: Catalog, m: CommandMetrics) -> DataFrame | None:
        if text.startswith("\\"):
            return self.meta(text, catalog)
        if word in QUERY:
            return self.query(text, catalog)
        if word in ("insert", "update", "delete"):
            catalog.txn.bytes = 0
            m.rows = getattr(self, f"_{word}")(text, catalog)
            m.bytes = catalog.txn.bytes
            return None
        for pattern, make in DDL:
            if found := re.fullmatch(pattern, text, re.I | re.S):
                make(catalog, found)
                return None
        raise ParseError(f"Not understood: {text[:60]}")

    # queries
    def query(self, text: str, catalog: Catalog) -> DataFrame:
        """Tables and views of the transaction's snapshot become temporary views; their names in the text follow."""
        if found := re.fullmatch(r"explain(?:\s+(extended|codegen|cost|formatted|analyze|logical|rules))?\s+(.+)", text, re.I | re.S):
            return self.spark.createDataFrame([(self.explain(found[2], (found[1] or "formatted").lower()),)], "plan string")
        prefix = f"t{uuid.uuid4().hex[:8]}"
        names: dict[str, str] = {}
        for d, db in catalog.databases.items():
            for s, sc in db["schemas"].items():
                for t in (*sc["tables"], *sc["views"]):
                    alias = f"{prefix}_{d}_{s}_{t}"
                    names[f"{d}.{s}.{t}"] = alias
                    if d == catalog.database:
                        names[f"{s}.{t}"] = alias
                        if s == catalog.schema:
                            names[t] = alias
        made: dict[str, str] = {}

        def declared(name: str) -> str | None:
            """The temporary view that stands for a name; made when first asked for."""
            alias = names.get(name)
            if alias and alias not in made:
                made[alias] = next(k for k, v in names.items() if v == alias and k.count(".") == 2)
                d, s, t = made[alias].split(".")
                schema = catalog.databases[d]["schemas"][s]
                df = catalog.txn.rows(f"{d}.{s}.{t}") if t in schema["tables"] else self.spark.sql(self.plans.renamed(schema["views"][t]["text"], declared))
                df.createOrReplaceTempView(alias)
            return alias

        try:
            self.plans.check_aliases(self.plans.parse(text))
            out = self.spark.sql(self.plans.renamed(text, declared))
            self.plans.check_types(out)
            out = out.toDF(*self.plans.output_names(text, out.columns))
            self.names = {alias: name for alias, name in made.items()}
            if self.sink:
                self.sink({"text": text, "logical": telemetry.logical(self.plans, out, self.names), "physical": _explained(self.spark, out, "formatted"), "diagnostics": telemetry.rules(out)})
        except Py4JJavaError as e:  # the parser is asked directly
            raise ParseError(str(e.java_exception.getMessage()).strip().split("\n")[0]) from e
        finally:
            for alias in made:
                self.spark.catalog.dropTempView(alias)  # the plan is bound already
        return out

    def index_rows(self, name: str) -> DataFrame:
        """The table's rows that an index has, in its order."""
        catalog = Catalog(self.txn or Transaction(self.store))
        d, s, i = catalog.resolve(name)
        held = catalog.databases.get(d, {}).get("schemas", {}).get(s, {}).get("indexes", {}).get(i)
        if held is None:
            raise CatalogError(f"Index '{name}' does not exist")
        rows = catalog.txn.rows(f"{d}.{s}.{held['table']}")
        return ordered(rows.filter(held["predicate"]) if held["predicate"] else rows, held["columns"], held["comparator"])

    # DML
    def _insert(self, text: str, catalog: Catalog) -> int:
        found = cut(r"insert\s+into\s+([\w.$]+)\s*\(([^)]*)\)\s*values\s*(.+)", text)
        if not found:
            raise ParseError("Expected INSERT INTO table (columns) VALUES (...)")
        table, columns = catalog.table(found[1]), [c.strip().lower() for c in found[2].split(",")]
        if sorted(columns) != sorted(c["name"] for c in table["columns"]):
            raise ParseError("The column list must name every column once", "Columns: " + ", ".join(c["name"] for c in table["columns"]))
        rows = split_list(found[3])
        if any(not r.startswith("(") or len(split_list(r[1:-1])) != len(columns) for r in rows):
            raise ParseError("Each row needs a value for each column")
        kinds = {c["name"]: c["kind"] for c in table["columns"]}
        for r in rows:
            for c, v in zip(columns, split_list(r[1:-1])):
                if not re.fullmatch(r"null|true|false|[+-]?\d+(?:\.\d+)?|'(?:[^']|'')*'", v, re.I | re.S):
                    raise ParseError(f"Only literals may be inserted, not {v}")
                if v.lower() != "null" and not re.fullmatch(r"'.*'" if kinds[c] == "utf8" else r"[+-]?\d+", v, re.S):
                    raise TypeMismatch(f"Column '{c}' does not take {v}.", "Give a quoted text." if kinds[c] == "utf8" else "Give a whole number.")
        data = self.spark.sql(f"SELECT * FROM VALUES {found[3]} AS v({', '.join(f'`{c}`' for c in columns)})")
        return catalog.txn.insert(catalog.full(found[1]), data)

    def _where(self, df: DataFrame, text: str):
        """A single comparison is checked for its types; anything else that Spark understands may stand here too."""
        if found := re.fullmatch(rf"([\w.$]+)\s*(<=|>=|<>|=|<|>)\s*({LITERAL})", text, re.S):
            return compare(df, F.expr(found[1].split(".")[-1]), found[2], F.expr(found[3]))
        return F.expr(text)

    def _update(self, text: str, catalog: Catalog) -> int:
        found = cut(r"update\s+([\w.$]+)\s+set\s+(\w+)\s*=\s*(.+?)\s+where\s+(.+)", text)
        if not found:
            raise ParseError("Expected UPDATE table SET column = value WHERE condition")
        name, column = catalog.full(found[1]), found[2].lower()
        catalog._column(catalog.table(found[1]), column)
        df = catalog.txn.rows(name)
        value = F.expr(found[3])
        compare(df, F.col(column), "=", value)
        text = df.schema[column].dataType.typeName() == "string"
        return catalog.txn.update(name, column, value.cast("string" if text else "bigint"), self._where(df, found[4]))

    def _delete(self, text: str, catalog: Catalog) -> int:
        found = cut(r"delete\s+from\s+([\w.$]+)\s+where\s+(.+)", text)
        if not found:
            raise ParseError("Expected DELETE FROM table WHERE condition")
        name = catalog.full(found[1])
        return catalog.txn.delete(name, self._where(catalog.txn.rows(name), found[2]))

    # shell
    def meta(self, text: str, catalog: Catalog) -> DataFrame:
        command, _, pattern = text.partition(" ")
        what = {"\\dt": "relations", "\\di": "indexes", "\\dv": "views", "\\dl": "sequences"}.get(command)
        if what is None:
            raise ParseError(f"Unknown command {command}", "\\dt \\di \\dv \\dl [pattern]")
        return self.system(what, catalog).filter(F.lower("name").contains(pattern.strip().lower()))

    SYSTEM = {"relations": "database string, schema string, name string, id long, columns int", "columns": "database string, schema string, table string, name string, type string, ordinal int", "indexes": "database string, schema string, name string, table string, columns string, is_unique boolean", "views": "database string, schema string, name string, text string", "constraints": "database string, schema string, table string, name string, kind string, columns string", "sequences": "database string, schema string, name string, next_value long"}

    def system(self, what: str, catalog: Catalog | None = None) -> DataFrame:
        """A system relation as a DataFrame."""
        rows = (catalog or Catalog(Transaction(self.store))).snapshot()[what]
        names = [x.split()[0] for x in self.SYSTEM[what].split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], self.SYSTEM[what])

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query.  Modes: logical; formatted, cost and Spark's others; analyze runs it and gives rows and times; rules."""
        df = self.query(text, Catalog(self.txn or Transaction(self.store)))
        if mode == "logical":
            return telemetry.logical(self.plans, df, self.names)
        if mode == "rules":
            df._jdf.queryExecution().executedPlan()
            return json.dumps(telemetry.rules(df))
        if mode == "analyze":
            df.collect()
            nodes = telemetry.executed(df)
            self.telemetry.ran(nodes)
            return telemetry.with_figures(nodes)
        return _explained(self.spark, df, mode)


def _explained(spark: SparkSession, df: DataFrame, mode: str) -> str:
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def cut(pattern: str, text: str) -> list[str] | None:
    """A pattern's groups, from 1 on, in the text; what quotes hold is not looked at."""
    found = re.fullmatch(pattern, masked(text), re.I | re.S)
    return found and [text, *(text[a:b] for a, b in (found.span(i + 1) for i in range(found.re.groups)))]


def _columns(catalog: Catalog, found: re.Match) -> None:
    columns, constraints = [], []
    for part in split_list(found[3]):
        if x := re.match(r"(?:constraint\s+(\w+)\s+)?(primary\s+key|unique|foreign\s+key)\s*\(([^)]*)\)(?:\s+references\s+([\w.]+)\s*\(([^)]*)\))?", part, re.I):
            kind = "_".join(x[2].lower().split())
            constraints.append({"kind": kind, "columns": [c.strip() for c in x[3].split(",")]} | ({"name": x[1]} if x[1] else {}) | ({"parent": x[4], "parent_columns": [c.strip().lower() for c in x[5].split(",")]} if x[4] else {}))
            continue
        x = re.match(r"([\w$]+)\s+(\w+)(?:\(\d+(?:,\s*\d+)?\))?(.*)", part, re.S)
        if not x:
            raise ParseError(f"Not a column: {part}")
        rest = x[3].lower()
        default = re.search(r"default\s+(.+?)(?:\s+(?:primary|unique|not|references)\b|$)", x[3], re.I | re.S)
        columns.append({"name": x[1], "type": x[2], "default": default[1] if default else None})
        for kind, mark in (("primary_key", "primary key"), ("unique", "unique"), ("not_null", "not null")):
            if mark in " ".join(rest.split()):
                constraints.append({"kind": kind, "columns": [x[1]]})
        if ref := re.search(r"references\s+([\w.]+)\s*\((\w+)\)", rest):
            constraints.append({"kind": "foreign_key", "columns": [x[1]], "parent": ref[1], "parent_columns": [ref[2]]})
    catalog.create_table(found[2], columns, constraints, bool(found[1]))


def _schema(catalog: Catalog, found: re.Match) -> None:
    catalog.create_schema(found[2], bool(found[1]))
    for s in split_script((found[3] or "").replace("\n", " ")):
        for pattern, make in DDL:
            if x := re.fullmatch(pattern, s, re.I | re.S):
                inner = Catalog(catalog.txn, catalog.database, found[2].split(".")[-1].lower())
                make(inner, x)
                break
        else:
            raise ParseError(f"Not understood: {s[:60]}")


def _index(catalog: Catalog, x: re.Match) -> None:
    options = dict(re.findall(r"(\w+)\s*=\s*(\w+)", x[8] or ""))
    options = {k.lower(): v for k, v in options.items()}
    names = lambda t: [c.strip() for c in t.split(",")] if t else []
    catalog.create_index(x[3], x[4], names(x[6]), bool(x[1]), x[5] or options.get("comparator"), int(options["fanout"]) if "fanout" in options else None, tuple(names(x[7])), x[9], bool(x[2]))


IF_NOT, IF = r"(if\s+not\s+exists\s+)?", r"(if\s+exists\s+)?"
DDL = [
    (rf"create\s+database\s+{IF_NOT}(\w+)", lambda c, x: c.create_database(x[2], bool(x[1]))),
    (rf"drop\s+database\s+{IF}(\w+)(\s+cascade)?", lambda c, x: c.drop_database(x[2], bool(x[1]), bool(x[3]))),
    (rf"create\s+schema\s+{IF_NOT}([\w.]+)(?:\s+authorization\s+\w+)?(?:\s*\{{(.*)\}})?", _schema),
    (rf"drop\s+schema\s+{IF}([\w., ]+?)(\s+cascade|\s+restrict)?", lambda c, x: [c.drop_schema(n.strip(), bool(x[1]), (x[3] or "").strip().lower() == "cascade") for n in x[2].split(",")]),
    (rf"create\s+table\s+{IF_NOT}([\w.$]+)\s*\((.*)\)", _columns),
    (rf"drop\s+table\s+{IF}([\w.$]+)(\s+cascade)?", lambda c, x: c.drop_table(x[2], bool(x[1]), bool(x[3]))),
    (r"alter\s+table\s+([\w.$]+)\s+rename\s+to\s+(\w+)", lambda c, x: c.rename_table(x[1], x[2])),
    (r"alter\s+table\s+([\w.$]+)\s+rename\s+column\s+(\w+)\s+to\s+(\w+)", lambda c, x: c.rename_column(x[1], x[2], x[3])),
    (rf"alter\s+table\s+([\w.$]+)\s+add\s+column\s+{IF_NOT}(\w+)\s+(\w+)", lambda c, x: c.add_column(x[1], x[3], x[4], bool(x[2]))),
    (rf"alter\s+table\s+([\w.$]+)\s+drop\s+column\s+{IF}(\w+)", lambda c, x: c.drop_column(x[1], x[3], bool(x[2]))),
    (rf"create\s+(unique\s+)?index\s+{IF_NOT}(\w+)\s+on\s+([\w.$]+)(?:\s+using\s+(\w+))?\s*\(([^)]*)\)(?:\s+include\s*\(([^)]*)\))?(?:\s+with\s*\(([^)]*)\))?(?:\s+where\s+(.+))?", _index),
    (rf"drop\s+index\s+{IF}([\w.]+)", lambda c, x: c.drop_index(x[2], bool(x[1]))),
    (rf"create\s+view\s+{IF_NOT}([\w.]+)\s+as\s+(.+)", lambda c, x: c.create_view(x[2], x[3], bool(x[1]))),
]
