"""Versioned parquet tables under one manifest.

Each version of the manifest is a file of its own that lists the data files of every table.  A commit creates the next
version's file, which fails if it is there already; then the commit looks at the new head and tries again, so of two
writers none is lost.  Data files are never changed: an insert adds files, an update or delete rewrites only the files
that hold matching rows.  A transaction works on a pinned manifest and commits if no table it wrote was changed meanwhile.
"""

from __future__ import annotations

import copy
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, RangeViolation, TransactionConflict, TypeMismatch
from ..functions.types import RANGES, SPARK, family, in_range
from ..operators.constraints import enforce

ROW_ID = "__row_id"
#: Versions of the manifest that a vacuum leaves; a commit that has been under way for longer could not be told from a new one.
KEPT = 1000
#: Rows whose keys are broadcast to the table that they are checked against, rather than joined by a shuffle.
SMALL = 100_000


class Files:
    """Hadoop file access, so that any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.fs.mkdirs(self.path(""))

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        fresh = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(fresh)
        stream.write(bytearray(text.encode()))
        stream.close()
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, over)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(fresh, self.path(name), options)

    def create(self, name: str, text: str) -> bool:
        """The file appears whole, or not at all if there is one of that name already."""
        fresh = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(fresh)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename would replace; a second name for the file does not
                here, there = (self.jvm.java.io.File(self.fs.makeQualified(p).toUri().getPath()).toPath() for p in (fresh, self.path(name)))
                self.jvm.java.nio.file.Files.createLink(there, here)
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                self.jvm.java.lang.reflect.Array.set(options, 0, none)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(fresh, self.path(name), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(fresh, False)

    def names(self, prefix: str) -> list[str]:
        return sorted(n for s in self.fs.listStatus(self.path("")) if (n := s.getPath().getName()).startswith(prefix))

    def size(self, names: list[str]) -> int:
        return sum(self.fs.getFileStatus(self.path(n)).getLen() for n in names)

    def parquet(self, folder: str) -> list[str]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]
        return [f"{folder}/{n}" for n in sorted(names) if n.endswith(".parquet")]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def schema_of(table: dict) -> T.StructType:
    return T.StructType([T.StructField(c["name"], SPARK[c["kind"]]) for c in table["columns"]])


class Store:
    """All tables of all databases; ``head`` is the manifest as committed last."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def head(self) -> dict:
        for name in reversed(self.files.names("manifest-")):
            if text := self.files.read(name):
                return json.loads(text)
        return {"version": 0, "next_id": 1, "next_txn": 1, "databases": {}}

    def commit(self, base: dict, new: dict, written: set[str], changed_catalog: bool) -> dict:
        """new becomes the head; raises if the head has other versions of the written tables than base."""
        while True:
            head, out = self.head(), new
            if head["version"] != base["version"]:
                if changed_catalog:
                    raise TransactionConflict("The catalog was changed by another transaction.", "Run the statement again.")
                for name in written:
                    if _entry(head, name) is None or _entry(head, name)["version"] != _entry(base, name)["version"]:
                        raise TransactionConflict(f"Table '{name}' was changed by another transaction.", "Run the transaction again.")
                out = copy.deepcopy(head)
                for name in written:
                    _entry(out, name).update(_entry(new, name))
            out["version"] = head["version"] + 1
            for k in ("next_txn", "next_id"):
                out[k] = max(new[k], head[k])
            if self.files.create(f"manifest-{out['version']:012d}.json", json.dumps(out)):
                return out

    def rows(self, manifest: dict, name: str, hidden: bool = False, raw: bool = False) -> DataFrame:
        """hidden: with row ids; raw: whole numbers as files hold them, all as bigint."""
        table = _entry(manifest, name)
        stored = lambda c: T.StringType() if c["kind"] == "utf8" else T.LongType()
        full = T.StructType([T.StructField(c["field"], stored(c)) for c in table["columns"]] + [T.StructField(ROW_ID, T.LongType())])
        if table["files"]:
            df = self.spark.read.schema(full).parquet(*[f"{self.files.root}/{f}" for f in table["files"]])
        else:
            df = self.spark.createDataFrame([], full)
        return df.select(*[(F.col(c["field"]) if raw else F.col(c["field"]).cast(SPARK[c["kind"]])).alias(c["name"]) for c in table["columns"]], *([ROW_ID] if hidden else []))

    def write(self, table: dict, df: DataFrame) -> list[str]:
        folder = f"data/{table['id']}/{uuid.uuid4().hex}"
        df.select(*[F.col(c["name"]).cast("string" if c["kind"] == "utf8" else "bigint").alias(c["field"]) for c in table["columns"]], ROW_ID).write.parquet(f"{self.files.root}/{folder}")
        return self.files.parquet(folder)

    def vacuum(self) -> int:
        """Delete data files that the head does not list; only safe while no transaction is open."""
        used = {f for t in _tables(self.head()).values() for f in t["files"]}
        gone = 0
        if not self.files.fs.exists(self.files.path("data")):
            return 0
        for t in self.files.fs.listStatus(self.files.path("data")):
            for d in self.files.fs.listStatus(t.getPath()):
                folder = f"data/{t.getPath().getName()}/{d.getPath().getName()}"
                names = self.files.parquet(folder)
                free = [n for n in names if n not in used]
                for n in [folder] if len(free) == len(names) else free:
                    self.files.delete(n)
                gone += len(free)
        for n in self.files.names("manifest-")[:-KEPT]:
            self.files.delete(n)
        return gone


def _tables(manifest: dict) -> dict[str, dict]:
    return {f"{d}.{s}.{t}": e for d, db in manifest["databases"].items() for s, sc in db["schemas"].items() for t, e in sc["tables"].items()}


def _entry(manifest: dict, name: str) -> dict | None:
    d, s, t = name.split(".")
    return manifest["databases"].get(d, {}).get("schemas", {}).get(s, {}).get("tables", {}).get(t)


class Transaction:
    """SNAPSHOT pins the manifest at its begin; READ COMMITTED takes a new one for each statement until it writes."""

    def __init__(self, store: Store, isolation: str = "SNAPSHOT") -> None:
        self.store, self.isolation = store, isolation
        self.base = store.head()
        self.work = copy.deepcopy(self.base)
        self.written: set[str] = set()
        self.catalog = False
        self.failed = False
        self.bytes = 0  # written by the last statement

    def refresh(self) -> None:
        if self.isolation == "READ COMMITTED" and not self.written and not self.catalog:
            self.base = self.store.head()
            self.work = copy.deepcopy(self.base)

    def savepoint(self) -> tuple:
        return copy.deepcopy(self.work), set(self.written), self.catalog

    def restore(self, point: tuple) -> None:
        self.work, self.written, self.catalog = copy.deepcopy(point[0]), set(point[1]), point[2]

    def commit(self) -> None:
        if self.failed:
            raise EngineError("The transaction has failed; roll it back.", "ROLLBACK")
        if self.written or self.catalog:
            self.store.commit(self.base, self.work, self.written, self.catalog)

    def rows(self, name: str, hidden: bool = False) -> DataFrame:
        return self.store.rows(self.work, name, hidden)

    def table(self, name: str) -> dict:
        return _entry(self.work, name)

    def _check(self, name: str, rest: DataFrame, fresh: DataFrame, n: int, changed: set[str] | None = None) -> None:
        """fresh: the n rows of new files; rest: those of the files that stay, which were checked when they came.

        changed: the columns that may have changed (None: all); constraints on others hold as before.
        """
        held = [c for c in self.table(name)["constraints"] if changed is None or c.get("predicate") or changed & set(c["columns"])]
        enforce(fresh, held, lambda parent: self.rows(parent), rest, n <= SMALL)

    def insert(self, name: str, rows: DataFrame) -> int:
        table = self.table(name)
        first = table["next_row"]
        cast = rows.select(*[self._fitting(c, rows.schema[c["name"]].dataType) for c in table["columns"]])
        files = self.store.write(table, cast.withColumn(ROW_ID, F.lit(first) + F.monotonically_increasing_id()))
        self._ranges(table, self._read(table, files, True))
        fresh = self._read(table, files)
        n, top = fresh.agg(F.count("*"), F.max(ROW_ID)).first()
        self._check(name, self.rows(name, True), fresh, n)
        table["files"] += files
        table["next_row"] = (top or first - 1) + 1
        self._mark(name, files)
        return n

    def _fitting(self, column: dict, given: T.DataType) -> Column:
        """A column of the given type as the table holds it; a number with a fraction does not fit, nor does another family."""
        value, want = F.col(f"`{column['name']}`"), "string" if column["kind"] == "utf8" else "numeric"
        if family(given) not in (want, "unknown"):
            raise TypeMismatch(f"Column '{column['name']}' does not take {given.simpleString()}.", "Cast the value.")
        if want == "string":
            return value.cast("string").alias(column["name"])
        whole = value.cast("bigint")
        if not isinstance(given, T.IntegralType | T.NullType):
            wrong = F.raise_error(F.lit(f"A value of column '{column['name']}' is not a whole number.")).cast("bigint")
            whole = F.when(value.isNull() | (value == F.floor(value)), whole).otherwise(wrong)
        return whole.alias(column["name"])

    def _ranges(self, table: dict, rows: DataFrame) -> None:
        """One pass over the rows for all columns."""
        out = [c["name"] for c in table["columns"] if c["kind"] in RANGES]
        if not out:
            return
        bad = rows.agg(*[F.count_if(~in_range(c["kind"], F.col(c["name"]))).alias(c["name"]) for c in table["columns"] if c["name"] in out]).first()
        for name in out:
            if bad[name]:
                raise RangeViolation(f"A value is out of the range of column '{name}'.")

    def _read(self, table: dict, files: list[str], raw: bool = False) -> DataFrame:
        return self.store.rows({"databases": {"d": {"schemas": {"s": {"tables": {"t": table | {"files": files}}}}}}}, "d.s.t", True, raw)

    def _mark(self, name: str, files: list[str] = ()) -> None:
        self.table(name)["version"] = uuid.uuid4().hex
        self.written.add(name)
        self.bytes = self.store.files.size(files)

    def _split(self, name: str, condition: Column) -> tuple[list[str], list[str]]:
        """Files that hold matching rows, and the others, whose content stays as it is."""
        hit = self.rows(name, True).withColumn("__file", F.input_file_name()).filter(condition).select("__file").distinct().collect()
        ends = {"/".join(r[0].split("/")[-4:]) for r in hit}
        files = self.table(name)["files"]
        return [f for f in files if f in ends], [f for f in files if f not in ends]

    def update(self, name: str, column: str, value: Column, condition: Column) -> int:
        touched, rest = self._split(name, condition)
        if not touched:
            return 0
        table = self.table(name)
        met = F.coalesce(condition, F.lit(False))
        old = self._read(table, touched)
        new = old.withColumn(column, F.when(met, value).otherwise(F.col(column)))
        files = self.store.write(table, new)
        self._ranges(table, self._read(table, files, True))
        fresh = self._read(table, files)
        n, all_rows = old.agg(F.count_if(met), F.count("*")).first()
        self._check(name, self._read(table, rest), fresh, all_rows, {column})
        table["files"] = rest + files
        self._mark(name, files)
        return n

    def delete(self, name: str, condition: Column) -> int:
        touched, rest = self._split(name, condition)
        if not touched:
            return 0
        table = self.table(name)
        met = F.coalesce(condition, F.lit(False))
        old = self._read(table, touched)
        n = old.filter(met).count()
        files = self.store.write(table, old.filter(~met))
        table["files"] = rest + files
        self._mark(name, files)
        return n
