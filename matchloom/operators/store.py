"""Keyed tables under one log of commits: snapshots over several tables, transactions, replacement of the buckets touched.

A table's rows lie in BUCKETS buckets by the hash of one column, each a list of parquet folders.  The log is numbered files, each made
only if it is absent; a commit says which folders a bucket now has.  A reader replays the log up to a number, and so sees all
of a commit, in all its tables, or nothing of it.  A writer prepares its folders first and then takes the next number; if another
writer took it, the commits in between are looked at: if they touched a bucket that this one rewrites or has read, it raises
ConflictError, and `transact` runs it again on the new state; else it takes the number after.

Only buckets that hold the keys of the rows given are read and written again, so that one offer among many costs one bucket.
Every CHECKPOINT commits the whole state is written beside the log, and readers replay from there.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, ConflictError
from ..schemas import BUCKET_BY, KEYS, TABLES

log = logging.getLogger(__name__)

BUCKETS = 64
CHECKPOINT = 16
_BUCKET = "_bucket"


def stable_id(*columns: str):
    """The id that a row's key gives: the same at every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


@dataclass
class State:
    """What the log says up to a number: each table's folders by bucket, the commits that touched it, and the migrations applied."""

    version: int = 0
    buckets: int = BUCKETS
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    touched: dict[str, int] = field(default_factory=dict)
    migrations: dict[str, str] = field(default_factory=dict)

    def apply(self, commit: dict) -> None:
        self.version, self.buckets = commit["version"], commit["buckets"]
        for table, change in commit["changes"].items():
            own = {} if change["clear"] else self.tables.get(table, {})
            own |= change["set"]
            for bucket, folders in change["add"].items():
                own[bucket] = [*own.get(bucket, []), *folders]
            self.tables[table] = {b: f for b, f in own.items() if f}
            self.touched[table] = self.version
        self.migrations |= commit["migrations"]


class Transaction:
    """Changes on a snapshot that become visible together.  Reads see its own changes."""

    def __init__(self, store: Store, state: State):
        self.store, self.state = store, state
        self.changes: dict[str, dict] = {}
        self.seen: dict[str, set[str] | None] = {}
        self.migrations: dict[str, str] = {}

    def _folders(self, table: str, buckets: set[str] | None = None) -> list[str]:
        own, change = dict(self.state.tables.get(table, {})), self.changes.get(table)
        if change:
            own = ({} if change["clear"] else own) | change["set"]
            for bucket, folders in change["add"].items():
                own[bucket] = [*own.get(bucket, []), *folders]
        return [f for b, folders in own.items() if buckets is None or b in buckets for f in folders]

    def _saw(self, table: str, buckets: set[str] | None) -> None:
        before = self.seen.get(table, set())
        self.seen[table] = None if buckets is None or before is None else before | buckets

    def read(self, table: str, buckets: set[str] | None = None) -> DataFrame:
        """The table, or its rows in `buckets`; another writer's commit to what was read is a conflict."""
        self._saw(table, buckets)
        return self.store._load(table, self._folders(table, buckets))

    def of(self, table: str, value) -> DataFrame:
        """The rows whose bucket column has a value, from its bucket alone."""
        by = BUCKET_BY[table]
        bucket = self.store._buckets_of(self.store.spark.createDataFrame([(value,)], T.StructType([TABLES[table][by]])))
        return self.read(table, bucket).where(F.col(by) == value)

    def _change(self, table: str) -> dict:
        return self.changes.setdefault(table, {"clear": False, "set": {}, "add": {}})

    def rewrite(self, table: str, touched: set[str], rows: DataFrame) -> None:
        """`rows` are all that the buckets `touched` hold from now on."""
        change, written = self._change(table), self.store._write(table, rows)
        for bucket in touched | set(written):
            change["set"][bucket] = written.get(bucket, [])
            change["add"].pop(bucket, None)

    def replace(self, table: str, rows: DataFrame) -> None:
        """These rows and no others."""
        written = self.store._write(table, rows)
        self.changes[table] = {"clear": True, "set": written, "add": {}}

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows beside those that are there; no conflict with others who append."""
        change = self._change(table)
        for bucket, folders in self.store._write(table, rows).items():
            into = change["set"] if bucket in change["set"] else change["add"]
            into[bucket] = [*into.get(bucket, []), *folders]

    def upsert(self, table: str, rows: DataFrame, update: list[str] | None = None) -> None:
        """Rows with new keys are added; of known keys the columns `update` (all, if None) are replaced."""
        if table not in KEYS:
            raise ConfigError("the table has no key", table=table)
        staged, touched = self.store.staged(table, rows)
        self.rewrite(table, touched, merged(self.read(table, touched), staged, list(KEYS[table]), update))

    def replace_children(self, table: str, rows: DataFrame, parent: str, also: list | None = None) -> None:
        """All rows of the parents in `rows`, and of those in `also`, go, then `rows` come: a rerun changes nothing."""
        staged, touched = self.store.staged(table, rows)
        gone = self.store.spark.createDataFrame([(value,) for value in also or []], T.StructType([TABLES[table][parent]]))
        if parent == BUCKET_BY[table]:
            touched |= self.store._buckets_of(gone)
            buckets = touched
        else:
            touched, buckets = touched | set(self.state.tables.get(table, {})), None
        self.rewrite(table, touched, replaced(self.read(table, buckets), staged, parent, gone))

    def update_from(self, table: str, rows: DataFrame, key: str, columns: list[str]) -> None:
        """UPDATE ... FROM: rows of the table with a key in `rows` get its `columns`; of several the greatest.  Only buckets with such rows are rewritten."""
        by = BUCKET_BY[table]
        if by == key:
            touched = self.store._buckets_of(rows.select(F.col(key).cast(TABLES[table][key].dataType)))
        else:
            touched = self.store._buckets_of(self.read(table).select(by, key).join(rows.select(key).distinct(), key, "left_semi").select(by))
        if touched:
            self.rewrite(table, touched, updated_from(self.read(table, touched), rows, key, columns))

    def clear(self, table: str) -> None:
        self.changes[table] = {"clear": True, "set": {}, "add": {}}

    def conflicts(self, commit: dict) -> list[str]:
        """Tables in which a commit touched what this transaction rewrites or has read."""
        out = []
        for table, theirs in commit["changes"].items():
            ours, seen = self.changes.get(table, {"clear": False, "set": {}}), self.seen.get(table, set())
            buckets = set(theirs["set"]) | set(theirs["add"])
            if ours["clear"] or (theirs["clear"] and (ours["set"] or seen is None or seen)) or (seen is None and (buckets or theirs["clear"])) or buckets & (set(ours["set"]) | (seen or set())):
                out.append(table)
        if set(commit["migrations"]) & set(self.migrations):
            out.append("_migrations")
        return out

    def commit(self) -> int:
        """The number under which the changes are visible; nothing is written if there are none."""
        if not self.changes and not self.migrations:
            return self.state.version
        number = self.state.version + 1
        while True:
            body = {"version": number, "base": self.state.version, "buckets": self.state.buckets, "changes": self.changes, "migrations": self.migrations}
            if self.store._put_new(self.store._log(number), json.dumps(body)):
                if number % CHECKPOINT == 0:
                    self.store._checkpoint(number)
                return number
            if tables := self.conflicts(self.store._commit(number)):
                raise ConflictError("another writer changed what this transaction read or rewrites", version=number, tables=tables)
            number += 1


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- files ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        fs, at = self._fs(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _put_new(self, path: str, text: str, link: bool = True) -> bool:
        """Makes a file, whole, unless there is one: by a hard link where the root is a mounted folder, else by a rename that does not overwrite."""
        fs, at = self._fs(path)
        part = f"{path}.{uuid.uuid4().hex}"
        fs.mkdirs(at.getParent())
        if link and fs.getScheme() == "file":
            own, made = (self.spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (part, path))
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, made)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        self._create(part, text)
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hadoop.Path(part)), fs.makeQualified(at), gateway.new_array(hadoop.Options.Rename, 0))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            fs.delete(hadoop.Path(part), False)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _commit(self, number: int) -> dict:
        return json.loads(self._text(self._log(number)))

    def _checkpoint(self, number: int) -> None:
        part = f"{self.root}/log/part-{uuid.uuid4().hex}"
        self._create(part, json.dumps(self.state(number).__dict__))
        fs, at = self._fs(part)
        fs.rename(at, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/state-{number:020d}.json"))

    def state(self, version: int | None = None) -> State:
        """What the log says, now or up to a number."""
        names = self._names(f"{self.root}/log")
        numbers = [int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.json", n)]
        last = version if version is not None else max(numbers, default=0)
        whole = [int(n[6:26]) for n in names if re.fullmatch(r"state-\d{20}\.json", n) and int(n[6:26]) <= last]
        state = State(**json.loads(self._text(f"{self.root}/log/state-{max(whole):020d}.json"))) if whole else State(buckets=self.buckets)
        for number in range(state.version + 1, last + 1):
            state.apply(self._commit(number))
        return state

    # --- rows -----------------------------------------------------------------------------------

    def _load(self, table: str, folders: list[str]) -> DataFrame:
        """Rows of folders, by the schema of today: columns that a folder lacks are null."""
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{f}" for f in folders])

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.state_buckets)).cast("int")

    @property
    def state_buckets(self) -> int:
        """A store keeps the number of buckets of its first commit."""
        if not hasattr(self, "_kept"):
            self._kept = self._commit(1)["buckets"] if f"{1:020d}.json" in self._names(f"{self.root}/log") else self.buckets
        return self._kept

    def _buckets_of(self, column: DataFrame) -> set[str]:
        """The buckets of a one-column frame's values: as many numbers as there are buckets, at most."""
        return {str(r[0]) for r in column.select(self._bucket(column.columns[0]).alias("b")).distinct().collect()}

    def _write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket into a folder of their own; gives the folders by bucket.  Nobody sees them before a commit names them.

        Rows are gathered by bucket, and AQE splits a bucket that has too many.
        """
        name = f"c-{uuid.uuid4().hex}"
        self._typed(table, rows).withColumn(_BUCKET, self._bucket(BUCKET_BY[table])).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{table}/{name}")
        return {n.removeprefix(f"{_BUCKET}="): [f"{name}/{n}"] for n in self._names(f"{self.root}/{table}/{name}") if n.startswith(f"{_BUCKET}=")}

    def staged(self, table: str, rows: DataFrame) -> tuple[DataFrame, set[str]]:
        """Rows, computed once, with the columns given; and the buckets of their keys."""
        path = f"{self.root}/{table}/s-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        staged = self.spark.read.schema(rows.schema).parquet(path)
        return staged, self._buckets_of(staged.select(F.col(BUCKET_BY[table]).cast(TABLES[table][BUCKET_BY[table]].dataType)))

    # --- reading and writing ------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self, self.state())

    def at(self, version: int) -> Transaction:
        """The tables as they were at a number; for reading."""
        return Transaction(self, self.state(version))

    def transact(self, work: Callable[[Transaction], object], attempts: int = 10) -> int:
        """Runs `work` on a snapshot and commits it; on a conflict again, on the newer one."""
        for attempt in range(attempts):
            tx = self.begin()
            work(tx)
            try:
                return tx.commit()
            except ConflictError:
                if attempt == attempts - 1:
                    raise
                time.sleep(0.05 * (attempt + 1))
        return 0

    def version(self, table: str) -> int | None:
        """The last commit that touched a table."""
        return self.state().touched.get(table)

    def read(self, table: str) -> DataFrame:
        return self.begin().read(table)

    def of(self, table: str, value) -> DataFrame:
        """The rows whose bucket column has a value, from its bucket alone."""
        return self.begin().of(table, value)

    def replace(self, table: str, rows: DataFrame) -> None:
        self.transact(lambda tx: tx.replace(table, rows))

    def append(self, table: str, rows: DataFrame) -> None:
        self.transact(lambda tx: tx.append(table, rows))

    def upsert(self, table: str, rows: DataFrame, update: list[str] | None = None) -> None:
        self.transact(lambda tx: tx.upsert(table, rows, update))

    def replace_children(self, table: str, rows: DataFrame, parent: str) -> None:
        self.transact(lambda tx: tx.replace_children(table, rows, parent))

    def update_from(self, table: str, rows: DataFrame, key: str, columns: list[str]) -> None:
        self.transact(lambda tx: tx.update_from(table, rows, key, columns))

    def reset(self, tables: list[str] | None = None, hard: bool = False) -> None:
        """Empties tables in one commit; `hard` deletes the whole store, its log included."""
        if hard:
            fs, at = self._fs(self.root)
            fs.delete(at, True)
            return
        self.transact(lambda tx: [tx.clear(table) for table in tables or list(tx.state.tables)])

    def prune(self, table: str, older_than: float = 3600.0) -> int:
        """Deletes folders that the newest state doesn't name and that nobody can still be writing; gives their number."""
        kept = {f.split("/")[0] for folders in self.state().tables.get(table, {}).values() for f in folders}
        fs, at = self._fs(f"{self.root}/{table}")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in kept and s.getModificationTime() <= (time.time() - older_than) * 1000] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def orphans(self, table: str, column: str, parent: str) -> DataFrame:
        """Rows whose reference names no row of the parent table, both as of one commit."""
        tx = self.begin()
        return tx.read(table).where(F.col(column).isNotNull()).join(tx.read(parent).select(F.col("id").alias(column)), column, "left_anti")


@dataclass(frozen=True)
class Migration:
    """A step that makes a table's rows anew: `sql` selects them from {rows}, the table as it is."""

    name: str
    table: str
    sql: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.table}\n{self.sql}".encode()).hexdigest()


def migrate(store: Store, steps: list[Migration]) -> tuple[list[str], list[str]]:
    """Applies the steps that the store hasn't had, in the order of their names, each in one commit with its digest.

    Gives the names applied, and those that were applied before with another text; these are warned of and not run again.
    """
    applied, changed = [], []
    for step in sorted(steps, key=lambda m: m.name):

        def work(tx: Transaction, step=step) -> None:
            if step.name not in tx.state.migrations:
                tx.replace(step.table, store.spark.sql(step.sql, rows=tx.read(step.table)))
                tx.migrations[step.name] = step.digest

        before = store.state().migrations
        if step.name not in before:
            store.transact(work)
            applied.append(step.name)
        elif before[step.name] != step.digest:
            log.warning("migration %s was changed after it was applied", step.name)
            changed.append(step.name)
    return applied, changed


def replaced(old: DataFrame, new: DataFrame, parent: str, also: DataFrame | None = None) -> DataFrame:
    """`old` without the rows of the parents in `new` (and in `also`), and `new`; columns that `new` lacks are null."""
    parents = new.select(F.col(parent).alias("_parent")).distinct()
    if also is not None:
        parents = parents.union(also.distinct())
    return old.join(parents, F.col(parent).eqNullSafe(F.col("_parent")), "left_anti").unionByName(new, allowMissingColumns=True).select(old.columns)


def updated_from(old: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`old` with `columns` of `rows` where a row's key is there, nulls included; of several rows with a key the greatest counts."""
    new = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*columns)).alias("_new"))
    both = old.join(new, F.col(key) == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def merged(old: DataFrame, new: DataFrame, key: list[str], update: list[str] | None = None) -> DataFrame:
    """The upsert of `new` into `old`, as one join.  Of new rows with one key the greatest counts."""
    others = [c for c in new.columns if c not in key]
    new = new.groupBy(*key).agg(F.max(F.struct(*others)).alias("_row")).select(*key, "_row.*") if others else new.distinct()
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), on=[F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], how="full_outer")

    def value(c: str):
        if c in key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c not in new.columns:
            return F.col(f"o.{c}")
        if update is not None and c not in update:
            return F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])


def reconciled_offers(offers: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Offers with their status, which follows from whether they were ever reconciled."""
    done = reconciliations.select(F.col("offer_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    return offers.drop("status").join(done, "id", "left").withColumn("status", F.when(F.col("_done"), "reconciled").otherwise("extracted")).drop("_done")


def to_lines(lines: DataFrame, reconciliation_id: str, precision: T.DecimalType | None = None) -> DataFrame:
    """Cascade rows as rows of reconciliation_lines."""
    return lines.select(
        F.lit(reconciliation_id).alias("reconciliation_id"), F.col("item_no").cast("string").alias("requisition_item_id"), F.col("line_no").cast("string").alias("offer_item_id"), "status",
        F.round("confidence", 2).cast(precision or "decimal(3,2)").alias("confidence"), "quantity_delta", "price_total", "reasoning", "candidates", "needs_review", "decided_by",
    )
