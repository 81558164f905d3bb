"""Table store (S5) on Parquet files under one root, and a JDBC pass-through.

Snapshots. Every write goes to a folder of its own and becomes visible by a commit (``commits``)
that may change several tables at once. A reader pins a snapshot: all its reads see the tables of
one commit, so pages of one cursor agree and a configuration load is seen whole or not at all. A
``Transaction`` remembers which tables it read and replaces; if another commit changed one of them
meanwhile its commit raises ``CommitConflict``, and ``TableStore.run`` starts the body again from
the new snapshot. Rows appended without a read never conflict.

Layout. Facts (``billing_event``, ``rate_sample``) are partitioned by UTC month of their time column
and sorted within files by (workspace, time), so ranges prune partitions and row groups. Events are
filed by the months of both their ends: a query for events that overlap a range reads the
partitions whose months reach into it, not all older history, however long a few events last.
Dimensions are small and replaced whole. The estimation state is kept in ``STATE_BUCKETS`` hash
buckets of the key: a commit appends the new rows of the keys it moved as a delta to their
buckets, and a bucket of ``FOLD`` deltas is folded when it is next written.

Uuid ledger. Each append to a fact table also appends (hash of the uuid, month) to its ledger, split
into ``LEDGER_BUCKETS`` hash buckets and sorted by hash. ``known`` finds the stored rows of a set of
uuids by reading only the buckets of these uuids and then only the months where a hash was found;
``find`` does so for one uuid. The rows found are compared by uuid, so equal hashes cost a read,
not a wrong result. A set of more uuids than there are buckets reads the whole ledger (about 6
bytes a row) but never the uuids of the facts; stores with very many rows take more buckets.

``compact`` rewrites a table's folders as one, as one more commit that lets appends pass; ``vacuum``
deletes commits older than the newest ``keep`` and the folders only they name.
"""

from __future__ import annotations

import uuid as uuidlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from meterkit import schemas
from meterkit.sources.commits import CommitConflict, CommitLog

FACT_LAYOUT = {
    "billing_event": ("event_start", ["workspace", "event_start"]),
    "rate_sample": ("sample_time", ["workspace", "sample_time"]),
}
STATE_KEYS = {"estimate_state": ["workspace", "item_id"]}
APPEND_ONLY = {"billing_event", "rate_sample", "event_quarantine", "sample_quarantine", "workspace_quarantine"}
MONTH_COL, UNTIL_COL, BUCKET_COL, SEQ_COL = "_month", "_until", "_bucket", "_seq"
END_COLUMN = {"billing_event": "event_end"}  # facts that last
KEEP_VERSIONS = 3
LEDGER_BUCKETS = 16
STATE_BUCKETS = 16
FOLD = 8
LEDGER = StructType([StructField("hash", LongType()), StructField("month", StringType()), StructField(BUCKET_COL, IntegerType())])


def ledger_of(name: str) -> str:
    return f"{name}_keys"


class Snapshot:
    """The tables of one commit."""

    def __init__(self, store: "TableStore", version: int, tables: dict):
        self.store, self.spark, self.version = store, store.spark, version
        self.tables = tables

    def _folders(self, name: str) -> list[str]:
        return self.tables.get(name, {}).get("folders", [])

    def _load(self, name: str, schema: StructType, folders: Iterable[str]) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.store.root}/{name}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)).select(*schema.fieldNames())

    def _facts(self, name: str, folders: Iterable[str]) -> DataFrame:
        parts = [StructField(c, StringType(), True) for c in _parts(name)]
        return self._load(name, StructType([*schemas.TABLES[name].fields, *parts]), folders)

    def read(self, name: str, time_from=None, time_until=None, months: list[str] | None = None, ends_after=None) -> DataFrame:
        """A table. For facts, ``time_from``/``time_until`` bound the time column (``event_start`` /
        ``sample_time``) to [from, until), ``months`` to these, and ``ends_after`` the end of an event
        to after it; all prune partitions."""
        schema = schemas.TABLES[name]
        if name in STATE_KEYS:
            return self._folded(name, self._folders(name)).select(*schema.fieldNames())
        if name not in FACT_LAYOUT:
            return self._load(name, schema, self._folders(name))
        df = self._facts(name, self._folders(name))
        tcol = F.col(FACT_LAYOUT[name][0])
        if months is not None:
            df = df.filter(F.col(MONTH_COL).isin(months)) if months else df.limit(0)
        if time_from is not None:
            lo = F.lit(time_from).cast("timestamp_ntz")
            df = df.filter((F.col(MONTH_COL) >= F.date_format(lo, "yyyy-MM")) & (tcol >= lo))
        if time_until is not None:
            hi = F.lit(time_until).cast("timestamp_ntz")
            df = df.filter((F.col(MONTH_COL) <= F.date_format(hi, "yyyy-MM")) & (tcol < hi))
        if ends_after is not None:
            end = F.lit(ends_after).cast("timestamp_ntz")
            df = df.filter((F.col(UNTIL_COL) >= F.date_format(end, "yyyy-MM")) & (F.col(END_COLUMN[name]) > end))
        return df.select(*schema.fieldNames())

    # -- state kept as deltas
    def _folded(self, name: str, folders: Iterable[str]) -> DataFrame:
        """Each key's rows of the last commit that wrote the key."""
        schema = StructType([*schemas.TABLES[name].fields, StructField(SEQ_COL, LongType()), StructField(BUCKET_COL, IntegerType())])
        newest = F.max(SEQ_COL).over(Window.partitionBy(*STATE_KEYS[name]))
        return self._load(name, schema, folders).withColumn("_newest", newest).filter(F.col(SEQ_COL) == F.col("_newest")).drop("_newest")

    def state_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The state's rows of ``keys``, read from their buckets only."""
        buckets = self._buckets(keys, STATE_KEYS[name], self.store.state_buckets)
        folders = [f for f in self._folders(name) if _bucket_of(f) in buckets]
        found = self._folded(name, folders).select(*schemas.TABLES[name].fieldNames())
        return found.join(keys.select(*STATE_KEYS[name]).distinct(), STATE_KEYS[name], "left_semi")

    @staticmethod
    def _buckets(df: DataFrame, keys: list[str], n: int) -> set[int]:
        """The buckets that the rows fall in, ``n`` at most."""
        return {r[0] for r in df.select(_bucket(keys, n)).distinct().collect()}

    # -- uuid ledger
    def _ledger(self, name: str) -> DataFrame:
        return self._load(ledger_of(name), LEDGER, self._folders(ledger_of(name)))

    def ledger_hits(self, name: str, uuids: DataFrame) -> DataFrame:
        """(uuid, month) of the ``uuids`` whose hash the ledger holds; reads their buckets only."""
        keys = uuids.select("uuid", F.xxhash64("uuid").alias("hash"), _bucket(["uuid"], self.store.ledger_buckets).alias(BUCKET_COL)).distinct()
        buckets = sorted(self._buckets(uuids, ["uuid"], self.store.ledger_buckets))
        ledger = self._ledger(name).filter(F.col(BUCKET_COL).isin(buckets))
        return ledger.join(keys, [BUCKET_COL, "hash"]).select("uuid", "month").distinct()

    def known(self, name: str, uuids: DataFrame) -> DataFrame:
        """The stored rows of ``uuids`` (a column ``uuid``), read from the months that hold them."""
        hits = self.ledger_hits(name, uuids)
        months = [r.month for r in hits.select("month").distinct().collect()]
        if not months:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.read(name, months=months).join(hits.select("uuid").distinct(), "uuid", "left_semi").select(*schemas.TABLES[name].fieldNames())

    def find(self, name: str, uuid: str) -> DataFrame:
        """The stored row of one uuid: one bucket of the ledger, then the months it names."""
        at = self.spark.sql("SELECT xxhash64(:u) AS hash", args={"u": uuid}).first().hash
        ledger = self._ledger(name).filter((F.col(BUCKET_COL) == at % self.store.ledger_buckets) & (F.col("hash") == at))
        months = [r.month for r in ledger.select("month").distinct().collect()]
        return self.read(name, months=months).filter(F.col("uuid") == uuid)


def _parts(name: str) -> list[str]:
    return [MONTH_COL, UNTIL_COL] if name in END_COLUMN else [MONTH_COL]


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _bucket_of(folder: str) -> int:
    return int(folder.rpartition(f"{BUCKET_COL}=")[2])


class Transaction(Snapshot):
    """A snapshot with writes of its own, which it sees, and a commit. ``staged`` tables live until ``close``."""

    def __init__(self, store: "TableStore", version: int, tables: dict):
        super().__init__(store, version, {n: {**t, "folders": list(t["folders"])} for n, t in tables.items()})
        self.id = uuidlib.uuid4().hex
        self.used: dict[str, int] = {}  # table read or replaced -> the version it was read at
        self.added: dict[str, list[str]] = {}
        self.gone: dict[str, list[str]] = {}
        self.done = False

    def _folders(self, name: str) -> list[str]:
        self.used.setdefault(name.removesuffix("_keys"), self.version)
        return super()._folders(name)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written under the store's root and read again; gone when the transaction ends."""
        path = f"{self.store.root}/_staging/{self.id}/{name}-{uuidlib.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, name: str, df: DataFrame, *parts: str) -> str:
        """A new folder of a table; nobody sees it before the commit."""
        folder = f"c={self.id}-{len(self.added.get(name, []))}"
        w = df.write.partitionBy(*parts) if parts else df.write
        w.parquet(f"{self.store.root}/{name}/{folder}")
        return folder

    def _change(self, name: str, added: list[str], gone: Iterable[str] = ()) -> None:
        table = self.tables.setdefault(name, {"folders": [], "changed": 0})
        gone = set(gone)
        table["folders"] = [f for f in table["folders"] if f not in gone] + added
        self.added.setdefault(name, []).extend(added)
        self.gone.setdefault(name, []).extend(gone)

    def append(self, name: str, df: DataFrame) -> None:
        """Append rows to a fact or quarantine table (callers de-duplicate first; see ``ingest``)."""
        if name not in APPEND_ONLY:
            raise ValueError(f"{name} is a dimension table; use replace()")
        df = df.select(*schemas.TABLES[name].fieldNames())
        if name not in FACT_LAYOUT:
            self._change(name, [self._write(name, df)])
            return
        tcol, sort = FACT_LAYOUT[name]
        month = {MONTH_COL: F.date_format(F.col(tcol), "yyyy-MM")}
        if name in END_COLUMN:
            month[UNTIL_COL] = F.date_format(F.col(END_COLUMN[name]), "yyyy-MM")
        rows = df.withColumns(month).sortWithinPartitions(*_parts(name), *sort)
        folder = self._write(name, rows, *_parts(name))
        if not self.store._partitions(name, folder):
            return  # no rows
        self._change(name, [folder])
        self._write_ledger(name, self._facts(name, [folder]).select(F.xxhash64("uuid").alias("hash"), F.col(MONTH_COL).alias("month"), _bucket(["uuid"], self.store.ledger_buckets).alias(BUCKET_COL)))

    def _write_ledger(self, name: str, keys: DataFrame, gone: Iterable[str] = ()) -> None:
        rows = keys.repartition(BUCKET_COL).sortWithinPartitions(BUCKET_COL, "hash")
        self._change(ledger_of(name), [self._write(ledger_of(name), rows, BUCKET_COL)], gone)

    def replace(self, name: str, df: DataFrame) -> None:
        """A dimension table's new content (``df`` may read the old one); for the state see ``write_state``."""
        if name in APPEND_ONLY:
            raise ValueError(f"{name} is append-only")
        if name in STATE_KEYS:
            self.write_state(name, df, whole=True)
            return
        self._change(name, [self._write(name, df.select(*schemas.TABLES[name].fieldNames()))], super()._folders(name))

    def write_state(self, name: str, df: DataFrame, whole: bool = False) -> None:
        """The new rows of the keys in ``df``, as a delta to their buckets (``whole``: instead of all rows)."""
        keys, n = STATE_KEYS[name], self.store.state_buckets
        rows = df.select(*schemas.TABLES[name].fieldNames(), F.lit(self.version + 1).cast("long").alias(SEQ_COL), _bucket(keys, n).alias(BUCKET_COL))
        old = self._folders(name)
        gone = list(old) if whole else []
        if not whole:
            rows = self.stage(rows, name)
            touched = {r[0] for r in rows.select(BUCKET_COL).distinct().collect()}
            held: dict[int, list[str]] = {}
            for f in old:
                held.setdefault(_bucket_of(f), []).append(f)
            for b in touched:
                gone += held.get(b, []) if len(held.get(b, [])) >= FOLD else []
            if gone:
                kept = self._folded(name, gone).join(df.select(*keys).distinct(), keys, "left_anti")
                rows = rows.unionByName(kept.select(*rows.columns))
        folder = self._write(name, rows.repartition(BUCKET_COL), BUCKET_COL)
        self._change(name, [f"{folder}/{p}" for p in self.store._partitions(name, folder)], gone)

    def commit(self) -> int:
        """Make the writes visible, all at once; raises ``CommitConflict`` if a table that was read
        or replaced has changed since, or a compacted folder is gone."""
        changed = [n for n in self.added if self.added[n] or self.gone.get(n)]
        while changed:
            number, tables = self.store.log.latest()
            for name, at in self.used.items():
                if tables.get(name, {}).get("changed", 0) > at:
                    raise CommitConflict(f"{name} was changed by commit {tables[name]['changed']}, read at {at}")
            for name in changed:
                now = tables.setdefault(name, {"folders": [], "changed": 0})
                gone = set(self.gone.get(name, ())) - set(self.added[name])
                if gone - set(now["folders"]):
                    raise CommitConflict(f"folders of {name} were replaced meanwhile")
                now["folders"] = [f for f in now["folders"] if f not in gone] + [f for f in self.added[name] if f in set(self.tables[name]["folders"])]
                now["changed"] = number + 1
            if self.store.log.put(number + 1, tables):
                self.version = number + 1
                break
        self.done = True
        return self.version

    def close(self) -> None:
        """Remove what is staged, and what was written if nothing was committed."""
        self.store._delete(f"_staging/{self.id}")
        if not self.done:
            for name, folders in self.added.items():
                for top in {f.partition("/")[0] for f in folders}:
                    self.store._delete(f"{name}/{top}")


class TableStore:
    def __init__(self, spark: SparkSession, root: str, ledger_buckets: int = LEDGER_BUCKETS, state_buckets: int = STATE_BUCKETS):
        """``ledger_buckets`` and ``state_buckets`` are those of the store's first commit if it has one."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_commits")
        kept = self.log.latest()[1].get("_store", {})
        self.ledger_buckets = kept.get("ledger_buckets", ledger_buckets)
        self.state_buckets = kept.get("state_buckets", state_buckets)
        self._seen: dict[str, int] = {}  # the commit at which this object last read or wrote a table

    # -- paths
    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p, jvm.org.apache.hadoop.fs.Path

    def _delete(self, name: str) -> None:
        fs, p, _ = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def _partitions(self, name: str, folder: str) -> list[str]:
        fs, p, _ = self._fs(f"{self.root}/{name}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if "=" in x.getPath().getName())

    # -- snapshots and transactions
    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or that of an earlier commit which ``vacuum`` has left."""
        number, tables = self.log.latest() if version is None else (version, self.log.read(version))
        return Snapshot(self, number, tables)

    def begin(self) -> Transaction:
        return Transaction(self, *self.log.latest())

    def run(self, body: Callable[[Transaction], object], attempts: int = 10):
        """``body(transaction)`` and its commit; again from the new snapshot after a conflict."""
        for left in reversed(range(attempts)):
            tx = self.begin()
            try:
                out = body(tx)
                tx.commit()
                return out
            except CommitConflict:
                if not left:
                    raise
            finally:
                tx.close()

    # -- S5: create / drop
    def create_all(self) -> None:
        number, tables = self.log.latest()
        while any(n not in tables for n in schemas.TABLES):
            added = {n: {"folders": [], "changed": number + 1} for n in schemas.TABLES if n not in tables}
            own = {"folders": [], "changed": number + 1, "ledger_buckets": self.ledger_buckets, "state_buckets": self.state_buckets}
            self.log.put(number + 1, {"_store": own} | tables | added)
            number, tables = self.log.latest()

    def drop_all(self) -> None:
        fs, p, _ = self._fs(self.root)
        fs.delete(p, True)

    def exists(self, name: str) -> bool:
        return name in self.log.latest()[1]

    # -- single reads and writes
    def read(self, name: str, time_from=None, time_until=None, **more) -> DataFrame:
        now = self.snapshot()
        self._seen[name] = now.version
        return now.read(name, time_from, time_until, **more)

    def append(self, name: str, df: DataFrame) -> None:
        self.run(lambda tx: tx.append(name, df))

    def replace(self, name: str, df: DataFrame) -> None:
        self.replace_all({name: df})

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """Replace dimension tables in one commit. A table that was changed after this object last
        read it raises ``CommitConflict``; use ``run`` to read and replace with retries."""
        tx = self.begin()
        try:
            for name, df in tables.items():
                if name in self._seen:
                    tx.used[name] = self._seen[name]
                tx.replace(name, df)
            version = tx.commit()
            self._seen.update(dict.fromkeys(tables, version))
        finally:
            tx.close()

    # -- upkeep
    def versions(self) -> list[int]:
        return self.log.numbers()

    def compact(self, name: str) -> None:
        """Rewrite a fact or quarantine table's folders, and its ledger's, as one each. Appends that
        are committed meanwhile stay; another compaction makes this one start again."""
        if name not in APPEND_ONLY:
            raise ValueError(f"{name} is replaced or folded whenever it is written")

        def body(tx: Transaction) -> None:
            old, keys = Snapshot._folders(tx, name), Snapshot._folders(tx, ledger_of(name))
            if len(old) < 2:
                return
            schema = schemas.TABLES[name]
            if name not in FACT_LAYOUT:
                tx._change(name, [tx._write(name, tx._load(name, schema, old))], old)
                return
            rows = tx._facts(name, old).repartition(*_parts(name), F.pmod(F.xxhash64("workspace"), F.lit(64)))
            tx._change(name, [tx._write(name, rows.sortWithinPartitions(*_parts(name), *FACT_LAYOUT[name][1]), *_parts(name))], old)
            tx._write_ledger(name, tx._load(ledger_of(name), LEDGER, keys), keys)

        self.run(body)

    def vacuum(self, keep: int = KEEP_VERSIONS) -> None:
        """Delete all but the newest ``keep`` commits, and the folders that only the others name.
        Folders of unfinished transactions are in no commit and are left alone."""
        numbers = self.log.numbers()
        old, left = numbers[:-keep], numbers[-keep:]
        named = lambda ns: {f"{t}/{f}" for n in ns for t, x in self.log.read(n).items() for f in x["folders"]}
        kept = named(left)
        for folder in named(old) - kept:
            self._delete(folder)
        for number in old:
            self.log.drop(number)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of an external relational store (options pass through, e.g. user,
    password, partitionColumn/lowerBound/upperBound/numPartitions for parallel reads)."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


__all__ = ["CommitConflict", "Snapshot", "TableStore", "Transaction", "read_jdbc", "write_jdbc"]
