"""Structured Streaming ingest.

Each stream is ``readStream`` of text messages → a ``foreachBatch`` body that runs the same
set-based operators as the batch queries against the table store and appends the result.
Every body is idempotent (uuid anti-joins; estimate ids are deterministic), so Spark's
at-least-once replay after a failure appends nothing twice. Checkpoints live in the shared
folder named by ``spark.checkpoint.dir``.

Finality (R4): the reference closes an hour window for a (workspace, SKU) when a sample of
that key at or past the window end arrives. A watermark is global per query, so it cannot
express this; instead each micro-batch estimates, per key present in the batch, up to the
start of the hour of that key's latest sample in the batch. Results equal the reference
when the samples of a key arrive in time order (the batch contract); late samples are
stored but closed windows are not re-estimated (R5), which ``estimate_drift`` audits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit import schemas
from meterkit.functions import HOUR_US, floor_div, from_us, to_us
from meterkit.operators import ingest, timeseries
from meterkit.session import scratch_path
from meterkit.sources.tables import Snapshot, TableStore, Transaction

KEYS = ["workspace", "item_id"]


def read_message_stream(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    """Message stream from files (JSON lines by default). Messages carry ``ingest_seq``
    (producer position); without it they are ordered by the file's modification time, its path,
    then the byte offset of the file block that held them (the rows of one block keep no order of
    their own, so producers should number messages). ``ingest_at`` holds that position for
    ``first_wins``; ``ingest_seq`` alone names a message and does not order blocks."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    rows = reader.load(path)
    if "ingest_seq" not in rows.columns:
        return rows
    time, block = F.unix_millis(F.col("_metadata.file_modification_time")) * F.lit(1 << 20), F.col("_metadata.file_block_start")
    place = F.struct(time.alias("seq"), F.col("_metadata.file_path").alias("path"), block.alias("block"))
    numbered = F.struct(F.col("ingest_seq").alias("seq"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("block"))
    return rows.withColumns({
        "ingest_seq": F.coalesce(F.col("ingest_seq"), time + F.pmod(block, F.lit(1 << 20))),
        "ingest_at": F.when(F.col("ingest_seq").isNotNull(), numbered).otherwise(place),
    })


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, schema, **options) -> DataFrame:
    """Message stream from a Kafka-compatible broker (needs the Kafka connector on the
    classpath). ``ingest_at`` orders by broker time (milliseconds), partition and offset."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return broker_messages(raw, schema)


def broker_messages(raw: DataFrame, schema) -> DataFrame:
    """Fields, position and ``raw`` text (for the quarantine) of a broker's messages."""
    fields = [f for f in schema.fieldNames() if f != "ingest_seq"]
    value = F.col("value").cast("string")
    parsed = raw.select(F.from_json(value, schema).alias("m"), value.alias("raw"), "timestamp", "partition", "offset")
    return parsed.select(*[F.col("m")[f].alias(f) for f in fields], "raw", *_kafka_position())


def _kafka_position() -> tuple[Column, Column]:
    """``ingest_seq`` and ``ingest_at`` of a broker's message."""
    # 43 bits of milliseconds, 20 bits that tell the offsets and partitions of one millisecond apart
    seq = F.unix_millis(F.col("timestamp")) * F.lit(1 << 20) + F.pmod(F.col("offset") * F.lit(64) + F.pmod(F.col("partition"), F.lit(64)), F.lit(1 << 20))
    at = F.struct(F.unix_millis(F.col("timestamp")).alias("time"), F.col("partition"), F.col("offset"))
    return seq.alias("ingest_seq"), at.alias("ingest_at")


def dedupe_within_watermark(stream: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Cheap bounded-state pre-filter of exact re-sends by uuid. It only removes copies;
    which copy wins is decided by ``first_wins`` in the batch body."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["uuid"])


def event_arrivals(messages: DataFrame | None, items: DataFrame, stored: DataFrame, parsed: DataFrame | None = None) -> dict[str, DataFrame]:
    """R1 as a function of (state, batch): ``events`` to append, ``stubs``, ``quarantine``, and
    ``accepted``, the rows of the batch's uuids as they are kept: the stored copy of a uuid
    that arrived before, else its first valid copy in the batch. What is derived from a batch
    (resume points) follows from ``accepted`` and not from a re-sent copy; it is the same on a
    replay. ``stored`` may be the whole table or only the rows of the batch's uuids."""
    parsed = ingest.parse_event_messages(messages) if parsed is None else parsed
    known = stored.join(ingest.valid(parsed).select("uuid").distinct(), "uuid", "left_semi")
    out = ingest.ingest_events(None, items, known, parsed)
    return out | {"accepted": out["events"].unionByName(known.select(*out["events"].columns))}


def sample_arrivals(messages: DataFrame | None, items: DataFrame, stored: DataFrame, parsed: DataFrame | None = None) -> dict[str, DataFrame]:
    """R3 (storage part) as a function of (state, batch), as ``event_arrivals``; also ``seen``: the
    keys of the batch's valid messages with their latest time, which closes hours (R4)."""
    parsed = ingest.parse_sample_messages(messages) if parsed is None else parsed
    known = stored.join(ingest.valid(parsed).select("uuid").distinct(), "uuid", "left_semi")
    out = ingest.ingest_samples(None, items, known, parsed)
    every = ingest.ingest_samples(None, items, parsed=parsed)["samples"]
    seen = every.groupBy(*KEYS).agg(F.max("sample_time").alias("seen"))
    return out | {"accepted": out["samples"].unionByName(known.select(*out["samples"].columns)), "seen": seen}


def resume_moves(accepted: DataFrame) -> DataFrame:
    """The resume point that a batch of events asks for per key: its latest end."""
    return accepted.groupBy(*KEYS).agg(F.max("event_end").alias("_end"))


class _Batch:
    """A ``foreachBatch`` body: one transaction of the store, so all its tables change at once, and
    again from the new snapshot if another stream changed a table it had read."""

    def __init__(self, store: TableStore):
        self.store = store

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            self.store.run(lambda tx: self.apply(tx, batch))
        finally:
            batch.unpersist()


class EventBatch(_Batch):
    """R1 body: validate, de-duplicate (first wins, not stored yet), stub items, append.

    Each batch is checked against every stored uuid (exact, like a primary key) through the store's
    ledger: only the batch's buckets are read, and of the events only the months that hold a uuid
    of the batch."""

    def apply(self, tx: Transaction, batch: DataFrame) -> None:
        parsed = tx.stage(ingest.parse_event_messages(batch, payload=True), "parsed")
        known = tx.stage(tx.known("billing_event", ingest.valid(parsed).select("uuid").distinct()), "known")
        items = tx.read("billing_item")
        out = event_arrivals(None, items, known, parsed)
        accepted = tx.stage(out["accepted"], "accepted")
        _add_stubs(tx, items, out["stubs"])
        tx.append("billing_event", accepted.join(known.select("uuid"), "uuid", "left_anti"))
        _add_quarantine(tx, "event_quarantine", out["quarantine"])
        advance_resume(tx, accepted)


class WorkspaceBatch(_Batch):
    """R2 body: first-wins workspace → account rows; bad messages are quarantined."""

    def apply(self, tx: Transaction, batch: DataFrame) -> None:
        current = tx.read("workspace_account")
        added = tx.stage(ingest.workspace_map(batch, current), "added")
        if not added.isEmpty():
            tx.replace("workspace_account", current.unionByName(added))
        _add_quarantine(tx, "workspace_quarantine", ingest.workspace_quarantine(batch, payload=True))


class SampleBatch(_Batch):
    """R3 body: store new samples, then estimate the closed hours of the keys in the batch.

    Estimation reads only the batch's accepted samples and the ``estimate_state`` rows of the
    batch's keys (resume point and pending samples), never the sample or event history. A
    store with history but no state is bootstrapped once with ``rebuild_estimate_state``."""

    def apply(self, tx: Transaction, batch: DataFrame) -> None:
        parsed = tx.stage(ingest.parse_sample_messages(batch, payload=True), "parsed")
        known = tx.stage(tx.known("rate_sample", ingest.valid(parsed).select("uuid").distinct()), "known")
        items = tx.read("billing_item")
        out = sample_arrivals(None, items, known, parsed)
        accepted, seen = tx.stage(out["accepted"], "accepted"), tx.stage(out["seen"], "seen")
        _add_stubs(tx, items, out["stubs"])
        tx.append("rate_sample", accepted.join(known.select("uuid"), "uuid", "left_anti"))
        _add_quarantine(tx, "sample_quarantine", out["quarantine"])
        estimate_batch(tx, accepted, seen)


def estimate_batch(tx: Transaction, batch_samples: DataFrame, seen: DataFrame) -> None:
    """T6 + T4 for the keys of one micro-batch, from the estimation state.

    ``batch_samples`` are the batch's samples as stored, ``seen`` (keys, ``seen``) the latest
    time of a valid message per key: ``upto`` is its hour (R4), also where the message is a
    re-sent copy whose values are not used. Windows run from
    the key's resume point (its latest event end, else the hour of its first sample). New
    estimates are appended unless their id is stored already, and the state rows of the batch's keys
    move on in the same commit; so a replay adds nothing."""
    bs = batch_samples.select(*KEYS, "uuid", "sample_time", "rate")
    upto = seen.select(*KEYS, from_us(floor_div(to_us(F.col("seen")), HOUR_US) * F.lit(HOUR_US)).alias("upto"))
    keys = upto.select(*KEYS)
    mine = tx.state_of("estimate_state", keys)
    resume_old = mine.filter(F.col("resume_at").isNotNull()).select(*KEYS, "resume_at")
    pending = mine.filter(F.col("uuid").isNotNull()).select(*KEYS, "uuid", "sample_time", "rate")
    cand = tx.stage(pending.unionByName(bs.join(pending.select("uuid"), "uuid", "left_anti")), "candidates")
    first = cand.groupBy(*KEYS).agg(F.min("sample_time").alias("_first"))
    resume = first.join(resume_old, KEYS, "left").select(
        *KEYS,
        F.coalesce(
            F.col("resume_at"), from_us(floor_div(to_us(F.col("_first")), HOUR_US) * F.lit(HOUR_US))
        ).alias("resume_at"),
    )
    est = timeseries.hourly_estimates(cand, tx.read("billing_item"), resume=resume, upto=upto)
    est = tx.stage(
        est.select("uuid", "event_start", "event_end", "item_id", F.lit(None).cast("string").alias("user"), "workspace", "quantity"), "estimates"
    )
    if not est.isEmpty():
        tx.append("billing_event", est.join(tx.known("billing_event", est.select("uuid")).select("uuid"), "uuid", "left_anti"))
    ends = est.groupBy(*KEYS).agg(F.max("event_end").alias("_end"))
    new_resume = ends.join(resume_old, KEYS, "full_outer").select(
        *KEYS, F.greatest(F.col("_end"), F.col("resume_at")).alias("resume_at")
    )
    tx.write_state("estimate_state", state_rows(new_resume, pending_after(cand, new_resume)))


def pending_after(samples: DataFrame, resume: DataFrame) -> DataFrame:
    """Samples still needed per key: from the last one at or before the resume point onward
    (all of them when the key has no resume point yet)."""
    s = samples.join(resume, KEYS, "left")
    cut = s.filter(F.col("sample_time") <= F.col("resume_at")).groupBy(*KEYS).agg(F.max("sample_time").alias("_cut"))
    return (
        s.join(cut, KEYS, "left")
        .filter(F.col("_cut").isNull() | (F.col("sample_time") >= F.col("_cut")))
        .select(*KEYS, "uuid", "sample_time", "rate")
    )


def state_rows(resume: DataFrame, pending: DataFrame) -> DataFrame:
    r = resume.filter(F.col("resume_at").isNotNull()).select(
        *KEYS, "resume_at", F.lit(None).cast("string").alias("uuid"),
        F.lit(None).cast("timestamp_ntz").alias("sample_time"), F.lit(None).cast("double").alias("rate"),
    )
    p = pending.select(*KEYS, F.lit(None).cast("timestamp_ntz").alias("resume_at"), "uuid", "sample_time", "rate")
    return r.unionByName(p)


def rebuild_estimate_state(store: TableStore) -> None:
    """Bootstrap (or repair) the estimation state from the stored history in one pass."""

    def body(tx: Transaction) -> None:
        resume = tx.read("billing_event").groupBy(*KEYS).agg(F.max("event_end").alias("resume_at"))
        samples = tx.read("rate_sample").select(*KEYS, "uuid", "sample_time", "rate")
        tx.replace("estimate_state", state_rows(resume, pending_after(samples, resume)))

    store.run(body)


def advance_resume(tx: Transaction, events: DataFrame) -> None:
    """A directly reported event moves its key's resume point (T6: any event counts)."""
    ends = tx.stage(resume_moves(events), "ends")
    if ends.isEmpty():
        return
    mine = tx.state_of("estimate_state", ends)
    old = mine.filter(F.col("resume_at").isNotNull()).select(*KEYS, "resume_at")
    moved = ends.join(old, KEYS, "left").select(*KEYS, F.greatest(F.col("_end"), F.col("resume_at")).alias("resume_at"))
    pending = mine.filter(F.col("uuid").isNotNull()).select(*KEYS, "uuid", "sample_time", "rate")
    tx.write_state("estimate_state", state_rows(moved, pending))


def _add_stubs(tx: Transaction, items: DataFrame, stubs: DataFrame) -> None:
    stubs = tx.stage(stubs.select(*schemas.BILLING_ITEM.fieldNames()), "stubs")
    if not stubs.isEmpty():
        tx.replace("billing_item", items.unionByName(stubs))


def _add_quarantine(tx: Transaction, table: str, rejected: DataFrame) -> None:
    """Rejected messages not quarantined yet, named by the digest of their payload and their position
    (NULL is a value like any other), so a replay adds none."""
    rejected = tx.stage(rejected.distinct(), "rejected")
    if rejected.isEmpty():
        return
    old = tx.read(table)
    same = [F.col("r.digest") == F.col("q.digest"), F.col("r.ingest_seq").eqNullSafe(F.col("q.ingest_seq")), F.col("r.reason") == F.col("q.reason")]
    tx.append(table, rejected.alias("r").join(old.alias("q"), same, "left_anti"))


def letters(quarantined: DataFrame, schema) -> DataFrame:
    """The messages of quarantined rows, read back from their payload, with ``reason`` and ``digest``."""
    return quarantined.select("reason", "digest", F.from_json("payload", schema).alias("m")).select("m.*", "reason", "digest")


def dead_letters(store: TableStore | Snapshot, table: str, schema) -> DataFrame:
    """The messages of a quarantine table. Corrected rows go through the same body again
    (``EventBatch(store)(corrected, epoch)``): the uuid ledger bills a row once however often it is sent."""
    return letters(store.read(table), schema)


def start_event_ingest(spark: SparkSession, store: TableStore, source: DataFrame, name: str = "events", trigger=None):
    """Start R1: ``source`` is a message stream (see ``read_message_stream``)."""
    w = source.writeStream.foreachBatch(EventBatch(store)).option(
        "checkpointLocation", scratch_path(spark, f"stream-{name}")
    )
    w = w.trigger(**(trigger or {"processingTime": "30 seconds"}))
    return w.start()


def start_sample_ingest(spark: SparkSession, store: TableStore, source: DataFrame, name: str = "samples", trigger=None):
    """Start R3 (samples and hourly estimates)."""
    w = source.writeStream.foreachBatch(SampleBatch(store)).option(
        "checkpointLocation", scratch_path(spark, f"stream-{name}")
    )
    w = w.trigger(**(trigger or {"processingTime": "30 seconds"}))
    return w.start()


def start_workspace_ingest(spark: SparkSession, store: TableStore, source: DataFrame, name: str = "workspaces", trigger=None):
    """Start R2."""
    w = source.writeStream.foreachBatch(WorkspaceBatch(store)).option(
        "checkpointLocation", scratch_path(spark, f"stream-{name}")
    )
    w = w.trigger(**(trigger or {"processingTime": "30 seconds"}))
    return w.start()


def validated_stream(source: DataFrame) -> DataFrame:
    """Parse and validate an event-message stream with built-in operators only; suitable for
    a plain file sink."""
    return ingest.valid(ingest.parse_event_messages(source)).drop("ingest_at")
