"""Streams: idle scopes, debounced digests, latest events, deduplicated sensing, and ingestion by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import staging
from ..functions import text
from ..operators import codeindex, lifecycle

IDLE_SECONDS, DEBOUNCE_SECONDS = 1800, 3600


def idle_scopes(writes: DataFrame, scope: str = "scope", at: str = "ts", idle: int = IDLE_SECONDS, late: str = "1 hour") -> DataFrame:
    """A row for each spell of writes that was followed by so many quiet seconds: scope, first, idle_at, n_writes."""
    spells = writes.withWatermark(at, late).groupBy(scope, F.session_window(at, f"{idle} seconds")).agg(F.count("*").alias("n_writes"))
    return spells.select(scope, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("idle_at"), "n_writes")


class Claims(StatefulProcessor):
    """The last claim of a scope, until the watermark is beyond the time that it blocks: after that it could change nothing."""

    def __init__(self, scope: str, at: str, every: int):
        self.scope, self.at, self.every = scope, at, every * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for t in sorted(int(x.value // 1000) for b in rows for x in b[self.at]):
            if last is None or t - last >= self.every:
                taken.append(t)
                last = t
        if taken:
            for timer in [x[0] if isinstance(x, tuple) else x for x in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.every) // 1000))
            yield pd.DataFrame({self.scope: [key[0]] * len(taken), "claimed_at": pd.to_datetime(taken, unit="us")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def debounced(writes: DataFrame, scope: str = "scope", at: str = "ts", every: int = DEBOUNCE_SECONDS, late: str = "1 hour") -> DataFrame:
    """scope, claimed_at: the writes that may start a digest, at most one in `every` seconds a scope.

    The stream's query needs the RocksDB state store, which this sets for the session. A scope has state only while a
    claim blocks others; rows that are later than `late` are dropped, and counted in the query's progress.
    """
    writes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = writes.withWatermark(at, late).groupBy(scope)
    return own.transformWithStateInPandas(Claims(scope, at, every), f"{scope} string, claimed_at timestamp", "Append", "EventTime")


#: The store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_markers(events: DataFrame, marker: str, at: str, late: str = "1 day") -> DataFrame:
    """Each marker once, however often it arrives within the lateness."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([marker])


def windowed_counts(events: DataFrame, by: str, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    own = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("since"), by, "n")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs write(rows, batch number) on everything that is there; a batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_scopes(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """The scopes that a batch of writes marks as pending."""
    return rows.select(scope).where(F.col(scope) != "").distinct()


def consolidating(stream: DataFrame, run: Callable[[DataFrame], None], checkpoint: str, every: str | None = None):
    """Runs run(pending scopes) after each batch of writes: once for what is there, or every so often (such as "1 hour").

    A scope that is written to while it is worked on is pending again in the next batch.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, number: run(pending_scopes(rows))).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def summarising(writes: DataFrame, stored: Callable[[], DataFrame], write: Callable[[dict[str, DataFrame], int], None], checkpoint: str, as_of: Column, idle: int = IDLE_SECONDS, late: str = "1 hour", every: str | None = None, **options):
    """Summarises the old rows of the scopes that fell idle since the last batch (lifecycle.summarise_run), by a timer or once for what is there.

    stored() gives the rows as they are; write(parts, batch number) puts the summaries and what is left in their place. A
    batch that is run again has the same number.
    """

    def step(idlers: DataFrame, number: int) -> None:
        own = stored().join(idlers.select("scope").distinct(), "scope", "left_semi")
        write(lifecycle.summarise_run(own, as_of, **options), number)

    writer = idle_scopes(writes, idle=idle, late=late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def indexing(stream: DataFrame, folder: str, checkpoint: str, project: str = "default", every: str | None = None):
    """Keeps a project's code index in folder up to date with a stream of files (path, changed, text); a null text is a file that went.

    Of a path that comes more than once in a batch the last change counts. Only files whose checksum isn't the known one
    are parsed. A batch writes the new checksums, rows and facts of its files together under its number; older ones of
    these files are thereby gone (index_of), so a batch that is run again changes nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, number: index_batch(rows, number, folder, project)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: Parts of an index that lie in folders of their own, each row with its file and batch.
FILES = "path string, checksum string, batch long"


def index_batch(rows: DataFrame, number: int, folder: str, project: str = "default") -> None:
    """One batch of indexing()."""
    spark = rows.sparkSession
    last = rows.groupBy("path").agg(F.max_by(F.struct("text"), "changed").alias("last")).select("path", "last.text")
    known = known_files(spark, folder, number).select("path", F.col("checksum").alias("known"))
    new = last.withColumn("checksum", F.when(F.col("text").isNotNull(), text.source_checksum(F.col("text")))).join(known, "path", "left")
    new = staging.staged(new.where(~F.col("checksum").eqNullSafe(F.col("known"))).drop("known"), "changed")
    parts = codeindex.rows_of(new.where("text is not null").select("path", "text"), project)
    facts = parts.pop("facts").withColumn("module", F.col("subject"))
    owner = F.coalesce(F.col("metadata")["path"], F.col("metadata")["from_path"])
    indexed = reduce(DataFrame.unionByName, parts.values()).withColumn("path", owner)
    own = new.where("text is not null").select(text.path_module(F.col("path")).alias("module"), "path")
    for name, part in (("rows", indexed), ("facts", facts.join(own, "module").drop("module")), ("files", new.select("path", "checksum"))):
        part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")  # files last: only then the batch counts
    staging.unstaged(new)


def known_files(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """path, checksum (null: gone), batch: the last word on each file, of batches before a number or all."""
    try:
        found = spark.read.schema(FILES).parquet(f"{folder}/files")
    except AnalysisException:  # no batch yet
        found = spark.createDataFrame([], FILES)
    found = found if before is None else found.where(F.col("batch") < before)
    return found.groupBy("path").agg(F.max_by(F.struct("checksum"), "batch").alias("last"), F.max("batch").alias("batch")).select("path", "last.checksum", "batch")


def index_of(spark: SparkSession, folder: str, part: str = "rows") -> DataFrame:
    """The rows, or facts, that hold: those of each file's last batch, unless it went."""
    held = known_files(spark, folder).where("checksum is not null").select("path", "batch")
    return spark.read.parquet(f"{folder}/{part}").join(held, ["path", "batch"], "left_semi").drop("path", "batch")


def drained(spark: SparkSession, stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for what is there, as a table beside its checkpoint."""
    out = f"{checkpoint}/rows"

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def as_timestamps(events: DataFrame, at: Column | str = "ts") -> DataFrame:
    return events.withColumn("ts", F.col(at).cast("timestamp") if isinstance(at, str) else at)
