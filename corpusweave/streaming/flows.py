"""The flows that run continuously: ingest, progress, feedback, clicks.

Each takes a streaming DataFrame and keeps a table in a folder that readers can open at any time.
What a batch makes is written to a folder of the batch's number, and the number to a list of those
that are done, last of all: readers see a batch whole or not at all, and one that runs again after a
failure writes the same again. Ingest adds to logs, of which readers see each textbook's last version.
Progress and feedback keep their state by key in a state store (RocksDB); a batch gives out changed keys only,
and every COMPACT batches the log of changes becomes a snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusweave.functions.shared import delete_folder
from corpusweave.functions.text import strip
from corpusweave.operators.chunk import chunk_table
from corpusweave.operators.converse import KEEP_NOTE, SPLIT_NOTE, message_turns
from corpusweave.operators.extract import candidate_terms, known_terms
from corpusweave.operators.integrate import DIALOGUE, decision_listing
from corpusweave.operators.segment import format_gate, heading_chapters
from corpusweave.sources.readers import titled

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches of changes after which they are drawn together.
COMPACT = 16
#: Parts of a textbook's progress, so that no task has all of a large one.
PARTS = 16


def _start(rows: DataFrame, path: str, mode: str, each: Callable[[DataFrame, int], None], once: bool, name: str = "_checkpoint") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/{name}")
    conf, key = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)  # taken over by the query when it starts
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.set(key, before)


def _done(spark: SparkSession, path: str, n: int) -> None:
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/batch={n}")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(n) of the batches that are done."""
    return spark.read.schema("n long").parquet(f"{path}/done").select("n").distinct()


def _change(rows: DataFrame, path: str, n: int, keys: list[str]) -> None:
    """Adds a batch of changed keys; every COMPACT batches a snapshot takes the place of what came before the last one."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
    _done(spark, path, n)
    if n % COMPACT == COMPACT - 1:
        latest(spark, path, keys, n).write.mode("overwrite").parquet(f"{path}/snapshots/batch={n}")
        _done(spark, f"{path}/snapshots", n)
        for old in range(n - 2 * COMPACT + 1, n - COMPACT + 1):  # a reader may still be at the last snapshot
            if old >= 0:
                delete_folder(spark, f"{path}/changes/batch={old}")
        if n >= 2 * COMPACT:
            delete_folder(spark, f"{path}/snapshots/batch={n - 2 * COMPACT}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def latest(spark: SparkSession, path: str, keys: list[str] | None = None, upto: int | None = None) -> DataFrame:
    """Each key's last row in the batches that are done (up to a given one)."""
    keys = keys or spark.read.parquet(f"{path}/keys").first()["keys"]
    last = upto if upto is not None else _numbers(spark, path).agg(F.max("n")).first()[0]
    begin, rows = -1, None
    if _exists(spark, f"{path}/snapshots/done"):
        begin = _numbers(spark, f"{path}/snapshots").filter(F.col("n") <= last).agg(F.max("n")).first()[0]
        begin = -1 if begin is None else begin
    if begin >= 0:
        rows = spark.read.parquet(f"{path}/snapshots/batch={begin}").withColumn("batch", F.lit(begin))
    if last > begin:
        # a folder a batch, COMPACT of them or a few more
        changes = spark.read.option("basePath", f"{path}/changes").parquet(*(f"{path}/changes/batch={n}" for n in range(begin + 1, last + 1)))
        rows = changes if rows is None else rows.unionByName(changes)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _keyed(rows: DataFrame, path: str, keys: list[str], once: bool) -> StreamingQuery:
    """Starts the log of changes of rows by keys."""
    rows.sparkSession.createDataFrame([(keys,)], "keys array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/keys")
    return _start(rows, path, "update", lambda batch, n: _change(batch, path, n, keys), once)


def ingest(files: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Textbooks, chapters and chunks of arriving files (filename, content, modified), for ingested().

    A file's textbook is named by its filename. A file that comes again replaces what was made of it
    before; of several in one batch the last modified counts. Files of an unknown format, and those
    without text, give a textbook that failed, with the reason, and without chapters.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        read = lambda name: spark.read.parquet(f"{path}/{name}/batch={n}")
        add = lambda rows, name: rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        last = batch.groupBy("filename").agg(F.max(F.struct("modified", F.coalesce("content", F.lit("")).alias("content"))).alias("f"))
        books = format_gate(titled(last.select("filename", "f.content"))).withColumnRenamed("doc_id", "textbook_id")
        rejected, blank = F.col("status") == "rejected", F.length(strip(F.col("content"))) == 0
        judged = books.select("textbook_id", "title", "filename", F.length("content").alias("total_chars"), F.when(rejected | blank, "failed").otherwise("done").alias("parse_status"), F.when(rejected, F.col("reason")).when(blank, "no text").alias("error_message"), "content")
        add(judged, "files")
        done = read("files").filter("parse_status = 'done'")
        chapters = heading_chapters(done.select(F.col("textbook_id").alias("doc_id"), "content")).withColumnRenamed("doc_id", "textbook_id")
        add(chapters.withColumns({"page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")}), "chapters")
        add(chunk_table(read("chapters"), read("files").drop("content")), "chunks")
        # readers go by the textbooks of batches that are done, so a new version shows when all of it is there
        add(read("files").drop("content"), "textbooks")
        _done(spark, path, n)
        delete_folder(spark, f"{path}/files/batch={n}")

    return _start(files, path, "append", each, once)


def ingested(spark: SparkSession, path: str, table: str) -> DataFrame:
    """textbooks in their last version, or the chapters or chunks of that version; only batches that are done count."""
    done = _numbers(spark, path).select(F.col("n").alias("batch"))
    books = spark.read.parquet(f"{path}/textbooks").join(F.broadcast(done), "batch", "left_semi")  # a number a batch
    last = books.groupBy("textbook_id").agg(F.max("batch").alias("batch"))
    rows = books if table == "textbooks" else spark.read.parquet(f"{path}/{table}")
    return rows.join(last, ["textbook_id", "batch"], "left_semi").drop("batch")


class ChapterCounts(StatefulProcessor):
    """Per part of a textbook: the nodes of each chapter, the last time that it came, and their sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chapters = handle.getMapState("chapters", "chapter_id string", "n bigint")
        self.sums = handle.getValueState("sums", "done bigint, nodes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, nodes = self.sums.get() if self.sums.exists() else (0, 0)
        for part in rows:
            for chapter, n in zip(part["chapter_id"].tolist(), part["n"].tolist()):
                before = self.chapters.getValue((chapter,)) if self.chapters.containsKey((chapter,)) else None
                done, nodes = done + (before is None), nodes + n - (before[0] if before else 0)
                self.chapters.updateValue((chapter,), (n,))
        self.sums.update((done, nodes))
        yield pd.DataFrame({"textbook_id": [key[0]], "part": [key[1]], "done": [done], "nodes": [nodes]})

    def close(self) -> None:
        pass


def progress(chapters: DataFrame, dictionary: list[str] | DataFrame, path: str, most: int = 10, once: bool = True) -> StreamingQuery:
    """The progress of each textbook over chapters (textbook_id, chapter_id, title, content) as they arrive, for progressed().

    A chapter that comes again counts once, with the nodes that it has then.
    """
    known = dictionary
    if isinstance(dictionary, DataFrame):
        chapters, known = known_terms(chapters, dictionary, "known"), F.col("known")
    n = F.least(F.size(candidate_terms(F.col("title"), F.col("content"), known)), F.lit(most))
    counts = chapters.select("textbook_id", F.pmod(F.xxhash64("chapter_id"), F.lit(PARTS)).cast("int").alias("part"), F.col("chapter_id").cast("string").alias("chapter_id"), n.cast("long").alias("n"))
    rows = counts.groupBy("textbook_id", "part").transformWithStateInPandas(ChapterCounts(), "textbook_id string, part int, done bigint, nodes bigint", "update", "none")
    return _keyed(rows, path, ["textbook_id", "part"], once)


def progressed(spark: SparkSession, path: str) -> DataFrame:
    """(textbook_id, done, nodes) after the last batch."""
    return latest(spark, path).groupBy("textbook_id").agg(F.sum("done").alias("done"), F.sum("nodes").alias("nodes"))


class Notes(StatefulProcessor):
    """Per decision: what teachers have said of it, and which messages said it, for as long as one may come again."""

    def __init__(self, late_ms: int | None):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "message string", "ts_ms bigint")
        self.notes = handle.getValueState("notes", "notes string, messages bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        notes, n = self.notes.get() if self.notes.exists() else ("", 0)
        # one batch's messages on a decision, in their order
        said = pd.concat(list(rows)).sort_values(["session_id", "id"])
        before = n
        for session, number, intent, ts in zip(said["session_id"], said["id"], said["intent"], said["ts_ms"]):
            message = f"{session} {number}"
            if not self.seen.containsKey((message,)):
                self.seen.updateValue((message,), (int(ts),))
                notes, n = notes + (SPLIT_NOTE if intent == "split" else KEEP_NOTE), n + 1
                if self.late_ms is not None:
                    self.handle.registerTimer(int(ts) + self.late_ms)
        if n > before:
            self.notes.update((notes, n))
            yield pd.DataFrame({"decision_id": [key[0]], "notes": [notes], "messages": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets the messages that can't come again."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.late_ms
        for message, (ts,) in list(self.seen.iterator()):
            if ts <= until:
                self.seen.removeKey(message)
        return iter(())

    def close(self) -> None:
        pass


def feedback(messages: DataFrame, decisions: DataFrame, path: str, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Feedback of arriving messages (decision_id, session_id, id, intent keep or split, optionally ts) on decisions, for decided().

    A message that comes again says nothing new; where messages have a time, they are remembered for
    `late` after it, else for good. Within a batch messages count in the order of session and id,
    batches in that of their arrival. A decision keeps its state under its id, so that a batch touches
    no others.
    """
    if not _exists(decisions.sparkSession, f"{path}/decisions"):
        decisions.write.mode("overwrite").parquet(f"{path}/decisions")
    said = messages.filter(F.col("intent").isin("keep", "split") & F.col("decision_id").isNotNull())
    timed = "ts" in messages.columns
    ms = F.unix_millis("ts") if timed else F.lit(0).cast("long")
    rows = said.withWatermark("ts", late) if timed else said
    rows = rows.select("decision_id", "session_id", "id", "intent", ms.alias("ts_ms"), *(["ts"] if timed else []))
    late_ms = int(decisions.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {late})").first()[0]) if timed else None
    notes = rows.groupBy("decision_id").transformWithStateInPandas(Notes(late_ms), "decision_id string, notes string, messages bigint", "update", "eventTime" if timed else "none")
    return _keyed(notes, path, ["decision_id"], once)


def decided(spark: SparkSession, path: str) -> DataFrame:
    """The decisions with all feedback so far: each one spoken of becomes keep at 0.96 and its reason gets the notes."""
    decisions = spark.read.parquet(f"{path}/decisions")
    rows = decisions.join(latest(spark, path).select("decision_id", "notes"), "decision_id", "left")
    hit = F.col("notes").isNotNull()
    kept: dict[str, Column] = {"action": F.when(hit, "keep").otherwise(F.col("action")), "reason": F.concat("reason", F.coalesce("notes", F.lit(""))), "confidence": F.when(hit, DIALOGUE).otherwise(F.col("confidence"))}
    return rows.withColumns(kept).select(decisions.columns)


def turns(messages: DataFrame, decisions: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """The whole way from raw messages (session_id, id, content) to decisions, for decided(): what a message
    wants and which decision it means is found batch by batch, against the decisions (decision_id,
    action, reason, confidence) as they were at the start; what it says goes to feedback().

    The first of two queries writes what it has found to a log that the second one reads; the second
    is given back. With once=True it starts when the first has ended.
    """
    spark = decisions.sparkSession
    if not _exists(spark, f"{path}/listing"):
        decision_listing(decisions).withColumn("haystack", F.col("reason")).write.parquet(f"{path}/listing")
    listing, silent = spark.read.parquet(f"{path}/listing"), spark.createDataFrame([], "reply string")
    kinds = [messages.schema["session_id"], messages.schema["id"]]
    schema = f"{kinds[0].name} {kinds[0].dataType.simpleString()}, {kinds[1].name} {kinds[1].dataType.simpleString()}, intent string, decision_id string"

    def each(batch: DataFrame, n: int) -> None:
        found = message_turns(batch, listing, silent).filter(F.col("intent").isin("keep", "split"))
        found.select("session_id", "id", "intent", "decision_id").write.mode("overwrite").parquet(f"{path}/meant/{n}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/meant/none")
    first = _start(messages, path, "append", each, once, "_meant")
    if once:
        first.awaitTermination()
    meant = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/meant")
    return feedback(meant, decisions, path, once=once)


def clicks(events: DataFrame, path: str, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Running (id, clicks) of events (event_id, ts, id); an event that comes again within `late` counts once, whatever its time."""
    counts = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy("id").agg(F.count("*").alias("clicks"))
    return _keyed(counts, path, ["id"], once)
