"""Chapters to sections and overlapping windows, and the chunk index.

Sections are cut with column functions. Windows hang on one another, as each begins a little before
the last one's end, but texts don't: all texts of a batch advance together, one window at a time,
and look up the breaks near their windows' ends in sorted lists of places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.shared import written
from corpusweave.functions.text import short_id, strip

SIZE, OVERLAP, LEAST = 700, 90, 80
PREFIX_LEAST, TITLE_LENGTH = 100, 80
BREAK_SHARE = 0.55
# Where a window may end, best first; a heading of level 2 to 4.
BREAKS = ("\n##", "\n\n", "。", "；", "\n")
HEADING = r"(?mdU)^#{2,4}\s+."
HEADING_TITLE = r"(?mdU)\A#{2,4}\s+(.+?)\s*$"
#: Characters from which a text is windowed in pieces, and those of a piece.
PIECE = 1 << 20
#: Parts two texts of a batch; no break holds it.
BETWEEN = "\0"


def sections(content: Column) -> Column:
    """Array of (title, text) by headings of level 2 to 4; what stands before the first counts if it is long, and is untitled."""
    content = F.coalesce(content, F.lit(""))
    pieces = F.split(content, HEADING.replace("^", "(?=^", 1) + ")")
    title = lambda p: F.substring(F.regexp_replace(strip(F.regexp_extract(p, HEADING_TITLE, 1)), r"(?U)\s+", " "), 1, TITLE_LENGTH)
    cut = F.transform(pieces, lambda p: F.struct(title(p).alias("title"), strip(p).alias("text"), p.rlike(r"(?U)\A#{2,4}\s+.").alias("headed")))
    kept = F.filter(cut, lambda p: p["headed"] | (F.length(p["text"]) > PREFIX_LEAST))
    whole = F.array(F.struct(F.lit("").alias("title"), content.alias("text")))
    return F.when(content.rlike(HEADING), F.transform(kept, lambda p: F.struct(F.when(p["headed"], p["title"]).otherwise("").alias("title"), p["text"].alias("text")))).otherwise(whole)


def _break_places(joined: str) -> list[np.ndarray]:
    """Where each kind of break begins in the joined texts."""
    return [np.array([m.start() for m in re.finditer(f"(?={re.escape(mark)})", joined)], np.int64) for mark in BREAKS]


def _stops(at: np.ndarray, length: np.ndarray, base: np.ndarray, places: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of the window from each place, whether text may follow); base tells where the texts begin in what places counts from."""
    end = np.minimum(length, at + size)
    open_ended = end < length
    chosen, stop, early = ~open_ended, end.copy(), size * BREAK_SHARE
    for mark, found in zip(BREAKS, places):
        if not len(found) or chosen.all():
            continue
        # the last break of this kind that lies in the window as a whole
        last = np.searchsorted(found, base + end - len(mark), side="right") - 1
        place = found[np.maximum(last, 0)] - base
        fits = ~chosen & (last >= 0) & (place - at >= early)
        stop = np.where(fits, place + len(mark), stop)
        chosen |= fits
    return stop, open_ended | (stop < length)


def window_spans(bodies: list[str], size: int = SIZE, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every window of each body, in order; a window ends after the best break in its last part."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    offsets = np.cumsum(lengths + len(BETWEEN)) - lengths - len(BETWEEN)
    places = _break_places(BETWEEN.join(bodies))
    live, at, out = np.arange(len(bodies)), np.zeros(len(bodies), np.int64), []
    while len(live):
        stop, more = _stops(at, lengths[live], offsets[live], places, size)
        out.append((live, at, stop))
        at, live = np.maximum(stop - overlap, at + 1)[more], live[more]
    if not out:
        return (np.empty(0, np.int64),) * 3
    text, start, stop = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((start, text))
    return text[order], start[order], stop[order]


def _body(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def windows(texts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[list[tuple[int, str]]]:
    """[(start, text)] of each text's windows; blank ones are left out, unless they are all of a text."""
    bodies = [_body(t) for t in texts]
    out: list[list[tuple[int, str]]] = [[] for _ in bodies]
    for k, a, b in zip(*(c.tolist() for c in window_spans(bodies, size, overlap))):
        if (piece := bodies[k][a:b].strip()) or len(bodies[k]) <= size:
            out[k].append((a, piece))
    return out


def window_udf(size: int = SIZE, overlap: int = OVERLAP):
    """text -> array of (start, text)."""

    @F.pandas_udf("array<struct<start:int,text:string>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            got = windows(batch.fillna("").tolist(), size, overlap)
            yield pd.Series([[{"start": a, "text": w} for a, w in ws] for ws in got], index=batch.index, dtype=object)

    return cut


def _following(text: str, first: int, own: int, length: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of the window, start of the next one) for each of the first `own` places of a piece; the next start is -1 after the last window.

    The piece begins at `first` of a body of `length` and goes on for a window beyond its own places.
    """
    at = np.arange(first, first + own)
    stop, more = _stops(at, np.full(own, length), np.full(own, -first), _break_places(text), size)
    return stop, np.where(more, np.maximum(stop - overlap, at + 1), -1)


def _ways_out(following: np.ndarray, first: int, size: int) -> np.ndarray:
    """For each place where the windows may come into a piece (its first `size` ones): where they leave it, -1 for never.

    Pointers to the next start are doubled until all lead out.
    """
    own = len(following)
    # places behind the piece, and the end of all windows, lead to themselves
    jump = np.concatenate((np.where(following < 0, own + size, following - first), np.arange(own, own + size + 1)))
    while (jump[: min(own, size)] < own).any():
        jump = jump[jump]
    out = jump[: min(own, size)]
    return np.where(out == own + size, -1, out + first)


def _long_windows(each: DataFrame, text: str, size: int, overlap: int, piece: int) -> DataFrame:
    """each with start and text of the windows in place of its long texts, found in pieces that tasks work on side by side.

    Where the next window begins hangs on the text near it alone, so every piece tells for each place
    where the windows may enter it where they leave it; the ways through the pieces of a text are then
    put together, and each piece cuts its windows from where they enter.
    """
    # windows end within `size`, and a break may reach a little beyond
    reach = size + max(map(len, BREAKS))
    rest = [c for c in each.columns if c != text]
    named = written(each.withColumn("__row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0), batch.column(1)):
                body = _body(t.as_py() or "")
                for k, first in enumerate(range(0, max(1, len(body)), piece)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([body[first : first + piece + reach]])], ["row", "k", "length", "text"])

    def way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, k, length, t in zip(*(c.to_pylist() for c in batch.columns)):
                _, following = _following(t, k * piece, min(piece, length - k * piece), length, size, overlap)
                ways = _ways_out(following, k * piece, size) if length else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([ways], pa.list_(pa.int64()))], ["row", "k", "ways"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ways in zip(*(c.to_pylist() for c in batch.columns)):
                at, found = 0, []
                for w in ways:
                    # a short last piece may be stepped over
                    if at < 0:
                        break
                    if at // piece == w["k"]:
                        found.append((w["k"], at))
                        at = w["ways"][at - w["k"] * piece]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.int32()), pa.array([a for _, a in found], pa.int64())], ["row", "k", "enter"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, k, length, t, at in zip(*(c.to_pylist() for c in batch.columns)):
                first, own = k * piece, min(piece, length - k * piece)
                stop, following = _following(t, first, own, length, size, overlap)
                starts, found = ([], []) if length else ([0], [""])
                while 0 <= at < first + own:
                    if (w := t[at - first : stop[at - first] - first].strip()) or length <= size:
                        starts.append(at)
                        found.append(w)
                    at = int(following[at - first])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(starts, pa.int32()), pa.array(found, pa.string())], ["row", "start", "text"])

    pieces = written(named.select("__row", text).mapInArrow(cut, "row bigint, k int, length bigint, text string").repartition(F.col("row"), F.col("k")))
    ways = pieces.mapInArrow(way, "row bigint, k int, ways array<bigint>")
    # `size` numbers a piece
    lists = ways.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ways"))).alias("ways"))
    enters = lists.mapInArrow(entered, "row bigint, k int, enter bigint")
    found = pieces.join(enters, ["row", "k"]).select("row", "k", "length", "text", "enter").mapInArrow(windows_of, "row bigint, start int, text string")
    return found.join(named.select(*rest, F.col("__row").alias("row")), "row").select(*rest, "start", "text")


def chunk_windows(chapters: DataFrame, size: int = SIZE, overlap: int = OVERLAP, piece: int = PIECE) -> DataFrame:
    """chapters with section_title, start and text in place of content; chapters over `piece` characters are windowed in pieces of so many."""
    if not 0 <= overlap or piece <= size:
        raise ValueError("a piece must be longer than a window")
    rest = [c for c in chapters.columns if c != "content"]
    huge = F.coalesce(F.length("content") > piece, F.lit(False))
    cut = lambda rows: rows.select(*rest, F.explode(sections(F.col("content"))).alias("s")).select(*rest, F.col("s.title").alias("section_title"), F.col("s.text").alias("body"))
    each = cut(chapters.filter(~huge)).select(*rest, "section_title", window_udf(size, overlap)("body").alias("w"))
    short = each.select(*rest, "section_title", F.explode("w").alias("w")).select(*rest, "section_title", "w.*")
    long = chapters.filter(huge)
    if long.isEmpty():
        return short
    parts = written(cut(long))
    of_long = parts.filter(F.length("body") <= piece).select(*rest, "section_title", F.explode(window_udf(size, overlap)("body")).alias("w")).select(*rest, "section_title", "w.*")
    return short.unionByName(of_long).unionByName(_long_windows(parts.filter(F.length("body") > piece), "body", size, overlap, piece))


def chunk_table(chapters: DataFrame, textbooks: DataFrame, wanted: list[str] | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of finished (and wanted) textbooks, windows of fewer than 80 characters left out."""
    books = textbooks.filter(F.col("parse_status") == "done").select("textbook_id", F.col("title").alias("textbook_title"))
    if wanted:
        books = books.filter(F.col("textbook_id").isin(*wanted))
    rows = chunk_windows(chapters.join(books, "textbook_id"), size, overlap).filter(F.length("text") >= LEAST)
    payload = F.concat_ws(":", "textbook_id", "chapter_id", "section_title", "start", F.substring("text", 1, 40))
    return rows.select(
        short_id(F.lit("chunk_"), payload, 12).alias("chunk_id"), "textbook_id", "textbook_title", "chapter_id", F.col("title").alias("chapter_title"), "section_title", "start", "page_start", "page_end", "text", F.length("text").alias("char_count")
    )


def build_index(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """chunks with embedding where vectors (chunk_id, embedding) have one; without vectors all are lexical."""
    if vectors is None:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")


def index_status(index: DataFrame) -> DataFrame:
    """One row: chunks, embedded, textbooks, status."""
    n = index.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.countDistinct("textbook_id").alias("textbooks"))
    return n.withColumn("status", F.when(F.col("chunks") > 0, "ready").otherwise("empty"))


def write_index(chunks: DataFrame, path: str, encoded: Callable[[DataFrame], DataFrame] | None = None, encoder: str = "") -> DataFrame:
    """Replaces the index at path (index, meta) with chunks and their vectors, and gives its one row of metadata.

    encoded turns chunks into chunks with an embedding. Where it is missing or fails, the index is
    written without vectors and the reason goes into the metadata, so lexical search still works.
    """
    error = None
    try:
        if encoded is None:
            raise ValueError("no encoder")
        build_index(chunks, encoded(chunks)).write.mode("overwrite").parquet(f"{path}/index")
    except Exception as e:  # noqa: BLE001  whatever an encoder raises
        error = str(e).strip().splitlines()[0][:200] if str(e).strip() else type(e).__name__
        build_index(chunks).write.mode("overwrite").parquet(f"{path}/index")
    index = chunks.sparkSession.read.parquet(f"{path}/index")
    width = F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")
    meta = index_status(index).crossJoin(index.agg(width)).withColumns({"encoder": F.lit(encoder if error is None else ""), "error": F.lit(error).cast("string"), "built_at": F.current_timestamp()})  # one row each
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return chunks.sparkSession.read.parquet(f"{path}/meta")
