"""Byte-wise substring dedup with suffix arrays, one per shard.

A passage of `window` bytes that starts at two places is found without comparing documents:

1. Every window has an anchor, the first of its runs of `gram` bytes with the least hash. The anchor with
   half of the window's other bytes, taken on the side where the window has more, is its key. Neighbouring
   windows with one anchor and key are a segment. Equal windows have equal keys and lie alike around
   their anchors, so only segments whose key stands at two places go on, equal ones as one entry with a weight.
2. Shards gather whole keys. A shard's segments, cut into blocks of `BLOCK` bytes counted from their
   anchors, are one sequence of symbols, whose suffixes are sorted by grouping in linear time
   (`suffix_array`). Suffixes that agree on what a window has after its first block border are
   neighbours then; where their bytes before the border agree too, the windows are equal, and those of
   a weight of two or more are reported.
3. A key with very many different segments (text that stands everywhere) has its windows keyed by all of
   their bytes instead, so they are dealt out over the shards.

Keys and digests (64 bits each, together) choose what meets; within a shard bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import scratch, slices, texts_of, written
from corpusweave.llm.passages import INTERVALS, _ARROW_INTERVALS, _intervals, _keyed, _mixed, _repeats_rows, _with_texts, run_hashes

WINDOW, GRAM, BLOCK = 200, 16, 16
SHARD_SEGMENTS = 4096
#: Bytes of text that are hashed at once, and bits of a place in them beside those of a hash.
PIECE, PLACE_BITS = 1 << 20, 24
#: Segments of a text that are cut into their windows at once.
SOME = 1024


def suffix_array(text: list[int]) -> list[int]:
    """Places of the suffixes of text in ascending order; the last symbol must be the only 0.

    Suffixes are first grouped by their first symbol. The groups are taken in descending order: each
    suffix of a group finds the nearest suffix before it that is in a lower group, by way of the
    pointers found so far. The suffixes pointed at move up, out of their group into one right above it,
    the higher the more pointers they got. In the end a group holds the suffixes with one longest
    Lyndon prefix. Then the order within groups is emitted upwards: behind each suffix that has its
    place, the one before it and all on that one's chain of pointers take the next places of their groups.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable").tolist()
    # a group is named by its first place; it lies in [name, ends[name])
    group, ends, begins, members = [0] * n, [0] * (n + 1), [0] * (n + 1), {}
    at = 0
    while at < n:
        end, symbol = at + 1, text[order[at]]
        while end < n and text[order[end]] == symbol:
            end += 1
        members[at] = order[at:end]
        for i in members[at]:
            group[i] = at
        ends[at], begins[end], at = end, at, end
    before, high = [-1] * n, n
    while high > 0:
        own = begins[high]
        targets = []
        # members stand in the order of the text, so earlier ones have their pointers
        for i in members.pop(own):
            if group[i] == own:
                p = i - 1
                while p >= 0 and group[p] >= own:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    targets.append(p)
        if len(targets) < 2:
            moves = [(group[p], targets) for p in targets]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, times in Counter(targets).items():
                parts.setdefault((-times, group[p]), []).append(p)
            moves = [(g, sorted(ps)) for (_, g), ps in sorted(parts.items())]
        for g, ps in moves:
            end = ends[g]
            first = end - len(ps)
            if first > g:
                members[first] = ps
                for p in ps:
                    group[p] = first
                ends[g], ends[first], begins[first], begins[end] = first, end, g, first
        high = own
    out, free = [-1] * n, list(range(n))
    out[0], placed = n - 1, bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = before[i]
    return out


def repeated_windows(rows: list[tuple[bytes, int, int, int]], window: int, block: int = BLOCK) -> list[list[dict]]:
    """rows: (text, windows, front, weight) of one shard's segments; front is how many bytes a text lacks to its first block border. Runs of repeated windows of each."""
    padded = [bytes(front) + text + bytes(-(front + len(text)) % block) for text, _, front, _ in rows]
    sizes = np.array([len(p) // block for p in padded], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    # one block of zeros follows each text; its symbol is of its own
    flat = np.frombuffer(b"".join(p + bytes(block) for p in padded), f"S{block}")
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 2
    codes[starts + sizes] = 1
    suffixes = np.array(suffix_array([*codes.tolist(), 0]), np.int64)[1:]
    # bytes that neighbours have in common, as far as a window goes
    raw = np.frombuffer(b"".join(p + bytes(block) for p in padded), np.uint8).reshape(-1, block)
    most = window // block + 1
    wide = np.concatenate((codes, -np.arange(1, most + 2)))
    a, b = suffixes[:-1], suffixes[1:]
    common, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(most):
        same = wide[a[live] + k] == wide[b[live] + k]
        ended = live[~same]
        inside = ended[(a[ended] + k < len(codes)) & (b[ended] + k < len(codes))]
        differ = raw[a[inside] + k] != raw[b[inside] + k]
        common[ended] = k * block
        common[inside] += np.where(differ.any(1), differ.argmax(1), block)
        live = live[same]
    common[live] = most * block
    # places of windows: border of a block, and bytes before it
    counts = np.array([r[1] for r in rows], np.int64)
    fronts, weights = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + fronts[owner]
    border, lead = -(-first // block), -first % block
    place = np.empty(len(codes), np.int64)
    place[suffixes] = np.arange(len(suffixes))
    hits = np.zeros(len(owner), bool)
    for p in range(block):
        some = np.flatnonzero(lead == p)
        if not len(some):
            continue
        suffix = starts[owner[some]] + border[some]
        classes = np.concatenate(([0], np.cumsum(common < window - p)))[place[suffix]]
        keys = np.column_stack((classes, np.zeros(len(some), np.int64))) if not p else np.column_stack((classes, np.unique(raw[suffix - 1, block - p :].copy().view(f"S{p}").ravel(), return_inverse=True)[1]))
        kind = np.unique(keys[:, 0] * (int(keys[:, 1].max()) + 1) + keys[:, 1], return_inverse=True)[1]
        hits[some] = np.bincount(kind, weights[owner[some]])[kind] > 1
    return [_intervals(part) for part in np.split(hits, np.cumsum(counts)[:-1])]


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes): lists of about PIECE bytes; longer texts are cut, with a window less one in common."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), PIECE):
            part = text[at : at + PIECE + window - 1]
            if len(part) < window:
                continue
            held.append((number, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, whole: bool = False) -> np.ndarray:
    """(text, start, windows, front, key, digest) as columns, a row a segment of a text; with whole=True a window is a segment and its key is of all its bytes."""
    found = [np.empty((6, 0), np.int64)]
    for pieces in _pieces(texts, window):
        values = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8).astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        # starts of windows that lie in one piece
        counts = sizes - window + 1
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes, counts)
        at = np.arange(len(values) - gram + 1)
        least = (run_hashes(values, at, at + gram) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
        reach, width = window - gram + 1, 1
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        anchor = (np.minimum(least[start], least[start + reach - width]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        half = (window - gram + 1) // 2
        left = 2 * (anchor - start) >= window - gram
        low = anchor - half * left
        key = run_hashes(values, start, start + window) if whole else _mixed(run_hashes(values, low, low + gram + half) + left.astype(np.uint64))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        rows = np.flatnonzero(new)
        first, windows = start[rows], np.diff(np.append(rows, len(start)))
        digest = _mixed(run_hashes(values, first, first + windows + window - 1))
        piece = np.searchsorted(ends, first, side="right")
        number, offset = np.array([(p[0], p[1]) for p in pieces], np.int64).T
        found.append(np.stack((number[piece], first - (ends - sizes)[piece] + offset[piece], windows, (first - anchor[rows]) % block, key[rows].view(np.int64), digest.view(np.int64))))
    return np.concatenate(found, 1)


def _packed(rows: np.ndarray) -> np.ndarray:
    """start, windows and front of segments in a number: a segment has no more windows than a window has places for its anchor."""
    return rows[1] << 24 | rows[2] << 8 | rows[3]


def _outline(given: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """(doc_id, digest, n_bytes, whole, keys, segments, places, row): per row, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.encode() for t in texts_of(part)]
            rows = segments(texts, window, gram, block)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows[0], minlength=len(texts))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (rows[4], rows[5], _packed(rows))]
            plain = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *plain, *lists], ["doc_id", "digest", "n_bytes", "whole", "keys", "segments", "places"])

    tail = T.StructType.fromDDL("n_bytes bigint, whole string, keys array<bigint>, segments array<bigint>, places array<bigint>")
    return given.mapInArrow(run, T.StructType([*given.schema[:2], *tail])).withColumn("row", F.monotonically_increasing_id())


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(key, segment, windows, front, n, text) from texts with the segments that they stand for."""
    names = ["key", "segment", "windows", "front", "n", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out: list[list] = [[] for _ in names]
            for t, entries in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = t.encode()
                for e in entries:
                    start, windows, front = e["place"] >> 24, e["place"] >> 8 & 0xFFFF, e["place"] & 0xFF
                    for column, value in zip(out, (e["key"], e["segment"], windows, front, e["n"], raw[start : start + windows + window - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names)

    return rows.mapInArrow(run, "key bigint, segment bigint, windows bigint, front bigint, n bigint, text binary")


def _windows_of(rows: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """(row, key, segment, place): every window of the listed segments as a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            for row, t, places in zip(*(c.to_pylist() for c in part.columns)):
                raw = t.encode()
                for at in range(0, len(places), SOME):
                    starts = np.array([p >> 24 for p in places[at : at + SOME]], np.int64)
                    ends = [(p >> 24) + (p >> 8 & 0xFFFF) + window - 1 for p in places[at : at + SOME]]
                    found = segments([raw[s:e] for s, e in zip(starts.tolist(), ends)], window, gram, block, whole=True)
                    found[1] += starts[found[0]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(found.shape[1], row)), pa.array(found[4]), pa.array(found[5]), pa.array(_packed(found))], ["row", "key", "segment", "place"])

    return rows.mapInArrow(run, "row bigint, key bigint, segment bigint, place bigint")


def _search(window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (shard, key, segment, windows, front, n, text) of the shard that may go on

        def ended(rows: list[tuple]) -> pa.RecordBatch:
            spans = repeated_windows([(r[6], r[3], r[4], r[5]) for r in rows], window, block)
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(spans, _ARROW_INTERVALS)], ["key", "segment", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield ended(held)
                    held = []
                held.append(row)
        if held:
            yield ended(held)

    return run


def _without(rows: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, n_spans, sha, kept): what is left when covered bytes go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            removed, runs, kept = [], [], []
            for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = np.frombuffer(t.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in spans], 1)
                np.add.at(edge, [s["last"] + window for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(raw[~gone].tobytes())
            shas = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["row", "n_removed", "n_spans", "sha", "kept"])

    return rows.mapInArrow(run, "row bigint, n_removed bigint, n_spans bigint, sha string, kept binary")


def _shared(runs: DataFrame) -> DataFrame:
    """The runs (row, key, segment, place) whose key stands at two places or more."""
    keys = written(runs.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"))
    return written(runs.join(keys, "key", "left_semi").select("row", "key", "segment", "place"))


def _found(runs: DataFrame, outline: DataFrame, given: DataFrame, window: int, block: int, shard_segments: int) -> DataFrame:
    """(key, segment, s): repeated windows of the runs' different segments, by the suffix array of their shard."""
    first = runs.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("first"))
    lists = first.select("first.row", F.struct("key", "segment", "first.place", "n").alias("e")).groupBy("row").agg(F.collect_list("e").alias("entries"))
    wanted = written(lists.join(outline.select("row", "doc_id", "digest"), "row").select("doc_id", "digest", "entries"))
    cut = _cut(_with_texts(given, wanted, "text", "entries"), window)
    # rows that repeat as a whole give their entries twice
    cut = written(cut.dropDuplicates(["key", "segment"]) if _repeats_rows(outline) else cut)
    shards = max(1, -(-cut.count() // shard_segments))
    routed = cut.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "segment", "windows", "front", "n", "text")
    searched = routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(window, block), f"key bigint, segment bigint, spans {INTERVALS}")
    return written(searched.select("key", "segment", F.explode("spans").alias("s")))


def dedup_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null: nothing removed).

    A byte of a text in UTF-8 goes when it lies in `window` bytes of the text that also start anywhere
    else, in the same text too, overlapping or not. Judged on the input, not on what is left; what is left
    may cut a character. Null text has no bytes; texts shorter than a window lose nothing; texts are read
    whole and never joined; a repeated row counts as another place; a null doc_id is an id like
    others; other columns are ignored; an empty table gives an empty one.
    """
    if not 1 <= gram <= window < 1 << 15 or not 1 <= block <= min(255, window):
        raise ValueError("gram and block must lie between 1 and window, block under 256")
    with scratch(docs.sparkSession):
        given = _keyed(docs, key, text)
        outline = written(_outline(given, window, gram, block), keep=True)
        cols = ["keys", "segments", "places"]
        runs = outline.select("row", F.explode(F.arrays_zip(*cols)).alias("r")).select("row", *(F.col(f"r.{c}").alias(c[:-1]) for c in cols))
        live = _shared(runs)
        kinds = live.groupBy("key", "segment").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("m"))
        crowded = written(kinds.filter(F.col("m") > shard_segments).select("key"))
        if not crowded.isEmpty():
            hot = live.join(crowded, "key", "left_semi").groupBy("row").agg(F.collect_list("place").alias("places"))
            texts = _with_texts(given, written(hot.join(outline.select("row", "doc_id", "digest"), "row")), "row", "text", "places").dropDuplicates(["row"])
            # a few rows of many windows: dealt out evenly, and cut once
            dealt = texts.repartition(given.sparkSession.sparkContext.defaultParallelism, "row")
            each = _shared(written(_windows_of(dealt, window, gram, block)))
            live = written(live.join(crowded, "key", "left_anti").unionByName(each))
        found = _found(live, outline, given, window, block, shard_segments)
        # every place of a segment has the segment's repeated windows
        start = F.shiftright("place", 24)
        places = live.join(found, ["key", "segment"]).select("row", F.struct((start + F.col("s.first")).alias("first"), (start + F.col("s.last")).alias("last")).alias("span"))
        spans = places.groupBy("row").agg(F.collect_list("span").alias("spans"))
        marked = written(spans.join(outline.select("row", "doc_id", "digest"), "row"))
        less = _without(_with_texts(given, marked, "row", "text", "spans"), window)
        less = written(less.dropDuplicates(["row"]) if _repeats_rows(outline) else less, keep=True)
    return outline.join(less, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), "kept")
