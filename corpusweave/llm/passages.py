"""Substring dedup with compressed FM-indexes, one per shard.

A passage of `window` words that stands at two places is found without comparing documents:

1. Every window has an anchor, the least of the hashes of its runs of `gram` words, and more words
   on one side of it than on the other. The anchor with half of the window's other words, taken on
   the longer side, is the window's key. Equal windows have equal keys, and neighbouring windows
   mostly share one, so a document falls into segments; only segments whose key stands at two
   places go on.
2. Equal segments are one entry with a weight, how often it stands. Shards gather whole keys, so all
   equal windows lie in one shard. Each shard's segments are indexed (suffix order, its last-column
   transform in a wavelet tree) and streamed through it by backward search: the words matched before
   the interval's weight falls under two are the matching statistic of a place, and places that
   reach `window` are reported as intervals. The index reads words `stride` at a time, in each
   phase, so a window takes window / stride steps.
3. A key with very many different segments (words that are everywhere) has each window as a segment
   of its own, so that it is dealt out over the shards by the windows' words.

Keys and digests choose what meets: segments are equal when their 64-bit key and the 64-bit BLAKE2b
digest of their words both are; within a shard windows are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import slices, texts_of, written

WINDOW, GRAM = 35, 4
SHARD_SEGMENTS = 4096
#: Texts that aren't needed are left out by so many hashes before the others are shuffled.
FILTER = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end] that doesn't depend on where it lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(values) + 1)[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], (a == 32) | ((a >= 9) & (a <= 13)), [True]))
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return run_hashes(a.astype(np.uint64) + np.uint64(1), turns[::2], turns[1::2])


def segments(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, places of the anchor) of each segment of a text."""
    words = word_hashes(raw)
    n, reach = len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    at = np.arange(len(words) - gram + 1)
    grams = run_hashes(words, at, at + gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    before = np.concatenate([view[i : i + (1 << 16)].argmin(1) for i in range(0, n, 1 << 16)])
    anchor, half = before + np.arange(n), (window - gram + 1) // 2
    left = 2 * before >= window - gram
    first = anchor - half * left
    keys = _mixed(run_hashes(words, first, first + gram + half) + left.astype(np.uint64))
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    moved = new | np.concatenate(([True], anchor[1:] != anchor[:-1]))
    starts = np.flatnonzero(new)
    return keys[starts], starts, np.diff(np.append(starts, n)), np.add.reduceat(moved, starts, dtype=np.int64)


class WaveletTree:
    """Rank of symbols in a sequence that has all of them, as one bit row per bit with counts per word of 64."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits, self.before, self.zeros = [], [], []
        self.depth = max(1, int(symbols - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, np.uint8))), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # where each symbol's run begins in the last row
        last = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1]))) if len(seq) else np.empty(0, np.int64)
        self.first = np.zeros(symbols, np.int64)
        self.first[seq[last]] = last

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at - self.first[symbol]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each distinct pair."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Index of texts (lists of word numbers from 1) with weights, read `stride` words at a time in each phase."""

    def __init__(self, texts: list[np.ndarray], window: int, weights: list[int] | None = None):
        self.window = window
        self.stride = max(d for d in range(1, 8) if window % d == 0)
        self.steps = window // self.stride
        sizes = np.array([len(t) for t in texts])
        gap = np.zeros(self.stride, np.int64)
        flat = np.concatenate([x for t in texts for x in (t, gap)])
        self.starts = np.cumsum(sizes + self.stride) - sizes - self.stride
        # the run of `stride` words from each place, as one symbol; runs over an end are symbol 0
        ends = np.concatenate((flat, gap))
        run, alive = flat.copy(), flat > 0
        for k in range(1, self.stride):
            run = _joined(run, ends[k : k + len(flat)])
            alive &= ends[k : k + len(flat)] > 0
        self.run = np.unique(np.where(alive, run + 1, 0), return_inverse=True)[1].astype(np.int64)
        symbols = int(self.run.max(initial=0)) + 1
        # the phases one after the other, each closed by a 0
        phases = [np.append(self.run[p :: self.stride], 0) for p in range(self.stride)]
        text = np.concatenate(phases)
        order = text
        reach = 1
        while reach < self.steps:
            order = _joined(order, np.append(order[reach:], np.zeros(min(reach, len(order)), np.int64))[: len(order)])
            reach *= 2
        suffixes = np.argsort(order, kind="stable")
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.tree = WaveletTree(text[suffixes - 1], symbols)
        self.size = len(text)
        heavy = np.repeat(np.ones(len(texts), np.int64) if weights is None else np.array(weights, np.int64), sizes + self.stride)
        ordered = np.concatenate([np.append(heavy[p :: self.stride], 0) for p in range(self.stride)])[suffixes]
        self.weight = np.concatenate(([0], np.cumsum(ordered)))

    def matched(self, places: np.ndarray) -> np.ndarray:
        """For each place in the joined texts, how many words back from the end of its window stand twice or more (in strides, the window at most)."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), self.size, np.int64)
        out = np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        for step in range(self.steps - 1, -1, -1):
            c = self.run[places[live] + step * self.stride]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            live = live[self.weight[high[live]] - self.weight[low[live]] > 1]
            out[live] += self.stride
        return out

    def repeated(self, places: np.ndarray) -> np.ndarray:
        """For each place in the joined texts: does the window from there stand twice or more?"""
        return self.matched(places) == self.window


def _intervals(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def repeated_windows(rows: list[tuple[str, int]], window: int) -> list[list[dict]]:
    """rows: (segment, how often it stands) of one shard. Runs of repeated windows of each."""
    numbers: dict[str, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in segment.split(" ")], np.int64) for segment, _ in rows]
    index = FMIndex(texts, window, [n for _, n in rows])
    counts = [len(t) - window + 1 for t in texts]
    hits = index.repeated(np.concatenate([start + np.arange(c) for start, c in zip(index.starts, counts)]))
    return [_intervals(part) for part in np.split(hits, np.cumsum(counts)[:-1])]


INTERVALS = "array<struct<first:bigint,last:bigint>>"
_ARROW_INTERVALS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _search(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (shard, anchor, digest, segment, n) of the shard that may go on

        def ended(rows: list[tuple]) -> pa.RecordBatch:
            spans = repeated_windows([(r[3], r[4]) for r in rows], window)
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(spans, _ARROW_INTERVALS)], ["anchor", "segment", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield ended(held)
                    held = []
                held.append(row)
        if held:
            yield ended(held)

    return run


def _same_row(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["digest"] == y["digest"])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("text"))


def _outline(given: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, digest, n_words, whole, anchors, segments, starts, counts, places, row): per row, without its text."""
    ints = {"anchors": np.int64, "segments": np.int64, "starts": np.int32, "counts": np.int32, "places": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, wholes, found, size = [], [], [], []
            for t in texts_of(part):
                words = t.encode().split()
                plain = b" ".join(words)
                sizes.append(len(words))
                wholes.append(hashlib.sha256(plain).hexdigest())
                keys, starts, counts, places = segments(plain, window, gram)
                ends = np.cumsum([len(w) + 1 for w in words])
                first = (ends[starts] - [len(words[i]) + 1 for i in starts.tolist()]).tolist()
                last = (ends[starts + counts + window - 2] - 1).tolist()
                digests = b"".join(hashlib.blake2b(plain[a:b], digest_size=8).digest() for a, b in zip(first, last))
                found.append((keys.view(np.int64), np.frombuffer(digests, "<i8"), starts, counts, places))
                size.append(len(keys))
            ends = np.cumsum([0, *size]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]).astype(kind))) for i, kind in enumerate(ints.values())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(wholes, pa.string()), *lists], ["doc_id", "digest", "n_words", "whole", *ints])

    tail = T.StructType.fromDDL("n_words bigint, whole string, anchors array<bigint>, segments array<bigint>, starts array<int>, counts array<int>, places array<int>")
    return given.mapInArrow(run, T.StructType([*given.schema[:2], *tail])).withColumn("row", F.monotonically_increasing_id())


def _segment_rows(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, text, n) from texts with the segments that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            anchor, digest, text, n = [], [], [], []
            for t, entries in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = t.encode().split()
                for e in entries:
                    anchor.append(e["anchor"])
                    digest.append(e["segment"])
                    text.append(b" ".join(words[e["start"] : e["start"] + e["count"] + window - 1]).decode())
                    n.append(e["n"])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["anchor", "segment", "text", "n"])

    return rows.mapInArrow(run, "anchor bigint, segment bigint, text string, n bigint")


def _without(rows: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, sha, kept): what is left when covered words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            removed, kept = [], []
            for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = t.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["first"]] += 1
                    edge[s["last"] + window] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            shas = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array([k.decode() for k in kept], pa.string())], ["row", "n_removed", "sha", "kept"])

    return rows.mapInArrow(run, "row bigint, n_removed bigint, sha string, kept string")


def _with_texts(given: DataFrame, marked: DataFrame, *cols: str) -> DataFrame:
    """marked (doc_id, digest, ...) with its rows' text; few other texts are shuffled."""
    bucket = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(FILTER))
    some = F.broadcast(marked.select(bucket.alias("bucket")).distinct())  # FILTER rows at most
    texts = given.withColumn("bucket", bucket).join(some, "bucket", "left_semi").drop("bucket")
    return marked.join(texts, _same_row(marked, texts)).select(*cols)


class Repeats:
    """The tables of one search for repeated passages.

    given:   (doc_id, digest, text).
    outline: a row per row of docs (row, doc_id, digest, n_words, whole: sha256 of its words).
    spans:   (row, spans): the runs of window starts that stand elsewhere too.
    """

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS):
        if not 1 <= gram <= window:
            raise ValueError("gram must lie between 1 and window")
        self.window = window
        self.given = _keyed(docs, key, text)
        self.outline = written(_outline(self.given, window, gram))
        cols = ["anchors", "segments", "starts", "counts", "places"]
        runs = self.outline.select("row", F.explode(F.arrays_zip(*cols)).alias("r")).select("row", *(F.col(f"r.{c}").alias(c[:-1]) for c in cols))
        shared = written(runs.groupBy("anchor").agg(F.sum("place").alias("times")).filter("times > 1").select("anchor"))
        live = written(runs.join(shared, "anchor", "left_semi").select("row", "anchor", "segment", "start", "count"))
        groups = written(live.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "count")).alias("first")))
        kinds = written(groups.groupBy("anchor").agg(F.count("*").alias("m"), F.max("n").alias("most")))
        # a segment alone under its key stands whole elsewhere, or repeats within itself
        whole = groups.join(kinds.filter("m = 1 AND most > 1"), "anchor").select("anchor", "segment", F.struct(F.lit(0).cast("long").alias("first"), (F.col("first.count") - 1).cast("long").alias("last")).alias("s"))
        mixed = groups.join(kinds.filter("m > 1 OR most = 1"), "anchor").select("first.row", F.struct("anchor", "segment", "first.start", "first.count", "n").alias("e"))
        lists = mixed.groupBy("row").agg(F.collect_list("e").alias("entries"))
        ids = self.outline.select("row", "doc_id", "digest")
        wanted = written(lists.join(ids, "row").select("doc_id", "digest", "entries"))
        cut = written(_segment_rows(_with_texts(self.given, wanted, "text", "entries"), window))
        crowded = kinds.filter(F.col("m") > shard_segments).select("anchor")
        found = written(whole.unionByName(self._indexed(cut, crowded, shard_segments)))
        # every place of a segment has the segment's repeated windows
        places = live.join(found, ["anchor", "segment"]).select("row", F.struct((F.col("start") + F.col("s.first")).alias("first"), (F.col("start") + F.col("s.last")).alias("last")).alias("span"))
        self.spans = places.groupBy("row").agg(F.collect_list("span").alias("spans"))

    def _indexed(self, cut: DataFrame, crowded: DataFrame, shard_segments: int) -> DataFrame:
        """(anchor, segment, s): the repeated windows of segments, by the index of their shard."""
        dealt = cut if crowded.isEmpty() else cut.join(crowded, "anchor", "left_anti")
        each = None
        if dealt is not cut:
            words, size = F.split("text", " "), F.lit(self.window)
            windows = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.array_join(F.slice("words", i + 1, size), " "))
            hot = cut.join(crowded, "anchor", "left_semi").withColumn("words", words)
            each = hot.select("anchor", "segment", "n", F.posexplode(windows).alias("at", "w")).withColumns({"a": F.xxhash64("w"), "b": F.xxhash64(F.lit("window"), "w")})
            alone = written(each.groupBy(F.col("a").alias("anchor"), F.col("b").alias("segment"), F.col("w").alias("text")).agg(F.sum("n").alias("n")))
            dealt = dealt.unionByName(alone)
        shards = max(1, -(-dealt.count() // shard_segments))
        routed = dealt.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "segment", "text", "n")
        searched = routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(self.window), f"anchor bigint, segment bigint, spans {INTERVALS}")
        found = searched.select("anchor", "segment", F.explode("spans").alias("s"))
        if each is None:
            return found
        found = written(found)
        at = F.col("at").cast("long")
        own = found.select(F.col("anchor").alias("a"), F.col("segment").alias("b"))
        return found.unionByName(each.join(own, ["a", "b"], "left_semi").select("anchor", "segment", F.struct(at.alias("first"), at.alias("last")).alias("s")))


def dedup_passages(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (null: nothing removed).

    Words are what ASCII blanks part; a word goes when it lies in `window` consecutive words of a
    document that also start anywhere else, in the same document too. Judged on the input, not on
    what is left. Null text has no words; shorter texts than a window lose nothing; texts are read
    whole; a repeated row counts as another place; a null doc_id is an id like others; other
    columns are ignored; an empty table gives an empty one.
    """
    r = Repeats(docs, **options)
    marked = written(r.spans.join(r.outline.select("row", "doc_id", "digest"), "row"))
    less = _without(_with_texts(r.given, marked, "row", "text", "spans"), r.window)
    if _repeats_rows(r.outline):
        less = less.dropDuplicates(["row"])
    return r.outline.join(less, "row", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"), "kept")


def _repeats_rows(outline: DataFrame) -> bool:
    return not outline.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty()
