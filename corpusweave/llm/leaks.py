"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF rows (document frequencies counted over all documents, in one pass).
A randomised SVD of these rows, its sums taken over tasks, gives a latent space. Windows of every
document are folded into it and compared by cosine to the passages of their length; candidates
are verified by the longest common subsequence of words. Where that is too short for a copy, a
paraphrase is told by the passage's answer standing word for word in the same place. Passages too
short to be told from chance that way are searched for word by word.

Benchmarks are searched in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import slices, texts_of, written
from corpusweave.llm.licences import words_of

RANK, OVERSAMPLE, SEED = 64, 16, 7
BLOCK_WORDS = 250_000
#: Shorter passages count where they stand word for word.
MIN_WORDS = 8
COSINE = 0.5
#: Words of a document that are searched at once, at least.
STRETCH = 512
#: Words that a task counts before it hands its counts on, and the most that are sent to the tasks beforehand.
COUNTED = 200_000
SIMILAR, PARAPHRASE = 0.8, 0.6
ANSWER_WORDS = 4


def common_subsequence(item: dict[bytes, int], size: int, words: list[bytes]) -> tuple[int, int]:
    """(length, last) of the longest common subsequence of a passage and words; item maps a word to
    the bit set of its places. last is the place where the length is first reached, -1 for none."""
    rows, mask, length, last = (1 << size) - 1, (1 << size) - 1, 0, -1
    for at, w in enumerate(words):
        if m := item.get(w, 0):
            x = rows & m
            rows = ((rows + x) | (rows - x)) & mask
            if (now := size - rows.bit_count()) > length:
                last, length = at, now
    return length, last


def backwards(item: dict[bytes, int], size: int) -> dict[bytes, int]:
    """The bit sets of a passage read from its end."""
    return {w: int(f"{m:0{size}b}"[::-1], 2) for w, m in item.items()}


def closest(item: dict[bytes, int], size: int, words: list[bytes], least: float = 0) -> tuple[int, int, int]:
    """(length, first, last) of the longest common subsequence within a stretch of twice the passage's size.

    The whole of words comes first. Only where what it finds spreads wider, the stretches from every
    place on are looked at one by one; of equals the first counts. Lengths under `least` are none.
    """
    turned: dict[bytes, int] = {}

    def within(low: int, high: int) -> tuple[int, int, int]:
        length, last = common_subsequence(item, size, words[low:high])
        if not length or length < least:
            return 0, low, low
        if not turned:
            turned.update(backwards(item, size))
        back = common_subsequence(turned, size, words[low : low + last + 1][::-1])[1]
        return length, low + last - back, low + last

    best = within(0, len(words))
    if best[2] - best[1] < 2 * size:
        return best
    stretches = (within(low, low + 2 * size) for low in range(max(1, len(words) - 2 * size + 1)))
    return max(stretches, key=lambda s: (s[0], -s[1]))


def stands_in(short: list[bytes], long: list[bytes]) -> bool:
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


class Items:
    """A block of the benchmark with its vocabulary, weights and latent space; rows are (id, text, answer)."""

    def __init__(self, rows: list[tuple]):
        cut = [(r, words_of(r[1])) for r in rows]
        #: first word -> (id, words) of the passages that are too short
        self.short: dict[bytes, list[tuple]] = {}
        for r, ws in cut:
            if 0 < len(ws) < MIN_WORDS:
                self.short.setdefault(ws[0], []).append((r[0], ws))
        cut = [(r, ws) for r, ws in cut if len(ws) >= MIN_WORDS]
        self.ids = [r[0] for r, _ in cut]
        self.words = [ws for _, ws in cut]
        # without an answer of its own a passage's last sentence serves
        self.answers = [words_of(r[2]) if r[2] is not None else words_of(r[1].rstrip(" .!?\n").replace("!", ".").replace("?", ".").rpartition(".")[2]) for r, _ in cut]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.places = []
        for ws in self.words:
            masks: dict[bytes, int] = {}
            for i, w in enumerate(ws):
                masks[w] = masks.get(w, 0) | 1 << i
            self.places.append(masks)
        self.terms = [np.array([self.vocab[w] for w in masks], np.int64) for masks in self.places]
        self.longs = np.array([len(ws) for ws in self.words], np.int64)
        #: windows are as long as the passage, so that little else is in the one that lies on a copy
        self.sizes = self.longs
        # postings: for each word the passages that have it, and how often
        rows = sorted((self.vocab[w], i, m.bit_count()) for i, masks in enumerate(self.places) for w, m in masks.items())
        terms, self.having, self.times = np.array(rows, np.int64).reshape(-1, 3).T
        self.starts = np.searchsorted(terms, np.arange(len(self.vocab) + 1))
        self.idf = self.space = self.vectors = self.weighted = None

    def covered(self, terms: np.ndarray) -> np.ndarray:
        """How many of its words each passage has among different terms: no common subsequence is longer."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        lengths = ends - starts
        picked = np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        return np.bincount(self.having[picked], self.times[picked], len(self.ids))

    def row(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their TF-IDF weights, of length 1."""
        counts = Counter(self.vocab[w] for w in words if w in self.vocab)
        terms = np.fromiter(counts, np.int64, len(counts))
        values = np.fromiter(counts.values(), np.float64, len(counts)) * self.idf[terms]
        return terms, values / (np.linalg.norm(values) or 1)

    def fold(self) -> None:
        rows = [self.row(ws) for ws in self.words]
        v = np.array([x @ self.space[t] for t, x in rows], np.float32).reshape(len(rows), -1)
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def weigh(self) -> None:
        """What each word adds to a window; the last row is a word of no passage."""
        rows = self.space * self.idf[:, None].astype(np.float32)
        self.weighted = np.vstack((rows, np.zeros((1, rows.shape[1]), np.float32)))


def document_frequencies(docs: DataFrame, words: DataFrame, text: str) -> DataFrame:
    """(word, n): how many documents have each of the words; the word "" stands for all documents.

    If the words are few enough to be sent to the tasks, these count no others; else all are counted.
    """
    asked = words.limit(COUNTED + 1).collect()
    few = docs.sparkSession.sparkContext.broadcast(frozenset(r["word"].encode() for r in asked)) if len(asked) <= COUNTED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for part in slices(batches):
            n += part.num_rows
            for t in texts_of(part):
                found.update(few.value.intersection(words_of(t)) if few else set(words_of(t)))
            if len(found) >= COUNTED:
                yield _counts(found)
                found = Counter()
        found[b""] = n
        yield _counts(found)

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.join(words.unionByName(words.sparkSession.createDataFrame([("",)], "word string")).distinct(), "word", "left_semi")


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def _vocabulary(bench: DataFrame) -> DataFrame:
    """(word): the different words of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in {w for t in texts_of(part) for w in words_of(t)}], pa.string())], ["word"])

    return bench.select("text").mapInArrow(run, "word string").distinct()


def _summed(rows: DataFrame, key: str, width: int, size: int) -> np.ndarray:
    """The sum over tasks of the partial matrices given as rows (key, v)."""
    sums = rows.groupBy(key).agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width))).toPandas()
    out = np.zeros((size, width))
    out[sums[key].to_numpy(np.int64)] = sums[[f"v{j}" for j in range(width)]].to_numpy()
    return out


def latent_space(spark: SparkSession, items: Items, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """The first right singular vectors of the block's TF-IDF rows, by a randomised SVD: the range of
    two multiplications by A'A of a random matrix, and the eigenvectors of A on that range."""
    size = len(items.vocab)
    width = min(rank + OVERSAMPLE, size, len(items.ids))
    rows = [(t.tolist(), x.tolist()) for t, x in map(items.row, items.words)]
    table = spark.createDataFrame(rows, "terms array<bigint>, weights array<double>").repartition(8)
    basis = np.random.default_rng(seed).standard_normal((size, width))

    def product(shared: Broadcast, gram: bool):
        def run(batches):
            q, total, got = shared.value, np.zeros((width, width)), {}
            for b in batches:
                for t, x in zip(b["terms"], b["weights"]):
                    y = x @ q[t]
                    if gram:
                        total += np.outer(y, y)
                        continue
                    for term, value in zip(t.tolist(), x):
                        got[term] = got.get(term, 0) + value * y
            terms, sums = (np.arange(width), total) if gram else (list(got), list(got.values()))
            if len(terms):
                yield pd.DataFrame({"term": np.asarray(terms, np.int64), "v": [r.tolist() for r in sums]})

        return run

    def multiplied(gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis)
        out = _summed(table.mapInPandas(product(shared, gram), "term bigint, v array<double>"), "term", width, width if gram else size)
        shared.destroy()
        return out

    for _ in range(2):
        basis, _ = np.linalg.qr(multiplied(False))
    values, vectors = np.linalg.eigh(multiplied(True))
    top = [j for j in np.argsort(-values)[:rank] if values[j] > 1e-9]
    return (basis @ vectors[:, top]).astype(np.float32)


def search(words: list[bytes], block: Items, cosine: float = COSINE) -> list[tuple]:
    """(item's id, similarity, cosine, first, last word) of each item's best place in words."""
    n, rest = len(words), len(block.vocab)
    best: dict[int, tuple[float, float, int, int]] = {}
    ids = np.fromiter(map(block.vocab.get, words, repeat(rest)), np.int64, n)
    longest = int(block.sizes.max(initial=8))
    stretch = max(STRETCH, 2 * longest)
    mark = np.zeros(rest + 1, bool)
    for at in range(0, max(1, n) if block.ids else 0, stretch):
        around = np.unique(ids[max(0, at - longest // 2) : at + stretch + 2 * longest])
        for i in np.flatnonzero(block.covered(around[around < rest]) >= PARAPHRASE * block.longs).tolist():
            if i in best and best[i][0] == 1:
                continue
            size, long, terms = int(block.sizes[i]), int(block.longs[i]), block.terms[i]
            step = size // 4
            # windows that begin in this stretch, but for the last half window of the text
            starts = np.arange(at, min(at + stretch, max(at + 1, n - size // 2)), step)
            lows, highs = np.maximum(0, starts - size // 2), np.minimum(n, starts + size + size // 2)
            # how many words around a window the passage has: no common subsequence is longer
            mark[terms] = True
            before = np.concatenate(([0], np.cumsum(mark[ids[lows[0] : highs[-1]]])))
            mark[terms] = False
            full = before[highs - lows[0]] - before[lows - lows[0]] >= PARAPHRASE * long
            if not full.any():
                continue
            starts, lows, highs = starts[full], lows[full], highs[full]
            own = starts[:, None] + np.arange(size)
            v = block.weighted[np.where(own < n, ids[np.minimum(own, n - 1)], rest)].sum(1)
            near = (v @ block.vectors[i]) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)
            alike = np.flatnonzero(near >= cosine)
            # up to four windows that follow each other are judged together
            for group in np.split(alike, np.flatnonzero(np.diff(alike) > 1) + 1):
                for k in range(0, len(group), 4):
                    some = group[k : k + 4]
                    low = int(lows[some[0]])
                    region = words[low : int(highs[some[-1]])]
                    length, first, last = closest(block.places[i], long, region, PARAPHRASE * long)
                    similar = length / long
                    if similar >= SIMILAR or (similar >= PARAPHRASE and len(block.answers[i]) >= ANSWER_WORDS and stands_in(block.answers[i], region)):
                        found = (similar, float(near[some].max()), low + first, low + last)
                        if i not in best or found[:2] > best[i][:2]:
                            best[i] = found
    out = [(block.ids[i], *found) for i, found in best.items()]
    return out + whole_places(words, block) if block.short else out


def whole_places(words: list[bytes], block: Items) -> list[tuple]:
    """The first place of each short passage that stands word for word; its cosine is 1."""
    out, seen = [], set()
    for at, w in enumerate(words):
        for name, ws in block.short.get(w, ()):
            if (name, *ws) not in seen and words[at : at + len(ws)] == ws:
                seen.add((name, *ws))
                out.append((name, 1.0, 1.0, at, at + len(ws) - 1))
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> int:
    words = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    return max(1, math.ceil(words / block_words))


def _benchmark_blocks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, answer: str | None, block_words: int) -> Iterator[Items]:
    """The benchmark's blocks, ready for search()."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).filter("text IS NOT NULL")
    blocks, frequencies = _blocks(bench, block_words), None
    for b in range(blocks):
        # a block has about block_words words: the bound of what is collected and broadcast
        rows = bench.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()
        items = Items(sorted(rows, key=lambda r: (str(r["item_id"]), r["text"])))
        if items.ids:
            if frequencies is None:
                frequencies = written(document_frequencies(docs, _vocabulary(bench), text))
            asked = spark.createDataFrame([(w.decode(),) for w in [b"", *items.vocab]], "word string")
            counts = {r["word"]: r["n"] for r in frequencies.join(asked, "word").collect()}  # one row per word of the block
            items.idf = np.log((1 + counts.get("", 0)) / (1 + np.array([counts.get(w.decode(), 0) for w in items.vocab]))) + 1
            items.space = latent_space(spark, items)
            items.fold()
            items.weigh()
        if items.ids or items.short:
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, cosine: float = COSINE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, cosine, first_word, last_word): documents with benchmark passages.

    One row per row of docs and passage that it holds. similarity is the share of the passage's
    words in the longest common subsequence within a stretch of twice its length: 0.8 or more, or
    0.6 or more where the answer (a column of the benchmark, else the passage's last sentence if it
    has 4 words) stands word for word. Words are runs of letters and digits after lower-casing A-Z.
    Passages of fewer than 8 words must stand whole. Null texts have no words, and passages without
    words are never found; texts are read whole; of equally good places the first counts; repeated
    rows give repeated rows; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = benchmark.select(F.col(item).alias("item_id")).schema[0]
    schema = T.StructType([given.schema[0], named, *T.StructType.fromDDL("similarity double, cosine double, first_word bigint, last_word bigint")])
    out = spark.createDataFrame([], schema)
    for items in _benchmark_blocks(given, benchmark, "text", item, item_text, answer, block_words):
        out = out.unionByName(given.mapInArrow(_searcher(spark.sparkContext.broadcast(items), schema, cosine), schema))
    return out


def _searcher(shared: Broadcast, schema: T.StructType, cosine: float):
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column(0).to_pylist()
            rows = [(doc_id, *found) for doc_id, t in zip(ids, texts_of(part)) for found in search(words_of(t), shared.value, cosine)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, cosine: float = COSINE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no passage (see find_leaks), with all their columns.

    Rows are judged where they stand, block after block, so none is shuffled; null and empty texts stay.
    """
    out, schema = docs, docs.schema
    for items in _benchmark_blocks(docs, benchmark, text, item, item_text, answer, block_words):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(items), text, cosine), schema)
    return out


def _clean(shared: Broadcast, text: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([not search(words_of(t or ""), shared.value, cosine) for t in part.column(part.schema.get_field_index(text)).cast(pa.string()).to_pylist()], pa.bool_()))

    return run
