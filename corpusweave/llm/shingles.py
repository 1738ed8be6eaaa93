"""Near-dedup on word shingles: documents whose sets of five-word runs have Jaccard similarity 0.8 or more.

Two sets that are so alike share one of the first fifth of their shingles (and one more) in any
order that holds for all documents. Shingles that are frequent in a sample come last in it, so few
documents meet in a cell (a shingle among the first of several documents). The order decides what
is compared, never what is found.

SimHash comes first: fingerprints of the shingles within three bits, found through the pivot distance
tables, are candidates, and what they join needs no more search. Similarity 0.8 leaves some ten bits
apart, more than pivots can tell, so the cells find the rest. Cells of the same documents are one. Near
copies in large groups are joined in a few rounds, each with the strongest document of the cell that
it shares most with; only documents of a cell that this has not joined are compared with each other.
Sizes and counts of shingles by their last bits, the more bits the larger the set, discard pairs that
can't be alike; a pair that is left is given out in the first cell that both are in, not in each, and
verified on the whole texts. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import simhash
from corpusweave.llm.common import scratch, slices, texts_of, written
from corpusweave.llm.passages import run_hashes, word_hashes
from corpusweave.llm.simhash import BLOCK, SEED, majority
from corpusweave.operators.components import connected_components

SHINGLE = 5
#: Sampled documents and the most shingles that are told to be frequent; they are in SAMPLE_COUNT of the sample at least.
SAMPLE_ROWS, FREQUENT, SAMPLE_COUNT = 20_000, 50_000, 3
#: Counters of shingles by their last bits: so many for sets of up to 8 times as many shingles, then doubled to the most.
BUCKETS, MOST_BUCKETS = 128, 1024
#: Cells, the least first, by which a document tells that it has met another in one of them before.
EARLIER = 16
#: How often documents are joined with a strong one of their cell before those of a cell are compared with each other.
ROUNDS = 1
#: Texts that aren't needed are left out by so many hashes before the others are shuffled.
FILTER = 1 << 20


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of n words, ascending; a shorter text is one run."""
    words = word_hashes(text.encode().lower())  # bytes: lower() knows A-Z only
    if not len(words):
        return np.empty(0, np.uint64)
    starts = np.arange(max(1, len(words) - n + 1))
    return np.unique(run_hashes(words, starts, np.minimum(starts + n, len(words))))


def first_ones(x: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first len - ceil(0.8 len) + 1 of ascending shingles, the frequent ones last."""
    heat = np.zeros(len(x), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        heat = np.where(frequent[at] == x, ranks[at], 0)
    return x[np.argsort(heat, kind="stable")[: len(x) - -(-4 * len(x) // 5) + 1]]


def counters(x: np.ndarray) -> bytes:
    """Numbers of shingles by their last bits, a byte each and 255 at most."""
    n = BUCKETS
    while n < MOST_BUCKETS and 8 * n < len(x):
        n *= 2
    return np.minimum(np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def _frequent(given: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(frequent shingles of a sample, ascending, their ranks: the most frequent last)."""
    share = max(1, given.count() // SAMPLE_ROWS)
    sample = given.filter(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in texts_of(part)]).view(np.int64))], ["token"])

    counts = sample.select("text").mapInArrow(run, "token bigint").groupBy("token").count().filter(F.col("count") >= SAMPLE_COUNT)
    rows = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    ranks = np.arange(len(rows), 0, -1)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def _sketched(given: DataFrame) -> DataFrame:
    """(doc_id, digest, sid, fp, size, counts, tokens): sid names the set of shingles, fp is its fingerprint."""
    shared = given.sparkSession.sparkContext.broadcast(_frequent(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t) for t in texts_of(part)]
            sids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fps = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            counts = [counters(x) for x in sets]
            tokens = [first_ones(x, *shared.value).view(np.int64) if len(x) else x.view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sids), pa.array(fps), pa.array([len(x) for x in sets], pa.int64()), pa.array(counts, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "digest", "sid", "fp", "size", "counts", "tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, digest string, sid bigint, fp bigint, size bigint, counts binary, tokens array<bigint>")


def _folded(counts: bytes, n: int) -> np.ndarray:
    """Counters by fewer bits, n of them."""
    return np.frombuffer(counts, np.uint8).reshape(-1, n).sum(0, dtype=np.int32)


def _matrix(counts: list[bytes]) -> np.ndarray:
    return np.array([_folded(c, BUCKETS) for c in counts], np.int32).reshape(-1, BUCKETS)


def _near(counts: bytes, other: bytes, sizes: int) -> bool:
    """Whether sets of so many shingles together may be alike: no more than a ninth of these may stand in one of them only."""
    n = min(len(counts), len(other))
    return 9 * int(np.abs(_folded(counts, n) - _folded(other, n)).sum()) <= sizes


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of (a, b, size, other_size, counts, other_counts) whose sets may be alike."""
    for b in batches:
        for part in slices([b], 4096):
            sizes = (part.column(2).to_numpy() + part.column(3).to_numpy()).tolist()
            near = pa.array([_near(*v) for v in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), sizes)], pa.bool_())
            yield part.select(["a", "b"]).filter(near)


def _met(cells: np.ndarray, sids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, owns: np.ndarray, earlier: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Pairs of one cell, not joined and not met before, whose sets may be alike."""
    starts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(1)))) if len(cells) else np.empty(0, int)
    a, b = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
        token, one_block = cells[s, 0], cells[s, 1] == cells[s, 2]
        order = s + np.argsort(sizes[s:e], kind="stable")
        own = sizes[order]
        coarse = _matrix(counts[order].tolist())
        for k in range(len(order) - 1):
            i = order[k]
            rest = np.arange(k + 1, np.searchsorted(own, own[k] * 5 // 4, side="right"))
            other = order[rest]
            rest = rest[(comps[other] != comps[i]) & (one_block | (owns[other] != owns[i]))]
            if len(rest):
                rest = rest[9 * np.abs(coarse[rest] - coarse[k]).sum(1) <= own[rest] + own[k]]
            if len(rest):
                # one that both are in and that comes before has given the pair out
                rest = rest[~np.isin(earlier[order[rest]], earlier[i][earlier[i] < token]).any(1)]
            for j in order[rest].tolist():
                if _near(counts[i], counts[j], int(sizes[i] + sizes[j])):
                    a.append(sids[i])
                    b.append(sids[j])
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_met of each run of rows (token, i, j, sid, comp, size, own, earlier, counts) of the same cell; a run may go on in the next batch."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([batch.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)
        lists = batch.column(7).to_pylist()
        # short lists repeat their last cell
        earlier = np.array([[*x, *[x[-1]] * (EARLIER - len(x))] for x in lists], np.int64)
        new = [cells, *(batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5, 6)), earlier, np.array([*batch.column(8).to_pylist(), None], object)[:-1]]
        kept = new if kept is None else [np.concatenate(v) for v in zip(kept, new)]
        other = np.flatnonzero((kept[0] != kept[0][-1]).any(1))
        if len(other):
            at = int(other[-1]) + 1
            yield _met(*(v[:at] for v in kept))
            kept = [v[at:] for v in kept]
    if kept is not None:
        yield _met(*kept)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, text, other) whose sets have Jaccard similarity 0.8 or more."""
    for batch in batches:
        for part in slices([batch], 64):
            near = []
            for t, u in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = shingles(t), shingles(u)
                near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(pairs: DataFrame, heads: DataFrame, given: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets with Jaccard similarity 0.8 or more, on the whole texts; the texts go when that is known."""
    with scratch(given.sparkSession):
        pairs = written(pairs.distinct())
        needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = written(heads.join(needed, "sid").select("sid", F.col("first.doc_id").alias("id"), F.col("first.digest").alias("own")).withColumn("bucket", F.pmod(F.xxhash64("id", "own"), F.lit(FILTER))))
        some = F.broadcast(wanted.select("bucket").distinct())  # FILTER rows at most
        texts = given.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(FILTER))).join(some, "bucket", "left_semi")
        texts = wanted.join(texts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))).select("sid", "text")
        # rows that repeat id and text give a set more than one text, all alike
        texts = written(texts.dropDuplicates(["sid"]))
        both = pairs.join(texts.withColumnRenamed("sid", "a"), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("other")), "b")
        return written(both.select("a", "b", "text", "other").mapInArrow(_alike, "a bigint, b bigint"), keep=True)


def _cells(rows: DataFrame) -> DataFrame:
    """(token, sid, weight): shingles among the first of two sets or more; of those of the same sets one, with their number."""
    keyed = rows.select("sid", F.explode("tokens").alias("token"))
    common = written(keyed.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"))
    placed = written(keyed.join(common, "token", "left_semi").distinct())
    members = placed.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), "sid")).alias("y")).filter("n > 1")
    kept = written(members.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "weight"))
    return written(placed.join(kept, "token"))


def _plausible_pairs(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and counts leave."""
    left = sketch.select(F.col("sid").alias("a"), "size", "counts")
    right = sketch.select(F.col("sid").alias("b"), F.col("size").alias("other_size"), F.col("counts").alias("other_counts"))
    sized = pairs.join(left, "a").join(right, "b").filter("5 * least(size, other_size) >= 4 * greatest(size, other_size)")
    return sized.select("a", "b", "size", "other_size", "counts", "other_counts").mapInArrow(_plausible, "a bigint, b bigint")


def _marked(sketch: DataFrame, found: DataFrame) -> DataFrame:
    """sketch with comp, the component by the links found."""
    joined = connected_components(found).select(F.col("id").alias("sid"), "component")
    return written(sketch.join(joined, "sid", "left").select("sid", "size", "counts", F.coalesce("component", "sid").alias("comp")))


def _by_fingerprint(heads: DataFrame) -> DataFrame:
    """(a, b): candidates that the pivot tables give, a set of each fingerprint standing for the others."""
    own = heads.select("sid", "fp")
    first = written(own.groupBy("fp").agg(F.min("sid").alias("a")))
    same = own.join(first, "fp").filter("sid <> a").select("a", F.col("sid").alias("b"))
    left, right = first.select(F.col("fp").alias("p"), F.col("a").alias("x")), first.select(F.col("fp").alias("q"), F.col("a").alias("y"))
    near = simhash.links(first.select("fp")).toDF("p", "q").join(left, "p").join(right, "q")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def links(rows: DataFrame, heads: DataFrame, given: DataFrame, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): verified links between the sets of heads that join all that are linked."""
    cells = _cells(rows)
    sketch = heads.select("sid", "size", "counts")
    strength = written(cells.groupBy("sid").agg(F.sum("weight").alias("strength")))
    found, used = _verified(_plausible_pairs(_by_fingerprint(heads), sketch), heads, given), None
    placed = written(cells.join(strength, "sid").select("token", "sid", "weight", "strength"))
    for k in range(rounds + 1):
        marked = _marked(sketch, found)
        placed = written(placed.select("token", "sid", "weight", "strength").join(marked.select("sid", "comp"), "sid"))
        mixed = written(placed.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token", "n"))
        if k == rounds or mixed.isEmpty():
            break
        # each with the strongest of its cells that has not served, the one that it meets most often
        free = placed.join(mixed.select("token"), "token", "left_semi")
        centres = written((free if used is None else free.join(used, "sid", "left_anti")).groupBy("token").agg(F.max(F.struct("strength", "sid", "comp")).alias("c")).select("token", F.col("c.sid").alias("a"), F.col("c.comp").alias("centre_comp")))
        met = free.join(centres, "token").filter("comp <> centre_comp").groupBy("sid", "a").agg(F.sum("weight").alias("n"))
        stars = met.groupBy("sid").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", F.col("sid").alias("b"))
        linked = _verified(_plausible_pairs(stars, sketch), heads, given)
        found = found.unionByName(linked)
        own = centres.select(F.col("a").alias("sid")).distinct()
        used = written(own if used is None else used.unionByName(own).distinct())

    # those of a cell that are still apart
    sized = mixed.select("token", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = written(placed.join(sized, "token").select("token", "sid", "blocks", F.pmod(F.xxhash64("sid"), "blocks").alias("own")))
    lists = dealt.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("token")), 1, EARLIER).alias("earlier"))
    told = written(marked.join(lists, "sid"))
    spread = dealt.select("token", "own", "sid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    together = spread.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid").join(told, "sid").select("token", "i", "j", "sid", "comp", "size", "own", "earlier", "counts")
    apart = together.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_meetings, "a bigint, b bigint")
    last = _verified(apart, heads, given)
    return found.unionByName(last)


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns.

    Components are of links of Jaccard similarity 0.8 or more; the smallest id stays, null ids last.
    Words are split at ASCII blanks after lower-casing A-Z; a text of fewer than five words is one
    shingle, null is empty, and texts without words are alike. Texts are read whole; of rows that
    repeat both id and text one stays; other columns are ignored; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = docs.select(F.col(key).alias("doc_id"), F.md5(body).alias("digest"), body.alias("text"))
    with scratch(docs.sparkSession):
        rows = written(_sketched(given))
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
        heads = written(rows.groupBy("sid").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("counts").alias("counts")))
        found = connected_components(links(rows, heads, given, block)).select(F.col("id").alias("sid"), "component")
        named = heads.join(found, "sid", "left").select("first", F.coalesce("component", "sid").alias("component"))
        smallest = named.groupBy("component").agg(F.min("first").alias("first"))
        kept = written(smallest.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__kept")), keep=True)
        repeats = not rows.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty()
    tagged = docs.withColumn("__digest", F.md5(body))
    stays = tagged.join(kept, (F.col("__digest") == F.col("__kept")) & F.col(key).eqNullSafe(F.col("__id")), "left_semi")
    return (stays.dropDuplicates([key, "__digest"]) if repeats else stays).select(docs.columns)
