"""SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to reference fingerprints (pivots) are its coordinates. By the
triangle inequality two fingerprints within r bits differ by r at most in every coordinate, so a
pair with a larger coordinate difference is discarded unseen; survivors are verified.

Two kinds of pivots serve. The zero word and the 64 one-bit words deal fingerprints into cells: two
that differ in r bits have the same offsets (distance to the one-bit word minus distance to zero)
in all but r of 64 coordinates, so of four groups of 16 such coordinates one is the same when
r <= 3. In a cell the table of distances to spread-out pivots discards the pairs; a cell holds a
65,536th of all fingerprints that are unlike each other, and hardly any of their pairs survive it.

A cell of many classes is cut by a second group, of 12 of the other 48 coordinates, and what is
still crowded is dealt out as pairs of blocks, so that no task holds more than two blocks. Equal
fingerprints are one class from the start. Within a cell only a spanning forest of the verified
links is given out, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import slices, texts_of, written
from corpusweave.operators.components import connected_components

SEED, SHINGLE, RADIUS, BITS = 42, 3, 3, 64
BLOCK = 2048
#: Cells of up to so many classes are paired together, many cells at once; larger ones by a forest each.
SMALL = 32
#: Pairs that are looked at once.
PAIRS = 1 << 18
#: Spread-out pivots: the first is zero, the others are hashes of their numbers.
PIVOTS = np.array([0, *(xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(1, 16))], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        set_bits += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: lower() knows A-Z only, split() the six ASCII blanks
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64)
    return majority(h)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp): one row per row of docs; digest is the md5 of the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = docs.select(F.col(key).alias("doc_id"), F.md5(body).alias("digest"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t) for t in texts_of(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["doc_id", "digest", "fp"])

    return given.mapInArrow(run, T.StructType([*given.schema[:2], T.StructField("fp", T.LongType())]))


def _bits(word: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << n) - 1))


def _keys() -> Column:
    """The four first keys of fp: a group of 16 bits, and which."""
    return F.array(*(F.shiftleft(_bits(F.col("fp"), 16 * g, 16), 4).bitwiseOR(F.lit(4 * g)).cast("long") for g in range(4)))


def _second_keys() -> Column:
    """The four second keys of (fp, key): a group of 12 of the bits that are not the key's, and which."""
    group = F.shiftright(F.col("key"), 2).bitwiseAND(F.lit(3))

    def rest(g: int) -> Column:
        # the key's bits cut out: what is below them stays, what is above moves down
        low = F.col("fp").bitwiseAND(F.lit((1 << 16 * g) - 1))
        return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * (g + 1)), 16 * g)) if g < 3 else low

    others = F.when(group == 0, rest(0)).when(group == 1, rest(1)).when(group == 2, rest(2)).otherwise(rest(3))
    return F.array(*(F.shiftleft(F.col("key"), 16).bitwiseOR(F.shiftleft(_bits(others, 12 * h, 12), 2)).bitwiseOR(F.lit(h)) for h in range(4)))


def survivors(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs x[a], x[b] the pivot distance table leaves: no coordinate differs by more than radius."""
    left = np.arange(len(a))
    for pivot in PIVOTS:
        far = np.bitwise_count(x ^ pivot).astype(np.int8)
        left = left[np.abs(far[a[left]] - far[b[left]]) <= radius]
    return left


def small_links(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Verified links within small cells that follow each other in x, as pairs of places."""
    out = [np.empty((0, 2), np.int64)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        for at in range(0, len(own), max(1, PAIRS // len(i))):
            some = own[at : at + max(1, PAIRS // len(i)), None]
            a, b = (some + i).ravel(), (some + j).ravel()
            left = survivors(x, a, b, radius)
            left = left[np.bitwise_count(x[a[left]] ^ x[b[left]]) <= radius]
            out.append(np.stack((a[left], b[left]), 1))
    return np.concatenate(out)


def forest(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Verified links that join whatever is linked among x, as pairs of places."""
    table = np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int8)
    todo, links = np.arange(len(x)), [np.empty((0, 2), np.int64)]
    while len(todo) > 1:
        reached, todo = [int(todo[0])], todo[1:]
        while reached and len(todo):
            at = reached.pop()
            near = np.flatnonzero(np.abs(table[todo, 0] - table[at, 0]) <= radius)
            near = near[np.abs(table[todo[near]] - table[at]).max(1, initial=0) <= radius]
            near = near[np.bitwise_count(x[todo[near]] ^ x[at]) <= radius]
            if len(near):
                found = todo[near]
                links.append(np.stack((np.full(len(found), at), found), 1))
                reached += found.tolist()
                todo = np.delete(todo, near)
    return np.concatenate(links)


def cell_links(cells: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Verified links (pairs of fingerprints) that join what is linked within each run of rows of one cell."""
    starts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(1)))) if len(cells) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(cells)))
    small = sizes <= SMALL
    links = [small_links(x, starts[small], sizes[small]), *(s + forest(x[s : s + n]) for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()))]
    return x[np.concatenate(links)]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows of the same cell; a run may go on in the next batch."""
    cells, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)

    def ended(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        links = cell_links(cells, fps).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1).astype(np.int64)
        cells = np.concatenate((cells, new))
        fps = np.concatenate((fps, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if len(cells):
            open_at = int(np.flatnonzero((cells != cells[-1]).any(1))[-1] + 1) if (cells != cells[-1]).any() else 0
            if open_at:
                yield ended(cells[:open_at], fps[:open_at])
                cells, fps = cells[open_at:], fps[open_at:]
    yield ended(cells, fps)


def _sized(keyed: DataFrame) -> DataFrame:
    """(key, n) of the keys of two classes or more."""
    return keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links within 3 bits between the distinct fp of classes that join all that are linked."""
    keyed = written(classes.select("fp", F.explode(_keys()).alias("key")))
    met = written(_sized(keyed))
    usual = keyed.join(met.filter(F.col("n") <= block).select("key"), "key").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "fp")
    crowded = met.filter(F.col("n") > block).select("key")
    cells = usual
    if not crowded.isEmpty():
        second = written(keyed.join(crowded, "key").select("fp", F.explode(_second_keys()).alias("key")))
        dealt = second.join(_sized(second).select("key", F.ceil(F.col("n") / block).alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        pairs = dealt.select("key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cells = usual.unionByName(pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    together = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return together.mapInArrow(_forests, "a bigint, b bigint").distinct()


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, digest, fp, component_id, kept.

    component_id is the smallest doc_id reachable by links of 3 or fewer differing bits, itself
    included. Null text is empty; texts without words have fingerprint zero and link like others.
    A null doc_id gives no component its name, unless all its ids are null. kept marks one row
    kind (doc_id, digest) of each component, the smallest, null ids last. Texts are read whole;
    repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs, key=key, text=text))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = written(rows.groupBy("fp").agg(F.min(first).alias("first")))
    found = connected_components(links(classes.select("fp"), block)).select(F.col("id").alias("fp"), "component")
    named = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    roots = named.select("fp", "component").join(smallest, "component").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("first_digest"))
    joined = rows.join(written(roots), "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first_digest"))
    return joined.select("doc_id", "digest", "fp", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    kept = components(docs, key=key, text=text, block=block).filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__kept"))
    given = docs.withColumn("__digest", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    stays = given.join(kept, F.col("__digest").eqNullSafe(F.col("__kept")) & F.col(key).eqNullSafe(F.col("__id")), "left_semi")
    return stays.dropDuplicates([key, "__digest"]).select(docs.columns)
