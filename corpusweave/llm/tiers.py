"""Ranked lexical search over a tiered index of documents.

Documents are dealt into segments; an entry of the index is a term's documents within a segment with
their impacts (what an occurrence adds to a score, before the term's weight). Each term's entries are
tiered by impact: its best postings, about `first` of them, make tier 0, the next ones up to `growth`
times as many tier 1, and so on. With each tier goes the residual of a term, the largest impact that
it has in lower tiers.

A search reads tier 0 of the items' terms alone. What an item's terms may still add in lower tiers
bounds the score of all documents that were not met and of what met ones lack. Where the last score
that counts lies well above the bound of what was not met, only documents whose own bound reaches it
can count, and these few are completed from the lower tiers: the item is proved exact. All other items
fall through to the next tier; at the last one nothing is left to bound.

Scores are whole numbers throughout. Neither the postings nor the items pass through the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import let
from corpusweave.llm.common import UPPER, ascii_lower, scratch, written

TOP = 50
FIRST, GROWTH = 1024, 16
#: Documents of a segment and bytes of their texts, at most (a longer text is a segment by itself).
SEGMENT, SEGMENT_BYTES = 4096, 16 << 20
#: Items that are scored together.
GROUP = 256
#: Tiers are cut between impacts that differ in the bits above these.
LEVEL_BITS = 14
#: An item is proved by completing documents only where its bound is so small a share of the last score
#: that counts; else too many documents could still come in, and reading the next tier costs less.
SHARE = 0.5
#: Rows of term tables that may be sent to all tasks; larger ones are joined by a shuffle.
SENT = 1 << 17

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ENTRIES = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def terms_of(text: Column) -> Column:
    """Terms of a text, lower-cased in A-Z only; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), lambda t: t != "")


def _count(text: Column) -> Column:
    """How many terms a text has, without making them: pieces between breaks, less empty ones at the ends."""
    empty = lambda ts, at: F.when(F.element_at(ts, at) == "", 1).otherwise(0)
    return let(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda ts: F.size(ts) - empty(ts, 1) - F.when(F.size(ts) > 1, empty(ts, -1)).otherwise(0))


def length_parts(n: list[int], documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms, where `documents` hold `terms` in all."""
    return np.array([50 + 50 * x * documents // terms if terms else 50 for x in n], np.int64)


def _weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * df.cast("double") + 1.0))).cast("long")


def _indexed(documents: int, terms: int, segment: int, segment_bytes: int):
    """(segment, term, docs, impacts, ids) of each run of documents; ids stand in a row of their own without a term."""

    def entries(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        codes: dict[bytes, int] = {}
        code, tf, own = [], [], []
        sizes: list[int] = []
        for text in texts:
            found = Counter(_TERM.findall(text.translate(_LOWER)))
            sizes.append(found.total())
            own.append(len(found))
            code += [codes.setdefault(w, len(codes)) for w in found]
            tf += found.values()
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), own)
        tf, code = np.array(tf, np.int64), np.array(code, np.int64)
        add = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(length_parts(sizes, documents, terms), own))
        order = np.argsort(code, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(codes))), [len(code)])).astype(np.int32)
        none = np.zeros(len(codes) + 2, np.int32)
        none[-1] = len(ids)
        lists = [pa.ListArray.from_arrays(ends, pa.array(values[order].astype(np.int32))) for values in (doc, add)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes) + 1, number)), pa.array([*(w.decode() for w in codes), None], pa.string()), *lists, pa.ListArray.from_arrays(none, pa.array(ids, pa.int64()))], schema=_ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, texts, size = [], [], 0
                for row in range(at, min(at + segment, batch.num_rows)):
                    text = (batch.column(1)[row].as_py() or "").encode()
                    if texts and size + len(text) > segment_bytes:
                        break
                    ids.append(batch.column(0)[row].as_py())
                    texts.append(text)
                    size += len(text)
                yield entries(number, ids, texts)
                number, at = number + 1, at + len(texts)

    return run


@dataclass
class Index:
    """The tables of a tiered index.

    places:   (segment, ids): the documents of each segment in order.
    weights:  (term, w, residuals): residuals[j] is the term's largest impact beyond tier j; null where tier 0 has all.
    postings: (segment, term, docs, impacts, tier), a folder a tier.
    """

    documents: int
    terms: int
    tiers: int
    places: DataFrame
    weights: DataFrame
    postings: DataFrame


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """df to be sent to all tasks if its rows, counted, are few enough."""
    return F.broadcast(df) if rows <= SENT else df


def build(docs: DataFrame, *, key: str = "doc_id", text: str = "text", first: int = FIRST, growth: int = GROWTH, segment: int = SEGMENT, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """The index of all rows of docs.

    Null texts, and texts without terms, have no postings. Texts are read whole. A repeated row, or
    another row of the same key, is another document; a null key stays null. Keys are whole numbers;
    other columns are ignored; an empty table gives an empty index.
    """
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sizes = given.select(_count(F.col("text")).alias("n"))
    documents, terms = sizes.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = "segment bigint, term string, docs array<int>, impacts array<int>, ids array<bigint>"
    with scratch(docs.sparkSession):
        entries = written(given.mapInArrow(_indexed(documents, terms, segment, segment_bytes), kinds))
        places = written(entries.filter("term IS NULL").select("segment", "ids"), keep=True)
        entries = entries.filter("term IS NOT NULL").select("segment", "term", "docs", "impacts")
        counts = written(entries.groupBy("term").agg(F.sum(F.size("docs")).alias("df")))
        often = counts.filter(F.col("df") > first)
        n_often, most = often.agg(F.count("*"), F.max("df")).first()
        limits = [first]
        while most and limits[-1] < most:
            limits.append(limits[-1] * growth)
        # levels of impact from above, each in the tier where the postings down to it fit
        own = entries.join(_checked(often.select("term"), n_often), "term", "left_semi")
        levels = own.select("term", F.explode("impacts").alias("impact")).groupBy("term", F.shiftright("impact", LEVEL_BITS).alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
        down = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
        tier = sum((F.when(F.col("sofar") > limit, 1).otherwise(0) for limit in limits[:-1]), F.lit(0))
        placed = levels.withColumn("sofar", F.sum("n").over(down)).withColumn("tier", tier)
        parts = written(placed.groupBy("term", "tier").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.max("top").alias("top")))
        # a term has at most as many parts as there are tiers
        cuts = parts.groupBy("term").agg(F.collect_list(F.struct("tier", "low", "high", "top")).alias("cuts"))
        beyond = lambda j: F.coalesce(F.array_max(F.transform(F.filter("cuts", lambda c: c["tier"] > j), lambda c: c["top"])), F.lit(0)).cast("long")
        residuals = cuts.select("term", F.array(*map(beyond, range(len(limits)))).alias("residuals"))
        weights = written(counts.join(residuals, "term", "left").select("term", "df", _weight(F.col("df"), documents).alias("w"), "residuals"), keep=True)
        split = entries.join(_checked(cuts, n_often), "term", "left")
        whole = F.array(F.struct(F.lit(0).alias("tier"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(None).cast("int").alias("top")))
        each = split.select("segment", "term", "docs", "impacts", F.explode(F.coalesce("cuts", whole)).alias("c"))
        inside = lambda v: F.shiftright(v, LEVEL_BITS).between(F.col("c.low"), F.col("c.high"))
        # most terms are rare and have one tier; their entries stay as they are
        all_of = F.col("c.low").isNull()
        some_docs = F.when(all_of, F.col("docs")).otherwise(F.filter("docs", lambda d, i: inside(F.get("impacts", i))))
        some_impacts = F.when(all_of, F.col("impacts")).otherwise(F.filter("impacts", inside))
        postings = written(each.select("segment", "term", some_docs.alias("docs"), some_impacts.alias("impacts"), F.col("c.tier").alias("tier")).filter(F.size("impacts") > 0), keep=True, by=("tier",))
    return Index(documents, terms, len(limits), places, weights, postings)


class _Best:
    """The best `most` documents of each item so far: scores downwards, then ids upwards, null ids last."""

    def __init__(self, most: int):
        self.most, self.rows = most, {}

    def least(self, q: int) -> int:
        """A score under which nothing counts any more."""
        found = self.rows.get(q)
        return int(found[0][-1]) if found is not None and len(found[0]) == self.most else 1

    def add(self, q: int, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        cols = (scores, nulls, ids)
        if q in self.rows:
            cols = tuple(np.concatenate(pair) for pair in zip(self.rows[q], cols))
        order = np.lexsort((cols[2], cols[1], -cols[0]))[: self.most]
        self.rows[q] = tuple(c[order] for c in cols)

    def batch(self) -> pa.RecordBatch:
        q = np.repeat(np.array(list(self.rows), np.int64), [len(r[0]) for r in self.rows.values()])
        scores, nulls, ids = (np.concatenate(c) for c in zip(*self.rows.values())) if self.rows else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores), pa.array(ids, mask=nulls)], ["q", "score", "doc_id"])


def _pieces(batch: pa.RecordBatch, name: str, child: str | None = None) -> list[np.ndarray]:
    """The lists of a column as slices of one array."""
    lists = batch.column(batch.schema.get_field_index(name))
    values = lists.values if child is None else lists.values.field(child)
    ends = lists.offsets.to_numpy()
    values = values.fill_null(0).to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(group, segment, ids or None, [(docs, impacts, q, w, rest, need)]) of each segment in a group; rows come in this order."""
    held, ids, parts = None, None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        heads = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        ids_of = {int(row): batch.column(2)[row].values for row in heads}
        docs, adds = _pieces(batch, "docs"), _pieces(batch, "impacts")
        asks = [_pieces(batch, "asked", c) for c in ("q", "w", "rest", "need")]
        for row, key in enumerate(keys):
            if key != held:
                if held:
                    yield *held, ids, parts
                held, ids, parts = key, None, []
            if row in ids_of:
                ids = ids_of[row]
            else:
                parts.append((docs[row], adds[row].astype(np.int64), *(a[row] for a in asks)))
    if held:
        yield *held, ids, parts


def _sums(parts: list[tuple], documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, scores, rests, need): per item and document what was met adds, and what the met terms could have added in lower tiers at most."""
    items, places = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    scores, rests, need = np.zeros((len(items), documents), np.int64), np.zeros((len(items), documents), np.int64), np.zeros(len(items), np.int64)
    at = 0
    for docs, adds, q, w, rest, limit in parts:
        rows = places[at : at + len(q)]
        at += len(q)
        cells = np.ix_(rows, docs)
        scores[cells] += w[:, None] * adds
        if rest.any():
            rests[cells] += rest[:, None]
        need[rows] = limit
    return items, scores, rests, need


def _best_of(most: int):
    """(q, score, doc_id): the best documents of each item in a task, by what was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best = None, _Best(most)
        for g, _, ids, parts in _segments(batches):
            if g != group:
                yield best.batch()
                group, best = g, _Best(most)
            if not parts:
                continue
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            items, scores, _, _ = _sums(parts, len(ids))
            for q, row in zip(items.tolist(), scores):
                found = np.flatnonzero(row >= best.least(q))
                if len(found) > most:
                    found = found[row[found] >= np.partition(row[found], -most)[-most]]
                if len(found):
                    best.add(q, row[found], nulls[found], numbers[found])
        yield best.batch()

    return run


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, segment, doc, score, doc_id): documents that may still reach what their item needs."""
    for _, segment, ids, parts in _segments(batches):
        if not parts:
            continue
        items, scores, rests, need = _sums(parts, len(ids))
        rows, docs = np.nonzero((scores - rests >= need[:, None]) & (scores > 0))
        yield pa.RecordBatch.from_arrays([pa.array(items[rows]), pa.array(np.full(len(rows), segment)), pa.array(docs.astype(np.int32)), pa.array(scores[rows, docs]), ids.take(pa.array(docs))], ["q", "segment", "doc", "score", "doc_id"])


def _met(index: Index, tier: int, asked: DataFrame, n_asked: int, groups: int) -> DataFrame:
    """(grp, segment, ids, docs, impacts, asked): segments of the tiers down to `tier` with who asks for their terms, in groups of items."""
    # a group has about GROUP items
    wants = asked.groupBy("term", "grp").agg(F.collect_list(F.struct("q", "w", "rest", "need")).alias("asked"))
    rows = index.postings.filter(F.col("tier") <= tier).join(_checked(wants, n_asked), "term").select("grp", "segment", F.lit(None).cast("array<bigint>").alias("ids"), "docs", "impacts", "asked")
    kind = rows.schema["asked"].dataType
    heads = index.places.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "segment", "ids", F.array().cast("array<int>").alias("docs"), F.array().cast("array<int>").alias("impacts"), F.array().cast(kind).alias("asked"))
    return heads.unionByName(rows).repartition("grp", "segment").sortWithinPartitions("grp", "segment")


def _ranked(scores: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _completed(index: Index, tier: int, able: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """able (q, segment, doc, score, doc_id) with what lower tiers add."""
    lower = index.postings.filter(F.col("tier") > tier).join(_checked(asked.select("term").distinct(), n_asked), "term", "left_semi").drop("tier")
    missing = able.select("q", "segment", "doc").join(asked.select("q", "term", "w"), "q")
    at = F.array_position("docs", F.col("doc"))
    more = lower.join(missing, ["term", "segment"]).filter(at > 0).select("q", "segment", "doc", (F.col("w") * F.element_at("impacts", at.cast("int"))).alias("add"))
    more = more.groupBy("q", "segment", "doc").agg(F.sum("add").alias("add"))
    return able.join(more, ["q", "segment", "doc"], "left").select("q", "doc_id", (F.col("score") + F.coalesce("add", F.lit(0))).alias("score"))


def search(index: Index, items: DataFrame, *, key: str = "item_id", text: str = "text", most: int = TOP, group: int = GROUP) -> DataFrame:
    """(key, rank, doc_id, score, tier): the `most` best documents of each item, exact; tier is the last one its proof needed.

    A term counts once however often the item has it. Documents without a common term, or whose
    score is 0, have no rank. Of equal scores the smaller doc_id comes first, null last; documents
    that share an id have ranks of their own. Rows of one key and text are one item; another text
    under the same key, or under a null one, is another item. Null and empty texts find nothing.
    """
    with scratch(items.sparkSession):
        named = items.select(F.col(key).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
        named = written(named.withColumn("q", F.monotonically_increasing_id()))
        groups = max(1, -(-named.count() // group))
        words = named.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("grp"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
        asked = written(words.join(index.weights, "term").filter("w > 0").select("q", "grp", "term", "w", "residuals"))
        n_asked, done, left = asked.count(), None, asked.select("q").distinct()
        for tier in range(index.tiers):
            rest = F.col("w") * F.coalesce(F.get("residuals", F.lit(tier)), F.lit(0))
            now = asked.join(left, "q", "left_semi").withColumn("rest", rest)
            bounds = now.groupBy("q").agg(F.sum("rest").alias("bound"))
            met = _met(index, tier, now.withColumn("need", F.lit(0).cast("long")), n_asked, groups)
            best = written(_ranked(met.mapInArrow(_best_of(most), "q bigint, score bigint, doc_id bigint"), most))
            last = best.filter(F.col("rank") == most).select("q", F.col("score").alias("last"))
            # nothing was left out, or nothing that was not met can come in, by far
            proof = written(bounds.join(last, "q", "left").filter((F.col("bound") == 0) | (F.col("last") * SHARE > F.col("bound"))))
            whole = best.join(proof.filter("bound = 0"), "q", "left_semi").select("q", "rank", "doc_id", "score")
            open_ended = proof.filter("bound > 0")
            if not open_ended.isEmpty():
                late = written(now.join(open_ended, "q").withColumn("need", F.col("last") - F.col("bound")))
                able = written(_met(index, tier, late, n_asked, groups).mapInArrow(_able, "q bigint, segment bigint, doc int, score bigint, doc_id bigint"))
                whole = whole.unionByName(_ranked(_completed(index, tier, able, late, n_asked), most).select("q", "rank", "doc_id", "score"))
            found = whole.withColumn("tier", F.lit(tier))
            done = found if done is None else done.unionByName(found)
            left = written(left.join(proof, "q", "left_anti"))
            if left.isEmpty():
                break
        if done is None:
            done = named.select("q", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("tier")).limit(0)
        return written(done.join(named.select("q", F.col("item").alias(key)), "q").select(key, "rank", "doc_id", "score", "tier"), keep=True)
