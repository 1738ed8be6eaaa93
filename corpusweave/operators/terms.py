"""Many terms in many texts: one pass of an automaton over each text, whatever the number of terms.

The terms are a table. They are sent to the tasks in blocks of bounded size, each an Aho-Corasick
automaton that a worker builds once; a text meets every block in turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.functions.shared import written

#: Terms of a block, and of texts the rows that are Python objects at once.
BLOCK, ROWS = 200_000, 256
#: Automata that a worker has built, by the name of their block; few are in use at a time.
_BUILT: dict[str, ahocorasick.Automaton] = {}

HITS = "array<struct<ord:bigint,term:string,at:int>>"
_ARROW = pa.struct([("ord", pa.int64()), ("term", pa.string()), ("at", pa.int32())])


def automaton(rows: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """The automaton of (ord, term); terms are not empty."""
    found = ahocorasick.Automaton()
    for ord_, term in rows:
        found.add_word(term, (ord_, term))
    if rows:
        found.make_automaton()
    return found


def hits_in(text: str, found: ahocorasick.Automaton) -> list[dict]:
    """Each term of the automaton that stands in text, once, with its first place from 1, in order of ord."""
    first: dict[str, dict] = {}
    if len(found):
        for end, (ord_, term) in found.iter(text):
            if term not in first:
                first[term] = {"ord": ord_, "term": term, "at": end - len(term) + 2}
    return sorted(first.values(), key=lambda h: (h["ord"], h["term"]))


def _of(shared: Broadcast) -> ahocorasick.Automaton:
    name, rows = shared.value
    if name not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[name] = automaton(rows)
    return _BUILT[name]


def with_hits(texts: DataFrame, terms: DataFrame, *, text: str = "text", name: str = "hits", block: int = BLOCK) -> DataFrame:
    """texts with an array of (ord, term, at): the terms (ord, term) that each text contains, in order of ord, with their first places.

    Of equal terms the smallest ord counts; null and empty terms stand nowhere, null texts contain
    nothing. Comparison is exact, in code points. Every block of terms is one more pass over the texts.
    """
    rows = written(terms.filter(F.length("term") > 0).groupBy("term").agg(F.min(F.col("ord").cast("long")).alias("ord")))
    blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    spark = texts.sparkSession
    out, columns = texts, [F.col(c) for c in texts.columns]
    for number in range(blocks):
        # about `block` rows
        own = [(r["ord"], r["term"]) for r in placed.filter(F.col("block") == number).select("ord", "term").collect()]
        if not own and blocks > 1:
            continue
        shared, column = spark.sparkContext.broadcast((uuid.uuid4().hex, own)), f"__hits{number}"
        out = _passed(out, text, column, shared)
        columns.append(F.col(column))
    if len(columns) == len(texts.columns) + 1:
        return out.withColumnRenamed(out.columns[-1], name)
    found = [c for c in out.columns if c.startswith("__hits")]
    return out.select(*texts.columns, F.array_sort(F.concat(*found)).alias(name))


def _passed(texts: DataFrame, text: str, column: str, shared: Broadcast) -> DataFrame:
    at = texts.columns.index(text)
    schema = T.StructType([*texts.schema.fields, T.StructField(column, T.StructType.fromDDL(f"h {HITS}")["h"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                hits = [hits_in(t or "", found) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.list_(_ARROW))], schema.names)

    return texts.mapInArrow(run, schema)


def first_with(terms: DataFrame, texts: DataFrame, value: str, order: str, *, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(term, value): of the texts that contain a term, the value of the one that comes first by `order`; terms in no text are left out."""
    numbered = terms.select("term").distinct().withColumn("ord", F.lit(0))
    found = with_hits(texts.select(value, order, text), numbered, text=text, block=block)
    return found.select(value, order, F.explode("hits.term").alias("term")).groupBy("term").agg(F.min_by(value, order).alias(value))
