"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary has a whitespace mark after another character, so no merge crosses
the place where a run of marks begins. A text is therefore cut there into marked words; each
distinct marked word is segmented once per worker (a bounded table), and the ids are joined
back by position. The table saves the segmentation, never a row: what it doesn't hold is
segmented again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=4)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    """One model per worker; refuses a model whose pieces can cross a mark."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace mark: distinct chunks would not be exact")
    for text in ("a", " a", "a  b ", "\ta　b"):
        if sp.decode(sp.encode(text)) != text:
            raise ValueError("this model rewrites texts before it cuts them: distinct chunks would not be exact")
    return sp


def marked_words(text: str) -> list[str]:
    """The marked words without their first mark, which the model puts there itself."""
    if text and text[0] != " " and MARK not in text and "  " not in text:
        return text.split(" ")
    return [w[1:] for w in MARKED_WORD.findall(MARK + text.replace(" ", MARK))] if text else []


class ChunkTable:
    """Marked word -> its ids as int32 bytes, at most `most` entries of at most `longest` characters."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, most: int = 1 << 18, longest: int = 64):
        self.sp, self.most, self.longest, self.ids = sp, most, longest, {}

    def encode(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """The ids of each text, followed by end."""
        words = [marked_words(t) for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.ids})
        if len(self.ids) + len(fresh) > self.most:
            self.ids.clear()
            fresh = list(set(chain.from_iterable(words)))
        self.ids.update((w, array("i", i).tobytes()) for w, i in zip(fresh, self.sp.encode(fresh, num_threads=1)))
        if "" in self.ids:  # a mark alone, as at the end of "a "; for the model "" has no mark
            self.ids[""] = array("i", [self.sp.piece_to_id(MARK)]).tobytes()
        out = [np.frombuffer(b"".join([*map(self.ids.__getitem__, ws), end]), np.int32) for ws in words]
        for w in fresh:
            if len(w) > self.longest:
                del self.ids[w]
        return out


def _encoder(model: str, add_eos: bool, decode: bool, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table, end = ChunkTable(sp), array("i", [sp.eos_id()] if add_eos else []).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = table.encode([t or "" for t in part.column(1).to_pylist()], end)
                starts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols = [part.column(0), pa.ListArray.from_arrays(starts, np.concatenate(ids))]
                if decode:
                    cols.append(pa.array([sp.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    return run


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", add_eos: bool = True, decode: bool = False, rows: int = 128) -> DataFrame:
    """(doc_id, ids[, decoded]) for each row of docs.

    model is a path that every worker can open. A null or empty text has only the end id; texts
    are encoded whole however long; repeated rows give repeated rows; a null key stays null;
    other columns of docs are ignored; an empty table gives an empty one.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([given.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decode:
        schema = schema.add("decoded", "string")
    return given.mapInArrow(_encoder(model, add_eos, decode, rows), schema)


def decode(encoded: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids", rows: int = 128) -> DataFrame:
    """(doc_id, decoded) by the library's decode; a null list gives an empty text."""
    given = encoded.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    schema = T.StructType([given.schema[0], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [sp.decode(i or []) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return given.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and digests of what encode(decode=True) gives."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
