"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.shared import scratch, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z only, so the bytes of other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that Python objects of few documents live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column with null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows kept away from training: crc32 of the id as text, modulo folds, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))
