"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assay.session import Scratch, cut_lineage, ensure_checkpoint_dir

__all__ = ["Scratch", "as_bytes", "cut_lineage", "each_bytes", "ensure_checkpoint_dir", "free_name", "shuffle_parts", "text_rows", "with_rows"]


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def each_bytes(column: pa.Array) -> Iterator[bytes]:
    """As ``as_bytes``, one text after the other, so that a task holds no second copy of a batch."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def with_rows(rows_of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn a function on one Arrow batch into one that ``mapInArrow`` takes."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield rows_of(batch)
    return run


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
