"""Token counts of whole texts by rank-synchronous array merging (``bytebpe``).

Defined cases: a null or empty text has no bytes and no tokens; special strings
inside a text count as one token each, as the library's default has it;
repeated rows are counted each; extra columns are ignored; texts of any length
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder, load_tables
from .words import read_columns

LIMIT = 512


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) with the byte-level BPE file at ``path``."""
    tables = load_tables(path)  # fixed size: one vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tables)
        for batch in batches:
            ids, n_bytes, text = read_columns(batch, "doc_id", "n_bytes", "text")
            n = bpe.counts(text)
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
