"""Token counts: Arrow batches in, lengths out.

Runs of texts are balanced by bytes, long texts are cut at safe boundaries, and each distinct piece
of a run is encoded once (see ``pieces``). Null texts count as empty: no bytes, no tokens. Repeated
rows give repeated results, an empty table an empty one; other columns do not pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.pieces import Encoded, model, runs

LIMIT = 4096


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens by the vocabulary file at ``path``, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            counts = np.concatenate([np.zeros(0, np.int64), *(Encoded(m, part).lengths() for part in runs(b.column("text")))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), size.alias("n_bytes"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
