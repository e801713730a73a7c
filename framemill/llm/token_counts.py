"""Token counts without the tokens: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (see segments), so no very long text is encoded at once; a slab's distinct new segments go to the library in batches of about equal bytes, and only their lengths are kept. Texts without white space have no safe boundary and are encoded whole.

Null texts count as empty: no bytes, no tokens. Repeated rows are counted each. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .segments import segments
from .shared import text_slabs, texts_of

#: Bytes of a batch that goes to the library.
BATCH_BYTES = 128 << 10
#: Segments whose lengths a task remembers between slabs. It changes the speed only.
REMEMBERED = 400_000


def balanced(parts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about `most` bytes each; the longest parts come first, so that the last batch is no straggler."""
    batch, size = [], 0
    for s in sorted(parts, key=len, reverse=True):
        batch.append(s)
        size += len(s.encode())
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) by the byte-level BPE vocabulary in a tokenizers file."""
    df = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        known: dict[str, int] = {}
        for slab in text_slabs(batches):
            parts = [segments(t) for t in slab.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            for batch in balanced([s for s in {s for p in parts for s in p} if s not in known]):
                known.update(zip(batch, map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))))
            n = np.fromiter((sum(map(known.__getitem__, p)) for p in parts), np.int64, len(parts))
            size = pc.binary_length(slab.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([slab.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
