"""Token counts by prefix dynamic programming: the exact count at every prefix, kept with the text.

Null text counts as empty. Any other column of the input is left out, so names can't clash. An empty table
gives an empty table. Long texts are worked on one at a time; memory is a few bytes a character.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import prefix_counts


def prefix_table(docs: DataFrame, path: str, budgets: tuple[int, ...] = (1024,), id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True) -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, steps, cuts.

    steps: the count's change at each code point as little-endian 16-bit integers; its running sum is the count at
    every prefix, which `tokens_at` and `longest_prefix` read, so that no text is encoded again.
    cuts: for each budget, the code points of the longest prefix with at most so many tokens (a later prefix may
    need fewer tokens than an earlier one; the longest counts).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(path)
        for batch in batches:
            rows = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                text = text or ""
                steps = counts.steps(text)
                upto = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
                n = int(upto[-1]) if len(upto) else 0
                cuts = [len(text) if n <= b else int(np.flatnonzero(upto <= b)[-1]) + 1 if upto[0] <= b else _last(upto, b) for b in budgets]
                for to, v in zip(rows, (len(text.encode()), n, steps if keep_steps else None, cuts), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.list_(pa.int64()))], [id_col, "n_bytes", "n_tokens", "steps", "cuts"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, steps binary, cuts array<long>")


def _last(upto: np.ndarray, budget: int) -> int:
    found = np.flatnonzero(upto <= budget)
    return int(found[-1]) + 1 if len(found) else 0


def tokens_at(steps: bytes, n_chars: int) -> int:
    """Tokens of a text's first n_chars code points."""
    return int(np.frombuffer(steps, "<i2")[:n_chars].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most budget tokens."""
    return _last(np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64), budget)
