"""Token counts by offsets: a document is encoded once and its tokens are shared out to its sections.

The ids' byte lengths give every token's span in the UTF-8 text; the spans are interval-joined with
the sections' spans by binary search within the row. Sections tile the text, so each token starts in
exactly one. The rule for a token that crosses a boundary is explicit: `first` gives it to the section
of its first byte, `most` to the section with most of its bytes (the earlier one where equal).

Defined results: a null or empty text is one empty section without tokens; a section is a line with
its line feed, and a text that ends in one has no section after it; repeated rows are counted once
each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

RULES = ("first", "most")


def line_starts(raw: bytes) -> np.ndarray:
    """First bytes of the lines of a text."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate([[0], at])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def share_out(starts: np.ndarray, size: int, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross into or out of another one."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    bounds = np.concatenate([starts[1:], [size]])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.maximum(np.searchsorted(starts, ends - 1, "right") - 1, first)
    to = first
    crossing = last > first
    if rule == "most" and crossing.any():
        to = first.copy()
        for i in np.flatnonzero(crossing):
            s = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[s], ends[i]) - np.maximum(starts[s], begins[i])
            to[i] = s[int(np.argmax(held))]
    n = len(starts)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def count_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "first") -> DataFrame:
    """One row a section: doc_id, section, start and end (bytes), n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        import pyarrow as pa

        from fieldloom.llm.tokens import byte_encoding

        encoding, length_of = byte_encoding(ranks, pattern)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                lengths = length_of[np.array(encoding.encode_ordinary(text or ""), np.int64)]
                starts = line_starts(raw)
                n, crossing = share_out(starts, len(raw), lengths, rule)
                k = len(starts)
                ends = np.concatenate([starts[1:], [len(raw)]])
                for column, v in zip(out, ([doc] * k, range(k), starts, ends, n, crossing, [len(lengths)] * k), strict=True):
                    column.extend(v)
            names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the tokens of every line of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
