"""Mixture-controlled packing: deficit round-robin over the sources' queues.

The token stream is a row of windows. In each window a source earns a quantum of tokens, its target
share of the window; it sends whole documents in queue order while its credit lasts and carries the
rest to the next window. Credit that is carried makes the rule a closed form: a document whose queue
position ends at token e goes to window ceil(e / quantum) - 1. So no task replays a queue: positions
are running totals of blocks, the windows' places are a running total of windows, and the documents
are laid end to end and cut every `length` tokens, which leaves padding in the last sequence only.

Defined results: a null or empty text is its end token alone; a null source is a queue of its own;
repeated rows are packed once each; a source without target share in `weights` has share 0 there and
goes to the windows after all others'; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import running_total, stash, table

LENGTH = 4096
#: Sequences in a mixture window.
WINDOW = 64
END_ID = 2
#: Texts whose ids a task holds as Python objects, and sends back, at a time.
ROWS = 512


def _parts(batches):
    """The batches in parts of ROWS rows, so that what a task holds doesn't grow with the batches that it is given."""
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a document: row (a number of its own), doc_id, source, n (ids with the end token), ids (bytes, two for each id where the vocabulary allows)."""

    def run(batches):
        import pyarrow as pa

        from fieldloom.llm.tokens import word_tokenizer

        import numpy as np

        encode = word_tokenizer(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in _parts(batches):
            ids = [encode(t or "") + end for t in b.column(2).to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array([_narrow(x) for x in ids], pa.binary())], ["doc_id", "source", "n", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, source string, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _narrow(ids: bytes) -> bytes:
    """A leading byte tells whether two or four bytes an id follow."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 65536 else b"\x04" + ids


def _wide(ids: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


def lay_out(rows: DataFrame, window_tokens: int, weights: dict[str, float] | None = None) -> DataFrame:
    """row -> begin: where each document begins in the stream. rows: row, source, n."""
    queued = running_total(rows.select("row", "source", "n"), ["source"], "row", "n", "before")
    shares = rows.groupBy("source").agg(F.sum("n").cast("double").alias("share"))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        shares = shares.withColumn("share", F.coalesce(given[F.col("source")], F.lit(0.0)))
    whole = shares.agg(F.sum("share").alias("whole"))
    shares = shares.crossJoin(F.broadcast(whole)).select(F.col("source").alias("of"), (F.lit(float(window_tokens)) * F.col("share") / F.col("whole")).alias("quantum"))
    due = F.when(F.col("quantum") > 0, (F.ceil((F.col("before") + F.col("n")) / F.col("quantum")) - 1).cast("long")).otherwise(F.lit(1 << 50))
    placed = queued.join(shares, F.col("source").eqNullSafe(F.col("of"))).withColumn("window", due).select("row", "source", "n", "before", "window")
    placed = stash(placed, "placed")  # written, as what follows is, so that the windows' totals don't plan the documents' over and over
    from pyspark.sql import Window

    parts = stash(placed.groupBy("window", "source").agg(F.sum("n").alias("part"), F.min("before").alias("first")), "parts")
    inner = F.coalesce(F.sum("part").over(Window.partitionBy("window").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    windows = running_total(parts.groupBy("window").agg(F.sum("part").alias("size")), [], "window", "size", "base")
    parts = parts.withColumn("inner", inner).join(windows.select("window", "base"), "window")
    shifts = parts.select(F.col("window").alias("w"), F.col("source").alias("s"), (F.col("base") + F.col("inner") - F.col("first")).alias("shift"))
    at = placed.join(stash(shifts, "shifts"), (F.col("window") == F.col("w")) & F.col("source").eqNullSafe(F.col("s")))
    return at.select("row", (F.col("before") + F.col("shift")).alias("begin"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids (bytes, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    encoded = stash(encode_documents(docs, tokenizer, end_id), "encoded")
    begins = lay_out(encoded, length * window, weights)

    def cut(batches):
        import pyarrow as pa

        from fieldloom.llm.packing import _wide

        for b in _parts(batches):
            doc, source, ids, begin = (b.column(i).to_pylist() for i in range(4))
            out: list[list] = [[] for _ in range(8)]
            for i in range(len(doc)):
                whole = _wide(ids[i])
                n, at = len(whole) // 4, 0
                while at < n:
                    sequence, offset = divmod(begin[i] + at, length)
                    k = min(n - at, length - offset)
                    for column, v in zip(out, (doc[i], source[i], at, k, whole[4 * at : 4 * (at + k)], n, sequence, offset), strict=True):
                        column.append(v)
                    at += k
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    joined = encoded.join(begins, "row").select("doc_id", "source", "ids", "begin")
    return joined.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's pieces, with a check sum of their ids."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
