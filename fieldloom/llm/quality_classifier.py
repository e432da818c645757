"""Quality classifier: labelled latent-semantic vectors vote for their neighbours.

Terms are trigrams of character classes (letters by case, digits, each mark, white space) and how well
the text compresses, weighted by tf-idf. A truncated singular value decomposition of a bounded sample
of labelled documents gives the latent space; every document's whole text is projected into it, its
cosine with all labelled vectors is an exact product of blocks, and the nearest ones vote, weighted by
similarity. `sample` bounds the labelled rows, hence the vectors that are broadcast (sample x rank
floats); it is the only bound, every document is scored against all of them.

Defined results: a null or empty text is scored like any other (its vector is zero, so it gets the
labels' mean); without any labelled document every score is 0.5; rows with a null label or id teach
nothing; repeated rows are scored alike; the input's other columns are never inputs.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 24
THRESHOLD = 0.3
FOLDS = 5
TERMS = 1024
#: One-hot steps of the compression ratio, each with this weight among the trigrams.
STEPS, STEP_WEIGHT = 24, 0.5
BLOCK = 512

_CLASS = np.full(256, 31, np.uint32)
_CLASS[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
for _i, _c in enumerate(b".,;:!?'\"()-_#*$%&|<>/=+@"):
    _CLASS[_c] = 6 + _i


def term_weights(text: str | None) -> np.ndarray:
    """Logarithmic term counts of one whole text, of unit length; zero for an empty one."""
    out = np.zeros(TERMS + STEPS, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) < 3:
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    key = (c[:-2] << 10) | (c[1:-1] << 5) | c[2:]
    counts = np.bincount((key * np.uint32(2654435761)) >> np.uint32(22), minlength=TERMS)
    tf = np.log1p(counts).astype(np.float32)
    out[:TERMS] = tf / np.linalg.norm(tf)
    step = int(STEPS * len(zlib.compress(raw, 1)) / (len(raw) + 16))
    out[TERMS + min(step, STEPS - 1)] = STEP_WEIGHT
    return out / np.linalg.norm(out)


def is_held_out(doc_id: str):
    """The rows that never teach: crc32 of the id's text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Term weights and labels of at most `sample` labelled documents, chosen by a hash of their ids."""
    ids = labels.filter(~is_held_out("doc_id") & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    known = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")  # at most `sample` rows

    def weigh(batches):
        import pyarrow as pa

        for b in batches:
            rows = [term_weights(t).astype("<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["y", "x"])

    rows = sorted((r["x"], r["y"]) for r in known.mapInArrow(weigh, "y double, x binary").collect())
    if not rows:
        return np.zeros((0, TERMS + STEPS), np.float32), np.zeros(0, np.float32)
    return np.stack([np.frombuffer(x, "<f4") for x, _ in rows]), np.array([y for _, y in rows], np.float32)


class Voters:
    """The labelled documents in the latent space; small enough to travel with the tasks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> None:
        self.y, self.neighbours = y, min(neighbours, len(y))
        self.prior = float(y.mean()) if len(y) else 0.5
        if not len(y):
            return
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        weighted = x * self.idf
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, np.argsort(-values)[:rank]], np.float32)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among each row's nearest labelled vectors."""
        if not len(self.y):
            return np.full(len(x), self.prior)
        cosine = self.project(x) @ self.vectors.T
        k = self.neighbours
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near_cosine = np.take_along_axis(cosine, near, axis=1)
        weight = np.exp(30.0 * (near_cosine - near_cosine.max(axis=1, keepdims=True)))
        out = (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(x.any(axis=1), out, self.prior)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with score: 0 to 1, higher where label 1 is likelier, in place of a column of that name. docs needs doc_id and text."""
    voters = Voters(*labelled_sample(docs.select("doc_id", "text"), labels, label, sample))
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema
    names = docs.columns

    def vote(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(names.index("text"))
            parts = []
            for i in range(0, b.num_rows, BLOCK):
                parts.append(sent.value.score(np.stack([term_weights(t) for t in text.slice(i, BLOCK).to_pylist()])))
            score = np.clip(np.round(np.concatenate(parts).astype(np.float64), 6), 0, 1) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*names, "score"])

    return docs.mapInArrow(vote, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
