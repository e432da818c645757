"""Language identification by a byte convolutional network.

A text is lower-cased, everything but letters and marks beyond ASCII becomes single spaces, and its UTF-8
bytes are cut into windows of WINDOW. Bytes are embedded; filters of several widths slide over a window,
their maxima over the window go through a linear layer and a softmax. A text's probabilities are the
mean over all its windows, weighted by their letters. The network is trained in numpy on the driver,
with Adam, on windows of a bounded sample: at most PER_LANGUAGE documents of a language, those of
least hash, and at most SAMPLE in all, each with at most WINDOWS_EACH windows spread over its text. That
is the only bound: every window of every text is scored, in batches of fixed size.

Defined results: `und` with score 0 where the text is null or has no letter, or nothing was learned;
with one language learned the score is 1; rows with a null language or id teach nothing; of rows that
share an id the smallest text teaches; repeated rows get like results; an empty table gives no rows;
columns other than those named are passed through, or replaced where they are named lang_pred or score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table
from .quality_classifier import is_held_out

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
PER_LANGUAGE, SAMPLE, WINDOWS_EACH = 384, 4096, 6
SALTS = 32
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows that are scored at once.
BLOCK = 512
UNKNOWN = "und"

#: Letters, and a few numerals that aren't digits.
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters_of(text: str | None) -> bytes:
    """The bytes that the network reads; empty if the text has no letter."""
    if not text or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def windows_of(read: bytes) -> np.ndarray:
    """All windows, one after another, the last one filled with zeros."""
    n = -(-len(read) // WINDOW)
    return np.frombuffer(read.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """Embedding, filters of several widths, maxima, softmax.

    All filters share one matrix of the largest width's rows, in which a narrower filter's last rows stay
    zero; a window ends with zero bytes, so that every filter sees every place.
    """

    def __init__(self, languages: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.width, n = languages, max(WIDTHS), FILTERS * len(WIDTHS)
        self.used = np.zeros((self.width * EMBEDDING, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.used[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        filters = normal(self.width * EMBEDDING, n) * self.used / np.sqrt(self.used.sum(axis=0))
        self.p = {"embedding": normal(256, EMBEDDING) / 2, "filters": filters, "bias": np.zeros(n, np.float32), "out": normal(n, len(languages)) / 10, "out_bias": np.zeros(len(languages), np.float32)}

    def _places(self, windows: np.ndarray):
        """The filters' values at each place of all windows, place by place."""
        padded = np.vstack([windows.T, np.zeros((self.width - 1, len(windows)), np.uint8)])
        x = self.p["embedding"][padded]
        runs = np.empty((len(windows), self.width, EMBEDDING), np.float32)
        for t in range(len(windows.T)):
            runs[:] = x[t : t + self.width].transpose(1, 0, 2)
            yield runs.reshape(len(windows), -1) @ self.p["filters"]

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = None
        for y in self._places(windows):
            top = y if top is None else np.maximum(top, y, out=top)
        return self._softmax(np.maximum(top + self.p["bias"], 0))

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; only the maxima's places take part."""
        values = np.stack(list(self._places(windows)))
        at = values.argmax(axis=0)
        h = np.maximum(np.take_along_axis(values, at[None], 0)[0] + self.p["bias"], 0)
        d = self._softmax(h)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.p["out"].T) * (h > 0)
        padded = np.hstack([windows, np.zeros((len(windows), self.width - 1), np.uint8)])
        seen = np.take_along_axis(padded[:, None], at[:, :, None] + np.arange(self.width), 2)
        runs = self.p["embedding"][seen].reshape(*at.shape, -1)
        to = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBEDDING)
        embedding = np.zeros_like(self.p["embedding"])
        np.add.at(embedding, seen.ravel(), to)
        return {"out": h.T @ d, "out_bias": d.sum(axis=0), "bias": back.sum(axis=0), "filters": np.einsum("nf,nfk->kf", back, runs) * self.used, "embedding": embedding}

    def train(self, windows: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        total = max(1, EPOCHS * -(-len(y) // BATCH))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                rows, step = order[i : i + BATCH], step + 1
                rate = RATE * (1 - (step - 1) / total)
                for k, g in self.gradients(windows[rows], y[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability."""
        read = [letters_of(t) for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        pending, owners, held = [], [], 0

        def flush():
            x = np.concatenate(pending)
            weight = ((x != 32) & (x != 0)).sum(axis=1) + 1e-9
            np.add.at(total, np.repeat(*map(np.array, zip(*owners))), np.concatenate([self.probabilities(x[i : i + BLOCK]) * weight[i : i + BLOCK, None] for i in range(0, len(x), BLOCK)]))
            pending.clear()
            owners.clear()

        for i, r in enumerate(read):
            if r and self.languages:
                pending.append(windows_of(r))
                owners.append((i, len(pending[-1])))
                held += len(pending[-1])
                if held >= 16 * BLOCK:
                    flush()
                    held = 0
        if pending:
            flush()
        sums = total.sum(axis=1)
        best = total.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        known = sums > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        top = np.where(known, total.max(axis=1, initial=0) / np.where(known, sums, 1), 0)
        return names, np.clip(np.round(top, 6), 0, 1).tolist()


def sampled_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, window) of the documents that teach. docs needs doc_id, text and lang."""
    teach = docs.filter(~is_held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").distinct()
    h = F.xxhash64("doc_id")
    # The first ones of each of SALTS parts of a language first, so that no task orders all documents of a frequent one.
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(h, "doc_id"))
    parts = teach.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    few = parts.withColumn("nth", nth("lang", "part")).filter(F.col("nth") <= per_language)
    ids = few.withColumn("nth", nth("lang")).filter(F.col("nth") <= per_language).drop("part").orderBy("nth", h, "doc_id", "lang").limit(sample).drop("nth")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            lang, out = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = windows_of(letters_of(text))
                for i in sorted(set(np.linspace(0, len(x) - 1, WINDOWS_EACH).round().astype(int))) if len(x) else []:
                    lang.append(name)
                    out.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    # At most `sample` documents with WINDOWS_EACH windows each.
    return sorted((r["lang"], bytes(r["window"])) for r in texts.select("lang", "text").mapInArrow(cut, "lang string, window binary").collect())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Network:
    """The network that the labelled documents teach."""
    rows = sampled_windows(docs, per_language, sample)
    languages = sorted({name for name, _ in rows})
    network = Network(languages)
    if len(languages) > 1:
        number = {name: k for k, name in enumerate(languages)}
        network.train(np.stack([np.frombuffer(w, np.uint8) for _, w in rows]), np.array([number[name] for name, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """docs with lang_pred and score. docs needs text."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    kept = docs.drop("lang_pred", "score")
    names = kept.columns
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def score(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                lang, p = sent.value.score(part.column(names.index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
