"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are counted over all texts, each task adding up what it meets. Every word, between two end marks,
is then cut into grams of 2 to QMAX letters. A gram dictionary prunes by frequency: a gram is extended by
a letter only where more than a threshold of words hold it, so grams are as short as they can be while
their lists stay short. At each place of a word the longest gram of the dictionary is taken, unless one
that began earlier covers it. One edit affects only the grams whose choice looks at the place of the
edit; the most that any single place affects is the word's bound. Two words one edit apart share all
grams of either but its bound, so lists need merging only for each word's bound + 1 rarest grams, and
what meets there is verified by its edit distance.

Pairs are sought by the shorter word's length (a class): grams of a class have at most half of the shorter
padded word's letters, so that the first and the last gram never look at the same place, and every
word keeps a gram whatever the edit: the search is exact. Words beyond LONG letters use their first and
last SIDE letters, of which one edit leaves one side whole.

The frequent grams are broadcast; their number is bounded by DICTIONARY, since the threshold doubles until
no more remain. Lists of frequent grams are joined by Spark, which splits skewed ones.

Defined results: a null text has no words, a null id reads as an empty one; repeated rows count as often
as they occur; of equally frequent near words the smallest in code-point order is the form; an empty
table gives no rows; a text or a run of any length is read whole; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, UPPER, stash, table, unstash
from .merkle_manifest import CRC_TABLE, crc_sql

SHORTEST, LEAST = 5, 3
#: One distinct run in so many, by its document, loses a letter before it is counted.
SPOIL = 97
#: Longest gram, the frequency from which a gram is extended, and the most frequent grams that are broadcast.
QMAX, FREQUENT, DICTIONARY = 6, 64, 1 << 18
LONG, SIDE = 64, 32
#: A form is this many times as frequent as the word.
RATIO = 2
#: Distinct words that a counting task holds before it hands them on.
HELD = 1 << 18

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: In UTF-8 the letters beyond ASCII, U+00C0 to U+00FF, all begin with C3; other characters end a run.
_OTHERS = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")
_CLASS_BITS, _MOST_CLASS = 48, (1 << 15) - 1


def runs(text: bytes) -> Counter:
    """How often each lower-cased run of letters occurs in a UTF-8 text."""
    if not text.isascii() and _OTHERS.search(text):
        text = _OTHERS.sub(b" ", text)
    return Counter(text.translate(_LETTERS).split())


def spoiled(run: bytes, start: int) -> bytes:
    """The run, without one letter where the hash of document and run says so; `start` is the check sum of the id and a colon."""
    h = zlib.crc32(run, start)
    if h % SPOIL:
        return run
    letters = run.decode("utf-8", "ignore")
    at = h % max(len(letters), 1)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of every run of at least SHORTEST letters that occurs LEAST times or more. docs needs doc_id and text."""

    def count(batches):
        import pyarrow as pa

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "ignore") for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        held: dict[bytes, int] = {}
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in runs(text or b"").items():
                    if len(run) >= SHORTEST:
                        word = spoiled(run, start)
                        if len(word) - word.count(b"\xc3") >= SHORTEST:
                            held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _sides(letters: np.ndarray, size: int) -> list[np.ndarray]:
    """Words of one length (a row each), between end marks: whole, or their two ends in a class of long ones."""
    ends = np.ones((len(letters), 1), np.int64)
    padded = np.hstack([ends, letters, 2 * ends])
    return [padded] if size <= LONG else [padded[:, :SIDE], padded[:, -SIDE:]]


def _longest(size: int) -> int:
    return min(QMAX, (size + 2) // 2)


def _grams(side: np.ndarray, size: int):
    """(q, keys): of each gram length, the grams at every place as numbers: the letters' codes below the class."""
    key = side.copy()
    for q in range(2, _longest(size) + 1):
        key = (key[:, :-1] << 8) | side[:, q - 1 :]
        yield q, key | (min(size, _MOST_CLASS) << _CLASS_BITS)


def _by_length(words: list[str]):
    """(length, rows, letters) of the words of each length."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), rows, np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size).astype(np.int64)


def _classes(size: int) -> list[int]:
    """The classes that a word belongs to: as the shorter or an equal one, and as the longer one."""
    return [c for c in (size, size - 1) if c >= SHORTEST]


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, f: how often each gram of each class occurs in the words."""

    def count(batches):
        import pyarrow as pa

        for b in batches:
            keys = [k.ravel() for size, _, letters in _by_length(b.column(0).to_pylist()) for c in _classes(size) for side in _sides(letters, c) for _, k in _grams(side, c)]
            if keys:
                gram, f = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(f.astype(np.int64))], ["gram", "f"])

    return words.select("word").mapInArrow(count, "gram long, f long").groupBy("gram").agg(F.sum("f").alias("f"))


def dictionary(words: DataFrame, frequent: int = FREQUENT, most: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """The frequent grams, sorted, and their frequencies; the threshold is `frequent`, doubled until at most `most` grams exceed it."""
    counts = stash(gram_counts(words).filter(F.col("f") > frequent), "grams")
    doublings = F.floor(F.log2((F.col("f") - 1) / frequent)).cast("int").alias("k")  # f > frequent * 2 ** k
    by_power = {r["k"]: r["n"] for r in counts.groupBy(doublings).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a power of two
    k = 0
    while sum(n for p, n in by_power.items() if p is not None and p >= k) > most:
        k += 1
    kept = counts.filter(F.col("f") > frequent * 2**k).toArrow()
    gram, f = kept.column("gram").to_numpy(), kept.column("f").to_numpy()
    order = np.argsort(gram)
    unstash(counts)
    return gram[order], f[order]


def _chosen(side: np.ndarray, size: int, grams: np.ndarray, counts: np.ndarray):
    """keys, frequencies, chosen (each a row a word, a column a place) and the first and last place that each choice looks at."""
    n, places = side.shape[1], side.shape[1] - 1
    q_of = np.full((len(side), places), 2, np.int64)
    key_of, f_of = None, None
    for q, keys in _grams(side, size):
        if len(grams):
            at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            f = np.where(grams[at] == keys, counts[at], 0)
        else:
            f = np.zeros_like(keys)
        if q == 2:
            key_of, f_of = keys.copy(), f
        else:
            w = keys.shape[1]
            longer = (q_of[:, :w] == q - 1) & (f_of[:, :w] > 0)
            q_of[:, :w] += longer
            key_of[:, :w] = np.where(longer, keys, key_of[:, :w])
            f_of[:, :w] = np.where(longer, f, f_of[:, :w])
    begin = np.arange(places)
    end = begin + q_of
    reach = np.maximum.accumulate(end, axis=1)
    chosen = np.ones_like(q_of, bool)
    chosen[:, 1:] = end[:, 1:] > reach[:, :-1]
    longest = _longest(size)
    return key_of, f_of, chosen, np.maximum(end - longest, 0), np.broadcast_to(np.minimum(begin + longest - 1, n - 1), end.shape)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(letters: np.ndarray, size: int, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length in one class: their tokens, rarest first, and how many of them need merging.

    A token is a gram, the side that it is of, and how many of its kind come before it in the word.
    """
    tokens, freq, taken, sizes, bound = [], [], [], [], None
    sides = _sides(letters, size)
    for s, side in enumerate(sides):
        key, f, chosen, first, last = _chosen(side, size, grams, counts)
        before = np.zeros_like(key)
        for p in range(1, key.shape[1]):
            for e in range(p):
                before[:, p] += chosen[:, e] & (key[:, e] == key[:, p])
        tokens.append(_mixed(_mixed(key) + (2 * before + s).astype(np.uint64)))
        freq.append(f)
        taken.append(chosen)
        sizes.append(chosen.sum(axis=1))
        if len(sides) == 1:
            rows, edge = np.arange(len(key)), np.zeros((len(key), side.shape[1] + 1), np.int64)
            for p in range(key.shape[1]):
                edge[rows, first[:, p]] += chosen[:, p]
                edge[rows, last[:, p] + 1] -= chosen[:, p]
            bound = np.cumsum(edge, axis=1).max(axis=1)
    if bound is None:
        bound = np.maximum(*sizes)
    token, f, take = np.hstack(tokens), np.hstack(freq), np.hstack(taken)
    f = np.where(take, f, np.iinfo(np.int64).max)
    order = np.argsort(token, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(f, order, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(token, order, 1).view(np.int64), np.minimum(bound + 1, sum(sizes))


def index(words: DataFrame, grams: np.ndarray, counts: np.ndarray) -> DataFrame:
    """token, shorter (the word has its class's length), word, n: the lists to merge."""
    sent = words.sparkSession.sparkContext.broadcast((grams, counts))

    def emit(batches):
        import pyarrow as pa

        for b in batches:
            rows_of, tokens_of, shorter = [], [], []
            for size, rows, letters in _by_length(b.column(0).to_pylist()):
                for c in _classes(size):
                    token, n = signature(letters, c, *sent.value)
                    keep = np.arange(token.shape[1]) < n[:, None]
                    rows_of.append(np.repeat(rows, n))
                    tokens_of.append(token[keep])
                    shorter.append(np.full(len(rows_of[-1]), c == size))
            if rows_of:
                at = pa.array(np.concatenate(rows_of))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens_of)), pa.array(np.concatenate(shorter)), b.column(0).take(at), b.column(1).take(at)], ["token", "shorter", "word", "n"])

    return words.select("word", "n").mapInArrow(emit, "token long, shorter boolean, word string, n long")


def near_words(words: DataFrame, frequent: int = FREQUENT, most: int = DICTIONARY) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, once, the shorter one or the smaller of two equally long ones first."""
    lists = stash(index(words, *dictionary(words, frequent, most)), "lists")
    a, b = lists.filter("shorter").alias("a"), lists.alias("b")
    met = (F.col("a.token") == F.col("b.token")) & (~F.col("b.shorter") | (F.col("a.word") < F.col("b.word")))
    pairs = a.join(b, met & (F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form: the end of its chain, by doubling. Chains are short: a form is RATIO times as frequent."""
    reached = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("of"), F.col("root").alias("further"))
        step = stash(reached.join(on, F.col("root") == F.col("of"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("of").isNotNull().alias("moved")), "roots")
        unstash(reached)
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        reached = step.drop("moved")


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words (word, n)."""
    pairs = stash(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"), best)
    enough = -F.col("best.less") >= RATIO * F.col("own")
    found = stash(found.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    known = found.join(last_forms(found.filter("form is not null")), "word", "left")
    return words.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every word of the documents with its form and root."""
    return group(stash(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")), "words"))


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: near words by the words' deletions."""
    text = "(coalesce(doc_id::VARCHAR, '') || ':' || run)"
    # Letters beyond ASCII are U+00C0 to U+00FF: C3 and a second byte in UTF-8.
    bytes_of = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN ord(substr({text}, i::INT, 1)) < 128 THEN [ord(substr({text}, i::INT, 1))::BIGINT] ELSE [195, ord(substr({text}, i::INT, 1))::BIGINT - 64] END))"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, k, {crc_sql(bytes_of)} AS h FROM each, crc),
seen AS (SELECT CASE WHEN h % {SPOIL} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM seen WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
less AS (SELECT gaps.word AS a, gaps.n AS an, words.word AS b, words.n AS bn FROM gaps JOIN words ON gaps.rest = words.word),
near AS MATERIALIZED (SELECT a, an, b, bn FROM less UNION SELECT b, bn, a, an FROM less UNION SELECT p.word, p.n, q.word, q.n FROM gaps p JOIN gaps q ON p.i = q.i AND p.rest = q.rest AND p.word <> q.word),
best AS (SELECT a, an, b, bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS rn FROM near),
forms AS MATERIALIZED (SELECT a AS word, n_near, CASE WHEN bn >= {RATIO} * an THEN b END AS form, CASE WHEN bn >= {RATIO} * an THEN bn END AS form_n FROM best WHERE rn = 1),
chain(word, at_) AS (SELECT word, word FROM words UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at_ WHERE forms.form IS NOT NULL),
roots AS (SELECT chain.word, chain.at_ AS root FROM chain ANTI JOIN (SELECT word FROM forms WHERE form IS NOT NULL) f ON f.word = chain.at_)
SELECT words.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN forms USING (word) JOIN roots USING (word)"""
