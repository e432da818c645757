"""Spelling variants against neighbourhoods by deletion, found in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import spelling_variants as S

SF = "/root/testdata/sf0.001"


def counted(docs):
    n = Counter()
    for i, text in docs:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}


def neighbours(words):
    near, gaps = {w: set() for w in words}, defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            gaps[k, shorter].add(w)
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for g in gaps.values():
        for w in g:
            near[w] |= g - {w}
    return near


def brute(n):
    near, form = neighbours(n), {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def _rows(df):
    return sorted(repr(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))) for r in df.collect())


def _same(df, n):
    assert _rows(df) == sorted(map(repr, brute(n)))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = counted(docs)
    assert len(n) > 1000
    _same(S.query(spark, SF), n)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (None, "Straße STRASSE strasse ÀÉÎõüŸabcde"), (None, "straße " * 4), (3, "Ωstraße× ÷straße; stráße"), (4, "hello_world hello2world HELLO " * 3), (5, "x" * 300 + " " + "x" * 299 + "\n" + "x" * 300), (5, ("x" * 300 + " ") * 3 + ("x" * 299 + " ") * 9), (5, "x" * 299 + "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("clash"))
    n = counted(docs)
    words = S.count_words(df)
    assert {r["word"]: r["n"] for r in words.collect()} == n and n
    _same(S.group(words), n)


def test_dense_words_ties_and_long_words(spark):
    """Few letters, so that words repeat their grams and have many near words; lengths about the limits of classes and sides."""
    rng = random.Random(5)
    n = {"".join(rng.choice("aaabé") for _ in range(rng.randint(5, 9))): rng.randint(3, 40) for _ in range(1500)}
    for size in (61, 62, 63, 64, 65, 66, 130):
        for _ in range(6):
            w = "".join(rng.choice("ab") for _ in range(size))
            for k in {0, 1, size // 2, size - 1, rng.randrange(size)}:
                for v in (w, w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "z" + w[k + 1 :]):
                    n[v] = rng.randint(3, 40)
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(5)
    _same(S.group(words), n)


def test_dictionary_limits_change_no_pair(spark):
    rng = random.Random(6)
    n = {"".join(rng.choice("abcde") for _ in range(rng.randint(5, 11))): 3 for _ in range(3000)}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    want = {frozenset((w, x)) for w, others in neighbours(n).items() for x in others}
    for frequent, most in ((1, 1 << 18), (4, 50), (10**6, 10)):
        grams, _ = S.dictionary(words, frequent, most)
        assert len(grams) <= most
        got = [frozenset((r["word"], r["near"])) for r in S.near_words(words, frequent, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bound_holds_for_every_edit():
    """A word and any word one edit away share a token among those that either merges."""
    rng = random.Random(7)
    text = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 12))) for _ in range(300)]
    keys = np.concatenate([k.ravel() for size, _, x in S._by_length(text) for c in S._classes(size) for side in S._sides(x, c) for _, k in S._grams(side, c)])
    grams, counts = np.unique(keys, return_counts=True)
    grams, counts = grams[counts > 3], counts[counts > 3]

    def merged(w, c):
        token, m = S.signature(np.frombuffer(w.encode("latin-1"), np.uint8)[None].astype(np.int64), c, grams, counts)
        return set(token[0, : m[0]].tolist())

    for w in text[:120]:
        for k in range(len(w)):
            for v in (w[:k] + "c" + w[k:], w[:k] + "z" + w[k:], w[:k] + "a" + w[k + 1 :], w[:k] + "z" + w[k + 1 :]):
                assert merged(w, len(w)) & merged(v, len(w))


def test_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from oracle import rows_of, sql_rows

    df = S.query(spark, SF)
    assert (sorted(df.columns), rows_of(df)) == sql_rows(S.oracle_sql(), SF)
