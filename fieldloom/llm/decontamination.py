"""Benchmark decontamination by template windows.

Both sides are reduced to templates: numbers, capitalised names and units become typed placeholders,
other words are case-folded. Every run of `window` template words is hashed; the windows of the
documents meet those of the benchmark items in a hash join, whatever the items' number. A fixed bitmap
of the items' hashes (BITS bits, whatever the input) travels to the scan of the documents so that only
windows with a set bit are shuffled; the join itself is exact. The values in the placeholders then
decide: along one alignment of document and item each value of the item must stand for one value of
the document and the other way round, so a question with other numbers or names is caught, and prose
that only shares a frame with inconsistent fillings is not.

What is a name depends on case, so each window has a second, case-free form in which names are words
like others: a copy in capitals, small letters or title case meets its item there. Both forms go
through the same join and each is judged on its own alignments; a window counts once, by either.

Defined results: null texts and texts without a word match nothing; an item with fewer words than a
window is one whole window, however short, in the case-free form only (no second window could
contradict a name); a window with fewer than `literals` plain words has no template, and one with fewer
than that besides its numbers and units keeps these as literals too; a copy in another case with other
names is found by the windows without such a name; repeated rows are each reported once per
(doc_id, item_id); empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

WINDOW = 8
LITERALS = 4
#: Matched windows that condemn a document: 13 words in a row, or as many scattered ones.
EVIDENCE = 6
#: Share of an alignment's value pairs that may contradict each other (a copy with a word or two changed).
TOLERANCE = 0.2
BITS = 1 << 20
#: Documents whose windows are hashed together.
TEXTS = 64
# Units of measure that a placeholder stands for.
UNITS = frozenset(
    "percent dollar dollars euro euros cent cents pound pounds kg g mg km m cm mm mile miles meter meters metre metres foot feet inch inches "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split()
)
WORDS = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*")
NUMBER, NAME, UNIT, LITERAL = 1, 2, 3, 0


#: The forms of a window, as bits: with names as placeholders, and case-free.
TEMPLATE, CASE_FREE = 1, 2


def word_kind(word: str) -> tuple[str, int]:
    """The word without its case, and its kind."""
    low = word.casefold()
    if word[0].isdigit():
        return low, NUMBER
    if low in UNITS:
        return low, UNIT
    if len(word) > 1 and word[0].isupper() and word[1:].islower():
        return low, NAME
    return low, LITERAL


class _Codes(dict):
    """word -> hash of the word without its case, with the kind in the low two bits; bounded."""

    def __missing__(self, word: str) -> int:
        low, kind = word_kind(word)
        code = (zlib.crc32(low.encode("utf-8", "replace")) << 2) | kind
        if len(self) < 300_000:
            self[word] = code
        return code


_codes = _Codes()
_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_IS = np.eye(4, dtype=bool)
#: What stands for a number, a name and a unit.
_PLACES = np.random.default_rng(9).integers(1, 1 << 63, 4, np.uint64)


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size`."""
    n = len(x) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h += x[j : j + n] * _FACTORS[j]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def window_forms(words: list[str], size: int, literals: int, template: bool) -> list[tuple[int, np.ndarray, np.ndarray, frozenset]]:
    """(forms, hashes, which windows have this form, kinds of the words that are its slots) of a text's windows; equal hashes of both forms are given once."""
    if len(words) < size:
        return []
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    kinds = (codes & np.uint64(3)).astype(np.int8)
    x = (codes >> np.uint64(2)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)

    def held(*which: int) -> np.ndarray:
        """How many words of these kinds are in each window."""
        c = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(_IS[list(which)].any(axis=0)[kinds], out=c[1:])
        return c[size:] - c[:-size]

    value = (kinds == NUMBER) | (kinds == UNIT)
    valued = np.where(value, _PLACES[kinds], x) if value.any() else x
    names = held(NAME)
    rest = size - held(NUMBER, UNIT)
    h = _rolled(valued, size)
    free = rest >= literals
    both = free & (names == 0) if template else np.zeros(len(h), bool)
    out = [(TEMPLATE | CASE_FREE, h, both, frozenset((NUMBER, UNIT))), (CASE_FREE, h, free & ~both, frozenset((NUMBER, UNIT)))]
    if not free.all():
        out.append((CASE_FREE, _rolled(x, size), ~free, frozenset()))
    if template and names.any():
        good = (rest - names >= literals) & (names > 0)
        out.append((TEMPLATE, _rolled(np.where(kinds == NAME, _PLACES[NAME], valued), size), good, frozenset((NUMBER, UNIT, NAME))))
    return out


def _windows(df: DataFrame, key: str, bitmap: tuple[np.ndarray, list[int]] | None, window: int, literals: int) -> DataFrame:
    """key, at, size, forms, hash, slots (the values in the window's placeholders, in order) and wid of every window whose bit is set.

    Without a bitmap (items) a text shorter than a window is one window; with one (documents) the short sizes beside it are tried too.
    wid is one number for all forms of a window.
    """

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64()]
        for b in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            out: list[list] = [[], [], [], [], [], [], []]
            keys, found = b.column(0).to_pylist(), [WORDS.findall(t or "") for t in b.column(1).to_pylist()]
            # Items one at a time, documents many at a time: their windows are those of one row of words that lie within one text.
            for first, texts in enumerate([[x] for x in found]) if bitmap is None else [(0, found)]:
                words = [w for x in texts for w in x]
                if not words:
                    continue
                lengths = np.array([len(x) for x in texts])
                text, begin = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
                for size in [min(window, len(words))] if bitmap is None else [window, *bitmap[1]]:
                    forms_found = window_forms(words, size, literals, size == window)
                    if not forms_found:
                        continue
                    if bitmap is None:
                        wid = np.zeros(len(words) - size + 1, np.int64)
                        for _, h, good, _ in forms_found:  # the template, where there is one, is the last
                            wid[good] = h[good]
                    within = text[size - 1 :] == text[: len(text) - size + 1]
                    for forms, h, good, kinds in forms_found:
                        at = np.flatnonzero(good & within)
                        if bitmap is not None:
                            bit = h[at].view(np.uint64) & np.uint64(BITS - 1)
                            at = at[((bitmap[0][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                        for i in at.tolist():
                            t = int(text[i])
                            slots = [word_kind(w)[0] for w in words[i : i + size] if _codes[w] & 3 in kinds]
                            for column, v in zip(out, (keys[first + t], i - int(begin[t]), size, forms, int(h[i]), slots, int(wid[i]) if bitmap is None else 0), strict=True):
                                column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [key, "at", "size", "forms", "hash", "slots", "wid"])

    plain = df.select(F.col(key).cast("long").alias(key), "text")
    return plain.mapInArrow(run, f"{key} long, at long, size int, forms int, hash long, slots array<string>, wid long")


def _bitmap(items: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """One bit for each residue of the items' hashes, and the sizes of items shorter than a window: at most window x BITS numbers reach the driver, in parts."""
    bits, sizes = np.zeros(BITS // 8, np.uint8), set()
    residues = items.select(F.col("hash").bitwiseAND(BITS - 1).cast("int").alias("r"), "size").distinct()
    for r in residues.toLocalIterator():
        bits[r["r"] >> 3] |= np.uint8(1 << (r["r"] & 7))
        sizes.add(r["size"])
    return bits, sorted(sizes - {window})


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, literals: int = LITERALS, evidence: int = EVIDENCE) -> DataFrame:
    """One row for each document and benchmark item that it gives away: doc_id, item_id, n_windows (of the item's, found), item_windows, n_changed (values that differ)."""
    known = _windows(items.select("item_id", "text"), "item_id", None, window, literals)
    is_template = F.col("forms").bitwiseAND(TEMPLATE) != 0
    sizes = known.groupBy("item_id").agg(F.count_distinct("wid").alias("item_windows"), F.count_distinct(F.when(is_template, F.col("wid"))).alias("item_templates"))
    found = _windows(docs.select("doc_id", "text"), "doc_id", _bitmap(known, window), window, literals)
    theirs = known.select("item_id", F.col("at").alias("item_at"), "size", F.col("forms").alias("item_forms"), "hash", F.col("slots").alias("item_slots"), F.col("wid").alias("item_wid"))
    met = found.drop("wid").join(theirs, ["hash", "size"]).withColumn("shift", F.col("at") - F.col("item_at"))
    shared = F.filter(F.array(F.lit(TEMPLATE), F.lit(CASE_FREE)), lambda x: F.col("forms").bitwiseAND(F.col("item_forms")).bitwiseAND(x) != 0)
    met = met.withColumn("form", F.explode(shared))
    # One alignment at a time, by one form: pairs of values that the placeholders hold on both sides.
    alignment = ["doc_id", "item_id", "shift", "form"]
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda z: z["i"].isNotNull())
    values = met.select(*alignment, "item_wid", F.explode_outer(pairs).alias("z")).select(*alignment, "item_wid", F.col("z.i").alias("i"), F.col("z.d").alias("d"))
    slots = values.groupBy(*alignment).agg(
        F.count_distinct("i").alias("n_i"),
        F.count_distinct("d").alias("n_d"),
        F.count_distinct("i", "d").alias("n_pairs"),
        F.count_distinct(F.when(F.col("i") != F.col("d"), F.col("i"))).alias("changed"),
        F.collect_set("item_wid").alias("wids"),  # at most the item's own windows
    )
    contradictions = F.col("n_pairs") - F.least("n_i", "n_d")
    consistent = slots.filter(contradictions <= F.lit(TOLERANCE) * F.col("n_pairs"))
    each = consistent.select("doc_id", "item_id", "form", "changed", F.explode("wids").alias("wid"))
    templates = F.count_distinct(F.when(F.col("form") == TEMPLATE, F.col("wid"))).alias("n_templates")
    total = each.groupBy("doc_id", "item_id").agg(F.count_distinct("wid").alias("n_windows"), templates, F.max("changed").alias("n_changed"))
    enough = (F.col("n_windows") >= F.least(F.lit(evidence), F.col("item_windows"))) | ((F.col("n_templates") > 0) & (F.col("n_templates") >= F.least(F.lit(evidence), F.col("item_templates"))))
    return total.join(sizes, "item_id").filter(enough).select("doc_id", "item_id", "n_windows", "item_windows", "n_changed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document that gives a benchmark item away."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
