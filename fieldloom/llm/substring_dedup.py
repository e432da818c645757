"""Exact substring removal by a depth-limited radix sort of sampled suffixes.

Every byte that a `length`-byte string covers which also starts earlier (in a document with a smaller
id, or before it in the same one) is removed. Ordering all suffixes through that depth would shuffle
each byte's suffix, so the sort is of suffixes at content-chosen places: the positions whose KMER-byte
prefix has the least hash in some `length`-byte string around them. Equal strings choose equal places,
and each string has one, so nothing repeats that the sampled suffixes don't show. They are sorted by
most significant digits first, and what is alone after a pass leaves:

1. the digit of the first KMER bytes: suffixes alone with theirs leave;
2. all bytes within `length` of the place: of equal ones all but the earliest are wholly repeated
   (within a document this is seen while it is read, so a run of one byte gives few suffixes);
3. the earliest ones, where a KMER has several, by quarters of the strings around the place: those that
   agree with no other on the bytes that a quarter's strings have in common leave, and of those that
   agree on all bytes of its strings all but the earliest are repeated there;
4. the strings themselves, through `length` bytes: groups that are equal now are exactly the repeated
   strings, and all but the earliest are removed. A string is looked at from one place only, that of its
   least hash.

The first digit also deals the suffixes into SLICES parts, sorted one after another, so that the disk
holds one part's shuffles. Groups are counted and reduced to their minima by partial aggregates and
joined back, so a string that very many documents share is no task's load. Digits are 64-bit hashes; a
group agrees on two independent ones, of the first KMER bytes and of the digit's bytes.

Defined results: a null or empty text has 0 bytes, none removed; a text shorter than `length` is kept;
a null doc_id comes after all others; rows that share a doc_id (or have none) are documents of their own
where their texts differ, in the order of a hash of these, and one document where they are equal (each
row gets its result); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import may_hold, stash, table, unstash

LENGTH, KMER = 100, 32
QUARTERS = 4
#: Parts of the sort that follow each other.
SLICES = 2
#: A document: its id, and a hash of its text for those that share one.
DOCUMENT = ["d", "t"]
PLACE = [*DOCUMENT, "at"]
#: Bytes of a text that are hashed at a time; bounds a task's memory, not the text.
BLOCK = 1 << 20
LAST = (1 << 63) - 1

_random = np.random.default_rng(100)
_TABLE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    n = BLOCK + 8 * LENGTH
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for x in (_BASE, inverse):
        a = np.full(n, np.uint64(x), np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of each run of w values."""
    s = 1
    while 2 * s <= w:
        x = best(x[:-s], x[s:])
        s *= 2
    return best(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def places(raw: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of a text, the hash of the kmer there, and that of all bytes within `length` of it.

    A place is position << 16 | low << 8 | high: the strings that start low to high bytes before it are its own.
    """
    n, w = len(raw), length - kmer + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers()
    parts = []
    for begin in range(0, n, BLOCK):
        first, end = max(0, begin - 2 * length), min(n, begin + BLOCK + 2 * length)
        if end - first < length:
            continue
        b = np.frombuffer(raw, np.uint8, end - first, first)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[: len(b)], out=total[1:])
        h = _mix((total[kmer:] - total[:-kmer]) * down[: len(b) - kmer + 1])
        least = _sliding(h, w, np.minimum)
        most = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        at = np.flatnonzero(most == h)
        # Strings with one least hash are a run; unless hashes repeat nearby, runs and places pair off.
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        if len(starts) == len(at) and (h[at] == least[starts]).all():
            high, low = at - starts, at - (np.concatenate([starts[1:], [len(least)]]) - 1)
        else:
            low, high = np.zeros(len(at), np.int64), np.full(len(at), w - 1)
        inside = (at + first >= begin) & (at + first < begin + BLOCK)
        at, low, high = at[inside], low[inside], high[inside]
        s, e = np.maximum(at - (w - 1), 0), np.minimum(at + length, len(b))
        around = (total[e] - total[s]) * down[s] + ((at - s) * 1009 + (e - at)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((((at + first) << 16) | (low << 8) | high, h[at], _mix(around)))
    at, h, around = (np.concatenate(c) for c in zip(*parts, strict=True))
    return at.astype(np.int64), h.view(np.int64), around.view(np.int64)


def _own_repeats(found: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a document's places have the bytes around them for the first time, and the runs of bytes around the others."""
    at, h, around = found
    order = np.lexsort((at, around, h))
    same = (h[order[1:]] == h[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    where = np.sort(at[again] >> 16)
    s, e = np.maximum(where - (length - kmer), 0), np.minimum(where + length, size)
    begins = np.ones(len(s), bool)
    begins[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(begins)
    return ~again, s[first], e[np.append(first[1:], len(e)) - 1] if len(e) else e


def _sampled(docs: DataFrame, length: int, kmer: int) -> DataFrame:
    """d, t, at, kmer, around: the sampled suffixes of every document; with slice -1, bytes at to around that repeat earlier ones of the same document."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for d, t, text in zip(*(b.column(j).slice(i, 256).to_pylist() for j in range(3)), strict=True):
                    raw = (text or "").encode("utf-8", "replace")
                    found = places(raw, length, kmer)
                    if not len(found[0]):
                        continue
                    new, s, e = _own_repeats(found, len(raw), length, kmer)
                    at, h, around = (c[new] for c in found)
                    n = len(at) + len(s)
                    parts = (np.concatenate([at, s]), np.concatenate([h, np.zeros(len(s), np.int64)]), np.concatenate([around, e]), np.concatenate([h % SLICES, np.full(len(s), -1)]))
                    for c, v in zip(columns, (np.full(n, d, np.int64), np.full(n, t, np.int64), *parts), strict=True):
                        c.append(v)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for c in columns], ["d", "t", "at", "kmer", "around", "slice"])

    return docs.select(*DOCUMENT, "text").mapInArrow(run, "d long, t long, at long, kmer long, around long, slice long")


def _quarter(q: int, w: int) -> tuple[int, int]:
    """Strings of a quarter start `first` to `end` - 1 bytes before the place."""
    return w * q // QUARTERS, w * (q + 1) // QUARTERS


def _contexts(firsts: DataFrame, docs: DataFrame, length: int, kmer: int) -> DataFrame:
    """d, t, at, kmer, left (bytes before the place), context (all bytes within reach)."""
    wanted = firsts.groupBy(*DOCUMENT).agg(F.collect_set(F.struct("at", "kmer")).alias("of"))  # a document's own places
    texts = may_hold(docs, "t", firsts, "t").select(*DOCUMENT, "text").dropDuplicates(DOCUMENT).join(wanted, DOCUMENT)
    w = length - kmer + 1

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["d", "t", "at", "kmer", "left", "context"]
        out: list[list] = [[] for _ in names]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for i in range(b.num_rows):
                d, t, text, of = (b.column(j)[i].as_py() for j in range(4))
                raw = (text or "").encode("utf-8", "replace")
                for place, k in sorted((x["at"], x["kmer"]) for x in of):
                    at = place >> 16
                    low = max(0, at - (w - 1))
                    for c, v in zip(out, (d, t, place, k, at - low, raw[low : at + length]), strict=True):
                        c.append(v)
                    if len(out[0]) == 4096:
                        yield flush()
        if out[0]:
            yield flush()

    return texts.select(*DOCUMENT, "text", "of").mapInArrow(run, "d long, t long, at long, kmer long, left long, context binary")


def _digits(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """d, t, at, kmer, q, common, whole: of each quarter of a place's own strings, hashes of the bytes that they have in common, and of all their bytes (null where these aren't there)."""
    w = length - kmer + 1
    quarters = [(q, *_quarter(q, w)) for q in range(QUARTERS)]

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            rows, qs, commons, wholes = [], [], [], []
            for i, (place, left, raw) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                own_low, own_high, size = place >> 8 & 255, place & 255, len(raw)
                for q, first, end in quarters:
                    if first <= own_high and own_low < end and left >= first and left + length - end + 1 <= size:
                        rows.append(i)
                        qs.append(q)
                        commons.append(_signed(digest(raw[left - first : left + length - end + 1], q)))
                        all_there = left >= end - 1 and left + length - first <= size
                        wholes.append(_signed(digest(raw[left - end + 1 : left + length - first], q + QUARTERS)) if all_there else None)
            taken = [b.column(j).take(pa.array(rows, pa.int64())) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(qs, pa.int32()), pa.array(commons, pa.int64()), pa.array(wholes, pa.int64())], ["d", "t", "at", "kmer", "q", "common", "whole"])

    return contexts.select("d", "t", "at", "kmer", "left", "context").mapInArrow(run, "d long, t long, at long, kmer long, q int, common long, whole long")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _several(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*keys).hint("shuffle_hash")


def _heads(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one place has, and the earliest of these."""
    return df.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")).filter("first < last").select(*keys, "first").hint("shuffle_hash")


def _first_passes(sampled: DataFrame, part: int, docs: DataFrame, length: int, kmer: int) -> tuple[DataFrame, DataFrame]:
    """Passes 1 and 2 of one part: the bytes around places that repeat an earlier one's, and the places that go on."""
    own = sampled.filter(F.col("slice") == part).select(*PLACE, "kmer", "around")
    alike = stash(own.join(_several(own, "kmer"), "kmer"), "suffixes")
    classes = stash(alike.groupBy("kmer", "around").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last")), "classes")
    later = alike.join(classes.filter("first < last").select("kmer", "around", "first").hint("shuffle_hash"), ["kmer", "around"]).filter(F.struct(*PLACE) != F.col("first"))
    at = F.shiftright("at", 16)
    # Where the text ends is known only with the text; `remove` cuts there.
    whole = stash(later.select(*DOCUMENT, F.greatest(at - (length - kmer), F.lit(0)).alias("s"), (at + length).alias("e")), "whole")
    several = classes.groupBy("kmer").agg(F.min("around").alias("lo"), F.max("around").alias("hi")).filter("lo < hi").select("kmer").hint("shuffle_hash")
    firsts = stash(classes.join(several, "kmer", "left_semi").select("first.*", "kmer"), "firsts")
    unstash(alike)
    unstash(classes)
    return whole, firsts


def _last_passes(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """Passes 3 and 4 of one part: d, t, s, e."""
    w = length - kmer + 1
    at = F.shiftright("at", 16)
    first_of = F.floor(F.col("q") * w / QUARTERS).cast("int")
    end_of = F.floor((F.col("q") + 1) * w / QUARTERS).cast("int")
    digits = stash(_digits(contexts, length, kmer), "digits")
    live = stash(digits.join(_several(digits, "kmer", "common"), ["kmer", "common"]), "live")
    unstash(digits)
    met = live.join(_heads(live.filter("whole is not null"), "kmer", "whole"), ["kmer", "whole"], "left")
    again = F.col("first").isNotNull() & (F.struct(*PLACE) != F.col("first"))
    met = stash(met.select("kmer", *PLACE, "q", "common", again.alias("again")), "quarters")
    unstash(live)
    quarters = stash(met.filter("again").select(*DOCUMENT, (at - end_of + 1).alias("s"), (at + length - first_of).alias("e")), "cuts")
    rest = met.filter("not again").select("kmer", *PLACE, "q", "common")
    going = rest.join(_several(rest, "kmer", "common"), ["kmer", "common"]).groupBy("kmer", *PLACE).agg(F.collect_set("q").alias("qs"))  # at most QUARTERS
    strings = contexts.join(going, ["kmer", *PLACE]).select("kmer", *PLACE, "left", "context", F.explode("qs").alias("q"))
    own_low, own_high = F.shiftright("at", 8).bitwiseAND(255).cast("int"), F.col("at").bitwiseAND(255).cast("int")
    strings = strings.withColumn("r", F.explode(F.sequence(F.greatest(first_of, own_low), F.least(end_of - 1, own_high))))
    begin = (F.col("left") - F.col("r")).cast("int")
    strings = strings.filter((begin >= 0) & (begin + length <= F.octet_length("context")))
    strings = stash(strings.select("kmer", *DOCUMENT, (at - F.col("r")).alias("at"), F.xxhash64(F.substring("context", begin + 1, F.lit(length))).alias("h")), "strings")
    unstash(met)
    again_here = strings.join(_heads(strings, "kmer", "h"), ["kmer", "h"]).filter(F.struct(*PLACE) != F.col("first"))
    last = stash(again_here.select(*DOCUMENT, F.col("at").alias("s"), (F.col("at") + length).alias("e")), "cuts")
    unstash(strings)
    return quarters.unionByName(last)


def repeated(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """d, t, s, e: byte intervals that together cover every repeated string's bytes (e may lie beyond the text). docs: d, t, text."""
    sampled = stash(_sampled(docs, length, kmer), "sampled")
    cuts = [stash(sampled.filter("slice = -1").select(*DOCUMENT, F.col("at").alias("s"), F.col("around").alias("e")), "own")]
    firsts = None
    for part in range(SLICES):
        whole, more = _first_passes(sampled, part, docs, length, kmer)
        cuts.append(whole)
        firsts = more if firsts is None else firsts.unionByName(more)
    unstash(sampled)
    contexts = stash(_contexts(firsts, docs, length, kmer), "contexts")
    for part in range(SLICES):
        cuts.append(_last_passes(contexts.filter(F.pmod("kmer", F.lit(SLICES)) == part), length, kmer))
    unstash(contexts)
    return reduce(DataFrame.unionByName, cuts)


def remove(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """One row for each document of docs (d, t, text) with a repeated string: d, t, kept (the remaining bytes), n_removed, n_spans."""
    both = F.shiftleft("s", 32).bitwiseOR(F.col("e"))  # a text has fewer than 2 ** 31 bytes
    cuts = stash(repeated(docs, length, kmer).groupBy(*DOCUMENT).agg(F.collect_set(both).alias("cuts")), "cuts")  # a document's own intervals
    hit = may_hold(docs, "t", cuts, "t").select(*DOCUMENT, "text").dropDuplicates(DOCUMENT).join(cuts, DOCUMENT).select(*DOCUMENT, "text", "cuts")

    def run(batches):
        import pyarrow as pa

        for b in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            out: list[list] = [[] for _ in range(5)]
            bounds, cuts = b.column(3).offsets.to_numpy(), b.column(3).flatten().to_numpy()
            bounds = bounds - bounds[0]
            for i, (d, t, text) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                raw = (text or "").encode("utf-8", "replace")
                of = np.sort(cuts[bounds[i] : bounds[i + 1]])
                s, e = of >> 32, np.maximum.accumulate(np.minimum(of & 0xFFFFFFFF, len(raw)))
                first = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                s, e = s[first], e[np.append(first[1:], len(e)) - 1]
                kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                for c, v in zip(out, (d, t, kept, len(raw) - len(kept), len(s)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["d", "t", "kept", "n_removed", "n_spans"])

    return hit.mapInArrow(run, "d long, t long, kept binary, n_removed long, n_spans long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, and what `remove` reads: d, t, text."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what is removed from every document, and a digest of what stays."""
    docs = keyed(table(spark, sf_dir, "documents"))
    cut = remove(docs).select(*DOCUMENT, "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    whole = docs.select("doc_id", *DOCUMENT, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = whole.join(cut, DOCUMENT, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
