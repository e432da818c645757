"""Merkle manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def _tree(level, fan):
    paths, where = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, w in zip(paths, where):
            run = level[w // fan * fan : w // fan * fan + fan]
            path.append((run[: w % fan], run[w % fan + 1 :]))
        level = [_hash(level[k : k + fan]) for k in range(0, len(level), fan)]
        where = [w // fan for w in where]
    return level[0], paths


def brute(rows, fan=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    parts = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        parts.append((members, *_tree([_leaf(r, r[4]) for r in members], fan)))
    if not parts:
        return []
    root, above = _tree([p[1] for p in parts], fan)
    out = []
    for (members, subroot, paths), rest in zip(parts, above):
        for r, path in zip(members, paths):
            lost = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            d = _leaf(r, r[4].replace("\n", "") if lost else r[4])
            for left, right in path + rest:
                d = _hash(left + [d] + right)
            proof = _hash(h for left, right in path + rest for h in left + right)
            out.append((r[0], _leaf(r, r[4]), subroot, root, proof, d, d == root))
    return out


def _write(spark, tmp_path, rows, n=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x"))
    df.repartition(n).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _same(spark, folder, rows):
    got = [tuple(r[c] for c in NAMES) for r in M.query(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


ODD = [(1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, None, "fr", 0, ""), (None, "a", "en", 1, "z\n"), (None, None, None, None, None), (4, "", "en", 2, "é\n"), (5, "é", "en", 2, "-"), (5, "é", "en", 2, "-"), (5, "é", "en", 2, "\n" * 70000), (6, "z", "en", 1, "1:a")]


def test_odd_rows(spark, tmp_path):
    _same(spark, _write(spark, tmp_path, ODD), ODD)


@pytest.mark.parametrize("n", [1, 2, 4, 28])
def test_one_group(spark, tmp_path, n):
    rows = [(i, "only", "en", i, f"t\n{i}") for i in range(n)]
    _same(spark, _write(spark, tmp_path, rows), rows)


def test_a_group_of_a_third_and_many_small_ones(spark, tmp_path):
    rows = [(i * 7, "big" if i % 3 == 0 else f"s{i % 41:02d}", "en", i, f"line {i}\nend") for i in range(700)]
    _same(spark, _write(spark, tmp_path, rows, 7), rows)


def test_equal_rows_have_places_of_their_own(spark, tmp_path):
    rows = [(7, "a", "en", 1, "same")] * 20 + [(8, "b", "en", 1, "\n")]
    _same(spark, _write(spark, tmp_path, rows), rows)


def test_other_fan_and_broadcast_of_few_ancestors(spark, tmp_path):
    """A fan of two makes a tree of many levels, so that late rounds broadcast; without that the join is shuffled, with equal rows."""
    rows = [(i, f"s{i % 2}", "en", i, f"t{i}") for i in range(600)]
    docs = spark.read.parquet(f"{_write(spark, tmp_path, rows)}/documents.parquet")
    found = M.manifest(docs, fan=2).withColumn("end", M.fold(F.col("leaf"), F.col("path")))
    assert found.filter("end = root").count() == 600
    assert found.select(F.size("path").alias("n")).distinct().count() == 1
    roots = {r[0].hex() for r in found.select(F.col("root").cast("binary")).distinct().collect()}
    assert roots == {brute(rows, fan=2)[0][3]}
    limit, M.BROADCAST = M.BROADCAST, 0
    try:
        assert M.manifest(docs, fan=2).exceptAll(found.drop("end")).count() == 0
    finally:
        M.BROADCAST = limit


def test_any_change_of_a_row_breaks_its_proof(spark, tmp_path):
    rows = [(i, "a", "en", 5, f"word{i}") for i in range(9)]
    docs = spark.read.parquet(f"{_write(spark, tmp_path, rows)}/documents.parquet")
    found = M.manifest(docs, tampered={"text": F.concat("text", F.lit(" "))}, when=F.col("doc_id") == 4)
    broken = found.filter(F.coalesce(M.fold(F.coalesce("tampered", "leaf"), F.col("path")) != F.col("root"), F.lit(True)))
    assert [r["key"] for r in broken.collect()] == [4]


def test_sql_of_the_odd_rows(tmp_path, spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    import duckdb

    folder = _write(spark, tmp_path, ODD)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    r = con.sql(M.oracle_sql())
    at = [r.columns.index(c) for c in NAMES]
    assert sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall()) == sorted(map(repr, brute(ODD)))


def test_sql_of_the_tables(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from oracle import rows_of, sql_rows

    df = M.query(spark, "/root/testdata/sf0.001")
    assert (sorted(df.columns), rows_of(df)) == sql_rows(M.oracle_sql(), "/root/testdata/sf0.001")
