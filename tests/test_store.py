"""The result store and sweeps in rounds."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import rounds, select
from fieldloom.sources.store import Conflict, ResultStore

SCHEMA = "k long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, f"file://{tmp_path}/store", SCHEMA, ["k"])


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(store, version=None):
    return sorted(map(tuple, store.read(version).collect()))


def test_versions(spark, store):
    assert held(store) == [] and store.versions() == []
    assert store.upsert(rows(spark, (1, "a"), (2, "b"))) == 1
    before = store.read()
    assert store.upsert(rows(spark, (2, "c"), (3, None))) == 2
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (2, "b")]  # a reader keeps its snapshot
    assert held(store) == [(1, "a"), (2, "c"), (3, None)] and held(store, 1) == [(1, "a"), (2, "b")]
    assert sorted(r["k"] for r in store.missing(rows(spark, (3, "x"), (4, "y"))).collect()) == [4]
    store.prune(1)
    assert store.versions() == [2] and len(held(store)) == 3


def test_one_row_a_key_in_a_defined_order(spark, store):
    store.upsert(rows(spark, (1, "b"), (1, "c"), (1, "a")))
    assert held(store) == [(1, "a")]
    store.upsert(rows(spark, (1, "b"), (1, "c")), F.desc("v"))
    assert held(store) == [(1, "c")]
    twice = select.latest(rows(spark, (1, "z")), rows(spark, (1, "y"), (1, "x")).repartition(2), ["k"])
    assert [tuple(r) for r in twice.collect()] == [(1, "x")]


def test_a_failing_write_leaves_the_old_version(spark, store):
    store.upsert(rows(spark, (1, "a")))
    bad = rows(spark, (2, "b")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.upsert(bad)
    assert store.versions() == [1] and held(store) == [(1, "a")]
    store.upsert(rows(spark, (2, "b")))
    assert held(store) == [(1, "a"), (2, "b")]


def test_two_writers_lose_no_rows(spark, store):
    other = ResultStore(spark, store.path, SCHEMA, ["k"])
    store.upsert(rows(spark, (1, "a")))
    write, first = store._write, []

    def late(table, version):
        if not first:  # between this writer's reading and its commit the other one commits
            first.append(1)
            other.upsert(rows(spark, (2, "b")))
        write(table, version)

    store._write = late
    assert store.upsert(rows(spark, (3, "c"))) == 3
    assert held(other) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Conflict):
        store._commit(3, "x")


def test_rounds_carry_the_winner_and_resume(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/rounds", rounds.SCHEMA, rounds.KEYS)
    ious = {"a": [0.5, 0.1], "b": [0.4, 0.3], "b1": [0.2, 0.2], "b2": [0.6, 0.2], "b3": [0.6, 0.2]}
    asked = []

    def evaluate(cells):
        asked.append(cells)
        if "b2" in cells and fail:
            raise RuntimeError("lost")
        return spark.createDataFrame([(c, t, v) for c in cells for t, v in enumerate(ious[c])], "cell string, target int, iou double")

    grid = [lambda won: ["a", "b"], lambda won: [f"{won[-1]}{k}" for k in (1, 2, 3)]]
    fail = True
    with pytest.raises(RuntimeError):
        rounds.run(store, grid, evaluate)
    fail = False
    assert rounds.run(store, grid, evaluate) == ["b", "b2"]  # of equal cells the first
    assert rounds.run(store, grid, evaluate) == ["b", "b2"]
    assert asked == [["a", "b"], ["b1", "b2", "b3"], ["b1", "b2", "b3"]]
    assert rounds.run(store, [grid[0], lambda won: [*grid[1](won), "b"]], evaluate) == ["b", "b"]
    assert asked[3:] == [["b"]]
    got = {r["cell"]: (r["targets"], r["robust"]) for r in rounds.summaries(store.read()).filter("round = 0").collect()}
    assert got == {"a": (2, 0.2), "b": (2, 0.325)}


def test_rounds_without_cells_or_targets(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/none", rounds.SCHEMA, rounds.KEYS)
    none = spark.createDataFrame([], "cell string, target int, iou double")
    assert rounds.run(store, [lambda won: []], lambda cells: none) == []
    assert rounds.run(store, [lambda won: ["a"], lambda won: ["b"]], lambda cells: none) == []
