"""Digests that change along one path only, and ledgers that go on after a restart; nulls, ties, late rows, empty tables."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import identity
from leafmill.session import ship
from leafmill.streaming import attempts


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain_leaves(value, path=()):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() if k not in identity.IGNORED for x in plain_leaves(v, (*path, k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in plain_leaves(v, (*path, f"{i:09}"))]
    return [path]


DOCS = {
    1: {"a": {"b": [1, 2.00049, "x"], "xref": 7}, "c": True, "d": None, "e": [], "f": {}},
    2: {"a": {"b": [1, 2.00001, "x"], "xref": 8}, "c": True, "d": None, "e": [], "f": {}},
    3: [[["deep"]]],
    4: "text",
    5: {"number": 3, "z": "\n\"quoted\" é"},
}


def frame(spark, docs):
    rows = [(k, None if v is None else json.dumps(v)) for k, v in docs.items()]
    return identity.variants(spark, spark.createDataFrame(rows, "id int, j string"), "id", "j")


def test_leaves(spark):
    rows = identity.leaves(frame(spark, DOCS | {6: None}), "id", "v").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(tuple(r.path))
    assert got == {k: set(plain_leaves(v)) for k, v in DOCS.items()}
    by = {(r.id, tuple(r.path)): r.leaf for r in rows}
    assert by[1, ("a", "b", "000000001")] == by[2, ("a", "b", "000000001")] == "n:2.0" and by[4, ()] == 's:"text"'
    assert identity.leaves(frame(spark, DOCS).limit(0), "id", "v").count() == 0


def test_equal_content_has_equal_digests_whatever_the_rows(spark):
    leaves = identity.leaves(frame(spark, DOCS), "id", "v")
    root = {r.id: r.digest for r in identity.digests(leaves, "id").where("size(path) = 0").collect()}
    again = {r.id: r.digest for r in identity.digests(leaves.repartition(5).unionByName(leaves), "id").where("size(path) = 0").collect()}
    assert root == again and set(root) == set(DOCS) and root[1] == root[2] and len(set(root.values())) == 4
    assert identity.digests(leaves.limit(0), "id").count() == 0


def test_a_changed_leaf_changes_its_path_only(spark):
    rng = random.Random(1)
    rows = {}
    while len(rows) < 400:
        size = rng.choice((2, 4, 4))
        rows[rng.randint(1, 4), (*(rng.choice("abcdefgh") + str(k) for k in range(size - 1)), f"leaf{size}{rng.randint(0, 9)}")] = f"v{rng.randint(0, 9)}"
    make = lambda rows: spark.createDataFrame([(k, list(p), v) for (k, p), v in rows.items()], "id int, path array<string>, leaf string")
    stored = identity.digests(make(rows), "id")
    stored = stored.persist()
    keys = sorted(rows)
    changes = {keys[10]: "new", keys[200]: None, keys[300]: rows[keys[300]], (2, ("zz", "added", "x")): "more", (9, ("only",)): "first"}
    after = {k: v for k, v in (rows | changes).items() if v is not None}
    fresh = {(r.id, tuple(r.path)): r.digest for r in identity.digests(make(after), "id").collect()}
    new = identity.refresh(stored, make(changes), "id")
    assert {(r.id, tuple(r.path)): r.digest for r in new.collect()} == fresh
    above = {(k, p[:n]) for (k, p), v in changes.items() if (k, p) != keys[300] for n in range(len(p) + 1)}
    changed = {(r.id, tuple(r.path)): r.change for r in identity.differences(stored, new, "id").collect()}
    assert set(changed) <= above and {(k, ()) for k in (keys[10][0], keys[200][0], 2, 9)} <= set(changed) and changed[9, ()] == "added"
    assert identity.refresh(stored, make(changes).limit(0), "id").count() == stored.count()
    stored.unpersist()


def test_cache_key_is_the_digest_of_sorted_json(spark):
    rows = [("ab", "elements-v1", "1.24.9"), ('q"uote', "v2", "2")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, d string, l string").select(identity.cache_key(F.col("s"), F.col("d"), F.col("l"))).collect()]
    want = [hashlib.sha256(json.dumps({"source_sha256": s, "detector_version": d, "pymupdf_major": v.split(".")[0], "analyzer_version": "source-structure-v1"}, sort_keys=True).encode()).hexdigest() for s, d, v in rows]
    assert got == want and len({*got}) == 2


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def feed(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in-{name}.parquet")


def test_checkpoints_go_on_after_a_restart(spark, tmp_path):
    schema = "job string, event_id long, ts timestamp, phase string, completed long"
    path = f"file://{tmp_path}"
    feed(spark, path, [("a", 3, at(3), "translation", 4), ("a", 1, at(1), "translation", 5), ("a", 2, at(1), "translation", 5), ("b", 4, at(2), "extract", 9), (None, 5, at(1), "extract", 1)], schema, "1")
    run = lambda: {(r.job, r.event_id): (r.status, r.phase, r.completed) for r in attempts.drain(attempts.checkpoints(stream(spark, f"{path}/in-*", schema)), f"{path}/out").collect()}
    first = run()
    assert first == {("a", 1): ("accepted", "translation", 5), ("a", 2): ("accepted", "translation", 5), ("a", 3): ("regression", "translation", 5), ("b", 4): ("accepted", "extract", 9), (None, 5): ("accepted", "extract", 1)}
    feed(spark, path, [("a", 6, at(9), "translation", 2), ("a", 7, at(10), "review", 1), ("a", 8, at(2), "review", 50), ("a", 9, at(11), "translation", 1)], schema, "2")
    second = run()  # the state of the first run goes on; event 8 is late
    assert {k: v for k, v in second.items() if k not in first} == {("a", 6): ("regression", "translation", 5), ("a", 8): ("late", "translation", 5), ("a", 7): ("accepted", "review", 1), ("a", 9): ("accepted", "translation", 1)}
    assert run() == second and {k: second[k] for k in first} == first


def test_attempts_keep_their_number(spark, tmp_path):
    schema = "iteration int, renderer string, build string, event_id long, ts timestamp, fingerprint string"
    path = f"file://{tmp_path}"
    feed(spark, path, [(1, "r", "x", 1, at(1), "f1"), (1, "r", "x", 2, at(2), "f2"), (1, "r", "x", 3, at(3), "f1"), (1, "r", "y", 4, at(1), "f2"), (1, "r", None, 5, at(1), None)], schema, "1")
    run = lambda: {r.event_id: (r.attempt, r.status) for r in attempts.drain(attempts.attempts(stream(spark, f"{path}/in-*", schema)), f"{path}/out").collect()}
    assert run() == {1: (1, "new"), 2: (2, "new"), 3: (1, "repeated"), 4: (1, "new"), 5: (1, "new")}
    feed(spark, path, [(1, "r", "x", 6, at(0), "f2"), (1, "r", "x", 7, at(9), "f3")], schema, "2")
    assert {k: v for k, v in run().items() if k > 5} == {6: (2, "repeated"), 7: (3, "new")}
