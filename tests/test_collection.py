import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexmark.errors import Code, EngineError
from vexmark.files import Files
from vexmark.operators import ann
from vexmark.operators import replay as R
from vexmark.plans import collection
from vexmark.plans.catalog import Database
from vexmark.plans.collection import Collection
from vexmark.streaming import ingest
from vexmark.streaming.ingest import CHANGES, Applied, into_collection, read_changes
from vexmark.types import CollectionConfig, CollectionMeta, Metric

VECTORS = "id long, embedding array<float>"
CONFIG = CollectionConfig("c", 2, Metric.L2)


def rows(spark, ids, x=0.0):
    return spark.createDataFrame([(i, [float(i), x]) for i in ids], VECTORS)


def found(c, k=100):
    return [r.id for r in c.search([0.0, 0.0], k).orderBy("rank").collect()]


def test_crash_recovery(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(10)))
    c.save()
    c.insert_batch(rows(spark, range(10, 20)))
    again = Collection.load(spark, c.path)  # no save: the log has the rest
    assert again.size() == 20 and again.recovered_from_log and (again.next_lsn, again.next_txid) == (21, 21)
    assert found(again) == list(range(20))


def test_delete_replay_and_tombstones(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(10)))
    c.save()
    assert c.remove(5).ok
    again = Collection.load(spark, c.path)
    assert again.size() == 10 and again.recovered_from_log and 5 not in found(again)
    again.save()
    third = Collection.load(spark, c.path)
    assert third.size() == 10 and not third.recovered_from_log and 5 not in found(third)
    third.insert(5, [5.0, 0.0])  # an upsert takes the tombstone away
    assert third.size() == 10 and 5 in found(third)


def test_counters_and_files_after_save(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(10)))
    c.save()
    doc = json.loads(Files(spark).read(f"{c.path}/meta.json"))
    assert doc["recovery"] == {"lastPersistedLsn": 10, "lastPersistedTxid": 10, "cleanShutdown": True}
    assert c.commits() == [] and doc["snapshotVersion"] == 1
    again = Collection.load(spark, c.path)
    assert not again.recovered_from_log and again.size() == 10 and again.next_lsn == 11


def test_never_saved_collection_is_found_again(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert(1, [1.0, 1.0])
    assert found(Collection.load(spark, c.path)) == [1]


def test_batch_status_and_last_writer(spark):
    c = Collection(spark, CONFIG)
    batch = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [1.0]), (2, 1, [9.0, 0.0]), (3, 3, None)], "pos long, " + VECTORS)
    status = {r.pos: r.status for r in c.insert_batch(batch, "pos").collect()}
    assert status == {0: "kOk", 1: "kDimensionMismatch", 2: "kOk", 3: "kDimensionMismatch"}
    assert c.size() == 1 and c.next_lsn == 3
    assert c.search([9.0, 0.0], 1).first().score == 0.0


def test_rows_without_positions_keep_their_order(spark):
    c = Collection(spark, CONFIG)
    many = spark.range(0, 40, 1, 4).selectExpr("id % 10 AS id", "array(cast(id AS float), 0f) AS embedding")
    assert c.insert_batch(many).where("status = 'kOk'").count() == 40
    assert c.next_lsn == 41 and {r.id: r.embedding[0] for r in c.live_view().collect()} == {i: 30.0 + i for i in range(10)}


def test_single_insert_mismatch_uses_no_lsn_but_unknown_remove_does(spark):
    c = Collection(spark, CONFIG)
    assert c.insert(1, [1.0]).code is Code.DIMENSION_MISMATCH and c.next_lsn == 1
    assert c.remove(4).code is Code.NOT_FOUND and c.next_lsn == 2 and c.size() == 0


def test_empty_collection(spark):
    c = Collection(spark, CONFIG)
    assert c.size() == 0 and found(c) == [] and c.metadata().count() == 0
    c.insert_batch(rows(spark, []))
    assert c.next_lsn == 1


def test_metadata_lives_until_saved(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(3)))
    c.set_metadata(1, {"a": 1})
    c.set_metadata(1, {"b": True, "c": 0.5, "d": "x"})
    c.set_metadata(77, {"no": "vector"})
    assert Collection.load(spark, c.path).metadata().count() == 0
    c.save()
    again = Collection.load(spark, c.path)
    assert again.size() == 3
    got = {r.id: json.loads(r.metadata) for r in again.metadata().collect()}
    assert got == {1: {"b": True, "c": 0.5, "d": "x"}, 77: {"no": "vector"}}
    assert [r.metadata for r in again.query([0.0, 0.0], 2).orderBy("rank").collect()][0] == "{}"
    again.remove(1)
    assert {r.id for r in again.metadata().collect()} == {77}
    with pytest.raises(EngineError):
        c.set_metadata(1, {"bad": [1]})


def test_save_elsewhere_keeps_the_own_log(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(4)))
    c.save(f"{tmp_path}/copy")
    assert Collection.load(spark, f"{tmp_path}/copy").size() == 4 and len(c.commits()) == 1


def test_load_errors(spark, tmp_path):
    with pytest.raises(EngineError) as e:
        Collection.load(spark, f"{tmp_path}/none")
    assert e.value.code is Code.NOT_FOUND
    Files(spark).write(f"{tmp_path}/bad/meta.json", b"{ not json }")
    db = Database(spark, str(tmp_path))
    assert [r.code for r in db.load_errors().collect()] == ["kCorruption"] and db.list_collections() == []


def test_catalog(spark, tmp_path):
    with Database(spark, str(tmp_path)) as db:
        for n, d in (("a", 64), ("b", 96), ("c", 128)):
            db.create_collection(n, CollectionConfig("", d))
        with pytest.raises(EngineError) as e:
            db.create_collection("a", CollectionConfig("", 64))
        assert e.value.code is Code.ALREADY_EXISTS
        with pytest.raises(EngineError):
            db.get_collection("none")
        assert db.get_collection("b").name == "b" and db.list_collections() == ["a", "b", "c"]
        db.drop_collection("b")
    again = Database(spark, str(tmp_path))
    assert again.list_collections() == ["a", "c"] and not again.has_collection("b")
    assert [tuple(r) for r in again.collections().collect()] == [("a", 64, "Cosine"), ("c", 128, "Cosine")]


def test_meta_json():
    doc = {"name": "x", "dimensions": 3, "metric": "L2", "dtype": "Float32", "idxType": "HNSW"}
    meta = CollectionMeta.from_json(doc)
    assert meta.options.m == 64 and CollectionMeta.from_json(meta.to_json()) == meta
    for bad in ([], {"name": "x"}, {**doc, "metric": "Hamming"}):
        with pytest.raises(EngineError):
            CollectionMeta.from_json(bad)


def test_numbers_of_uneven_positions(spark):
    far = [-(10**17), *range(500), 10**9, *range(10**12, 10**12 + 300), 2**62, 2**62 + 1]
    got = R.numbered(spark.createDataFrame([(p,) for p in reversed(far)], "pos long").repartition(3), 7).collect()
    assert sorted((r.pos, r.lsn) for r in got) == [(p, 7 + k) for k, p in enumerate(sorted(far))]
    assert R.numbered(spark.createDataFrame([], "pos long"), 7).count() == 0
    edges = list(range(0, 990, 11))
    ranges = spark.range(-5, 1100).select("id", R._range_of(F.col("id"), edges).alias("b")).collect()
    assert all(r.b == sum(c <= r.id for c in edges) for r in ranges)


def test_replay_over_snapshot(spark):
    snapshot = spark.createDataFrame([(1, [1.0], False), (2, [2.0], False), (3, None, True)], "id long, embedding array<float>, deleted boolean")
    log = spark.createDataFrame([(1, "INSERT", 9, [9.0]), (5, "DELETE", 1, None), (6, "INSERT", 2, [5.0]), (7, "COMMIT_TXN", 0, None), (8, "DELETE", 50, None), (9, "DELETE", 2, None), (10, "INSERT", 2, [6.0])], "lsn long, op string, id long, embedding array<float>")
    got = {r.id: (r.embedding, r.deleted) for r in R.merged(snapshot, log, 4).collect()}
    assert got == {1: (None, True), 2: ([6.0], False), 3: (None, True)}


def changes_file(spark, source, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)


def test_stream(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    source = f"{tmp_path}/in"
    changes_file(spark, source, [(1, 1, "INSERT", [1.0, 0.0]), (2, 2, "INSERT", [2.0, 0.0]), (3, 1, "DELETE", None)])
    into_collection(read_changes(spark, source), c, f"{tmp_path}/ck").awaitTermination()
    assert found(c) == [2]
    changes_file(spark, source, [(3, 1, "INSERT", [7.0, 0.0]), (4, 3, "INSERT", [3.0, 0.0])])
    into_collection(read_changes(spark, source), c, f"{tmp_path}/ck").awaitTermination()
    assert found(c) == [2, 3]  # LSN 3 was applied before


def test_stream_of_files_out_of_order(spark, tmp_path):
    c, source = Collection(spark, CONFIG, path=f"{tmp_path}/c"), f"{tmp_path}/in"
    for first in (100, 0, 50):
        changes_file(spark, source, [(first + i, first + i, "INSERT", [float(first + i), 0.0]) for i in range(10)] + [(first + 10, 7, "INSERT", [float(first + 10), 1.0])])
    changes_file(spark, source, [(200, 300, "INSERT", [1.0]), (201, None, "INSERT", [1.0, 1.0]), (202, 301, "MERGE", [1.0, 1.0]), (None, 302, "DELETE", None), (203, 100, "DELETE", None)])
    into_collection(read_changes(spark, source, max_files=1), c, f"{tmp_path}/ck").awaitTermination()
    got = {r.id: r.embedding for r in Collection.load(spark, c.path).live_view().collect()}
    assert set(got) == {*range(10), *range(50, 60), *range(101, 110)} and got[7] == [110.0, 1.0]
    assert sorted((str(r.lsn), r.status) for r in Applied(c).rejected().collect()) == [("200", "kDimensionMismatch"), ("201", "kInvalidArgument"), ("202", "kInvalidArgument"), ("None", "kInvalidArgument")]


def test_streams_with_new_checkpoints_count_their_batches_anew(spark, tmp_path):
    c, source = Collection(spark, CONFIG, path=f"{tmp_path}/c"), f"{tmp_path}/in"
    changes_file(spark, source, [(1, 1, "INSERT", [1.0, 0.0])])
    into_collection(read_changes(spark, source), c, f"{tmp_path}/ck1").awaitTermination()
    changes_file(spark, source, [(2, 2, "INSERT", [2.0, 0.0])])
    into_collection(read_changes(spark, source), c, f"{tmp_path}/ck2").awaitTermination()  # reads both files again, as its batch 0
    assert found(c) == [1, 2] and c.next_lsn == 3
    assert len({n.rsplit("-", 1)[0] for n in Files(spark).names(f"{c.path}/applied")}) == 2


def test_stream_batches_that_run_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT_AFTER", 2)
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    a = Applied(c)
    batches = [[(5, 1, "INSERT", [5.0, 0.0])], [(4, 1, "DELETE", None), (6, 2, "INSERT", [6.0, 0.0])], [(7, 2, "DELETE", None)], [(6, 2, "INSERT", [9.0, 0.0])], [(8, 3, "INSERT", [8.0, 0.0])]]
    for n, rows_ in enumerate(batches):
        batch = spark.createDataFrame(rows_, CHANGES)
        if n == 1:  # the commit fails after the batch was decided on: the same changes are applied later
            with monkeypatch.context() as m:
                m.setattr(Collection, "apply_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    a.apply(batch, n)
        a.apply(batch, n)
        before = c.next_lsn
        a.apply(batch, n)
        assert c.next_lsn == before
        c.save()
    assert found(c) == [1, 3] and {r.id: r.lsn for r in a.marks().collect()} == {1: 5, 2: 7, 3: 8}
    assert len([n for n in Files(spark).names(a.folder) if n.startswith("base")]) == 1


def test_readers_keep_their_state_over_a_save(spark, tmp_path):
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    c.insert_batch(rows(spark, range(4)))
    c.save()
    c.insert_batch(rows(spark, range(4, 6)))
    view = Collection.load(spark, c.path).live_view()
    c.insert_batch(rows(spark, range(6, 8)))
    c.save()
    assert view.count() == 6 and c.size() == 8
    c.save()
    assert Files(spark).names(f"{c.path}/snapshot") == ["v=2", "v=3"] and Files(spark).names(f"{c.path}/log") == []


def test_many_metadata_calls_keep_plans_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "SINGLES", 5)
    c = Collection(spark, CONFIG, path=f"{tmp_path}/c")
    for k in range(23):
        c.set_metadata(k % 7, {"k": k})
    for k in range(9):
        c.set_metadata_batch(spark.createDataFrame([(k, f'{{"b":{k}}}')], "id long, metadata string"))
    c.set_metadata(8, {"last": 1})
    got = {r.id: json.loads(r.metadata) for r in c.metadata().collect()}
    assert got == {**{k: {"b": k} for k in range(8)}, 8: {"last": 1}} and len(c._changes) < 8


def test_index_in_a_collection(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)).astype(np.float32) + 8 * rng.integers(0, 12, 1500)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    c = Collection(spark, CollectionConfig("i", 8, Metric.L2), path=f"{tmp_path}/c")
    c.insert_batch(frame.where("id < 1000"), "id")
    c.create_index(20)
    queries = frame.where("id % 10 = 0").selectExpr("id AS qid", "embedding AS qv")

    def recall(ef):
        truth, got = ({(r.qid, r.id) for r in c.search_batch(queries, 10, e).collect()} for e in (None, ef))
        return len(truth & got) / len(truth)

    assert recall(300) > 0.9
    c.insert_batch(frame.where("id >= 1000 AND id < 1200"), "id")
    c.insert(5, [100.0] * 8)
    c.remove_batch(frame.where("id BETWEEN 900 AND 999"))
    assert recall(300) > 0.9 and recall(3000) == 1
    c.save()
    c = Collection.load(spark, c.path)
    assert c._index.generations == 2 and c._index.gone == 101 and recall(3000) == 1
    assert [r.id for r in c.search([100.0] * 8, 1, ef=50).collect()] == [5]
    c.insert_batch(frame.where("id >= 600"), "id")  # more than a fifth of the index is out of date
    c.save()
    assert c._index.generations == 1 and recall(3000) == 1
    with pytest.raises(EngineError):
        c.search([1.0], 1, ef=9)
    with pytest.raises(EngineError):
        ann.load(spark, f"{tmp_path}/none")
