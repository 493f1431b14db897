"""Tables by their log: readers during overwrites, batches cut off half-way, ids that are kept for ever."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from quadrille.sources import versions
from quadrille.streaming import events, ids


def test_readers_during_overwrites(spark, tmp_path):
    """Ten overwrites while another thread reads: it never fails, and never sees rows of two versions."""
    path, seen, failed, done = f"file://{tmp_path}/t", set(), [], threading.Event()

    def rows(n):
        return spark.range(50 + n, numPartitions=3).select("id", F.lit(n).cast("long").alias("version"))

    versions.publish(rows(0), path)

    def read():
        while not done.is_set():
            try:
                got = [tuple(r) for r in versions.current(spark, path, "id long, version long").collect()]
                kinds = {v for _, v in got}
                assert len(kinds) == 1 and len(got) == 50 + next(iter(kinds))
                seen.add(next(iter(kinds)))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 11):
        assert versions.publish(rows(n), path) == 50 + n
    done.set()
    reader.join()
    assert not failed and len(seen) > 2
    assert versions.vacuum(spark, path, keep=2) == 9
    assert versions.current(spark, path, "id long, version long").first()["version"] == 10
    assert versions.publish(rows(11), path) == 61


def test_publish_that_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert versions.current(spark, path, "id long").count() == 0
    versions.publish(spark.range(4), path)
    looks = iter([(1, 1), (2, 2)])
    with monkeypatch.context() as m:
        m.setattr(versions, "_look", lambda df: next(looks))
        with pytest.raises(RuntimeError):
            versions.publish(spark.range(9), path)
    assert versions.current(spark, path, "id long").count() == 4
    log = versions.Log(spark, path)
    with pytest.raises(versions.Conflict):
        log.commit(1, log.new_folder(1))


def source(spark, folder, parts):
    """A file each; returns a stream of one file a batch."""
    for k, (a, b) in enumerate(parts):
        spark.range(a, b, numPartitions=1).select("id").write.mode("append").parquet(f"{folder}/f{k}")
    return spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("behind", [False, True], ids=["before its entry", "behind its entry"])
def test_batch_cut_off(spark, tmp_path, monkeypatch, behind):
    """The third batch fails once, with its rows written: run again, every event is there once."""
    stream = source(spark, f"{tmp_path}/in", [(0, 10), (10, 25), (25, 40), (40, 41)])
    path, checkpoint, commit = f"file://{tmp_path}/out", f"file://{tmp_path}/check", versions.Log.commit

    def cut(self, number, folder):
        if behind:
            commit(self, number, folder)
        if number == 2:
            raise OSError("cut off")
        if not behind:
            commit(self, number, folder)

    with monkeypatch.context() as m:
        m.setattr(versions.Log, "commit", cut)
        with pytest.raises(Exception, match="cut off"):
            events.ledgered(stream, path, checkpoint)
    assert versions.appended(spark, path, "id long").count() in ((40,) if behind else (25,))
    assert sorted(r["id"] for r in events.ledgered(stream, path, checkpoint).collect()) == list(range(41))
    spark.range(41, 50, numPartitions=1).write.parquet(f"{tmp_path}/in/later")
    assert sorted(r["id"] for r in events.ledgered(stream, path, checkpoint).collect()) == list(range(50))


def test_ids_over_growing_input(spark, tmp_path):
    """Batches that overlap, with repeats and nulls, in several types at once; what is new is told, and nothing twice."""
    rng, known = random.Random(1), set()
    batches = [[(rng.randrange(300 * (k + 1)), rng.choice(["a", "b"])) for _ in range(500)] + [(None, "a"), (1, None)] for k in range(4)]
    frames = [spark.createDataFrame(b, "n int, s string").repartition(3) for b in batches]
    store = ids.IdStore(spark, f"file://{tmp_path}/ids", frames[0].schema)
    assert store.ids().count() == 0
    for batch, frame in zip(batches, frames):
        new = {x for x in batch if None not in x} - known
        got = [tuple(r) for r in store.add(frame).collect()]
        assert set(got) == new and len(got) == len(new)
        known |= new
    assert sorted(map(tuple, store.ids().collect())) == sorted(known)
    assert ids.IdStore(spark, f"file://{tmp_path}/ids", frames[0].schema).add(frames[2]).count() == 0


def test_filters(spark, tmp_path):
    """All that was added is known; of what was not, about one in a hundred is."""
    digests = [f"{random.Random(i).getrandbits(160):040x}" for i in range(6000)]
    import numpy as np

    bits = ids.filter_of(np.array(digests[:3000]))
    assert ids.may_know(bits, np.array(digests[:3000])).all() and ids.may_know(bits, np.array(digests[3000:])).mean() < 0.03
    frame = spark.range(2000)
    store = ids.IdStore(spark, f"file://{tmp_path}/ids", frame.schema)
    store.add(frame)
    assert store.suspects(store._digested(spark.range(10_000, 12_000))).count() < 60
    plan = store._read().where(F.col("bucket").isin(3, 7))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_stream_of_ids_cut_off(spark, tmp_path, monkeypatch):
    """A stream that is cut off behind a batch's entry and before its own note of it does not lose or repeat an id."""
    stream = source(spark, f"{tmp_path}/in", [(0, 30), (20, 50), (40, 60)]).select((F.col("id") % 45).alias("id"))
    path, checkpoint, commit = f"file://{tmp_path}/ids", f"file://{tmp_path}/check", versions.Log.commit

    def cut(self, number, folder):
        commit(self, number, folder)
        if number == 1:
            raise OSError("cut off")

    with monkeypatch.context() as m:
        m.setattr(versions.Log, "commit", cut)
        with pytest.raises(Exception, match="cut off"):
            ids.dedup_stream(stream, ["id"], path, checkpoint)
    assert sorted(r["id"] for r in ids.dedup_stream(stream, ["id"], path, checkpoint).collect()) == list(range(45))
