"""Merges that are seen whole or not at all, and results that are computed once."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from test_graph import rows

from loomgraph.sources import results, snapshots, store

SCHEMA = "id long, name string, size int"


def df(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def base(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.create(spark, at, df(spark, []).schema, ["id"], n_buckets=4)
    return at


def test_merges_with_clashes(spark, base):
    assert snapshots.current(spark, base).rows().count() == 0
    snapshots.upsert(spark, base, df(spark, [(i, f"n{i}", i) for i in range(10)]))
    first = snapshots.current(spark, base)
    snapshots.upsert(spark, base, df(spark, [(3, "three"), (99, "new")], "id long, name string"))
    snapshots.upsert(spark, base, df(spark, [(None, 3), (7, 4)], "size int, id long"))
    want = {i: (i, f"n{i}", i) for i in range(10)} | {3: (3, "three", None), 99: (99, "new", None), 4: (4, "n4", 7)}
    assert rows(snapshots.current(spark, base).rows().orderBy("id")) == sorted(want.values())
    assert rows(first.rows()) == [(i, f"n{i}", i) for i in range(10)]  # an older snapshot is what it was
    assert first.version == 1 and snapshots.current(spark, base).version == 3


def test_only_touched_buckets_are_written(spark, base):
    snapshots.upsert(spark, base, df(spark, [(i, "x", 1) for i in range(40)]))
    old = snapshots.current(spark, base).manifest["buckets"]
    snapshots.upsert(spark, base, df(spark, [(5, "y", 2)]))
    new = snapshots.current(spark, base).manifest["buckets"]
    assert len(old) == 4 and sum(old[b] != new[b] for b in old) == 1
    lost = snapshots.vacuum(spark, base)
    assert len(lost) == 1 and snapshots.current(spark, base).rows().count() == 40
    assert snapshots.current(spark, base).rows([int(b) for b in new if old[b] != new[b]]).where("id = 5").first().name == "y"


def test_wrong_merges_change_nothing(spark, base):
    snapshots.upsert(spark, base, df(spark, [(1, "a", 1)]))
    for data, schema, message in (([(None, "x")], "id long, name string", "null"), ([(2, "x"), (2, "y")], "id long, name string", "more than once"), ([("x",)], "name string", "key"), ([(1, 2)], "id long, other int", "no column")):
        with pytest.raises(ValueError, match=message):
            snapshots.upsert(spark, base, df(spark, data, schema))
    assert snapshots.upsert(spark, base, df(spark, [])).version == 1
    assert rows(snapshots.current(spark, base).rows()) == [(1, "a", 1)]
    with pytest.raises(ValueError, match="there is a table"):
        snapshots.create(spark, base, df(spark, []).schema, ["id"])
    with pytest.raises(ValueError, match="no table"):
        snapshots.current(spark, base + "x")
    with pytest.raises(ValueError, match="no column"):
        snapshots.create(spark, base + "y", df(spark, []).schema, ["key"])


def test_a_merge_that_dies_changes_nothing(spark, base, monkeypatch):
    snapshots.upsert(spark, base, df(spark, [(1, "a", 1)]))

    def die(*a):
        raise OSError("dead")

    monkeypatch.setattr(snapshots, "replace_text", die)  # data are written, the number is claimed
    with pytest.raises(OSError, match="dead"):
        snapshots.upsert(spark, base, df(spark, [(1, "b", 2), (2, "c", 3)]))
    monkeypatch.undo()
    assert rows(snapshots.current(spark, base).rows()) == [(1, "a", 1)]
    monkeypatch.setattr(snapshots, "CLAIM_SECONDS", 0.0)  # its claim is void
    snapshots.upsert(spark, base, df(spark, [(2, "d", 4)]))
    assert rows(snapshots.current(spark, base).rows()) == [(1, "a", 1), (2, "d", 4)]
    assert snapshots.vacuum(spark, base)


def test_of_two_merges_from_one_snapshot_the_later_starts_again(spark, base):
    old = snapshots.current(spark, base)
    snapshots.upsert(spark, base, df(spark, [(1, "a", 1)]))
    with pytest.raises(snapshots.Superseded):
        snapshots._merge(old, df(spark, [(2, "b", 2)]))
    threads = [threading.Thread(target=snapshots.upsert, args=(spark, base, df(spark, [(i, "t", i)])), kwargs={"retries": 50}) for i in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(snapshots.current(spark, base).rows())] == [1, 10, 11, 12, 13]


# Results ------------------------------------------------------------------------------------------


def test_two_threads_compute_once(spark, tmp_path):
    calls, got = [], []

    def make():
        calls.append(1)
        time.sleep(1.0)
        return spark.range(5)

    threads = [threading.Thread(target=lambda: got.append(results.kept_or_computed(spark, str(tmp_path), "f", make).count())) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [5] * 4 and len(calls) == 1


def test_results_expire_and_readers_keep_theirs(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(len(calls))
    ask = lambda **k: results.kept_or_computed(spark, str(tmp_path), "f", make, **k)
    first = ask()
    assert first.count() == 1 and ask().count() == 1 and ask(kept=None).count() == 1
    assert ask(kept=0.0).count() == 2 and first.count() == 1 and ask().count() == 2
    assert ask(anew=True).count() == 3
    assert len(results.vacuum(spark, str(tmp_path))) == 2 and ask().count() == 3
    assert len(results.vacuum(spark, str(tmp_path), kept=0.0)) == 1 and ask().count() == 4


def test_an_expired_lease_is_taken_over_by_one(spark, tmp_path):
    folder = str(tmp_path / "leases")
    dead = results.Lease.acquire(spark, folder, held=0.3)
    assert dead.holds() and results.Lease.acquire(spark, folder) is None
    time.sleep(0.4)
    got = []
    threads = [threading.Thread(target=lambda: got.append(results.Lease.acquire(spark, folder, held=60))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (new,) = [x for x in got if x is not None]
    assert new.holds() and not dead.holds()
    new.release()
    assert results.Lease.acquire(spark, folder).number == new.number + 1
    assert not any(n.startswith("000000000") for n in store.children(spark, folder))


def test_errors_release_the_lease_and_waiting_ends(spark, tmp_path):
    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        results.kept_or_computed(spark, str(tmp_path), "f", fail)
    assert results.kept_or_computed(spark, str(tmp_path), "f", lambda: spark.range(2)).count() == 2
    other = results.Lease.acquire(spark, f"{tmp_path}/fingerprint=g/leases")
    with pytest.raises(TimeoutError):
        results.kept_or_computed(spark, str(tmp_path), "g", fail, wait=0.1)
    other.release()


def test_one_who_was_taken_over_has_no_say(spark, tmp_path):
    path = f"{tmp_path}/fingerprint=f"

    def slow():
        time.sleep(0.3)  # the lease runs out meanwhile, and another computes
        assert results.kept_or_computed(spark, str(tmp_path), "f", lambda: spark.range(7), held=60).count() == 7
        return spark.range(1)

    assert results.kept_or_computed(spark, str(tmp_path), "f", slow, held=0.2).count() == 7
    assert [n for n in store.children(spark, path) if n.startswith("result-")] and results.kept_or_computed(spark, str(tmp_path), "f", slow).agg(F.count("*")).first()[0] == 7
