"""Results kept under the fingerprint of their request, so an equal request computes nothing.

A result lies in a folder of its own, and a small file says which is the current one and when it was made; it is
replaced by a rename, so a reader that has opened a result keeps it. Who computes holds a lease: a file that only one
can create, with a time after which it has expired and the next may take over. Others wait for the holder's result.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.store import age, children, create_text, now, read_text, remove, replace_text

#: Seconds that a result is good for, that a lease holds, and between two looks of one who waits.
KEPT, HELD, LOOK = 3600.0, 600.0, 0.2


class Lease:
    """The right to compute one thing. Leases of a folder are numbered; the one after an expired or released lease can be
    created once, so of several that take over at the same time one succeeds."""

    def __init__(self, spark: SparkSession, folder: str, number: int):
        self.spark, self.folder, self.number = spark, folder, number

    @classmethod
    def acquire(cls, spark: SparkSession, folder: str, held: float = HELD) -> Lease | None:
        """The lease, or None while another's holds."""
        last = cls._last(spark, folder)
        if last >= 0 and f"{last:09d}.released" not in children(spark, folder):
            held_file = f"{folder}/{last:09d}.lease"
            text = read_text(spark, held_file)
            if float(text) > now(spark) if text else (age(spark, held_file) or 0) < held:  # in force, or just being written
                return None
        lease = cls(spark, folder, last + 1)
        return lease if create_text(spark, f"{folder}/{lease.number:09d}.lease", repr(now(spark) + held)) else None

    @staticmethod
    def _last(spark: SparkSession, folder: str) -> int:
        return max((int(n[:9]) for n in children(spark, folder) if n.endswith(".lease")), default=-1)

    def holds(self) -> bool:
        """Whether nobody has taken over."""
        return self._last(self.spark, self.folder) == self.number

    def release(self) -> None:
        create_text(self.spark, f"{self.folder}/{self.number:09d}.released", "")
        for n in children(self.spark, self.folder):
            if int(n[:9]) < self.number:
                remove(self.spark, f"{self.folder}/{n}")


def _current(spark: SparkSession, path: str, kept: float | None) -> DataFrame | None:
    text = read_text(spark, f"{path}/current.json")
    if text is None:
        return None
    entry = json.loads(text)
    if kept is not None and now(spark) - entry["made"] >= kept:
        return None
    return spark.read.parquet(f"{path}/{entry['folder']}")


def kept_or_computed(spark: SparkSession, base: str, fingerprint: str, compute: Callable[[], DataFrame], *, anew: bool = False, kept: float | None = KEPT, held: float = HELD, wait: float = 2 * HELD) -> DataFrame:
    """The result below ``base``, in any store that Spark writes, if one was made within ``kept`` seconds (None: ever);
    else it is computed, by one of those who ask at the same time, and kept.

    A request for it ``anew`` replaces it. Who finds another computing waits, at most ``wait`` seconds, and takes that
    result; after ``held`` seconds the lease of one who died is taken over. One whose lease was taken over has no
    say any more: the other's result stands. An error of ``compute`` releases the lease and is the caller's.
    """
    path = f"{base}/fingerprint={fingerprint}"
    began = time.monotonic()
    asked = now(spark)
    while True:
        if not anew and (found := _current(spark, path, kept)) is not None:
            return found
        lease = Lease.acquire(spark, f"{path}/leases", held)
        if lease is not None:
            try:
                if not anew and (found := _current(spark, path, kept)) is not None:  # made while this one asked for the lease
                    return found
                folder = f"result-{uuid.uuid4().hex}"
                compute().write.parquet(f"{path}/{folder}")
                if lease.holds():
                    replace_text(spark, f"{path}/current.json", json.dumps({"folder": folder, "made": now(spark)}))
                    return spark.read.parquet(f"{path}/{folder}")
                remove(spark, f"{path}/{folder}")
            finally:
                if lease.holds():
                    lease.release()
        elif anew and (found := _current(spark, path, now(spark) - asked)) is not None:
            return found  # made anew by another since this request
        if time.monotonic() - began > wait:
            raise TimeoutError(f"another computes '{fingerprint}' for more than {wait:g} seconds")
        time.sleep(LOOK)


def vacuum(spark: SparkSession, base: str, *, kept: float = KEPT) -> list[str]:
    """Removes results that aren't current, and current ones older than ``kept`` seconds with their entries. Not to be
    called while readers are at them or a request computes."""
    lost = []
    for entry in children(spark, base):
        path = f"{base}/{entry}"
        text = read_text(spark, f"{path}/current.json")
        current = json.loads(text) if text else None
        if current and now(spark) - current["made"] >= kept:
            remove(spark, f"{path}/current.json")
            current = None
        lost += [f"{entry}/{n}" for n in children(spark, path) if n.startswith("result-") and (current is None or n != current["folder"])]
    for folder in lost:
        remove(spark, f"{base}/{folder}")
    return lost
