"""One writer at a time on a shared folder, and results published only if what they were made from still stands."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from docweft.streaming.refresh import CLAIM_SECONDS


class Busy(RuntimeError):
    """Another writer holds the folder."""


class WriterLock:
    """A claim file in a folder of any file system Spark can write. A claim not renewed for CLAIM_SECONDS is stale: its
    successor moves it aside, which only one can do, and claims anew. Use as a context, or claim, renew and release."""

    def __init__(self, spark: SparkSession, folder: str, stale_after: float = CLAIM_SECONDS):
        self._fs = spark._jvm.org.apache.hadoop.fs
        self.path = self._fs.Path(folder, "writer.claim")
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stale_after = stale_after
        self.held = False

    def try_claim(self) -> bool:
        self.files.mkdirs(self.path.getParent())
        if self.files.exists(self.path):
            age = time.time() - self.files.getFileStatus(self.path).getModificationTime() / 1000
            if age < self.stale_after:
                return False
            aside = self._fs.Path(self.path.getParent(), f"stale-{uuid.uuid4().hex}")
            if not self.files.rename(self.path, aside):
                return False
            self.files.delete(aside, False)
        try:
            self.files.create(self.path, False).close()  # fails where another came first
        except Exception:  # noqa: BLE001
            return False
        self.held = True
        return True

    def claim(self, wait: float = 0.0, step: float = 0.2) -> None:
        """Claim, trying again for ``wait`` seconds; Busy after that."""
        until = time.time() + wait
        while not self.try_claim():
            if time.time() >= until:
                raise Busy(str(self.path))
            time.sleep(step)

    def renew(self) -> None:
        self.files.setTimes(self.path, int(time.time() * 1000), -1)

    def release(self) -> None:
        if self.held:
            self.files.delete(self.path, False)
            self.held = False

    def __enter__(self) -> WriterLock:
        self.claim()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def publish(version: Callable[[], object], build: Callable[[], object], write: Callable[[object], None], lock: WriterLock, again: int = 2) -> bool:
    """Build a result outside the lock and write it under the lock if the version it was built from still stands; else
    build again, at most ``again`` times more. False if it never stood."""
    for _ in range(1 + again):
        seen = version()
        result = build()
        with lock:
            if version() == seen:
                write(result)
                return True
    return False
