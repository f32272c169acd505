"""Stages of a job, each from one DataFrame to the next, with retries, timeouts, policies for failures, interceptors, and resumption.

Given a folder, every stage's rows are written there within the stage, so that errors of executors are the stage's own: they are tried again, and
the policy sees them. The jobs of an attempt are a job group, which a timeout cancels. An attempt writes to a folder of its own, and a marker, put in place by a
rename, names the one that counts: what a lost attempt left is never read. A later run with the same folder takes stages up to the first one that is not
committed, or was committed as another version or from other input, from their markers.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.graph import topological

Step = Callable[[DataFrame], DataFrame]
Interceptor = Callable[[str, DataFrame], None]
#: Which attempt of its stage a step is in, from 0.
ATTEMPT: ContextVar[int] = ContextVar("attempt", default=0)
#: Seconds between cancellations of what a stage starts after its time is up.
AGAIN = 0.2


class StageTimeout(RuntimeError):
    """A stage took longer than it may."""


@dataclass(frozen=True)
class Stage:
    """A step with its name, the names of those it needs, how often it is tried again after how many seconds, and how long an attempt may take.

    What its failure does: ``fail`` the run, ``continue`` with the rows as they came, or ``skip`` what needs it as well. A changed ``version`` is not resumed.
    """

    name: str
    step: Step
    needs: tuple[str, ...] = ()
    retries: int = 0
    wait: float = 0.0
    on_failure: str = "fail"
    timeout: float | None = None
    version: str = "1"


class _Folder:
    """A folder of the shared store: markers by name, read and put in place whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.store = self.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.hadoop.fs.Path(f"{self.path}/{name}")

    def marker(self, name: str) -> dict | None:
        at = self._at(f"{name}/committed.json")
        if not self.store.exists(at):
            return None
        stream = self.store.open(at)
        try:
            return json.loads(bytes(self.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, name: str, told: dict) -> None:
        made, at = self._at(f"{name}/{uuid.uuid4().hex}.json"), self._at(f"{name}/committed.json")
        stream = self.store.create(made, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        self.store.delete(at, False)
        if not self.store.rename(made, at):
            raise OSError(f"{at} could not be put in place")


def _told(interceptors: list[Interceptor], name: str, rows: DataFrame) -> list[str]:
    """What went wrong in interceptors, which never stops a run."""
    warnings = []
    for f in interceptors:
        try:
            f(name, rows)
        except Exception as e:  # noqa: BLE001
            warnings.append(f"{type(e).__name__}: {e}")
    return warnings


@contextmanager
def _limited(spark: SparkSession, name: str, seconds: float | None):
    """Jobs started here are one group; when the time is up, it is cancelled, and again until the step has noticed."""
    context, group, over, done = spark.sparkContext, f"stage-{name}-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    kept = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while not done.wait(AGAIN):
                context.cancelJobGroup(group)

    context.setJobGroup(group, f"stage {name}", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True) if seconds else None
    if watcher:
        watcher.start()
    try:
        yield
        if over.is_set():
            raise StageTimeout(f"over {seconds:g} s")
    except Exception as e:
        if over.is_set() and not isinstance(e, StageTimeout):
            raise StageTimeout(f"over {seconds:g} s") from e
        raise
    finally:
        done.set()
        if watcher:
            watcher.join()
        for k, v in kept.items():
            context.setLocalProperty(k, v)


def _key(stage: Stage, before: str) -> str:
    return hashlib.sha256(f"{len(stage.name)}:{stage.name}{len(stage.version)}:{stage.version}{before}".encode()).hexdigest()


def run(stages: list[Stage], rows: DataFrame, before: list[Interceptor] | None = None, after: list[Interceptor] | None = None, folder: str | None = None, origin: str = "") -> tuple[DataFrame, list[dict]]:
    """The rows that the stages make, in an order that respects needs, and a log entry for each: ``stage``, ``status``, ``attempts``, ``error``, ``warnings``.

    With a ``folder``, stages are written there and resumed from there; ``origin`` then says what the first rows are, and those of another origin are not taken for the same.
    Without one, steps are as lazy as they are written, and only what fails while a step is called is seen.
    A status is ``done``, ``resumed``, ``continued`` or ``skipped``. What is continued or skipped hands the rows on as they came; what needs a skipped stage is skipped too.
    """
    by, spark = {s.name: s for s in stages}, rows.sparkSession
    store, key = _Folder(spark, folder) if folder else None, origin
    log, skipped = [], set()
    for name in topological(by, {s.name: s.needs for s in stages}):
        stage, error, status, attempts = by[name], "", "", 0
        key, came = _key(stage, key), key
        marker = store.marker(name) if store else None
        if skipped & set(stage.needs):
            status = "skipped"
        elif marker and marker["key"] == key:
            rows, status = spark.read.parquet(marker["path"]), "resumed"
        warnings = _told(before or [], name, rows) if status != "resumed" else []
        while not status and attempts <= stage.retries:
            if attempts and stage.wait:
                time.sleep(stage.wait)
            token = ATTEMPT.set(attempts)
            attempts += 1
            try:
                with _limited(spark, name, stage.timeout):
                    made = stage.step(rows)
                    if store:
                        path = f"{store.path}/{name}/{uuid.uuid4().hex}"
                        made.write.parquet(path)
                        made = spark.read.schema(made.schema).parquet(path)
                if store:
                    store.commit(name, {"key": key, "path": path})
                rows, status = made, "done"
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
            finally:
                ATTEMPT.reset(token)
        if not status:
            if stage.on_failure not in ("continue", "skip"):
                raise RuntimeError(f"stage {name} failed: {error}")
            status = "skipped" if stage.on_failure == "skip" else "continued"
        if status == "skipped":
            skipped.add(name)
        if status in ("skipped", "continued"):
            key = came  # the rows are those that came
        elif status == "done":
            warnings += _told(after or [], name, rows)
        log.append({"stage": name, "status": status, "attempts": attempts, "error": error, "warnings": warnings})
    return rows, log
