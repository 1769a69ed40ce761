"""Queries as jobs: run in the background under a job group, with results, cancellation and timings.

Results are tables in the shared folder, so a lost executor does not take them along.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from .operators.flatten import Extract, From, timed
from .operators.tables import materialize, release
from .plans.graph import Graph
from .plans.traversal import Traversal, paths

Query = "Traversal | From | Extract | Callable[[Graph], DataFrame]"


@dataclass
class Job:
    id: int
    query: Query
    version: int | None
    started: float
    timings: list[tuple[str, int]] = field(default_factory=list)
    future: Future | None = None
    cancelled: bool = False

    @property
    def state(self) -> str:
        if self.cancelled:
            return "cancelled"
        if not self.future.done():
            return "running"
        return "failed" if self.future.exception() else "done"


class JobManager:
    """Runs queries against the version that is newest when they are submitted; of finished jobs the newest ``keep`` stay."""

    def __init__(self, spark: SparkSession, open_graph: Callable[[int | None], Graph], version: Callable[[], int] = lambda: 0, workers: int = 4, keep: int = 100):
        self.spark, self._open, self._version, self._keep = spark, open_graph, version, keep
        self._pool, self._ids, self._jobs = ThreadPoolExecutor(workers), itertools.count(1), {}

    def submit(self, query: Query) -> int:
        """Start a query; returns the job's id."""
        job = Job(next(self._ids), query, self._version(), time.time())
        self._start(job)
        finished = [j.id for j in self._jobs.values() if j.state != "running"]
        for old in finished[: max(0, len(finished) - self._keep)]:
            self.forget(old)
        return job.id

    def _start(self, job: Job) -> None:
        self._jobs[job.id] = job
        job.future = self._pool.submit(inheritable_thread_target(self.spark)(lambda: self._run(job)))

    def _run(self, job: Job) -> DataFrame:
        if job.cancelled:
            raise CancelledError
        self.spark.sparkContext.setJobGroup(f"job-{job.id}", f"query {job.id}", interruptOnCancel=True)
        graph = timed("open", job.timings, lambda: self._open(job.version))
        df = timed("compile", job.timings, lambda: compile_query(graph, job.query))
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
        return timed("execute", job.timings, lambda: materialize(df, f"job-{job.id}"))

    def result(self, job_id: int, timeout: float | None = None, newest: bool = False) -> DataFrame:
        """Wait for a job's table; raises what the job raised, or ``CancelledError``.

        With ``newest`` a job whose version is no longer the newest runs again, under its id, before it answers.
        """
        job = self._jobs[job_id]
        if job.cancelled:
            raise CancelledError
        if newest and job.future.done() and job.version != self._version():
            self.forget(job_id)
            job = Job(job_id, job.query, self._version(), time.time())
            self._start(job)
        return job.future.result(timeout)

    def present(self, job_id: int, renderer: Callable[[DataFrame], str]) -> str:
        job = self._jobs[job_id]
        table = self.result(job_id)
        return timed("present", job.timings, lambda: renderer(table))

    def cancel(self, job_id: int) -> None:
        job = self._jobs[job_id]
        if not job.future.done():
            job.cancelled = True
            job.future.cancel()
            self.spark.sparkContext.cancelJobGroup(f"job-{job_id}")

    def cancel_all(self) -> None:
        for job_id in list(self._jobs):
            self.cancel(job_id)

    def forget(self, job_id: int) -> None:
        """Drop a finished job and the table it wrote."""
        job = self._jobs.pop(job_id)
        if job.future.done() and not job.future.cancelled() and not job.future.exception():
            release(job.future.result())

    def list(self) -> list[dict]:
        return [{"id": j.id, "state": j.state, "version": j.version, "started": j.started, "timings": list(j.timings)} for j in self._jobs.values()]

    def info(self, job_id: int) -> dict:
        return next(j for j in self.list() if j["id"] == job_id)

    def count(self, alive: bool = False) -> int:
        return sum(1 for j in self._jobs.values() if not alive or j.state == "running")

    def close(self) -> None:
        self.cancel_all()
        self._pool.shutdown(wait=False, cancel_futures=True)


def compile_query(graph: Graph, query: Query) -> DataFrame:
    if isinstance(query, From):
        query = query.traversal
    if isinstance(query, Traversal):
        return paths(graph, query)
    return query.run(graph) if isinstance(query, Extract) else query(graph)
