"""Jobs by name: status, stage results, side results, events, chains, profiles, saved results."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import scratch

SIDE_NAME = re.compile(r"[A-Za-z0-9_@:-]+\Z")


class JobError(Exception):
    pass


@dataclass
class Job:
    name: str
    status: str = "active"  # active, ready, dead
    results: dict[str, str] = field(default_factory=dict)  # stage: path
    events: list[str] = field(default_factory=list)
    profile: dict[str, float] = field(default_factory=dict)
    error: str = ""


_KNOWN = "name string, seq bigint, job string"


class Jobs:
    """A registry of jobs; stage results are Parquet folders below ``root``, and so is what is known of each job:
    ``load`` finds it again in another session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jobs = spark, root.rstrip("/"), {}

    def new_name(self, prefix: str) -> str:
        if not prefix or re.search(r"[/.]", prefix):
            raise ValueError("a job's prefix has neither slash nor dot")
        t = time.time_ns()
        return f"{prefix}@{t // 10**15:x}:{t // 10**9 % 10**6:x}:{t % 10**9:x}"

    def run(self, prefix: str, make: Callable[[SparkSession], dict[str, DataFrame] | DataFrame], keep: bool = True) -> Job:
        """Run a plan's stages and keep their results; a failure leaves a dead job and raises."""
        job = Job(self.new_name(prefix))
        self.jobs[job.name] = job
        self.event(job, "job starts")
        self._save(job)
        self.spark.sparkContext.setJobGroup(job.name, prefix, interruptOnCancel=True)
        try:
            made = make(self.spark)
            for stage, df in (made if isinstance(made, dict) else {"result": made}).items():
                path, began = f"{self.root}/jobs/{_file(job.name)}/{stage}", time.time()
                df.write.parquet(path)
                job.results[stage] = path
                job.profile[stage] = time.time() - began
                self.event(job, f"stage {stage} is ready")
            job.status = "ready"
            self._save(job)
        except Exception as e:
            job.status, job.error = "dead", str(e)[:2000]
            self.event(job, "job died")
            self._save(job)
            raise JobError(f"{job.name} died") from e
        return job

    def _save(self, job: Job) -> None:
        row = (job.name, time.time_ns(), json.dumps(vars(job)))
        self.spark.createDataFrame([row], _KNOWN).coalesce(1).write.mode("append").parquet(f"{self.root}/known")

    def load(self) -> Jobs:
        """Jobs of earlier sessions as they were last written; one that was active then may still be, elsewhere."""
        table = scratch.read_or_empty(self.spark, f"{self.root}/known", _KNOWN)
        for r in table.groupBy("name").agg(F.max_by("job", "seq").alias("job")).orderBy("name").collect():
            job = Job(**json.loads(r["job"]))
            if job.status != "purged":
                self.jobs.setdefault(job.name, job)
        return self

    def event(self, job: Job, text: str) -> None:
        job.events.append(json.dumps([time.strftime("%Y/%m/%d %H:%M:%S"), os.uname().nodename, text]))

    def events(self, name: str, offset: int = 0) -> tuple[int, list[str]]:
        """Lines from a byte offset on, and the offset after them."""
        text = "".join(x + "\n" for x in self.jobs[name].events).encode()
        return len(text), text[offset:].decode().splitlines()

    def matching_events(self, name: str, query: str = "", last: int = 1000) -> list[str]:
        return [x for x in self.jobs[name].events if query.lower() in x.lower()][-min(last, 1000) :]

    def status(self, name: str) -> str:
        return self.jobs[name].status if name in self.jobs else "unknown"

    def results(self, name: str, stage: str | None = None) -> DataFrame:
        job = self.jobs[name]
        if not job.results:
            raise JobError(f"{name} has no results")
        return self.spark.read.parquet(job.results[stage] if stage else list(job.results.values())[-1])

    def rows(self, name: str, stage: str | None = None) -> Iterator[tuple]:
        """Result rows one partition at a time."""
        return (tuple(r) for r in self.results(name, stage).toLocalIterator())

    def wait(self, *names: str) -> dict[str, str]:
        if dead := [n for n in names if self.status(n) == "dead"]:
            raise JobError(f"{dead[0]} died")
        return {n: self.status(n) for n in names}

    def kill(self, name: str) -> None:
        self.spark.sparkContext.cancelJobGroup(name)
        if self.status(name) == "active":
            self.jobs[name].status = "dead"
            self._save(self.jobs[name])

    def purge(self, name: str) -> None:
        """Forget a job and delete its results."""
        job = self.jobs.pop(name)
        for path in (f"{self.root}/jobs/{_file(name)}", self._side_path(name)):
            scratch.delete(self.spark, path)
        job.status = "purged"
        self._save(job)

    def names(self) -> list[str]:
        return list(self.jobs)

    # -- side results: key to bytes, last write wins

    def put(self, name: str, key: str, value: bytes) -> None:
        if not SIDE_NAME.match(key):
            raise ValueError(f"a side result can't be called {key!r}")
        self.side(name)  # the table's folder
        seq = time.time_ns()
        self.spark.createDataFrame([(name, key, bytearray(value), seq)], "job string, key string, value binary, seq bigint").coalesce(1).write.mode("append").parquet(self._side_path(name))

    def _side_path(self, name: str) -> str:
        return f"{self.root}/side/{_file(name)}"

    def side(self, name: str) -> DataFrame:
        schema = "job string, key string, value binary, seq bigint"
        return scratch.read_or_empty(self.spark, self._side_path(name), schema)

    def get(self, name: str, key: str) -> bytes | None:
        row = last_written(self.side(name).where(F.col("key") == key)).first()
        return bytes(row["value"]) if row else None

    def keys(self, name: str) -> list[str]:
        return sorted(r["key"] for r in self.side(name).select("key").distinct().collect())


def _file(name: str) -> str:
    return name.replace(":", "_")


def last_written(side: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    return side.groupBy(key).agg(F.max_by(value, seq).alias(value))


class JobChain:
    """Jobs whose inputs may be other jobs' results; run in an order that has inputs first."""

    def __init__(self, jobs: dict[str, tuple[Callable[[list[DataFrame]], DataFrame], list]]):
        self.jobs = jobs

    def order(self) -> list[str]:
        done: list[str] = []
        while len(done) < len(self.jobs):
            ready = [n for n, (_, inputs) in self.jobs.items() if n not in done and all(not isinstance(i, str) or i not in self.jobs or i in done for i in inputs)]
            if not ready:
                raise JobError("jobs wait for each other")
            done += ready
        return done

    def build(self) -> dict[str, DataFrame]:
        """Each job's DataFrame; lazily, so that Catalyst sees a chain as one plan."""
        out: dict[str, DataFrame] = {}
        for name in self.order():
            make, inputs = self.jobs[name]
            out[name] = make([out[i] if isinstance(i, str) and i in out else i for i in inputs])
        return out
