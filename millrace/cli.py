"""Command line: list queries, run one, show its plan or its SQL; look at and end jobs; list, read and change tags.

The root of jobs and of tags is a folder that the cluster shares."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("millrace")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    for name in ("run", "explain", "results"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("data")
        c.add_argument("--out")
        c.add_argument("--show", type=int, default=20)
    sub.add_parser("sql").add_argument("query")
    for name in ("ls", "urls", "attrs", "find", "rm", "exists", "tag", "stat", "getattr", "setattr", "delattr", "cat"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("names", nargs="*")
    for name in ("push", "chunk", "put", "cp", "touch", "blobs", "chtok", "xcat"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("names", nargs="*")
        c.add_argument("--update", action="store_true")
        c.add_argument("--read")
        c.add_argument("--write")
    for name in ("jobs", "status", "events", "jobresults", "wait", "kill", "purge", "oob"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("names", nargs="*")
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--stage")
    a = p.parse_args(args)
    from millrace.plans import registry

    if a.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if a.command == "sql":
        print(registry.ORACLE_SQL.get(a.query, ""))
        return 0
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    if a.command in ("run", "explain", "results"):
        df = registry.QUERIES[a.query](spark, a.data)
        if a.command == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.parquet(a.out)
        else:
            df.show(a.show, truncate=False)
        return 0
    if a.command in ("jobs", "status", "events", "jobresults", "wait", "kill", "purge", "oob"):
        return _job(spark, a)
    from millrace.sources.catalog import Catalog

    c, n = Catalog(spark, a.root), a.names
    if a.command == "ls":
        print("\n".join(c.list(*n[:1])))
    elif a.command == "exists":
        return 0 if c.exists(n[0]) else 1
    elif a.command == "rm":
        for x in n:
            c.delete(x)
    elif a.command == "tag":
        print(c.tag(n[0], [[u] for u in n[1:]]))
    elif a.command == "find":
        for t, links, blobs in c.findtags(*n):
            print(json.dumps([t, links, blobs]))
    elif a.command == "cat":
        for row in c.pull(n[0]).select("value").toLocalIterator():  # a partition at a time
            print("" if row[0] is None else row[0])
    elif a.command == "xcat":
        from millrace.sources import readers

        for row in readers.replicas(spark, [[u] for u in n]).select("value").toLocalIterator():
            print("" if row[0] is None else row[0])
    elif a.command in ("setattr", "delattr"):
        getattr(c, a.command)(*n)
    elif a.command == "touch":
        for x in n:
            c.tag(x, [])
    elif a.command == "put":
        print(c.put(n[0], [[u] for u in n[1:]]))
    elif a.command == "cp":
        print(c.put(n[1], c.urls(n[0])))
    elif a.command == "blobs":
        for b in c.blobs(*n):
            print("\t".join(b))
    elif a.command == "chtok":
        for x in n:
            for kind, token in (("read", a.read), ("write", a.write)):
                if token is not None:
                    c.setattr(x, f"sys:{kind}-token", token)
    elif a.command == "push":
        print(c.tag(n[0], [[u] for u in n[1:]], update=a.update))
    elif a.command == "chunk":
        print(c.tag(n[0], [[u] for u in _chunked(spark, c, n[1:])], update=a.update))
    else:
        what = {"urls": c.urls, "attrs": c.attrs, "stat": c.get, "getattr": c.getattr}[a.command](*n)
        print(json.dumps(what, default=str))
    return 0


def _chunked(spark: SparkSession, catalog, paths: list[str]) -> list[str]:
    """Lines of the files as text files of about a chunk's size, below the catalog's blobs; their urls."""
    import uuid

    from pyspark.sql import functions as F

    lines = spark.read.text(paths)
    mean = lines.agg(F.avg(F.octet_length("value"))).first()[0] or 1
    folder = f"{catalog.root}/blobs/chunks-{uuid.uuid4().hex}"
    lines.write.option("maxRecordsPerFile", max(1, int((64 << 20) / max(1.0, mean)))).text(folder)
    return [f[0] for f in spark.read.text(folder).select(F.input_file_name()).distinct().orderBy(F.input_file_name()).toLocalIterator()]


def _job(spark: SparkSession, a: argparse.Namespace) -> int:
    """Commands on jobs, of this session or of earlier ones."""
    from millrace.plans.jobs import JobError, Jobs

    jobs, n = Jobs(spark, a.root).load(), a.names
    if unknown := [x for x in (n[:1] if a.command == "oob" else n) if jobs.status(x) == "unknown"]:
        print(f"no such job: {unknown[0]}", file=sys.stderr)
        return 1
    if a.command == "jobs":
        print("\n".join(f"{x} {jobs.status(x)}" for x in jobs.names()))
    elif a.command == "status":
        for x in n:
            print(jobs.status(x))
    elif a.command == "events":
        at, lines = jobs.events(n[0], a.offset)
        print("\n".join([*lines, f"# next offset {at}"]))
    elif a.command == "jobresults":
        for row in jobs.rows(n[0], a.stage):
            print(json.dumps(row, default=str))
    elif a.command == "wait":
        try:
            print(json.dumps(jobs.wait(*n)))
        except JobError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "oob":
        if len(n) == 1:
            print("\n".join(jobs.keys(n[0])))
        else:
            value = jobs.get(n[0], n[1])
            if value is None:
                return 1
            sys.stdout.write(value.decode(errors="replace"))
    else:
        for x in n:
            getattr(jobs, a.command)(x)
    return 0


if __name__ == "__main__":
    sys.exit(main())
