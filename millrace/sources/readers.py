"""Sources by scheme, composable readers and lenient forms of them."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Reader = Callable[[DataFrame], DataFrame]


# -- by scheme --------------------------------------------------------------------------------


def open_urls(spark: SparkSession, urls: list[str | list[str]]) -> DataFrame:
    """(url, value) rows of any inputs; a list among the urls is a replica set."""
    groups: dict[str, list] = {}
    for u in urls:
        groups.setdefault("replicas" if isinstance(u, list) else split_scheme(u)[0] or "file", []).append(u)
    out: DataFrame | None = None
    for kind, some in groups.items():
        d = SCHEMES[kind](spark, some)
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "url string, value string")


def split_scheme(url: str) -> tuple[str, str]:
    head, mark, tail = url.partition("://")
    return (head, tail) if mark else ("", url)


def literals(spark: SparkSession, urls: list[str]) -> DataFrame:
    """raw://x is the text x itself."""
    return spark.createDataFrame([(u, split_scheme(u)[1]) for u in urls], "url string, value string")


def urls_as_data(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u, u) for u in urls], "url string, value string")


def files(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Lines of files; a path has to be reachable from every executor."""
    return spark.read.text([split_scheme(u)[1] if u.startswith("file://") else u for u in urls]).select(F.col("_metadata.file_path").alias("url"), "value")


def native_files(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Lines from any file system that Spark itself reaches (hdfs, s3a, ...); s3:// becomes s3a://, an empty key no rows."""
    some = [re.sub("^s3://", "s3a://", u) for u in urls if not re.fullmatch(r"s3a?://[^/]+/?", u)]
    return spark.read.text(some).select(F.col("_metadata.file_path").alias("url"), "value") if some else spark.createDataFrame([], "url string, value string")


def http(spark: SparkSession, urls: list[str]) -> DataFrame:
    return replicas(spark, [[u] for u in urls])


def replicas(spark: SparkSession, sets: list[list[str]]) -> DataFrame:
    spark.dataSource.register(ReplicaSource)
    return spark.read.format("replicas").option("sets", json.dumps(sets)).load().select("url", "value")


def directory(spark: SparkSession, urls: list[str], labels: list[int] | None = None) -> DataFrame:
    """dir:// of a folder that is partitioned by label: only wanted labels are read."""
    d = spark.read.parquet(*[split_scheme(u)[1] for u in urls])
    return d if labels is None else d.where(F.col("label").isin(labels))


SCHEMES: dict[str, Callable[[SparkSession, list], DataFrame]] = {"raw": literals, "url": urls_as_data, "file": files, "http": http, "https": http, "replicas": replicas, "hdfs": native_files, "s3": native_files, "s3a": native_files}


# -- replica sets -------------------------------------------------------------------------------


class DataError(ValueError):
    """A replica that can't be read to its end."""


class _Set(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class ReplicaSource(DataSource):
    """Lines of replica sets, one partition each. Where a replica fails, the next one goes on after
    the lines already given; only when all fail does the query."""

    @classmethod
    def name(cls) -> str:
        return "replicas"

    def schema(self) -> str:
        return "url string, value string, position bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ReplicaReader(self.options.get("sets", ""))


class _ReplicaReader(DataSourceReader):
    def __init__(self, sets: str):
        self.sets = json.loads(sets or "[]")

    def partitions(self) -> list[InputPartition]:
        return [_Set(s) for s in self.sets]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        given = 0
        errors: list[str] = []
        for url in partition.urls:
            try:
                for k, line in enumerate(stream_lines(url)):
                    if k >= given:
                        yield (url, line, given)
                        given += 1
                return
            except (OSError, ValueError) as e:
                errors.append(f"{url}: {e}")
        raise DataError("; ".join(errors))


def stream_lines(url: str, piece: int = 10 << 20) -> Iterator[str]:
    """A URL's lines; HTTP in ranges of 10 MB, with growing pauses where the server is busy. ``fail://n/...``
    gives the rest's first n lines and fails: it is there for tests."""
    kind, rest = split_scheme(url)
    if kind == "raw":
        yield from rest.split("\n")
    elif kind == "fail":
        n, _, text = rest.partition("/")
        yield from text.split("\n")[: int(n)]
        raise DataError("broken replica")
    elif kind in ("http", "https"):
        yield from _http_lines(url, piece)
    else:
        with (gzip.open if url.endswith(".gz") else open)(rest if kind == "file" else url, "rt", encoding="utf-8", errors="replace", newline="\n") as f:
            for line in f:
                yield line.rstrip("\n")


def _http_lines(url: str, piece: int, tries: int = 9) -> Iterator[str]:
    import random
    import time
    import urllib.error
    import urllib.request

    at, total, left = 0, None, b""
    while total is None or at < total:
        for attempt in range(tries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={at}-{at + piece - 1}"}), timeout=60) as r:
                    data = r.read()
                    span = r.headers.get("Content-Range")
                break
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    data, span = b"", f"*/{at}"
                    break
                if e.code != 503 or attempt == tries:
                    raise DataError(f"status {e.code}") from e
            except (urllib.error.URLError, ConnectionError) as e:
                if attempt == tries:
                    raise DataError(str(e)) from e
            time.sleep(random.uniform(0, 2**attempt))
        total = int(span.rpartition("/")[2]) if span and span.rpartition("/")[2].isdigit() else at + len(data)
        at += len(data)
        if not data:
            break
        *whole, left = (left + data).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole)
    if left:
        yield left.decode("utf-8", "replace")


# -- readers: DataFrame (url, value) to rows ---------------------------------------------------------


def chain(*readers: Reader) -> Reader:
    """Readers one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for r in readers:
            df = df.transform(r)
        return df

    return run


def lines(column: str = "value") -> Reader:
    """Rows of the text's lines, in a column of that name; a last empty line is none."""
    return lambda df: df.select(*[c for c in df.columns if c != column], F.explode(F.split(F.regexp_replace(column, "\n\\z", ""), "\n")).alias(column)).where(F.col(column).isNotNull())


def regex_rows(pattern: str, groups: list[str], column: str = "value", tail: str | None = None) -> Reader:
    """Matches one after the other from a text's start on, a row of groups each; at the first text that
    doesn't match it stops, and with ``tail`` gives what is left in a column of that name."""
    import pandas as pd
    from pyspark.sql import types as T

    def read(df: DataFrame) -> DataFrame:
        keep = [f for f in df.schema.fields if f.name != column]
        names = [*groups, *([tail] if tail else [])]
        schema = T.StructType([*keep, T.StructField("position", T.IntegerType()), *[T.StructField(g, T.StringType()) for g in names]])
        exp = re.compile(pattern)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for row in f[[k.name for k in keep] + [column]].itertuples(index=False):
                    *kept, text = row
                    at, k = 0, 0
                    while text and (m := exp.match(text, at)) and m.end() > at:
                        out.append((*kept, k, *m.groups(), *([None] if tail else [])))
                        at, k = m.end(), k + 1
                    if tail and text and at < len(text):
                        out.append((*kept, k, *[None] * len(groups), text[at:]))
                yield pd.DataFrame(out, columns=[x.name for x in schema.fields])

        return df.mapInPandas(run, schema)

    return read


def gzip_files(spark: SparkSession, paths: list[str], lenient: bool = False) -> DataFrame:
    """Lines of compressed files; leniently, a damaged one gives the lines before the damage."""
    if not lenient:
        return spark.read.text(paths)
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for f in frames:
            for content in f["content"]:
                got = []
                try:
                    for line in gzip.open(io.BytesIO(content), "rb"):
                        got.append(line.rstrip(b"\n").decode("utf-8", "replace"))
                except (OSError, EOFError):
                    pass
                yield pd.DataFrame({"value": got})

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "value string")


def csv(spark: SparkSession, paths: list[str], schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(**options).csv(paths)


def xml(spark: SparkSession, paths: list[str], tag: str, schema: str | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", tag)
    return (r.schema(schema) if schema else r).load(paths)


def netstrings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text pairs 'length key length value' line by line: k, v."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame(list(parse_netstrings(content)), columns=["k", "v"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "k string, v string")


def parse_netstrings(data: bytes) -> Iterator[tuple[str, str]]:
    at = 0

    def one() -> str:
        nonlocal at
        space = data.find(b" ", at)
        if space < 0 or not data[at:space].isdigit():
            raise DataError("a length is missing")
        n = int(data[at:space])
        got = data[space + 1 : space + 1 + n]
        if len(got) < n:
            raise DataError("a text is cut short")
        at = space + 1 + n + 1
        return got.decode("utf-8", "replace")

    while at < len(data):
        k = one()
        yield k, one()


def presets(spark: SparkSession) -> dict[str, Callable[[list[str]], DataFrame]]:
    """Named readers: plain lines, earlier results, compressed lines, compressed lines as far as they go."""
    return {
        "default": lambda p: spark.read.text(p),
        "chain": lambda p: spark.read.parquet(*p),
        "gzip": lambda p: gzip_files(spark, p),
        "gzip_line": lambda p: gzip_files(spark, p, lenient=True),
    }


def list_pairs(df: DataFrame, key: str, values: str) -> DataFrame:
    """A store of lists by key as (k, v) pairs: a row for each element."""
    return df.select(F.col(key).alias("k"), F.explode(values).alias("v"))


def resolve(url: str, master: str = "localhost") -> str:
    """tag://name on the session's own catalog as tag://master/name."""
    kind, rest = split_scheme(url)
    return f"{kind}://{master}/{rest}" if kind == "tag" and "/" not in rest else url


def host_port(url: str) -> tuple[str, int | None]:
    u = urlsplit(url)
    return u.hostname or "", u.port
