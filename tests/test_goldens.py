"""Documented results of small jobs, restated."""

import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.functions import pyfuncs as P
from millrace.functions import scalars as S
from millrace.operators import core as O
from millrace.plans import classic, jobs, pipeline, workloads
from millrace.sources import readers, sinks
from millrace.sources.catalog import Catalog, NoPrivilege, blob_name, canonical, relative, safe_name

PRIMES = [3, 5, 7, 11, 13, 17, 19, 23, 29, 31]


def _values(spark, items):
    return spark.createDataFrame([(str(x),) for x in items], "value string")


def test_primes_both_reduce_forms(spark):
    lines = _values(spark, [p for p in PRIMES for _ in range(10)])
    yields = classic.ClassicJob(map=lambda r, p: [(int(r[0]), r[0])], reduce=lambda rows, p: sorted(rows), map_schema="k int, v string", reduce_schema="k int, v string")
    adds = yields.resolved(reduce=lambda rows, out, p: [out.add(k, v) for k, v in sorted(rows)])
    for job in (yields, adds):
        assert [tuple(r) for r in job.result(lines).collect()] == [(p, str(p)) for p in PRIMES for _ in range(10)]


def test_pipeline_of_two_stages_and_of_many(spark):
    lines = _values(spark, [p for p in PRIMES for _ in range(10)])

    def spread(out, state, label, records, params):
        for v in records:
            out.add(v, v, int(v) % 3)

    def gather(out, state, label, records, params):
        for k, v in sorted(records, key=lambda r: int(r[0])):
            out.add(k, v)

    relay = lambda out, state, label, records, params: [out.add(k, v, label) for k, v in records]
    middle = [(g, pipeline.Stage(f"m{i}", relay)) for i, g in enumerate(["group_node_label", "group_label", "split", "group_node"] * 2)]
    for steps in ([("split", pipeline.Stage("map", spread)), ("group_all", pipeline.Stage("reduce", gather))], [("split", pipeline.Stage("map", spread)), *middle, ("group_all", pipeline.Stage("reduce", gather))]):
        out = pipeline.run(lines, steps)
        assert [r["k"] for r in out["reduce"].collect()] == [str(p) for p in PRIMES for _ in range(10)]
    with pytest.raises(ValueError):
        pipeline.check([("split", pipeline.Stage("a")), ("split", pipeline.Stage("a"))])
    with pytest.raises(ValueError):
        pipeline.check([("nowhere", pipeline.Stage("a"))])
    assert pipeline.check([("group_label_node", pipeline.Stage("a"), True)])[0][0] == "group_node_label"


def test_empty_input_gives_nothing(spark):
    none = _values(spark, [])
    job = classic.ClassicJob(map=lambda r, p: [(r[0], r[0])], reduce=lambda rows, p: rows)
    assert job.result(none).count() == job.resolved(partitions=None).result(none).count() == job.resolved(partitions=8).result(none).count() == 0
    assert O.group_all(none, F.count("*").alias("n")).count() == 0
    assert pipeline.run(none, [("group_all", pipeline.Stage("a", lambda out, s, l, r, p: out.add("x", "y")))])["a"].count() == 0


def test_classic_plans():
    assert classic.steps(False, False, True, 1) == []
    assert classic.steps(False, True, False, 1) == [("reduce", "group_all")]
    assert classic.steps(True, True, True, 4) == [("map", "split"), ("map_shuffle", "group_node"), ("reduce", "group_label"), ("reduce_shuffle", "group_node")]
    assert classic.steps(True, True, False, 1)[-1] == ("reduce", "group_all")
    assert classic.steps(True, False, True, 9) == [("map", "split"), ("map_shuffle", "group_node")]


def test_params_header_and_sort(spark):
    rows = _values(spark, range(10))
    params = {"x": 5, "f1": lambda a, b: a + b, "f2": lambda a: 1 if a > 10 else 0}
    job = classic.ClassicJob(map=lambda r, p: [(int(r[0]), p["f2"](p["f1"](int(r[0]), p["x"])))], params=params, partitions=None, map_schema="k int, v int")
    assert {tuple(r) for r in job.result(rows).collect()} == {(k, int(k + 5 > 10)) for k in range(10)}
    skipped = O.map_python(_values(spark, ["skip", *range(5)]).coalesce(1), lambda r, p: [(int(r[0]) + p["add"],)], "k int", {"add": 10}, lambda it, p: (next(it), p.update(add=1110)))
    assert sorted(r[0] for r in skipped.collect()) == [1110 + k for k in range(5)]
    d = O.sort_in_labels(_values(spark, "zyxabc"), S.key_hash_label("value", 3), 3, "value")
    parts = [[r["value"] for r in p] for p in d.rdd.glom().collect() if p]
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 6


def test_hash_and_range_labels(spark):
    import hashlib

    keys = [str(k) for k in range(500)] + ["", "é"]
    got = {r[0]: r[1] for r in _values(spark, keys).select("value", S.key_hash_label("value", 160)).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 160 for k in keys}
    got = {r[0]: r[1] for r in spark.range(0, 101).select("id", S.range_label("id", 0, 100, 6)).collect()}
    assert got == {k: round(k / 100 * 5) for k in range(101)}


def test_groupings(spark):
    outputs = spark.createDataFrame([(1, 0, 5, 10, "node1"), (2, 0, 5, 20, "node2")], "task_id int, out_id int, label int, size bigint, host string")
    assert pipeline.groups(outputs, "group_label").count() == 1 and pipeline.groups(outputs, "group_node_label").count() == 2
    more = outputs.union(spark.createDataFrame([(3, 0, 5, 5, "node3")], outputs.schema))
    change = lambda g: [(r["host"], r["what"]) for r in pipeline.new_and_grown(pipeline.groups(outputs, g), pipeline.groups(more, g)).collect()]
    assert change("group_node") == [("node3", "new")] and change("group_all") == [(None, "grown")]


def test_joins(spark):
    a = spark.createDataFrame(list(enumerate(["alpha", "beta", "gamma", "delta", "epsilon"], 1)), "id int, w string")
    b = spark.createDataFrame(list(enumerate(["who", "what", "where", "when", "why", "how"], 1)), "id int, w string")
    assert {r["id"] for r in O.union_join(a, b, "id").collect()} == {1, 2, 3, 4, 5}
    cities = spark.createDataFrame([("Edmonton", -45), ("Calgary", -35), ("Montreal", -25), ("Toronto", -15)], "city string, temp int")
    packages = spark.createDataFrame([(0, "Edmonton"), (1, "Calgary"), (2, "Edmonton")], "id int, city string")
    j = O.lookup_join(packages, cities, ["city"])
    assert sorted((r["city"], r["n"]) for r in O.two_level_count(j, "city", S.key_hash_label("city", 160)).collect()) == [("Calgary", 1), ("Edmonton", 2)]


def test_consecutive_keys(spark):
    d = spark.createDataFrame(list(enumerate("aaba")), "at int, k string")
    assert [(r["k"], r["n"]) for r in O.consecutive(d, "k", ["at"]).orderBy("run").collect()] == [("a", 2), ("b", 1), ("a", 1)]
    assert [(k, list(v)) for k, v in P.runs([("a", 1), ("a", 2), ("b", 3), ("a", 4)])] == [("a", [1, 2]), ("b", [3]), ("a", [4])]


def test_pagerank(spark):
    # eleven pages: a page without links out links to nothing
    links = {1: [2], 2: [1], 3: [0, 1], 4: [1, 3, 5], 5: [1, 4], 6: [1, 4], 7: [1, 4], 8: [1, 4], 9: [4], 10: [4]}
    nodes = spark.createDataFrame([(k,) for k in range(11)], "node int")
    edges = spark.createDataFrame([(a, b, 1 / len(t)) for a, t in links.items() for b in t], "src int, dst int, w double")
    got = {r["node"]: r["score"] for r in workloads.pagerank(nodes, edges, 10).collect()}
    want = dict.fromkeys(range(11), 1.0)
    for _ in range(10):
        want = {n: 0.15 + 0.85 * sum(want[a] / len(t) for a, t in links.items() if n in t) for n in want}
    assert got == pytest.approx(want)


def test_bayes_and_kmeans_and_tours(spark):
    train = workloads.bayes_train(spark.createDataFrame([("android", "cheap"), ("apple", "expensive"), ("android", "cheap"), ("android", "cheap")], "cls string, feature string"))
    got = {(r["id"], r["cls"]): r["score"] for r in workloads.bayes_predict(spark.createDataFrame([(1, "cheap"), (2, "expensive")], "id int, feature string"), train).collect()}
    assert got[1, "android"] == pytest.approx(math.log(4 / 5), abs=1e-8) and got[2, "apple"] > got[2, "android"]
    points = spark.createDataFrame([(1, [1.0, 4.0]), (2, [1.0, 3.0]), (3, [2.0, 3.0]), (4, [6.0, 1.0]), (5, [7.0, 1.0]), (6, [7.0, 2.0])], "id int, x array<double>")
    centres, placed = workloads.kmeans(points, [[0.0, 5.0], [9.0, 0.0]], 3)
    assert centres == [pytest.approx([4 / 3, 10 / 3]), pytest.approx([20 / 3, 4 / 3])]
    assert placed.groupBy("c").count().where("count = 3").count() == 2
    import itertools
    import random

    r = random.Random(1)
    graph = [[0 if a == b else r.randint(1, 50) for b in range(7)] for a in range(7)]
    best = min((P.tour_cost(graph, [0, *p]), [0, *p]) for p in itertools.permutations(range(1, 7)))
    assert [tuple(x) for x in workloads.shortest_tour(spark, graph, 0).collect()] == [best]
    assert sorted(tuple(P.tour(k, [1, 2, 3])) for k in range(6)) == sorted(itertools.permutations([1, 2, 3]))


def test_registered_rounds(spark, tmp_path):
    """Ten rounds, k-means from a pass over all points, against brute force."""
    import hashlib
    import random
    from collections import Counter

    from millrace.plans import registry

    r = random.Random(3)
    points = [(k, [r.random(), r.random()]) for k in range(400)]
    spark.createDataFrame(points, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = [(row["vec_id"], row["embedding"]) for row in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]

    def sizes(rounds):
        of = {k: int(hashlib.md5(str(k).encode()).hexdigest(), 16) % 4 for k, _ in points}
        for _ in range(rounds + 1):
            means = [[sum(x) / len(x) for x in zip(*[v for k, v in points if of[k] == c])] for c in range(4)]
            of = {k: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))[1] for k, v in points}
        return Counter(of.values())

    got = {row["c"]: row["n"] for row in registry.QUERIES["job_05_iterated_kmeans"](spark, str(tmp_path)).collect()}
    assert got == sizes(10) != sizes(3)

    users = [r.randrange(12) for _ in range(60)]
    spark.createDataFrame(list(enumerate(users)), "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    edges = set(zip(users, users[1:]))
    out = Counter(a for a, _ in edges)
    want = [dict.fromkeys(users, 1.0)]
    for _ in range(10):
        want.append({n: 0.15 + 0.85 * sum(want[-1][a] / out[a] for a, b in edges if b == n) for n in want[0]})
    got = {row["node"]: row["score"] for row in registry.QUERIES["joi_04_pagerank_full"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want[10], abs=1e-6) and got != pytest.approx(want[3], abs=1e-6)


def test_boolean_queries(spark):
    index = sinks.key_value_map(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "k string, v int"))
    ask = lambda q: sorted(r["v"] for r in workloads.query_map(index, q).collect())
    assert (ask("a"), ask("a | c"), ask("a & b"), ask("a | b & ~a"), ask("none")) == ([1, 2], [1, 2, 4], [2], [3], [])


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    first = c.tag("t", [["http://h/one$1"]])
    assert c.tag("t", []) == first and c.tag("t", [["http://g/one$2"]], update=True) == first
    for k in range(3):
        c.tag("t", [[f"http://h/x{k}"]], update=True, delayed=True)
    c.flush()
    assert [u[0] for u in c.urls("t")] == ["http://h/x2", "http://h/x1", "http://h/x0", "http://h/one$1"]
    c.tag("t", [["tag://t"], ["tag://u"]])
    assert [t for t, _, _ in c.findtags("t")] == ["t", "u"] and len(list(c.walk("t"))) == 2
    c.setattr("t", "a", "1")
    with pytest.raises(ValueError):
        c.setattr("t", "sys:mine", "1")
    assert c.attrs("t") == {"a": "1"}
    c.tag("s", [["raw://x"]], token="secret")
    for call in (lambda: c.get("s"), lambda: c.tag("s", [["raw://y"]]), lambda: c.delete("s", "wrong")):
        with pytest.raises(NoPrivilege):
            call()
    assert c.exists("s") and c.urls("s", "secret") == [["raw://x"]]
    c.delete("t")
    c.delete("t")
    assert not c.exists("t") and c.list() == ["s"]
    with pytest.raises(ValueError):
        c.tag("bad name", [["raw://x"]])
    assert (safe_name("a b/c"), blob_name("http://h/p/q$1-2"), canonical("x", "m"), relative("tag://m/x")) == ("a_b_c", "q", "tag://m/x", "tag://x")
    c.upload("blob", spark.range(2))
    with pytest.raises(Exception):
        c.upload("blob", spark.range(2))


def test_jobs(spark, tmp_path):
    registry = jobs.Jobs(spark, str(tmp_path))
    job = registry.run("two", lambda s: {"map": s.range(3), "reduce": s.range(1)})
    assert registry.status(job.name) == "ready" and registry.results(job.name, "map").count() == 3 and registry.results(job.name).count() == 1
    at, lines = registry.events(job.name)
    assert len(lines) == 3 and registry.events(job.name, at) == (at, []) and registry.matching_events(job.name, "STARTS")
    with pytest.raises(jobs.JobError):
        registry.run("bad", lambda s: s.range(1).selectExpr("raise_error('no')"))
    dead = registry.names()[-1]
    assert registry.status(dead) == "dead" and registry.status("never") == "unknown"
    with pytest.raises(jobs.JobError):
        registry.wait(job.name, dead)
    for bad in ("a/b", "a.b", ""):
        with pytest.raises(ValueError):
            registry.new_name(bad)
    registry.put(job.name, "k", b"one")
    registry.put(job.name, "k", b"two")
    assert registry.get(job.name, "k") == b"two" and registry.keys(job.name) == ["k"] and registry.get(job.name, "none") is None
    with pytest.raises(ValueError):
        registry.put(job.name, "no spaces", b"")
    registry.purge(job.name)
    assert registry.status(job.name) == "unknown"
    with pytest.raises(jobs.JobError):
        jobs.JobChain({"a": (lambda i: i[0], ["b"]), "b": (lambda i: i[0], ["a"])}).order()


def test_replicas_and_http(spark):
    class Handler(BaseHTTPRequestHandler):
        busy = [2]

        def do_GET(self):
            if self.path == "/busy" and self.busy[0]:
                self.busy[0] -= 1
                self.send_response(503)
                self.end_headers()
                return
            if self.path == "/fail":
                self.send_error(500)
                return
            body = b"".join(b"line %d\n" % k for k in range(50))
            low, _, high = self.headers["Range"].removeprefix("bytes=").partition("-")
            part = body[int(low) : int(high) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {low}-{high}/{len(body)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert list(readers.stream_lines(f"{base}/x", piece=64)) == [f"line {k}" for k in range(50)]
        assert len(list(readers.stream_lines(f"{base}/busy"))) == 50
        got = readers.open_urls(spark, [[f"{base}/fail", f"{base}/x"], ["fail://1/hello\nthere", "raw://hello\nthere"]])
        assert sorted(r["value"] for r in got.collect()) == sorted([f"line {k}" for k in range(50)] + ["hello", "there"])
    finally:
        server.shutdown()
    with pytest.raises(Exception):
        readers.replicas(spark, [["fail://0/x", "fail://1/x\ny"]]).collect()


def test_readers_and_sinks(spark, tmp_path):
    import gzip

    data = gzip.compress(b"".join(b"row %d\n" % k for k in range(20_000)))
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    n = readers.gzip_files(spark, [str(tmp_path / "cut.gz")], lenient=True).count()
    assert 0 < n < 20_000
    assert list(readers.parse_netstrings(b"1 a 2 bb\n0  1 c\n")) == [("a", "bb"), ("", "c")]
    with pytest.raises(readers.DataError):
        list(readers.parse_netstrings(b"5 ab 1 c\n"))
    rows = readers.regex_rows(r"(\w+) ", ["w"], tail="rest")(_values(spark, ["a b !c d"])).collect()
    assert [(r["w"], r["rest"]) for r in rows] == [("a", None), ("b", None), (None, "!c d")]
    with pytest.raises(Exception):
        sinks.chunks(_values(spark, ["x" * 100]), str(tmp_path / "c"), record_bytes=50)
    assert [tuple(r) for r in _values(spark, ["http://h:1/a/b$2", "x"]).select(S.scheme("value"), S.net_location("value"), S.url_path("value"), S.blob_name("value")).collect()] == [("http", "h:1", "a/b$2", "b"), ("", "", "x", "x")]


def test_command_line(capsys):
    from millrace import cli

    assert cli.main(["queries"]) == 0 and "map_05_word_count" in capsys.readouterr().out
    assert cli.main(["sql", "agg_13_count"]) == 0 and "count(*)" in capsys.readouterr().out


def test_cat_prints_every_row(spark, capsys, monkeypatch):
    from millrace import cli

    def no_show(*args, **kwargs):
        raise AssertionError("show() is capped")

    n = 1_000_003
    monkeypatch.setattr(Catalog, "pull", lambda self, tag: spark.range(n).select(F.col("id").cast("string").alias("value")))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.show", no_show)
    assert cli.main(["cat", "/nowhere", "t"]) == 0
    assert capsys.readouterr().out.splitlines() == [str(k) for k in range(n)]


def test_flat_map_sees_all_rows(spark, tmp_path, monkeypatch):
    from millrace.plans import registry

    rows = [(1, 46.0, "A", "F"), (2, 45.0, "N", "O"), (3, None, "R", "F"), (4, 50.0, None, "O")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, flat_map = [], O.flat_map
    monkeypatch.setattr(O, "flat_map", lambda df, *args, **kwargs: (seen.append(df.count()), flat_map(df, *args, **kwargs))[1])
    got = registry.QUERIES["map_01_flat_map"](spark, str(tmp_path)).collect()
    assert seen == [4] and sorted(map(tuple, got), key=repr) == sorted([(1, "A"), (1, "F"), (4, None), (4, "O")], key=repr)


def test_url_functions_of_other_urls(spark):
    urls = ["http://h", "http://h/", "http://h:1/a/b", "x", "a/b", "", None]
    d = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string")
    got = [tuple(r)[1:] for r in d.select("k", S.scheme("u"), S.net_location("u"), S.url_path("u"), S.job_name("u")).orderBy("k").collect()]
    assert got == [("http", "h", "", ""), ("http", "h", "", "h"), ("http", "h:1", "a/b", "a"), ("", "", "x", None), ("", "", "a/b", "a"), ("", "", "", None), ("", "", None, None)]


def test_commands_on_tags_and_jobs(spark, tmp_path, capsys):
    from millrace import cli
    from millrace.plans.jobs import JobError, Jobs

    root = str(tmp_path)
    out = lambda *args: (cli.main(list(args)), capsys.readouterr().out.splitlines())
    (tmp_path / "in.txt").write_text("one\ntwo\n")
    assert out("push", root, "a", "raw://x", "raw://y")[0] == 0 and out("push", root, "a", "raw://x", "--update")[0] == 0
    assert out("cp", root, "a", "b")[0] == out("touch", root, "e")[0] == out("put", root, "c", "tag://a", "raw://z")[0] == 0
    assert sorted(out("blobs", root, "c")[1]) == ["raw://x", "raw://y", "raw://z"] and out("urls", root, "e")[1] == ["[]"]
    assert out("chunk", root, "d", f"{root}/in.txt")[0] == 0
    assert sorted(out("cat", root, "d")[1]) == ["one", "two"] and out("xcat", root, "raw://hi")[1] == ["hi"]
    assert out("chtok", root, "b", "--write", "w", "--read", "r")[0] == 0
    with pytest.raises(Exception):
        Catalog(spark, root).get("b")
    registry = Jobs(spark, root)
    job = registry.run("good", lambda s: {"map": s.range(3), "reduce": s.range(1)})
    registry.put(job.name, "k", b"v")
    with pytest.raises(JobError):
        registry.run("bad", lambda s: s.read.parquet(f"{root}/nowhere"))
    bad = registry.names()[1]
    assert out("jobs", root)[1] == sorted([f"{job.name} ready", f"{bad} dead"])
    assert out("status", root, job.name)[1] == ["ready"] and out("wait", root, bad)[0] == 1 and out("status", root, "none")[0] == 1
    assert sorted(out("jobresults", root, job.name, "--stage", "map")[1]) == ["[0]", "[1]", "[2]"]
    assert any("map is ready" in x for x in out("events", root, job.name)[1])
    assert out("oob", root, job.name)[1] == ["k"] and out("oob", root, job.name, "k")[1] == ["v"] and out("oob", root, job.name, "none")[0] == 1
    assert out("purge", root, job.name)[0] == 0 and out("jobs", root)[1] == [f"{bad} dead"]
    assert Jobs(spark, root).load().status(job.name) == "unknown"


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    from millrace.sources import scratch

    assert scratch.read_or_empty(spark, f"{tmp_path}/none", "k string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        scratch.read_or_empty(spark, f"{tmp_path}/bad", "k string").count()
    Catalog(spark, f"{tmp_path}/c").tag("t", [["raw://x"]])
    with pytest.raises(Exception):
        scratch.read_or_empty(spark, "nosuch://x/y", "k string").count()


def test_temporary_folders_are_for_local_sessions(spark, monkeypatch):
    from types import SimpleNamespace as N

    from millrace.sources import scratch

    far = N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://h:7077"))
    with pytest.raises(ValueError):
        scratch.folder(far, "x")


def test_letters_of_awkward_texts(spark, tmp_path):
    from millrace.plans import registry

    texts = [None, "", "aB\u212a\u0130z{`", "\u00e9\u4e2d" * 1000 + "q", "x"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["k"]: r["v"] for r in registry.QUERIES["map_06_letters"](spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "b": 1, "k": 1, "i": 1, "z": 1, "q": 1, "x": 1}
