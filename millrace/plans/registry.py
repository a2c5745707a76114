"""Every query by name, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import pyfuncs as P
from millrace.functions import scalars as S
from millrace.operators import core as O
from millrace.plans import classic, jobs, pipeline, tasks, workloads
from millrace.sources import readers, scratch, sinks
from millrace.sources.catalog import Catalog
from millrace.streaming import files as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space as SQL's regular expressions spell it.
WS = r"[ \t\n\r\f\x0B]+"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({names})"


WORDS_SQL = f"SELECT unnest(regexp_split_to_array(text, '{WS}')) AS w FROM documents"
CHARS = "abcdefghijklmnopqrstuvwxyz"


# -- 2.1 sources ----------------------------------------------------------------------------------


@query("src_01_scheme_dispatch", values("url, value", "('raw://hello', 'hello')", "('url://x/y', 'url://x/y')", "('raw://b c', 'b c')"))
def _(spark, sf_dir):
    return readers.open_urls(spark, ["raw://hello", "url://x/y", "raw://b c"])


@query("src_02_files", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("src_04_literals", values("value", "('eeny')", "('meeny')", "('miny')", "('moe')"))
def _(spark, sf_dir):
    return readers.literals(spark, [f"raw://{x}" for x in ("eeny", "meeny", "miny", "moe")]).select("value")


@query("src_05_urls_as_data", values("url, value", "('url://a', 'url://a')", "('url://b', 'url://b')"))
def _(spark, sf_dir):
    return readers.urls_as_data(spark, ["url://a", "url://b"])


@query("src_06_internal_file", "SELECT c_custkey AS k, c_name AS v FROM customer")
def _(spark, sf_dir):
    path = scratch.folder(spark, "internal")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")).write.parquet(path)
    return readers.presets(spark)["chain"]([path])


_LABEL = "CAST(CAST('0x' || md5({k}) AS UHUGEINT) % {n} AS INTEGER)"


@query("src_07_label_directory", f"SELECT o_orderkey, o_orderpriority, {_LABEL.format(k='o_orderpriority', n=16)} AS label FROM orders WHERE {_LABEL.format(k='o_orderpriority', n=16)} IN (0, 3, 5, 9, 11)")
def _(spark, sf_dir):
    path = scratch.folder(spark, "labels")
    sinks.labelled(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").withColumn("label", S.key_hash_label("o_orderpriority", 16)), path)
    return readers.directory(spark, [f"dir://{path}"], [0, 3, 5, 9, 11])


def _catalog(spark: SparkSession) -> Catalog:
    c = Catalog(spark, scratch.folder(spark, "catalog"))
    c.tag("a", [["raw://one"], ["raw://two"]], delayed=True)
    c.tag("b", [["raw://three"], ["tag://a"]], delayed=True)
    c.tag("c", [["tag://b"], ["tag://c"]], delayed=True)
    c.flush()
    return c


@query("src_08_tags", values("value", "('one')", "('two')", "('three')"))
def _(spark, sf_dir):
    return _catalog(spark).pull("c").select("value")


@query("src_11_lists_by_key", "SELECT o_custkey AS k, o_orderkey AS v FROM orders")
def _(spark, sf_dir):
    store = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("items"))
    return readers.list_pairs(store, "o_custkey", "items")


@query("src_12_map_reader", "SELECT DISTINCT doc_id AS v FROM documents WHERE lang = 'fr' OR source = 'src3'")
def _(spark, sf_dir):
    return workloads.query_map(_index(spark, sf_dir), "lang:fr | source:src3")


@query("src_13_lines", "SELECT doc_id, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS value FROM documents")
def _(spark, sf_dir):
    return readers.lines()(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))


@query("src_14_regex_reader", r"""SELECT event_id, regexp_extract(props, '^\{"k": (\d+)\}', 1) AS n FROM events WHERE regexp_matches(props, '^\{"k": (\d+)\}')""")
def _(spark, sf_dir):
    read = readers.regex_rows(r'\{"k": (\d+)\}', ["n"], "props")
    return read(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", "n")


@query("src_15_gzip_lines", "SELECT n_name AS value FROM nation")
def _(spark, sf_dir):
    path = scratch.folder(spark, "gzip")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.option("compression", "gzip").text(path)
    return readers.gzip_files(spark, [path], lenient=True)


@query("src_16_earlier_results", "SELECT s_suppkey AS k, s_name AS v FROM supplier")
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    job = registry.run("suppliers", lambda s: table(s, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")))
    return registry.results(job.name)


@query("src_17_pair_text", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation")
def _(spark, sf_dir):
    path = scratch.folder(spark, "pairs")
    sinks.plain(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), path)
    return readers.netstrings(spark, [path])


@query("src_19_strings", values("value", "('a b')", "('c')"))
def _(spark, sf_dir):
    return spark.createDataFrame([("a b",), ("c",)], "value string")


@query("src_20_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf_dir):
    path = scratch.folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return readers.csv(spark, [path], "c_custkey bigint, c_name string, c_mktsegment string", header=True)


@query("src_21_xml", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    path = scratch.folder(spark, "xml")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.format("xml").option("rootTag", "nations").option("rowTag", "nation").save(path)
    return readers.xml(spark, [path], "nation", "n_nationkey int, n_name string")


@query("src_22_stream_chain", "SELECT 'b' || 'a' || n_name AS value FROM nation")
def _(spark, sf_dir):
    prefix = lambda p: lambda d: d.withColumn("value", F.concat(F.lit(p), "value"))
    return readers.chain(prefix("a"), prefix("b"))(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")))


@query("src_23_presets", "SELECT r_name AS value FROM region")
def _(spark, sf_dir):
    path = scratch.folder(spark, "preset")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).write.text(path)
    return readers.presets(spark)["default"]([path])


_NAMES = "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"


def _two(spark, sf_dir):
    return [table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))]


@query("src_24_serial_input", _NAMES)
def _(spark, sf_dir):
    return O.union_all(_two(spark, sf_dir))


@query("src_25_parallel_input", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def _(spark, sf_dir):
    return O.union_all([table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))])


@query("src_26_merged_input", f"SELECT name, row_number() OVER (ORDER BY name) AS place FROM ({_NAMES})")
def _(spark, sf_dir):
    merged = O.merge_sorted(_two(spark, sf_dir), "name")  # a few dozen names
    return merged.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("name")).cast("bigint"))


@query("src_27_replica_failover", values("value", "('hello')", "('there')", "('again')"))
def _(spark, sf_dir):
    return readers.open_urls(spark, [["fail://1/hello\nthere", "fail://0/x", "raw://hello\nthere"], "raw://again"]).select("value")


@query("src_28_result_reader", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation")
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    job = registry.run("nations", lambda s: table(s, sf_dir, "nation").select("n_nationkey"))
    got = [r[0] for r in registry.rows(job.name)]  # 25 rows, read as a client reads them
    return spark.createDataFrame([(len(got), sum(got))], "n bigint, s bigint")


# -- 2.2 sinks --------------------------------------------------------------------------------------


@query("snk_01_labelled_output", f"SELECT {_LABEL.format(k='c_name', n=8)} AS label, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    path = scratch.folder(spark, "out")
    sinks.labelled(table(spark, sf_dir, "customer").select("c_name").withColumn("label", S.key_hash_label("c_name", 8)), path)
    return readers.directory(spark, [path]).groupBy("label").agg(F.count("*").alias("n"))


@query("snk_03_internal_format", "SELECT p_partkey AS k, p_name AS v FROM part")
def _(spark, sf_dir):
    path = scratch.folder(spark, "internal")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query("snk_04_plain_text", "SELECT strlen(CAST(p_partkey AS VARCHAR)) || ' ' || p_partkey || ' ' || strlen(p_name) || ' ' || p_name AS value FROM part")
def _(spark, sf_dir):
    path = scratch.folder(spark, "plain")
    sinks.plain(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), path)
    return spark.read.text(path)


@query("snk_05_key_value_map", "SELECT c_mktsegment AS k, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS items FROM customer GROUP BY 1")
def _(spark, sf_dir):
    d = sinks.key_value_map(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_nationkey").alias("v")), unique=True)
    return d.select("k", F.array_join("values", ",").alias("items"))


@query("snk_07_saved_results", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    c = Catalog(spark, scratch.folder(spark, "catalog"))
    tag = sinks.save_as(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), c, "job1", scratch.folder(spark, "saved"))
    return spark.read.parquet(*[u[0] for u in c.urls(tag)])


@query("snk_09_chunks", "SELECT doc_id, text AS value FROM documents")
def _(spark, sf_dir):
    path = scratch.folder(spark, "chunks")
    sinks.chunks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")), path)
    return spark.read.parquet(path)


@query("snk_10_pushed_files", "SELECT CAST(sum(octet_length(encode(n_name)) + 1) AS BIGINT) AS bytes FROM nation")
def _(spark, sf_dir):
    path, out = scratch.folder(spark, "files"), scratch.folder(spark, "pushed")
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.text(path)
    sinks.push(spark, [path], out)
    return spark.read.parquet(out).agg(F.sum(F.octet_length("data")).cast("bigint").alias("bytes"))


@query("snk_11_side_results", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def _(spark, sf_dir):
    return jobs.last_written(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq")))


# -- 2.3 map ----------------------------------------------------------------------------------------


@query("map_01_flat_map", "SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS k FROM lineitem WHERE l_quantity > 45")
def _(spark, sf_dir):
    # all rows reach the flat map; those of a small quantity, or of none, yield nothing
    items = F.when(F.col("l_quantity") > 45, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>"))
    return O.flat_map(table(spark, sf_dir, "lineitem"), items, "l_orderkey")


@query("map_02_identity", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def _(spark, sf_dir):
    return classic.ClassicJob(map=classic.nop_map, partitions=None).result(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))


@query("map_04_grep", "SELECT doc_id, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE regexp_matches(value, '^(?:The|La) [a-z]+')")
def _(spark, sf_dir):
    return O.grep(readers.lines()(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))), "(?:The|La) [a-z]+")


@query("map_05_word_count", f"SELECT w AS k, CAST(count(*) AS BIGINT) AS v FROM ({WORDS_SQL}) WHERE w <> '' GROUP BY 1")
def word_count(spark, sf_dir):
    return O.flat_map(table(spark, sf_dir, "documents"), S.words("text")).groupBy("k").agg(F.count("*").alias("v"))


@query("map_06_letters", "SELECT c AS k, CAST(count(*) AS BIGINT) AS v FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c >= 'a' AND c <= 'z' GROUP BY 1")
def _(spark, sf_dir):
    # one look at each byte: letters a to z are single bytes in UTF-8, and no other character has such bytes
    def letters(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for b in batches:
            texts = b.column(0)
            width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            ends = np.frombuffer(texts.buffers()[1], width)[[texts.offset, texts.offset + len(texts)]] if len(texts) else (0, 0)
            if ends[1] > ends[0]:
                total += np.bincount(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[1]], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(list(CHARS)), pa.array(total[97:123])], names=["k", "v"])

    counts = table(spark, sf_dir, "documents").select(F.lower("text").alias("text")).mapInArrow(letters, "k string, v bigint")
    return counts.groupBy("k").agg(F.sum("v").alias("v")).where("v > 0")


@query("map_07_clean_words", f"""SELECT w AS k, CAST(count(*) AS BIGINT) AS v FROM (SELECT unnest(regexp_split_to_array(lower(translate(text, '{S.PUNCTUATION.replace("'", "''")}', '')), '{WS}')) AS w FROM documents) WHERE w <> '' GROUP BY 1""")
def _(spark, sf_dir):
    return O.flat_map(table(spark, sf_dir, "documents"), S.clean_words("text")).groupBy("k").agg(F.count("*").alias("v"))


@query("map_08_init_hook", "SELECT CAST(n_nationkey AS BIGINT) + 1110 AS k, n_name AS v FROM nation")
def _(spark, sf_dir):
    def init(rows, params):
        params["add"] += 1000

    rows = O.map_python(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), lambda r, p: [(r[0] + p["add"], r[1])], "k bigint, v string", {"add": 110}, init)
    return rows


@query("map_09_stage_process", "SELECT o_orderstatus AS k, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1")
def _(spark, sf_dir):
    def process(out, state, label, records, params):
        for k, vs in P.runs(records):
            out.add(k, sum(vs), label)

    stage = pipeline.Stage("count", process, "k string, v bigint", combine=True, sort=True)
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("v")).select(S.key_hash_label("o_orderstatus", 4).alias("label"), F.col("o_orderstatus").alias("k"), "v")
    return pipeline.run_stage(rows, "group_label", stage).select("k", "v")


@query("map_10_stage_state", "SELECT CAST(label AS VARCHAR) AS k, CAST(sum(n_nationkey) AS BIGINT) AS v FROM (SELECT n_regionkey AS label, n_nationkey FROM nation) GROUP BY 1")
def _(spark, sf_dir):
    def process(state_out, state, label, records, params):
        for _, v in records:
            state[label] = state.get(label, 0) + v

    stage = pipeline.Stage("sum", process, "k string, v bigint", init=lambda p: {}, done=lambda out, state, p: [out.add(str(k), v, k) for k, v in state.items()], combine=True)
    return pipeline.run_stage(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("label"), F.col("n_name").alias("k"), F.col("n_nationkey").cast("bigint").alias("v")), "group_label", stage).select("k", "v")


@query("map_11_label_order", "SELECT CAST(5 - n_regionkey AS INTEGER) AS place, CAST(n_regionkey AS INTEGER) AS label FROM nation GROUP BY n_regionkey")
def _(spark, sf_dir):
    def process(out, state, label, records, params):
        state.append(label)

    stage = pipeline.Stage("visit", process, "k int, v int", init=lambda p: [], done=lambda out, state, p: [out.add(i, x) for i, x in enumerate(state, 1)], combine=True, input_hook=lambda state, labels: sorted(labels, reverse=True))
    return pipeline.run_stage(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("label"), F.col("n_name").alias("k"), F.col("n_name").alias("v")), "group_all", stage).select(F.col("k").alias("place"), F.col("v").alias("label"))


def _centres(spark, sf_dir):
    return [[float(x) for x in r["embedding"]] for r in table(spark, sf_dir, "embeddings").where("vec_id < 4").orderBy("vec_id").collect()]  # 4 rows


_ASSIGN = "SELECT e.vec_id, e.embedding, CAST(arg_min(c.vec_id, list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))) AS INTEGER) AS c FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 4) c GROUP BY 1, 2"


@query("map_13_nearest_centre", f"SELECT vec_id, c FROM ({_ASSIGN})")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    return d.select("vec_id", O.nearest(d, _centres(spark, sf_dir), "embedding").alias("c"))


def _facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("feature"))
    return d, table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("cls"))


_BAYES = """WITH f AS (SELECT doc_id, unnest(['lang:' || lang, 'source:' || source]) AS feature FROM documents),
r AS (SELECT 'q' || quality AS cls, feature, f.doc_id FROM f JOIN labels USING (doc_id)),
b AS (SELECT cls, feature, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT cls, CAST(sum(n) AS BIGINT) AS cls_n FROM b GROUP BY 1), k AS (SELECT count(DISTINCT feature) AS features FROM r)
"""


@query("map_14_bayes_scores", _BAYES + "SELECT f.doc_id AS id, c.cls, round(sum(ln((coalesce(b.n, 0) + 1) / CAST(c.cls_n + k.features AS DOUBLE))), 9) AS score FROM f CROSS JOIN c CROSS JOIN k LEFT JOIN b ON b.cls = c.cls AND b.feature = f.feature GROUP BY 1, 2")
def _(spark, sf_dir):
    d, labels = _facts(spark, sf_dir)
    return workloads.bayes_predict(d.withColumnRenamed("doc_id", "id"), workloads.bayes_train(d.join(labels, "doc_id").select("cls", "feature")))


# -- 2.4 partition and group -----------------------------------------------------------------------------


@query("prt_01_hash_labels", f"SELECT {_LABEL.format(k='o_orderpriority', n=16)} AS label, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(S.key_hash_label("o_orderpriority", 16).alias("label")).agg(F.count("*").alias("n"))


@query("prt_02_range_labels", "SELECT CAST(round_even((CAST(o_custkey AS DOUBLE) - 1.0) / 1499.0 * 7.0, 0) AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(S.range_label("o_custkey", 1, 1500, 8).alias("label")).agg(F.count("*").alias("n"))


@query("prt_03_custom_labels", "SELECT CAST(o_orderkey % 7 AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return O.to_labels(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 7, 7).groupBy("label").agg(F.count("*").alias("n"))


@query("prt_04_no_partitions", "SELECT n_name AS k, 0 AS label FROM nation")
def _(spark, sf_dir):
    job = classic.ClassicJob(map=lambda r, p: [(r[0], "")], partitions=None)
    out = job.result(table(spark, sf_dir, "nation").select("n_name"))
    # a job without partitions gives rows no label: its one output is label 0
    return out.select("k", F.col("label").cast("int").alias("label") if "label" in out.columns else F.lit(0).alias("label"))


@query("prt_05_label_by_record", f"SELECT {_LABEL.format(k='c_name', n=160)} AS label, CAST(min(c_custkey) AS BIGINT) AS low FROM customer GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(S.key_hash_label("c_name", 160).alias("label")).agg(F.min("c_custkey").alias("low"))


_OUTPUTS = "SELECT CAST(event_id AS INTEGER) AS out_id, CAST(user_id % 5 AS INTEGER) AS label, 1 AS size, 'node' || (event_id % 3) AS host FROM events"


def _outputs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("out_id"), (F.col("user_id") % 5).cast("int").alias("label"), F.lit(1).cast("bigint").alias("size"), F.concat(F.lit("node"), F.col("event_id") % 3).alias("host"))


for _n, (_kind, _l, _h) in enumerate([("split", "label", "host"), ("group_label", "label", "NULL"), ("group_node_label", "label", "host"), ("group_node", "0", "host"), ("group_all", "0", "NULL")], 1):

    def _make(kind):
        def run(spark, sf_dir):
            return pipeline.groups(_outputs(spark, sf_dir), kind)

        return run

    query(
        f"grp_0{_n}_{_kind}",
        f"SELECT label, host, CAST(1 AS BIGINT) AS inputs, CAST(size AS BIGINT) AS size FROM ({_OUTPUTS})" if _kind == "split" else f"SELECT CAST({_l} AS INTEGER) AS label, CAST({_h} AS VARCHAR) AS host, CAST(count(*) AS BIGINT) AS inputs, CAST(sum(size) AS BIGINT) AS size FROM ({_OUTPUTS}) GROUP BY 1, 2",
    )(_make(_kind))


@query("grp_06_empty_input", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE false HAVING count(*) > 0")
def _(spark, sf_dir):
    return O.group_all(table(spark, sf_dir, "nation").where("false"), F.sum("n_nationkey").cast("bigint").alias("s"))


@query("grp_08_grown_groups", f"WITH o AS ({_OUTPUTS}), a AS (SELECT label, count(*) AS inputs FROM o WHERE label < 3 AND host <> 'node2' GROUP BY 1), b AS (SELECT label, count(*) AS inputs FROM o GROUP BY 1) SELECT b.label, CAST(NULL AS VARCHAR) AS host, CASE WHEN a.inputs IS NULL THEN 'new' ELSE 'grown' END AS what, CAST(b.inputs AS BIGINT) AS inputs FROM b LEFT JOIN a USING (label) WHERE a.inputs IS NULL OR b.inputs > a.inputs")
def _(spark, sf_dir):
    o = _outputs(spark, sf_dir)
    return pipeline.new_and_grown(pipeline.groups(o.where("label < 3 and host <> 'node2'"), "group_label"), pipeline.groups(o, "group_label"))


@query("grp_09_shuffle_stage", "SELECT CAST(n_regionkey AS INTEGER) AS label, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("label")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("grp_10_consecutive_keys", "WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(1) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT m.*, e.ts FROM m JOIN events e USING (event_id))) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return O.consecutive(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "event_type", ["ts", "event_id"], ["user_id"])


@query("grp_11_split_by_test", "SELECT c_acctbal > 0 AS good, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    good, bad = O.split_by(table(spark, sf_dir, "customer"), F.col("c_acctbal") > 0)
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


# -- 2.5 aggregate ---------------------------------------------------------------------------------------


@query("agg_01_combiner", "SELECT o_orderstatus AS k, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1")
def _(spark, sf_dir):
    def combiner(key, value, buffer, done, params):
        if done:
            return list(buffer.items())
        buffer[key] = buffer.get(key, 0) + value

    job = classic.ClassicJob(map=lambda r, p: [(r[0], 1)], combiner=combiner, reduce=classic.sum_reduce, map_schema="k string, v bigint")
    return job.result(table(spark, sf_dir, "orders").select("o_orderstatus"))


@query("agg_02_sum_combiner", "SELECT l_returnflag AS k, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    job = classic.ClassicJob(map=classic.Native("pairs", lambda d: d.select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").cast("bigint").alias("v"))), combiner=classic.sum_combiner, reduce=classic.sum_reduce)
    return job.result(table(spark, sf_dir, "lineitem"))


@query("agg_03_sum_reduce", "SELECT l_suppkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return O.sum_by_key(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("q")), "k", "q")


@query("agg_04_sort_aggregate", "SELECT l_shipdate AS k, CAST(count(*) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("k")).agg(F.count("*").alias("v"))


@query("agg_05_running_key", "SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return O.reduce_python(table(spark, sf_dir, "orders").select("o_custkey"), ["o_custkey"], lambda k, rows, p: [(k, P.count(rows))], "k bigint, v bigint")


@query("agg_06_reduce_forms", "SELECT n_regionkey AS k, CAST(sum(n_nationkey) AS BIGINT) AS v FROM nation GROUP BY 1")
def _(spark, sf_dir):
    def reduce(records, out, params):
        for k, vs in P.runs(records):
            out.add(k, sum(vs))

    job = classic.ClassicJob(map=classic.nop_map, reduce=reduce, partitions=3, sort=True, reduce_schema="k int, v bigint")
    return job.result(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("bigint").alias("v")))


@query("agg_07_identity_reduce", "SELECT s_suppkey AS k, s_name AS v FROM supplier")
def _(spark, sf_dir):
    return classic.ClassicJob(map=classic.nop_map, reduce=classic.nop_reduce).result(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")))


@query("agg_08_global", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS most FROM lineitem HAVING count(*) > 0")
def _(spark, sf_dir):
    return O.group_all(table(spark, sf_dir, "lineitem"), F.sum("l_linenumber").cast("bigint").alias("s"), F.count("*").alias("n"), F.max("l_quantity").alias("most"))


@query("agg_09_two_level_count", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    return O.two_level_count(table(spark, sf_dir, "customer"), "c_mktsegment", S.key_hash_label("c_mktsegment", 128))


@query("agg_10_distinct_in_record", f"SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> ''))) AS BIGINT) AS n FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", O.distinct_in_record(S.words("text")).alias("n"))


@query("agg_11_mean_vector", "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def _(spark, sf_dir):
    return O.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", 6)


@query("agg_12_least_tuple", "SELECT o_custkey, min(o_totalprice) AS price, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("b")).select("o_custkey", F.col("b.o_totalprice").alias("price"), "b.o_orderkey")


@query("agg_13_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("agg_14_pi")
def _(spark, sf_dir):
    return workloads.estimate_pi(spark, 1_000_000)


# -- 2.6 joins ---------------------------------------------------------------------------------------------


@query("joi_01_union_join", "WITH u AS (SELECT r_regionkey AS id, r_name AS w FROM region UNION ALL SELECT n_nationkey, n_name FROM nation) SELECT id, string_agg(w, ',' ORDER BY w) AS cells FROM u GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("w"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("w"))
    return O.union_join(a, b, "id").select("id", F.array_join("cells", ",").alias("cells"))


@query("joi_01_inner_join", "SELECT r_regionkey AS id, r_name, n_name FROM region JOIN nation ON r_regionkey = n_nationkey")
def _(spark, sf_dir):
    return table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "id").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), "id")


@query("joi_02_hash_join", "SELECT o_orderkey, c_name, o_orderstatus, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "o_orderstatus", "n_name")


@query("joi_02_join_and_count", "SELECT n_name AS k, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf_dir):
    # orders are counted by customer before they meet anything
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("k")).agg(F.sum("n").alias("n"))


@query("joi_03_merge_jobs", "SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT s_nationkey AS k, 1 AS v FROM supplier UNION ALL SELECT c_nationkey, 1 FROM customer) GROUP BY 1")
def _(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("v"))
    chain = jobs.JobChain({"a": (lambda i: one("supplier", "s_nationkey"), []), "b": (lambda i: one("customer", "c_nationkey"), []), "c": (lambda i: O.sum_by_key(O.union_all(i), "k", "v"), ["a", "b"])})
    return chain.build()["c"]


_GRAPH = "WITH e AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1), g AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e), n AS (SELECT DISTINCT user_id AS node FROM events), r0 AS (SELECT node, 1.0::DOUBLE AS score FROM n)"
for _k in range(1, 4):
    _GRAPH += f", r{_k} AS (SELECT n.node, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(s, 0.0) AS score FROM n LEFT JOIN (SELECT dst, sum(score * w) AS s FROM g JOIN r{_k - 1} ON src = node GROUP BY 1) ON dst = node)"


def _graph(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    edges = e.join(after, "event_id").select(F.col("user_id").alias("src"), "dst").distinct()
    out = edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("w"))
    return e.select(F.col("user_id").alias("node")).distinct(), edges.join(out, "src")


@query("joi_04_pagerank", _GRAPH + " SELECT node, round(score, 6) AS score FROM r3")
def _(spark, sf_dir):
    return workloads.pagerank(*_graph(spark, sf_dir), rounds=3, digits=6)


#: As many rounds as the reference makes by default, of PageRank and of k-means.
ROUNDS = 10

_FULL = _GRAPH.replace(" AS (", " AS MATERIALIZED (")
for _k in range(4, ROUNDS + 1):
    _FULL += f", r{_k} AS MATERIALIZED (SELECT n.node, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(s, 0.0) AS score FROM n LEFT JOIN (SELECT dst, sum(score * w) AS s FROM g JOIN r{_k - 1} ON src = node GROUP BY 1) ON dst = node)"


@query("joi_04_pagerank_full", _FULL + f" SELECT node, round(score, 6) AS score FROM r{ROUNDS}")
def _(spark, sf_dir):
    kept = []
    for d in _graph(spark, sf_dir):  # each round reads them again
        path = scratch.folder(spark, "graph")
        d.write.parquet(path)
        kept.append(spark.read.parquet(path))
    return workloads.pagerank(*kept, rounds=ROUNDS, digits=6)


@query("joi_05_lookup_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    n = O.lookup_join(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf_dir, "region"), ["r_regionkey"])
    return O.lookup_join(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"]).select("c_custkey", "n_name", "r_name")


# -- 2.7 sort and sets -----------------------------------------------------------------------------------------


@query("srt_01_sort_in_labels", f"SELECT {_LABEL.format(k='c_name', n=8)} AS label, c_name, row_number() OVER (PARTITION BY {_LABEL.format(k='c_name', n=8)} ORDER BY c_name, c_custkey) AS place FROM customer")
def _(spark, sf_dir):
    d = O.sort_in_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), S.key_hash_label("c_name", 8), 8, "c_name", "c_custkey")
    return d.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("c_name", "c_custkey")).cast("bigint")).select("label", "c_name", "place")


@query("srt_02_pipeline_sort", "SELECT CAST(n_regionkey AS INTEGER) AS label, n_name AS k, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS v FROM nation")
def _(spark, sf_dir):
    def process(out, state, label, records, params):
        for i, (k, _) in enumerate(records):
            out.add(k, i, label)

    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("label"), F.col("n_name").alias("k"), F.col("n_nationkey").alias("v"))
    return pipeline.run_stage(rows, "group_label", pipeline.Stage("sort", process, "k string, v int", combine=True, sort=True)).select("label", "k", "v")


@query("srt_04_sorted_reduce", "SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return O.reduce_python(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], lambda k, rows, p: [(k, " ".join(str(r[1]) for r in rows))], "k bigint, v string", ["o_orderkey"])


@query("srt_05_spilling_sort", "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("srt_06_random_order", "SELECT n_name FROM nation")
def _(spark, sf_dir):
    return O.shuffled(table(spark, sf_dir, "nation").select("n_name"), 3)


@query("set_01_union", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT n_nationkey FROM nation")
def _(spark, sf_dir):
    return O.union_all([table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))])


# -- 2.8 streams -----------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    """Rows that a stream handles, copied to a folder of their own in two files."""
    path = scratch.folder(spark, "events")
    table(spark, sf_dir, "events").select("event_id", "ts", "event_type").repartition(2).write.parquet(path)
    return streams.added(spark, path, "event_id bigint, ts timestamp, event_type string"), path


@query("str_01_windowed_stream", "SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    out = scratch.folder(spark, "windows")

    def write(batch, number):
        streams.window_counts(batch, "ts", "event_type").write.mode("append").parquet(out)

    stream, _ = _events(spark, sf_dir)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch.folder(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))


@query("str_02_more_inputs", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    out = scratch.folder(spark, "batches")
    streams.counts_by_batch(_events(spark, sf_dir)[0], "event_type", out, scratch.folder(spark, "check"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str_03_append_and_rerun", "SELECT event_id FROM events UNION ALL SELECT -event_id - 1 FROM events")
def _(spark, sf_dir):
    stream, path = _events(spark, sf_dir)
    out, check = scratch.folder(spark, "out"), scratch.folder(spark, "check")
    streams.run_available(stream.select("event_id"), out, check)
    spark.read.parquet(path).withColumn("event_id", -F.col("event_id") - 1).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    streams.run_available(streams.added(spark, path, "event_id bigint, ts timestamp, event_type string").select("event_id"), out, check)
    return spark.read.parquet(out)


# -- 2.9 catalog -----------------------------------------------------------------------------------------------


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("tag_01_append", values("place, url", "(0, 'raw://three')", "(1, 'raw://two')", "(2, 'raw://one')"))
def _(spark, sf_dir):
    c = Catalog(spark, scratch.folder(spark, "catalog"))
    c.tag("t", [["raw://one"], ["raw://two"]], delayed=True)
    c.tag("t", [["raw://three"]], delayed=True)
    c.flush()
    return _rows(spark, [(i, u[0]) for i, u in enumerate(c.urls("t"))], "place int, url string")


@query("tag_02_append_new_only", values("n", "(2)"))
def _(spark, sf_dir):
    c = Catalog(spark, scratch.folder(spark, "catalog"))
    for k in range(5):
        c.tag("t", [[f"http://h{k}/blob$1"], ["http://h/other$2"]], update=True, delayed=True)
    c.flush()
    return _rows(spark, [(len(c.urls("t")),)], "n int")


@query("tag_05_get_and_replace", values("url", "('raw://z')"))
def _(spark, sf_dir):
    c = _catalog(spark)
    c.put("a", [["raw://z"]])
    return _rows(spark, [(u[0],) for u in c.get("a")["urls"]], "url string")


@query("tag_06_delete_exists_list", values("tag", "('b')", "('c')"))
def _(spark, sf_dir):
    c = _catalog(spark)
    c.delete("a")
    c.delete("never")
    return _rows(spark, [(t,) for t in c.list() if c.exists(t) and not c.exists("a")], "tag string")


@query("tag_09_find", values("tag, links, blobs", "('c', 'c b', '')", "('b', 'a', 'raw://three')", "('a', '', 'raw://two raw://one')"))
def _(spark, sf_dir):
    return _rows(spark, [(t, " ".join(x), " ".join(b[0] for b in y)) for t, x, y in _catalog(spark).findtags("c")], "tag string, links string, blobs string")


@query("tag_10_walk", values("path", "('c')", "('c/b')", "('c/b/a')"))
def _(spark, sf_dir):
    return _rows(spark, [("/".join(p),) for p, _, _ in _catalog(spark).walk("c")], "path string")


@query("tag_11_blobs", values("url", "('raw://one')", "('raw://two')", "('raw://three')"))
def _(spark, sf_dir):
    return _rows(spark, [(b[0],) for b in _catalog(spark).blobs("c")], "url string")


@query("tag_13_attributes", values("name, value", "('color', 'blue')"))
def _(spark, sf_dir):
    c = _catalog(spark)
    c.setattr("a", "color", "red")
    c.setattr("a", "color", "blue")
    c.setattr("a", "size", "2")
    c.delattr("a", "size")
    c.delattr("a", "none")
    return _rows(spark, list(c.attrs("a").items()), "name string, value string")


@query("tag_18_orphans", values("url", "('raw://lost')"))
def _(spark, sf_dir):
    return _catalog(spark).orphans(spark.createDataFrame([("raw://lost",), ("raw://one",), ("raw://three",)], "url string"))


@query("tag_22_newest_version", values("tag, n", "('a', 2)", "('b', 2)", "('c', 2)"))
def _(spark, sf_dir):
    return _catalog(spark).newest().select("tag", F.size("urls").alias("n"))


# -- 2.10 inverted map -------------------------------------------------------------------------------------------


def _index(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.concat(F.lit("lang:"), "lang").alias("k"), F.col("doc_id").alias("v")).unionByName(d.select(F.concat(F.lit("source:"), "source").alias("k"), F.col("doc_id").alias("v")))
    # values in 64 pieces a key, as one key may hold a third of all rows
    return pairs.groupBy("k", F.pmod(F.hash("v"), F.lit(64)).alias("piece")).agg(F.collect_set("v").alias("values"))


@query("idx_01_build", "SELECT k, CAST(count(DISTINCT v) AS BIGINT) AS n FROM (SELECT 'lang:' || lang AS k, doc_id AS v FROM documents UNION ALL SELECT 'source:' || source, doc_id FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("k").agg(F.sum(F.size("values")).alias("n"))


@query("idx_02_boolean_query", "SELECT doc_id AS v FROM documents WHERE (lang = 'fr' OR lang = 'de') AND NOT source = 'src1' AND (source = 'src2' OR source = 'src5')")
def _(spark, sf_dir):
    return workloads.query_map(_index(spark, sf_dir), "lang:fr | lang:de & ~source:src1 & source:src2 | source:src5")


@query("idx_03_keys_and_items", "SELECT 'lang:' || lang AS k, doc_id AS v FROM documents UNION ALL SELECT 'source:' || source, doc_id FROM documents")
def _(spark, sf_dir):
    return _index(spark, sf_dir).select("k", F.explode("values").alias("v"))


# -- 2.11 functions ------------------------------------------------------------------------------------------------


@query("fn_01_flatten", "SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS x")
def _(spark, sf_dir):
    return _rows(spark, [(x,) for x in P.flatten([0, [1, [2, 3], [[4, [5, [6]]]]]])], "x int")


@query("fn_02_hexhash", "SELECT c_custkey, substr(md5(c_name), 1, 2) AS h FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.hexhash("c_name").alias("h"))


@query("fn_03_persistent_hash", f"SELECT doc_id, {_LABEL.format(k='CAST(doc_id AS VARCHAR)', n=1000)} AS h FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.key_hash_label("doc_id", 1000).alias("h"))


@query("fn_04_urls", "SELECT page_id, string_split(url, '://')[1] AS scheme, string_split(string_split(url, '://')[2], '/')[1] AS netloc, regexp_replace(string_split(url, '://')[2], '^[^/]*/', '') AS path FROM pages WHERE url LIKE '%://%/%'")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").like("%://%/%"))
    return p.select("page_id", S.scheme("url").alias("scheme"), S.net_location("url").alias("netloc"), S.url_path("url").alias("path"))


@query("fn_05_job_name", "SELECT page_id, string_split(url, '/')[-2] AS job FROM pages WHERE url LIKE '%://%/%'")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").like("%://%/%")).select("page_id", S.job_name("url").alias("job"))


@query("fn_06_format_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' bytes' WHEN n_chars < 1048576 THEN (n_chars // 1024) || ' KB' ELSE (n_chars // 1048576) || ' MB' END AS size FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.format_size("n_chars").alias("size"))


@query("fn_08_safe_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_@:-]', '_', 'g') AS safe, replace(url, ':', '_') AS plain, string_split(string_split(url, '/')[-1], '$')[1] AS blob FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.safe_name("url").alias("safe"), S.compliant_name("url").alias("plain"), S.blob_name("url").alias("blob"))


@query("fn_09_strings", "SELECT c_custkey, trim(lower(c_name)) AS low, to_base64(encode(c_name)) AS b64, regexp_replace(c_name, '[0-9]+', 'N') AS masked, concat_ws('-', c_mktsegment, c_nationkey) AS joined FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(F.lower("c_name")).alias("low"), F.base64(F.col("c_name").cast("binary")).alias("b64"), F.regexp_replace("c_name", "[0-9]+", "N").alias("masked"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"))


@query("fn_10_math", "SELECT l_returnflag, CAST(sum(CAST(ceil(l_extendedprice) AS BIGINT)) AS BIGINT) AS up, min(l_quantity) AS low, round(ln(max(l_extendedprice)), 9) AS ln_most, CAST(factorial(5) AS BIGINT) AS f FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.ceil("l_extendedprice").cast("bigint")).alias("up"), F.min("l_quantity").alias("low"), F.round(F.log(F.max("l_extendedprice")), 9).alias("ln_most"), F.max(F.factorial(F.lit(5))).alias("f"))


@query("fn_11_tours", values("cost, path", "(CAST(8.0 AS DOUBLE), '0 1 2 3 4 5 6 7')"))
def _(spark, sf_dir):
    n = 8
    graph = [[0.0 if a == b else 1.0 if (a - b) % n in (1, n - 1) else 5.0 for b in range(n)] for a in range(n)]
    return workloads.shortest_tour(spark, graph, 0).select("cost", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


# -- 2.12 user functions and jobs ----------------------------------------------------------------------------------------


@query("udf_01_partial_functions", "SELECT n_nationkey AS k, n_name || '!' AS v FROM nation")
def _(spark, sf_dir):
    from functools import partial

    return O.map_python(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), partial(_mark, mark="!"), "k int, v string")


def _mark(row, params, mark):
    yield row[0], row[1] + mark


@query("udf_05_external_program", "SELECT upper(n_name) AS value FROM nation")
def _(spark, sf_dir):
    import pandas as pd

    def run(frames):
        import subprocess

        for f in frames:
            if len(f):
                out = subprocess.run(["tr", "a-z", "A-Z"], input="\n".join(f["n_name"]) + "\n", capture_output=True, text=True, check=True).stdout
                yield pd.DataFrame({"value": out.splitlines()})

    return table(spark, sf_dir, "nation").select("n_name").mapInPandas(run, "value string")


@query("udf_07_task_context", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))


@query("udf_07_task_helpers", "SELECT 'n_' || lower(n_name) AS k, CAST(n_nationkey AS BIGINT) AS v FROM nation UNION ALL SELECT 'put:' || replace(r_name, ' ', '_'), CAST(count(*) AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf_dir):
    """A task reads a side result of an earlier job, knows where it is, and puts side results of its own."""
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    before = registry.run("prefix", lambda s: table(s, sf_dir, "region").select("r_name"))
    registry.put(before.name, "prefix", b"n_")

    def names(rows, task):
        some = {}
        for key, name, region in rows:
            some[region] = some.get(region, 0) + 1
            yield task.get("prefix").decode() + name.lower(), key
        for region, n in some.items():
            task.put(f"{region.replace(' ', '_')}@{task.this_partition}", str(n).encode())

    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint"), "n_name", "r_name")  # five rows
    out, side = tasks.with_tasks(nations.repartition(3), names, "k string, v bigint", before.name, registry.side(before.name))
    put = side.groupBy(F.concat(F.lit("put:"), F.split("key", "@")[0]).alias("k")).agg(F.sum(F.col("value").cast("string").cast("bigint")).alias("v"))
    return out.union(put)


@query("udf_09_argument_order", "SELECT n_name AS k, CAST(7 AS BIGINT) AS v FROM nation")
def _(spark, sf_dir):
    job = classic.ClassicJob(map=lambda r, p: [(r[0], p)], params=3, partitions=None, map_schema="k string, v bigint").resolved(params=7)
    return job.result(table(spark, sf_dir, "nation").select("n_name"))


@query("job_01_word_lengths", f"SELECT CAST(length(w) AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS v FROM ({WORDS_SQL}) WHERE w <> '' GROUP BY 1")
def _(spark, sf_dir):
    pairs = classic.Native("lengths", lambda d: O.flat_map(d, S.words("text"), name="w").select(F.length("w").alias("k"), F.lit(1).cast("bigint").alias("v")))
    return classic.ClassicJob(map=pairs, reduce=classic.sum_reduce).result(table(spark, sf_dir, "documents"))


@query("job_02_chain", "SELECT n_name || '0-1-' AS k, 1 AS v FROM nation")
def _(spark, sf_dir):
    step = lambda mark: lambda i: i[0].select(F.concat("k", F.lit(mark)).alias("k"), "v")
    start = table(spark, sf_dir, "nation").select(F.col("n_name").alias("k"), F.lit(1).alias("v"))
    return jobs.JobChain({"second": (step("1-"), ["first"]), "first": (step("0-"), [start])}).build()["second"]


@query("job_03_stage_results", "SELECT n_name || '!' AS k FROM nation UNION ALL SELECT n_name || '!?' FROM nation")
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))

    def plan(s):
        first = table(s, sf_dir, "nation").select(F.concat("n_name", F.lit("!")).alias("k"))
        return {"map": first, "reduce": first.select(F.concat("k", F.lit("?")).alias("k"))}

    job = registry.run("marks", plan)
    return registry.results(job.name, "map").unionByName(registry.results(job.name, "reduce"))


@query("job_05_kmeans", f"SELECT c, CAST(count(*) AS BIGINT) AS n FROM ({_ASSIGN}) GROUP BY 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    return workloads.kmeans(d, _centres(spark, sf_dir), 0, "embedding")[1].groupBy("c").agg(F.count("*").alias("n"))


@query("job_05_iterated_kmeans")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    return workloads.kmeans(d, workloads.random_centres(d, 4, "vec_id", "embedding"), ROUNDS, "embedding")[1].groupBy("c").agg(F.count("*").alias("n"))


@query("job_07_events", values("status, n", "('ready', 2)"))
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    job = registry.run("events", lambda s: s.range(3))
    return _rows(spark, [(registry.status(job.name), len(registry.matching_events(job.name, "RESULT")) + len(registry.events(job.name, 0)[1][:1]))], "status string, n int")


@query("job_08_job_names", values("kind, ok", "('plain', true)", "('slash', false)", "('dot', false)"))
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))

    def fine(prefix):
        try:
            return registry.new_name(prefix).startswith(f"{prefix}@")
        except ValueError:
            return False

    return _rows(spark, [("plain", fine("count")), ("slash", fine("a/b")), ("dot", fine("a.b"))], "kind string, ok boolean")


@query("job_09_status", values("job, status", "('good', 'ready')", "('bad', 'dead')", "('none', 'unknown')"))
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    good = registry.run("good", lambda s: s.range(1)).name
    try:
        registry.run("bad", lambda s: s.range(1).selectExpr("raise_error('on purpose')"))
    except jobs.JobError:
        pass
    return _rows(spark, [("good", registry.status(good)), ("bad", registry.status(registry.names()[-1])), ("none", registry.status("none"))], "job string, status string")


@query("job_04_profile", values("stage, measured", "('map', true)", "('reduce', true)"))
def _(spark, sf_dir):
    registry = jobs.Jobs(spark, scratch.folder(spark, "jobs"))
    job = registry.run("profile", lambda s: {"map": s.range(3), "reduce": s.range(1)})
    return _rows(spark, [(k, v > 0) for k, v in job.profile.items()], "stage string, measured boolean")


@query("tag_03_delayed_append", values("before, after", "(0, 1)"))
def _(spark, sf_dir):
    c = Catalog(spark, scratch.folder(spark, "catalog"))
    c.tag("t", [["raw://x"]], delayed=True)
    before = c.newest().count()
    c.flush()
    return _rows(spark, [(before, c.newest().count())], "before int, after int")


@query("tag_12_pull", values("value", "('one')"))
def _(spark, sf_dir):
    return _catalog(spark).pull("c", lambda name: name == "one").select("value")


@query("tag_14_tokens", values("who, may_read, may_write", "('nobody', false, false)", "('reader', true, false)", "('writer', true, true)"))
def _(spark, sf_dir):
    from millrace.sources.catalog import NoPrivilege

    c = Catalog(spark, scratch.folder(spark, "catalog"))
    c.tag("t", [["raw://x"]], token="w")
    c.setattr("t", "sys:read-token", "r", "w")

    def may(call):
        try:
            call()
        except NoPrivilege:
            return False
        return True

    return _rows(spark, [(who, may(lambda t=t: c.get("t", t)), may(lambda t=t: c.tag("t", [], token=t))) for who, t in (("nobody", None), ("reader", "r"), ("writer", "w"))], "who string, may_read boolean, may_write boolean")


@query("tag_19_names", values("kind, name", "('safe', 'a_b_c')", "('blob', 'q')", "('canonical', 'tag://m/x')", "('relative', 'tag://x')"))
def _(spark, sf_dir):
    from millrace.sources import catalog

    return _rows(spark, [("safe", catalog.safe_name("a b/c")), ("blob", catalog.blob_name("http://h/q$1-2")), ("canonical", catalog.canonical("x", "m")), ("relative", catalog.relative("tag://m/x"))], "kind string, name string")


@query("tag_21_upload_once", values("writes", "(1)"))
def _(spark, sf_dir):
    c, n = Catalog(spark, scratch.folder(spark, "catalog")), 0
    for _ in range(2):
        try:
            c.upload("blob", spark.range(3))
            n += 1
        except Exception as e:
            if "already exists" not in str(e):
                raise
    return _rows(spark, [(n,)], "writes int")


@query("str_04_log_tail", values("line", "('two')", "('three')"))
def _(spark, sf_dir):
    import tempfile

    with tempfile.NamedTemporaryFile("w") as f:  # a log on the driver, as a client reads it
        f.write("one\n")
        f.flush()
        at, _ = streams.tail(f.name, 0)
        f.write("two\nthree\nfou")
        f.flush()
        return _rows(spark, [(x,) for x in streams.tail(f.name, at)[1]], "line string")


@query("fn_07_by_name", values("value", "(3.0::DOUBLE)"))
def _(spark, sf_dir):
    return _rows(spark, [(P.by_dotted_name("math.sqrt")(9),)], "value double")


@query("udf_08_params", "SELECT n_nationkey AS k, CAST(n_nationkey + 5 > 10 AS INTEGER) AS v FROM nation")
def _(spark, sf_dir):
    params = {"x": 5, "f": lambda a: int(a > 10)}
    return O.map_python(table(spark, sf_dir, "nation").select("n_nationkey"), lambda r, p: [(r[0], p["f"](r[0] + p["x"]))], "k int, v int", params)
