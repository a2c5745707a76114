"""The pipeline's stages on the smallest tables, each against brute force over what the one before kept."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p
    from millrace.llm import common as C

    out, docs = [], C.read_table(spark, SF, "documents")
    columns = docs.columns
    out.append(docs.toPandas())
    for k, (name, stage) in enumerate(p.STAGES):
        docs = C.materialize(stage(spark, docs, SF), name)
        assert k == len(p.STAGES) - 1 or docs.columns == columns
        out.append(docs.toPandas())
    return out


def test_toxic_documents_go(spark, stages):
    from millrace.llm import common as C
    from millrace.llm import toxicity

    model = toxicity.train(C.read_table(spark, SF, "documents"), C.read_table(spark, SF, "labels"))
    want = [i for i, t in zip(stages[0].doc_id, stages[0].text, strict=True) if model.score(t) < 0.5]
    assert sorted(stages[1].doc_id) == sorted(want)


def test_one_of_each_group_stays(stages):
    from millrace.llm import common as C

    sets = {}
    for i, t in zip(stages[1].doc_id, stages[1].text, strict=True):
        w = C.ascii_words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(stages[2].doc_id) == sorted(i for i in sets if find(i) == i)


def test_benchmark_passages_go(spark, stages):
    from millrace.llm import common as C
    from millrace.llm import fm_index

    items = C.read_table(spark, SF, "benchmark").toPandas()
    windows = set()
    for t in items.text:
        w = fm_index.words_of(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    hit = lambda t: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for w in [fm_index.words_of(t)] for k in range(len(w) - n + 1))
    before, after = (dict(zip(s.doc_id, s.text, strict=True)) for s in stages[2:4])
    assert before.keys() == after.keys()
    touched = [i for i in before if hit(before[i])]
    assert touched and all(before[i] == after[i] for i in before if i not in touched)
    assert all(after[i] != before[i] for i in touched)


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, got, copies = Counter(), Counter(), defaultdict(list)
    for s, t in zip(stages[3].source, stages[3].text, strict=True):
        have[s] += size(t)
    for i, s, t in zip(stages[4].doc_id, stages[4].source, stages[4].text, strict=True):
        got[s] += size(t)
        copies[i].append(t)
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(have))}
    level = sum(have.values()) / sum(weights.values())
    if all(weights[s] * level <= 3 * n for s, n in have.items()):
        assert all(abs(got[s] - weights[s] * level) <= 3 for s in have)
    whole = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    assert all(len(c) <= 3 and all(whole[i].startswith(t) for t in c) for i, c in copies.items())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in zip(stages[4].doc_id, stages[4].text, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    last = stages[5]
    assert Counter(zip(last.doc_id, last.n_tokens, last.ids_crc32, strict=True)) == want
    assert sorted(last.start) == np.cumsum([0, *last.sort_values("start").n_tokens[:-1]]).tolist()


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Documents with nulls in all columns, empty and very long texts, ties, repeated rows and clashing names; tables beside them."""
    path = str(tmp_path_factory.mktemp("sf"))
    long = " ".join(f"word{k % 5000}x{k}" for k in range(60_000))
    texts = [None, "", " \n", "one", "one", "a b c d e f", long, long + " more", "the quick brown fox jumps over the lazy dog again and", "x" * 300_000, None]
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None if k % 2 else 1, "h", k, None) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[6], (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, uid int, `set key` int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def _row(r):
    return tuple(r[c] for c in ("doc_id", "text", "source"))


def test_stages_on_awkward_rows(spark, awkward):
    import corpus_pipeline as p
    from millrace.llm import common as C

    path, rows = awkward
    docs = C.read_table(spark, path, "documents")
    columns, stage = docs.columns, dict(p.STAGES)
    clean = C.materialize(stage["toxicity"](spark, docs, path), "t")
    assert clean.columns == columns and clean.count() == len(rows)
    one = C.materialize(stage["ngram_join"](spark, clean, path), "t")
    kept = sorted(map(_row, one.collect()), key=repr)
    lone = [r[1] for r in rows if not (r[1] or "").split()]
    assert sorted(t or "" for _, t, _ in kept if not (t or "").split()) == sorted(t or "" for t in lone)
    assert sorted((i, len(t)) for i, t, _ in kept if (t or "").split()) == sorted((i, len(rows[i][1])) for i in (3, 5, 6, 8, 9))
    cut = C.materialize(stage["decontamination"](spark, one, path), "t")
    assert cut.columns == columns and {(r["doc_id"], r["text"]) for r in cut.collect()} == {(i, "the " if i == 8 else t) for i, t, _ in kept}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())
    mixed = C.materialize(stage["mixing"](spark, cut, path), "t")
    size = lambda some: sum(len((r["text"] or "").split()) for r in some.select("text").collect())
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in cut.collect()}
    assert 0 < size(mixed) <= 3 * size(cut)
    stored = stage["token_store"](spark, mixed, path)
    assert stored.count() == mixed.count()


def test_stages_on_empty_tables(spark, awkward):
    import corpus_pipeline as p
    from millrace.llm import common as C

    path, _ = awkward
    none = C.read_table(spark, path, "documents").where("false")
    for name, stage in p.STAGES:
        out = stage(spark, none, path)
        assert out.count() == 0 and (name == "token_store" or out.columns == none.columns)
