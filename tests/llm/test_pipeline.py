"""The corpus pipeline against its stages one by one, and against plain Python."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from kgcube.llm import op5_toxicity, op10_secrets
from kgcube.llm import queries as llm_queries
from kgcube.llm.store import stored

from test_operators import SCHEMA, fingerprint, lower, merged, sentence

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == first.columns, name
        sizes.append(docs.count())
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 0.5 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = {(r.doc_id, r.doc_tokens) for r in last.collect()}
    got = {(r.doc_id, r.doc_tokens) for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert got == want and {i for i, _ in got} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(llm_queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns) and got.count() > 0
    rows = lambda columns, values: sorted(str([r[columns.index(c)] for c in order]) for r in values)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def contaminated(text, items):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[i : i + 13]) for w in map(alnum, items) for i in range(max(1, len(w) - 12)) if w}
    w, hit = alnum(text), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_pipeline_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in op5_toxicity.score(docs, labels).where("score >= 0.7").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    fp = {i: fingerprint(t) for i, t in texts.items()}
    roots = merged(sorted(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: op10_secrets.redacted(t or "") for i, t in texts.items() if roots[i] == i and not contaminated(t, items)}
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    tok.encode_special_tokens = True
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    seen, bins = collections.Counter(), collections.Counter()
    for r in entry.queries()["pipeline"](spark, SF).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seen[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()} and max(bins.values()) <= 1024


@pytest.fixture(scope="module")
def odd(spark):
    a, b = sentence(90), sentence(9000)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, None, None, None), (None, a, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", "s", 2), (4, "password: hunter22 " + sentence(40), "en", "s", 3), (5, "é" * 300_000, "en", "s", 4), (6, "one", "en", "s", 3)]
    names = ["fp", "h", "node", "at", "none", "hits", "items", "score", "_kgcube_", "text_", "DOC", "tail"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in names})


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF)
    none = stage(spark, odd.limit(0), SF)
    assert none.columns == got.columns and none.count() == 0
    rows = got.collect()
    if name == "packing":
        assert collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0).total() == 10
        return
    assert got.columns == odd.columns and all(r.fp == "clash" for r in rows)
    ids = sorted((r.doc_id or 0) for r in rows)
    if name == "near_dedup":
        assert ids == [1, 1, 2, 4, 5, 6]  # texts without words are one group
    else:
        assert ids == [0, 0, 1, 1, 1, 2, 3, 4, 5, 6]
        assert {len(r.text or "") for r in rows if r.doc_id == 5} == {300_000}
    if name == "secrets":
        assert all("hunter22" not in (r.text or "") for r in rows)
