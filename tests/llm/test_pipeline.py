"""The pipeline against a brute-force version, and the registered queries against their SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tickerloom.llm.queries import QUERIES
from tickerloom.llm.sql import ORACLE
from tools.compare import compare

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_pipeline(con):
    docs = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    items = [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    kept = brute.rules_keep(docs)
    docs = [d for i, d in enumerate(docs) if i in kept]
    comp = brute.components({d[0]: d[1] for d in docs}, 5, 80)
    docs = [d for d in docs if comp[d[0]] == d[0]]
    cut = brute.cut_words({d[0]: d[1] for d in docs}, 50)
    docs = [(d[0], d[1] if len(cut[d[0]][1]) == cut[d[0]][0] else b" ".join(cut[d[0]][1]).decode(), *d[2:]) for d in docs if cut[d[0]][1] or not cut[d[0]][0]]
    docs = [d for d in docs if not any(brute.shingles(d[1], 5) & brute.shingles(x, 5) and brute.leaked(d[1], x) for x in items)]
    n = brute.counts([(d[0], d[1], d[3]) for d in docs])
    return sorted((d[0], d[1], d[2], d[3], c) for d, k in zip(docs, n, strict=True) for c in range(1, k + 1))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_pipeline(spark, con):
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.copy_no) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == plain_pipeline(con)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() == 0


def test_stages_take_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as `a.b`", "2 as m", "3 as gone", "'x' as component_id", "4 as dedup", "5 as copy_no_")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_, out = docs, stage(spark, docs, SF)
        assert out.dtypes == docs_.dtypes and out.count() > 0


def test_repeated_rows_and_missing_ids_go_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, "en"), (None, text, "en"), (None, None, "en"), (3, "other words here", "en"), (1, "x y z", "de")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)[:5]) for r in out) == [("1", "w0 w1"), ("1", "x y z"), ("3", "other"), ("None", "None"), ("None", "w0 w1")]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).fetchdf()) == "ok"


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) < names and "pipeline" in names and set(ORACLE) < set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
