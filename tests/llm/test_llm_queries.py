"""The registered queries on the smallest tables, and the pipeline against a plain version of its stages."""

import re
import zlib

import pytest

import corpus_pipeline
from lumicat.llm import pii, queries, toxicity

from ..compare import connect, difference
from .test_operators import brute_components


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        assert difference(df, con, queries.ORACLE_SQL[name]) == ""
    else:
        table = "conversations" if name.startswith("op6") else "documents"
        n = con.execute(f"select count(*) from {table}").fetchone()[0]
        assert df.count() >= n


def test_toxicity_query_on_held_out_rows(spark, con):
    rows = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r[0]: r[1] for r in connect("/root/testdata/sf0.1").execute("select doc_id, toxic from labels").fetchall()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_pipeline_stages(spark, sf_dir, con):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(i, t) for i, t in con.execute("select doc_id, text from documents").fetchall() if model.score(model.tag(t)[0]) < 0.5]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i, t))
    rows = [(min(g)[1], min(g)[2]) for g in groups.values()]
    part = brute_components(rows)
    rows = [(i, t) for i, t in rows if part[i][1] == i]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, step = step.columns, stage(spark, step, sf_dir)
        assert step.columns == before
    got = {r.doc_id: (r.text, r.n_chars) for r in step.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        base, added = pii.all_spans(t, pii.trained())
        assert (got[i][0] == t) == (not base and not added) and got[i][1] == len(got[i][0])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == set(got)
