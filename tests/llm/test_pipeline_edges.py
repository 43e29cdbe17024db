"""The pipeline's stages on nulls, repeated ids, empty tables and columns whose names clash with helpers."""

import random

import pytest

import corpus_pipeline as P
from lumicat.llm import toxicity

from .test_operators import toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, text_sha256 string, _sha string, sha string, n long, wanted string, kept boolean, component_id string"
STAGES = dict(P.STAGES)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), f"id{k}", "h", "own", "own2", 5, "w", None, f"c{k}") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    base = " ".join(f"w{r.randint(0, 400)}" for _ in range(80))
    near = base.replace(base.split()[40], "changed", 1)
    return [(1, base), (2, base + "  "), (3, near), (None, None), (4, ""), (5, " \n"), (6, "mail a.b@c.example.com"), (6, "other text of this id"), (6, "other text of this id"), (None, "no id here"), (None, "no id here"), (7, near), (8, "short")]


def told(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r._sha, r.sha, r.n, r.text_sha256, r.wanted) for r in df.collect())


def test_copies(spark, rows):
    docs = documents(spark, rows)
    out = STAGES["exact_dedup"](spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert all(r._sha == "own" and r.sha == "own2" and r.n == 5 and r.text_sha256 == "h" and r.id.startswith("id") for r in got)
    # of equal texts the longest, then the smallest id; of empty ones the longest blank
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(2, rows[1][1]), (3, rows[2][1]), (5, " \n"), (6, rows[6][1]), (6, rows[7][1]), (0, "no id here"), (8, "short")])


def test_near_copies(spark, rows):
    docs = documents(spark, rows)
    out = STAGES["ngram_jaccard_join"](spark, docs, "")
    assert out.schema == docs.schema
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert (1, rows[0][1]) in got and not any(i in (2, 3, 7) for i, _ in got)
    assert sum(i == 6 for i, _ in got) == 3 and (8, "short") in got and sum(i is None for i, _ in got) == 3


def test_masking(spark, rows):
    docs = documents(spark, rows)
    out = STAGES["pii"](spark, docs, "")
    assert out.schema == docs.schema and out.count() == len(rows)
    mail = [r for r in out.collect() if r.doc_id == 6 and "mail" in r.text]
    assert mail[0].text == "mail [email]" and mail[0].n_chars == 12
    assert STAGES["pii"](spark, docs.drop("n_chars"), "").columns == [c for c in docs.columns if c != "n_chars"]
    assert [r.n_chars for r in out.collect() if r.text is None] == [None]


def test_toxic_documents_and_packing(spark, rows, sf_dir):
    docs = documents(spark, rows)
    model = toxicity.train(toxic_rows(400, 1))
    assert told(toxicity.reject_toxic(docs, model)) == told(docs)
    out = STAGES["toxicity"](spark, docs, sf_dir)
    assert out.schema == docs.schema and out.count() <= len(rows)
    packed = STAGES["best_fit_packing"](spark, docs, "").collect()
    assert len(packed) == len(rows) and all(r.length >= 1 for r in packed)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, sf_dir, name):
    out = STAGES[name](spark, documents(spark, []), sf_dir)
    assert out.count() == 0
