"""The registered queries and the pipeline."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from veilgrid.llm import secrets
from veilgrid.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, small).write.parquet(str(tmp_path / name))
        before = out[name] = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert before.columns == columns
    ids = {n: Counter(r.doc_id for r in out[n].select("doc_id").collect()) for n in list(out)[:-1]}
    kept = ids["quality_classifier"]
    assert max(kept.values()) == 1 and len(kept) < docs.count()
    assert set(ids["simhash_dedup"]) < set(kept)
    assert ids["secret_redaction"] == ids["simhash_dedup"]
    scan = secrets.Scanner().scan
    assert not any(scan(r.text) for r in out["secret_redaction"].collect())
    mixed = ids["source_mixing"]
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2
    packed = Counter()
    for r in out["bestfit_packing"].collect():
        packed.update(i for i, a in zip(r.doc_ids, r.starts, strict=True) if a == 0)
    assert packed == mixed
    assert corpus_pipeline.run(spark, small).count() == out["bestfit_packing"].count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_tables(spark, small, name):
    """One row for each row of the table, where the query is of rows."""
    df = QUERIES[name](spark, small)
    key = {"op6_warc": ("pages", "page_id"), "op7_embedding_neardup": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    if name == "op3_chat_format":
        assert df.count() == 1 + spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
    elif name == "op13_collocations":
        assert df.groupBy("lang").count().where("count > 2000").isEmpty()
    elif name == "op9_bestfit_packing":
        assert df.selectExpr("explode(doc_ids) i").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").count()
    else:
        assert df.count() == df.select(key[1]).distinct().count() == spark.read.parquet(f"{small}/{key[0]}.parquet").count()


def test_packed_sequences_have_their_texts(spark, small):
    """Each piece is found in its sequence's text, in order and in full."""
    texts = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op9_bestfit_packing"](spark, small).collect():
        want = [w for i, a, n in zip(r.doc_ids, r.starts, r.lengths, strict=True) for w in texts[i][a : a + n]]
        assert r.text.split() == want and len(want) == r.used
