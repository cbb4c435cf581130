"""Extra columns with the names that operators use inside: every stage keeps them, every query ignores them."""

import pytest

from veilgrid.llm import chat_format, embedding_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules, secrets, simhash, warc

NAMES = ["id", "t", "fp", "keep", "want", "rank", "own", "i", "node", "root", "at", "k", "n", "copy", "place", "mine", "size", "h", "cell", "host", "w", "row", "_keep", "a b.c", "__id", "__key", "__copy", "__keep"]


def odd(df):
    names = [n for n in NAMES if n.lower() not in {c.lower() for c in df.columns}]
    return df.selectExpr("*", *[f"{k} `{n}`" for k, n in enumerate(names)]), names


def documents(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, "a"), (2, long, "a"), (2, "password = hunter2hunter2 " + long[:90], "b"), (3, None, None), (None, "x y", "a")]
    return odd(spark.createDataFrame(rows, "doc_id long, text string, source string"))


@pytest.mark.parametrize("stage", [simhash.simhash_dedup, near_dedup.near_dedup, secrets.redact_secrets, mixing.mix_documents])
def test_stages_keep_them(spark, stage):
    docs, names = documents(spark)
    got = stage(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert [r[n] for n in names] == list(range(len(names)))


def test_operators_ignore_them(spark):
    docs, _ = documents(spark)
    plain = docs.select("doc_id", "text", "source")
    for f in (simhash.simhash_components, secrets.secret_digest, lm_scoring.score_documents, mixing.mix_copies, quality_rules.quality_rules, packing.pack_documents):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(plain).collect())), f
    for f, schema, rows in (
        (chat_format.chat_digest, "conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (1, 1, "assistant", "b")]),
        (warc.warc_round_trip, "page_id long, url string, html string", [(1, "u", "x" * 2000), (2, "v", "x" * 2000)]),
        (embedding_dedup.embedding_links, "vec_id long, embedding array<float>", [(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [-1.0, 0.5])]),
    ):
        plain = spark.createDataFrame(rows, schema)
        assert sorted(map(repr, f(odd(plain)[0]).collect())) == sorted(map(repr, f(plain).collect())), f
