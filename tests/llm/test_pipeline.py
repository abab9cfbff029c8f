"""The corpus pipeline, stage by stage, against brute-force versions, and the
registered queries of this package on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle import compare
from test_text_operators import brute_components, brute_repeats
from tessera.llm import decontam, spans
from tessera.llm.common import table
from tessera.llm.queries import tokenizer

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    from tokenizers import Tokenizer
    docs = table(spark, SMALL, "documents")
    columns = docs.dtypes
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.durable(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert docs.dtypes == columns
            texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            gone = before.keys() - texts.keys()
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
            assert gone and len(gone & toxic) > len(toxic) / 2
        elif name == "near_duplicates":
            rows = sorted(before.items())
            lost = {i for i, _, c in brute_components(rows, 5, 80) if c != i}
            assert gone == lost
        elif name == "substring_dedup":
            assert not gone
            found = brute_repeats(list(before.items()))
            for i, t in before.items():
                at = [0, *spans.cut(t)]
                kept = "".join(t[at[n]:at[n + 1]] for n in range(len(at) - 1) if n not in found.get(i, ()))
                assert texts[i] == kept
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "decontamination":
            tokens = decontam.Tokens()
            items = decontam.Items([(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()])
            grams = {tuple(t[k:k + 12].tolist()) for t in items.tokens for k in range(len(t) - 11)}
            exact = {i for i, t in before.items()
                     if any(tuple(w) in grams for w in np.lib.stride_tricks.sliding_window_view(
                         np.concatenate([tokens.of(t), np.zeros(12, np.uint64)]), 12).tolist())}
            assert exact <= gone
            assert gone == {i for i, t in before.items() if items.overlaps(tokens.of(t))}
        else:
            tok = Tokenizer.from_file(tokenizer())
            got = {}
            for r in sorted(docs.collect(), key=lambda r: r.start):
                got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
            assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in before.items()}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


CLASHING = "id long, removed string, ranges int, doc long, key int, h string, gone int, y int, terms string, score string, label int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_rows_and_clashing_columns(spark, name, stage):
    """Nulls in every column, empty texts, repeated rows, other columns with the names the operators use."""
    some = table(spark, SMALL, "documents").select("doc_id", "text").limit(12).collect()
    rows = [(r.doc_id, r.text) for r in some]
    rows += [rows[0], rows[0], (rows[1][0], "another text of this id"), (None, rows[2][1]), (None, None), (900_001, None),
             (900_002, ""), (900_003, " \n\t"), (900_004, "word " * 30_000)]
    names = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame([(*r, *[None if k % 3 == 0 else str(k) if kind.endswith("string") else k
                                       for kind in CLASHING.split(", ")]) for k, r in enumerate(rows)],
                               "doc_id long, text string, " + CLASHING)
    out = corpus_pipeline.durable(stage(spark, df, SMALL), name)
    if name == "packing":
        assert out.where("doc_id is null").count() >= 2 and {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    else:
        assert out.dtypes == df.dtypes
        assert out.where("doc_id is null").count() == 2 and out.where("doc_id = 900002").count() == 1
        assert out.select(*names).exceptAll(df.select(*names)).count() == 0
    none = corpus_pipeline.durable(stage(spark, df.limit(0), SMALL), name)
    assert none.count() == 0 and none.dtypes == out.dtypes


@pytest.mark.parametrize("name", ["op1_top_products", "op4_url_filter", "op8_warc", "op9_near_duplicates", "op11_hard_negatives",
                                  "op12_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    ok, said = compare(spark, name, SMALL, con)
    assert ok, said


def test_substring_dedup_returns_every_document(spark):
    docs = table(spark, SMALL, "documents")
    got = entry.queries()["op6_substring_dedup"](spark, SMALL)
    assert got.columns == [*docs.columns, "ranges", "removed"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert 0 < sum(r.removed == 0 and r.text == texts[r.doc_id] for r in rows) < len(rows)


def test_every_operator_has_its_query():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
