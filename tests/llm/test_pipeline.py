"""run() against a version of its own on plain Python structures."""

import duckdb
import numpy as np

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_text_operators import contained, removed
from trackloom.llm import common, queries, stages, tokens


def test_stages_keep_the_columns(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.dtypes == d.dtypes
        d = common.materialize(out, "stage")
        assert d.count() > 100


def test_run(spark, sf):
    source = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in stages.keep_quality(spark, kept, sf).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert np.mean([(d in good) == bool(q) for d, q in labels.items()]) > 0.95
    now = [(d, t) for d, t in source if d in good]
    grams = {d: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in now}
    alone = {r.doc_id for r in stages.keep_one_of_near(spark, kept.where(kept.doc_id.isin(list(good))), sf).collect()}
    for i, (d, _) in enumerate(now):  # well above the threshold one of two goes, well below it both stay
        same = [e for e, _ in now[:i] if len(grams[d] & grams[e]) / len(grams[d] | grams[e]) >= 0.9]
        like = [e for e, _ in now if e != d and len(grams[d] & grams[e]) / len(grams[d] | grams[e]) >= 0.6]
        assert not same or d not in alone
        assert like or d in alone
    now = [(d, t) for d, t in now if d in alone]
    texts = {d: k.decode("utf-8", "ignore") for d, _, _, _, k in removed(now)}
    now = [(d, texts[d]) for d, t in now if texts[d].strip() or texts[d] == t]
    items = duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()
    now = [(d, t) for d, t in now if not any(contained(t, i)[1] * 5 >= contained(t, i)[0] * 4 for (i,) in items)]
    got = corpus_pipeline.run(spark, sf).toPandas()
    enc = tokens.word_ids(tokens.default_vocabulary())
    want = {d: len(enc.ids(t)) // 4 + 1 for d, t in now}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (5, "word " * 5000)]
    d = docs(spark, rows, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        out.collect()
        assert stage(spark, d.limit(0), sf).count() == 0
    near = sorted([r.doc_id for r in stages.keep_one_of_near(spark, d, sf).collect()], key=str)
    assert near == [1, 3, 5, None]


def test_other_columns_come_through(spark):
    rows = [(1, "a" * 60, "x"), (2, "b " + "a" * 60, "y"), (3, None, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, no_text string")
    d = d.selectExpr("*", "timestamp'2020-01-02 03:04:05.123456' AS at", "1L AS carry", "binary('q') AS `print`", "named_struct('text', 1.5D) AS kept", "2 AS `a.b`")
    got = {r.doc_id: r for r in stages.cut_repeats(spark, d, "").collect()}
    assert stages.cut_repeats(spark, d, "").dtypes == d.dtypes
    want = {r.doc_id: r for r in d.collect()}
    assert {k: r.text for k, r in got.items()} == {1: "a" * 60, 2: "b ", 3: None}
    assert all(got[k].asDict() | {"text": 0} == want[k].asDict() | {"text": 0} for k in want)


def test_near_duplicates_with_a_shared_id(spark, sf):
    one, two, three = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(1, one), (2, one + " end"), (2, two), (2, three), (3, two + " end"), (4, three + " end"), (4, "alone with its words"), (4, "alone with its words")]
    got = [(r.doc_id, r.text) for r in stages.keep_one_of_near(spark, docs(spark, rows), sf).collect()]
    assert sorted(got) == sorted([(1, one), (2, two), (2, three), (4, "alone with its words")])


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
