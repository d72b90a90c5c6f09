import re

import corpus_pipeline

from .helpers import ODD, docs
from .test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [*ODD, (90, f"before {bench} after", "en"), (91, "write to a.person@mail3.example.com about the cat on the mat", "en")]
    table = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == corpus_pipeline.COLUMNS, name
    left = {r.doc_id: r.text for r in table.collect()}
    assert 90 not in left and 0 not in left and 5 not in left and 4 not in left and 3 in left and None in left
    assert "a.person" not in left[91]
    packed = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_each_stage_takes_effect(spark):
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs_in.count()]
    for _, stage in corpus_pipeline.STAGES[:2]:
        before, docs_in = docs_in, stage(spark, docs_in, SF).cache()
        counts.append(docs_in.count())
    rows = [(r.doc_id, r.text, r.lang) for r in before.collect()]
    assert {r.doc_id for r in docs_in.collect()} == {i for i, _, root in brute(rows) if i == root}
    out = corpus_pipeline.STAGES[3][1](spark, docs_in, SF)
    assert not [r for r in out.collect() if re.search(r"@mail\d\.example\.com", r.text)]


def test_empty_table(spark):
    table = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert table.count() == 0


def test_short_clean_texts_keep_their_language(spark):
    known = {"en": "the cat and the dog went over the hill", "de": "der hund und die katze gingen mit", "fr": "le chat et le chien vont sur la colline", "es": "el gato y el perro van por la colina"}
    rows = [(i, t, k) for i, (k, t) in enumerate([*known.items()] * 20)] + [(900, "жук", None), (901, "colin", None), (902, "1234 !!", None)]
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs(spark, rows), SF).collect()}
    assert {900, 901} <= left and 902 not in left and len(left) == len(rows) - 1
