"""The pipeline against a brute-force version of what its stages decide."""

import corpus_pipeline as C
from hindcast.llm import quality as Q
from hindcast.llm import rules as R
from hindcast.llm import secret_scan as S
from hindcast.sources.tables import read_table

from .test_groups import base_counts, linked, shingles


def test_pipeline(spark, sf_small):
    docs = read_table(spark, sf_small, "documents")
    rows = {d.doc_id: d for d in docs.collect()}
    verdict = {r.doc_id: r for r in R.quality_rules(spark, docs).collect()}
    after = [d for i, d in sorted(rows.items()) if verdict[i].kept]
    for i, d in rows.items():
        n, _, _, _, repeated = base_counts(d.text)
        assert verdict[i].base_failed == (n < 10 or 100 * repeated > 20 * n)

    one = C.quality_rules(spark, docs, sf_small)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d.doc_id for d in after}

    model = Q.fitted(spark, one, read_table(spark, sf_small, "labels"))
    reader = Q.Reader(model.vocabulary)
    after = [d for d in after if Q.scores(model, reader, [d.text])[0] >= Q.THRESHOLD]
    roots = linked([shingles(d.text, 5) for d in after])
    after = [d for n, d in enumerate(after) if roots[n] == n]

    out = C.run(spark, sf_small).collect()
    assert {r.doc_id for r in out} == {d.doc_id for d in after}
    field = S.fitted(spark, spark.createDataFrame(after, docs.schema))
    from .test_text_tools import ids_of
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    for d in after:
        assert lengths[d.doc_id] == len(ids_of(S.masked(d.text, S.all_spans(d.text, field), "<secret>"))) + 1


def test_stages_take_an_empty_table(spark, sf_small):
    docs = read_table(spark, sf_small, "documents").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_small).count() == 0
