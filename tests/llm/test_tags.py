from geoflume.llm import jaccard_join, line_dedup
from geoflume.llm._common import keyed

#: Different texts with the same low 32 bits of xxhash64.
A = "bon kan kin dor mar kar kin kas"
B = "bor den kut kan dar lit dus lin"


def test_rows_of_one_doc_id_are_told_apart(spark, make_docs):
    docs = make_docs((None, A), (None, B), (None, A), (1, "other words that are in no other text here"))
    assert keyed(docs).select("id", "tag").distinct().count() == 3
    assert sorted(r.text for r in jaccard_join.one_of_each(docs).collect() if r.doc_id is None) == sorted((A, B))


def test_lines_of_one_text_do_not_go_from_another(spark, make_docs):
    docs = make_docs((None, A), (None, B), (9, A))
    got = sorted(r.text for r in line_dedup.without_repeated_lines(docs, min_chars=5, min_docs=2).collect() if r.doc_id is None)
    assert got == ["", B]
