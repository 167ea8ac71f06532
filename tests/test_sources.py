"""Text files with a title, both outputs of the text formatter, and review pairs of either kind."""

import pytest
from pyspark.sql import functions as F

from termweave.operators import evaluate, expand
from termweave.sources import catalog

ODD = ['say "id"', "back\\slash", " lead", "trail ", "a, b", "it''s", 'x"y"z', "tab\there", "ünï", "#no comment", "''"]


def test_lines_come_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = spark.createDataFrame([(x,) for x in ODD], "value string").repartition(3)
    catalog.write_lines(lines, path, "TITLE")
    raw = [r.value for r in spark.read.text(path).collect()]
    assert raw.count("TITLE") > 1 and sorted(x for x in raw if x != "TITLE") == sorted(ODD)
    assert sorted(r.value for r in catalog.read_lines(spark, path).collect()) == sorted(ODD)


@pytest.mark.parametrize("end", ["\n", ""])
def test_files_of_relations_and_terms(spark, tmp_path, end):
    (tmp_path / "rel.txt").write_text("RELATIONS\nS.T(A, B)\n\nS.U(C)\nbroken" + end)
    (tmp_path / "bt.txt").write_text("TERMS\nzip code\nTERMS\n\nzip code" + end)
    rows = catalog.scan_relation_file(spark, str(tmp_path / "rel.txt")).collect()
    assert {r[1:] for r in rows} == {("S", "T", "A"), ("S", "T", "B"), ("S", "U", "C")} and len({r.col_id for r in rows}) == 3
    # only the first line is the title; an equal line further on is a term
    terms = catalog.scan_term_file(spark, str(tmp_path / "bt.txt"))
    assert sorted(r.term for r in terms.collect()) == ["TERMS", "zip code"]
    (tmp_path / "empty.txt").write_text("TERMS" + end)
    assert catalog.scan_term_file(spark, str(tmp_path / "empty.txt")).isEmpty()


def test_terms_of_the_text_formatter(spark):
    rows = spark.createDataFrame([("A", "zip"), ("B", "zip"), ("C", None), ("D", "name")], "column_name string, business_term string")
    assert sorted(r.value for r in catalog.format_term_text(rows, "business_term").collect()) == ["name", "zip"]
    assert catalog.format_term_text(rows.where("false"), "business_term").isEmpty()


def test_vector_text_leaves_the_header_out(spark):
    lines = spark.createDataFrame([("2 3",), ("cat 1 2.5 -3e-2",), (" dog 0 0 1 ",)], "value string")
    assert sorted(map(tuple, catalog.load_vector_text(lines).collect())) == [("cat", [1.0, 2.5, -0.03]), ("dog", [0.0, 0.0, 1.0])]


def test_review_pairs_of_either_kind(spark):
    scored = spark.createDataFrame([(f"n{i}", "t", i / 10, i % 2 == 0) for i in range(10)], "name string, term string, p double, label boolean")
    for gold in (False, True):
        found = evaluate.review_pairs(scored, "p", 0.3, gold=gold).collect()
        assert len(found) == 2 and all(r.p >= 0.3 and r.label == gold for r in found)
    assert evaluate.review_pairs(scored, "p", 0.3, n=10, gold=True).count() == 3


def test_lemmas_make_inflected_tokens_english(spark):
    names = spark.createDataFrame([(1, "ORDERS_IDS_XYZS", ["ORDERS", "IDS", "XYZS"])], "name_id long, name string, tokens array<string>")
    lexicon = spark.createDataFrame([("order",), ("id",)], "form string")
    words = spark.createDataFrame([("order",)], "word string")
    lemmas = spark.createDataFrame([("orders", "order"), ("ids", "id"), ("xyzs", "xyz")], "form string, lemma string")
    english = lambda **more: [r.english for r in expand.classified_tokens(names, lexicon, words, **more).orderBy("pos").collect()]
    # ids has a lemma, but is short and no word of the domain
    assert english() == [False, False, False] and english(lemmas=lemmas) == [True, False, False]
    assert expand.classified_tokens(names.where(F.lit(False)), lexicon, words, lemmas=lemmas).isEmpty()
