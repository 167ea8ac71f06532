"""What keeps the queries over all documents in proportion to their input, against plain results."""

import random
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from termweave.operators import align, feedback
from termweave.plans.fixtures import abbreviated, abbreviated_term


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def full_product(tokens, words, scoring):
    """The best choice by the whole product, as best_alignment defines it."""
    best, options = (0, 0, []), align.abbreviation_windows(tokens, words)
    for choice in product(*options) if options else ():
        n, d, kept = align._judged([*choice], len(tokens), len(words), scoring, False)
        if n * max(best[1], 1) > best[0] * d:
            best = n, d, kept
    return best


def test_plain_choice_equals_the_full_product(monkeypatch):
    rng = random.Random(5)
    plain = 0
    for _ in range(3000):
        words = ["".join(rng.choices("abe", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        tokens = [w[0] + "".join(c for c in w[1:] if rng.random() < 0.6) for w in words]
        if not align.one_each(tokens, words):
            continue
        plain += 1
        for scoring in ("words", "windows"):
            assert align.best_alignment(tokens, words, scoring) == full_product(tokens, words, scoring), (tokens, words)
    assert plain > 500
    # tokens that can trade places are searched
    assert not align.one_each(["ab", "ac"], ["abc", "acb"]) and not align.one_each(["a"], ["a", "b"]) and not align.one_each(["", "a"], ["", "a"])
    # and a name that is its term's abbreviation needs no search
    monkeypatch.setattr(align, "abbreviation_windows", None)
    assert align.best_alignment("th qck brwn th tht".split(), "the quick brown the that".split())[:2] == (5, 5)


def test_counted_uses_give_the_same_rules(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = rng.choices("alpha alp beta bet gamma gem delta".split(), k=rng.randint(0, 5))
        rows.append((f"n{i}", [w[0] + w[2:] for w in words] if i % 5 else ["ab", "_", "G"], words))
    pairs = spark.createDataFrame(rows, "name string, tokens array<string>, term_tokens array<string>").repartition(3)
    uses, counted = feedback.abbreviation_uses(pairs), feedback.counted_uses(pairs)
    want = Counter((r.token, r.phrase) for r in uses.collect())
    assert {(r.token, r.phrase): r.n for r in counted.collect()} == want and want
    assert rows_of(feedback.rewrite_rules(counted)) == rows_of(feedback.rewrite_rules(uses))
    assert rows_of(feedback.overall_entries(counted)) == rows_of(feedback.expansion_dictionary(uses)[1])


def test_a_term_is_abbreviated_as_its_words(spark):
    words = "a ea area the ioeu oboe sky quay bcd".split()
    term = F.lit(" ".join(words))
    each = F.array_join(F.transform(F.split(term, " "), abbreviated), "_")
    row = spark.range(1).select(abbreviated_term(term).alias("a"), each.alias("b")).first()
    assert row.a == row.b


def test_expansions_look_for_a_beginning_once(monkeypatch):
    from termweave.operators import expand

    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 8))) for _ in range(400)})
    tokens = ["ab" + x + y for x in "abcé" for y in "abcé"]
    calls, search = [], np.searchsorted
    monkeypatch.setattr(expand.np, "searchsorted", lambda *a: calls.append(a) or search(*a))
    within = lambda x, y: (rest := iter(y)) and all(c in rest for c in x)
    got = {(t, words[i]) for t, rows in expand._containing(tokens, words) for i in rows.tolist()}
    assert got == {(t, w) for t in tokens for w in words if len(t) < len(w) and t[0] == w[0] and within(t, w)} and got
    assert len(calls) == 1 + 4 + 16
    assert [r.tolist() for _, r in expand._containing(["a"], [])] == [[]]


def test_expansions_in_many_groups(spark, monkeypatch):
    from termweave.operators import expand

    monkeypatch.setattr(expand, "GROUP_TOKENS", 7)
    monkeypatch.setattr(expand, "GROUP_WORDS", 11)
    rng = random.Random(8)
    words = ["".join(rng.choices("ab\N{MUSICAL SYMBOL G CLEF}", k=rng.randint(1, 7))) for _ in range(120)] + [None, ""]
    tokens = ["".join(rng.choices("ab\N{MUSICAL SYMBOL G CLEF}", k=rng.randint(1, 4))) for _ in range(60)] + [None, ""]
    found = expand.expand_single_word(
        spark.createDataFrame([(x,) for x in tokens], "token string"), spark.createDataFrame([(x,) for x in words], "word string")
    )
    within = lambda x, y: (rest := iter(y)) and all(c in rest for c in x)
    want = {(t, w) for t in tokens for w in words if t and w and len(t) < len(w) and t[0] == w[0] and within(t, w)}
    assert rows_of(found) == sorted(want)


def test_words_are_distinct_within_their_term(spark):
    from termweave.operators import block

    rows = [("The Cust cust ADDR", ["The", "Cust", "cust", "ADDR"]), ("9 addr _", ["9", "addr", "_"]), ("none", []), ("empty", [])]
    terms = spark.createDataFrame(rows, "term string, tokens array<string>")
    assert rows_of(block.index_tokens(terms, once=True)) == rows_of(block.index_tokens(terms))
    plan = block.index_tokens(terms, once=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_blocking_counts_only_words_that_are_asked(spark):
    from termweave.operators import block

    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["the", "9a"]
    texts = sorted({" ".join(rng.choices(words, weights=[1 + 40 * (i < 3) for i in range(32)], k=4)) for _ in range(500)})
    terms = spark.createDataFrame([(i, x, x.split(" ")) for i, x in enumerate(texts)], "term_id long, term string, tokens array<string>")
    names = [(i, f"n{i}", [(" ".join(rng.choices([*words, "absent"], k=3)), 1.0)]) for i in range(40)]
    asked = spark.createDataFrame(names, "name_id long, name string, derived array<struct<text:string,score:double>>")
    df = Counter(w for x in texts for w in set(x.split(" ")))
    cap = sorted(df.values())[-4]
    usable = {w for w in df if df[w] < cap and w[0].isalpha() and w != "the"}
    want = sorted((n, m, i, x) for n, m, d in names for i, x in enumerate(texts) if usable & set(x.split(" ")) & set(d[0][0].split(" ")))
    assert want and rows_of(block.block_candidates(asked, terms, cap=cap, once=True)) == want
    twice = terms.unionByName(terms.select((F.col("term_id") + 1000).alias("term_id"), "term", "tokens"))
    both = sorted(want + [(n, m, i + 1000, x) for n, m, i, x in want])
    assert rows_of(block.block_candidates(asked, twice, cap=cap)) == both


def test_plain_names_are_split(spark):
    from termweave.functions import names

    texts = ["AB_CD", "ab cd", "A", "a_b c", "AB__CD", "Ab_cd", "ab_", "_ab", "ab-cd", "007_ab", "", "AB_cd", "éa b", "ab  cd", "ab\n", "a b"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select("x", names.tokenize(F.col("x")).alias("a"), names._searched(F.col("x")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == len(texts)


def test_names_are_judged_without_a_shuffle_of_their_tokens(spark):
    from termweave.operators import expand

    names = spark.createDataFrame([(1, "a", ["Cust", "of", "xq", "zz"]), (2, "b", ["order", "xq"])], "name_id long, name string, tokens array<string>")
    lexicon = spark.createDataFrame([("cust",), ("of",), ("xq",), ("zz",)], "form string")
    got = expand.classified_tokens(names, lexicon, spark.createDataFrame([("xq",), ("order",)], "word string"))
    want = [(1, "a", 0, "Cust", True), (1, "a", 1, "of", True), (1, "a", 2, "xq", True), (1, "a", 3, "zz", False), (2, "b", 0, "order", False), (2, "b", 1, "xq", True)]
    assert rows_of(got) == want
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def asked_and_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the", "9a"]
    texts = sorted({" ".join(rng.choices(words, weights=[1 + 40 * (i < 3) for i in range(32)], k=4)) for _ in range(500)})
    names = [(i, f"n{i}", [(" ".join(rng.choices([*words, "absent"], k=3)), 1.0)]) for i in range(40)]
    df = Counter(w for x in texts for w in set(x.split(" ")))
    cap = sorted(df.values())[-4]
    usable = {w for w in df if df[w] < cap and w[0].isalpha() and w != "the"}
    want = sorted((n, m, x) for n, m, d in names for x in texts if usable & set(x.split(" ")) & set(d[0][0].split(" ")))
    return names, texts, cap, want


def test_terms_without_ids_are_distinct(spark):
    from termweave.operators import block

    names, texts, cap, want = asked_and_texts(12)
    asked = spark.createDataFrame(names, "name_id long, name string, derived array<struct<text:string,score:double>>")
    rows = [(x, x.upper().split(" ")) for x in texts for _ in range(1 + len(x) % 3)] + [(None, None), ("", [])]
    terms = spark.createDataFrame(rows, "term string, tokens array<string>").repartition(3)
    for part in (None, terms.where("length(term) > 8"), terms.limit(0), terms):
        assert rows_of(block.block_candidates(asked, terms, cap=cap, part=part)) == want
    assert want


def test_tokens_of_all_terms_are_made_once(spark):
    from termweave.operators import block

    names, texts, cap, want = asked_and_texts(13)
    made = spark.sparkContext.accumulator(0)

    def split(text):
        made.add(1)
        return text.split(" ")

    asked = spark.createDataFrame(names, "name_id long, name string, derived array<struct<text:string,score:double>>")
    terms = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "term_id long, term string").withColumn("tokens", F.udf(split, "array<string>")("term"))
    found = block.block_candidates(asked, terms, cap=cap, once=True).drop("term_id")
    assert rows_of(found) == want and want
    assert made.value < 1.5 * len(texts)


def test_gram_sets_are_made_once_a_pair(spark):
    from termweave.functions import names
    from termweave.operators import features

    texts = ["", "a", "ab", "blue anvil", "aaaa", "\N{MUSICAL SYMBOL G CLEF}éx", None]
    grams = lambda x: {f"##{x}$$"[i : i + 3] for i in range(len(x) + 2)}
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    sets = rows.select("x", "y", names.trigrams(F.col("x")).alias("a"), names.trigrams(F.col("y")).alias("b"))
    got = sets.select("x", "y", "a", features.gram_similarity(F.array("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.a is None if r.x is None else (set(r.a) == grams(r.x) and len(set(r.a)) == len(r.a))
        want = 0.0 if r.x is None or r.y is None else len(grams(r.x) & grams(r.y)) / len(grams(r.x) | grams(r.y))
        assert abs(r.p - want) < 1e-12
    # what makes a text or a set stands in the plan once, not beside every place or string
    plan = lambda c: rows.select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(names.trigrams(F.reverse("x"))).count("reverse(x") == plan(F.reverse("x").alias("c")).count("reverse(x") + 1
    assert plan(features.gram_similarity(F.array(F.array("x")), F.array(F.reverse("y"))).alias("c")).count("reverse(y") == 1


def test_segments_are_found_in_texts_as_they_are(spark):
    import re

    from termweave.plans.fixtures import segments

    texts = ["", None, "123 -- !", "One", "a b c d e f", "A1b2C3d4E5f6g7 h", "état naïve İstanbul\nline\ttab  two", " lead and trail. ", "x " * 40]
    rows = segments(spark.createDataFrame([*enumerate(texts)], "id long, text string"), "id")
    want = []
    for text in texts:
        words = re.findall("[a-z]+", (text or "").lower())
        want += [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    assert sorted(r.term for r in rows.collect()) == sorted(want) and len({r.seg_id for r in rows.collect()}) == len(want)
    # no array is cut word by word
    assert "lambda" not in rows.select("term")._jdf.queryExecution().optimizedPlan().toString()


def test_posting_lists_are_made_without_a_shuffle_of_postings(spark, monkeypatch):
    from termweave.operators import block

    rng = random.Random(14)
    words = [f"w{i}" for i in range(40)]
    terms = sorted({" ".join(rng.choices(words, weights=[1 + 60 * (i < 3) for i in range(40)], k=4)) for _ in range(400)})
    postings = sorted({(w, x) for x in terms for w in x.split(" ")})
    df = Counter(w for w, _ in postings)
    index = spark.createDataFrame([*postings, (None, "w0")], "token string, term string").repartition(3)
    shuffles = lambda lists: "hashpartitioning" in lists._jdf.queryExecution().executedPlan().toString()
    assert not shuffles(block.inverted_index(index, 7))
    rows = [(x, [w.upper() for w in x.split(" ")] + ["the", "9a", None]) for x in terms] + [("none", []), ("null", None)]
    own = block.own_tokens(spark.createDataFrame(rows, "term string, tokens array<string>").repartition(3))
    monkeypatch.setattr(block, "RUN_BYTES", 5000)
    # all tokens, some, or none are few enough to be sent to the postings
    for sent, given in product((40, 3, 0), (index, own)):
        monkeypatch.setattr(block, "SENT_TOKENS", sent)
        found = block.inverted_index(given, 7)
        lists = found.collect()
        assert sorted((r.token, x, r.df) for r in lists for x in r.terms) == [(w, x, df[w]) for w, x in postings]
        assert max(len(r.terms) for r in lists) == 7 and len({(r.token, r.block) for r in lists}) == len(lists)
        assert all(r.terms == sorted(r.terms) for r in lists)
        assert shuffles(found) == (sent < 40)


def test_a_tidy_write_leaves_the_setting(spark):
    from termweave import session

    before = spark.conf.get(session.TIDY_SETTING)
    rows = session.written(spark.range(50).select((F.col("id") % 7).alias("x")).distinct(), tidy=True)
    assert sorted(r.x for r in rows.collect()) == [*range(7)] and spark.conf.get(session.TIDY_SETTING) == before


def test_letters_are_told_with_and_without_a_search(spark):
    from termweave.functions import names

    texts = ["", "a", "z", "{", "`", "A", "Z9", "é", "9a", "_a", "\na", " a", "ß", "\u0130", "\N{MUSICAL SYMBOL G CLEF}", "\N{GOTHIC LETTER AHSA}", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select("x", names.starts_with_letter(F.col("x")).alias("a"), F.col("x").rlike(r"^\p{L}").alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False, None}
