import itertools
import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions.names import binary_entropy, is_subsequence, matching_tokens, tokenize
from termweave.operators import align
from termweave.operators.derive import derived_strings
from termweave.operators.expand import expand_acronym, expand_single_word
from termweave.operators.features import FEATURES, score_incremental, score_pairs

TOKENS = {
    "CUST_ID": ["CUST", "ID"], "ABCd": ["AB", "Cd"], "aBC": ["a", "BC"], "custID2Name": ["cust", "ID", "2", "Name"],
    "addr007x": ["addr", "7", "x"], "a__b": ["a", "__", "b"], "a_-b": ["a", "b"], "name_": ["name", "_"], "_x": ["x"],
    "__x": ["__", "x"], "9-": ["9", "-"], "a-_": ["a", "_"], "x--_": ["x", "--", "_"], "ABc1": ["A", "Bc", "1"], "000": ["0"],
    "a  b": ["a", "  ", "b"], "Ab": ["Ab"], "": [],
}


def test_tokenize(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "name string")
    assert {r[0]: r[1] for r in df.select("name", tokenize(F.col("name"))).collect()} == TOKENS


def test_scalars(spark):
    df = spark.createDataFrame([("ace", "abcde"), ("ca", "abc"), ("a%", "xa1%"), ("", "a"), ("a_", "ab")], "x string, y string")
    assert [r[0] for r in df.select(is_subsequence(F.col("x"), F.col("y"))).collect()] == [True, False, True, True, False]
    e = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double").select(binary_entropy(F.col("p"))).collect()
    assert [r[0] for r in e] == [0.0, 0.0, 1.0]
    t = spark.createDataFrame([(["the", "x", "id"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in t.select(matching_tokens(F.col("t"))).collect()] == [["id"], ["x"], []]


def test_alignment_vectors():
    assert align.abbreviation_windows(["dob"], ["date", "of", "birth"]) == [[(0, 3, 3, 0)]]
    assert align.best_alignment(["dob"], ["date", "of", "birth"])[:2] == (3, 3)
    assert align.best_alignment(["dob"], ["date", "birth"])[:2] == (0, 0)
    assert align.smith_waterman([("cat", "hat"), ("", "x")]) == pytest.approx([4.0, 0.0])
    assert align.affine([("dva", "deeva"), ("", "abc"), ("", "")]) == pytest.approx([4.8, -1.6, 0.0])
    assert align.greedy_overlap(["cust", "addr"], ["customer", "address"]) == 2


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignments_equal_plain_recursions(a, b):
    score = lambda x, y: 2.0 if x == y else -1.0
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    g = [[-0.8 * (i + j) if 0 in (i, j) else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + score(a[i - 1], b[j - 1]), h[i - 1][j] - 0.8, h[i][j - 1] - 0.8)
        g[i][j] = max(g[i - 1][j - 1] + score(a[i - 1], b[j - 1]), g[i - 1][j] - 0.8, g[i][j - 1] - 0.8)
    assert align.smith_waterman([(b, ""), (a, b), (a + "x", b)])[1] == pytest.approx(max(map(max, h)))
    assert align.needleman_wunsch(a, b) == pytest.approx(g[-1][-1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 3)), max_size=6))
def test_heaviest_windows(raw):
    windows = [(a, a + n, n, i) for i, (a, n) in enumerate(raw)]
    best = 0
    for k in range(len(windows) + 1):
        for some in itertools.combinations(windows, k):
            ordered = sorted(some)
            if all(x[1] <= y[0] for x, y in itertools.pairwise(ordered)):
                best = max(best, sum(w[2] for w in some))
    kept = sorted(align.heaviest(windows))
    assert sum(w[2] for w in kept) == best and all(x[1] <= y[0] for x, y in itertools.pairwise(kept))


def test_expansions_equal_brute_force(spark):
    tokens, words = ["bl", "b", "rd", "gzm"], ["blue", "ball", "bed", "read", "red", "gizmo", "b", "bl"]
    phrases = ["bank of london", "bank london", "big of", "read only disk", "road disk", "red and dead", "go zoo my"]
    stop = ["of", "and", "only"]
    v = spark.createDataFrame([(t,) for t in tokens], "token string")

    def sub(x, y):
        rest = iter(y)
        return all(c in rest for c in x)

    def spelled(token, phrase):
        k = 0
        for w in phrase.split(" "):
            if k < len(token) and w[0] == token[k]:
                k += 1
            elif w not in stop or k == len(token):
                return False
        return k == len(token) and len(token) < len(phrase)

    got = expand_single_word(v, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {tuple(r) for r in got} == {(t, w) for t in tokens for w in words if t[0] == w[0] and len(t) < len(w) and sub(t, w)}
    got = expand_acronym(v, spark.createDataFrame([(p,) for p in phrases], "phrase string"), stop).collect()
    assert {tuple(r) for r in got} == {(t, p) for t in tokens for p in phrases if spelled(t, p)}


def test_pruned_products_equal_full_ones(spark):
    import random

    random.seed(3)
    rows, lists = [], {}
    for name in range(60):
        lists[name] = [[random.choice([-1.0, 0.0, 0.9, 0.31, -0.4, 0.7, -0.2]) for _ in range(random.randint(1, 4))] for _ in range(random.randint(1, 4))]
        rows += [(name, p, f"{p}{r}", s, r) for p, some in enumerate(lists[name]) for r, s in enumerate(some)]
    got = derived_strings(spark.createDataFrame(rows, "name_id long, pos int, expansion string, score double, rank int"), beam=5).collect()
    for row in got:
        full = []
        for path in itertools.product(*(range(len(x)) for x in lists[row.name_id])):
            scores = [lists[row.name_id][p][r] for p, r in enumerate(path)]
            value, scored = 1.0, False
            for s in scores:
                if s not in (-1.0, 0.0):
                    value, scored = value * s, True
            full.append((round(-(value if scored else 0.0), 9), path, " ".join(f"{p}{r}" for p, r in enumerate(path))))
        assert [d["text"] for d in row.derived] == [x[2] for x in sorted(full)[:5]]


def test_incremental_equals_full(spark):
    rows = [
        (1, ["CUST", "ADDR"], [("customer address", 0.9)], 7, ["customer", "address"]),
        (2, ["DOB"], [("date of birth", 0.5), ("dob", 0.1)], 8, ["date", "of", "birth"]),
        (3, ["X"], None, 9, ["unknown"]),
    ]
    pairs = spark.createDataFrame(rows, "name_id long, tokens array<string>, derived array<struct<text:string,score:double>>, term_id long, term_tokens array<string>")
    full = score_pairs(pairs)
    values = {r.name_id: {c: r[c] for c in FEATURES} for r in full.collect()}
    assert values[1]["overlap_coeff"] == values[1]["jaccard_coeff"] == 1.0
    assert values[2]["abbr_jaccard_coeff"] == 1.0 and values[3]["normalized_smith_waterman_dist"] == 0.0
    seen = [F.when(F.col("name_id") != 1, F.col(c)).alias(c) for c in FEATURES]
    stale = [F.when(F.col("name_id") == 2, F.lit(0.123)).otherwise(s).alias(c) if c.startswith("normalized") else s for c, s in zip(FEATURES, seen, strict=True)]
    later = full.select("name_id", "tokens", "derived", "term_id", "term_tokens", *stale, (F.col("name_id") == 2).alias("updated"))
    assert {r.name_id: {c: r[c] for c in FEATURES} for r in score_incremental(later).collect()} == values


def test_restricted_subsequence(spark):
    from termweave.functions.names import is_restricted_subsequence

    def scan(x, y):
        i = 0
        for j, c in enumerate(y):
            if i < len(x) and x[i] == c and not (c in "aeiou" and i and j and x[i - 1] != y[j - 1]):
                i += 1
        return i == len(x)

    rng = random.Random(4)
    rows = [("".join(rng.choices("abei", k=rng.randint(0, 4))), "".join(rng.choices("abei", k=rng.randint(0, 7)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select("x", "y", is_restricted_subsequence(F.col("x"), F.col("y")).alias("r")).collect()
    assert [r.r for r in got] == [scan(x, y) for x, y in rows] and any(r.r for r in got)


def test_lemmas_make_a_token_english(spark):
    from termweave.operators.expand import classified_tokens

    names = spark.createDataFrame([(1, "ORDERS_XQ", ["ORDERS", "XQ"])], "name_id long, name string, tokens array<string>")
    lexicon, words = spark.createDataFrame([("order",)], "form string"), spark.createDataFrame([("x",)], "word string")
    lemmas = spark.createDataFrame([("orders", "order"), ("xq", "none")], "form string, lemma string")
    for table, want in ((None, [False, False]), (lemmas, [True, False])):
        got = classified_tokens(names, lexicon, words, lemmas=table).orderBy("pos").collect()
        assert [r.english for r in got] == want


def test_affine_against_the_plain_recurrence():
    rng = random.Random(6)
    pairs = [("".join(rng.choices("abc ", k=rng.randint(0, 9))), "".join(rng.choices("abc ", k=rng.randint(0, 9)))) for _ in range(300)]

    def plain(a, b):
        low = float("-inf")
        best = {(0, 0): (0.0, low, low)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    m = max(best[i - 1, j - 1]) + (2.0 if a[i - 1] == b[j - 1] else -1.0) if i and j else low
                    x = max(best[i - 1, j][0] - 0.8, best[i - 1, j][1] - 0.4) if i else low
                    y = max(best[i, j - 1][0] - 0.8, best[i, j - 1][2] - 0.4) if j else low
                    best[i, j] = (m, x, y)
        return max(best[len(a), len(b)])

    assert align.affine(pairs) == pytest.approx([plain(a, b) for a, b in pairs])


def plain_windows(token, words):
    """(first word, words) by plain recursion over the cuts of a token."""

    def within(x, y):
        rest = iter(y)
        return all(c in rest for c in x)

    def cuts(rest, following):
        inner = [j for j in range(1, len(rest)) if following < len(words) and rest[j] == words[following][0]]
        return [*inner, len(rest)]

    def longest(rest, i):
        if not rest:
            return 0
        if i == len(words):
            return -len(words)
        best = 0
        for j in cuts(rest, i + 1):
            if not within(rest[:j], words[i]):
                break
            n = longest(rest[j:], i + 1) + 1
            best = n if rest[:j] == rest == words[i] else max(best, n)
        return best if best > 0 else -len(words)

    out = []
    for i, word in enumerate(words):
        for j in cuts(token, i + 1) if word[0] == token[0] else ():
            if not within(token[:j], word):
                break
            n = longest(token[j:], i + 1) + 1
            if n > 0 and (i, n) not in out:
                out.append((i, n))
    return out


def plain_alignment(tokens, words, scoring, compat):
    """The first of the best choices, of all choices."""
    options = [[(j, j + n, n, i) for j, n in plain_windows(t, words)] for i, t in enumerate(tokens)]
    best = (0.0, 0, 0, [])
    options = [some for some in options if some]
    for choice in itertools.product(*options) if options else ():
        found = []
        for kept, plain in ((k := align.earliest_end(list(choice)), k), (align.heaviest(list(choice), compat), align.heaviest(list(choice)))):
            span = sum(w[2] for w in plain)
            n, d = (span, len(tokens) + len(words) - len(plain)) if scoring == "words" else (len(plain), len(tokens) + len(words) - span)
            found.append((n / d, n, d, kept))
        one = found[0] if found[0][0] >= found[1][0] else found[1]
        if one[0] > best[0]:
            best = one
    return best[1:]


short = st.text("abc", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(short, st.lists(st.text("abc", min_size=1, max_size=5), max_size=6))
def test_token_windows_equal_enumeration(token, words):
    assert list(dict.fromkeys(align.token_windows(token, tuple(words)))) == plain_windows(token, words)


@settings(max_examples=150, deadline=None)
@given(st.lists(short, max_size=5), st.lists(st.text("abc", min_size=1, max_size=4), max_size=6), st.sampled_from(["words", "windows"]), st.booleans())
def test_best_alignment_equals_full_product(tokens, words, scoring, compat):
    assert align.best_alignment(tokens, words, scoring, compat) == plain_alignment(tokens, words, scoring, compat)


@pytest.mark.parametrize("seed", range(4))
def test_best_alignment_of_many_choices_equals_full_product(seed):
    rng = random.Random(seed)
    tokens, words = ["a"] * 6 + ["ab"], ["ab", "ac", "ab", "bb", "ad", "aab"]
    rng.shuffle(tokens)
    rng.shuffle(words)
    sizes = [len(some) for some in align.abbreviation_windows(tokens, words)]
    assert 20_000 < math.prod(sizes) < 2_000_000
    assert align.best_alignment(tokens, words) == plain_alignment(tokens, words, "words", False)


def test_alignments_of_repeated_letters_are_fast():
    words = tuple("a" + chr(98 + i % 20) * 3 + "a" for i in range(60))
    least = min(_timed(lambda: align.token_windows("a" * 60, words)) for _ in range(5))
    assert least < 0.01
    assert _timed(lambda: align.best_alignment(["a"] * 12, ["a" + chr(98 + i) for i in range(12)])) < 1
    assert align.best_alignment(["a"] * 12, ["a" + chr(98 + i) for i in range(12)])[:2] == (12, 12)


def _timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_merge_derived_equals_brute_force(spark):
    from termweave.operators.feedback import merge_derived

    rng = random.Random(2)
    rows, local, overall = [], [], [(t, f"{t}{k}") for t in "abcd" for k in range(rng.randint(0, 4))]
    overall += [("a", "a x"), ("b", "x b"), ("a", "a0")]
    for i in range(60):
        tokens = [rng.choice("ABCDE") for _ in range(rng.randint(0, 3))]
        made = sorted({rng.choice(["a0 b0", "a x b", "c1", "zz", "a1 a1"]) for _ in range(rng.randint(0, 3))})
        rows.append((i, f"n{i}", tokens, [(t, rng.choice([1.0, 0.8, 0.3])) for t in made] if i % 9 else None))
        if i % 4 == 0:
            local += [(f"n{i}", t.lower(), f"own {t.lower()}{k}") for t in tokens[:1] for k in range(2)]
    beam = 6
    names = spark.createDataFrame(rows, "name_id long, name string, tokens array<string>, derived array<struct<text:string,score:double>>")
    got = merge_derived(names, spark.createDataFrame(local, "name string, token string, expansion string"), spark.createDataFrame(overall, "token string, expansion string"), beam)
    want = {}
    for i, name, tokens, derived in rows:
        has = any(x[0] == name for x in local)
        kept = [(t, s) for t, s in derived or [] if not has or s == 1.0]
        top = 1.0 if has else max([s for _, s in derived or []], default=0.5)
        options = []
        for t in map(str.lower, tokens):
            mine = {e for n, x, e in local if n == name and x == t} or {e for x, e in overall if x == t} or {t}
            options.append(sorted(mine))
        made = list(dict.fromkeys(" ".join(c) for c in itertools.product(*options))) if tokens else []
        best = {}
        for k, (t, s) in enumerate([*kept, *((m, top) for m in made)]):
            best[t] = (max(s, best[t][0]), *best[t][1:]) if t in best else (s, k >= len(kept), k)
        order = sorted(best, key=lambda t: (-best[t][0], *best[t][1:]))[:beam]
        want[i] = ([(t, best[t][0]) for t in order], any((m, top) not in kept for m in made))
    assert {r.name_id: ([tuple(d) for d in r.derived], r.updated) for r in got.collect()} == want


def test_merge_derived_of_long_names_is_bounded(spark):
    from termweave.operators.feedback import merge_derived

    letters = "abcdefghij"
    names = spark.createDataFrame([(1, "n", list(letters), [("x", 0.4)])], "name_id long, name string, tokens array<string>, derived array<struct<text:string,score:double>>")
    overall = spark.createDataFrame([(t, f"{t}{k:02}") for t in letters for k in range(20)], "token string, expansion string")
    local = spark.createDataFrame([], "name string, token string, expansion string")
    row = merge_derived(names, local, overall).first()
    assert row.updated and [d.text for d in row.derived] == ["x"] + [" ".join(f"{t}00" for t in letters[:-1]) + f" j{k:02}" for k in range(9)]


def plain_contexts(cells, expansions, reach, stop):
    import re

    out = []
    for e in dict.fromkeys(expansions):
        run = [w for w in re.split("[ -]", e) if len(w) > 1 and w not in stop]
        for cell, text in cells:
            if text is None or not run or e not in text.lower():
                continue
            words = [w for w in re.split(r"[;:'/. ,&()_-]", text.lower()) if len(w) > 1 and w not in stop]
            right, start = len(run) + reach if " " in e else reach, 0
            for p in range(len(words)):
                if p >= start and words[p : p + len(run)] == run:
                    end = min(p + right, len(words))
                    out.append((e, cell, words[max(p - reach, start) : end]))
                    start = end
    return sorted(out, key=str)


def test_contexts_equal_plain_search(spark):
    from termweave.operators.context import candidate_context

    rng = random.Random(8)
    words = ["red", "fox", "ox", "of", "a", "Yard", "yard", "the", "blue"]
    cells = [(f"c{i}", "".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", ". ", "", " & "]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    cells += [("null", None), ("empty", ""), ("apart", "red - yard and fox yard. redox yards"), ("end", "red yard")]
    expansions = ["red", "red fox", "fox yard", "red-yard", "of red", "red of yard", "the", "a", "ox yard", "blue a red", "yard", "yard", "x yard"]
    got = candidate_context(spark.createDataFrame(cells, "cell_id string, text string"), spark.createDataFrame([(e,) for e in expansions], "expansion string"), 2, ["of", "the"])
    assert sorted([tuple(r) for r in got.select("expansion", "cell_id", "window").collect()], key=str) == plain_contexts(cells, expansions, 2, ["of", "the"])


def test_contexts_carry_no_texts(spark):
    from termweave.operators.context import postings

    cells = spark.createDataFrame([("c", " ".join(f"word{i}" for i in range(3000)))], "cell_id string, text string")
    rows = postings(cells, 3, 2, 4).collect()
    assert len(rows) == 3000 and max(len(r.around) for r in rows) == 8 and max(len(r.as_is.split()) for r in rows) == 4


def test_vector_sums_equal_plain_ones(spark):
    from termweave.operators.context import expansion_vector, name_context_vector

    vectors = spark.createDataFrame([("ab", [1.0, 2.0]), ("cd", [3.0, -1.0])], "word string, vector array<double>")
    names = spark.createDataFrame([(1, ["AB", "cd", "ab", "x", "zz"]), (2, ["zz"]), (3, ["CD"])], "name_id long, tokens array<string>")
    assert {r.name_id: r.vector for r in name_context_vector(names, vectors).collect()} == {1: pytest.approx([5 / 3, 1.0]), 3: [3.0, -1.0]}
    contexts = spark.createDataFrame([("e", ["ab", "zz"]), ("e", ["cd", "ab"]), ("f", ["zz"])], "expansion string, window array<string>")
    assert {r.expansion: r.vector for r in expansion_vector(contexts, vectors).collect()} == {"e": pytest.approx([1.25, 0.75])}


def test_block_candidates_equal_brute_force(spark):
    from termweave.operators import block

    rng = random.Random(11)
    vocabulary = [f"w{c}" for c in "abcdfghij"] + ["hot", "of", "9x"]
    terms = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))) for i in range(120)] + [(500, "hot wa"), (501, "hot wa"), (501, "hot wa")]
    names = [(i, f"n{i}", [(" ".join(rng.choices(vocabulary, k=2)), 1.0) for _ in range(rng.randint(0, 3))]) for i in range(80)] + [(900, "none", None)]
    terms_df = spark.createDataFrame([(i, t, t.title().split()) for i, t in terms], "term_id long, term string, tokens array<string>")
    names_df = spark.createDataFrame(names, "name_id long, name string, derived array<struct<text:string,score:double>>")
    usable = lambda t: {w for w in t.split() if w[0].isalpha() and w != "of"}
    df = {w: len({t for _, t in terms if w in usable(t)}) for w in vocabulary}
    for cap, size in ((300, 1000), (300, 5), (12, 4)):
        want = []
        for i, name, derived in names:
            words = {w for text, _ in (derived or [])[:2] for w in text.split(" ")}
            want += [(i, name, k, t) for k, t in terms if any(w in words and df[w] < cap for w in usable(t))]
        got = block.block_candidates(names_df, terms_df, top=2, cap=cap, size=size)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    index = block.index_tokens(terms_df)
    lists = block.inverted_index(index, 7).collect()
    assert max(len(r.terms) for r in lists) <= 7 and len({(r.token, r.block) for r in lists}) == len(lists)
    assert sorted((r.token, t, r.df) for r in lists for t in r.terms) == sorted((w, t, df[w]) for w in df for t in {t for _, t in terms if w in usable(t)})


def test_a_hot_token_is_shared_by_tasks(spark):
    from termweave.operators import block

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        terms = spark.range(200).selectExpr("id as term_id", "concat('hot t', id) as term", "array('hot', concat('t', id)) as tokens")
        names = spark.range(3000).selectExpr("id as name_id", "concat('n', id) as name", "array(named_struct('text', 'hot', 'score', 1.0d)) as derived")
        pairs = block.block_candidates(names, terms, size=50)
        counts = sorted(r[1] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
        assert sum(counts) == 600_000 and len(counts) == 8 and counts[-1] <= 3 * counts[4]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
