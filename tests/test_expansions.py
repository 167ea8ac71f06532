"""Expansions against plain Python, with repeated, accented and very long words."""

import random

from termweave.operators.expand import expand_single_word


def within(x, y):
    rest = iter(y)
    return all(c in rest for c in x)


def test_single_words_equal_every_pair(spark):
    rng = random.Random(4)
    some = lambda n, letters: {"".join(rng.choices(letters, k=rng.randint(1, n))) for _ in range(150)}
    tokens = some(5, "abé%_") | {"a", "aa", "ab_", "é%"}
    words = some(9, "abcé%_'") | {"a", "aab" * 4000, "z"}
    found = expand_single_word(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(t, w) for t in tokens for w in words if len(t) < len(w) and t[0] == w[0] and within(t, w)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([], "token string")
    assert expand_single_word(none, spark.createDataFrame([("ab",)], "word string")).isEmpty()
