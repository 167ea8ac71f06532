"""Column functions over names, tokens and pairs of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words, and the list without single letters that stages after blocking use.
STOP_WORDS = """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
    haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
    weren weren't won won't wouldn wouldn't
    """.split()
MATCH_STOP_WORDS = [w for w in STOP_WORDS if w not in ("d", "s", "m", "o", "y", "t")]

#: Upper-case run, capitalised or lower-case word, number, repeated symbol, symbol at the very end.
NAME_TOKEN = (
    r"\p{Lu}+(?![\p{L}&&[^\p{Lu}]])|\p{Lu}?[\p{L}&&[^\p{Lu}]]+|\p{Nd}+"
    r"|([^\p{L}\p{Nd}])\1+|[^\p{L}\p{Nd}]\z"
)


#: Words of one case between single spaces or underscores: what tokenize finds there is a split.
PLAIN_NAME = r"\A(?:[a-z]++(?:[ _][a-z]++)*+|[A-Z]++(?:[ _][A-Z]++)*+)\z"


def tokenize(name: Column) -> Column:
    """Camel-case, digit and symbol tokens of a name; numbers lose leading zeros."""
    return F.when(name.rlike(PLAIN_NAME), F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")).otherwise(_searched(name))


def _searched(name: Column) -> Column:
    found = F.regexp_extract_all(name, F.lit(NAME_TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.when(x.startswith("0"), F.regexp_replace(x, r"^0+(?=\p{Nd})", "")).otherwise(x))


def lower_alnum(tokens: Column) -> Column:
    """Lower-case letter-and-digit tokens."""
    return F.transform(F.filter(tokens, lambda x: x.rlike(r"^[\p{L}\p{N}]+$")), F.lower)


def lower_words(tokens: Column) -> Column:
    """Lower-case tokens that start with a letter."""
    return F.transform(F.filter(tokens, starts_with_letter), F.lower)


def starts_with_letter(x: Column) -> Column:
    # most are told without a search
    return ((x >= "a") & (x < "{")) | x.rlike(r"^\p{L}")


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens that are none of the words; repeats stay."""
    return F.filter(tokens, lambda x: ~x.isin(words))


def matching_tokens(tokens: Column, words: list[str] = MATCH_STOP_WORDS) -> Column:
    """No stop words, and no single letter at the start of two or more tokens."""
    def stripped(kept: Column) -> Column:
        lone = (F.size(kept) >= 2) & F.get(kept, F.lit(0)).rlike(r"^\p{L}$")
        return F.when(lone, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)

    # the list is made once, as the only element of another
    return F.get(F.transform(F.array(without(tokens, words)), stripped), F.lit(0))


def is_subsequence(x: Column, y: Column) -> Column:
    """Whether the characters of x stand in y in this order."""
    # the place of every character behind the one before it; -1 from where there is none
    def step(at: Column, c: Column) -> Column:
        place = F.call_function("locate", c, y, at + 1)
        return F.when((at < 0) | (place == 0), -1).otherwise(place)

    return F.when(x == "", True).otherwise(F.aggregate(F.split(x, ""), F.lit(0), step) >= 0) & y.isNotNull()


def is_restricted_subsequence(x: Column, y: Column) -> Column:
    """As is_subsequence, scanned from left to right, but a vowel of x that is not its first character
    only counts where the character before it in y is the one before it in x too."""
    def step(i: Column, j: Column) -> Column:
        c, before = F.substring(x, i + 1, 1), F.substring(x, i, 1)
        apart = c.isin(*"aeiou") & (i > 0) & (j > 1) & (before != F.substring(y, j - 1, 1))
        return F.when((i < F.length(x)) & (c == F.substring(y, j, 1)) & ~apart, i + 1).otherwise(i)

    places = F.when(F.length(y) > 0, F.sequence(F.lit(1), F.length(y))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), step) == F.length(x)


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the text between ## and $$."""
    def grams(padded: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))

    # the text is made once, as the only element of an array, not for every place
    return F.get(F.transform(F.array(F.concat(F.lit("##"), text, F.lit("$$"))), grams), F.lit(0))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of (p, 1 - p)."""
    half = [F.when(q > 0, -q * F.log2(q)).otherwise(0.0) for q in (p, 1 - p)]
    return half[0] + half[1]


def long_hash(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts joined by |, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that only depends on the parts."""
    return long_hash(*parts) / F.lit(float(1 << 52))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one is null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) for v in (a, b)]
    return F.try_divide(dot, norm[0] * norm[1])
