"""Normalising names: noisy tokens and their expansions from a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS, is_restricted_subsequence, starts_with_letter
from ..session import few, shared_dir


def domain_words(corpus: DataFrame) -> DataFrame:
    """Distinct lower-case words of a corpus (column text)."""
    words = corpus.select(F.explode(F.split("text", r"[/. ,&()_-]")).alias("word"))
    return words.select(F.lower("word").alias("word")).where("word <> ''").distinct()


def classified_tokens(
    names: DataFrame, lexicon: DataFrame, words: DataFrame, stop: list[str] = STOP_WORDS, lemmas: DataFrame | None = None
) -> DataFrame:
    """(name_id, name, pos, token, english): a token is English if its lower-case form, or a lemma of
    it by the optional table lemmas (form, lemma), is in the lexicon and it is longer than 3, a word
    of the domain or a stop word."""
    if lemmas is not None:
        inflected = lemmas.join(lexicon.select(F.col("form").alias("lemma")), "lemma", "left_semi")
        lexicon = lexicon.select("form").unionByName(inflected.select("form"))
    shared_dir(names.sparkSession)
    # the English forms are judged before they meet the tokens, which then stay beside their name
    known, alone = lexicon.select("form").distinct(), (F.length("form") > 3) | F.col("form").isin(stop)
    domain = words.where(F.length("word") <= 3).select(F.col("word").alias("form"))
    english = known.where(alone).unionByName(known.where(~alone).join(domain, "form", "left_semi")).checkpoint()
    tokens = names.select("name_id", "name", F.posexplode("tokens").alias("pos", "token")).where("token is not null")
    met = tokens.join(few(english), F.lower("token") == F.col("form"), "left")
    return met.select("name_id", "name", "pos", "token", F.col("form").isNotNull().alias("english"))


def noisy_tokens(classified: DataFrame) -> DataFrame:
    """(name_id, name, english_tokens, noisy_tokens): a noisy token's place holds _ in the first."""
    shown = F.when(F.col("english"), F.col("token")).otherwise("_")
    packed = classified.groupBy("name_id", "name").agg(
        F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"), "token", "english"))).alias("t")
    )
    noisy = F.filter("t", lambda x: ~x["english"])
    return packed.select(
        "name_id", "name", F.transform("t", lambda x: x["shown"]).alias("english_tokens"),
        F.transform(noisy, lambda x: x["token"]).alias("noisy_tokens"),
    )


def noisy_vocabulary(classified: DataFrame) -> DataFrame:
    """Distinct lower-case noisy tokens that start with a letter."""
    noisy = classified.where(~F.col("english") & starts_with_letter(F.col("token")))
    return noisy.select(F.lower("token").alias("token")).distinct()


def longest_phrase(vocabulary: DataFrame) -> int:
    """Most words that a phrase for one of the tokens can have."""
    size = F.length("token")
    alphabetic = vocabulary.where(F.col("token").rlike(r"^\p{L}+$"))
    return alphabetic.agg(F.max(F.least(size + 5, size * 2))).first()[0] or 0


def phrase_windows(corpus: DataFrame, vocabulary: DataFrame, max_words: int, stop: list[str] = STOP_WORDS) -> DataFrame:
    """Distinct word windows that can be long forms: they start with a noisy token's first letter
    and with no stop word, end with no stop word, and have at most max_words words."""
    letters = vocabulary.select(F.substring("token", 1, 1).alias("letter")).distinct()
    segment = corpus.select(F.explode(F.split("text", r"[.,;:()=*&]")).alias("s"))
    words = segment.select(F.filter(F.split(F.lower("s"), " "), lambda x: x != "").alias("words"))
    # windows are made within the row, so that only they are multiplied and not the words beside them
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: ~F.element_at("words", i).isin(stop))

    def windows(i: Column) -> Column:
        ends = F.sequence(i, F.least(i + F.lit(max_words - 1), F.size("words")))
        ends = F.filter(ends, lambda j: ~F.element_at("words", j).isin(stop))
        return F.transform(ends, lambda j: F.array_join(F.slice("words", i, j - i + 1), " "))

    made = words.where((F.lit(max_words) > 0) & (F.size("words") > 0))
    phrases = made.select(F.explode(F.flatten(F.transform(places, windows))).alias("phrase"))
    return phrases.join(letters, F.substring("phrase", 1, 1) == F.col("letter"), "left_semi").distinct()


#: Tokens and words that meet in one group of expand_single_word, about.
GROUP_TOKENS, GROUP_WORDS = 10_000, 20_000
#: Rows of a batch that such a group hands on.
EXPANSIONS = 50_000


def _containing(tokens: list[str], words: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Every token with the places of the longer words that begin with its first character and contain it
    as a subsequence. Tokens are taken in their order, and what two of them begin with is looked
    for once: for every word that has it, the place where it ends first."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    order = np.argsort(codes, kind="stable")
    values, first = np.unique(codes[order], return_index=True)
    places = dict(zip(map(chr, values.tolist()), np.split(order, first[1:]), strict=True)) if len(values) else {}
    none = np.empty(0, np.int64)
    path: list[tuple[np.ndarray, np.ndarray]] = []  # words and ends, for every beginning of the last token
    last = ""
    for token in sorted(tokens):
        same = 0
        while same < min(len(last), len(token)) and last[same] == token[same]:
            same += 1
        del path[same:]
        for c in token[same:]:
            at = places.get(c, none)
            if not path:
                start = end - size
                rows = np.flatnonzero(np.isin(start, at) & (size > 0))
                path.append((rows, start[rows]))
                continue
            rows, ends = path[-1]
            following = np.searchsorted(at, ends, "right")
            there = following < len(at)
            rows, following = rows[there], at[following[there]]
            inside = following < end[rows]
            path.append((rows[inside], following[inside]))
        last = token
        rows = path[-1][0]
        yield token, rows[size[rows] > len(token)]


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, expansion) of the tokens and words of a group."""
    sides: tuple[list[str], list[str]] = ([], [])
    for batch in batches:
        for text, is_word in zip(batch.column("text").to_pylist(), batch.column("is_word").to_pylist(), strict=True):
            sides[is_word].append(text)
    tokens, words = sides
    listed, found, n = pa.array(words, pa.string()), [], 0

    def made() -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(found)), [len(rows) for _, rows in found]))
        token = pa.array([token for token, _ in found], pa.string()).take(at)
        expansion = listed.take(pa.array(np.concatenate([rows for _, rows in found])))
        return pa.RecordBatch.from_arrays([token, expansion], names=["token", "expansion"])

    for token, rows in _containing(tokens, words):
        if len(rows):
            found.append((token, rows))
            n += len(rows)
        if n >= EXPANSIONS:
            yield made()
            found, n = [], 0
    if found:
        yield made()


def expand_single_word(vocabulary: DataFrame, words: DataFrame, mode: str = "plain") -> DataFrame:
    """(token, expansion): longer domain words with the token's first letter that contain it as a
    subsequence (mode "restricted": see is_restricted_subsequence).

    Tokens and words of a first letter are dealt into groups of bounded size, by a hash of the token's first
    three characters and of the word, so that every token and word meet in one of them. A group
    looks for what its tokens begin with once, so its work follows the pairs there are.
    """
    sides = vocabulary.where("token <> ''").select(F.col("token").alias("text")).distinct(), words.where("word <> ''").select(F.col("word").alias("text")).distinct()
    letter = F.substring("text", 1, 1).alias("letter")
    counts = [
        df.groupBy(letter).agg(F.ceil(F.count("*") / size).alias(n))
        for df, size, n in zip(sides, (GROUP_TOKENS, GROUP_WORDS), ("_nt", "_nw"), strict=True)
    ]
    groups = F.broadcast(counts[0].join(counts[1], "letter"))
    zero = F.lit(0).cast("long")

    def dealt(df: DataFrame, key: Column, own: str, n: str, other: str, m: str, is_word: bool) -> DataFrame:
        rows = df.select("text", letter).join(groups, "letter").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)))
        rows = rows.withColumn(other, F.explode(F.sequence(zero, F.col(m) - 1)))
        return rows.select("letter", "_t", "_w", "text", F.lit(is_word).alias("is_word"))

    tokens = dealt(sides[0], F.substring("text", 1, 3), "_t", "_nt", "_w", "_nw", False)
    both = tokens.unionByName(dealt(sides[1], F.col("text"), "_w", "_nw", "_t", "_nt", True))
    found = both.groupBy("letter", "_t", "_w").applyInArrow(_expanded, "token string, expansion string")
    return found.where(is_restricted_subsequence(F.col("token"), F.col("expansion"))) if mode == "restricted" else found


def expand_acronym(vocabulary: DataFrame, phrases: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(token, expansion): phrases whose words' initials spell the token, stop words optional.

    Tokens and phrases meet in an equi-join on initials: a phrase has one string for every way to
    skip stop words, cut at the longest token. The walk over the words then decides exactly: a
    word whose initial is the next character takes it, another must be a stop word, and no word
    may follow the last character.
    """
    longest = vocabulary.agg(F.max(F.length("token"))).first()[0] or 0
    first = F.expr("transform(split(phrase, ' '), x -> struct(substring(x, 1, 1) as c, x as w))")
    listed = phrases.select("phrase", first.alias("ws")).where(F.size(F.filter("ws", lambda x: ~x["w"].isin(stop))) <= longest)
    initials = F.aggregate(
        "ws", F.array(F.lit("")),
        lambda acc, x: F.array_distinct(F.filter(
            F.when(x["w"].isin(stop), F.concat(F.transform(acc, lambda a: F.concat(a, x["c"])), acc))
            .otherwise(F.transform(acc, lambda a: F.concat(a, x["c"]))),
            lambda a: F.length(a) <= longest,
        )),
    )
    keyed = listed.select("phrase", "ws", F.explode(initials).alias("token")).where("token <> ''")
    met = keyed.join(vocabulary.select("token"), "token")
    check = F.expr(
        "aggregate(ws, struct(0 as k, true as ok), (s, x) -> struct("
        " s.k + cast(s.k < length(token) and x.c = substring(token, s.k + 1, 1) as int) as k,"
        " s.ok and s.k < length(token) and (x.c = substring(token, s.k + 1, 1)"
        "   or array_contains(array(" + ", ".join('"' + w + '"' for w in stop) + "), x.w)) as ok))"
    )
    valid = met.where(F.length("token") < F.length("phrase")).withColumn("end", check)
    return valid.where(F.col("end.ok") & (F.col("end.k") == F.length("token"))).select("token", F.col("phrase").alias("expansion")).distinct()
