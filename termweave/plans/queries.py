"""The registered queries of the matching engine, one for each operator of the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import lower_words, matching_tokens, tokenize, unit_hash
from ..operators import block, context, derive, evaluate, expand, features, feedback, learn
from ..session import shared_dir
from ..sources import catalog, runs
from .fixtures import Tables
from .jobs import epoch_loop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables.of(spark, sf_dir))
    return f


def scratch(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}"


def text_of(column: str, sep: str = " ") -> F.Column:
    return F.array_join(column, sep)


# sources and sinks


def _csv(t: Tables, df: DataFrame) -> DataFrame:
    """df, written as CSV and read again with an all-string schema."""
    path = scratch(t)
    catalog.sink_csv(df, path)
    return catalog.scan_csv(t.spark, path, df.columns)


@query
def scan_gold(t: Tables) -> DataFrame:
    parts = t.read("part").select(F.col("p_brand").alias("names"), F.when(F.col("p_size") > 3, F.concat_ws(" ", "p_name", "p_type")).alias("terms"))
    return catalog.scan_gold(_csv(t, parts), "names", "terms")


@query
def scan_names(t: Tables) -> DataFrame:
    rows = catalog.scan_names(_csv(t, t.large.select(F.col("name").alias("names"))), "names")
    return rows.select("name_id", "name", text_of("tokens").alias("tokens"))


@query
def scan_terms(t: Tables) -> DataFrame:
    rows = _csv(t, t.large.select(F.col("seg_id").cast("string").alias("id"), F.col("term").alias("terms")))
    return catalog.scan_terms(rows, "terms", F.col("id").cast("long")).select("term_id", "term", text_of("tokens").alias("tokens"))


def _relations(t: Tables) -> DataFrame:
    parts = t.read("part").select(F.upper("p_type").alias("schema_name"), F.upper(F.translate("p_brand", "#", "")).alias("table_name"), F.upper(F.translate("p_name", " ", "_")).alias("column_name"))
    return parts.distinct()


@query
def format_relation_text(t: Tables) -> DataFrame:
    return catalog.format_relation_text(_relations(t))


@query
def scan_relation_text(t: Tables) -> DataFrame:
    path = scratch(t)
    catalog.format_relation_text(_relations(t)).write.text(path)
    return catalog.scan_relation_text(t.spark.read.text(path))


@query
def scan_term_text(t: Tables) -> DataFrame:
    path = scratch(t)
    t.large.select("term").write.text(path)
    return catalog.scan_term_text(t.spark.read.text(path))


def _described(t: Tables) -> DataFrame:
    """Columns, some with a term."""
    named = F.when(F.col("p_size") > 3, F.concat_ws(" ", "p_name", "p_type"))
    return t.read("part").select(F.upper("p_name").alias("column_name"), named.alias("business_term"))


@query
def format_term_text(t: Tables) -> DataFrame:
    return catalog.format_term_text(_described(t), "business_term")


@query
def scan_relation_file(t: Tables) -> DataFrame:
    path = scratch(t)
    catalog.write_lines(catalog.format_relation_text(_relations(t)), path, "RELATIONS")
    return catalog.scan_relation_file(t.spark, path)


@query
def scan_term_file(t: Tables) -> DataFrame:
    path = scratch(t)
    catalog.write_lines(t.large.select(F.col("term").alias("value")), path, "TERMS")
    return catalog.scan_term_file(t.spark, path)


@query
def sink_csv(t: Tables) -> DataFrame:
    return _csv(t, t.names.select("name", "tokens"))


@query
def load_vectors(t: Tables) -> DataFrame:
    return t.vectors.select("word", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


@query
def load_vector_text(t: Tables) -> DataFrame:
    path = scratch(t)
    t.vectors.select(F.concat_ws(" ", "word", F.array_join(F.col("vector").cast("array<string>"), " ")).alias("value")).write.text(path)
    head = t.spark.range(1).select(F.lit("1000 64").alias("value"))
    rows = catalog.load_vector_text(t.spark.read.text(path).unionByName(head))
    return rows.select("word", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


# tokens and expansions


@query
def tokenize_names(t: Tables) -> DataFrame:
    part = t.read("part")
    w = F.split("p_name", " ")
    camel = part.select(F.concat(w[0], F.initcap(w[1]), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.upper(F.substring("p_type", 1, 2)), w[0]).alias("name"))
    brand = part.select(F.concat_ws("_", "p_brand", "p_type").alias("name"))
    names = camel.union(brand).union(t.large.select("name")).distinct()
    return names.select("name", F.array_join(tokenize(F.col("name")), " ").alias("tokens"))


@query
def domain_words(t: Tables) -> DataFrame:
    return expand.domain_words(t.spread("documents"))


@query
def phrase_windows(t: Tables) -> DataFrame:
    return t.phrases


@query
def context_tokens(t: Tables) -> DataFrame:
    names = catalog.scan_names(t.large, "name")
    rows = names.select("name", lower_words(F.col("tokens")).alias("words"))
    return rows.select("name", text_of("words").alias("context"), F.array_join(matching_tokens(F.col("words")), " ").alias("matching"))


@query
def noisy_tokens(t: Tables) -> DataFrame:
    rows = expand.noisy_tokens(t.classified)
    return rows.select("name", text_of("english_tokens").alias("english_tokens"), text_of("noisy_tokens").alias("noisy_tokens"))


@query
def expand_single_word(t: Tables) -> DataFrame:
    return t.single


@query
def noisy_documents(t: Tables) -> DataFrame:
    rows = expand.noisy_tokens(t.large_classified)
    return rows.select("name", text_of("english_tokens").alias("english_tokens"), text_of("noisy_tokens").alias("noisy_tokens"))


@query
def expand_documents(t: Tables) -> DataFrame:
    """Every noisy token of the documents' names with all words of the documents that it can stand for."""
    return expand.expand_single_word(expand.noisy_vocabulary(t.large_classified), t.large_words)


@query
def expand_restricted(t: Tables) -> DataFrame:
    return expand.expand_single_word(t.vocabulary, t.words, mode="restricted")


@query
def lemma_tokens(t: Tables) -> DataFrame:
    """Tokens of all documents' terms against a lexicon without plurals, whose lemmas are a table."""
    names = t.kept(catalog.scan_names(t.large.select(F.translate("term", " ", "_").alias("name")), "name"))
    words = t.read("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("form")).distinct()
    tokens = names.select(F.explode("tokens").alias("form")).distinct()
    plural = tokens.where("form like '%s' and length(form) > 2").select("form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))
    domain = expand.domain_words(t.gold.select(F.col("term").alias("text")))
    rows = expand.classified_tokens(names, words.where("form not like '%s'"), domain, lemmas=plural)
    return rows.select("name", "pos", "token", "english")


@query
def expand_acronym(t: Tables) -> DataFrame:
    initials = t.read("benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z ]+")).alias("s"))
    words = initials.select(F.filter(F.split("s", " "), lambda x: x != "").alias("w")).where(F.size("w") >= 3)
    made = words.select(F.array_join(F.transform(F.slice("w", 1, 3), lambda x: F.substring(x, 1, 1)), "").alias("token"))
    vocabulary = t.kept(t.vocabulary.union(made).distinct())
    phrases = expand.phrase_windows(t.cells, vocabulary, expand.longest_phrase(vocabulary))
    return expand.expand_acronym(vocabulary, phrases)


@query
def noisy_token_histogram(t: Tables) -> DataFrame:
    noisy = t.classified.where("not english").groupBy("token").agg(F.count("*").alias("n"))
    return noisy.orderBy(F.desc("n"), "token").limit(100)


# contexts, ranking, derived strings


@query
def candidate_context(t: Tables) -> DataFrame:
    return t.contexts.select("expansion", "cell_id", text_of("window").alias("window"))


@query
def name_context_vector(t: Tables) -> DataFrame:
    return t.name_vectors.select("name_id", F.posexplode("vector").alias("dim", "x")).select("name_id", "dim", F.round("x", 6).alias("x"))


@query
def expansion_vector(t: Tables) -> DataFrame:
    return t.expansion_vectors.select("expansion", F.posexplode("vector").alias("dim", "x")).select("expansion", "dim", F.round("x", 6).alias("x"))


@query
def rank_expansions(t: Tables) -> DataFrame:
    return t.ranked.select("name_id", "pos", "expansion", F.round("score", 6).alias("score"), "rank")


@query
def combined_candidates(t: Tables) -> DataFrame:
    return t.combined.select("name_id", "pos", "expansion", F.round("score", 6).alias("score"), "rank")


@query
def derived_strings(t: Tables) -> DataFrame:
    rows = t.derived.select("name_id", F.posexplode("derived").alias("i", "d"))
    return rows.select("name_id", "i", "d.text", F.round("d.score", 6).alias("score"))


@query
def dedup_derived(t: Tables) -> DataFrame:
    return derive.dedup_derived(t.derived).select("name_id", "text", F.round("score", 6).alias("score"))


# blocking


@query
def index_token_filter(t: Tables) -> DataFrame:
    return block.index_tokens(catalog.scan_terms(t.large_terms, "term"), once=True)


@query
def df_cap(t: Tables) -> DataFrame:
    return block.capped_tokens(block.index_tokens(catalog.scan_terms(t.large_terms, "term"), once=True))


@query
def inverted_index(t: Tables) -> DataFrame:
    """The posting lists of all documents' terms, a row each posting."""
    lists = block.inverted_index(block.own_tokens(catalog.scan_terms(t.large_terms, "term")))
    return lists.select("token", F.explode("terms").alias("term"), "df")


@query
def block_candidates(t: Tables) -> DataFrame:
    return t.candidates


@query
def block_documents(t: Tables) -> DataFrame:
    """Blocking of names from the benchmark, each with its own term as derived string, against the
    terms of all documents."""
    return block.block_candidates(t.asked_names.select("name_id", "name", "derived"), catalog.scan_terms(t.large, "term", F.col("seg_id")))


@query
def blocking_stats(t: Tables) -> DataFrame:
    rows = block.blocking_stats(t.candidates, t.gold, t.names.count(), t.terms.count())
    return rows.select("pairs", F.round("ratio", 9).alias("ratio"), F.round("recall", 9).alias("recall"))


@query
def label_from_gold(t: Tables) -> DataFrame:
    return t.labelled.select("name", "term", "label")


@query
def blocking_documents(t: Tables) -> DataFrame:
    rows = block.blocking_stats(t.asked_grams, t.asked_gold, t.asked.count(), t.all_terms.count())
    return rows.select("pairs", F.round("ratio", 9).alias("ratio"), F.round("recall", 9).alias("recall"))


@query
def label_documents(t: Tables) -> DataFrame:
    return t.asked_labelled.select("name_id", "term", "label")


# features


@query
def pair_ngrams(t: Tables) -> DataFrame:
    return t.grams.select("name", "term", "p")


@query
def score_pairs(t: Tables) -> DataFrame:
    return t.features.select("name", "term", *[F.round(c, 6).alias(c) for c in features.FEATURES])


@query
def gram_documents(t: Tables) -> DataFrame:
    return t.asked_grams.select("name_id", "term", "p")


@query
def score_documents(t: Tables) -> DataFrame:
    """All features of the pairs that blocking finds in the documents."""
    rows = features.score_pairs(t.asked_pairs)
    return rows.select("name_id", "term", *[F.round(c, 6).alias(c) for c in features.FEATURES])


@query
def score_incremental(t: Tables) -> DataFrame:
    """A later round: a third of the pairs is new, another third's derived strings changed."""
    third = F.pmod(F.col("term_id") + F.col("name_id"), F.lit(3))
    seen = [F.when(third != 0, F.col(c)).alias(c) for c in features.FEATURES]
    rows = t.features.select(*[c for c in t.features.columns if c not in features.FEATURES], *seen, (third == 1).alias("updated"))
    return features.score_incremental(rows).select("name", "term", *[F.round(c, 6).alias(c) for c in features.FEATURES])


# learning


@query
def positive_seeds(t: Tables) -> DataFrame:
    return learn.positive_seeds(t.features)


@query
def negative_seeds(t: Tables) -> DataFrame:
    positives = t.grams.where("p >= 0.8").select("name_id", "term_id")
    return learn.negative_seeds(t.grams, positives, positives.count())


@query
def gold_seeds(t: Tables) -> DataFrame:
    return learn.gold_seeds(t.grams)


@query
def uncertain_pairs(t: Tables) -> DataFrame:
    return learn.uncertain_pairs(t.grams).select("name_id", "term_id", F.round("entropy", 6).alias("entropy"))


@query
def uncertain_documents(t: Tables) -> DataFrame:
    return learn.uncertain_pairs(t.asked_labelled).select("name_id", "term_id", F.round("entropy", 6).alias("entropy"))


@query
def seeds_documents(t: Tables) -> DataFrame:
    """As many pairs that are no match as there are pairs alike by their 3-grams."""
    alike = t.asked_labelled.where("p >= 0.8").select("name_id", "term_id")
    return learn.negative_seeds(t.asked_labelled, alike, alike.count())


@query
def fit_predict(t: Tables) -> DataFrame:
    vectors = t.kept(learn.assembled(t.features))
    truth = t.features.select("name_id", "term_id", "label")
    half = truth.where(unit_hash(F.lit("half"), "name_id", "term_id") < 0.5)
    model = learn.fit_forest(vectors.join(half, learn.PAIR))
    return learn.predict(model, vectors).join(truth, learn.PAIR).select("name_id", "term_id", "match", "label")


@query
def active_learning(t: Tables) -> DataFrame:
    truth = t.features.select("name_id", "term_id", "label")
    model, labels = learn.active_learning(t.features, truth, learn.gold_seeds(truth))
    found = learn.predict(model, learn.assembled(t.features))
    return evaluate.apply_labels(found, labels).select("name_id", "term_id", "match")


@query
def apply_labels(t: Tables) -> DataFrame:
    found = t.grams.select("name_id", "term_id", (F.col("p") > 0.5).alias("match"))
    return evaluate.apply_labels(found, learn.gold_seeds(t.grams))


def _matches(t: Tables) -> DataFrame:
    return t.grams.select("name_id", "name", "term_id", "term", (F.col("p") > 0.5).alias("match"))


@query
def eval_outer(t: Tables) -> DataFrame:
    return evaluate.eval_outer(_matches(t).where("match"), t.gold)


@query
def precision_recall(t: Tables) -> DataFrame:
    rows = evaluate.precision_recall(_matches(t).where("match"), t.gold)
    return rows.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def score_eval(t: Tables) -> DataFrame:
    return evaluate.score_eval(_matches(t), t.gold).select("name", "term", "score_eval")


@query
def match_report(t: Tables) -> DataFrame:
    rows = evaluate.match_report(_matches(t), t.gold)
    return rows.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def review_pairs(t: Tables) -> DataFrame:
    return evaluate.review_pairs(t.grams, "p", 0.3).select("name", "term", "p")


@query
def review_gold_pairs(t: Tables) -> DataFrame:
    return evaluate.review_pairs(t.grams, "p", 0.3, gold=True).select("name", "term", "p")


@query
def match_documents(t: Tables) -> DataFrame:
    """Precision and recall where a name from the benchmark matches the documents' terms by 3-grams."""
    found = t.asked_grams.select("name", "term", (F.col("p") > 0.5).alias("match"))
    rows = evaluate.match_report(found, t.asked_gold)
    return rows.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def eval_documents(t: Tables) -> DataFrame:
    found = t.asked_labelled.select("name", "term", (F.col("p") > 0.5).alias("match")).distinct()
    return evaluate.score_eval(found, t.asked_gold).select("name", "term", "score_eval")


@query
def training_report(t: Tables) -> DataFrame:
    return evaluate.training_report(learn.gold_seeds(t.grams), t.grams)


@query
def training_summary(t: Tables) -> DataFrame:
    return evaluate.training_summary(learn.gold_seeds(t.grams), t.names, t.terms, t.gold)


# the outputs of a run, as they are read again


@query
def run_blocking(t: Tables) -> DataFrame:
    return runs.read_run(t.spark, t.run_folder, "blocking").select("name_id", "name", "term_id", "term")


@query
def run_training_labels(t: Tables) -> DataFrame:
    return runs.read_run(t.spark, t.run_folder, "training_labels").select("name", "term", "p", "match", "label")


@query
def run_matches(t: Tables) -> DataFrame:
    return runs.read_run(t.spark, t.run_folder, "matches").select("name", "term", "p", "match")


@query
def run_score_eval(t: Tables) -> DataFrame:
    return runs.read_run(t.spark, t.run_folder, "score_eval").select("name", "term", "match", "score_eval")


@query
def run_names(t: Tables) -> DataFrame:
    return runs.read_run(t.spark, t.run_folder, "names")


@query
def run_manifest(t: Tables) -> DataFrame:
    return runs.read_manifest(t.spark, t.run_folder).select("name", "rows")


# feedback


@query
def rewrite_rules(t: Tables) -> DataFrame:
    return feedback.rewrite_rules(t.uses).select("token", "expansion", F.round("score", 6).alias("score"), "rank")


@query
def expansion_dictionary(t: Tables) -> DataFrame:
    return feedback.expansion_dictionary(t.uses)[0]


@query
def overall_dictionary(t: Tables) -> DataFrame:
    return feedback.expansion_dictionary(t.uses)[1]


@query
def windows_dictionary(t: Tables) -> DataFrame:
    """The names' own dictionary where alignments score their windows, not the words in them."""
    pairs = t.gold.join(t.names.select("name", "tokens"), "name").join(t.terms.select("term", F.col("tokens").alias("term_tokens")), "term")
    return feedback.expansion_dictionary(feedback.abbreviation_uses(pairs, scoring="windows"))[0]


@query
def rules_documents(t: Tables) -> DataFrame:
    """Rewrite rules from the abbreviations in all terms of the documents."""
    return feedback.rewrite_rules(t.large_uses).select("token", "expansion", F.round("score", 6).alias("score"), "rank")


@query
def dictionary_documents(t: Tables) -> DataFrame:
    return feedback.overall_entries(t.large_uses)


def _some_dictionary(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Entries of a third of the names, and the overall ones."""
    local, overall = feedback.expansion_dictionary(t.kept(t.uses))
    return local.where(unit_hash(F.lit("own"), "name") < 1 / 3), overall


@query
def boosted_rerank(t: Tables) -> DataFrame:
    tokens = t.classified.where("not english").select("name_id", "name", "pos", F.lower("token").alias("token"))
    rows = t.ranked.join(tokens, ["name_id", "pos"]).select("name", "pos", "token", "expansion", "score")
    out = feedback.boosted_rerank(rows, *_some_dictionary(t))
    return out.select("name", "pos", "expansion", F.round("score", 6).alias("score"), "rank")


@query
def merge_derived(t: Tables) -> DataFrame:
    names = t.names.join(t.derived, "name_id")
    out = feedback.merge_derived(names, *_some_dictionary(t)).select("name_id", "updated", F.posexplode("derived").alias("i", "d"))
    return out.select("name_id", "updated", "i", "d.text", F.round("d.score", 6).alias("score"))


@query
def revise_rules(t: Tables) -> DataFrame:
    out = feedback.revise_rules(t.classified, t.combined, t.derived, feedback.rewrite_rules(t.uses))
    rows = out.select("name_id", "updated", F.posexplode("derived").alias("i", "d"))
    return rows.select("name_id", "updated", "i", "d.text", F.round("d.score", 6).alias("score"))


@query
def past_examples(t: Tables) -> DataFrame:
    now = t.candidates.where(unit_hash(F.lit("now"), "name_id", "term_id") < 0.5)
    return feedback.past_examples(learn.gold_seeds(t.grams), now, t.names, t.terms).select("name", "term")


@query
def refresh_derived(t: Tables) -> DataFrame:
    first = t.derived.select("name_id", F.slice("derived", 1, 1).alias("derived"), F.lit(True).alias("updated"))
    rows = feedback.refresh_derived(t.candidates.withColumn("derived", F.lit(None)), first)
    return rows.select("name", "term", F.array_join(F.transform("derived", lambda d: d["text"]), "|").alias("derived"), "updated")


@query
def reuse_features(t: Tables) -> DataFrame:
    before = t.grams.where(unit_hash(F.lit("now"), "name_id", "term_id") < 0.5)
    return feedback.reuse_features(t.candidates, before, ["p"]).select("name", "term", "p")


@query
def feedback_round(t: Tables) -> DataFrame:
    """Rules from the matched pairs, and the derived strings that they change."""
    matched = t.pairs.join(_matches(t).where("match").select("name_id", "term_id"), ["name_id", "term_id"], "left_semi")
    rules = feedback.rewrite_rules(feedback.abbreviation_uses(matched))
    return feedback.revise_rules(t.classified, t.combined, t.derived, rules).select("name_id", "updated", F.size("derived").alias("n"))


@query
def match_epochs(t: Tables) -> DataFrame:
    """Three epochs of block, match and feed back, of few rounds each (active_learning runs all 70)."""
    return epoch_loop(t, epochs=3, rounds=4).select("name", "term", "match", "score_eval")
