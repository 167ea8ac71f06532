"""The whole job: normalise, then block, match and feed back in epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import block, evaluate, features, feedback, learn
from .fixtures import Tables


def flagship(t: Tables) -> DataFrame:
    """Candidates whose name and term tokens overlap by half or more, with their evaluation."""
    matches = t.features.select("name", "term", (F.col("overlap_coeff") >= 0.5).alias("match"))
    return evaluate.score_eval(matches, t.gold)


def epoch_loop(t: Tables, epochs: int = 3, rounds: int = 70, least: int = 10) -> DataFrame:
    """(name, term, match, score_eval) after the last epoch.

    The first epoch blocks and matches from seeds. The second blocks again with the derived
    strings that the matches' rewrite rules give, and keeps labelled pairs that dropped out; later ones
    keep the candidates and take the new strings. From the second on all features of new pairs are
    computed, the normalised ones of pairs whose name's strings changed, and no others. The loop ends
    when fewer than ``least`` pairs are unlabelled.
    """
    names, terms = t.names, t.terms.select("term_id", F.col("tokens").alias("term_tokens"))
    derived, candidates, scored, labels, matches = t.derived, t.candidates, None, None, None
    for epoch in range(epochs):
        if epoch == 1:
            fresh = block.block_candidates(names.select("name_id", "name").join(derived, "name_id"), t.terms)
            candidates = t.kept(feedback.past_examples(labels, fresh, names, t.terms))
        current = feedback.refresh_derived(candidates, derived.withColumn("updated", F.lit(None)))
        pairs = evaluate.label_from_gold(current, t.gold).join(names.select("name_id", "tokens"), "name_id").join(terms, "term_id")
        if scored is None:
            made = features.score_pairs(pairs.withColumn("derived_key", feedback.derived_key(F.col("derived"))))
        else:
            made = features.score_incremental(feedback.changes(pairs, scored, features.FEATURES))
        scored = t.kept(made)
        labels = learn.gold_seeds(scored) if labels is None else labels
        truth = scored.select("name_id", "term_id", "label")
        model, labels = learn.active_learning(scored, truth, labels, rounds)
        found = evaluate.apply_labels(learn.predict(model, learn.assembled(scored)), labels)
        matches = t.kept(found.join(scored.select("name_id", "term_id", "name", "term", "tokens", "term_tokens"), ["name_id", "term_id"]))
        if scored.join(labels, learn.PAIR, "left_anti").limit(least).count() < least:
            break
        if epoch + 1 < epochs:
            rules = feedback.rewrite_rules(feedback.abbreviation_uses(matches.where("match")))
            revised = t.kept(feedback.revise_rules(t.classified, t.combined, derived, rules))
            derived = revised.select("name_id", "derived")
    return evaluate.score_eval(matches, t.gold)
