"""Properties of the learning loop and of what an epoch computes again."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import feedback, learn
from termweave.operators.features import FEATURES, NORMALIZED, score_incremental, score_pairs


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        good = i % 7 == 0
        rows.append((i, i % 20, good, *[round(rng.random() * 0.4 + (0.6 if good else 0.0), 2) for _ in FEATURES]))
    schema = "name_id long, term_id long, label boolean, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_labels_keep_to_budget_and_truth(scored):
    truth = scored.select("name_id", "term_id", "label")
    seeds = learn.gold_seeds(truth, per_class=3)
    model, labels = learn.active_learning(scored, truth, seeds, rounds=4, draw=5)
    got = rows_of(labels.select("name_id", "term_id", "label"))
    assert len(got) == len({r[:2] for r in got}) == 6 + 4 * 5 and set(got) <= set(rows_of(truth)) and set(rows_of(seeds)) <= set(got)
    # the same again, and however the rows are dealt
    again, same = learn.active_learning(scored.repartition(5), truth, seeds, rounds=4, draw=5)
    assert rows_of(same.select("name_id", "term_id", "label")) == got
    found = learn.predict(model, learn.assembled(scored))
    right = found.join(truth, learn.PAIR).where(F.col("match") == F.col("label")).count()
    assert found.count() == 400 and right > 380


def test_loop_ends_when_few_are_left(scored):
    truth = scored.select("name_id", "term_id", "label")
    some = scored.where("name_id < 60")
    _, labels = learn.active_learning(some, truth, learn.gold_seeds(truth.where("name_id < 60"), per_class=3), rounds=70, draw=10, least=45)
    assert labels.count() == 6 + 10  # 54 are unlabelled at first, then 44


def test_seeds_beyond_the_pairs_stay_labels(spark, scored):
    truth = scored.select("name_id", "term_id", "label")
    seeds = learn.gold_seeds(truth, per_class=3).unionByName(spark.createDataFrame([(9999, 1, True)], "name_id long, term_id long, label boolean"))
    _, labels = learn.active_learning(scored, truth, seeds, rounds=1, draw=2)
    assert labels.count() == 7 + 2 and labels.where("name_id = 9999").count() == 1


def test_forest_and_predictions(scored):
    vectors = learn.assembled(scored)
    model = learn.fit_forest(vectors.join(scored.select(*learn.PAIR, "label"), learn.PAIR))
    found = learn.predict(model, vectors).collect()
    assert len(found) == 400 and all(0 <= r.p <= 1 and r.match == (r.p > 0.5) for r in found)
    assert model.getNumTrees == 10


def test_positive_seeds_equal_plain_rules(scored):
    def rule(r):
        return (
            (r.jaccard_coeff >= 0.55 and r.abbr_jaccard_coeff_no_stopwords >= 0.85 and r.smith_waterman_dist >= 39)
            or (min(r.jaccard_coeff, r.abbr_jaccard_coeff, r.abbr_jaccard_coeff_no_stopwords) >= 0.8 and r.smith_waterman_coeff >= 0.76)
            or (r.jaccard_coeff < r.normalized_3gram_jaccard_coeff and r.normalized_smith_waterman_coeff >= 0.8 and r.normalized_3gram_jaccard_coeff >= 0.83)
            or (r.rel_diff_num_tokens == 0 and (r.abbr_jaccard_coeff_no_stopwords <= 0.4 or r.affine_dist >= 34))
            or (r.rel_diff_num_tokens == 1 and r.smith_waterman_dist > 44)
            or (r.rel_diff_num_tokens == 2 and r.jaccard_coeff == 1.0)
        )

    rows = scored.withColumn("smith_waterman_dist", F.col("smith_waterman_dist") * 50).withColumn("rel_diff_num_tokens", F.col("name_id") % 3)
    want = sorted((r.name_id, r.term_id, True) for r in rows.collect() if rule(r))
    assert rows_of(learn.positive_seeds(rows)) == want and want


PAIRS = "name_id long, tokens array<string>, derived array<struct<text:string,score:double>>, term_id long, term_tokens array<string>"


def test_an_epoch_computes_only_changes(spark):
    old = [(i, ["CUST", "ADDR"], [(f"customer address {i}", 0.9)], 7, ["customer", "address"]) for i in range(6)]
    new = [(i, t, [("client address", 0.9)] if i in (2, 4) else d, k, w) for i, t, d, k, w in old]
    new[5] = (5, ["CUST", "ADDR"], [("customer address 5", 0.1)], 7, ["customer", "address"])  # a score is no change
    new += [(6, ["DOB"], [("date of birth", 0.5)], 8, ["date", "of", "birth"])]
    first = score_pairs(spark.createDataFrame(old, PAIRS).withColumn("derived_key", feedback.derived_key(F.col("derived"))))
    # wrong on purpose, so that what is computed again shows
    first = first.withColumns({c: F.lit(-5.0) for c in FEATURES})
    known = feedback.changes(spark.createDataFrame(new, PAIRS), first, FEATURES)
    assert {r.name_id for r in known.where("updated and overlap_coeff is not null").collect()} == {2, 4}
    assert {r.name_id for r in known.where("overlap_coeff is null").collect()} == {6}
    full = {r.name_id: r for r in score_pairs(spark.createDataFrame(new, PAIRS)).collect()}
    got = {r.name_id: r for r in score_incremental(known).collect()}
    for i in range(7):
        fresh = FEATURES if i == 6 else NORMALIZED if i in (2, 4) else []
        assert all(got[i][c] == (full[i][c] if c in fresh else -5.0) for c in FEATURES)
    assert {r.derived_key for r in score_incremental(known).collect()} == {r[0] for r in spark.createDataFrame(new, PAIRS).select(feedback.derived_key(F.col("derived"))).collect()}


def test_three_epochs(spark):
    from termweave.plans.fixtures import Tables
    from termweave.plans.jobs import epoch_loop

    t = Tables.of(spark, "/root/testdata/sf0.001")
    got = epoch_loop(t, epochs=3, rounds=1)
    assert {r[0] for r in got.select("score_eval").distinct().collect()} <= {"TP", "FP", "FN", "TN"}
    assert t.gold.join(got, ["name", "term"], "left_anti").count() == 0


def test_a_forest_carries_no_session(spark, scored):
    model = learn.fit_forest(learn.assembled(scored).join(scored.select(*learn.PAIR, "label"), learn.PAIR))
    made = spark._jvm.java.io.ByteArrayOutputStream()
    spark._jvm.java.io.ObjectOutputStream(made).writeObject(model._java_obj)
    assert not model.hasSummary and b"SparkSession" not in bytes(made.toByteArray())
