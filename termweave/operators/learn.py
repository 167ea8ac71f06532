"""Seeds, uncertainty sampling and the random forest of the matching stage."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import binary_entropy, unit_hash
from ..session import shared_dir
from .features import FEATURES

PAIR = ["name_id", "term_id"]


def positive_seeds(features: DataFrame) -> DataFrame:
    """Pairs that one of six fixed threshold rules calls a match."""
    rules = """
    (jaccard_coeff >= 0.55 and abbr_jaccard_coeff_no_stopwords >= 0.85 and smith_waterman_dist >= 39)
    or (jaccard_coeff >= 0.8 and abbr_jaccard_coeff >= 0.8 and abbr_jaccard_coeff_no_stopwords >= 0.8
        and smith_waterman_coeff >= 0.76)
    or (jaccard_coeff < normalized_3gram_jaccard_coeff and normalized_smith_waterman_coeff >= 0.8
        and normalized_3gram_jaccard_coeff >= 0.83)
    or (rel_diff_num_tokens = 0 and (abbr_jaccard_coeff_no_stopwords <= 0.4 or affine_dist >= 34))
    or (rel_diff_num_tokens = 1 and smith_waterman_dist > 44)
    or (rel_diff_num_tokens = 2 and jaccard_coeff = 1.0)"""
    return features.where(rules).select(*PAIR, F.lit(True).alias("label")).distinct()


def negative_seeds(features: DataFrame, positives: DataFrame, n: int, seed: str = "negative") -> DataFrame:
    """n pairs that are no positive seed, in the order of a hash."""
    rest = features.select(*PAIR).distinct().join(positives, PAIR, "left_anti")
    return rest.orderBy(unit_hash(F.lit(seed), *PAIR), *PAIR).limit(n).select(*PAIR, F.lit(False).alias("label"))


def gold_seeds(labelled: DataFrame, per_class: int = 5, seed: str = "gold") -> DataFrame:
    """per_class pairs of each label, in the order of a hash."""
    order = Window.partitionBy("label").orderBy(unit_hash(F.lit(seed), *PAIR), *PAIR)
    ranked = labelled.select(*PAIR, "label").withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") <= per_class).select(*PAIR, "label")


def uncertain_pairs(scored: DataFrame, top: int = 100, draw: int = 10, seed: str = "round", carry: tuple[str, ...] = ()) -> DataFrame:
    """Of the ``top`` pairs with the highest entropy of p, ``draw`` without replacement, weighted by
    entropy (exponential keys from a hash); those without any entropy come last."""
    with_entropy = scored.select(*PAIR, *carry, "p", binary_entropy(F.col("p")).alias("entropy"))
    first = with_entropy.orderBy(F.desc(F.round("entropy", 9)), *PAIR).limit(top)
    u = F.greatest(unit_hash(F.lit(seed), *PAIR), F.lit(1e-16))
    key = F.when(F.col("entropy") > 0, -F.log(u) / F.col("entropy"))
    return first.withColumn("key", key).orderBy(F.asc_nulls_last("key"), *PAIR).limit(draw).select(*PAIR, "entropy", *carry)


def fit_forest(train: DataFrame, seed: int = 7):
    """A forest of 10 trees over rows with features (vector) and label (boolean).

    The copy has no training summary. A summary holds the session, which every task of a prediction would
    then carry, and which can't be serialised once other queries have used certain parts of it.
    """
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="y", numTrees=10, maxDepth=30, maxBins=256, minInstancesPerNode=1,
        impurity="gini", featureSubsetStrategy="sqrt", seed=seed,
    )
    return forest.fit(train.withColumn("y", F.col("label").cast("double"))).copy()


def assembled(features: DataFrame) -> DataFrame:
    """Pairs with their features as one vector."""
    made = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(features)
    return made.select(*PAIR, "features")


def predict(model, vectors: DataFrame, *carry: str) -> DataFrame:
    """(name_id, term_id, p, match, and the carried columns): probability of a match and the forest's answer."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(vectors).select(*PAIR, F.coalesce(p, F.lit(0.0)).alias("p"), (F.coalesce(p, F.lit(0.0)) > 0.5).alias("match"), *carry)


#: Training rows of a partition: small ones are fitted in one task, without waiting for many.
TRAIN_ROWS = 10_000


def active_learning(
    features: DataFrame, truth: DataFrame, seeds: DataFrame, rounds: int = 70, draw: int = 10, least: int = 100, seed: int = 7
):
    """(model, labels): a loop of fitting, scoring the unlabelled pairs and labelling a few.

    features has a row a pair; truth has the label of every pair that may be asked (false where it has
    none), seeds the labels to begin with (those that are no pair of features are left out of fitting,
    and stay labels). The loop ends after ``rounds``, or when fewer than ``least`` pairs are unlabelled.

    Pairs, their vectors and their answers are joined and written once, before the loop. A round fits on the
    seeds and the answers so far, of which there are at most rounds * draw, and scores the others in
    one scan: that small set is sent to every task, so no round shuffles pairs.
    """
    spark = features.sparkSession
    shared_dir(spark)
    given = seeds.select(*PAIR, "label").distinct().checkpoint()
    answers = truth.select(*PAIR, F.col("label").alias("_answer"))
    known = assembled(features).join(answers, PAIR, "left").join(given, PAIR, "left")
    known = known.select(*PAIR, "features", F.coalesce("_answer", F.lit(False)).alias("answer"), "label").checkpoint()
    first, rest = known.where("label is not null").drop("answer"), known.where("label is null").drop("label")
    parts = -(-max(1, given.count()) // TRAIN_ROWS)
    first, left = first.checkpoint(), rest.count()
    schema = first.select(*PAIR, "features", "label").schema
    asked: list[tuple] = []

    def labelled() -> DataFrame:
        return spark.createDataFrame(asked, schema).coalesce(1)

    def fitted(turn: int):
        # the forest draws by a row's place, so places come from the pairs alone
        train = first.select(*PAIR, "features", "label").unionByName(labelled())
        train = train.repartition(parts, *PAIR).sortWithinPartitions(*PAIR).persist()
        try:
            return fit_forest(train, seed + turn)
        finally:
            train.unpersist()

    for turn in range(rounds):
        if left < least:
            break
        scored = predict(fitted(turn), rest, "features", "answer")
        unseen = scored.join(F.broadcast(labelled().select(*PAIR)), PAIR, "left_anti") if asked else scored
        new = uncertain_pairs(unseen, draw=draw, seed=f"round {turn}", carry=("features", "answer")).collect()
        asked += [(*(r[c] for c in PAIR), r["features"], r["answer"]) for r in new]
        left -= len(new)
    labels = given.unionByName(labelled().select(*PAIR, "label")) if asked else given
    return fitted(rounds), labels.checkpoint()
