"""Votes and word labels against plain Python, names of carried columns, and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from termweave.llm import language_id, quality
from termweave.llm.decontaminate import decontaminate
from termweave.llm.language_id import identify_language, letter_words
from termweave.llm.quality import quality_score
from termweave.llm.substring_dedup import substring_dedup
from termweave.llm.topk_search import top_k_search
from termweave.llm.url_filter import url_filter
from termweave.llm.warc import read_warc, write_warc


def texts():
    rng = random.Random(11)
    en, de = ["the", "house", "and", "of", "water", "river", "with"], ["das", "haus", "und", "von", "wasser", "fluss", "mit"]
    rows = []
    for i in range(120):
        words = [rng.choice(en if rng.random() < (0.9 if i % 2 else 0.1) else de) for _ in range(rng.randint(1, 40))]
        if i % 3 == 0:
            words += ["CLICK!!", "$$$", "FREE"] * rng.randint(1, 4)
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
    # repeated rows, a repeated id, null and empty texts, a null id, a text without a letter
    return rows + [rows[4], (7, "das haus", None), (200, None, "en"), (201, "", "de"), (None, "the river", "en"), (202, "12 !! 7", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(4)


@pytest.mark.parametrize("neighbours", [5, 1000])
def test_votes_equal_plain_cosines(spark, docs, neighbours):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int")
    profiles, y = quality.labelled_profiles(docs, labels, "doc_id", "text", "doc_id", "quality", 5, 0, 2500)
    some = [i for i, (s, _) in enumerate(profiles) if len(s)]
    space = quality.fit([profiles[i] for i in some], y[some], 48)
    table, marks = space.vectors.astype(float).tolist(), space.labels.tolist()

    def vote(text):
        slots, counts = quality.profile(text.encode() if text is not None else None)
        value = {int(s): math.log1p(c) * float(space.idf[s]) for s, c in zip(slots, counts, strict=True)}
        for shapes in (True, False):
            mine = [s for s in value if (s < quality.SLOTS) == shapes]
            norm = math.sqrt(sum(value[s] ** 2 for s in mine))
            for s in mine:
                value[s] *= (1.0 if shapes else quality.WORD_WEIGHT) / norm
        place = [sum(v * float(space.axes[s][k]) for s, v in value.items()) for k in range(space.axes.shape[1])]
        norm = math.sqrt(sum(x * x for x in place)) or 1.0
        cosines = sorted(((sum(a * b / norm for a, b in zip(place, row, strict=True)), m) for row, m in zip(table, marks, strict=True)), reverse=True)
        near = cosines[:neighbours]
        weights = [max(c, 0.0) ** 8 for c, _ in near]
        if not sum(weights):
            return sum(marks) / len(marks), True
        # where the first vector left out is as near as the last one taken, either may vote
        clear = len(cosines) <= neighbours or near[-1][0] - cosines[neighbours][0] > 1e-5
        return sum(w * m for w, (_, m) in zip(weights, near, strict=True)) / sum(weights), clear

    given = {t for _, t, _ in texts()}
    want = {t: vote(t) for t in given}
    found = quality_score(docs, labels, neighbours=neighbours, carry=("text",)).collect()
    assert len(found) == len(texts())
    checked = [r for r in found if want[r.text][1]]
    assert len(checked) > 0.8 * len(found)
    for r in checked:
        assert r.score == pytest.approx(want[r.text][0], abs=1e-3) and r.predicted == int(r.score >= 0.3)


def test_languages_equal_plain_forward_backward(docs):
    model = language_id.fit(language_id.training_spans(docs, "doc_id", "text", "lang", 5, 0, 1500))
    names, n = model.languages, len(model.languages)
    step = [[math.exp(x) for x in row] for row in model.transitions.tolist()]

    def shares(text):
        words = letter_words(text) if text else []
        if not words:
            return None
        e = [[math.exp(x) for x in model.emissions([w.encode()])[0].tolist()] for w in words]
        # the first word is entered from a uniform start through the transitions
        ahead, behind = [[sum(step[i][j] for i in range(n)) * e[0][j] for j in range(n)]], [[1.0] * n]
        for row in e[1:]:
            ahead.append([sum(ahead[-1][i] * step[i][j] for i in range(n)) * row[j] for j in range(n)])
        for row in reversed(e[1:]):
            behind.insert(0, [sum(step[i][j] * row[j] * behind[0][j] for j in range(n)) for i in range(n)])
        out = [0.0] * n
        for a, b in zip(ahead, behind, strict=True):
            total = sum(x * y for x, y in zip(a, b, strict=True))
            out = [o + x * y / total / len(words) for o, x, y in zip(out, a, b, strict=True)]
        return dict(zip(names, out, strict=True))

    rows = identify_language(docs, text_output="text").collect()
    assert len(rows) == len(texts()) and names == ["de", "en"]
    for r in rows:
        want = shares(r.text)
        if want is None:
            assert (r.lang_pred, r.score, r.shares) == ("und", 0.0, {})
        else:
            assert r.shares == pytest.approx(want, abs=1e-6) and r.score == pytest.approx(max(want.values()), abs=1e-6)
            assert want[r.lang_pred] == pytest.approx(max(want.values()), abs=1e-6)


def test_carried_columns_may_not_take_an_output_name(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    clashing = docs.withColumnsRenamed({"lang": "items"}).withColumn("Kept_Text", F.lit(1)).withColumn("lang", F.lit("en"))
    for call in (
        lambda: quality_score(clashing, labels, carry=("score",)), lambda: identify_language(clashing, carry=("score",)),
        lambda: identify_language(clashing, text_output="score"), lambda: decontaminate(clashing, bench, carry=("items",)),
        lambda: substring_dedup(clashing, carry=("Kept_Text",)), lambda: substring_dedup(clashing, carry=("text", "text")),
        lambda: quality_score(clashing, labels, carry=("doc_id",)),
    ):
        with pytest.raises(ValueError, match="other names"):
            call()
    # clashing columns that are not carried do no harm
    assert quality_score(clashing, labels).columns == ["doc_id", "score", "predicted"]
    assert decontaminate(clashing, bench, carry=("score",)).count() == len(texts())


def test_empty_tables(spark, docs):
    no_docs, bench = docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(no_docs, bench).isEmpty()
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0 or size(items) > 0").isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    marked = spark.createDataFrame([], "url string, bad boolean")
    assert url_filter(pages, marked, [("block", "com", "/en/")]).isEmpty()
    assert read_warc(write_warc(pages)).isEmpty()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<float>")
    assert top_k_search(vectors, vectors).isEmpty() and top_k_search(some, vectors).isEmpty()
    assert top_k_search(vectors, some).isEmpty() and top_k_search(some, some).isEmpty()
