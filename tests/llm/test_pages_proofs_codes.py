"""HTML extraction, the Merkle manifest and vector codes against brute force on small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import html_text, queries
from termweave.llm.merkle_manifest import folded, merkle_manifest, merkle_proofs, siblings
from termweave.llm.vector_codes import label_errors, vector_codes


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fitted_tree(html_text.labelled_blocks(spark))


def test_tree_knows_its_labels(spark, tree):
    for row in html_text.labelled_blocks(spark).collect():
        *features, label = tuple(row)
        assert html_text.is_article(tree, tuple(features)) == bool(label)


LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>Of.</article><footer>&copy; me</footer>", f"Title & more\n{LONG}\nOf."),
        (f"<title>t</title><style>p{{}}</style><script>var t='</p>';</script><div class='ad'>Buy {LONG}</div><main><p>a\n\t b&nbsp; c<br>d</p></main>", "a b c d"),
        (f"<body><article><h1>H</h1><p>{LONG}</p><div id='comments'><p>{LONG}</p></div></article>", f"H\n{LONG}"),
        (f"<body><article><p>{LONG}</p><form><p>Your name please</p><select><option>1</select></form></article><aside>{LONG}</aside>", LONG),
        (f"<div class=menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><h1>Head</h1><p>{LONG}<p>{LONG}<div class=footer>x y z</div>", f"Head\n{LONG}\n{LONG}"),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>x</p><!-- <p>no</p> --><p>&#233;&eacute; &am &amp</p>", "x\néé &am &"),
        (f"<article><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>1 < 2 & 3</p></article>", "1 < 2 & 3"),
        (f"<article><p>{LONG}</p><p>cut off <b", f"{LONG}\ncut off"),
        (f"<header>Site</header><article><header><h1>Own</h1></header><p>{LONG}</p></article>", f"Own\n{LONG}"),
        ("<nav>a b c</nav><footer>d</footer>", ""),
        ("", ""),
        ("plain", "plain"),
    ],
)
def test_main_text(tree, page, text):
    assert html_text.main_text(page, tree) == text


@pytest.mark.parametrize("page", ["<p \"" * 20000, "<script>" * 20000, "<!--" * 20000, "<div>" * 20000, "<b \"'>" * 20000, "<a href='>" * 20001])
def test_broken_pages_end(tree, page):
    assert isinstance(html_text.main_text(page, tree), str)


def test_extract_text_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (2, "v", "", "y")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [*[(1, "u", LONG, len(LONG))] * 2, (None, None, "", 0), (2, "v", "", 0)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(empty).collect() == []


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proofs_by_hand(rows, fanout=16):
    """What op12 returns, from whole lists."""
    def leaf(r, text):
        return H("".join(framed(v) for v in (*r[:4], text)))

    def grown(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // fanout * fanout
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
            i //= fanout
        return out

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: grown([leaf(r, r[4]) for r in of[s]]) for s in sources}
    over = grown([trees[s][-1][0] for s in sources])
    root, out = over[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            steps, text = path(trees[s], i) + path(over, k), r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            end = leaf(r, text)
            for before, after in steps:
                end = H(before + end + after)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, H("".join(b + a for b, a in steps)), end, end == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_merkle_same_as_by_hand(spark, tmp_path):
    rows = [(1, "a", "x", 3, "AbC")] * 2 + [(None, None, None, None, None), (5, None, "x", 1, ""), (5, "", "x", 1, "É"), (7, "b", None, None, "Q" * 70000)]
    rows += [(20, "hot", "x", 1, "Same")] * 300 + [(i, "c", "y", 2, f"T{i}") for i in range(700)] + [(9, f"s{i}", "", 0, "Z") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    # names that the operator uses inside, as columns of the table
    docs.withColumns({c: F.lit(1) for c in ("rank", "n", "grp", "digest")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(proofs_by_hand(rows), key=str)


def test_merkle_one_row_and_none(spark, tmp_path):
    for k, rows in enumerate(([], [(0, "a", "x", 3, "AbC")])):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path / f"{k}")).collect()]
        assert got == (proofs_by_hand(rows) if rows else [])


def test_merkle_some_requests(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None, "x", 1, str(i)) for i in range(900)], DOCS)
    manifest = merkle_manifest(docs)
    asked = spark.createDataFrame([("a", 0), ("a", 599), (None, 17), ("a", 0), ("b", 1), ("a", 600)], "source string, rank long")
    every = {(r["source"], r["rank"]): r for r in merkle_proofs(manifest).collect()}
    found = merkle_proofs(manifest, asked)
    assert {(r["source"], r["rank"]) for r in found.collect()} == {("a", 0), ("a", 599), (None, 17)} and found.count() == 3
    for r in found.withColumn("top", folded(F.col("digest"), F.col("path"))).withColumn("s", siblings(F.col("path"))).collect():
        assert r["top"] == manifest.root and r["path"] == every[r["source"], r["rank"]]["path"]


def codes_by_hand(x, labels, parts=16, entries=64, rounds=2):
    width = x.shape[1] // parts
    cut = x.reshape(len(x), parts, width).transpose(1, 0, 2)
    books = cut[:, :entries].copy()
    for _ in range(rounds + 1):
        d = ((cut[:, :, None] - books[:, None]) ** 2).sum(3)
        code, final = d.argmin(2), books.copy()
        for p in range(parts):
            for k in range(books.shape[1]):
                mine = cut[p][code[p] == k]
                if len(mine):
                    books[p, k] = [int(c) // len(mine) for c in mine.sum(0)]
    error = d.min(2).sum(0)
    total = {}
    for a, e in zip(labels, error, strict=True):
        total[a] = total.get(a, 0) + int(e)
    books_hash = hashlib.sha256(",".join(map(str, final.ravel().tolist())).encode()).hexdigest()
    return [("".join(f"{c:02x}" for c in code[:, i]), int(error[i]), total[labels[i]], books_hash) for i in range(len(x))]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["even", "clusters", "few", "equal", "integers"])
def test_codes_same_as_by_hand(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    n = 40 if kind == "few" else 700
    x = rng.normal(0, 0.2, (n, 32)).astype(np.float32)
    if kind == "clusters":
        x = (x * 0.05 + rng.normal(0, 2, (20, 32))[rng.integers(0, 20, n)]).astype(np.float32)
    if kind == "equal":
        x[:] = x[rng.integers(0, 3, n)]
    if kind == "integers":  # many ties
        x = (rng.integers(-2, 3, (n, 32)) / 256).astype(np.float32)
    labels = [None if i % 5 == 0 else i % 3 for i in range(n)]
    rows = [(i, v.tolist(), a) for i, (v, a) in enumerate(zip(x, labels, strict=True))]
    bad = [(-1, None, 1), (-2, [float("nan")] * 32, 1), (-3, [None] + [0.0] * 31, 1), (-4, [float("inf")] + [0.0] * 31, None)]
    frame = spark.createDataFrame(rows[::-1] + bad, VECTORS).withColumns({c: F.lit(1) for c in ("x", "code", "error")})
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r)[1:] for r in queries.op13_vector_codes(spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert got == codes_by_hand(np.floor(256 * x.astype(np.float64)).astype(np.int64), labels)


def test_codes_skip_by_bounds(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 0.01, (2000, 32)) + rng.normal(0, 2, (64, 32))[np.arange(2000) % 64]).tolist()
    codes, _ = vector_codes(spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], VECTORS))
    assert codes.agg(F.sum("scans")).first()[0] < 2000 * 16 * 64 / 4


def test_codes_empty_repeated_and_ragged(spark):
    empty, books = vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert label_errors(empty).collect() == [] and books.size == 0
    again = spark.createDataFrame([(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [0.25] * 16, None)], VECTORS)
    got = label_errors(vector_codes(again)[0]).collect()
    assert sorted((str(r["vec_id"]), r["error"], r["label_error"]) for r in got) == [("1", 0, 0), ("1", 0, 0), ("None", 0, 0)]
    for rows in ([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], [(1, [0.5] * 17, 1)]):
        with pytest.raises(ValueError, match="equal parts"):
            vector_codes(spark.createDataFrame(rows, VECTORS))
