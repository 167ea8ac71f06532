"""LM scoring: marginal likelihood over the lattice of all subword segmentations.

The pieces are those of an existing vocabulary file; no file at hand has unigram scores (its scores
are merge ranks), so a piece's weight is its relative frequency in the training words: counted first
in the file's own segmentation, then, ``rounds`` times, expected over all segmentations under the
weights before (forward-backward; EM). A text is its words and one end; pieces never span two words,
so the lattice of a text is the chain of its words' lattices, and its probability is the product of
theirs. In each word a forward recursion in log space sums over all segmentations.

Word counts cover every document and are never gathered whole. A word's lattice is scored where its
count stands, so once for the corpus and not once for each task; words that are frequent enough for
at most ``frequent`` of them to be so go to every task with their scores, and the others meet theirs
in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, record, steps, utf8, written
from .wordhash import ascii_words

#: The end of a text, as a token: no word can be it.
END = b"\n"
#: Words that a task counts before it passes them on.
CACHE_WORDS = 100_000
#: Bytes of the longest word that goes to every task.
FREQUENT_BYTES = 64
#: Characters from which on a word is scored alone, position by position in bounded memory.
LONG = 4096
#: The mark that begins a word in the vocabulary file: a fixed value.
MARK = "▁"


def lm_tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*(ascii_words(text.lower()) if text else ()), END]


def _count_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter, others: set[bytes]) -> pa.RecordBatch:
            others = others - counts.keys()
            n = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(len(others), np.int64)])
            return record(word=pa.array([*counts, *others], pa.binary()), n=pa.array(n))

        counts: Counter = Counter()
        others: set[bytes] = set()
        for batch in steps(batches, "text"):
            for text, trains in zip(utf8(batch.column("text")), batch.column("trains").to_pylist(), strict=True):
                (counts if trains else others).update(lm_tokens(text))
                if len(counts) + len(others) > CACHE_WORDS:
                    yield rows(counts, others)
                    counts, others = Counter(), set()
        yield rows(counts, others)

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over (text, trains): every word and its training count, counted within tasks first."""
    return texts.mapInArrow(_count_rows(), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(counts: DataFrame, vocabulary_path: str, shared=None) -> np.ndarray:
    """Occurrences of every piece in the training words (a vector as long as the vocabulary): in the
    file's own segmentation, or expected under the shared weights (long words: the file's own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(vocabulary_path)
        total = np.zeros(model.get_piece_size())
        if shared is not None:
            lattice = Lattice(*shared.value[:2])
            number = np.array([model.piece_to_id(p) for p in shared.value[0]])
            of_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(len(total)) if model.is_byte(i)}
        for batch in steps(batches, "word"):
            n = batch.column("n").to_numpy()
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            if shared is not None:
                short = np.array([len(w) < LONG for w in words], bool)
                pieces, by_byte = lattice.expected([w for w in words if len(w) < LONG], n[short])
                np.add.at(total, number, pieces)
                for b, x in enumerate(by_byte.tolist()):
                    if x and b in of_byte:
                        total[of_byte[b]] += x
                words, n = [w for w in words if len(w) >= LONG], n[~short]
            pieces = model.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.fromiter((p for some in pieces for p in some), np.int64, int(sizes.sum()))
            total += np.bincount(flat, np.repeat(n, sizes), len(total))
        some = np.flatnonzero(total)
        yield record(piece=pa.array(some.astype(np.int32)), n=pa.array(total[some]))

    words = counts.where((F.col("word") != F.lit(END)) & (F.col("n") > 0)).mapInArrow(run, "piece int, n double")
    table = words.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_processor(vocabulary_path).get_piece_size())
    out[table["piece"].to_numpy()] = table["n"].to_numpy()
    return out


@dataclass
class Edges:
    """Pieces in words: from state source to target (state i stands before character i), ln weights,
    piece numbers (-1: a character by its bytes), and the states where every word begins and is whole."""

    text: str
    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    end: np.ndarray

    def _recursion(self, begin: np.ndarray, since: np.ndarray, into: np.ndarray) -> np.ndarray:
        """ln sums over all ways from the states begin, each step from since to into; the words move
        together, one character further each time."""
        word = np.repeat(np.arange(len(self.first)), self.end - self.first + 1)
        within = np.abs(into - begin[word[np.minimum(self.source, len(word) - 1)]])
        order = np.lexsort((into, within))
        since, into, weight, within = since[order], into[order], self.weight[order], within[order]
        value = np.full(len(self.text) + 1, -np.inf)
        value[begin] = 0.0
        cuts = np.searchsorted(within, np.arange(within.max(initial=-1) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            step = value[since[a:b]] + weight[a:b]
            at = np.flatnonzero(np.concatenate(([True], into[a + 1 : b] != into[a : b - 1])))
            top = np.maximum.reduceat(step, at)
            top = np.where(np.isfinite(top), top, -1e300)
            spread = np.exp(step - np.repeat(top, np.diff(np.append(at, b - a))))
            with np.errstate(divide="ignore"):
                value[into[a:b][at]] = top + np.log(np.add.reduceat(spread, at))
        return value

    def total(self) -> np.ndarray:
        """Every word's ln probability."""
        return self._recursion(self.first, self.source, self.target)[self.end]

    def shares(self) -> np.ndarray:
        """How likely every edge is in a segmentation of its word."""
        forward = self._recursion(self.first, self.source, self.target)
        backward = self._recursion(self.end, self.target, self.source)
        word = np.repeat(np.arange(len(self.first)), self.end - self.first + 1)[self.source]
        with np.errstate(invalid="ignore"):
            found = np.exp(forward[self.source] + self.weight + backward[self.target] - forward[self.end[word]])
        return np.nan_to_num(found)


class Lattice:
    """log10 marginal probabilities of words under weighted pieces."""

    def __init__(self, pieces: dict[str, float], byte_pieces: list[float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(pieces):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.weights_of = np.fromiter(pieces.values(), np.float64, len(pieces))
        self.single = np.array(sorted(ord(p) for p in pieces if len(p) == 1), np.uint32)
        self.byte_pieces = byte_pieces
        self.longest = int(self.sizes.max(initial=1))

    def scores(self, words: list[str]) -> np.ndarray:
        """Every word's log10 probability."""
        long = [k for k, w in enumerate(words) if len(w) >= LONG]
        out = np.empty(len(words))
        if long:
            out[long] = [self._long(words[k]) for k in long]
        short = np.setdiff1d(np.arange(len(words)), long)
        if len(short):
            out[short] = self._edges([words[k] for k in short]).total()
        return out / math.log(10)

    def _long(self, word: str) -> float:
        """ln probability of a word; only the last ``longest`` states are held."""
        known, text = set(self.single.tolist()), MARK + word
        ring, size, log = [0.0] * (self.longest + 1), self.longest + 1, 0.0
        ring[0] = 1.0
        sizes, chance = self.sizes.tolist(), np.exp(self.weights_of).tolist()
        ends = self.automaton.iter(text)
        at, number = next(ends, (-1, 0))
        for i, c in enumerate(text):
            value = 0.0
            while at == i:
                if sizes[number] <= i + 1:
                    value += ring[(i + 1 - sizes[number]) % size] * chance[number]
                at, number = next(ends, (-1, 0))
            if ord(c) not in known:
                value += ring[i % size] * math.exp(sum(self.byte_pieces[b] for b in c.encode()))
            if value < 1e-100:
                ring = [x * 1e100 for x in ring]
                value, log = value * 1e100, log - 100 * math.log(10)
            ring[(i + 1) % size] = value
        last = ring[len(text) % size]
        return math.log(last) + log if last > 0 else -math.inf

    def _edges(self, words: list[str]) -> Edges:
        """The lattices of words, which stand in one string with a line end after each."""
        text = "".join(f"{MARK}{w}\n" for w in words)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        unknown = np.flatnonzero(~np.isin(codes, self.single) & (codes != 10))
        by_bytes = [sum(self.byte_pieces[b] for b in text[i].encode()) for i in unknown.tolist()]
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(length) - length
        target = np.concatenate([found[:, 0], unknown]) + 1
        size = np.concatenate([self.sizes[found[:, 1]], np.ones(len(unknown), np.int64)])
        return Edges(
            text, target - size, target, np.concatenate([self.weights_of[found[:, 1]], by_bytes]),
            np.concatenate([found[:, 1], np.full(len(unknown), -1)]), first, first + length - 1,
        )

    def expected(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected occurrences of the pieces and of the 256 byte pieces, in n times each word."""
        edges = self._edges(words)
        share = edges.shares() * n[np.repeat(np.arange(len(words)), edges.end - edges.first + 1)[edges.source]]
        known = edges.piece >= 0
        pieces = np.bincount(edges.piece[known], share[known], len(self.sizes))
        by_byte = np.zeros(256)
        for i, x in zip(edges.source[~known].tolist(), share[~known].tolist(), strict=True):
            for b in edges.text[i].encode():
                by_byte[b] += x
        return pieces, by_byte

    @staticmethod
    def weights(path: str, counts: np.ndarray, ends: int, smoothing: float) -> tuple[dict[str, float], list[float], float]:
        """ln weights of the pieces and of the byte pieces, and log10 of the end's."""
        model = _processor(path)
        counts = counts + smoothing
        ids = range(len(counts))
        use = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = counts[use].sum() + ends + smoothing
        byte = {i: int(model.id_to_piece(i)[3:5], 16) for i in use if model.is_byte(i)}
        by_byte = [math.log(smoothing / total)] * 256
        pieces = {}
        for i in use:
            if i in byte:
                by_byte[byte[i]] = math.log(counts[i] / total)
            else:
                pieces[model.id_to_piece(i)] = math.log(counts[i] / total)
        return pieces, by_byte, math.log10((ends + smoothing) / total)


def lattice_scores(counts: DataFrame, shared) -> DataFrame:
    """(word, n, score) for (word, n): every word's log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, by_byte, end_score = shared.value
        lattice = Lattice(pieces, by_byte)
        for batch in steps(batches, "word"):
            words = batch.column("word").to_pylist()
            found = lattice.scores([w.decode("utf-8", "replace") for w in words])
            found[[k for k, w in enumerate(words) if w == END]] = end_score
            yield record(word=batch.column("word"), n=batch.column("n"), score=pa.array(found))

    return counts.mapInArrow(run, "word binary, n long, score double")


def most_frequent(scored: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, down to a bound that at most ``most`` rows reach."""
    size = F.floor(F.log2("n") * 16).alias("size")
    seen, least = 0, None
    for r in scored.where("n > 0").groupBy(size).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect():
        seen += r["rows"]
        if seen > most:
            break
        least = r["size"]
    return scored.where(F.lit(False)) if least is None else scored.where((F.col("n") > 0) & (F.floor(F.log2("n") * 16) >= least))


_PARTS = "word binary, row long, doc long, n long, tokens long, known long, base double, part double"


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, scores, denominator = shared.value
        place = dict(zip(words, range(len(words)), strict=True))
        # the last entry stands for all other words
        base = np.append(np.log10((n + 1) / denominator), 0.0)
        known, score = np.append(n > 0, False), np.append(scores, 0.0)
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches, "text"):
            texts = [lm_tokens(t) for t in utf8(batch.column("text"))]
            if not texts:
                continue
            tokens = np.fromiter(map(len, texts), np.int64, len(texts))
            flat = list(chain.from_iterable(texts))
            at = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
            first = np.cumsum(tokens) - tokens  # every text has its end, so none is empty
            rare = np.flatnonzero(at < 0)
            of = (np.searchsorted(first, rare, "right") - 1).tolist()
            others = Counter(zip(of, map(flat.__getitem__, rare.tolist()), strict=True))
            m, rows = len(others), row + np.arange(len(texts))
            row += len(texts)
            none, zero = pa.nulls(m, pa.int64()), pa.array(np.zeros(m))
            owner = np.fromiter((i for i, _ in others), np.int64, m)
            yield record(
                word=pa.array([*(b" %d" % r for r in rows.tolist()), *(w for _, w in others)], pa.binary()),
                row=pa.array(np.concatenate([rows, rows[owner]])),
                doc=pa.concat_arrays([batch.column("doc"), none]),
                n=pa.array(np.concatenate([np.zeros(len(texts), np.int64), np.fromiter(others.values(), np.int64, m)])),
                tokens=pa.concat_arrays([pa.array(tokens), none]),
                known=pa.concat_arrays([pa.array(np.add.reduceat(known[at].astype(np.int64), first)), none]),
                base=pa.concat_arrays([pa.array(np.add.reduceat(base[at], first)), zero]),
                part=pa.concat_arrays([pa.array(np.add.reduceat(score[at], first)), zero]),
            )

    return run


def lm_score(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7,
    remainder: int = 2, frequent: int = 1 << 18, smoothing: float = 0.1, rounds: int = 2,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    Training rows are those whose crc32 of the id modulo ``modulus`` is not ``remainder`` (a null
    id never trains). base_score is the add-one unigram over words, score the log10 probability
    of the lattice model. A null or empty text is the end alone. With no training rows the model
    is the uniform one of its smoothing.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc"), fold(id_col, modulus).alias("f"), F.col(text_col).alias("text"))
    trains = F.coalesce(F.col("f") != remainder, F.lit(False)).alias("trains")
    counts = written(word_counts(given.select("text", trains)))
    is_end = F.col("word") == F.lit(END)
    n, distinct, ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0))
    ).first()
    weights = None
    for _ in range(rounds + 1):
        found = piece_counts(counts, vocabulary_path, weights)
        weights = spark.sparkContext.broadcast(Lattice.weights(vocabulary_path, found, ends, smoothing))
    scored = written(lattice_scores(counts, weights))
    top = most_frequent(scored.where(F.octet_length("word") <= FREQUENT_BYTES), frequent).toArrow()
    denominator = float(n + distinct + 1)
    many = top["word"].to_pylist(), top["n"].to_numpy(), top["score"].to_numpy(), denominator
    shared = spark.sparkContext.broadcast(many)
    parts = given.select("doc", "text").mapInArrow(_score_rows(shared), _PARTS)
    joined = parts.join(scored.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = F.col("n") * F.log10((c + 1) / F.lit(denominator))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc").alias(id_col),
            F.sum("tokens").alias("n_tokens"),
            (F.sum("known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
            (F.sum("base") + F.sum(rare)).alias("base_score"),
            (F.sum("part") + F.sum(F.col("n") * F.coalesce("score", F.lit(0.0)))).alias("score"),
        )
        .select(id_col, "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
    )
