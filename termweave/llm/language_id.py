"""Language ID: a linear-chain conditional random field over the words of a text.

Each word has character n-grams with its borders (so prefixes and suffixes), itself and its entry
in a lexicon of telling words as features; transitions between the languages of neighbouring words
are learned with them. Forward-backward gives every word's language, also in texts that switch; a
text's language is the one with the largest share of its words.

The model is fitted on spans from a bounded number of labelled documents (``train_docs``), joined
across documents so that the training sequences switch languages too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, per_document, record, unclashed, utf8, with_outputs
from .sampling import hash_sample
from .wordhash import byte_values, mixed, span_hashes

LETTERS = re.compile(r"[^\W\d_]+")
#: Feature slots (features are hashed into them), words a task remembers, words in a scan's chunk.
SLOTS = 1 << 17
CACHE_WORDS = 100_000
CHUNK = 64
#: Words whose features a task holds at once.
NEW_WORDS = 4096
VALUES = byte_values(9)


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters; none where no character is a letter."""
    words = LETTERS.findall(text.lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of every word's features, one after another; where each word's begin; word hashes."""
    text = b"^" + b"$^".join(words) + b"$"
    data = np.frombuffer(text, np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    value = VALUES[data]
    slots, owner = [], []
    for n in (1, 2, 3, 4):
        if len(data) < n:
            break
        code = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + value[k : len(data) - n + 1 + k]
        inside = word[: len(code)] == word[n - 1 :]
        slots.append(mixed(code[inside] + np.uint64(n)) % np.uint64(SLOTS))
        owner.append(word[: len(code)][inside])
    whole = span_hashes(text, first, first + size, VALUES)
    slots.append(whole % np.uint64(SLOTS))
    owner.append(np.arange(len(words)))
    slots, owner = np.concatenate(slots).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(words))), whole


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    lexicon: np.ndarray  # sorted word hashes
    lexicon_language: np.ndarray
    lexicon_weight: np.ndarray  # languages x languages
    transitions: np.ndarray  # from x to, log space

    def emissions(self, words: list[bytes]) -> np.ndarray:
        slots, starts, whole = features(words)
        n = np.diff(np.append(starts, len(slots)))
        out = np.add.reduceat(self.weights[slots], starts, axis=0) / np.sqrt(n)[:, None]
        return out + self.lexical(whole)

    def lexical(self, whole: np.ndarray) -> np.ndarray:
        out = np.zeros((len(whole), len(self.languages)))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            hit = self.lexicon[at] == whole
            out[hit] = self.lexicon_weight[self.lexicon_language[at[hit]]]
        return out


def forward_backward(potentials: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, parts: bool = False):
    """Marginals of every word, for sequences one after another (potentials: words x languages).

    With parts, also the forward values and the backward values times the potentials.

    Long sequences are cut into chunks whose transfer matrices are multiplied first, so that the
    work is done for many chunks at a time and the result is that of the plain recursion.
    """
    total, n = potentials.shape
    if not total:
        return (potentials,) * 3 if parts else potentials
    step = np.exp(transitions - transitions.max())
    chunks = -(-lengths // CHUNK)
    first_chunk = np.cumsum(chunks) - chunks
    seq = np.repeat(np.arange(len(lengths)), chunks)
    base = np.cumsum(lengths) - lengths
    begin = base[seq] + CHUNK * (np.arange(chunks.sum()) - first_chunk[seq])
    end = np.minimum(begin + CHUNK, base[seq] + lengths[seq])
    at = np.minimum(begin[:, None] + np.arange(CHUNK), total - 1)
    there = begin[:, None] + np.arange(CHUNK) < end[:, None]
    e = np.exp(potentials - potentials.max(1, keepdims=True))[at]
    m = np.broadcast_to(np.eye(n), (len(begin), n, n)).copy()
    for t in range(CHUNK):
        moved = (m @ step) * e[:, t, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        m = np.where(there[:, t, None, None], moved, m)
    alpha0 = np.empty((len(begin), n))
    beta0 = np.empty((len(begin), n))
    state = np.ones((len(lengths), n)) / n
    back = np.ones((len(lengths), n))
    for k in range(int(chunks.max())):
        live = np.flatnonzero(chunks > k)
        c = first_chunk[live] + k
        alpha0[c] = state[live]
        moved = np.einsum("ci,cij->cj", state[live], m[c])
        state[live] = moved / moved.sum(1, keepdims=True)
        c = first_chunk[live] + chunks[live] - 1 - k
        beta0[c] = back[live]
        moved = np.einsum("cij,cj->ci", m[c], back[live])
        back[live] = moved / moved.max(1, keepdims=True)
    alphas = np.empty((CHUNK, len(begin), n))
    a = alpha0
    for t in range(CHUNK):
        moved = (a @ step) * e[:, t]
        a = np.where(there[:, t, None], moved / moved.sum(1, keepdims=True), a)
        alphas[t] = a
    out = np.empty((total, n))
    before, after = (np.empty((total, n)), np.empty((total, n))) if parts else (None, None)
    b = beta0
    for t in range(CHUNK - 1, -1, -1):
        live = there[:, t]
        p = alphas[t] * b
        out[at[live, t]] = (p / p.sum(1, keepdims=True))[live]
        if parts:
            before[at[live, t]], after[at[live, t]] = alphas[t][live], (b * e[:, t])[live]
        moved = (b * e[:, t]) @ step.T
        b = np.where(live[:, None], moved / moved.max(1, keepdims=True), b)
    return (out, before, after) if parts else out


def fit(spans: list[tuple[str, list[str]]], seed: int = 1, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """A model from labelled word spans: penalised likelihood, climbed by Adam over all sequences."""
    languages = sorted({lang for lang, _ in spans})
    number = {lang: k for k, lang in enumerate(languages)}
    n = len(languages)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(spans))
    # three spans to a sequence
    lengths = np.array([sum(len(spans[i][1]) for i in order[a : a + 3]) for a in range(0, len(order), 3)], np.int64)
    words = [w.encode() for i in order for w in spans[i][1]]
    gold = np.repeat([number[spans[i][0]] for i in order], [len(spans[i][1]) for i in order])
    distinct = sorted(set(words))
    place = {w: k for k, w in enumerate(distinct)}
    at = np.fromiter((place[w] for w in words), np.int64, len(words))
    slots, starts, whole = features(distinct)
    sizes = np.diff(np.append(starts, len(slots)))
    scale = 1 / np.sqrt(sizes)
    table = np.zeros((len(distinct), n))
    np.add.at(table, (at, gold), 1)
    telling = (table.sum(1) >= 3) & (table.max(1) >= 0.9 * table.sum(1))
    by_hash = np.argsort(whole[telling])
    model = Crf(
        languages, np.zeros((SLOTS, n)), whole[telling][by_hash], table[telling].argmax(1)[by_hash],
        np.zeros((n, n)), np.zeros((n, n)),
    )
    entry = np.full(len(distinct), -1)
    entry[telling] = table[telling].argmax(1)
    seq_start = np.zeros(len(words), bool)
    seq_start[np.cumsum(lengths) - lengths] = True
    inner = np.flatnonzero(~seq_start)
    pairs = np.zeros((n, n))
    np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
    params = [model.weights, model.lexicon_weight, model.transitions]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        word_scores = model.emissions(distinct)
        marginal, before, after = forward_backward(word_scores[at], model.transitions, lengths, parts=True)
        joint = before[inner - 1][:, :, None] * np.exp(model.transitions)[None] * after[inner][:, None, :]
        expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        wrong = -marginal
        wrong[np.arange(len(words)), gold] += 1
        by_word = np.stack([np.bincount(at, wrong[:, k], len(distinct)) for k in range(n)], 1)
        spread = np.repeat(by_word * scale[:, None], sizes, axis=0)
        grad_w = np.stack([np.bincount(slots, spread[:, k], SLOTS) for k in range(n)], 1)
        grad_l = np.stack([by_word[entry == k].sum(0) for k in range(n)])
        for i, g in enumerate((grad_w, grad_l, pairs - expected)):
            g = g / len(words) - decay * params[i] / len(words) ** 0.5
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            move = first[i] / (1 - 0.9**turn) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-8)
            params[i] += rate * 0.97**turn * move
    return model


def training_spans(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, remainder: int, train_docs: int,
    spans: int = 3, span_words: int = 16,
) -> list[tuple[str, list[str]]]:
    """Word spans, spread over the whole text, of a bounded number of labelled training rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, modulus) != remainder))
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i, lang, text in zip(batch.column("id").to_pylist(), batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                words = letter_words(text.decode("utf-8", "replace"))
                room = max(0, len(words) - span_words)
                for at in sorted({room * k // max(1, spans - 1) for k in range(spans)}):
                    if words[at : at + span_words]:
                        out.append((int(i), lang, " ".join(words[at : at + span_words])))
            ids, langs, texts = zip(*out, strict=True) if out else ((), (), ())
            return record(id=pa.array(ids, pa.int64()), lang=pa.array(langs, pa.string()), words=pa.array(texts, pa.string()))

        return f

    sample = per_document(hash_sample(labelled, "id", train_docs), "id long, lang string, words string", rows, "text")
    bounded = sample.orderBy("id", "lang", "words").limit(2 * spans * train_docs).collect()
    return [(r["lang"], r["words"].split(" ")) for r in bounded]


class Tagger:
    """Languages of texts in a task, with a memory of the words' emission scores."""

    def __init__(self, model: Crf):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = list(set().union(*texts) - self.place.keys())
        if new:
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            coded = [w.encode("utf-8", "replace") for w in new]
            parts = [self.model.emissions(coded[a : a + NEW_WORDS]) for a in range(0, len(coded), NEW_WORDS)]
            self.table = np.concatenate([self.table, *parts])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter((p for words in texts for p in map(self.place.__getitem__, words)), np.int64, int(lengths.sum()))
        return forward_backward(self.table[at], self.model.transitions, lengths[lengths > 0])


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5,
    remainder: int = 0, train_docs: int = 1500, carry: tuple[str, ...] = (), labelled: DataFrame | None = None,
    text_output: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, the carried columns, lang_pred, score, shares.

    shares maps each language to its share of the words' marginals; lang_pred has the largest and
    score is it. Null texts, and texts without a letter, are "und" with score 0. Training rows are
    those of labelled (docs itself by default) with a language, whose crc32 of the id modulo
    ``modulus`` is not ``remainder``; with none at all lang_pred is null where it is not "und".
    text_output names a column that keeps the text. carry may not name an output.
    """
    unclashed(id_col, carry + ((text_output,) if text_output else ()), ("lang_pred", "score", "shares"))
    spans = training_spans(docs if labelled is None else labelled, id_col, text_col, lang_col, modulus, remainder, train_docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(spans) if spans else None)

    def make():
        tagger = Tagger(model.value) if model.value else None
        kind = pa.map_(pa.string(), pa.float64())

        def f(texts):
            words = [letter_words(t.decode("utf-8", "replace")) if t else [] for t in texts]
            pred, score, shares = [], [], []
            marginals = tagger.marginals(words) if tagger else None
            at = 0
            for w in words:
                if not w or tagger is None:
                    pred.append(None if w else "und"), score.append(0.0), shares.append([])
                    continue
                mean = marginals[at : at + len(w)].mean(0)
                at += len(w)
                pred.append(tagger.model.languages[int(mean.argmax())])
                score.append(float(min(1.0, mean.max())))
                shares.append(list(zip(tagger.model.languages, mean.tolist(), strict=True)))
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind)]

        return f

    keep = [F.col(id_col), *[F.col(c) for c in carry]]
    if text_output:
        keep.append(F.col(text_col).alias(text_output))
    return with_outputs(docs, keep, F.col(text_col), {"lang_pred": "string", "score": "double", "shares": "map<string,double>"}, make)
