"""Toxicity by a logistic model with counterfactual regularisation.

Features are the distinct lower-cased words of the whole text and their first four to seven letters,
hashed; each is scaled by its smoothed log odds of being toxic among the labelled rows. Those below
``LEAST_ODDS``, or in fewer than ``LEAST_ROWS`` rows, are left out: harmless words, however many, excuse
nothing. Of every labelled text one sentence, chosen by a hash, is made to mention a group, in one of four
languages, and its counterfactual names another group of the set or none; labelled texts that name a group
themselves are swapped as they are. The squared change of the score between the two is added to the loss. So a
group's name, or the beginning that it shares with other words, cannot carry weight by itself, and neutral
mentions are not held against a text.

The model is fitted in numpy on a bounded sample of labelled rows (``rows``); scoring runs in the
tasks over every whole text.

Edge cases: null and empty texts score by the model's intercept alone; rows keep their count and
repeated rows score alike; without labels every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, only_cache
from .labelled import held_out, training_rows

BITS = 20
STEMS = (4, 5, 6, 7)
LEAST_ROWS, LEAST_ODDS, SMOOTHING = 3, 0.7, 10.0
TRAIN_ROWS = 10_000
EPOCHS, BATCH, RATE, DECAY, COUNTERFACTUAL = 8, 256, 0.05, 1e-4, 1.0
CACHE_WORDS = 100_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
_KNOWN: dict[str, list[int]] = {}
#: Where a checksum goes on after its first letters.
_MASK, _OF_WORD, _OF_STEM = (1 << BITS) - 1, crc32(b"w"), [(n, crc32(b"s%d" % n)) for n in STEMS]

#: Terms that name groups in English, German, French and Spanish, each row a set whose members are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen", "refugee", "foreigner"), ("immigrants", "citizens", "refugees", "foreigners"),
    ("old", "young", "elderly"), ("disabled", "deaf", "blind"), ("transgender", "cisgender"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "bürger", "flüchtlinge", "ausländer"), ("schwule", "lesben", "heteros"), ("behinderte", "gehörlose", "blinde"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "citoyens", "réfugiés", "étrangers"), ("gays", "lesbiennes", "hétéros"), ("handicapés", "sourds", "aveugles"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "ciudadanos", "refugiados", "extranjeros"), ("homosexuales", "lesbianas", "heterosexuales"), ("discapacitados", "sordos", "ciegos"),
)
_SWAP = {w: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, w in enumerate(row)}


def _features_of(w: str) -> list[int]:
    """CRC-32 of "w" and the word, and of "s", n and its first n letters."""
    whole, size = w.encode(), len(w)
    found = [crc32(whole, _OF_WORD) & _MASK]
    if size == len(whole):  # letters are bytes
        return found + [crc32(whole[:n], start) & _MASK for n, start in _OF_STEM if n < size]
    return found + [crc32(w[:n].encode(), start) & _MASK for n, start in _OF_STEM if n < size]


def _ids(words: set[str]) -> np.ndarray:
    only_cache("toxicity", _KNOWN)
    out = set()
    for w in words:
        found = _KNOWN.get(w)
        if found is None:
            if len(_KNOWN) > CACHE_WORDS:
                _KNOWN.clear()
            _KNOWN[w] = found = _features_of(w)
        out.update(found)
    return np.fromiter(out, dtype=np.int32, count=len(out))


class _Live(dict):
    """The features of a word that carry weight in a model; most words have none."""

    def __init__(self, weights: np.ndarray):
        self.carries = (weights != 0).tobytes()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        carries = self.carries
        self[word] = found = tuple([i for i in _features_of(word) if carries[i]])
        return found


def _logits(model: tuple[np.ndarray, float], texts: list[str | None], live: _Live) -> list[float]:
    """Intercept and weights of each text's distinct features."""
    only_cache("toxicity", _KNOWN)
    w, b = model
    found = (list(set(chain.from_iterable(map(live.__getitem__, _words(t))))) for t in texts)
    return [w[ids].sum(dtype=np.float64) + b if ids else b for ids in found]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactual(words: set[str]) -> set[str] | None:
    """The words with every group's term swapped, or None if there is no such term."""
    return {_SWAP.get(w, w) for w in words} if not words.isdisjoint(_SWAP) else None


def mentions(text: str | None) -> tuple[set[str], set[str]] | None:
    """Words of one sentence of the text with a group's term, and with another term of the set, or none, in its place.

    Sentence and terms follow from a hash of the text, so a text always gives the same pair.
    """
    sentences = [s for s in _SENTENCE.split(text or "") if s.strip()]
    if not sentences:
        return None
    pick = crc32(text.encode("utf-8", "surrogatepass"))
    words = _words(sentences[pick % len(sentences)])
    pick //= len(sentences)
    row = IDENTITY_TERMS[pick % len(IDENTITY_TERMS)]
    at = pick // len(IDENTITY_TERMS) % len(row)
    other = ("", *row[:at], *row[at + 1 :])[pick // 1_000 % len(row)]
    return words | {row[at]}, words | ({other} if other else set())


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], []]
    for text in batch.column(0).to_pylist():
        words = _words(text)
        swapped, pair = counterfactual(words), mentions(text)
        found = (words, swapped, *(pair or (None, None)))
        for c, w in zip(columns, found, strict=True):
            c.append(None if w is None else _ids(w))
    kind = pa.list_(pa.int32())
    return pa.record_batch([*[pa.array(c, kind) for c in columns], batch.column(1)], ["ids", "swapped", "one", "other", "y"])


def fit(rows: list[tuple], seed: int = 7, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float] | None:
    """Weights and intercept by AdaGrad on log loss, with the counterfactual penalty.

    A row is (features, features of the swapped text or None, label) and, optionally, the features
    of a made-up mention and of its counterfactual.
    """
    if not rows:
        return None
    rng, y = np.random.default_rng(seed), np.array([r[2] for r in rows], dtype=float)
    all_rows, bad_rows = np.zeros(1 << BITS, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for ids, _, bad, *_ in rows:  # a row has each feature once
        all_rows[ids] += 1
        if bad:
            bad_rows[ids] += 1
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    odds = np.log((bad_rows + SMOOTHING * share) / (all_rows - bad_rows + SMOOTHING * (1 - share)) * (1 - share) / share)
    odds[(all_rows < LEAST_ROWS) | (odds < LEAST_ODDS)] = 0.0
    # Numbers of the features that carry weight; the rest is left out of every row.
    number = np.full(1 << BITS, -1, dtype=np.int64)
    live = np.flatnonzero(odds)
    number[live] = np.arange(len(live))
    odds = odds[live]

    def known(ids: np.ndarray) -> np.ndarray:
        found = number[ids]
        return found[found >= 0]

    data = []
    for ids, swapped, _, *made in rows:
        pairs = [(ids, swapped)] if swapped is not None else []
        pairs += [tuple(made)] if made and made[0] is not None else []
        data.append((known(ids), [(known(p), known(q)) for p, q in pairs]))
    w, b = np.full(len(live), 0.1), 0.0
    seen, seen_b = np.full(len(live), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            f = np.concatenate([data[i][0] for i in part])
            d = np.repeat(np.arange(len(part)), [len(data[i][0]) for i in part])
            z = np.bincount(d, weights=(w * odds)[f], minlength=len(part)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            grad = np.bincount(f, weights=g[d], minlength=len(live))
            now = w * odds
            for i in part:
                for one, other in data[i][1]:
                    change = 2 * penalty * (now[one].sum() - now[other].sum()) / len(part)
                    if change:
                        np.add.at(grad, one, change)
                        np.add.at(grad, other, -change)
            grad = grad * odds + DECAY * w
            seen += grad * grad
            w -= RATE * grad / np.sqrt(seen)
            seen_b += g.sum() ** 2
            b -= RATE * g.sum() / np.sqrt(seen_b)
    full = np.zeros(1 << BITS, dtype=np.float32)
    full[live] = w * odds
    return full, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float] | None:
    """Fit on at most *rows* labelled documents that are not held out."""
    chosen = training_rows(docs, labels, "toxic", rows).select("text", "y")
    return fit(labelled_features(chosen))


def labelled_features(chosen: DataFrame) -> list[tuple]:
    """Rows for ``fit`` from a bounded sample of (text, y)."""
    found = map_batches(chosen, _features, "ids array<int>, swapped array<int>, one array<int>, other array<int>, y int").toArrow()
    lists = [found[c].combine_chunks() for c in ("ids", "swapped", "one", "other")]
    sets = [[v.values.to_numpy() if v.is_valid else None for v in c] for c in lists]
    return [(ids, swapped, y, one, other) for ids, swapped, one, other, y in zip(*sets, found["y"].to_pylist(), strict=True)]


def mention_gap(model: tuple[np.ndarray, float], texts: list[str | None]) -> float:
    """Mean absolute change of the score when one sentence of a text names another group, or none."""
    w, b = model
    changes = []
    for pair in filter(None, map(mentions, texts)):
        one, other = (1 / (1 + np.exp(-(w[_ids(p)].sum(dtype=np.float64) + b))) for p in pair)
        changes.append(abs(one - other))
    return float(np.mean(changes)) if changes else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """One row per row of *docs*: doc_id, held_out, score, predicted."""
    live = None if model is None else _Live(model[0])  # each task has its own copy

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            found = np.zeros(batch.num_rows)
        else:
            z = np.array(_logits(model, batch.column(1).to_pylist(), live))
            found = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """*docs* without the rows scored as toxic, all columns kept."""
    model = train(docs, labels)
    live = None if model is None else _Live(model[0])
    return keep_rows(docs, lambda texts: [True] * len(texts) if model is None else [bool(z < 0) for z in _logits(model, texts, live)])


def keep_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows for whose text *keep* (a list of texts to a list of booleans) holds; one pass, no shuffle."""
    at = docs.columns.index("text")
    return map_batches(docs, lambda batch: batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_())), docs.schema)
