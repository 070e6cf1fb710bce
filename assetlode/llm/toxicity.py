"""Toxicity by a linear classifier that is regularised with counterfactuals.

Features are the words of a text and the first letters of its words, present or
not. Those most tied to the label in a bounded sample of labelled rows enter a
logistic model. Every labelled text is also seen in counterfactuals: with its
identity terms swapped for others of their kind or, where it names no group, with a
term put in, that term's partner in its place, and without. The squared change of
the raw score between them is penalised, so that naming a group doesn't move the
score: a term that begins like an insult would else share its first letters'
weights.

Defined results: a null text is an empty one and scores as such; without labelled
rows every text scores 0; repeated rows are scored each; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import map_rows
from assetlode.llm.quality_rules import labelled_sample
from assetlode.plans.staging import materialize

SAMPLE_ROWS = 20_000
FEATURES = 1_024
LEAST_DOCS = 5
RIDGE, FAIRNESS, STEPS = 3e-4, 1.0, 300
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)

# Identity terms by kind, each swapped for the next one of its kind.
IDENTITY_TERMS = {
    "religion": "muslim christian jewish hindu buddhist catholic protestant mormon sikh atheist",
    "religion_plural": "muslims christians jews hindus buddhists catholics protestants mormons sikhs atheists",
    "orientation": "gay straight lesbian bisexual heterosexual queer",
    "gender": "woman man",
    "gender_plural": "women men",
    "gender_identity": "transgender cisgender nonbinary trans cis",
    "ability": "disabled deaf blind paralysed autistic",
    "origin": "african asian european american mexican arab moroccan scottish turkish latino",
    "origin_plural": "africans asians europeans americans mexicans arabs moroccans scots turks latinos",
    "colour": "black white",
    "de": "frauen männer muslime christen juden türken polen",
    "fr": "femmes hommes musulmans chrétiens juifs arabes",
    "es": "mujeres hombres musulmanes cristianos judíos árabes",
}
SWAP = {a.encode(): b.encode() for terms in IDENTITY_TERMS.values() for a, b in zip(terms.split(), terms.split()[1:] + terms.split()[:1])}
TERMS = sorted(SWAP)
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(SPACED).split())


def features_of(words: set[bytes]) -> set[bytes]:
    out = {b"w:" + w for w in words}
    for n in PREFIXES:
        out.update(b"%d:%b" % (n, w[:n]) for w in words if len(w) > n)
    return out


def swapped(words: set[bytes]) -> set[bytes]:
    return {SWAP.get(w, w) for w in words}


def counterfactuals(words: set[bytes], draw: int) -> list[tuple[set[bytes], set[bytes]]]:
    """Pairs of texts that differ in the groups they name only; ``draw`` picks the term that is put in where there is none."""
    if words & SWAP.keys():
        return [(words, swapped(words))]
    term = TERMS[draw % len(TERMS)]
    named = words | {term}
    return [(named, words | {SWAP[term]}), (named, words)]


class ToxicityModel:
    """Weights of features; ``pairs`` counterfactual pairs were seen in training, ``changed`` of them with a change of features."""

    def __init__(self, names: list[bytes], weights: np.ndarray, bias: float, pairs: int = 0, changed: int = 0):
        self.bias, self.pairs, self.changed = float(bias), pairs, changed
        self.whole = {n[2:]: float(w) for n, w in zip(names, weights) if n[:1] == b"w"}
        self.starts = {k: {n[2:]: float(w) for n, w in zip(names, weights) if n[:1] == b"%d" % k} for k in PREFIXES}

    def raw(self, words: set[bytes]) -> float:
        total = self.bias + sum(map(self.whole.__getitem__, self.whole.keys() & words))
        for k, table in self.starts.items():
            if table:
                total += sum(map(table.__getitem__, table.keys() & {w[:k] for w in words if len(w) > k}))
        return total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.raw(words_of(t)) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, change: np.ndarray, y: np.ndarray, fairness: float = FAIRNESS, ridge: float = RIDGE, steps: int = STEPS, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + fairness * mean squared change of the raw score.

    Accelerated gradient steps; ``change`` holds the features of one text of each
    counterfactual pair less those of the other, ``share`` how much each row of it
    counts in the mean (all alike by default).
    """
    n, d = x.shape
    w, b = np.zeros(d, dtype=np.float64), 0.0
    v, c = w.copy(), b
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    bound = 0.25 * weight.mean() * float((x.astype(np.float64) ** 2).sum(axis=1).mean() + 1) + ridge
    if len(change):
        change = change.astype(np.float64) * np.sqrt(share if share is not None else np.full(len(change), 1 / len(change)))[:, None]
        bound += 2 * fairness * float((change**2).sum())
    step = 1 / bound
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -40, 40)))
        r = weight * (p - y) / n
        gradient = x.T @ r.astype(np.float32) + ridge * v
        if len(change):
            gradient = gradient + 2 * fairness * (change.T @ (change @ v))
        w2, b2 = v - step * gradient, c - step * float(r.sum())
        momentum = k / (k + 3)
        v, c = w2 + momentum * (w2 - w), b2 + momentum * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(labelled: DataFrame, features: int = FEATURES, fairness: float = FAIRNESS) -> ToxicityModel:
    """Fit on ``labelled`` (text, label), which the caller has bounded."""

    def count(part: pa.RecordBatch) -> dict:
        seen, toxic = Counter(), Counter()
        for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
            own = features_of(words_of(text))
            seen.update(own)
            if label:
                toxic.update(own)
        names = list(seen)
        return {"name": pa.array(names, pa.binary()), "n": pa.array([seen[k] for k in names], pa.int64()), "t": pa.array([toxic[k] for k in names], pa.int64())}

    counts = map_rows(labelled, count, "name binary, n long, t long", rows=2000).groupBy("name").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == total:
        return ToxicityModel([], np.zeros(0), -40.0 if not toxic else 40.0)
    expected = F.col("n") * (toxic / total)
    tied = (F.col("t") - expected) ** 2 / (expected * (1 - toxic / total))
    names = [bytes(r["name"]) for r in counts.where(F.col("n") >= LEAST_DOCS).orderBy(tied.desc(), "name").limit(features).collect()]
    place = {n: k for k, n in enumerate(names)}

    def index(part: pa.RecordBatch) -> dict:
        """Features by number; of each counterfactual pair those that only the first has, and, below zero, those that only the second has."""
        own, changes = [], []
        for text in part.column("text").to_pylist():
            words = words_of(text)
            own.append(sorted(place[f] for f in place.keys() & features_of(words)))
            pairs = [(features_of(a), features_of(b)) for a, b in counterfactuals(words, zlib.crc32((text or "").encode("utf-8", "surrogatepass")))]
            changes.append([sorted([place[f] + 1 for f in place.keys() & (a - b)] + [-place[f] - 1 for f in place.keys() & (b - a)]) for a, b in pairs])
        return {"label": part.column("label"), "own": pa.array(own, pa.list_(pa.int32())), "changes": pa.array(changes, pa.list_(pa.list_(pa.int32())))}

    rows = sorted(map_rows(labelled, index, "label int, own array<int>, changes array<array<int>>").collect(), key=lambda r: (r["own"], r["label"]))
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r["own"]] = 1
    found = Counter(tuple(change) for r in rows for change in r["changes"])
    pairs, changed = sum(found.values()), sum(n for change, n in found.items() if change)
    change = np.zeros((sum(map(bool, found)), len(names)), dtype=np.float32)
    share = np.zeros(len(change))
    for k, (own, n) in enumerate(sorted((c, n) for c, n in found.items() if c)):
        share[k] = n / changed
        for f in own:
            change[k, abs(f) - 1] = np.sign(f)
    weights, bias = train(x, change, np.array([r["label"] for r in rows], dtype=np.float64), fairness, share=share)
    return ToxicityModel(names, weights, bias, pairs, changed)


def fold(column: str = "doc_id") -> F.Column:
    """The remainder that says which rows are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and label of at most ``rows`` labelled documents outside the held-out fold, written once."""
    return materialize(labelled_sample(docs, labels.where(fold() != 2), "toxic", rows).select("text", "label"), "toxicity-rows", compression="zstd")


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "score": pa.array(shared.value.scores(part.column("text").to_pylist()))}

    scored = map_rows(docs.select("doc_id", "text"), run, f"doc_id {id_type}, score double", rows=1000)
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.where(scores(F.col("text")) < threshold)
