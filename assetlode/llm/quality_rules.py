"""Quality rules by an isolation forest over rule statistics.

Each text gives a few counts. Two fixed rules reject on their own; for the rest an
isolation forest scores the statistics. Its random splits fall anywhere in the box
that all labelled rows span, and every good labelled row is counted in every tree,
so that a document where no good one is ends on a short path. The threshold on the
anomaly score is the exact quantile over all good rows above which at most
``good_lost`` of them fall. Statistics, counts and scores of labelled rows are
made by the tasks; only a tree's counts and those of bins of scores, of a fixed
number, reach the driver. One more pass over all texts counts, scores and decides.

Defined results: a null text has no words and fails the base rules, as an empty
one does; without labelled rows only the base rules decide; repeated rows are
judged each, and each counts in the forest; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import longs, map_rows
from assetlode.plans.staging import discard, materialize

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent
WHITE_SPACE = " \t\n\x0b\x0c\r"

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TREES, DEPTH, SEED = 100, 8, 3
GOOD_LOST = 0.001
#: Bins in which scores are counted at a time.
BINS = 4_096
FEATURES = ["f0", "f1", "f2", "f3"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that are in a window of three words found twice or more, the first one's included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).astype(np.uint64)
    keys = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    found = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = twice[found] == keys
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of the rules, and the forest's features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    word_bytes = sum(map(len, words))
    word_chars = len(text) - (size - word_bytes)
    symbols = size - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE_SPACE):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    upper = size - len(raw.translate(None, UPPER))
    lower = size - len(raw.translate(None, LOWER))
    marks = raw.count(b"!") + raw.count(b"?")
    features = [
        min(1.0, symbols / max(n, 1)) ** 0.5,
        min(1.0, marks / max(n, 1)) ** 0.5,
        upper / max(upper + lower, 1),
        (repeat / max(n, 1)) ** 0.5,
    ]
    return [n, word_chars, symbols, dup, repeat], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


# The forest


def mean_depth(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits of a box, node ``k`` above ``2k + 1`` and ``2k + 2``; ``fill`` gives them the paths that rows make."""

    def __init__(self, low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.nodes, self.size = depth, (2 << depth) - 1, 0
        self.feature, self.at = np.full((trees, self.nodes), -1), np.zeros((trees, self.nodes))
        self.path = np.zeros((trees, self.nodes))
        for t in range(trees):
            boxes = {0: (low, high)}
            for k in range((1 << depth) - 1):
                if k not in boxes:
                    continue
                low_, high_ = boxes.pop(k)
                free = np.flatnonzero(high_ > low_)
                if len(free):
                    f = int(rng.choice(free))
                    at = float(rng.uniform(low_[f], high_[f]))
                    self.feature[t, k], self.at[t, k] = f, at
                    below, above = high_.copy(), low_.copy()
                    below[f] = above[f] = at
                    boxes[2 * k + 1], boxes[2 * k + 2] = (low_, below), (above, high_)

    def leaves(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """The node at which each row ends."""
        feature, at = self.feature[tree], self.at[tree]
        node, every = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            f = feature[node]
            right = rows[every, np.maximum(f, 0)] > at[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Rows that end at each node of each tree."""
        return np.array([np.bincount(self.leaves(rows, t), minlength=self.nodes) for t in range(len(self.path))])

    def fill(self, counts: np.ndarray) -> IsolationForest:
        """The paths of trees that hold the counted rows: a path ends at the first node without any."""
        mass = counts.astype(np.int64)
        for k in range((1 << self.depth) - 2, -1, -1):
            mass[:, k] += mass[:, 2 * k + 1] + mass[:, 2 * k + 2]
        self.size = int(mass[0, 0])
        ended = np.full(mass.shape, -1)
        for k in range(self.nodes):
            level = (k + 1).bit_length() - 1
            above = ended[:, (k - 1) // 2] if k else ended[:, 0]
            ended[:, k] = np.where(above >= 0, above, np.where(mass[:, k] == 0, level, -1))
            self.path[:, k] = np.where(ended[:, k] >= 0, ended[:, k], level + np.array([mean_depth(n) for n in mass[:, k].tolist()]))
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0 to 1; short paths score high."""
        total = np.zeros(len(rows))
        for t in range(len(self.path)):
            total += self.path[t, self.leaves(rows, t)]
        return 2.0 ** (-total / len(self.path) / max(mean_depth(self.size), 1.0))


class QualityModel:
    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def keeps(self, counts: np.ndarray, features: np.ndarray) -> np.ndarray:
        kept = ~base_failed(counts)
        if self.forest and len(features):
            kept &= self.forest.score(features) <= self.threshold
        return kept

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, base_failed and kept of each text."""
        made = [statistics(t or "") for t in texts]
        counts = np.array([m[0] for m in made], dtype=np.int64).reshape(len(made), len(COUNTS))
        features = np.array([m[1] for m in made]).reshape(len(made), -1)
        return counts, base_failed(counts), self.keeps(counts, features)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents, those with the least checksums of their ids.

    Of rows that share a labelled doc_id one text is taken, the greatest, so that repeated ids don't exceed the bound.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    some = some.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # at most ``rows`` rows
    return found.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def nth_least(values: DataFrame, column: str, n: int) -> float:
    """The ``n``-th least value, exactly: counts in ever narrower bins, of which a fixed number reaches the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        place = F.least(F.floor((F.col(column) - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = values.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)), F.min(column), F.max(column))
        for _, rows, low, high in sorted(map(tuple, bins.collect())):
            if n <= rows:
                break
            n -= rows
    return float(low)


def matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(f).to_numpy() for f in FEATURES], axis=1)


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """good and the features of every row with a label that passes the base rules, once for each label its doc_id has."""
    id_type = dict(docs.dtypes)["doc_id"]

    def measure(part: pa.RecordBatch) -> dict:
        made = [statistics(t or "") for t in part.column("text").to_pylist()]
        passed = np.flatnonzero(~base_failed(np.array([m[0] for m in made])))
        return {"doc_id": part.column("doc_id").take(longs(passed))} | {c: pa.array([made[k][1][i] for k in passed], pa.float64()) for i, c in enumerate(FEATURES)}

    # Numbers are shuffled by doc_id, not texts.
    measured = map_rows(docs.select("doc_id", "text").where("doc_id is not null"), measure, f"doc_id {id_type}, " + ", ".join(f"{f} double" for f in FEATURES))
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    return measured.join(some, "doc_id").select((F.col("label") == 1).alias("good"), *FEATURES)


def fit(docs: DataFrame, labels: DataFrame, good_lost: float = GOOD_LOST) -> QualityModel:
    """Grow and calibrate on all labelled rows."""
    known = materialize(labelled_statistics(docs, labels), "labelled-statistics")
    seen = known.agg(F.count(F.lit(1)), F.count_if("good"), *[F.min(f) for f in FEATURES], *[F.max(f) for f in FEATURES]).first()
    rows, n_good = seen[0], seen[1]
    if rows < 2 or not n_good:
        discard(known)
        return QualityModel(None, 1.0)
    forest = IsolationForest(np.array(seen[2 : 2 + len(FEATURES)]), np.array(seen[2 + len(FEATURES) :]))
    good = known.where("good").select(*FEATURES)

    def count(batches):
        total = np.zeros(forest.path.shape, dtype=np.int64)
        for part in batches:
            total += forest.counts(matrix(part))
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([longs(some), longs(flat[some])], names=["node", "n"])

    mass = np.zeros(forest.path.size, dtype=np.int64)
    for node, n in good.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n")).collect():  # at most a row for each node
        mass[node] = n
    forest.fill(mass.reshape(forest.path.shape))

    scores = materialize(map_rows(good, lambda part: {"score": pa.array(forest.score(matrix(part)))}, "score double", rows=10_000), "quality-scores")
    threshold = nth_least(scores, "score", max(1, int(np.ceil(n_good * (1 - good_lost)))))
    discard(known, scores)
    return QualityModel(forest, threshold)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(part: pa.RecordBatch) -> dict:
        counts, failed, kept = shared.value.judge(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id")} | {c: longs(counts[:, k]) for k, c in enumerate(COUNTS)} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return map_rows(docs.select("doc_id", "text"), run, schema, rows=1000)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.judge(texts.tolist())[2])

    return docs.where(kept(F.col("text")))
