"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 6000
ROUNDS = 250
STEP = 0.05
DECAY = 1e-4
TRAIN_SEED = 11

_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
_SYMBOLS = frozenset("#*$%&|<>")
_STOPS = tuple(".,;:?!")
OWN_FEATURES = 16
FEATURES = 3 * OWN_FEATURES + 2


def line_features(line: str) -> list[float]:
    """What one line shows by itself."""
    words = [w for w in _SPACES.split(line) if w]
    n, chars = len(words), len(line)
    if not n:
        return [1.0] + [0.0] * (OWN_FEATURES - 1)
    letters = sum(map(str.isalpha, line)) or 1
    capitals = sum(map(str.isupper, line))
    symbols = sum(map(line.count, _SYMBOLS))
    lowered = [w.lower() for w in words]
    return [
        0.0,
        np.log1p(n),
        min(chars / n, 40.0) / 10,
        capitals / letters,
        sum(map(str.istitle, words)) / n,
        min(symbols / n, 3.0),
        line.count("|") / n,
        line.count("!!") / n,
        sum(map(str.isdigit, line)) / chars,
        letters / chars,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / n,
        len(set(lowered)) / n,
        float(line.rstrip().endswith(_STOPS)),
        sum(w.endswith(_STOPS) for w in words) / n,
        float(n < 4),
        float("<" in line or "{" in line or "://" in line),
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, and the lengths of the lines.

    An empty or null text is one empty line. A line counts at least one
    character, so that documents of empty lines have a score too.
    """
    lines = (text or "").split("\n")
    own = np.array([line_features(x) for x in lines], np.float32)
    edge = np.zeros((1, OWN_FEATURES), np.float32)
    ends = np.zeros((len(lines), 2), np.float32)
    ends[0, 0] = ends[-1, 1] = 1
    rows = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), ends])
    return rows, np.array([max(len(x), 1) for x in lines], float)


@dataclass
class Chain:
    """Weights of a two-state chain: features and bias of state good against bad, and moves between states."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights + self.bias


def marginals(evidence: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for padded chains: P(good) of each line, expected moves and log partition of each chain.

    ``evidence`` is chains by lines; what lies beyond a chain's length is ignored.
    Messages are scaled to sum to one at each line, so long chains stay finite.
    """
    b, t = evidence.shape
    top = np.maximum(evidence, 0)
    local = np.stack([np.exp(-top), np.exp(evidence - top)], axis=-1)
    step = np.exp(moves)
    forward, backward, norm = np.empty((b, t, 2)), np.ones((b, t, 2)), np.ones((b, t))
    live = np.arange(t)[None, :] < lengths[:, None]
    for i in range(t):
        a = local[:, i] if i == 0 else (forward[:, i - 1] @ step) * local[:, i]
        norm[:, i] = a.sum(axis=1)
        forward[:, i] = a / norm[:, i : i + 1]
    for i in range(t - 2, -1, -1):
        m = (local[:, i + 1] * backward[:, i + 1]) @ step.T
        backward[:, i] = np.where(live[:, i + 1 : i + 2], m / m.sum(axis=1, keepdims=True), 1.0)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    pairs = forward[:, :-1, :, None] * step * (local * backward)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    pairs *= live[:, 1:, None, None]
    log_z = ((np.log(norm) + top) * live).sum(axis=1)
    return both[:, :, 1] * live, pairs.sum(axis=1), log_z


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> Chain:
    """Maximum likelihood by Adam; every line of a document has the document's label.

    Chains count alike whatever their length, so that long documents don't rule.
    Chains of similar length are run together, so that padding stays small.
    """
    documents = sorted(documents, key=lambda d: len(d[0]))
    rows = np.vstack([d[0] for d in documents]) if documents else np.zeros((1, FEATURES), np.float32)
    mean, scale = rows.mean(axis=0, dtype=float), rows.std(axis=0, dtype=float) + 1e-3
    chain = Chain(np.zeros(rows.shape[1]), 0.0, np.zeros((2, 2)), mean, scale)
    batches = []
    for i in range(0, len(documents), 256):
        part = documents[i : i + 256]
        n = np.array([len(d[0]) for d in part])
        x = np.zeros((len(part), n.max(), rows.shape[1]))
        for k, (f, _) in enumerate(part):
            x[k, : len(f)] = (f - mean) / scale
        y = np.array([d[1] for d in part], float)[:, None] * (np.arange(n.max())[None, :] < n[:, None])
        batches.append((x, y, n))
    moment, square = np.zeros(rows.shape[1] + 5), np.zeros(rows.shape[1] + 5)
    for r in range(1, rounds + 1) if documents else ():
        slope = np.zeros_like(moment)
        for x, y, n in batches:
            good, moved, _ = marginals(x @ chain.weights + chain.bias, n, chain.moves)
            off = (good - y) / n[:, None]
            slope[:-5] += np.einsum("bt,btf->f", off, x)
            slope[-5] += off.sum()
            label = y[:, 0].astype(int)
            moved[np.arange(len(n)), label, label] -= n - 1
            slope[-4:] += (moved / n[:, None, None]).sum(axis=0).ravel()
        slope /= len(documents)
        slope[:-5] += DECAY * chain.weights
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        change = STEP * (moment / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
        chain.weights -= change[:-5]
        chain.bias -= change[-5]
        chain.moves = np.clip(chain.moves - change[-4:].reshape(2, 2), -3, 3)
    return chain


def document_score(text: str | None, chain: Chain) -> float:
    """Mean of the lines' P(good), each weighted by its length."""
    rows, chars = document_features(text)
    good, _, _ = marginals(chain.evidence(rows)[None, :], np.array([len(rows)]), chain.moves)
    return float(np.clip(np.average(good[0], weights=chars), 0.0, 1.0))


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [document_features(t)[0].ravel() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["label", "rows"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = TRAIN_DOCS,
) -> Chain:
    """Fits the chain on at most ``max_docs`` labelled rows, taken in the order of a hash of their ids.

    Only their ids, labels and line features reach the driver. The chosen ids are
    broadcast, as their number is bounded. Rows whose label is neither 0 nor 1 and null
    ids are no training rows. Without any training row every score is 0.5.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(TRAIN_SEED), "_id"), "_id", "label")
        .limit(max_docs)
    )
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("label", "text")
    found = joined.mapInArrow(_described, "label int, rows array<float>").collect()
    return fit([(np.array(r.rows, np.float32).reshape(-1, FEATURES), r.label) for r in found])


def classify(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, from its text alone.

    Null and empty texts are one empty line. Rows are scored one by one; other columns
    stay, and one named ``out_col`` is replaced. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([document_score(t, shared.value) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out_col, F.arrow_udf(score, "double").asNondeterministic()(F.col(text_col).cast("string")))
