"""A quality score by gradient-boosted trees over document statistics.

Statistics of whole texts are taken in tasks.  The trees are grown on histograms of a
bounded labelled sample, level by level, and stored as flat arrays: node ``i`` of a tree
has the children ``2 * i + 1`` and ``2 * i + 2``, so all rows walk down all trees in a few
numpy steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, raw_texts, small_batches
from needlework.llm.language import held_out

#: Shares of bytes that are counted: capital and small letters, digits, marks of prose,
#: other marks, exclamation marks, bars, white space, bytes beyond ASCII.
BYTE_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b".,;:?'\"()-",
    b"#*$%&<>@=+_/\\^~`[]{}",
    b"!",
    b"|",
    b" \t\r\n",
    bytes(range(128, 256)),
)
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "longest_word", "distinct_words", "commonest_word",
    "repeated_neighbours", "log_lines", "words_per_line", "distinct_lines", "byte_entropy",
    *[f"bytes_{i}" for i in range(len(BYTE_CLASSES))],
)


def class_matrix() -> np.ndarray:
    out = np.zeros((256, len(BYTE_CLASSES)))
    for i, members in enumerate(BYTE_CLASSES):
        out[list(members), i] = 1
    return out


CLASS_MATRIX = class_matrix()


def statistics(text: bytes) -> list[float]:
    """The numbers named in ``STATISTICS``; all are defined for an empty text."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = max(len(text), 1)
    share = counts[counts > 0] / size
    number: dict[bytes, int] = {}
    nr = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    lines = [line for line in text.split(b"\n") if line.strip()]
    commonest = np.bincount(nr).max() / n if n else 0.0
    repeated = float((nr[1:] == nr[:-1]).mean()) if n > 1 else 0.0
    return [
        np.log1p(n), np.log1p(len(text)), len(text) / max(n, 1), max(map(len, words), default=0), len(number) / max(n, 1),
        commonest, repeated, np.log1p(len(lines)), n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        float(-(share * np.log2(share)).sum()), *(counts @ CLASS_MATRIX / size),
    ]


@dataclass(frozen=True)
class Boosting:
    """rows: labelled documents in the sample, about; the rest as usual for boosted trees."""

    rows: int = 12_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    smoothing: float = 1.0
    least_weight: float = 2.0


@dataclass(frozen=True)
class Trees:
    """Per tree and inner node: which statistic, and above which value the walk turns right."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, how: Boosting) -> Trees:
    """Trees for logistic loss.  Splits are chosen from histograms of gradients."""
    inner, leaves = 2**how.depth - 1, 2**how.depth
    feature = np.zeros((how.trees, inner), dtype=np.int64)
    threshold = np.full((how.trees, inner), np.inf)
    leaf = np.zeros((how.trees, leaves))
    if not len(y):
        return Trees(feature, threshold, leaf, 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    total = np.full(len(y), base)
    for t in range(how.trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(how.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            split = np.full(width, how.bins, dtype=np.int64)
            for f in range(x.shape[1]):
                at = (node - first) * how.bins + binned[:, f]
                g = np.bincount(at, slope, width * how.bins).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(at, bend, width * how.bins).reshape(width, -1).cumsum(axis=1)
                gain = sum(a * a / (b + how.smoothing) for a, b in ((g, h), (g[:, -1:] - g, h[:, -1:] - h)))
                gain -= g[:, -1:] ** 2 / (h[:, -1:] + how.smoothing)
                gain[(h < how.least_weight) | (h[:, -1:] - h < how.least_weight)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], split[better] = value[better], top[better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = edges[f][top[better]] if len(edges[f]) else np.inf
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[t, node]] > split[node - first])
        at = node - inner
        g, h = np.bincount(at, slope, leaves), np.bincount(at, bend, leaves)
        leaf[t] = -how.rate * g / (h + how.smoothing)
        total += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` and ``stats``, an array with the statistics of the whole text."""
    wanted = docs.select(*names, "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            stats = pa.array([statistics(t) for t in raw_texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in names], stats], names=[*names, "stats"])

    return wanted.mapInArrow(run, f"{fields}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> Trees:
    """Trees for ``labels.quality``, from labelled documents that are not held out.

    About ``how.rows`` labels are taken by a hash of their id, all of them if there are
    fewer.  They are joined to the documents they name, whose statistics come to the
    driver; nothing else does.  Of labels that share an id the highest counts, of documents
    that do the one with the smallest statistics, so no id adds more than one row.
    """
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("quality"))
    share = min(1.0, how.rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row for an id, however many rows share it
    once = measured(named, ["doc_id", "quality"]).groupBy("doc_id").agg(F.min(F.struct("quality", "stats")).alias("row"))
    rows = sorted((r["doc_id"], r["row"]["quality"], r["row"]["stats"]) for r in once.collect())
    x = np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r[1] for r in rows]), how)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every document.

    A null text counts as empty, and an empty one is scored like any other; null ids stay
    null, repeated rows are scored one by one, an empty table gives no rows, and without
    labels every score is one half.  Other columns are never looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([statistics(t) for t in raw_texts(batch)])
            found = trees.scores(x)
            predicted = (found >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array(found), pa.array(predicted)],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
