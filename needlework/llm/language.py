"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths slide over fixed-length windows, each
filter's largest response is kept and a softmax turns these into probabilities.  The
network is trained in numpy on a bounded sample of labelled windows.  A text is cut into
windows from its first to its last byte; its prediction is the mean over all of them,
weighted by their bytes.

For prediction the embedding and the filters are multiplied out into one table per pair
of neighbouring bytes, so that a filter's response is a sum of two table rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, raw_texts, small_batches

UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Shape:
    """window: bytes; widths: of the filters, 2 to 4; filters: of each width; depth: of the embedding."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 10
    depth: int = 8


@dataclass(frozen=True)
class Training:
    """rows: labelled documents per language in the sample, about; windows: most per document."""

    rows: int = 1200
    windows: int = 3
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """languages, embedding (256, depth), filters by width (width, depth, filters), bias, output layer."""

    shape: Shape
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(shape: Shape, languages: list[str], seed: int) -> Network:
        random = np.random.default_rng(seed)
        size = len(shape.widths) * shape.filters
        weights = {"embed": random.normal(0, 0.5, (256, shape.depth))}
        for w in shape.widths:
            weights[f"conv{w}"] = random.normal(0, 1 / np.sqrt(w * shape.depth), (w, shape.depth, shape.filters))
        weights["bias"] = np.zeros(size)
        weights["out"] = random.normal(0, 1 / np.sqrt(size), (size, len(languages)))
        weights["base"] = np.zeros(len(languages))
        return Network(shape, languages, {k: v.astype(np.float32) for k, v in weights.items()})


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def responses(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each window, and where it begins."""
    best, place = [], []
    data = net.weights["embed"][windows]
    for w in net.shape.widths:
        conv = net.weights[f"conv{w}"]
        out = data[:, : windows.shape[1] - w + 1] @ conv[0]
        for k in range(1, w):
            out += data[:, k : windows.shape[1] - w + 1 + k] @ conv[k]
        at = out.argmax(axis=1)
        place.append(at)
        best.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0])
    return np.concatenate(best, axis=1), np.concatenate(place, axis=1)


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy.  Only the places of the largest responses take part."""
    p, shape = net.weights, net.shape
    best, place = responses(net, windows)
    hidden = np.maximum(best + p["bias"], 0)
    error = softmax(hidden @ p["out"] + p["base"])
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    down = (error @ p["out"].T) * (hidden > 0)
    grads = {"out": hidden.T @ error, "base": error.sum(axis=0), "bias": down.sum(axis=0)}
    grads["embed"] = np.zeros_like(p["embed"])
    rows = np.arange(len(windows))[:, None]
    for i, w in enumerate(shape.widths):
        part = slice(i * shape.filters, (i + 1) * shape.filters)
        conv, part_down, at = p[f"conv{w}"], down[:, part], place[:, part]
        grad = np.empty_like(conv)
        for k in range(w):
            seen = windows[rows, at + k]
            grad[k] = np.einsum("nf,nfd->df", part_down, p["embed"][seen])
            np.add.at(grads["embed"], seen, part_down[:, :, None] * conv[k].T[None])
        grads[f"conv{w}"] = grad
    return grads


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], shape: Shape, how: Training) -> Network:
    """Adam over shuffled batches; the same windows in the same order give the same network."""
    net = Network.fresh(shape, languages, how.seed)
    random = np.random.default_rng(how.seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps, total = 0, how.epochs * -(-len(windows) // how.batch)
    for _ in range(how.epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(order), how.batch):
            chosen = order[at : at + how.batch]
            steps += 1
            rate = how.rate * (1 - steps / (total + 1))
            for k, g in gradients(net, windows[chosen], labels[chosen]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-7)
                net.weights[k] = (net.weights[k] - rate * step).astype(np.float32)
    return net


class Tables:
    """A network multiplied out: responses by pairs of bytes at a place and two places on."""

    CHUNK = 48

    def __init__(self, net: Network):
        p, shape = net.weights, net.shape
        self.net, near, far = net, [], []
        zero = np.zeros((256, 256, shape.filters), dtype=np.float32)
        for w in shape.widths:
            by_byte = [p["embed"] @ p[f"conv{w}"][k] for k in range(w)] + [np.zeros((256, shape.filters), np.float32)] * 4
            near.append(by_byte[0][:, None] + by_byte[1][None] + zero)
            if w > 2:
                far.append(by_byte[2][:, None] + by_byte[3][None] + zero)
        self.near = np.concatenate(near, axis=2).reshape(65536, -1)
        self.far = np.concatenate(far, axis=2).reshape(65536, -1) if far else None
        self.short = shape.filters * (len(shape.widths) - len(far))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Per window; windows are padded with zero bytes, which get no response of their own."""
        p = self.net.weights
        best = np.empty((len(windows), self.near.shape[1]), dtype=np.float32)
        last = windows.shape[1] - max(self.net.shape.widths) + 1
        for at in range(0, len(windows), self.CHUNK):
            part = windows[at : at + self.CHUNK].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            out = self.near[pairs[:, :last]]
            if self.far is not None:
                out[:, :, self.short :] += self.far[pairs[:, 2 : last + 2]]
            best[at : at + self.CHUNK] = out.max(axis=1)
        return softmax(np.maximum(best + p["bias"], 0) @ p["out"] + p["base"])


def cut_windows(text: bytes, size: int) -> np.ndarray:
    """All bytes of a text in rows of ``size``, the last one padded with spaces."""
    n = max(1, -(-len(text) // size))
    return np.frombuffer(text.lower().ljust(n * size, b" "), dtype=np.uint8).reshape(n, size)


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")


def sample_windows(docs: DataFrame, shape: Shape, how: Training) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about ``how.rows`` labelled documents per language, the rarest kept whole.

    Documents are chosen by a hash of id and text, windows at seeded places, so the sample
    does not depend on the partitions.  Equal windows of equal rows count once.  It is
    bounded by languages x rows x windows.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, how.rows / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return np.zeros((0, shape.window), np.uint8), np.zeros(0, int), []
    wanted = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])[F.col("lang")]
    chosen = known.where(F.pmod(F.xxhash64(F.lit(how.seed), "doc_id", "text"), F.lit(1 << 20)) < wanted * (1 << 20))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = zip(column(batch, "doc_id").to_pylist(), column(batch, "lang").to_pylist(), raw_texts(batch), strict=True)
            found = []
            for doc_id, lang, text in rows:
                if has_letter(text):
                    windows = cut_windows(text, shape.window)
                    random = np.random.default_rng((doc_id or 0) % (1 << 32))
                    for at in random.permutation(len(windows))[: how.windows]:
                        found.append((doc_id, int(at), lang, windows[at].tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                    names=["doc_id", "at", "lang", "window"],
                )

    windows = chosen.select("doc_id", "lang", "text").mapInArrow(cut, "doc_id bigint, at bigint, lang string, window binary")
    rows = windows.distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["at"], bytes(r["window"]), r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), dtype=np.uint8).reshape(-1, shape.window)
    return windows, np.array([languages.index(r["lang"]) for r in rows], dtype=int), languages


def fit(docs: DataFrame, shape: Shape = Shape(), how: Training = Training()) -> Network:
    """A network for the ``lang`` values of the documents that are not held out."""
    windows, labels, languages = sample_windows(docs, shape, how)
    return train(windows, labels, languages, shape, how)


@lru_cache(maxsize=2)
def tables_of(key: bytes) -> Tables:
    import pickle

    return Tables(pickle.loads(key))


def predicted(texts: list[bytes], tables: Tables) -> tuple[list[str], list[float]]:
    """Language and mean probability of each whole text."""
    net, size = tables.net, tables.net.shape.window
    known = [bool(net.languages) and has_letter(t) for t in texts]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, k in enumerate(known) if k]
    if not rows:
        return langs, scores
    cut = [cut_windows(texts[i], size) for i in rows]
    counts = np.array([len(c) for c in cut])
    found = tables.probabilities(np.concatenate(cut)).astype(np.float64)
    starts = np.cumsum(counts) - counts
    # a document's last window counts by the bytes it holds
    weight = np.ones(len(found))
    weight[starts + counts - 1] = np.array([len(texts[i]) - (n - 1) * size for i, n in zip(rows, counts, strict=True)]) / size
    mean = np.add.reduceat(found * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
    for i, row in zip(rows, mean, strict=True):
        langs[i], scores[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
    return langs, scores


def identify(docs: DataFrame, net: Network, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score per document, or with ``keep`` all its columns as well.

    A null text, or one without letters, is ``und`` with score 0, and so is every text if
    nothing was labelled.  Null ids stay null, repeated rows are judged one by one, an
    empty table gives no rows, and ``lang`` and ``source`` are never looked at.
    """
    import pickle

    key = pickle.dumps(net)
    source = docs if keep else docs.select("doc_id", "text")
    kept = source.columns if keep else ["doc_id"]
    schema = source.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(key)
        for batch in small_batches(batches):
            langs, scores = predicted(raw_texts(batch), tables)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"]
            )

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, net: Network, above: float = 0.04) -> DataFrame:
    """The documents whose language is known: not ``und``, and with a score above even odds.

    A score counts as above them if it makes up at least the share ``above`` of the way from
    one in the number of languages to one.  With a single language only texts without a
    letter go; if nothing was labelled, all do.  Nulls, repeated rows and empty tables are
    as with ``identify``; ``lang`` stays as it came and the columns are those of ``docs``.
    """
    even = 1 / max(1, len(net.languages))
    least = even + above * (1 - even)
    names = docs.columns
    judged = docs.toDF(*[f"c{i}" if n not in ("doc_id", "text") else n for i, n in enumerate(names)])
    kept = identify(judged, net, keep=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*names)
