"""Document quality from lines: a linear-chain CRF labels each line good or bad, its marginals add up by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import slices

#: The bounded sample: labelled rows, whole, and their lines together, at most. A row that would go beyond the lines is left out.
DOCS, FIT_LINES = 3000, 200_000
#: Lines of a chain that the CRF is fitted on; longer documents give several.
LINES = 200
THRESHOLD = 0.7
#: Byte classes; bytes of 128 and more count as letters.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?", b"!", b"\"'()[]{}/\\=+-_~^`@")
BLANK = b" \t\n\x0b\f\r"
LUT = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    LUT[np.frombuffer(_chars, np.uint8)] = _k


#: Features of a line without those of its neighbours.
OWN = len(CLASSES) + 7


def _beside(own: np.ndarray) -> np.ndarray:
    """The lines' own features with those of both neighbours."""
    zero = np.zeros((1, own.shape[1]), np.float32)
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


def line_features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the features (line, feature) of its \\n-split lines, with those of both neighbours, and the lines' bytes.

    Own features: share of each byte class, length, words, mean word length, share of distinct words, whether the same line
    came before. An empty text is one empty line.
    """
    split = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lines = [line for own in split for line in own]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    classes = LUT[data]
    out = np.zeros((len(lines), OWN), np.float32)
    for k in range(len(CLASSES)):
        out[:, k] = np.add.reduceat(classes == k, starts, dtype=np.int64) / np.maximum(sizes, 1)
    k = len(CLASSES)
    for i, line in enumerate(lines):
        words = line.split()
        if n := len(words):
            out[i, k] = np.log1p(n)
            out[i, k + 1] = len(set(words)) / n
            out[i, k + 2] = len(line) / n / 10
    out[:, k + 3] = sizes == 0
    out[:, k + 4] = np.log1p(sizes) / 5
    at = 0
    for own in split:
        seen: set[bytes] = set()
        for i, line in enumerate(own):
            out[at + i, k + 5] = bool(line) and line in seen
            seen.add(line)
        at += len(own)
    out[:, k + 6] = 1
    features, weights = [], []
    at = 0
    for n in counts.tolist():
        features.append(_beside(out[at : at + n]))
        weights.append(sizes[at : at + n])
        at += n
    return features, weights


class Model:
    """CRF weights, label 1 is bad, and the logistic curve from a document's bad share to its score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: np.ndarray):
        self.weights, self.trans, self.curve = weights, trans, curve

    def bad_lines(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """P(bad) of each line, documents of like length together."""
        out: list = [None] * len(features)
        order = sorted(range(len(features)), key=lambda i: len(features[i]))
        at = 0
        while at < len(order):
            longest = len(features[order[min(at + 255, len(order) - 1)]])
            take = max(1, min(256, 400_000 // max(1, longest)))
            part = order[at : at + take]
            scores, lengths = crf.padded([features[i] @ self.weights for i in part])
            marginals, _ = crf.forward_backward(scores.astype(np.float64), self.trans, lengths)
            for row, i in enumerate(part):
                out[i] = marginals[row, : lengths[row], 1]
            at += take
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        features, weights = line_features(texts)
        return _curve(bad_share(self.bad_lines(features), weights), self.curve)


def bad_share(bad: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean of the lines' P(bad), and the share of lines with it above a half, by length."""
    return np.array([[float(b @ (w + 1) / (w + 1).sum()), float((b > 0.5) @ (w + 1) / (w + 1).sum())] for b, w in zip(bad, weights, strict=True)]).reshape(-1, 2)


def _curve(shares: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(curve[0] + shares @ curve[1:])))


def fit_model(features: list[np.ndarray], weights: list[np.ndarray], good: np.ndarray) -> Model:
    """Fit line_features() to whole-document labels: lines start with their document's label; then lines of bad documents that the CRF finds good
    are taken as good, but for the worst line of each, and it is fitted again."""
    if not len(features) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
        return Model(np.zeros((3 * OWN, 2)), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    chains = lambda rows: [x[at : at + LINES] for x in rows for at in range(0, len(x), LINES)]
    labels = [np.full(len(f), int(not g)) for f, g in zip(features, good, strict=True)]
    for step in range(2):
        model = Model(*crf.fit(chains(features), chains(labels), 2, rounds=60, rate=0.2), np.zeros(3))
        bad = model.bad_lines(features)
        if step == 0:
            labels = [np.where((b > min(0.5, b.max() - 1e-9)), 1, 0) if not g else y for b, g, y in zip(bad, good, labels, strict=True)]
    x, y = bad_share(bad, weights), good.astype(float)
    curve = np.zeros(3)
    full = np.hstack([np.ones((len(x), 1)), x])
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-full @ curve))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.eye(3), full.T @ (y - p) - curve)
        curve += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.trans, curve)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        features, weights = line_features(batch.column(1).to_pylist())
        blobs = [pa.array([x.tobytes() for x in own], pa.binary()) for own in ([f[:, :OWN] for f in features], weights)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *blobs], ["doc_id", "good", "own", "sizes"])


def _sample(labelled: DataFrame, at_most: int, lines: int) -> list[tuple[int, int]]:
    """(id, hash of the text) of the rows of labelled (id, text_hash, lines) to fit on, in the order of their ids' hashes."""
    rows = labelled.groupBy("id", "text_hash").agg(F.max("lines").alias("lines")).orderBy(F.xxhash64("id"), "id", "text_hash").limit(at_most).collect()
    out, left = [], lines
    for r in sorted(rows, key=lambda r: (r["id"], r["text_hash"])):
        if r["lines"] <= left:
            left -= r["lines"]
            out.append((r["id"], r["text_hash"]))
    return out


def train(docs: DataFrame, labels: DataFrame, at_most: int = DOCS, lines: int = FIT_LINES) -> Model:
    """Fit on `at_most` labelled rows with `lines` lines together at most, those whose id hashes lowest; labels has doc_id and quality (1 good, 0 bad).

    A row counts once however often it is repeated; of an id with two texts each is a row; of an id with two labels the good one holds. Null
    ids and labels are left out, null texts are empty. The bounds hold before anything comes to the driver: it gets ids, then the lines'
    features of the sample, never texts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(at_most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).join(F.broadcast(chosen), "id")
    picked = _sample(own.select("id", "text_hash", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines")), at_most, lines)
    if not picked:
        return fit_model([], [], np.zeros(0, bool))
    table = docs.sparkSession.createDataFrame(picked, "id long, text_hash long")
    rows = own.join(F.broadcast(table), ["id", "text_hash"], "left_semi").groupBy("id", "text_hash").agg(F.max("text").alias("text"), F.max("good").alias("good"))
    rows = rows.select(F.col("id").alias("doc_id"), "text", "good").mapInArrow(_featured, "doc_id long, good boolean, own binary, sizes binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["sizes"], r["own"]))
    features = [_beside(np.frombuffer(r["own"], np.float32).reshape(-1, OWN)) for r in rows]
    return fit_model(features, [np.frombuffer(r["sizes"], np.int64) for r in rows], np.array([r["good"] for r in rows], bool))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = shared.value.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is better) for each row of docs, from its whole text alone.

    A null text counts as empty, which is one empty line. Repeated rows stay repeated and score alike, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scored(shared), "doc_id long, score double")
