"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators of byte 4-grams and of back-reference n-grams (a run of 3 or 5 words with each word replaced by the
place of its first occurrence in the run), hashed to ``DIM`` places.  Each is scaled by its class log-count ratio, rows are
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.  Two-fold decision values of
the training rows give the logistic map to a probability.

The fit uses at most ``max_rows`` labelled rows in hash order, so what reaches the driver is bounded; every document is
scored, whole, and repeated rows one by one.  Null and empty texts have no features and score what the bias gives; an empty
table gives an empty result; columns beside doc_id and text are passed on or left alone, whatever their names.  Without labels of
both classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark.llm import _text

DIM = 1 << 18
MAX_ROWS = 4000


def training_ids(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, y: labelled rows outside the held-out fold (crc32 of the id as text, mod 5, is not 0), one for each id."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 0))
    some = some.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def examples(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, y, text of at most ``max_rows`` training rows: of a repeated id the text with the smallest hash."""
    some = docs.select("doc_id", "text").join(F.broadcast(training_ids(labels, label, max_rows)), "doc_id")
    one = some.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_first"))
    return one.select("doc_id", "y", "_first.text")


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct feature places of each row of a slice."""
    n = len(data)
    grams = np.zeros(0, np.int32)
    if n > 3:
        x = data.astype(np.uint32)
        x = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
        grams = ((x * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int32)
    w = _text.Words(data, offsets)
    codes = w.hashes()
    shapes = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for k in (3, 5):
        m = len(codes) - k + 1
        if m <= 0:
            continue
        shape = np.zeros(m, np.int64)
        for i in range(1, k):
            place = np.full(m, i, np.int64)
            for j in range(i - 1, -1, -1):
                place[codes[i : i + m] == codes[j : j + m]] = j
            shape = shape * k + place
        at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 : k - 1 + m])
        shapes.append((w.doc[at], (_text.mix(shape[at].astype(np.uint64) + np.uint64(k << 40)) % np.uint64(DIM)).astype(np.int32)))
    doc = np.concatenate([a for a, _ in shapes])
    place = np.concatenate([b for _, b in shapes])
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    at = np.searchsorted(doc, np.arange(len(offsets)))
    mark, out = np.zeros(DIM, np.int32), []
    for i in range(len(offsets) - 1):
        mine = np.concatenate((grams[offsets[i] : max(offsets[i], offsets[i + 1] - 3)], place[at[i] : at[i + 1]]))
        number = np.arange(len(mine), dtype=np.int32)
        mark[mine] = number  # the last of equal ones stays
        out.append(mine[mark[mine] == number])
    return out


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(DIM), np.ones(DIM)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss support vector machine over unit rows r[x] / |r[x]|."""
    w, alpha, rng = np.zeros(DIM + 1), np.zeros(len(rows)), np.random.default_rng(0)
    scale = [1 / max(np.sqrt((r[x] ** 2).sum()), 1e-12) for x in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            x, s = rows[i], sign[i]
            z = r[x] * scale[i]
            g = s * (w[x] @ z + w[DIM]) - 1
            new = min(max(alpha[i] - g / (2.0 if len(x) else 1.0), 0.0), c)
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * s * z
                w[DIM] += (new - alpha[i]) * s
                alpha[i] = new
    return w


def decide(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([(w[x] * r[x]).sum() / max(np.sqrt((r[x] ** 2).sum()), 1e-12) + w[DIM] for x in rows])


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a f + b))) with smoothed targets, by damped Newton steps; a is at least 0."""
    n1 = float((y > 0).sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(a, b):
        z = a * f + b
        return float(np.sum(np.logaddexp(0, z) - t * z)) + 1e-6 * a * a

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -500, 500)))
        d, v = p - t, p * (1 - p) + 1e-9
        grad = np.array([(d * f).sum() + 2e-6 * a, d.sum()])
        hess = np.array([[(v * f * f).sum() + 2e-6, (v * f).sum()], [(v * f).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """Model: ratio-scaled weights, squared ratios, bias and the logistic map."""

    def take(batches):
        for batch in batches:
            found = [x for _, _, data, offsets in _text.slices(batch.column(2)) for x in features(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([np.sort(x).tobytes() for x in found], pa.binary())], ["doc_id", "y", "x"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = examples(docs, labels, label, max_rows).mapInArrow(take, f"doc_id {kind}, y int, x binary").collect()
    got.sort(key=lambda g: (g["doc_id"], bytes(g["x"])))
    y = np.array([g["y"] for g in got], np.int64)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return {"w": np.zeros(DIM, np.float32), "rr": np.zeros(DIM, np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log((p + 1e-9) / (1 - p + 1e-9)))}
    x = [np.frombuffer(g["x"], np.int32) for g in got]
    fold, f = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        mine = np.flatnonzero(fold != k)
        if y[mine].min() == y[mine].max():
            mine = np.arange(len(y))
        part = [x[i] for i in mine]
        r = log_count_ratios(part, y[mine])
        other = np.flatnonzero(fold == k)
        f[other] = decide([x[i] for i in other], r, descend(part, y[mine], r))
    a, b = logistic(f, y)
    r = log_count_ratios(x, y)
    w = descend(x, y, r)
    return {"w": (w[:DIM] * r).astype(np.float32), "rr": (r * r).astype(np.float32), "bias": float(w[DIM]), "a": a, "b": b}


def _scorer(docs: DataFrame, labels: DataFrame, label: str, max_rows: int):
    """A function that scores a text column."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, max_rows))

    def scores(column) -> np.ndarray:
        m, out = model.value, []
        for _, _, data, offsets in _text.slices(column):
            for x in features(data, offsets):
                out.append(m["w"][x].sum(dtype=np.float64) / max(np.sqrt(m["rr"][x].sum(dtype=np.float64)), 1e-12) + m["bias"])
        z = m["a"] * np.array(out) + m["b"]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return scores


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows whose score reaches ``threshold``, with their own columns alone (whatever their names)."""
    scores, at = _scorer(docs, labels, label, max_rows), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scores = _scorer(docs, labels, label, max_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = scores(batch.column(1))
            arrays = [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
