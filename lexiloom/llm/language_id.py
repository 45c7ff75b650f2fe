"""Operator 1: language ID by a byte convolutional network (numpy).

Fixed windows of ``WINDOW`` bytes are embedded byte by byte, run through filters of
several widths, max-pooled over the window and classified by a softmax. A text's
windows cover it whole; their probabilities, weighted by the bytes they hold, are
averaged, and the best language is the prediction.

Training takes a bounded sample of labelled rows (``docs_per_language`` documents a
language by hash of id and text, repeated ones once, ``windows_per_doc`` windows spread over
each text), so what reaches the driver does not grow with the corpus. Rows whose
``crc32(doc_id as text) mod 5`` is 0 are held out. Only bytes are inputs.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so
is all text when there is nothing to learn from; a null doc_id is not held out and
not learnt from; repeated rows give repeated results; an empty table gives no rows;
columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lexiloom.llm.common import map_batches, python_batches, release, spread, table, unused

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
FOLDS = 5
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
EPOCHS = 6
BATCH = 128
RATE = 0.004
UND = "und"
#: Windows classified at once.
CHUNK = 256
#: Below this score the pipeline rejects a document.
MIN_SCORE = 0.4


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros (at least one)."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNet:
    """Embedding, convolutions of several widths, ReLU, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((wide * EMBED, total), np.float32)  # narrow filters are wide ones with zeros
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.2, (total, len(classes))).astype(np.float32),
            "base": np.zeros(len(classes), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, wide * EMBED): the embedded bytes each filter sees, without copying."""
        e = np.ascontiguousarray(self.p["embed"][x])
        n, length, d = e.shape
        wide = max(WIDTHS)
        return np.lib.stride_tricks.as_strided(e, (n, length - wide + 1, wide * d), e.strides)

    def _pooled(self, x: np.ndarray, keep: bool = False):
        columns = self._columns(x)
        flat = columns.reshape(-1, columns.shape[2]) @ self.p["conv"]
        h = flat.reshape(columns.shape[0], columns.shape[1], -1)
        if not keep:
            return np.maximum(h.max(axis=1) + self.p["bias"], 0), None, None
        best = h.argmax(axis=1)
        top = np.take_along_axis(h, best[:, None, :], 1)[:, 0] + self.p["bias"]
        return np.maximum(top, 0), best, columns

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities per window."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), CHUNK):
            h, _, _ = self._pooled(x[i : i + CHUNK])
            out[i : i + CHUNK] = self._softmax(h @ self.p["out"] + self.p["base"])
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Cross-entropy loss and its gradients; y are class numbers."""
        h, best, columns = self._pooled(x, keep=True)
        p = self._softmax(h @ self.p["out"] + self.p["base"])
        n, rows = len(x), np.arange(len(x))
        loss = float(-np.log(p[rows, y] + 1e-9).mean())
        dz = p.copy()
        dz[rows, y] -= 1
        dz /= n
        dh = (dz @ self.p["out"].T) * (h > 0)
        seen = columns[rows[:, None], best]  # what each filter saw at its best place
        g = {"out": h.T @ dz, "base": dz.sum(0), "bias": dh.sum(0)}
        g["conv"] = np.einsum("nfk,nf->kf", seen, dh) * self.mask
        back = dh[:, :, None] * self.p["conv"].T[None]
        g["embed"] = np.zeros_like(self.p["embed"])
        for j in range(max(WIDTHS)):
            bytes_at = x[rows[:, None], best + j].ravel()
            part = back[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED)
            for d in range(EMBED):
                g["embed"][:, d] += np.bincount(bytes_at, part[:, d], 256)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ByteNet:
        """Adam over shuffled batches; every other window is cut to a random length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                take = order[i : i + BATCH]
                batch = x[take].copy()
                cut = rng.integers(12, 2 * WINDOW, len(take))
                batch[np.arange(WINDOW)[None] >= cut[:, None]] = 0
                _, g = self.gradients(batch, y[take])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out():
    """crc32 of doc_id as text, mod 5, is 0 (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def training_windows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC):
    """(windows, class numbers, classes) of a bounded sample: about so many documents of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    if not classes:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[v for c in classes for v in (F.lit(c), F.lit(min(1.0, docs_per_language / sizes[c])))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(1_000_000)) < F.lit(1_000_000) * F.element_at(share, F.col("lang")))
    chosen = chosen.select("lang", "text").distinct()  # rows repeated without end are one

    def body(cols):
        langs, windows = [], []
        for lang, text in zip(cols["lang"].to_pylist(), cols["text"].to_pylist()):
            w = windows_of(text.encode("utf-8"))
            for i in np.unique(np.linspace(0, len(w) - 1, windows_per_doc).astype(int)):
                langs.append(lang)
                windows.append(w[i].tobytes())
        return {"lang": langs, "window": windows}

    rows = map_batches(chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")), body, "lang string, window binary").toPandas()
    rows = rows.sort_values(["lang", "window"], kind="stable")
    x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    return x, np.searchsorted(classes, rows["lang"].to_numpy(str)), classes


def train(docs: DataFrame, **bounds) -> ByteNet | None:
    """The network learnt from ``docs``, or None where there is nothing to learn from."""
    x, y, classes = training_windows(docs, **bounds)
    return ByteNet(classes).fit(x, y) if len(x) else None


def classify(texts: list[str | None], net: ByteNet | None) -> tuple[list[str], list[float]]:
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    if not spoken:
        return langs, scores
    raw = [texts[i].encode("utf-8") for i in spoken]
    parts = [windows_of(r) for r in raw]
    p = net.predict(np.concatenate(parts))
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(count)
    weight = np.full(len(p), float(WINDOW))
    weight[ends - 1] = [len(r) - (c - 1) * WINDOW for r, c in zip(raw, count.tolist())]
    total = np.add.reduceat(p * weight[:, None], ends - count, axis=0)
    mean = total / np.fromiter(map(len, raw), np.float64, len(raw))[:, None]
    for i, row in zip(spoken, mean):
        best = int(row.argmax())
        langs[i], scores[i] = net.classes[best], round(min(1.0, float(row[best])), 6)
    return langs, scores


def language_id(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Trains on ``docs`` unless a network is given."""
    net = net or train(docs)

    def body(cols):
        langs, scores = classify(cols["text"].to_pylist(), net)
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": langs, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, body, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, net: ByteNet | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is known: not ``und``, and scored ``min_score`` or more."""
    net = net or train(docs)
    python_batches(docs.sparkSession)
    text, keep = unused(docs, "__lx_text", "__lx_keep")

    def run(batches):
        for batch in batches:
            langs, scores = classify(batch.column(batch.num_columns - 1).to_pylist(), net)
            kept = pa.array([lang != UND and score >= min_score for lang, score in zip(langs, scores)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kept], [*batch.schema.names[:-1], keep])
        release()

    schema = StructType([*docs.schema.fields, StructField(keep, BooleanType())])
    found = docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)
    return found.where(F.col(keep)).select([F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(spread(table(spark, sf_dir, "documents")))
