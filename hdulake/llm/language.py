"""Op 8. Language identification with a byte convolutional network.

Bytes of a fixed-length window are embedded, filters of several widths run over them, each filter's
largest response in the window is kept, and a softmax over the languages follows. It is trained here,
in numpy, on a bounded sample of labelled texts. A text is cut into windows that together hold all of
it; the windows are scored in batches and their log-probabilities averaged by their bytes.

Since a filter is a sum over its bytes, embedding and filter fold into one table for each filter place
(256 rows), and scoring is a few table look-ups for each byte.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a text shorter than the
window is padded with zero bytes (as in training); very long texts are read whole; repeated rows get
equal results, and a null doc_id is never held out; with no labelled text nothing can be learned and every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hdulake.llm._common import read, remainder, slices

#: Bounds of the training sample: texts of one language, texts of all languages together (shared evenly where there
#: are many languages), and windows of one text.
MAX_TEXTS, MAX_SAMPLE, MAX_WINDOWS = 1200, 240_000, 6
WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDING = 8
EPOCHS = 4
#: Small samples are gone over more often, for at least so many steps.
LEAST_STEPS = 400
BATCH = 128


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories (numerals such as a half or a roman twelve are not)."""
    return any(map(str.isalpha, text))


def windows_of(raw: bytes) -> np.ndarray:
    """The text's bytes as rows of ``WINDOW``, the last padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, n_classes: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross entropy of the windows ``x`` with classes ``y``, and its gradient."""
        n = len(x)
        e = self.embedding[x]  # n, WINDOW, EMBEDDING
        pooled, cache = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            columns = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            response = columns @ f + b
            where = response.argmax(1)
            top = np.take_along_axis(response, where[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            cache.append((columns, where, top > 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        d = p
        d[np.arange(n), y] -= 1
        d /= n
        d_hidden = d @ self.out.T
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            columns, where, alive = cache[k]
            dt = d_hidden[:, k * FILTERS : (k + 1) * FILTERS] * alive  # n, FILTERS
            at = np.take_along_axis(columns, where[:, :, None], 1)  # n, FILTERS, w * EMBEDDING
            d_filters.append(np.einsum("nfe,nf->ef", at, dt))
            d_biases.append(dt.sum(0))
            de = (dt[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBEDDING)
            places = where[:, :, None] + np.arange(w)
            np.add.at(d_embedding, x[np.arange(n)[:, None, None], places].ravel(), de.reshape(-1, EMBEDDING))
        d_embedding[0] = 0
        return loss, [d_embedding, *d_filters, *d_biases, hidden.T @ d, d.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 8) -> float:
        """Adam over shuffled batches; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v, t, loss = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0
        for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(x))))):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                loss, grads = self.gradients(x[pick], y[pick])
                losses.append(loss)
                t += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (3e-3 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def tables(self) -> list[np.ndarray]:
        """For each place in a filter: what each byte adds there to the filters that are so wide."""
        return [
            np.ascontiguousarray(np.concatenate([self.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING] for w, f in zip(WIDTHS, self.filters, strict=True) if w > k], axis=1))
            for k in range(max(WIDTHS))
        ]

    def scorer(self, at_a_time: int = 64):
        """A function from windows to the logarithms of the class probabilities."""
        tables = self.tables()
        starts = [[sum(FILTERS for v in WIDTHS[:i] if v > k) for k in range(w)] for i, w in enumerate(WIDTHS)]

        def score(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), len(self.out_bias)), dtype=np.float32)
            for at in range(0, len(x), at_a_time):
                # positions first: the pooling then runs over contiguous rows
                part = np.ascontiguousarray(x[at : at + at_a_time].T)
                found = [t.take(part, axis=0) for t in tables]
                pooled = []
                for w, start, b in zip(WIDTHS, starts, self.biases, strict=True):
                    n = WINDOW - w + 1
                    response = found[0][:n, :, start[0] : start[0] + FILTERS] + found[1][1 : n + 1, :, start[1] : start[1] + FILTERS]
                    for k in range(2, w):
                        response += found[k][k : n + k, :, start[k] : start[k] + FILTERS]
                    pooled.append(np.maximum(response.max(0) + b, 0))
                logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
                logits -= logits.max(1, keepdims=True)
                out[at : at + at_a_time] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
            return out

        return score


def train(docs: DataFrame, max_texts: int = MAX_TEXTS) -> tuple[list[str], ByteCNN | None]:
    """The languages and the network, from rows outside the held-out fifth (crc32 of the doc_id mod 5 is 0)."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    labelled = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    # the least hashes of each language; a threshold lets about twice as many texts through, so no others are shuffled
    place = F.pmod(F.xxhash64(F.lit(8), "doc_id", F.xxhash64("text")), F.lit(1 << 40))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_SAMPLE).collect()  # one row a language
    if not counts:
        return [], None
    each = max(1, min(max_texts, MAX_SAMPLE // len(counts)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (2 * each + 50) / r["count"]) * (1 << 40))) for r in counts], "known string, most long")
    close = labelled.withColumn("hash", place).join(F.broadcast(limits), (F.col("lang") == F.col("known")) & (F.col("hash") < F.col("most")))  # at most MAX_SAMPLE short rows
    ranked = close.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, rows = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if has_letter(text):
                    w = windows_of(text.encode("utf-8", "replace"))
                    for i in np.unique(np.linspace(0, len(w) - 1, MAX_WINDOWS).astype(int)):
                        langs.append(lang)
                        rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "bytes"])

    sample = ranked.filter(F.col("place") <= each).select("lang", "text").mapInArrow(cut, "lang string, bytes binary")
    rows = sorted(map(tuple, sample.collect()))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], None
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(langs, dtype=object), np.array([r[0] for r in rows], dtype=object))
    net = ByteCNN(len(langs))
    net.train(x, y)
    return langs, net


def identify(docs: DataFrame, langs: list[str], net: ByteCNN | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for batch in slices(batches, 128):
            texts = batch["text"].to_pylist()
            pred, prob = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and has_letter(t)] if score else []
            if known:
                raws = [texts[i].encode("utf-8", "replace") for i in known]
                cut = [windows_of(r) for r in raws]
                x = np.concatenate(cut)
                logs = score(x) * (x != 0).sum(1, keepdims=True)
                ends = np.cumsum([0, *map(len, cut)])
                for i, total, raw in zip(known, np.add.reduceat(logs, ends[:-1], axis=0), raws, strict=True):
                    mean = total / max(1, len(raw)) * min(8.0, len(raw) / WINDOW + 1)
                    p = np.exp(mean - mean.max())
                    k = int(p.argmax())
                    pred[i], prob[i] = langs[k], float(p[k] / p.sum())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(pred), pa.array(prob, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, *train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
