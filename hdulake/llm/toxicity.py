"""Op 5. Toxicity by weak supervision.

1. A bounded sample of labelled documents gives word features (whole words and word beginnings) that
   go with toxic or clean labels. The strongest become lexicons; each lexicon is a voter. Patterns
   (several hits, hits per word, no hit in a long text, shouting, rows of exclamation marks) vote too.
2. A generative label model takes the votes of all sampled documents and estimates by expectation
   maximisation how often each voter is right when it speaks, and from the residuals how strongly
   voters move together; voters that say the same thing share one voice.
3. Its posteriors are the soft labels of a logistic regression over the selected word features, which
   scores whole texts.

The fit runs on the driver over at most ``MAX_TOXIC + MAX_CLEAN`` rows of feature lists that the
executors have made; scoring is one pass over the table with the weights (a few thousand words) in the
closure. Nothing but the text is an input of a score.

Edge cases: a null or empty text gets the score of no evidence (the bias alone); without any labelled
row, or with one class only, every score is 0; repeated rows are scored alike; very long texts are
read whole; labels of rows whose doc_id is null or missing among the documents are not used, nor are labels of
one doc_id that contradict each other; of documents that share a doc_id the least text is learned from.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import read, remainder, slices

#: Bounds of the fitting sample, in labelled documents; chosen by a hash of the doc_id.
MAX_TOXIC, MAX_CLEAN = 2000, 2500
PREFIXES = (4, 5, 6, 7)
N_FEATURES = 4000
LEAST_DOCS = 4
#: The likelihood-ratio statistic that a feature needs; a lexicon entry needs twice as much.
LEAST_G = 12.0
#: A voter's accuracy before its votes are seen, and what that weighs against them. With a half or less the model took
#: clean documents for the toxic class on samples of few toxic ones.
EXPECTED, EXPECTED_WEIGHT = 0.95, 1.0
THRESHOLD = 0.7

_STRIP = ".,;:!?\"'()[]{}<>*_-«»“”‘’„…¡¿"


def features_of(word: str) -> list[str]:
    """A word's features: itself and its beginnings (marked by a star)."""
    word = word.strip(_STRIP)
    if not word:
        return []
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def surface(text: str | None) -> tuple[int, float, float]:
    """Words, share of capitals among ASCII letters, exclamation marks a word."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    n = len(text.split())
    return n, upper / max(1, upper + lower), text.count("!") / max(1, n)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    voters: list[str] = field(default_factory=list)
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: np.ndarray | None = None


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive class, each voter's accuracy, and the voters' residual correlations.

    ``votes``: documents by voters, 1 toxic, 0 clean, -1 no opinion (which says nothing). A voter whose
    errors and hits move together with others' has the less of a voice.
    """
    n, m = votes.shape
    fires, clears = (votes == 1).astype(np.float64), (votes == 0).astype(np.float64)
    given = np.maximum(fires.sum(0) + clears.sum(0), 1)
    posterior = np.clip((fires.sum(1) + prior) / (fires.sum(1) + clears.sum(1) + 1), 0.01, 0.99)
    voice, correlation, accuracy = np.ones(m), np.eye(m), np.full(m, EXPECTED)
    base = np.log(prior / (1 - prior))
    for step in range(rounds):
        right = posterior @ fires + (1 - posterior) @ clears
        accuracy = np.clip((right + EXPECTED * EXPECTED_WEIGHT * given) / ((1 + EXPECTED_WEIGHT) * given), 0.55, 0.995)
        if step in (rounds // 3, 2 * rounds // 3):
            rate1 = posterior @ fires / max(posterior.sum(), 1e-9)
            rate0 = (1 - posterior) @ fires / max((1 - posterior).sum(), 1e-9)
            residual = fires - (posterior[:, None] * rate1 + (1 - posterior)[:, None] * rate0)
            spread = np.sqrt((residual**2).mean(0)) + 1e-9
            correlation = (residual.T @ residual) / n / np.outer(spread, spread)
            voice = 1 / (1 + np.clip(correlation - np.diag(np.diag(correlation)), 0, 1).sum(1))
        odds = np.log(accuracy / (1 - accuracy))
        logit = base + fires @ (voice * (odds - base)) - clears @ (voice * (odds + base))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, accuracy, correlation


def without_copies(docs: list[str]) -> list[int]:
    """The places of documents that aren't copies, or nearly, of an earlier one: a copied text's words prove nothing."""
    seen: set = set()
    out = []
    for i, words in enumerate(docs):
        rare = sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in words.split("\n") if len(w) >= 8)[:4]
        key = tuple(rare) if len(rare) == 4 else words
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def feature_index(docs: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and feature of each occurrence, and the features' names, of those that enough documents have.

    A first pass counts features by hash, so the names of rare ones are never kept together.
    """
    found = lambda words: {f for w in words.split("\n") for f in features_of(w)}
    mask = (1 << 22) - 1
    seen = np.zeros(mask + 1, dtype=np.int32)
    for words in docs:
        seen[np.unique(np.fromiter((hash(f) & mask for f in found(words)), dtype=np.int64))] += 1
    often = (seen >= LEAST_DOCS).tobytes()
    index: dict[str, int] = {}
    rows, cols = array("i"), array("i")
    for i, words in enumerate(docs):
        for f in sorted(f for f in found(words) if often[hash(f) & mask]):
            cols.append(index.setdefault(f, len(index)))
            rows.append(i)
    return np.frombuffer(rows, dtype=np.int32), np.frombuffer(cols, dtype=np.int32), list(index)


def fit(docs: list[str], surfaces: np.ndarray, toxic: np.ndarray) -> Model:
    """Lexicons, voters, label model and classifier from the sampled documents' words (a line each)."""
    alone = without_copies(docs)
    docs, surfaces, toxic = [docs[i] for i in alone], surfaces[alone], toxic[alone]
    n, pos = len(docs), int(toxic.sum())
    if not pos or pos == n:
        return Model()
    rows, cols, names = feature_index(docs)
    y = toxic.astype(np.float64)
    n1 = np.bincount(cols, weights=y[rows], minlength=len(names))
    n0 = np.bincount(cols, minlength=len(names)) - n1
    odds = np.log((n1 + 0.5) / (pos - n1 + 0.5)) - np.log((n0 + 0.5) / (n - pos - n0 + 0.5))
    z = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    # the likelihood-ratio test of "as frequent in toxic as in clean documents"
    e1, e0 = (n1 + n0) * pos / n, (n1 + n0) * (n - pos) / n
    g = 2 * (n1 * np.log(np.maximum(n1, 0.5) / e1) + n0 * np.log(np.maximum(n0, 0.5) / e0))
    often = (n1 + n0 >= LEAST_DOCS) & (g >= LEAST_G)
    # lexicons: what is found in toxic documents almost alone, together by the same beginning
    sure = np.flatnonzero(often & (g >= 2 * LEAST_G) & (n1 / np.maximum(n1 + n0, 1) >= 0.9))
    sure = sure[np.argsort(-z[sure], kind="stable")][:800]
    lexicons: dict[str, list[int]] = {}
    for k in sure:
        lexicons.setdefault(names[k].rstrip("*")[: PREFIXES[0]], []).append(int(k))
    chosen = sorted(lexicons, key=lambda b: -max(z[k] for k in lexicons[b]))[:60]
    lexicon_of = np.full(len(names), -1)
    for v, b in enumerate(chosen):
        lexicon_of[lexicons[b]] = v
    hit = np.zeros((n, len(chosen)), dtype=bool)
    some = lexicon_of[cols] >= 0
    hit[rows[some], lexicon_of[cols[some]]] = True
    n_hits, n_words = hit.sum(1), surfaces[:, 0]
    patterns = {
        "two lexicons": np.where(n_hits >= 2, 1, -1),
        "three lexicons": np.where(n_hits >= 3, 1, -1),
        "dense": np.where(n_hits * 50 > np.maximum(n_words, 1), 1, -1),
        "none": np.where(n_hits == 0, 0, -1),
        "none in a long text": np.where((n_hits == 0) & (n_words >= 50), 0, -1),
        "shouting": np.where(surfaces[:, 1] > 0.5, 1, -1),
        "exclamations": np.where(surfaces[:, 2] > 0.2, 1, -1),
    }
    votes = np.concatenate([np.where(hit, 1, -1), np.stack(list(patterns.values()), axis=1)], axis=1)
    voters = [*(f"lexicon {b}" for b in chosen), *patterns]
    posterior, accuracy, correlation = label_model(votes, float(np.clip(pos / n, 0.01, 0.5)))
    # the classifier learns from the posteriors
    selected = np.flatnonzero(often & (odds > 0))  # evidence only; what is common in clean texts proves nothing
    selected = selected[np.argsort(-z[selected], kind="stable")][:N_FEATURES]
    at = np.full(len(names), -1)
    at[selected] = np.arange(len(selected))
    inside = at[cols] >= 0
    r, c = rows[inside], at[cols[inside]]
    weight, bias = np.zeros(len(selected)), -1.0
    g2, b2 = np.full(len(selected), 1e-6), 1e-6
    importance = np.where(posterior > 0.5, 0.8 * n / max(1.0, (posterior > 0.5).sum()), 0.5 * n / max(1.0, (posterior <= 0.5).sum()))
    for _ in range(400):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=weight[c], minlength=n), -30, 30)))
        error = (score - posterior) * importance
        grad = np.bincount(c, weights=error[r], minlength=len(selected)) / n + 2e-6 * weight
        g2, b2 = g2 + grad**2, b2 + error.mean() ** 2
        weight -= 1.0 * grad / np.sqrt(g2)
        bias -= 0.5 * error.mean() / np.sqrt(b2)
    return Model({names[k]: float(w) for k, w in zip(selected, weight, strict=True)}, float(bias), voters, dict(zip(voters, map(float, accuracy), strict=True)), correlation)


def sample_words(labelled: DataFrame) -> DataFrame:
    """toxic, words, surface of each labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            words, surf = [], []
            for text in batch["text"].to_pylist():
                words.append("\n".join(sorted(distinct_words(text))))
                surf.append([float(x) for x in surface(text)])
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words), pa.array(surf, pa.list_(pa.float64()))], names=["toxic", "words", "surface"])

    return labelled.mapInArrow(run, "toxic int, words string, surface array<double>")


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on labelled rows outside the held-out third (crc32 of the doc_id mod 3 is 1 there)."""
    marked = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["toxic"].cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (remainder(F.col("label_id"), 3) != 1))
    # labels that contradict each other say nothing
    marked = marked.groupBy("label_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    order = (F.xxhash64(F.lit(5), "label_id"), F.col("label_id"))
    taken = marked.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(marked.filter("toxic = 0").orderBy(*order).limit(max_clean))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    labelled = texts.join(F.broadcast(taken), F.col("doc_id") == F.col("label_id"))  # at most max_toxic + max_clean rows of two numbers
    one = labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of documents with one doc_id, the least text
    rows = sample_words(one.select("toxic", "text")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["words"]))
    if not rows:
        return Model()
    return fit([r["words"] for r in rows], np.array([r["surface"] for r in rows]), np.array([r["toxic"] for r in rows]))


def scorer(model: Model):
    """A function from a text to its score. Words whose beginning no feature has are passed over at once."""
    weights, head = model.weights, PREFIXES[0]
    heads = {f.rstrip("*")[:head] for f in weights}

    def score(text: str | None) -> float:
        present: dict[str, float] = {}
        for word in distinct_words(text):
            if word.strip(_STRIP)[:head] in heads:
                for f in features_of(word):
                    if f in weights:
                        present[f] = weights[f]
        logit = model.bias + sum(present[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return score


def score_documents(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score, with the columns ``carry`` of the documents beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches):
            scores = pa.array([score(t) for t in batch[batch.num_columns - 1].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    kept = docs.select(*(docs[c] for c in ("doc_id", *carry)), docs["text"].cast("string").alias("scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
