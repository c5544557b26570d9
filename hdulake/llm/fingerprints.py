"""Op 7. Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j a pointer stands on a character c of the text, the
embedding's j-th place gets c, and the pointer moves on or stays as a shared random bit r(j, c) says.
Two texts that differ by few edits soon walk in step again, so their embeddings differ in few places:
edit distance becomes Hamming distance. Here r has a period of 256 steps, which makes the walk a small
automaton: its state is the step modulo 256, and each character leads to the next state.

The fingerprint samples the embedding at ``PLACES`` (256) places: all steps are dealt to 256 bins by a
hash, and each bin takes the step of least priority that the embedding has. Embeddings of about the
same length so share nearly all sampled steps. A place gives 4 bits of a hash of its step and
character; the fingerprint is these as hexadecimal digits. The likeness of two fingerprints is the
share of equal digits. For search, digits are sampled into bands, texts with an equal band are
candidates, and the likeness of whole fingerprints verifies them.

Edge cases: a null or empty text embeds nowhere and its fingerprint is all zeros; equal texts have equal
fingerprints; very long texts are walked whole; rows that repeat a doc_id are neighbours in the order of
a hash of their texts; null doc_ids come last; a table of one row is its own next document; an empty
table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import checkpointed, mix, read, shuffle_partitions, slices

PLACES = 256
BANDS, BAND_DIGITS = 32, 6
LEAST_LIKENESS = 0.75
_PERIOD = 256


def _automaton(seed: int = 7) -> list[bytes]:
    """For each state the next state by character."""
    moves = np.random.default_rng(seed).integers(0, 2, (_PERIOD, 256)).astype(bool)
    moves[-1] = True  # so that no walk stays longer than a period
    out = np.zeros((_PERIOD, 256), dtype=np.uint8)
    after = np.zeros(256, dtype=np.int64)  # at the end of the period
    for j in range(2 * _PERIOD - 1, -1, -1):
        after = np.where(moves[j % _PERIOD], j + 1, after)
        if j < _PERIOD:
            out[j] = after % _PERIOD
    return [row.tobytes() for row in out]


_NEXT = _automaton()


def folded(text: str) -> bytes:
    """A byte a character: its code point if below 256, else that folded."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return ((points ^ (points >> 8) * np.uint32(31)) & np.uint32(255)).astype(np.uint8).tobytes()


def walk(characters: bytes, state: int = 0) -> bytes:
    """The states after each character."""
    step = _NEXT
    return bytes([state := step[state][c] for c in characters])


class Sampler:
    """The sampled steps of an embedding of any length."""

    def __init__(self) -> None:
        self.known = 0
        self.steps, self.bins = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = np.full(PLACES, np.uint64(0xFFFFFFFFFFFFFFFF))

    def grow(self, length: int) -> None:
        size = 1 << 18
        while self.known < length:
            j = np.arange(self.known, self.known + size, dtype=np.uint64)
            h = mix(j * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
            bins, priority = (h & np.uint64(PLACES - 1)).astype(np.int64), h >> np.uint64(8)
            found = []
            for k in np.unique(bins):
                own = np.flatnonzero(bins == k)
                run = np.minimum.accumulate(np.concatenate(([self.least[k]], priority[own])))
                found.append(own[priority[own] < run[:-1]])
                self.least[k] = run[-1]
            new = np.sort(np.concatenate(found))
            self.steps = np.concatenate([self.steps, new + self.known])
            self.bins = np.concatenate([self.bins, bins[new]])
            self.known += size

    def sample(self, length: int) -> np.ndarray:
        """A step for each bin, -1 where the embedding has none there."""
        self.grow(length)
        n = int(np.searchsorted(self.steps, length))
        out = np.full(PLACES, -1, dtype=np.int64)
        out[self.bins[:n]] = self.steps[:n]  # later records take the place of earlier ones
        return out


_sampler = Sampler()


def digits(characters: bytes, states: bytes) -> np.ndarray:
    """The fingerprint's 4-bit numbers."""
    out = np.zeros(PLACES, dtype=np.uint8)
    if not characters:
        return out
    after = np.frombuffer(states, dtype=np.uint8)
    moved = np.empty(len(after), dtype=np.int64)
    moved[0] = after[0]
    np.subtract(after[1:], after[:-1], out=moved[1:], dtype=np.int64, casting="unsafe")
    moved = (moved - 1) % _PERIOD + 1  # a walk stays 1 to 256 steps on a character
    ends = np.cumsum(moved)
    steps = _sampler.sample(int(ends[-1]))
    there = steps >= 0
    seen = np.frombuffer(characters, dtype=np.uint8)[np.searchsorted(ends, steps[there], side="right")]
    out[there] = (mix(steps[there].astype(np.uint64) << np.uint64(8) | seen.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return out


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def fingerprint(text: str | None) -> str:
    characters = folded(text or "")
    return _HEX[digits(characters, walk(characters))].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(t) for t in batch["text"].to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def near_pairs(docs: DataFrame, least: float = LEAST_LIKENESS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of classes whose likeness reaches ``least``, and the membership doc_id, class_id.

    A class is all documents of one text (null counts as empty), its id the least doc_id. In a band's bucket
    every class is held against every other, so a bucket gives about half the square of its classes in pairs.
    """
    rng = np.random.default_rng(seed)
    taken = [sorted(rng.choice(PLACES, BAND_DIGITS, replace=False).tolist()) for _ in range(BANDS)]
    text_key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("text_key", text_key)
    members = checkpointed(named.select("doc_id", "text_key"))
    one = named.groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.first("text").alias("text"))
    numbers = checkpointed(one.select("class_id", "text_key", "text")).withColumn("place", F.monotonically_increasing_id())  # stable: the rows lie in files now
    printed = fingerprints(numbers.select(F.col("place").alias("doc_id"), "text")).select(F.col("doc_id").alias("place"), "fingerprint")
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.concat(*(F.substring("fingerprint", p + 1, 1) for p in places)).alias("key")) for k, places in enumerate(taken)))
    rows = checkpointed(printed.select("place", "fingerprint", F.explode(keys).alias("at")).select("place", "fingerprint", "at.band", "at.key"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fa, fb = (np.frombuffer("".join(batch[c].to_pylist()).encode(), dtype=np.uint8).reshape(-1, PLACES) for c in ("fa", "fb"))
            equal = fa == fb
            alike = equal.mean(axis=1)
            first = np.stack([equal[:, places].all(axis=1) for places in taken], axis=1).argmax(axis=1)  # a pair counts in its first band
            keep = pa.array((alike >= least) & (first == batch["band"].to_numpy()))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(alike)], names=["u", "v", "likeness"]).filter(keep)

    u = rows.select("band", "key", F.col("place").alias("u"), F.col("fingerprint").alias("fa"))
    v = rows.select("band", "key", F.col("place").alias("v"), F.col("fingerprint").alias("fb"))
    verified = u.join(v, ["band", "key"]).filter("u < v").select("band", "u", "v", "fa", "fb").mapInArrow(verify, "u long, v long, likeness double")
    ids = numbers.select("place", "class_id")
    a, b = (ids.select(F.col("place").alias(f"{k}p"), F.col("class_id").alias(f"{k}c")) for k in "uv")
    pairs = verified.join(a, F.col("u") == F.col("up")).join(b, F.col("v") == F.col("vp"))
    pairs = pairs.select(F.least("uc", "vc").alias("a"), F.greatest("uc", "vc").alias("b"), "likeness")
    return pairs, members.join(numbers.select("text_key", "class_id"), "text_key").select("doc_id", "class_id")


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are less than the key, by bisection: an expression as long as the logarithm of their number."""
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds)).cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) < key, n + step).otherwise(n))


def with_next(docs: DataFrame) -> DataFrame:
    """The rows dealt into ranges of falling doc_id, each range followed by the first row of the next one (``borrowed``).

    The range bounds and the ranges' first doc_ids are on the driver: one number each for a partition.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), key.alias("key"))
    ids = rows.select("key")
    bounds = sorted(set(map(int, ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0] or []))) if n > 1 else []
    part = F.lit(len(bounds)) - _below(bounds, F.col("key"))
    ranged = rows.withColumn("part", part.cast("int"))
    heads = sorted(map(tuple, ids.withColumn("part", part.cast("int")).groupBy("part").agg(F.max("key")).collect()))
    # by part: its first key, and the part before it that has rows
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (k, head) in enumerate(heads):
        first[k], before[k] = head, heads[i - 1][0]
    at = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.when(F.col("key") == at(first, "long"), at(before, "int")).alias("part"), F.lit(True).alias("borrowed"))
    dealt = ranged.select("doc_id", "text", "key", F.explode(F.filter(F.array(own, lent), lambda x: x["part"].isNotNull())).alias("to")).select("doc_id", "text", "key", "to.part", "to.borrowed")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "borrowed", F.col("key").desc(), F.xxhash64("text"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (its end replaced by the next document's beginning), and likenesses."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None  # the row that waits for its next one: part, borrowed, doc_id, text, characters, states, digits
        for batch in slices(batches):
            for part, borrowed, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
                text = text or ""
                characters = folded(text)
                states = walk(characters)
                now = (part, borrowed, doc_id, text, characters, states, digits(characters, states))
                if last is not None and not last[1] and last[0] == part:
                    yield compared(last, now)
                last = now

    def compared(one: tuple, following: tuple) -> tuple:
        _, _, doc_id, text, characters, states, own = one
        n = len(text)
        keep = n - n // 2
        edited = text[:keep] + following[3][: n // 2]
        # as folded() works by character, the walk over the kept part is the one that is known
        tail = following[4][: n // 2]
        walked = states[:keep] + walk(tail, states[keep - 1] if keep else 0)
        other = digits(characters[:keep] + tail, walked)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, n, sha, _HEX[own].tobytes().decode(), _HEX[other].tobytes().decode(), likeness(own, other), likeness(own, following[6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows(batches):
            out.append(row)
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return with_next(docs).select("part", "borrowed", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
