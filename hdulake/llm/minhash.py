"""Op 6. Near-duplicates by MinHash, exact confirmation, and connected components.

1. A text's set is that of its 5-word shingles, as 64-bit hashes. Texts of equal sets are linked to
   the least of them at once; one representative of each set goes on.
2. ``N_HASHES`` universal hashes (multiply-add modulo 2^64) give each set its signature of minima, cut
   into bands of ``ROWS``. At a similarity of 0.75 a pair shares none of the 32 bands of 4 with a
   chance of 5 in a million.
3. Each band's bucket gets a pivot: of all sets that its members meet in their buckets, the one that
   meets most. Members are paired with their pivots. Signatures that agree too little are let go
   (``LEAST_AGREEMENT``, over six standard deviations below 0.75); the others are confirmed on the full sets.
4. Components of the confirmed links follow (large-star, small-star). Most buckets hold one component
   then, and transitivity leaves nothing open in them.
5. In the others, members x and y of one pivot p are told apart by their differences D(x) = x xor p.
   100 |x and y| >= 75 |x or y| holds just if 7 |x xor y| <= |x| + |y|, that is
   14 |D(x) and D(y)| >= S(x) + S(y) with S(x) = 7 |D(x)| - |x|. Where the right side isn't positive, both
   are linked with p already. So D(x) and D(y) share one of their rarest elements (a prefix filter): each
   needs only its rarest |D| - o + 1, with o the least overlap that any member of the pivot could ask of it.
   Random edits of one text share few differences, so of n copies of it that are no links of each other
   some pairs at the threshold are left to confirm, not n^2. No link between members of a bucket is lost.
6. Those pairs are verified and confirmed in the same way, and join the components.

The full sets are read again only of documents in candidate pairs. Hot buckets are joins on the band
key, which adaptive execution splits; minima are aggregated before they are shuffled.

Edge cases: with fewer than 5 words the whole sequence is the one shingle; null, empty or blank texts
have an empty set and are linked with nothing; rows that repeat a doc_id are rows of their own; a
component's id is its least doc_id that isn't null, or null if all are; an empty table gives an empty
result; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import BASE, checkpointed, mix, read, seeds, slices, stored, text_of, words_of
from hdulake.llm.components import connected_components

WORDS = 5
ROWS, BANDS = 4, 32
N_HASHES = ROWS * BANDS
LEAST = 75  # per cent
LEAST_AGREEMENT = 0.5

_A, _B = seeds(N_HASHES, 61) | np.uint64(1), seeds(N_HASHES, 67)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes.lower() changes A-Z alone
    word = words_of(raw)[0]
    if not len(word):
        return np.zeros(0, dtype=np.uint64)
    k = min(words, len(word))
    out = np.full(len(word) - k + 1, np.uint64(len(word) if len(word) < words else words))
    for i in range(k):
        out = mix(out * BASE + word[i : len(word) - k + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of all universal hashes over a set that isn't empty."""
    best = None
    for at in range(0, len(s), 1024):
        part = (s[at : at + 1024][None, :] * _A[:, None] + _B[:, None]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def bands(minima: np.ndarray) -> np.ndarray:
    keys = minima.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * BASE
    for i in range(ROWS):
        out = mix(out ^ keys[:, i]) * BASE
    return out


def sign(kept: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, two hashes of the whole set, its band keys and its signature's upper 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for packed in batch["packed"].to_pylist():
                s = shingles(text_of(packed))
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                minima = signature(s)
                rows.append((len(s), *whole_set(s), bands(minima).view(np.int64).tolist(), (minima >> np.uint64(16)).astype("<u2").tobytes()))
            n, h1, h2, keys, sig = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["rid", "doc_id", "n", "h1", "h2", "bands", "sig"])

    return kept.select("rid", F.col("carried.doc_id").cast("long").alias("doc_id"), "packed").mapInArrow(run, "rid long, doc_id long, n long, h1 long, h2 long, bands array<long>, sig binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Signature verification: the pairs u, v whose signatures (su, sv) agree often enough to be worth confirming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype="<u2").reshape(-1, N_HASHES) for c in ("su", "sv"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def whole_set(s: np.ndarray) -> list[int]:
    """Two hashes of a set of shingles."""
    return [int(mix(s * m).sum(dtype=np.uint64).view(np.int64)) for m in (BASE, _A[0])]


def shingle_sets(kept: DataFrame) -> DataFrame:
    """sid and shingles of the rows whose text has the set that sid stands for (c1, c2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sids, found = [], []
            for sid, c1, c2, packed in zip(*(batch[c].to_pylist() for c in ("sid", "c1", "c2", "packed")), strict=True):
                s = shingles(text_of(packed))
                if len(s) and whole_set(s) == [c1, c2]:
                    sids.append(sid)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(found, pa.binary())], names=["sid", "shingles"])

    return kept.select("sid", "c1", "c2", "packed").mapInArrow(run, "sid long, shingles binary")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets xs and ys of their ends u and v."""
    x, y = (sets.select(F.col("sid").alias(k), F.col("shingles").alias(c)) for k, c in (("xi", "xs"), ("yi", "ys")))
    return pairs.join(x, F.col("u") == F.col("xi"), "left").join(y, F.col("v") == F.col("yi"), "left").drop("xi", "yi")


def _set(data: bytes | None) -> np.ndarray:
    if data is None:
        raise RuntimeError("a candidate's set of shingles wasn't found")
    return np.frombuffer(data, dtype=np.uint64)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v with 100 * intersection >= LEAST * union on the full sets, all of which must be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True):
                a, b = _set(x), _set(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= LEAST * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return with_sets(pairs, sets).select("u", "v", "xs", "ys").mapInArrow(run, "u long, v long")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v (its pivot), component, n (its size) and elements: what is in one of both sets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, elements = [], []
            for x, y in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True):
                a, b = _set(x), _set(y)
                n.append(len(a))
                elements.append(np.setxor1d(a, b, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], batch["component"], pa.array(n, pa.int64()), pa.array(elements, pa.list_(pa.int64()))], names=["u", "v", "component", "n", "elements"])

    return with_sets(members, sets).select("u", "v", "component", "xs", "ys").mapInArrow(run, "u long, v long, component long, n long, elements array<long>")


def by_differences(members: DataFrame) -> DataFrame:
    """The pairs u, v over different components of one pivot whose differences from it leave a link possible (step 5).

    An element that one member alone has can't be shared; it only counts for the places of the others,
    which come after it. Frequencies are aggregated before they are shuffled, and the lists that are
    collected are those of one member.
    """
    sized = members.select("u", "v", "component", "n", "elements", F.size("elements").cast("long").alias("d"), (7 * F.size("elements") - F.col("n")).alias("s"))
    least = sized.groupBy(F.col("v").alias("lv")).agg(F.min("s").alias("lo"))
    listed = sized.select("v", "u", F.explode("elements").alias("e"))
    shared = listed.groupBy(F.col("v").alias("fv"), F.col("e").alias("fe")).agg(F.count("*").alias("f")).filter("f > 1")
    rarest = listed.join(shared, (F.col("v") == F.col("fv")) & (F.col("e") == F.col("fe"))).groupBy(F.col("u").alias("ru"), F.col("v").alias("rv")).agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("rarest"))
    asked = sized.drop("elements").join(least, F.col("v") == F.col("lv")).join(rarest, (F.col("u") == F.col("ru")) & (F.col("v") == F.col("rv")))
    # place of the first shared element, and the number of elements that must be looked at
    asked = asked.withColumn("first", F.col("d") - F.size("rarest")).withColumn("prefix", F.expr("d + 1 - greatest(1, cast(ceil((s + lo) / 14D) as long))"))
    placed = asked.filter("prefix > first").select("u", "v", "component", "n", "s", "d", "first", F.posexplode(F.expr("slice(rarest, 1, cast(least(prefix - first, size(rarest)) as int))")).alias("place", "item"))
    left = checkpointed(placed.select("u", "v", "component", "n", "s", (F.col("d") - F.col("first") - F.col("place")).alias("rest"), F.col("item.e").alias("e")))
    right = left.select(*(F.col(c).alias(f"{c}2") for c in left.columns))
    possible = F.expr(f"component < component2 and 14 * least(rest, rest2) >= s + s2 and 100 * least(n, n2) >= {LEAST} * greatest(n, n2)")
    return left.join(right, (F.col("v") == F.col("v2")) & (F.col("e") == F.col("e2")) & possible).select("u", F.col("u2").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``near_duplicates_of`` the rows of ``docs``."""
    return near_duplicates_of(stored(docs, ("doc_id",)))


def pivots_of(in_buckets: DataFrame) -> DataFrame:
    """k and pivot of each bucket ``key``: of all sets that its members (``sid``) meet in a bucket, the one that meets most."""
    meets = in_buckets.groupBy(F.col("sid").alias("i")).agg(F.sum("members").alias("meets"))
    known = in_buckets.join(meets, F.col("sid") == F.col("i"))
    heads = known.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("meets", "sid")).alias("head"))
    seen = in_buckets.join(heads, F.col("key") == F.col("k")).groupBy(F.col("sid").alias("i")).agg(F.max("head").alias("head"))
    best = in_buckets.join(seen, F.col("sid") == F.col("i")).groupBy(F.col("key").alias("k")).agg(F.max("head").alias("head"))
    return best.select("k", F.col("head.sid").alias("pivot"))


def near_duplicates_of(kept: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and stays (true for one row of each component) of each ``stored`` row."""
    signed = checkpointed(sign(kept))
    # one class for each set; its best row has the least doc_id (nulls last)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    classes = signed.filter("n > 0").groupBy(F.col("h1").alias("c1"), F.col("h2").alias("c2")).agg(best, *(F.first(c).alias(c) for c in ("n", "bands", "sig")))
    classes = checkpointed(classes).withColumn("sid", F.monotonically_increasing_id())  # stable: the rows lie in files now
    keys = classes.select(F.explode("bands").alias("key"), "sid")
    counts = keys.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("members")).filter("members > 1")
    in_buckets = checkpointed(keys.join(counts, F.col("key") == F.col("k")).select("key", "sid", "members"))
    pivots = checkpointed(pivots_of(in_buckets))
    with_pivot = in_buckets.join(pivots, F.col("key") == F.col("k")).select("key", "sid", "pivot")
    wanted = in_buckets.select(F.col("sid").alias("w")).distinct()
    rows = classes.join(wanted, F.col("sid") == F.col("w")).select("sid", "c1", "c2", F.col("best.rid").alias("best_rid"))
    sets = checkpointed(shingle_sets(kept.join(rows, F.col("rid") == F.col("best_rid"))))
    # written before it is joined, so that the joins' sides are plain shuffles, which split at hot pivots
    signatures = checkpointed(classes.join(wanted, F.col("sid") == F.col("w")).select("sid", "n", "sig"))

    def linked(pairs: DataFrame) -> DataFrame:
        u, v = (signatures.select(F.col("sid").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "uv")
        known = pairs.join(u, F.col("u") == F.col("iu")).join(v, F.col("v") == F.col("iv"))
        likely = agreeing(known.filter(f"100 * least(nu, nv) >= {LEAST} * greatest(nu, nv)"))
        return checkpointed(confirm(likely, sets))

    first = connected_components(linked(with_pivot.filter("sid <> pivot").select(F.col("sid").alias("u"), F.col("pivot").alias("v")).distinct()))
    # members of buckets that hold several components
    named = with_pivot.join(first, F.col("sid") == F.col("id"), "left").select("key", "sid", "pivot", F.coalesce("component", "sid").alias("component"))
    several = named.groupBy(F.col("key").alias("k")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("k")
    open_ = named.join(several, F.col("key") == F.col("k")).filter("sid <> pivot").select(F.col("sid").alias("u"), F.col("pivot").alias("v"), "component").distinct()
    more = linked(by_differences(checkpointed(differences(checkpointed(open_), sets))))
    # the components of the first ones over the links found since
    of = lambda k: first.select(F.col("id").alias(f"{k}i"), F.col("component").alias(f"{k}c"))
    ends = more.join(of("u"), F.col("u") == F.col("ui"), "left").join(of("v"), F.col("v") == F.col("vi"), "left")
    second = connected_components(ends.select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")))
    of_class = classes.select("sid", "c1", "c2", "best").join(first, F.col("sid") == F.col("id"), "left").select("c1", "c2", "best", F.coalesce("component", "sid").alias("own"))
    of_class = of_class.join(second, F.col("own") == F.col("id"), "left").select("c1", "c2", "best", F.coalesce("component", "own").alias("component"))
    least = of_class.groupBy(F.col("component").alias("k")).agg(F.min("best").alias("least"))
    of_class = of_class.join(least, F.col("component") == F.col("k")).select("c1", "c2", "least")
    out = signed.select("rid", "doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(of_class, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return out.select("rid", "doc_id", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), F.coalesce(F.col("least.rid") == F.col("rid"), F.lit(True)).alias("stays"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
