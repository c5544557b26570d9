"""Op 10. Removal of long repeated passages by sparse distributed prefix doubling.

A symbol (a byte, or a word) goes if a string of ``length`` symbols that covers it also starts anywhere else. Prefix
doubling sorts suffixes by pairs (rank of the first half, rank of the second half), reranks, and goes
on with twice the length; a suffix of unique rank is settled and leaves. Run over every position of
the corpus that is several sorts of as many rows as there are symbols, so positions are thinned first,
without loss (figures for bytes, ``BYTES``; ``WORDS`` are the same with 50 words, spans of 32 and grams of 4):

* Each 400-byte window has an anchor: the place of the least 16-byte hash among its first ``span`` (200)
  positions. That is a property of the window's content alone, so two equal windows have their
  anchors at the same offset, and the windows with one anchor are a run of neighbouring starts.
* Round 1 ranks anchors by the first 200 bytes after them. All windows of an anchor hold those, so an
  anchor of unique rank is settled: none of its windows repeats.
* Round 2 ranks the pairs (rank of those 200 bytes, rank of all that the anchor's windows cover). An
  anchor whose pair isn't unique has all of its windows repeated: it is past the threshold. One anchor
  of each pair goes on, if its rank has one of an unsettled fate.
* Round 3 does the same with blocks of ``PART`` (8) neighbouring starts: the 393 bytes that all windows of the
  block share, and all that they cover.
* Round 4 takes single windows of the blocks that are still open: pairs of the ranks of two 256-byte
  halves (overlapping by 112). A window whose pair isn't unique is repeated.

Ranks are names: equal strings get equal hashes (two of 64 bits where they decide), those of single windows
made by doubling 16-byte names, so that Spark's sort-based grouping on the pairs is the reranking
and nothing has to be numbered globally.

Hot passages are grouped with map-side counts; no group is collected. Texts are read once, compressed
and written to the checkpoint folder, dealt by row number.

Edge cases: a null or empty text has no bytes and keeps none; texts shorter than ``length`` keep all;
very long texts are handled in segments; a row repeated (doc_id included) repeats its windows; matches
within a document count; an empty table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hdulake.llm._common import checkpointed, checkpointed_by, mix, numbered, powers_to, read, seeds, shuffle_partitions, slices, words_of



@dataclass(frozen=True)
class Unit:
    """What a text is a string of, and how long a repeated string must be."""

    words: bool
    length: int
    gram: int
    span: int

    def symbols(self, text: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The symbols, and where each begins and ends in the text (None: at its own place)."""
        raw = np.frombuffer(text, dtype=np.uint8)
        return words_of(raw) if self.words else (raw, None, None)


BYTES = Unit(words=False, length=400, gram=16, span=200)
#: Passages of 50 words, whatever their length in bytes and the white space between.
WORDS = Unit(words=True, length=50, gram=4, span=32)
#: Positions of a text whose anchors are found at a time.
SEGMENT = 1 << 19

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Two hashes of each byte.
_TABLES = seeds(256, 101), seeds(256, 103)
#: An anchor, as kept beside its text: rank of its first symbols, hash of all that its windows cover, how far it lies
#: after its first start, and the number of its starts (both under a span). Its first start is the one after the anchor before.
ANCHOR = np.dtype([("rank", "<i8"), ("cover", "<i8"), ("ahead", "u1"), ("starts", "u1")])
#: Starts in a block of round 3.
PART = 8


def grams(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` symbols (bytes: of 16)."""
    n = len(symbols) - gram + 1
    if symbols.dtype == np.uint64:
        out = mix(symbols[:n] + _C1)
        for i in range(1, gram):
            out = mix(out * _C2 + symbols[i : n + i])
        return out
    words = np.lib.stride_tricks.as_strided(symbols[: len(symbols) - 7].view(), shape=(len(symbols) - 7, 8), strides=(1, 1))
    words = np.ascontiguousarray(words).view("<u8")[:, 0]
    x = words[:n] * _C1 ^ (words[8 : n + 8] + _C2) * _C2
    return mix(x)


def anchors(symbols: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of neighbouring window starts with one anchor: the anchor, the first and the last start."""
    starts = len(symbols) - unit.length + 1
    if starts < 1:
        return (np.zeros(0, dtype=np.int64),) * 3
    found = np.empty(starts, dtype=np.int64)
    for at in range(0, starts, SEGMENT):
        n = min(SEGMENT, starts - at)
        key = grams(symbols[at : at + n + unit.span - 1 + unit.gram - 1], unit.gram)  # n + span - 1 positions
        # the place in the low bits: the least key is the rightmost of the least hashes
        low = np.arange(len(key), dtype=np.uint64)
        bits = np.uint64((1 << 20) - 1)
        key = (key | bits) - low
        least, width = key, 1
        while 2 * width <= unit.span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[unit.span - width : unit.span - width + n])
        found[at : at + n] = at + (bits - (least & bits)).astype(np.int64)
    change = np.flatnonzero(np.diff(found)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [starts])) - 1
    return found[first], first, last


class Names:
    """Hashes of strings of symbols, equal for equal strings: polynomials in the symbols' own hashes, by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power, self.inverse = powers_to(n + 1)
        self.sums = []
        for table, c in zip(_TABLES, (_C1, _C2), strict=True):
            own = mix(symbols + c) if symbols.dtype == np.uint64 else table[symbols]
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(own * power[:n], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The names of symbols[begin:end], of the first or second kind."""
        total = self.sums[which]
        return mix((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * _C2).view(np.int64)


def anchor_records(text: bytes, unit: Unit = BYTES) -> np.ndarray:
    symbols = unit.symbols(text)[0]
    at, first, last = anchors(symbols, unit)
    out = np.empty(len(at), dtype=ANCHOR)
    out["ahead"], out["starts"] = at - first, last - first + 1
    if len(at):
        names = Names(symbols)
        out["rank"] = names.of(0, at, at + unit.length - unit.span)
        out["cover"] = names.of(1, first, last + unit.length)
    return out


def window_names(symbols: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """Two hashes of each window of the symbols, by doubling the names of grams."""
    n, out = len(symbols) - unit.length + 1, []
    for c in (_C1, _C2):
        name, width = mix(grams(symbols, unit.gram) + c), unit.gram
        while 2 * width <= unit.length:
            name = mix(name[:-width] * c + mix(name[width:] ^ c))
            width *= 2
        out.append(mix(name[:n] * c + mix(name[unit.length - width : unit.length - width + n] ^ c)))
    return np.stack(out, axis=1).view(np.int64)


def stretches(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that the windows starting in first..last cover, one stretch after the other, and how far each has moved."""
    ends = last + length
    return np.concatenate([symbols[i:j] for i, j in zip(first.tolist(), ends.tolist(), strict=True)]), np.cumsum(ends - first) - ends


def _store(units: tuple[Unit, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            found = [pa.array([anchor_records(t, u).tobytes() for t in texts], pa.binary()) for u in units]
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["carried"], pa.array([press.compress(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *found], names=["rid", "carried", "packed", "n_bytes", *(f"anchors{k}" for k in range(len(units)))])

    return run


def _list_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [np.frombuffer(a, dtype=ANCHOR)["rank"] for a in batch["anchors"].to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["r"])


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        blobs = batch["anchors"].to_pylist()
        if not blobs:
            continue
        sizes = np.array([len(x) // ANCHOR.itemsize for x in blobs])
        r = np.frombuffer(b"".join(blobs), dtype=ANCHOR)
        rid = np.repeat(batch["rid"].to_numpy(), sizes)
        number = (np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["rank"])), pa.array(np.ascontiguousarray(r["cover"])), pa.array(rid), pa.array(number)], names=["rank", "cover", "rid", "number"])


def starts_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last start of each anchor."""
    after = np.cumsum(records["starts"], dtype=np.int64)
    return after - records["starts"], after - 1


def block_records(names: Names, at: np.ndarray, first: np.ndarray, last: np.ndarray, alone: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each block of the anchors' starts: names of what its windows share and of what they cover, first and last start, alone, the anchor's place.

    Blocks are laid out from the anchor, so equal windows lie in equal places of their blocks.
    """
    least, most = (at - last) // PART, (at - first) // PART
    owner = np.repeat(np.arange(len(at)), most - least + 1)
    k = least[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1)
    high = at[owner] - PART * k
    low = high - PART + 1
    lo, hi = np.maximum(low, first[owner]), np.minimum(high, last[owner])
    return names.of(0, high, low + length), names.of(1, lo, hi + length), lo, hi, alone[owner], owner


def _list_blocks(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for rid, packed, records, numbers, alone in zip(*(batch[c].to_pylist() for c in ("rid", "packed", "anchors", "numbers", "alone")), strict=True):
                r, numbers = np.frombuffer(records, dtype=ANCHOR), np.array(numbers)
                first, last = (x[numbers] for x in starts_of(r))
                symbols, moved = stretches(unit.symbols(expand.decompress(packed))[0], first, last, unit.length)
                core, cover, lo, hi, single, owner = block_records(Names(symbols), first + r["ahead"][numbers] + moved, first + moved, last + moved, np.array(alone), unit.length)
                rows.append((core, cover, lo - moved[owner], hi - moved[owner], single, np.full(len(core), rid)))
            if rows:
                core, cover, lo, hi, single, rids = map(np.concatenate, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(cover), pa.array(rids), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(single)], names=["core", "cover", "rid", "first", "last", "alone"])

    return run


def _list_windows(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            parts: list[tuple] = []
            for rid, packed, items in zip(*(batch[c].to_pylist() for c in ("rid", "packed", "items")), strict=True):
                first, last, alone = (np.array([item[k] for item in items]) for k in ("first", "last", "alone"))
                symbols, moved = stretches(unit.symbols(expand.decompress(packed))[0], first, last, unit.length)
                n = last - first + 1
                start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                names = window_names(symbols, unit)[start + np.repeat(moved, n)]
                parts.append((names, np.full(len(start), rid), start.astype(np.int32), np.repeat(alone, n)))
            if parts:
                names, rids, start, alone = map(np.concatenate, zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array(rids), pa.array(start), pa.array(alone)], names=["w1", "w2", "rid", "start", "alone"])

    return run


def spans_of(records: np.ndarray, whole: list[int], runs: list[dict], length: int = BYTES.length) -> np.ndarray:
    """The maximal removed runs of symbols, as rows (from, to), of anchors that are repeated whole and runs of repeated starts."""
    if not len(whole) and not len(runs):
        return np.zeros((0, 2), dtype=np.int64)
    begin, end = starts_of(records)
    firsts = np.concatenate([begin[whole], np.array([r["first"] for r in runs], dtype=np.int64)])
    lasts = np.concatenate([end[whole], np.array([r["last"] for r in runs], dtype=np.int64)])
    order = np.argsort(firsts, kind="stable")
    a, b = firsts[order], np.maximum.accumulate(lasts[order] + length)
    new = np.concatenate(([True], a[1:] > b[:-1]))
    begin = np.flatnonzero(new)
    return np.stack([a[begin], b[np.concatenate((begin[1:], [len(a)])) - 1]], axis=1)


def _cut(units: tuple[Unit, ...], as_text: bool):
    """Of each text: its length, the bytes and spans of the first unit's repeats, what is left without them, and the bytes of the others' repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches, 128):
            found = [(batch[f"anchors{k}"], batch[f"whole{k}"].to_pylist(), batch[f"runs{k}"].to_pylist()) for k in range(len(units))]
            rows: list[tuple] = []
            for i, packed in enumerate(batch["packed"].to_pylist()):
                text, spans = expand.decompress(packed), []
                for unit, (records, whole, runs) in zip(units, found, strict=True):
                    own = spans_of(np.frombuffer(records[i].as_py(), dtype=ANCHOR), whole[i] or [], runs[i] or [], unit.length)
                    if unit.words and len(own):
                        _, begin, end = unit.symbols(text)
                        own = np.stack([begin[own[:, 0]], end[own[:, 1] - 1]], axis=1)
                    spans.append(own)
                at, kept = 0, []
                for a, b in spans[0].tolist():
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                sizes = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
                rows.append((sizes[0], spans[0].tolist(), left.decode("utf-8", "ignore") if as_text else left, *sizes[1:]))
            gone, spans, kept, *more = zip(*rows, strict=True) if rows else ((),) * (2 + len(units))
            more = [pa.array(x, pa.int64()) for x in more]
            yield pa.RecordBatch.from_arrays([batch["carried"], batch["n_bytes"], pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string() if as_text else pa.binary()), *more], names=["carried", "n_bytes", "n_removed", "spans", "kept", *(f"n_removed{k + 1}" for k in range(len(more)))])

    return run


def find_repeats(stored: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """The repeats in the stored texts (rid, packed, anchors): wr and whole (numbers of anchors), sr and runs (first, last) by document."""
    listed = stored.select("rid", "anchors").mapInArrow(_list_anchors, "rank long, cover long, rid long, number int")
    # round 1: anchors whose rank isn't unique
    # counts and classes are written before they are joined: the join's sides are then plain shuffles, which split at hot ranks
    counts = checkpointed(stored.select("anchors").mapInArrow(_list_ranks, "r long").groupBy("r").agg(F.count("*").alias("n")).filter("n > 1").select("r"))
    live = checkpointed(listed.join(counts, F.col("rank") == F.col("r")).select("rank", "cover", "rid", "number"))
    # round 2: pairs; the members of repeated ones are done, and one of each pair goes on where a lone one is left
    classes = checkpointed(live.groupBy("rank", "cover").agg(F.count("*").alias("members"), F.min(F.struct("rid", "number")).alias("one")))
    whole = live.join(classes.filter("members > 1").select(F.col("rank").alias("r"), F.col("cover").alias("c")), (F.col("rank") == F.col("r")) & (F.col("cover") == F.col("c"))).select("rid", "number")
    lone = classes.filter("members = 1").select(F.col("rank").alias("r")).distinct()
    item = F.struct(F.col("one.number").alias("number"), (F.col("members") == 1).alias("alone"))
    asked = classes.join(lone, F.col("rank") == F.col("r")).groupBy(F.col("one.rid").alias("o")).agg(F.collect_list(item).alias("items"))  # at most the anchors of one document
    # round 3: blocks of starts
    blocks = stored.join(asked, F.col("rid") == F.col("o")).select("rid", "packed", "anchors", F.col("items.number").alias("numbers"), F.col("items.alone").alias("alone"))
    blocks = checkpointed(blocks.mapInArrow(_list_blocks(unit), "core long, cover long, rid long, first int, last int, alone boolean"))
    counts = checkpointed(blocks.groupBy(F.col("core").alias("r")).agg(F.count("*").alias("n")).filter("n > 1").select("r"))
    live = checkpointed(blocks.join(counts, F.col("core") == F.col("r")).drop("r"))
    classes = checkpointed(live.groupBy("core", "cover").agg(F.count("*").alias("members"), F.min(F.struct("rid", "first", "last", "alone")).alias("one")))
    parts_whole = live.filter("alone").join(classes.filter("members > 1").select(F.col("core").alias("r"), F.col("cover").alias("c")), (F.col("core") == F.col("r")) & (F.col("cover") == F.col("c"))).select("rid", "first", "last")
    lone = classes.filter("members = 1 and one.alone").select(F.col("core").alias("r")).distinct()
    item = F.struct("one.first", "one.last", ((F.col("members") == 1) & F.col("one.alone")).alias("alone"))
    asked = classes.join(lone, F.col("core") == F.col("r")).groupBy(F.col("one.rid").alias("o")).agg(F.collect_list(item).alias("items"))  # at most the blocks of one document
    # round 4: single windows
    windows = stored.join(asked, F.col("rid") == F.col("o")).select("rid", "packed", "items")
    windows = checkpointed(windows.mapInArrow(_list_windows(unit), "w1 long, w2 long, rid long, start int, alone boolean"))
    twice = windows.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.count("*").alias("n")).filter("n > 1")
    single = windows.filter("alone").join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))).select("rid", F.col("start").alias("first"), F.col("start").alias("last"))
    # collected by document: at most the anchors and the starts of one
    by_whole = whole.groupBy(F.col("rid").alias("wr")).agg(F.collect_list("number").alias("whole"))
    by_run = parts_whole.unionAll(single).groupBy(F.col("rid").alias("sr")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return by_whole, by_run


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), as_text: bool = False, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """The columns ``carry`` of each row of ``docs``, n_bytes, n_removed, spans (from, to in bytes) and the kept bytes.

    These follow the first unit; of each further one only the bytes that its repeats cover are told (n_removed1, ...).
    With ``as_text`` what is kept is a string; a span's border may lie within a character, and what is
    left of such a character goes too.
    """
    spark = docs.sparkSession
    base = numbered(docs.select(F.struct(*(docs[c] for c in carry)).alias("carried"), docs["text"].cast("string").alias("text")))
    carried = base.schema["carried"].dataType
    field, long, binary = T.StructField, T.LongType(), T.BinaryType()
    store = T.StructType([field("rid", long), field("carried", carried), field("packed", binary), field("n_bytes", long), *(field(f"anchors{k}", binary) for k in range(len(units)))])
    cut = T.StructType([field("carried", carried), field("n_bytes", long), field("n_removed", long), field("spans", T.ArrayType(T.ArrayType(long))), field("kept", T.StringType() if as_text else binary), *(field(f"n_removed{k}", long) for k in range(1, len(units)))])
    stored = checkpointed_by(base.select("rid", "carried", "text").mapInArrow(_store(units), store), shuffle_partitions(spark), "rid")
    marked = stored
    for k, unit in enumerate(units):
        by_whole, by_run = find_repeats(stored.select("rid", "packed", F.col(f"anchors{k}").alias("anchors")), unit)
        by_whole, by_run = by_whole.withColumnsRenamed({"wr": f"wr{k}", "whole": f"whole{k}"}), by_run.withColumnsRenamed({"sr": f"sr{k}", "runs": f"runs{k}"})
        marked = marked.join(by_whole, F.col("rid") == F.col(f"wr{k}"), "left").join(by_run, F.col("rid") == F.col(f"sr{k}"), "left")
    columns = [f"{c}{k}" for k in range(len(units)) for c in ("anchors", "whole", "runs")]
    done = marked.select("carried", "packed", "n_bytes", *columns).mapInArrow(_cut(units, as_text), cut)
    return done.select("carried.*", *cut.names[1:])


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns are those of 400 bytes; passage_bytes are those that a repeated passage of 50 words covers."""
    out = remove_repeats(read(spark, sf_dir, "documents"), units=(BYTES, WORDS))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("n_removed1").alias("passage_bytes"))
