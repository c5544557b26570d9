"""What the registered queries return, held against brute force, on a small folder of tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hdulake.llm import fingerprints, mixing
from hdulake.llm.queries import QUERIES
from tests.llm.test_llm import brute_components, texts, tokenizer

BASE = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of():
    rng = random.Random(11)
    letters = {"aa": "abcde", "bb": "vwxyz", None: "klm"}
    out = []
    for i, t in enumerate(texts()):
        out.append((i, t, [None, "aa", "bb"][i % 3], [None, "s1", "é", "s0"][i % 4], len(t or "")))
    for i in range(len(out), 260):
        lang = ["aa", "bb", None][i % 3]
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            words[::7] = ["kysvile"] * len(words[::7])
        out.append((i, " ".join(words), lang, f"s{i % 5}", 0))
    return out


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(data, BASE).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(50, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(150, 12)))]
    vectors += [(40, [float(v) for v in rng.normal(size=12)]), (151, None), (152, [0.0] * 12), (153, [float("inf")] * 12), (154, [1.0] * 5), (160, vectors[20][1])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return path


def got(spark, folder, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, folder)


def utf8(text):
    return (text or "").encode()


def test_op1(spark, folder, data):
    frame = got(spark, folder, 1)
    assert dict(frame.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    out = frame.collect()
    want = Counter((i, len(utf8(t)) + 16, zlib.crc32(utf8(t))) for i, t, *_ in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    assert sorted(map(tuple, got(spark, folder, 1).collect())) == sorted(map(tuple, out))


def test_op2(spark, folder, data):
    t = tokenizer()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in data}
    out = got(spark, folder, 2).collect()
    pieces = Counter()
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        cut = own[r["start"] : r["start"] + r["length"]]
        assert len(cut) == r["length"] and zlib.crc32(np.array(cut, dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert pieces == Counter((i, k) for i, own in ids.items() for k in range(len(own)))
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ends = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        ends.append(at)
    assert sorted(ends)[1:] == [2048] * (len(ends) - 1)


def test_op3(spark, folder):
    vectors = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None]
    vectors = [(i, v) for i, v in vectors if len(v) == 12 and np.isfinite(v).all() and v.any()]
    out = got(spark, folder, 3).collect()
    queries = [k for k, (i, _) in enumerate(vectors) if i % 20 == 0]
    assert Counter(r["query_id"] for r in out) == {i: 20 * n for i, n in Counter(vectors[k][0] for k in queries).items()}
    hits = total = 0
    for i in {vectors[k][0] for k in queries}:
        rankings = []
        for k in queries:
            if vectors[k][0] == i:
                best = sorted(((-float(vectors[k][1] @ v), j) for m, (j, v) in enumerate(vectors) if m != k))[:20]
                rankings += [(rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == i]
        assert Counter(r for r, *_ in mine) == Counter(r for r, *_ in rankings)
        if len(mine) == 20:
            scores = [s for _, _, s in sorted(mine)]
            assert scores == sorted(scores, reverse=True)
            own = next(v for j, v in vectors if j == i)
            assert all(abs(s - max((own @ v for j2, v in vectors if j2 == j), key=lambda x: -abs(x - s))) < 1e-9 for _, j, s in mine)
        hits += sum((Counter(j for _, j, _ in mine) & Counter(j for _, j, _ in rankings)).values())
        total += len(rankings)
    assert hits >= 0.9 * total


def test_op4(spark, folder, data):
    from hdulake.llm import counts

    t = tokenizer()
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    out = {r["doc_id"]: r for r in got(spark, folder, 4).collect()}
    edits = {r["doc_id"]: r["edits"] for r in counts.production_edits(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert len(out) == len(data)
    for i, text, *_ in data:
        text = text or ""
        assert out[i]["n_tokens"] == n(text)
        for e in edits[i]:
            at = min(max(0, e["at"]), len(text))
            text = text[:at] + e["inserted"] + text[at + min(e["deleted"], len(text) - at) :]
        assert out[i]["edited_tokens"] == n(text) and out[i]["edited_crc32"] == zlib.crc32(text.encode()) and out[i]["edited_chars"] == len(text)


def test_op5(spark, folder, data):
    out = got(spark, folder, 5).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in data)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 50]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) >= 0.95 * len(held)


def test_op6(spark, folder, data):
    out = got(spark, folder, 6).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(data)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def plain_digits(text):
    """The fingerprint of a text by the definition: the walk step by step, then the least step of each bin."""
    characters = fingerprints.folded(text)
    embedding = []
    state = 0
    for c in characters:
        after = fingerprints._NEXT[state][c]
        stay = (after - state - 1) % 256 + 1
        embedding += [c] * stay
        state = after
    return characters, np.array(embedding, dtype=np.uint64)


def test_op7(spark, folder, data):
    out = {r["doc_id"]: r for r in got(spark, folder, 7).collect()}
    order = sorted(data, key=lambda r: -r[0])
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = out[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == share(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == share(r["fingerprint"], out[order[(k + 1) % len(order)][0]]["fingerprint"])
    mixer = lambda x: int(fingerprints.mix(np.array([x], dtype=np.uint64))[0])
    for i in (3, 5, 8, 13, 100):
        _, embedding = plain_digits(data[i][1])
        j = np.arange(len(embedding), dtype=np.uint64)
        h = fingerprints.mix(j * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
        best = {}
        for step, (b, p) in enumerate(zip((h & np.uint64(255)).tolist(), (h >> np.uint64(8)).tolist(), strict=True)):
            if b not in best or p < best[b][0]:
                best[b] = (p, step)
        want = ["0"] * 256
        for b, (_, step) in best.items():
            want[b] = format(mixer(step << 8 | int(embedding[step])) >> 60, "x")
        assert out[i]["fingerprint"] == "".join(want)


def test_near_pairs(spark, data):
    rng = random.Random(5)
    rows = [(i, t) for i, t, *_ in data if t and len(t) > 150][:60]
    for k in range(12):
        text = rows[k][1]
        for _ in range(2):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("qxz") + text[at + 1 :]
        rows.append((1000 + k, text))
    pairs, members = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    printed = {i: fingerprints.fingerprint(t) for i, t in rows}
    class_of = dict(map(tuple, members.collect()))
    texts_of = dict(rows)
    want = {(a, b) for a in set(class_of.values()) for b in set(class_of.values()) if a < b and sum(x == y for x, y in zip(printed[a], printed[b])) >= 0.75 * 256}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(texts_of[i] == texts_of[c] for i, c in class_of.items())
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 5


def test_op8(spark, folder, data):
    out = {r["doc_id"]: r for r in got(spark, folder, 8).collect()}
    for i, text, *_ in data:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i]["score"] <= 1
        assert (out[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    held = [i for i, _, lang, *_ in data if i >= 60 and lang and out[i]["held_out"]]
    assert held and sum(out[i]["lang_pred"] == data[i][2] for i in held) >= 0.9 * len(held)


def test_numerals_are_no_letters():
    from hdulake.llm.language import has_letter

    assert not any(has_letter(x) for x in ("", " 12", "½", "²", "Ⅻ", "_-")) and has_letter("1ä")


def test_op9(spark, folder, data):
    size = {i: len(WORD.findall(utf8(t))) for i, t, *_ in data}
    sources = sorted({s for *_, s, _ in data}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, _, own, _ in data if own == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    goal, left, target, open_ = 1.5 * sum(total.values()), 0.0, {}, set(sources)
    while True:
        left = goal - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        open_ -= set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    out = got(spark, folder, 9).collect()
    source = {i: s for i, _, _, s, _ in data}
    taken = Counter()
    for r in out:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == total[source[i]]
        assert r["target"] == pytest.approx(target[source[i]]) and r["taken"] in (0, size[i], 2 * size[i])
        taken[source[i]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size.values())
    assert sorted(map(tuple, got(spark, folder, 9).collect())) == sorted(map(tuple, out))


def covered(rows, length, words):
    """For each row which bytes a string of so many bytes (or words) covers that also starts elsewhere."""
    spans = [[m.span() for m in WORD.finditer(utf8(t))] if words else [(k, k + 1) for k in range(len(utf8(t)))] for t in rows]
    keys = [[(tuple(utf8(t)[a:b] for a, b in s[p : p + length]) if words else utf8(t)[p : p + length]) for p in range(len(s) - length + 1)] for t, s in zip(rows, spans, strict=True)]
    seen = Counter(k for own in keys for k in own)
    out = []
    for t, s, own in zip(rows, spans, keys, strict=True):
        gone = bytearray(len(utf8(t)))
        for p, k in enumerate(own):
            if seen[k] > 1:
                a, b = s[p][0], s[p + length - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out.append(gone)
    return out


def test_op10(spark, folder, data):
    rows = [t for _, t, *_ in data]
    gone, passages = covered(rows, 400, False), covered(rows, 50, True)
    want = Counter()
    for (i, t, *_), g, w in zip(data, gone, passages, strict=True):
        left = bytes(c for c, x in zip(utf8(t), g) if not x)
        want[i, len(g), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(left).hexdigest(), sum(w)] += 1
    assert Counter(map(tuple, got(spark, folder, 10).collect())) == want


def test_pipeline_stages(spark, folder, data):
    """Each stage on the rows that the one before it has kept, against brute force; then the whole."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, kept = dict(pipeline.STAGES), None
    scores = {r["doc_id"]: r["predicted"] for r in got(spark, folder, 5).collect()}
    for name in ("toxicity", "near duplicates", "repeated passages", "mixing", "packing"):
        before = docs.collect()
        out = stages[name](spark, docs, folder)
        rows = out.collect()
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before if not scores[r["doc_id"]]}
            assert Counter(map(tuple, rows)) <= Counter(map(tuple, before))
        elif name == "near duplicates":
            least = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"] for r in rows} == least and Counter(map(tuple, rows)) <= Counter(map(tuple, before))
        elif name == "repeated passages":
            gone = covered([r["text"] for r in before], 50, True)
            want = {r["doc_id"]: None if r["text"] is None else bytes(c for c, g in zip(utf8(r["text"]), own) if not g).decode() for r, own in zip(before, gone, strict=True)}
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        elif name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
            assert Counter(map(tuple, rows)).keys() <= Counter(map(tuple, before)).keys()
            size = lambda rs: Counter({s: sum(len(WORD.findall(utf8(r["text"]))) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 2 and set(plan.values()) <= {0, 1, 2}
            assert sum(size(rows).values()) == pytest.approx(min(1.5 * sum(size(before).values()), 2 * sum(size(before).values())), rel=0.05)
        else:
            t = tokenizer()
            assert sum(r["length"] for r in rows) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
        kept = rows
        path = f"{folder}/stage-{name.replace(' ', '-')}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    total = lambda rs: sum(r["length"] for r in rs)
    assert total(pipeline.run(spark, folder).collect()) == pytest.approx(total(kept), rel=0.02)


def test_pipeline_edges(spark, tmp_path):
    """An empty table, and rows that repeat a doc_id beside columns with clashing names."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], BASE).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    more = [(1, "a b c d e f", "x", "s", 1, 9, "r"), (1, "a b c d e f", "x", "s", 1, 9, "r"), (None, None, None, None, None, None, None), (2, "", "x", "s", 0, 1, "q"), (1, "other words here", "x", "s", 1, 2, "q")]
    spark.createDataFrame(more, BASE + ", rid long, carried string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(1, "a b c d e f"), (None, None), (2, ""), (1, "other words here")])
    assert pipeline.run(spark, str(tmp_path)).count() > 0
