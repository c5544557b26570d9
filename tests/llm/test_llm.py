"""Each operator against brute force or a round trip, on texts that are null, empty, blank, long, repeated, or alike."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hdulake.llm import counts, fingerprints, language, minhash, mixing, neighbours, packing, sharding, suffixes, toxicity
from hdulake.llm.components import connected_components
from hdulake.llm.tokens import Encoder



def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


SCHEMA = "doc_id long, text string, source string, lang string, rid string, key int, n int"


def texts() -> list:
    rng = random.Random(4)
    words = ["wörd", "alpha", "beta", "gamma", "delta", "日本", "x", "it's", "end."] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(90), say(120)
    out = [None, "", "  \n ", "one two", "one two", "a  b \n c", "ab" * 700, say(3000)]
    out += [base, base, base.replace("alpha", "omega", 1), base + " tail", base.upper()]
    out += [say(40) + " " + passage + " " + say(40) for _ in range(4)]
    return out + [say(rng.randrange(1, 200)) for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, [None, "a", "b"][i % 3], "en", "r", 1, 2) for i, t in enumerate(texts())]
    return [*out, (3, "one two", "a", "en", "r", 1, 2), (None, "no id", None, None, "r", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, nothing, rows):
    out = sharding.shard_records(docs, 7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard_records(nothing, 7).count() == 0


def test_tokens_agree():
    e, t = Encoder(), tokenizer()
    for text in [x or "" for x in texts()] + [" ", "a   b", "x\n \n y", "<|endoftext|> ok", "a  b", "\t\t z"]:
        assert np.frombuffer(e.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(docs, nothing, rows):
    pieces = packing.pack(docs, length=64)
    out, t = pieces.collect(), tokenizer()
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    assert sum(len(x) // 2 for x in seqs.values()) == sum(r["length"] for r in out)
    assert sorted(len(x) // 2 for x in seqs.values())[1:] == [64] * (len(seqs) - 1)
    for r in out:
        assert bytes(seqs[r["sequence_id"]])[2 * r["offset"] :][: 2 * r["length"]] == bytes(r["piece"])
    whole = next(x for x in rows if x[0] == 7)[1]
    own = sorted((r["start"], bytes(r["piece"])) for r in out if r["doc_id"] == 7)
    assert np.frombuffer(b"".join(p for _, p in own), "<u2").tolist() == [*t.encode(whole, add_special_tokens=False).ids, 1]
    assert packing.pack(nothing).count() == 0
    for r in out:
        ids = np.frombuffer(bytes(r["piece"]), "<u2").astype("<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and len(ids) == r["length"] <= r["doc_tokens"]
    key = lambda r: (r["sequence_id"], r["offset"], r["doc_id"] or -1, r["start"], r["ids_crc32"])
    few = packing.pack(docs, length=64, with_ids=False)
    assert "piece" not in few.columns and sorted(map(key, few.coalesce(1).collect())) == sorted(map(key, out))
    assert sorted(map(key, few.unionAll(few).collect())) == sorted(2 * [key(r) for r in out])


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50] = x[60]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1001, [float("nan")] * 16)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    hits = 0
    for q in range(0, 400, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(400), -score))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21))
        assert np.allclose([g[2] for g in got], score[[g[1] for g in got]])
        hits += len(set(want) & {g[1] for g in got})
    assert hits / 400 >= 0.9 and len(out) == 400
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * 0.1 + np.eye(16)[0]
    # queries that the radius isn't calibrated on
    ids = spark.range(0, 1500, 2).orderBy(F.desc(F.xxhash64(F.lit(3), "id"))).limit(3).collect()
    lone = [r[0] for r in ids]
    x[lone] = 0.3 * rng.normal(size=(3, 16)) - np.eye(16)[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.search(frame, divisor=2).collect()
    assert Counter(r["query_id"] for r in out) == dict.fromkeys(range(0, 1500, 2), 20)
    for q in lone:
        score = x @ x[q]
        score[q] = -np.inf
        assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == np.lexsort((np.arange(1500), -score))[:20].tolist()


def test_counts(docs, nothing):
    e = Encoder()
    rng = random.Random(1)
    for text in [x or "" for x in texts()]:
        tree, plain = counts.TokenTree(text, e), text
        for _ in range(12):
            at, gone, new = rng.randrange(len(plain) + 1), rng.choice([0, 1, 5, 900]), rng.choice(["", " ", "  ", "new words here", "\n"])
            tree.edit(at, gone, new)
            plain = plain[:at] + new + plain[at + gone :]
            assert tree.text() == plain and tree.n_tokens == len(e.encode(plain)) // 2
    assert counts.count_with_edits(counts.production_edits(docs)).count() == docs.count()
    assert counts.count_with_edits(counts.production_edits(nothing)).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(words) for _ in range(60)) + (" grunk vileness!" if bad else "")))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert toxicity.score_documents(docs, model).count() == docs.count()
    assert toxicity.score_documents(nothing, toxicity.Model()).count() == 0


def test_short_words_count_with_marks():
    model = toxicity.Model(bias=-1.0, weights={"die": 3.0, "kys": 2.0})
    score = toxicity.scorer(model)
    for word, weight in (("die", 3.0), ("die!!!", 3.0), ("the.***", 0.0), ("kys...", 2.0), ("...kys...", 2.0)):
        assert abs(score(f"so {word} now") - 1 / (1 + np.exp(1.0 - weight))) < 1e-12


def brute_components(rows):
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    return Counter((r[0], len(sets[i]), ids.get(find(i))) for i, r in enumerate(rows))


def test_minhash(docs, nothing, rows):
    out = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)
    assert sum(r["stays"] for r in out) == len({r["component_id"] for r in out if r["n_shingles"]}) - 0 + sum(not r["n_shingles"] for r in out)
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_of_a_large_group(spark):
    """Copies of one text, edited so much that many are linked with some others alone, or with none."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 12) if i else 4):  # no copy is the text itself
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert 3 < len({k[2] for k in want}) < 140
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_rows_keep_their_numbers(spark, tmp_path):
    """Another cut of the files in every plan, as after the loss of an executor, changes no result."""
    import corpus_pipeline as pipeline
    from hdulake.llm import _common

    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(90)) for _ in range(20)]
    data = [(i, t + f" tail{k}", "en", "ab"[i % 2], 1) for k in range(2) for i, t in enumerate(base, 20 * k)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    files = [spark.createDataFrame(data[k::4], columns).coalesce(1) for k in range(4)]
    for f in files:
        f.write.mode("append").parquet(f"{tmp_path}/docs")
    number, plans = _common.numbered, [0]

    def recut(df):
        plans[0] += 1
        return number(df.repartition(1 + plans[0], F.xxhash64(F.lit(plans[0]), "text")))

    with pytest.MonkeyPatch.context() as m:
        for module in (_common, minhash, mixing, pipeline):
            if hasattr(module, "numbered"):
                m.setattr(module, "numbered", recut)
        docs = spark.read.parquet(f"{tmp_path}/docs")
        out = minhash.near_duplicates(docs).collect()
        left = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i % 20 for i in range(40)}
    assert {r["doc_id"] for r in left} == set(range(20)) and len(left) == 20


def test_missing_sets_fail(spark):
    pairs, sets = spark.createDataFrame([(1, 2)], "u long, v long"), spark.createDataFrame([(1, b"12345678")], "sid long, shingles binary")
    with pytest.raises(Exception, match="wasn't found"):
        minhash.confirm(pairs, sets).collect()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_fingerprints(docs, nothing, rows):
    out = fingerprints.compare_with_next(docs).collect()
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        assert len(r["fingerprint"]) == fingerprints.PLACES and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["edited_sha256"]))
    for k, (i, t, *_) in enumerate(order):
        if i == 3:  # the doc_id that two rows have
            continue
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        sha = hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest()
        assert by_text[i] == {(fingerprints.fingerprint(text), sha)}
    assert fingerprints.compare_with_next(nothing).count() == 0
    pairs, members = fingerprints.near_pairs(docs.filter("doc_id is not null"))
    assert members.count() == len(rows) - 1 and pairs.count() >= 0


def test_near_pairs(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    near = [say(150) for _ in range(6)]
    data = [t + " " + say(k) for t in near for k in range(4)] + [say(3) for _ in range(40)] + [say(80) for _ in range(30)]
    data += [near[0], near[0], "", None]
    for points in (0x101, 0x220):  # one folded byte: different texts of equal fingerprints
        data.append("colliding " * 30 + chr(points))
    prints, least = {}, {}
    for i, t in enumerate(data):
        least.setdefault(t or "", i)
        prints[i] = np.frombuffer(fingerprints.fingerprint(t).encode(), np.uint8)
    ids = sorted(least.values())
    want = {(a, b): fingerprints.likeness(prints[a], prints[b]) for a in ids for b in ids if a < b and fingerprints.likeness(prints[a], prints[b]) >= fingerprints.LEAST_LIKENESS}
    pairs, members = fingerprints.near_pairs(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"))
    out = pairs.collect()
    assert {(r["a"], r["b"]): r["likeness"] for r in out} == want and len(out) == len(want)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: least[t or ""] for i, t in enumerate(data)}


def test_language(spark, docs, nothing):
    rng = random.Random(3)
    alphabet = {"aa": "abcde ", "bb": "vwxyz ", "cc": "äöüßé "}
    rows = [(i, "".join(rng.choice(alphabet[lang]) for _ in range(150)), lang) for i in range(240) for lang in [sorted(alphabet)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, net = language.train(d)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(d, langs, net).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(found[i] == lang for i, lang in held)
    out = language.identify(docs, langs, net).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language.identify(nothing, *language.train(nothing)).count() == 0


def test_mixing(docs, nothing):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["copies"] <= 2 for r in out)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        taken, most = sum(r["size"] * r["copies"] for r in own), max(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= most and sum(r["size"] for r in own) == own[0]["source_size"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(nothing).count() == 0
    chance, size = [0.3] * 50, [float(i * i % 97) for i in range(50)]
    flown = mixing.flight(chance, size, 1, keep=2)
    assert sum(0 < c < 1 for c in flown) <= 2
    assert abs(sum(flown) - 15) < 1e-6 and abs(sum(c * s for c, s in zip(flown, size)) - 0.3 * sum(size)) < 1e-6


def test_suffixes(docs, nothing, rows):
    out = suffixes.remove_repeats(docs).collect()
    seen = Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in data:
        seen.update(t[p : p + 400] for p in range(len(t) - 399))
    want = Counter()
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want[i, len(t), sum(gone), bytes(c for c, g in zip(t, gone) if not g)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out) == want
    assert suffixes.remove_repeats(nothing).count() == 0


def test_suffixes_of_words(docs, nothing, rows):
    """Passages of 50 words, whatever white space stands between, beside those of 400 bytes."""
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())] for r in rows]
    data, seen = [(r[0], (r[1] or "").encode()) for r in rows], Counter()
    grams = [[tuple(t[a:b] for a, b in w[p : p + 50]) for p in range(len(w) - 49)] for (_, t), w in zip(data, words, strict=True)]
    for g in grams:
        seen.update(g)
    want = Counter()
    for (i, t), w, own in zip(data, words, grams, strict=True):
        gone = bytearray(len(t))
        for p, g in enumerate(own):
            if seen[g] > 1:
                a, b = w[p][0], w[p + 49][1]
                gone[a:b] = b"\1" * (b - a)
        want[i, len(t), sum(gone), bytes(c for c, g in zip(t, gone) if not g)] += 1
    out = suffixes.remove_repeats(docs, units=(suffixes.WORDS,)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out) == want
    assert sum(k[2] > 0 for k in want) > 5
    both = suffixes.remove_repeats(docs, units=(suffixes.BYTES, suffixes.WORDS)).collect()
    plain = suffixes.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in both) == Counter((r["doc_id"], bytes(r["kept"])) for r in plain)
    assert Counter((r["doc_id"], r["n_removed1"]) for r in both) == Counter((k[0], k[2]) for k in want.elements())
    assert suffixes.remove_repeats(nothing, units=(suffixes.WORDS,)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(20)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    out = pipeline.run(spark, folder).collect()
    assert out and {n for n, _ in pipeline.STAGES} == {"toxicity", "near duplicates", "repeated passages", "mixing", "packing"}
    ends = Counter((r["sequence_id"], r["offset"] + r["length"]) for r in out)
    assert max(ends.values()) == 1 and all(r["length"] > 0 for r in out)
