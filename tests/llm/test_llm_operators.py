"""Each operator against brute force or a round trip, and over rows with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from lumenweir.llm import decontamination, language, language_model, line_dedup, packing, prefix_hash, quality, queries, sharding, simhash, toxicity
from lumenweir.llm.common import WordHashes

EDGES = [(1, None), (2, ""), (None, "a b c"), (3, "A  b\tc"), (3, "A  b\tc"), (5, "é" * 50 + " word" * 3000), (6, "!!! ...")]


@pytest.fixture(scope="module")
def edges(spark):
    """Edge rows with columns whose names clash with results'."""
    rows = [(i, t, "en", 0.5, "x", 1, None) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, Fingerprint string, n_words int, extra string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# Queries that SQL can express.


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name]))


# 1. Quality


def test_quality_features():
    hashes, items = WordHashes(), [b"a b b c", None, b"", b"x", "é ü é".encode()]
    got = [Counter() for _ in items]
    for first, kinds in quality.features(items, hashes):
        for ends, buckets in kinds:
            for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                got[first + i].update(buckets[s:e].tolist())
    bucket = lambda v: (v * int(quality._MIX) & (1 << 64) - 1) >> 64 - quality.BITS
    for t, own in zip(items, got, strict=True):
        w = t.split() if t else []
        h = [hashes[x] for x in w]
        raw = b" " + b" ".join(w) + b" " if w else b""
        want = [bucket(x) for x in h] + [bucket(1 if a == b else (a * 3 + b) & (1 << 64) - 1) for a, b in zip(h, h[1:], strict=False)]
        want += [bucket(int.from_bytes(raw[i : i + k], "little") + (k << 40)) for k in quality.ORDERS for i in range(len(raw) - k + 1)]
        assert own == Counter(want)


def test_quality_learns(spark, docs, edges):
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    known = quality.score(docs, model).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("quality", "score").toPandas()
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.9
    got = quality.score(edges, model)
    assert got.count() == len(EDGES) and got.columns[-1] == "score" and got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(edges, none).agg(F.max("score")).first()[0] == 0.5
    assert quality.score(edges.limit(0), none).count() == 0


# 2. SimHash


def test_simhash_components(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {i: rng.getrandbits(64) for i in range(300)}
    for i in range(300, 500):  # a dense ball of near copies, and exact ones
        fps[i] = center ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 3)))
    top = {i: i for i in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                top[max(find(i), find(j))] = min(find(i), find(j))
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in fps.items()], "doc_id long, fp long")
    for most in (1024, 4):  # 4: nearly all by the way of large buckets
        links = simhash.link(rows, 2, most)
        signed = lambda v: v % (1 << 64)
        own = {v: v for v in fps.values()}

        def root(v, own=own):
            while own[v] != v:
                v = own[v]
            return v

        for r in links.collect():
            assert (signed(r["a"]) ^ signed(r["b"])).bit_count() <= 2
            own[root(signed(r["a"]))] = root(signed(r["b"]))
        groups = {}
        for i in fps:
            groups.setdefault(find(i), set()).add(root(fps[i]))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_fingerprint(edges):
    import xxhash

    def brute(t, k=3):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = sorted((str(r["doc_id"]), r["fingerprint"]) for r in simhash.near_duplicates(edges).collect())
    assert got == sorted((str(i), f"{brute(t):016x}") for i, t in EDGES)
    assert simhash.near_duplicates(edges.limit(0)).count() == 0
    kept = simhash.deduplicated(edges)
    assert kept.count() == 4 and simhash.deduplicated(edges.limit(0)).count() == 0
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]


def test_simhash_groups(spark):
    """Of near copies at a measure of 0.8 or more over five words, one stays; other documents all do."""
    rng = random.Random(4)
    rows, group = [], {}
    for base in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 300]))]
        for _ in range(rng.choice([1, 2, 5])):
            own = list(words)
            for _ in range(rng.randint(0, len(own) // 60)):
                own[rng.randrange(len(own))] = "new"
            group[len(rows)] = base
            rows.append((len(rows), " ".join(own), "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, Text2 int")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    firsts = {min(i for i in group if group[i] == b) for b in group.values()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in rows}
    near = [i for i in group if i not in firsts and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i) if group[i] == group[j])]
    assert firsts <= set(ids) and sum(i not in ids for i in near) >= 0.95 * len(near) and len(near) > 20


# 3. Packing


def test_packing(spark, docs, texts, edges):
    tokenizer = packing.Tokenizer(packing.default_tokenizer()).own
    got = packing.packed_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    sums = got.groupby("sequence_id").length
    assert (sums.sum() <= 2048).all() and (got.offset == sums.cumsum() - got.length).all()
    least = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= least * 1.03 + 1
    for i, part in got.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        part = part.sort_values("piece")
        assert part.length.tolist() == [len(ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    assert packing.packed_documents(edges).count() == len(EDGES) + 1
    assert packing.packed_documents(edges.limit(0)).count() == 0


def test_tokenizer_parts():
    own = packing.Tokenizer(packing.default_tokenizer())
    items = ["It's o'clock!! (a)b,c... é… ÀÉ?! x y z é. 12ab#$ don't'", "a <|endoftext|> B", "\x1c\x1fq", "…!", "ß.ſ!"]
    items += ["İstanbul DİYARBAKIR kilise", "ﬁ ﬃx שּׁ שלום", "e\u0301te\u0301 a\u0301b", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "\u212a \u212b", "ａｂｃ １２", "\u3000全角\u3000空白", "ǅ ŉ", " a ", "\x1c\x1d", "word,word; (x) y's ''s 'tis", "<|endoftext|> a", "ไทย हिन्दी", None]
    ids, ends = own.encode(pa.array(items, pa.string()), 0)
    for t, a, b in zip(items, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == [*own.own.encode(t or "", add_special_tokens=False).ids, 0]
    own.newer, own.older = {}, own.newer
    again, _ = own.encode(pa.array(items, pa.string()), 0)
    assert (again == ids).all()
    own.by_word = False
    again, _ = own.encode(pa.array(items, pa.string()), 0)
    assert (again == ids).all()


def test_tokenizer_fuzz():
    """Whole texts of several scripts, with letters whose lower case isn't all letters before and after each ASCII sign."""
    own = packing.Tokenizer(packing.default_tokenizer())
    rng = random.Random(4)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = [*"İIiıŞğAzßſÉé", "I\u0307", "e\u0301", "\u0958", "\u0915\u093c", "\ufb2a", "Σ", "ς", "ὈΥ", "ж", "Й", "한", "中", "ไ", "\u0307", "\u0338", "5", "Ⅷ", "²"]
    items = [f"{a}{x}{s}{b} {s}{x}" for x in ("İ", "I\u0307", "\u0958") for s in signs for a in ("", "T") for b in ("", "n")]
    for _ in range(4000):
        parts = rng.choices([*letters, *letters, *signs, " ", "\n", "\u3000"], k=rng.randint(1, 30))
        items.append("".join(parts))
    items += ["TÜRKİYE'NİN BAŞKENTİ.", "EMİNİ, evet", "ATATÜRK İLKELERİ!"]
    ids, ends = own.encode(pa.array(items, pa.string()), 0)
    wrong = [t for t, a, b in zip(items, [0, *ends[:-1]], ends, strict=True) if ids[a:b].tolist() != [*own.own.encode(t, add_special_tokens=False).ids, 0]]
    assert not wrong, (len(wrong), wrong[:5])


def test_packed_runs():
    rng = random.Random(1)
    for n in (0, 1, 30, 3000):
        counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 2048), 2048, 1100]) for _ in range(n))
        runs = packing.packed(counts)
        found = Counter()
        for r in runs:
            assert sum(r.lengths) <= 2048
            for x in r.lengths:
                found[x] += r.n
        assert +found == counts


# 4. Language


def test_language(spark, docs, edges):
    model = language.fit(docs.where("doc_id % 3 > 0"))
    got = language.predict(docs.where("doc_id % 3 = 0"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    odd = {(r["doc_id"], r["text"]): r["lang_pred"] for r in language.predict(edges, model).collect()}
    assert odd[1, None] == odd[2, ""] == odd[6, "!!! ..."] == "und" and odd[3, "A  b\tc"] in model.langs
    assert language.predict(edges, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_numbers_are_no_letters(spark):
    model = language.Model(["a", "b"], {"x": 0}, {}, np.array([[-1, -2]], np.float32), np.array([-9.0, -9.0]))
    rows = spark.createDataFrame([(1, "² Ⅷ 5"), (2, "² x")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(rows, model).orderBy("doc_id").collect()] == ["und", "a"]


def test_language_backs_off():
    model = language.Model(["a", "b"], {"ab": 0}, {"^xy": 1, "z": 2}, np.array([[-1, -2], [-3, -1], [-2, -4]], np.float32), np.array([-9.0, -9.0]))
    assert model.of_word("ab").tolist() == [-1, -2]
    assert np.allclose(model.of_word("z"), (np.array([-2, -4]) + 4 * language.BACKOFF + 2 * (np.array([-9, -9]) + 5 * language.BACKOFF)) / 3)


# 5. Language model


def test_language_model(spark, docs, texts, edges):
    split = {i: language_model.words(t.encode()) for i, t in texts.items()}
    n = Counter(tuple(x[i : i + k]) for x in split.values() for k in (1, 2, 3) for i in range(len(x) - k + 1))
    total = sum(map(len, split.values()))

    def brute(x, order):
        out = 0.0
        for i in range(len(x)):
            steps = 0
            for k in range(min(i + 1, order), 0, -1):
                gram = tuple(x[i - k + 1 : i + 1])
                if k == 1 or n[gram] >= 2:
                    out += steps * np.log(0.4) + np.log(n[gram] / (n[gram[:-1]] if k > 1 else total))
                    break
                steps += 1
        return out

    for order in (1, 2, 3):
        for r in language_model.scores(docs, order=order).collect():
            x = split[r["doc_id"]]
            assert r["n_words"] == len(x) and abs(r["score"] - brute(x, order)) < 1e-6 * max(1, len(x))
    odd = language_model.scores(edges).collect()
    assert len(odd) == len(EDGES) and {r["doc_id"]: r["mean"] for r in odd}[1] is None
    assert language_model.scores(edges.limit(0)).count() == 0


def test_language_model_knows_all_words(spark):
    """600,000 words, each once: half of the documents come twice, so that their trigrams count."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ").alias("text"))
    total = 900_000
    for r in language_model.scores(docs.union(docs.where("doc_id % 2 = 0"))).collect():
        want = np.log(2 / total) if r["doc_id"] % 2 == 0 else 10_000 * np.log(1 / total) + (1 + 2 * 9_998) * np.log(0.4)
        assert r["n_words"] == 10_000 and abs(r["score"] - want) < 1e-4


# 6. Prefix hashes


def test_prefix_hash(docs, texts, edges):
    got = {r["doc_id"]: r for r in prefix_hash.edit_fingerprints(docs).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(texts[i]) // 2
        e = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and (e == texts[i] or 0.3 < got[i]["near_edited"] < 1)
    assert all((got[i]["fingerprint"] == got[j]["fingerprint"]) == (texts[i] == texts[j]) for i in ids for j in ids[:40])
    assert prefix_hash.edit_fingerprints(edges).count() == len(EDGES) and prefix_hash.edit_fingerprints(edges.limit(0)).count() == 0
    single = prefix_hash.edit_fingerprints(edges.where("doc_id = 5")).first()
    assert single["near_next"] == 1.0


def test_spans_and_extensions():
    powers, rng = prefix_hash.Powers(), random.Random(2)
    for _ in range(50):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        pa, pb = ([prefix_hash.prefix(prefix_hash.points(x), powers, k) for k in (0, 1)] for x in (a, b))
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert prefix_hash.common_extension(pa, i, pb, j) == n


# 7. Sharding


def test_sharding(docs, texts, edges):
    got = sharding.byte_shards(docs).toPandas().sort_values("doc_id")
    assert got["size"].tolist() == [len(texts[i].encode()) + 1 for i in sorted(texts)]
    assert got.text_crc32.tolist() == [zlib.crc32(texts[i].encode()) for i in sorted(texts)]
    assert got.shard.is_monotonic_increasing and set(got.shard) == set(range(8))
    target = got["size"].sum() / 8
    assert (got.groupby("shard")["size"].sum() - target).abs().max() <= got["size"].max()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    odd = sharding.byte_shards(edges)
    assert odd.count() == len(EDGES) and odd.where("doc_id = 1").first()["size"] == 1
    assert sharding.byte_shards(edges.limit(0)).count() == 0


# 8. Toxicity


def test_toxicity(spark, edges):
    rng = random.Random(5)
    usual = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["worthless", "scumbag", "idiotic", "disgusting"]
    rows = [(i, " ".join(rng.choice(bad) if i % 3 == 0 and k % 20 == 5 else rng.choice(usual) for k in range(100)), int(i % 3 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 5 > 0"), labels)
    got = toxicity.score(docs.where("doc_id % 5 = 0"), model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.9
    assert toxicity.score(edges, model).where("score is null").count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(edges, none).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score(edges.limit(0), model).count() == 0


# 9. Decontamination


def test_decontamination(spark, edges):
    items = spark.createDataFrame([(1, "one two THREE four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "word word")], "item_id long, text string")
    rows = [(1, "x one, two three four five six seven eight nine ten eleven y"), (2, "a short ITEM and short item"), (3, "one two three"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1_000_000, 0):  # 0: joined, not broadcast
        got = {r["doc_id"]: r for r in decontamination.scan(docs, items, most_bytes=most).collect()}
        assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) for i in (1, 2, 3, 4)] == [(13, 11, ["1"]), (6, 4, ["2"]), (3, 0, []), (0, 0, [])]
        assert len(decontamination.scan(edges, items, most_bytes=most).collect()) == len(EDGES)
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "x  y", 2: "a  and ", 3: "one two three", 4: None}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == [3, 4]
    assert decontamination.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0


# 10. Line dedup


def test_line_dedup(spark, edges):
    line = lambda k: f"line {k} has these eight words in it all"
    own = lambda k: f"own line of document {k} with some more words"
    rows = [
        (1, "\n".join([own(1), line(1), line(2), line(3)])), (2, "\n".join([own(2), line(1), line(2), own(22)])), (3, "\n".join([line(3), own(3), line(1)])), (4, "short\n" + own(4)), (5, "short\n" + own(5)),
        (6, "\n".join([own(1), line(1), line(2), line(3)])), (7, own(7) + "\n" + own(7)), (8, None), (9, own(7) + "\n" + own(7)), (9, own(7) + "\n" + own(7)),
    ]
    got = [(r["doc_id"], r["text"], r["lines_deleted"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [
        (1, rows[0][1], 0), (2, own(2) + "\n" + own(22), 2), (3, own(3), 2), (4, rows[3][1], 0), (5, rows[4][1], 0), (6, "", 4), (7, rows[6][1], 0), (8, None, 0), (9, "", 2), (9, "", 2),
    ]
    assert line_dedup.deduplicated(edges).count() == len(EDGES) and line_dedup.deduplicated(edges.limit(0)).count() == 0


def test_aligned_blocks():
    blocks = line_dedup.aligned_blocks([(0, 5, 0, 1, True), (1, 6, 2, 3, True), (2, 7, 3, 4, True), (9, 0, 9, 10, True), (12, 3, 12, 13, False), (3, 8, 4, 5, False)])
    assert blocks == [(0, 1, False), (2, 5, False), (9, 10, True), (12, 13, True)]


def _side(worded, i, step):
    """The nearest line with words on one side."""
    places = [at for at, _ in worded if (at - i) * step > 0]
    return (max if step < 0 else min)(places) if places else None


def _brute_line_dedup(rows, least=8):
    """Lines of a document in a run of lines with so many words that an earlier document has as well go."""
    split = [[(at, w) for at, x in enumerate(t.split("\n")) if (w := " ".join(decontamination.words(x.encode("utf-8")) and [y.decode() for y in decontamination.words(x.encode())]))] for _, t in rows]
    out = []
    for k, (_, t) in enumerate(rows):
        own, lines, gone = [w for _, w in split[k]], t.split("\n"), set()
        for earlier in split[:k]:
            other = [w for _, w in earlier]
            for a in range(len(own)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[a : a + n]) >= least:
                        gone |= {at for at, _ in split[k][a : a + n]}
        gone |= {i for i, x in enumerate(lines) if not decontamination.words(x.encode()) and _side(split[k], i, -1) in gone and _side(split[k], i, 1) in gone}
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_brute(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefghijklm") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(40)] + ["", "!!"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    block = [f"word{i} of three" for i in range(6)]
    rows += [(100 + i, x) for i, x in enumerate(block)] + [(200, "\n\n".join(block)), (201, "own line\n" + "\n".join(block))]  # six holders of a line each; a block with blank lines
    want = _brute_line_dedup(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == want
    assert got[200] == rows[-2][1] and got[201] == "own line"


def test_line_dedup_of_long_texts(spark):
    lines = [f"line {i} of a text that is read in both orders" for i in range(40_000)]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)))], "doc_id long, text string")
    assert [r["lines_deleted"] for r in line_dedup.deduplicated(rows).orderBy("doc_id").collect()] == [0, 40_000]


def test_likeness_brute():
    powers, rng = prefix_hash.Powers(), random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 5, 40, 100, 700])))
        b = a[rng.randrange(3) :] + "x" * rng.randrange(40) if rng.random() < 0.5 else a[: len(a) // 2] + "".join(rng.choice("abc") for _ in range(len(a) // 2)) + a[-len(a) // 3 :]
        one, two = (prefix_hash.fingerprint(prefix_hash.points(x), powers) for x in (a, b))
        n, m = sorted((len(a), len(b)))
        if a == b or not n:
            want = float(a == b)
        else:
            step = prefix_hash.step_of(m)
            same = lambda x, y: {k for k in range(n // step) if x[k * step : (k + 1) * step] == y[k * step : (k + 1) * step]}  # noqa: B023, E731
            covered = same(a, b) | {m // step - 1 - k for k in same(a[::-1], b[::-1])}
            want = min(len(covered) * step / m, 1 - 1 / (m + 1))
        assert prefix_hash.likeness(one, two) == pytest.approx(want)
