"""Each operator against a brute-force version on small tables, and on the awkward rows all of them must bear."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import common, decontamination, graphs, jaccard, mixing, quality_classifier, quality_rules, registry, revisit, sharding, simhash, substring_dedup, token_counts, toxicity
from tests.helpers import assert_same, canonical

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", (sources or ["s"])[i % len(sources or ["s"])], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None), (None, "no id here at all", "en", "b"), (1, None, "en", None), (2, "", None, "a"), (3, " \n\t ", "en", "a"), (4, long, "en", "a"), (5, long, "en", "b"), (6, "same row", "en", "a"), (6, "same row", "en", "a"), (7, "é　ß\x1cx 𝒳", "fr", "ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(1) for c in ("fp", "key", "size", "copies", "rep", "gid", "bucket", "kept", "pattern", "y", "h", "cell", "target", "n_words", "shard_id", "version", "tier", "_id", "_gone", "_row", "_text", "score", "passage")}
    return df.withColumns(clash)


OPERATORS = {
    "1": lambda d, s: substring_dedup.remove_repeats(d),
    "3": lambda d, s: quality_rules.judge(d),
    "4": lambda d, s: toxicity.score(d, toxicity.train(d, labels(s))),
    "6": lambda d, s: token_counts.token_counts(d, registry.vocabulary_path()),
    "7": lambda d, s: quality_classifier.score(d, quality_classifier.train(d, labels(s))),
    "9": lambda d, s: mixing.mix(d),
    "10": lambda d, s: simhash.near_duplicates(d),
    "5": lambda d, s: sharding.shard(d),
}


def labels(spark):
    return spark.createDataFrame([(1, None, 1), (4, 1, 0), (4, 1, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("n", OPERATORS)
def test_awkward_rows(spark, n):
    rows = awkward(spark)
    out = OPERATORS[n](rows, spark)
    assert out.count() == 10
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted((r["doc_id"] for r in rows.collect()), key=str)
    assert OPERATORS[n](rows.limit(0), spark).count() == 0


def test_filters_keep_columns_and_bear_awkward_rows(spark):
    rows = awkward(spark)
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12"), (1, "w5 w6 w7 w8 w9 w10 w11 w12"), (2, None), (None, "x" * 50), (3, "short")], "item_id long, text string")
    clean = decontamination.drop_contaminated(rows, items)
    assert clean.columns == rows.columns and clean.count() == 8
    assert decontamination.contaminations(rows, items).select("doc_id", "item_id", "distance").collect() == [(4, 1, 0), (5, 1, 0)]
    assert decontamination.contaminations(rows, items.limit(0)).count() == 0 and decontamination.contaminations(rows.limit(0), items).count() == 0
    kept = quality_rules.keep_good(rows)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {4, 5}
    one = simhash.keep_one(rows)
    assert one.columns == rows.columns
    # blank texts share fingerprint zero; rows without an id are never dropped
    assert sorted((r["doc_id"] for r in one.select("doc_id").collect()), key=str) == sorted([None, None, 1, 4, 6, 6, 7], key=str)
    mixed = mixing.apply_mix(rows)
    assert mixed.columns == rows.columns
    assert quality_rules.keep_good(rows.limit(0)).count() == 0 and mixing.apply_mix(rows.limit(0)).count() == 0


# -- 1


def _vocabulary_texts(seed, n, words=40, most=60):
    r = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(r.randrange(10, 30))] for k in range(6)]
    out = []
    for _ in range(n):
        text = []
        while len(text) < r.randrange(1, most):
            text += r.choice(passages)[r.randrange(4) :] if r.random() < 0.4 else [f"w{r.randrange(words)}" for _ in range(r.randrange(1, 9))]
        out.append(r.choice([" ", "\n", "\t "]).join(text))
    return out


@pytest.mark.parametrize("window", [13, 2, 1, 6])
def test_repeats_against_all_windows(spark, window):
    texts = _vocabulary_texts(window, 60) + ["", None]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, texts), window=window, group_bytes=500).collect()}
    first, words = {}, {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert {j for s in r["removed"] for j in range(s["start"], s["stop"])} == gone


def test_word_arrays():
    texts = ["a  bc　d\n", "", None, "é", "x\x1cy \x85z"]
    raw, offsets = common.binary_parts(pa.array(texts))
    starts, ends, first = common.word_spans(raw, offsets)
    words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    assert [words[first[i] : first[i + 1]] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]
    whole = common.word_hashes(raw, starts, ends)
    assert (whole == common.word_hashes(raw, starts, ends, piece=1)).all()
    assert common.word_hashes(*[np.frombuffer(b"ab ab", np.uint8), np.array([0, 3]), np.array([2, 5])]).tolist() == [whole_ := int(common.word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0]), whole_]


# -- 2


def _resolve_brute(records):
    key = {r[0]: canonical_python(r[1]) for r in records}
    out = {}
    for rid, _, ts, kind, status, headers, body in records:
        h = {k.lower(): v for k, v in (headers or {}).items()}
        if kind == "response":
            out[rid] = ("full" if status == 200 else "not-full", rid if status == 200 else None, body, h)
            continue
        earlier = [r for r in records if r[3] == "response" and r[4] == 200 and key[r[0]] == key[rid] and r[2] < ts]
        if not earlier:
            out[rid] = ("unmatched", None, None, h)
            continue
        s = max(earlier, key=lambda r: (r[2], r[0]))
        sh = {k.lower(): v for k, v in (s[5] or {}).items()}
        pairs = [(h[n].removeprefix("W/"), sh[n].removeprefix("W/")) for n in ("etag", "last-modified") if n in h and n in sh]
        if pairs and all(a == b for a, b in pairs):
            out[rid] = ("resolved", s[0], s[6], sh | {k: v for k, v in h.items() if k in revisit.PERMITTED})
        else:
            out[rid] = ("mismatch", s[0], None, h)
    return out


def canonical_python(url):
    return {"http://a.org/x": "a", "https://www.A.org/x/#top": "a", "http://a.org/x?utm_source=f": "a", "http://b.org/index.html": "b", "b.org": "b"}[url]


def test_revisits_against_brute_force(spark):
    r = random.Random(3)
    urls = ["http://a.org/x", "https://www.A.org/x/#top", "http://a.org/x?utm_source=f", "http://b.org/index.html", "b.org"]
    records = []
    for i in range(300):
        kind = r.choice(["response", "revisit"])
        headers = {k: v for k, v in (("ETag", r.choice(["x", "W/x", "y"])), ("Last-Modified", r.choice(["1", "2"])), ("Content-Type", "t"), ("Date", str(i))) if r.random() < 0.6}
        records.append((i, r.choice(urls), r.randrange(60), kind, r.choice([200, 200, 404]), headers, f"body{i}" if kind == "response" else None))
    df = spark.createDataFrame(records, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, body string")
    got = {x["record_id"]: (x["outcome"], x["source_id"], x["body"], x["headers"]) for x in revisit.resolve(df).collect()}
    assert got == _resolve_brute(records)


def test_awkward_revisits(spark):
    rows = [(1, None, 5, "response", 200, None, "x", 1), (2, "a.org", None, "response", 200, {"A": "1", "a": "2"}, "x", 1), (3, "a.org", 5, None, 200, {}, "x", 1), (4, None, 6, "revisit", 304, {"etag": None}, None, 1), (5, "a.org", 6, "revisit", 304, None, None, 1), (5, "a.org", 6, "revisit", 304, None, None, 1), (None, "a.org", 6, "revisit", 304, None, None, 1)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, body string, url_key int")
    got = revisit.resolve(df)
    assert sorted((str(r["record_id"]), r["outcome"]) for r in got.collect()) == sorted([("1", "not-full"), ("2", "not-full"), ("4", "unmatched"), ("5", "unmatched"), ("5", "unmatched"), ("None", "unmatched")])
    assert {r["record_id"]: r["headers"] for r in got.collect()}[2] == {"a": "2"}
    assert revisit.resolve(df.limit(0)).count() == 0


# -- 3


def test_quality_counts_against_brute_force(spark):
    r = random.Random(5)
    texts = []
    for _ in range(40):
        lines = [" ".join(r.choice(["a", "bb", "cc#", "D|", "é"]) + (str(r.randrange(5)) if r.random() < 0.5 else "") for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(1, 6))]
        texts.append("\n".join(lines + (lines[:2] if r.random() < 0.6 else [])))
    got = {x["doc_id"]: x for x in quality_rules.judge(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert x["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_estimation_finds_the_bad_class():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        bad = r.random() < 0.15
        votes = [r.choice([quality_rules.BAD, quality_rules.GOOD]) if bad and k < 3 else quality_rules.GOOD for k in range(len(quality_rules.RULES))]
        p = sum(v * 3**k for k, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    found = quality_rules.estimate(counts)
    good = sum(quality_rules.GOOD * 3**k for k in range(len(quality_rules.RULES)))
    assert found[good] > 0.9 and found[good + 1 + 3] < 0.1 and quality_rules.estimate({}) == {}


# -- 4 and 7


def test_multiple_instances_locate_the_sentence(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, y = [], []
    for i in range(400):
        s = [" ".join(word() for _ in range(6)) for _ in range(r.randrange(1, 8))]
        y.append(int(r.random() < 0.3))
        if y[-1]:
            s[r.randrange(len(s))] += r.choice([" vile", " foul"]) + " thing"
        texts.append(". ".join(s) + ".")
    d = docs(spark, texts)
    lab = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(d, toxicity.train(d, lab)).collect()}
    for i in range(400):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == y[i]
        parts = [texts[i][s["start"] : s["stop"]] for s in got[i]["offending"]]
        assert all(re.search("vile|foul", p) for p in parts) and len(parts) == y[i]


def test_trees_against_a_recursive_reading():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_classifier.fit(x, y, trees=30, depth=3)

    def walk(tree, row, node=0):
        if node >= m.feature.shape[1]:
            return m.leaf[tree][node - m.feature.shape[1]]
        return walk(tree, row, 2 * node + (2 if row[m.feature[tree][node]] > m.threshold[tree][node] else 1))

    slow = [1 / (1 + np.exp(-(m.base + sum(walk(k, row) for k in range(30))))) for row in x[:50]]
    assert np.allclose(m.score(x[:50]), slow) and ((m.score(x) > 0.5) == (y > 0)).mean() > 0.97
    assert quality_classifier.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


@pytest.mark.parametrize(("name", "label"), [("op4_toxicity", "toxic"), ("op7_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank = got["score"].rank().to_numpy()
    y = got[label].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.98 and (got["predicted"] == got[label]).mean() > 0.96 and got["score"].between(0, 1).all()


# -- 6


def test_token_counts_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = [None, "", "<|endoftext|> a <|startoftext|><|ENDOFTEXT|>", "ΑΣ Σας İ ǅ ﬁ é", "a" * 3000, "don't WE'LL 12½", "\x1c\x85 x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 127), r.randrange(0xA0, 0x250)])) for _ in range(80)) for _ in range(200)]
    lib = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    wanted = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {x["doc_id"]: x for x in token_counts.token_counts(docs(spark, texts), registry.vocabulary_path(), limit=100).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == wanted
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (wanted[i] > 100) for i, t in enumerate(texts))


# -- 8


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_matching_against_dynamic_programming(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 8)))
    items = [" ".join(word() for _ in range(r.randrange(6, 14))) for _ in range(12)]

    def worn(s):
        s = list(s)
        for _ in range(r.randrange(0, 7)):
            k = r.randrange(len(s))
            s[k : k + r.randrange(0, 2)] = r.choice(["", "x", "e"])
        return "".join(s).upper() if r.random() < 0.3 else "".join(s)

    texts = [" ".join([word() for _ in range(r.randrange(0, 20))] + ([worn(r.choice(items))] if r.random() < 0.8 else []) + [word() for _ in range(r.randrange(0, 20))]) for _ in range(80)]
    found = decontamination.contaminations(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_chars=200)
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in found.collect()}
    wanted = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            a, b = decontamination.normalize(item), decontamination.normalize(text)
            if len(a) >= decontamination.MIN_CHARS and (d := _distance(a, b)) <= decontamination.budget(len(a)):
                wanted[i, k] = d
    assert got == wanted and len(wanted) > 20
    assert decontamination.best_match(3, decontamination.item_masks("abc"), "xxabcxabc") == (0, 5)


def test_short_items_stand_between_word_borders(spark):
    texts = ["ox cart", "an OX  cart!", "ox carts and box cart", "box cart ox cart", "ox cort", "ox", ""]
    items = spark.createDataFrame([(1, "Ox cart"), (2, "  ")], "item_id long, text string")
    found = decontamination.contaminations(docs(spark, texts), items)
    assert sorted(tuple(x) for x in found.collect()) == [(0, 1, 0, 7, "ox cart"), (1, 1, 0, 7, "ox cart"), (3, 1, 0, 7, "ox cart")]
    assert {x["doc_id"] for x in decontamination.drop_contaminated(docs(spark, texts), items).collect()} == {2, 4, 5, 6}


# -- 5 and 9


@pytest.mark.parametrize("name", ["op2_warc_revisits", "op3_quality_rules", "op5_sharding", "op9_mixing"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_mix_against_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join("w" * r.randrange(1, 3) for _ in range(r.randrange(0, 30))) for _ in range(200)]
    sources = ["a", None, "b", "é", "a", "a"]
    got = mixing.mix(docs(spark, texts, sources)).collect()
    size = {i: len(WORD.findall(t)) for i, t in enumerate(texts)}
    per, order = {}, sorted({s for s in sources if s is not None}) + [None]
    for i in size:
        per[sources[i % 6]] = per.get(sources[i % 6], 0) + size[i]
    weights, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, sum(size.values())
    target, left, free = {}, 1.5 * total, set(order)
    while True:  # share what is left by weight until no target is above its bound
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * per[s]}
        if not full:
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2 * per[s] for s in full)
        free -= full
    target |= {s: weights[s] * level for s in free}
    taken = {}
    for x in got:
        s = sources[x["doc_id"] % 6]
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == per[s] and abs(x["target"] - target[s]) < 1e-6 and 0 <= x["copies"] <= 2
        taken[s] = taken.get(s, 0) + x["copies"] * x["size"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order) and sum(taken.values()) <= 1.5 * total
    assert sorted(got, key=lambda x: x["doc_id"]) == sorted(mixing.mix(docs(spark, texts, sources).repartition(7)).collect(), key=lambda x: x["doc_id"])


def test_mixed_rows_come_as_often_as_they_are_taken(spark):
    d = docs(spark, ["a b c"] * 20 + ["d"] * 5, ["x", "y"])
    found = {x["doc_id"]: x["copies"] for x in mixing.mix(d).collect()}
    rows = [x["doc_id"] for x in mixing.apply_mix(d).collect()]
    assert {i: rows.count(i) for i in found} == found


def test_shard_store_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    first = docs(spark, [f"text {i}" for i in range(50)])
    assert store.append(first, arrival_rows=5) == 1 and store.manifest().count() == 10
    assert store.append(docs(spark, [(100 + i, "more") for i in range(5)]), arrival_rows=5) == 2
    assert store.compact(target_bytes=1 << 20) == 3
    one, all_ = store.read(1), store.read()
    assert one.count() == 50 and all_.count() == 55 and store.read(2).count() == 55 and all_.select("shard_id").distinct().count() < 11
    assert store.compact(target_bytes=1 << 20) in (3, 4)
    stale = store.manifest()
    with pytest.raises(RuntimeError):
        store.commit(stale, 1)
    assert canonical(all_.select("doc_id", "text").toPandas()) == canonical(first.unionByName(docs(spark, [(100 + i, "more") for i in range(5)])).select("doc_id", "text").toPandas())


# -- 10


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", "A b", "É É É É", "one two three four"] + _vocabulary_texts(1, 20)
    got = {x["doc_id"]: x["fp"] & (2**64 - 1) for x in simhash.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: _fingerprint(t) for i, t in enumerate(texts)}


def test_golay_code():
    words = simhash.codeword_index(np.arange(1 << 23))
    assert (np.bincount(words, minlength=4096) == 2048).all()  # perfect: every ball holds 1 + 23 + 253 + 1771 words
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 500)
    keys = simhash.fuzzy_indices(x)
    assert set(((keys >= 0).sum(axis=1)).tolist()) <= {1, 6}
    for bit in range(23):
        assert all(k in row for k, row in zip(simhash.codeword_index(x ^ (1 << bit)).tolist(), keys.tolist()))


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_against_all_pairs(spark, bits):
    r = random.Random(bits)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 4))) for _ in range(8)}
    rows = list(enumerate(sorted(fps)))
    signed = [(x - 2**64 if x >= 2**63 else x, i) for i, x in rows]
    got = {tuple(sorted(p)) for p in simhash.link_pairs(spark.createDataFrame(signed, "fp long, rep long"), bits).collect()}
    assert got == {(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= bits}


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    r = random.Random(8)
    texts = [None, "", "one two three"]
    for size in (7, 12, 40, 90, 150):
        for _ in range(4):
            base = [f"v{r.randrange(3000)}" for _ in range(size)]
            for _ in range(9):
                w = list(base)
                for _ in range(r.randrange(0, 1 + size // 25)):
                    at = r.randrange(size - 1)
                    w[at : at + r.randrange(2)] = [f"v{r.randrange(3000)}"]
                texts.append(" ".join(w))
    line = " ".join(f"c{i}" for i in range(12))  # a common line makes large buckets of different texts
    texts += [f"{line} {t}" for t in _vocabulary_texts(5, 30, 40, 12)]
    texts = [(1000 - i, t.upper() if t and i % 3 == 0 else t) for i, t in enumerate(texts)]
    got = {x["doc_id"] for x in simhash.keep_one(docs(spark, texts), similar=True).select("doc_id").collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts}
    fps, part = {i: _fingerprint(t) for i, t in texts}, {i: i for i, _ in texts}
    far = 0
    for i, j in ((i, j) for i in sets for j in sets if i < j):
        near = sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        far += bool(near and (fps[i] ^ fps[j]).bit_count() > 2)
        if (near or (fps[i] ^ fps[j]).bit_count() <= 2) and part[i] != part[j]:
            a, b = sorted((part[i], part[j]))
            part = {k: a if v == b else v for k, v in part.items()}
    assert far >= 10 and got == set(part.values())


def test_one_id_on_different_texts(spark):
    x, y = _vocabulary_texts(3, 2)
    rows = docs(spark, [(5, x), (5, y), (3, y)])
    for similar in (False, True):
        assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(rows, similar=similar).collect()) == sorted([(5, x), (3, y)])


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(5, 5), (7, None)]
    got = {x["node"]: x["label"] for x in graphs.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert graphs.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# -- the pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text", "source").toPandas()
    pdf = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    judged = registry.QUERIES["op3_quality_rules"](spark, sf).toPandas().set_index("doc_id")["kept"]
    pdf = pdf[pdf["doc_id"].map(judged)]
    fps = {i: _fingerprint(t) for i, t in zip(pdf["doc_id"], pdf["text"])}
    keep = [i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps)]
    items = [decontamination.normalize(t) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()["text"]]
    texts = dict(zip(pdf["doc_id"], pdf["text"]))
    keep = [i for i in keep if not any(item in decontamination.normalize(texts[i]) for item in items)]
    mixed = {x["doc_id"]: x["copies"] for x in mixing.mix(spark.createDataFrame(pdf[pdf["doc_id"].isin(keep)])).collect()}
    assert got["doc_id"].value_counts().to_dict() == {i: n for i, n in mixed.items() if n}
    assert all(texts[i] == t for i, t in zip(got["doc_id"], got["text"]))
