"""Skew, repeats, lost writers and long inputs; each against a brute-force version where there is one."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, decontamination, jaccard, mixing, quality_classifier, registry, revisit, sharding, simhash, substring_dedup, token_counts, toxicity

from .test_operators import WORD, _fingerprint, _vocabulary_texts, awkward, docs

# -- 1


def _removed(rows, window):
    """Removed word positions of each row, and its repeats, by comparing every window with every other."""
    at = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1 if i is not None else 0):
            at.setdefault(tuple(w[k : k + window]), []).append((i, k))
    at = {g: min(places) for g, places in at.items()}
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        hits = [(k, *at[tuple(w[k : k + window])]) for k in range(len(w) - window + 1) if i is not None and at[tuple(w[k : k + window])][0] < i]
        repeats = []
        for k, source, place in hits:
            if repeats and repeats[-1][1] == k + window - 1 and repeats[-1][2] == source and repeats[-1][3] + k - repeats[-1][0] == place:
                repeats[-1][1] = k + window
            else:
                repeats.append([k, k + window, source, place])
        out.append((i, {j for k, *_ in hits for j in range(k, k + window)}, repeats))
    return out


@pytest.mark.parametrize("window", [13, 5])
def test_repeats_name_their_source(spark, window):
    texts = _vocabulary_texts(window + 100, 50, 25, 80)
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, rows), window=window, group_bytes=400).collect()}
    wanted = _removed(rows, window)
    assert sum(len(w[2]) for w in wanted) > 30
    words = {i: WORD.findall(t) for i, t in rows}
    for i, gone, repeats in wanted:
        found = [[r["start"], r["stop"], r["source_id"], r["source_start"]] for r in got[i]["repeats"]]
        assert found == repeats and got[i]["n_removed"] == len(gone)
        for a, b, source, place in found:
            assert words[i][a:b] == words[source][place : place + b - a]


def test_repeated_ids_in_any_order(spark):
    texts = _vocabulary_texts(4, 40, 20, 90)
    rows = [(i // 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[1]), (3, texts[1])]
    wanted = sorted((str(i), len(gone), hashlib.sha256((t or "").encode()).hexdigest()) for (i, gone, _), (_, t) in zip(_removed(rows, 13), rows))
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = substring_dedup.remove_repeats(docs(spark, rows).repartition(5), group_bytes=300).collect()
        sizes = sorted((str(r["doc_id"]), r["n_removed"]) for r in got)
        assert sizes == sorted(w[:2] for w in wanted)


def test_packed_numbers():
    for values in ([], [5], [-3, 7], [0, 255], [0, 256], [1 << 40, 3], [-(1 << 63), (1 << 63) - 1]):
        a = np.array(values, np.int64)
        back, end = substring_dedup._unpack(data := substring_dedup._pack(a), 0, len(a))
        assert back.tolist() == values and end == len(data)


# -- 2

RECORDS = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, body string, profile string"


def test_latest_response_without_an_id(spark):
    e = {"ETag": "a"}
    rows = [
        (1, "http://x.org/p", 1, "response", 200, e, "old", None), (None, "http://x.org/p", 5, "response", 200, e, "new", None), (9, "http://x.org/p", 8, "revisit", 304, e, None, None),
        (10, "http://x.org/p", 8, "revisit", 200, e, None, None), (11, "http://x.org/p", 8, "revisit", None, e, None, "http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
        (12, "http://x.org/p", 8, "revisit", 304, e, None, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    ]
    got = {r["record_id"]: (r["outcome"], r["source_id"], r["body"]) for r in revisit.resolve(spark.createDataFrame(rows, RECORDS), only_304=True).filter("kind = 'revisit'").collect()}
    assert got == {9: ("resolved", None, "new"), 10: ("not-304", None, None), 11: ("resolved", None, "new"), 12: ("not-304", None, None)}


def test_repeated_responses_and_skewed_times(spark, monkeypatch):
    monkeypatch.setattr(revisit, "BLOCK_ROWS", 5)
    r = random.Random(1)
    rows = [(i % 30, f"http://x.org/{i % 2}", r.choice([10**15, r.randrange(40)]), r.choice(["response", "revisit"]), None, {"ETag": "t"}, f"b{r.randrange(3)}", None) for i in range(150)]
    rows = [(i, u, ts, k, 200 if k == "response" else 304, h, b if k == "response" else None, p) for i, u, ts, k, _, h, b, p in rows]
    rows += rows[:20]
    outs = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = revisit.resolve(spark.createDataFrame(rows, RECORDS).repartition(4)).filter("kind = 'revisit'").collect()
        outs.append(sorted((x["record_id"], x["url_key"], x["ts"], x["outcome"], x["source_id"], x["body"]) if x["body"] else (x["record_id"], x["url_key"], x["ts"], x["outcome"], -1, "") for x in got))
    assert outs[0] == outs[1] and len(outs[0]) == sum(x[3] == "revisit" for x in rows)  # a revisit is never multiplied
    for rid, url, ts, outcome, source, body in outs[0]:
        before = [(t, i) for i, u, t, k, _, _, _, _ in rows if k == "response" and t < ts and u.endswith(url)]
        assert (outcome == "resolved") == bool(before)
        if before:
            assert source == max(before)[1] and any(x[0] == source and x[2] == max(before)[0] and x[6] == body for x in rows)


# -- 4


def test_noisy_or_against_a_slow_version():
    r = np.random.default_rng(3)
    n_words, doc = 6, np.repeat(np.arange(5), [1, 3, 0, 2, 4])
    row, column = np.array([s for s in range(len(doc)) for _ in range(3)]), r.integers(0, n_words, 3 * len(doc))
    y, theta = np.array([1.0, 0, 1, 0, 1]), r.normal(size=n_words + 1)

    def slow(theta):
        total = 0.0
        for d in range(5):
            clean = 1.0
            for s in np.flatnonzero(doc == d):
                z = theta[-1] + sum(theta[c] for c, at in zip(column, row) if at == s)
                clean *= 1 - 1 / (1 + math.exp(-z))
            clean *= math.exp(-1e-9)  # a document without sentences is toxic with next to no probability
            total += -math.log(1 - clean) if y[d] else -math.log(clean)
        return total / 5

    value, gradient = toxicity.loss(theta, column, row, doc, y)
    assert value == pytest.approx(slow(theta), rel=1e-6)
    for k in range(n_words + 1):
        step = np.eye(n_words + 1)[k] * 1e-5
        assert gradient[k] == pytest.approx((slow(theta + step) - slow(theta - step)) / 2e-5, rel=1e-4, abs=1e-7)


def test_scores_against_a_slow_version(spark):
    texts = ["Good day. vile thing! Über­größen sind schön\nvile", "", None, "größer größeres GRÖßE vile. ...", "one two three"]
    shapes = lambda w: [w, *(w[:k] for k in (6, 7, 8) if len(w) > k)]
    code = {}
    for t in texts:
        for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            for k, s in enumerate([low, *(low[:n] if len(low) > n else None for n in (6, 7, 8))]):
                if s is not None:
                    raw = np.frombuffer(s.encode(), np.uint8)
                    code[k, s] = int(common.mix64(common.word_hashes(raw, np.array([0]), np.array([len(raw)])) + np.uint64(k)).view(np.int64)[0])
    assert shapes("abcdefg") == ["abcdefg", "abcdef"]
    chosen = sorted(code)[::2]
    words = np.array(sorted(code[c] for c in chosen), np.int64)
    weights = np.random.default_rng(5).normal(size=len(words))
    weight = {int(h): float(x) for h, x in zip(words, weights)}
    model = toxicity.Model(-1.0, words, weights)
    got = {x["doc_id"]: x for x in toxicity.score(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", t or ""):
            found = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence)
            if found:
                z = -1.0
                for w in found:
                    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                    z += sum(weight.get(code[k, s], 0.0) for k, s in enumerate([low, *(low[:n] if len(low) > n else None for n in (6, 7, 8))]) if s is not None)
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-9) and got[i]["predicted"] == int(1 - clean >= 0.3)


# -- 5


def _ids(kind, n):
    r = random.Random(kind)
    return {"sparse": [k * 10**9 for k in range(n)], "hashed": [r.getrandbits(63) - (1 << 62) for _ in range(n)], "negative": list(range(-n, 0)), "one": [5] * n, "null": [None] * (n // 2) + list(range(n - n // 2))}[kind]


@pytest.mark.parametrize("kind", ["sparse", "hashed", "negative", "one", "null"])
def test_any_ids_reach_the_target_size(spark, kind):
    rows = docs(spark, [(i, f"text number {k} " * 5) for k, i in enumerate(_ids(kind, 400))]).repartition(6)
    got = sharding.shard(rows, arrival_rows=10, target_bytes=4000)
    shards = got.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), F.max("shard_docs").alias("sd"), F.max("shard_bytes").alias("sb")).collect()
    assert got.count() == 400 and all(s["n"] == s["sd"] and s["b"] == s["sb"] for s in shards)
    assert sum(s["b"] < 4000 for s in shards) <= 6 and max(s["b"] for s in shards) < 3 * 4000
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == sorted(str(i) for i in _ids(kind, 400))


def test_arrivals_are_cut_by_rank(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs(spark, [(3 * i, "x") for i in range(95)]).repartition(7), arrival_rows=10)
    assert sorted((r["shard_id"], r["n_docs"]) for r in store.manifest().collect()) == [(k, 10 if k < 9 else 5) for k in range(10)]
    assert all(r["doc_id"] // 30 == r["shard_id"] for r in store.read().collect())


def test_lost_and_late_writers_leave_the_store_usable(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store, other = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    store.append(docs(spark, [(i, "a b c") for i in range(20)]), arrival_rows=5)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "commit", crash)
        with pytest.raises(KeyboardInterrupt):  # killed between its write and its commit
            other.append(docs(spark, [(100, "lost")]))
    assert store.version() == 1 and store.read().count() == 20
    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "version", lambda _: 0)  # began before version 1 was there
        with pytest.raises(RuntimeError):
            other.append(docs(spark, [(200, "late")]))
    assert store.read().count() == 20
    assert store.append(docs(spark, [(300, "next")])) == 2 and store.read().count() == 21
    assert store.compact(target_bytes=1 << 20) == 3 and store.read().count() == 21 and store.read(1).count() == 20
    assert store.vacuum(min_age_s=-60) > 0 and store.read().count() == 21
    left = [p for p in (tmp_path / "s/data").rglob("shard_id=*")]
    assert len(left) == store.manifest().count()
    assert store.vacuum(min_age_s=-60) == 0
    assert store.append(docs(spark, [])) == 4 and store.read().count() == 21


# -- 6


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_long_words_in_time_near_linear(spark):
    r = random.Random(6)
    vocabulary, library = token_counts.Vocabulary.load(registry.vocabulary_path()), _library()
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzßéø") for _ in range(200_000))
    texts = [letters, "a" * 50_001, "ab" * 20_000 + "!" * 999, "".join(r.choice("ACGT") for _ in range(30_000)), "x" * 257 + " " + "y" * 256]
    began = time.perf_counter()
    got = token_counts.Counter(vocabulary).count(texts)
    assert time.perf_counter() - began < 60
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_both_ways_of_merging_agree():
    r = random.Random(7)
    v = token_counts.Vocabulary.load(registry.vocabulary_path())
    words = ["".join(r.choice("etaoinshr" if k % 2 else "aab") for _ in range(r.randrange(1, 200))).encode() for k in range(300)]
    assert token_counts.merged_lengths(words, v).tolist() == [token_counts.merged_length(w, v) for w in words]


# -- 7


def test_statistics_against_a_slow_version():
    texts = ["", None, "One two  TWO two two\nline 1\n\nline 1\n|a| #b! é 你好", "\n \t", "A" * 300, "a b c d a b c d a b"] + _vocabulary_texts(2, 10)
    x = quality_classifier.features(pa.array(texts))
    for row, text in zip(x, texts):
        text = text or ""
        raw, words = text.encode(), WORD.findall(text)
        # a text's words by bytes
        w, size = max(len(words), 1), max(len(raw), 1)
        count = lambda members: sum(c in members for c in raw)
        known = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,;:?'\"-()!|#*$%&<>~^_={}[]\\/@+`"
        grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
        lines = [line for line in raw.split(b"\n") if line]
        wanted = {
            "words": math.log1p(len(words)), "word_bytes": sum(len(t.encode()) for t in words) / w, "other": sum(c not in known for c in raw) / size, "lower": count(b"abcdefghijklmnopqrstuvwxyz") / size, "upper": count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, "digit": count(b"0123456789") / size,
            "newline": count(b"\n") / w, "stop": count(b".,;:?'\"-()") / w, "shout": count(b"!") / w, "bar": count(b"|") / w, "symbol": count(b"#*$%&<>~^_={}[]\\/@+`") / w, "distinct": len(set(words)) / w, "distinct_4": len(set(grams)) / max(len(grams), 1),
            "twice_in_row": sum(a == b for a, b in zip(words, words[1:])) / w, "longest": math.log1p(max((len(t.encode()) for t in words), default=0)), "short": sum(len(t.encode()) <= 2 for t in words) / w,
            "lines": len(words) / max(len(lines), 1), "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "upper_first": sum("A" <= t[0] <= "Z" for t in words) / w,
        }
        assert dict(zip(quality_classifier.FEATURES, row.tolist())) == pytest.approx(wanted, abs=1e-12)


# -- 8


def test_short_items_of_every_length(spark):
    r = random.Random(3)
    items = [(n, "".join(r.choice("abc") for _ in range(n))) for n in range(1, 20)]
    texts = [" ".join(r.choice([r.choice(items)[1], "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))]) for _ in range(8)) for _ in range(60)]
    found = decontamination.contaminations(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in found.collect()}
    assert got == {(i, n): 0 for i, t in enumerate(texts) for n, item in items if item in t.split()} and len({n for _, n in got}) > 15


# -- 9


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_rows_of_any_ids_meet_their_targets(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 7, k]), " ".join("w" * r.randrange(3) for _ in range(r.randrange(6))) if r.random() < 0.6 else "same text", "en", r.choice(["a", "a", "b", None]), 1) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(df).collect()
    assert len(found) == 300
    took = {}
    for x in found:
        took[x["source"]] = took.get(x["source"], 0) + x["copies"] * x["size"]
    target = {x["source"]: x["target"] for x in found}
    assert all(abs(took[s] - target[s]) <= 12 for s in target)
    out = mixing.apply_mix(df.repartition(5)).collect()
    mixed = {}
    for x in out:
        mixed[x["source"]] = mixed.get(x["source"], 0) + len(WORD.findall(x["text"]))
    assert all(abs(mixed.get(s, 0) - target[s]) <= 12 for s in target)
    here = {}
    for x in rows:
        here[x] = here.get(x, 0) + 1
    assert all(sum(tuple(x) == row for x in out) <= 2 * n for row, n in here.items())


def test_the_cut_lies_anywhere_in_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "RUN_ROWS", 3)
    df = docs(spark, [(i // 4, "a b c") for i in range(80)], ["x", "y", "y"])
    for share in (0.0, 0.3, 1.0, 1.99, 2.0):
        total = sum(x["copies"] * x["size"] for x in mixing.mix(df, share=share).collect())
        assert share * 240 - 6 < total <= share * 240 + 1e-9
        assert mixing.apply_mix(df, share=share).count() * 3 == total


# -- 10


def test_components_of_documents_against_all_pairs(spark):
    r = random.Random(12)
    base = _vocabulary_texts(9, 12, 60, 40)
    texts = list(base)
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            if r.random() < 0.7:
                v[r.randrange(len(v))] = r.choice(["w1", "w2", "zz"])
            texts.append(" ".join(v).upper() if r.random() < 0.3 else "  ".join(v))
    texts += ["", None, " \n"]
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    got = {x["doc_id"]: (x["fp"] & (2**64 - 1), x["component_id"]) for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps, part = {i: _fingerprint(t) for i, t in rows}, {i: i for i in ids}
    linked = 0
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                linked += fps[i] != fps[j]
                a, b = sorted((part[i], part[j]))
                part = {k: a if v == b else v for k, v in part.items()}
    assert got == {i: (fps[i], part[i]) for i in ids} and linked > 0


# -- the pipeline


def _similar(a, b):
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b)]
    return bool(sets[0]) and 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])


def test_pipeline_against_brute_force(spark):
    """As the stages say: near copies are fingerprints within two bits or five-word shingles with a similarity of 0.8."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text").toPandas()
    pdf = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    judged = registry.QUERIES["op3_quality_rules"](spark, sf).toPandas().set_index("doc_id")["kept"]
    texts = {i: t for i, t in zip(pdf["doc_id"], pdf["text"]) if judged[i]}
    fps, part = {i: _fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and part[i] != part[j] and ((fps[i] ^ fps[j]).bit_count() <= 2 or _similar(texts[i], texts[j])):
                a, b = sorted((part[i], part[j]))
                part = {k: a if v == b else v for k, v in part.items()}
    items = [decontamination.normalize(t) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()["text"]]
    keep = [i for i in set(part.values()) if not any(item in decontamination.normalize(texts[i]) for item in items)]
    mixed = {x["doc_id"]: x["copies"] for x in mixing.mix(spark.createDataFrame(pdf[pdf["doc_id"].isin(keep)])).collect()}
    assert got["doc_id"].value_counts().to_dict() == {i: n for i, n in mixed.items() if n}
    assert all(texts[i] == t for i, t in zip(got["doc_id"], got["text"]))


def test_stages_bear_awkward_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = awkward(spark)
    for df in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert set(df.columns) - set(sharding.RESERVED) <= set(out.columns), name
            assert out.count() >= 0 and (df is rows or out.count() == 0)


def test_similar_links_of_nothing(spark):
    assert simhash.keep_one(docs(spark, []), similar=True).count() == 0 and jaccard.WORDS == 5


def test_documents_are_dropped_alike_by_join_and_by_automaton(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(30)]
    items = spark.createDataFrame([(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))) for k in range(25)] + [(None, "x y z"), (3, None), (4, " ")], "item_id long, text string")
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 25))) for _ in range(60)] + [x["text"] for x in items.collect() if x["text"]] + [None, ""]
    rows = docs(spark, texts).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars")))
    rows = rows.withColumns({"dk": F.lit(1), "h": F.lit(2), "_held": F.lit("x"), "gid": F.lit(0)})
    one, many = ({"block_chars": n} for n in (1 << 20, 10))
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(decontamination.contaminations(rows, items, **one)) == as_rows(decontamination.contaminations(rows, items, **many))
    kept = decontamination.drop_contaminated(rows, items, **many)
    assert as_rows(decontamination.drop_contaminated(rows, items, **one)) == as_rows(kept) and kept.columns == rows.columns and 5 < kept.count() < rows.count()
    assert decontamination.contaminations(rows.limit(0), items, **many).count() == 0
