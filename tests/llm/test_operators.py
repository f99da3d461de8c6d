"""Each operator on a small fixture: nulls, empty and long texts, repeated rows, extra columns, empty tables, brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, fingerprints, graph, langid, licenses, lines, neardup, packing, pii, quality, rules
from gridloom.llm.common import lowest

KEY = b"only for tests"
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [text(rng, n) for n in (5, 9, 12, 40, 120, 300, 800, 4000)]
    out = list(base)
    for b in base[2:]:
        w = b.split()
        for share in (0.01, 0.03, 0.05, 0.2):
            out.append(" ".join(x if rng.random() > share else rng.choice(WORDS) for x in w))
    out += [base[3].upper(), base[4], "Mail a.b@mail.example.com or +1 (386) 555-3733, a.b@mail.example.com", "one\n\ntwo\n  ONE \n\r\n", "", "   \n\t", None, "x", "THE!! " * 50, "é ß 日本 🙂 " * 9, "Licensed under the Apache License, Version 2.0.\n" + base[5], "a" * 5000]
    out += [f"shared line\nown {k}" for k in range(12)]
    return [(i, t, None if t is None else rng.choice(["en", "de", None]), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("bucket", "h", "key", "id", "score", "component", "shard", "copy", "words", "path", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def collect(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(docs, rows, none):
    got, ids = collect(fingerprints.edited_pairs(docs)), [r[0] for r in rows]
    texts = {r[0]: r[1] or "" for r in rows}
    errors = []
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, u = texts[a], texts[b]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[a]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[a]["n_chars"] == len(t)
        x, y = shingles(t, 5), shingles(e, 5)
        errors.append(got[a]["near_edited"] - (len(x & y) / len(x | y) if x | y else 1))
    assert np.abs(errors).mean() < 0.05
    one = collect(fingerprints.fingerprints(docs))
    assert all(one[i]["fingerprint"] == got[i]["fingerprint"] for i in ids)
    assert fingerprints.edited_pairs(none).count() == 0
    assert collect(fingerprints.edited_pairs(docs.filter("doc_id = 3")))[3]["near_next"] == 1.0
    many = collect(fingerprints.with_next(docs, bucket_rows=4).filter("ahead = 0").withColumnRenamed("bucket", "b"))
    assert len({r["b"] for r in many.values()}) > 5


def test_buckets_do_not_change_results(docs, monkeypatch):
    one = collect(fingerprints.edited_pairs(docs))
    many = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d: many(d, 5))
    assert collect(fingerprints.edited_pairs(docs)) == one


def least_reachable(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("cell", [2048, 20])
def test_near_duplicates_in_long_lists(spark, monkeypatch, cell):
    """One family of texts of which most are just under the threshold: every list is long, and few of its pairs are links."""
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    rng = random.Random(11)
    family = [[rng.choice(WORDS) for _ in range(100)]]
    for _ in range(260):
        w = list(rng.choice(family) if rng.random() < 0.3 else family[0])
        for k in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(100)] = f"{rng.choice(WORDS)}{rng.randrange(9)}"
        family.append(w)
    ids = rng.sample(range(1000), len(family))
    rows = [(i, " ".join(w)) for i, w in zip(ids, family)]
    want = least_reachable({i: shingles(t, 4) for i, t in rows})
    got = collect(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) > 10


@pytest.mark.parametrize("limit", [48, 2])
def test_near_duplicates(docs, rows, none, monkeypatch, limit):
    monkeypatch.setattr(neardup, "LIST", limit)
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    want = least_reachable(sets)
    got = collect(neardup.near_duplicates(docs, words=4))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.near_duplicates(docs.unionByName(docs)).count() == 2 * len(rows)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {i: i for p in pairs for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: find(i) for p in pairs for i in p if p[0] != p[1]}


def test_language(spark, docs, rows, none):
    rng = random.Random(2)
    de = "der die das und nicht ist ein eine zu auf für mit sich von dem den werden haben wir über schön Straße".split()
    train = [(i, " ".join(rng.choice(WORDS if i % 2 else de) for _ in range(60)), "en" if i % 2 else "de") for i in range(200)]
    langs, p = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = collect(langid.predict(spark.createDataFrame([(1, "the water and the people", "x"), (2, "die Straße und das", "x"), (3, None, "x"), (4, "12 !!", "x"), (5, " ".join(WORDS[:40] + de), "x")], "doc_id long, text string, lang string"), langs, p))
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert min(got[5]["shares"]) > 0.1 and abs(sum(got[5]["shares"]) - 1) < 1e-3
    assert langid.held_out_predictions(docs).count() == len(rows)
    assert langid.held_out_predictions(none).count() == 0


def test_licenses(spark, docs, rows, none):
    got = collect(licenses.license_rows(docs))
    assert len(got) == len(rows) and sum(r["license"] is not None for r in got.values()) >= 1
    files = spark.createDataFrame([(1, "Released under the MIT License.", "a/LICENSE", True), (2, "x", "a/b/c.txt", False), (3, "Licensed under CC BY-NC 4.0.", "a/b/d/LICENSE", True), (4, None, "a/b/d/e/f.txt", False), (5, "x", "z/y.txt", False), (6, "", None, False)], "doc_id long, text string, path string, is_license boolean")
    out = collect(licenses.inherited(files, licenses.scanned(files)))
    assert [out[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None, None]
    assert licenses.license_rows(none).count() == 0
    gnu = """/* This program is free software: you can redistribute it and/or
 * modify it under the terms of the GNU General Public License as published
 * by the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */
int main() { return 0; }"""
    heads = ["// SPDX-License-Identifier: Apache-2.0\nimport x", gnu, "a plain text of the people and the water", "* SPDX-License-Identifier: GPL-2.0-only", text(random.Random(1), 3000) + "\nReleased under the MIT License."]
    head = spark.createDataFrame([(i, t) for i, t in enumerate(heads)], "doc_id long, text string")
    assert {i: r["license"] for i, r in collect(licenses.scanned(head)).items()} == {0: "Apache-2.0", 1: "GPL-3.0", 3: "GPL-2.0-only", 4: "MIT"}
    ties = spark.createDataFrame([(1, "Licensed under CC BY 4.0", "a/B", True), (2, "Licensed under the Apache License, Version 2.0", "a/A", True), (3, "x", "a/c.txt", False)], "doc_id long, text string, path string, is_license boolean")
    assert collect(licenses.inherited(ties, licenses.scanned(ties)))[3]["license"] == "Apache-2.0"


def test_licenses_agree_with_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    want = {r[0]: r for r in duckdb.sql(licenses.ORACLE_OP4).fetchall()}
    got = collect(licenses.license_rows(docs))
    assert {i: (r["path"], r["license"], r["origin"]) for i, r in got.items()} == {i: (r[1], r[2], r[4]) for i, r in want.items()}
    assert all(abs((got[i]["similarity"] or 0) - (want[i][3] or 0)) < 1e-5 for i in got)


def test_rules(docs, rows, none):
    got = collect(rules.rule_rows(docs))
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {x for x in win if win.count(x) > 1} if len(win) < 1000 else {x for x, n in __import__("collections").Counter(win).items() if n > 1}
        n = len({k + j for k, x in enumerate(win) if x in twice for j in range(8)})
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), n), i
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * n > 30 * len(w))
    assert rules.rule_rows(none).count() == 0
    led = rules.ledger(docs)
    assert {r["rule"] for r in rules.ablation(led).collect()} == {n for n, _ in rules.RULES}


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, docs, rows, none, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collect(lines.deduplicated(docs, min_docs=3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({i: i + 32 for i in range(65, 91)})
    seen = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(strip(x), set()).add(i)
    for i, t, *_ in rows:
        keep = [x for x in (t or "").split("\n") if not strip(x) or len(seen[strip(x)]) < 3]
        assert got[i]["text"] == "\n".join(keep) and got[i]["n_lines"] == len((t or "").split("\n"))
    assert lines.deduplicated(none).count() == 0
    first = collect(lines.deduplicated(docs, min_docs=2, keep_first=True))
    assert sum("shared line" in r["text"] for r in first.values()) == 1


def test_quality(spark, docs, rows, none):
    rng = random.Random(3)
    many = [(i, text(rng, 80) if i % 4 else "BUY NOW!! " * 40) for i in range(400)]
    d = spark.createDataFrame(many, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    got = collect(quality.held_out_scores(d, lab))
    assert np.mean([got[i]["predicted"] == (i % 4 > 0) for i in range(400)]) > 0.97
    assert len(collect(quality.held_out_scores(docs, lab))) == len(rows)
    assert quality.held_out_scores(none, lab).count() == 0
    assert {r["score"] for r in quality.held_out_scores(docs, lab.filter("doc_id < 0")).collect()} == {0.5}


def test_pii(docs, rows, none, spark):
    got = collect(pii.surrogates(docs))
    for i, t, *_ in rows:
        if not pii.find(t or ""):
            assert got[i]["text"] == (t or "")
    d = spark.createDataFrame([(1, "Mrs Jane Doe, Mr John Doe, 4012888888881881, +1 (386) 555-3733, 386-555-3733"), (2, "Mrs Jane Doe password=d9f3929e83c8655244 10.1.2.3 x@y.org X@Y.org 123-45-6789"), (3, None)], "doc_id long, text string")
    out = collect(pii.surrogates(d))
    for t in ("Jane", "John", "4012888888881881", "555-3733", "d9f3929e83c8655244", "x@y.org", "123-45-6789"):
        assert t not in out[1]["text"] + out[2]["text"]
    a, b = out[1]["text"].split(","), out[2]["text"]
    assert a[0] == b[: len(a[0])] and a[0] != a[1]
    assert re.fullmatch(r" \+1 \(\d{3}\) \d{3}-\d{4}", a[3])
    assert pii.surrogates(none).count() == 0
    new = {pii.surrogate("phone", f"+1386555{k:04}", 0, KEY) for k in range(2000)}
    assert len(new) == 2000


def test_pii_redraws_collisions(spark, monkeypatch):
    plain = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, v, attempt, key: "same" if attempt == 0 else plain(kind, v, attempt, key))
    found = spark.createDataFrame([("ssn", f"123-45-{k:04}") for k in range(30)], "kind string, value string")
    monkeypatch.setattr(pii, "_drawn", lambda rows, key: spark.createDataFrame([(r["kind"], r["value"], r["attempt"], pii.surrogate(r["kind"], r["value"], r["attempt"], key)) for r in rows.collect()], "kind string, value string, attempt int, new string"))
    assert pii.redrawn(found, KEY).count() == 29


def test_bpe_matches_library(docs, rows, none):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got, own = collect(bpe.round_trip_digests(docs)), collect(bpe.encoded(docs))
    for i, t, *_ in rows:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (own[i]["ids"] or b"") == ids.tobytes()
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    rng, c = random.Random(5), bpe.codec(path, pattern)
    for _ in range(400):
        t = "".join(rng.choice("ab'stre \n\t  é日🙂12!?-\x1c\x85　") for _ in range(rng.randrange(60)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == lib.encode_ordinary(t)
    c.fst.max_states, c.fst.hold = 50, 7
    t = " ".join(WORDS) * 3
    c.known.clear()
    assert np.frombuffer(c.encode(t), "<u4").tolist() == lib.encode_ordinary(t)
    back = collect(bpe.decoded(bpe.encoded(docs)))
    assert all(back[i]["text"] == (t or "") for i, t, *_ in rows)
    s = bpe.Utf8Stream()
    assert "".join(s.feed(bytes([x])) for x in "é日🙂a".encode()) + s.close() == "é日🙂a"
    assert bpe.round_trip_digests(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for p, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            cut = np.array(ids[4096 * p : 4096 * p + 4096], "<u4")
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (p, 4096 * p, len(cut), zlib.crc32(cut.tobytes()))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096
    assert packing.pack_documents(none).count() == 0
    rng = random.Random(6)
    lengths = [rng.choice((rng.randint(1, 300), rng.randint(1000, 4095))) for _ in range(2000)]
    bins = packing.pack(lengths)
    assert sorted(itertools.chain(*bins)) == list(range(2000)) and len(bins) <= 1.06 * sum(lengths) / 4096 + 1
    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(300):
        t = "".join(rng.choice("abcStREé日🙂12!?-' \nßœ</w>\x85") for _ in range(rng.randrange(40)))
        assert np.frombuffer(tok.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, sf).cache()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() > 50


def test_samples_of_large_tables(spark):
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    assert ids.filter(lowest(100, 100, "doc_id")).count() == 2000 and ids.filter(lowest(100, 0, "doc_id")).count() == 2000
    assert 150 < ids.filter(lowest(200, 2000, "doc_id")).count() < 250
    share = lowest(5000, 10**12, "doc_id")
    assert "5000000" in str(share)
