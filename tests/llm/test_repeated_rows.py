"""Repeated rows, empty tables and plain versions of what has no SQL."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints, langid, neardup, packing, pii, pipeline, quality, rules
from tests.llm.test_operators import KEY, WORDS, least_reachable, shingles, text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def twice(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 30 + 9 * i) + f"\nline {i % 3}", "en", "s", 1) for i in range(20)] + [(90, None, None, None, None), (91, "", "en", "s", 0)]
    return spark.createDataFrame(rows + rows, SCHEMA).repartition(3)


def test_stages_neither_add_nor_lose_repeated_rows(spark, twice):
    for stage in (pipeline.line_stage, pipeline.pii_stage):
        out = stage(spark, twice, "")
        assert out.columns == pipeline.COLUMNS and out.count() == twice.count()
    assert {r["count"] for r in pipeline.near_duplicate_stage(spark, twice, "").groupBy("doc_id").count().collect()} == {2}
    for query in (fingerprints.edited_pairs, langid.held_out_predictions, pii.surrogates):
        assert query(twice).count() == twice.count()
    assert quality.score(twice, None).count() == twice.count()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({i: i + 32 for i in range(65, 91)})
    seen, first = {}, {}
    for i in sorted(texts):
        for k, x in enumerate(texts[i].split("\n")):
            seen.setdefault(strip(x), set()).add(i)
            first.setdefault(strip(x), (i, k))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not strip(x) or len(seen[strip(x)]) < 10 or first[strip(x)] == (i, k)) for i, t in texts.items()}
    got = pipeline.line_stage(spark, docs, sf)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    roots = least_reachable({i: shingles(t, 5) for i, t in want.items()})
    kept = pipeline.near_duplicate_stage(spark, got, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in roots.items() if i == r)


def test_full_pieces_of_repeated_rows_have_their_own_sequences(spark):
    row = (5, " ".join(WORDS * 60), None, None, None)
    got = packing.pack_documents(spark.createDataFrame([row, row, row, (6, "a", None, None, None)], SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(n == 4096 for s in by.values() for _, n in s) >= 3
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == list(itertools.accumulate([0, *(n for _, n in s)]))[:-1] and sum(n for _, n in s) <= 4096


def test_texts_meet_their_ids_with_and_without_broadcast(spark):
    rng = random.Random(5)
    base = [text(rng, 60) for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "x" for w in base[i % 6].split())) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(3)
    want = least_reachable({i: shingles(t, 4) for i, t in rows})
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (plain, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, words=4).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_hot_lists_and_classes_of_many_pairs(spark, monkeypatch):
    """One family whose lists are dealt over several tasks and whose classes have more pairs than one task takes."""
    monkeypatch.setattr(neardup, "PAIRS", 3)
    monkeypatch.setattr(neardup, "HOT_LEAST", 40)
    rng = random.Random(3)
    first = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(first)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(90)] = f"{rng.choice(WORDS)}{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), words=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least_reachable({i: shingles(t, 4) for i, t in rows})


def test_lists_hold_every_link(spark):
    """Every pair of 0.8 or more meets in a list."""
    rng = random.Random(12)
    base = [[rng.choice(WORDS) for _ in range(n)] for n in (4, 7, 12, 30, 33, 36, 60, 200)]
    rows = []
    for w in base * 12:
        w = list(w)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((len(rows), " ".join(w)))
    sk = neardup.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 2).dropDuplicates(["sig"])
    lists = neardup.entries(sk.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")).collect()
    by = {}
    for r in lists:
        by.setdefault(r["id"], set()).add(r["key"])
    sets = {r["doc_id"]: shingles(rows[r["doc_id"]][1], 2) for r in sk.collect()}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 20 and all(by.get(a, set()) & by.get(b, set()) for a, b in linked)


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(size=(30, 4)), rng.normal(size=(50, 4)), rng.normal(size=4)
    for prior in (0.05, 0.5):
        def plain(w, prior=prior):
            loss = lambda z: np.log(1 + np.exp(-z))
            rest = np.mean([loss(-(x @ w)) for x in u]) - prior * np.mean([loss(-(x @ w)) for x in p])
            return prior * np.mean([loss(x @ w) for x in p]) + max(0, rest)

        value, step = quality.risk(w, p, u, prior)
        assert abs(value - plain(w)) < 1e-9
        slope = np.array([(plain(w + d) - plain(w - d)) / 2e-6 for d in np.eye(4) * 1e-6])
        assert np.allclose(step, slope, atol=1e-5)


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled_rows_alone(spark, share):
    rng = random.Random(7)
    rows = [(i, text(rng, 60) if rng.random() < share else "BUY NOW!! " * rng.randint(5, 40)) for i in range(1500)]
    good = {i for i, t in rows if "BUY" not in t}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in sorted(good)[::3]], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert abs(model["prior"] - share) < 0.1
    got = {r["doc_id"]: r["score"] >= 0.5 for r in quality.score(docs, model).collect()}
    assert np.mean([got[i] == (i in good) for i, _ in rows]) > 0.97


def test_surrogates_of_one_key_and_of_none(spark):
    docs = spark.createDataFrame([(1, "ann@one.com bob@one.com 192.168.3.4 GB82 WEST 1234 5698 7654 32")], "doc_id long, text string")
    once, again, other = (pii.surrogates(docs, k).first()["text"] for k in (KEY, KEY, None))
    assert once == again != other
    a, b, ip, *iban = once.split()
    assert a.split("@")[1] == b.split("@")[1] != "one.com" and a != b
    assert ip.startswith("192.168.") and ip != "192.168.3.4"
    new = "".join(iban)
    assert new[:2] == "GB" and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", " ".join(iban))


def test_mixture_against_a_plain_version():
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet(np.ones(40), 3).T, rng.integers(1, 9, 40).astype(float)
    share = [1 / 3] * 3
    for _ in range(langid.ROUNDS):
        mine = [0.0] * 3
        for g in range(40):
            whole = sum(share[k] * p[g, k] for k in range(3))
            for k in range(3):
                mine[k] += n[g] * share[k] * p[g, k] / whole
        new = [x / n.sum() for x in mine]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
        share = new
        if done:
            break
    got, value = langid.mixture(p, n)
    assert np.allclose(got, share) and abs(value - sum(n[g] * np.log(sum(share[k] * p[g, k] for k in range(3))) for g in range(40))) < 1e-9


def test_ablation_counts(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([text(rng, 30), text(rng, 3), "a # b " * 20, "x\nx\nx\nx " * 9, "ABCDEF GHIJ " * 15, None])) for i in range(80)]
    led = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "failures").collect()
    bits = {name: 1 << k for k, (name, _) in enumerate(rules.RULES)}
    got = {r["rule"]: (r["failing"], r["only_this"]) for r in rules.ablation(spark.createDataFrame(led)).collect()}
    own = [r["failures"] & rules.mask("v1") for r in led]
    assert got == {name: (sum(f & b > 0 for f in own), sum(f == b for f in own)) for name, b in bits.items() if name in rules.POLICIES["v1"]}
    assert any(n for n, _ in got.values())
