"""Exact and near duplicates, fingerprints and personal data against plain versions."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, components, exact_dedup, fingerprints, pii, queries, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
LONG = " ".join(WORDS[i * i % 12] for i in range(60_000))
ODD = [(5, None), (6, ""), (7, " \t\n"), (8, "É"), (9, " x y"), (10, "x"), (11, "a" * 300_000), (12, LONG), (13, LONG)]


@pytest.fixture(scope="module")
def rows(spark, small):
    found = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return [(row[0], row[1]) for row in found]


def near_copies():
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(400)]
    out = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(400)] = "zz"
        out.append((100 + i, " ".join(words)))
    return out


def test_near_groups(spark, make, small, rows):
    cases = rows[:120] + [(1000 + i, t) for i, t in ODD + near_copies()]
    found = simhash.near_groups(make(cases))
    got = {r.doc_id: (f"{r.fingerprint % 2**64:016x}", r.component_id) for r in found.collect()}
    assert got == brute.near_components(cases)
    assert len({c for _, c in got.values()}) < len(got)
    result = queries.op4_simhash_near_dedup(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result} == brute.near_components(rows)


def test_near_groups_edges(make):
    assert simhash.near_groups(make([(1, "a")]).limit(0)).count() == 0
    cases = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A B C D"), (None, "other words here now")]
    got = sorted(map(tuple, simhash.near_groups(make(cases)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 2), (3, 2), (3, 2), (2, 2), (None, None)], key=str)
    kept = simhash.drop_near_copies(make(cases))
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == [("A B C D", 2), ("other words here now", None)]
    assert kept.columns == make(cases).columns
    repeated = [(1, "p q r s"), (1, "p q r s"), (1, "completely different text of its own")]
    assert sorted(r.text for r in simhash.drop_near_copies(make(repeated)).collect()) == [
        "completely different text of its own",
        "p q r s",
    ]


def test_links_join_everything_within_the_radius(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(30)}
    for value in list(values):
        for _ in range(3):
            values.add(value ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    numbered = [(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame(numbered, "id long, fingerprint long")
    found = simhash.links(nodes, 2)
    roots = {r.node: r.root for r in components.components(found).collect()}
    assert roots
    signed = [v for _, v in numbered]
    for a in signed:
        for b in signed:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert roots.get(a, a) == roots.get(b, b)
    with pytest.raises(ValueError):
        simhash.links(nodes, 3)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i + 1, i) for i in range(1, 200)]
    hub = [(1000 + i, 999) for i in range(1, 500)]
    links = spark.createDataFrame(path + hub + path[:5], "node long, parent long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {i: 1 for i in range(2, 201)} | {1000 + i: 999 for i in range(1, 500)}
    assert components.components(links.limit(0)).count() == 0


def test_exact_groups(make):
    cases = [(1, "Ab"), (2, "aB"), (3, "ÉE"), (4, "ée"), (5, None), (6, ""), (7, "ab "), (7, "ab "), (None, "ab"), (None, "zz")]
    cases += [(100 + i, "hot") for i in range(200)] + [(12, LONG), (13, LONG.upper())]
    got = exact_dedup.exact_groups(make(cases).repartition(7))
    found = sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=str)
    groups = {}
    for doc_id, text in cases:
        groups.setdefault(brute.lower_ascii(text or ""), []).append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, best[brute.lower_ascii(t or "")], len(groups[brute.lower_ascii(t or "")])) for i, t in cases]
    assert found == sorted(expected, key=str)
    smallest = exact_dedup.exact_groups(make(cases), keep="min")
    assert {r.keep_id for r in smallest.where("group_size = 200").collect()} == {100}
    kept = exact_dedup.drop_exact_copies(make(cases))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, "aB"), (3, "ÉE"), (4, "ée"), (6, ""), (7, "ab "), (None, "zz"), (299, "hot"), (13, LONG.upper())], key=str
    )
    assert kept.columns == make(cases).columns
    assert exact_dedup.exact_groups(make(cases).limit(0)).count() == 0


def test_runs_merge_by_rounds(spark):
    # One digest in every third run, others in few; runs hold one row per digest.
    level = [(run, f"{digest:02x}" * 32, digest, run * 7 % 4096, 1 + run % 3) for run in range(0, 4096, 3) for digest in (5, 200)]
    level += [(9, "ab" * 32, 1, None, 4), (4000, "ab" * 32, 1, 3, 2), (4000, "ab" * 32, 2, None, 1)]
    runs = spark.createDataFrame(level, "run int, digest string, check long, best long, rows long")
    runs = runs.withColumn("digest", F.unhex("digest"))
    for keep, best in (("max", max), ("min", min)):
        expected = {}
        for _, digest, check, doc_id, n in level:
            ids, total = expected.get((digest, check), ([], 0))
            expected[digest, check] = (ids + [doc_id] * (doc_id is not None), total + n)
        merged = exact_dedup.merge_runs(runs, keep)
        got = {(r.digest.hex(), r.check): (r.best, r.rows) for r in merged.collect()}
        assert got == {key: (best(ids, default=None), n) for key, (ids, n) in expected.items()}
        assert merged.count() == len(expected)


def test_texts_of_one_digest_are_compared(make):
    def weak(text):
        return F.unhex(F.sha2(F.substring(text, 1, 1), 256)), F.xxhash64(F.octet_length(text))

    same = make([(i, "abc") for i in range(50)] + [(60, "xyz"), (61, "ab")])
    assert exact_dedup.exact_groups(same, digests=weak).where("group_size = 50").count() == 50
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.exact_groups(same.unionByName(make([(70, "abd")])), digests=weak)


def test_native_plans(spark, small):
    for name in ("op1_fingerprints", "op9_exact_dedup", "op10_pii"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop", "SinglePartition"):
            assert word not in plan, (name, word)


def test_fingerprints(spark, small, rows):
    found = {r.doc_id: r for r in queries.op1_fingerprints(spark, small).collect()}
    texts = dict(rows)
    changed = brute.edited(rows)
    ordered = sorted(texts, reverse=True)
    errors = []
    for i, doc_id in enumerate(ordered):
        row, text = found[doc_id], texts[doc_id] or ""
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed[doc_id].encode()).hexdigest()
        mine, other = brute.shingles(text), brute.shingles(changed[doc_id])
        errors.append(abs(row.near_edited - brute.jaccard(mine, other)))
        following = brute.shingles(texts[ordered[(i + 1) % len(ordered)]] or "")
        assert abs(row.near_next - brute.jaccard(mine, following)) < 0.25
        if len(mine | other) <= fingerprints.K:
            assert errors[-1] < 1e-12
    assert len(found) == len(rows) and max(errors) < 0.25 and sum(errors) / len(errors) < 0.05


def test_fingerprints_of_frequent_ids(spark):
    # A third of the rows have no id and a third share one, both beside ids of their own.
    cases = [(None, f"{i % 90:03d} none {i}") for i in range(400)] + [(7, f"{i % 80:02d}é same {i}") for i in range(400)]
    cases += [(i, f"own {i}") for i in range(-200, 200) if i != 7] + [(7, None), (None, "")]
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(5)
    placed = fingerprints.with_next(docs, 12).where("NOT _copy")
    sizes = {row["bucket"]: row["count"] for row in placed.groupBy("bucket").count().collect()}
    assert max(sizes.values()) < 250 and len(sizes) >= 10
    ordered = sorted(((-(10**9) if i is None else i, t or "") for i, t in cases), reverse=True)
    expected = [(i, t, ordered[(at + 1) % len(ordered)][1]) for at, (i, t) in enumerate(ordered)]
    found = [(-(10**9) if r["doc_id"] is None else r["doc_id"], r["text"], r["next_text"]) for r in placed.collect()]
    assert sorted(found) == sorted(expected)


def test_fingerprint_edges(make):
    cases = ODD + [(8, "É"), (None, "last one here"), (None, "another")]
    got = fingerprints.edited_pairs(make(cases), 4).collect()
    assert len(got) == len(cases)
    ids = [(-1 if i is None else i, t) for i, t in cases]
    ordered = sorted(ids, key=lambda r: (r[0], r[1] or ""), reverse=True)
    expected = []
    for i, (_, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        expected.append(hashlib.sha256((text[: len(text) - third] + other[:third]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(expected)
    assert fingerprints.edited_pairs(make(cases).limit(0), 4).count() == 0
    single = fingerprints.edited_pairs(make([(1, "abcdef")]), 4).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:1500])), (3, "")]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    parts = [(1, " ".join(words[max(0, i - 4) : i + 500])) for i in range(0, 3000, 500)] + [(3, "")]
    pieces = spark.createDataFrame(parts, "id long, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    merged = {r.id: r.s for r in fingerprints.merge_groups(pieces, "id", "s").collect()}
    sketches = {r.id: r.s for r in df.collect()}
    assert merged == {1: sketches[1], 3: []}
    pair = df.where("id = 1").select(F.col("s").alias("a")).crossJoin(df.where("id = 2").select(F.col("s").alias("b")))
    row = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"),
        fingerprints.containment(F.col("b"), F.col("a")).alias("c"),
        fingerprints.distinct_count(F.col("a")).alias("n"),
    ).first()
    assert abs(row.r - 0.5) < 0.15 and row.c > 0.75 and abs(row.n - 2996) < 900


PRIVATE = [
    "a@b.c_d@e.f.g x..y@z-.q a@b 1.2.3.4.5.6.7.8 256.1.1.1 0255.000000001.2.3 99999999999999999999.1.1.1",
    "card 4417744280351547 and 4417-7442-8035-1547, 4417 7442 8035 1547 4417744280351548 12--34",
    "+1 (974) 555-3436. +49 30 123456 +1234567890123456 +12 +1-(2)",
    "IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000 ssn 123-45-6789" + " " * 50 + "x 123-45-6789",
    "é@x.com ñ a@x.com b@y.org 😀 c@z.io",
    "1" * 50_000 + " " + "9 " * 20_000 + "a" * 50_000 + "@",
    "1.1.1." * 5_000,
    " ".join(f"u{i}@h{i}.com 10.0.{i % 300}.1" for i in range(3000)),
]


def test_pii_matches_the_patterns(spark, make, small, rows):
    cases = list(enumerate(PRIVATE + [None, ""]))
    columns = [pii.joined(pii.base_only(F.col("spans"))).alias("base"), pii.joined(F.col("spans")).alias("all")]
    got = {r.doc_id: r for r in pii.find(make(cases)).select("doc_id", *columns).collect()}
    for doc_id, text in cases:
        assert got[doc_id].base == ",".join(s for _, _, s in brute.base_spans(text or "")), doc_id
    assert got[3]["all"] == "iban:5:32,ssn:64:75"
    found = {r.doc_id: r.base_sha256 for r in queries.op10_pii(spark, small).collect()}
    assert found == {i: brute.base_sha256(t or "") for i, t in rows}
    assert pii.find(make(cases).limit(0)).count() == 0


def test_pii_masks(make):
    cases = [(1, "mail me@x.org or 10.0.0.1."), (2, None), (3, "nothing"), (4, "me@1.2.3.4"), (5, "me@x.org")]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(make(cases)).collect()}
    assert got == {
        1: ("mail [EMAIL] or [IP].", 21),
        2: (None, 0),
        3: ("nothing", 7),
        4: ("[EMAIL]", 7),
        5: ("[EMAIL]", 7),
    }
    assert pii.mask(make(cases)).columns == make(cases).columns
