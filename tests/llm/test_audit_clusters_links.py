"""Operators 11 to 13 against plain versions, with odd rows, and in many shards, blocks and cells."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from starfold.llm import centroids, filter_audit, near_dedup, range_join
from tests.llm.fixtures import SCHEMA, prose, table

LABELS = "doc_id long, quality int, toxic int, text string"


def plain_flags(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        out.append((s or "", len(w), len(set(w)), sum(x << k for k, x in enumerate(fails)), i in good, i in toxic))
    return out


def plain_audit(flags):
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        removed_all = [0] * 5
        for order in itertools.permutations(range(5)):
            before = 0
            for step, k in enumerate(order):
                bit = 1 << k
                here = [f for f in own if f[3] & bit and not f[3] & before]
                removed_all[k] += len(here)
                out[part, "".join("ABCDE"[x] for x in order), step + 1] = [sum(not f[3] & (before | bit) for f in own), len(here), sum(1 for f in own if f[3] & bit and f[3] & before), sum(f[3] == bit for f in own), sum(f[4] for f in here), sum(f[5] for f in here), k]
                before |= bit
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed_all[v[6]]
    return out


def audit_rows():
    texts = [prose(k, 150 + 10 * k) for k in range(12)] + ["Word " * 300, "A$ b", prose(3, 180), prose(3, 180), None, "", "\x00   x", "É" * 300, "na na " * 200, prose(40, 9000)]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 1, "clash", "clash", "clash", "clash") for k, t in enumerate(texts)]
    return [*rows, (100, texts[0], "en", "s1", 1, "", "", "", ""), (100, texts[0], "en", "s2", 1, "", "", "", ""), (None, texts[0], None, "s1", 1, "", "", "", ""), (None, None, None, None, None, "", "", "", "")]


@pytest.mark.parametrize("small", [False, True])
def test_audit_is_the_plain_one(spark, monkeypatch, small):
    if small:  # many shards, many buckets
        monkeypatch.setattr(filter_audit, "SHARD_BYTES", 3000)
        monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 40)
    rows = audit_rows()
    labels = [(0, 1, 0, "x"), (0, 0, 1, "x"), (5, 1, 1, "x"), (13, None, 1, "x"), (100, 1, None, "x"), (None, 1, 1, "x"), (7777, 1, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    flags = filter_audit.flagged(docs, spark.createDataFrame(labels, LABELS))
    want = plain_flags([(r[0], r[1], r[3]) for r in rows], labels)
    # rows of no id are in no label list, whatever the labels hold
    want = [w[:4] + ((w[4], w[5]) if r[0] is not None else (False, False)) for w, r in zip(want, rows, strict=True)]
    got = [(r["part"], r["n_words"], r["n_distinct"], r["fails"], r["good"], r["toxic"]) for r in flags.collect()]
    assert sorted(got) == sorted(want)
    result = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(flags).collect()}
    assert result == plain_audit(want)


def test_matrix_holds_every_word_once(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2000)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 64)
    docs = table(spark)
    counted = filter_audit.counted(docs, "doc_id", "text", "source")
    numbered = filter_audit.numbered(counted)
    words = {r["term"]: bytes(r["word"]).decode() for r in filter_audit.dictionary(numbered).collect()}
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    assert len(set(words.values())) == len(words) and set(words.values()) == {w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)}
    got = []
    for r in filter_audit.term_matrix(counted, numbered).collect():
        indptr, indices, counts = (filter_audit.opened(r[c], k) for c, k in (("indptr", np.int64), ("indices", np.int64), ("counts", np.uint32)))
        for a, b in itertools.pairwise(indptr.tolist()):
            got.append(sorted((words[i], n) for i, n in zip(indices[a:b].tolist(), counts[a:b].tolist(), strict=True)))
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append(sorted((x, w.count(x)) for x in set(w)))
    assert sorted(got) == sorted(want)


def test_audit_of_nothing(spark):
    assert filter_audit.audit(filter_audit.flagged(table(spark, []), spark.createDataFrame([], LABELS))).count() == 0


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, q) for i, q in kept if i is not None)[:k]
    cents = [q for _, _, q in starts]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    return sorted(((-1 if i is None else i), near(q)[1], near(q)[0]) for i, q in kept), cents


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, kept string, n_links string, c string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash", "clash") for i, v in rows], VECTORS).repartition(3)


def odd_vectors(n=150):
    rng = np.random.default_rng(0)
    v = np.float32(rng.normal(0, 0.2, (n, 64))).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(500, None), (501, v[0][:63]), (502, [*v[0], 0.0]), (503, [*v[0][:63], None]), (504, [*v[0][:63], float("nan")]), (505, [float("inf"), *v[0][1:]]), (506, []), (507, [0.0] * 64), (508, [1000.0] + [0.0] * 63), (509, [1e30] * 64)]
    return [*rows, *[(600 + i, v[3]) for i in range(40)], (3, v[3]), (3, v[4]), (None, v[5])]


@pytest.mark.parametrize("shard", [1 << 16, 17])
def test_clusters_are_the_plain_ones(spark, monkeypatch, shard):
    monkeypatch.setattr(centroids, "SHARD", shard)
    rows = odd_vectors()
    found, cents = centroids.clusters(vectors(spark, rows))
    out = centroids.described(found, cents).collect()
    want, plain = plain_clusters([(i, v) for i, v in rows])
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in out) == want and cents.tolist() == plain
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    rows = odd_vectors(6)[:5]
    found, cents = centroids.clusters(vectors(spark, rows))
    assert len(cents) == 5 and {r["distance"] for r in found.collect()} == {0}
    for none in ([], [(1, None), (2, [])]):
        found, cents = centroids.clusters(vectors(spark, none))
        assert len(cents) == 0 and centroids.described(found, cents).count() == 0
    found, _ = centroids.clusters(vectors(spark, [(None, [0.5] * 64)]))
    assert found.count() == 0


def test_other_shapes_and_seeds(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (60, 5)))], "id long, v array<double>")
    found, cents = centroids.clusters(df, "id", "v", k=4, rounds=2, dim=5, scale=100, seed=9)
    assert cents.shape == (4, 5) and found.count() == 60
    q = np.floor(100 * np.array([r["v"] for r in df.orderBy("id").collect()])).astype(int)
    d = ((q[:, None] - cents) ** 2).sum(axis=2)
    for r in found.collect():
        assert r["cluster"] == d[r["id"]].argmin() and r["distance"] == d[r["id"]].min()


def plain_links(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    part = {i: i for i, _ in rows if i is not None}

    def root(a):
        while part[a] != a:
            a = part[a]
        return a

    n = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if ok[x] and ok[y] and len(unit[x]) == len(unit[y]) and float(unit[x] @ unit[y]) >= least:
                n[x] += 1
                n[y] += 1
                a, b = root(rows[x][0]), root(rows[y][0])
                part[max(a, b)] = min(a, b)
    return sorted((-1 if i is None else i, n[k], -1 if i is None else root(i)) for k, (i, _) in enumerate(rows))


def check(spark, rows):
    got = range_join.near_vectors(vectors(spark, rows)).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def clustered(seed, groups, each, spread):
    """Near copies around random directions, of chains and tight groups, some scaled."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(0, 1, 24)
        for k in range(each):
            v = base + rng.normal(0, spread * (1 + g % 3), 24)
            rows.append((1000 * g + k, np.float32(v * rng.choice([1e-3, 1.0, 50.0])).tolist()))
    return [rows[i] for i in rng.permutation(len(rows))]


def test_links_of_odd_vectors(spark):
    rows = odd_vectors(40)
    rows += [(700, [x * 7 for x in rows[2][1]]), (701, [-x for x in rows[2][1]]), (702, [1e-30] * 64), (703, [3e30] * 64), (704, [1.0, 0.0]), (705, [2.0, 0.1]), (706, [-0.0, 1.0]), (707, [0.0, 1.0])]
    check(spark, rows)


@pytest.mark.parametrize("blocks", [False, True])
def test_links_in_many_cells_and_blocks(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(range_join, "BLOCK", 16)
        monkeypatch.setattr(range_join, "STRIP", 7)
    monkeypatch.setattr(range_join, "CELL", 20)
    check(spark, clustered(1, 12, 25, 0.12))


def test_chains_across_cells(spark, monkeypatch):
    """Points along an arc, each linked with its neighbours only: one component through all cells."""
    monkeypatch.setattr(range_join, "CELL", 10)
    rows = [(i, [math.cos(0.2 * i), math.sin(0.2 * i), 0.3]) for i in range(15)] + [(100 + i, [0.0, math.cos(0.3 * i), math.sin(0.3 * i) + 2]) for i in range(10)]
    check(spark, rows)


def test_a_cell_that_holds_most_vectors(spark, monkeypatch):
    monkeypatch.setattr(range_join, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, 24)
    rows = [(i, np.float32(base + rng.normal(0, 0.22, 24)).tolist()) for i in range(220)] + [(1000 + i, np.float32(rng.normal(0, 1, 24)).tolist()) for i in range(60)]
    check(spark, rows)


def test_decisions_at_the_limit_are_in_double_precision(spark):
    turn = math.acos(0.95)
    rows = [(0, [1.0, 0.0])] + [(i, [math.cos(turn + d), math.sin(turn + d)]) for i, d in ((1, -1e-6), (2, 1e-6), (3, -3e-9), (4, 3e-9))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in range_join.near_vectors(df).collect()}
    assert got[0] == 2 and got == {i: n for i, n, _ in plain_links(rows)}


def test_no_vectors_and_only_unusable_ones(spark):
    assert range_join.near_vectors(vectors(spark, [])).count() == 0
    check(spark, [(1, None), (2, []), (None, None), (3, [0.0])])


def test_what_is_sent_is_bounded_by_cells_not_pairs(spark):
    """Tight groups far apart: triangle inequality leaves next to nothing to send on."""
    rows = clustered(7, 40, 10, 0.02)
    known = range_join.prints(vectors(spark, rows), "vec_id", "embedding")
    classes = known.selectExpr("id AS c", "v", "1L AS copies")
    radius = math.sqrt(0.1)
    pivots = range_join.pivots_of(classes, np.float32, 24, radius)
    sent, n = range_join.routed(range_join.homes(classes, np.float32, pivots), np.float32, pivots, radius)
    assert n == len(pivots) > 8 and sent.filter("home").count() == 400 and sent.count() < 400 * 6


def test_learners_fit_after_components_in_one_session(spark):
    """What near-duplicates leave in a session must not keep Spark's learners from fitting."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    near_dedup.near_duplicates(table(spark)).count()
    rows = spark.createDataFrame([(float(i % 2), [float(i), 1.0]) for i in range(20)], "label double, v array<double>")
    model = LogisticRegression(maxIter=2).fit(rows.withColumn("features", array_to_vector(F.col("v"))))
    assert model.transform(rows.withColumn("features", array_to_vector(F.col("v")))).count() == 20
