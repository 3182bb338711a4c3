import random

from starfold.llm import near_dedup
from tests.llm.fixtures import SCHEMA, prose, table


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    names = {}
    sets = [(i, sum(1 << names.setdefault(g, len(names)) for g in shingles(t))) for i, t in rows if i is not None]
    part = {i: i for i, _ in sets}

    def root(a):
        while part[a] != a:
            a = part[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * (a & b).bit_count() >= 75 * (a | b).bit_count() and root(i) != root(j):
                part[max(root(i), root(j))] = min(root(i), root(j))
    return {(i, len(shingles(t)), None if i is None else root(i)) for i, t in rows}


def check(df):
    got = near_dedup.near_duplicates(df).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == df.count()


def test_odd_rows(spark):
    check(table(spark))


def test_groups_of_copies_that_only_their_source_links(spark):
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = prose(50 + g, 100).split()
        rows.append((1000 * g + 500, " ".join(base), "en", "s", 1, "", "", "", ""))
        for k in range(60):
            w = list(base)
            for _ in range(2):
                w[r.randrange(len(w))] = f"other{r.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(w), "en", "s", 1, "", "", "", ""))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))


def on_one_template(groups):
    """Each document has one near copy at the limit; all others are just below it, so most buckets are large."""
    r = random.Random(12)
    head, rows = [f"t{r.randrange(10**6)}" for _ in range(240)], []
    for g in range(groups):
        own = [f"g{r.randrange(10**9)}" for _ in range(42)]
        for k in range(2):
            rows.append((2 * g + k, " ".join([*head, *own[:6], *(own[6:] if k else [f"h{r.randrange(10**9)}" for _ in own[6:]])]), "en", "s", 1, "", "", "", ""))
    return rows


def test_pairs_whose_buckets_are_all_large(spark):
    check(spark.createDataFrame(on_one_template(30), SCHEMA).repartition(4))


def test_pairs_of_many_documents_on_one_template(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    check(spark.createDataFrame(on_one_template(120), SCHEMA).repartition(4))


def test_large_groups_without_their_source(spark):
    """Most pairs are just below the limit; which are above it is by chance, so stars settle little."""
    r = random.Random(3)
    rows = []
    for at, (n, words, changed) in ((0, (1300, 120, 2)), (5000, (600, 200, 4))):
        base = prose(90 + at, words).split()
        for k in range(n):
            w = list(base)
            for _ in range(changed):
                w[r.randrange(len(w))] = f"other{r.randrange(10**6)}"
            rows.append((at + k, " ".join(w), "en", "s", 1, "", "", "", ""))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_units_of_several_blocks_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "SHINGLES", 9000)
    check(spark.createDataFrame(on_one_template(60), SCHEMA).repartition(4))


def test_rows_that_repeat_a_key_share_its_component(spark):
    one, two = prose(1, 60).split(), prose(2, 60).split()
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    texts = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, ""), (4, " ".join([*two[:29], "x", *two[30:]])), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "", "", "", "") for i, t in texts], SCHEMA)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
