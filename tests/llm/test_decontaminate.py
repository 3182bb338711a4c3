import re

from starfold.llm import decontaminate
from tests.llm.fixtures import SCHEMA, prose, table


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for name, text in items:
            v = norm(text)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(name)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(map(repr, out))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string, n_hit int")


ITEMS = [("10", prose(1, 40), 1), ("9", prose(2, 25), 1), ("a", "one single", 1), ("b", None, 1), ("c", "", 1), (None, prose(3, 12), 1), ("d", "na na na na", 1), ("e", "x", 1), ("9", prose(4, 15), 1)]


def test_matches_brute_force(spark, monkeypatch):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for chosen in (ITEMS, [x for x in ITEMS if x[0] not in ("e", "a", "d")], []):
        want = brute(rows, [(n or "", t) for n, t, _ in chosen])
        got = decontaminate.find(df, items(spark, chosen)).collect()
        assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == want
    whole = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda x: whole(x, 100))
    got = decontaminate.find(df, items(spark, ITEMS)).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == brute(rows, [(n or "", t) for n, t, _ in ITEMS])


def test_strip_takes_out_spans_and_drops_what_is_mostly_hit(spark):
    leak = prose(7, 20)
    rows = [(1, f"{prose(8, 60)} {leak} {prose(9, 60)}", "en", "s", 1, "", "", "", ""), (2, leak + " and little else", "en", "s", 1, "", "", "", ""), (3, prose(10, 50), "en", "s", 1, "", "", "", ""), (4, None, "en", "s", 1, "", "", "", "")]
    got = {r["doc_id"]: r["text"] for r in decontaminate.strip(spark.createDataFrame(rows, SCHEMA), items(spark, [("q", leak, 1)])).collect()}
    assert set(got) == {1, 3, 4} and got[3] == rows[2][1] and got[4] is None
    assert norm(got[1]) == norm(prose(8, 60)) + norm(prose(9, 60))
