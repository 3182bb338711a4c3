import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from starfold.llm import chat, classifier, lm, mixing, packing, quality, urls
from tests.llm.fixtures import SCHEMA, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts_of_odd_rows(spark):
    df = table(spark)
    got = quality.judge(df, columns=["doc_id", "text", "kept"]).collect()
    assert len(got) == df.count()
    for r in got:
        w = WORD.findall(r["text"] or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 500 else None
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or "")) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert twice is None or r["n_repeat_words"] == len(twice)
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(table(spark, [])).count() == 0
    kept = quality.judge(df, filtering=True)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)


def test_divergence_rejects_symbol_soup_and_keeps_prose(spark):
    clean = [(i, with_common(prose(i, 200).lower(), "en", i), "en", "s", 1, "", "", "", "") for i in range(40)]
    soup = [(100, " ".join(f"{w}%%%" if k % 2 else f"{w}***" for k, w in enumerate(prose(5, 200).split())), "en", "s", 1, "", "", "", ""), (101, prose(6, 200).upper() + "!!", "en", "s", 1, "", "", "", "")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean + soup, SCHEMA)).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101]


def with_common(text, lang, seed):
    """Every third word is a common one of the language."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(quality.COMMON[lang]) if k % 3 == 0 else w for k, w in enumerate(text.split()))


def test_divergence_rejects_other_languages_and_texts_without_common_words(spark):
    rows = [(100 * n + i, with_common(prose(100 * n + i, 200).lower(), lang, i), lang, "s", 1, "", "", "", "") for n, lang in enumerate(("de", "en", "fr")) for i in range(30)]
    wrong = [(1000, with_common(prose(1, 200).lower(), "en", 1), "de", "s", 1, "", "", "", ""), (1001, prose(2, 200).lower(), "fr", "s", 1, "", "", "", ""), (1002, with_common(prose(3, 200).lower(), "de", 3), "en", "s", 1, "", "", "", ""), (1003, prose(4, 200).lower(), "xx", "s", 1, "", "", "", "")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows + wrong, SCHEMA)).collect()}
    assert all(got[r[0]] for r in rows) and not got[1000] and not got[1001] and not got[1002] and got[1003]


def test_mix_reaches_targets_and_agrees_again(spark):
    rows = [(i, prose(i, 20 + i % 7), "en", ("a", "b", "c", None)[min(i % 9, 3)], 1, "", "", "", "") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7)).collect()}
    assert all(again[r["doc_id"]] == r["copies"] <= 2 for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        t[0] += r["size"] * r["copies"]
    assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * sum(t[2] for t in by.values()))
    assert all(abs(t[0] - t[1]) < 0.1 * t[1] and t[1] <= 2 * t[2] + 1e-6 for t in by.values())
    assert mixing.emit(mixing.mix(df), df.columns).count() == sum(r["copies"] for r in got)
    odd = mixing.mix(table(spark))
    assert odd.count() == table(spark).count() and mixing.mix(table(spark, [])).count() == 0


@given(st.lists(st.integers(1, 60), max_size=60))
@settings(max_examples=50, deadline=None)
def test_best_fit_decreasing(sizes):
    bins = packing.best_fit_decreasing(np.array(sizes, np.int64), 60)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    left, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [k for k, room in enumerate(left) if room >= sizes[i]]
        if fits:
            k = min(fits, key=lambda k: left[k])
            left[k] -= sizes[i]
        else:
            left.append(60 - sizes[i])
    assert sorted(60 - sum(sizes[i] for i in b) for b in bins) == sorted(left) and want == []


@given(st.text(alphabet=st.sampled_from(list("ab éß\u00a0\u2003\n\t '.1s\u0085")), max_size=60))
@settings(max_examples=200, deadline=None)
def test_token_ids_are_those_of_the_whole_text(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, offs = packing.token_ids(raw, np.array([0, len(raw)]), packing.encoder())
    assert ids.tolist() == packing.encoder().encode_ordinary(text) and offs[-1] == len(ids)


def test_packing_round_trip(spark):
    df = table(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(df, length=64, shard_tokens=5000).cache()
    back = {r["doc_id"]: r["text"] for r in packing.unpack(packed).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in packed.collect():
        assert len(r["ids"]) == 2 * 64 * r["n_rows"] and all(c[-1] == n <= 64 and p == c[:-1] for c, n, p in zip(r["cu_lengths"], r["n_tokens"], r["position_resets"], strict=True))
    assert packing.pack(table(spark, [])).count() == 0 and packing.pack(table(spark)).count() > 0


@pytest.mark.parametrize("most", [1 << 28, 1 << 12])
def test_cascades_are_exact_over_their_universe(spark, most):
    keys = spark.range(9000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascades = urls.build_cascades(keys, max_bits=most)
    assert (len(cascades) > 1) == (most == 1 << 12) and len(cascades[0].levels) > 1 and all(sum(x[0] for x in c.levels) <= most for c in cascades)
    wrong = keys.withColumns(dict(zip(("a", "b"), urls._pair("key"), strict=True))).filter(urls._member(cascades) != F.col("listed"))
    assert wrong.count() == 0
    with pytest.raises(ValueError):
        urls.build_cascades(keys, max_bits=100)


def test_url_rules(spark):
    few, many = "text " * 100, '<a href="x">y</a>' * 20
    rows = [("http://WWW.Example.com/en/x?q", "www.example.com/en/", "allow", many), ("http://a.example.com/en/", "example.com/en/", "block", few), ("https://spam-farm.a.com", None, "block", many), ("https://spam-farm.a.com/", "com/", "allow", many), ("x://b.net/es/1", "net/es/", "block", few), ("nothing", None, "allow", many), (None, None, "allow", many), ("", None, "allow", None), ("a://casino-win.org?x", None, "block", many), ("a://casino-win.org?x", None, "block", few), ("a://fine.org#casino-win.org", None, "allow", None), ("a://fine.org/" + "p" * 100_000, None, "allow", few)]
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, _, _, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == {i: x[1:3] for i, x in enumerate(rows)}
    assert urls.judge(df.limit(0)).count() == 0
    own = {r["page_id"]: r["verdict"] for r in urls.judge(df, listed_host=F.col("key").endswith(".org")).collect()}
    assert own[10] == "block" and own[2] == "allow"


def test_reply_trees_choose_the_best_branch(spark):
    nodes = [("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good <|", 5.0), ("t", 4, 3, "user", None, None), ("t", 5, 2, "user", "x", 2.0), (None, 1, 99, "system", "\\e[INST]</s>|", 0.0), ("loop", 1, 2, "user", "a", 0.0), ("loop", 2, 1, "user", "b", 0.0)]
    df = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    back = {r["tree_id"]: r for r in chat.read_back(chat.format_paths(chat.chosen_paths(df))).collect()}
    assert [(x["role"], x["text"]) for x in back["t"]["turns"]] == [("user", "hi"), ("assistant", "good <|"), ("user", "")] and back["t"]["loss_text"] == "good <|"
    assert [(x["role"], x["text"]) for x in back[None]["turns"]] == [("system", "\\e[INST]</s>|")] and back[None]["loss_text"] == "" and "loop" not in back
    both = chat.chosen_paths(df, top=2).filter("tree_id = 't'").select("path").distinct().count()
    assert both == 2
    for r in back.values():
        assert "[INST]" not in r["formatted"] and r["formatted"].count("</s>") == len(r["turns"])


def test_reply_trees_of_odd_rows(spark):
    schema = "tree_id string, node_id long, parent_id long, role string, text string, score double, formatted string"
    long = "é<|" * 60_000
    nodes = [("a", 1, None, "user", "hi", 0.0, "x"), ("a", 1, None, "user", "hi", 0.0, "x"), ("a", 3, 1, "assistant", "three", 2.0, "x"), ("a", 2, 1, "assistant", "two", 2.0, "x"), ("b", 1, None, "assistant", long, None, "x"), ("b", 1, None, "assistant", None, None, "x")]
    df = spark.createDataFrame(nodes, schema)
    back = {r["tree_id"]: r for r in chat.read_back(chat.format_paths(chat.chosen_paths(df))).collect()}
    assert [x["text"] for x in back["a"]["turns"]] == ["hi", "two"]  # a repeated node is one; equal scores go to the smaller leaf
    assert [x["text"] for x in back["b"]["turns"]] == [""]  # of two rows of a node the least counts
    only = chat.read_back(chat.format_paths(chat.chosen_paths(df.filter("text is not null")))).filter("tree_id = 'b'").first()
    assert only["turns"][0]["text"] == long == only["loss_text"]
    assert chat.format_paths(chat.chosen_paths(df.limit(0))).count() == 0 and chat.linear_trees(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_long_chains_take_few_joins(spark):
    said = spark.range(37).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat.read_back(chat.format_paths(chat.chosen_paths(chat.linear_trees(said)))).collect()
    assert len(r) == 1 and [x["text"] for x in r[0]["turns"]] == [f"t{i}" for i in range(37)]


def test_classifier_tells_labels_it_never_saw(spark):
    rows = [(i, prose(i, 150) if i % 2 else "spam*** $$$ " * 80 + str(i), "en", "s", 1, "", "", "", "") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (1000, "", None, None, 0, "", "", "", ""), (None, None, None, None, 0, "", "", "", "")], SCHEMA)
    got = classifier.judge(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 242 and held and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert classifier.judge(docs.limit(0), labels).count() == 0 and classifier.judge(docs, labels.limit(0)).count() == 242


def test_ridge_and_isotonic_against_plain_ones(spark):
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.uniform(0, 1, 60)), rng.integers(0, 2, 60).astype(float)
    w = rng.integers(1, 5, 60).astype(float)
    knots, levels = classifier.isotonic(x, y, w)
    fit = np.interp(x, knots, levels)
    best = np.array([max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])  # the max-min formula
    assert np.all(np.diff(levels) >= -1e-12) and np.abs(fit - best).mean() < 0.1
    dims = classifier.statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    data = rng.normal(size=(300, dims))
    truth = (data[:, 0] + 0.3 * data[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, d.tolist(), int(t)) for i, (d, t) in enumerate(zip(data, truth, strict=True))], "id long, x array<double>, y int")
    model = classifier.fit(rows)
    assert np.allclose(model.mean, data.mean(axis=0)) and np.allclose(model.scale, data.std(axis=0), rtol=1e-6)
    learns = np.array([not r["c"] for r in rows.select("id", (F.pmod(F.xxhash64(F.lit(classifier.SEED), "id"), F.lit(4)) == 0).alias("c")).orderBy("id").collect()])
    z = model.lifted(data[learns])
    penalty = classifier.RIDGE * learns.sum() * np.eye(z.shape[1]) / classifier.FEATURES
    penalty[-1, -1] = 0
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + penalty, z.T @ truth[learns]), atol=1e-5)
    assert np.mean((model.score(data) > 0.5) == truth) > 0.8


def test_language_model_base_and_mix(spark):
    import math
    import zlib
    from collections import Counter

    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    words = lambda t: [w.encode().lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode() for w in WORD.findall(t or "")]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter(w for i, t in rows if trains(i) for w in [*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    got = lm.score(df).collect()
    want = Counter()
    for i, t in rows:
        toks = [*words(t), "end"]
        want[repr((i, not trains(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks), 6)))] += 1
    assert Counter(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == want
    assert all(r["score"] < 0 and r["bits_per_byte"] >= 0 for r in got)
    assert lm.score(table(spark, [])).count() == 0


def test_mix_is_a_probability():
    """Over all bytes that may follow, and the end, the chances add up to one."""
    code = lm.huffman(np.arange(257))
    rng = np.random.default_rng(0)
    m = lm.Mixer(code, rng.normal(0, 1, int(lm.STARTS[-1])).astype(np.float32))
    start = b"ab c"
    texts = [start + bytes([x]) for x in range(256)]
    last = len(start)
    s, _ = lm.symbols(np.frombuffer(start, np.uint8), np.array([0, last]))
    total = 0.0
    for x in range(257):
        sx = s.copy()
        sx[-1] = x
        t, bits, n = m.parts(sx)
        z = sum(a[-n[-1] :] for a in t) * (1 - 2.0 * bits[-n[-1] :])
        total += math_exp(-np.log1p(np.exp(z)).sum())
    assert total == pytest.approx(1, abs=1e-4) and len(texts) == 256


def test_each_predictor_is_refined_in_ordinary_documents():
    """Bit by bit in plain Python, over texts of under 2 KB and one of several."""
    code, rng = lm.huffman(np.arange(257)), np.random.default_rng(3)
    m = lm.Mixer(code, rng.normal(0, 1, int(lm.STARTS[-1])).astype(np.float32))
    texts = [prose(k, n).encode() for k, n in enumerate((1, 150, 40, 220, 600))]
    offs = np.cumsum([0, *map(len, texts)])
    s, soff = lm.symbols(np.frombuffer(b"".join(texts), np.uint8), offs)
    t, bits, n_bits = m.parts(s)
    boff, want, moved = np.concatenate(([0], np.cumsum(n_bits)))[soff], [], []
    for a, b in zip(boff[:-1], boff[1:], strict=True):
        w, grad, loss = np.ones(3), np.zeros(3), 0.0
        for i in range(a, b):
            if i > a and (i - a in (64, 128, 256, 512) or (i - a) % lm.BLOCK == 0):
                w, grad = np.clip(w - lm.RATE * grad, 0.5, 1.5), np.zeros(3)
            v = np.array([x[i] for x in t], float) * (1 - 2 * int(bits[i]))
            z = min(float(v @ w), 20.0)
            loss += np.log1p(np.exp(z))
            grad += v / (1 + np.exp(-z))
        want.append(-loss / np.log(10))
        moved.append(bool((w != 1).any()))
    assert m.log10(np.frombuffer(b"".join(texts), np.uint8), offs) == pytest.approx(np.array(want), rel=1e-5)
    assert all(moved[1:]) and len(texts[2]) < 400


def math_exp(x):
    import math

    return math.exp(x)


def test_gated_weights_fit_counts():
    """Counts drawn from known chances: a predictor that is right gets weights near 1, one of noise near 0."""
    rng = np.random.default_rng(8)
    size = int(lm.STARTS[-1])
    counts = np.zeros((size, 2), np.int64)
    p = np.where(rng.random(4000) < 0.5, 0.1, 0.9)
    n = 200
    counts[:4000, 1] = rng.binomial(n, p)
    counts[:4000, 0] = n - counts[:4000, 1]
    a, b = int(lm.STARTS[1]), int(lm.STARTS[2])
    counts[a : a + 4000, 1] = rng.integers(0, 2, 4000)  # each slot once or never in either bit
    counts[a : a + 4000, 0] = 1 - counts[a : a + 4000, 1]
    w = lm.gated_weights(counts)
    assert abs(w[0][lm.gate(np.array([n - 1.0]))[0]] - 1) < 0.1 and b > a
    assert w[1][0] == 1  # bits that were never seen elsewhere have no chances to weigh
