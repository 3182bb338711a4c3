import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from starfold.llm import shards, suffix
from tests.llm.fixtures import SCHEMA, prose, table


def brute(rows):
    """Per row, in order: removed bytes, spans, hash of what stays."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        key = suffix.LAST if i is None else i
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (suffix.LAST if i is None else i):
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@given(st.integers(1, 4), st.binary(min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_suffix_array_and_prefixes(letters, raw):
    text = np.frombuffer(bytes(97 + b % letters for b in raw), np.uint8)
    b = text.tobytes()
    sa = suffix.suffix_array(text)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = suffix.common_prefixes(text, sa, 64, 7)
    for k in range(1, len(b)):
        p, q = b[sa[k - 1] :], b[sa[k] :]
        n = next((i for i in range(min(len(p), len(q))) if p[i] != q[i]), min(len(p), len(q)))
        assert lcp[k] == min(n, 64)


@pytest.mark.parametrize("many", [4096, 2])
def test_repeats_match_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(shards, "SHARD_BYTES", 4000)
    shared = prose(9, 30)
    given_rows = [(i, prose(i, 30) + shared + prose(100 + i, 20), "en", "s", 1, "", "", "", "") for i in range(12)]
    given_rows += [(20, "ab" * 100, "en", "s", 1, "", "", "", ""), (21, "ba" * 100, "en", "s", 1, "", "", "", ""), (22, "z" * 49, "en", "s", 1, "", "", "", ""), (23, "z" * 50, "en", "s", 1, "", "", "", ""), (24, "z" * 51, "en", "s", 1, "", "", "", "")]
    for df in (table(spark), spark.createDataFrame(given_rows, SCHEMA).repartition(4)):
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeated_spans(df).collect()]
        key = lambda r: (r[0] is None, r)
        assert sorted(map(repr, sorted(got, key=lambda r: repr(r)))) == sorted(map(repr, brute([(r["doc_id"], r["text"]) for r in df.collect()]))), key


def test_empty_table(spark):
    assert suffix.repeated_spans(table(spark, [])).count() == 0


def test_pieces_of_one_hash_are_told_apart_by_their_bytes():
    text = np.frombuffer(b"abcabdabcxyz", np.uint8)
    low, sizes = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3])
    key, doc = np.full(4, 7, np.uint64), np.array([5, 4, 3, 2])
    first, of = suffix.alike(key, np.zeros(4, np.uint64), doc, text, low, sizes)
    assert of[0] == of[2] and len(set(of.tolist())) == 3 and first[of[0]] == 2
