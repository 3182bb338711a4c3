"""A small table with everything that is odd: nulls, empty, short, repeated and very long texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, component_id string"
WORDS = "the of and to in is was that for with as by are at an on be this from or stone river light garden window paper silver number answer travel".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", "ing", "er")) + str(r.randrange(50)) for _ in range(n))


def rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 300)
    near = base.split()
    near[60] = "changed"
    texts = [base, other, base, None, "", "short", " \t\n ", "A b C", "a B c", " ".join(near), prose(3, 4000), "x" * 200_000, "na " * 300, other[:400] + " tail of its own", "é à ü " * 40 + "ß\u00a0ç", prose(4, 80) + "\n" + prose(4, 80) + "\n\n" + prose(5, 20), "q\x00r s t u", "[INST] </s> <|x|>"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, "en", None, 1, "c", "c", "c", "c"), (None, None, None, None, None, None, None, None, None)]


def table(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(3)
