import random

import pytest

CLASHES = ["row", "pos", "line", "h", "n", "sid", "base", "clean", "kept", "copies", "rate", "score", "lang_pred", "piece", "size", "target", "line_dedup", "label", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)

SYLLABLES = {"en": "the and ing er tion on re at en he".split(), "de": "der sch ung ein ich ver zu keit pf ü".split(), "fr": "eau que les ment oi tre é è aux ç".split()}


def prose(rng, lang, words):
    out = []
    while len(out) < words:
        sentence = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 12))]
        out += sentence[:-1] + [sentence[-1] + rng.choice([".", ".", ".\n"])]
    return " ".join(out[:words]).replace("\n ", "\n")


def corpus(seed=5, rows=60):
    """Prose with copies, near copies, repeated lines, secrets and the awkward cases."""
    rng = random.Random(seed)
    docs = []
    for k in range(rows):
        lang = rng.choice(list(SYLLABLES))
        docs.append((k, prose(rng, lang, rng.choice([3, 20, 60, 150])), lang, f"s{rng.randint(0, 4) if k % 3 else 0}"))
    line = "A line that many documents hold, with words enough to count."
    for k in range(rows, rows + 30):
        _, text, lang, source = docs[rng.randrange(rows)]
        kind = k % 5
        if kind == 0:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 1:
            text += "\n" + line
        elif kind == 2:
            text += "\n" + line.replace("many", "many" if k % 2 else "meny").replace("count.", "count!" if k % 4 else "count.")
        elif kind == 3:
            text += f"\ntoken = 'abcd{k % 7}ef0123456789abcd' and AKIA{'Q7' * 8} then Password: hunter2hunter{k % 3}"
        docs.append((k, text, lang, source))
    n = len(docs)
    docs += [(n, None, "en", "s0"), (n + 1, "", "en", None), (n + 2, " \n\t \n", None, "s1"), (n + 3, "one", "en", "s1"), (n + 4, "a b c", "en", "s9"), (n + 5, "a b c", "en", "s9"),
             (n + 6, "12 34 !!", "en", "s2"), (n + 7, docs[3][1].upper(), "en", None), (n + 8, (docs[4][1] + "\n") * 30, "en", "s3"), (n + 9, prose(rng, "en", 9000), "en", "s0"),
             (n + 10, "x" * 70000, "en", "s4"), (n + 11, "word " * 3000, "en", "s4")]
    docs.append(docs[7])  # a repeated row
    docs.append((None, docs[8][1], "en", "s0"))
    return [(*d, len(d[1] or "")) for d in docs]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
