"""Secret scan, license scan, line-first cleaning and line de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawlake.llm import license_scan, line_dedup, line_quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def key(doc_id, text):
    return (doc_id is None, doc_id or 0, text or "")


def base_spans(text):
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_secrets_against_brute_force(docs, rows):
    wide, owners = {}, {}
    random_looking = lambda v: sum(c in "0123456789" for c in v) >= 4 and sum(c.isascii() and c.isalpha() for c in v) >= 4 and len(set(v)) >= 10
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        base = base_spans(text)
        free = [(m.start(), 3, m.end(), m.group()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text)
                if random_looking(m.group()) and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        wide[doc_id, text] = (base, free)
        for *_, value in base + free:
            owners.setdefault(value, set()).add(source)
    got = {}
    for r in secret_scan.find(docs).collect():
        got.setdefault(r.doc_id, []).append(([(s.start, s.kind, s.end) for s in sorted(r.base)], [(s.start, s.kind, s.end) for s in sorted(r.spans)],
                                             sum(s.example for s in r.spans)))
    want = {}
    for doc_id, text, *_ in rows:
        base, free = wide[doc_id, text or ""]
        kept = sorted(base + [s for s in free if len(owners[s[3]]) == 1])
        want.setdefault(doc_id, []).append(([s[:3] for s in base], [s[:3] for s in kept], sum(len(owners[s[3]]) >= 3 for s in kept)))
    assert got == want
    assert sum(len(b) for x in want.values() for b, _, _ in x) > 10


def test_failing_assignments_consume_what_they_match(spark):
    texts = ["token: secret: abcdefghijk", "secret=token=abcdefgh1", "API_KEY = 'short'", "AKIA" + "A" * 11, "AKIAAKIA" + "B" * 8, "ünï password:aaaaaaaa 😀 passwd=bbbbbbbb"]
    df = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secret_scan.find(df).collect():
        assert [(s.start, s.kind, s.end) for s in sorted(r.base)] == [s[:3] for s in base_spans(texts[r.doc_id])]


def test_verdicts_read_repositories_and_owners(spark):
    copied, shared, wide = "sk_Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "pk_Zy9Xw8Vu7Ts6Rq5Po4Nm3", "tk_Qa1Ws2Ed3Rf4Tg5Yh6Uj7"
    held = [(copied, "s0")] * secret_scan.EXAMPLE_REPOS + [(shared, "s0"), (shared, "s1")] + [(wide, f"s{k}") for k in range(secret_scan.EXAMPLE_OWNERS)]
    df = spark.createDataFrame([(i, f"see {v} here", s) for i, (v, s) in enumerate(held)], "doc_id long, text string, source string")
    got = {r.doc_id: [(s.start, s.end, s.example, s.live, s.n_owners, s.n_repos) for s in r.spans] for r in secret_scan.find(df).collect()}
    assert got == {i: [(4, 4 + len(v), False, True, 2, 2)] if v == shared else [] for i, (v, _) in enumerate(held)}
    keyed = df.selectExpr("doc_id", "replace(text, 'see ', 'token = ') AS text", "source")
    got = {r.doc_id: [(s.example, s.live, s.n_owners, s.n_repos) for s in r.spans] for r in secret_scan.find(keyed).collect()}
    want = {copied: (True, False, 1, len(held) - 5), shared: (False, True, 2, 2), wide: (True, False, 3, 3)}
    assert got == {i: [want[v]] for i, (v, _) in enumerate(held)}


def test_secrets_of_an_empty_table(empty):
    assert secret_scan.find(empty).collect() == []


def line_rule(line):
    chars = len(line.replace(" ", ""))
    words = len(WORD.findall(line))
    if not WORD.search(line):
        return 0
    if len(re.findall(r"[!-/:-@\[-`{-~]", line)) * 100 > chars * 15:
        return 1
    if len(re.findall("[|»›•·]", line)) * 100 >= words * 20 or (words < 4 and not re.search(r"[.!?:;…。！？]['\"»”’)\]]*\Z", line)):
        return 2
    return 3 if words <= 25 and any(p in line.lower() for p in line_quality.PHRASES) else 0


def test_line_first_against_brute_force(docs, rows):
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        lines = (text or "").split("\n")
        full = [x for x in lines if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
        bad = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        size = lambda x: len(x.replace(" ", ""))
        lost, chars = sum(size(x) for x in lines if line_rule(x)), sum(map(size, lines))
        want.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(repeat), bad,
                     not bad and 100 * lost <= 40 * chars, "\n".join(x for x in lines if not line_rule(x))))
    got = line_quality.judge(docs).selectExpr("doc_id", "base.n_words", "base.word_chars", "base.n_symbols", "base.n_dup_lines", "base.n_repeat_words", "base_failed", "kept", "clean.text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_line_first_rules(spark, empty):
    prose = "This line is plain prose that ends with a mark, as lines of a page do.\n" * 2
    other = "\n".join(" ".join(f"word{k * 9 + i}" for i in range(9)) + "." for k in range(12))
    indented = ["\t\t  Home", "        About", "        one\ttwo\tthree\tfour five."]  # words are counted, not spaces
    assert [r.rule for r in spark.createDataFrame(list(enumerate(indented)), "i long, line string").orderBy("i").select(line_quality.line_rule(F.col("line")).alias("rule")).collect()] == [2, 2, 0]
    texts = [prose + other, other + "\nHome | News | Sport | About | Contact\nAll rights reserved.", "\n".join("LOUD!! WORDS!! %%% ### $$$" for _ in range(20))]
    got = line_quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True, False]
    assert got[1].clean.n_removed_lines == 2 and got[1].clean.text == other
    assert line_quality.judge(empty).collect() == []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def deduplicated(rows):
    order = sorted({(i is None, i or 0, t): None for i, t, *_ in rows if t is not None})
    seen, first, out = [], {}, {}
    for place in order:
        left = []
        for line in place[2].split("\n"):
            if not WORD.search(line):
                left.append(line)
                continue
            near = any(one_edit(x, line) for x in seen)
            if line not in first and not near:
                left.append(line)
            if line not in first:
                first[line] = place
                seen.append(line)
        out[place] = "\n".join(left)
    return out


def test_line_dedup_against_brute_force(docs, rows):
    want = deduplicated(rows)
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == set(docs.columns)
    raw = {(r.doc_id, r.n_chars): r for r in got.collect()}
    texts = sorted(((i, want[i is None, i or 0, t] if t is not None else None) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == texts
    assert sum(r.line_dedup.n_near for r in raw.values()) > 0 and sum(r.line_dedup.n_exact for r in raw.values()) > 0


@pytest.mark.parametrize("edit", ["swap", "insert", "delete"])
def test_every_place_of_an_edit_is_found(spark, edit):
    line = "The quick brown fox jumps over"
    rows = [(0, line)]
    for k in range(len(line) + (edit == "insert")):
        rows.append((k + 1, line[:k] + {"swap": "#", "insert": "#", "delete": ""}[edit] + line[k + (edit != "insert"):]))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got if r.text} == {0: line}


def test_short_lines_within_one_edit_go(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ü") for _ in range(rng.randint(1, 7))) for _ in range(150)] + ["Contact us today 12", "Contact us today 123", "Contact us today 1x3", "Contact us today 1234"]
    rng.shuffle(texts)
    seen, want = [], {}
    for k, text in enumerate(texts):
        want[k] = text if not WORD.search(text) or not any(one_edit(x, text) for x in seen) else ""
        seen += [text] if WORD.search(text) else []
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_lines_two_edits_apart_stay(spark, empty):
    rows = [(0, "The quick brown fox jumps over"), (1, "The quiXk brown fXx jumps over"), (2, "he quick brown fox jumps overr")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    assert line_dedup.dedup_lines(empty).collect() == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_common_and_in_order():
    import random

    rng = random.Random(3)
    for _ in range(200):
        b = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 20))]
        a = [w for w in b if rng.random() > 0.1] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 20))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
    assert len(license_scan.align("x y all rights z reserved".split(), "all rights reserved".split())) == 3


def test_licenses_are_found_whole_and_changed(spark, docs, rows, empty):
    mit = license_scan.TEMPLATES["mit-text"].text
    words = mit.split()
    words[5:9] = ["something", "else"]
    texts = ["Before. " * 500 + mit + " after." * 500, "Start " + " ".join(words) + " end", "Released under the\nMIT license. x Released under the MIT License.", "no license here", None, "",
             " ".join(words[::3]), "Licensed under CC BY-NC 4.0."]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", license_scan.licenses("text").alias("f")).orderBy("i").collect()]
    assert [[x.template for x in f] for f in got] == [["mit-text"], ["mit-text"], ["mit", "mit"], [], [], [], [], ["cc-by-nc-4.0"]]
    assert texts[0][got[0][0].start: got[0][0].end] == mit[:-1] and got[0][0].coverage == 1.0 and got[1][0].coverage < 1.0
    assert docs.select(license_scan.licenses("text")).count() == len(rows)
    assert empty.select(license_scan.licenses("text")).collect() == []


NAMED = {
    "Released under the BSD License.": ["bsd"], "released under the new license": [], "Mozilla Public License": [], "Eclipse General Public License": [],
    "CC BY-ND 4.0": [], "Licensed under CC BY-ND 4.0": ["cc-by-nd-4.0"], "Licensed under CC BY 4.0": ["cc-by-4.0"], "Licensed under CC BY-NC-SA 4.0 here": ["cc-by-nc-sa-4.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["gpl"], "licensed under the GNU Lesser General Public License": ["lgpl"],
    "licensed under the GNU Library General Public License": [], "licensed under the GNU Affero General Public License": ["agpl"], "All rights reserved.": ["all rights reserved"],
    "Mozilla Public License, Version 2.0": ["mpl-2.0"], "Released under the terms of the MIT License": ["mit"], "mit license": [], "all seats reserved": [], "MIT mit MIT " * 50: [],
}


def test_near_notices_are_not_named_wrongly():
    scan = license_scan.Templates()
    for text, want in NAMED.items():
        assert [x["license"] for x in scan.find(text)] == want, text
        assert [x["license"] for x in scan.find("filler words " * 300 + text + " more of them" * 300)] == want, text
    for name, template in license_scan.TEMPLATES.items():
        assert template.license in [x["license"] for x in scan.find(template.text)], name
    for wrong in ("absent", "the"):
        with pytest.raises(ValueError):
            license_scan.Templates({"x": license_scan.Template("x", "x", (wrong,), "the words of the template")})


def best_by_subsequence(text, templates):
    """Licenses whose longest common subsequence with some stretch of the text covers enough, names and marks apart."""
    own, found = license_scan.words(text)[0], set()
    for template in templates.values():
        words = license_scan.words(template.text)[0]
        need = len(words) if len(words) <= license_scan.SHORT else 0.8 * len(words)
        if set(template.marks) <= set(own) and lcs(own, words) >= need:
            found.add(template.license)
    return found


def test_changed_notices_against_common_subsequences():
    rng, scan = random.Random(6), license_scan.Templates()
    for name in ("bsd-notice", "gpl-3.0-notice", "lgpl-2.1-notice", "apache-2.0-header", "isc-text", "cc0-1.0", "mpl-2.0-header", "bsd-3-text", "bsd-2-text"):
        template = license_scan.TEMPLATES[name]
        words = template.text.split()
        marked = {i for i, w in enumerate(words) if set(license_scan.words(w)[0]) & {*template.marks, *license_scan.NAMES}}
        for at in range(0, len(words) + 1, max(1, len(words) // 12)):
            foreign = [f"foreign{k}" for k in range(12)]
            text = " ".join(["x"] * rng.randint(0, 60) + words[:at] + foreign + words[at:] + ["y"] * rng.randint(0, 60))
            assert template.license in [x["license"] for x in scan.find(text)], (name, at)
        for share in (0.05, 0.1, 0.3, 0.5):
            kept = [w if i in marked or rng.random() > share else f"other{i}" for i, w in enumerate(words)]
            got = {x["license"] for x in scan.find(" ".join(kept))}
            able = best_by_subsequence(" ".join(kept), license_scan.TEMPLATES)
            assert got <= able and (share > 0.1 or template.license in got), (name, share, got, able)


def test_digest_of_spans():
    text = "token = 'abcd1ef0123456789abcd'"
    assert hashlib.sha256(b"assign:0:30").hexdigest() == hashlib.sha256(",".join(f"assign:{s}:{e}" for s, _, e, _ in base_spans(text)).encode()).hexdigest()
