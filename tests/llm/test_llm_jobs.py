"""Packing, mixing, joins, search, classifiers and the pipeline against brute force, round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from drawlake.llm import byte_cnn, exact_topk, jaccard_join, language_id, mixing, packing

from .conftest import SYLLABLES, prose
from .test_llm_scans import WORD, deduplicated

CAPACITY = 128


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def check_packing(got, rows, tokenizer, capacity):
    """Every document's ids come back from its pieces, and sequences are gapless and within the capacity."""
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_round_trip(docs, rows, empty, tokenizer):
    bins = check_packing(packing.pack(docs, CAPACITY).collect(), rows, tokenizer, CAPACITY)
    total = sum(n for own in bins.values() for _, n in own)
    assert len(bins) <= math.ceil(total / CAPACITY) * 1.05 + 2
    check_packing(packing.pack(docs, CAPACITY, block_docs=16).collect(), rows, tokenizer, CAPACITY)
    assert packing.pack(empty).collect() == []


def test_large_ids_beside_a_null_id(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "some text"), (None, "other text")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(df).collect()} == {big, None}
    assert {r.doc_id for r in jaccard_join.join_documents(df).collect()} == {big, None}


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = ["", " ", "  ", "a  b", " a", "a ", "a\n b \n", "don't  stop\n\n\nnow", "a\x00 b", "<|endoftext|> hi", "a <|endoftext|>\nb<|endoftext|>", "\t\t x", " " * 50 + "z",
             "é à　ü", "a b \x1c c", "x\xa0 y", "end\n", "\nstart of\nlines here", "a\r\nb", "x" * 300 + " y " + "z" * 300, "a\u200bb c\u2028d e"]
    texts += [prose(random.Random(k), "fr", 200) for k in range(5)]
    plain = Tokenizer.from_file(packing.tokenizer_path())
    plain.encode_special_tokens = True
    for theirs, ours in ((tokenizer, {}), (plain, {"plain": True})):
        code = packing.Encoder(packing.tokenizer_path(), limit=20_000, **ours)
        for some in (texts, texts[:5], texts[-5:], [], *([t] for t in texts), texts):
            ids, ends = code.encode(pa.array(some, pa.string()))
            assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [x.ids for x in theirs.encode_batch(some, add_special_tokens=False)]
            assert code.size <= 20_000 + 200 * 900 and max(map(len, [*code.old, *code.young]), default=0) <= code.LONGEST
    assert 50256 in tokenizer.encode(texts[9]).ids and 50256 not in plain.encode(texts[9]).ids


def test_two_documents_replace_the_smallest():
    number, offset = packing.best_two_fit(np.array([60, 30, 25, 14]), 100)
    first = [n for n, s in zip([60, 30, 25, 14], number) if s == number[0]]
    assert sorted(first) == [14, 25, 60]
    lengths = np.random.default_rng(1).integers(1, 101, 500)
    number, offset = packing.best_two_fit(lengths, 100)
    assert np.bincount(number, weights=lengths).max() <= 100 and number.max() + 1 <= lengths.sum() / 100 * 1.03 + 1


def test_choice_of_two_against_every_pair():
    """Greedy fill, then the smallest piece gives way to the best two, by trying all of them."""
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        left, bins = sorted(rng.choices(range(1, capacity + 1), k=rng.randint(1, 30))), []
        lengths = np.array(left)
        while left:
            own, gap = [], capacity
            while fits := [x for x in left if x <= gap]:
                own.append(fits[-1])
                left.remove(fits[-1])
                gap -= fits[-1]
            while gap:
                small = min(own)
                pairs = [(left[i], left[j]) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + small]
                if not pairs or max(map(sum, pairs)) <= small:
                    break
                gap += small - max(map(sum, pairs))
                best = max(pairs, key=lambda p: (sum(p), abs(p[0] - p[1])))
                own.remove(small)
                left = sorted([*left, small])
                for x in best:
                    left.remove(x)
                    own.append(x)
            bins.append(sum(own))
        number, _ = packing.best_two_fit(lengths, capacity)
        assert np.bincount(number, weights=lengths).astype(int).tolist() == bins, lengths


def targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        above = {s for s in order if s not in full and out[s] > cap * sizes[s]}
        if not above:
            return out
        full |= above


def check_mix(got, rows):
    """A source misses its target by no more than its largest document."""
    size = lambda t: len(WORD.findall(t or ""))
    source_size, largest = Counter(), Counter()
    for _, text, _, source, *_ in rows:
        source_size[source] += size(text)
        largest[source] = max(largest[source], size(text))
    want = targets(source_size)
    by = {}
    for r, source in got:
        assert r.source_size == source_size[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[source] = by.get(source, 0) + r.taken
    for s, taken in by.items():
        assert abs(taken - want[s]) <= largest[s], (s, taken, want[s])


def test_mixing_meets_its_targets(spark, docs, rows, empty):
    source = {}
    for i, t, _, s, *_ in rows:
        source.setdefault((i, len(WORD.findall(t or ""))), s)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in rows if i is not None)
    check_mix([(r, source[r.doc_id, r.size]) for r in got], rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).collect() == []


def test_rates_solve_the_dual(docs):
    """Rates are exponential in size, and meet the target of their source, as bisection finds them."""
    by = {}
    for r in mixing.mix(docs).collect():
        by.setdefault(r.source, []).append(r)
    solved = 0
    for rows in by.values():
        total, target = rows[0].source_size, rows[0].target
        full = [r for r in rows if r.size]
        if not full or target >= 3 * total:
            assert all(r.rate == (3.0 if r.size else 0.0) for r in rows)
            continue
        mean, low, high = total / len(full), -60.0, 60.0
        rate = lambda lam, n: min(3.0, math.exp(min(50.0, lam * n / mean)))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(rate(middle, r.size) * r.size for r in full) < target else (low, middle)
        assert [r.rate for r in full] == pytest.approx([rate(low, r.size) for r in full], rel=1e-4)
        solved += 1
    assert solved >= 2


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 400, None: 70}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in targets(sizes).items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    return {tuple(words[i: i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))}


def join_by_force(rows, percent=85):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return [(i, len(s), smallest.get(root(k), i)) for k, (i, s) in enumerate(sets)]


def family(seed, base_words, copies, edits, start=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(base_words)]
    out = [(start, " ".join(base), "en", "s")]
    for k in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append((start + k + 1, " ".join(own), "en", "s"))
    return out


def test_join_against_brute_force(docs, rows, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(join_by_force(rows), key=str)
    assert jaccard_join.join_documents(empty).collect() == []


def test_join_of_families_split_into_buckets(spark):
    rows = family(1, 120, 60, 6) + family(2, 40, 30, 2, 100) + family(3, 12, 20, 1, 200) + family(4, 300, 25, 14, 300)
    rows += [(i + 400, t + " " + " ".join(f"tail{j}" for j in range(i % 40)), "en", "s") for i, (_, t, *_) in enumerate(rows[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(join_by_force(rows))
    for bucket, chunk in ((1500, 1500), (7, 5)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_documents(df, bucket=bucket, chunk=chunk).collect())
        assert got == want
    assert len({c for *_, c in want}) > 5


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = prose(random.Random(2), "de", 400)
    whole = jaccard_join.shingle_sets([text, "", None, "one two"])
    monkeypatch.setattr(jaccard_join, "SLICE", 64)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, jaccard_join.shingle_sets([text, "", None, "one two"])))
    assert [len(s) for s in whole] == [len(shingles(t)) for t in (text, "", None, "one two")]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for i in range(150)]
    rows += [(150, None), (151, [1.0, None, 2.0]), (200, [float("nan")] * 6), (250, [float("inf")] * 6), (153, rows[3][1]), (154, rows[3][1]), (155, [0.0] * 6), (100, rows[100][1]), (50, [1.5, -2.0, 0.5, 0.0, 1.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, score string, rank string")
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:  # an id with two vectors asks twice
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for blocks in ((2048, 2048), (16, 2)):
        got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, index_block=blocks[0], query_block=blocks[1]).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).collect() == []


def test_language_on_held_out_texts(spark, docs, rows, empty):
    rng = random.Random(8)
    made = [(k, prose(rng, lang, 60), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language_id.fit(df, language_id.learnable())
    held = [m for m in made if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert sum(language_id.predict(t, model)[0] == lang for _, t, lang in held) >= 0.97 * len(held)
    assert language_id.predict(None, model) == ("und", 0.0, []) and language_id.predict("12 !", model)[0] == "und"
    mixed = prose(rng, "en", 40) + " " + prose(rng, "fr", 40)
    spans = language_id.predict(mixed, model)[2]
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "fr" and spans[-1]["end"] == len(mixed)
    shared = spark.sparkContext.broadcast(model)
    assert docs.select(language_id.identify(docs.text, shared)).count() == len(rows)
    assert language_id.fit(empty, language_id.learnable()).languages == []
    assert language_id.predict("some words", language_id.Model([], np.zeros((0, language_id.BUCKETS)), np.zeros((0, 1))))[0] == "und"


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(4)
    from itertools import product

    for _ in range(60):
        s = rng.normal(0, 3, (6, 3))
        value = lambda path: sum(s[t, k] for t, k in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
        assert value(language_id.label(s, 2.5)) == pytest.approx(max(map(value, product(range(3), repeat=6))))


def test_scores_small_against_the_switch():
    assert language_id.label(np.array([[0.0, 10, -11], [0, -11, 10]]), 14.0).tolist() == [1, 2]
    rng = np.random.default_rng(7)
    from itertools import product

    mixed = 0
    for _ in range(200):
        s = rng.normal(0, 1, (5, 3))
        value = lambda path: sum(s[t, k] for t, k in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
        labels = language_id.label(s, 2.5)
        assert value(labels) == pytest.approx(max(map(value, product(range(3), repeat=5))))
        mixed += len(set(labels.tolist())) > 1
    assert 0 < mixed < 200


def test_quality_on_held_out_texts(spark, docs, rows, empty):
    rng = random.Random(9)
    made = []
    for k in range(400):
        text, good = prose(rng, "en", rng.choice([10, 50, 200])), k % 3 > 0
        made.append((k, text if good else " ".join(w + "%%%" for w in text.split()), int(good)))
    texts = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, quality int")
    model = byte_cnn.fit(texts, labels, byte_cnn.learnable())
    held = [m for m in made if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    scores = model.scores([m[1].encode() for m in held])
    assert np.mean((scores >= 0.3) == np.array([m[2] for m in held])) >= 0.95
    shared = spark.sparkContext.broadcast(model)
    got = [r[0] for r in docs.select(byte_cnn.quality(docs.text, shared)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got)
    assert byte_cnn.fit(empty, labels, byte_cnn.learnable()).scores([b"x"]).tolist() == [0.5]


def test_scores_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, "de", n).encode() for n in (1, 3, 30, 300, 2000)] + [b"", b"\x00" * 70]
    model = byte_cnn.Network()
    whole = model.scores(texts)
    assert whole == pytest.approx([model.scores([t])[0] for t in texts], abs=1e-5)
    monkeypatch.setattr(byte_cnn, "SLICE", 64 * 8)
    assert whole == pytest.approx(model.scores(texts), abs=1e-5)


def test_gradients_by_differences():
    rng = random.Random(2)
    texts, labels = [prose(rng, "en", n).encode() for n in (20, 80)], np.array([1.0, 0.0], np.float32)
    model = byte_cnn.Network()
    loss = lambda: -np.mean(np.log(np.where(labels == 1, model.forward(texts), 1 - model.forward(texts)).astype(np.float64)))
    grads = model.gradients(texts, labels)
    for name, at in (("weight", (3,)), ("weight", (20,)), ("bias", (0,)), ("shift", (2,))):
        model.p[name][at] += 1e-2
        up = loss()
        model.p[name][at] -= 2e-2
        down = loss()
        model.p[name][at] += 1e-2
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=3e-3)
    largest = np.argsort(-np.abs(grads["taps"]).ravel())[:6]  # the filters themselves
    for at in zip(*np.unravel_index(largest, grads["taps"].shape)):
        model.p["taps"][at] += 1e-3
        up = loss()
        model.p["taps"][at] -= 2e-3
        down = loss()
        model.p["taps"][at] += 1e-3
        assert grads["taps"][at] == pytest.approx((up - down) / 2e-3, rel=0.05) and abs(grads["taps"][at]) > 1e-3


def test_pipeline_against_brute_force(spark, docs, rows, tokenizer):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    (_, language), (_, lines), (_, join), (_, mix), (_, pack) = corpus_pipeline.STAGES
    collect = lambda df: [tuple(r) for r in df.collect()]

    model = language_id.fit(plain, language_id.learnable())
    one = language(spark, plain, "").cache()
    ok = lambda t: (p := language_id.predict(t, model))[0] != "und" and p[1] >= language_id.KEEP_SCORE
    assert sorted(collect(one), key=str) == sorted((r for r in rows if ok(r[1])), key=str)

    two = lines(spark, one, "").cache()
    clean = deduplicated(collect(one))
    want = [(i, clean[i is None, i or 0, t], *rest) for i, t, *rest in collect(one)]
    assert sorted(collect(two), key=str) == sorted((r for r in want if WORD.search(r[1])), key=str)

    three = join(spark, two, "").cache()
    kept = {i for i, _, c in join_by_force(collect(two)) if i == c and i is not None}
    assert sorted(collect(three), key=str) == sorted({r for r in collect(two) if r[0] in kept}, key=str)

    four = mix(spark, three, "").cache()
    assert four.columns == plain.columns
    counts = Counter(r[0] for r in collect(four))
    assert all(n <= 3 for n in counts.values()) and set(counts) <= kept
    want = targets(Counter({s: sum(len(WORD.findall(r[1])) for r in collect(three) if r[3] == s) for s in {r[3] for r in collect(three)}}))
    for source, target in want.items():
        own = [len(WORD.findall(r[1])) for r in collect(three) if r[3] == source]
        assert abs(sum(len(WORD.findall(r[1])) for r in collect(four) if r[3] == source) - target) <= max(own)

    check_packing(pack(spark, four, "").collect(), collect(four), tokenizer, packing.CAPACITY)
    for frame in (one, two, three, four):
        frame.unpersist()


def test_nothing_is_lost_by_id(spark):
    """Null and repeated ids: whole rows of the near-duplicate and the mixture stage."""
    rng = random.Random(12)
    base = [prose(rng, "en", 60) for _ in range(6)]
    near = [t.split(" ") for t in base]
    for words in near:
        words[30] = "changed"
    near = [" ".join(w) for w in near]
    rows = [(1, base[0], "en", "a"), (None, near[0], "en", "a"), (2, near[0] + " more", "en", "b"),  # 1 and 2 meet through a text without an id
            (3, base[1], "en", "a"), (3, base[2], "en", "a"), (3, base[2], "de", "b"), (3, near[1], "en", "a"),  # one id, two groups
            (None, base[3], "en", "a"), (None, base[3], "de", None), (None, near[3], "en", "a"),  # a group without any id
            (None, base[4], "en", "a"), (9, base[4], "en", "a"), (None, None, "en", "a"), (None, "", "en", "a"), (4, " ", None, None), (4, " ", None, None)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    component = {(i, t): c for i, t, c in ((r.doc_id, r.text, r.component_id) for r in docs.join(
        jaccard_join.grouped(docs).select("row", "component_id").distinct(), jaccard_join.row_name("doc_id", "text") == F.col("row")).collect())}
    assert component[1, base[0]] == component[None, near[0]] == component[2, near[0] + " more"] == 1
    assert component[3, base[1]] == 3 and component[None, base[3]] is None and component[None, base[4]] == 9
    got = Counter(map(tuple, jaccard_join.stage(spark, docs, "").collect()))
    texts = Counter(r[1] for r in got.elements())
    assert not got - Counter(rows) and got[rows[0]] == 1 and got[rows[11]] == 1
    one_of = lambda *options: sum(texts[t] for t in options) == 1
    assert one_of(base[0], near[0], near[0] + " more") and one_of(base[1], near[1]) and one_of(base[2]) and one_of(base[3], near[3]) and one_of(base[4])
    assert sum(n for r, n in got.items() if not (r[1] or "").strip()) == 4 and sum(got.values()) == 9

    mixed = mixing.mix(docs).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.row, r.source] += r.copies
    hashed = {tuple(r)[:5]: r.h for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    out = [tuple(r) for r in mixing.stage(spark, docs, "").collect()]
    assert set(out) <= set(rows)
    assert Counter((r[0], hashed[r], r[3]) for r in out) == +want
    assert sum(1 for r in out if r[0] is None) > 0


def test_windows_over_a_sorted_partition(monkeypatch):
    """Windows of a few rows give what one window gives, also where one shingle fills several."""
    rng = np.random.default_rng(3)
    k = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 17), np.full(90, 23)]))
    v, w = rng.integers(1, 6, len(k)), np.where(rng.random(len(k)) < 0.05, -1, 0)
    v[(k == 23)], w[k == 23] = 4, 0
    v[w == -1] = 0
    batches = [pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(v[a:b]), pa.nulls(b - a, pa.int64()), pa.array(w[a:b].astype(np.int32))], names=list("kvxw"))
               for a, b in zip(range(0, 590, 25), [*range(25, 590, 25), 590])]

    def read():
        found, recur = set(), Counter()
        for batch in jaccard_join._recurring(iter(batches)):
            for kind, a, sid, _, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 2:
                    found.add((a, sid))
                else:
                    recur[sid] += a
        return found, recur

    whole = read()
    monkeypatch.setattr(jaccard_join, "WINDOW", 40)
    assert read() == whole and 23 not in {t for t, _ in whole[0]} and (17, 4) in whole[0]


def test_stages_on_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
