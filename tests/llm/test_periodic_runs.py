import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from drawlake.llm import periodic_runs as P
from drawlake.llm.common import WORD


def brute_runs(words, min_length=6, exponent=4):
    """Every maximal stretch of every period, smallest period only."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(f for f in found if not any(g[:2] == f[:2] and g[2] < f[2] for g in found))


def brute_row(doc_id, text):
    words = re.findall(WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in found), default=None)
    longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *longest, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def sequences(rng):
    for _ in range(400):
        letters = rng.choice(["a", "ab", "ab", "abc", "abcdefghij"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            at, q = rng.randint(0, len(words)), rng.randint(1, 12)
            words[at:at] = ([rng.choice("abxyz") for _ in range(q)] * 9)[: rng.randint(q, 6 * q + 3)]
        yield words


def test_runs_equal_every_period_tried():
    docs = list(sequences(random.Random(3)))
    assert sum(len(brute_runs(d)) for d in docs) > 300
    for found, words in zip(P.block_runs(docs), docs):
        assert [tuple(r) for r in found.tolist()] == brute_runs(words), words
    for words in docs[:60]:
        symbols = np.array([ord(w) for w in words], np.int64)
        assert [tuple(r) for r in P.runs(symbols).tolist()] == brute_runs(words)
        assert [tuple(r) for r in P.runs(symbols, 4).tolist()] == brute_runs(words, 4)
        assert [tuple(r) for r in P.runs(symbols, 8, 5).tolist()] == brute_runs(words, 8, 5)
    with pytest.raises(ValueError):
        P.runs(np.zeros(9, np.int64), 6, 3)


def test_wavelet_matrix_counts_and_orders():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 200):
        values = rng.permutation(n)
        tree = P.WaveletMatrix(values)
        lo = rng.integers(0, n, 50)
        hi = lo + rng.integers(0, n - lo + 1)
        bound = rng.integers(0, n + 40, 50)
        assert tree.below(lo, hi, bound).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, bound)]
        full = hi > lo
        nth = (rng.random(50) * (hi - lo)).astype(np.int64)
        assert tree.nth(lo[full], hi[full], nth[full]).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(lo[full], hi[full], nth[full])]


def test_long_powers_and_nested_periods():
    deep = (["a"] * 8 + ["b"]) * 40 + ["c"]
    assert [tuple(r) for r in P.block_runs([deep])[0].tolist()] == brute_runs(deep)
    flat = ["x"] * 5000
    assert P.block_runs([flat, ["y"] * 5, flat])[2].tolist() == [[0, 5000, 1]]
    assert P.block_runs([["y"] * 5, [], ["y"] * 6])[2].tolist() == [[0, 6, 1]]
    assert [len(r) for r in P.block_runs([["y"] * 5, []])] == [0, 0]


def test_documents_against_brute_force(spark, docs, rows, empty):
    rng = random.Random(8)
    texts = [" ".join(words) for words in sequences(rng)][:150]
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(brute_row(1000 + k, t) for k, t in enumerate(texts))
    assert sorted(map(tuple, P.periodic_runs(extra, prepare=P.planted).collect())) == want
    assert sum(row[1] for row in want) > 20
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got = sorted((tuple(r) for r in P.periodic_runs(docs, prepare=P.planted).collect()), key=str)
    wanted = {r[0]: brute_row(r[0], r[1]) for r in short}
    assert len(got) == len(rows)
    assert all(row == wanted[row[0]] for row in got if row[0] in wanted)
    assert all(row[1] == 0 and row[2] is None for row in got if row[0] is not None and wanted.get(row[0], ("", 1))[1] == 0)
    assert P.periodic_runs(empty).collect() == []
    # The block size does not show.
    again = P.periodic_runs(docs, prepare=P.planted, block_words=50)
    assert sorted((tuple(r) for r in again.collect()), key=str) == got
