"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that
no neighbouring word extends and that is at least ``max(MIN_LENGTH, EXPONENT * q)`` words long.

The words of a block of documents form one sequence of numbers, in which no document shares a number with
another.  Prefix doubling ranks all factors of length 1, 2, 4, ... and ends in the suffix array; every
level's ranks are places in it, so a factor's occurrences are one interval of the suffix array.

1. Queries.  A run with period ``q`` holds a whole dyadic block of ``m`` words and that block again ``q``
   later, ``m`` being the power of two with ``(2m - 1) / 3 <= q < (4m - 1) / 3``.  So each dyadic block asks
   for its occurrences in that window behind it: range counting and range successor in a wavelet matrix
   over the suffix array.
2. Progressions.  The window is narrower than the block, hence its occurrences form one arithmetic
   progression, which its first two members and their number give.  Its members are candidate periods.
3. Runs.  A candidate grows to both sides by comparing ranks of ever shorter factors.  Candidates with the
   same stretch differ by multiples, and the smallest is its period: a stretch of four periods with a smaller
   period too has one that divides them, whose block is asked as well.

Everything is exact.  A document lies in one task whole; documents are dealt to blocks of about ``BLOCK_WORDS``
words, a longer one being a block of its own with a working set of some 100 bytes a word, and four more
for each doubling of its longest repeated stretch.

Defined results: null, empty and blank texts have no words, no run, four nulls and the digests of empty
strings; of runs of equal length the one with the smallest start, then period, is reported; repeated rows
give a row each; an empty table gives no rows; a null id stays null and its text as it is.  Columns other
than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import WORD, documents, ship

#: Shortest run in words and in periods; words of a block of documents.
MIN_LENGTH, EXPONENT, BLOCK_WORDS = 6, 4, 100_000

_word = re.compile(WORD)
_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


class WaveletMatrix:
    """Counts and order statistics of values in intervals of a sequence of distinct non-negative integers."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for shift in range(self.bits - 1, -1, -1):
            ones = (values >> shift & 1).astype(bool)
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            zeros = int(len(ones) - ones.sum())
            self.levels.append((words, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits in front of the places ``at``."""
        inside = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(inside)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of every interval ``[lo, hi)`` are less than ``bound``."""
        total = np.zeros(len(lo), np.int64)
        full = bound >= 1 << self.bits
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        total[full] = (hi - lo)[full]
        for level, (words, before, zeros) in enumerate(self.levels):
            left, right = self._ones(words, before, lo), self._ones(words, before, hi)
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            total += np.where(one & ~full, (hi - right) - (lo - left), 0)
            lo, hi = np.where(one, zeros + left, lo - left), np.where(one, zeros + right, hi - right)
        return total

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest value (from 0) of every interval."""
        value = np.zeros(len(lo), np.int64)
        lo, hi, n = lo.astype(np.int64), hi.astype(np.int64), n.copy()
        for words, before, zeros in self.levels:
            left, right = self._ones(words, before, lo), self._ones(words, before, hi)
            small = (hi - right) - (lo - left)
            one = n >= small
            n -= np.where(one, small, 0)
            value = value << 1 | one
            lo, hi = np.where(one, zeros + left, lo - left), np.where(one, zeros + right, hi - right)
        return value


def basic_factors(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the factors of length 1, 2, 4, ... and the suffix array.

    The rank of a factor is the first place of the suffix array whose suffix begins with it.  The last
    level is the one at which all ranks differ; factors are cut at the end of the sequence.
    """
    n = len(symbols)
    keys, levels = symbols.astype(np.int64), []
    while True:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int32)
        rank[order] = starts[np.cumsum(new) - 1]
        levels.append(rank)
        if len(starts) == n:
            return levels, order
        step = 1 << len(levels) - 1
        follows = np.zeros(n, np.int64)
        follows[: n - step] = rank[step:].astype(np.int64) + 1
        keys = rank.astype(np.int64) * (n + 1) + follows


def _grow(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Length of the longest common extension of the places ``a`` and ``b``, ``a < b``, forward from or back before them."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, rank = 1 << level, levels[level]
        x, y = (a - length - step, b - length - step) if back else (a + length, b + length)
        inside = (x >= 0) if back else (y + step <= n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        length += np.where(same, step, 0)
    return length


def runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """``start, length, period`` of all runs, by start, then period.  ``exponent`` is at least 4."""
    if exponent < 4:
        raise ValueError("blocks are dense enough for four periods and more")
    none = np.empty((0, 3), np.int64)
    if len(symbols) < 2:
        return none
    levels, suffixes = basic_factors(symbols)
    n, tree = len(symbols), None
    found = []
    for level in range(1, len(levels)):
        m, rank = 1 << level, levels[level]
        at = np.arange(0, n - m + 1, m, dtype=np.int64)
        lo = rank[at].astype(np.int64)
        counts = np.bincount(rank, minlength=n)
        at, lo = at[counts[lo] > 1], lo[counts[lo] > 1]
        hi = lo + counts[lo]
        if not len(at):
            continue
        near, far = -(-(2 * m - 1) // 3), -(-(4 * m - 1) // 3)
        tree = tree or WaveletMatrix(suffixes)
        skip = tree.below(lo, hi, at + near)
        many = tree.below(lo, hi, at + far) - skip
        some = many > 0
        at, lo, hi, skip, many = at[some], lo[some], hi[some], skip[some], many[some]
        if not len(at):
            continue
        first = tree.nth(lo, hi, skip)
        step = np.zeros(len(at), np.int64)
        more = many > 1
        step[more] = tree.nth(lo[more], hi[more], skip[more] + 1) - first[more]
        member = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a, b = np.repeat(at, many), np.repeat(first, many) + member * np.repeat(step, many)
        before, after = _grow(levels, a, b, True), _grow(levels, a, b, False)
        period = b - a
        length = before + after + period
        keep = length >= np.maximum(min_length, exponent * period)
        found.append(np.stack([(a - before)[keep], length[keep], period[keep]], axis=1))
    every = np.concatenate(found) if found else none
    if not len(every):
        return none
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(axis=1)])
    every = every[fresh]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _numbers(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of numbers for all documents, each followed by a number of its own, and where each begins."""
    code: dict[str, int] = {}
    ids, sizes = [], []
    for words in docs:
        ids += [code.setdefault(w, len(code)) for w in words]
        ids.append(-1)
        sizes.append(len(words) + 1)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
    return (doc << 32) + np.asarray(ids, dtype=np.int64) + 1, starts


def collapse(words: list[str], found: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [w for w, inside in zip(words, np.cumsum(change)[:-1].tolist()) if not inside]


def block_runs(docs: list[list[str]], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of every document of a block."""
    symbols, starts = _numbers(docs)
    found = runs(symbols, min_length, exponent)
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
    found[:, 0] -= starts[owner]
    return [found[cuts[k]: cuts[k + 1]] for k in range(len(docs))]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of ``op11``'s contract: every tenth id by checksum repeats a part of its text to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a: a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def _rows(docs: list[tuple[int | None, list[str]]], min_length: int, exponent: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(8)]
    for (doc_id, words), found in zip(docs, block_runs([w for _, w in docs], min_length, exponent)):
        best: tuple = (None,) * 4
        if len(found):
            start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
            best = (start, length, period, 1000 * length // period)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        row = (doc_id, len(found), *best, sha256(listed.encode()).hexdigest(),
               sha256(" ".join(collapse(words, found)).encode()).hexdigest())
        for column, value in zip(out, row):
            column.append(value)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def _scan(prepare: Callable | None, min_length: int, exponent: int, block_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, words = doc_id.as_py(), _word.findall(text.as_py() or "")
                if held and size + len(words) > block_words:
                    yield _rows(held, min_length, exponent)
                    held, size = [], 0
                held.append((doc_id, prepare(doc_id, words) if prepare else words))
                size += len(words) + 1
        if held:
            yield _rows(held, min_length, exponent)

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable | None = None,
                  min_length: int = MIN_LENGTH, exponent: int = EXPONENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Runs of every document: their number, the longest one, a digest of all and of the text without repeats.

    ``prepare(id, words)`` may change the words first.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_scan(prepare, min_length, exponent, block_words), _SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), prepare=planted)
