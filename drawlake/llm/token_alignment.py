"""Alignment of two tokenizers' tokens by coalescing their byte intervals.

Tokens of both sides are intervals of bytes.  All intervals are sorted by start (``lexsort``), the running
maximum of their ends is taken (``maximum.accumulate``), and a group ends where the next start reaches that
maximum.  Within a group every pair of tokens whose intervals overlap is expanded; a pair whose intervals
end together is a link.

A text is cut at places where both tokenizers certainly end a token, so the tokens of a part depend on
that part alone; each distinct part of a chunk of documents is tokenised and aligned once, and many of them
at a time.  A chunk (``CHUNK_CHARS`` characters, or one longer document) becomes one written row: its
documents' digests, the parts that each document holds, the links of each part, and how often each pair of
ids is linked in it.  Counts of pairs are summed over the corpus from these partial sums, the highest of each
B id is found, and they return to the chunks, which then score their documents.  A pair of ids is shuffled once
a chunk, however many documents hold it.

Defined results: null and empty texts, and texts whose tokens on either side do not join to the bytes of
the text (with its opening space), have no tokens: zeros and an empty digest; repeated rows count and
are returned each; equal counts are all highest; a very long document is a chunk of its own; an empty table
gives no rows; a null id stays null.  Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, ship, staged
from drawlake.llm.packing import Encoder, tokenizer_path

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk of documents; bytes that the parts kept between chunks may take.
CHUNK_CHARS, KEPT_BYTES = 2_000_000, 48 << 20
#: Parts that are tokenised and aligned at a time, and the bits of a B id in the code of a pair.
PARTS_AT_ONCE, B_BITS = 20_000, 24

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_STRUCT = ", ".join(": ".join(field.split()) for field in _DOC.split(", "))
_CHUNK = f"chunk long, docs array<struct<{_STRUCT}>>, codes array<long>, counts array<long>, sizes binary, parts binary, ends binary, links binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_pairs: dict[tuple[str, str], Aligner] = {}


@dataclass
class Groups:
    """Groups of overlapping intervals of the sides A and B, and the pairs that overlap."""

    #: The group of every token of either side, in the tokens' order.
    a_group: np.ndarray
    b_group: np.ndarray
    #: Positions of tokens that overlap, by A, then B.
    pair_a: np.ndarray
    pair_b: np.ndarray


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> Groups:
    """Group two lists of intervals that are sorted and do not overlap within a list."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[True], start[order][1:] >= reach[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, side="right")
    many = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    pair_a = np.repeat(np.arange(len(a_start)), many)
    pair_b = np.arange(len(pair_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return Groups(group[: len(a_start)], group[len(a_start):], pair_a, pair_b)


@dataclass
class Aligned:
    """What documents need to know of their parts, by part: tokens, groups and links, the links' codes, and the groups as text.

    Parts whose tokens do not join to them are not ``right`` and have none of these.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    right: np.ndarray
    codes: np.ndarray
    texts: list[str]

    @classmethod
    def none(cls) -> Aligned:
        return cls(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool), np.zeros(0, np.int64), [])

    def joined(self, more: list[Aligned]) -> Aligned:
        every = [self, *more]
        arrays = (np.concatenate([getattr(x, name) for x in every]) for name in ("n_a", "n_b", "n_groups", "n_links", "right", "codes"))
        return Aligned(*arrays, list(chain.from_iterable(x.texts for x in every)))

    def taken(self, at: np.ndarray) -> Aligned:
        many = self.n_links[at]
        start = (np.cumsum(self.n_links) - self.n_links)[at]
        links = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        return Aligned(self.n_a[at], self.n_b[at], self.n_groups[at], many, self.right[at], self.codes[links], [self.texts[k] for k in at.tolist()])


class Aligner:
    """Tokenises and aligns the distinct parts of texts; keeps those of earlier chunks, of about ``limit`` bytes."""

    #: Bytes that a part takes beside its groups as text.
    ENTRY = 300

    def __init__(self, a_path: str, b_path: str, limit: int = KEPT_BYTES):
        import sentencepiece

        self.a = Encoder(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        plain = {chr(b): b for span in ((33, 127), (161, 173), (174, 256)) for b in range(*span)}
        plain |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in plain)}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(plain[c] for c in token if c in plain)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # Parts are independent on side B if no piece goes on over a space or holds a line end.
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross spaces or line ends")
        self.lead = self.b.piece_to_id("▁")
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.limit, self.size = limit, 0
        self.place: dict[str, int] = {}
        self.kept = Aligned.none()

    def _b_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts; the model puts a space before each, which those that open with one must not get twice."""
        ids = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [i if p[0] == " " else i[1:] if i and i[0] == self.lead else [] for p, i in zip(parts, ids)]

    @staticmethod
    def _joined(whole: list[bytes], ids: np.ndarray, many: np.ndarray, tokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part, ``many`` of them, join to its bytes."""
        right = _sums(sizes[ids], many) == np.fromiter(map(len, whole), np.int64, len(whole))
        own = [tokens[i] for i in ids.tolist()]
        if right.all() and b"".join(own) == b"".join(whole):
            return right
        ends = np.cumsum(many)
        for k in np.flatnonzero(right).tolist():
            right[k] = b"".join(own[ends[k] - many[k]: ends[k]]) == whole[k]
        return right

    def align(self, parts: list[str]) -> Aligned:
        """Tokens, groups and links of distinct parts, each of which opens with a space or a line end."""
        known, b_ids = self.a.fresh(parts), self._b_ids(parts)
        a_ids = [known[p] for p in parts]
        a_many, b_many = np.fromiter(map(len, a_ids), np.int64, len(parts)) >> 2, np.fromiter(map(len, b_ids), np.int64, len(parts))
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_many.sum()))
        whole = [p.encode("utf-8", "surrogatepass") for p in parts]
        right = self._joined(whole, a, a_many, self.a_bytes, self.a_sizes) & self._joined(whole, b, b_many, self.b_bytes, self.b_sizes)
        a, b = a[np.repeat(right, a_many)], b[np.repeat(right, b_many)]
        a_many, b_many = np.where(right, a_many, 0), np.where(right, b_many, 0)
        if not len(a):
            zero = np.zeros(len(parts), np.int64)
            return Aligned(zero, zero, zero, zero, right, zero[:0], [""] * len(parts))
        a_len, b_len = self.a_sizes[a], self.b_sizes[b]
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        found = coalesce(a_end - a_len, a_end, b_end - b_len, b_end)
        linked = a_end[found.pair_a] == b_end[found.pair_b]
        link_a, link_b = found.pair_a[linked], found.pair_b[linked]
        a_cut = np.concatenate([[0], np.cumsum(a_many)])
        texts = self._written(a, b, found)
        group_cut = np.concatenate([found.a_group, [len(texts)]])[a_cut]
        cut = group_cut.tolist()
        return Aligned(a_many, b_many, np.diff(group_cut), np.diff(np.searchsorted(link_a, a_cut)), right, a[link_a] << B_BITS | b[link_b],
                       [";".join(texts[i:j]) for i, j in zip(cut, cut[1:])])

    def _written(self, a: np.ndarray, b: np.ndarray, found: Groups) -> list[str]:
        """``a1,a2|b1`` of every group."""
        sides = []
        for ids, group in ((a, found.a_group), (b, found.b_group)):
            text = [self.names[i] for i in ids.tolist()]
            cut = np.searchsorted(group, np.arange(group[-1] + 2)).tolist()
            sides.append([text[i] if j == i + 1 else ",".join(text[i:j]) for i, j in zip(cut, cut[1:])])
        return [f"{x}|{y}" for x, y in zip(*sides)]

    def lookup(self, needed: list[str]) -> Aligned:
        """The distinct parts ``needed``, as ``Encoder.split`` writes them, in order.  Beyond the limit only these are kept for the next chunk."""
        new = [p for p in needed if p not in self.place]
        fresh = [self.align([Encoder.raw(p) for p in new[at: at + PARTS_AT_ONCE]]) for at in range(0, len(new), PARTS_AT_ONCE)]
        self.place |= zip(new, range(len(self.place), len(self.place) + len(new)))
        self.kept = self.kept.joined(fresh)
        self.size += sum(sum(map(len, x.texts)) + 8 * len(x.codes) + self.ENTRY * len(x.texts) for x in fresh)
        found = self.kept.taken(np.fromiter(map(self.place.__getitem__, needed), np.int64, len(needed)))
        if self.size > self.limit:
            few = [k for k, p in enumerate(needed) if len(p) <= Encoder.LONGEST]
            self.kept = found.taken(np.array(few, np.int64))
            self.place = {needed[k]: n for n, k in enumerate(few)}
            self.size = sum(map(len, self.kept.texts)) + 8 * len(self.kept.codes) + self.ENTRY * len(few)
        return found


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Aligner(a_path, b_path)
    return _pairs[a_path, b_path]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def chunk_row(code: Aligner, number: int, docs: list[tuple[int | None, str]]) -> dict:
    """The written row of one chunk of documents."""
    full = [bool(text) for _, text in docs]
    names, flat, many = code.a.split(pa.array([" " + text for _, text in docs if text], pa.large_string()))
    blank = np.fromiter((p == "\x01" for p in names), bool, len(names))  # a plain text is cut in front of its opening space too
    sizes = np.zeros(len(docs), np.int64)
    sizes[full] = many - _sums(blank[flat].astype(np.int64), many)
    flat = (np.cumsum(~blank) - 1)[flat[~blank[flat]]]
    parts = code.lookup([p for p in names if p != "\x01"])
    wrong = np.repeat(_sums(~parts.right[flat] if len(flat) else flat, sizes) > 0, sizes)
    sizes[_sums(wrong.astype(np.int64), sizes) > 0] = 0
    flat = flat[~wrong]
    columns = [_sums(values[flat], sizes).tolist() for values in (parts.n_a, parts.n_b, parts.n_groups, parts.n_links)]
    ends = np.cumsum(sizes).tolist()
    texts = [parts.texts[k] for k in flat.tolist()]
    digests = [sha256(";".join(texts[end - n: end]).encode()).hexdigest() if n else "" for n, end in zip(sizes.tolist(), ends)]
    names = [c.split()[0] for c in _DOC.split(", ")]
    rows = [dict(zip(names, row)) for row in zip([d for d, _ in docs], *columns, digests)]
    many = parts.n_links
    used = np.repeat(np.bincount(flat, minlength=len(many)), many)
    codes, where = np.unique(parts.codes, return_inverse=True)
    counts = np.bincount(where, weights=used, minlength=len(codes)).astype(np.int64)
    return {"chunk": number, "docs": rows, "codes": codes, "counts": counts, "sizes": sizes.astype("<u4").tobytes(), "parts": flat.astype("<u4").tobytes(),
            "ends": many.astype("<u4").tobytes(), "links": where.astype("<u4").tobytes()}


def _chunks(a_path: str, b_path: str, chunk_chars: int):
    doc = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _DOC.split(", ")])
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                        *((name, pa.binary()) for name in ("sizes", "parts", "ends", "links"))])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        docs, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if docs and size + len(text) > chunk_chars:
                    yield pa.RecordBatch.from_pylist([chunk_row(code, number, docs)], schema)
                    docs, size, number = [], 0, number + 1
                docs.append((doc_id.as_py(), text))
                size += len(text) + 1
        if docs:
            yield pa.RecordBatch.from_pylist([chunk_row(code, number, docs)], schema)

    return chunks


def _score(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of the documents of one chunk."""
    out = {c.split()[0]: [] for c in _RESULT.split(", ")}
    order = np.argsort(pairs["code"].to_numpy())
    total, best = pairs["total"].to_numpy()[order], pairs["best"].to_numpy()[order]
    for row in chunk.to_pylist():
        sizes, flat, many, where = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("sizes", "parts", "ends", "links"))
        # The pairs of a chunk come back complete and in the order of their codes.
        scores = {"n_best": _sums(best[where], many), "count_sum": _sums(total[where], many)}
        for name, values in scores.items():
            out[name] += _sums(values[flat], sizes).tolist()
        for doc in row["docs"]:
            for name, value in doc.items():
                out[name].append(value)
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _RESULT.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types)], names=list(out))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``code, total, best``: links of every pair of ids in the corpus, and 1 if no other A id has more with its B id."""
    part = chunks.select(F.explode(F.arrays_zip("codes", "counts")).alias("pair")).select(F.col("pair.codes").alias("code"), F.col("pair.counts").alias("n"))
    total = part.filter("n > 0").groupBy("code").agg(F.sum("n").alias("total"))
    total = staged(total.withColumn("b", F.col("code").bitwiseAND((1 << B_BITS) - 1)), "pair-counts")
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(most, "b").select("code", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_corpus(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Tokens, groups and links of every document, with its links' counts in the whole corpus."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    function = _chunks(a_path or tokenizer_path(A_MODEL), b_path or tokenizer_path(B_MODEL), chunk_chars)
    chunks = staged(chosen.mapInArrow(function, _CHUNK), "aligned-chunks", long_rows=True)
    asked = chunks.select(F.col("chunk").alias("home"), F.explode("codes").alias("code"))
    # A part that only documents without tokens hold counts nowhere.
    answered = asked.join(pair_counts(chunks), "code", "left").select("home", "code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "best")))
    return chunks.drop("codes", "counts").groupBy("chunk").cogroup(answered.groupBy("home")).applyInArrow(_score, _RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(documents(spark, sf_dir))
