"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie; only ``(doc_id, piece, start, length, ids_crc32)`` is
shuffled.  Pieces are dealt by a hash to blocks of a bounded expected number and every block is
packed on its own, so the loss is at most the last few sequences of a block.  Within a block a
sequence is filled greedily with the largest piece that fits; then its smallest piece is replaced
by the two unpacked pieces that fill the enlarged gap best, as long as that makes the fit tighter.

Defined results: null text is an empty document, which is the end token alone; documents longer than
the capacity are cut into full pieces, of which the first may be shorter; repeated rows are packed
once for every row; an empty table gives no rows; a null doc_id stays null.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, settle, ship

#: Tokens of a sequence, the id that ends a document, and documents to a block.
CAPACITY, END_ID, BLOCK_DOCS = 2048, 0, 4096
#: Documents and bytes that are encoded at once; a longer document is encoded alone.
ROWS, BYTES = 2500, 4 << 20
TOKENIZER = "byte_bpe_50k.json"

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian 32-bit integers.

    Pre-tokens of the byte-level vocabulary never cross a single space or line end that stands between two
    other characters, so a text is cut before those and the ids of its parts are looked up.  Parts met for the
    first time are encoded by the tokenizer, many in one string: the ids that open with a space or line end
    tell them apart again.  Two generations of parts are kept, each of at most about ``limit`` bytes; long
    parts are not kept.  With ``plain``, literals of special tokens are ordinary text.
    """

    #: The places where a cut is certain.
    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
    #: Texts without these have no other spaces and line ends: pairs of white space, white space at the end and of other kinds.
    ODD = r"[ \n][ \n]|[ \n]$|[\x00-\x09\x0B-\x1F\x7F-\xA0]|\x{1680}|[\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}]"
    #: Characters of the longest part that is kept; bytes that an entry takes beside its contents.
    LONGEST, ENTRY = 64, 200

    def __init__(self, path: str, limit: int = 48 << 20, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        leads = tuple(self.tokenizer.id_to_token(self._ids(c)[0]) for c in " \n")
        self.opens[[i for token, i in vocabulary.items() if token.startswith(leads)]] = True
        self.limit, self.size = limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct parts of texts without nulls, the parts of all texts by number, and how many each text has.

        Parts are written as ``raw`` reads them.
        """
        odd = pc.match_substring_regex(texts, self.ODD)
        plain = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x01", texts.type), plain, pa.scalar("", texts.type)), " ")
        coded = lists.flatten().dictionary_encode()
        names, flat, many = coded.dictionary.to_pylist(), coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        if pc.any(odd).as_py():
            known = {p: k for k, p in enumerate(names)}
            own = [[known.setdefault("\x01" + p, len(known)) for p in self.CUT.split(t)] for t in texts.filter(odd).to_pylist()]
            mask = odd.to_numpy(zero_copy_only=False)
            every = np.empty(len(texts), np.int64)
            every[~mask], every[mask] = many, [len(x) for x in own]
            mixed = np.empty(every.sum(), np.int64)
            at_odd = np.repeat(mask, every)
            mixed[~at_odd], mixed[at_odd] = flat, np.fromiter(chain.from_iterable(own), np.int64)
            names, flat, many = list(known), mixed, every
        return names, flat, many

    @staticmethod
    def raw(name: str) -> str:
        """The text of a part: one that opens with a line end and one that is marked stand for themselves, others lost their space."""
        return name[1:] if name[:1] == "\x01" else name if name[:1] == "\n" else " " + name

    def fresh(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct parts, by the tokenizer."""
        found = {}
        joint = [p for p in parts if p[:1] in (" ", "\n") and (rest := p[1:]) and rest.isprintable() and " " not in rest]
        for at in range(0, len(joint), 64):
            some = joint[at: at + 64]
            ids = np.asarray(self._ids("".join(some)), dtype="<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                raw, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for k, part in enumerate(some):
                    found[part] = raw[ends[k]: ends[k + 1]]
        for part in parts:
            if part not in found:
                found[part] = np.asarray(self._ids(part), dtype="<u4").tobytes()
        return found

    def lookup(self, needed: list[str]) -> list[bytes]:
        """The ids of distinct parts as ``split`` writes them; short ones are kept."""
        found = list(map(self.young.get, needed))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in missing:
            found[k] = self.old.get(needed[k])
            if found[k] is None:
                new.append(k)
        raw = [self.raw(needed[k]) for k in new]
        known = self.fresh(list(dict.fromkeys(raw)))
        for k, part in zip(new, raw):
            found[k] = known[part]
        kept = {needed[k]: found[k] for k in missing if len(needed[k]) <= self.LONGEST}
        added = sum(map(len, kept)) + sum(map(len, kept.values())) + self.ENTRY * len(kept)
        if self.size + added > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young |= kept
        self.size += added
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each text end."""
        parts, flat, many = self.split(texts)
        ids = self.lookup(parts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(ids), "<u4")
        own = sizes[flat]
        after = np.cumsum(own)
        places = np.arange(after[-1] if len(after) else 0) + np.repeat(starts[flat] - (after - own), own)
        return table[places], np.concatenate([[0], after])[np.cumsum(many)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``length`` tokens."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        code = encoder(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, ROWS)
                while part.num_rows > 1 and part.nbytes > BYTES:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                out = [[] for _ in range(5)]
                ids, ends = code.encode(pc.fill_null(part.column(1), ""))
                begin = 0
                for doc, stop in zip(part.column(0).to_pylist(), ends.tolist()):
                    own = memoryview(ids[begin:stop].tobytes() + end)
                    begin = stop
                    for number, (start, length) in enumerate(cuts(len(own) // 4, capacity)):
                        row = (doc, number, start, length, zlib.crc32(own[4 * start: 4 * (start + length)]))
                        for column, value in zip(out, row):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
        settle()

    return pieces


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the number of its sequence and its offset there."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.flatnonzero(counts).tolist()

    def take(size: int) -> None:
        counts[size] -= 1
        if not counts[size]:
            del sizes[bisect_right(sizes, size) - 1]

    def give(size: int) -> None:
        if not counts[size]:
            sizes.insert(bisect_right(sizes, size), size)
        counts[size] += 1

    bins = []
    while sizes:
        gap, own = capacity, []
        while (at := bisect_right(sizes, gap)) and gap:
            own.append(sizes[at - 1])
            gap -= own[-1]
            take(own[-1])
        while gap and sizes:
            room = gap + min(own)
            one = np.flatnonzero(counts[: room + 1])
            at = np.searchsorted(one, room - one, side="right") - 1
            at[(at >= 0) & (one[at] == one) & (counts[one] < 2)] -= 1
            both = np.where(at >= 0, one + one[at], 0)
            if not len(one) or (best := int(both.argmax()), both[best])[1] <= min(own):
                break
            a, b = int(one[best]), int(one[at[best]])
            smallest = min(own)
            own.remove(smallest)
            give(smallest)
            for size in (a, b):
                take(size)
                own.append(size)
            gap = room - a - b
        bins.append(own)
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = first[:-1].copy()
    for k, own in enumerate(bins):
        start = 0
        for size in own:
            piece = order[used[size]]
            used[size] += 1
            number[piece], offset[piece] = k, start
            start += size
    return number, offset


def _pack_block(capacity: int):
    def pack(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(name, "ascending") for name in ("doc_id", "piece", "ids_crc32")])
        number, offset = best_two_fit(pieces["length"].to_numpy(), capacity)
        sequence = pieces["block"].to_numpy().astype(np.int64) * 2**32 + number
        return pieces.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of ``docs``."""
    ship(docs.sparkSession)
    blocks = max(1, -(-docs.count() // block_docs))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id), schema)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack_block(capacity), f"{schema}, sequence_id long, offset long")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last one, so it returns the packed pieces."""
    return pack(docs)
