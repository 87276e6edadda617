"""N-gram Jaccard join by T-occurrence search (DivideSkip), as components of linked documents.

A document is the set of hashes of its distinct word shingles.  Equal sets form one class that is joined
once.  Two sets link when their Jaccard similarity is at least ``PERCENT`` per cent, that is when they share
at least ``T = ceil(PERCENT * (|x| + |y|) / (100 + PERCENT))`` shingles.

1. Filter.  In the order of hashes, linked sets share at least ``l`` of their first
   ``|x| - ceil(PERCENT |x| / 100) + l`` shingles, ``l`` being a tenth of the size.  Only these are shuffled; a
   set of which fewer than ``l`` recur elsewhere has no partner.  Shingles that recur within a task are
   sent once, so a passage that many documents hold does not pile up in one place.
2. Candidates.  Among the sets left, the rarest of those shingles tie sets into candidate groups.  A group is
   dealt to buckets by size band (linked sets lie in neighbouring bands) and hash, of bounded expected size.
3. Search.  Within a bucket an inverted index answers each query: its short lists are merged by a heap,
   members that could still reach ``T`` are probed for in its long lists by binary search.  Sets that
   are already in one component need no search against each other, so a bucket first queries its most
   central set and then those outside the largest component.  What lies in no group's largest component
   afterwards is searched against all the group's buckets of neighbouring bands.

All of this loses no link between components; which of several links joins two components does not matter.

Defined results: null or word-less text has an empty set and is its own component; a text of one to three
words is one shingle; rows with equal ids get a row each, whatever their texts; a null id links its text like any other
and is never the smallest of a component (null if all are); very long texts are hashed piece by piece; an empty table gives no rows.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import WORD, documents, runtime_filters, settle, ship, staged

PERCENT, WORDS = 85, 4
#: Expected sets of a bucket, expected queries of a chunk, and bytes of text hashed at once.
BUCKET, CHUNK, SLICE = 1500, 1500, 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_MIX = [_U(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the words in ASCII-lowered bytes."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _weights(len(data) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[data] * power[: len(data)])])
    return starts, _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[2])


def _words(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of every text; long texts are hashed piece by piece between words."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    part: list[int] = []

    def flush() -> None:
        if part:
            begin = np.cumsum([0, *(len(texts[i]) + 1 for i in part)])
            starts, hashes = _hash_words(np.frombuffer(b"\n".join([texts[i] for i in part]), np.uint8))
            cut = np.searchsorted(starts, begin)
            for i, a, b in zip(part, cut[:-1], cut[1:]):
                out[i] = hashes[a:b]
            part.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) > SLICE:
            pieces, at = [], 0
            while at < len(text):
                end = at + SLICE
                while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
                pieces.append(_hash_words(np.frombuffer(text[at:end], np.uint8))[1])
                at = end
            out[i] = np.concatenate(pieces)
            continue
        if size + len(text) > SLICE:
            flush()
            size = 0
        part.append(i)
        size += len(text) + 1
    flush()
    return out


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    out = []
    for words in _words([(t or "").encode("utf-8", "replace") for t in texts]):
        if not len(words):
            out.append(words)
            continue
        k = min(width, len(words))
        rows = len(words) - k + 1
        total = np.full(rows, k, np.uint64) * _MIX[4]
        for at in range(k):
            total = (total ^ words[at: at + rows]) * _MIX[3]
            total ^= total >> _U(29)
        out.append(np.unique(_mix(total)))
    return out


def identity(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    both = np.array([np.add.reduce(_mix(tokens)), np.bitwise_xor.reduce(tokens)], np.uint64)
    return int(_mix(both[:1] * _MIX[2] ^ _mix(both[1:] + _U(len(tokens)))).view(np.int64)[0])


def least(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a partner shares with a set of ``n``; also the size of the smallest partner."""
    return -(-percent * n // 100)


def shared_least(n: int) -> int:
    return 1 + n // 10


def zone(n: int, percent: int = PERCENT) -> int:
    """How many of the first shingles of a set of ``n`` are compared."""
    return min(n, n - least(n, percent) + shared_least(n))


def _least_col(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / 100).cast("int")


#: Marks of the rows that carry a shingle of several sets of a batch, and of documents (less their size).
_LOCAL, _DOC = 1 << 30, -2
#: Rows of a window over a sorted partition.
WINDOW = 400_000


def _digest(percent: int, width: int):
    """Rows ``(k, v, x, w)``: documents (row, set, id, -2 - size), set totals (set, set, null, 1 + shingles that recur in
    the batch), shingles seen in one set (hash, set, null, 0), and of those seen in several one witness (hash, 0, null, -1)
    and every pair (a hash of set and shingle, set, shingle, _LOCAL).  ``row`` names a row of the table, id and text."""
    def run(batches):
        for batch in batches:
            ids, texts, row = batch.columns
            sets: dict[int, np.ndarray] = {}
            names, sizes = [], []
            for at in range(0, batch.num_rows, 512):
                for tokens in shingle_sets(texts.slice(at, 512).to_pylist(), width):
                    names.append(identity(tokens) if len(tokens) else 0)
                    sizes.append(len(tokens))
                    if len(tokens):
                        sets.setdefault(names[-1], tokens[: zone(len(tokens), percent)].copy())
            out = [(row, pa.array(names, pa.int64()), ids, pa.array(_DOC - np.array(sizes, np.int64), pa.int64()))]
            if sets:
                owner = np.array(list(sets), np.int64)
                tokens = np.concatenate(list(sets.values())).view(np.int64)
                who = np.repeat(np.arange(len(owner)), [len(s) for s in sets.values()])
                order = np.argsort(tokens, kind="stable")
                tokens, who = tokens[order], who[order]
                first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                alone = first & np.concatenate([first[1:], [True]])
                again = np.bincount(who[~alone], minlength=len(owner))
                many = tokens[first & ~alone]
                sets_of, shared = owner[who[~alone]], tokens[~alone]
                pair = _mix(_mix(sets_of.view(np.uint64)) ^ shared.view(np.uint64)).view(np.int64)
                for k, v, x, w in ((owner, owner, None, again + 1), (tokens[alone], owner[who[alone]], None, np.zeros(alone.sum())),
                                   (many, np.zeros(len(many)), None, np.full(len(many), -1)), (pair, sets_of, shared, np.full(len(shared), _LOCAL))):
                    x = pa.nulls(len(k), pa.int64()) if x is None else pa.array(x)
                    out.append((pa.array(k), pa.array(v.astype(np.int64)), x, pa.array(w.astype(np.int64))))
            for k, v, x, w in out:
                yield pa.RecordBatch.from_arrays([k, v, x, w.cast(pa.int32())], names=["k", "v", "x", "w"])
        settle()

    return run


def _cut(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The whole groups of rows ``k, v, w, m`` that are sorted by ``k``, and what has to be carried on of the last group.

    A group that spreads over windows is carried on as far as it matters: the one set that holds its shingle, ``m``
    times, or a witness as soon as two do; the rows so far are then given with that witness.
    """
    k, v, w, m = columns
    at = int(np.searchsorted(k, k[-1]))
    whole, last = [c[:at] for c in columns], [c[at:] for c in columns]
    k, v, w, m = last
    if not (w == -1).any() and v.min() == v.max():
        return whole, [k[:1], v[:1], w[:1], m.sum(keepdims=True)]
    witness = [k[:1], np.zeros(1, np.int64), np.full(1, -1, w.dtype), np.ones(1, np.int64)]
    return [np.concatenate(c) for c in zip(whole, last, witness)], witness


def _shared(columns: list[np.ndarray]) -> list[tuple]:
    """Arguments of the rows about shingles that more than one set holds."""
    key, name, flag, times = columns
    if not len(key):
        return []
    witness = flag == -1
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    shared = np.logical_or.reduceat(witness, start) | (np.minimum.reduceat(name, start) != np.maximum.reduceat(name, start))
    own = np.repeat(shared, np.diff(np.append(start, len(key)))) & ~witness
    sids, at = np.unique(name[own], return_inverse=True)
    return [(2, key[own], name[own], np.zeros(own.sum())), (1, np.bincount(at, weights=times[own], minlength=len(sids)), sids, np.zeros(len(sids)))]


def _recurring(batches):
    """Rows ``(kind, a, sid, n, row)``: 0 documents (a is the id, n the size), 1 per set the shingles that recur (a) and how
    often it was counted (n), 2 a set's recurring shingle (a).  The partition is sorted by ``k`` and read in windows."""
    def rows_of(kind: int, a, sid, n, row=None):
        a, sid, n = (c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(np.int64)) for c in (a, sid, n))
        row = pa.nulls(len(a), pa.int64()) if row is None else row
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, sid, n, row], names=["kind", "a", "sid", "n", "row"])

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        k, v, w = (batch.column(i).to_numpy() for i in (0, 1, 3))
        if (docs := w <= _DOC).any():
            at = pa.array(np.flatnonzero(docs))
            yield rows_of(0, batch.column(2).take(at), v[docs], _DOC - w[docs].astype(np.int64), batch.column(0).take(at))
        if (totals := (w > 0) & (w < _LOCAL)).any():
            yield rows_of(1, w[totals] - 1, v[totals], np.ones(totals.sum()))
        if (local := w == _LOCAL).any():
            # Copies of a set send the same pair from every batch; they follow each other.
            name, token = v[local], batch.column(2).take(pa.array(np.flatnonzero(local))).to_numpy()
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (token[1:] != token[:-1])])
            yield rows_of(2, token[new], name[new], np.zeros(new.sum()))
        tokens = (w == 0) | (w == -1)
        held.append([k[tokens], v[tokens], w[tokens], np.ones(tokens.sum(), np.int64)])
        size += len(held[-1][0])
        if size >= WINDOW:
            window, rest = _cut([np.concatenate(c) for c in zip(*held)])
            held, size = [rest], 1
            for row in _shared(window):
                yield rows_of(*row)
    for row in _shared([np.concatenate(c) for c in zip(*held)]) if held else ():
        yield rows_of(*row)
    settle()


def _sets(width: int):
    """Adds the shingles of a set to its row ``(row, sid, text, n, ...)``, once; texts that share a row's name but not the set are left out.

    Rows of one name follow each other.
    """
    def run(batches):
        last, seen = None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                named = []
                for i, (row, sid, tokens) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2).to_pylist(), width))):
                    if row != last:
                        last, seen = row, set()
                    if sid not in seen and len(tokens) and identity(tokens) == sid:
                        seen.add(sid)
                        named.append((i, tokens))
                if named:
                    tokens = pa.array([s.view(np.int64) for _, s in named], pa.list_(pa.int64()))
                    kept = part.take(pa.array([i for i, _ in named]))
                    yield pa.RecordBatch.from_arrays([kept.column(1), tokens, *kept.columns[3:]], names=["sid", "tokens", *kept.schema.names[3:]])
        settle()

    return run


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes of ``edges(a, b)``: alternating stars move every node to its smallest neighbour, until none moves."""
    now, before = staged(edges.where("a <> b").distinct(), "edges"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = staged(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return nodes.union(nodes.select(F.col("label").alias("node"), "label")).distinct()


class Index:
    """Inverted lists over the sets of a bucket."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order].tolist()
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        ends = np.append(start[1:], len(tokens)).tolist()
        self.lists = {t: who[a:b] for t, a, b in zip(tokens[start].tolist(), start.tolist(), ends)}

    def search(self, query: np.ndarray, percent: int, skip) -> list[int]:
        """Members that link with ``query``, without those that ``skip`` tells to leave out."""
        lists = sorted((self.lists[t] for t in query.tolist() if t in self.lists), key=len)
        need = least(len(query), percent)
        if len(lists) < need:
            return []
        cut = len(lists) - (need - 1)
        short, long = lists[:cut], lists[cut:]
        found = []
        for member, hits in groupby(heapq.merge(*short)):
            if skip(member):
                continue
            size = self.sizes[member]
            reach = -(-percent * (len(query) + size) // (100 + percent))
            seen, left = sum(1 for _ in hits), len(long)
            for postings in reversed(long):
                if seen >= reach or seen + left < reach:
                    break
                at = bisect_left(postings, member)
                seen += at < len(postings) and postings[at] == member
                left -= 1
            if seen >= reach:
                found.append(member)
        return found


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    values = table[column].combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], table.schema.field(column).type)
    at, flat = values.offsets.to_numpy(), values.values.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _search_bucket(percent: int, among: bool):
    """Links between the bucket's sets and the queries and, if ``among``, between the bucket's own sets."""
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        sids, labels = members["sid"].to_pylist(), members["label"].to_pylist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        index = Index(_lists(members, "tokens"))
        links: list[tuple[int, int]] = []

        def ask(sid: int, label: int, tokens: np.ndarray) -> None:
            for member in index.search(tokens, percent, lambda m: root(labels[m]) == root(label)):
                if root(labels[member]) != root(label):
                    parent[root(labels[member])] = root(label)
                    links.append((sid, sids[member]))

        for sid, label, tokens in zip(queries["sid"].to_pylist(), queries["label"].to_pylist(), _lists(queries, "tokens")):
            ask(sid, label, tokens)
        if among and sids:
            own, central = _lists(members, "tokens"), members["central"].to_pylist()
            order = sorted(range(len(sids)), key=lambda i: (-central[i], sids[i]))
            ask(sids[order[0]], labels[order[0]], own[order[0]])
            largest = Counter(root(x) for x in labels).most_common(1)[0][0]
            for i in order[1:]:
                if root(labels[i]) != root(largest):
                    ask(sids[i], labels[i], own[i])
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def candidates(shared: DataFrame, percent: int, bucket: int) -> DataFrame:
    """``(sid, rep, n, grp, band, central, bucket)`` of the sets that may have a partner.

    ``shared(token, sid, n, rep)`` are the compared shingles that recur.  A set's rarest ones, as many as leave
    fewer than the least overlap, tie candidate groups; ``central`` tells how often its shingles recur.
    """
    often = shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    both = staged(shared.join(often, "token"), "recurring")
    own = Window.partitionBy("sid")
    ranked = both.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("all", F.count("*").over(own)).withColumn("central", F.sum("df").over(own))
    rare = staged(ranked.where(F.col("rank") <= F.col("all") - F.floor(_least_col(F.col("n"), percent) / 10)).select("token", "sid", "n", "rep", "central"), "rare")
    hub = rare.groupBy("token").agg(F.min("sid").alias("b"), F.count("*").alias("many")).where("many > 1")
    groups = components(rare.join(hub, "token").select(F.col("sid").alias("a"), "b")).select(F.col("node").alias("sid"), F.col("label").alias("grp"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1000.0 / (10 * percent - 1)))).cast("int")
    members = staged(rare.select("sid", "n", "rep", "central").distinct().join(groups, "sid"), "members")
    # A group that fits a bucket needs no bands.
    sizes = members.groupBy("grp").agg((F.count("*") > bucket).alias("wide"))
    members = members.join(sizes, "grp").withColumn("band", F.when(F.col("wide"), band).otherwise(0)).drop("wide")
    buckets = members.groupBy("grp", "band").agg(F.ceil(F.count("*") / F.lit(bucket)).cast("int").alias("buckets"))
    return members.join(buckets, ["grp", "band"]).withColumn("bucket", F.pmod("sid", F.col("buckets")).cast("int"))


def links(members: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: links that join the sets of ``members`` (candidates with their ``tokens``) to their components."""
    bands = staged(members.groupBy("grp", "band").agg(F.max("buckets").alias("buckets"), F.max_by("sid", F.struct("central", "sid")).alias("pivot")), "bands")
    dealt = members.drop("buckets")

    def near(rows: DataFrame) -> DataFrame:
        """Every row once for every bucket of its group's bands that are its own or next to it."""
        side = rows.drop("bucket").withColumn("to", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        there = bands.select("grp", F.col("band").alias("to"), "buckets")
        return side.join(there, ["grp", "to"]).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("band", "buckets").withColumnRenamed("to", "band")

    def search(index: DataFrame, asks: DataFrame, among: bool) -> DataFrame:
        key = ["grp", "band", "bucket", "chunk"]
        fresh = lambda rows, *names: rows.select(*[F.col(c).alias(f"{c}_").alias(c) for c in (*key, *names)]).groupBy(*key)
        return fresh(index, "sid", "label", "central", "tokens").cogroup(fresh(asks, "sid", "label", "tokens")).applyInArrow(_search_bucket(percent, among), "a long, b long")

    plain = lambda rows: rows.withColumn("label", F.col("sid")).withColumn("chunk", F.lit(0))
    pivots = dealt.join(bands.select("pivot"), F.col("sid") == F.col("pivot"), "left_semi")
    found = staged(search(plain(dealt), plain(near(pivots)), True), "links")
    label = components(found).select(F.col("node").alias("sid"), "label")
    labelled = members.select("sid", "grp", "band").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    labelled = staged(labelled, "labelled")
    split = bands.groupBy("grp").agg(F.sum("buckets").alias("cells")).where("cells > 1").select("grp")
    labelled = labelled.join(split, "grp", "left_semi")  # elsewhere all pairs have met
    top = labelled.groupBy("grp", "label").agg(F.count("*").alias("many")).groupBy("grp").agg(F.max_by("label", F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    rest = labelled.join(top, "grp").where("label <> top").select("sid", "label")
    chunks = labelled.join(top, "grp").groupBy("grp").agg(F.ceil(F.count_if(F.col("label") != F.col("top")) / F.lit(chunk)).cast("int").alias("chunks"))
    asks = near(dealt.join(rest, "sid")).join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    index = dealt.join(labelled.select("sid", "label"), "sid").join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return found.union(search(index, asks, False))


def row_name(id_col: str, text_col: str) -> Column:
    """A hash of id and text, never null."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS,
            bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, row, n, label, component_id)`` for every row of ``docs``; ``label`` names its component (null without words)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_name(id_col, text_col).alias("row"))
    spread = rows.mapInArrow(_digest(percent, width), "k long, v long, x long, w int").repartition("k").sortWithinPartitions("k")
    digest = staged(spread.mapInArrow(_recurring, "kind int, a long, sid long, n long, row long"), "digest")
    named = digest.where("kind = 0").select(F.col("a").alias("doc_id"), "sid", "n", "row")
    classes = staged(named.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row")), "classes")
    recur = digest.where("kind = 1").groupBy("sid").agg(F.sum("a").alias("recur"), F.sum("n").alias("times"))
    at_least = 1 + F.floor(_least_col(F.col("n"), percent) / 10)
    left = classes.join(recur, "sid").where(F.col("recur") >= at_least * F.col("times")).select("sid", "n", F.col("row").alias("rep"))
    pairs = digest.where("kind = 2").select(F.col("a").alias("token"), "sid").join(left, "sid").dropDuplicates(["token", "sid"])
    found = staged(candidates(pairs, percent, bucket), "found").where("n > 0")
    texts = rows.hint("merge").join(found, F.col("row") == F.col("rep")).select("row", "sid", "text", "n", "grp", "band", "central", "buckets", "bucket")
    with runtime_filters(docs.sparkSession):
        members = staged(texts.mapInArrow(_sets(width), "sid long, tokens array<bigint>, n long, grp long, band int, central long, buckets int, bucket int"), "sets")
    labels = staged(components(links(members, percent, chunk)).select(F.col("node").alias("sid"), "label"), "labels")
    least_doc = classes.join(labels, "sid").groupBy("label").agg(F.min("rep").alias("least"))
    known = labels.join(least_doc, "label").select("sid", "label", "least")
    by_class = classes.join(known, "sid", "left").select("sid", "n", F.coalesce("label", "sid").alias("label"), F.coalesce("least", "rep").alias("component_id"))
    return named.join(by_class, ["sid", "n"], "left").select("doc_id", "row", "n", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS,
                   bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``."""
    return grouped(docs, id_col, text_col, percent, width, bucket, chunk).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op6_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one document stays, the one with the smallest id.

    Where ids repeat, the smaller hash of id and text decides; where no document of a component has an id, one of
    them stays.  Rows that repeat id and text are copies: one stays, the first by its columns.  Null, empty and
    word-less texts are linked with nothing and all stay; an empty table stays empty.
    """
    rows = grouped(docs).where("n > 0").groupBy("label", "doc_id", "row").agg(F.count("*").alias("copies"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "copies")).alias("best"))
    best = staged(best.select(F.col("best.doc_id").alias("__kept_id"), F.col("best.row").alias("__kept_row"), "best.copies"), "kept")
    full = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    named = docs.where(full).withColumn("__row", row_name("doc_id", "text"))
    same = (F.col("__row") == F.col("__kept_row")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    kept = named.join(best, same, "left_semi")
    if not best.where("copies > 1").isEmpty():
        first = Window.partitionBy("__row", "doc_id").orderBy(*docs.columns)
        kept = kept.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return kept.select(*docs.columns).unionByName(docs.where(~full))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), sym AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r(node, reach) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.node, sym.y FROM r JOIN sym ON r.reach = sym.x
)
SELECT node AS doc_id, n AS n_shingles, min(reach) AS component_id FROM r JOIN n ON n.doc_id = node GROUP BY node, n
"""
