import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from drawlake.llm import token_alignment as T
from drawlake.llm.common import staged
from drawlake.llm.packing import tokenizer_path

from .conftest import prose


def brute(rows):
    """The contract, document by document, over whole texts."""
    a = Tokenizer.from_file(tokenizer_path(T.A_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(T.B_MODEL))
    # The byte-level alphabet: printable characters stand for themselves, other bytes for 256 and on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(own)))}
    found = []
    for doc_id, text, *_ in rows:
        empty = (doc_id, 0, 0, 0, [], "")
        if not text:
            found.append(empty)
            continue
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        b_ids = b.encode(text)
        a_raw = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
        b_raw = [bytes([int(p[1:-1], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode() for i in b_ids]
        if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            found.append(empty)
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a_ids[i:x], b_ids[j:y]))
            i, j = x, y
        where = {e: k for k, e in enumerate(b_ends)}
        links = [(i, b_ids[where[e]]) for i, e in zip(a_ids, a_ends) if e in where]
        digest = sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        found.append((doc_id, len(a_ids), len(b_ids), len(groups), links, digest))
    count = Counter(pair for row in found for pair in row[4])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((d, n_a, n_b, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest)
                   for d, n_a, n_b, g, links, digest in found), key=str)


ODD = ["", None, " ", "  two  spaces ", "\n", "\nline\n", "a▁b", "▁", "tail ▁ word", "<|endoftext|> in a text", "<s>x</s> <0x0A>", "a\x00b", "tab\there", "é ﬁ ½", "日本 語", "🙂 🙂\n🙂",
       "one\r\ntwo", "\x1c x", "don't can't", "x" * 3000, "trailing \n", "a\n\nb\n c", "﻿bom", "word word"]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "some word"), (7, "some word"), (7, "some word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert collected(T.align_corpus(df)) == want
    assert collected(T.align_corpus(df, chunk_chars=40)) == want
    assert sum(r[1] == 0 for r in want) >= 5 and sum(r[4] > 0 for r in want) > 15


def test_corpus_against_brute_force(spark, docs, rows, empty):
    assert collected(T.align_corpus(docs, chunk_chars=3000)) == brute(rows)
    assert T.align_corpus(empty).collect() == []


def test_groups_equal_components_of_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        a, b = (np.unique(np.append(rng.integers(1, n, int(rng.integers(0, n))), n)) for _ in range(2))
        a_start, b_start = np.append(0, a[:-1]), np.append(0, b[:-1])
        found = T.coalesce(a_start, a, b_start, b)
        assert list(zip(found.pair_a, found.pair_b)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a_start[i] < b[j] and b_start[j] < a[i]]
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert found.a_group.tolist() == np.searchsorted(both, a).tolist() and found.b_group.tolist() == np.searchsorted(both, b).tolist()


def test_rows_of_megabytes_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    written = []

    def megabytes(*_):
        def rows(batches):
            for _ in batches:
                pass
            for k in range(48):
                own = {c: os.urandom(1 << 20) if c == "links" else b"" for c in ("sizes", "parts", "ends", "links")}
                yield pa.RecordBatch.from_pylist([{"chunk": k, "docs": [], "codes": [], "counts": []} | own], schema)

        doc = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in T._DOC.split(", ")])
        schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                            *((c, pa.binary()) for c in ("sizes", "parts", "ends", "links"))])
        return rows

    monkeypatch.setattr(T, "_chunks", megabytes)
    monkeypatch.setattr(T, "staged", lambda *a, **b: written.append(staged(*a, **b)) or written[-1])
    T.align_corpus(spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1))
    (file,) = [f.removeprefix("file:").replace("///", "/") for f in written[0].inputFiles()]
    found = pq.ParquetFile(file).metadata
    groups = [found.row_group(k) for k in range(found.num_row_groups)]
    assert found.num_rows == 48 and max(g.total_byte_size for g in groups) < 24 << 20


def test_kept_parts_are_bounded():
    paths = tokenizer_path(T.A_MODEL), tokenizer_path(T.B_MODEL)
    code, other = T.Aligner(*paths, limit=60_000), T.Aligner(*paths)
    rng, least = random.Random(4), []
    for _ in range(12):
        parts = list({w for w in prose(rng, "de", 150).split()} | {"x" * 99})
        found, want = code.lookup(parts), other.lookup(parts)
        assert found.texts == want.texts and all((getattr(found, n) == getattr(want, n)).all() for n in ("n_a", "n_b", "n_groups", "n_links", "right", "codes"))
        assert len(code.place) * code.ENTRY <= 60_000 + code.ENTRY * len(parts)
        least.append(len(code.place))
    assert any(b < a for a, b in zip(least, least[1:]))


def test_model_that_crosses_spaces_is_refused(monkeypatch):
    real = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b" if i == 500 else real(self, i))
    with pytest.raises(ValueError):
        T.Aligner(tokenizer_path(T.A_MODEL), tokenizer_path(T.B_MODEL))
