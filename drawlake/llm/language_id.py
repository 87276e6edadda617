"""Language identification with spans of mixed-language text.

A word is scored under every learned language by the log probabilities of its letters' trigrams.  The
script of its first letter narrows the languages to those that use that script.  Viterbi over the
words, with a penalty for every switch, labels spans; the label with most letters names the document.

The model counts trigrams by language in Spark over a bounded sample of training documents
(``PER_LANGUAGE`` of each language, ``SAMPLE`` in all); only the table of ``BUCKETS`` counts per
language reaches the driver, and its logarithms are broadcast.

Defined results: null text and text without a letter are ``und`` with score 0, and so is every text if
nothing could be learned; texts of any length are scored whole; of labels or languages that tie the first by name
wins; repeated rows are labelled each and learned from once; an empty table gives no rows; a null doc_id
is neither learned from nor held out.  Columns other than the text are never read for a prediction.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import documents, ship

#: Training documents of one language, training documents in all, and hash buckets of trigrams.
PER_LANGUAGE, SAMPLE, BUCKETS = 1500, 60_000, 1 << 15
#: Cells over which the training documents of a language are chosen evenly.
CELLS = 50
#: Cost of a switch and of a script that a language does not use, in nats; a script is used from this share of letters.
SWITCH, FOREIGN, SCRIPT_SHARE = 14.0, 30.0, 0.01
UNKNOWN = "und"
#: Letters that are scored at once.
SLICE = 1 << 18
#: Least score of a document that the pipeline keeps.
KEEP_SCORE = 0.3

# First and last code points of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))), ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF))), ("armenian", ((0x530, 0x58F),)), ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))), ("devanagari", ((0x900, 0x97F),)), ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)), ("gujarati", ((0xA80, 0xAFF),)), ("tamil", ((0xB80, 0xBFF),)), ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)), ("malayalam", ((0xD00, 0xD7F),)), ("thai", ((0xE00, 0xE7F),)), ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))), ("kana", ((0x3040, 0x30FF),)), ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its kind (0 space, 1 other, 2 letter) and its script (0 for none of SCRIPTS)."""
    kind = np.fromiter((2 if (c := chr(i)).isalpha() else 0 if c.isspace() else 1 for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kind[0] = 0
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            script[first: last + 1] = number
    return kind, script


def _codes(text: str) -> np.ndarray:
    lower = text.lower()
    if len(lower) != len(text):  # places must be those of the text itself
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)


def _trigrams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters and the bucket of the trigram around each; ``code`` starts and ends with a space."""
    kind, _ = _tables()
    at = np.flatnonzero(kind[code] == 2)
    plain = np.where(kind[code] == 0, np.uint32(32), np.where(kind[code] == 1, np.uint32(46), code)).astype(np.uint32)
    mixed = plain[at - 1] * np.uint32(0x9E3779B1) ^ plain[at] * np.uint32(0x85EBCA77) ^ plain[at + 1] * np.uint32(0xC2B2AE3D)
    return at, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64) % BUCKETS


class Model:
    """Log probabilities by language and bucket, and the scripts that each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        smooth = counts + 0.3
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
        self.table = np.ascontiguousarray((table - table.mean(axis=0)).T.astype(np.float32)) if languages else table.T
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        uses = share >= SCRIPT_SHARE
        uses[:, ~uses.any(axis=0)] = True  # a script of no language excludes none
        self.foreign = np.where(uses, 0.0, -FOREIGN).T

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and letter counts of the words with a letter, and their scores by language."""
        kind, script = _tables()
        code = np.concatenate([[np.uint32(32)], _codes(text), [np.uint32(32)]]).astype(np.uint32)
        at, bucket = _trigrams(code)
        solid = kind[code] != 0
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
        own = high > low
        starts, ends, low, high = starts[own], ends[own], low[own], high[own]
        # A word's letters follow each other; the table is read for SLICE letters at a time.
        scores, first = np.empty((len(low), len(self.languages))), 0
        while first < len(low):
            stop = max(first + 1, int(np.searchsorted(low, low[first] + SLICE)))
            own = self.table[bucket[low[first]: high[stop - 1]]]
            scores[first:stop] = np.add.reduceat(own, low[first:stop] - low[first], axis=0, dtype=np.float64)
            first = stop
        scores += self.foreign[script[code[at[low]]]]
        return starts - 1, ends - 1, high - low, scores


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of the words."""
    best = scores[0].copy()
    back = np.empty(scores.shape, np.int32)
    own = np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        top = int(best.argmax())
        moved = best[top] - switch
        back[t] = np.where(best >= moved, own, top)
        best = np.maximum(best, moved) + scores[t]
    labels = np.empty(len(scores), np.int32)
    labels[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def label(scores: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels; one label throughout if no run of words gains more than half of what a switch costs.

    Runs in m other languages pay m - 1 switches at least, and one alone throughout gains nothing, so that is exact.
    """
    top = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [top]], axis=0)
    lowest = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - lowest).max() <= switch / 2:
        return np.full(len(scores), top, np.int32)
    return viterbi(scores, switch)


def predict(text: str | None, model: Model, switch: float = SWITCH) -> tuple[str, float, list[dict]]:
    """``(language, score, spans)`` of a text; spans are ``start, end, lang`` in code points."""
    if not text or not model.languages:
        return UNKNOWN, 0.0, []
    starts, ends, letters, scores = model.words(text)
    if not len(starts):
        return UNKNOWN, 0.0, []
    labels = label(scores, switch)
    by_label = np.bincount(labels, weights=letters, minlength=len(model.languages))
    top = int(by_label.argmax())
    own = scores[labels == top].sum(axis=0)
    sure = 1.0 / np.exp(np.minimum(own - own[top], 0)).sum() if own[top] >= own.max() else 1.0 / len(own)
    cut = np.flatnonzero(np.diff(labels)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]]) - 1
    spans = [{"start": int(starts[a]), "end": int(ends[b]), "lang": model.languages[labels[a]]} for a, b in zip(first, last)]
    return model.languages[top], float(by_label[top] / by_label.sum() * sure), spans


def _count(batches):
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    kind, script = _tables()
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts, letters = sums.setdefault(language, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
            code = np.concatenate([[np.uint32(32)], _codes(text), [np.uint32(32)]]).astype(np.uint32)
            at, bucket = _trigrams(code)
            counts += np.bincount(bucket, minlength=BUCKETS)
            letters += np.bincount(script[code[at]], minlength=len(letters))
    for language, (counts, letters) in sums.items():
        both = np.concatenate([counts, letters])
        used = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(used)), pa.array(used.astype(np.int32)), pa.array(both[used])], names=["lang", "slot", "n"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model from the rows that ``learn`` selects, by hash at most ``per_language`` of each language."""
    ship(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    ids = rows.select("id", "row", "lang", F.xxhash64("id").alias("h"))
    cells = max(1, min(CELLS, per_language))  # a language's rows are ranked in cells of their hash, not in one place
    own = Window.partitionBy("lang", F.pmod("h", F.lit(cells))).orderBy("h", "id", "row")
    ids = ids.withColumn("k", F.row_number().over(own)).where(F.col("k") <= per_language // cells)
    ids = ids.orderBy("k", "lang", "h").limit(sample).select("id", "row").distinct()
    chosen = rows.join(F.broadcast(ids), ["id", "row"]).dropDuplicates(["id", "row"]).select("lang", "text")
    cells = chosen.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cells["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS) + 1))
    for k, language in enumerate(languages):
        own = cells[cells["lang"] == language]
        counts[k, own["slot"].to_numpy()] = own["n"].to_numpy()
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])


def identify(text: Column, model: Broadcast, switch: float = SWITCH) -> Column:
    """struct(lang_pred, score, spans) of a text column."""
    ship(SparkSession.active())

    @F.arrow_udf("struct<lang_pred:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>")
    def run(texts: pa.Array) -> pa.Array:
        found = [predict(t.as_py(), model.value, switch) for t in texts]
        return pa.array([{"lang_pred": a, "score": b, "spans": c} for a, b, c in found], _RESULT)

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(fit(docs, learnable()))
    rows = docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), model).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", F.size("found.spans").alias("n_spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents in no learned language and those that no language leads.

    Null, empty and letterless texts are in no language and go; repeated rows and rows without an id stay or go by
    their text; an empty table stays empty.
    """
    model = spark.sparkContext.broadcast(fit(docs, learnable()))
    found = identify(F.col("text"), model)
    return docs.withColumn("__language", found).where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= KEEP_SCORE)).select(*docs.columns)
