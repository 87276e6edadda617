"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole text.  Their responses are max-pooled over
overlapping chunks of ``4 * BLOCK`` bytes that start every ``2 * BLOCK`` bytes; the mean and the maximum
over the chunks feed one logistic unit.  A filter is a table by tap and byte value, so a response is a
sum of looked-up rows.

The network is fitted on the driver by Adam on a bounded sample: ``PER_CLASS`` labelled rows of either
label, chosen by hash among texts of at most ``FIT_CHARS`` characters.  Every text is scored whole.

Defined results: null text counts as empty and scores what the bias alone gives; without labels every
score is 0.5, with one label only that label; repeated rows are scored each; an empty table gives no
rows; a null doc_id is neither learned from nor held out.  Other columns are never read for a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, ship

#: Filters, bytes that a filter sees, and bytes of a pooling block.
FILTERS, WIDTH, BLOCK = 16, 5, 64
#: Rows of either label to fit on, their longest text, passes over them, rows to a step, and the step size.
PER_CLASS, FIT_CHARS, EPOCHS, STEP_ROWS, RATE = 1200, 20_000, 12, 32, 0.02
#: Bytes that are scored at once.
SLICE = 1 << 17
THRESHOLD = 0.3


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"taps": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "shift": np.zeros(FILTERS, np.float32),
                  "weight": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, each text followed by WIDTH - 1 zeros or more; first places of the blocks; blocks per text; places beyond a text."""
        length = np.array([len(t) for t in texts], np.int64)
        padded = np.maximum(length, 1) + WIDTH - 1
        data = np.zeros(int(padded.sum()), np.uint8)
        begin = np.concatenate([[0], np.cumsum(padded)[:-1]])
        for at, text in zip(begin, texts):
            data[at: at + len(text)] = np.frombuffer(text, np.uint8)
        blocks = np.maximum(1, -(-length // BLOCK))
        local = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        beyond = np.ones(len(data), bool)
        inside = np.repeat(begin, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
        beyond[inside] = False
        return data, np.repeat(begin, blocks) + local * BLOCK, blocks, beyond

    def responses(self, data: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        out = np.zeros((len(data), FILTERS), np.float32)
        tmp = np.empty((n, FILTERS), np.float32)
        for tap in range(WIDTH):
            np.take(self.p["taps"][tap], data[tap: tap + n], axis=0, out=tmp)
            out[:n] += tmp
        out += self.p["shift"]
        np.maximum(out, 0, out=out)
        out[beyond] = 0
        return out

    @staticmethod
    def chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First blocks of the chunks, chunks per text, and for each chunk whether its blocks 1 to 3 belong to it."""
        per = np.maximum(1, (blocks - 1) // 2)
        first = np.cumsum(blocks) - blocks
        local = 2 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        left = np.repeat(blocks, per) - local
        return np.repeat(first, per) + local, per, left[:, None] > np.arange(4)

    def pool(self, pooled: np.ndarray, blocks: np.ndarray) -> tuple:
        start, per, has = self.chunks(blocks)
        own = pooled[np.minimum(start[:, None] + np.arange(4), len(pooled) - 1)] * has[:, :, None]
        chunk = own.max(axis=1)
        at = np.cumsum(per) - per
        top = np.maximum.reduceat(chunk, at, axis=0)
        mean = np.add.reduceat(chunk, at, axis=0) / per[:, None]
        return np.concatenate([mean, top], axis=1), own, chunk, start, per

    def forward(self, texts: list[bytes]) -> np.ndarray:
        """Scores of the texts."""
        data, first, blocks, beyond = self.layout(texts)
        pooled = np.maximum.reduceat(self.responses(data, beyond), first, axis=0)
        features = self.pool(pooled, blocks)[0]
        return 1 / (1 + np.exp(-np.clip(features @ self.p["weight"] + self.p["bias"], -30, 30)))

    def long_text(self, text: bytes) -> float:
        """The score of a text of any length, of which only the pooled blocks are kept."""
        parts = []
        for at in range(0, len(text), SLICE):
            piece = text[at: at + SLICE + WIDTH - 1]
            data = np.concatenate([np.frombuffer(piece, np.uint8), np.zeros(WIDTH - 1, np.uint8)])
            beyond = np.arange(len(data)) >= min(SLICE, len(text) - at)
            parts.append(np.maximum.reduceat(self.responses(data, beyond), np.arange(0, min(SLICE, len(text) - at), BLOCK), axis=0))
        pooled = np.concatenate(parts)
        features = self.pool(pooled, np.array([len(pooled)]))[0]
        return float((1 / (1 + np.exp(-np.clip(features @ self.p["weight"] + self.p["bias"], -30, 30))))[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores in order, computed in slices of bounded size."""
        out, part, size = np.empty(len(texts)), [], 0
        for k, text in enumerate(texts):
            if len(text) > SLICE:
                out[k] = self.long_text(text)
                continue
            if part and size + len(text) > SLICE:
                out[part] = self.forward([texts[i] for i in part])
                part, size = [], 0
            part.append(k)
            size += len(text) + WIDTH
        if part:
            out[part] = self.forward([texts[i] for i in part])
        return out

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data, first, blocks, beyond = self.layout(texts)
        response = self.responses(data, beyond)
        pooled = np.maximum.reduceat(response, first, axis=0)
        features, own, chunk, start, per = self.pool(pooled, blocks)
        score = 1 / (1 + np.exp(-np.clip(features @ self.p["weight"] + self.p["bias"], -30, 30)))
        error = ((score - labels) / len(labels)).astype(np.float32)
        down = error[:, None] * self.p["weight"]
        of_text = np.repeat(np.arange(len(texts)), per)
        g_chunk = down[of_text, :FILTERS] / per[of_text, None]
        is_top = chunk == features[of_text, FILTERS:]
        # Chunks overlap, so the place of the maximum lies in several; together they count once.
        tops = np.add.reduceat(is_top.astype(np.float32), np.cumsum(per) - per, axis=0)
        g_chunk = g_chunk + np.where(is_top, (down[:, FILTERS:] / tops)[of_text], 0)
        g_block = np.zeros_like(pooled)
        block = start[:, None] + own.argmax(axis=1)
        filters = np.broadcast_to(np.arange(FILTERS), block.shape)
        np.add.at(g_block, (np.minimum(block, len(pooled) - 1), filters), np.where(chunk > 0, g_chunk, 0))
        b, f = np.nonzero(g_block)
        end = np.append(first[1:], len(data))
        place = np.array([first[x] + response[first[x]: min(end[x], first[x] + BLOCK), y].argmax() for x, y in zip(b, f)], np.int64)
        g = g_block[b, f]
        taps = np.zeros_like(self.p["taps"])
        for tap in range(WIDTH):
            np.add.at(taps, (tap, data[np.minimum(place + tap, len(data) - 1)], f), g)
        return {"taps": taps, "shift": np.bincount(f, weights=g, minlength=FILTERS), "weight": features.T @ error, "bias": np.array([error.sum()])}

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(texts) // STEP_ROWS)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), STEP_ROWS):
                own = order[at: at + STEP_ROWS]
                step += 1
                rate = RATE * (1 - 0.9 * step / steps)
                for k, g in self.gradients([texts[i] for i in own], labels[own]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    self.p[k] = (self.p[k] - move).astype(np.float32)
        return self


class Constant:
    """What is fitted when the sample does not hold both labels."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.score)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS) -> Network | Constant:
    """A network fitted on at most ``per_class`` rows of either label among those that ``learn`` selects."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    short = docs.where(learn & (F.length(F.coalesce(F.col(text_col), F.lit(""))) <= fit_chars)).select(F.col(id_col).alias("id"))
    known = marked.join(short, "id").select("id", "y", F.xxhash64("id").alias("h"))
    ids = known.where("y = 0").orderBy("h", "id").limit(per_class).unionByName(known.where("y = 1").orderBy("h", "id").limit(per_class)).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "id").select("h", "y", "text")
    rows = rows.where(F.length("text") <= fit_chars).orderBy("h", "text").limit(2 * per_class).toPandas()
    y = rows["y"].to_numpy(np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(0.5 if not len(y) else float(y[0]))
    return Network().fit([t.encode("utf-8", "replace") for t in rows["text"]], y)


def quality(text: Column, model: Broadcast) -> Column:
    """The probability that a text has label 1."""
    ship(SparkSession.active())

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.scores([b"" if t is None else t.encode("utf-8", "replace") for t in texts.to_pylist()]), pa.float64())

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable()))
    rows = docs.select("doc_id", held_out().alias("held_out"), quality(F.col("text"), model).alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
