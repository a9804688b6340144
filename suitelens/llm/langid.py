"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes, letters lower-cased,
anything else ASCII a space), hashed into ``BUCKETS``; its language is a softmax over a
linear map of that mean. Both are trained together by stochastic gradient descent in
numpy, on snippets of many lengths from a sample of labelled documents. The sample is
bounded by parameters of ``fit`` and stratified by language.

A fifth of the sample is kept from training. On it a temperature is fitted, so that the
score is a probability, and two bounds below which a document is rejected: of the score, and of the share
of its 4-byte strings that the training texts had (gibberish or a language that was not learned may score high, as
the softmax has to choose; but it is made of other strings). Both are half of a low quantile of what the kept-back
documents have, so documents like those stay; of a short text some strings count as known in advance.

Prediction scans all documents, whole texts, without a shuffle; since the map is
linear, embeddings and softmax weights fold into one table of scores per n-gram.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected;
so is everything when there is nothing to learn from; a labelled text above the sample's bound gives
one snippet, chosen by a hash; texts shorter than an n-gram are
judged by the shorter ones, or by the languages' order; equal scores go to the first
language in order; an empty table gives an empty result; other columns are kept, those
named like the added ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suitelens.llm.common import prepare, stored, text_chunks

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
#: bounds of the training sample: documents of a language, of all, and bytes of a document
PER_LANGUAGE, DOCUMENTS, DOCUMENT_BYTES = 800, 4000, 20_000
#: the quantile of the kept-back documents' scores and known shares that bounds rest on; strings of each text known in advance
LOW_QUANTILE, KNOWN_BEFORE = 0.01, 6
KNOWN_BITS = 22
UNKNOWN = "und"
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def hashed(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of ``order`` bytes of cleaned text."""
    n = max(0, len(data) - order + 1)
    code = np.full(n, order, np.uint32)
    for k in range(order):
        code = (code << np.uint32(8)) ^ data[k:k + n] if k else data[:n].astype(np.uint32)
    return (code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(16)


def _string_place(data: np.ndarray) -> np.ndarray:
    """Place of each 4-byte string of cleaned text in the table of known ones."""
    n = max(0, len(data) - 3)
    code = np.zeros(n, np.uint32)
    for k in range(4):
        code = (code << np.uint32(8)) | data[k:k + n]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - KNOWN_BITS)


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    known: np.ndarray | None = None  # 4-byte strings of the training texts
    least_known: float = 0.0

    def logits(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each document ``data[begin:end]``."""
        clean = _CLEAN[data]
        total, count = np.zeros((len(begin), len(self.languages))), np.zeros(len(begin))
        for order in ORDERS:
            grams = hashed(clean, order)
            has = np.flatnonzero(end - begin >= order)
            if not len(has):
                continue
            edges = np.stack([begin[has], end[has] - order + 1], 1).ravel()  # n-grams across documents fall between
            for c in range(len(self.languages)):
                total[has, c] += np.add.reduceat(np.append(self.scores[:, c][grams], np.float32(0)), edges)[::2]
            count[has] += end[has] - begin[has] - order + 1
        return total / np.maximum(count, 1)[:, None] + self.bias

    def known_share(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each document the share of 4-byte strings that training texts had."""
        share = np.ones(len(begin))
        has = np.flatnonzero(end - begin >= 4)
        if self.known is None or not len(has):
            return share
        hit = np.append(self.known[_string_place(_CLEAN[data])], False)
        edges = np.stack([begin[has], end[has] - 3], 1).ravel()
        n = end[has] - begin[has] - 3
        share[has] = (np.add.reduceat(hit, edges, dtype=np.int64)[::2] + KNOWN_BEFORE) / (n + KNOWN_BEFORE)
        return share

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[bytes], labels: np.ndarray, languages: list[str], epochs: int = 10, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over snippets; see the module's text."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    clean = [_CLEAN[np.frombuffer(t, np.uint8)] for t in texts]
    steps = max(1, epochs * len(texts) // 64)
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(epochs)]) if texts else np.zeros(0, int)
    for step in range(steps):
        batch = order[step * 64:(step + 1) * 64]
        ids, target = [], []
        for d in batch.tolist():
            size = int(8 * 100 ** rng.random())
            a = int(rng.integers(0, max(1, len(clean[d]) - size + 1)))
            # the snippet's n-grams alone: those of all texts would be twelve times their bytes in the driver
            mine = np.concatenate([hashed(clean[d][a:a + size + o - 1], o) for o in ORDERS])
            if len(mine):
                ids.append(mine)
                target.append(labels[d])
        if not ids:
            continue
        n = np.array([len(i) for i in ids])
        flat, y = np.concatenate(ids), np.array(target)
        mean = np.add.reduceat(emb[flat], np.cumsum(n) - n) / n[:, None]
        z = mean @ weight + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        lr = rate * (1 - step / steps)
        back = (p @ weight.T) / n[:, None]
        weight -= lr * mean.T @ p / len(y) * 4
        bias -= lr * p.mean(0)
        by = np.argsort(flat, kind="stable")
        cut = np.flatnonzero(np.append(True, flat[by][1:] != flat[by][:-1]))
        emb[flat[by][cut]] -= lr * 8 * np.add.reduceat(np.repeat(back, n, 0)[by], cut)
    known = np.zeros(1 << KNOWN_BITS, bool)
    for c in clean:
        known[_string_place(c)] = True
    return Model(languages, (emb @ weight).astype(np.float32), bias, known=known)


def calibrate(model: Model, texts: list[bytes], labels: np.ndarray) -> Model:
    """Fit temperature and rejection bounds on documents that were not trained on."""
    if not texts:
        return model
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    model.least_known = float(np.quantile(model.known_share(data, end - size, end), LOW_QUANTILE)) / 2
    if len(model.languages) < 2:
        return model
    logits = model.logits(data, end - size, end)
    losses = {}
    for t in np.geomspace(0.001, 100, 101):
        model.temperature = float(t)
        losses[t] = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(labels)), labels], 1e-12)).mean()
    model.temperature = float(min(losses, key=losses.get))
    p = model.probabilities(logits)
    right = p.argmax(1) == labels
    if right.any():
        model.least = min(0.5, float(np.quantile(p.max(1)[right], LOW_QUANTILE)) / 2)
    return model


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", allowed: Column | None = None, per_language: int = PER_LANGUAGE,
        documents: int = DOCUMENTS, document_bytes: int = DOCUMENT_BYTES) -> Model:
    """Learn from a sample of the rows that ``allowed`` admits: at most ``documents`` texts
    (of a longer one a snippet of at most ``document_bytes`` bytes), at most ``per_language`` of each language, chosen by
    a hash of the text."""
    prepare(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if allowed is not None:
        rows = rows.filter(allowed)
    chars = document_bytes // 4  # at most four bytes each
    at = F.pmod(F.xxhash64(text, F.lit("snippet")), F.greatest(F.length(text) - chars, F.lit(1))).cast("int") + 1
    some = F.when(F.octet_length(text) <= document_bytes, F.col(text)).otherwise(F.substring(F.col(text), at, F.lit(chars)))
    rows = rows.select(F.col(lang).cast("string").alias("l"), some.alias("t"), F.xxhash64(text).alias("h"))
    # which texts: those of the least hashes. Only hashes below a threshold, about eight times as many as are wanted,
    # are ranked, so that a language with very many documents does not meet in one task
    size = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("c"))
    below = rows.select("l", "h").join(F.broadcast(size), "l") \
        .filter((F.col("h").cast("double") + 2.0**63) / 2.0**64 * F.col("c") <= 8 * per_language).select("l", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = below.withColumn("n", nth).filter(F.col("n") <= per_language).orderBy("n", "l").limit(documents)
    chosen = stored(chosen, "sample")
    sample = (rows.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h", "n").agg(F.first("t").alias("t"))
              .orderBy("n", "l").collect())
    languages = sorted({r["l"] for r in sample})
    number = {v: k for k, v in enumerate(languages)}
    spare = [r for r in sample if r["n"] % 5 == 0]
    used = [r for r in sample if r["n"] % 5]

    def parts(rs: list) -> tuple[list[bytes], np.ndarray]:
        return [r["t"].encode() for r in rs], np.array([number[r["l"]] for r in rs], np.int64)

    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    return calibrate(train(*parts(used), languages), *parts(spare))


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*[c for c in docs.columns if c not in ADDED or c == text])
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches, text):
            letters = chunk.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            if m.languages:
                p = m.probabilities(m.logits(chunk.data, chunk.begin, chunk.end))
                best = p.argmax(1)
                score = np.where(letters, p[np.arange(len(best)), best], 0.0)
                names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            else:
                score, names = np.zeros(len(chunk)), [UNKNOWN] * len(chunk)
            rejected = (np.array(names, object) == UNKNOWN) | (score < m.least) | (m.known_share(chunk.data, chunk.begin, chunk.end) < m.least_known)
            yield pa.RecordBatch.from_arrays([*chunk.rows.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(rejected.astype(bool))],
                                             names=schema.names)

    return docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
