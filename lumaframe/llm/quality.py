"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded and read by learned filters over overlapping chunks of 16 bytes, 8 apart, from the first
byte to the last. Each filter's activations are max-pooled over sections of 64 chunks and over the whole document; the
overall maxima and the mean of the sections' maxima are combined into one probability. It is trained here, on a sample of
labelled rows whose size is a parameter, in mini-batches with Adam; the gradient flows through the maxima alone.

A null text is read as an empty one. Empty texts get the score of a blank chunk. Equal texts get equal scores, so repeated rows
do. Texts of any length are read whole, in pieces. With labels of one kind only (or none) every score is that label (or 0.5). A
doc_id with both labels counts as 1; a null doc_id has no label. Null texts aren't trained on. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.langid import fold
from lumaframe.llm.words import tidy
from lumaframe.session import ship_code

STEP, WIDTH, FILTERS, SECTION = 8, 8, 24, 64
#: Labelled rows of each label that are read for training at most, and bytes of all of them at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 24_000_000
#: Bytes that are scored at once.
BATCH_BYTES = 1 << 20


@dataclass
class Network:
    embedding: np.ndarray  # 257 x WIDTH, the last row for what lies past the end
    first: np.ndarray  # STEP * WIDTH x FILTERS, for a chunk's first half
    second: np.ndarray
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    shift: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.first, self.second, self.bias, self.weights, self.shift]


def fresh(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(draw(0.5, 257, WIDTH), draw(0.15, STEP * WIDTH, FILTERS), draw(0.15, STEP * WIDTH, FILTERS), np.zeros(FILTERS, np.float32), draw(0.1, 2 * FILTERS), np.zeros(1, np.float32))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in blocks of STEP (256: past the end), the first chunk of each text, the first chunk of each section.

    A text of n blocks has n chunks, the last one half past the end; an empty text has one.
    """
    blocks = np.array([len(t) // STEP + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks + 1)[:-1]])
    flat = np.full(int((blocks + 1).sum()) * STEP, 256, np.int16)
    for t, a in zip(texts, starts.tolist(), strict=True):
        flat[a * STEP : a * STEP + len(t)] = np.frombuffer(t, np.uint8)
    return flat, starts, blocks


def forward(net: Network, texts: list[bytes]):
    flat, starts, blocks = lay_out(texts)
    x = net.embedding[flat].reshape(-1, STEP * WIDTH)
    act = x[:-1] @ net.first
    act += x[1:] @ net.second
    act += net.bias
    np.maximum(act, 0, out=act)
    sections = [np.arange(a, a + n, SECTION) for a, n in zip(starts.tolist(), blocks.tolist(), strict=True)]
    per = np.array([len(s) for s in sections])
    edges = np.concatenate(sections)
    act[(starts + blocks)[:-1]] = 0  # the chunk between two texts
    pooled = np.maximum.reduceat(act, edges, axis=0)
    at = np.concatenate([[0], np.cumsum(per)[:-1]])
    most = np.maximum.reduceat(pooled, at, axis=0)
    mean = np.add.reduceat(pooled, at, axis=0) / per[:, None].astype(np.float32)
    features = np.concatenate([most, mean], axis=1)
    score = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.shift[0], -30, 30)))
    return score, (flat, x, act, edges, pooled, per, at, features)


def backward(net: Network, kept, error: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss; error: its derivative by each logit."""
    flat, x, act, edges, pooled, per, at, features = kept
    out = features.T @ error, np.array([error.sum()], np.float32)
    by_most, by_mean = error[:, None] * net.weights[:FILTERS], error[:, None] * net.weights[FILTERS:] / per[:, None]
    owner = np.repeat(np.arange(len(per)), per)
    share = by_mean[owner]
    best = np.zeros_like(pooled, bool)
    ends = np.append(at[1:], len(pooled))
    for d, (a, b) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
        best[a + pooled[a:b].argmax(axis=0), np.arange(FILTERS)] = True
    share = share + best * by_most[owner]
    share[pooled <= 0] = 0
    stops = np.append(edges[1:], len(act))
    where = np.stack([a + act[a:b].argmax(axis=0) for a, b in zip(edges.tolist(), np.minimum(edges + SECTION, stops).tolist(), strict=True)])
    g_first, g_second, g_embedding = np.zeros_like(net.first), np.zeros_like(net.second), np.zeros_like(net.embedding)
    for f in range(FILTERS):
        rows, g = where[:, f], share[:, f]
        on = g != 0
        rows, g = rows[on], g[on].astype(np.float32)
        g_first[:, f], g_second[:, f] = g @ x[rows], g @ x[rows + 1]
        for half, weight in ((rows, net.first[:, f]), (rows + 1, net.second[:, f])):
            ids = flat.reshape(-1, STEP)[half]
            np.add.at(g_embedding, ids, g[:, None, None] * weight.reshape(STEP, WIDTH))
    return [g_embedding, g_first, g_second, share.sum(axis=0).astype(np.float32), out[0].astype(np.float32), out[1]]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Both labels weigh the same, whatever their numbers."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        net.shift[0] = 0 if not len(labels) else 30 if labels[0] == 1 else -30
        return net
    first, second, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            score, kept = forward(net, [texts[i] for i in rows])
            grads = backward(net, kept, ((score - labels[rows]) * weight[rows] / len(rows)).astype(np.float32))
            t += 1
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * 0.6**epoch) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def sample(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Texts and labels to train on, from labelled (doc_id, text, quality); each text once for each doc_id.

    Of each label, sample_rows at most, those with the smallest hash of doc_id, then the smallest doc_id and hash of the text. A
    label's rows have half of sample_bytes; a text that doesn't fit in what is left is passed over. If no text of a label fits,
    the beginning of one stands for it. The choice is made from ids, hashes and sizes; only the chosen texts are moved.
    """
    spark, most = labelled.sparkSession, sample_bytes // 2
    labelled = _measured(labelled).where(F.col("text").isNotNull())
    known = labelled.groupBy("doc_id", "_lf_th", "quality").agg(F.max("_lf_bytes").alias("bytes"))
    known = known.withColumn("h", F.xxhash64("doc_id")).withColumn("fits", F.col("bytes") <= most)
    best = Window.partitionBy("quality", "fits").orderBy("h", "doc_id", "_lf_th")
    # At most sample_rows ids for each label and for whether the text fits reach the driver.
    ranked = known.withColumn("r", F.row_number().over(best)).where(F.col("r") <= sample_rows).orderBy("quality", "r").collect()
    chosen = []
    for label in (0, 1):
        size, before = 0, len(chosen)
        for r in (r for r in ranked if r["quality"] == label and r["fits"]):
            if size + r["bytes"] <= most:
                size += r["bytes"]
                chosen.append((r["doc_id"], r["_lf_th"], label))
        if len(chosen) == before:
            chosen += [(r["doc_id"], r["_lf_th"], label) for r in ranked if r["quality"] == label and not r["fits"]][:1]
    key = labelled.schema["doc_id"].dataType.simpleString()
    ids = spark.createDataFrame([c[:2] for c in chosen], f"doc_id {key}, _lf_th long")
    texts = labelled.join(F.broadcast(ids), ["doc_id", "_lf_th"], "left_semi").select("doc_id", "_lf_th", F.substring("text", 1, most).alias("text"))
    found = {(r["doc_id"], r["_lf_th"]): r["text"] for r in texts.groupBy("doc_id", "_lf_th").agg(F.first("text").alias("text")).collect()}
    return [(found[doc, th].encode("utf-8", "surrogatepass")[:most], label) for doc, th, label in chosen]


def _measured(docs: DataFrame) -> DataFrame:
    """docs with hash and size of the text; if they are there before a join, a plan that needs no more doesn't move the text."""
    return docs if "_lf_th" in docs.columns else docs.withColumns({"_lf_th": F.xxhash64("text"), "_lf_bytes": F.octet_length("text")})


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> Network:
    """Train on a sample() of labelled (doc_id, text, quality)."""
    rows = sample(labelled, sample_rows, sample_bytes)
    return train([text for text, _ in rows], np.array([label for _, label in rows], np.int64), seed=seed)


def score_quality(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs with one more column, the score of its text; docs must have no column of that name."""
    ship_code(docs.sparkSession)
    names, at = [f.name for f in docs.schema], docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            found, a = np.empty(len(texts)), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_BYTES):
                    size += len(texts[b])
                    b += 1
                found[a:b] = score_texts(net, texts[a:b])
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(score), f"{fields}, `{column}` double")


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """The scores of texts; one longer than BATCH_BYTES is read in runs of whole sections, so memory stays bounded."""
    if len(texts) != 1 or len(texts[0]) <= BATCH_BYTES:
        return forward(net, texts)[0].astype(np.float64)
    text, run, most, total, n = texts[0], BATCH_BYTES // (STEP * SECTION) * STEP * SECTION, np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
    for a in range(0, len(text) + 1, run):
        piece = text[a : a + run + STEP]
        pooled = forward(net, [piece])[1][4]
        pooled = pooled[: run // (STEP * SECTION)] if len(piece) > run else pooled
        most, total, n = np.maximum(most, pooled.max(axis=0)), total + pooled.sum(axis=0, dtype=np.float64), n + len(pooled)
    features = np.concatenate([most, (total / n).astype(np.float32)])
    return np.array([1 / (1 + np.exp(-np.clip(features @ net.weights + net.shift[0], -30, 30)))], np.float64)


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, text, quality of the labelled rows outside the held-out fold, with hash and size of the text."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return _measured(docs.select("doc_id", "text")).where(fold(folds) != held_out).join(known, "doc_id")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    net = fit(labelled_rows(docs, labels, folds, held_out))
    scored = score_quality(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (fold(folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
