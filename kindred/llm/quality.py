"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it (neighbours share
``WIDTH`` - 1 bytes, so every window of WIDTH bytes lies in one chunk).  Learned filters run
over the embedded bytes of a chunk and are max-pooled in it.  The pooled filters are combined
over the chunks by their mean and their maximum, and a logistic unit gives one probability.

The network is fitted on a sample of labelled rows: ``TRAIN_ROWS`` rows at most, chosen by a
hash of the id among those of ``TRAIN_BYTES`` bytes at most, half of each label where there are
enough.  The bounds hold for fitting only; every text is scored whole.

Null and empty texts are one chunk of padding and get a score like any other.  Labels, language,
source and id are no inputs.  Rows are independent; repeated rows repeat their score; without
usable labels of both kinds every score is 0.5; no rows give no rows; further columns pass
through (a column named like the new one is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, text_bytes

WIDTH, DEPTH, FILTERS, CHUNK = 8, 4, 16, 512
TRAIN_ROWS, TRAIN_BYTES = 1500, 16 * 1024
EPOCHS, BATCH, RATE, SEED = 16, 32, 0.02, 7
CROPS = 0.35
#: Positions multiplied at once.
STRIP = 1 << 17
PAD = 256


def chunks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the overlapping chunks of texts that stand one after the other."""
    step = CHUNK - WIDTH + 1
    count = np.maximum(1, -(-(lengths - WIDTH + 1) // step))
    owner = np.repeat(np.arange(len(lengths)), count)
    before = np.cumsum(count) - count
    start = (np.arange(len(owner)) - before[owner]) * step
    return owner, start, np.minimum(lengths[owner] - start, CHUNK)


def windows(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH pads after each text, first and end of each chunk's windows, and its text.

    A window lies in one chunk; only a text shorter than WIDTH has one that reaches into its pads.
    """
    n = len(lengths)
    padded = np.full(len(data) + n * WIDTH, PAD, np.int32)
    shift = np.repeat(np.arange(n) * WIDTH, lengths)
    padded[np.arange(len(data)) + shift] = data
    base = np.cumsum(lengths) - lengths + np.arange(n) * WIDTH
    owner, start, length = chunks(lengths)
    first = base[owner] + start
    return padded, first, first + np.maximum(1, length - WIDTH + 1), owner


def responses(model: dict, padded: np.ndarray) -> np.ndarray:
    """Filter responses at every position but the last WIDTH - 1: one matrix product per strip.

    Embedding and filter weights are multiplied out beforehand to one row per byte value and
    offset, so the product runs over the embedded window of a position.
    """
    vectors = model["embed"][padded]
    view = np.lib.stride_tricks.sliding_window_view(vectors.reshape(-1), WIDTH * DEPTH)[::DEPTH]
    return view @ model["filters"] + model["bias"]


def pooled(model: dict, data: np.ndarray, lengths: np.ndarray, where: bool = False):
    """Mean and maximum over the chunks of the max-pooled filters, per text."""
    padded, first, ends, owner = windows(data, lengths)
    n = len(lengths)
    tops = np.empty((len(first), FILTERS), np.float32)
    ats = np.empty((len(first), FILTERS), np.int64) if where else None
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + STRIP, "right")))
        part = responses(model, padded[first[lo] : ends[hi - 1] + WIDTH - 1])
        own, upto = first[lo:hi] - first[lo], ends[lo:hi] - first[lo]
        edges = np.c_[own, upto].reshape(-1)[:-1]  # spans of windows, and the gaps between them
        tops[lo:hi] = np.maximum.reduceat(part, edges, axis=0)[::2]
        if where:
            for c, (a, b) in enumerate(zip(own, upto, strict=True), lo):
                ats[c] = part[a:b].argmax(axis=0) + a + first[lo]
        lo = hi
    hidden = np.maximum(tops, 0)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else np.empty(0, np.int64)
    share = np.bincount(owner, minlength=n).astype(np.float32)
    mean = np.add.reduceat(hidden, begin, axis=0) / share[:, None]
    most = np.maximum.reduceat(hidden, begin, axis=0)
    return (mean, most) if not where else (mean, most, hidden, ats, owner, share, padded)


def probabilities(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for lo, hi in blocks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        mean, most = pooled(model, part, np.diff(offsets[lo : hi + 1]))
        logit = mean @ model["mean"] + most @ model["most"] + model["level"]
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def cropped(text: bytes, rng: np.random.Generator) -> bytes:
    """A text, or for CROPS of them a random span of it: short texts are rare among the labels."""
    if rng.random() >= CROPS or len(text) < 40:
        return text
    size = int(rng.integers(24, 25 + min(len(text) - 24, 400)))
    at = int(rng.integers(0, len(text) - size + 1))
    return text[at : at + size]


def fit(texts: list[bytes], labels: np.ndarray) -> dict | None:
    """Train the network by Adam on whole texts; None unless both labels occur."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    model = {
        "embed": rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "mean": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "most": np.zeros(FILTERS, np.float32),
        "level": np.zeros(1, np.float32),
    }
    model["embed"][PAD] = 0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weight = (weight * len(labels)).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            parts = [cropped(texts[i], rng) for i in some]
            data = np.frombuffer(b"".join(parts), np.uint8)
            lengths = np.array([len(x) for x in parts])
            mean, most, hidden, ats, owner, share, padded = pooled(model, data, lengths, where=True)
            p = 1 / (1 + np.exp(-np.clip(mean @ model["mean"] + most @ model["most"] + model["level"], -30, 30)))
            err = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            top = (hidden == most[owner]) & (hidden > 0)
            back = err[owner, None] * (model["mean"] / share[owner, None] + top * model["most"])
            back = (back * (hidden > 0)).astype(np.float32)
            grads = {
                "mean": err @ mean + 1e-4 * model["mean"],
                "most": err @ most + 1e-4 * model["most"],
                "level": np.array([err.sum()], np.float32),
                "bias": back.sum(axis=0),
                "filters": np.zeros_like(model["filters"]),
                "embed": np.zeros_like(model["embed"]),
            }
            for f in range(FILTERS):
                rows = padded[ats[:, f, None] + np.arange(WIDTH)]
                grads["filters"][:, f] = back[:, f] @ model["embed"][rows].reshape(len(rows), -1)
                shaped = model["filters"][:, f].reshape(WIDTH, DEPTH)
                for j in range(WIDTH):
                    np.add.at(grads["embed"], rows[:, j], back[:, f, None] * shaped[j])
            grads["embed"][PAD] = 0
            step += 1
            for k, g in grads.items():
                one, two = moment[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                model[k] -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text: str = "text") -> dict | None:
    """Fit on a bounded sample of the labelled documents for which ``usable`` (of doc_id) holds."""
    known = (
        labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .filter("low = high")
        .select("doc_id", F.col("low").alias("label"))
    )
    order = F.xxhash64("doc_id", F.lit(SEED))
    # Ids first: only the chosen rows' texts are looked up.  Longer texts are left out afterwards.
    chosen = [
        r["doc_id"]
        for side in (0, 1)
        for r in known.filter(F.col("label") == side).orderBy(order, "doc_id").limit(TRAIN_ROWS // 2).collect()
    ]
    if not chosen:
        return None
    picked = docs.filter(F.col("doc_id").isin(chosen) & (F.octet_length(text) <= TRAIN_BYTES))
    rows = (
        picked.select("doc_id", F.encode(text, "UTF-8").alias("t"))
        .join(known, "doc_id")
        .groupBy("doc_id", "t")
        .agg(F.max("label").alias("label"))
        .orderBy(order, "doc_id", "t")
        .limit(TRAIN_ROWS)
        .collect()
    )
    return fit([bytes(r["t"]) for r in rows], np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: dict | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is of high quality."""
    small_batches(docs.sparkSession)

    def score_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if model is None:
                yield pa.array(np.full(len(batch), 0.5))
            else:
                yield pa.array(probabilities(model, *text_bytes(batch)))

    return docs.withColumn(out, F.arrow_udf(score_texts, "double")(text))


def remainder() -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; rows of remainder 1 are held out from fitting (a null id is not held out)."""
    model = train(docs, labels, remainder() != 1)
    held = F.coalesce(remainder() == 1, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
