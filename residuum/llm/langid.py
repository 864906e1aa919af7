"""Language identification: a bidirectional gated recurrent network over bytes.

A text is cut into windows; a network reads each from both ends and labels every byte with a
distribution over the learned languages; their mean over all bytes of the text is the document's. The
weights are trained in numpy by backpropagation through time on windows of a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from residuum.llm import gru
from residuum.session import stage

WINDOW, SIZE = 64, 8
#: Bounds of the sample: different texts per language (lowest hashes), windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
BATCH, EPOCHS, RATE = 128, 8, 0.02
#: Windows that are scored together.
TOGETHER = 4096
#: Letters and some numbers, such as superscripts; ``has_letter`` tells them apart.
WORD_CHARACTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text))


def sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """(lang, windows as strings) of the sample; only rows with a letter and a lang, copies of a text once."""
    place = lambda k: F.pmod(F.xxhash64("text", k), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.substring("text", place(k), F.lit(WINDOW)))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    # Hashes alone are made distinct and ranked, so that no copies take places; a rank filter keeps that many per task and language.
    ranked = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE_DOCS)
    chosen = rows.join(stage(ranked.drop("k")), ["lang", "h"]).groupBy("lang", "h").agg(F.min(cut).alias("cut"))
    return [(r["lang"], r["cut"]) for r in chosen.orderBy("lang", "h").collect()]


def _hidden(p: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
    """States of both directions, (steps, batch, size) each, in text order."""
    start = np.zeros((codes.shape[1], p["u_f"].shape[0]), np.float32)
    f = gru.forward(p["t_f"][codes], p["u_f"], start, keep)
    b = gru.forward(p["t_b"][codes[::-1]], p["u_b"], start, keep)
    return f, b


def train(rows: list[tuple[str, list[str]]]) -> dict:
    """A model: ``languages`` and ``params``; no rows give no languages."""
    languages = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(3)
    p = {"t_f": gru.glorot(rng, 256, 3 * SIZE), "t_b": gru.glorot(rng, 256, 3 * SIZE), "u_f": gru.glorot(rng, SIZE, 3 * SIZE),
         "u_b": gru.glorot(rng, SIZE, 3 * SIZE), "w": gru.glorot(rng, 2 * SIZE, max(1, len(languages))), "c": np.zeros(max(1, len(languages)), np.float32)}
    if not rows:
        return {"languages": [], "params": p}
    pieces = [(np.frombuffer(w.encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0"), np.uint8), languages.index(lang)) for lang, cut in rows for w in cut]
    codes, want = np.array([c for c, _ in pieces]), np.array([y for _, y in pieces])
    # Languages with few rows count as much as the others.
    weight = (len(want) / len(languages) / np.bincount(want, minlength=len(languages))).astype(np.float32)
    adam = gru.Adam(p, RATE)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            x, y = codes[chosen].T, want[chosen]
            (f, f_memory), (b, b_memory) = _hidden(p, x, True)
            both = np.concatenate([f, b[::-1]], axis=2).reshape(-1, 2 * SIZE)
            d = gru.softmax(both @ p["w"] + p["c"])
            d.reshape(WINDOW, len(y), -1)[:, np.arange(len(y)), y] -= 1
            real = (x != 0).reshape(-1, 1) * np.tile(weight[y], WINDOW)[:, None]
            d *= real / max(1, len(x.ravel()))
            d_both = (d @ p["w"].T).reshape(WINDOW, len(y), -1)
            dx_f, du_f = gru.backward(d_both[:, :, :SIZE], p["u_f"], f_memory)
            dx_b, du_b = gru.backward(d_both[::-1, :, SIZE:], p["u_b"], b_memory)
            adam.update({"w": both.T @ d, "c": d.sum(axis=0), "u_f": du_f, "u_b": du_b,
                         "t_f": gru.table_grad(x, dx_f, 256), "t_b": gru.table_grad(x[::-1], dx_b, 256)})
    return {"languages": languages, "params": p}


def position_labels(model: dict, codes: np.ndarray) -> np.ndarray:
    """Probabilities of each language at each byte of windows (batch, WINDOW): (batch, WINDOW, languages)."""
    p = model["params"]
    f, b = _hidden(p, codes.T)
    logits = (np.concatenate([f, b[::-1]], axis=2).reshape(-1, f.shape[2] * 2) @ p["w"]) + p["c"]
    return gru.softmax(logits).reshape(codes.shape[1], codes.shape[0], -1).transpose(1, 0, 2)


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text over all its bytes; every text has at least one."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    sizes = np.array([len(t) for t in texts])
    padded = np.frombuffer(b"".join([t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)]), np.uint8).reshape(-1, WINDOW)
    filled = np.full(len(padded), WINDOW)
    filled[np.cumsum(counts) - 1] = sizes - (counts - 1) * WINDOW
    sums = np.empty((len(padded), len(model["languages"])))
    for at in range(0, len(padded), TOGETHER):
        labels = position_labels(model, padded[at:at + TOGETHER])
        labels *= (np.arange(WINDOW)[None, :] < filled[at:at + TOGETHER, None])[:, :, None]
        sums[at:at + TOGETHER] = labels.sum(axis=1)
    return np.add.reduceat(sums, np.cumsum(counts) - counts, axis=0) / sizes[:, None]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out: only others with a doc_id, text and lang are
    learned from. Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
    could be learned. Repeated rows are labelled alike; an empty table gives no rows; further columns are ignored.
    """
    if model is None:
        model = train(sample(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("text", "lang")))
    names = model["languages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(2).to_pylist()
                real = [i for i, t in enumerate(texts) if t and names and has_letter(t)]
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if real:
                    found = pooled(model, [texts[i].encode("utf-8", "replace") for i in real])
                    for i, row in zip(real, found):
                        labels[i], scores[i] = names[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
