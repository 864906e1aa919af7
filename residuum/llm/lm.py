"""Language-model scoring: counts over the whole training corpus and a gated recurrent network on top.

Words of all training documents are counted. The most frequent ``WORDS`` are symbols of the network, any
other word is one symbol, the rare word. The output is factored: a softmax over classes (frequency bins
of words, and the rare word), then one over the words of the class. A rare word is finally drawn by its
count among rare words. The network is trained in numpy by backpropagation truncated to windows, states
carried from window to window; scoring carries them through the whole document in the same way. Texts are cut
once, into a written table of symbols that training and scoring read. Training runs in rounds, each over its
share of all training rows. Rows are dealt to rounds and shards by the hash of id and text, and shards are counted
by tokens, so that the model does not depend on how the table is laid out: each shard goes on from the same
parameters with its own rows, then they are averaged by tokens; only they and the counts of the known words come
to the driver.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residuum.llm import gru
from residuum.session import stage

#: What ends every text; a blank is in no word.
END = " "
#: Symbols of the network, classes they are binned into, size of the state.
WORDS, CLASSES, SIZE = 1536, 24, 16
#: Words whose counts every worker holds; any other word meets its count in a join.
HELD = 60_000
#: Streams of a window at most, steps of a window, rate of the first round, tokens that are learned together.
STREAMS, STEPS, RATE, CHUNK = 256, 24, 0.01, 160_000
#: Rounds, each over its share of the rows, and how often they go over all rows.
ROUNDS, PASSES = 4, 1
#: Tokens of a shard in a round, about, and pieces in which parameters are averaged.
SHARD_TOKENS, PIECES = 500_000, 16
#: Tasks of a round at most; beyond that a task learns several shards, one after the other.
TASKS = 16_384
#: Tokens that a worker scores together, steps of a scoring window, rows whose outputs are computed together.
TOGETHER, WINDOW, ROWS = 1_500_000, 32, 65_536
#: Different words that a task counts together.
COUNTED = 200_000
#: Logits of at most this size need no shift before ``exp`` in single precision.
SAFE = 60
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str | None) -> list[str]:
    """Words with A-Z lower-cased, then the end."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    return [w.decode() for w in found] + [END]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _cut(text: pa.Scalar) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased, then the end; null is empty."""
    found = (text.as_py() or b"").translate(_LOWER).split()
    found.append(END.encode())
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows, the end counted once a row; a task counts at most about ``COUNTED`` words before it sends them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                met.update(_cut(text))
                if len(met) >= COUNTED:
                    yield _counted(met)
                    met = Counter()
        if met:
            yield _counted(met)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(met: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(met), pa.binary()).cast(pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "c"])


class Model:
    """Symbols 0 .. n - 1 are the known words in order of their classes; symbol n is the rare word, a class of its own."""

    def __init__(self, known: list[tuple[str, int]], rare: int = 0):
        """``known`` with their counts, and the count of all rare words, from which the biases begin."""
        self.symbols = {w: i for i, (w, _) in enumerate(known)}
        self.n = n = len(known)
        # Bins of equal share of the tokens, at most CLASSES of them; known is ordered by count.
        share = np.cumsum([c for _, c in known]) / max(1, sum(c for _, c in known)) if known else np.empty(0)
        bins = np.minimum((share * CLASSES).astype(int), CLASSES - 1)
        _, starts = np.unique(bins, return_index=True)
        self.starts = np.append(starts, [n, n + 1]).astype(int)  # bounds of the classes, the last one is the rare word
        self.classes = len(self.starts) - 1
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.starts))
        rng = np.random.default_rng(10)
        self.p = {"table": gru.glorot(rng, n + 1, 3 * SIZE), "u": gru.glorot(rng, SIZE, 3 * SIZE), "wc": gru.glorot(rng, SIZE, self.classes),
                  "bc": np.zeros(self.classes, np.float32), "ww": gru.glorot(rng, SIZE, n + 1), "bw": np.zeros(n + 1, np.float32)}
        logs = np.log(np.array([c for _, c in known] + [rare], float) + 0.5)
        self.p["bw"][:] = logs - np.array([logs[a:b].mean() for a, b in zip(self.starts, self.starts[1:])])[self.class_of]
        self.p["bc"][:] = np.log(np.add.reduceat(np.exp(logs), self.starts[:-1]) / np.exp(logs).sum())

    def end(self) -> int:
        return self.symbols.get(END, self.n)

    def _unshifted(self) -> bool:
        """States lie between -1 and 1, so the weights bound every logit."""
        p = self.p
        return max(float((np.abs(p["wc"]).sum(axis=0) + np.abs(p["bc"])).max()), float((np.abs(p["ww"]).sum(axis=0) + np.abs(p["bw"])).max())) <= SAFE

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """ln P(target | state) of each row: class, then word in its class."""
        p, out, shifted = self.p, np.empty(len(targets)), not self._unshifted()
        wc, ww, bounds = np.vstack([p["wc"], p["bc"]]), np.vstack([p["ww"], p["bw"]]), np.arange(self.classes + 1)
        for at in range(0, len(targets), ROWS):
            y = targets[at:at + ROWS]
            classes = self.class_of[y]
            order = np.argsort(classes, kind="stable")
            y, classes, h = y[order], classes[order], np.ones((len(y), SIZE + 1), np.float32)
            h[:, :SIZE] = states[at:at + ROWS][order]
            found = _log_softmax(h @ wc, classes, shifted)
            cuts = np.searchsorted(classes, bounds)
            for c in range(self.classes):
                a, b, rows = self.starts[c], self.starts[c + 1], slice(cuts[c], cuts[c + 1])
                if cuts[c + 1] > cuts[c] and b - a > 1:
                    found[rows] += _log_softmax(h[rows] @ ww[:, a:b], y[rows] - a, shifted)
            out[at + order] = found
        return out

    def train(self, texts: list[list[int]]) -> None:
        """Two passes over the joined texts, without Spark."""
        for done in range(2 if texts else 0):
            self.learn(np.concatenate([[self.end()], *texts]).astype(np.int16), gru.Adam(self.p, RATE / (1 + done)))

    def learn(self, flat: np.ndarray, adam: gru.Adam) -> None:
        """Truncated backpropagation: streams run through the symbols, states go on from window to window; each symbol after the first is learned once."""
        flat = flat.astype(np.intp)
        while len(flat) > 1:
            streams = max(1, min(STREAMS, (len(flat) - 1) // STEPS))
            length = (len(flat) - 1) // streams
            self._run(np.stack([flat[i * length:(i + 1) * length + 1] for i in range(streams)], axis=1), adam)
            flat = flat[streams * length:]

    def _run(self, streams: np.ndarray, adam: gru.Adam) -> None:
        p, length, state = self.p, len(streams) - 1, np.zeros((streams.shape[1], SIZE), np.float32)
        for at in range(0, length, STEPS):
            x, y = streams[at:at + STEPS][:length - at], streams[at + 1:at + STEPS + 1].ravel()
            table, u = gru.prepared(p["table"], p["u"])
            states, memory = gru.run(np.take(table, x, axis=1), u, state, True)
            state, scale, shifted = states[-1], np.float32(1 / len(y)), not self._unshifted()
            # In order of the classes, with a last column of ones for the biases.
            order = np.argsort(self.class_of[y], kind="stable")
            y, h = y[order], np.ones((len(y), SIZE + 1), np.float32)
            h[:, :SIZE] = states.reshape(-1, SIZE)[order]
            classes, wc, ww = self.class_of[y], np.vstack([p["wc"], p["bc"]]), np.vstack([p["ww"], p["bw"]])
            d = _errors(h @ wc, classes, scale, shifted)
            to_wc, to_ww, dh = h.T @ d, np.zeros_like(ww), d @ p["wc"].T
            cuts = np.searchsorted(classes, np.arange(self.classes + 1))
            for c in range(self.classes):
                a, b, rows = self.starts[c], self.starts[c + 1], slice(cuts[c], cuts[c + 1])
                if cuts[c + 1] > cuts[c] and b - a > 1:
                    e = _errors(h[rows] @ ww[:, a:b], y[rows] - a, scale, shifted)
                    to_ww[:, a:b] = h[rows].T @ e
                    dh[rows] += e @ p["ww"][:, a:b].T
            grads = {"wc": to_wc[:SIZE], "bc": to_wc[SIZE], "ww": to_ww[:SIZE], "bw": to_ww[SIZE]}
            back = np.empty_like(dh)
            back[order] = dh
            dx, grads["u"] = gru.backward(back.reshape(states.shape), p["u"], memory)
            grads["table"] = gru.table_grad(x, dx, self.n + 1)
            adam.update(grads)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """ln probability of each whole text of symbols; texts advance together, longest first, so that those still running are a prefix."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        flat, begin = np.concatenate(texts).astype(np.intp), np.cumsum(sizes) - sizes
        totals, ordered = np.zeros(len(texts)), sizes[order]
        state, last = np.zeros((len(texts), SIZE), np.float32), np.full(len(texts), self.end())
        table, u = gru.prepared(self.p["table"], self.p["u"])
        for at in range(0, int(ordered[0]) if len(ordered) else 0, WINDOW):
            running = int(np.searchsorted(-ordered, -at, "left"))
            rows = order[:running]
            steps = min(WINDOW, int(ordered[0]) - at)
            place = np.minimum(begin[rows][None, :] + at + np.arange(steps)[:, None], (begin + sizes - 1)[rows][None, :])
            target = flat[place]
            inputs = np.concatenate([last[None, :running], target[:-1]])
            states = gru.run(np.take(table, inputs, axis=1), u, state[:running])
            if ordered[running - 1] >= at + steps:
                found = self.log_probs(states.reshape(-1, SIZE), target.ravel()).reshape(target.shape)
            else:
                real = (at + np.arange(steps))[:, None] < ordered[None, :running]
                found = np.zeros(target.shape)
                found[real] = self.log_probs(states[real], target[real])
            totals[rows] += found.sum(axis=0)
            state, last = states[-1], target[-1]
        return totals


def _log_softmax(logits: np.ndarray, targets: np.ndarray, shifted: bool) -> np.ndarray:
    """Logarithm of the softmax of each row at its target."""
    if shifted:
        logits -= logits.max(axis=1, keepdims=True)
    at = logits[np.arange(len(targets)), targets]
    np.exp(logits, out=logits)
    return at.astype(float) - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _errors(logits: np.ndarray, targets: np.ndarray, scale: np.float32, shifted: bool) -> np.ndarray:
    """``scale`` times the softmax of each row, less ``scale`` at its target."""
    if shifted:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (scale / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    logits[np.arange(len(targets)), targets] -= scale
    return logits


def most_frequent(counts: DataFrame, bound: int) -> list[tuple[str, int]]:
    """Words by count, at most ``bound``: whole bins of the logarithm of the count, from the top, while they fit.

    The bins (some thousands) tell the cutoff first, so that no task sends a top list of its own to the driver.
    """
    bin_of = F.floor(F.log2("c") * 64)
    left, cut = bound, None
    for r in sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["bin"]
    chosen = counts.where(bin_of >= cut).collect() if cut is not None else []
    return sorted([(r["word"], r["c"]) for r in chosen], key=lambda x: (-x[1], x[0]))


def _trained(dealt: DataFrame, shards: int, model: Model, rate: float) -> dict[str, np.ndarray]:
    """Parameters after a round over ``dealt`` (shard, deal, symbols): each shard goes on from those of ``model``; their mean, weighted by tokens."""
    shared, names = dealt.sparkSession.sparkContext.broadcast(model), sorted(model.p)

    def of_shard(rows: Iterator[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
        own = copy.deepcopy(shared.value)
        adam, waiting, size, total = gru.Adam(own.p, rate), [np.array([own.end()], np.int16)], 1, 0
        for _, symbols in rows:
            waiting.append(np.frombuffer(symbols, np.int16))
            size += len(waiting[-1])
            while size > CHUNK:
                flat = np.concatenate(waiting)
                own.learn(flat[:CHUNK + 1], adam)
                waiting, size, total = [flat[CHUNK:]], size - CHUNK, total + CHUNK
        own.learn(np.concatenate(waiting), adam)
        return total + size - 1, np.concatenate([own.p[k].ravel() for k in names])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of their shards; what a task has learned is summed before it is sent.
        rows = ((k, x) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        total, sums = 0, None
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            n, params = of_shard(group)
            total, sums = total + n, n * params.astype(float) + (0 if sums is None else sums)
        if total:
            pieces = np.array_split((sums / total).astype(np.float32), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([total] * PIECES, pa.int64()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "tokens", "params"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tokens_of = {}, {}
        for batch in batches:
            for piece, n, params in zip(*(c.to_pylist() for c in batch.columns)):
                sums[piece] = sums.get(piece, 0) + n * np.frombuffer(params, np.float32).astype(float)
                tokens_of[piece] = tokens_of.get(piece, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / tokens_of[k]).astype(np.float32).tobytes() for k, x in sums.items()], pa.binary())], ["piece", "params"])

    # Written, so that a lost task of the mean does not train again.
    placed = dealt.repartitionById(min(shards, TASKS), F.pmod("shard", F.lit(min(shards, TASKS))).cast("int")).sortWithinPartitions("shard", "deal")
    parts = stage(placed.select("shard", "symbols").mapInArrow(learn, "piece int, tokens long, params binary"))
    means = sorted(tuple(r) for r in parts.repartition(PIECES, "piece").mapInArrow(mean, "piece int, params binary").collect())
    if not means:
        return model.p
    flat, out = np.frombuffer(b"".join(bytes(x) for _, x in means), np.float32), {}
    for k in names:
        out[k], flat = flat[:model.p[k].size].reshape(model.p[k].shape).copy(), flat[model.p[k].size:]
    return out


def fit(cut: DataFrame, model: Model, n: int) -> Model:
    """``model`` trained on all rows of ``cut`` (deal, symbols), ``n`` tokens."""
    shards = max(1, n // ROUNDS // SHARD_TOKENS)
    own = cut.select("deal", "symbols", F.pmod("deal", F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftrightunsigned("deal", 16), F.lit(shards)).alias("shard"))
    for done in range(ROUNDS * PASSES if n else 0):
        model.p = _trained(own.where(F.col("round") == done % ROUNDS).select("shard", "deal", "symbols"), shards, model, RATE / (1 + done))
    return model


def cut_texts(docs: DataFrame, known: dict[str, int], network: int, base_of, rare_of) -> DataFrame:
    """``docs`` (doc_id, held_out, deal, text) with texts cut once: symbols of the network (16 bits each), counts and sums over the words of ``known``, and the different other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most HELD words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        index, last = {w.encode(): i for i, w in enumerate(held)}, len(held)  # symbols of the network come first
        base = np.array([base_of(c) for c in held.values()] + [0.0])
        rare = np.array([0.0 if i < network else rare_of(c) for i, c in enumerate(held.values())] + [0.0])
        get, missing = index.get, itertools.repeat(last)
        for batch in batches:
            rows, words, times, bounds = [], [], [], [0]
            for text in batch.column(3).cast(pa.binary()):
                found = _cut(text)
                place = np.fromiter(map(get, found, missing), np.int32, len(found))
                others = Counter([found[i] for i in np.flatnonzero(place == last).tolist()])
                words.extend(others)
                times.extend(others.values())
                bounds.append(len(words))
                rows.append((len(place), len(place) - others.total(), float(base[place].sum()), float(rare[place].sum()), np.minimum(place, network).astype(np.int16).tobytes()))
            sizes, n_known, bases, rares, symbols = zip(*rows) if rows else [()] * 5
            met = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "k"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(rares, pa.float64()),
                                              pa.array(symbols, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), met)],
                                             ["doc_id", "held_out", "deal", "n_tokens", "n_known", "base", "rare", "symbols", "others"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "deal", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, deal long, n_tokens long, n_known long, base double, rare double, symbols binary, others array<struct<word: string, k: bigint>>")


def network_scores(cut: DataFrame, model: Model) -> DataFrame:
    """``cut`` with ``model``, the network's log10 probability, in place of ``symbols``."""
    shared = cut.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in cut.columns if c != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            # Whole rows that are scored together; at least one.
            group = np.cumsum(np.asarray(batch.column("n_tokens"))) // TOGETHER
            starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else []
            for a, b in zip(starts, [*starts[1:], len(group)]):
                part = batch.slice(a, b - a)
                found = network.score([np.frombuffer(x, np.int16) for x in part.column("symbols").to_pylist()]) / math.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(found, pa.float64())], [*columns, "model"])

    return cut.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "symbols") + ", model double")


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; all others are counted, and all of
    them train the network. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))); ``score`` is the network's
    log10 probability, rare words by (c + 0.5) / (N' + 0.5 (V' + 1)) among the rare. Null and empty texts are one
    end; repeated rows are scored each; an empty table gives no rows; further columns are ignored. With nothing
    to learn from all words are rare.
    """
    deal = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), deal.alias("deal"))
    counts = stage(count_words(own.where("NOT held_out")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    held = most_frequent(counts, HELD)
    inside = sum(c for _, c in held[:WORDS])
    model = Model(held[:WORDS], n - inside)
    rare_n, rare_v = n - inside, v - model.n
    base_of = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    rare_of = lambda c: math.log10((c + 0.5) / (rare_n + 0.5 * (rare_v + 1)))
    # Written once, so that the row numbers do not change when a lost task runs again.
    cut = stage(cut_texts(own, dict(held), model.n, base_of, rare_of).withColumn("row", F.monotonically_increasing_id()))
    model = fit(cut.where("NOT held_out"), model, n)
    part = network_scores(cut.drop("deal", "others"), model)
    met = cut.select("row", F.inline("others")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"),
                                  F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1)))).alias("more_base"),
                                  F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / (rare_n + 0.5 * (rare_v + 1)))).alias("more_model"))
    out, zero = part.join(sums, "row", "left"), lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") + zero("more_base")).alias("base_score"), (F.col("model") + F.col("rare") + zero("more_model")).alias("score"))
