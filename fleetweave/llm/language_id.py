"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

The network reads the bytes of a word, white space on both sides, forwards and backwards, and labels every position
with a language. Its state starts anew at white space (and after ``PIECE`` bytes of a longer word), so equal words have
equal labels and are read once per chunk of text, however often they stand there. A document's probabilities are the
mean over the labels of all its letter positions. Training is back-propagation through time on the driver, over a
sample of labelled documents bounded by ``SAMPLE_DOCS`` and ``SAMPLE_BYTES``.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.llm.scratch import stored
from fleetweave.llm.text import chunks, release, texts_of, words_of

HIDDEN = 16
PIECE = 48  # bytes read in one go, white space aside
CHUNK = 3 << 20  # bytes of text whose equal words are read once
ROWS = 1000  # documents in hand at a time
BATCH, STEPS, RATE = 256, 500, 0.02
SAMPLE_DOCS = 1200  # documents to learn from, shared out evenly over the languages
SAMPLE_BYTES = 4 << 20  # of their texts together, likewise
MOST_SENT = 10_000
UNKNOWN = "und"
MIN_SCORE = 0.3  # a best language below this is no better than a guess among a few
RESULT = "id long, lang_pred string, score double"
_RESULT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = True
_LETTER_BYTE[128:] = True
_letter = regex.compile(r"\p{L}").search


@dataclass
class Network:
    """Weights by name; ``f`` and ``b`` are the two directions, gates in the order update, reset, candidate."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11) -> Network:
        draw, h, n = np.random.default_rng(seed), HIDDEN, len(languages)
        weights = {}
        for way in "fb":
            weights["x" + way] = draw.normal(0, 0.3, (256, 3 * h))
            weights["u" + way] = draw.normal(0, h ** -0.5, (h, 3 * h))
            weights["o" + way] = draw.normal(0, h ** -0.5, (h, n))
        weights["bias"] = np.zeros(n)
        return cls(languages, {k: w.astype(np.float32) for k, w in weights.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _read(weights: dict, way: str, steps: np.ndarray, active: list[int], keep: bool):
    """States after every step. ``steps`` is (time, word) bytes, words by falling length; ``active`` of them go on at t."""
    h, w, u = HIDDEN, weights["x" + way], weights["u" + way]
    states = np.zeros((len(steps) + 1, steps.shape[1], h), np.float32)
    trace = []
    for t, n in enumerate(active):
        before = states[t, :n]
        seen, carried = w[steps[t, :n]], before @ u
        gates = _sigmoid(seen[:, :2 * h] + carried[:, :2 * h])
        update, reset = gates[:, :h], gates[:, h:]
        candidate = np.tanh(seen[:, 2 * h:] + reset * carried[:, 2 * h:])
        states[t + 1, :n] = candidate + update * (before - candidate)
        if keep:
            trace.append((update, reset, candidate, carried[:, 2 * h:]))
    return states, trace


def _grid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Bytes of words (falling length) by time, forwards and backwards, their lengths, and words active at each time."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    time = np.arange(lengths[0])[:, None]
    inside = time < lengths
    forward = np.where(inside, flat[np.minimum(starts + time, len(flat) - 1)], 0)
    backward = np.where(inside, flat[np.maximum(np.minimum(starts + lengths - 1 - time, len(flat) - 1), 0)], 0)
    return forward, backward, lengths, inside.sum(1).tolist()


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _label(weights: dict, words: list[bytes], keep: bool = False):
    """Probabilities (time, word, language) of every position; positions behind a word's end mean nothing."""
    forward, backward, lengths, active = _grid(words)
    states_f, trace_f = _read(weights, "f", forward, active, keep)
    states_b, trace_b = _read(weights, "b", backward, active, keep)
    time = np.arange(len(forward))[:, None]
    turn = np.maximum(lengths - 1 - time, 0)  # the backward step that ends at this position
    across = np.arange(len(words))
    ahead = states_b[turn + 1, across]
    probs = _softmax(states_f[1:] @ weights["of"] + ahead @ weights["ob"] + weights["bias"])
    return probs, (forward, backward, lengths, active, states_f, trace_f, states_b, trace_b, turn, ahead)


def _back(weights: dict, way: str, steps, active, states, trace, d_out, grads) -> None:
    """Back-propagate through time: ``d_out`` is the gradient of every state after its step."""
    h, u = HIDDEN, weights["u" + way]
    d_next = np.zeros_like(states[0])
    d_u, d_w = np.zeros_like(u), np.zeros_like(weights["x" + way])
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        update, reset, candidate, carried = trace[t]
        before, d = states[t, :n], d_next[:n] + d_out[t, :n]
        d_cand = d * (1 - update) * (1 - candidate * candidate)
        d_gates = np.empty((n, 3 * h), np.float32)
        d_gates[:, :h] = d * (before - candidate) * update * (1 - update)
        d_gates[:, h:2 * h] = d_cand * carried * reset * (1 - reset)
        d_gates[:, 2 * h:] = d_cand
        np.add.at(d_w, steps[t, :n], d_gates)
        d_gates[:, 2 * h:] *= reset
        d_u += before.T @ d_gates
        d_next[:n] = d * update + d_gates @ u.T
    grads["u" + way], grads["x" + way] = d_u, d_w


def gradients(network: Network, words: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients. Words come by falling length."""
    weights = network.weights
    probs, (forward, backward, lengths, active, sf, tf, sb, tb, turn, ahead) = _label(weights, words, keep=True)
    inside = np.arange(len(forward))[:, None] < lengths
    across = np.arange(len(words))
    total = int(lengths.sum())
    loss = -np.log(probs[:, across, labels][inside] + 1e-12).sum() / total
    d = probs.copy()
    d[:, across, labels] -= 1
    d *= inside[:, :, None] / total
    d = d.astype(np.float32)
    grads = {"bias": d.sum((0, 1)), "of": np.tensordot(sf[1:], d, ([0, 1], [0, 1])),
             "ob": np.tensordot(ahead, d, ([0, 1], [0, 1]))}
    _back(weights, "f", forward, active, sf, tf, d @ weights["of"].T, grads)
    turned = np.zeros((*d.shape[:2], HIDDEN), np.float32)
    at, word = np.nonzero(inside)
    turned[turn[at, word], word] = (d @ weights["ob"].T)[at, word]
    _back(weights, "b", backward, active, sb, tb, turned, grads)
    return float(loss), grads


def _pieces(word: bytes) -> list[bytes]:
    """A word as sequences for the network, white space on both sides."""
    return [b" " + word[k:k + PIECE] + b" " for k in range(0, len(word), PIECE)]


def fit(samples: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """Train on (text, language) pairs: languages drawn evenly, then words of theirs; Adam on mini-batches."""
    languages = sorted({lang for _, lang in samples})
    network, draw = Network.fresh(languages), np.random.default_rng(seed)
    pools = [[p for text, own in samples if own == lang for w in text.split() if _LETTER_BYTE[list(w)].any()
              for p in _pieces(w)] for lang in languages]
    drawn = [k for k, pool in enumerate(pools) if pool]
    if len(drawn) < 2:
        return network
    first = {k: np.zeros_like(w) for k, w in network.weights.items()}
    second = {k: np.zeros_like(w) for k, w in network.weights.items()}
    for step in range(1, STEPS + 1):
        labels = draw.choice(drawn, BATCH)
        words = [pools[k][draw.integers(len(pools[k]))] for k in labels]
        order = sorted(range(BATCH), key=lambda i: -len(words[i]))
        _, grads = gradients(network, [words[i] for i in order], labels[order])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            scale = (1 - 0.9 ** step) / np.sqrt(1 - 0.99 ** step)
            network.weights[k] -= (rate / scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return network


def _word_labels(network: Network, words: list[bytes]) -> np.ndarray:
    """For each word the summed probabilities of its letter positions, and their number in the last column."""
    pieces, owner = [], []
    for k, word in enumerate(words):
        for piece in _pieces(word):
            pieces.append(piece)
            owner.append(k)
    out = np.zeros((len(words), len(network.languages) + 1), np.float32)
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    for start in range(0, len(order), 2048):
        part = order[start:start + 2048]
        probs, (forward, _, lengths, *_) = _label(network.weights, [pieces[i] for i in part])
        letters = _LETTER_BYTE[forward] & (np.arange(len(forward))[:, None] < lengths)
        sums = np.concatenate([(probs * letters[:, :, None]).sum(0), letters.sum(0)[:, None]], axis=1)
        np.add.at(out, [owner[i] for i in part], sums)
    return out


def probabilities(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities (text, language) over each text's letter positions; zero where there are none."""
    out = np.zeros((len(texts), len(network.languages)))
    for part in chunks(texts, CHUNK):
        words = words_of(texts[part])
        if not len(words.starts):
            continue
        _, firsts, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        data = words.data.tobytes()
        distinct = [data[a:b] for a, b in zip(words.starts[firsts].tolist(), words.ends[firsts].tolist())]
        sums = _word_labels(network, distinct)[inverse]
        full = np.flatnonzero(words.counts)
        pooled = np.add.reduceat(sums, words.firsts[full], axis=0, dtype=np.float64)
        out[part.start + full] = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
    return out


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id is the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor).cast("int")


def is_held_out(doc_id: int | None, divisor: int, value: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor == value


def sample(docs: DataFrame, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """Labelled texts to learn from: distinct texts of lowest hash, evenly over languages, bounded in number and in bytes.

    A text counts once for a language, however many copies it has, so copies neither crowd out other texts nor lower the
    rate at which they are drawn. Every language has its share of ``SAMPLE_DOCS`` and of ``SAMPLE_BYTES``, in hash order;
    texts larger than the latter come last, and a language's first text is always taken. If there are more languages than
    ``SAMPLE_DOCS``, those whose first text has the lowest hash are learned. Nothing depends on the order of rows.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    known = known.withColumn("_hash", F.xxhash64("_text", F.lit("sample")))
    counts = stored(known.groupBy("_lang", "_hash").agg(F.lit(1).alias("_one")).groupBy("_lang").agg(F.count("*").alias("_texts")))
    kinds = counts.count()
    if not kinds:
        return []
    share, most = max(1, SAMPLE_DOCS // kinds), SAMPLE_BYTES // kinds
    spread = F.pmod(F.col("_hash"), F.lit(1 << 40)) / float(1 << 40)
    # few languages are sent to every task, so that no text moves; more than that are met by a shuffle
    counts = F.broadcast(counts) if kinds <= MOST_SENT else counts
    drawn = known.join(counts, "_lang").where(spread * F.col("_texts") < 2 * share)  # about twice the share
    drawn = drawn.groupBy("_lang", "_hash").agg(F.first("_text").alias("_text")).withColumn("_bytes", F.octet_length("_text"))
    order = Window.partitionBy("_lang").orderBy(F.col("_bytes") > most, spread, "_hash")
    held = F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = drawn.select("*", F.row_number().over(order).alias("_nth"), held.alias("_held"))
    taken = ranked.where((F.col("_nth") == 1) | ((F.col("_nth") <= share) & (F.col("_held") <= most)))
    rows = taken.orderBy("_nth", spread, "_hash", "_lang").limit(SAMPLE_DOCS).select("_text", "_lang").collect()
    return [(r["_text"].encode(), r["_lang"]) for r in rows]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          divisor: int = 3, held_out: int = 1) -> Network:
    """A network fitted to the labelled rows whose id remainder is not ``held_out``."""
    return fit(sample(docs.where(remainder(id_col, divisor) != held_out), text_col, lang_col))


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, lang_pred, score), the language of highest pooled probability and that probability.

    ``und`` and 0 where the text is null or has no letter, or where nothing was learned. Equal probabilities go to the
    language first in the alphabet. Whole texts are read; repeated rows stay; other columns are not read.
    """
    def run(batches):
        for batch in _parts(batches):
            names, scores = _judged(network, texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], schema=_RESULT)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, RESULT)


def _parts(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)
        release()


def _judged(network: Network, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if network.languages:
        found = probabilities(network, texts)
        best = found.argmax(1)
        for k, text in enumerate(texts):
            if _letter(text.decode()):
                names[k], scores[k] = network.languages[best[k]], min(1.0, found[k, best[k]])
    return names, scores


def accepted(docs: DataFrame, network: Network, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language: not ``und``, and with a score of ``min_score`` or more.

    All columns pass through. Where nothing was learned there is no ground to reject a text that has a letter.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in _parts(batches):
            texts = texts_of(batch.column(place))
            names, scores = _judged(network, texts)
            if network.languages:
                kept = [n != UNKNOWN and s >= min_score for n, s in zip(names, scores)]
            else:
                kept = [_letter(t.decode()) is not None for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
