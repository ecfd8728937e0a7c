"""Language of texts by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a text's UTF-8 bytes from both ends; at every byte their states
give probabilities of the languages, and a document has the mean over the bytes of its
letters. The network is trained here in numpy, by backpropagation through time.

Texts are read in windows of ``WINDOW`` bytes, each after (and before) ``CONTEXT`` bytes of
its surroundings, so a window needs no other and many are read side by side. Every byte of
the whole text is labelled, in a window of its own.

The network learns from ``most_rows`` documents a language at most: those with the least
hash of their id, ``PIECES`` pieces of ``PIECE`` characters each. Predictions take the text alone.

Defined results: null text, and text without a letter, is ``und`` with score 0, and so is
all text where nothing was learned. Rows without id, language or letters aren't learned
from; of several rows with one id and language, the least text is. Rows of equal text get
equal languages, and scores that differ by rounding at most (under 1e-5); an empty table stays empty. Long texts are read whole, ``BATCH`` windows at a time.
Columns of the input stay, unless they have the name of a result, which takes their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of each direction; bytes of a window and of its surroundings on each side; windows read at once.
UNITS, WINDOW, CONTEXT, BATCH = 8, 112, 16, 2048
#: Documents of a language that are learned from, and the pieces of each.
MOST_ROWS, PIECES, PIECE = 400, 2, 120
#: Training: windows of this many bytes, this many at once; steps over all; step size.
TRAIN_WINDOW, TRAIN_BATCH, STEPS, RATE = 64, 128, 320, 0.02
#: Stands for what lies before and after a text.
PAD = 256
UNKNOWN = "und"
LETTER = r"\p{L}"

_IS_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(128)] + [True] * 128 + [False], np.float32)


def held_out(key: Column) -> Column:
    """Whether a row belongs to the fold that nothing is learned from; false without an id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, owners)``: texts end to end with ``PAD`` between, where each window starts, and whose it is."""
    counts = [-(-len(t) // size) for t in texts]
    room = np.array([n * size + CONTEXT for n in counts], np.int64)
    begins = CONTEXT + np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    row = np.full(CONTEXT + int(room.sum()) + CONTEXT, PAD, np.int16)
    for t, at in zip(texts, begins):
        row[at : at + len(t)] = t
    owners = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts) if len(owners) else owners
    return row, np.repeat(begins, counts) + inner * size, owners


def _columns(row: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Bytes by place in the window (with both surroundings) and window."""
    return row[np.arange(-CONTEXT, size + CONTEXT)[:, None] + starts[None, :]]


@dataclass
class Network:
    """``table[d, :, byte]`` and ``inner[d]`` make the gates (keep, reset, new) of direction ``d``; ``out`` and ``bias`` the languages."""

    table: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias]

    @classmethod
    def fresh(cls, n_languages: int, rng: np.random.Generator) -> Network:
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        table = draw(0.5, 2, 3 * UNITS, PAD + 1)
        table[:, :UNITS] += 1  # states last from the start
        return cls(table, draw(UNITS**-0.5, 2, 3 * UNITS, UNITS), draw((2 * UNITS) ** -0.5, n_languages, 2 * UNITS), np.zeros((n_languages, 1), np.float32))

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions after each step, ``[step, 2, UNITS, window]``; ``keep`` gets what backpropagation needs."""
        steps, n, u = len(x) - CONTEXT, x.shape[1], UNITS
        # Half the gates' sums, for sigmoid(v) = (1 + tanh(v / 2)) / 2.
        half = np.r_[np.full(2 * u, 0.5), np.ones(u)].astype(np.float32)[None, :, None]
        table, inner = self.table * half, self.inner * half
        states = np.empty((steps, 2, u, n), np.float32)
        state = np.zeros((2, u, n), np.float32)
        given, back = np.empty((2, 3 * u, n), np.float32), np.empty((2, 3 * u, n), np.float32)
        for t in range(steps):
            for d, row in enumerate((x[t], x[len(x) - 1 - t])):
                np.take(table[d], row, axis=1, out=given[d], mode="clip")
            np.matmul(inner, state, out=back)
            gates = given[:, : 2 * u]
            gates += back[:, : 2 * u]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = given[:, 2 * u :]
            if keep is not None:
                keep.append((state, gates.copy(), back[:, 2 * u :].copy()))
            back[:, 2 * u :] *= gates[:, u:]
            new += back[:, 2 * u :]
            np.tanh(new, out=new)
            if keep is not None:
                keep[-1] += (new.copy(),)
            after = states[t]
            np.subtract(state, new, out=after)
            after *= gates[:, :u]
            after += new
            state = after
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each language at each place of the window, ``[place, language, window]``."""
        ahead, back = states[CONTEXT:, 0], states[CONTEXT:, 1][::-1]
        p = self.out[:, :UNITS] @ ahead
        p += self.out[:, UNITS:] @ back
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Mean probabilities of each text over the bytes of its letters, ``[text, language]``."""
        row, starts, owners = windows(texts, WINDOW)
        sums = np.zeros((len(texts), len(self.bias)))
        for at in range(0, len(starts), BATCH):
            x = _columns(row, starts[at : at + BATCH], WINDOW)
            weight = _IS_LETTER[x[CONTEXT:-CONTEXT]]
            p = self.probabilities(self.states(x))
            np.add.at(sums, owners[at : at + BATCH], np.einsum("tlb,tb->bl", p, weight).astype(np.float64))
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)

    def gradients(self, x: np.ndarray, answers: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes of letters, and its gradients, by backpropagation through time."""
        keep: list = []
        u, steps = UNITS, len(x) - CONTEXT
        states = self.states(x, keep)
        p = self.probabilities(states)
        weight = _IS_LETTER[x[CONTEXT:-CONTEXT]]
        weight = weight / max(1.0, float(weight.sum()))
        right = np.take_along_axis(p, np.broadcast_to(answers[None, None, :], (len(p), 1, len(answers))), axis=1)[:, 0]
        loss = float(-(np.log(np.maximum(right, 1e-12)) * weight).sum())
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(answers[None, None, :], (len(p), 1, len(answers))), (right - 1)[:, None], axis=1)
        d *= weight[:, None]
        ahead, back = states[CONTEXT:, 0], states[CONTEXT:, 1][::-1]
        g_out = np.concatenate([np.einsum("tlb,tub->lu", d, s, optimize=True) for s in (ahead, back)], axis=1)
        g_bias = d.sum(axis=(0, 2))[:, None]
        into = np.zeros_like(states)
        into[CONTEXT:, 0] = self.out[:, :u].T @ d
        into[CONTEXT:, 1] = (self.out[:, u:].T @ d)[::-1]
        g_table, g_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        grad = np.zeros_like(states[0])
        eye = np.eye(PAD + 1, dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            state, gates, back_new, new = keep[t]
            z, r = gates[:, :u], gates[:, u:]
            grad = grad + into[t]
            d_new = grad * (1 - z) * (1 - new * new)
            d_given = np.concatenate([grad * (state - new) * z * (1 - z), d_new * back_new * r * (1 - r), d_new], axis=1)
            d_back = np.concatenate([d_given[:, : 2 * u], d_new * r], axis=1)
            g_inner += d_back @ state.transpose(0, 2, 1)
            for k, row in enumerate((x[t], x[len(x) - 1 - t])):
                g_table[k] += d_given[k] @ eye[row]
            grad = grad * z + self.inner.transpose(0, 2, 1) @ d_back
        return loss, [g_table, g_inner, g_out, g_bias]


@dataclass
class Model:
    """The languages learned, in order, and the network that tells them apart."""

    languages: list[str]
    network: Network | None


def fitted(texts: list[bytes], langs: list[str]) -> Model:
    """A model of pieces of text, by Adam; the same pieces give the same model."""
    languages = sorted(set(langs))
    if len(languages) == 0:
        return Model([], None)
    rng = np.random.default_rng(3)
    network = Network.fresh(len(languages), rng)
    row, starts, owners = windows([np.frombuffer(t, np.uint8) for t in texts], TRAIN_WINDOW)
    answers = np.array([languages.index(v) for v in langs])[owners]
    first, second, step = [np.zeros_like(p) for p in network.parameters], [np.zeros_like(p) for p in network.parameters], 0
    order = np.zeros(0, int)
    while step < STEPS:
        if not len(order):
            order = rng.permutation(len(starts))
        chosen, order = order[:TRAIN_BATCH], order[TRAIN_BATCH:]
        _, gradients = network.gradients(_columns(row, starts[chosen], TRAIN_WINDOW), answers[chosen])
        rate, step = RATE * (1 - step / STEPS), step + 1
        for p, m, v, g in zip(network.parameters, first, second, gradients):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, network)


def train(docs: DataFrame, most_rows: int = MOST_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows' languages, from ``most_rows`` documents of each at most."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("key is not null and lang is not null")
    # Ids first, without texts: the columns of the scan are small.
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key")
    chosen = rows.select("lang", "key").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_rows).drop("r")
    texts = rows.where(F.col("text").rlike(LETTER)).join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    spare = F.greatest(F.length("text") - PIECE, F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(k)), spare + 1).cast("int") + 1
    pieces = F.array(*[F.substring("text", place(k), F.lit(PIECE)) for k in range(PIECES)])
    found = sorted((r.lang, piece) for r in texts.select("lang", F.explode(pieces).alias("piece")).collect() for piece in [r.piece])
    return fitted([piece.encode() for _, piece in found], [v for v, _ in found])


def labelled(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the mean probability of that language."""
    languages, network = model.languages, model.network

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found: list[dict | None] = [None] * len(part)
            waiting: list[tuple[int, np.ndarray]] = []
            held = 0

            def read() -> None:
                means = network.pooled([t for _, t in waiting])
                for (k, _), p in zip(waiting, means):
                    found[k] = {"lang": languages[int(p.argmax())], "score": float(p.max())}
                waiting.clear()

            for k, value in enumerate(part):
                if value.is_valid:
                    waiting.append((k, np.frombuffer(value.as_buffer(), np.uint8)))
                    held += -(-len(waiting[-1][1]) // WINDOW)
                    if held >= BATCH:
                        read()
                        held = 0
            if waiting:
                read()
            yield pa.array(found, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    if network is None:
        return docs.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    asked = F.when(F.col(text).rlike(LETTER), F.col(text).cast("binary"))
    told = docs.withColumn("__told", predicted(asked))
    return told.select(*others, F.coalesce("__told.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.least(F.coalesce("__told.score", F.lit(0.0)), F.lit(1.0)).alias("score"))
