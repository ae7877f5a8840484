"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of about ``WINDOW`` bytes, spaces included, in both directions and labels
every position with a language distribution; a document's distribution pools the log probabilities of
all its positions. Windows are cut before a character, never inside one, and every byte of a text is
in one window. It is trained in numpy by backpropagation through time on a bounded sample of labelled
rows: per language up to about twice ``SAMPLE_ROWS`` of them, and about ``MOST_ROWS`` in all, of each
an excerpt of ``EXCERPT`` characters at a hashed place. States and training steps grow with the number
of languages. A fifth of the sample is not trained on: it calibrates the scores.

A text that is null or has no letter is ``und`` with score 0. Repeated rows are predicted once each;
an empty table gives an empty result; without any labelled row every document is ``und``. Languages,
sources and ids are no inputs of a prediction. Other columns do not pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.pieces import runs

SAMPLE_ROWS = 150
EXCERPT = 2000
MOST_ROWS = 30_000
HIDDEN = 10  # states a direction for up to FEW languages; beyond, they grow with the root of the number
STEPS = 150  # for up to FEW languages; beyond, they grow with the power GROWTH of the number
FEW = 4
GROWTH = 0.75
WINDOW = 128
BATCH = 128  # windows of a training step
STRIP = 2048  # windows read together; their states stay in the processor's cache
RUN_BYTES = 4 << 20  # texts cut into windows together
# Positions of one text are far from independent: evidence counts per so many of them. The number that
# fits best is taken, the first one where there is nothing to calibrate with.
POSITIONS = [6.0, 1.5, 3.0, 12.0, 24.0, 48.0, 96.0, 192.0, 384.0]
FOLD = 5  # of so many labelled rows of a language one is for calibration


@dataclass
class Direction:
    """One gated recurrent layer: w (256, 3H) by input byte, u (H, 3H), b (3H); gates update, reset, candidate."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x (T, B) bytes to states (T, B, H); ``keep`` returns what the backward pass needs."""
        h = self.u.shape[0]
        # A sigmoid is half a hyperbolic tangent of half its argument.
        w = self.w + self.b
        w[:, : 2 * h] *= 0.5
        gates, candidate = self.u[:, : 2 * h] * 0.5, np.ascontiguousarray(self.u[:, 2 * h :])
        s, out, saved = np.zeros((x.shape[1], h), w.dtype), np.empty((*x.shape, h), w.dtype), []
        for t, byte in enumerate(x):
            a = w[byte]
            zr = s @ gates
            zr += a[:, : 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            rs = r * s
            c = rs @ candidate
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                saved.append((s, z, r, rs, c))
            s = s + z * (c - s)
            out[t] = s
        return out, saved

    def backward(self, x: np.ndarray, grad: np.ndarray, saved: list) -> list[np.ndarray]:
        """Gradients of w, u, b from those of the states (T, B, H)."""
        h = self.u.shape[0]
        du, each = np.zeros_like(self.u), np.empty((*x.shape, 3 * h), self.w.dtype)
        ds = np.zeros(grad.shape[1:], self.w.dtype)
        for t in range(len(saved) - 1, -1, -1):
            s, z, r, rs, c = saved[t]
            ds = ds + grad[t]
            dc = ds * z * (1 - c * c)
            drs = dc @ self.u[:, 2 * h :].T
            dz = ds * (c - s) * z * (1 - z)
            dr = drs * s * r * (1 - r)
            da = each[t]
            da[:, :h], da[:, h : 2 * h], da[:, 2 * h :] = dz, dr, dc
            du[:, : 2 * h] += s.T @ da[:, : 2 * h]
            du[:, 2 * h :] += rs.T @ dc
            ds = ds * (1 - z) + drs * r + da[:, : 2 * h] @ self.u[:, : 2 * h].T
        dw = np.zeros_like(self.w)
        order = np.argsort(x, axis=None, kind="stable")
        found, firsts = np.unique(x.reshape(-1)[order], return_index=True)
        dw[found] = np.add.reduceat(each.reshape(-1, 3 * h)[order], firsts)
        return [dw, du, dw.sum(axis=0)]


@dataclass
class Model:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (2H, L)
    bias: np.ndarray
    positions: float = POSITIONS[0]

    def states(self, x: np.ndarray, keep: bool = False):
        a, sa = self.ahead.forward(x, keep)
        b, sb = self.back.forward(x[::-1], keep)
        return np.concatenate([a, b[::-1]], axis=2), sa, sb

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        """(..., 2H) to log probabilities (..., L) of every position."""
        y = states @ self.out + self.bias
        y -= y.max(axis=-1, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=-1, keepdims=True))
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions of ``mask`` (T, B), and its gradients in the order of ``parameters``."""
        states, sa, sb = self.states(x, keep=True)
        y = self.log_probabilities(states)
        n, h = max(int(mask.sum()), 1), self.ahead.u.shape[0]
        hot = np.zeros(y.shape[1:], y.dtype)
        hot[np.arange(len(target)), target] = 1
        weight = mask[:, :, None] / np.asarray(n, y.dtype)
        dy = (np.exp(y) - hot) * weight
        dstates = dy @ self.out.T
        flat = dy.reshape(-1, dy.shape[2])
        return float(-(y * hot * weight).sum()), [
            *self.ahead.backward(x, dstates[:, :, :h], sa),
            *self.back.backward(x[::-1], dstates[::-1, :, h:], sb),
            states.reshape(-1, 2 * h).T @ flat,
            flat.sum(axis=0),
        ]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.bias]

    def window_sums(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probabilities summed over the positions of each window, (windows, L)."""
        sums = np.zeros((len(starts), len(self.languages)), np.float64)
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), STRIP):
            own = order[at : at + STRIP]
            x, mask = padded(data, starts[own], sizes[own])
            states = self.states(x)[0]
            for t in range(len(x)):
                y = self.log_probabilities(states[t])
                sums[own] += y * mask[t][:, None] if not mask[t].all() else y
        return sums


def padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (T, B) bytes with zeros behind their ends, and which positions are theirs."""
    t = np.arange(int(sizes.max()))[:, None]
    mask = t < sizes
    return np.where(mask, data[np.minimum(starts + t, len(data) - 1)], 0).astype(np.uint8), mask


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the windows of texts that lie one after another, and the text of each; empty texts have none."""
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    starts = offsets[:-1][text] + number * WINDOW
    for _ in range(3):  # back to the first byte of a character
        starts -= (data[starts] & 0xC0 == 0x80) & (number > 0)
    ends = np.where(np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool), offsets[1:][text], np.concatenate([starts[1:], [0]]) if len(text) else starts)
    return starts, ends - starts, text


def new_model(languages: list[str], hidden: int | None = None, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    hidden = hidden or math.ceil(HIDDEN * math.sqrt(max(1.0, len(languages) / FEW)))
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(max(shape[0], 1) if shape[0] != 256 else 4)).astype(np.float32)
    layer = lambda: Direction(draw(256, 3 * hidden), draw(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32))
    return Model(languages, layer(), layer(), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 0) -> Model:
    """Fits (text, language) rows: Adam on random windows of whole characters, each language as likely as another.

    ``steps`` is for up to ``FEW`` languages. One row of ``FOLD`` of a language is kept for ``calibrate``.
    """
    own, kept, by_lang = {}, [], defaultdict(list)
    for text, lang in rows:
        if text:
            by_lang[lang].append(text)
    for lang in sorted(by_lang):
        kept += [(t, lang) for t in by_lang[lang][FOLD - 1 :: FOLD]]
        texts = [t.encode("utf-8") for i, t in enumerate(by_lang[lang]) if i % FOLD != FOLD - 1]
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data):
            own[lang] = data, *windows(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))[:2]
    languages = list(own)
    model, rng = new_model(languages, seed=seed), np.random.default_rng(seed)
    if not own:
        return model
    steps = math.ceil(steps * max(1.0, len(languages) / FEW) ** GROWTH)
    params = model.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(languages), BATCH)
        parts, sizes = [], []
        for k in target:
            data, starts, lengths = own[languages[k]]
            i = int(rng.integers(0, len(starts)))
            parts.append(data[starts[i] : starts[i] + lengths[i]])
            sizes.append(len(parts[-1]))
        sizes = np.array(sizes)
        x, mask = padded(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes)
        _, grads = model.gradients(x, mask, target)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    model.positions = calibrate(model, kept)
    return model


def calibrate(model: Model, rows: list[tuple[str, str]]) -> float:
    """Of ``POSITIONS`` the number under which the labels of rows that were not trained on are likeliest."""
    if not rows:
        return POSITIONS[0]
    total = _evidence(model, pa.array([text for text, _ in rows], pa.string()))
    own = np.arange(len(rows)), np.array([model.languages.index(lang) for _, lang in rows])
    likely = lambda n: np.log(np.maximum(_probabilities(total, n)[own], 1e-12)).mean()
    return max(POSITIONS, key=likely)


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32 as text leaves 2 modulo 4; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """Excerpts of about 2 x ``rows`` labelled texts per language at most, about ``MOST_ROWS`` in all, not held out.

    Rows are chosen by the hash of the id, in proportion to a language's count, so the sample does not grow
    with the input. With more than ``MOST_ROWS`` / (2 x ``rows``) languages each has its equal share.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    narrow = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), mark.alias("mark"))
    # A row per language, gathered to know their number.
    counts = narrow.groupBy("lang").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("lang", "n")).alias("all"))
    each = counts.select(F.explode("all").alias("own"), F.least(F.lit(2.0 * rows), MOST_ROWS / F.size("all")).alias("most"))
    share = each.select("own.lang", F.least(F.lit(1.0), F.col("most") / F.col("own.n")).alias("share"))
    chosen = narrow.join(F.broadcast(share), "lang").filter(F.pmod("mark", F.lit(1 << 24)) <= F.col("share") * (1 << 24))
    at = F.pmod(F.shiftright("mark", 24), F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1)
    got = chosen.select(F.substring(F.col("text"), at.cast("int") + 1, F.lit(EXCERPT)).alias("text"), "lang", "mark").collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["mark"], r["lang"]))]


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            begin = 0
            letters = b.column("has_letter").to_numpy(zero_copy_only=False)
            for texts in runs(b.column("text"), RUN_BYTES):
                known = letters[begin : begin + len(texts)]
                begin += len(texts)
                pooled = _probabilities(_evidence(model, texts), model.positions) if model else np.zeros((len(texts), 1))
                best = pooled.argmax(axis=1)
                scores += np.where(known & (model is not None), pooled[np.arange(len(best)), best], 0.0).tolist()
                names += [model.languages[k] if model and ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _evidence(model: Model, texts: pa.Array) -> np.ndarray:
    """Log probabilities summed over all positions of each text, (texts, L)."""
    plain = pc.fill_null(texts, "")
    sizes = pc.binary_length(plain).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in plain), np.uint8)
    starts, lengths, text = windows(data, np.concatenate([[0], np.cumsum(sizes)]))
    total = np.zeros((len(plain), len(model.languages)))
    if len(starts):
        np.add.at(total, text, model.window_sums(data, starts, lengths))
    return total


def _probabilities(total: np.ndarray, positions: float) -> np.ndarray:
    """Document probabilities (texts, L) from evidence that counts per ``positions`` positions."""
    shares = np.exp((total - total.max(axis=1, keepdims=True)) / positions)
    return shares / shares.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    labelled = sample(docs, rows)
    model = train(labelled) if any(text for text, _ in labelled) else None
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"), letter)
    return kept.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
