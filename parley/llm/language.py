"""Operator 9, language identification: a byte convolutional network, trained in numpy, over fixed-length windows of whole texts.

Model. A window of WINDOW bytes (UTF-8, zero-padded) goes through filters over 2, 3 and 4 bytes (FILTERS of each; a filter over w
bytes is w tables of 256 values, the embedding and the convolution in one), a ReLU, the maximum over the window and a softmax.
A text's prediction is the mean of its windows' log probabilities, weighted by their bytes.

Learning. For each language about `sample` documents (expected number, by hash of doc_id and text together, equal ones once) with up to
WINDOWS_EACH windows each; 2 * sample * languages documents at most, so the training rows are bounded by 2 * languages * sample * WINDOWS_EACH
windows of WINDOW bytes, whatever the table's size and however often ids or texts repeat.

Edge cases. Text null, empty or without a letter (Unicode category L; numerals like ² or Ⅷ are none): `und`, score 0. No labelled rows: `und` for
all. lang null: never learned from. Null doc_id: in the hash like an empty id. Extra columns don't matter; repeated rows are each predicted by themselves.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
SAMPLE, WINDOWS_EACH, EPOCHS, BATCH, RATE, SEED = 600, 3, 6, 64, 0.01, 7
_MAYBE_LETTER = re.compile(r"[^\W\d_]").finditer  # letters and numerals that aren't digits


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER(text))


class ByteNet:
    """Filters as tables of byte values; `labels` in the order of the softmax."""

    def __init__(self, labels: list[str], filters: int = FILTERS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.labels, self.filters = labels, filters
        self.tables = {w: [draw.normal(0, 0.15, (256, filters)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        self.out = draw.normal(0, 0.2, (filters * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self._pairs = None

    def train(self, windows: np.ndarray, targets: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """windows: uint8 [n, WINDOW]. Adam; the gradient of the maximum reaches only the bytes under it."""
        draw = np.random.default_rng(seed)
        flat = [*(t for w in WIDTHS for t in self.tables[w]), *self.bias.values(), self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                x, y = windows[order[at : at + BATCH]], targets[order[at : at + BATCH]]
                rows, pooled, places = np.arange(len(x)), [], {}
                for w in WIDTHS:
                    n = x.shape[1] - w + 1
                    h = sum(self.tables[w][j][x[:, j : j + n]] for j in range(w)) + self.bias[w]
                    places[w] = h.argmax(1)
                    pooled.append(np.maximum(h.max(1), 0))
                p = np.concatenate(pooled, 1)
                z = p @ self.out + self.out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[rows, y] -= 1
                g /= len(x)
                back = (g @ self.out.T) * (p > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    own = back[:, k * self.filters : (k + 1) * self.filters]
                    columns = np.broadcast_to(np.arange(self.filters), own.shape)
                    for j in range(w):
                        grad = np.zeros_like(self.tables[w][j])
                        np.add.at(grad, (x[rows[:, None], places[w] + j], columns), own)
                        grads.append(grad)
                grads += [back[:, k * self.filters : (k + 1) * self.filters].sum(0) for k in range(len(WIDTHS))] + [p.T @ g, g.sum(0)]
                step += 1
                for q, grad, a, b in zip(flat, grads, first, second, strict=True):
                    a *= 0.9
                    a += 0.1 * grad
                    b *= 0.999
                    b += 0.001 * grad * grad
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self._pairs = None

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """[n, labels] of uint8 [n, WINDOW]. Neighbouring bytes' tables are added beforehand into tables of byte pairs: half the look-ups."""
        if self._pairs is None:
            self._pairs = {w: [(t[:-1:2][k][:, None, :] + t[1::2][k][None, :, :]).reshape(65536, -1) for k in range(w // 2)] for w, t in self.tables.items()}
        pair = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            h = np.take(self._pairs[w][0], pair[:, :n], axis=0)
            for k in range(1, w // 2):
                h += np.take(self._pairs[w][k], pair[:, 2 * k : 2 * k + n], axis=0)
            if w % 2:
                h += np.take(self.tables[w][-1], windows[:, w - 1 : w - 1 + n], axis=0)
            pooled.append(np.maximum(h.max(1) + self.bias[w], 0))
        z = np.concatenate(pooled, 1) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}


def windows_of(data: bytes) -> np.ndarray:
    """All of the text's windows, the last one zero-padded; at least one."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


#: Windows that go through the network at a time.
AT_ONCE = 128


def predict(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = [bool(net and t and has_letter(t)) for t in texts]
    data = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, known, strict=True) if k]
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not data:
        return labels, scores
    windows = [windows_of(d) for d in data]
    starts = np.cumsum([0, *(len(w) for w in windows[:-1])])
    every = np.concatenate(windows)
    logs = np.concatenate([net.log_probabilities(every[a : a + AT_ONCE]) for a in range(0, len(every), AT_ONCE)])
    sizes = np.array([len(d) for d in data])
    weights = np.minimum(WINDOW, np.repeat(sizes, np.diff([*starts, len(every)])) - WINDOW * (np.arange(len(every)) - np.repeat(starts, np.diff([*starts, len(every)]))))
    mean = np.add.reduceat(logs * weights[:, None], starts, axis=0) / sizes[:, None]
    best = mean.argmax(1)
    odds = np.exp(mean - mean.max(1, keepdims=True))
    top = 1 / odds.sum(1)
    for i, b, s in zip((i for i, k in enumerate(known) if k), best, top, strict=True):
        labels[i], scores[i] = net.labels[b], float(s)
    return labels, scores


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> ByteNet | None:
    """A network for the labels of docs (the rows to learn from)."""
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["_l"]: r["count"] for r in known.groupBy(F.col(label_col).alias("_l")).count().collect()}
    if not counts:
        return None
    million = 1_000_000
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit(SEED)), F.lit(million))
    wanted = F.lit(False)
    for label, n in sorted(counts.items()):
        wanted = wanted | ((F.col(label_col) == label) & (drawn < min(million, -(-sample * million // n))))

    def make():
        def do(columns):
            out = []
            for text in columns["_text"]:
                every = windows_of(text.encode("utf-8", "surrogatepass"))
                spread = np.unique(np.linspace(0, len(every) - 1, min(len(every), WINDOWS_EACH)).astype(int))
                out.append(every[spread].tobytes())
            return {"label": columns["_label"], "windows": out}

        return do

    rows = by_batch(known.where(wanted).select(F.col(label_col).alias("_label"), F.col(text_col).alias("_text")), make, "label string, windows binary")
    rows = rows.distinct().orderBy(F.xxhash64("label", "windows"), "label", "windows").limit(2 * sample * len(counts)).collect()
    rows.sort(key=lambda r: (r.label, bytes(r.windows)))  # the order of partitions doesn't matter
    labels = sorted(counts)
    x = np.concatenate([np.frombuffer(bytes(r.windows), np.uint8).reshape(-1, WINDOW) for r in rows])
    y = np.concatenate([np.full(len(r.windows) // WINDOW, labels.index(r.label)) for r in rows])
    net = ByteNet(labels)
    net.train(x, y)
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    id_type = dict(docs.dtypes)[id_col]

    def make():
        def do(columns):
            labels, scores = predict(net, columns["_text"])
            return {"doc_id": columns["_id"], "lang_pred": labels, "score": scores}

        return do

    return by_batch(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), make, f"doc_id {id_type}, lang_pred string, score double")


def id_crc(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 4 is not 2; predicts every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    net = fit(docs.where(~held_out))
    return identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
