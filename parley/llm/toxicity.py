"""Operator 8, toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds calibrated by language.

Model. A word (run of letters, lower-cased; numerals that aren't digits count as letters) and its beginnings of PREFIXES letters, which stand for
its stem, are hashed to BUCKETS embeddings of DIM values; their mean is the word's. Then filters over 1, 2 and 3 words (FILTERS of each), a ReLU,
the maximum over the whole text, and a logistic output. One value of each embedding starts as the smoothed log odds in the training texts.
Learning is from a bounded sample: distinct labelled texts, `sample` of each class and SAMPLE_BYTES bytes of each at most, lowest hash of
the text first. Texts with one hash in CALIBRATION_SHARE are never learned from.
Languages. A text's language is told from its own words: the sample's texts and their language column give each word's log odds between languages, and the
sum over a text's words decides (`other` where no word is known).
Calibration. All labelled texts that weren't learned from are counted, over the whole table, by language, raw score (in steps of 1 / STEPS) and class; classes
have the weights that they have among all labelled rows. For each language this gives Platt's two parameters and the threshold with the
best F1; both are folded into the score so that every language's threshold lies at THRESHOLD. Languages with fewer than LEAST_GROUP such texts, or
LEAST_CLASS of a class, use the values over all.

Edge cases. Text null or empty: the score of a text without words. No labelled texts of either class: score 0 for all. Labels that
disagree on an id or a text: toxic if any says so; rows with a null label or id are never learned from but are scored. Null and repeated ids: each row is
scored by itself. Very long texts: whole, in pieces of words. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, saved, ship
from .language import id_crc

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE, DROP, SEED = 2500, 32 << 20, 5, 16, 0.01, 0.15, 11
THRESHOLD, LEAST_GROUP, LEAST_CLASS, CALIBRATION_SHARE = 0.7, 40, 5, 4
STEPS, REACH = 32, 30.0
WORD = re.compile(r"[^\W\d_]+").findall
PREFIXES = (3, 4, 5, 6)
FEATURES = 1 + len(PREFIXES)


def features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings (0, the embedding of nothing, for those that it doesn't have)."""
    found = [word, *(word[:k] + "-" if len(word) > k else "" for k in PREFIXES)]
    return [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if x else 0 for x in found]


class Vocabulary(dict):
    """Word -> row; `table` holds each row's buckets. Forgets all beyond a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.table, self.filled = most, np.zeros((1024, FEATURES), np.uint32), 0

    def __missing__(self, word: str) -> int:
        if self.filled == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row, self.filled = self.filled, self.filled + 1
        self.table[row] = features(word)
        self[word] = row
        return row

    def rows(self, text: str | None) -> np.ndarray:
        words = WORD((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def shrink(self) -> None:
        """Between texts only: rows that were given out no longer hold."""
        if self.filled > self.most:
            self.clear()
            self.filled = 0


class Languages:
    """Log odds of words between the languages of labelled texts."""

    def __init__(self, texts: list[np.ndarray], names: list[str | None]):
        """texts: buckets of words."""
        self.names = sorted({n for n in names if n is not None})
        counts = np.zeros((BUCKETS, len(self.names)), np.float32)
        for words, name in zip(texts, names, strict=True):
            if name is not None and len(words):
                np.add.at(counts[:, self.names.index(name)], np.unique(words), 1)
        held = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
        self.odds = np.where(counts.sum(1, keepdims=True) > 0, held - held.mean(1, keepdims=True) if self.names else 0, 0).astype(np.float32)
        self.odds[0] = 0

    def group(self, rows: np.ndarray) -> int:
        """0: other; else the language's place from 1. rows: the words' log odds."""
        total = rows.sum(0, dtype=np.float64)
        return int(total.argmax()) + 1 if len(rows) and total.any() else 0


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' rows one after the other, with zeros after each so that no filter need span two, and each text's start. A text without words is zeros."""
    pad = np.zeros((WIDTHS[-1], texts[0].shape[1]), texts[0].dtype)
    parts = [x for t in texts for x in (t, pad)]
    return np.concatenate(parts), np.cumsum([0, *(len(t) + len(pad) for t in texts[:-1])])


class WordNet:
    def __init__(self, log_odds: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.words = draw.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.words[:, 0] = log_odds
        self.words[0] = 0
        self.filters = {w: draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = draw.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(0)

    def _convolved(self, embedded: np.ndarray, w: int) -> np.ndarray:
        n = len(embedded) - w + 1
        return sum(embedded[j : j + n] @ self.filters[w][j] for j in range(w)) + self.bias[w]

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        return sum(self.words[buckets[..., k]] for k in range(FEATURES)) / FEATURES

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        (embedded, starts), tops = _laid_out(texts), []
        for w in WIDTHS:
            h = self._convolved(embedded, w)
            ends = np.append(starts[1:], len(embedded)) - w + 1  # places that reach into the next text don't count
            bounds = np.stack([starts, ends], 1).ravel()
            tops.append(np.maximum(np.maximum.reduceat(h, bounds[: -1 if bounds[-1] == len(h) else None], axis=0)[::2], 0))
        return np.concatenate(tops, 1)

    def logits(self, texts: list[np.ndarray], most: int = 60_000) -> np.ndarray:
        """texts: embedded words. Texts go through in groups of about `most` words; a longer text in pieces that overlap by a filter's width, whose maxima are joined."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), most):
                pieces.append(t[max(0, a - WIDTHS[-1] + 1) : a + most])
                owner.append(i)
        found, group, size = [], [], 0
        for p in pieces:
            if group and size + len(p) > most:
                found.append(self.pooled(group))
                group, size = [], 0
            group.append(p)
            size += len(p)
        found.append(self.pooled(group))
        tops = np.maximum.reduceat(np.concatenate(found), np.searchsorted(owner, np.arange(len(texts))), axis=0)
        return tops @ self.out + self.out_bias

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the filters, AdaGrad on the words met; the gradient of the maximum reaches only the words under it. Words are dropped at random."""
        draw = np.random.default_rng(seed)
        dense = [*self.filters.values(), *self.bias.values(), self.out]
        first, second, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
        squares = np.full(BUCKETS, 1e-3, np.float32)
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())).astype(np.float32)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                which = order[at : at + BATCH]
                ids, starts = _laid_out([t[draw.random(len(t)) >= DROP] for t in (texts[i] for i in which)])
                ends = np.append(starts[1:], len(ids))
                embedded, tops, places = self.embedded(ids), [], {}
                for w in WIDTHS:
                    h = self._convolved(embedded, w)
                    places[w] = np.stack([a + h[a : max(a + 1, b - w + 1)].argmax(0) for a, b in zip(starts, ends, strict=True)])
                    tops.append(np.maximum(h[places[w], np.arange(FILTERS)], 0))
                p = np.concatenate(tops, 1)
                z = p @ self.out + self.out_bias
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[which]) * weight[which] / len(which)
                back = np.outer(g, self.out) * (p > 0)
                of_filters, of_bias = [], []
                touched, moved = [], []
                for k, w in enumerate(WIDTHS):
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.zeros_like(self.filters[w])
                    for j in range(w):
                        under = embedded[places[w] + j]  # texts, filters, DIM
                        grad[j] = np.einsum("tf,tfd->df", own, under)
                        touched.append(ids[places[w] + j].ravel())  # each place's FEATURES buckets share its gradient
                        moved.append(np.repeat((own[:, :, None] * self.filters[w][j].T[None]).reshape(-1, DIM) / FEATURES, FEATURES, axis=0))
                    of_filters.append(grad)
                    of_bias.append(own.sum(0))
                step += 1
                for q, grad, a, b in zip(dense, [*of_filters, *of_bias, p.T @ g], first, second, strict=True):
                    a *= 0.9
                    a += 0.1 * grad
                    b *= 0.999
                    b += 0.001 * grad * grad
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                self.out_bias -= np.float32(RATE * g.sum() * 10)
                rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(moved))
                squares[rows] += (total**2).mean(1)
                self.words[rows] -= RATE * total / np.sqrt(squares[rows])[:, None]
                self.words[0] = 0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b) with the least log loss, by damped Newton steps with a small ridge on a; rows: each row's weight."""
    a, b = 1.0, 0.0
    for _ in range(40):
        p = _sigmoid(a * z + b)
        r, w = rows * (p - y), rows * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (r * z).sum() + 0.01 * (a - 1), r.sum()
        haa, hab, hbb = (w * z * z).sum() + 0.01, (w * z).sum(), w.sum() + 1e-6
        d = haa * hbb - hab * hab
        a, b = a - np.clip((hbb * ga - hab * gb) / d, -1, 1), b - np.clip((haa * gb - hab * ga) / d, -2, 2)
    return max(float(a), 1e-3), float(b)


def _threshold(p: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> float:
    """Half-way below the cut with the best F1, within 0.05 and 0.95; hits and misses: weights of the two classes at each p, p descending."""
    found = np.cumsum(hits)
    k = int((2 * found / (found + np.cumsum(misses) + hits.sum())).argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.05, 0.95))


class Network:
    """The convolutional network and the languages; `trained`: 64-bit hashes of the texts learned from."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, names: list[str | None], trained: list[int], epochs: int = EPOCHS):
        """texts: rows of a Vocabulary's table, for each word one."""
        self.trained = trained
        seen = np.zeros((2, BUCKETS), np.float32)
        for words, label in zip(texts, labels, strict=True):
            seen[label, np.unique(words)] += 1
        n = [max(1, int((labels == c).sum())) for c in (0, 1)]
        odds = np.log((seen[1] + 2 * n[1] / sum(n)) / n[1]) - np.log((seen[0] + 2 * n[0] / sum(n)) / n[0])
        self.net = WordNet((np.where(seen.sum(0) >= 3, odds, 0) / 2).astype(np.float32))
        self.net.train(texts, labels.astype(np.float32), epochs)
        self.languages = Languages([t[:, 0] for t in texts], names)

    def raw(self, texts: list[str | None], words: Vocabulary) -> tuple[np.ndarray, list[int]]:
        """Raw scores (log odds before calibration) and language groups."""
        rows = [words.rows(t) for t in texts]
        table = words.table[: words.filled]
        odds = self.languages.odds[table[:, 0]]
        embedded = self.net.embedded(table) if 4 * len(table) < sum(map(len, rows)) else None
        z = self.net.logits([embedded[r] if embedded is not None else self.net.embedded(table[r]) for r in rows])
        groups = [self.languages.group(odds[r]) for r in rows]
        words.shrink()
        return z, groups


class Classifier:
    """Network and calibration: score = sigmoid(a z + b), with a and b of the text's language (row 0: other)."""

    def __init__(self, network: Network, shift: np.ndarray):
        self.network, self.shift = network, shift

    def scores(self, texts: list[str | None], words: Vocabulary) -> np.ndarray:
        z, groups = self.network.raw(texts, words)
        a, b = self.shift[groups].T
        return _sigmoid(a * z + b)


def _known(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """One row for each labelled id: _id, _label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    return known.where(F.col("_label").isin(0, 1))


def _hash(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", lang_col: str | None = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network from a bounded sample of labelled texts; None without labelled texts of both classes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("_id"), _hash(text).alias("_hash"), F.octet_length(text).alias("_bytes"))
    once = slim.join(_known(labels, label_col, id_col), "_id").groupBy("_hash").agg(F.max("_label").alias("_label"), F.max("_bytes").alias("_bytes"))
    once = saved(once.where(F.pmod("_hash", F.lit(CALIBRATION_SHARE)) != 0), "labelled")
    chosen = {}
    for label in (0, 1):
        room = sample_bytes
        for r in once.where(F.col("_label") == label).orderBy(F.xxhash64("_hash", F.lit(SEED)), "_hash").limit(sample).collect():
            room -= r["_bytes"]
            if room < 0 and label in chosen.values():
                break
            chosen[r["_hash"]] = label
    if len(set(chosen.values())) < 2:
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in chosen], "_hash long"))  # 2 * sample numbers at most
    rows = docs.select(_hash(text).alias("_hash"), text.alias("_text"), lang.alias("_lang")).join(picked, "_hash")
    rows = rows.groupBy("_hash").agg(F.min(F.struct("_lang", "_text")).alias("r")).select("_hash", "r.*").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["_text"].encode("utf-8", "surrogatepass")), r["_text"]))
    words = Vocabulary(1 << 40)
    numbered = [words.rows(r["_text"]) for r in rows]
    return Network([words.table[r] for r in numbered], np.array([chosen[r["_hash"]] for r in rows]), [r["_lang"] for r in rows], sorted(chosen))


def raw_scores(docs: DataFrame, network: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, hash of the text, raw score and language group of every row."""
    shipped = ship(docs.sparkSession, network)  # BUCKETS * (DIM + languages) floats: some 6 MB

    def make():
        words, found = Vocabulary(), shipped()

        def do(columns):
            z, groups = found.raw(columns["_text"], words)
            return {"doc_id": columns["_id"], "hash": columns["_hash"], "z": z, "group": groups}

        return do

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), _hash(docs[text_col]).alias("_hash"))
    return by_batch(rows, make, f"doc_id {dict(docs.dtypes)[id_col]}, hash long, z double, group int")


def calibrate(raw: DataFrame, labels: DataFrame, network: Network, label_col: str = "toxic", id_col: str = "doc_id") -> np.ndarray:
    """a and b of each group, from raw_scores() (best saved) of the whole table. The driver gets a row for each group, step of the score and class."""
    trained = raw.sparkSession.createDataFrame([(h, True) for h in network.trained], "hash long, trained boolean")
    step = F.round(F.least(F.greatest(F.col("z"), F.lit(-REACH)), F.lit(REACH)) * STEPS).cast("int")
    joined = raw.join(_known(labels, label_col, id_col), F.col("doc_id") == F.col("_id")).join(F.broadcast(trained), "hash", "left")
    counted = joined.groupBy("group", step.alias("step"), F.col("_label").alias("label"), F.col("trained").isNotNull().alias("trained")).count().collect()
    return shifts([(r["group"], r["step"] / STEPS, r["label"], r["trained"], r["count"]) for r in counted], len(network.languages.names) + 1)


def shifts(counted: list[tuple], n_groups: int) -> np.ndarray:
    """counted: (group, raw score, label, learned from, rows). Rows learned from count for the classes' weights alone."""
    out = np.zeros((n_groups, 2))
    out[:, 0] = 1.0
    every = np.zeros(2)
    held = np.zeros(2)
    for _, _, label, learned, n in counted:
        every[label] += n
        held[label] += 0 if learned else n
    weights = every / np.maximum(held, 1)
    for g in [-1, *range(n_groups)]:
        own = sorted((z, y, n) for group, z, y, learned, n in counted if not learned and g in (-1, group))
        of_class = [sum(n for _, y, n in own if y == c) for c in (0, 1)]
        if min(of_class) < (LEAST_CLASS if g >= 0 else 1) or sum(of_class) < (LEAST_GROUP if g >= 0 else 2):
            continue
        z, y, rows = (np.array(x, float) for x in zip(*own, strict=True))
        rows = rows * np.where(y == 1, weights[1], weights[0])
        a, b = _platt(z, y, rows)
        places, inverse = np.unique(-z, return_inverse=True)
        t = _threshold(_sigmoid(-a * places + b), np.bincount(inverse, rows * y), np.bincount(inverse, rows * (1 - y)))
        out[slice(None) if g < 0 else g] = a, b - np.log(t / (1 - t)) + np.log(THRESHOLD / (1 - THRESHOLD))
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", lang_col: str | None = "lang", sample: int = SAMPLE) -> Classifier | None:
    network = train(docs, labels, label_col, text_col, id_col, lang_col, sample)
    return network and Classifier(network, calibrate(raw_scores(docs, network, text_col, id_col), labels, network, label_col, id_col))


def _calibrated(raw: DataFrame, shift: np.ndarray) -> DataFrame:
    a, b = (F.element_at(F.array(*(F.lit(float(x)) for x in column)), F.col("group") + 1) for column in shift.T)
    odds = F.least(F.greatest(a * F.col("z") + b, F.lit(-40.0)), F.lit(40.0))
    return raw.select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"))


def score_toxicity(docs: DataFrame, model: Classifier | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    return _calibrated(raw_scores(docs, model.network, text_col, id_col), model.shift)


def op8(spark, sf_dir: str) -> DataFrame:
    """Learns from labels where crc32(doc_id) mod 3 is not 1; scores every document, in one pass that calibration reads as well."""
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc("doc_id") % 3 == 1
    own = labels.where(~held_out)
    network = train(docs, own)
    if network is None:
        scored = score_toxicity(docs, None)
    else:
        raw = saved(raw_scores(docs, network), "toxicity")
        scored = _calibrated(raw, calibrate(raw, own, network))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
