"""Operator 6, benchmark decontamination: spaced seeds find test passages in training texts, and each hit's surroundings are verified with substitutions allowed.

Method. Tokens are words of letters and digits, lower-cased. A mask slides over the tokens; where it has a 1 the token counts, where it has a 0 any token
does, so a substituted word doesn't hide a passage. The hashes of all test places under every mask are joined with those of all
training places (a bit table sorts out nearly all places, a sorted table of the test hashes gives the rest their places).
A hit fixes a diagonal: training place minus test place. Along it the tokens of both are compared over the whole item, and the
segment with the best score (a match counts MATCH, a difference DIFFER) is the overlap. It's a leak if its matches reach LEAST_TOKENS,
or LEAST_SHARE of the item's tokens, and its identity is LEAST_IDENTITY or more.

The test tokens go to all executors in blocks of about BLOCK_TOKENS tokens, each block in a pass of its own over the training texts: one pass for usual
benchmarks, more for larger ones. A Python worker holds one block's index at a time, made once and not in every task; hits are taken HITS_AT_ONCE at
a time, so a seed that repeats in test and training texts costs time but no memory. Blocks' broadcasts (8 bytes a test token) live until the session drops them.

Result: one row for each document and item with a leak: its best overlap (most matches, then the earliest place), in words of the document.
Edge cases. Null texts, and texts with fewer words than the shortest mask, are never hit and hit nothing. Repeated rows or ids: a row for each
input row pair. Empty tables: no rows. The id columns may have any type.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, once_a_process, ship
from .licenses import WORD_BREAKS

#: The masks, each with seven places that count.
MASKS = ("1111111", "110110111", "11101001011", "1101100010111")
MATCH, DIFFER = 1, 3
LEAST_TOKENS, LEAST_SHARE, LEAST_IDENTITY = 12, 0.7, 0.75
BLOCK_TOKENS, TABLE_BITS, HITS_AT_ONCE = 2_000_000, 24, 1_000_000
#: Words whose hashes a Python worker remembers: some 40 MB.
REMEMBERED = 250_000
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(16)], np.uint64) | np.uint64(1)


class Tokens(dict):
    """Token -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BREAKS).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        total += tokens[at : at + n] * _MIX[k]
    total ^= total >> np.uint64(29)
    return total * _MIX[11]


def _distinct(item: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Distinct rows (item, shift), ascending."""
    order = np.lexsort((shift, item))
    item, shift = item[order], shift[order]
    first = np.ones(len(item), bool)
    first[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
    return np.stack([item[first], shift[first]], 1).astype(np.int64)


class Index:
    """Test places by the hash under each mask."""

    def __init__(self, items: list[np.ndarray], masks: tuple[str, ...] = MASKS):
        self.items, self.masks = items, masks
        self.tables = []
        for mask in masks:
            hashes = [seed_hashes(t, mask) for t in items]
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
            order = np.argsort(every, kind="stable")
            seen = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
            slot = (every >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.bitwise_or.at(seen, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            self.tables.append((every[order], item[order], place[order], seen))

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) rows, ascending; tokens of one text, or of several in a row."""
        found = []
        for mask, (keys, item, place, seen) in zip(self.masks, self.tables, strict=True):
            h = seed_hashes(tokens, mask)
            slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            at = np.flatnonzero(seen[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n, a = high - low, 0
            reached = np.cumsum(n)
            while a < len(n):  # a training place at least, and HITS_AT_ONCE hits or those of one place
                b = max(a + 1, int(np.searchsorted(reached, (reached[a - 1] if a else 0) + HITS_AT_ONCE, "right")))
                own = n[a:b]
                which = np.repeat(low[a:b] - np.cumsum(own) + own, own) + np.arange(own.sum())
                found.append(_distinct(item[which], np.repeat(at[a:b], own) - place[which]))
                if len(found) > 8:
                    found = [_distinct(*np.concatenate(found).T)]
                a = b
        return _distinct(*np.concatenate(found).T) if found else np.zeros((0, 2), np.int64)

    def overlap(self, tokens: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """(matches, first, last + 1) of the best segment along a diagonal, in the text's tokens; None if it's no leak."""
        test = self.items[item]
        a, b = max(0, shift), min(len(tokens), shift + len(test))
        same = tokens[a:b] == test[a - shift : b - shift]
        sums = np.concatenate([[0], np.cumsum(np.where(same, MATCH, -DIFFER))])
        low = np.minimum.accumulate(sums)
        end = int((sums - low).argmax())
        begin = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
        matched = int(same[begin:end].sum())
        if matched < min(LEAST_TOKENS, LEAST_SHARE * len(test)) or matched < LEAST_IDENTITY * (end - begin):
            return None
        return matched, a + begin, a + end


def _blocks(items: DataFrame, text_col: str, id_col: str, block_tokens: int):
    """The items in blocks of bounded size: (ids, token arrays)."""
    sized = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    total = sized.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = max(1, -(-total // (5 * block_tokens)))
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("_text"), F.lit(n)) == k).collect() if total else []
        rows.sort(key=lambda r: (str(r["_id"]), r["_text"]))
        tokens = Tokens()
        yield [r["_id"] for r in rows], [tokens.of(r["_text"]) for r in rows]


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, n_matched, n_item (tokens of the item), first_word, last_word (exclusive), identity."""
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(items.dtypes)[item_id]}, n_matched long, n_item long, first_word long, last_word long, identity double"
    parts = []
    for ids, tokens in _blocks(items, item_text, item_id, block_tokens):
        shipped, name = ship(docs.sparkSession, (ids, tokens)), uuid.uuid4().hex  # 8 bytes a token of the block
        parts.append(by_batch(texts, lambda shipped=shipped, name=name: _scanner(shipped, name), schema))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _scanner(shipped, name: str):
    ids, items, index = _held(shipped, name)
    words = Tokens()

    def do(columns):
        out = {k: [] for k in ("doc_id", "item_id", "n_matched", "n_item", "first_word", "last_word", "identity")}
        texts = [words.of(t) for t in columns["_text"]]
        for key, best in zip(columns["_id"], leaks_of(index, texts), strict=True):
            for item, (matched, first, last) in sorted(best.items()):
                for k, v in zip(out, (key, ids[item], matched, len(items[item]), first, last, matched / (last - first)), strict=True):
                    out[k].append(v)
        return out

    return do


def _held(shipped, name: str) -> tuple:
    """A block's ids, tokens and index, made once in a Python worker."""

    def make():
        ids, items = shipped()
        return ids, items, Index(items)

    return once_a_process("leak-block", make, name)


def leaks_of(index: Index, texts: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
    """For each text: item -> its best overlap."""
    found: list[dict] = [{} for _ in texts]
    starts = np.cumsum([0, *map(len, texts)])
    for item, shift in index.hits(np.concatenate(texts) if texts else np.zeros(0, np.uint64)).tolist():
        # a hit may lie in any text that the item's place on this diagonal touches
        first = max(0, int(np.searchsorted(starts, shift, "right")) - 1)
        for i in range(first, len(texts)):
            if starts[i] >= shift + len(index.items[item]):
                break
            if item in found[i] and found[i][item][0] == len(index.items[item]):
                continue  # a whole item further to the left; diagonals ascend
            own = index.overlap(texts[i], item, shift - int(starts[i]))
            if own and (item not in found[i] or (-own[0], own[1]) < (-found[i][item][0], found[i][item][1])):
                found[i][item] = own
    return found


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without those that hold a leak, with their own columns; no text is shuffled."""
    columns = [c for c, _ in docs.dtypes]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for ids, tokens in _blocks(items, item_text, item_id, block_tokens):
        shipped, name = ship(docs.sparkSession, (ids, tokens)), uuid.uuid4().hex

        def make(shipped=shipped, name=name):
            index, words = _held(shipped, name)[2], Tokens()

            def do(got):
                clean = [not x for x in leaks_of(index, [words.of(t) for t in got[text_col]])]
                return {c: [v for v, ok in zip(got[c], clean, strict=True) if ok] for c in columns}

            return do

        docs = by_batch(docs, make, schema)
    return docs


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
