"""Operator 3, token files: token ids of documents in raw binary shards, with a minimal perfect hash index from document key to place.

Files, in one folder of the shared storage. `manifest.json`: format, ids' width, shards with their file, number of documents and ids,
and the number of ids before them. `shard-N.ids`: the ids of the shard's documents, one after the other, little-endian unsigned
integers of 2 bytes (4 if the vocabulary has more than 65,536 ids), nothing else. `shard-N.index`: the documents' keys and offsets in
the shard's order, and a minimal perfect hash function over the shard's distinct keys (bit arrays by level with counts of the ones before each word; a key that is alone at
its place in a level's array belongs there, the others go on to the next level), whose slots hold a 32-bit fingerprint of the
key, its first document and its number of documents. A look-up takes the shard by bisection of the manifest's first keys, one slot, one comparison of fingerprints
(a foreign key passes with probability 2**-32, and is then told by the stored key) and one read of the ids.

Order. Shards ascend by key and so do documents in them; a key's rows stand together, within a shard by a hash of their ids. Null keys come first. A key with
more than a shard's rows is dealt over several shards row by row, whatever its texts. Keys may be whole numbers, strings, dates, decimals, binary
or boolean (KEY_TYPES); others raise TypeError and are to be cast.

Size. A shard has about `shard_rows` rows at every size of the table, so the manifest has a line for each; ids go to the file as they come, and a task holds
no more than its shard's keys and offsets. The driver draws some KEYS_A_SHARD keys for each shard (KEYS_LEAST in all at least) to place the shards' bounds; all rows are written.

Encoding. The ids are those of encode(text, add_special_tokens=False). Stretches of text between spaces go through the tokenizers library once while a
worker remembers them (see Encoder).

Recovery. A shard is written to a name of its own attempt and then renamed, so a repeated or doubled task leaves whole files with equal content.

Edge cases. Text null or empty: the end id alone. Repeated rows and keys: each row has its own ids. Empty table: no shards. Very long texts: whole.
"""

from __future__ import annotations

import bisect
import datetime
import decimal
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, file_system, fresh_dir, once_a_process, pieces, ship
from .near_copies import mix

END_ID = 2
SHARD_ROWS, KEYS_A_SHARD, KEYS_LEAST = 16_384, 20, 4_000
#: Bounds of the encoder's memory: bytes of text split at a time, stretches remembered in a generation, their length, and how many
#: go through the library together.
PART_BYTES, STRETCHES_KEPT, STRETCH_KEPT, AT_ONCE = 6 << 20, 500_000, 100, 200
READ_BYTES = 8 << 20
GAMMA, LEVELS = 1.6, 40
_U = np.uint64


def hashed(keys: list) -> np.ndarray:
    """64-bit hashes of integer, string or null keys."""
    import xxhash

    if all(type(k) is int for k in keys):
        return mix(np.array(keys, np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
    return np.array([int(mix(np.array([k], np.int64).view(_U) + _U(0x9E3779B97F4A7C15))[0]) if type(k) is int else xxhash.xxh64_intdigest(f"{type(k).__name__}:{k}") for k in keys], _U)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: slot(values) is a bijection onto 0..n-1."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    @classmethod
    def of(cls, values: np.ndarray) -> PerfectHash:
        levels, before = [], 0
        for level in range(LEVELS):
            if not len(values):
                break
            size = -(-max(64, int(GAMMA * len(values))) // 64) * 64
            place = cls._place(values, level, size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            values = values[~alone[place]]
        return cls(levels, np.sort(values))

    @staticmethod
    def _place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(values ^ mix(np.array([level + 1], _U))) % _U(size)).astype(np.int64)

    def slot(self, values: np.ndarray) -> np.ndarray:
        """-1 for values that surely aren't among those it was made of."""
        out, todo = np.full(len(values), -1, np.int64), np.arange(len(values))
        for level, (size, words, before) in enumerate(self.levels):
            place = self._place(values[todo], level, size)
            word, bit = words[place >> 6], (place & 63).astype(_U)
            here = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[todo[here]] = (before[place >> 6] + below)[here]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, values[todo]), len(self.rest) - 1)
            known = self.rest[at] == values[todo]
            size, words, before = self.levels[-1]
            out[todo[known]] = int(before[-1]) + int(np.bitwise_count(words[-1])) + at[known]
        return out


def index_bytes(keys: list, offsets: np.ndarray) -> bytes:
    """keys: of the shard's documents, equal ones together; offsets: their first ids, and the number of all."""
    firsts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    values = hashed([keys[i] for i in firsts])
    perfect = PerfectHash.of(values)
    slots = perfect.slot(values)
    first, count, prints = (np.zeros(len(firsts), t) for t in (np.uint32, np.uint32, np.uint32))
    first[slots], count[slots] = firsts, np.diff([*firsts, len(keys)])
    prints[slots] = fingerprints(values)
    arrays = {"offsets": offsets.astype(np.uint64), "first": first, "count": count, "prints": prints, "rest": perfect.rest, "sizes": np.array([s for s, _, _ in perfect.levels], np.int64)}
    arrays |= {f"bits{i}": w for i, (_, w, _) in enumerate(perfect.levels)} | {f"before{i}": b.astype(np.uint32) for i, (_, _, b) in enumerate(perfect.levels)}
    arrays["keys"] = np.frombuffer(json.dumps(list(map(plain, keys))).encode(), np.uint8)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def fingerprints(values: np.ndarray) -> np.ndarray:
    return (mix(values + _U(0x632BE59BD9B4E019)) >> _U(32)).astype(np.uint32)


class Index:
    def __init__(self, data: bytes):
        got = dict(np.load(io.BytesIO(data)))
        self.offsets, self.first, self.count, self.prints = (got[k] for k in ("offsets", "first", "count", "prints"))
        self.keys = list(map(typed, json.loads(got["keys"].tobytes())))
        self.perfect = PerfectHash([(int(s), got[f"bits{i}"], got[f"before{i}"].astype(np.int64)) for i, s in enumerate(got["sizes"])], got["rest"])

    def documents(self, keys: list) -> list[range]:
        """For each key its documents' numbers in the shard."""
        values = hashed(keys)
        slots = self.perfect.slot(values)
        held = (slots >= 0) & (self.prints[slots] == fingerprints(values)) if len(self.prints) else np.zeros(len(keys), bool)
        return [range(f, f + int(self.count[s])) if ok and self.keys[f := int(self.first[s])] == k else range(0) for k, s, ok in zip(keys, slots, held, strict=True)]


class TokenFiles:
    """Keyed access to a folder of shards."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.manifest = json.loads(self._read("manifest.json"))
        self.type = np.dtype(f"<u{self.manifest['width']}")
        self._starts = [sort_key(typed(s["first_key"])) for s in self.manifest["shards"]]
        self._indexes: dict[int, Index] = {}

    def _read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            f.seek(start)
            return f.read(length)

    def get(self, key) -> list[np.ndarray]:
        """The ids of every document with this key."""
        found = []
        at = max(0, bisect.bisect_right(self._starts, sort_key(key)) - 1)
        while at > 0 and self._starts[at] == sort_key(key):  # a key may go over several shards
            at -= 1
        for n in range(at, len(self._starts)):
            if self._starts[n] > sort_key(key):
                break
            shard = self.manifest["shards"][n]
            if n not in self._indexes:
                self._indexes[n] = Index(self._read(shard["file"] + ".index"))
            index = self._indexes[n]
            for i in index.documents([key])[0]:
                a, b = int(index.offsets[i]), int(index.offsets[i + 1])
                found.append(np.frombuffer(self._read(shard["file"] + ".ids", a * self.type.itemsize, (b - a) * self.type.itemsize), self.type))
        return found


def sort_key(key) -> tuple:
    return key is not None, key if key is not None else 0


def plain(key):
    """A key as JSON holds it: types that JSON lacks by name and text."""
    for kind, name in _KINDS.items():
        if type(key) is kind:
            return {name: key.hex() if kind is bytes else str(key) if kind is decimal.Decimal else key.isoformat()}
    return key


def typed(key):
    """plain() undone."""
    if not isinstance(key, dict):
        return key
    ((name, text),) = key.items()
    return {"bytes": bytes.fromhex, "decimal": decimal.Decimal, "date": datetime.date.fromisoformat}[name](text)


_KINDS = {bytes: "bytes", decimal.Decimal: "decimal", datetime.date: "date"}
KEY_TYPES = ("tinyint", "smallint", "int", "bigint", "string", "date", "decimal", "binary", "boolean")


# Fixed value: the character that stands for a space in a byte-level vocabulary.
SHOWN_SPACE = "\u0120"
#: In Encoder.known: a stretch that isn't one.
NONE = 0


class Encoder:
    """Texts to ids with one tokenizer, given as the text of its file.

    A byte-level tokenizer splits before a space that stands alone between other characters, whatever these are, so what lies between two such spaces has ids
    of its own. In a part of the texts each distinct stretch is looked up once and its ids are laid out at all its places.
    Stretches are remembered, in two generations: those in use stay. New ones go through the library many at a time, with a space before each: the ids
    whose tokens begin with a space tell where each begins. Texts with spaces beside other white space, and texts for other tokenizers, go through it whole."""

    def __init__(self, tokenizer_json: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer, source = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
        byte_level = source["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # a special token within a stretch stays there, unless it takes white space or what stands around it into account
        inner = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in source["added_tokens"])
        self.by_stretch = byte_level and inner and not source["normalizer"] and not source["post_processor"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SHOWN_SPACE)]] = True
        self.type = np.dtype(f"<u{width}")
        self.end = np.array([END_ID], self.type).tobytes()
        self.known: dict = {}
        self.older: dict = {}

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of texts (strings or nulls) with the end id, as bytes."""
        texts = pc.fill_null(texts, "")
        if not self.by_stretch:
            return pa.array([self._whole(t) + self.end for t in texts.to_pylist()], pa.binary())
        reached = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out, a = [pa.array([], pa.binary())], 0
        while a < len(texts):  # a text at least, and PART_BYTES or those of one text
            b = max(a + 1, int(np.searchsorted(reached, (reached[a - 1] if a else 0) + PART_BYTES, "right")))
            out.append(self._part(texts.slice(a, b - a)))
            a = b
        return pa.concat_arrays(out)

    def _part(self, texts: pa.Array) -> pa.Array:
        """Each distinct stretch is looked up once; its ids are then laid out at all its places."""
        n, numbers = len(texts), np.arange(len(texts))
        split = pc.split_pattern(texts, " ")
        bounds, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            for i, x in zip(lacking, self._learn([words[i] for i in lacking]), strict=True):
                found[i] = x
        owner = np.repeat(numbers, np.diff(bounds))
        firsts = [words[i] for i in index[bounds[:-1]]]  # they have no space before them
        whole = np.array([_open(x) for x in firsts], bool) & (np.diff(bounds) > 1)
        if none := [i for i, x in enumerate(found) if x is NONE]:
            places = np.flatnonzero(np.isin(index, none))
            whole[owner[np.setdiff1d(places, bounds[:-1])]] = True
        heads = [self._whole(texts[i].as_py() if whole[i] else firsts[i]) for i in range(n)]
        entries = [x or b"" for x in found] + heads + [self.end, b""]
        data, sizes = np.frombuffer(b"".join(entries), self.type), np.fromiter(map(len, entries), np.int64, len(entries)) // self.type.itemsize
        starts = np.cumsum(sizes) - sizes
        # each text is its head, its other stretches and the end; a text that went through whole is its head and the end
        line = np.empty(len(index) + n, np.int64)
        line[np.arange(len(index)) + owner] = np.where(whole[owner], len(entries) - 1, index)
        line[bounds[:-1] + numbers], line[bounds[1:] + numbers] = len(words) + numbers, len(entries) - 2
        own = sizes[line]
        ends = np.cumsum(own)
        near = np.int32 if max(len(data), int(ends[-1])) < 1 << 30 else np.int64
        ids = data[np.repeat((starts[line] - (ends - own)).astype(near), own) + np.arange(ends[-1], dtype=near)]
        offsets = np.concatenate([[0], ends[bounds[1:] + numbers]]) * self.type.itemsize
        if len(self.known) > STRETCHES_KEPT:
            self.known, self.older = {}, self.known
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])

    def _learn(self, new: list[str]) -> list:
        """Ids of distinct stretches with the space before them; NONE for those that are empty or have white space at an end. Remembers them but the longest."""
        got = list(map(self.older.get, new))
        lacking = [i for i, x in enumerate(got) if x is None]
        if lacking:
            made = self._made([new[i] for i in lacking])
            for i, x in zip(lacking, made, strict=True):
                got[i] = x
        if sum(map(len, new)) > STRETCH_KEPT * len(new) or max(map(len, new)) > STRETCH_KEPT:
            self.known.update((x, ids) for x, ids in zip(new, got, strict=True) if len(x) <= STRETCH_KEPT)
        else:
            self.known.update(zip(new, got, strict=True))
        return got

    def _made(self, new: list[str]) -> list:
        got = [NONE if _open(x) else None for x in new]
        clean = [x for x, none in zip(new, got, strict=True) if none is None]
        blocks = [clean[a : a + AT_ONCE] for a in range(0, len(clean), AT_ONCE)]
        made = []
        for block, coded in zip(blocks, self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in blocks], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids)
            places = np.flatnonzero(self.opens[ids])
            if len(places) == len(block) and not places[0]:
                data, at = ids.astype(self.type).tobytes(), (places * self.type.itemsize).tolist()
                made += map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))
            else:
                made += [self._whole(" " + x) for x in block]
        found = iter(made)
        return [next(found) if x is None else x for x in got]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes() if text else b""


def _open(stretch: str) -> bool:
    """Whether white space at an end, or nothing, makes a stretch depend on what stands beside it."""
    return not stretch or stretch[0].isspace() or stretch[-1].isspace()


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None, text_col: str = "text", id_col: str = "doc_id", shard_rows: int = SHARD_ROWS) -> str:
    """Writes documents' ids as described above; returns the folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's copy goes to the executors
        tokenizer_json = f.read()
    width = 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True) <= 65_536 else 4
    source, name = ship(spark, tokenizer_json), zlib.crc32(tokenizer_json.encode())
    total = docs.count()
    n_shards = -(-total // shard_rows)
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("_text"))
    key_type = dict(keyed.dtypes)["key"]
    if key_type.partition("(")[0] not in KEY_TYPES:
        raise TypeError(f"keys of type {key_type} have no place in token files: cast them")
    # keys with more rows than a shard: fewer than there are shards
    hot = {r["key"]: -(-r["count"] // shard_rows) for r in keyed.groupBy("key").count().where(F.col("count") > shard_rows).collect()}
    if hot:
        parts = spark.createDataFrame(list(hot.items()), f"_hot {key_type}, parts long")
        keyed = keyed.join(F.broadcast(parts), F.col("key").eqNullSafe(F.col("_hot")), "left")
        keyed = keyed.withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), "parts"), F.lit(0)).cast("int")).drop("_hot", "parts")
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    wanted = max(KEYS_A_SHARD * n_shards, KEYS_LEAST)
    lot = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 40))
    drawn = docs.select(F.col(id_col).alias("key")).where(lot < F.lit(min(1 << 40, (wanted << 40) // max(1, total)))).collect() if n_shards > 1 else []
    drawn = sorted((*sort_key(r["key"]), 0) for r in drawn)
    bounds = sorted({*(drawn[len(drawn) * k // n_shards] for k in range(1, n_shards) if drawn), *((*sort_key(k), p) for k, n in hot.items() for p in range(n))})
    places = _numbers_of_partitions(spark, len(bounds) + 1)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_a_process("encoder", lambda: Encoder(source(), width), f"{name}-{width}")
        for batch in batches:
            for part in pieces(batch):
                key, numbers, texts = part.columns
                shard = [bisect.bisect_right(bounds, (*sort_key(k), p)) for k, p in zip(key.to_pylist(), numbers.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([places[x] for x in shard], pa.int32()), pa.array(shard, pa.int32()), key, encoder(texts)], ["place", "shard", "key", "ids"])

    rows = keyed.select("key", "part", "_text").mapInArrow(encoded, f"place int, shard int, key {key_type}, ids binary")
    dealt = rows.repartition(len(places), "place").sortWithinPartitions("shard", "key", F.xxhash64("ids")).select("shard", "key", "ids")
    written = dealt.mapInArrow(lambda batches: _write_shards(batches, folder, width), "shard int, file string, n_docs long, n_ids long, first_key string").collect()
    before, shards = 0, []
    for r in sorted(written, key=lambda r: r["shard"]):
        shards.append({"file": r["file"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "before": before, "first_key": json.loads(r["first_key"])})
        before += r["n_ids"]
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"format": "parley-token-files-1", "width": width, "end_id": END_ID, "tokenizer": tokenizer_file.rpartition("/")[2], "key_type": key_type, "shards": shards}).encode())
    return folder


def _numbers_of_partitions(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning puts there, so that each shard has a task of its own."""
    numbers = spark.range(40 * n + 100).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(n)).alias("p"))
    found = {r["p"]: r["i"] for r in numbers.groupBy("p").agg(F.min("i").alias("i")).collect()}
    return [found.get(p, p) for p in range(n)]


class _Shard:
    """One shard being written: ids go to the file as they come."""

    def __init__(self, number: int, folder: str, width: int):
        self.fs, self.path = file_system(folder)
        self.number, self.width, self.name = number, width, f"shard-{number:06d}"
        self.keys, self.sizes = [], [0]
        self.own = f"{self.path}/{self.name}.ids.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.own)

    def add(self, key, ids: bytes) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids) // self.width)
        self.file.write(ids)

    def finished(self) -> dict:
        self.file.close()
        self.fs.move(self.own, f"{self.path}/{self.name}.ids")
        offsets = np.cumsum(self.sizes)
        index = f"{self.path}/{self.name}.index.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(index) as f:
            f.write(index_bytes(self.keys, offsets))
        self.fs.move(index, f"{self.path}/{self.name}.index")
        return {"shard": self.number, "file": self.name, "n_docs": len(self.keys), "n_ids": int(offsets[-1]), "first_key": json.dumps(plain(self.keys[0]))}


def _write_shards(batches: Iterator, folder: str, width: int) -> Iterator:
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.string())])
    shard = None
    for batch in batches:
        for part in pieces(batch):
            for number, key, ids in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if shard is None or number != shard.number:
                    if shard is not None:
                        yield pa.RecordBatch.from_pylist([shard.finished()], schema)
                    shard = _Shard(number, folder, width)
                shard.add(key, ids)
    if shard is not None:
        yield pa.RecordBatch.from_pylist([shard.finished()], schema)


def read_token_files(spark: SparkSession, folder: str, key_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files; places come from the hash index."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    key_type, width = manifest.get("key_type", key_type), manifest["width"]
    shards = [(s["file"], s["before"]) for s in manifest["shards"]]

    def make():
        def do(columns):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            own, at = file_system(folder)
            for name, before in zip(columns["file"], columns["before"], strict=True):
                with own.open_input_file(f"{at}/{name}.index") as f:
                    index = Index(f.read())
                distinct = list(dict.fromkeys(index.keys))
                with own.open_input_file(f"{at}/{name}.ids") as f:
                    held, first = b"", 0  # bytes of the file from its first on
                    for key, places in zip(distinct, index.documents(distinct), strict=True):
                        for i in places:
                            a, b = int(index.offsets[i]), int(index.offsets[i + 1])
                            if b * width > first + len(held):
                                first = a * width
                                f.seek(first)
                                held = f.read(max(READ_BYTES, (b - a) * width))
                            ids = np.frombuffer(held, f"<u{width}", b - a, a * width - first)
                            for k, v in zip(out, (key, before + a, b - a, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                                out[k].append(v)
            return out

        return do

    listed = spark.createDataFrame(shards, "file string, before long").repartition(max(1, len(shards) // 2))
    return by_batch(listed, make, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def op3(spark, sf_dir: str) -> DataFrame:
    """Encodes, writes and reads back all documents."""
    import public_tokenizers

    from .common import table

    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
