"""Operator 5, near copies: BagMinHash signatures of word-shingle multisets, banded, verified by exact weighted Jaccard, joined into classes.

Signature. A text's shingles (WORDS words, lower-cased, counted) are elements with integer weights. Weight is cut into the
intervals [0,1), [1,2), [2,4), [4,8), ...; on each (element, interval) runs a Poisson process whose points have a time, a component and
a height in the interval, all from hashes of the element, so texts that share an element share its points. A point counts below the element's weight: whole
intervals count all of theirs, the topmost one is thinned by height, so an element costs O(log weight) processes. A component's value is its earliest
point. Two texts agree in a component with probability sum(min)/sum(max), the weighted Jaccard similarity, without bias. Points
are made up to a time by which all components are expected to be filled; texts with one still empty are done again with twice the time.

Classes.
1. Texts that are equal are one node (md5 of the text), whatever their number; from here on only nodes count.
2. BANDS bands of ROWS components give bucket keys. A bucket's hub is its member with the most company over all its buckets (near copies of one
   original agree with it more than with each other). Each member is verified against its buckets' hubs: linear in members. A hub of very many is
   dealt over tasks.
3. Links give components. A bucket is open while it has members outside its hub's component. Their signatures alone are compared with those of
   the bucket's other members, in blocks; each outside member is then verified against the one it agrees with most. Where it has
   more likely partners in other components after that, these and it, and no others, meet with their texts in blocks and are compared until no
   two components are left that a link could join; texts that share several buckets are compared in that with the least key. No group is gathered
   in one task, no pairs are emitted but each outside member's best. Outside members are cut into PARTS blocks at most, and a block has at least
   as many members as outside ones, so a bucket's blocks have (2 * PARTS + 1) * (members) rows at most, however large it is.
   Buckets with the same members are done once. The work is (members outside) * (members) comparisons of signatures, only in open buckets.
4. Links of all rounds give the classes; a class's keeper is its smallest (doc_id, md5, number of the row).

What can be missed. A pair at similarity SIMILAR exactly shares no band with probability (1 - SIMILAR ** ROWS) ** BANDS, 5e-5, and less above it; signatures
of such a pair agree in fewer than LIKELY components with probability MISS at most. Pairs that share a band and agree so are compared exactly.

Texts and ids are broadcast only up to a checked number of rows, and shuffled beyond it; rows of texts or hubs that are very frequent then
get their few values by a broadcast of HOT_MOST rows at most, so no task gets all of them.

Edge cases. Text null: a class of its own for each row. No words: no shingles, so equal only to the same text. Fewer words than WORDS:
one shingle of all of them. Repeated rows and ids: rows with one text are in one class; a row is named by its id and text together, and of rows
that repeat both, one is kept. Null id: like any id, smallest. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, saved

WORDS, SIMILAR = 5, 0.8
COMPONENTS, BANDS, ROWS = 128, 25, 5
#: Probability that the signatures of a similar pair agree in fewer than LIKELY components.
MISS = 1e-9


def _likely(miss: float) -> int:
    total, k = 0.0, -1
    while total <= miss:
        k += 1
        total += math.comb(COMPONENTS, k) * SIMILAR**k * (1 - SIMILAR) ** (COMPONENTS - k)
    return k


LIKELY = _likely(MISS)
#: Rows that a broadcast may have: 16-byte keys, some 20 MB.
BROADCAST_ROWS = 250_000
#: A key is hot with more than HOT_ROWS rows, and more than one row in HOT_MOST of all: so there are HOT_MOST at most.
HOT_ROWS, HOT_MOST = 100_000, 100_000
#: Members of a bucket that meet their hub's text in one task.
HUB_ROWS = 20_000
OUTSIDE_BLOCK, MEMBER_BLOCK = 64, 256
#: Blocks that a bucket's outside members are cut into at most: beyond PARTS * OUTSIDE_BLOCK of them blocks grow, not the copies of rows.
PARTS = 2
#: Shingles of members that are compared with an outside row at once: some 20 MB.
SHINGLES_AT_ONCE = 1 << 19
AT_ONCE = 250
#: Words whose hashes a Python worker remembers: some 40 MB.
REMEMBERED = 250_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingles(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    split = (text or "").lower().split()
    h = np.fromiter(map(words.__getitem__, split), _U, len(split))
    if not len(h):
        return h, np.zeros(0, np.int64)
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, _U)
    for j in range(k):
        total += h[j : j + n] * _ODD[j]
        total = mix(total)
    return np.unique(total, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int(np.minimum(n, m[at])[y[at] == x].sum())
    return both / (int(n.sum()) + int(m.sum()) - both)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], components: int = COMPONENTS) -> np.ndarray:
    """[bags, components] ids of each component's earliest point; 0 for empty bags."""
    out = np.zeros((len(bags), components), _U)
    todo = np.array([i for i, (x, _) in enumerate(bags) if len(x)], np.int64)
    slack = 4.0
    while len(todo):
        ids, filled = _earliest([bags[i] for i in todo], components, slack)
        out[todo[filled]] = ids[filled]
        todo = todo[~filled]
        slack = 2 * slack + np.log(components)
    return out


def _earliest(bags: list, components: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x, _ in bags]
    bag = np.repeat(np.arange(len(bags)), sizes)
    element, weight = np.concatenate([x for x, _ in bags]), np.concatenate([w for _, w in bags])
    until = (np.log(components) + slack) / np.array([w.sum() for _, w in bags], np.float64)
    best, found = np.full(len(bags) * components, np.inf), np.zeros(len(bags) * components, _U)
    low, level = 0, 0
    while len(element):
        high = max(1, 2 * low)
        seed, time, own, cap = mix(element ^ mix(np.array([level + 1], _U))), np.zeros(len(element)), bag, weight
        step = 0
        while len(seed):
            step += 1
            point = mix(seed + np.array([step], _U) * _ODD[0])
            time = time - np.log1p(-(point >> _U(11)).astype(np.float64) * 2.0**-53) / ((high - low) * components)
            live = time <= until[own]
            seed, time, own, cap, point = seed[live], time[live], own[live], cap[live], point[live]
            place = own * components + (mix(point ^ _ODD[1]) % _U(components)).astype(np.int64)
            if high - low > 1:
                under = low + (mix(point ^ _ODD[2]) % _U(high - low)).astype(np.int64) < cap
                place, at, name = place[under], time[under], point[under]
            else:
                at, name = time, point
            np.minimum.at(best, place, at)
            first = at == best[place]
            found[place[first]] = name[first]
        more = weight > high
        element, weight, bag = element[more], weight[more], bag[more]
        low, level = high, level + 1
    return found.reshape(len(bags), components), np.isfinite(best.reshape(len(bags), components)).all(1)


def band_keys(points: np.ndarray) -> np.ndarray:
    """[texts, BANDS] signed 64-bit keys; a band's number is part of its key."""
    parts = points[:, : BANDS * ROWS].reshape(len(points), BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(1), parts.shape[:2]).copy()
    for j in range(ROWS):
        total = mix(total * _ODD[4] + parts[:, :, j])
    return total.view(np.int64)


def text_key(text) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, row (a number), node (md5 of the text), bands (keys; empty without words), signature (two bytes a component)."""

    def make():
        words = Words()

        def do(columns):
            first: dict = {}
            for i, node in enumerate(columns["node"]):
                first.setdefault(node, i)
            places = {node: k for k, node in enumerate(first)}
            texts = [columns["_text"][i] for i in first.values()]
            bands, short = [], []
            for a in range(0, len(texts), AT_ONCE):
                bags = [shingles(t, words) for t in texts[a : a + AT_ONCE]]
                points = bag_min_hash(bags)
                keys = band_keys(points)
                bands += [keys[k].tolist() if len(x) else [] for k, (x, _) in enumerate(bags)]
                short += [row.tobytes() for row in (points & _U(0xFFFF)).astype(np.uint16)]
            at = [places[node] for node in columns["node"]]
            return {"id": columns["_id"], "row": columns["_row"], "node": columns["node"], "bands": [bands[k] for k in at], "signature": [short[k] for k in at]}

        return do

    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("_text"))
    return by_batch(known, make, f"id {dict(docs.dtypes)[id_col]}, row long, node binary, bands array<long>, signature binary")


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The hot values of key (see HOT_ROWS), saved; None if there are none."""
    least = max(HOT_ROWS, rows.count() // HOT_MOST)
    found = saved(rows.groupBy(key).count().where(F.col("count") > least).select(key), "hot")
    return found if found.limit(1).count() else None


def join_values(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows with the values (one row a key) of their key; rows of hot keys stay where they are and get theirs by broadcast."""
    if hot is None:
        return rows.join(values, key)
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = values.join(F.broadcast(hot), key, "left_semi")
    return flagged.where("_hot is null").drop("_hot").join(values, key).unionByName(flagged.where("_hot").drop("_hot").join(F.broadcast(few), key))


def hub_pairs(members: DataFrame) -> DataFrame:
    """members: key, node, n (of the bucket). -> each bucket's hub: key, hub."""
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).getField("node").alias("hub"))
    return saved(hubs, "hubs")


def texts_of(docs: DataFrame, nodes: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """node and text of the given nodes (node, id: that of one of its rows), once each."""
    few = nodes.count() <= BROADCAST_ROWS
    every = docs.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("node"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    asked = nodes.select(F.col("node").alias("_node"), F.col("id").alias("_asked"))
    found = every.join(F.broadcast(asked) if few else asked, (every["node"] == asked["_node"]) & every["_id"].eqNullSafe(asked["_asked"]), "left_semi")
    return saved(found.groupBy("node").agg(F.max("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of pairs (a, b, n: rows that b may have here) whose texts are similar."""

    def make():
        words = Words()

        def do(columns):
            out: dict = {"a": [], "b": []}
            bags: dict = {}
            for a, b, x, y in zip(columns["a"], columns["b"], columns["x"], columns["y"], strict=True):
                if b not in bags:
                    bags[b] = shingles(y, words)
                if similarity(shingles(x, words), bags[b]) >= SIMILAR:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return do

    parts = F.floor(F.col("n") / HUB_ROWS).cast("int") + 1
    dealt = pairs.groupBy("a", "b").agg(F.max(parts).alias("parts")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    spread = dealt.groupBy("b").agg(F.max("parts").alias("parts")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = spread.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return saved(by_batch(dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "x", "y"), make, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes with links: smallest labels of neighbours, then labels' labels, until nothing changes."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("changed")), "labels")
    few = labels.count() <= BROADCAST_ROWS  # all tables below but edges have at most a row for each of these
    held = F.broadcast if few else lambda df: df
    hot = None if few else hot_keys(edges, "b")
    while labels.where("changed").limit(1).count():
        told = join_values(edges, held(labels.select(F.col("node").alias("b"), F.col("component").alias("label"))), "b", hot)
        seen = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        spread = saved(labels.join(held(seen), "node").select("node", F.col("component").alias("was"), F.least("component", "label").alias("component")), "labels")
        onward = spread.select(F.col("node").alias("component"), F.col("component").alias("next"))
        large = None if few else hot_keys(spread.select("component"), "component")
        following = join_values(spread, held(onward), "component", large)  # a component is a node with a label
        labels = saved(following.select("node", F.least("component", "next").alias("component"), (F.least("component", "next") != F.col("was")).alias("changed")), "labels")
    return labels.select("node", "component")


def settled(docs: DataFrame, nodes: DataFrame, members: DataFrame, hubs: DataFrame, links: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """components() of links (those to hubs) and of all that join further components: between a bucket's members outside its hub's component and its other
    members (see step 3)."""
    found = components(links)
    of = lambda name, to: found.select(F.col("node").alias(name), F.col("component").alias(to))
    # buckets of two are settled by their hub
    placed = members.where("n > 2").join(hubs, "key").join(of("node", "c"), "node", "left").join(of("hub", "h"), "hub", "left")
    placed = saved(placed.select("key", "node", "n", F.coalesce("c", "node").alias("component"), (F.coalesce("c", "node") != F.coalesce("h", "hub")).alias("outside"), (F.col("node") == F.col("hub")).alias("is_hub")), "members")
    buckets = placed.groupBy("key").agg(F.sum(F.col("outside").cast("long")).alias("n_outside"), F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor"))
    buckets = saved(buckets.where("n_outside > 0").groupBy("n", "sum", "xor").agg(F.min("key").alias("key"), F.max("n_outside").alias("n_outside")).select("key", "n_outside"), "open")
    if not buckets.limit(1).count():
        return found
    n_out = F.least(F.lit(PARTS), F.ceil(F.col("n_outside") / OUTSIDE_BLOCK))
    n_in = F.ceil(F.col("n") / F.greatest(F.lit(MEMBER_BLOCK), F.ceil(F.col("n_outside") / n_out)))
    drawn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30))
    own = placed.where("not is_hub").join(buckets, "key").select("key", "n", "node", "component", "outside", drawn.alias("_d"), n_out.cast("int").alias("_o"), n_in.cast("int").alias("_i"))
    as_outside = own.where("outside").select("key", "n", "node", "component", F.lit(True).alias("outside"), (F.col("_d") % F.col("_o")).cast("int").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("ib"))
    as_member = own.select("key", "n", "node", "component", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("_o") - 1)).alias("ob"), (F.col("_d") % F.col("_i")).cast("int").alias("ib"))
    asked = saved(own.select("node").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    signed = saved(nodes.select("node", "signature", "bands").join(asked, "node", "left_semi"), "signed")  # of open buckets alone, since all are many
    blocks = as_outside.unionByName(as_member).join(signed.select("node", "signature"), "node")
    schema = "key long, ob int, ib int, n long, node binary, outside boolean, best binary, agree int, likely int"
    likely = saved(blocks.groupBy("key", "ob", "ib").applyInArrow(_likely_of_block, schema), "likely")
    if not likely.limit(1).count():
        return found
    texts = texts_of(docs, likely.select("node").distinct().join(nodes.select("node", "id"), "node"), text_col, id_col)
    best = saved(likely.where("outside").groupBy("key", "node").agg(F.max(F.struct("agree", "best")).getField("best").alias("b"), F.max("n").alias("n")), "best")
    better = verified(best.select(F.col("node").alias("a"), "b", "n"), texts)
    if better.limit(1).count():
        links = links.unionByName(better)
        found = components(links)
    # what the best partners left: in blocks that hold several components, rows with likely partners that weren't tried
    held = saved(likely.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "held")
    tried = held.join(best.select("key", "node", "b"), ["key", "node"], "left").withColumn("tried", F.col("likely").isNull() | ((F.col("likely") == 1) & (F.col("best") == F.col("b"))))
    unsettled = tried.groupBy("key", "ob", "ib").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.bool_and("tried").alias("tried"))
    unsettled = unsettled.where("x <> y and not tried").select("key", "ob", "ib")
    rest = held.join(unsettled, ["key", "ob", "ib"], "left_semi").join(signed, "node").join(texts, "node")
    more = saved(rest.groupBy("key", "ob", "ib").applyInArrow(_links_of_block, "a binary, b binary"), "more-links")
    return components(links.unionByName(more)) if more.limit(1).count() else found


def _agreements(points: np.ndarray, out: list[int], rest: list[int]):
    """For each of out: how many components each of rest shares with it."""
    inner = np.ascontiguousarray(points[rest].T)
    for i in out:
        agree = np.zeros(len(rest), np.int16)
        for c in range(COMPONENTS):
            agree += inner[c] == points[i, c]
        yield i, agree


def _likely_of_block(block):
    import pyarrow as pa

    columns = {n: block.column(n).to_pylist() for n in ("node", "component", "outside", "signature")}
    rows = likely_rows(**columns)
    size = len(rows)
    head = {n: pa.array([block.column(n)[0].as_py()] * size, t) for n, t in (("key", pa.int64()), ("ob", pa.int32()), ("ib", pa.int32()), ("n", pa.int64()))}
    own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()))]
    return pa.table(head | dict(zip(("node", "outside", "best", "agree", "likely"), own, strict=True)))


def likely_rows(node: list, component: list, outside: list, signature: list) -> list[tuple]:
    """(node, outside, its best partner, their agreement, number of likely partners) of the rows with a likely partner in another component."""
    out = [i for i, o in enumerate(outside) if o]
    rest = sorted((i for i, o in enumerate(outside) if not o), key=lambda i: node[i])
    if not out or not rest:
        return []
    points = np.frombuffer(b"".join(signature), np.uint16).reshape(len(node), COMPONENTS)
    names = {c: k for k, c in enumerate(dict.fromkeys(component))}
    label = np.array([names[c] for c in component])
    inner, rows, met = label[rest], [], np.zeros(len(rest), bool)
    for i, agree in _agreements(points, out, rest):
        likely = (agree >= LIKELY) & (inner != label[i])
        if likely.any():
            met |= likely
            k = int(np.where(likely, agree, -1).argmax())
            rows.append((node[i], True, node[rest[k]], int(agree[k]), int(likely.sum())))
    return rows + [(node[rest[k]], False, None, None, None) for k in np.flatnonzero(met)]


def _links_of_block(block):
    import pyarrow as pa

    columns = {n: block.column(n).to_pylist() for n in ("node", "component", "outside", "signature", "bands", "text")}
    links = block_links(block.column("key")[0].as_py(), **columns)
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def block_links(key: int, node: list, component: list, outside: list, signature: list, bands: list, text: list) -> list[tuple]:
    """Verified links that join components: outside rows against the others, but for pairs that share a bucket of a lesser key and so meet there."""
    out, rest = [i for i, o in enumerate(outside) if o], [i for i, o in enumerate(outside) if not o]
    if not out or not rest:
        return []
    points = np.frombuffer(b"".join(signature), np.uint16).reshape(len(node), COMPONENTS)
    keys = np.array(bands, np.int64)
    lesser = keys < key
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    words, links = Words(), []
    bags = {i: shingles(text[i], words) for i in out}
    for part, members in _parts(rest, text, words):
        for i, agree in _agreements(points, out, part):
            near = [k for k in np.flatnonzero(agree >= LIKELY) if find(component[i]) != find(component[part[k]])]
            if not near:
                continue
            own = [part[k] for k in near]
            here = ~((keys[own] == keys[i]) & lesser[own]).any(1)
            if not here.any():
                continue
            alike = members.similarities(bags[i], np.array(near)[here])
            for k in np.array(near)[here][alike >= SIMILAR]:
                j = part[k]
                if find(component[i]) != find(component[j]):
                    links.append((node[i], node[j]))
                    root[find(component[i])] = find(component[j])
    return links


def _parts(rest: list[int], text: list, words: Words):
    """rest in parts of SHINGLES_AT_ONCE or one row more, each with its Bags."""
    part, bags, size = [], [], 0
    for j in rest:
        part.append(j)
        bags.append(shingles(text[j], words))
        size += len(bags[-1][0])
        if size >= SHINGLES_AT_ONCE:
            yield part, Bags(bags)
            part, bags, size = [], [], 0
    if part:
        yield part, Bags(bags)


class Bags:
    """Multisets that others are compared with, many at a time."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.known, self.place = np.unique(np.concatenate([x for x, _ in bags]), return_inverse=True)
        self.weight = np.concatenate([n for _, n in bags])
        self.ends = np.cumsum([0] + [len(x) for x, _ in bags])
        self.total = np.array([n.sum() for _, n in bags], np.int64)

    def similarities(self, bag: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> np.ndarray:
        """similarity() of bag and each of which (ascending places)."""
        x, n = bag
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        same = self.known[at] == x
        held = np.zeros(len(self.known), np.int64)
        held[at[same]] = n[same]
        sizes = self.ends[which + 1] - self.ends[which]
        starts = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(self.ends[which] - starts, sizes)
        both = np.add.reduceat(np.minimum(held[self.place[rows]], self.weight[rows]), starts)
        return both / (int(n.sum()) + self.total[which] - both)


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, node, row (a number of the row), keeper (struct of these) of every row, saved; node and keeper.node are null where the text is."""
    signed = saved(signatures(docs, text_col, id_col), "signatures")
    nodes = signed.groupBy("node").agg(F.min(F.struct("id", "row")).alias("first"), F.max("signature").alias("signature"), F.max("bands").alias("bands"))
    nodes = saved(nodes.select("node", "first.id", "first.row", "signature", "bands"), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = saved(keys.join(shared, "key"), "members")
    hubs = hub_pairs(members)
    pairs = saved(members.join(hubs, "key").where("node != hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n")), "pairs")
    ends = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id"), "node"), "ends")
    links = verified(pairs, texts_of(docs, ends, text_col, id_col))
    found = settled(docs, nodes, members, hubs, links, text_col, id_col)
    named = saved(nodes.select("node", "id", "row").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    few = named.count() <= BROADCAST_ROWS
    keepers = named.groupBy("component").agg(F.min(F.struct("id", "node", "row")).alias("keeper"))
    of_node = saved(join_values(named.select("node", "component"), keepers, "component", None if few else hot_keys(named.select("component"), "component")).select("node", "keeper"), "classes")
    slim = signed.select("id", "node", "row")
    own = join_values(slim, F.broadcast(of_node) if few else of_node, "node", None if few else hot_keys(slim, "node")).select("id", "node", "row", "keeper")
    unknown = docs.where(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), F.lit(None).cast("binary").alias("node"), F.monotonically_increasing_id().alias("row"))
    return saved(own.unionByName(unknown.withColumn("keeper", F.struct("id", "node", "row"))), "rows")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that aren't their class's keeper."""
    rows = classes(docs, text_col, id_col)
    known = rows.where(F.col("node").isNotNull()).select("id", "node", F.struct("id", "node").eqNullSafe(F.struct("keeper.id", "keeper.node")).alias("stays"))
    counted = saved(known.groupBy("id", "node", "stays").count().where("not stays or count > 1"), "dropped")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    held = docs.select(own, F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_node"))

    def among(found: DataFrame, how: str) -> DataFrame:
        named = found.select(F.col("id").alias("_gone"), F.col("node").alias("_of"))
        named = F.broadcast(named) if found.count() <= BROADCAST_ROWS else named
        return held.join(named, (held["_node"] == named["_of"]) & held["_id"].eqNullSafe(named["_gone"]), how)

    kept = among(counted, "left_anti")
    again = counted.where("stays")
    if again.limit(1).count():  # keepers whose rows repeat id and text
        kept = kept.unionByName(among(again, "left_semi").dropDuplicates(["_id", "_node"]))
    return kept.select("_row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the keeper's doc_id) and whether the row is the keeper: one row of each class is."""
    from .common import table

    rows = classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("keeper.id").alias("class_id"), F.struct("id", "node", "row").eqNullSafe(F.col("keeper")).alias("kept"))
