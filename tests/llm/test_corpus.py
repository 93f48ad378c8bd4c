"""Token files, near copies, quality rules, packing, the pipeline."""

import itertools
import random
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import leaks, near_copies, packing, quality, secrets, token_files
from parley.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def test_token_files(spark, sf_dir, texts):
    encode = encoder()
    start, expected = 0, []
    for k in sorted(texts):
        ids = encode(texts[k])
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op3(spark, sf_dir).collect())) == expected


def test_keyed_access_and_shards(spark, docs, texts):
    folder = token_files.write_token_files(docs, TOKENIZER, shard_rows=30)
    files, encode = token_files.TokenFiles(folder), encoder()
    assert len(files.manifest["shards"]) > 3
    for k in sorted(texts)[::7]:
        assert [x.tolist() for x in files.get(k)] == [encode(texts[k])]
    assert files.get(-5) == [] and files.get(10**9) == []
    read = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted(texts)


def test_repeated_and_null_keys(spark, odd, empty):
    folder = token_files.write_token_files(odd, TOKENIZER)
    files, encode = token_files.TokenFiles(folder), encoder()
    assert sorted(x.tolist() for x in files.get(5)) == sorted([encode("é𝒳漢 \u0000 x"), encode("another text of this id")])
    assert [x.tolist() for x in files.get(None)] == [[2]] and len(files.get(4)) == 2
    assert token_files.read_token_files(spark, folder).count() == 8
    hot = spark.createDataFrame([(7, f"t{i}") for i in range(50)] + [(1, "a"), (9, "b")], "doc_id long, text string")
    folder = token_files.write_token_files(hot, TOKENIZER, shard_rows=10)
    files = token_files.TokenFiles(folder)
    assert len(files.get(7)) == 50 and max(s["n_docs"] for s in files.manifest["shards"]) < 30
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1] + [7] * 50 + [9] and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    same = spark.createDataFrame([(7, "the same")] * 500 + [(1, "a"), (9, "b")], "doc_id long, text string")
    folder = token_files.write_token_files(same, TOKENIZER, shard_rows=10)
    files = token_files.TokenFiles(folder)
    assert len(files.get(7)) == 500 and max(s["n_docs"] for s in files.manifest["shards"]) <= 20 and len(files.manifest["shards"]) >= 50
    assert sum(token_files.read_token_files(spark, folder).toPandas().n_tokens) == 500 * len(encode("the same")) + len(encode("a")) + len(encode("b"))
    nothing = token_files.write_token_files(empty, TOKENIZER)
    assert token_files.read_token_files(spark, nothing).count() == 0 and token_files.TokenFiles(nothing).get(1) == []


@pytest.mark.parametrize("kind", ["date", "decimal(12,2)", "binary", "string", "int", "boolean"])
def test_keys_of_other_types(spark, kind):
    made = {"date": "date_add(date'2020-01-01', int(id))", "binary": "unhex(lpad(hex(id), 4, '0'))", "boolean": "id % 2 = 0"}.get(kind, f"cast(id as {kind})")
    rows = spark.range(200).selectExpr(f"{made} AS doc_id", "concat('text ', id) AS text")
    folder = token_files.write_token_files(rows.unionByName(rows.limit(0).selectExpr("doc_id", "text")), TOKENIZER, shard_rows=20)
    files, encode = token_files.TokenFiles(folder), encoder()
    held = rows.collect()
    for r in held[::17]:
        key = bytes(r.doc_id) if kind == "binary" else r.doc_id
        assert sorted(x.tolist() for x in files.get(key)) == sorted(encode(o.text) for o in held if o.doc_id == r.doc_id)
    read = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted(r.doc_id for r in held)
    assert len(files.manifest["shards"]) >= (2 if kind == "boolean" else 8)
    with pytest.raises(TypeError):
        token_files.write_token_files(rows.selectExpr("now() AS doc_id", "text"), TOKENIZER)


def test_encoder_is_exact(monkeypatch):
    draw = random.Random(8)
    letters = "ab  Z's'll\t\n\r\x1c\x85 ²½Ⅷ٣é漢_-!０　̈'reİſ"
    texts = ["", None, "<|endoftext|> x", "a\n\n b", *("".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(1500))]
    with open(TOKENIZER, encoding="utf-8") as f:
        made = token_files.Encoder(f.read(), 2)
    encode = encoder()
    expected = [encode(t) for t in texts]
    for kept, part in ((token_files.STRETCHES_KEPT, token_files.PART_BYTES), (50, 300)):  # and with hardly any memory
        monkeypatch.setattr(token_files, "STRETCHES_KEPT", kept)
        monkeypatch.setattr(token_files, "PART_BYTES", part)
        got = made(pa.array(texts, pa.string())).to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == expected
    assert made(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    values = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    perfect = token_files.PerfectHash.of(values)
    assert sorted(perfect.slot(values)) == list(range(len(values)))


def test_min_hash_is_unbiased():
    words, draw, off = near_copies.Words(), np.random.default_rng(2), []
    for t in range(24):
        base = [f"w{draw.integers(0, 40)}-{t}" for _ in range((60, 300, 30)[t % 3])]
        other = [w if draw.random() > 0.05 else "zz" for w in base]
        a, b = near_copies.shingles(" ".join(base * 3), words), near_copies.shingles(" ".join(other * 2 + ["x"] * 40), words)
        p = near_copies.bag_min_hash([a, b], 1024)
        off.append((p[0] == p[1]).mean() - near_copies.similarity(a, b))
    assert abs(np.mean(off)) < 0.01


def brute_classes(texts):
    words = near_copies.Words()
    bags = {k: near_copies.shingles(t, words) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = find(a), find(b)
        if x != y and texts[a] is not None and (texts[a] == texts[b] or near_copies.similarity(bags[a], bags[b]) >= near_copies.SIMILAR):
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_classes_against_brute_force(spark, sf_dir, texts):
    assert {r.doc_id: r.class_id for r in near_copies.op5(spark, sf_dir).collect()} == brute_classes(texts)


@pytest.mark.parametrize("rows", [0, near_copies.BROADCAST_ROWS])
def test_a_large_group_of_near_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", rows)
    for name in ("HOT_ROWS", "HUB_ROWS", "OUTSIDE_BLOCK", "MEMBER_BLOCK") if not rows else ():  # hot keys and small blocks too
        monkeypatch.setattr(near_copies, name, 20)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(w if draw.random() > p else f"z{draw.randint(0, 999)}" for w in base) for i, p in enumerate([0.0, *(draw.choice([0.01, 0.02, 0.04, 0.08]) for _ in range(160))])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.keeper.id for r in near_copies.classes(df).collect()}
    assert got == brute_classes(texts)


def test_rows_of_open_buckets_grow_with_their_members(spark, monkeypatch):
    """However many members are outside a hub's component, each is copied to few blocks, and no link is lost."""
    tables = {}

    def kept(df, tag):
        tables[tag] = saved(df, tag)
        return tables[tag]

    saved = near_copies.saved
    monkeypatch.setattr(near_copies, "saved", kept)
    for name in ("OUTSIDE_BLOCK", "MEMBER_BLOCK"):
        monkeypatch.setattr(near_copies, name, 2)
    draw = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(w if draw.random() > 0.04 else f"z{draw.randint(0, 999)}" for w in base) for i in range(160)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.keeper.id for r in near_copies.classes(df).collect()} == brute_classes(texts)
    copies = tables["likely"].groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("n")).collect()
    assert max(r.n for r in copies) > 40
    assert all(r.rows <= 5 * r.n for r in copies), max(r.rows / r.n for r in copies)


def test_many_similarities_at_once():
    draw, words = random.Random(3), near_copies.Words()
    bags = [near_copies.shingles(" ".join(draw.choice("ab") for _ in range(draw.randint(1, 60))), words) for _ in range(30)]
    made = near_copies.Bags(bags[:20])
    for bag in bags:
        for which in (range(20), (0, 7, 19), (4,)):
            assert made.similarities(bag, np.array(which)).tolist() == [near_copies.similarity(bag, bags[k]) for k in which]


def test_chains_in_open_buckets(spark):
    """Texts that are similar only to their neighbours in a chain, so hubs reach few of them; and recall on pairs about the limit."""
    draw = random.Random(8)
    texts, k = {}, 0
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(120)]
        for step in range(25):
            texts[k] = " ".join(words)
            words[(step * 5) % 120] = f"g{g}s{step}"
            k += 1
    for _ in range(20):
        words = [f"x{draw.randint(0, 10**6)}" for _ in range(60)]
        texts[k] = " ".join(words)
        texts[k + 1] = " ".join([*words[:55], "tail", *words[56:]])
        k += 2
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.keeper.id for r in near_copies.classes(df).collect()} == brute_classes(texts)


def test_signature_bound():
    """LIKELY hides a similar pair with probability MISS at most, and no less would do."""
    from fractions import Fraction
    from math import comb

    below = lambda k: sum(comb(near_copies.COMPONENTS, i) * Fraction(4, 5) ** i * Fraction(1, 5) ** (near_copies.COMPONENTS - i) for i in range(k))
    assert below(near_copies.LIKELY) <= near_copies.MISS < below(near_copies.LIKELY + 1)


def test_one_of_each(spark, odd, empty):
    same = spark.createDataFrame([(1, "some words of a text")] * 3 + [(0, None), (0, None), (2, "some words of a text"), (3, "another one")], "doc_id long, text string")
    rows = near_copies.classes(same)
    kept = rows.where(F.struct("id", "node", "row").eqNullSafe(F.col("keeper"))).select("id").collect()
    assert sorted(r.id for r in kept) == [0, 0, 1, 3]
    assert sorted(r.doc_id for r in near_copies.one_of_each(same).collect()) == [0, 0, 1, 3]
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [(0, ""), (1, ""), (2, ""), (3, " \n\t "), (4, "word word"), (5, "another t"), (5, "é𝒳漢 \u0000 x")]
    assert near_copies.one_of_each(empty).count() == 0 and near_copies.classes(empty).count() == 0


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count: dict = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, sf_dir, texts):
    rows = quality.op7(spark, sf_dir).collect()
    for r in rows:
        expected = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0]) and not (r.base_failed and r.kept)
    assert len(rows) == len(texts)


def test_repeats_of_windows(spark):
    draw = random.Random(7)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 40))) for _ in range(200)] + ["x " * 8, "x " * 9, "a b c d e f g h " * 2, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.q.n_repeat_words for r in quality.measure(df, to="q").select("doc_id", "q").collect()}
    assert got == {i: brute_quality(t)[4] for i, t in enumerate(texts)}


def test_certified_cutoffs(spark):
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10) and quality.binomial_tail(10, 10, 0.5) == 1
    assert quality.binomial_tail(3, 20, 0.2) == pytest.approx(sum(__import__("math").comb(20, i) * 0.2**i * 0.8 ** (20 - i) for i in range(4)))
    rules = {"r": [3.0, 2.0, 1.0]}
    found = quality.certify([("en", 2000, 100, [[(0, 10), (2, 50), (500, 100)]]), ("xx", 10, 5, [[(0, 5), (0, 5), (0, 5)]])], 0.05, 0.05, rules)
    assert found == {"en": {"r": 2.0}, "xx": {}}
    good, bad = "plain words " * 20, "we % shout & a lot # " * 10
    rows = [(i, good + str(i), "en") for i in range(1500)] + [(2000 + i, bad + str(i), "en") for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(f"{w}{k}" if w.isalpha() else w for k, w in enumerate(t.split())), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, *_ in rows], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).where("doc_id >= 2000").count() == 0 and quality.keep_good(docs, labels).count() == 1500


def test_cutoffs_of_many_strata(spark):
    """Thousands of strata, null among them, are joined and not spelled out in the plan."""
    rows = [(i, " ".join(f"w{k}" + "!" * (i % 2) for k in range(30)), None if i % 1500 == 7 else f"s{i % 1500}") for i in range(3000)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    cutoffs = {f"s{k}": {"bangs_per_word": 0.5} if k % 3 == 0 else {} for k in range(1500)} | {None: {"bangs_per_word": 0.5, "symbols_per_word": 0.1}}
    got = {r.doc_id: r.kept for r in quality.judged(measured, cutoffs).select("doc_id", "kept").collect()}
    assert got == {i: not (i % 2 and (lang is None or int(lang[1:]) % 3 == 0)) for i, _, lang in rows}
    assert all(r.kept for r in quality.judged(measured, {}).collect())


def test_quality_of_odd_rows(odd, empty, labels):
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.keep_good(odd, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_best_buckets():
    draw = random.Random(3)
    for _ in range(60):
        lengths = sorted(draw.sample(range(1, 60), draw.randint(1, 9)))
        counts = [draw.randint(1, 20) for _ in lengths]
        k = draw.randint(1, 4)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        ends = packing.best_ends(lengths, counts, k)
        assert ends == sorted(ends) and padding(lengths, counts, ends) == best and len(ends) == min(k, len(lengths))


def test_best_buckets_of_many_lengths(spark):
    """More than 16,384 distinct lengths and one far longer: ends stay those of the exact histogram."""
    rows = spark.range(17_000).selectExpr("id AS doc_id", "id % 17000 + 1 AS n").union(spark.range(40_000).selectExpr("id + 20000", "id % 40 + 1")).union(spark.createDataFrame([(90_000, 20_000_000)], "doc_id long, n long"))
    got = packing.pack(rows, length_col="n").groupBy("bucket").agg(F.min("n_tokens"), F.max("n_tokens"), F.max("padded"), F.sum("padding")).orderBy("bucket").collect()
    lengths, counts = np.unique(np.concatenate([np.arange(1, 17_001), np.arange(40_000) % 40 + 1, [20_000_000]]), return_counts=True)
    assert [r[3] for r in got] == [r[2] for r in got] == packing.best_ends(lengths, counts)
    assert sum(r[4] for r in got) == padding_of(lengths, counts, packing.N_BUCKETS)


def padding_of(lengths, counts, k):
    """The least padding with k buckets, by the convex hull of lines instead of divide and conquer."""
    many, total = np.concatenate([[0], np.cumsum(counts)]).tolist(), np.concatenate([[0], np.cumsum(lengths * counts)]).tolist()
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(k):
        after, hull = [0], deque()
        for j, size in enumerate(lengths.tolist()):
            line = (-many[j], best[j] + total[j])  # cost of a last bucket from j, without its own part
            while best[j] < float("inf") and len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            if best[j] < float("inf"):
                hull.append(line)
            while len(hull) > 1 and hull[1][0] * size + hull[1][1] <= hull[0][0] * size + hull[0][1]:
                hull.popleft()
            after.append(size * many[j + 1] - total[j + 1] + hull[0][0] * size + hull[0][1])
        best = after
    return best[-1]


def test_packing(spark, sf_dir, texts, odd, empty):
    rows = packing.op10(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts.items()}
    batches: dict = {}
    for r in rows:
        assert r.n_tokens <= r.padded and r.padding == r.padded - r.n_tokens
        batches.setdefault((r.bucket, r.padded, r.batch), []).append(r.slot)
    incomplete: dict = {}
    for (bucket, padded, _), slots in batches.items():
        most = max(1, packing.BUDGET // padded)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= most
        incomplete[bucket] = incomplete.get(bucket, 0) + (len(slots) < most)
    assert max(incomplete.values()) <= 1
    lengths, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    assert sum(r.padding for r in rows) == padding(np.maximum(lengths, 1).tolist(), counts.tolist(), packing.best_ends(np.maximum(lengths, 1).tolist(), counts.tolist())) + int((lengths == 0) @ counts)
    assert packing.pack(odd).count() == 8 and packing.pack(empty).count() == 0
    many = spark.range(5000).selectExpr("id AS doc_id", "'a b c' AS text")
    alike = packing.pack(spark.range(30_000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text"), budget=30)
    assert alike.groupBy("batch", "slot").count().where("count > 1").count() == 0 and alike.agg(F.max("batch")).first()[0] == 2999
    spread = packing.pack(many, budget=30).groupBy("batch").count()
    assert spread.count() == 500 and spread.agg(F.max("count")).first()[0] == 10


def test_pipeline(spark, sf_dir, texts):
    """Against the same decisions made one by one."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scan", "packing"]
    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality.op7(spark, sf_dir).where("kept").collect()}
    good = {k: texts[k] for k in kept}
    classes = brute_classes(good)
    single = {k: good[k] for k in good if classes[k] == k}
    tokens = leaks.Tokens()
    items = [tokens.of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = leaks.Index(items)
    clean = {k: t for k, t in single.items() if not leaks.leaks_of(index, [tokens.of(t)])[0]}
    secret = {r.doc_id: r.text for r in secrets.masked(docs.where(F.col("doc_id").isin(list(clean)))).collect()}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in secret.items()}


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    fine = [(100 + i, " ".join(f"word{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(3)]
    fine += [(100, fine[0][1], "en", "s", 0), (None, " ".join(f"other{k}" for k in range(25)), None, None, None), (200, " ".join(f"exam{k}" for k in range(40)), "fr", "s", 0)]
    docs = spark.createDataFrame(fine, empty.schema)
    extra = [c for c in odd.columns if c not in docs.columns]
    both = odd.unionByName(docs.selectExpr("*", *(f"'x' AS `{c}`" for c in extra)))
    none = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    some = {"labels": spark.createDataFrame([(1, 1, 0), (None, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, fine[-1][1]), (2, None), (None, "")], "item_id long, text string")}
    for name, table_of, kept in (("none", none, [None, 100, 101, 102, 200]), ("some", some, [None, 100, 101, 102])):
        at = tmp_path / name
        for t, df in (table_of | {"documents": both}).items():
            df.write.parquet(f"{at}/{t}.parquet")
        assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(at)).collect()), key=lambda x: x or 0) == kept
    at = tmp_path / "empty"
    for t, df in (none | {"documents": empty}).items():
        df.write.parquet(f"{at}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(at)).count() == 0
