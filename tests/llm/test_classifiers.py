"""Toxicity and language: held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from parley.llm import language, toxicity


def test_language(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in language.op9(spark, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in rows.items() if r.held_out} == set(held) and len(rows) == len(truth)
    assert np.mean([rows[k].lang_pred == truth[k] for k in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(docs, odd, empty):
    net = language.fit(docs, sample=60)
    rows = language.identify(odd, net).collect()
    assert len(rows) == 8 and all(r.lang_pred == "und" for r in rows if r.doc_id in (None, 1, 2, 3))
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.fit(empty) is None and language.identify(empty, net).count() == 0


def slow_prediction(net, text):
    """A forward pass place by place in plain Python floats."""
    data = text.encode("utf-8", "surrogatepass")
    total = np.zeros(len(net.labels))
    for a in range(0, len(data), language.WINDOW):
        window = data[a : a + language.WINDOW]
        padded = window + b"\0" * (language.WINDOW - len(window))
        pooled = []
        for w in language.WIDTHS:
            best = np.zeros(net.filters)
            for i in range(language.WINDOW - w + 1):
                best = np.maximum(best, sum(net.tables[w][j][padded[i + j]].astype(float) for j in range(w)) + net.bias[w])
            pooled.append(best)
        z = np.concatenate(pooled) @ net.out + net.out_bias
        total += len(window) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
    p = np.exp(total / len(data) - (total / len(data)).max())
    return net.labels[int(p.argmax())], p.max() / p.sum()


def test_language_against_a_slow_network(spark, sf_dir, docs, texts):
    """The query's rows are those of the fitted network, worked out place by place."""
    net = language.fit(docs.where(~(language.id_crc("doc_id") % 4 == 2)))
    rows = {r.doc_id: r for r in language.op9(spark, sf_dir).collect()}
    for k in sorted(texts, key=lambda k: (len(texts[k] or ""), k))[:120:6]:
        if not any(c.isalpha() for c in texts[k] or ""):
            assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
            continue
        label, score = slow_prediction(net, texts[k])
        assert abs(rows[k].score - score) < 1e-3 and (rows[k].lang_pred == label or score < 0.51)


def test_texts_without_letters(spark, docs):
    net = language.fit(docs, sample=60)
    texts = ["½²Ⅷ", "123 _ ٣", "Ⅷa", "漢", "é", "!", None, ""]
    assert [x == "und" for x in language.predict(net, texts)[0]] == [True, True, False, False, False, True, True, True]


def test_bounded_samples_of_repeated_ids(spark):
    """A third of the rows have one id or none; draws stay bounded and both languages are learned."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"der und das nicht {i}" if i % 2 else f"the and of that {i}", "de" if i % 2 else "en") for i in range(12_000)]
    rows += [(None, "the same text", "en")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = language.ByteNet.train
    language.ByteNet.train = lambda self, x, y, *a: (seen.append(len(x)), train(self, x, y, 1))
    try:
        net = language.fit(df, sample=50)
    finally:
        language.ByteNet.train = train
    assert net.labels == ["de", "en"] and 40 < seen[0] <= 4 * 50 * language.WINDOWS_EACH


def test_pair_tables_are_the_network():
    net = language.ByteNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    pooled = []
    for w in language.WIDTHS:
        h = sum(net.tables[w][j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w)) + net.bias[w]
        pooled.append(np.maximum(h.max(1), 0))
    z = np.concatenate(pooled, 1) @ net.out + net.out_bias
    p = np.exp(net.log_probabilities(x))
    assert np.allclose(p, np.exp(z) / np.exp(z).sum(1, keepdims=True), atol=1e-4)


def planted(n, seed):
    draw = random.Random(seed)
    syllables = "ba ko mi tu re sa ne lo".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(3))
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [draw.choice(["the", "and", "of", "der", "und"]) for _ in range(6)] + [word() for _ in range(draw.randint(5, 60))]
        words += ["frumpo" + draw.choice(syllables)] * toxic
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_of_new_word_forms(spark):
    rows = planted(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fresh = planted(300, 2)
    scores = model.scores([t.replace("frumpo", "frumpoz") for _, t, _ in fresh], toxicity.Vocabulary())
    assert np.mean([(s >= 0.7) == bool(y) for s, (_, _, y) in zip(scores, fresh, strict=True)]) > 0.97


def slow_raw(net, text):
    """A raw score word by word in plain Python floats."""
    import re

    vectors = [sum(net.words[b].astype(float) for b in toxicity.features(w)) / toxicity.FEATURES for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    vectors += [np.zeros(toxicity.DIM)] * toxicity.WIDTHS[-1]
    pooled = []
    for w in toxicity.WIDTHS:
        best = np.zeros(toxicity.FILTERS)
        for i in range(len(vectors) - w + 1):
            best = np.maximum(best, sum(vectors[i + j] @ net.filters[w][j] for j in range(w)) + net.bias[w])
        pooled.append(best)
    return np.concatenate(pooled) @ net.out + net.out_bias


def test_toxicity_against_a_slow_network(spark, sf_dir, docs, labels, texts):
    """The query's rows are those of the trained network, worked out word by word, in every language's calibration."""
    own = labels.where(~(language.id_crc("doc_id") % 3 == 1))
    network = toxicity.train(docs, own)
    shift = toxicity.calibrate(toxicity.raw_scores(docs, network), own, network)
    held = {r.doc_id for r in own.collect()}
    assert {h for h in network.trained} <= {r.h for r in docs.where(docs.doc_id.isin(list(held))).selectExpr("xxhash64(text) h").collect()}
    rows = {r.doc_id: r for r in toxicity.op8(spark, sf_dir).collect()}
    words = toxicity.Vocabulary()
    for k in sorted(texts, key=lambda k: (len(texts[k] or ""), k))[:120:5]:
        _, (group,) = network.raw([texts[k]], words)
        score = 1 / (1 + np.exp(-(shift[group][0] * slow_raw(network.net, texts[k]) + shift[group][1])))
        assert abs(rows[k].score - score) < 1e-3 and rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_toxicity_of_held_out_rows(spark):
    """On the larger table: labels that were never learned from, and documents' languages told from their words."""
    at = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null").collect()}
    rows = [r for r in toxicity.op8(spark, at).collect() if r.held_out and r.doc_id in truth]
    order = np.argsort([r.score for r in rows])
    y = np.array([truth[r.doc_id] for r in rows])[order]
    ranks = np.arange(1, len(y) + 1)
    area = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.8, area


def test_order_of_words_counts():
    """Ablation: classes that share all their words differ by their order alone; word odds tell nothing, the filters do."""
    draw = random.Random(4)
    fill = [f"word{x}" for x in "abcdefghijklmnop"]
    words = toxicity.Vocabulary()

    def text(toxic):
        body = [draw.choice(fill) for _ in range(draw.randint(6, 20))]
        at = draw.randint(0, len(body))
        return " ".join(body[:at] + (["grum", "plit"] if toxic else ["plit", "grum"]) + body[at:])

    made = [(text(i % 2), i % 2) for i in range(1500)]
    rows = [words.table[r] for r in [words.rows(t) for t, _ in made]]
    labels = np.array([y for _, y in made])
    network = toxicity.Network(rows[:1200], labels[:1200], [None] * 1200, [], epochs=12)
    z, groups = network.raw([t for t, _ in made[1200:]], toxicity.Vocabulary())
    right = np.mean((z > np.median(z)) == labels[1200:])
    alone = np.array([network.net.words[np.unique(r[:, 0]), 0].sum() for r in rows[1200:]])
    odds_only = np.mean((alone > np.median(alone)) == labels[1200:])
    assert right > 0.9 and odds_only < 0.7 and set(groups) == {0}, (right, odds_only)


def test_languages_from_words():
    words = toxicity.Vocabulary()
    texts = ["the cat and dog", "the sun and moon", "der hund und katze", "die sonne und mond", "nothing of it"]
    rows = [words.table[r][:, 0] for r in [words.rows(t) for t in texts]]
    found = toxicity.Languages(rows, ["en", "en", "de", "de", None])
    group = lambda t: found.group(found.odds[words.table[words.rows(t)][:, 0]])
    assert found.names == ["de", "en"]
    assert [group(t) for t in ("und der mond", "the dog", "xyz", "")] == [1, 2, 0, 0]
    assert toxicity.Languages(rows[:1], [None]).group(np.zeros((3, 0), np.float32)) == 0


def test_calibration_covers_all_labelled_texts():
    """Every language with labels enough has its own threshold, a rare one too; steps are counted, not drawn."""
    counted = []
    for group, cut in ((0, 0.0), (1, 2.0), (2, -1.0)):
        for k in range(-100, 100):
            z = k / 20
            counted.append((group, z, int(z > cut), False, 1000 if group == 1 else 1))
    counted += [(3, 0.0, 1, False, 3), (3, 1.0, 0, False, 30), (1, 0.0, 0, True, 10**6)]
    shift = toxicity.shifts(counted, 4)
    for group, cut in ((1, 2.0), (2, -1.0)):
        a, b = shift[group]
        assert -(b - np.log(0.7 / 0.3)) / a == __import__("pytest").approx(cut, abs=0.1)
    assert tuple(shift[3]) not in {tuple(x) for x in shift[:3]}


def test_bounded_samples_of_labelled_rows(spark):
    """Ten thousand rows with one labelled id, and texts beyond the bytes allowed."""
    rows = [(1 if i % 2 else None, f"text number {i}") for i in range(10_000)] + [(2 + i, f"fine {i} " * 500) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 1)] + [(2 + i, 0) for i in range(200)], "doc_id long, toxic int")
    network = toxicity.train(docs, labels, sample=300, sample_bytes=100_000)
    assert 301 <= len(network.trained) <= 300 + 25


def test_long_texts_in_pieces():
    net = toxicity.WordNet(np.zeros(toxicity.BUCKETS, np.float32))
    draw = np.random.default_rng(3)
    texts = [draw.normal(size=(n, toxicity.DIM)).astype(np.float32) for n in (0, 1, 2, 7, 90, 5)]
    assert np.allclose(net.logits(texts), net.logits(texts, most=10), atol=1e-5)
    assert np.allclose(net.logits(texts), np.concatenate([net.logits([t]) for t in texts]), atol=1e-5)


def test_toxicity_of_odd_rows(spark, sf_dir, docs, labels, odd, empty):
    rows = toxicity.op8(spark, sf_dir).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(odd, model).count() == 8
    assert [r.score for r in toxicity.score_toxicity(odd, None).collect()] == [0.0] * 8
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.fit(empty, labels) is None
