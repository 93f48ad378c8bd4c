"""Licences, HTML, secrets, leaks."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from parley.llm import html, leaks, licenses, secrets


def brute_licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, found = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        found |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_licences_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op1(spark, sf_dir).collect()}
    assert got == {k: brute_licences(t) for k, t in texts.items()}
    assert any(x[1] for x in got.values())


def test_overlapping_phrases():
    machine = licenses.automaton()
    draw = random.Random(4)
    words = "gnu general public license apache mit cc by MIT-License é CC_BY lesser".split()
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", "-", "\n", ""]) for _ in range(draw.randint(0, 30)))
        r = licenses.scan(text, machine)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licences(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_expressions():
    read = lambda s: licenses.evaluate(licenses.to_postfix(s)[0])
    assert read("mit or gpl-3.0-only and apache-2.0") == (True, ["mit", "gpl-3.0-only", "apache-2.0"])
    assert read("(mit or gpl-3.0-only) and gpl-2.0") == (False, ["mit", "gpl-3.0-only", "gpl-2.0"])
    assert read("apache-2.0 with llvm-exception and mit") == (True, ["apache-2.0", "mit"])
    for broken in ("mit or", "(mit", "and mit", "", "or"):
        assert not licenses.to_postfix(broken)[1]
    for left in ("mit proprietary", "mit)", "(mit or apache-2.0) with llvm-exception", "mit with a with b", "mit with (a)", "mit & x", "mit (x)"):
        assert not licenses.to_postfix(left)[1], left
    for good in ("mit */", "mit -->", "(mit)", 'mit"', "mit\t# ", "((mit) and isc)  "):
        assert licenses.to_postfix(good)[1], good
    for named, ok in {"cc-by-nc-nd-4.0": False, "cc-by-sa-4.0": False, "cc-by-4.0": True, "bsd-4-clause": False, "bsd-3-clause": True, "apache-2.0+": True, "mitnfa": False, "mit-0": True}.items():
        assert read(named)[0] is ok, named
    assert list(map(licenses.family, ("cc-by-nc-nd-4.0", "cc-by-4.0", "gpl-2.0-only", "mit-0", "agpl-3.0+", "bsd-3-clause", "mit"))) == ["cc-by-nc-nd", "cc-by", "gpl", "mit", "agpl", "bsd", "mit"]
    many = " or ".join(["gpl-3.0-only"] * 20_000 + ["mit"])
    assert read(many)[0] and len(read(many)[1]) == 20_001
    row = licenses.scan("// SPDX-License-Identifier: GPL-2.0-only OR MIT\nx", licenses.automaton())
    assert row["allowed"] and row["ids"] == "gpl-2.0-only,mit" and row["labels"] == "gpl,mit"


def test_expressions_against_brute_force():
    """Random whole expressions, evaluated as nested Python."""
    draw = random.Random(9)
    names = ["mit", "gpl-3.0-only", "apache-2.0", "bsd-4-clause", "isc+"]

    def expression(depth):
        if depth == 0 or draw.random() < 0.3:
            name = draw.choice(names)
            return (f"{name} with x-exception" if draw.random() < 0.2 else name), name.rstrip("+") in licenses.PERMISSIVE, [name], 3
        op, rank = draw.choice([("and", 2), ("or", 1)])
        (a, x, left, p), (b, y, right, r) = expression(depth - 1), expression(depth - 1)
        a, b = (f"({a})" if p < rank or draw.random() < 0.1 and " with " not in a else a), (f"({b})" if r <= rank else b)
        return f"{a} {op} {b}", (x and y) if op == "and" else (x or y), left + right, rank

    for _ in range(500):
        source, ok, named, _ = expression(draw.randint(0, 5))
        postfix, whole = licenses.to_postfix(source)
        assert whole and licenses.evaluate(postfix) == (ok, named), source


def test_licences_of_odd_rows(odd, empty):
    rows = licenses.licences(odd).collect()
    assert len(rows) == 8 and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert licenses.licences(empty).count() == 0


def test_html_layout():
    r = lambda s: html.render(s)["text"]
    assert r("<p>a<p>b <b>c</b>\n d<div>e</div>f") == "a\n\nb c d\n\ne\nf"
    assert r("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>z") == "- a\n- b\n    3. c\n    4. d\n\nz"
    assert r("<table><tr><th>k<th>value<tr><td>long key<td>v</table>") == "k         value\nlong key  v"
    assert r("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>c</table>").split("\n")[1] == "a  b  c"
    assert r("<pre> x\n  y</pre>") == " x\n  y"
    assert r("a<br>b<!-- c --><script>d</script><p hidden>e</p><p style='display: none'>f<p>g &amp; h") == "a\nb\n\ng & h"
    assert r("<title>t</title><textarea><b>x</b></textarea>1 < 2") == "<b>x</b>1 < 2"
    assert r(None) == r("") == r("<") .replace("<", "") == ""
    assert r("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert r("</p></li></b>x</div>") == "x"


def test_wide_and_spanning_cells():
    r = lambda s: html.render(s)["text"].split("\n")
    wide = "w" * 60 + " " + "v" * 30
    assert r(f"<table><tr><td>{wide}<td>1<tr><td>a<td>2</table>") == [f"{wide}  1", "a".ljust(91) + "  2"]
    assert r("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == ["a  b", "   c", "d  e"]
    assert r("<table><tr><td colspan=2>a wide one<td>b<tr><td>c<td>d<td>e</table>") == ["a wide one  b", "c  d        e"]
    assert r("<table><tr><td colspan=12345>a<tr><td>b<td rowspan=0>c<tr><td>d<td>e</table>") == ["a", "b  c", "d     e"]
    assert r("<ol start=1234567890><li>a<li value=7>b<li>c</ol>") == ["1234567890. a", "7. b", "8. c"]
    assert r("<ol start=-1><li>a<li>b</ol>") == ["-1. a", "0. b"] and r("<ol start=x><li>a</ol>") == ["1. a"]
    many = " ".join(f"w{i}" for i in range(1000))
    lines = r(f"<table><tr><td>{many}<td>x<tr><td>y<td>z</table>")
    assert " ".join(lines).split()[:4] == ["w0", "w1", "w2", "w3"] and sorted(" ".join(lines).split()) == sorted([*many.split(), "x", "y", "z"])
    assert max(map(len, lines)) <= html.LINE_MOST + 3 and lines[-1].index("z") == lines[0].index("x")
    assert r(f"<table><tr><td>{'q' * 3000}<td>x<tr><td>y<td>z</table>")[0] == "q" * 3000 + "  x" and r(f"<table><tr><td>{many}</table>") == [many]


def test_tables_against_brute_force():
    """Random tables with spans: every cell starts at its column's place, and columns are as narrow as their cells allow."""
    draw = random.Random(11)
    for _ in range(200):
        n_rows, n_columns = draw.randint(1, 5), draw.randint(1, 5)
        grid: list[list] = [[None] * n_columns for _ in range(n_rows)]
        cells = []
        for i in range(n_rows):
            for j in range(n_columns):
                if grid[i][j] is not None:
                    continue
                across, down = draw.choice([1, 1, 1, 2]), draw.choice([1, 1, 1, 2])
                while j + across > n_columns or any(grid[i][j + k] is not None for k in range(across)):
                    across -= 1
                down = min(down, n_rows - i)
                name = f"c{i}{j}" + "x" * draw.randint(0, 9)
                cells.append((i, j, across, down, name))
                for a in range(i, i + down):
                    for b in range(j, j + across):
                        grid[a][b] = name
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={x} rowspan={y}>{t}" for k, _, x, y, t in cells if k == i) for i in range(n_rows)) + "</table>"
        starts = [0]
        for j in range(n_columns):  # a column's end is what the cells that end there ask for, narrow ones first
            single = max((len(t) for _, b, x, _, t in cells if b == j and x == 1), default=0)
            spread = max((len(t) - (starts[j] - starts[b]) for _, b, x, _, t in cells if x > 1 and b + x - 1 == j), default=0)
            starts.append(starts[j] + max(single, spread) + 2)
        lines = []
        for i in range(n_rows):
            line = ""
            for k, j, _, _, t in sorted(cells):
                line = line + " " * (starts[j] - len(line)) + t if k == i else line
            lines += [line] if line else []
        assert html.render(page)["text"] == "\n".join(lines), page


def test_blocks_and_lists_against_brute_force():
    """Random trees of blocks and lists, drawn by a recursion of its own."""
    draw = random.Random(12)
    count = iter(range(10**6))

    def tree(depth):
        kind = draw.choice(["p", "div", "h2", "ul", "ol", "text"] if depth else ["p", "text"])
        if kind in ("p", "h2", "text"):
            return kind, f"w{next(count)}" + (f" v{next(count)}" if draw.random() < 0.5 else "")
        if kind == "div":
            return kind, [tree(depth - 1) for _ in range(draw.randint(1, 3))]
        return kind, [(f"w{next(count)}", tree(depth - 1) if depth > 1 and draw.random() < 0.4 else None) for _ in range(draw.randint(1, 3))]

    def page(node):
        kind, held = node
        if kind == "text":
            return f"<div>{held}</div>"
        if kind in ("p", "h2"):
            return f"<{kind}>{held}</{kind}>"
        if kind == "div":
            return "<div>\n" + " ".join(map(page, held)) + "</div>"
        return f"<{kind}>" + "".join(f"<li>{t}{page(inner) if inner and inner[0] in ('ul', 'ol') else ''}" for t, inner in held) + f"</{kind}>"

    def lines(node, indent="", top=True):
        """(line, whether an empty line must stand before or after it) rows."""
        kind, held = node
        if kind == "text":
            return [(indent + held, False, False)]
        if kind in ("p", "h2"):
            return [(indent + held, True, True)]
        if kind == "div":
            return [x for y in held for x in lines(y, indent)]
        out = []
        for i, (t, inner) in enumerate(held, 1):
            mark = "- " if kind == "ul" else f"{i}. "
            out.append((indent + mark + t, False, False))
            if inner and inner[0] in ("ul", "ol"):
                out += lines(inner, indent + " " * len(mark) + "  ", False)
        if top:
            out[0] = (out[0][0], True, out[0][2])
            out[-1] = (out[-1][0], out[-1][1], True)
        return out

    for _ in range(300):
        node = ("div", [tree(3) for _ in range(3)])
        text, after = [], False
        for line, before, gap in lines(node):
            if text and (before or after):
                text.append("")
            text.append(line)
            after = gap
        assert html.render(page(node))["text"] == "\n".join(text), page(node)


def test_html_without_end_of_head():
    r = lambda s: html.render(s)["text"]
    assert r("<head><title>T</title><h1>Hi</h1><p>text") == "Hi\n\ntext"
    assert r("<html><head><meta charset=utf-8><title>T</title>\n <link rel=x>bare text<p>more</html>") == "bare text\n\nmore"
    assert r("<head><script>x</script><style>y</style><noscript>n</noscript><template><p>z</template><base href=/>\n</head><body>b") == "b"
    assert r("<head><title>T</title><div>a</div></head><body><p>b<head><p>c") == "a\n\nb\n\nc"


def test_html_of_drawings_formulas_and_fallbacks():
    r = lambda s: html.render(s)["text"]
    assert r("<p>a <svg><title>t</title><desc/><defs><text>no</text></defs><path d='M0'/><g>no<text x=1>one</text><text>two <tspan>three</tspan></text></g></svg> b") == "a one two three b"
    assert r("<svg><foreignObject><p>html</p></foreignObject></svg><svg><g><path d='M0'><p>after") == "html\n\nafter"
    assert r("<math><semantics><mfrac><mn>1</mn><mi>n</mi></mfrac><annotation>no</annotation></semantics></math>, <math><mi>x</mi></math>") == "1 n , x"
    assert r("<object data=x><param name=y>fallback</object> z") == "fallback z"


def test_html_keeps_all_visible_words(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.op2(spark, sf_dir).collect()}
    import html as entities

    for r in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        words = entities.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        shown = [w for w in got[r.page_id].split() if w != "-"]
        assert [w for w in words if w != "-"] == shown


def test_html_of_odd_rows(odd, empty):
    pages = odd.withColumn("html", F.col("text")).withColumn("page_id", F.col("doc_id"))
    assert html.extract(pages).count() == 8 and html.extract(empty.selectExpr("doc_id page_id", "text html")).count() == 0


def brute_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), "assign", m.end())] if len(m[2]) >= 8 else []
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[0], order.index(x[1])))


def test_base_secrets_against_brute_force(spark, sf_dir, texts):
    rows = secrets.op4(spark, sf_dir).collect()
    for r in rows:
        spans = brute_secrets(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, x, _ in spans) for k in ("assign", "access", "hex"))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("learned")) == line
    assert len(rows) == len(texts)


def test_base_secret_corner_cases():
    for text in ("TOKEN: abc token=abcdefgh", "api_key=\"AKIA" + "A" * 16, "password = token=abcdefghij", "passwd:" + "f" * 40, "ſecret=abcdefgh", "ToKen'='0123456789abcdef0123456789abcdef"):
        assert [(a, k, b) for a, b, k, _ in secrets.base_spans(text)] == brute_secrets(text)


def test_grammar_inference():
    draw = random.Random(2)
    key = lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(16))
    words = [f"page{draw.randint(1, 99)}.example{draw.randint(1, 9)}.com/path" for _ in range(200)]
    model = secrets.Model({"access": [key() for _ in range(200)]}, words)
    assert len(model.kinds["access"][0].next) < 60
    assert sum(model.score(key()) > 0.99 for _ in range(200)) > 180 and all(model.score(w) < 0.5 for w in words[:20])
    text = f"see {key()} or {words[0]}"
    assert [k for _, _, k, _ in model.spans([])] == [] and len(secrets.candidates(text, [])) == 2
    total = sum(2.718281828 ** secrets.Automaton(["99", "9f", "ff", "99"]).log_likelihood(s) for s in ("99", "9f", "ff", "f9"))
    assert 0.3 < total <= 1


def test_short_and_joined_candidates():
    """Eight characters are enough, base spans are cut out of a run, and names and paths don't hide values."""
    found = lambda text: [v for *_, v in secrets.candidates(text, secrets.base_spans(text))]
    access = "AKIA" + "A1" * 8
    assert found("x a1b2c3d4 y a1b2c3d") == ["a1b2c3d4"]
    assert found(f"{access}/q7w8e9r0t1") == ["/q7w8e9r0t1", "q7w8e9r0t1"]
    assert found("KEY=q7w8e9r0/t1y2u3i4o5") == ["KEY=q7w8e9r0/t1y2u3i4o5", "q7w8e9r0/t1y2u3i4o5", "q7w8e9r0", "t1y2u3i4o5"]
    assert found("host.example/q7w8e9r0t1") == ["host.example/q7w8e9r0t1", "q7w8e9r0t1"]
    draw = random.Random(5)
    value = lambda: "".join(draw.choice("abcdefghij") + draw.choice("0123456789") for _ in range(5))
    words = [f"{draw.choice(['Section', 'Chapter', 'Version'])}-{draw.randint(1, 9999)}" for _ in range(300)]
    model = secrets.Model({"assign": [value() for _ in range(300)]}, words)
    short, hidden, after = value(), value(), value()
    text = f"Version-12 {short} NAME={hidden} {access}/{after} Chapter-7"
    got = [v for *_, v in model.spans(secrets.candidates(text, secrets.base_spans(text)))]
    assert len(got) == 3 and all(x in y for x, y in zip((short, hidden, after), got, strict=True))


def test_masking(spark, odd, empty):
    rows = [(i, f"é token = {'0123456789abcdef' * 2} tail", "en", "s", 0) for i in range(3)] + [(9, "clean text", "en", "s", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.masked(df).collect()}
    assert got[0] == ("é [SECRET] tail", 15) and got[9] == ("clean text", 10)
    assert sorted(map(str, secrets.masked(odd).collect())) == sorted(map(str, odd.collect()))
    assert secrets.masked(empty).count() == 0 and secrets.find_secrets(empty).count() == 0


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_leaks(text, item):
    """(matches, first, last + 1) of the best overlap on any diagonal with a seed, place by place; None without a leak."""
    best = None
    for shift in range(-len(item), len(text)):
        places = [k for k in range(len(item)) if 0 <= shift + k < len(text)]
        same = {k for k in places if text[shift + k] == item[k]}
        if not any(all(k + j in same for j, c in enumerate(mask) if c == "1") and k + len(mask) <= len(item) and 0 <= shift + k and shift + k + len(mask) <= len(text) for mask in leaks.MASKS for k in places):
            continue
        score = low = begin = at = 0
        top, segment = 0, (0, 0)
        for n, k in enumerate(places, 1):
            score += leaks.MATCH if k in same else -leaks.DIFFER
            if score <= low:
                low, begin = score, n
            if score - low > top:
                top, segment = score - low, (begin, n)
        a, b = segment
        matched = sum(places[i] in same for i in range(a, b))
        if top and matched >= min(leaks.LEAST_TOKENS, leaks.LEAST_SHARE * len(item)) and matched >= leaks.LEAST_IDENTITY * (b - a):
            own = (matched, shift + places[a], shift + places[b - 1] + 1)
            best = own if best is None or (-own[0], own[1]) < (-best[0], best[1]) else best
    return best


def test_leaks_against_brute_force(spark, sf_dir, texts):
    """The whole result; pairs without seven equal words in any order can't leak and are left out of the slow version."""
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    expected = {}
    for d, t in texts.items():
        words = words_of(t)
        held = set(words)
        for i, item in items.items():
            if sum(w in held for w in item) >= 7 and len({(a, b) for a, b in zip(item, item[1:], strict=False)} & set(zip(words, words[1:], strict=False))) >= 2:
                found = brute_leaks(words, item)
                if found:
                    expected[d, i] = found
    got = {(r.doc_id, r.item_id): (r.n_matched, r.first_word, r.last_word) for r in leaks.op6(spark, sf_dir).collect()}
    assert got == expected and len(got) >= 3


def test_repeated_seeds(monkeypatch):
    """Small alphabets and very many equal seeds; hits in small parts give the same."""
    draw = random.Random(3)
    for n in range(60):
        letters = "ab" if n % 2 else "abcdefgh"
        items = [[draw.choice(letters) for _ in range(draw.randint(3, 20))] for _ in range(3)]
        texts = [[draw.choice(letters) for _ in range(draw.randint(0, 60))] + items[n % 3] for _ in range(3)]
        tokens = leaks.Tokens()
        index = leaks.Index([tokens.of(" ".join(x)) for x in items])
        arrays = [tokens.of(" ".join(x)) for x in texts]
        expected = [{i: own for i, item in enumerate(items) if (own := brute_leaks(t, item))} for t in texts]
        monkeypatch.setattr(leaks, "HITS_AT_ONCE", 1 << 20)
        assert leaks.leaks_of(index, arrays) == expected
        monkeypatch.setattr(leaks, "HITS_AT_ONCE", 5)
        assert leaks.leaks_of(index, arrays) == expected
    tokens = leaks.Tokens()
    index = leaks.Index([tokens.of("word " * 300)])
    assert leaks.leaks_of(index, [tokens.of("word " * 30_000)]) == [{0: (300, 0, 300)}]


def test_substitutions_and_blocks(spark, odd, empty):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(30)] for _ in range(6)]
    rows = []
    for i, item in enumerate(items):
        changed = [w if k % 9 != 4 else word() for k, w in enumerate(item)]
        rows.append((i, " ".join([word() for _ in range(20)] + changed + [word() for _ in range(20)])))
    rows.append((50, " ".join(word() for _ in range(80))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.first_word) for r in leaks.find_leaks(docs, bench).collect())
    assert found == [(i, i, 20) for i in range(6)]
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in leaks.find_leaks(docs, bench, block_tokens=60).collect()) == found
    assert [r.doc_id for r in leaks.without_leaks(docs, bench, block_tokens=60).collect()] == [50]
    assert leaks.without_leaks(odd, bench).count() == 8 and leaks.find_leaks(empty, bench).count() == 0 and leaks.find_leaks(docs, bench.limit(0)).count() == 0
