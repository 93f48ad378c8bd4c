"""Operator 4, secret scans: patterns find labelled credentials, grammar inference turns them into probabilistic automata, and these score every other candidate.

Method. The base patterns' matches are the labelled credentials, one class for each kind. From a bounded sample of each class
(SAMPLE distinct values, lowest hash first) a prefix tree with counts is built over character classes; states whose
continuations don't differ by more than the Hoeffding bound are merged (red-blue order, folding kept deterministic), which gives
a stochastic automaton for each kind. Merged states loop and so forget how long strings are; lengths have a distribution of their
own, and the automaton gives the symbols, given that the string goes on. Both back off by one observation's weight: to a broad
distribution of lengths, and to the symbols of the whole sample. Another automaton is inferred in the same way from candidates
that no pattern labels.

A candidate is what base matches leave of any run of CANDIDATE's characters, whole, and its parts: each piece after a '=' or '/',
and all that follows the first '='. Candidates have ASSIGN_LEAST characters or more, as the shortest labelled credentials, with a
letter and a digit. Of secrets one within another the outer is given. A candidate is a secret if, under some kind's automaton,
(a) its mean log likelihood a symbol isn't below that of all but QUANTILE of the kind's own sample, and (b) its log odds against
the background, lengths included, reach ODDS.

Edge cases. Text null or empty: no spans. No base match in the table: no automata, so base spans only. Several rows with one
doc_id or text: each is scanned by itself. Null doc_id: passed through. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, saved

# The base kinds with their patterns and shortest lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs of [0-9a-f]+ with 32 or more characters
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "learned")

CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{ASSIGN_LEAST},}}")
SAMPLE, QUANTILE, ODDS, MERGE_ALPHA = 400, 0.01, math.log(99), 0.05


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind as listed."""
    found = []
    lowered = text.lower()  # may hold more ASCII letters than the text, never fewer
    if any(n in lowered for n in NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span) -> tuple:
    return span[0], KINDS.index(span[2])


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, value) by start, longest first; taken: base_spans()."""
    found, at = set(), 0
    for m in CANDIDATE.finditer(text):
        if m[0].isalpha() or m[0].isdigit():
            continue
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        for k in range(at, len(taken)):
            a, b = taken[k][:2]
            if a >= end:
                break
            if b > start:
                found.update(_parts(text, start, a))
                start = b
        found.update(_parts(text, start, end))
    return [(a, b, text[a:b]) for a, b in sorted(found, key=lambda x: (x[0], -x[1]))]


def _parts(text: str, start: int, end: int):
    """Places of a run and of its parts that are candidates."""
    if end - start < ASSIGN_LEAST:
        return
    cuts = [m.end() for m in _SEPARATOR.finditer(text, start, end)]
    places = [(start, end), *zip(cuts, [c - 1 for c in cuts[1:]] + [end], strict=False)]
    first = text.find("=", start, end) + 1
    for a, b in [*places, (first, end)] if first else places:
        if b - a >= ASSIGN_LEAST and _LETTER(text, a, b) and _DIGIT(text, a, b):
            yield a, b


_LETTER, _DIGIT, _SEPARATOR = re.compile("[A-Za-z]").search, re.compile("[0-9]").search, re.compile("[=/]")
#: Symbols of the automata: classes of characters. Characters of a class are alike.
_CLASS = {c: "9" for c in "0123456789"} | {c: "f" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"} | {c: "F" for c in "ABCDEF"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}
SYMBOLS = "9fzFZ+/_.=-"


def symbols(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


class Automaton:
    """Stochastic automaton inferred from strings by merging compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = MERGE_ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self.lengths = Counter(map(len, strings))
        self.strings = len(strings)
        used = Counter(c for s in strings for c in s)
        whole = used.total() + 0.5 * len(SYMBOLS)
        self.base = {c: (used[c] + 0.5) / whole for c in SYMBOLS}
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self._total(a), self._total(b)
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to state a and what follows it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, target in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def _merge_all(self) -> None:
        red, seen = [0], {0}
        blue = deque((0, c) for c in sorted(self.next[0]))
        waiting = set(blue)
        while blue:
            source, c = blue.popleft()
            waiting.discard((source, c))
            q = self.next[source][c]
            if q in seen:
                continue
            for r in red:
                if self._compatible(r, q):
                    self.next[source][c] = r
                    self._fold(r, q)
                    more = [(s, x) for s in red for x in sorted(self.next[s]) if self.next[s][x] not in seen and (s, x) not in waiting]
                    break
            else:
                red.append(q)
                seen.add(q)
                more = [(q, x) for x in sorted(self.next[q])]
            blue.extend(more)
            waiting.update(more)
        order = {q: i for i, q in enumerate(red)}
        self.next = [{c: order[t] for c, t in self.next[q].items()} for q in red]
        self.count, self.ends = [self.count[q] for q in red], [self.ends[q] for q in red]
        self.onward = [sum(x.values()) for x in self.count]

    def steps(self, s: str) -> float:
        """Log likelihood of the symbols, given the length."""
        at, total = 0, 0.0
        for c in s:
            if at is None:
                total += math.log(self.base[c])
                continue
            total += math.log((self.count[at].get(c, 0) + self.base[c]) / (self.onward[at] + 1))
            at = self.next[at].get(c)
        return total

    def log_likelihood(self, s: str) -> float:
        n = len(s)
        return self.steps(s) + math.log((self.lengths[n] + 1 / ((n + 1) * (n + 2))) / (self.strings + 1))


class Model:
    """An automaton for each kind with its floor of likelihood, and one for the background."""

    def __init__(self, labelled: dict[str, list[str]], background: list[str]):
        self.kinds = {}
        for kind, values in sorted(labelled.items()):
            strings = [symbols(v) for v in values]
            machine = Automaton(strings)
            means = sorted(machine.steps(s) / max(1, len(s)) for s in strings)
            self.kinds[kind] = (machine, means[int(len(means) * QUANTILE)])
        self.background = Automaton([symbols(v) for v in background]) if background else None

    def score(self, value: str) -> float:
        """0 to 1: probability of a credential's format at even odds; 0 if it has no kind's format."""
        s = symbols(value)
        plain = self.background.log_likelihood(s) if self.background else -(len(s) + 1) * math.log(len(SYMBOLS) + 1)
        best = max((machine.log_likelihood(s) - plain for machine, floor in self.kinds.values() if machine.steps(s) / max(1, len(s)) >= floor), default=-math.inf)
        return 1 / (1 + math.exp(-min(best, 700.0))) if best > -700 else 0.0

    def spans(self, found: list[tuple]) -> list[tuple]:
        least = 1 / (1 + math.exp(-ODDS))
        kept, reach = [], -1
        for a, b, v in found:  # by start, longest first
            if b > reach and self.score(v) >= least:
                kept.append((a, b, "learned", v))
                reach = b
        return kept


_SPAN = "array<struct<s:long,e:long,kind:string,value:string>>"


def found_in(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its base spans and its other candidates (kind null)."""
    id_type = dict(docs.dtypes)[id_col]

    def make():
        def do(columns):
            base, rest = [], []
            for text in columns["_text"]:
                own = base_spans(text or "")
                base.append([dict(zip(("s", "e", "kind", "value"), x, strict=True)) for x in own])
                rest.append([{"s": a, "e": b, "kind": None, "value": v} for a, b, v in candidates(text or "", own)])
            return {"doc_id": columns["_id"], "base": base, "rest": rest}

        return do

    return by_batch(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), make, f"doc_id {id_type}, base {_SPAN}, rest {_SPAN}")


def fit(found: DataFrame, sample: int = SAMPLE) -> Model:
    """Automata from at most `sample` distinct values a kind and of the background (found: found_in()'s rows, best saved)."""

    def values(spans: DataFrame) -> list[str]:
        return [r.value for r in spans.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(sample).collect()]

    base = found.select(F.explode("base").alias("x")).select("x.kind", "x.value")
    labelled = {k: v for k in KINDS[:3] if (v := values(base.where(F.col("kind") == k)))}
    return Model(labelled, values(found.select(F.explode("rest").alias("x")).select("x.value")))


def judged(found: DataFrame, model: Model) -> DataFrame:
    """found_in()'s rows as doc_id, spans (all kinds; start, then kind as listed) and the best score of the document's candidates."""
    id_type = dict(found.dtypes)["doc_id"]

    def make():
        def do(columns):
            spans, score = [], []
            for base, rest in zip(columns["base"], columns["rest"], strict=True):
                own = [(x["s"], x["e"], x["kind"], x["value"]) for x in base]
                more = model.spans([(x["s"], x["e"], x["value"]) for x in rest])
                spans.append([dict(zip(("s", "e", "kind", "value"), x, strict=True)) for x in sorted(own + more, key=_place)])
                score.append(max((model.score(x["value"]) for x in rest), default=0.0))
            return {"doc_id": columns["doc_id"], "spans": spans, "score": score}

        return do

    return by_batch(found.select("doc_id", "base", "rest"), make, f"doc_id {id_type}, spans {_SPAN}, score double")


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    found = saved(found_in(docs, text_col, id_col), "secrets")
    return judged(found, fit(found, sample))


def masked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mask: str = "[SECRET]", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret's span replaced by mask, and length_col (if there is such a column) as long as the text is then.

    Scans twice, once to learn the automata and once to mask, so that no text is shuffled."""
    model = fit(saved(found_in(docs, text_col, id_col).where((F.size("base") > 0) | (F.size("rest") > 0)), "secrets"))
    columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def make():
        def do(got):
            for i, text in enumerate(got[text_col]):
                base = base_spans(text or "")
                spans = sorted(base + model.spans(candidates(text or "", base)), key=_place)
                if spans:
                    out, at = [], 0
                    for a, b, *_ in spans:
                        if b > at:
                            out += [text[at : max(a, at)], mask] if a >= at else []
                            at = b
                    got[text_col][i] = changed = "".join([*out, text[at:]])
                    if length_col in columns:
                        got[length_col][i] = len(changed)
            return got

        return do

    return by_batch(docs, make, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """Numbers of spans by kind, the base spans' digest and all spans of every document; score: of its best candidate."""
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    n_of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.kind != "learned")
    return found.select("doc_id", n_of("assign").alias("n_assign"), n_of("access").alias("n_access"), n_of("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), "score")
