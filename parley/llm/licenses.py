"""Operator 1, licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser reads licence expressions.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in text whose A-Z are lower-cased. Phrases stand as
consecutive words. After an identifier tag ("SPDX-License-Identifier:"; "License:" in metadata form is not read) the licence
expression is parsed with the precedence WITH > AND > OR and evaluated: `allowed` tells whether the document may be used under the
given set of permissive licence identifiers (AND needs all, OR any; WITH, which stands between one identifier and one exception,
the identifier's own), `ids` lists what the expression names. A licence's label is its identifier up to its version, so
cc-by-nc-nd-4.0 is cc-by-nc-nd and not cc-by.

Edge cases. Text null or empty: zero words, no labels, score 0. A malformed expression, which is also one with more words or
parentheses after it (the end of a comment may follow): its identifiers before the fault count, the expression isn't allowed. Repeated rows and ties: each row is read by itself. Null doc_id: passed through. Very long texts: linear time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import by_batch

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "all rights reserved": "reserved",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
# Identifiers of licences that allow use of every kind, without their "+".
PERMISSIVE = frozenset(
    "0bsd apache-1.0 apache-1.1 apache-2.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 isc mit mit-0 unlicense zlib".split()
)
#: How sure each kind of evidence is.
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.6}

WORD_BREAKS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_TAG = re.compile(r"spdx-license-identifier[\x20\t]*:[\x20\t]*([^\n]*)")
_TOKEN = re.compile(r"[\x20\t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)")
_VERSION = re.compile(r"(?:-v?\d.*|\+)$")
#: What may follow an expression: blanks and the end of a comment or string.
_NOTHING_ELSE = re.compile(r"""\s*(?:\*+/|-->|[*#%]?\}|\*\)|\?>|[#*;.,"'`]+)?\s*\Z""")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The identifier up to its version."""
    return _VERSION.sub("", identifier) or identifier


def to_postfix(source: str) -> tuple[list[str], bool]:
    """Shunting-yard: (postfix tokens, whether a whole expression and nothing else was read). Stops before the first token that can't continue."""
    out, stack, at, operand_next, opened = [], [], 0, True, 0
    single = ""  # what the last token leaves to its left for WITH: "id", "exception" or nothing
    while m := _TOKEN.match(source, at):
        token = m[1]
        operator = token in PRECEDENCE
        if operand_next:
            if token == "(" and not (stack and stack[-1] == "with"):
                stack.append(token)
                opened += 1
            elif operator or token in "()":
                break
            else:
                out.append(token)
                operand_next, single = False, "exception" if stack and stack[-1] == "with" else "id"
        elif operator and not (token == "with" and single != "id"):
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == ")" and opened:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened, single = opened - 1, ""
        else:
            break
        at = m.end()
    whole = not operand_next and not opened and _NOTHING_ELSE.match(source, at) is not None
    if operand_next:  # operators without their right side
        while stack and stack[-1] in PRECEDENCE:
            stack.pop()
    out += [x for x in reversed(stack) if x != "("]
    return out, whole


def evaluate(postfix: list[str], permissive: frozenset = PERMISSIVE) -> tuple[bool, list[str]]:
    """(allowed, the expression's licences in order; exceptions after WITH aren't licences)."""
    stack: list[bool] = []
    named: list[str] = []
    for token in postfix:
        if token == "with":
            named.pop()
            stack.pop()
        elif token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if token == "and" else a or b)
        else:
            stack.append(token.removesuffix("+") in permissive)
            named.append(token)
    return len(stack) == 1 and stack[0], named


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, phrase, label))
    found.make_automaton()
    return found


def scan(text: str | None, machine, permissive: frozenset = PERMISSIVE) -> dict:
    lowered = (text or "").encode("utf-8", "surrogatepass").lower()
    words = lowered.translate(WORD_BREAKS).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    places, base, labels, kinds, ids, allowed = [], set(), set(), set(), [], []
    done = at_word = 0
    hits = []
    for end, (kind, phrase, label) in machine.iter(line):
        start = end - len(phrase) - 1
        hits.append((start, kind, label))
    for start, kind, label in sorted(hits):
        at_word += line.count(" ", done, start)
        done = start
        kinds.add(kind)
        if label:
            labels.add(label)
        if kind == "base":
            base.add(label)
            places.append(at_word)
    if "tag" in kinds:
        for m in _TAG.finditer(lowered.decode("utf-8", "surrogatepass")):
            postfix, whole = to_postfix(m[1])
            ok, named = evaluate(postfix, permissive)
            allowed.append(whole and ok)
            ids += named
            labels.update(map(family, named))
    miss = 1.0
    for kind in kinds:
        miss *= 1 - WEIGHTS[kind]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": round(1 - miss, 6), "ids": ",".join(ids), "allowed": all(allowed) if allowed else None,
    }


def licences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", permissive: frozenset = PERMISSIVE) -> DataFrame:
    """One row per document; ids: identifiers in licence expressions; allowed: whether all expressions allow use (null: none)."""
    id_type = dict(docs.dtypes)[id_col]

    def make():
        machine = automaton()

        def do(columns):
            rows = [scan(x, machine, permissive) for x in columns["_text"]]
            return {"doc_id": columns["_id"]} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "ids", "allowed")}

        return do

    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, ids string, allowed boolean"
    return by_batch(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), make, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return licences(table(spark, sf_dir, "documents"))
