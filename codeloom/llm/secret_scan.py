"""Secret scans: fixed patterns, and assignment-aware lexing of what they miss.

The lexer reads source and configuration syntax (``name = "literal"``, ``name: literal``, ``:=``,
``=>``, quoted and indexed names, XML elements, command-line options, passwords in URLs) into pairs
of a name and a literal or another name. Constants are propagated over the whole text: a name that is
assigned another name gets the literal that this one had last, or, if it had none yet, gets next. A literal is scored by how
sensitive the name is that it reaches and by its own shape, so ``key = "..."; db_password = key`` marks the literal in the
first statement, in either order. Time and memory are linear in a text: values are held by position,
and those of one run of characters that end together (``a:b:c``) are scored in one pass from its end.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_extend, utf8

# The base patterns, their kinds in order, and the least length of what they hold.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Name parts that say how sensitive a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authtoken": 1.0,
}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("db", "pass"): 0.9}
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|your[_-]|dummy|redacted|undefined")
_LAST_LETTERS = max(map(len, ("example", "changeme", "change_me", "placeholder", "your_", "dummy", "redacted", "undefined")))

#: What a sensitive name holds when only its letters are left: words may be in any case and parted by any sign.
_HINTS = tuple(sorted({w.encode() for w in SENSITIVE} | {"".join(p).encode() for p in PAIRS}))
_SIGNS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
_NAME = r"[A-Za-z_$][\w$.\-]*"
_QUOTED = r"(?:[bBrRuUfF]{0,2})(?:\"\"\"(?P<q3>(?:[^\\]|\\.)*?)\"\"\"|\"(?P<q2>(?:[^\"\\\n]|\\.)*)\"|'(?P<q1>(?:[^'\\\n]|\\.)*)'|`(?P<q0>[^`\n]*)`)"
# what a value without quotes may hold; where it ends is looked up, so that nested ones don't read it again
_BARE = re.compile(r"[^\s;,\"'`<>(){}\[\]]+", re.ASCII)
_STATEMENT = re.compile(
    rf"(?:\[\s*[\"'](?P<index>[^\"'\n]+)[\"']\s*\]|[\"'](?P<quoted>{_NAME})[\"']|(?<![\w$.\-])(?P<name>{_NAME}))"
    rf"\s*(?::\s*[A-Za-z_][\w.<>\[\]]*\s*(?==)(?!==))?(?P<op>:=|=>|=(?!=)|:)[ \t]*"
    # the value of a key may stand alone on the next line
    rf"(?:(?<=[: \t])(?:[|>][+-]?[ \t]*)?\r?\n[ \t]+(?=[^\s:]+[ \t]*(?:\r?\n|$)))?"
    rf"(?:{_QUOTED}|(?P<ref>[A-Za-z_$][\w$.]*)(?=\s*(?:[;,)\]}}\n]|$))|(?P<bare>(?=[^\s;,\"'`<>(){{}}\[\]])))",
    re.ASCII | re.DOTALL,
)
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>", re.ASCII)
_OPTION = re.compile(rf"(?<!\S)--?(?P<name>{_NAME})[ =](?P<value>[^\s\"'-][^\s\"']*)", re.ASCII)
_URL = re.compile(r"://[^\s:/@]+:(?P<value>[^\s:/@]+)@", re.ASCII)
_SCHEME = re.compile(r"[\w+.-]", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is, 0 to 1, by its words in camel, snake, kebab or dotted case."""
    words = [w.lower() for w in _PARTS.findall(name.rpartition(".")[2] or name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for pair in zip(words, words[1:], strict=False):
        best = max(best, PAIRS.get(pair, 0.0), SENSITIVE.get("".join(pair), 0.0))
    return best


class Shape:
    """What a literal's score depends on, of a literal that grows to the left."""

    def __init__(self, text: str, stop: int) -> None:
        self.text, self.start, self.stop = text, stop, stop
        self.counts: dict[str, int] = {}
        self.weight = 0.0  # the sum of c * log2(c) over the characters' numbers c
        self.kinds = 0  # bits: small letters, capitals, digits, others
        self.blank = self.placeholder = False

    def grow(self, start: int) -> None:
        text, counts = self.text, self.counts
        for k in range(self.start - 1, start - 1, -1):
            c = text[k]
            n = counts.get(c, 0)
            counts[c] = n + 1
            self.weight += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
            if not n:
                self.kinds |= 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8
                self.blank |= c.isspace()
        self.placeholder = self.placeholder or bool(PLACEHOLDER.search(text, start, min(self.start + _LAST_LETTERS, self.stop)))
        self.start = start

    def score(self, quoted: bool) -> float:
        text, start, stop = self.text, self.start, self.stop
        n = stop - start
        if n < 8 or self.blank or self.placeholder or len(self.counts) == 1:
            return 0.0
        first, last = text[start], text[stop - 1]
        if (first == "<" and last == ">") or (first == "{" and text.startswith("{{", start) and text.endswith("}}", start, stop)) or (first == "$" and text.startswith("${", start) and last == "}"):
            return 0.0
        if first == "%" and last == "%" and re.compile(r"%\w+%").fullmatch(text, start, stop):
            return 0.0
        kinds = self.kinds.bit_count()
        if kinds == 1 and not quoted:
            return 0.0
        entropy = max(0.0, math.log2(n) - self.weight / n)
        # rounded: the order in which the characters were counted makes no difference
        return round(min(1.0, 0.25 * min(n, 20) / 20 + 0.5 * min(entropy, 4.0) / 4.0 + 0.125 * (kinds - 1)), 9)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: length, entropy and mixture of characters."""
    shape = Shape(value, len(value))
    shape.grow(0)
    return shape.score(quoted)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def pairs(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, sort, name) by start: sort is literal, bare or ref; start and stop are the value's."""
    out = []
    at, run = 0, (0, 0)
    while m := _STATEMENT.search(text, at):
        name = m["index"] or m["quoted"] or m["name"]
        group = next(g for g in ("q3", "q2", "q1", "q0", "ref", "bare") if m[g] is not None)
        start, stop = m.span(group)
        if group == "bare":
            if start >= run[1]:
                run = _BARE.match(text, start).span()
            stop = run[1]
        out.append((start, stop, group if group in ("ref", "bare") else "literal", name))
        # after a name that is a value, go on at the value: it may be the name of the next statement
        at = max(start, m.start() + 1) if group in ("ref", "bare") else m.end()
    for pattern in (_ELEMENT, _OPTION):
        out += [(*m.span("value"), "bare", m["name"]) for m in pattern.finditer(text)]
    for m in _URL.finditer(text):
        k = m.start() - 1
        while k >= 0 and _SCHEME.match(text, k) and not (text[k].isascii() and text[k].isalpha()):
            k -= 1
        if k >= 0 and text[k].isascii() and text[k].isalpha():
            out.append((*m.span("value"), "literal", "password"))
    return sorted(out, key=lambda p: p[0])


def _sources(text: str, found: list[tuple[int, int, str, str]]) -> list[int]:
    """For each statement the one whose literal its name gets: itself, or where the names lead that are its values. Names that
    lead round in a circle are their own literals."""
    latest: dict[str, int] = {}
    waiting: dict[str, list[int]] = {}
    to = list(range(len(found)))
    for k, (start, stop, sort, name) in enumerate(found):
        for other in waiting.pop(name, ()):
            to[other] = k
        if sort == "ref":
            value = text[start:stop]
            if value in latest:
                to[k] = latest[value]
            else:
                waiting.setdefault(value, []).append(k)
        latest[name] = k
    done = [t == k for k, t in enumerate(to)]
    for k in range(len(to)):
        way, here = [], {}
        while not done[k] and k not in here:
            here[k] = len(way)
            way.append(k)
            k = to[k]
        if not done[k]:  # a circle
            for own in way[here[k] :]:
                to[own], done[own] = own, True
            way = way[: here[k]]
        for own in way:
            to[own], done[own] = to[k], True
    return to


def lexed_spans(text: str, least: float = 0.6) -> list[tuple[int, int, str, float]]:
    """(start, stop, name, score) of literals that reach a sensitive name with ``least`` or more, by start."""
    letters = text.encode("utf-8", "replace").lower().translate(None, _SIGNS)
    if not any(h in letters for h in _HINTS) and "://" not in text:
        return []
    found = pairs(text)
    scores = {name: name_score(name) for name in {p[3] for p in found}}
    wanted: dict[tuple[int, int, bool], tuple[float, str]] = {}
    for (_, _, _, name), source in zip(found, _sources(text, found), strict=True):
        if scores[name] >= least:
            start, stop, sort, _ = found[source]
            key = stop, start, sort == "literal"
            if scores[name] > wanted.get(key, (0.0, ""))[0]:
                wanted[key] = scores[name], name
    best: dict[tuple[int, int], tuple[float, str]] = {}
    shape = Shape(text, -1)
    for (stop, start, quoted), (score, name) in sorted(wanted.items(), reverse=True):
        if stop != shape.stop or start > shape.start:
            shape = Shape(text, stop)
        shape.grow(start)
        own = score * shape.score(quoted)
        if own >= least and own > best.get((start, stop), (0.0, ""))[0]:
            best[start, stop] = own, name
    return [(a, b, name, score) for (a, b), (score, name) in sorted(best.items())]


def scan_text(text: str, least: float = 0.6) -> list[dict]:
    """All spans of a text by start, then kind. Lexed ones that a base span covers are left out."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "stop": b, "name": None, "score": 1.0} for a, b, k in base]
    at, covered = 0, -1  # of the base spans that start up to here: the furthest end
    for a, b, name, score in lexed_spans(text, least):
        while at < len(base) and base[at][0] <= a:
            covered = max(covered, base[at][1])
            at += 1
        if b > covered:
            out.append({"kind": "lexed", "start": a, "stop": b, "name": name, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def masked(text: str, spans: list[dict], mask: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mask]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,stop,name,score>>): secrets in each whole text.

    Positions are in code points, ends exclusive; spans go by start, then kind. Null text has no
    spans. Ids of any type and null pass through, repeated rows are scanned each, other columns are ignored.
    """

    def work(part: pa.RecordBatch) -> dict:
        return {"spans": [scan_text(t.decode("utf-8", "replace"), least) for t in utf8(part.column("text"))]}

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_extend(source, work, "spans array<struct<kind:string,start:long,stop:long,name:string,score:double>>", by="text").select("doc_id", "spans")


def redact_secrets(docs: DataFrame, *, least: float = 0.6, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text column masked; null stays null, texts without secrets stay as they are."""

    def work(part: pa.RecordBatch) -> dict:
        out = []
        for text in part.column(text_col).cast(pa.binary()).to_pylist():
            plain = (text or b"").decode("utf-8", "replace")
            spans = scan_text(plain, least)
            out.append(masked(plain, spans, mask).encode() if spans else text)
        return {text_col: pa.array(out, pa.binary()).view(pa.string()) if out else pa.array([], pa.string())}

    return arrow_extend(docs, work, f"{text_col} string", by=text_col)
