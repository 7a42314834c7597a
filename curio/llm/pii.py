"""Personal data with offset-preserving deobfuscation (operator 1).

A text is first read as it is (*base* spans).  Texts that show a disguise then pass transducers, each
of which rewrites characters and keeps for every character it emits the source range that it stands
for: homoglyphs, other scripts' digits and invisible characters; digits spelled as words; at and dot
disguises.  The same detectors read the normalised text, and what they find that touches a rewritten
place is mapped back to source characters and added.  Base spans always stay.

Everything is one map over whole texts, without a shuffle.

Definedness: null is the empty text and has no spans; offsets count code points, ends exclusive; very long
texts are read whole; spans that begin together are ordered by kind, as listed; repeated rows give repeated
results; null ids are kept; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curio.llm import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans: leftmost matches without overlap, kind by kind; matches that fail a check are dropped."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        # whatever start a match has, it meets the same @ and domain
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    plus = text.find("+")
    while plus >= 0:
        if m := _PHONE.match(text, plus):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", plus, m.end()))
            plus = m.end() - 1
        plus = text.find("+", plus + 1)
    return found


class Tape:
    """A text in rewriting, with the source range of each of its characters and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string for each edit, ascending and apart; each new character stands for the whole range."""
        if not edits:
            return
        text, start, end, new, done = [], [], [], [], 0
        for a, b, put in edits:
            text += [self.text[done:a], put]
            start += [self.start[done:a], np.full(len(put), self.start[a])]
            end += [self.end[done:a], np.full(len(put), self.end[b - 1])]
            new += [self.new[done:a], np.ones(len(put), bool)]
            done = b
        self.text = "".join([*text, self.text[done:]])
        self.start = np.concatenate([*start, self.start[done:]])
        self.end = np.concatenate([*end, self.end[done:]])
        self.new = np.concatenate([*new, self.new[done:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[­ıɑɡͰ-ϿЀ-ԯ٠-٩۰-۹०-९০-৯​-‍‐-–․⁠⁰-₉−①-⑨。﹐-﹫﻿！-～\U0001d400-\U0001d7ff]")


def _plain(ch: str) -> str:
    if ch in _INVISIBLE:
        return ""
    if ch in _LOOKALIKES:
        return _LOOKALIKES[ch]
    if (digit := unicodedata.digit(ch, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


# Signs as character references or percent codes.
_ESCAPES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
_ESCAPED = re.compile("|".join(map(re.escape, _ESCAPES)), re.IGNORECASE)


def escapes(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _ESCAPES[m[0].lower()]) for m in _ESCAPED.finditer(tape.text)])


def homoglyphs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), put) for m in _ODD.finditer(tape.text) if (put := _plain(m[0])) != m[0]])


# Digits as words, from 0 to 9.
_SPOKEN = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_WORDS = {w: str(k) for line in _SPOKEN for k, w in enumerate(line.split())} | {"oh": "0"}
_ANY = "(?:" + "|".join(sorted(_WORDS, key=len, reverse=True)) + ")"
#: A run begins with a word and a separator.
_BEGINS = tuple(f"{w} " for w in _WORDS)
#: What _SPELLED matches begins with two items that this matches in lower case.
_PAIR = re.compile(rf"{_ANY}(?:[ ,.\-\n]{{1,3}}(?:{_ANY}|dot|point)|[ ,\-]{{1,2}}(?:(?:dot|point|dash|hyphen)[ ,\-]{{1,2}})?(?:{_ANY}|[0-9](?![^\W_])))")
#: Letters that re.IGNORECASE takes for i and s and lower() does not.
_LIKE_ASCII = {0x130: "i", 0x131: "i", 0x17F: "s"}
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ ,\-]{{1,2}})?{_ANY}(?:[ ,\-]{{1,2}}(?:(?:dot|point|dash|hyphen)[ ,\-]{{1,2}})?(?:{_ANY}(?![^\W_])|[0-9](?![^\W_])))+(?![^\W_])", re.IGNORECASE)
_PART = re.compile(r"[^\W_]+")
_LEAST_DIGITS = 4


def spelled_digits(tape: Tape) -> None:
    """Runs of at least four digits, most of them words, become numerals; what parts them goes."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        parts = list(_PART.finditer(tape.text, m.start(), m.end()))
        put = ["+" if (w := p[0].lower()) == "plus" else "." if w in ("dot", "point") else "-" if w in ("dash", "hyphen") else _WORDS.get(w, w) for p in parts]
        if sum(x.isdigit() for x in put) < _LEAST_DIGITS:
            continue
        for p, after, x in zip(parts, [*parts[1:], None], put, strict=True):
            edits.append((p.start(), p.end(), x))
            if after and after.start() > p.end():
                edits.append((p.end(), after.start(), ""))
    tape.rewrite(edits)


_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase)", r"(?:dot|punto|punkt|point)"
_CLOSED_AT = rf"\s?[\[({{<]\s?(?:{_AT_WORD}|a|@)\s?[\])}}>]\s?"
_CLOSED_DOT = rf"\s?[\[({{<]\s?(?:{_DOT_WORD}|\.)\s?[\])}}>]\s?"
_HIDDEN_DOT = rf"(?:{_CLOSED_DOT}|\s{_DOT_WORD}\s)"
_AT = re.compile(rf"(?P<closed>{_CLOSED_AT})|(?P<word>(?<=[A-Za-z0-9])\s{_AT_WORD}\s(?=[A-Za-z0-9]))|(?P<plain>\s?@\s?)", re.IGNORECASE)
_SPOKEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_HIDDEN_DOT}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_SPOKEN_LOCAL = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:{_HIDDEN_DOT}|\.)[A-Za-z0-9_%+-]+)*\Z", re.IGNORECASE)
_DOTS = re.compile(_HIDDEN_DOT, re.IGNORECASE)
_SPACED = re.compile(r"(?P<left>[A-Za-z0-9._%+-]+) @ (?P<right>[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)* \. [A-Za-z]{2,})(?![A-Za-z0-9-])")
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_HIDDEN_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_HINT = re.compile(rf" @ |[\[({{<]\s?(?:{_AT_WORD}|a|{_DOT_WORD}|@|\.)\s?[\])}}>]|\s{_DOT_WORD}\s", re.IGNORECASE)
_HINTED = ("dot", "punto", "punkt", "point", " @ ")
_REACH = 120
# Last labels that make plain words ("jane at example dot com") an address.
_LAST_LABELS = frozenset("com org net edu gov mil int info biz name pro dev app io ai co me tv cc us uk eu de fr es it nl be ch at dk se no fi pl cz pt gr ie ru ua tr br mx ar cl ca au nz jp cn kr in za example test invalid local".split())


def at_dot(tape: Tape) -> None:
    """Spoken or bracketed at and dot become signs where together they read as an address; a bare "at" needs a hidden dot behind it."""
    edits: dict[tuple[int, int], str] = {}
    text, done = tape.text, 0
    for m in _AT.finditer(text):
        if m.start() < done or not (right := _SPOKEN_DOMAIN.match(text, m.end())):
            continue
        dots = list(_DOTS.finditer(text, right.start(), right.end()))
        if not m["closed"] and not dots:
            continue
        if m["word"] and right[0].rsplit(None, 1)[-1].rpartition(".")[2].lower() not in _LAST_LABELS:
            continue
        low = max(done, m.start() - _REACH)
        if not (left := _SPOKEN_LOCAL.search(text, low, m.start())):
            continue
        dots += _DOTS.finditer(text, left.start(), left.end())
        edits[m.start(), m.end()] = "@"
        edits |= {(d.start(), d.end()): "." for d in dots}
        done = right.end()
    for m in _SPACED.finditer(text):
        low, high = m.span("right")
        if len(last := m["right"].rsplit(None, 1)[-1].lower()) > 2 and last in _LAST_LABELS and not any(a < high and b > m.start() for a, b in edits):
            edits[m.end("left"), low] = "@"
            edits |= {(low + d.start(), low + d.end()): "." for d in re.finditer(r" ?\. ?", m["right"])}
    for m in _SPOKEN_IP.finditer(text):
        edits |= {(d.start(), d.end()): "." for d in _DOTS.finditer(text, m.start(), m.end())}
    tape.rewrite([(a, b, put) for (a, b), put in sorted(edits.items()) if b > a])


def _may_spell(text: str) -> bool:
    """Whether _SPELLED can match; cheap where it cannot."""
    low = (text if text.isascii() else text.translate(_LIKE_ASCII)).lower()
    flat = low.replace(",", " ").replace("-", " ")
    return any(w in flat for w in _BEGINS) and _PAIR.search(low) is not None


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows."""
    # cheap tests of substrings first: nearly all texts end here
    odd = not text.isascii() and _ODD.search(text)
    low = text.lower()
    words = _may_spell(text)
    hint = (any(w in low for w in _HINTED) or any(c in text for c in "[({<")) and _HINT.search(text)
    escaped = ("&" in text or "%40" in text) and _ESCAPED.search(text)
    if not (odd or words or hint or escaped):
        return []
    tape = Tape(text)
    if escaped:
        escapes(tape)
    if odd:
        homoglyphs(tape)
    spelled_digits(tape)
    at_dot(tape)
    changed = np.concatenate(([0], np.cumsum(tape.new)))
    # characters that were deleted leave a gap in the source
    gap = np.concatenate(([0], np.cumsum(tape.start[1:] != tape.end[:-1]))) if len(tape.text) else np.zeros(1, np.int64)
    have = set(base)
    out = []
    for kind, a, b in detect(tape.text):
        if changed[b] > changed[a] or gap[b - 1] > gap[a]:
            span = (kind, *tape.source(a, b))
            if span not in have:
                have.add(span)
                out.append(span)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SCHEMA = "spans array<struct<kind:string,start:long,end:long,disguised:boolean>>"


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), masked: bool = False) -> DataFrame:
    """The columns ``keep``, ``spans`` (kind, start, end, disguised) and, with ``masked``, the text with each span replaced by its kind."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = text or ""
                base = detect(text)
                both = [(s, False) for s in base] + [(s, True) for s in disguised(text, base)]
                both.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
                spans.append([{"kind": k, "start": a, "end": b, "disguised": d} for (k, a, b), d in both])
                if masked:
                    out, done = [], 0
                    for (k, a, b), _ in both:
                        if b > done:
                            out += [text[done:a], f"<{k}>" if a >= done else ""]
                            done = b
                    clean.append("".join([*out, text[done:]]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
            arrays = [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(spans, kind), *([pa.array(clean, pa.string())] if masked else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "spans", *(["masked"] if masked else [])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rows, ", ".join([*fields, SCHEMA, *(["masked string"] if masked else [])]))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and the digest of the base spans, and all spans in writing."""
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda s: ~s["disguised"])
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"), F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(common.read(spark, sf_dir, "documents")))
