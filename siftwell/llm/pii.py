"""Personal data, also in disguise, with offsets in the source text.

A tape holds a text and, for each of its characters, the span of the source it stands for.  Transducers
rewrite tapes: homoglyphs and other digits become ASCII, invisible characters go, bracketed or spelled
"at" and "dot" become their signs, spelled digits become digits.  The detectors run on the source (base
spans) and on the tapes before and after spelled digits, whose finds map back to source spans.  A find inside a base span adds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.shared import pick, slices

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes of ASCII letters, signs and spaces.
LOOKALIKES = (
    dict(zip("аВеЕКкМНоОрРсСТтхХуУіІјЈѕЅԁһԛԝАЅ", "aBeEKkMHoOpPcCTtxXyYiIjJsSdhqwAS", strict=True))
    | dict(zip("οΟαΑΒΕΖΗΙΚΜΝΡΤΥΧνρ", "oOaABEZHIKMNPTYXvp", strict=True))
    | dict(zip("‐‑‒–—−﹣․。﹒﹫", "-------...@", strict=True))
    | dict.fromkeys("      　", " ")
)
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
DOMAINS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|uk|eu|us|ch|at|it|nl"

LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
LOOKALIKES |= {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x660, 0x1E000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.decimal(c, None) is not None and c not in LOOKALIKES}
_TABLE = {ord(c): x for c, x in LOOKALIKES.items()}
_UNSEEN = re.compile(f"[{INVISIBLE}]")
_ODD = re.compile("[" + INVISIBLE + "".join(sorted(LOOKALIKES)) + "]")

# The same matches as EMAIL and IP, found in linear time: an address around each @, quads from the first figure of a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

_WORD = "|".join(DIGIT_WORDS)
_BRACKET = re.compile(r"(?:(?<!\s)\s+)?[(\[{<]\s*(at|dot|@|\.)\s*[)\]}>]\s*", re.I)
_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{DOMAINS})\b)", re.I)
_ANY_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])\s+at\s+(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))", re.I)
_SPELLED = re.compile(rf"(?:\bplus\s+|\+\s*)?(?:\b(?:{_WORD})\b|(?<![0-9])[0-9]++)(?:(?:[\s,-]++|\.)(?:\b(?:{_WORD})\b|[0-9]++))+", re.I)
_PART = re.compile(rf"plus|{_WORD}|[\s,-]+", re.I)
_BRACKETED = re.compile(r"[(\[{<]\s*(?:at|dot|@|\.)\s*[)\]}>]")
_NAMED = re.compile(rf"\.(?:{DOMAINS})\b")
_WORD_FIRST = re.compile(rf"(?:{_WORD})(?:[\s,-]+|\.)(?:[0-9]|(?:{_WORD})\b)")
_DIGIT_FIRST = re.compile(rf"[0-9](?:[\s,-]+|\.)(?:{_WORD})\b")


def _low(text: str) -> str:
    """In lower case, with the letters that re.I takes for i and s as these."""
    low = text.lower()
    return low if low.isascii() else low.replace("i̇", "i").replace("ı", "i").replace("ſ", "s")


def _hint(text: str) -> bool:
    """Whether a transducer for words may find something (true whenever one does); cheap tests first."""
    low = _low(text)
    if "dot" in low and re.search(r"\sdot\s", low):
        return True
    if any(c in low for c in "([{<") and _BRACKETED.search(low):
        return True
    if _NAMED.search(low) and re.search(r"\sat\s", low):
        return True
    return any(w in low for w in DIGIT_WORDS) and bool(_WORD_FIRST.search(low) or _DIGIT_FIRST.search(low))


class Tape:
    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: (from, to, new text), in order; each new character stands for the whole of what it replaces."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        return Tape("".join([*text, self.text[at:]]), [*start, *self.start[at:]], [*end, *self.end[at:]])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs with a digit word as digits; whether they are a number of some kind is for the detectors to say."""
    edits = []
    for run in _SPELLED.finditer(text):
        parts = [(p, _low(p[0])) for p in _PART.finditer(text, run.start(), run.end())]
        if any(word in DIGIT_WORDS for _, word in parts):
            for p, word in parts:
                edits.append((p.start(), p.end(), "+" if word == "plus" else str(DIGIT_WORDS.index(word)) if word in DIGIT_WORDS else ""))
    return edits


def _ats(tape: Tape) -> list[tuple[int, int, str]]:
    """A spelled "at" before a known ending, or before any other if a dot is in disguise, too ("at the dot product" is prose)."""
    edits = []
    for m in _ANY_AT.finditer(tape.text):
        a, b = m.span(1)
        wide = any(tape.text[i] == "." and tape.end[i] - tape.start[i] > 1 for i in range(a, b))
        if _AT.match(tape.text, m.start()) or wide and m[1].split(".")[0].lower() not in ("a", "an", "the"):
            edits.append((*m.span(), "@"))
    return edits


def _signed(text: str) -> Tape | None:
    """The tape of a text after all transducers but that of digits; None if nothing in it calls for them."""
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not _hint(text):
        return None
    tape = Tape(text)
    if odd:
        tape = Tape(text.translate(_TABLE)).rewrite([(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)])
    tape = tape.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKET.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    return tape.rewrite(_ats(tape))


def revealed(text: str) -> Tape | None:
    """The tape of a text after all transducers; None if nothing in it calls for them."""
    tape = _signed(text)
    return tape and tape.rewrite(_spelled(tape.text))


def luhn(digits: str) -> bool:
    double = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return not (sum(map(int, digits[::-2])) + sum(double)) % 10


_NUMBER = re.compile("[0-9]")


_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str):
    """Spans of the matches of EMAIL, each character looked at once per side of an @."""
    end, at = 0, text.find("@")
    last = 0  # behind the last sign before this @ that no address holds, or behind the address before
    while at >= 0:
        for m in _NOT_LOCAL.finditer(text, last, at):
            last = m.end()
        start = max(last, end)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        last = max(at + 1, end)
        at = text.find("@", last)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order; kind is an index of KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _NUMBER.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


class _Held:
    """Spans by start, and whether one of them holds another."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, _, b in sorted(spans):
            self.starts.append(a)
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that only the transducers reveal).

    Of the latter none lies within a base span, and of those of one kind that lie in one another the widest stays.
    """
    base = detect(text)
    tape = _signed(text)
    if tape is None:
        return base, []
    found, seen = [], text
    for one in (tape, tape.rewrite(_spelled(tape.text))):  # a digit word beside a number may spoil it
        if one.text != seen:
            found.append([(one.start[a], kind, one.end[b - 1]) for a, kind, b in detect(one.text)])
        seen = one.text
    added: list[tuple[int, int, int]] = []
    for spans in found:
        known = _Held(base + added)
        spans = [s for s in spans if not known.holds(s[0], s[2])]
        wide = [_Held([s for s in spans if s[1] == k]) for k in range(len(KINDS))]
        added = [s for s in added if not wide[s[1]].holds(s[0], s[2])]
        top = -1
        for a, kind, b in sorted(set(spans), key=lambda s: (s[0], -s[2], s[1])):
            if b > top:  # what starts later and ends no later lies within another
                added.append((a, kind, b))
                top = b
    return base, sorted(added)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spelled_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _run(batches):
    for part in slices(batches, "text"):
        columns = [[] for _ in range(8)]
        for text in part.column(1).to_pylist():
            base, added = find(text or "")
            kinds = [k for _, k, _ in base]
            values = [*(kinds.count(k) for k in range(4)), len(added), spelled_out(base), spelled_out(base + added), redact(text, base + added) if text is not None else None]
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        kinds = [*[pa.int64()] * 5, *[pa.string()] * 3]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(part.column(i) for i in range(2, part.num_columns))], NAMES + part.schema.names[2:])


NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_spans", "spans", "redacted"]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Returns per input row: doc_id long, n_email, n_ip, n_card, n_phone long (base spans), n_added long (spans
    that only show once disguises are undone), base_spans and spans string (kind:start:end by start, then
    kind, comma-joined; code points, end exclusive), redacted string (null for a null text).

    Null or empty text: no spans.  Null and repeated ids stay as they are, row for row.  An empty table gives
    an empty result.  Other columns are ignored.
    """
    docs = pick(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    return docs.mapInArrow(_run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string, redacted string")
