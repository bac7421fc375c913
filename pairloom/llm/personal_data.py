"""Personal data in plain and in disguised writing, with places in the source text.

Three transducers rewrite a text: look-alike characters to ASCII, spelled digits to digits,
at and dot disguises to their signs. Each keeps the list of its edits, so a span of its
output leads back to the characters of its input, and through all three to the source.
The detectors run on the source (the base spans) and on the rewritten text; a span found
there counts if something in it was rewritten and no base span of its kind covers it.
Every step is linear in the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, words

KINDS = ("email", "ip", "card", "phone")

# Detectors

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its run of digits begins, and possessive runs never give back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """The signs @ in turn, each with all of the local part before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield m.span()


_DETECTORS = (emails, addresses, cards, phones)

# Look-alikes beside those that Unicode itself maps to one ASCII character,
# what is invisible, and digits and signs as words of English, German, French and Spanish
# (accents are gone before words are read).
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝьѵ", "ABESIJKMHOPCTYXaeopcyxijshdqwbv"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux"))
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "ı": "i", "ℓ": "l", "ø": "o", "Ø": "O", "ß": "s", "đ": "d", "ł": "l"}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_DIGIT_WORDS = (
    "zero null cero oh", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five funf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_AT, _DOT, _PLUS = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point", "plus|mas"
#: Blocks whose compatibility mappings are look-alikes: letterlike, enclosed, wide, small, mathematical.
_BLOCKS = ((0xA0, 0xA1), (0xC0, 0x250), (0x660, 0x2000), (0x2000, 0x200B), (0x202F, 0x2030), (0x205F, 0x2060), (0x2100, 0x2150), (0x249C, 0x24EA), (0x3000, 0x3001), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1E00, 0x1F00))


def _look_alikes() -> dict[int, str]:
    """ASCII characters by code point: decimal digits of any script, letters that lose their
    accents, and what compatibility maps to one character."""
    table = {}
    for low, high in _BLOCKS:
        for point in range(low, high):
            parts = unicodedata.normalize("NFKD", chr(point))
            bare = [c for c in parts if not unicodedata.combining(c)]
            if len(bare) == 1 and bare[0].isascii():
                table[point] = bare[0]
            elif unicodedata.decimal(chr(point), None) is not None:
                table[point] = str(unicodedata.decimal(chr(point)))
    return table | {ord(a): b for a, b in (_CYRILLIC | _GREEK | _SIGNS).items()}


_FOLD = _look_alikes()
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
_UNSEEN = re.compile(f"[{_INVISIBLE}̀-ͯ]+")
_VALUE = {word: str(digit) for digit, words in enumerate(_DIGIT_WORDS) for word in words.split()}
_NUMBER = "|".join(sorted(_VALUE, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_NUMBER})(?![A-Za-z0-9])", re.I)
_GAP = re.compile(r"[ \t\n,-]{1,3}(?=\S)")
_TOKEN = re.compile(rf"(?:(?P<word>{_NUMBER})|[0-9])(?![A-Za-z0-9])|[0-9]+(?![A-Za-z0-9])", re.I)
_SPELLED_DOT = re.compile(rf"[ \t]+(?:{_DOT})[ \t]+", re.I)
_CONFUSED = re.compile(r"[OoIl|](?=[0-9])")
_PLUS_WORD = re.compile(rf"(?<![A-Za-z0-9])(?:{_PLUS})[ \t]+(?=[0-9])", re.I)
_OPEN, _CLOSE = r"[ \t]*+[\[({<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
# A match begins where its blanks begin, so a long run of blanks is read once.
_DISGUISED_AT = re.compile(rf"(?<![ \t])(?:(?P<closed>{_OPEN}(?:{_AT}|@){_CLOSE})|(?P<bare>[ \t]++(?:{_AT})[ \t]++)|(?P<sign>[ \t]*+@[ \t]*+))", re.I)
_ANY_DOT = rf"(?:{_OPEN}(?:{_DOT}|\.){_CLOSE}|[ \t]++(?:{_DOT})[ \t]++|\.)"
_TAIL_DOT = re.compile(rf"(?P<dot>{_ANY_DOT})(?P<label>[A-Za-z0-9-]+)", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_ANY_DOT}(?=[0-9])", re.I)
_CLOSED_DOT = re.compile(rf"[\[({{<][ \t]*+(?:{_DOT}|\.)", re.I)
_AT_WORDS, _DOT_WORDS, _PLUS_WORDS = (frozenset(w.split("|")) for w in (_AT, _DOT, _PLUS))
_SIGN_WORDS = _AT_WORDS | _DOT_WORDS

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits, and the way back for spans."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, before, self.starts, self.ends, self.sources = [], 0, [], [], []
        length = 0
        for start, end, new in edits:
            parts += [text[before:start], new]
            length += start - before
            self.starts.append(length)
            length += len(new)
            self.ends.append(length)
            self.sources.append((start, end))
            before = end
        self.text = "".join([*parts, text[before:]])

    def source(self, span: Span) -> Span:
        """The characters of the input that became ``span``; a part of an edit means all of it."""
        start, last = span[0], span[1] - 1
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, last) - 1
        first = start if i < 0 else self.sources[i][0] if start < self.ends[i] else start - self.ends[i] + self.sources[i][1]
        end = last + 1 if j < 0 else self.sources[j][1] if last < self.ends[j] else last - self.ends[j] + self.sources[j][1] + 1
        return first, end


def _vocabulary(text: str) -> list[str]:
    """Lower-case ASCII words: they tell which rules can apply."""
    return [w.decode() for w in words(text.encode("ascii", "replace"))]


def unseen(text: str) -> list[Edit]:
    """Invisible characters and loose accents go."""
    return [] if text.isascii() else [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)]


def spelled_digits(text: str, vocabulary: list[str]) -> list[Edit]:
    """Runs with three or more digits as words, with single digits or numbers between them,
    become runs of digits; so do letters that stand for digits, and the word before them."""
    edits, at = [], 0
    for m in _SPELLED.finditer(text) if sum(w in _VALUE for w in vocabulary) > 2 else ():
        if m.start() < at:
            continue
        run, spelled, at = [], 0, m.start()
        while token := _TOKEN.match(text, at):
            spelled += token["word"] is not None
            run.append((token.start(), token.end(), _VALUE.get(token.group().lower(), token.group())))
            dot = _SPELLED_DOT.match(text, token.end())
            gap = dot or _GAP.match(text, token.end())
            if dot:
                run.append((*dot.span(), "."))
            at = gap.end() if gap else token.end()
            if not gap:
                break
        if run[-1][2] == ".":
            run.pop()
        if spelled >= 3:
            # a token takes the gap behind it along, but for the last
            edits += [(s, run[i + 1][0] if i + 1 < len(run) else e, new) for i, (s, e, new) in enumerate(run)]
        at = run[-1][1]
    taken = Rewritten(text, edits)
    others = [(m.start(), m.end(), "0" if m.group() in "Oo" else "1") for m in _CONFUSED.finditer(text) if "0" <= text[m.start() - 1 : m.start()] <= "9"]
    if not _PLUS_WORDS.isdisjoint(vocabulary):
        others += [(*taken.source(m.span()), "+") for m in _PLUS_WORD.finditer(taken.text)]
    return _apart(edits, others)


def _apart(edits: list[Edit], others: list[Edit]) -> list[Edit]:
    """Both in order, without those of ``others`` that meet one of ``edits``."""
    kept, starts = list(edits), [e[0] for e in edits]
    for other in others:
        i = bisect_right(starts, other[0]) - 1
        if (i < 0 or edits[i][1] <= other[0]) and (i + 1 == len(edits) or other[1] <= edits[i + 1][0]):
            kept.append(other)
    return sorted(kept)


def _words_before(text: str, at: int, low: int) -> list[Edit]:
    """Dots of a local part that ends at ``at``, written as words or in brackets."""
    edits = []
    while True:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start == at or start <= low:
            return edits
        # the disguise of a dot, read backwards: blanks, a word or brackets, blanks
        end, left = start, start
        while left > low and text[left - 1] in " \t])}>":
            left -= 1
        word = left
        while word > low and (text[word - 1].isalpha() or text[word - 1] == "."):
            word -= 1
        first = word
        while first > low and text[first - 1] in " \t[({<":
            first -= 1
        if first in (low, word) or left == end or not re.fullmatch(_ANY_DOT, text[first:end], re.I) or text[first - 1] not in _LOCAL:
            return edits
        edits.append((first, end, "."))
        at = first


def disguises(text: str, vocabulary: list[str]) -> list[Edit]:
    """At signs and the dots around them; dots between digits. A bare word "at" counts only
    if a dot behind it is disguised too; brackets or a sign among blanks need a dot of any kind."""
    edits, low = [], 0
    dots = not _DOT_WORDS.isdisjoint(vocabulary) or _CLOSED_DOT.search(text) is not None
    at = "@" in text or not _AT_WORDS.isdisjoint(vocabulary) and (dots or any(c in text for c in "[({<"))
    for m in _DISGUISED_AT.finditer(text) if at else ():
        label = _LABEL.match(text, m.end())
        if m.start() < low or m.start() == 0 or not label or label.group().lower() in _SIGN_WORDS or text[m.start() - 1] not in _LOCAL:
            continue
        tail, end = [], label.end()
        while (dot := _TAIL_DOT.match(text, end)) and dot["label"].lower() not in _SIGN_WORDS:
            tail.append((dot.start("dot"), dot.end("dot"), "."))
            end = dot.end()
        disguised = any(e - s > 1 for s, e, _ in tail)
        if not tail or m["bare"] and not disguised or m["sign"] and len(m.group()) > 1 and not disguised:
            continue
        edits += sorted(_words_before(text, m.start(), low)) + [(m.start(), m.end(), "@")] + [d for d in tail if d[1] - d[0] > 1]
        low = end
    return _apart(edits, [(*m.span(), ".") for m in _NUMBER_DOT.finditer(text) if len(m.group()) > 1] if dots else [])


def rewritten(text: str) -> list[Rewritten]:
    """The chain of transducers; the last one's text is what the detectors read."""
    first = Rewritten(text, unseen(text))
    # look-alikes are one character for one, so their places stay
    folded = first.text = first.text if text.isascii() else _BEYOND_ASCII.sub(lambda m: m.group().translate(_FOLD), first.text)
    vocabulary = _vocabulary(folded)
    second = Rewritten(folded, spelled_digits(folded, vocabulary))
    return [first, second, Rewritten(second.text, disguises(second.text, vocabulary))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order; kinds by their place in :data:`KINDS`."""
    return sorted((s, kind, e) for kind, detect in enumerate(_DETECTORS) for s, e in detect(text))


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What only the rewritten text shows, at its place in ``text``."""
    steps = rewritten(text)
    final = steps[-1].text
    if final == text:
        return []
    found = set()
    by_kind = {kind: [(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))}
    for kind, detect in enumerate(_DETECTORS):
        plain = by_kind[kind]
        starts = [s for s, _ in plain]
        for s, e in detect(final):
            seen = final[s:e]
            for step in reversed(steps):
                s, e = step.source((s, e))
            i = bisect_right(starts, s) - 1
            if text[s:e] != seen and not (i >= 0 and e <= plain[i][1]):
                found.add((s, kind, e))
    return sorted(found)


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, kind, end, base)`` of all spans, by start, kind and end."""
    base = base_spans(text)
    return sorted([(*b, True) for b in base] + [(*d, False) for d in disguised_spans(text, base)])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: the spans ``(start, kind, end, base)`` of each row, in order of
    start, kind (as in :data:`KINDS`) and end; places count code points, the end is
    exclusive. One row per input row: repeated ids have a row each, a null or empty text
    has no spans, an empty table gives an empty one. Only the two columns are read.
    """

    def run(texts: list[bytes]) -> dict:
        rows = [[{"start": s, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in spans_of(raw.decode())] for raw in texts]
        return {"spans": (_SPANS, rows)}

    return map_texts(docs, run, "spans array<struct<start:bigint,kind:string,end:bigint,base:boolean>>", key, text)


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with its spans replaced by their kinds; of spans that overlap the first
    gives the name and all are covered."""
    parts, before = [], 0
    for start, kind, end, _ in spans:
        if start >= before:
            parts += [text[before:start], f"[{KINDS[kind].upper()}]"]
        before = max(before, end)
    return "".join([*parts, text[before:]])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, redacted)``: each text with its personal data masked, null as empty."""

    def run(texts: list[bytes]) -> dict:
        return {"redacted": (pa.string(), [masked(t, spans_of(t)) for t in (raw.decode() for raw in texts)])}

    return map_texts(docs, run, "redacted string", key, text)


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
