"""Personal data against the plain patterns, and disguises that must lead back to their source."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import personal_data
from pairloom.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def named(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


@given(st.text(alphabet="ab@.+- 0129()%é𝒳", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert personal_data.base_spans(text) == plain_base(text)


def test_base_spans_of_long_runs():
    for text in ("1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "a@b@c.d@e.f", "+1 (988) 555-2485+49301234567890123"):
        assert personal_data.base_spans(text) == plain_base(text)
    for text in ("a" * 300_000, "1" * 300_000, " " * 300_000, "1." * 150_000, "one " * 100_000, "a@" * 100_000, "a at b dot " * 50_000, "( " * 100_000):
        personal_data.spans_of(text)  # ends in linear time


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_over_the_given_table(spark, folder):
    path = f"/root/testdata/{folder}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_personal_data"](spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(named(base).encode()).hexdigest()
        assert set(filter(None, named(base).split(","))) <= set(r.spans.split(","))


WIDE = {c: chr(ord(c) + 0xFEE0) for c in map(chr, range(33, 127))}
WORDS = "zero one two three four five six seven eight nine".split()
DISGUISES = {
    "email": ["john at example dot com", "john.doe [at] example [dot] co [dot] uk", "foo(at)bar.com", "j dot doe { at } mail dot example", "a_b arroba correo punto es",
              "jоhn@example.com", "".join(WIDE[c] for c in "john@example.com"), "jo​hn@exa​mple.com", "rené@exemple.fr", "x @ example dot com", "𝐣𝐨𝐡𝐧@example.com"],
    "ip": ["192 dot 168 dot 0 dot 1", "192[.]168[.]0[.]1", "one nine two dot one six eight dot one dot one", "１９２.168.0.1", "l0.1.1.1".replace("l0", "1O1")],
    "card": [" ".join(WORDS[int(d)] for d in "4111111111111111"), "４１１１ 1111 1111 1111", "4111–1111–1111–1111", "4111 1111 1111 1l11", "vier eins eins eins 1111 1111 1111"],
    "phone": ["plus four four two zero seven nine four six zero nine five eight", "+٤٩ 30 1234 5678", "+1 988 five five five 2485", "＋1 (988) 555-2485"],
}


@pytest.mark.parametrize("kind,written", [(k, w) for k, ws in DISGUISES.items() for w in ws])
def test_disguised_spans_lead_back_to_the_source(kind, written):
    for before, after in (("", ""), ("Été 𝒳​ — call: ", " , please."), ("\n", "\nune autre ligne")):
        spans = [(s, e) for s, k, e, base in personal_data.spans_of(before + written + after) if not base and personal_data.KINDS[k] == kind]
        assert spans == [(len(before), len(before + written))]


@pytest.mark.parametrize("text", [
    "We met at noon. The dot was red.", "look at github.com for more", "one two three four five", "Nous avons un chat et deux chiens, un point c'est tout.",
    "Version 1.2.3 of 2024-01-02, 12–14 pages, 3 (three) dots ...", "at at at dot dot dot", "an der Uni (at least) 2.5 m", "été à la plage – neuf heures",
])
def test_clean_text_has_no_spans(text):
    assert personal_data.spans_of(text) == []


def test_random_texts_map_to_their_source():
    draw = random.Random(4)
    pieces = ["john", " at ", "(at)", "@", " dot ", ".", "com", "é", "​", "one ", "1", "4111", " ", "１", "+", "plus ", "-", "[.]", "\n", "О"]
    for _ in range(3_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(20)))
        spans = personal_data.spans_of(text)
        base = plain_base(text)
        assert [s[:3] for s in spans if s[3]] == base
        for s, k, e, is_base in spans:
            assert 0 <= s < e <= len(text) and text[s:e].strip() == text[s:e]
            assert is_base or not any(b[1] == k and b[0] <= s and e <= b[2] for b in base)


def test_every_row_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a@b.co", 1), (1, "a@b.co", 1), (2, None, 1), (3, "", 1), (None, "x at y dot zz", 1), (4, "w " * 400_000 + "a@b.co", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.redacted[-7:]) for r in personal_data.redact(docs).collect()}
    assert got == {(1, "[EMAIL]"), (2, ""), (3, ""), (None, "[EMAIL]"), (4, "[EMAIL]")}
    assert personal_data.find(docs).count() == len(rows)
    assert personal_data.find(docs.limit(0)).count() == 0


def test_masks_cover_overlapping_spans():
    text = "jоhn@example.com and 4111 1111 1111 1111"
    assert personal_data.masked(text, personal_data.spans_of(text)) == "[EMAIL] and [CARD]"
