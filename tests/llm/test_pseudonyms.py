"""Pseudonyms: bijections within formats, linked values, nothing else touched."""

import re
from datetime import date

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm._shared import documents
from quillstone.llm.pseudonyms import Permutation, luhn, op6_pseudonyms, pseudonyms, pseudonymised, validated


@pytest.mark.parametrize("size", [1, 2, 3, 26, 997, 1000, 5000])
def test_permutation(size):
    p = Permutation(b"key", "x", size)
    there = [p(i) for i in range(size)]
    assert sorted(there) == list(range(size)) and [p(x, True) for x in there] == list(range(size))
    assert size == 1 or all(i != x for i, x in enumerate(there))
    assert size < 900 or there != [Permutation(b"other", "x", size)(i) for i in range(size)]


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 10**40), st.data())
def test_large_domains(size, data):
    x, p = data.draw(st.integers(0, size - 1)), Permutation(b"key", "y", size)
    assert 0 <= p(x) < size and p(p(x), True) == x != p(x)


VALUES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"],
    "ip": ["192.168.0.1", "8.8.8.8", "0.1.2.3", "255.255.255.255"],
    "ssn": ["123-45-6789", "665-01-0001", "667-99-9999"],
    "phone": ["+1 (988) 555-2485", "988-555-2485", "(988) 555-2485", "+49 30 1234567", "+1 (017) 555-7713", "+353 86 123 4567", "+7 916 123 4567"],
    "date": ["2024-02-29", "31.12.1999", "12/25/2020", "25/12/2020", "5/6/2020", "1999/01/31"],
    "email": ["Ann.B-42@mail.example.com", "x1@y.org"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
}
INVALID = ["4111111111111112", "256.1.1.1", "1.2.3", "666-12-3456", "000-12-3456", "123-00-4567", "2023-02-29", "31.13.1999", "30/30/2020", "+1 188 555 248", "+011 222 333 444", "DE89 3704 0044 0532 0130 01", "a@b", "@x.org", "1e4111111111111111", "0000000000000000", "v1.2.3.4.5"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_stays(kind, value):
    text = f"é before {value} after"
    new, found = pseudonymised(text)
    assert [f[0] for f in found] == [kind]
    other = found[0][3]
    assert other != value and new == text.replace(value, other)
    assert [f[2] for f in validated(new)] == [kind]
    assert pseudonymised(new, undo=True)[0] == text
    if kind not in ("ip", "date"):
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", other)).rpartition("@")[0]) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)).rpartition("@")[0])


def test_invalid_values_stay():
    for value in INVALID:
        assert pseudonymised(f"x {value} y") == (f"x {value} y", []), value


def test_equal_values_are_linked():
    digits = lambda s: re.sub(r"\D", "", s)
    cards = {digits(pseudonymised(v)[0]) for v in VALUES["card"][:2]}
    phones = {digits(pseudonymised(v)[0])[-10:] for v in VALUES["phone"][:3]}
    assert len(cards) == len(phones) == 1 and luhn(next(iter(cards))[:-1]) == int(next(iter(cards))[-1])
    a, b = pseudonymised("2024-02-29")[0], pseudonymised("29.2.2024")[0]
    assert tuple(map(int, a.split("-"))) == tuple(map(int, reversed(b.split("."))))
    assert pseudonymised(VALUES["ip"][0])[0] != pseudonymised(VALUES["ip"][0], b"another key")[0]


def spellings_of_a_date(day):
    y, m, d = day.year, day.month, day.day
    out = [f"{y}-{m:02d}-{d:02d}", f"{y}/{m:02d}/{d:02d}", f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{d:02d}/{m:02d}/{y}"]
    return out + ([f"{m}/{d}/{y}", f"{m:02d}/{d:02d}/{y}"] if d > 12 else [])


@settings(max_examples=150, deadline=None)
@given(st.dates(date(1900, 1, 1), date(2099, 12, 31)), st.dates(date(1900, 1, 1), date(2099, 12, 31)))
def test_every_spelling_of_a_date_is_linked(day, other):
    def reading(text):
        a, b, c = map(int, re.split("[-./]", text))
        y, m, d = (a, b, c) if a > 31 else (c, b, a)
        return date(y, d, m) if m > 12 else date(y, m, d)

    one, two = ({reading(pseudonymised(t)[0]) for t in spellings_of_a_date(x)} for x in (day, other))
    assert len(one) == len(two) == 1 and (one == two) == (day == other) and day not in one


COUNTRIES = ["1", "7", "20", "44", "49", "86", "98", "212", "353", "420", "971"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(COUNTRIES), st.text("0123456789", min_size=10, max_size=10), st.text("0123456789", min_size=10, max_size=10))
def test_every_spelling_of_a_phone_number_is_linked(head, own, other):
    def spellings(n):
        a, b, c = n[:3], n[3:6], n[6:]
        out = [f"+{head} {a} {b} {c}", f"+{head}-{a}-{b}-{c}", f"+{head}.{a}.{b}.{c}", f"+{head} ({a}) {b}-{c}", f"+{head}{n}", f"+{head} {n[:4]} {n[4:7]} {n[7:]}"]
        return out + ([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"] if head == "1" else [])

    def reading(text):
        (span,) = validated(text)
        assert span[:3] == (0, len(text), "phone")
        return re.sub(r"\D", "", pseudonymised(text)[0])[-10:]

    one, two = ({reading(t) for t in spellings(n)} for n in (own, other))
    assert len(one) == len(two) == 1 and (one == two) == (own == other) and own not in one


# Written apart from the operator: what counts as a value, and its place.
def plain_values(text):
    found = []
    for m in re.finditer(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\w|\.\d)", text, re.ASCII):
        if all(int(x) < 256 and str(int(x)) == x for x in m.groups()):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", text, re.ASCII):
        a, g, n = m[0].split("-")
        if a not in ("000", "666") and a[0] != "9" and g != "00" and n != "0000":
            found.append(("ssn", *m.span()))
    for m in re.finditer(r"(?<!\w)\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\d)", text, re.ASCII):
        found.append(("phone", *m.span()))
    return found


def test_detection_against_plain_patterns():
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    n = 0
    for text in texts:
        want = plain_values(text or "")
        got = {(kind, a, b) for a, b, kind, _ in validated(text or "")}
        assert set(want) <= got
        n += len(want)
    assert n > 20


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    rows = op6_pseudonyms(spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_values"] for r in rows)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["text"] == text) == (r["n_values"] == 0)
        assert pseudonymised(r["text"], undo=True)[0] == text
        for span in filter(None, r["spans"].split(",")):
            kind, a, b = span.split(":")
            assert text[int(a) : int(b)] not in r["text"] or kind == "date"


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "mail x1@y.org", 3), (None, "mail x1@y.org", 3), (2, "4111111111111111 " * 3000, 4), (3, "@" * 5000, 5)], "doc_id long, text string, spans int")
    rows = pseudonyms(df).collect()
    assert len(rows) == 6 and [r["text"] for r in rows if r["doc_id"] == 1 and r["text"] is None] == [None]
    assert {r["n_values"] for r in rows if r["doc_id"] == 2} == {3000} and len({r["text"] for r in rows if r["doc_id"] is None}) == 1
    assert pseudonyms(df.limit(0)).count() == 0
