"""Pseudonyms: permutations of small spaces, formats, links, and rows of all kinds."""

import random
import re

from weftline.llm import pii
from weftline.llm.queries import op1_pii

KEY = b"k"


def test_feistel_is_a_permutation_with_an_inverse():
    for size in (1, 2, 3, 10, 97, 1000):
        images = [pii.permute(i, size, KEY, "t") for i in range(size)]
        assert sorted(images) == list(range(size))
        assert [pii.permute(i, size, KEY, "t", back=True) for i in images] == list(range(size))
    assert [pii.permute(i, 1000, KEY, "t") for i in range(20)] != [pii.permute(i, 1000, b"other", "t") for i in range(20)]


def test_formats_stay_valid():
    text = "Card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, ip 10.20.30.40 or 2001:db8::8a2e:370:7334, tel +1 (212) 555-0147, born 1984-02-29 or 29.02.1984, Jo.Doe7@example.org, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"."
    new, spans = pii.pseudonymise(text, KEY)
    assert {k for _, _, k in spans} == set(pii.KINDS)
    assert len(new) == len(text) - len("10.20.30.40") + len(re.search(r"ip ([\d.]+) or", new)[1])
    card = re.search(r"Card ([\d ]+),", new)[1]
    assert pii.luhn_ok(card.replace(" ", "")) and card[0] == "4" and card != "4111 1111 1111 1111"
    assert pii._iban_mod(re.search(r"IBAN ([A-Z\d ]+),", new)[1].replace(" ", "")) == 1
    assert re.search(r"Zz|[A-Z][a-z]\.[A-Z][a-z]{2}\d@example\.org", new)
    year, month, day = re.search(r"born (\d{4})-(\d\d)-(\d\d)", new).groups()
    assert f"or {day}.{month}.{year}" in new  # one date, two formats
    assert not any(x in new for x in ("4111 1111", "WEST", "123-45-6789", "10.20.30.40", "555-0147", "1984", "Jo.Doe7", "04dbebab"))
    assert pii.pseudonymise(text, KEY)[0] == new != pii.pseudonymise(text, b"other")[0]


def test_what_is_not_valid_stays():
    text = "4111 1111 1111 1112 999.1.1.1 000-12-3456 31.02.2020 1234567890123456 v1.2.3.4.5 x@y room 12-34"
    assert pii.pseudonymise(text, KEY) == (text, [])


def test_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op1_pii(spark, small).collect()}
    assert found.keys() == texts.keys()
    mail = re.compile(r"[\w.]+@[\w.]+\.com")
    for k, t in texts.items():
        assert not set(mail.findall(t)) & set(mail.findall(found[k].text))
        if not re.search(r"\d", t):
            assert found[k].text == t and found[k].n_pii == 0
    assert sum(r.n_pii for r in found.values()) > 0


def test_awkward_rows(spark):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (None, "a@b.org"), (4, "a@b.org"), (4, "a@b.org"), (5, "9" * 50000), (6, " ".join(str(rng.randrange(10**9)) for _ in range(5000)))]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, n_pii int")
    found = pii.pii_pseudonyms(df, "k").collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.doc_id == 1] == [None]
    assert len({r.text for r in found if r.doc_id in (4, None)}) == 1
    assert pii.pii_pseudonyms(df.limit(0), "k").count() == 0


def values(rng):
    """A random value of each kind and way of writing."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    day = f"{rng.randrange(1, 2100):04d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}".split("-")
    number = rng.choice("3456") + d(14)
    card = number + next(c for c in "0123456789" if pii.luhn_ok(number + c))
    body = "WEST" + d(14)
    iban = f"GB{98 - pii._iban_mod('GB00' + body):02d}{body}"
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    yield from (("date", "-".join(day)), ("date", ".".join(reversed(day))), ("date", f"{int(day[2])}/{int(day[1])}/{day[0]}"), ("date", f"{day[1]}/{rng.randrange(13, 29)}/{day[0]}"))
    yield from (("card", card), ("card", " ".join(card[i : i + 4] for i in range(0, 16, 4))), ("iban", iban), ("ssn", f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"))
    yield from (("phone", f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{d(4)}"), ("phone", f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{d(4)}"), ("phone", f"+49 30 {d(4)} {d(4)}"))
    yield from (("secret", hexa), ("secret", hexa.upper()), ("secret", "AKIA" + "".join(rng.choice("ABC123") for _ in range(16))), ("secret", "ghp_" + hexa[:36]), ("secret", "sk-" + hexa[:30]))
    yield from (("email", f"Jo.{hexa[:5]}{d(2)}@example.org"), ("ipv4", ".".join(str(rng.randrange(256)) for _ in range(4))))


def test_every_value_is_found_keeps_its_shape_and_leads_back():
    rng = random.Random(9)
    shape = lambda v: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v)))
    for _ in range(150):
        for kind, value in values(rng):
            text = f"Here = {value} is it"
            new, spans = pii.pseudonymise(text, KEY)
            assert spans == [(7, 7 + len(value), kind)], value
            got = new[7 : len(new) - 6]
            assert pii.pseudonym(kind, got, KEY, True) == value
            assert pii.pseudonymise(f"x: {value}", KEY)[0] == f"x: {got}"
            if kind == "secret":
                assert len(got) == len(value) and (got.isupper(), got.islower()) == (value.isupper(), value.islower())
            elif kind != "ipv4":
                assert shape(got) == shape(value)
            assert pii.pseudonymise(f"Here = {got} is it", KEY)[1][0][2] == kind  # valid in its format again


def test_documents_against_a_plain_search(spark, small):
    """Spans are those of a plain loop over all finders and values, and the pseudonyms lead back to the whole text."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in pii.pii_pseudonyms(spark.read.parquet(f"{small}/documents.parquet"), "k").collect():
        text, taken, expected = texts[r.doc_id], set(), []
        for kind in pii.KINDS:
            for m in pii.FINDERS[kind].finditer(text):
                if not taken & set(range(*m.span())) and pii.MAKERS[kind](m[0], KEY, False) is not None:
                    taken |= set(range(*m.span()))
                    expected.append((m.start(), m.end(), kind))
        assert [(x.start, x.end, x.kind) for x in r.spans] == sorted(expected) and r.n_pii == len(expected)
        at = shift = 0
        for x in r.spans:
            new = pii.pseudonym(x.kind, text[x.start : x.end], KEY)
            assert r.text[x.start + shift : x.start + shift + len(new)] == new and pii.pseudonym(x.kind, new, KEY, True) == text[x.start : x.end]
            assert r.text[at + shift : x.start + shift] == text[at : x.start]
            at, shift = x.end, shift + len(new) - (x.end - x.start)
        assert r.text[at + shift :] == text[at:]


def test_times_other_eras_and_case():
    for text in ("2001-02-03T10:00:00Z", "on 1899-05-05.", "1/2/2020", "12/31/2020", "token=04DBEBAB91AB85687D33EEAAF9AC6990"):
        new, spans = pii.pseudonymise(text, KEY)
        assert len(spans) == 1 and len(new) == len(text) and new != text
        assert new.upper() == new or not text.startswith("token") or new[6:].isupper()


def test_many_finds_take_time_in_proportion():
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail{i}.example.org called from 10.{i % 250}.{i // 250 % 250}.7 on 2024-01-{1 + i % 28:02d}" for i in range(n))
        pii.pseudonym.cache_clear()
        began = time.perf_counter()
        found = pii.pseudonymise(text, b"k")[1]
        assert len(found) == 3 * n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(33_400) < 40 * max(seconds(1670), 0.05)


def test_versions_stay_and_more_formats_go():
    key = b"k"
    for text in ("v 1.2.3.4 and version 4.3.2.1", "ratio 1:2:3 at 10:20:30", "password: hunter", "std::vector::size", "::1"):
        assert pii.pseudonymise(text, key)[0] == text, text
    for text, value, kind in (("host 2001:db8::ff00:42:8329 up", "2001:db8::ff00:42:8329", "ipv6"), ("at FE80:0:0:0:202:B3FF:FE1E:8329,", "FE80:0:0:0:202:B3FF:FE1E:8329", "ipv6"), ('Password = "s3cret.Word9"', "s3cret.Word9", "secret")):
        new, spans = pii.pseudonymise(text, key)
        (start, end, found), = spans
        assert text[start:end] == value and found == kind and new[start:end] != value and len(new) == len(text)
        assert pii.pseudonym(kind, new[start:end], key, True) == value
