"""Format-preserving pseudonyms for personal data.

Validated values (card numbers by Luhn, IBANs by mod 97, social security numbers, IPv4 octets, IPv6 groups, phone numbers, calendar
dates, e-mail addresses, secrets given to a key, named as a password or with a known prefix) are replaced by a keyed permutation of the value
space of their format: a Feistel network over the space's index, walked along its cycle until it lands inside. Equal
values get equal pseudonyms in every document, different values different ones; a pseudonym is valid in its format again and
has the value's length and case (octets of addresses may change their number of digits). With the key each leads back to its value.

What is not found: times of day, dates with month names (3 March 1990), phone numbers without separators (ten digits may be
anything), other kinds of secrets. Four numbers behind a ``v`` or the word version are a version, not an address.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

ROUNDS = 8
#: Years that dates are exchanged within: first and one past the last.
ERAS = ((1, 1000), (1000, 1900), (1900, 2100), (2100, 10000))
#: Days and months whose numbers look alike: one or two digits, and days that can be no month.
DAY_CLASSES, MONTH_CLASSES = ((1, 10), (10, 13), (13, 32)), ((1, 10), (10, 13))
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX = DIGITS + LOWER[:6]

FINDERS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])"),
    "secret": re.compile(
        r"(?i:(?<=[\"'=: ])(?<![0-9a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9a-z]))"
        r"|(?i:\b(?:password|passwd|pwd|passphrase|api[_-]?key|secret[_-]?key|access[_-]?token)\b[\"']?[ \t]*[:=][ \t]*[\"']?)(?P<value>(?=[A-Za-z_.!@#$%^&*+-]*\d)(?=[\d_.!@#$%^&*+-]*[A-Za-z])[A-Za-z0-9_.!@#$%^&*+-]{6,64})(?![\w.!@#$%^&*+-])"
        r"|(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9_-])"
    ),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "date": re.compile(r"(?<![\w.-])(?:\d{4}([-/])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?=T\d\d:\d\d|[^\w-]|\Z)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:]|\.\d)"),
    "ipv4": re.compile(r"(?<![\w.])(?<!\b[vV] )(?<!\b[vV]\.)(?<!\b[vV]er )(?<!ersion )\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"),
    "phone": re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
}
KINDS = tuple(FINDERS)


def _round(key: bytes, tweak: str, i: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    data = value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
    return int.from_bytes(hashlib.shake_256(b"%s|%s|%d|%d|%s" % (key, tweak.encode(), i, bits, data)).digest(size), "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False, fits: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the numbers of 0..size-1 that ``fits`` (``back``: its inverse): balanced Feistel rounds, walked until the result is one of them."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ _round(key, tweak, i, left, half), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ _round(key, tweak, i, right, half)
        value = left << half | right
        if value < size and fits(value):
            return value


def _mixed(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Permutes ASCII letters and digits of ``text`` within their classes; case and all else stay in place."""
    alphabets = [DIGITS if c.isdigit() and c.isascii() else LOWER if c.isascii() and c.isalpha() else "" for c in text]
    index, size = 0, 1
    for c, a in zip(text.lower(), alphabets, strict=True):
        if a:
            index, size = index * len(a) + a.index(c), size * len(a)
    shape = "".join("9" if a == DIGITS else "a" if a else c for c, a in zip(text, alphabets, strict=True))
    index, out = permute(index, size, key, f"{tweak}:{shape}", back), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            index, k = divmod(index, len(a))
            out.append(a[k].upper() if c.isupper() else a[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def _hexadecimal(text: str, key: bytes, back: bool) -> str | None:
    """Hex digits of one case in the same case, with a letter and a digit at least; of both cases within the classes of ``_mixed``'s digits and letters a-f."""
    if not re.search(r"\d", text) or not re.search("[a-fA-F]", text):
        return None
    if text in (text.lower(), text.upper()):
        width = len(text)
        fits = lambda v: (h := f"{v:0{width}x}").strip(DIGITS) != "" and not h.isalpha()
        new = f"{permute(int(text, 16), 16**width, key, f'secret{width}', back, fits):0{width}x}"
        return new.upper() if text == text.upper() else new
    index, size, sizes = 0, 1, [10 if c.isdigit() else 6 for c in text]
    for c, n in zip(text.lower(), sizes, strict=True):
        index, size = index * n + HEX.index(c) % 10, size * n
    index, out = permute(index, size, key, "secret:" + "".join("9" if n == 10 else "a" for n in sizes), back), []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        index, k = divmod(index, n)
        out.append(DIGITS[k] if n == 10 else LOWER[k].upper() if c.isupper() else LOWER[k])
    return "".join(reversed(out))


def _fill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), template)


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn_ok(digits) or len(set(digits)) == 1:
        return None
    body = digits[1:-1]

    def whole(value: int) -> str:
        new = digits[0] + str(value).zfill(len(body))
        return new + next(c for c in DIGITS if luhn_ok(new + c))

    fits = lambda v: len(set(whole(v))) > 1
    return _fill(text, whole(permute(int(body), 10 ** len(body), key, f"card{len(digits)}:{digits[0]}", back, fits)))


def _iban_mod(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_mod(plain) != 1:
        return None
    new = _mixed(plain[4:], key, f"iban{plain[:2]}", back)
    rest = iter(plain[:2] + f"{98 - _iban_mod(plain[:2] + '00' + new):02d}" + new)
    return "".join(c if c == " " else next(rest) for c in text)


def _real(year: int, month: int, day: int) -> bool:
    try:
        dt.date(year, month, day)
    except ValueError:
        return False
    return True


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Dates are exchanged with those of their era whose day and month have as many digits, so every way to write one keeps its length and order."""
    numbers = [int(x) for x in re.split(r"[-/.]", text)]
    orders = ["ymd"] if re.match(r"\d{4}", text) else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, numbers, strict=True))
        year, month, day = part["y"], part["m"], part["d"]
        if not _real(year, month, day):
            continue
        (y0, y1), (m0, m1), (d0, d1) = (next(c for c in classes if c[0] <= n < c[1]) for classes, n in ((ERAS, year), (MONTH_CLASSES, month), (DAY_CLASSES, day)))
        months, days = m1 - m0, d1 - d0
        split = lambda v: (y0 + v // days // months, m0 + v // days % months, d0 + v % days)  # noqa: B023, E731
        index = ((year - y0) * months + month - m0) * days + day - d0
        new = split(permute(index, (y1 - y0) * months * days, key, f"date{y0}:{m0}:{d0}", back, lambda v: _real(*split(v))))
        fields = iter(dict(zip("ymd", new, strict=True))[x] for x in order)
        return re.sub(r"\d+", lambda m: str(next(fields)).zfill(len(m[0])), text)
    return None


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    index = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    index, serial = divmod(index, 9999)
    return f"{areas[index // 99]:03d}-{index % 99 + 1:02d}-{serial + 1:04d}"


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    new = permute(int.from_bytes(bytes(int(o) for o in octets), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(str(b) for b in new.to_bytes(4, "big"))


def _ipv6(text: str, key: bytes, back: bool) -> str | None:
    """An address in the same shape: groups keep their number of digits, zeros of ``::`` stay, and letters their case."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    groups = [g for g in text.split(":") if g]
    if len(groups) < 3 or address.is_loopback:
        return None
    digits = "".join(groups)
    places = [sum(map(len, groups[:k])) for k, g in enumerate(groups) if len(g) > 1 and g[0] != "0"]
    shape = ":".join(str(len(g)) for g in text.split(":"))
    # A group with a digit in front that isn't 0 keeps one.
    fits = lambda v: all((f"{v:0{len(digits)}x}"[k] != "0") for k in places)
    new = f"{permute(int(digits, 16), 16 ** len(digits), key, f'ipv6:{shape}:{places}', back, fits):0{len(digits)}x}"
    new = new.upper() if text != text.lower() else new
    rest = iter(new)
    return "".join(c if c == ":" else next(rest) for c in text)


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    # The ten national digits of North America are one space, with and without +1; elsewhere the digits after the country code.
    lead = re.match(r"\+(\d{1,3})", text)
    keep = len(lead[1]) if lead and len(digits) - len(lead[1]) >= 7 else max(0, len(digits) - 10)
    tail = digits[keep:]
    american = len(tail) == 10 and digits[:keep] in ("", "1")
    # Area and exchange codes begin with 2 to 9; a number without that stays one without.
    dialled = lambda v: (t := f"{v:010d}")[0] > "1" and t[3] > "1"
    fits = (lambda v: dialled(v) == dialled(int(tail))) if american else (lambda _: True)
    country = "" if american else digits[:keep]
    return _fill(text, digits[:keep] + str(permute(int(tail), 10 ** len(tail), key, f"phone{country}:{len(tail)}", back, fits)).zfill(len(tail)))


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_mixed(local, key, 'email' + domain.lower(), back)}@{domain}" if any(c.isascii() and c.isalnum() for c in local) else None


def _secret(text: str, key: bytes, back: bool) -> str | None:
    named = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", text)
    if named:
        return named[0] + _mixed(text[named.end() :], key, "secret" + named[0], back)
    if re.fullmatch("[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}", text):
        return _hexadecimal(text, key, back)
    return _mixed(text, key, "password", back)


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ipv6": _ipv6, "ipv4": _ipv4, "phone": _phone, "card": _card}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a found value (``back``: the value of a pseudonym); None if it isn't valid in its format."""
    return MAKERS[kind](value, key, back)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and start, end (characters of the input) and kind of each value. Of overlapping finds the kind that stands first in ``KINDS`` holds."""
    found: list[tuple[int, int, str, str]] = []
    signs = {"email": "@" in text, "phone": True, "secret": True}
    if not re.search(r"[\d@]|sk-|gh[pousr]_|xox|A[KS]IA", text):
        return text, []
    for kind, finder in FINDERS.items():
        if signs.get(kind, True):
            # Both the finds so far and those of this kind come in order, so one place moves along the former.
            mine, k = [], 0
            for m in finder.finditer(text):
                start, end = m.span(m.lastgroup) if m.lastgroup else m.span()
                while k < len(found) and found[k][1] <= start:
                    k += 1
                if (k == len(found) or found[k][0] >= end) and (new := pseudonym(kind, text[start:end], key)) is not None:
                    mine.append((start, end, kind, new))
            if mine:
                found = sorted(found + mine)
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [(s, e, k) for s, e, k, _ in found]


def pii_pseudonyms(df: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Replaces personal data in every whole text by format-preserving pseudonyms.

    Returns id_column, text (null stays null), n_pii long and spans array<struct<start int, end int, kind string>>, in
    characters of the input. Rows are independent: nothing is shuffled, ids may be null or repeat, other columns are
    not read, whatever their names. An empty table gives an empty result. A text takes time in proportion to its length and
    finds. The key is a secret of the caller; the same key gives the same pseudonyms in every run and table.
    """
    secret = key.encode()
    kind = dict(df.dtypes)[id_column]

    def work(columns: list[list]) -> Iterator[list]:
        rows = [(None, []) if t is None else pseudonymise(t, secret) for t in columns[1]]
        yield [columns[0], [r[0] for r in rows], [len(r[1]) for r in rows], [[{"start": s, "end": e, "kind": k} for s, e, k in r[1]] for r in rows]]

    source = df.select(F.col(id_column), F.col(text_column).cast("string").alias("__text"))
    out = map_batches(source, [id_column, "__text"], work, f"`{id_column}` {kind}, text string, n_pii bigint, spans array<struct<start:int,end:int,kind:string>>")
    return out


def kind_counts(found: DataFrame) -> DataFrame:
    """doc_id, text, n_pii and kinds: the kinds found, each once, in the order of the alphabet, joined by commas."""
    return found.select("doc_id", "text", "n_pii", F.concat_ws(",", F.array_sort(F.array_distinct(F.col("spans.kind")))).alias("kinds"))
