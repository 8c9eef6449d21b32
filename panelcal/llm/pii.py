"""Format-preserving pseudonyms for personal data and secrets.

A finding is validated (checksum, calendar, value ranges), read as a number of its format, permuted by
a keyed Feistel network over the size of that format, and written back in the same format: a
card number becomes another card number with a right check digit, a date another date in the
same notation. The permutation depends on the kind and key alone, so equal values get equal pseudonyms in all documents, and it can
be undone with the key.
"""

from __future__ import annotations

import hashlib
import re
from calendar import monthrange
from collections.abc import Callable
from datetime import date, timedelta

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import Texts, with_text_columns

ROUNDS = 8
#: Characters of a secret that are permuted as one number.
PIECE = 200
KINDS = ("email", "secret", "iban", "ipv4", "date", "phone", "ssn", "card")

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = DIGITS + "abcdef"

# One pass over a text; the name of the group that matched is the kind. Order decides between kinds
# that start at the same place.
PATTERN = regex.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\w]))
  | (?P<secret>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b
      | (?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b["']?\s{0,3}[=:]\s{0,3}["']?)\K[^\s"'<>]{6,}
      | (?<![0-9A-Za-z])(?=[a-f]{0,39}[0-9])[0-9a-f]{40}(?![0-9A-Za-z])
      | \b(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36}\b
      | \bsk-[A-Za-z0-9]{20,}\b)
  | (?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
  | (?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{2}(?P<r>[-/.])[0-9]{2}(?P=r)[0-9]{4})(?![\w]|[-/.][0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9]))
  | (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![\w]|-[0-9])
      | (?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,8}\)?){1,5}(?![\w]|-[0-9]))
  | (?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?P<c>[ -])[0-9]{4}(?P=c)[0-9]{4}(?P=c)[0-9]{1,7}|[0-9]{4}(?P<a>[ -])[0-9]{6}(?P=a)[0-9]{5})(?![\w]|-[0-9]))
    """,
    regex.VERBOSE,
)
HINT = regex.compile(r"[0-9@]|(?i:passw|pwd|secret|token|key)|sk-")


def feistel(value: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: a Feistel network over the next even bit length, walked until in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def f(k: int, x: int) -> int:
        data, out = x.to_bytes(width, "big") + bytes([k]), b""
        while len(out) < width:
            out += hashlib.blake2b(data + bytes([len(out) // 64]), key=key, digest_size=64).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            if back:
                left, right = right ^ f(ROUNDS - 1 - k, left), left
            else:
                left, right = right, left ^ f(k, right)
        value = left << half | right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, back: bool, fits: Callable[[int], bool]) -> int:
    """The permutation restricted to the values that fit: walked until one is reached."""
    while not fits(value := feistel(value, size, key, back)):
        pass
    return value


def spelled(text: str, key: bytes, back: bool, alphabet: Callable[[str], str]) -> str:
    """Permute the characters that have an alphabet, each within its own; the others stay."""
    radix = [alphabet(c) for c in text]
    size, value = 1, 0
    for c, a in zip(text, radix, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size < 2:
        return text
    value = feistel(value, size, key, back)
    out = []
    for c, a in zip(reversed(text), reversed(radix), strict=True):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def pieces(text: str, key: bytes, back: bool, alphabet: Callable[[str], str]) -> str:
    """``spelled`` for texts of any length: a piece at a time, each keyed with what is before it, so that the work is linear."""
    out, seen = spelled(text[:PIECE], key, back, alphabet), hashlib.blake2b(key=key, digest_size=32)
    for at in range(PIECE, len(text), PIECE):
        seen.update((out[at - PIECE : at] if back else text[at - PIECE : at]).encode())
        out += spelled(text[at : at + PIECE], seen.digest(), back, alphabet)
    return out


def by_class(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else ""


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def put_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.partition("@")
    return f"{spelled(local, key, back, by_class)}@{domain}"


def secret(text: str, key: bytes, back: bool) -> str | None:
    prefix = re.match(r"(?:AKIA|ASIA)(?=[A-Z0-9]{16}$)|gh[opsu]_|sk-", text)
    head = prefix.group() if prefix else ""
    body = text[len(head) :]
    if len(body) >= 16 and all(c in HEX for c in body):
        return head + pieces(body, key + b"hex", back, lambda c: HEX)
    if head.endswith("IA"):
        return head + spelled(body, key + b"id", back, lambda c: DIGITS + UPPER)
    return head + pieces(body, key, back, by_class)


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = spelled(plain[4:], key + plain[:2].encode(), back, by_class)
    out = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in text)


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(p != str(o) for p, o in zip(parts, octets, strict=True)):
        return None
    value = int.from_bytes(bytes(octets), "big")
    return ".".join(map(str, feistel(value, 1 << 32, key, back).to_bytes(4, "big")))


FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def calendar_date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or year last with the day first where that can be read as a date, else the month first."""
    mark = text[4] if text[4] in "-/." else text[2]
    parts = [int(p) for p in text.split(mark)]
    orders = ((0, 1, 2),) if text[4] == mark and len(text.split(mark)[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    days = (LAST - FIRST).days + 1
    for order in orders:
        y, m, d = (parts[i] for i in order)
        if FIRST.year <= y <= LAST.year and 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]:
            # Month-first dates have a day above 12 here; their pseudonyms too, or they would be read the other way round.
            late = order == (2, 0, 1)
            new = FIRST + timedelta(walk((date(y, m, d) - FIRST).days, days, key + bytes(order), back, lambda v: not late or (FIRST + timedelta(v)).day > 12))
            out = [""] * 3
            for i, x, width in zip(order, (new.year, new.month, new.day), (4, 2, 2), strict=True):
                out[i] = f"{x:0{width}d}"
            return mark.join(out)
    return None


def phone(text: str, key: bytes, back: bool) -> str | None:
    """9 to 15 digits with a country code, 10 or 11 without; the country code stays."""
    digits = digits_of(text)
    code = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|\+1(?=[0-9]{10}$)", text)
    head = digits_of(code.group()) if code else ""
    body = digits[len(head) :]
    if not (8 <= len(digits) <= 15 if text.startswith("+") else 10 <= len(digits) <= 11):
        return None
    if len(body) == 10 and head in ("", "1"):  # area and exchange codes begin with 2 to 9
        good = lambda v: (v // 10**9 >= 2) and (v // 10**6 % 10 >= 2)
        if good(int(body)):
            return put_digits(text, head + f"{walk(int(body), 10**10, key + b'na', back, good):010d}")
    return put_digits(text, head + f"{feistel(int(body), 10 ** len(body), key + bytes([len(body)]), back):0{len(body)}d}")


def ssn(text: str, key: bytes, back: bool) -> str | None:
    def good(v: int) -> bool:
        area = v // 10**6
        return 0 < area < 900 and area != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0

    value = int(digits_of(text))
    return put_digits(text, f"{walk(value, 10**9, key, back, good):09d}") if good(value) else None


def card(text: str, key: bytes, back: bool) -> str | None:
    """13 to 19 digits with a right check digit, or 16 digits that begin as card numbers do; the first digit stays."""
    digits = digits_of(text)
    right = luhn_digit(digits[:-1]) == digits[-1]
    if not 13 <= len(digits) <= 19 or not (right or len(digits) == 16 and digits[0] in "3456"):
        return None
    keyed = key + digits[:1].encode() + bytes([len(digits), right])
    if right:
        n = len(digits) - 2
        body = digits[0] + f"{feistel(int(digits[1:-1]), 10**n, keyed, back):0{n}d}"
        return put_digits(text, body + luhn_digit(body))
    n = len(digits) - 1
    wrong = lambda v: luhn_digit(digits[0] + f"{v:0{n}d}"[:-1]) != f"{v:0{n}d}"[-1]
    return put_digits(text, digits[0] + f"{walk(int(digits[1:]), 10**n, keyed, back, wrong):0{n}d}")


MAKERS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": email, "secret": secret, "iban": iban, "ipv4": ipv4, "date": calendar_date, "phone": phone, "ssn": ssn, "card": card,
}


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or the value of a pseudonym; None if it isn't a valid value of the kind."""
    return MAKERS[kind](value, hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest(), back)


def replaced(text: str, key: bytes, known: dict[tuple[str, str], str | None] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each finding in the old text."""
    if not HINT.search(text):
        return text, []
    known = {} if known is None else known
    out, found, last, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        value = m.group()
        named = [k for k in KINDS if m.group(k) is not None]
        at = m.start() + 1  # what is no valid value may hold one
        for kind in named + ["card"] * ("phone" in named):  # a spaced card number can look like a phone number
            if (kind, value) not in known:
                known[kind, value] = pseudonym(kind, value, key)
            if (new := known[kind, value]) is not None:
                out += [text[last : m.start()], new]
                last = at = m.end()
                found.append((kind, m.start(), len(value)))
                break
    return "".join(out) + text[last:], found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``pii``: kind, start and length (in characters of the old text) of each finding.

    Null texts stay null with no findings; empty ones stay empty. Rows are treated one by one, so ties and repeats get equal
    results. Columns named ``pii`` are replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")

    def make():
        known: dict[tuple[str, str], str | None] = {}

        def run(texts: Texts) -> list:
            if len(known) > 200_000:
                known.clear()
            done = [(None, []) if t is None else replaced(t.decode(), key, known) for t in texts]
            return [[t for t, _ in done], [[{"kind": k, "start": s, "length": n} for k, s, n in f] for _, f in done]]

        return run

    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text, "pii")]
    order = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    made = with_text_columns(docs, make, "new_text string, pii array<struct<kind: string, start: int, length: int>>", text, kept)
    return made.withColumnRenamed("new_text", text).select(*[F.col(f"`{c}`") for c in order if c == text or c in kept], *([] if text in order else [text]), "pii")
