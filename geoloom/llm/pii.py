"""PII by anchor expansion.

An Aho-Corasick automaton finds anchors in the lower-case text: at-signs,
address schemes, plus signs, double colons, pairs of digits and words that
announce an identifier. At each anchor a deterministic parser expands to the
left and right as far as its alphabet goes, and validates what it has:

- email: a local part and at least two domain labels, the last of letters;
  letters of any script in both;
- url: scheme, host of labels or a dotted quad, up to white space or a quote;
- ip: four numbers of at most 255, not part of a longer dotted number; or an
  IPv6 address with a digit, of eight groups or with ::;
- iban: country, check digits and 11 to 30 characters, remainder 1 modulo 97;
- ssn: ddd-dd-dddd of assigned areas;
- phone: + and 8 to 15 digits, or ddd ddd dddd with separators;
- card: 13 to 19 digits that pass Luhn's check; account: others of 12 to 19,
  and 6 to 19 digits after a cue such as account or acct and an optional no,
  number, # or colon;
- secret: 16 or more token characters, however many, after a cue such as token
  or apiKey, in any case, and an optional =, : or quote.

Numbers are looked for in the whole run of digits and separators around their
anchor, IPv6 addresses within REACH characters of it: none is longer.

At most one finding covers a character: of those that overlap, the one that
begins first, then the longer, stays. Results depend on the text alone.

Defined cases: NULL text has none and stays NULL; rows without a doc_id are
left out of the findings but are redacted; repeated rows report once; other
columns are carried along unread.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .decontaminate import put

KINDS = ("account", "card", "email", "iban", "ip", "phone", "secret", "ssn", "url")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "auth_key", "authkey", "private_key", "privatekey")
ACCOUNTS = ("account", "acct", "konto")

_LOCAL = regex.compile(r"[\p{L}\p{N}._%+\-]+", regex.REVERSE)
_DOMAIN = regex.compile(r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?\.)+\p{L}{2,24}(?![\p{L}\p{N}])")
_SCHEME = regex.compile(r"[A-Za-z][A-Za-z0-9+.\-]*", regex.REVERSE)
_HOST = regex.compile(r"(?:[^\s/@\"'<>]+@)?(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?\.)+(?:[\p{L}]{2,24}|\d{1,3})(?::\d{1,5})?(?:[/?#][^\s\"'<>]*)?")
_LEFT = regex.compile(r"[\d.()+ \-]+", regex.REVERSE)
_RIGHT = regex.compile(r"[\d.()+ \-]+")
_IP = regex.compile(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d|\.\d)")
_SSN = regex.compile(r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])")
_PLUS = regex.compile(r"(?<![\p{L}\d+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d)")
_NATIONAL = regex.compile(r"(?<![\d.\-])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d.\-]\d|\d)")
_DIGITS = regex.compile(r"(?<![\d.])(?:\d{12,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?)(?!\d|[.,]\d)")
_IBAN = regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SECRET = regex.compile(r"[\"']?\s{0,3}[=:]?\s{0,3}[\"']?([A-Za-z0-9_\-/+.]{16,})")
_ACCOUNT = regex.compile(r"(?:[ _\-]?(?:number|num|no|nr|id)\b)?\.?\s{0,3}[:=#]?\s{0,3}(\d{6,19}|(?:\d{3,4}[ \-]){1,4}\d{3,4})(?![\d\-]|[.,]\d)")
_HEX = regex.compile(r"[0-9A-Fa-f:]+")
_HEX_LEFT = regex.compile(r"[0-9A-Fa-f:]+", regex.REVERSE)
REACH = 64


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for a in range(100):
        found.add_word(f"{a:02d}", (2, "digits"))
    found.add_word("@", (1, "at"))
    found.add_word("://", (3, "scheme"))
    found.add_word("www.", (4, "www"))
    found.add_word("+", (1, "plus"))
    found.add_word("::", (2, "colons"))
    for cue in CUES:
        found.add_word(cue, (len(cue), "cue"))
    for cue in ACCOUNTS:
        found.add_word(cue, (len(cue), "account"))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def lowered(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def _ipv6(text: str, at: int):
    left, right = _HEX_LEFT.match(text, max(0, at - REACH), at), _HEX.match(text, at, at + REACH)
    start, end = left.start() if left else at, right.end() if right else at
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return
    if text[start:end].endswith(":") and not text[start:end].endswith("::"):
        end -= 1
    value = text[start:end]
    if len(value) >= 4 and value.count(":") >= 2 and any(c.isdigit() for c in value):
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return
        yield start, end, "ip"


def _email(text: str, at: int):
    left = _LOCAL.match(text, 0, at)
    right = _DOMAIN.match(text, at + 1)
    if left and right:
        start = left.start()
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and text[at - 1] != "." and ".." not in text[start:at]:
            yield start, right.end(), "email"


def _url(text: str, start: int, host: int):
    m = _HOST.match(text, host)
    if m:
        end = m.end()
        while text[end - 1] in ".,;:!?)]}*":
            end -= 1
        if end > host + 3:
            yield start, end, "url"


def _numbers(text: str, start: int, stop: int):
    """The number-like identifiers of a run of digits and separators, overlapping ones too."""
    ahead = min(len(text), stop + 2)
    for m in _IP.finditer(text, start, ahead, overlapped=True):
        if all(int(x) < 256 for x in m.groups()):
            yield m.start(), m.end(), "ip"
    for kind, pattern in (("ssn", _SSN), ("phone", _NATIONAL)):
        for m in pattern.finditer(text, start, ahead, overlapped=True):
            yield m.start(), m.end(), kind
    for m in _DIGITS.finditer(text, start, ahead, overlapped=True):
        digits = "".join(c for c in m.group() if c.isdigit())
        if 12 <= len(digits) <= 19:
            yield m.start(), m.end(), "card" if len(digits) >= 13 and luhn(digits) else "account"


def _iban(text: str, at: int):
    """Around the check digits."""
    begin = max(0, at - 2)
    m = _IBAN.match(text, begin)
    if m and mod97(m.group()):
        yield begin, m.end(), "iban"


def findings(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and without overlap."""
    found: set[tuple[int, int, str]] = set()
    covered = run = -1
    for last, (size, kind) in anchors.iter(lowered(text)):
        at = last - size + 1
        if kind == "digits":
            got = list(_iban(text, at))
            if ":" in text[max(0, at - 5) : at + 6]:
                got += _ipv6(text, at)
            if at >= covered:
                left = _LEFT.match(text, max(0, covered), at)
                covered = _RIGHT.match(text, at).end()
                got += _numbers(text, left.start() if left else at, covered)
        elif kind == "at":
            got = _email(text, at)
        elif kind == "scheme":
            m = _SCHEME.match(text, max(0, at - 16), at)
            got = _url(text, m.start(), at + 3) if m else ()
        elif kind == "www":
            got = _url(text, at, at) if not at or not (text[at - 1].isalnum() or text[at - 1] in "/.@") else ()
        elif kind == "plus":
            m = _PLUS.match(text, at)
            got = [(at, m.end(), "phone")] if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15 else ()
        elif kind == "colons":
            got = _ipv6(text, at)
        elif kind == "account":
            m = _ACCOUNT.match(text, last + 1)
            got = [(m.start(1), m.end(1), "account")] if m else ()
        else:
            # A cue inside the run of an earlier one has no other end, and begins later.
            m = _SECRET.match(text, last + 1) if last + 1 >= run else None
            run = m.end(1) if m else run
            got = [(m.start(1), m.end(1), "secret")] if m and any(c.isdigit() for c in m.group(1)) else ()
        found.update(got)
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or s >= out[-1][1]:
            out.append((s, e, kind))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for whole in batches:
        for part in slices(whole):
            rows = []
            ids = part.column("doc_id")
            for i, text in enumerate(part.column("text").to_pylist()):
                if text:
                    rows += [{"doc_id": ids[i].as_py(), "kind": k, "start_char": s, "end_char": e} for s, e, k in findings(text, anchors)]
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())])


def pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char, end_char) of every finding; see the module."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(_find, "doc_id bigint, kind string, start_char int, end_char int").distinct()


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def _redact(chars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for whole in batches:
            for part in slices(whole):
                texts = part.column("text").to_pylist()
                changed = []
                for i, text in enumerate(texts):
                    if text and (found := findings(text, anchors)):
                        texts[i] = redacted(text, found)
                        changed.append(i)
                if changed:
                    part = put(part, "text", texts)
                    if chars:
                        sizes = part.column("n_chars").to_pylist()
                        for i in changed:
                            sizes[i] = len(texts[i])
                        part = put(part, "n_chars", sizes)
                yield part

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns and rows, each finding replaced by <KIND>,
    and n_chars, if there is such an integer column, the changed texts' length."""
    chars = any(f.name == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType)) for f in docs.schema)
    return docs.mapInArrow(_redact(chars), docs.schema)
