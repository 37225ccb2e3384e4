"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate around them.

Anchors are at-signs, ``://``, ``+`` or ``.`` before a digit, three digits in a row, and cue words (account, IBAN, phone
and the like in four languages, in any mix of cases). Parsers are deterministic and look only at the characters around their anchor:

* ``email`` - local part to the left, labelled domain to the right, a last label of two letters or more; accented, Greek and
  Cyrillic letters count as letters in both;
* ``url`` - scheme to the left, host and path to the right, closing punctuation left out;
* ``ip_address`` - four numbers up to 255, not part of a longer dotted number;
* ``phone`` - ``+`` and country code, groups of digits in usual separators, 8 to 15 digits (11 after +1), or 7 to 15 digits
  after a cue;
* ``card`` - a run of 13 to 19 digits, or groups of 4-4-4-4 or 4-6-5, with a correct Luhn digit;
* ``ssn`` - 3-2-4 digits with hyphens and an assignable area;
* ``iban`` - after a cue, country code and check digits with a remainder of 1 modulo 97;
* ``account`` - after a cue, 6 to 20 digits with single separators.

Overlaps go to the match that begins first, then the longer one, then the kind above. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

KINDS = ["email", "url", "ip_address", "phone", "card", "ssn", "iban", "account"]
PHONE_CUES = ["phone", "tel", "telefon", "teléfono", "téléphone", "mobile", "fax", "handy", "móvil"]
ACCOUNT_CUES = ["account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "customer id", "member id", "policy"]
IBAN_CUES = ["iban"]
_HITS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALNUM | frozenset("._%+-")
_HOST = _ALNUM | frozenset(".-")
_SCHEME = _ALNUM | frozenset("+.-")
_URL = _ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")
_SEPARATORS = frozenset(" -.()/")
Span = tuple[int, int]


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset[str]) -> int:
    while at > 0 and text[at - 1] in allowed:
        at -= 1
    return at


def _foreign(c: str) -> bool:
    """A letter, digit or accent beyond ASCII, of a script that puts spaces between words."""
    return ("\x7f" < c < "\u0590" or "\u1e00" <= c < "\u2000") and (c.isalnum() or "\u0300" <= c < "\u0370")


def email(text: str, at: int) -> Span | None:
    """``at`` is the place of an at-sign."""
    begin, end = at, at + 1
    while begin and (text[begin - 1] in _LOCAL or _foreign(text[begin - 1])):
        begin -= 1
    while end < len(text) and (text[end] in _HOST or _foreign(text[end])):
        end += 1
    while begin < at and text[begin] in ".-+%":
        begin += 1
    while end > at + 1 and text[end - 1] in ".-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    while len(labels) > 1 and not (len(labels[-1]) > 1 and labels[-1].isalpha()):
        end -= len(labels.pop()) + 1
    local = text[begin:at]
    good = len(labels) > 1 and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and len(local) <= 64
    return (begin, end) if good and local and ".." not in local and local[-1] != "." else None


def url_end(text: str, at: int) -> tuple[int, int]:
    """Ends of the URL characters from ``at`` on, without the closing punctuation and with it; all anchors between have the same."""
    stop = _run(text, at, _URL)
    end = stop
    while end > at and text[end - 1] in ".,;:!?'()[]*":
        end -= 1
    return end, stop


def url(text: str, at: int, end: int) -> Span | None:
    """``at`` is the place of ``://``, ``end`` is by ``url_end``."""
    begin = _back(text, at, _SCHEME)
    while begin < at and not text[begin].isalpha():
        begin += 1
    return (begin, end) if at - begin > 1 and end > at + 3 and text[at + 3] in _ALNUM else None


def ip_address(text: str, at: int) -> Span | None:
    """``at`` is the place of a dot before a digit."""
    begin, end = _back(text, at, _DIGITS | {"."}), _run(text, at, _DIGITS | {"."})
    while end > at and text[end - 1] == ".":
        end -= 1
    while begin < end and text[begin] == ".":
        begin += 1
    parts = text[begin:end].split(".")
    alone = (begin == 0 or text[begin - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM)
    return (begin, end) if alone and len(parts) == 4 and all(0 < len(p) < 4 and int(p) < 256 and str(int(p)) == p for p in parts) else None


def _number(text: str, at: int, least: int, most: int) -> Span | None:
    """Digits from ``at`` on, with up to two separators between groups, as many groups as fit into ``most`` digits."""
    digits, end = 0, at
    place = at
    while True:
        stop = _run(text, place, _DIGITS)
        if stop == place or digits + stop - place > most:
            break
        digits += stop - place
        end = stop
        place = stop
        while place < len(text) and place - stop < 2 and text[place] in _SEPARATORS:
            place += 1
        if place == stop:
            break
    return (at, end) if least <= digits <= most and (end == len(text) or text[end] not in _ALNUM) else None


def phone(text: str, at: int) -> Span | None:
    """``at`` is the place of a plus before a digit."""
    if at and text[at - 1] in _ALNUM:
        return None
    north_america = text.startswith("1", at + 1) and not text[at + 2 : at + 3].isalnum()
    span = _number(text, at + 1, 11 if north_america else 8, 11 if north_america else 15)
    return (at, span[1]) if span else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def card(text: str, at: int) -> Span | None:
    """``at`` is the place of the first digit of a run."""
    end = _run(text, at, _DIGITS)
    if (at and text[at - 1] in _ALNUM) or end - at > 19:
        return None
    if end - at == 4 and end < len(text) and text[end] in " -":
        for groups in ((4, 4, 4), (6, 5)):
            place, sep = end, text[end]
            for g in groups:
                if not text.startswith(sep, place) or _run(text, place + 1, _DIGITS) != place + 1 + g:
                    break
                place += 1 + g
            else:
                end = place
                break
    digits = "".join(c for c in text[at:end] if c in _DIGITS)
    return (at, end) if 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1 and (end == len(text) or text[end] not in _ALNUM) else None


def ssn(text: str, at: int) -> Span | None:
    """``at`` is the place of the first digit of a run."""
    s = text[at : at + 11]
    if len(s) < 11 or s[3] != "-" or s[6] != "-" or not all(c in _DIGITS for c in s[:3] + s[4:6] + s[7:]):
        return None
    if (at and (text[at - 1] in _ALNUM or text[at - 1] == "-")) or (at + 11 < len(text) and (text[at + 11] in _ALNUM or text[at + 11] == "-")):
        return None
    return (at, at + 11) if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None


_AFTER_CUE = re.compile(r"(?:\s?(?:number|numero|número|numéro|nummer|no|nr|n°))?[.:#=\s]{0,4}", re.IGNORECASE)


def _value_place(text: str, cue_end: int) -> int:
    m = _AFTER_CUE.match(text, cue_end)
    return m.end() if m else cue_end


def iban(text: str, cue_end: int) -> Span | None:
    at = place = _value_place(text, cue_end)
    found = ""
    best = None
    while place < len(text) and len(found) < 34:
        c = text[place]
        if c in _ALNUM:
            found += c.upper()
            if len(found) >= 15 and (place + 1 == len(text) or text[place + 1] not in _ALNUM) and found[:2].isalpha() and found[2:4].isdigit() and int("".join(str(int(x, 36)) for x in found[4:] + found[:4])) % 97 == 1:
                best = (at, place + 1)
        elif c != " " or not found:
            break
        place += 1
    return best


def account(text: str, cue_end: int) -> Span | None:
    return _number(text, _value_place(text, cue_end), 6, 20)


def cued_phone(text: str, cue_end: int) -> Span | None:
    at = _value_place(text, cue_end)
    return _number(text, at + 1 if text[at : at + 1] == "(" else at, 7, 15)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("sign", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word("." + d, ("dot", 2))
        a.add_word("+" + d, ("plus", 2))
    for k in range(1000):
        a.add_word(f"{k:03d}", ("digits", 3))
    for kind, words in (("phone", PHONE_CUES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _expand(text: str, what: str, begin: int, end: int) -> Iterator[tuple[str, Span | None]]:
    if what == "sign":
        yield "email", email(text, begin)
    elif what == "dot":
        yield "ip_address", ip_address(text, begin)
    elif what == "plus":
        yield "phone", phone(text, begin)
    elif what == "digits":
        if begin == 0 or text[begin - 1] not in _DIGITS:
            yield "card", card(text, begin)
            yield "ssn", ssn(text, begin)
    elif (begin == 0 or not text[begin - 1].isalnum()) and not text[end : end + 1].isalnum():  # a cue is a whole word
        if what == "phone":
            yield "phone", cued_phone(text, end)
        elif what == "iban":
            yield "iban", iban(text, end)
        else:
            yield "account", account(text, end)


def resolve(found: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping matches the first, then the longest, then the first kind."""
    out: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(found, key=lambda f: (f[0], -f[1], KINDS.index(f[2]))):
        if not out or begin >= out[-1][1]:
            out.append((begin, end, kind))
    return out


def folded(text: str) -> str:
    """``text`` in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in one text."""
    found: set[tuple[int, int, str]] = set()
    dotted = linked = reach = end = -1
    for last, (what, size) in automaton.iter(folded(text)):
        begin = last + 1 - size
        if what == "dot":  # the dots of one number expand alike
            if begin < dotted:
                continue
            dotted = _run(text, begin, _DIGITS | {"."})
        if what == "scheme":
            if begin < linked:  # within a URL already
                continue
            if last >= reach:
                end, reach = url_end(text, last + 1)
            span = url(text, begin, end)
            if span:
                linked = span[1]
                found.add((span[0], span[1], "url"))
            continue
        for kind, span in _expand(text, what, begin, last + 1):
            if span:
                found.add((span[0], span[1], kind))
    return resolve(found) if found else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for b in batches:
        for i, j, buf, off in T.text_blocks(b.column(1)):
            raw, hits = buf.tobytes(), []
            for r in range(j - i):
                text = raw[off[r] : off[r + 1]].decode("utf-8", "replace")
                hits += [(i + r, kind, s, e, text[s:e]) for s, e, kind in find(text, automaton)]
            if hits:
                row, kind, start, end, value = zip(*hits, strict=True)
                yield T.batch(_HITS, doc_id=b.column(0).take(pa.array(row)), kind=list(kind), start=list(start), end=list(end), value=list(value))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): every piece of personal data, by characters from 0; pieces never overlap.

    Null and empty texts have none; rows that repeat, or have no id, report theirs each. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, ddl(_HITS))
