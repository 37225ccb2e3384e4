"""Secret scans by a trigram inverted index: from each regex a Boolean query of trigrams, then postings, then the regex.

*Queries.* The syntax tree of a regex gives, bottom-up, the exact strings it may match while they are few, otherwise its
possible beginnings and endings, and what all matches must contain. Strings of three bytes or more become ANDs of their
trigrams, alternatives become ORs. A regex without any mandatory trigram gets the query ``True`` and scans every text.

*Index.* Each block of texts is a segment of the index: of the trigrams that the queries name, it holds the rows in which
each occurs, as bitmaps. A query's ANDs and ORs intersect and unite those, so postings never leave the executor and nothing
is shuffled; only rows that remain are decoded and matched. No text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

#: Python's, with ASCII classes. A name before an assigned secret is taken from its beginning, so long names are read once.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{20,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{1,20}://[0-9A-Za-z._%+-]+:[0-9A-Za-z._%+!*-]+@",
    "assigned_secret": r"\b(?<![0-9A-Za-z_]-)(?:(?=[0-9A-Za-z_])[0-9A-Za-z_-]*[_-])?(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)(?:[_-][0-9A-Za-z_-]*)?[\"']?[ \t]*[:=][ \t]*[\"']?[0-9A-Za-z+/_.=-]{8,}",
    "bare_hex_key": r"\b(?:[0-9a-f]{40}|[0-9a-f]{64})\b",
}
#: The same for RE2, which knows no looking around: a name's beginning is then found from the left alone, in quadratic time.
SQL_RULES: dict[str, str] = RULES | {
    "assigned_secret": RULES["assigned_secret"].replace("(?<![0-9A-Za-z_]-)(?:(?=[0-9A-Za-z_])[0-9A-Za-z_-]*[_-])?", "(?:[0-9A-Za-z_][0-9A-Za-z_-]*[_-]|_)?", 1),
}
MANY, _HITS = 64, pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])


# -- Boolean queries: True, a trigram (bytes), ("and", {...}) or ("or", {...}) ------------------------------------------


def _join(op: str, parts: list) -> object:
    """AND or OR of queries, flattened; True absorbs an OR and is neutral in an AND."""
    flat: set = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat |= set(p[1]) if isinstance(p, tuple) and p[0] == op else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _contain(strings: frozenset[bytes]) -> object:
    """The text contains one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


class Info(NamedTuple):
    """What is known of a part's matches: all of them, or beginnings and endings; and a query that they all satisfy."""

    exact: frozenset[bytes] | None
    begin: frozenset[bytes]
    end: frozenset[bytes]
    query: object


_NIL = frozenset([b""])
_ANY = Info(None, _NIL, _NIL, True)


def _exact(strings: set[bytes]) -> Info:
    s = frozenset(strings)
    return Info(s, s, s, True) if len(s) <= MANY else Info(None, _NIL, _NIL, _contain(s))


def _few(strings: frozenset[bytes], ending: bool) -> frozenset[bytes]:
    """The strings' outer two bytes, if those are few."""
    cut = frozenset(s[-2:] if ending else s[:2] for s in strings)
    return cut if len(cut) <= MANY else _NIL


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MANY else None


def _then(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and (both := _cross(x.exact, y.exact)) is not None:
        return _exact(set(both))
    parts = [x.query, y.query]
    parts += [_contain(i.exact) for i in (x, y) if i.exact is not None]
    middle = _cross(x.end, y.begin)
    if middle is not None:
        parts.append(_contain(middle))
    begin, end = x.begin, y.end
    if x.exact is not None and (wide := _cross(x.exact, y.begin)) is not None:
        begin = wide
        parts.append(_contain(begin))
    if y.exact is not None and (wide := _cross(x.end, y.exact)) is not None:
        end = wide
        parts.append(_contain(end))
    keep = frozenset(s[-12:] for s in end)
    return Info(None, _few(begin, False), keep if len(keep) <= MANY else _few(end, True), _join("and", parts))


def _either(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MANY:
        return _exact(set(x.exact | y.exact))
    full = [_join("and", [i.query, _contain(i.exact) if i.exact is not None else True]) for i in (x, y)]
    return Info(None, _few(x.begin | y.begin, False), _few(x.end | y.end, True), _join("or", full))


def _members(items: list) -> set[bytes] | None:
    out: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            if arg[1] - arg[0] > MANY:
                return None
            out |= set(range(arg[0], arg[1] + 1))
        else:  # a negation or a class such as \w
            return None
    return {chr(c).encode() for c in out}


def _info(seq: list) -> Info:
    out = _exact({b""})
    for op, arg in seq:
        if op is sre.LITERAL:
            part = _exact({chr(arg).encode()})
        elif op is sre.IN:
            part = _exact(m) if (m := _members(arg)) is not None and len(m) <= 8 else _ANY
        elif op is sre.SUBPATTERN:
            part = _ANY if arg[1] & re.IGNORECASE else _info(arg[3])  # any case: no trigram is mandatory
        elif op is sre.BRANCH:
            infos = [_info(b) for b in arg[1]]
            part = infos[0]
            for i in infos[1:]:
                part = _either(part, i)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            one = _info(body)
            if low == 0:
                part = _either(one, _exact({b""})) if high == 1 else _ANY
            else:
                part = one
                for _ in range(min(low, 8) - 1):
                    part = _then(part, one)
                if low != high or low > 8:
                    part = _then(part, _ANY)
                    if one.exact is not None:
                        part = part._replace(end=_few(one.exact, True))
        elif op is sre.AT:
            part = _exact({b""})
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(regex: str) -> object:
    """The query that every text with a match of ``regex`` satisfies; True if there is no mandatory trigram."""
    tree = parser.parse(regex, re.ASCII)
    if tree.state.flags & re.IGNORECASE:
        return True
    info = _info(list(tree))
    return _join("and", [info.query, *([_contain(info.exact)] if info.exact is not None else [])])


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


def _rows(query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.ones(n, bool)
    if isinstance(query, bytes):
        return postings[query]
    parts = [_rows(q, postings, n) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = [(name, re.compile(rx, re.ASCII), trigram_query(rx)) for name, rx in rules.items()]
        self.trigrams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.number = np.full(1 << 24, -1, np.int16)
        for k, t in enumerate(self.trigrams):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k

    def postings(self, buf: np.ndarray, off: np.ndarray) -> dict[bytes, np.ndarray]:
        """The rows in which each trigram occurs."""
        n = len(off) - 1
        has = np.zeros((len(self.trigrams), n), bool)
        if len(buf) >= 3 and self.trigrams:
            wide = buf.astype(np.int32)
            code = self.number[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
            at = np.flatnonzero(code >= 0)
            row = np.searchsorted(off, at, "right") - 1
            whole = at + 3 <= off[row + 1]
            has[code[at[whole]], row[whole]] = True
        return dict(zip(self.trigrams, has, strict=True))

    def block(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str, int, int, str]]:
        posted = self.postings(buf, off)
        texts: dict[int, str] = {}
        raw, out = buf.tobytes(), []
        for name, rx, query in self.rules:
            for r in np.flatnonzero(_rows(query, posted, len(off) - 1)):
                r = int(r)
                if r not in texts:
                    texts[r] = raw[off[r] : off[r + 1]].decode("utf-8", "replace")
                out += [(r, name, m.start(), m.end(), m.group()) for m in rx.finditer(texts[r])]
        return out


def _scan(rules: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            for i, _, buf, off in T.text_blocks(b.column(1)):
                if hits := scanner.block(buf, off):
                    row, rule, start, end, secret = zip(*hits, strict=True)
                    yield T.batch(_HITS, doc_id=b.column(0).take(pa.array([i + r for r in row])), rule=list(rule), start=list(start), end=list(end), secret=list(secret))

    return run


def scan(docs: DataFrame, rules: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, start, end, secret): every match of every rule, by characters from 0.

    Matches of one rule don't overlap and come from the left; different rules may match the same place. Null and empty texts
    have no matches; rows that repeat, or have no id, report theirs each. Other columns are not read. An empty table, or
    no rules, give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(RULES if rules is None else rules), ddl(_HITS))


def duckdb_sql(rules: dict[str, str] | None = None) -> str:
    """The same result by full scans, for the rules given; by default for SQL_RULES."""
    one = """SELECT doc_id, '{name}' AS rule, len_to(p, i) + len_to(m, i - 1) AS start, len_to(p, i) + len_to(m, i) AS "end", m[i] AS secret FROM (
        SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS p FROM documents WHERE regexp_matches(text, '{rx}')))"""
    parts = [one.format(name=n, rx=rx.replace("'", "''")) for n, rx in (SQL_RULES if rules is None else rules).items()]
    return re.sub(r"len_to\((\w), (i(?: - 1)?)\)", r"CAST(coalesce(list_sum(list_transform(\1[1:\2], lambda s: length(s))), 0) AS BIGINT)", "\nUNION ALL\n".join(parts))
