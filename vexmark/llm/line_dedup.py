"""Dropping lines whose template recurs across documents: a log-template tree of fixed depth.

*Tree.* A line's tokens are its runs of non-space bytes; a token with a digit in it is a variable field. The first level
of the tree is the number of tokens, the next three are the leading tokens (a variable field is a wildcard there); each
leaf holds templates. A leaf's distinct lines come in the order of their first occurrence. A line joins the template that
agrees with it in most of the positions after the leading ones, if at least ``similarity`` of those agree, and the
positions that don't become wildcards; otherwise it starts a template. Ties go to the older template. Tokens are compared
by 16-bit codes there, and equal lines by 64-bit hashes.

A leaf is grown whole, however many lines it has. Only a caller that gives ``leaf_lines`` has larger ones divided by their
lines' next two tokens, and the parts again where need be; templates then don't generalise over those.

*Distribution.* Leaves are independent, so lines are shuffled by leaf and each partition grows its leaves one after the
other from a sorted stream. Of a leaf of more than HELD bytes the templates are held and each line's hash and template, but
not the lines. Each Arrow batch sends an equal line once, so a line that a billion documents share costs a row
a batch and no task sees all its occurrences; those are found by a join on the line's hash, which AQE can split.

*Decision.* A template is recurring if lines of at least two documents (``doc_id``) match it. Its first occurrence, in the
order of doc_id and line, stays; all other lines that match it go. Lines of fewer than three literal tokens, or with less
than half of their tokens literal, have no part in the tree. With ``exact`` each of them, of whatever length, is a template of
its own that only equal lines match, digits included; without it they are never dropped. Lines without a token, and rows of
numbers (of digits and marks, without a letter or a multi-byte character), are never dropped.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .graph import checkpointed

LEADING, SIMILARITY, MIN_LITERALS = 3, 0.7, 3
SMALL_LEAF, HELD, DEEPER, DEEPEST = 256, 1 << 24, 2, 33
_WILD, _EXACT = T.U64(0x5851F42D4C957F2D), T.U64(0x2545F4914F6CDD1D)
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_DISTINCT = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("doc", pa.int64()), ("no", pa.int32()), ("last_doc", pa.int64()), ("codes", pa.binary())])
_PLACES = pa.schema([("line", pa.int64()), ("doc", pa.int64()), ("no", pa.int32())])
_RECURRING = pa.schema([("line", pa.int64()), ("keep_doc", pa.int64()), ("keep_no", pa.int32())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def lines(buf: np.ndarray, off: np.ndarray, leading: int, min_literals: int, exact: bool) -> tuple[np.ndarray, ...]:
    """(row, number in its row, leaf, hash, first token, tokens) of each line that may be dropped; and all token hashes."""
    start, end, before, h = T.word_hashes(buf, off, T.NONSPACE, lower=False)
    digits = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(T.DIGIT[buf], out=digits[1:])
    field = digits[end] > digits[start]
    raw, h = h, np.where(field, _WILD, h)
    newline = np.flatnonzero(buf == 10)
    n = len(off) - 1 + len(newline)
    line_of = T.rows_of(before) + np.searchsorted(newline, start)
    count = np.bincount(line_of, minlength=n)
    literal = count - np.bincount(line_of, field, minlength=n).astype(np.int64)
    first = np.cumsum(count) - count
    rule = (literal >= min_literals) & (2 * literal >= count)
    part = rule
    if exact:
        letters = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_LETTER[buf], out=letters[1:])
        part = rule | ((count > 0) & ((literal == count) | (np.bincount(line_of, letters[end] > letters[start], minlength=n) > 0)))
    some = np.flatnonzero(part)
    count, first = count[some], first[some]
    begin = np.arange(len(off) - 1) + np.searchsorted(newline, off[:-1])  # the first line of each row
    row = np.searchsorted(begin, some, "right") - 1
    lead = T.sequence_hash(h, first, np.minimum(count, leading))
    leaf, line = T.mix(lead + count.astype(T.U64)), T.sequence_hash(h, first, count)
    own = np.flatnonzero(~rule[some])  # equal lines are a leaf of their own
    line[own] = T.sequence_hash(raw, first[own], count[own])
    leaf[own] = T.mix(line[own] ^ _EXACT)
    return row, some - begin[row], leaf, line, first, count, h


def _places(leading: int, min_literals: int, exact: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, buf, off in T.text_blocks(b.column(1)):
                row, no, _, line, *_ = lines(buf, off, leading, min_literals, exact)
                yield T.batch(_PLACES, line=T.signed(line), doc=ids[i + row], no=no.astype(np.int32))

    return run


def _distinct(leading: int, min_literals: int, exact: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, codes = b.column(0).to_numpy(), [], []
            for i, _, buf, off in T.text_blocks(b.column(1)):
                row, no, leaf, line, first, count, h = lines(buf, off, leading, min_literals, exact)
                u, at, inv = np.unique(line, return_index=True, return_inverse=True)
                doc = ids[i + row]
                order = np.lexsort((no, doc, inv))
                head = order[np.searchsorted(inv[order], np.arange(len(u)))]
                last = np.full(len(u), np.iinfo(np.int64).min)
                np.maximum.at(last, inv, doc)
                token = np.repeat(first[at] - (np.cumsum(count[at]) - count[at]), count[at]) + np.arange(count[at].sum())
                data = (h[token] >> T.U64(48)).astype(np.uint16)
                ends = np.concatenate([[0], np.cumsum(2 * count[at])]).astype(np.int32)
                codes.append(pa.BinaryArray.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
                parts.append((T.signed(leaf[at]), T.signed(u), doc[head], no[head].astype(np.int32), last))
            if not parts:
                continue
            leaf, line, doc, no, last = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((no, doc, line))
            new = np.flatnonzero(np.diff(line[order], prepend=line[order][:1] - 1 if len(order) else 0))
            if not len(new):
                continue
            head = order[new]
            yield T.batch(_DISTINCT, leaf=leaf[head], line=line[head], doc=doc[head], no=no[head], last_doc=np.maximum.reduceat(last[order], new), codes=pa.chunked_array(codes).combine_chunks().take(pa.array(head)))

    return run


class _Templates:
    """The templates of one leaf of lines of ``width`` tokens, ``expected`` lines or more, which are added in order."""

    def __init__(self, width: int, leading: int, similarity: float, expected: int) -> None:
        self.leading, self.span, self.made = leading, max(0, width - leading), 0
        self.enough = similarity * self.span
        self.least = int(np.ceil(self.enough - 1e-9))
        self.text, self.wild = np.zeros((expected, self.span), np.uint16), np.zeros((expected, self.span), bool)
        # a template that agrees in ``least`` places agrees in one of any span - least + 1, so the places whose codes are rarest are looked up
        self.index: list[dict[int, array]] | None = [{} for _ in range(self.span)] if expected > SMALL_LEAF and self.least > 0 else None

    def _alike(self, codes: np.ndarray) -> np.ndarray:
        """The templates, in order, that may agree with a line's codes in enough places."""
        lists = sorted((place.get(c, ()) for place, c in zip(self.index, codes.tolist(), strict=True)), key=len)[: self.span - self.least + 1]
        some = [np.frombuffer(x, np.uint32) for x in lists if len(x)]
        return np.unique(np.concatenate(some)) if some else np.zeros(0, np.uint32)

    def add(self, codes: np.ndarray) -> np.ndarray:
        """The template (by number) that each of some lines, one row of codes each in order, ends in."""
        rest = codes[:, self.leading :]
        out = np.zeros(len(codes), np.int64)
        if not self.span:
            self.made = max(self.made, min(1, len(codes)))
            return out
        for k in range(len(codes)):
            made = self.made
            if made:
                if self.index is None:
                    at = None
                    same = (self.text[:made] == rest[k]) & ~self.wild[:made]
                else:
                    at = self._alike(rest[k])
                    same = (self.text[at] == rest[k]) & ~self.wild[at]
                agree = same.sum(axis=1)
                best = int(agree.argmax()) if len(agree) else 0
                if len(agree) and agree[best] >= self.enough:
                    t = best if at is None else int(at[best])
                    self.wild[t] |= ~same[best]
                    out[k] = t
                    continue
            if made == len(self.text):
                for held in (self.text, self.wild):
                    held.resize((made + made // 4 + 1, self.span), refcheck=False)
            self.text[made] = rest[k]
            if self.index is not None:
                for place, c in zip(self.index, rest[k].tolist(), strict=True):
                    place.setdefault(c, array("I")).append(made)
            out[k] = made
            self.made += 1
        return out


def grow(codes: np.ndarray, leading: int, similarity: float) -> np.ndarray:
    """The template (by number) that each of a leaf's lines, one row of codes each in order, ends in."""
    return _Templates(codes.shape[1], leading, similarity, len(codes)).add(codes)


class _LargeLeaf:
    """A leaf whose rows, sorted as in ``_recurring``, come a part at a time: its templates, and its lines by hash with their templates."""

    def __init__(self, leading: int, similarity: float) -> None:
        self.leading, self.similarity, self.templates = leading, similarity, None
        self.line, self.template = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.doc, self.no, self.shared = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def add(self, t: pa.Table) -> None:
        line, doc, no, last = (t.column(c).to_numpy() for c in ("line", "doc", "no", "last_doc"))
        distinct, first = np.unique(line, return_index=True)
        place = np.searchsorted(self.line, distinct)
        new = np.ones(len(distinct), bool)
        new[place < len(self.line)] = self.line[place[place < len(self.line)]] != distinct[place < len(self.line)]
        at = np.sort(first[new])
        if len(at):
            raw, ends = _binary(t.column("codes"))
            width = int(ends[at[0] + 1] - ends[at[0]]) // 2
            if self.templates is None:
                self.templates = _Templates(width, self.leading, self.similarity, SMALL_LEAF + len(at))
            before = self.templates.made
            made = self.templates.add(raw[ends[0] : ends[-1]].reshape(-1, 2 * width)[at].view(np.uint16))
            begun, head = np.unique(made, return_index=True)
            head = at[head[begun >= before]]
            self.doc, self.no, self.shared = np.append(self.doc, doc[head]), np.append(self.no, no[head]), np.append(self.shared, np.zeros(len(head), bool))
            self.template = np.insert(self.template, place[new], made[np.searchsorted(at, first[new])])
            self.line = np.insert(self.line, place[new], distinct[new])
        own = self.template[np.searchsorted(self.line, line)]
        self.shared[own[(doc != self.doc[own]) | (last != self.doc[own])]] = True

    def recurring(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.line), 1 << 16):
            own = self.template[i : i + (1 << 16)]
            hit = np.flatnonzero(self.shared[own])
            yield T.batch(_RECURRING, line=self.line[i + hit], keep_doc=self.doc[own[hit]], keep_no=self.no[own[hit]])


def _recurring(leading: int, similarity: float, most: int = HELD) -> Callable:
    def leaves(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        leaf, line, doc, no, last = (t.column(c).to_numpy() for c in ("leaf", "line", "doc", "no", "last_doc"))
        # a line that came from several batches is one line, at its first place
        _, inv = np.unique(line, return_inverse=True)
        first = np.full(inv.max() + 1, len(line))
        np.minimum.at(first, inv, np.arange(len(line)))
        latest = np.full(len(first), np.iinfo(np.int64).min)
        np.maximum.at(latest, inv, last)
        at = np.sort(first)
        latest = latest[inv[at]]
        leaf, line, doc, no = leaf[at], line[at], doc[at], no[at]
        begin = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
        size = np.diff(begin, append=len(leaf))
        template = np.repeat(begin, size)  # each leaf's first line, until it is known better
        raw, ends = _binary(t.column("codes"))
        for b, m in zip(begin[size > 1], size[size > 1], strict=True):
            rows = at[b : b + m]
            width = int(ends[rows[0] + 1] - ends[rows[0]]) // 2
            codes = np.stack([raw[ends[r] : ends[r + 1]] for r in rows]).view(np.uint16).reshape(m, width)
            made = grow(codes, leading, similarity)
            _, head = np.unique(made, return_index=True)
            template[b : b + m] = b + head[made]
        shared = np.zeros(len(line), bool)
        np.logical_or.at(shared, template, (doc != doc[template]) | (latest != doc[template]))
        hit = np.flatnonzero(shared[template])
        return T.batch(_RECURRING, line=line[hit], keep_doc=doc[template[hit]], keep_no=no[template[hit]])

    def ended(held: list[pa.RecordBatch], large: _LargeLeaf | None) -> Iterator[pa.RecordBatch]:
        if large is None:
            yield leaves(pa.Table.from_batches(held))
            return
        if held:
            large.add(pa.Table.from_batches(held))
        yield from large.recurring()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one leaf, ``last``
        large, last = None, None  # ``large``: what came before them of that leaf
        for b in batches:
            if not b.num_rows:
                continue
            leaf = b.column(0).to_numpy()
            if last is not None and (leaf[0] != last or (large is not None and leaf[-1] != last)):
                goes_on = int((leaf == last).sum())
                yield from ended([*held, b.slice(0, goes_on)], large)
                held, large, b, leaf = [], None, b.slice(goes_on), leaf[goes_on:]
            cut = int(np.flatnonzero(np.diff(leaf))[-1]) + 1 if (leaf != leaf[-1]).any() else 0
            if cut:
                yield leaves(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
            last = leaf[-1]
            if sum(x.nbytes for x in held) > most:
                large = large or _LargeLeaf(leading, similarity)
                large.add(pa.Table.from_batches(held))
                held = []
        if last is not None:
            yield from ended(held, large)

    return run


def _binary(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    arr = col.combine_chunks()
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    bufs = arr.buffers()
    kind = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    ends = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(bufs[2], np.uint8), ends


def _divided(found: DataFrame, leading: int, leaf_lines: int) -> DataFrame:
    """``found``, a written table of _DISTINCT, with leaves of more than ``leaf_lines`` distinct lines divided by further tokens."""
    for depth in range(leading, DEEPEST, DEEPER):
        many = checkpointed(found.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {leaf_lines}").select("leaf"))
        if many.isEmpty():
            break
        # a line is there once for each batch that had it
        large = checkpointed(found.join(many, "leaf", "left_semi").groupBy("leaf").agg(F.approx_count_distinct("line").alias("n")).where(f"n > {leaf_lines}").select(F.col("leaf").alias("large")))
        if large.isEmpty():
            break
        deeper = F.xxhash64("leaf", F.substring("codes", 2 * depth + 1, 2 * DEEPER))
        found = found.join(large, F.col("leaf") == F.col("large"), "left").withColumn("leaf", F.when(F.col("large").isNull(), F.col("leaf")).otherwise(deeper)).drop("large")
    return found


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leading: int = LEADING, similarity: float = SIMILARITY, min_literals: int = MIN_LITERALS, exact: bool = False, leaf_lines: int | None = None) -> DataFrame:
    """(doc, no): every line to drop, by doc_id and 0-based number; see ``drop_recurring_lines``."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    distinct = rows.mapInArrow(_distinct(leading, min_literals, exact), ddl(_DISTINCT))
    if leaf_lines is not None:
        distinct = _divided(checkpointed(distinct), leading, leaf_lines)
    recurring = distinct.repartition("leaf").sortWithinPartitions("leaf", "doc", "no", "line").mapInArrow(_recurring(leading, similarity), ddl(_RECURRING))
    places = rows.mapInArrow(_places(leading, min_literals, exact), ddl(_PLACES))
    return places.join(recurring, "line").where("doc <> keep_doc OR no <> keep_no").select("doc", "no")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leading: int = LEADING, similarity: float = SIMILARITY, min_literals: int = MIN_LITERALS, count_col: str | None = None, exact: bool = False, leaf_lines: int | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of their texts (lines end at a newline); all other columns as they are.

    Null and empty texts, and rows without a doc_id, come back unchanged. Rows that repeat a doc_id are one document: its
    lines count once and are dropped from each of its rows. A text that loses all its lines becomes empty. ``count_col``
    names a column for the number of lines dropped, which must not be one of ``docs``. With ``exact`` short lines and lines
    of mostly variable fields go too, where equal ones recur. Leaves are divided beyond ``leaf_lines`` distinct lines (by an
    estimate of their number) only if that is given. An empty table stays empty.
    """
    doc, nos, parts = T.unused(docs, "__doc", "__nos", "__lines")
    drops = recurring_lines(docs, id_col, text_col, leading, similarity, min_literals, exact, leaf_lines).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("no").alias(nos))
    joined = docs.join(drops, F.col(id_col).cast("long") == F.col(doc), "left")
    cut = joined.withColumn(parts, F.when(F.col(nos).isNotNull(), F.split(F.col(text_col), "\n", -1)))
    text = F.expr(f"array_join(transform(array_except(sequence(0, size({parts}) - 1), {nos}), i -> {parts}[i]), '\n')")
    cols = [F.coalesce(text, F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_col is not None:
        cols.append(F.when(F.col(nos).isNull(), 0).otherwise(F.size(nos)).alias(count_col))
    return cut.select(*cols)
