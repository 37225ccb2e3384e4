"""Line dedup, fingerprints, SimHash and decontamination against brute force, and their corner cases."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vexmark.llm import decontam, fingerprints, graph, line_dedup, queries, simhash
from vexmark.llm import textcore as T
from vexmark.llm.textcore import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"word{rng.randrange(size)}x" for _ in range(n)]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls everywhere, empty, blank and long texts, and repeated rows."""
    long = " ".join(words(random.Random(9), 150_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (None, "no id at all here", None, "s", 2), (5, "é🙂 ñ", "es", "s", 3)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Extra columns with names that a join or a rename could trip over."""
    return docs.selectExpr("*", "doc_id AS node", "text AS root", "1 AS group_id", "'x' AS line", "2 AS doc", "3 AS row", "4 AS `a.b`", "5 AS key", "6 AS no", "7 AS __doc", "8 AS __nos", "9 AS gone", "10 AS keep", "11 AS __gone")


# -- line dedup --------------------------------------------------------------------------------------------------------


def brute_leaves(lines, leading, limit):
    """Each line's leading tokens, more of them where a leaf has more than ``limit`` lines."""
    depth = dict.fromkeys(lines, leading)
    for d in range(leading, 33, 2):
        leaves = {}
        for t in lines:
            leaves.setdefault((len(t), depth[t], t[: depth[t]]), []).append(t)
        large = [t for v in leaves.values() if len(v) > limit for t in v if depth[t] == d]
        for t in large:
            depth[t] = d + 2
    return depth


def brute_lines(docs, leading=3, similarity=0.7, min_literals=3, limit=10**9):
    """The documents' kept lines, by the definition: one tree, lines in order."""
    tree, places = {}, []
    order = {}
    for d in sorted(docs):
        for no, line in enumerate(docs[d].split("\n")):
            toks = ["*" if re.search(r"\d", t) else t for t in line.split()]
            lit = sum(t != "*" for t in toks)
            if lit >= min_literals and 2 * lit >= len(toks):
                places.append((d, no, tuple(toks)))
                order.setdefault(tuple(toks), (d, no))
    found, depth = {}, brute_leaves(list(order), leading, limit)
    for toks, _ in sorted(order.items(), key=lambda x: x[1]):
        leaf = tree.setdefault((len(toks), depth[toks], toks[: depth[toks]]), [])
        rest = toks[leading:]
        best = max(range(len(leaf)), key=lambda k: (sum(a == b for a, b in zip(leaf[k], rest, strict=True)), -k), default=None)
        if not rest and leaf:
            found[toks] = (len(toks), depth[toks], toks[: depth[toks]], 0)
            continue
        if best is not None and sum(a == b for a, b in zip(leaf[best], rest, strict=True)) >= similarity * len(rest):
            leaf[best] = [a if a == b else None for a, b in zip(leaf[best], rest, strict=True)]
        else:
            leaf.append(list(rest))
            best = len(leaf) - 1
        found[toks] = (len(toks), depth[toks], toks[: depth[toks]], best)
    at = {}
    for d, no, toks in places:
        at.setdefault(found[toks], []).append((d, no))
    drop = set()
    for p in at.values():
        if len({d for d, _ in p}) > 1:
            drop |= set(p) - {min(p)}
    return {d: "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in drop) for d, t in docs.items()}


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    shared = [" ".join(words(rng, n)) for n in (4, 7, 12, 60)]
    docs = {}
    for d in range(60):
        lines = [" ".join(words(rng, rng.randrange(1, 9), 12)) for _ in range(rng.randrange(0, 6))]
        for s in shared:
            if rng.random() < 0.4:
                t = s.split()
                if len(t) > 6 and rng.random() < 0.5:
                    t[rng.randrange(3, len(t))] = "changed"
                lines.insert(rng.randrange(len(lines) + 1), " ".join(t))
        lines.append(f"page {d} of {rng.randrange(9)} was seen here today")
        docs[d] = "\n".join(lines)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    # words of this test have digits, so give each a literal form
    plain = {d: re.sub(r"word(\d+)x", lambda m: "w" + "".join(chr(97 + int(c)) for c in m[1]), t) for d, t in docs.items()}
    df = spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df).collect()}
    assert got == brute_lines(plain) and got != plain


def test_large_leaves_are_divided_by_further_tokens(spark):
    rng = random.Random(13)
    docs = {d: "\n".join(" ".join(["start", "of", "line", *(rng.choice(["red", "blue"]) for _ in range(rng.choice([4, 9]))), rng.choice(["x", "y", "z"])]) for _ in range(8)) for d in range(30)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    seen = []
    for limit in (1, 6, 40, 10**6):
        got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df, leaf_lines=limit).collect()}
        assert got == brute_lines(docs, limit=limit)
        seen.append(sum(map(len, got.values())))
    assert seen[0] > seen[2] and seen[1] > seen[3]


def test_a_leaf_of_more_than_a_million_lines_is_whole(spark):
    """Two lines of one template that differ in the first tokens after the leading ones, in a leaf of 1.25 million others."""
    tokens = ", ".join(f"translate(xxhash64(id, {k}), '0123456789', 'abcdefghij')" for k in range(4))
    rows = spark.range(1_250_000).selectExpr("id div 5000 AS doc_id", f"concat_ws(' ', 'start of line', {tokens}) AS line")
    filler = rows.groupBy("doc_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    docs = {1000: "start of line one b c d", 1001: "start of line two b c d", 1002: "start of line one b e d", 1003: "start of line six b c d"}
    df = filler.union(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).repartition(8)
    got = line_dedup.drop_recurring_lines(df, count_col="lost").where("lost > 0 OR doc_id >= 1000").collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(docs) and [r.doc_id for r in got if r.lost] != []


@pytest.mark.parametrize("exact", [False, True])
def test_leaves_of_which_templates_are_held_are_as_others(exact):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(150):
        lines = [" ".join(["start of line"[: rng.integers(9, 14)], *rng.choice(["red", "blue", "green", "7"], rng.choice([0, 1, 5, 9]))]) for _ in range(12)]
        texts.append("\n".join(lines))
    batch = pa.record_batch([pa.array(rng.integers(0, 90, 150)), pa.array(texts)], ["doc_id", "text"])
    found = pa.Table.from_batches(line_dedup._distinct(3, 3, exact)(batch.slice(i, 10) for i in range(0, 150, 10)))
    found = found.sort_by([(c, "ascending") for c in ("leaf", "doc", "no", "line")]).combine_chunks()
    seen = []
    for most, size in ((1 << 30, 5000), (1 << 30, 7), (0, 7), (0, 100), (900, 40), (9000, 13), (4000, 5000)):
        out = line_dedup._recurring(3, 0.7, most)(found.to_batches(max_chunksize=size))
        seen.append(sorted(x for b in out for x in zip(*b.to_pydict().values(), strict=True)))
    assert len(seen[0]) > 50 and all(x == seen[0] for x in seen)


@pytest.mark.parametrize("similarity", [0.3, 0.7, 1.0])
def test_a_large_leaf_grows_as_a_small_one(monkeypatch, similarity):
    rng = np.random.default_rng(8)
    for width in (3, 4, 5, 9, 20):
        base = rng.integers(0, 30, (40, width)).astype(np.uint16)
        codes = base[rng.integers(0, 40, 900)]
        change = rng.random(codes.shape) < 0.25
        codes[change] = rng.integers(0, 30, int(change.sum()))
        made = line_dedup.grow(codes, 3, similarity)
        monkeypatch.setattr(line_dedup, "SMALL_LEAF", 10**9)
        assert (made == line_dedup.grow(codes, 3, similarity)).all()
        monkeypatch.undo()


def test_a_leaf_of_many_templates_takes_near_linear_time():
    codes = np.random.default_rng(2).integers(0, 60_000, (40_000, 12)).astype(np.uint16)
    begun = time.process_time()
    made = line_dedup.grow(codes, 3, 0.7)
    assert time.process_time() - begun < 20 and len(set(made.tolist())) > 39_000


def test_long_passages_go_but_for_the_first(spark):
    rng = random.Random(5)
    passage = " ".join("abcdefghij"[rng.randrange(10)] * 3 + "klmnop"[rng.randrange(6)] for _ in range(55))
    df = frame(spark, [f"own line of {w} text\n{passage}" for w in ("apple", "pear", "plum")])
    got = [r.text for r in line_dedup.drop_recurring_lines(df, count_col="gone").orderBy("doc_id").collect()]
    assert passage in got[0] and all(passage not in t for t in got[1:])


def test_short_recurring_lines_go(spark):
    """Lines of one or two tokens, of a script without spaces, and with mostly fields; rows of numbers stay."""
    shared = ["Les.", "And ornd.", "版权所有未经许可不得转载本页内容", "第3章のはじめに", "Page 3", "***"]
    kept = ["12 34", "7"]
    df = frame(spark, ["\n".join([f"this is only line {w} here", *shared, "", *kept, end]) for w, end in (("a", "Own"), ("b", "End"), ("c", "Les"))]).repartition(2)
    got = [r for r in line_dedup.drop_recurring_lines(df, count_col="gone", exact=True).orderBy("doc_id").collect()]
    assert [r.text.split("\n") for r in got] == [["this is only line a here", *shared, "", *kept, "Own"], ["this is only line b here", "", *kept, "End"], ["this is only line c here", "", *kept, "Les"]]
    assert [r.gone for r in got] == [0, len(shared), len(shared)]


def test_lines_that_recur_exactly_go_from_the_queries(spark, sf):
    docs = {r.doc_id: r.text for r in load(spark, sf, "documents").collect() if r.doc_id is not None and r.text}
    got = {r.doc_id: r.text for r in queries.op1_line_dedup(spark, sf).collect()}
    at, left = {}, {}
    for texts, into in ((docs, at), (got, left)):
        for d in texts:
            for line in set((texts[d] or "").split("\n")):
                into.setdefault(line, set()).add(d)
    recur = {x for x, d in at.items() if len(d) > 1 and re.search(r"[^\W\d_]", x)}
    assert sum(len(x.split()) < 3 for x in recur) > 5
    assert all(left.get(x, set()) <= {min(at[x])} for x in recur)


def test_lines_corner_cases(spark):
    docs = clashing(odd(spark))
    got = line_dedup.drop_recurring_lines(docs, count_col="lost")
    assert got.columns == [*docs.columns, "lost"] and got.count() == 7
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert line_dedup.drop_recurring_lines(docs.limit(0)).count() == 0


# -- near duplicates ---------------------------------------------------------------------------------------------------


def near_copies(rng, n=60, copies=4, size=120):
    texts, group = [], []
    for g in range(n):
        base = words(rng, size, 5000)
        for c in range(copies if g % 3 == 0 else 1):
            t = list(base)
            for _ in range(c * 2):
                t[rng.randrange(size)] = f"other{rng.randrange(9999)}"
            texts.append(" ".join(t))
            group.append(g)
    return texts, group


def test_simhash_groups_match_brute_force(spark):
    texts, group = near_copies(random.Random(1))
    got = {r.doc_id: r for r in simhash.near_duplicate_groups(frame(spark, texts).repartition(4)).collect()}
    buf, off = T.utf8(pa.array(texts))
    fp = simhash.fingerprint(buf, off, simhash._signs())[0].view(np.uint64)
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if far[i, j] <= simhash.MAX_DISTANCE:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[i].group_id for i in range(len(texts))] == root
    assert root == [group.index(g) for g in group]
    assert all(r.group_size == root.count(r.group_id) and r.keep == (r.doc_id == r.group_id) for r in got.values())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts)).collect()}
    assert kept == set(root)


def test_close_pairs_share_a_block():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    for flips in (0, 5, 15):
        bits = np.unpackbits(fp, axis=1)
        for row in bits:
            row[rng.choice(256, flips, replace=False)] ^= 1
        a, b = simhash.block_keys(fp.view(np.int64)), simhash.block_keys(np.packbits(bits, axis=1).view(np.int64))
        assert (a == b).any(axis=1).all()


@pytest.mark.parametrize("width", [16, 24])
def test_nine_tenths_of_the_furthest_pairs_share_a_block(width):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (4000, 256), dtype=np.uint8)
    flip = np.zeros_like(bits)
    np.put_along_axis(flip, np.argsort(rng.random(bits.shape), axis=1)[:, : simhash.MAX_DISTANCE], 1, axis=1)
    a, b = (simhash.block_keys(np.packbits(x, axis=1).view(np.int64), width) for x in (bits, bits ^ flip))
    assert (a == b).any(axis=1).mean() > 0.89


def test_wide_blocks_give_the_same_groups(spark):
    df = frame(spark, near_copies(random.Random(6))[0])
    assert sorted(simhash.near_duplicate_groups(df, wide=0).collect()) == sorted(simhash.near_duplicate_groups(df).collect())


def edited_pairs(rng, n=40):
    """Texts of short words and a few long ones, two by two at about the largest distance, and for each the number of its group's first."""
    texts, signs = [], simhash._signs()
    while len(texts) < 2 * n:
        t = ["".join(rng.choices("abcdefghij", k=rng.choice([2, 3, 4, 4, 4, 6]))) for _ in range(rng.randint(20, 60))]
        u = [*t[:-1], "".join(rng.choices("abcdefghij", k=6))]
        fp, _ = simhash.fingerprint(*T.utf8(pa.array([" ".join(t), " ".join(u)])), signs)
        if simhash.MAX_DISTANCE - 2 <= np.bitwise_count((fp[0] ^ fp[1]).view(np.uint64)).sum() <= simhash.MAX_DISTANCE + 2:
            texts += [" ".join(t), " ".join(u)]
    fp, _ = simhash.fingerprint(*T.utf8(pa.array(texts)), signs)
    far = np.bitwise_count((fp[::2] ^ fp[1::2]).view(np.uint64)).sum(axis=1)
    keys = simhash.block_keys(fp)
    met = (far <= simhash.MAX_DISTANCE) & (keys[::2] == keys[1::2]).any(axis=1)
    return texts, [i - (i % 2 and int(met[i // 2])) for i in range(2 * n)]


def test_a_text_has_one_fingerprint_whatever_is_beside_it():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.choice([2, 3, 4, 6, 8]))) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    signs = simhash._signs()
    whole, _ = simhash.fingerprint(*T.utf8(pa.array(texts)), signs)
    for m in (1, 2, 7, 100):
        parts = [simhash.fingerprint(*T.utf8(pa.array(texts[i : i + m])), signs)[0] for i in range(0, len(texts), m)]
        assert (np.concatenate(parts) == whole).all()


def test_a_short_word_decides_between_millions_of_others():
    texts = ["aaaaa", "bbbbb", "ab", "aaaaa bbbbb " * 1_700_000 + "ab"]  # weights of 17 million, and one of 1
    fp, _ = simhash.fingerprint(*T.utf8(pa.array(texts)), simhash._signs())
    differ = fp[0] ^ fp[1]
    assert differ.all() and (fp[3] == (fp[0] & ~differ) | (fp[2] & differ)).all()


@pytest.mark.parametrize("wide", [0, 10**12])
def test_wide_blocks_are_the_same_for_any_number_of_fingerprints(spark, monkeypatch, wide):
    fp, _ = furthest_pairs()
    keys = simhash.block_keys(fp, 24)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    as_if_many(monkeypatch, spark, fp)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, ["x"] * len(fp)), wide=wide).collect()}
    assert got == {i: i - (i % 2 and int(met[i // 2])) for i in range(len(fp))}


def furthest_pairs(n=400):
    """Fingerprints, two by two at the largest distance, of which some share a block of 16 bits and none of 24, and some the reverse."""
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (n, 1, 256), dtype=np.uint8).repeat(2, axis=1)
    for row in bits:
        row[1, rng.choice(256, simhash.MAX_DISTANCE, replace=False)] ^= 1
    fp = np.packbits(bits.reshape(2 * n, 256), axis=1).view(np.int64)
    met = [(k[::2] == k[1::2]).any(axis=1) for k in (simhash.block_keys(fp, width) for width in (16, 24))]
    assert (met[0] & ~met[1]).sum() > 9 and (met[1] & ~met[0]).sum() > 9
    return fp, met[0]


def as_if_many(monkeypatch, spark, fp):
    """``simhash`` with these fingerprints for the documents of those numbers, and tables that count as a billion rows."""
    table = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(fp)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: table)
    monkeypatch.setattr(type(table), "count", lambda _: 10**9)


def test_the_same_pairs_meet_however_many_fingerprints_there_are(spark, monkeypatch):
    fp, met = furthest_pairs()
    as_if_many(monkeypatch, spark, fp)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, ["x"] * len(fp))).collect()}
    assert got == {i: i - (i % 2 and int(met[i // 2])) for i in range(len(fp))}


@pytest.mark.parametrize("piece", [7, 40])
def test_hot_buckets_in_pieces_give_the_same_groups(spark, piece):
    df = frame(spark, near_copies(random.Random(8), 40, 12)[0]).repartition(3)
    assert sorted(simhash.near_duplicate_groups(df, piece=piece).collect()) == sorted(simhash.near_duplicate_groups(df).collect())


def test_large_buckets_connect_the_same_rows():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (12, 32), dtype=np.uint8)
    bits = np.unpackbits(base[rng.integers(0, 12, 1500) ** 2 % 12], axis=1)
    bits ^= (rng.random(bits.shape) < 0.08).astype(np.uint8)
    words_ = np.packbits(bits, axis=1).view(np.int64)
    key, node = np.sort(rng.integers(0, 3, 1500)), np.arange(1500)
    sets = []
    for large in (10, 10**9):
        label = np.arange(1500)
        simhash._roots(label, *simhash._bucket_edges(key, node, words_, 40, large))
        sets.append(label.tolist())
    assert sets[0] == sets[1] and 12 < len(set(sets[0])) < 700
    crowd = np.repeat(words_[:1], 60_000, axis=0)
    crowd[:, 0] ^= rng.integers(0, 2**20, 60_000)
    begun = time.process_time()
    assert len(simhash._bucket_edges(np.zeros(60_000, int), np.arange(60_000), crowd, 40)[0]) == 59_999
    assert time.process_time() - begun < 10


def test_many_equal_copies_and_ties(spark):
    df = frame(spark, ["the same short text again"] * 300, [i // 2 for i in range(300)])
    got = simhash.near_duplicate_groups(df).collect()
    assert len(got) == 150 and {(r.group_id, r.group_size) for r in got} == {(0, 150)} and sum(r.keep for r in got) == 1
    assert simhash.drop_near_duplicates(df).count() == 2


def test_texts_of_one_doc_id_connect(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(words(rng, 60, 5000)) for _ in range(3))
    df = frame(spark, [a, a, b, b, c], [1, 7, 7, 3, 9])
    assert {r.doc_id: (r.group_id, r.group_size) for r in simhash.near_duplicate_groups(df).collect()} == {1: (1, 3), 7: (1, 3), 3: (1, 3), 9: (9, 1)}


def test_simhash_corner_cases(spark):
    docs = clashing(odd(spark))
    got = {r.doc_id: (r.group_id, r.group_size, r.keep) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {i: (i, 1, True) for i in range(1, 6)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    own = {x for a, b in edges if a == b for x in (a,)}
    assert all(got[x] == root[x] for x in got) and {x for x in root if x not in got} <= own


# -- fingerprints ------------------------------------------------------------------------------------------------------


def test_entropy_classes_match_brute_force():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 110, 70_000).astype(np.uint8)
    got = fingerprints.entropy_classes(buf)
    for i in [0, 1, 63, 64, 65_535, 65_536, 65_537, len(got) - 1]:
        n = np.bincount(buf[i : i + 64])
        n = n[n > 0]
        assert abs(got[i] - (6 - (n * np.log2(n)).sum() / 64) / 6 * 1000) <= 1.01


def test_features_match_brute_force_and_ignore_neighbours():
    rng = random.Random(6)
    texts = [" ".join(words(rng, n)) for n in (40, 3, 9, 300, 11)] + ["", "short"]
    rank = fingerprints.ranks(np.arange(1000) % 97)
    buf, off = T.utf8(pa.array(texts))
    row, h = fingerprints.features(buf, off, rank)
    for k, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8)
        mine = h[row == k]
        alone = fingerprints.features(b, np.array([0, len(b)]), rank)[1]
        assert (mine == alone).all()
        if len(b) >= 64:
            r = rank[fingerprints.entropy_classes(b)]
            points = np.zeros(len(r), int)
            for s in range(-63, len(r)):
                lo, hi = max(s, 0), min(s + 64, len(r))
                points[lo + int(r[lo:hi].argmin())] += 1
            assert len(mine) == (points >= 16).sum()
        else:
            assert len(mine) == (len(b) > 0)


def test_search_finds_what_brute_force_finds(spark):
    rng = random.Random(8)
    texts = []
    for g in range(60):
        base = words(rng, 250, 5000)
        for c in range(1 + g % 3):
            t = list(base)
            for _ in range(c * 3):
                t[rng.randrange(250)] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(t))
    texts += texts[:5]
    got = {r.doc_id: r for r in fingerprints.fingerprint(frame(spark, texts).repartition(3)).collect()}
    d = [bytes(got[i].digest) for i in range(len(texts))]
    true = {i: max((fingerprints.similarity(d[i], d[j]) for j in range(i)), default=0) for i in range(len(texts))}
    want = {i for i, s in true.items() if s >= fingerprints.MATCH}
    have = {i for i, r in got.items() if r.match_id is not None}
    assert have <= want and len(have) >= 0.9 * len(want) and len(want) > 20
    for i in have:
        assert got[i].match_id < i and got[i].similarity == pytest.approx(fingerprints.similarity(d[i], d[got[i].match_id]))
    assert all(got[len(texts) - 5 + k].match_id == k for k in range(5))


@pytest.mark.parametrize("piece", [fingerprints.PIECE, 40])
def test_groups_hold_the_pairs_of_brute_force(spark, piece):
    """Groups of hundreds whose members lie between documents that share passages with them and match none."""
    rng = random.Random(12)
    passages = [words(rng, 40, 5000) for _ in range(3)]
    bases = [words(rng, n, 5000) for n in (150, 150, 700)]
    texts = []
    for k in range(600):
        t = list(bases[k % 3]) if k % 2 else words(rng, 170, 5000)
        for _ in range(len(t) // 40):
            t[rng.randrange(len(t))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join([*passages[k % 3], *t]))
    got = {r.doc_id: r for r in fingerprints.fingerprint(frame(spark, texts).repartition(3), group_col="group", piece=piece).collect()}
    d = [bytes(got[i].digest) for i in range(len(texts))]
    true = np.zeros((len(d), len(d)))
    for i in range(len(d)):
        for j in range(i):
            true[i, j] = fingerprints.similarity(d[i], d[j])
    one = fingerprints.Chains(d)
    assert np.tril(fingerprints.similarities(one, one), -1) == pytest.approx(true)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(true >= fingerprints.MATCH), strict=True)]
    assert len(pairs) > 5000 and len({i for p in pairs for i in p}) < len(d)
    assert sum(got[i].group == got[j].group for i, j in pairs) >= 0.9 * len(pairs)
    root = list(range(len(d)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    assert all(root[r.group] == root[i] for i, r in got.items())
    best = {i: true[i].max() for i in {i for i, _ in pairs}}
    assert sum(got[i].similarity is not None and got[i].similarity >= s - 1e-9 for i, s in best.items()) >= 0.9 * len(best)


def test_chains_of_filters():
    h = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    f, chain = fingerprints.filters(np.zeros(400, int), h, 1)
    assert chain.tolist() == [3] and f.shape == (3, 256)
    assert fingerprints.similarity(f.tobytes(), f.tobytes()) == 1.0
    assert fingerprints.similarity(f.tobytes(), f[:1].tobytes()) < 0.6 and fingerprints.similarity(f.tobytes(), b"") == 0


def test_long_chains_compare_in_pieces():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400_000).astype(np.uint64)
    f = fingerprints.filters(np.zeros(400_000, int), h, 1)[0].tobytes()
    g = fingerprints.filters(np.zeros(200_000, int), h[:200_000], 1)[0].tobytes()
    small = [f[:512], g[256:2048]]
    tracemalloc.start()
    got = fingerprints.similarities(fingerprints.Chains([f]), fingerprints.Chains([g]))
    assert got.shape == (1, 1) and 0.4 < got[0, 0] < 0.6 and tracemalloc.get_traced_memory()[1] < 3e8
    tracemalloc.stop()
    many = fingerprints.similarities(fingerprints.Chains(small), fingerprints.Chains(small[::-1]))
    assert np.allclose(many, [[fingerprints.similarity(a, b) for b in small[::-1]] for a in small])


def test_fingerprint_corner_cases(spark):
    docs = clashing(odd(spark))
    got = fingerprints.fingerprint(docs)
    assert got.columns == ["doc_id", "n_features", "digest", "match_id", "similarity"]
    rows = got.collect()
    assert len(rows) == 7 and all(r.match_id is None for r in rows)
    assert {r.doc_id: r.n_features for r in rows}[1] == 0 and {r.doc_id: len(r.digest) for r in rows}[2] == 0
    assert fingerprints.fingerprint(docs.limit(0)).count() == 0


# -- decontamination ---------------------------------------------------------------------------------------------------


def brute_tiles(item, doc, least):
    """Greedy string tiling, by its definition."""
    a, b = item, doc
    least = min(least, len(a))
    ma, mb = [False] * len(a), [False] * len(b)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or n == 0:
            return total
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        total += n


def test_tiling_matches_brute_force(spark):
    rng = random.Random(7)
    items = [words(rng, n, 300) for n in (30, 25, 12, 3)]
    docs = []
    for k in range(40):
        t = words(rng, rng.randrange(0, 40), 300)
        it = items[k % 4]
        cut = rng.randrange(len(it) + 1)
        parts = [it[:cut], it[cut:]] if k % 2 else [it[cut:], it[:cut]]  # reordered
        t[len(t) // 2 : len(t) // 2] = [*parts[0], *words(rng, 2, 300), *parts[1][: rng.randrange(len(parts[1]) + 1)]]
        docs.append(t)
    df = frame(spark, [" ".join(t) for t in docs]).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for bound in (4_000_000, 20):
        got = {(r.doc_id, r.item_id): r.covered for r in decontam.contaminated(df, bench, coverage=0.3, broadcast_tokens=bound).collect()}
        want = {(d, i): n for d, t in enumerate(docs) for i, it in enumerate(items) if (n := brute_tiles(it, t, 5)) >= 0.3 * len(it)}
        assert got == want and len(want) > 10


def test_tiling_of_repetitive_texts_matches_brute_force():
    rng = random.Random(17)
    for _ in range(150):
        items = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        docs = [[rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        made = decontam.Items(np.arange(3), pa.array([" ".join(t) for t in items]), 3)
        buf, off = T.utf8(pa.array([" ".join(t) for t in docs]))
        want = [(d, i, n) for d, t in enumerate(docs) for i, it in enumerate(items) if (n := brute_tiles(it, t, 3)) >= 0.4 * len(it) and n]
        assert decontam.covered(made, buf, off, 0.4) == want


@pytest.mark.parametrize("item,doc", [(["a"] * 500, ["a"] * 1_500_000), (["a", "b"] * 250, ["a", "b"] * 700_000), (["a"] * 5, ["a"] * 1_200_000), (["a"] * 100, ["b", *["a"] * 9] * 30_000)])
def test_millions_of_equal_tokens_take_little_memory(item, doc):
    tracemalloc.start()
    made = decontam.Items(np.arange(1), pa.array([" ".join(item)]), 5)
    buf, off = T.utf8(pa.array([" ".join(doc)]))
    got = decontam.covered(made, buf, off, 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, len(item) - (len(item) == 100))] and most < 1e9


def test_rows_are_dropped_by_their_own_text(spark):
    docs = frame(spark, ["one two three four five", "one two three four five", "fine", None, "fine too"], [None, 1, 1, 2, None])
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert sorted(str(r.text) for r in decontam.drop_contaminated(docs, bench).collect()) == ["None", "fine", "fine too"]


def test_decontamination_corner_cases(spark):
    docs = clashing(odd(spark))
    bench = spark.createDataFrame([(1, "no id at all here", 5), (None, "x y z", 6), (2, None, 7), (3, "", 8), (4, "...", 9)], "item_id long, text string, doc_id long")
    assert [(r.doc_id, r.item_id, r.covered) for r in decontam.contaminated(docs, bench).collect()] == [(None, 1, 5)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 6
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontam.contaminated(d, b).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 7
