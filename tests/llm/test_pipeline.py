import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from test_dedup import as_if_many, brute_lines, brute_tiles, clashing, edited_pairs, frame, furthest_pairs, odd

import corpus_pipeline
from vexmark.llm import decontam, quality, simhash
from vexmark.llm import queries as Q
from vexmark.llm import textcore as T


def cell(x):
    return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x)


def test_stages_do_as_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    want = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    lines = corpus_pipeline.drop_recurring_lines(spark, docs, sf)
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0
    near = corpus_pipeline.near_dedup(spark, docs, sf)
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in simhash.near_duplicate_groups(docs).where("keep").collect()}
    clean = corpus_pipeline.decontaminate(spark, docs, sf)
    bad = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_line_stage_drops_what_is_left_of_copies(spark, sf):
    own = [f"{w} says a line of its own at {w} here" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta")]
    texts = {1: own, 2: [*own[:5], "edited"], 3: ["Notice.", "short text"], 4: ["Notice."], 5: [*own[:4], *(f"new {w} text {w}{w}{w}{w}{w}{w}" for w in ("abcdefgh", "hgfedcba", "fedcbahg"))]}
    rows = [(d, "\n".join(t), "x") for d, t in texts.items()] + [(6, None, None), (7, "", "y"), (None, own[0], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_lost string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_recurring_lines(spark, docs, sf).collect()}
    assert got == {1: "\n".join(own), 3: "Notice.\nshort text", 5: "\n".join(texts[5][4:]), 6: None, 7: "", None: own[0]}


def test_near_copies_go_however_many_documents_there_are(spark, sf, monkeypatch):
    fp, met = furthest_pairs()
    docs = frame(spark, [f"text {i}" for i in range(len(fp))])
    as_if_many(monkeypatch, spark, fp)
    left = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in left) == [i for i in range(len(fp)) if not (i % 2 and met[i // 2])]
    assert all(r.text == f"text {r.doc_id}" for r in left)


def test_near_copies_go_however_many_documents_are_in_a_batch(spark, sf):
    texts, group = edited_pairs(random.Random(2))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows in ("1", "50", before):
            spark.conf.set(key, rows)
            left = corpus_pipeline.near_dedup(spark, frame(spark, texts), sf).collect()
            assert sorted(r.doc_id for r in left) == sorted(set(group))
    finally:
        spark.conf.set(key, before)


def test_run_packs_what_the_stages_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    left = {r.doc_id for r in docs.where("text RLIKE '[^\\\\s]'").collect()}
    packed = {d for r in corpus_pipeline.run(spark, sf).collect() for d in r.doc_ids}
    assert packed == left and 0 < len(left) < 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]


def brute_exact_lines(docs):
    """``brute_lines`` with short lines and lines of mostly fields as templates of their own."""
    out = brute_lines(docs)
    at = {}
    for d, t in docs.items():
        for no, line in enumerate(t.split("\n")):
            toks = line.split()
            lit = sum(not re.search(r"\d", x) for x in toks)
            if toks and not (lit >= 3 and 2 * lit >= len(toks)) and (lit == len(toks) or re.search(r"[^\W\d_]", line)):
                at.setdefault(tuple(toks), []).append((d, no, line))
    for places in at.values():
        if len({d for d, *_ in places}) > 1:
            for d, _, line in sorted(places)[1:]:
                kept = out[d].split("\n")
                kept.remove(line)
                out[d] = "\n".join(kept)
    return out


def brute_copies(docs):
    """The smallest doc_id of each component of pairs within the largest distance, from all pairs."""
    ids = [d for d in docs if re.search(r"\w", docs[d])]
    buf, off = T.utf8(pa.array([docs[d] for d in ids]))
    fp = simhash.fingerprint(buf, off, simhash._signs())[0].view(np.uint64)
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    root = {d: d for d in docs}
    for i, d in enumerate(ids):
        for j, e in enumerate(ids[:i]):
            if far[i, j] <= simhash.MAX_DISTANCE and root[d] != root[e]:
                low, high = sorted((root[d], root[e]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_run_matches_brute_force(spark, tmp_path):
    """Documents with every kind of fault, through plain versions of all stages; only the classifier's model is the operator's own."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]

    def line():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 14)))

    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    docs = {d: "\n".join(line() for _ in range(rng.randrange(1, 12))) for d in range(150)}
    for d in range(10):
        docs[200 + d] = "#$%& @@ || 12 99 $$ " * 20 + f"{d}"  # bad
        docs[220 + d] = docs[d].replace("\n", f" {vocabulary[d]}\n", 1) if "\n" in docs[d] else docs[d]  # near copies
        docs[240 + d] = docs[20 + d] + "\nAll rights reserved.\nshared notice of the site owner here"
        docs[260 + d] = " ".join([docs[40 + d], *item.split()[15:], "between", *item.split()[:15]])  # reordered
    docs |= {300: "", 301: docs[60], 302: docs[60]}
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(not 200 <= d < 210), 0) for d in docs if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.classify(table, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("keep").collect()}
    left = {d: t for d, t in docs.items() if d in good}
    assert not good & set(range(200, 210)) and len(left) > 180
    cut = brute_exact_lines(left)
    lost = {d: left[d].count("\n") - cut[d].count("\n") + (cut[d] == "" != left[d]) for d in left}
    left = {d: t for d, t in cut.items() if not lost[d] or (t and (lost[d] < 4 or len(t) >= 0.5 * len(docs[d])))}
    root = brute_copies(left)
    left = {d: t for d, t in left.items() if root[d] == d}
    tokens = item.split()
    left = {d: t for d, t in left.items() if brute_tiles(tokens, t.lower().split(), 5) < 0.5 * len(tokens)}
    want = {d: len(re.findall(r"\w+|[^\w\s]", t)) for d, t in left.items() if t.strip()}
    have = {}
    for r in got:
        assert r.n_tokens == sum(r.lengths) <= 2048
        for d, n in zip(r.doc_ids, r.lengths, strict=True):
            have[d] = have.get(d, 0) + n
    assert have == want and not set(want) & set(range(260, 270)) and 302 not in want


def test_stages_take_odd_documents(spark, sf):
    for docs in (odd(spark), clashing(odd(spark)), odd(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.count()
            assert name == "best-fit packing" or out.columns == docs.columns


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in Q.ORACLE_SQL.items():
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        got = Q.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(names)
        assert sorted(tuple(cell(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(cell, r)) for r in want.fetchall())


def test_every_operator_has_a_query():
    numbers = sorted(int(n.split("_")[0][2:]) for n in Q.QUERIES)
    assert numbers == list(range(1, 11))
