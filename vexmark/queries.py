"""Queries over the driver's tables, one for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .embed import HashingEmbedder, embed, sentences
from .files import kept, scratch
from .functions import metadata as M
from .functions import vectors as V
from .ingest import ingest, zip_rows
from .operators import ann
from .operators import evaluate as E
from .operators import replay as R
from .operators import search as S
from .plans.catalog import Database
from .plans.collection import Collection
from .sources import binlog, lines, rawvec
from .streaming.ingest import CHANGES, into_collection, read_changes, windowed_counts
from .types import CollectionConfig, Metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of single searches: the vector of id 0."""
    return vectors(spark, sf_dir).where("id = 0").select("embedding").first()[0]


def rounded(hits: DataFrame) -> DataFrame:
    """Scores to six digits, without negative zeros."""
    r = F.round("score", 6)
    return hits.withColumn("score", F.when(r == 0, 0.0).otherwise(r))


_ROUND = "CASE WHEN round(s, 6) = 0 THEN 0.0::DOUBLE ELSE round(s, 6) END"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_L2 = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({}, {})])"


def _single_sql(score: str, order: str, k: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY s {order}, vec_id) AS INTEGER) AS rank, vec_id AS id, {_ROUND} AS score
        FROM (SELECT vec_id, {score} AS s FROM embeddings) ORDER BY rank LIMIT {k}"""


_DOT_SQL = f"list_inner_product(embedding::DOUBLE[], {_Q}) - 1"


# -- single searches ---------------------------------------------------------------------------------------------------


@query(_single_sql(_DOT_SQL, "DESC", 10))
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, Metric.COSINE))


@query(_single_sql(_DOT_SQL, "DESC", 10))
def knn_ip_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, Metric.INNER_PRODUCT))


@query(_single_sql(_L2.format("embedding::DOUBLE[]", _Q), "ASC", 10))
def knn_l2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, Metric.L2))


@query(_single_sql(_DOT_SQL, "DESC", 1_000_000))
def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 1_000_000))


# -- batch searches: every vector is a query ---------------------------------------------------------------------------


def _batch_sql(score: str, order: str, k: int, where: str = "true", select: str = "qid, rank, id, score") -> str:
    return f"""SELECT {select} FROM (
        SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY s {order}, id) AS INTEGER) AS rank, id, {_ROUND} AS score FROM (
            SELECT q.vec_id AS qid, e.vec_id AS id, {score} AS s FROM embeddings q, embeddings e WHERE {where})) WHERE rank <= {k}"""


_PAIR = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) - 1"


def _queries(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))


@query(_batch_sql(_PAIR, "DESC", 5))
def knn_batch_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(S.knn_batch(v, _queries(v), 5))


@query(_batch_sql(_L2.format("e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"), "ASC", 5))
def knn_batch_l2_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(S.knn_batch(v, _queries(v), 5, Metric.L2))


@query(_batch_sql(_PAIR, "DESC", 3))
def knn_batch_declarative(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(S.knn_batch_sql(v, _queries(v), 3))


@query(_batch_sql(_PAIR, "DESC", 5, "e.label <> 3"))
def knn_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of one label have been removed."""
    v = vectors(spark, sf_dir)
    inserts = v.select((F.col("id") + 1).alias("lsn"), F.lit("INSERT").alias("op"), "id", "embedding")
    deletes = v.where("label = 3").select((F.col("id") + 10_000_000_000).alias("lsn"), F.lit("DELETE").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding"))
    return rounded(S.knn_batch(R.live(R.merged(None, inserts.union(deletes))), _queries(v), 5))


@query(f"""SELECT qid, rank, id, score, coalesce(m, '{{}}') AS metadata FROM ({_batch_sql(_PAIR, "DESC", 5)}) h
    LEFT JOIN (SELECT doc_id, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS m FROM documents) d ON h.id = d.doc_id""")
def knn_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct("lang", "source")).alias("metadata"))
    return rounded(S.with_metadata(S.knn_batch(v, _queries(v), 5), meta)).select("qid", "rank", "id", "score", "metadata")


@query(_batch_sql(_PAIR, "DESC", 5, "e.label = q.label"))
def knn_filtered_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vectors with the query's own label."""
    return rounded(_by_label(spark, sf_dir, 5))


def _by_label(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return S.knn_batch(v, v.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"), "label"), k, key_col="label")


# -- changes -----------------------------------------------------------------------------------------------------------

_EVENT_OP = "CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: event_id is the LSN, user_id the vector, errors delete, everything else inserts."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    vector = F.when(op == "INSERT", F.array(F.col("value").cast("float"), F.col("user_id").cast("float")))
    return e.select((F.col("event_id") + 1).alias("lsn"), (F.col("event_id") + 1).alias("txid"), op.alias("op"), F.col("user_id").alias("id"), vector.alias("embedding"))


@query("SELECT vec_id AS id, CASE WHEN label = 1 THEN 'kDimensionMismatch' ELSE 'kOk' END AS status, CASE WHEN label = 1 THEN 'expected 64 dimensions, got 32' ELSE '' END AS message FROM embeddings")
def insert_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_status(_mixed(spark, sf_dir), 64).select("id", "status", "message")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 1 are cut to half their size."""
    return vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("label") == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))


@query("SELECT count(*) FILTER (label <> 1) AS success_count, count(*) FILTER (label = 1) AS failure_count FROM embeddings")
def insert_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_counts(R.batch_status(_mixed(spark, sf_dir), 64))


@query(f"SELECT user_id AS id, max(event_id) + 1 AS lsn, arg_max({_EVENT_OP}, event_id) AS op FROM events GROUP BY user_id")
def wal_replay_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_writer(event_log(spark, sf_dir)).select("id", "lsn", "op")


@query(f"""SELECT c_custkey AS id, coalesce(op = 'DELETE', false) AS deleted, CASE WHEN op = 'DELETE' THEN NULL ELSE coalesce(round(v, 4), round(c_acctbal::FLOAT, 4)) END AS first_value
    FROM customer LEFT JOIN (SELECT user_id, arg_max({_EVENT_OP}, event_id) AS op, arg_max(value::FLOAT, event_id) AS v FROM events GROUP BY user_id) ON user_id = c_custkey
    UNION ALL SELECT user_id, op = 'DELETE', CASE WHEN op = 'INSERT' THEN round(v, 4) END FROM (
        SELECT user_id, arg_max({_EVENT_OP}, event_id) AS op, arg_max(value::FLOAT, event_id) AS v, count(*) FILTER (event_type <> 'error') AS ins FROM events GROUP BY user_id)
    WHERE user_id NOT IN (SELECT c_custkey FROM customer) AND (ins > 0 OR op = 'INSERT')""")
def wal_replay_over_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of all customers, then the events as its log."""
    snapshot = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("float")).alias("embedding"), F.lit(False).alias("deleted"))
    return R.merged(snapshot, event_log(spark, sf_dir)).select("id", "deleted", F.round(F.col("embedding")[0], 4).alias("first_value"))


@query("SELECT count(DISTINCT user_id) FILTER (event_type <> 'error') AS size FROM events")
def size_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(None, event_log(spark, sf_dir)).agg(F.count("*").alias("size"))


@query("SELECT max(event_id) + 2 AS next_lsn, max(event_id) + 2 AS next_txid, count(*) AS replayed, count(*) > 0 AS recovered FROM events")
def wal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counters(event_log(spark, sf_dir))


@query(f"SELECT {_EVENT_OP} AS op, count(*) AS n, min(event_id) + 1 AS first_lsn FROM events WHERE event_id + 1 > (SELECT count(*) // 2 FROM events) GROUP BY 1")
def wal_pending_after_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return R.pending(log, log.count() // 2).groupBy("op").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"))


@query("SELECT user_id AS id, event_id AS lsn, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct(F.col("event_id").alias("lsn"), "value").alias("v"))
    return e.groupBy("id").agg(F.max("v").alias("v")).select("id", "v.lsn", F.round("v.value", 4).alias("value"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) + 100 AS BIGINT) AS lsn, event_id AS pos FROM events")
def dense_lsn_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos")), 101).select("lsn", "pos")


@query("SELECT CASE WHEN label = 1 THEN 'kBadRecord' ELSE 'kOk' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def wal_record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir).select(F.lit("INSERT").alias("op"), F.lit(64).alias("dimension"), "embedding")
    return rows.groupBy(binlog.record_status(rows).alias("status")).agg(F.count("*").alias("n"))


# -- scalar functions --------------------------------------------------------------------------------------------------


@query("""SELECT vec_id AS id, round(n, 6) AS norm, round(sqrt(list_sum([(x / n) ** 2 FOR x IN e])), 5) AS unit_norm, round(list_sum([x / n FOR x IN e]), 4) AS unit_sum
    FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, [(x * (label + 1))::DOUBLE FOR x IN embedding] AS e FROM embeddings))""")
def l2_normalize_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors of all lengths: each is stretched by its label."""
    e = F.col("embedding")
    v = vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")))
    total = F.aggregate(V.l2_normalize(e), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("id", F.round(V.norm(e), 6).alias("norm"), F.round(V.norm(V.l2_normalize(e)), 5).alias("unit_norm"), F.round(total, 4).alias("unit_sum"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), M.get(F.col("props"), "k", "long").alias("k"))


_DOCUMENT_JSON = "to_json({lang: lang, n_chars: n_chars, half: n_chars / 2 + 0.25, long: n_chars > 1000})"


@query(f"""SELECT key, CASE json_type(v, '$') WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'int64' WHEN 'BIGINT' THEN 'int64' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'double' END AS kind,
        count(*) AS n, count(DISTINCT v->>'$') AS "values", round(sum(TRY_CAST(v->>'$' AS DOUBLE)), 3) AS total
    FROM (SELECT unnest(json_keys(j)) AS key, j->unnest(json_keys(j)) AS v FROM (SELECT {_DOCUMENT_JSON} AS j FROM documents)) GROUP BY 1, 2""")
def metadata_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' columns as metadata of all four kinds."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.to_json(F.struct("lang", "n_chars", (F.col("n_chars") / 2 + 0.25).alias("half"), (F.col("n_chars") > 1000).alias("long"))).alias("m"))
    e = M.entries(rows, "doc_id", "m")
    number = F.when(F.col("kind") != "bool", F.expr("try_cast(value AS double)"))
    return e.groupBy("key", "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.round(F.sum(number), 3).alias("total"))


_SPOILT = "CASE WHEN event_id % 7 = 0 THEN '[' || props || ']' WHEN event_id % 5 = 0 THEN substr(props, 2) WHEN event_id % 3 = 0 THEN '{\"a\":' || props || '}' ELSE props END"


@query(f"""SELECT CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' AND NOT list_has_any(list_transform(json_keys(p), lambda k: json_type(json_extract(p, '$.' || k))), ['OBJECT', 'ARRAY', 'NULL']) THEN 'kOk' ELSE 'kInvalidArgument' END AS status,
    count(*) AS n, min(event_id) AS first FROM (SELECT event_id, CASE WHEN json_valid(s) THEN s ELSE '[]' END AS p FROM (SELECT event_id, {_SPOILT} AS s FROM events)) GROUP BY 1""")
def metadata_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the events' properties are made arrays, cut short, or nested."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_SPOILT).alias("p"))
    return e.groupBy(M.status(F.col("p")).alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's metadata to the id-keyed form and back."""
    out = M.export_rows(table(spark, sf_dir, "events"), "event_id", "props").select(F.concat(F.lit("{"), "entry", F.lit("}")).alias("value"))
    return M.import_rows(out).select("id", M.get(F.col("metadata"), "k", "long").alias("k"))


@query()
def payload_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return vectors(spark, sf_dir).select("id", V.payload_bytes(e).alias("payload_length"), binlog.payload_crc(e).alias("payload_crc"), F.crc32(F.encode(V.vector_text(e), "UTF-8")).alias("text_crc"))


@query("SELECT doc_id, sentence FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS sentence FROM documents) WHERE length(sentence) BETWEEN 40 AND 200")
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "sentence")


# -- joins, evaluation, approximate search -----------------------------------------------------------------------------


@query("""SELECT e.n AS id, e.label, length(d.text) AS n_chars FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, label FROM embeddings) e
    JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, text FROM documents) d ON e.n = d.n""")
def ingest_zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.numbered(vectors(spark, sf_dir).withColumnRenamed("id", "pos"), 0).withColumnRenamed("lsn", "id")
    d = R.numbered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text"), 0).select(F.col("lsn").alias("id"), "text")
    labels = e.select("id", "label")
    return zip_rows(e, d).join(labels, "id").select("id", "label", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH t AS ({_batch_sql(_PAIR, "DESC", 10)}), f AS ({_batch_sql(_PAIR, "DESC", 10, "e.label = q.label")})
    SELECT round(avg(r), 6) AS recall, count(*) AS queries FROM (
        SELECT t.qid, count(f.id) / count(*) AS r FROM t LEFT JOIN f ON t.qid = f.qid AND t.id = f.id GROUP BY t.qid)""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a search that only looks at the query's own label."""
    v = vectors(spark, sf_dir)
    truth = E.hit_lists(S.knn_batch(v, _queries(v), 10))
    return E.mean_recall(E.hit_lists(_by_label(spark, sf_dir, 10)), truth, 10).withColumn("recall", F.round("recall", 6))


@query(f"""SELECT t.qid, t.id FROM ({_batch_sql(_PAIR, "DESC", 5)}) t SEMI JOIN ({_batch_sql(_PAIR, "DESC", 5, "e.label = q.label")}) f ON t.qid = f.qid AND t.id = f.id""")
def common_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.common_hits(knn_batch_top5(spark, sf_dir), knn_filtered_by_label(spark, sf_dir)).select("qid", "id")


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file's recall at 10 over 0.7 of its cells: these vectors are random, their neighbours anywhere."""
    v = vectors(spark, sf_dir)
    index = ann.build(v, scratch(spark))
    found = E.hit_lists(ann.search(index, _queries(v), 10, ef=index.rows * 7 // 10))
    return E.mean_recall(found, E.hit_lists(S.knn_batch(v, _queries(v), 10)), 10).select("queries", F.round("recall", 6).alias("recall"))


@query(_batch_sql(_PAIR, "DESC", 5, "e.label NOT IN (6, 7)"))
def ann_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of some labels; the others inserted, two removed; opened again, and with every cell probed exact."""
    v, path = vectors(spark, sf_dir), scratch(spark)
    ann.build(v.where("label < 7"), path).insert(v.where("label >= 7")).delete(v.where("label IN (6, 7)"))
    index = ann.load(spark, path)
    return rounded(ann.search(index, _queries(v), 5, ef=index.rows * 2))


@query(_batch_sql(_PAIR, "DESC", 5))
def ann_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cell probed the inverted file is exact."""
    v = vectors(spark, sf_dir)
    index = ann.build(v, scratch(spark))
    return rounded(ann.search(index, _queries(v), 5, ef=index.rows * 2))


@query()
def ann_lsh_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(ann.lsh_search(v, _queries(v), 5))


# -- files and collections ---------------------------------------------------------------------------------------------

_SUMS = "SELECT vec_id AS id, len(embedding) AS dimension, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"


def _sums(rows: DataFrame) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", F.size("embedding").cast("long").alias("dimension"), F.round(total, 6).alias("total"))


@query(_SUMS)
def raw_f32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rawvec.write_f32(vectors(spark, sf_dir), path)
    return _sums(rawvec.read_f32(spark, path, 64))


@query(_SUMS)
def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rawvec.write_fvecs(vectors(spark, sf_dir), path)
    return _sums(rawvec.read_fvecs(spark, path))


@query(_batch_sql(_PAIR, "DESC", 5, select="qid, id"))
def ivecs_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of each query to a file, the first five of each back."""
    v, path = vectors(spark, sf_dir), scratch(spark)
    rawvec.write_ivecs(E.hit_lists(S.knn_batch(v, _queries(v), 10)), path)
    return rawvec.read_ivecs(spark, path, 5).select("qid", F.explode("ids").alias("id"))


@query(_SUMS)
def binary_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = R.numbered(vectors(spark, sf_dir).withColumn("pos", F.col("id")), 1)
    binlog.write_log(rows.select("lsn", F.col("lsn").alias("txid"), F.lit("INSERT").alias("op"), "id", "embedding"), path)
    return _sums(binlog.read_log(spark, path))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, length(text) AS n_chars FROM documents")
def text_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    lines.write_text(table(spark, sf_dir, "documents"), path, "doc_id")
    return lines.read_lines(spark, path).select("id", F.length("text").cast("long").alias("n_chars"))


@query(f"""SELECT h.rank, h.id, h.score, coalesce(length(d.text), length('ERROR: Line not found')) AS n_chars FROM ({_single_sql(_DOT_SQL, "DESC", 1_000_000)}) h
    LEFT JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, text FROM documents) d ON d.n = h.id""")
def hit_line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = R.numbered(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text"), 0).select(F.col("lsn").alias("id"), "text")
    return lines.lookup(knn_k_exceeds_n(spark, sf_dir), texts).select("rank", "id", "score", F.length("text").cast("long").alias("n_chars"))


def _collection(spark: SparkSession, sf_dir: str, metric: Metric = Metric.COSINE) -> Collection:
    c = Collection(spark, CollectionConfig("vectors", 64, metric), path=scratch(spark))
    c.insert_batch(vectors(spark, sf_dir), "id")
    return c


@query(_batch_sql(_PAIR, "DESC", 5, "e.label NOT IN (2, 3)"))
def collection_save_delete_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all, remove a label, save, remove another, and open the folder again as after a crash."""
    v, c = vectors(spark, sf_dir), _collection(spark, sf_dir)
    c.remove_batch(v.where("label = 2"))
    c.save()
    c.remove_batch(v.where("label = 3"))
    return rounded(Collection.load(spark, c.path).search_batch(_queries(v), 5))


@query("SELECT vec_id AS id, '{\"label\":' || label || '}' AS metadata FROM embeddings WHERE label <> 4")
def collection_metadata_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = vectors(spark, sf_dir), _collection(spark, sf_dir)
    c.set_metadata_batch(v.select("id", F.to_json(F.struct("label")).alias("metadata")))
    c.remove_batch(v.where("label = 4"))
    c.save()
    return Collection.load(spark, c.path).metadata()


@query("SELECT 'collection_' || label AS name, 64 AS dimensions, 'Cosine' AS metric, count(*) AS size FROM embeddings GROUP BY label")
def catalog_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each label, and the database opened again."""
    v, path = vectors(spark, sf_dir), scratch(spark)
    with Database(spark, path) as db:
        for label in sorted(r[0] for r in v.select("label").distinct().collect()):
            db.create_collection(f"collection_{label}", CollectionConfig("", 64)).insert_batch(v.where(F.col("label") == label), "id")
    again = Database(spark, path)
    sizes = spark.createDataFrame([(n, again.get_collection(n).size()) for n in again.list_collections()], "name string, size long")
    return again.collections().join(sizes, "name").select("name", "dimensions", "metric", "size")


@query(_batch_sql(_PAIR, "DESC", 5, "e.label NOT IN (1, 2, 3)"))
def collection_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indexed collection, changed before a save and after it, opened again and searched over all cells."""
    v = vectors(spark, sf_dir)
    c = Collection(spark, CollectionConfig("vectors", 64), path=scratch(spark))
    c.insert_batch(v.where("label < 8"), "id")
    c.create_index()
    c.remove_batch(v.where("label = 1"))
    c.insert_batch(v.where("label = 8"), "id")
    c.save()
    c.remove_batch(v.where("label IN (2, 3)"))
    c.insert_batch(v.where("label = 9"), "id")
    again = Collection.load(spark, c.path)
    return rounded(again.search_batch(_queries(v), 5, ef=2 * again.size()))


@query(_batch_sql(_PAIR, "DESC", 5))
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors arrive as files of a stream."""
    v, source = vectors(spark, sf_dir), scratch(spark)
    v.select(F.col("id").alias("lsn"), "id", F.lit("INSERT").alias("op"), "embedding").write.parquet(source)
    c = Collection(spark, CollectionConfig("stream", 64), path=scratch(spark))
    into_collection(read_changes(spark, source, CHANGES), c, scratch(spark)).awaitTermination()
    return rounded(c.search_batch(_queries(v), 5))


@query(f"""SELECT user_id AS id, max(event_id) AS lsn, arg_max(value::FLOAT, event_id) AS value FROM events GROUP BY user_id HAVING arg_max({_EVENT_OP}, event_id) = 'INSERT'""")
def streaming_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes in five files, a batch each, of which the last events come first and others are repeated."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    rows = e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("id"), op.alias("op"), F.when(op == "INSERT", F.array(F.col("value").cast("float"), F.col("event_id").cast("float"))).alias("embedding"))
    rows, source = kept(rows), scratch(spark)
    for part in (4, 1, 3, 0, 2):
        rows.where(f"lsn % 5 = {part} OR lsn % 50 = {part}").coalesce(1).write.mode("append").parquet(source)
    c = Collection(spark, CollectionConfig("stream", 2), path=scratch(spark))
    into_collection(read_changes(spark, source, CHANGES, max_files=1), c, scratch(spark)).awaitTermination()
    return c.live_view().select("id", F.col("embedding")[1].cast("long").alias("lsn"), F.col("embedding")[0].alias("value"))


_TEN = "(SELECT * FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY vec_id LIMIT 10)"


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id AS id, {_ROUND} AS score, '{{"label":' || label || '}}' AS metadata
    FROM (SELECT vec_id, label, {_DOT_SQL} AS s FROM {_TEN}) WHERE vec_id <> 0""")
def collection_single_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors, and their metadata, put in and one taken out by single calls; a query with metadata."""
    v = vectors(spark, sf_dir)
    rows = v.join(v.where("id = 0").select("label"), "label", "left_semi").orderBy("id").limit(10).collect()
    c = Collection(spark, CollectionConfig("single", 64), path=scratch(spark))
    for r in rows:
        c.insert(r["id"], r["embedding"])
        c.set_metadata(r["id"], {"label": r["label"]})
    c.insert(rows[0]["id"], rows[0]["embedding"][:3])  # of another size: refused
    c.remove(0)
    hits = rounded(c.query(first_vector(spark, sf_dir), 100))
    return hits.select("rank", "id", "score", F.regexp_replace("metadata", " ", "").alias("metadata"))


_INGESTED = """SELECT e.n AS id, e.embedding, d.text FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, embedding FROM embeddings) e
    JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, text FROM documents) d ON e.n = d.n"""


def _ingest_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    embeddings, texts = scratch(spark), scratch(spark)
    rawvec.write_f32(vectors(spark, sf_dir), embeddings)
    lines.write_text(table(spark, sf_dir, "documents"), texts, "doc_id")
    return embeddings, texts


@query(f"SELECT id, round(list_sum(embedding::DOUBLE[]), 6) AS total, length(text) AS n_chars FROM ({_INGESTED})")
def bulk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw file and a text file into a collection, opened again: its vectors and each one's line."""
    report = ingest(spark, *_ingest_files(spark, sf_dir), scratch(spark), 64)
    c = Collection.load(spark, report.collection.path)
    texts = c.metadata().select("id", F.length(M.get(F.col("metadata"), "text", "string")).cast("long").alias("n_chars"))
    return _sums(c.live_view()).select("id", "total").join(texts, "id")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s, id) AS BIGINT) AS rank, n_chars FROM (
    SELECT id, length(text) AS n_chars, {_L2.format("embedding::DOUBLE[]", _Q)} AS s FROM ({_INGESTED})) ORDER BY rank LIMIT 10""")
def command_line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ingest``, then ``query`` with a vector file, as on the command line; the lines of its output file."""
    (embeddings, texts), out, answer = _ingest_files(spark, sf_dir), scratch(spark), scratch(spark)
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["ingest", "-e", embeddings, "-t", texts, "-o", out, "-d", "64"], spark)
        cli.main(["query", "-f", embeddings, "-c", out, "-t", texts, "-k", "10", "-o", answer], spark)
    return lines.read_lines(spark, answer).select((F.col("id") + 1).alias("rank"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT 'collection_' || label AS name, count(*) AS size, label % 2 = 0 AS there FROM embeddings GROUP BY label")
def catalog_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each label, those of odd ones dropped; which are still there when the database is opened again."""
    v, path = vectors(spark, sf_dir), scratch(spark)
    labels = sorted(r[0] for r in v.select("label").distinct().collect())
    sizes = []
    with Database(spark, path) as db:
        for label in labels:
            c = db.create_collection(f"collection_{label}", CollectionConfig("", 64))
            c.insert_batch(v.where(F.col("label") == label), "id")
            sizes.append(c.size())
            if label % 2:
                db.drop_collection(c.name)
    again = Database(spark, path)
    names = [f"collection_{label}" for label in labels]
    return spark.createDataFrame([(n, s, again.has_collection(n)) for n, s in zip(names, sizes, strict=True)], "name string, size long, there boolean")


@query("SELECT vec_id + 1 AS lsn, CASE WHEN label = 1 THEN 'DELETE' ELSE 'INSERT' END AS op, vec_id AS id, CASE WHEN label = 1 THEN 0 ELSE 64 END AS dimension, CASE WHEN label = 1 THEN 0 ELSE 256 END AS payload_length FROM embeddings")
def binary_log_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file of insertions and removals as JSON text, and what that says."""
    v, path = vectors(spark, sf_dir), scratch(spark)
    op = F.when(F.col("label") == 1, "DELETE").otherwise("INSERT")
    binlog.write_log(v.select((F.col("id") + 1).alias("lsn"), (F.col("id") + 1).alias("txid"), op.alias("op"), "id", F.when(F.col("label") != 1, F.col("embedding")).alias("embedding")), path)
    j = F.from_json("json", "lsn long, op string, id long, dimension int, payload_length int")
    return binlog.dump(binlog.read_log(spark, path)).select(j.alias("j")).select("j.*")


@query("SELECT event_id AS id, CASE event_id % 9 WHEN 1 THEN 'COMMIT_TXN' WHEN 2 THEN 'ABORT_TXN' WHEN 3 THEN 'INSERT' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'UPDATE' WHEN 6 THEN 'BATCH_INSERT' ELSE 'INVALID' END AS op FROM events")
def operation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), binlog.op_name((F.col("event_id") % 9).cast("int")).alias("op"))


@query(f"SELECT date_trunc('hour', ts) AS begin, {_EVENT_OP} AS op, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT")
    return windowed_counts(table(spark, sf_dir, "events").select("ts", op.alias("op")))


@query()
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the ten nearest documents, by hashed-word vectors."""
    docs = kept(embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), HashingEmbedder(64)).select("id", "embedding"))
    items = embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), HashingEmbedder(64), to="qv").select("qid", "qv")
    return rounded(S.knn_batch(docs, items, 10))


def seconds(spark: SparkSession, sf_dir: str, name: str) -> float:
    """How long a query takes, written to nowhere."""
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
