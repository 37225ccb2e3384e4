import glob
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexmark import cli
from vexmark.embed import HashingEmbedder, OnnxEmbedder, embed, mean_pool, normalize, sentences
from vexmark.errors import Code, EngineError
from vexmark.functions import metadata as M
from vexmark.functions import vectors as V
from vexmark.sources import binlog as B
from vexmark.sources import lines as L
from vexmark.sources import rawvec as X


def test_raw_matrix_in_small_ranges(spark, tmp_path):
    m = np.arange(30, dtype="<f4").reshape(10, 3)
    path = tmp_path / "m.bin"
    path.write_bytes(m.tobytes() + b"\0\0\0\0\0")  # a cut last row
    got = [(r.id, r.embedding) for r in X.read_f32(spark, str(path), 3, range_bytes=30).orderBy("id").collect()]
    assert got == [(i, row.tolist()) for i, row in enumerate(m)]
    assert X.trailing_bytes(spark, str(path), 3) == 5
    assert X.read_query(spark, str(path), 3) == [0.0, 1.0, 2.0]
    with pytest.raises(EngineError) as e:
        X.read_query(spark, str(path), 1000)
    assert e.value.code is Code.EOF
    (tmp_path / "empty.bin").write_bytes(b"")
    assert X.read_f32(spark, str(tmp_path / "empty.bin"), 3).count() == 0
    with pytest.raises(EngineError):
        X.read_f32(spark, str(tmp_path / "none"), 3)


def test_fvecs_and_ivecs(spark, tmp_path):
    def pack(kind, rows):
        return b"".join(struct.pack(f"<i{len(r)}{kind}", len(r), *r) for r in rows)

    (tmp_path / "f").write_bytes(pack("f", [[1, 2], [3, 4], [5, 6]]))
    (tmp_path / "i").write_bytes(pack("i", [[7, 8, 9], [1, 2, 3]]))
    (tmp_path / "bad").write_bytes(pack("f", [[1, 2, 3]]) + pack("f", [[1, 2]]) + b"\0" * 4)
    assert [(r.id, r.embedding) for r in X.read_fvecs(spark, str(tmp_path / "f"), 2).orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert [r.ids for r in X.read_ivecs(spark, str(tmp_path / "i"), 2).orderBy("qid").collect()] == [[7, 8], [1, 2]]
    with pytest.raises(Exception, match="dimension"):
        X.read_fvecs(spark, str(tmp_path / "bad")).collect()
    rows = X.read_fvecs(spark, str(tmp_path / "f"))
    assert X.write_fvecs(rows, str(tmp_path / "out")) == 3
    assert X.read_fvecs(spark, str(tmp_path / "out")).orderBy("id").collect() == rows.orderBy("id").collect()
    assert X.write_ids(rows, str(tmp_path / "ids")) == 3


def test_texts_are_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(3000, numPartitions=5).selectExpr("(id * 7919) % 3000 AS place", "concat(place, '\nand ', repeat('x', place % 50)) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        L.write_text(rows, str(tmp_path / "many"), "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    L.write_text(rows.where("place < 10"), str(tmp_path / "few"), "place")
    assert max(os.path.getsize(f) for f in glob.glob(str(tmp_path / "many/part-*"))) < 3000 * 20
    assert len(glob.glob(str(tmp_path / "few/part-*"))) == 1
    got = [(r.id, r.text) for r in L.read_lines(spark, str(tmp_path / "many"), 4000).orderBy("id").collect()]
    assert got == [(i, f"{i} and {'x' * (i % 50)}") for i in range(3000)]


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n\na\n", "one\ntwo\n\nfour é\nfive", "x" * 100 + "\n" + "y\n" * 50])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_line_numbers(spark, tmp_path, text, step):
    if step == 1 and len(text) > 50:
        pytest.skip("too many ranges")
    path = tmp_path / "t"
    path.write_text(text)
    want = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
    got = [(r.id, r.text) for r in L.read_lines(spark, str(path), step).orderBy("id").collect()]
    assert got == list(enumerate(want))


def test_line_lookup(spark, tmp_path):
    (tmp_path / "t").write_text("zero\none\n")
    hits = spark.createDataFrame([(1, 1), (2, 9)], "rank int, id long")
    assert [r.text for r in L.lookup(hits, L.read_lines(spark, str(tmp_path / "t"))).orderBy("rank").collect()] == ["one", L.NO_LINE]
    assert L.lookup(hits, None).first().text == L.NO_FILE


def test_log_header():
    h = B.Header().checked()
    assert h.crc == 1956998465 and B.parse_header(h.pack()) == h
    other = B.Header(version=2, flags=0x1234, created=1234567890).checked()
    assert B.parse_header(other.pack()) == other
    for data, code in ((b"abc", Code.BAD_HEADER), (B.Header(magic=0xDEADBEEF).checked().pack(), Code.BAD_HEADER), (B.Header().pack(), Code.CHECKSUM_MISMATCH)):
        with pytest.raises(EngineError) as e:
            B.parse_header(data)
        assert e.value.code is code


def log_of(*entries):
    return B.Header().checked().pack() + b"".join(e.pack() for e in entries)


INSERT, DELETE = B.Entry("INSERT", 5, 10, 42, (1.5, 2.5)), B.Entry("DELETE", 6, 11, 7)


def test_log_records():
    packed = INSERT.pack()
    assert len(packed) == 45 + 8 and struct.unpack_from("<I", packed, 49)[0] == zlib.crc32(struct.pack("<2f", 1.5, 2.5))
    got = list(B.entries(log_of(INSERT, DELETE)))
    assert [(e.op, e.lsn, e.txid, e.id, e.embedding) for e in got] == [("INSERT", 5, 10, 42, (1.5, 2.5)), ("DELETE", 6, 11, 7, ())]
    assert all(e.status().ok for e in got)
    assert B.Entry("NOPE", 1, 1).status().code is Code.BAD_RECORD
    assert B.Entry("INSERT", 1, 1, embedding=(1.0,), dimension=2).status().code is Code.BAD_RECORD
    assert B.Entry("INSERT", 1, 1, embedding=(1.0,), payload_crc=3).status().code is Code.CHECKSUM_MISMATCH


def test_damaged_logs():
    whole = log_of(INSERT, DELETE)
    flipped = bytearray(whole)
    flipped[24 + 49] ^= 255
    kind = bytearray(whole)
    kind[24] = 99
    wide = bytearray(whole)
    wide[24 + 36 : 24 + 40] = struct.pack("<I", 70_000)
    for data, code in ((b"", Code.EOF), (bytes(flipped), Code.CHECKSUM_MISMATCH), (bytes(kind), Code.BAD_RECORD), (bytes(wide), Code.BAD_RECORD), (whole[:-3], Code.IO_ERROR)):
        with pytest.raises(EngineError) as e:
            list(B.entries(data))
        assert e.value.code is code
    assert len(list(B.entries(whole[:-3], tolerate_torn_tail=True))) == 1


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "db.wal")
    rows = spark.createDataFrame([(2, 2, "DELETE", 1, None), (1, 1, "INSERT", 1, [1.0, 2.0])], "lsn long, txid long, op string, id long, embedding array<float>")
    B.write_log(rows, path, created=5)
    assert B.read_header(spark, path).created == 5
    got = B.read_log(spark, path).orderBy("lsn").collect()
    assert [(r.lsn, r.op, r.dimension, r.embedding) for r in got] == [(1, "INSERT", 2, [1.0, 2.0]), (2, "DELETE", 0, [])]
    assert json.loads(B.dump(B.read_log(spark, path)).orderBy("lsn").first().json)["op"] == "INSERT"
    assert [r[0] for r in spark.range(0, 8, 1, 1).select(B.op_name(F.col("id").cast("int"))).collect()] == ["INVALID", "COMMIT_TXN", "ABORT_TXN", "INSERT", "DELETE", "UPDATE", "BATCH_INSERT", "INVALID"]
    with pytest.raises(EngineError) as e:
        B.read_header(spark, str(tmp_path / "none"))
    assert e.value.code is Code.IO_ERROR


def test_metadata(spark):
    texts = ['{"a": 1, "b": 0.95, "c": "x", "d": true}', "{}", '{"a": [1]}', '{"a": {"b": 1}}', '{"a": null}', "[1, 2, 3]", "{ bad }", "3", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, metadata string")
    got = {r.id: r.s for r in rows.select("id", M.status(F.col("metadata")).alias("s")).collect()}
    assert got == {0: "kOk", 1: "kOk", 8: "kOk"} | {i: "kInvalidArgument" for i in range(2, 8)}
    kinds = {r.key: (r.kind, r.value) for r in M.entries(rows.where("id = 0")).collect()}
    assert kinds == {"a": ("int64", "1"), "b": ("double", "0.95"), "c": ("string", "x"), "d": ("bool", "true")}
    assert M.loads(M.dumps({"x": 1, "y": "é"})) == {"x": 1, "y": "é"}
    for bad in ('{"a": [1]}', "[1]", "{ bad }"):
        with pytest.raises(EngineError):
            M.loads(bad)


def test_vector_functions(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    got = {r.id: r for r in rows.select("id", V.norm(F.col("v")).alias("n"), V.l2_normalize(F.col("v")).alias("u"), V.payload_bytes(F.col("v")).alias("b"), V.dimension_status(F.col("v"), 2).alias("s")).collect()}
    assert got[1].n == 5.0 and got[1].u == pytest.approx([0.6, 0.8]) and got[1].b == 8
    assert got[2].u == [0.0, 0.0] and got[3].s == "kDimensionMismatch" and got[3].b == 0


def test_embedding(spark):
    assert mean_pool(np.array([[[1.0, 2], [3, 4], [9, 9]]]), np.array([[1, 1, 0]])).tolist() == [[2, 3]]
    assert mean_pool(np.ones((1, 2, 3)), np.zeros((1, 2))).tolist() == [[0, 0, 0]]
    assert normalize(np.array([[3.0, 4], [0, 0]])).ravel().tolist() == pytest.approx([0.6, 0.8, 0, 0])
    rows = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue whale"), (4, ""), (5, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed(rows, HashingEmbedder(16)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == [0.0] * 16 and got[5] is None and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)


def test_sentences(spark):
    text = "Too short. " + "a" * 40 + "! " + "b" * 201 + "? " + "c" * 200
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert sorted(len(r.sentence) for r in sentences(rows).collect()) == [40, 200]


def test_cli(spark, tmp_path, capsys):
    texts = ["red fox", "blue whale", "green frog", "one more line"]
    m = HashingEmbedder(8)(texts[:3])
    (tmp_path / "e.bin").write_bytes(m.astype("<f4").tobytes())
    (tmp_path / "t.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "q.bin").write_bytes(m[1].astype("<f4").tobytes())
    e, t, q, c, o = (str(tmp_path / n) for n in ("e.bin", "t.txt", "q.bin", "col", "out"))
    assert cli.main(["ingest", "-e", e, "-t", t, "-o", c, "-d", "8"], spark) == 0
    assert "3 vectors" in (said := capsys.readouterr().out) and "1 lines without a vector" in said
    assert cli.main(["query", "-f", q, "-c", c, "-t", t, "-k", "2", "-o", o], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("1. [0.0000] blue whale")
    assert cli.main(["search", "green", "frog", "-c", c, "-t", t, "-k", "1"], spark) == 0
    assert "green frog" in capsys.readouterr().out
    assert cli.main(["search", "x", "-c", str(tmp_path / "none")], spark) == 0
    assert "kNotFound" in capsys.readouterr().out
    assert cli.main(["nonsense"], spark) == 1 and cli.main([], spark) == 1


def onnx_model(table, names):
    """Bytes of a model that looks token ids up in ``table``; its inputs are declared in the order of ``names``."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(value)) + value

    def declared(name, kind, dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    weights = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "out") + field(4, "Gather")
    inputs = b"".join(field(11, declared(n, 7, ["b", "t"])) for n in names)
    graph = field(1, node) + field(2, "g") + field(5, weights) + inputs + field(12, declared("out", 1, ["b", "t", table.shape[1]]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.mark.parametrize("names", [["input_ids", "attention_mask", "token_type_ids"], ["attention_mask", "token_type_ids", "input_ids"], ["input_ids"]])
def test_onnx_embedding(spark, tmp_path, names):
    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    files = sorted(glob.glob(os.environ.get("TOKENIZER_FILES", "/opt/tokenizers/*.json")))
    if not files:
        pytest.skip("no tokenizer file")
    tok = tokenizers.Tokenizer.from_file(files[0])
    table = np.random.default_rng(1).normal(size=(tok.get_vocab_size(with_added_tokens=True) + 10, 4)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(onnx_model(table, names))
    model = OnnxEmbedder(str(tmp_path / "m.onnx"), files[0])
    texts = ["a longer text about words", "short", None, "two words"]
    got = {r.id: r.embedding for r in embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        mean = table[tok.encode(t, add_special_tokens=False).ids].mean(axis=0)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-5)


def test_even_logs_read_as_uneven_ones(spark, tmp_path):
    """The quick way for records of one dimension gives what the slow one does, and leaves damaged files to it."""
    rng = np.random.default_rng(3)
    entries = [B.Entry(op, k + 1, k + 9, 7 * k, tuple(rng.normal(size=3).astype(np.float32).tolist())) for k, op in enumerate(["INSERT", "UPDATE", "BATCH_INSERT"] * 5)]
    data = B.Header(created=5).checked().pack() + b"".join(e.pack() for e in entries)
    even = B._even(data)
    assert even.num_rows == 15 and even.schema == B._ARROW
    (tmp_path / "even").write_bytes(data)
    (tmp_path / "uneven").write_bytes(data + B.Entry("DELETE", 99, 99, 1).pack())
    fast, slow = (B.read_log(spark, str(tmp_path / n)).where("lsn < 99").orderBy("lsn").collect() for n in ("even", "uneven"))
    assert fast == slow and B._even((tmp_path / "uneven").read_bytes()) is None
    for at in (30, 60, len(data) - 1):
        assert B._even(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]) is None
    assert B._even(data[:-3]) is None and B._even(data[:24]) is None


def test_log_parts_come_in_order(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr("1000 - id AS lsn", "1000 - id AS txid", "if(id % 5 = 0, 'DELETE', 'INSERT') AS op", "id", "if(id % 5 = 0, null, array(cast(id AS float))) AS embedding")
    B.write_log(rows, f"{tmp_path}/log", created=1)
    entries = list(B.entries((tmp_path / "log").read_bytes()))
    assert [e.lsn for e in entries] == list(range(1, 1001)) and all(e.id == 1000 - e.lsn and e.dimension == (e.id % 5 > 0) for e in entries)
    assert os.listdir(tmp_path) in (["log", ".log.crc"], [".log.crc", "log"], ["log"])
