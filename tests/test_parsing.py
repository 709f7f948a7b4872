import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import compression, parsing
from driftwell.operators import compaction

SCHEMA = "stream_id string, op binary, key binary, hash binary, data binary, meta binary"
META = b'{"content_type":"t","version":18446744073709551615,"updated_at":-5,"trace_parent":"00-aa-bb-01"}'


def sha(data):
    return hashlib.sha256(data).hexdigest().encode()


def frame(data):
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def parse(spark, entries, **more):
    rows = [(f"{i}-0", *[e.get(k) for k in ("op", "key", "hash", "data", "meta")]) for i, e in enumerate(entries)]
    return parsing.parse(spark.createDataFrame(rows, SCHEMA), **more).orderBy("ms").collect()


def test_malformed_entries_are_dropped_one_by_one(spark):
    got = parse(spark, [
        {"op": b"PUT", "key": b"good.1", "data": b"x"}, {"op": b"PUT", "data": b"x"}, {"key": b"k", "data": b"x"},
        {"op": b"DEL", "key": b"good.2"}, {"op": b"MOVE", "key": b"k"}, {"op": b"PUT", "key": b"k"},
        {"op": b"PUT", "key": b"\xff", "data": b"x"}, {"op": b"put", "key": b"k", "data": b"x", "hash": sha(b"x").upper()},
        {"op": b"delete", "key": b"k", "hash": b"h", "data": b"x", "meta": META},
    ])
    assert [r.reject_reason for r in got] == [
        None, "missing_key", "missing_op", None, "unknown_op", "missing_data", "missing_key", "hash_mismatch", None
    ]
    assert (got[8].op, got[8].hash, got[8].data, got[8].meta) == ("DELETE", None, None, None)


def test_a_put_without_hash_is_read_but_not_applied(spark):
    rows = spark.createDataFrame([("1-0", b"PUT", b"k", None, b"x", None)], SCHEMA)
    assert compaction.applicable(parsing.valid(parsing.parse(rows))).count() == 0


def test_metadata_is_whole_or_absent(spark):
    bad = [b"{}", b"x", b'{"content_type":"t","version":1.5,"updated_at":1}', b'{"content_type":"t","version":1}',
           b'{"content_type":"t","version":18446744073709551616,"updated_at":1}']
    got = parse(spark, [{"op": b"PUT", "key": b"k", "data": b"x", "meta": m} for m in [META, *bad]])
    assert (int(got[0].meta.version), got[0].meta.updated_at) == (2**64 - 1, -5)
    assert [r.meta for r in got[1:]] == [None] * 5
    assert {r.reject_reason for r in got} == {None}


def test_compressed_payloads(spark):
    big = bytes(i % 251 for i in range(1_000_000))
    bad = [compression.MAGIC, compression.MAGIC + b"\0" * 50, frame(big)[:-20], compression.MAGIC + bytes(range(256)) * 4]
    plain = [b"", b"\0", b"\xff", b"\x28", b"\x28\xb5", b"\x28\xb5\x2f"]
    got = parse(spark, [{"op": b"PUT", "key": b"k", "data": d, "hash": h} for d, h in
                        [(frame(big), sha(big)), (frame(big), sha(frame(big))), *[(b, None) for b in bad], *[(p, sha(p)) for p in plain]]])
    assert bytes(got[0].data) == big and got[0].reject_reason is None
    assert [r.reject_reason for r in got[1:6]] == ["hash_mismatch", *["bad_frame"] * 4]
    assert [bytes(r.data) for r in got[6:]] == plain and {r.reject_reason for r in got[6:]} == {None}


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=2000))
def test_frames_round_trip(data):
    assert compression.decode_frame(frame(data)) == (data, None)


def test_trace_parts_need_no_more_than_dashes(spark):
    df = spark.createDataFrame([("00-a-b-01",), ("x",), ("x-y",), (None,)], "t string")
    got = df.select(parsing.trace_id(F.col("t")).alias("a"), parsing.parent_span_id(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("a", "b"), (None, None), ("y", None), (None, None)]


def test_payloads(spark):
    df = spark.createDataFrame([('[{"a":1},2]',), ("[]",), ("[1",), ("plain",), ('{"a":1}',), (None,)], "t string")
    got = [r[0] for r in df.select(parsing.payload(F.col("t"))).collect()]
    assert got == ['{"a":1}', None, "[1", "plain", '{"a":1}', None]


def test_node_hashes(spark):
    df = spark.createDataFrame([("aB" * 32,), ("ab" * 31,), ("zz" * 32,), (None,)], "t string")
    got = [r[0] for r in df.select(parsing.node_hash(F.col("t"))).collect()]
    assert bytes(got[0]) == b"\xab" * 32 and got[1:] == [None] * 3


def test_an_empty_feed(spark):
    assert parse(spark, []) == []
