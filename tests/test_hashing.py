import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.functions.hashing import cbor, fnv1, fnv1_of, key_bytes, shard_of


def head(major, n):
    for lead, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < 256**width:
            return bytes([major << 5 | lead]) + n.to_bytes(width, "big")


def encoded(v):
    if v is None:
        return b"\xf6"
    if isinstance(v, bool):
        return b"\xf5" if v else b"\xf4"
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    return head(2, len(v)) + bytes(v)


CASES = [
    ("long", [0, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63 - 1, -1, -24, -25, -257, -(2**63), None]),
    ("string", ["", "a", "x" * 23, "x" * 24, "é" * 200, "y" * 70000, None]),
    ("binary", [b"", b"\x00\xff", bytes(300), None]),
    ("boolean", [True, False, None]),
]


@pytest.mark.parametrize(("kind", "values"), CASES)
def test_cbor_encoding(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    got = [bytes(r[0]) for r in df.select(cbor(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [encoded(v) for v in values]


def test_hash_and_shard_of_composite_keys(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(-(2**40), 2**40), rng.choice([None, "", "key", "ключ" * 9])) for _ in range(200)]
    df = spark.createDataFrame(rows, "b long, a string")
    h = fnv1(key_bytes("things", {"b": (F.col("b"), T.LongType()), "a": (F.col("a"), T.StringType())}))
    got = df.select("a", "b", h.alias("h")).withColumn("s", shard_of(F.col("h"), 7)).collect()
    for r in got:
        data = b"\x9f" + encoded("things") + b"\x82" + encoded("a") + encoded(r["a"]) + b"\x82" + encoded("b") + encoded(r["b"]) + b"\xff"
        want = fnv1_of(data)
        assert (r["h"]["hi"] << 32 | r["h"]["lo"]) == want
        assert r["s"] == want % 7 + 1


def test_types_without_encoding_are_refused():
    with pytest.raises(TypeError):
        cbor(F.lit(1.0), T.DoubleType())


def test_invalid_shard_count_is_refused():
    with pytest.raises(ValueError):
        shard_of(None, 0)
