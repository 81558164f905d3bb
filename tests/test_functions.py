"""Column functions against Python's own rules (uuid.uuid5, uuid.UUID, datetime.isoformat)."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from meterkit.functions import (
    canonical_uuid,
    floor_div,
    isoformat_utc,
    iso_z,
    packed_uuid,
    parse_ts,
    to_us,
    unpacked_uuid,
    uuid5_col,
)

NS = uuid.UUID("67f9a35c-567c-4a30-b51d-2fc64328bd55")


def test_uuid5_matches_python(spark):
    rnd = random.Random(1)
    names = ["ws1-sku-2025-01-01T01:00:00+00:00", "ä-ö-x", "", "a" * 300]
    names += ["".join(chr(rnd.randint(32, 0x2FF)) for _ in range(rnd.randint(0, 40))) for _ in range(100)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(uuid5_col(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(NS, n)) for n in names]


def test_packed_uuid_gives_any_text_back(spark):
    short = ["abcdef01-2345-6789-abcd-ef0123456789", "00000000-0000-0000-0000-000000000000"]
    other = [
        short[0].upper(), short[0] + "\n", short[0][:-1], short[0].replace("-", ""), "g" + short[0][1:],
        "ab", "", "----", "0123456789abcdef", "ä" * 36, None,
    ]
    df = spark.createDataFrame([(c,) for c in short + other], "s string").repartition(1)
    packed = df.select("s", *packed_uuid(F.col("s"), "x"))
    back = unpacked_uuid(packed, "x").collect()
    assert [r.x for r in back] == [r.s for r in back] and len(back) == len(short + other)
    rows = packed.collect()
    assert {r.s: len(r.x_packed) for r in rows if r.x_packed is not None} == dict.fromkeys(short, 16)
    assert all(r.x_text is None for r in rows if r.s in short)


def test_canonical_uuid_matches_python(spark):
    cases = [
        "ABCDEF01-2345-6789-abcd-ef0123456789", "{abcdef0123456789abcdef0123456789}",
        "urn:uuid:abcdef01-2345-6789-abcd-ef0123456789", "abc", "", " abcdef0123456789abcdef0123456789",
        "{{abcdef0123456789abcdef0123456789}", "ab-cd-ef0123456789abcdef0123456789ab",
        "uurn:uid:abcdef0123456789abcdef0123456789", "xyzdef0123456789abcdef0123456789ab",
    ]

    def py(c):
        try:
            return str(uuid.UUID(c))
        except ValueError:
            return None

    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "s string").select(canonical_uuid(F.col("s"))).collect()]
    assert got == [py(c) for c in cases]


def test_time_text_and_parse(spark):
    rows = ["2025-01-01T01:02:03", "2025-01-01T01:02:03.5+02:00", "2025-01-01 01:02:03Z", "junk", "2025-01-01"]
    got = (
        spark.createDataFrame([(s,) for s in rows], "s string")
        .select(parse_ts(F.col("s")).alias("t"))
        .select("t", isoformat_utc(F.col("t")).alias("iso"), iso_z(F.col("t")).alias("z"))
        .collect()
    )
    exp = [dt.datetime.fromisoformat(s).astimezone(dt.UTC) if s != "junk" else None for s in
           ["2025-01-01T01:02:03+00:00", "2025-01-01T01:02:03.5+02:00", "2025-01-01T01:02:03+00:00", "junk", "2025-01-01T00:00:00+00:00"]]
    assert [r.iso for r in got] == [e.isoformat() if e else None for e in exp]
    assert [r.z for r in got] == [e.strftime("%Y-%m-%dT%H:%M:%SZ") if e else None for e in exp]


def test_floor_div_and_micros(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 59, 59, 999999),), (dt.datetime(2024, 1, 1, 1, 0),)], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(to_us(F.col("t")), floor_div(to_us(F.col("t")), 3_600_000_000)).collect()]
    assert got == [(1704070799999999, 473352), (1704070800000000, 473353)]
