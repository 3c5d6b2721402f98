"""Every tracked event: encode typed values -> raw log -> decode -> same values."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyray.operators.decode import OUT_TYPES, SPECS, decode_logs
from tallyray.sources.fixtures import encode_logs


def _value(rnd, typ):
    if typ == "address":
        return "0x" + "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    if typ == "uint":
        return str(rnd.randint(0, 2 ** 120))
    if typ == "long":
        return rnd.randint(0, 2 ** 62)
    if typ == "bool":
        return rnd.random() < 0.5
    if typ == "uint8":
        return rnd.randint(0, 255)
    return "label-" + "é" * rnd.randint(0, 40)


@pytest.mark.parametrize("event", sorted(SPECS))
def test_round_trip(spark, event):
    rnd = random.Random(event)
    spec = SPECS[event]
    fields, row = [], []
    for name, _, typ in spec:
        st = T.StringType() if typ in ("address", "string", "uint") else \
            {"long": T.LongType(), "bool": T.BooleanType(), "uint8": T.IntegerType()}[typ]
        fields.append(T.StructField(name, st))
        row.append(_value(rnd, typ))
    df = spark.createDataFrame([tuple(row)], T.StructType(fields))
    for name, _, typ in spec:
        if typ == "uint":
            df = df.withColumn(name, F.col(name).cast(T.DecimalType(38, 0)))
    df = df.select("*", F.lit(event).alias("event"), F.lit(7).cast("long").alias("block_number"),
                   F.lit(3).cast("long").alias("log_index"), F.lit("0xab").alias("tx_hash"))
    raw = encode_logs(df, F.lit("0x" + "1" * 40), [event])
    got = decode_logs(raw, [event]).first()
    assert got is not None, event
    for (name, _, typ), v in zip(spec, row):
        g = got[name]
        if typ == "uint":
            assert int(g) == int(v), (event, name)
        else:
            assert g == v, (event, name)
    assert OUT_TYPES  # spec types are all mapped
