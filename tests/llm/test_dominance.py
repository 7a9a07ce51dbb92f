"""Dominance counts against plain loops."""

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import dominance


def plainly(rows):
    out = []
    for key, slot, level, _ in rows:
        above = [w for _, s, v, w in rows if None not in (slot, level, s, v) and s <= slot and v > level]
        out.append((key, slot, level, len(above) if None not in (slot, level) else None, sum(above) if None not in (slot, level) else None))
    return sorted(out, key=str)


def counted(df, **more):
    got = dominance.dominating(df, weight="w", keep=("key",), **more)
    zero = lambda r, c: (r[c] or 0) if None not in (r.slot, r.level) else r[c]
    return sorted(((r.key, r.slot, r.level, zero(r, "n_above"), zero(r, "w_above")) for r in got.collect()), key=str)


def test_against_loops(spark):
    rng = random.Random(3)
    for slots, levels, cells in ((12, 9, 16), (200, 40, 64), (1, 30, 8), (40, 1, 8)):
        rows = [(k, rng.choice([None, *range(-slots, slots)]), rng.choice([None, *range(levels), 0, 0, 0]), rng.choice([0, 1, 2])) for k in range(500)]
        rows += [(500 + k, 1, 0, 1) for k in range(250)]  # a third of all in one cell
        df = spark.createDataFrame(rows, "key long, slot long, level long, w long").repartition(4)
        assert counted(df, cells=cells) == plainly(rows)


def test_many_slots_stay_in_bounded_partitions(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(10**9), rng.randrange(50), 1) for k in range(600)]
    assert counted(spark.createDataFrame(rows, "key long, slot long, level long, w long"), cells=32) == plainly(rows)


def test_fenwick():
    rng = np.random.default_rng(1)
    level, slot, w = -np.sort(-rng.integers(0, 20, 300)), rng.integers(-5, 60, 300), rng.integers(0, 4, (300, 2))
    want = [w[(level > level[k]) & (slot <= slot[k])].sum(axis=0).tolist() for k in range(300)]
    assert dominance.swept(level, slot, w).tolist() == want


def test_sales(spark):
    day = datetime(2024, 1, 1)
    rng = random.Random(7)
    rows = [(k if k % 50 else None, rng.choice([None, day + timedelta(hours=rng.randrange(900))]), rng.choice([None, float("nan"), float("inf"), -3.456, rng.random() * 200, 99.995, 100.0])) for k in range(400)]
    rows += rows[:40] + [(9001, datetime(1969, 12, 31, 23, 59, 59), 10.0)]
    df = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double").withColumn("slot", F.lit("clash")).withColumn("n_above", F.lit(0))
    micros = [(i, None if at is None else (at - datetime(1970, 1, 1)) // timedelta(microseconds=1), total) for i, at, total in rows]
    local = spark.createDataFrame(micros, "sale_id long, at long, total double").withColumn("sold_at", F.timestamp_micros("at"))
    plain = []
    for i, at, total in rows:
        slot = None if at is None else (at - datetime(1970, 1, 1)).days
        level = None if total is None or not np.isfinite(total) else int(np.floor(np.floor(100 * total + 0.5) / 1000))
        plain.append((i, slot, level, 1 + zlib.crc32(("" if i is None else str(i)).encode()) % 3))
    want = plainly(plain)
    for zone in ("UTC", "Pacific/Auckland"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert sorted(map(tuple, dominance.sales_above(df).collect()), key=str) == want
            assert sorted(map(tuple, dominance.sales_above(local).collect()), key=str) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty(spark):
    assert dominance.sales_above(spark.createDataFrame([], "sale_id long, sold_at timestamp_ntz, total double")).collect() == []
    none = spark.createDataFrame([(1, None, 3.0)], "sale_id long, sold_at timestamp_ntz, total double")
    assert list(map(tuple, dominance.sales_above(none).collect())) == [(1, None, 0, None, None)]
