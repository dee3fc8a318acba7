"""Ordered operators against plain Python, for one block, one level of blocks and two levels."""

import random
from datetime import datetime, timedelta

import pytest

from tablewright.operators import sequence as S

BLOCKS = [1, 3, 64, 5000]


@pytest.fixture(scope="module")
def gappy(spark):
    """Keys (one hot, one NULL), order values with NULL and ties, a column with many NULLs and one with a single value."""
    draw = random.Random(7)
    data = []
    for i in range(1500):
        key = draw.choice(["hot", "hot", "hot", "b", None])
        order = None if i % 97 == 0 else draw.randrange(900) if i % 3 else draw.randrange(40)
        data.append((key, order, i if draw.random() < 0.2 else None, "only" if i == 700 else None))
    df = spark.createDataFrame(data, "k string, o int, v int, s string").repartition(5)
    return df.cache()


def filled_plainly(spark, df, keyed):
    """Last value before, else first value of the key; equal order values follow the hash the operator documents."""
    tie = "xxhash64(v, v IS NULL, s, s IS NULL)" if keyed else "xxhash64(k, k IS NULL, v, v IS NULL, s, s IS NULL)"
    records = df.selectExpr("*", f"{tie} AS t").collect()
    columns = ["v", "s"] if keyed else ["k", "v", "s"]
    out = []
    for key in {r["k"] for r in records} if keyed else [None]:
        own = [r for r in records if not keyed or r["k"] == key]
        ordered = sorted((r for r in own if r["o"] is not None), key=lambda r: (r["o"], r["t"]))
        first = {c: next((r[c] for r in ordered if r[c] is not None), None) for c in columns}
        last = dict.fromkeys(columns)
        for r in ordered:
            last = {c: last[c] if r[c] is None else r[c] for c in columns}
            cells = {c: first[c] if last[c] is None else last[c] for c in columns}
            out.append((cells.get("k", r["k"]), r["o"], cells["v"], cells["s"]))
        for r in own:
            if r["o"] is None:
                cells = {c: first[c] if r[c] is None else r[c] for c in columns}
                out.append((cells.get("k", r["k"]), None, cells["v"], cells["s"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", BLOCKS)
@pytest.mark.parametrize("keyed", [False, True])
def test_fill_is_the_same_for_any_blocks(spark, gappy, blocks, keyed):
    got = S.fill_in_order(gappy, "o", ["k"] if keyed else [], blocks)
    assert got.columns == gappy.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == filled_plainly(spark, gappy, keyed)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_gaps_are_the_same_for_any_blocks(spark, blocks):
    draw = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [(i % 3, None if i % 50 == 0 else start + timedelta(hours=draw.randrange(5000))) for i in range(900)]
    df = spark.createDataFrame(data, "k int, ts timestamp")
    got = [(r["k"], r["previous_ts"], r["ts"]) for r in S.time_gaps(df, "ts", 0.5, ["k"], blocks).collect()]
    want = []
    for k in range(3):
        times = sorted(t for key, t in data if key == k and t is not None)
        want += [(k, a, b) for a, b in zip(times, times[1:]) if b - a > timedelta(hours=12)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_codes_are_the_same_for_any_blocks(spark, blocks):
    # Texts that agree in more characters than place them, and texts in several scripts.
    texts = sorted({"p" * 70 + str(i) for i in range(300)} | {chr(60 + 37 * i) + str(i % 7) for i in range(900)}, key=lambda t: t.encode())
    values = spark.createDataFrame([(t,) for t in reversed(texts)], "v string")
    got = {r["value"]: r["code"] for r in S.ordinal_codes(values, "v", blocks).collect()}
    assert got == {t: i for i, t in enumerate(texts)}


def test_two_levels_make_even_blocks(spark):
    df = spark.range(20000).selectExpr("id * id AS o")
    sizes = [r["count"] for r in S.in_blocks(df, "o", 400).groupBy("_range", "_block").count().collect()]
    assert len(sizes) > 300 and max(sizes) < 6 * 20000 / 400


def test_blocks_ascend_and_keep_equal_values_together(spark, gappy):
    seen = {}
    for r in S.in_blocks(gappy, "o", 1000).select("o", "_range", "_block").collect():
        seen.setdefault(r["o"], set()).add((r["_range"], r["_block"]))
    assert all(len(places) == 1 for places in seen.values()) and seen[None] == {(0, 0)}
    places = [next(iter(seen[o])) for o in sorted(o for o in seen if o is not None)]
    assert places == sorted(places) and len(set(places)) > 64


@pytest.mark.parametrize("blocks", [1, 100])
def test_ordered_operators_on_nothing(spark, blocks):
    empty = spark.createDataFrame([], "o timestamp, v string")
    assert S.fill_in_order(empty, "o", (), blocks).count() == 0
    assert S.time_gaps(empty, "o", 1.0, (), blocks).count() == 0
    assert S.ordinal_codes(empty, "v", blocks).count() == 0


def test_blocks_follow_measured_size_where_the_estimate_is_large(spark):
    small = spark.range(1000).selectExpr("id", "string(id) AS s").hint("merge")
    product = small.join(small.selectExpr("id", "s AS t"), "id").join(small.selectExpr("id", "s AS u"), "id")
    assert S.plan_bytes(product) > S.BYTES_PER_BLOCK and S.block_count(product) == 1
    large = spark.range(3000).selectExpr("id", "repeat('x', 100000) AS s").join(product.select("id"), "id", "left")
    assert 4 <= S.block_count(large) <= 6
