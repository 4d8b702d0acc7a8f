from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from retail import rows

from shelfmark.functions.measures import averaged, counted_units, greatest, least, summed
from shelfmark.operators import (
    Lookup,
    add_dense_key,
    aggregate,
    attach_key,
    drop_staged,
    fits_broadcast,
    global_rank,
    previous_year,
    share_of_total,
    stage,
    staging_root,
    surrogate_key,
    unique_rows,
)
from shelfmark.operators import grouping, staging
from shelfmark.operators.lookup import Dimension, unpacked_bytes

DIM = Dimension("dim", "dim_key", ("id",), ("id", "label"))


def test_surrogate_key_ignores_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    keys = [
        {(r.a, r.b): r.k for r in df.repartition(n).withColumn("k", surrogate_key(["a", "b"])).collect()}
        for n in (1, 7, 64)
    ]
    assert keys[0] == keys[1] == keys[2]
    assert len(set(keys[0].values())) == 500


def test_surrogate_key_tells_null_positions_apart(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', NULL), (NULL, 'a'), (NULL, NULL), ('', '') t(x, y)")
    assert df.select(surrogate_key(["x", "y"])).distinct().count() == 4


@pytest.mark.parametrize("slices", [1, 5])
def test_dense_key_numbers_in_order(spark, slices):
    values = random.Random(1).sample(range(10_000), 300)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(9)
    got = rows(add_dense_key(df, "k", ["v"], slices=slices), "v", "k")
    assert dict(got) == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_unique_rows_keeps_the_smallest(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'b'), (1, 'a'), (2, NULL), (2, 'z') t(id, label)")
    assert rows(unique_rows(df, ["id"])) == [(1, "a"), (2, None)]


def _ranked(values):
    present = sorted((v for v in values if v is not None), reverse=True)
    return {v: present.index(v) + 1 if v is not None else len(present) + 1 for v in set(values)}


def test_global_rank(spark):
    rng = random.Random(2)
    # a third of all rows on one value, further ties, and NULLs
    values = [5.0] * 100 + [None] * 3 + [float(rng.randrange(40)) for _ in range(200)]
    rng.shuffle(values)
    df = spark.createDataFrame([(i, v, -(v or 0.0)) for i, v in enumerate(values)], "i int, v double, w double")
    got = global_rank(df, {"v": "rank_v", "w": "rank_w"}, slices=6)
    expected = _ranked(values)
    negated = _ranked([-(v or 0.0) for v in values])
    found = got.select("i", "v", "rank_v", "w", "rank_w").collect()
    assert len(found) == len(values)
    assert all(r.rank_v == expected[r.v] and r.rank_w == negated[r.w] for r in found)
    assert dict(got.dtypes)["rank_v"] == "int"


def test_sliced_rank_has_no_whole_table_task(spark):
    df = stage(spark.range(5000).select(F.col("id").cast("double").alias("v")), "t")
    plan = global_rank(df, {"v": "r"}, slices=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step is the one over the slice starts
    assert text.count("SinglePartition") == 1
    assert "hashpartitioning(_slice" in text


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 3.0, 0), ("c", None, 3)], "m string, x double, n int")
    got = rows(share_of_total(df, {"x": "xs", "n": "ns"}), "m", "xs", "ns")
    assert got == [("a", 25.0, 25.0), ("b", 75.0, 0.0), ("c", None, 75.0)]
    none = spark.createDataFrame([("a", 0.0)], "m string, x double")
    assert rows(share_of_total(none, {"x": "s"}), "s") == [(None,)]


def test_previous_year_default_and_strict(spark):
    data = [(2020, 1, 10.0), (2021, 1, 0.0), (2023, 1, 5.0), (2024, 1, -5.0), (2025, 1, 5.0), (2021, 2, 1.0)]
    df = spark.createDataFrame(data, "year int, q int, x double")
    spec = {"x": ("prev", "growth")}
    loose = {(r.year, r.q): (r.prev, r.growth) for r in previous_year(df, ["q"], spec).collect()}
    assert loose[2020, 1] == (None, None)
    assert loose[2021, 1] == (10.0, -100.0)
    assert loose[2023, 1] == (0.0, None)  # last year present; its zero gives no growth
    assert loose[2024, 1] == (5.0, -200.0)
    assert loose[2025, 1] == (-5.0, -200.0)  # a negative base flips the sign
    assert loose[2021, 2] == (None, None)
    strict = {(r.year, r.q): r.prev for r in previous_year(df, ["q"], spec, strict=True).collect()}
    assert strict[2023, 1] is None and strict[2024, 1] == 5.0


def _fact_and_dim(spark):
    """Ids with one, two and no dimension row, and NULL ids, one id very frequent."""
    fact = spark.createDataFrame(
        [("hot", "h", i) for i in range(60)]
        + [("two", "x", 100), ("two", "y", 101), (None, "n", 102), ("one", "o", 103)],
        "id string, label string, line int",
    )
    dim = fact.select("id", "label").distinct().withColumn("dim_key", surrogate_key(["id", "label"]))
    return fact, dim


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("lookup", ["as_is", "unique"])
def test_inline_lookup_equals_the_join(spark, lookup, null_safe):
    fact, dim = _fact_and_dim(spark)
    results = [
        rows(
            attach_key(fact, dim, DIM, lookup=lookup, method=method, null_safe=null_safe,
                       max_broadcast_bytes=limit),
            "id", "line", "dim_key",
        )
        for method, limit in (("join", 10), ("inline", 10_000), ("inline", 1))
    ]
    assert results[0] == results[1] == results[2]
    two = [r for r in results[0] if r[0] == "two"]
    assert len(two) == (4 if lookup == "as_is" else 2)
    assert [r[2] is None for r in results[0] if r[0] is None] == [not null_safe]


def test_inline_lookup_does_not_shuffle_without_versions(spark):
    fact, _ = _fact_and_dim(spark)
    fact = fact.where("id <> 'two'")
    dim = fact.select("id", "label").distinct().withColumn("dim_key", surrogate_key(["id", "label"]))
    plan = attach_key(fact, dim, DIM)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lookup_rejects_unknown_modes(spark):
    fact, dim = _fact_and_dim(spark)
    with pytest.raises(ValueError, match="lookup"):
        attach_key(fact, dim, DIM, lookup="latest")


def _sales(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        place = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "gone"])
        data.append((place, rng.randrange(3) or None, f"o{rng.randrange(80)}", f"c{rng.randrange(30)}",
                     rng.randrange(1000) / 4 if rng.random() > 0.05 else None, rng.randrange(9)))
    return data, spark.createDataFrame(
        data, "place string, year int, order_id string, customer string, x double, n int"
    )


def _measures():
    return {
        "total": summed("x"),
        "units": counted_units("n"),
        "mean": averaged("x"),
        "low": least("x"),
        "high": greatest("x"),
    }


def _expected(data, group):
    out = {}
    for row in data:
        for key in group(row):
            out.setdefault(key, []).append(row)
    result = {}
    for key, found in out.items():
        xs = [r[4] for r in found if r[4] is not None]
        result[key] = (sum(xs), sum(r[5] for r in found), sum(xs) / len(xs), min(xs), max(xs),
                       len({r[2] for r in found}), len({r[3] for r in found}))
    return result


def _as_dict(df, keys):
    figures = ["total", "units", "mean", "low", "high", "orders", "customers"]
    return {tuple(r[k] for k in keys): tuple(r[f] for f in figures) for r in df.collect()}


COUNTS = {"orders": "order_id", "customers": "customer"}


def test_aggregate_keeps_null_groups(spark):
    data, df = _sales(spark)
    got = aggregate(df, ["place", "year"], _measures(), COUNTS)
    assert _as_dict(got, ["place", "year"]) == _expected(data, lambda r: [(r[0], r[1])])


def test_aggregate_moves_narrow_distinct_columns(spark):
    _, df = _sales(spark)
    got = aggregate(stage(df, "sales"), ["place"], _measures(), COUNTS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_aggregate_parts_are_joined_where_they_are(spark):
    _, df = _sales(spark)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = aggregate(stage(df, "sales"), ["place", "year"], _measures(), COUNTS)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # one exchange for the measures, two per distinct count, none for the joins
    assert plan.count("Exchange hashpartitioning") == 5
    assert plan.count("SortMergeJoin") == 2


def test_broadcast_size_is_measured(spark):
    df = spark.sql("SELECT * FROM VALUES ('abc', 1), (NULL, 2) t(s, n)")
    assert unpacked_bytes(df) == 2 * 48 + 3
    assert unpacked_bytes(df.where("n > 5")) == 0
    assert fits_broadcast(df, 99) and not fits_broadcast(df, 98)


def test_dropped_stage_is_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path / "app"))
    stage(spark.range(3), "numbers")
    assert len(os.listdir(tmp_path / "app")) == 1
    drop_staged(spark)
    assert not os.path.exists(tmp_path / "app")



@pytest.mark.parametrize("limit", [0, 10_000])
def test_aggregate_over_lookups_both_ways(spark, limit):
    data, df = _sales(spark)
    # place "a" lies in two regions, "dull" in an unnamed one, "gone" and NULL in none
    data = [("dull" if r[2] == "o7" else r[0], *r[1:]) for r in data]
    df = spark.createDataFrame(data, df.schema)
    regions = {"hot": ["west"], "a": ["west", "east"], "b": ["east"], "dull": [None]}
    places = spark.createDataFrame(
        [(p, r, r and r[0]) for p, found in regions.items() for r in found],
        "place string, region string, short string",
    )
    eras = spark.createDataFrame([(1, "old"), (2, "new")], "year int, era string")
    got = aggregate(
        df,
        ["era", "region", "year"],
        _measures(),
        COUNTS,
        [Lookup("place", places.drop("short")), Lookup("year", eras)],
        max_broadcast_bytes=limit,
    )
    era = {1: "old", 2: "new", None: None}
    expected = _expected(data, lambda r: [(era[r[1]], g, r[1]) for g in regions.get(r[0], [None])])
    found = _as_dict(got, ["era", "region", "year"])
    assert found.keys() == expected.keys() and got.count() == len(expected)
    for key, figures in found.items():
        assert figures == pytest.approx(expected[key])


def test_rows_move_once_to_a_large_lookup(spark):
    _, df = _sales(spark)
    places = spark.createDataFrame([("a", "west"), ("hot", "east")], "place string, region string")
    got = aggregate(df, ["region"], _measures(), {}, [Lookup("place", places)], max_broadcast_bytes=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by_place = [line for line in plan.splitlines() if "Aggregate [" in line and "place" in line.split("],")[0]]
    assert not by_place  # partial sums per place would move wide


def test_small_lookup_groups_by_number(spark):
    _, df = _sales(spark)
    places = spark.createDataFrame([("a", "west"), ("hot", "east")], "place string, region string")
    got = aggregate(stage(df, "sales"), ["region"], {"units": counted_units("n")}, {"orders": "order_id"}, [Lookup("place", places)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the distinct exchange carries numbers, not the region
    assert re.search(r"hashpartitioning\(_group0#\d+L, _check0#\d+L, order_id#", plan)


def test_stage_writes_below_the_named_folder(spark):
    root = staging_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    staged = stage(spark.range(3), "numbers")
    assert rows(staged) == [(0,), (1,), (2,)]
    assert all(root in f for f in staged.inputFiles())


@pytest.mark.parametrize("cuts", [1, 64])  # no key fills the space between all rows; all of these are frequent
def test_aggregate_by_key_moves_rows_once(spark, monkeypatch, cuts):
    monkeypatch.setattr(grouping, "CUTS", cuts)
    data, df = _sales(spark)
    got = grouping.aggregate_by_key(stage(df, "sales"), "place", _measures(), "orders", "order_id")
    expected = {k: v[:-1] for k, v in _expected(data, lambda r: [(r[0],)]).items()}
    found = {(r["place"],): tuple(r[f] for f in ("total", "units", "mean", "low", "high", "orders")) for r in got.collect()}
    assert found.keys() == expected.keys()
    for key, figures in found.items():
        assert figures == pytest.approx(expected[key])
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # the rows, and with frequent keys the parts
    assert plan.count("Exchange hashpartitioning") == (1 if cuts == 1 else 2)


def test_aggregate_by_key_of_nothing(spark):
    _, df = _sales(spark)
    assert grouping.aggregate_by_key(df.where("false"), "place", _measures(), "orders", "order_id").isEmpty()
