"""Queries over whole tables, held against their oracle SQL on the smallest tables."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from arbora.core.storage import pieces
from arbora.operators import ordered
from arbora.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def both(spark, name, data=DATA):
    """Sorted rows of a query and of its SQL."""
    db = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = QUERIES[name](spark, str(data))
    out = db.execute(ORACLE_SQL[name])
    at = [[c[0] for c in out.description].index(c) for c in df.columns]
    key = lambda r: [(x is not None, x) for x in r]
    return sorted((tuple(r) for r in df.collect()), key=key), sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=key)


def test_compress_takes_all_lines(spark):
    got, want = both(spark, "compress_paths")
    assert got == want
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert len(got) == lines and any("/" in p for p, _ in got) and any(p.count("|") == 2 for p, _ in got)


def test_standalone_takes_all_lines(spark):
    got, want = both(spark, "standalone_cells")
    assert got == want
    cells = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_extendedprice").distinct()
    orders = {r.l_orderkey for r in cells.select("l_orderkey").collect()}
    assert max(a for a, _ in got) > 300 and len(orders) > len({a for a, _ in got}) > 0.9 * len(orders)


def test_sort_numbers_all_rows(spark):
    got, want = both(spark, "sort_nulls_first")
    assert got == want
    assert sorted(n for _, n in got) == list(range(1, spark.read.parquet(f"{DATA}/part.parquet").count() + 1))


def test_numbered_goes_on_over_ranges_and_takes_no_rows(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    assert [(r.k, r.rn) for r in ordered.numbered(df, "k desc").collect()] == [(4999 - i, i + 1) for i in range(5000)]
    assert ordered.numbered(df.where("k < 0"), "k").count() == 0


def test_overlay_takes_all_customers(spark):
    got, want = both(spark, "overlay_merge")
    assert got == want
    o = spark.read.parquet(f"{DATA}/orders.parquet")
    assert {r[0] for r in got} == {r.o_custkey for r in o.select("o_custkey").collect()}
    assert any(v is None for *_, v in got) and len(got) > o.select("o_custkey", F.to_date("o_orderdate")).distinct().count()


def test_bars_of_half_values(spark, tmp_path):
    rows = [(i, "O", p, "5-LOW") for i, p in enumerate((198500.0, 297500.0, 2500.0, 500.0, 1234.56, 999500.0, 1000500.0, 5e6))]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = both(spark, "html_links", tmp_path)
    assert got == want and "width:199px" in got[0][3] and "price: 198" in got[0][3]


def test_grid_computes_its_map_once(spark):
    df = QUERIES["html_tables"](spark, DATA)
    # once to test it for null, once for all cells; each has two levels
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") <= 4 and plan.count("Aggregate") == 1
    got, want = both(spark, "html_tables")
    assert got == want


def test_lookups_in_iterations_move_no_more_than_they_use(spark):
    df = QUERIES["lookup_in_iteration"](spark, DATA)
    plan = "\n".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" not in x)
    assert "p_retailprice" not in plan and "s_name" not in plan and "xxhash64" in plan
    got, want = both(spark, "lookup_in_iteration")
    assert got == want


def test_recursion_below_roots_has_no_bound_of_rows(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got, want = both(spark, "flatten_recursive_plus")
        assert got == want and len(got) > 300
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_lines_are_dealt_by_the_size_of_the_input(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    assert pieces(e) == spark.sparkContext.defaultParallelism
    assert pieces(e, of=1000) == -(-Path(f"{DATA}/events.parquet").stat().st_size // 1000)
    df = QUERIES["log_formats"](spark, DATA)
    # one number of tasks for each of the six formats, and no order before the union
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 6 and "Sort [" not in plan
    got, want = both(spark, "log_formats")
    assert got == want
    got, want = both(spark, "log_records")
    assert got == want
