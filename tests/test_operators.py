import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.functions import text, time
from arbora.lang import expr
from arbora.operators import keyed, levels, lookup, ordered, sets, unnest
from arbora.plans import generic
from arbora.render import charts, tables
from arbora.sources import records
from arbora.sources import tables as sources


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recursion_gives_an_ancestor_once_more_then_stops(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id int, parent int")
    want = [((0,)), (0, 0), (0, 0, 1), (0, 0, 1, 2)]
    got = sorted(tuple(r.path) for r in unnest.recurse(df, F.col("id") == 0, "id", "parent").collect())
    assert got == sorted([(0,), (0, 0), (0, 1), (0, 1, 2)])
    assert got == sorted(tuple(r.path) for r in unnest.recurse_sql(df, "id = 0", "id", "parent").collect())
    assert len(want) == len(got)
    assert [r.depth for r in unnest.recurse(df, F.col("id") == 0, "id", "parent", depth=1, include_root=False).collect()] == [1, 1]


def test_recursion_goes_as_deep_as_it_is_told(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(8)], "id int, parent int")
    got = unnest.recurse(df, F.col("id") == 0, "id", "parent", depth=5, most=3).collect()
    assert sorted(r.depth for r in got) == [0, 1, 2, 3, 4, 5]


def test_recursion_is_linear_in_its_levels(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id int, parent int")
    out = unnest.recurse(df, F.col("id") == 0, "id", "parent", depth=149)
    assert out.agg(F.max("depth"), F.count("*")).first() == (149, 150)
    with pytest.raises(ValueError, match="more than 20 levels"):
        unnest.recurse(df, F.col("id") == 0, "id", "parent", most=20)


def test_recursion_does_not_test_a_root_that_it_leaves_out(spark):
    df = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2)], "id int, parent int")
    for include, want in ((True, [(0,)]), (False, [(0, 1), (0, 1, 2), (0, 1, 2, 3)])):
        got = unnest.recurse(df, F.col("id") == 0, "id", "parent", include, stop=F.col("id") == 0)
        assert sorted(tuple(r.path) for r in got.collect()) == want


def test_recursion_by_sql_has_no_bound_of_rows(spark):
    df = spark.range(2000).select("id", F.floor(F.col("id") / 10).alias("parent"))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        assert unnest.recurse_sql(df, "id = 0", "id", "parent").count() == 2001
        assert unnest.recurse_sql(df, "id = 0", "id", "parent", include_root=False, depth=1, stop_sql="id = 3").count() == 10
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_unfold_keeps_the_parent(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    assert rows(unnest.unfold(df, F.col("xs"), "x", ["id"])) == [(1, "a"), (1, "b")]
    assert unnest.unfold(df, F.col("xs"), "x", ["id"], outer=True).count() == 4


def test_group_keeps_nulls_in_order(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, None), ("k", 2, "b")], "k string, o int, v string")
    assert keyed.group_by(df, [F.col("k")], F.col("v"), ["o"]).first()["values"] == [None, "b", "c"]


def test_index_collision_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    try:
        keyed.index_by(df, [F.col("k")], F.col("v")).collect()
    except Exception as e:
        assert "Key collision" in str(e)
    else:
        raise AssertionError


def test_overlay_takes_the_sources_nulls(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, value int")
    b = spark.createDataFrame([("y", None), ("z", 3)], "k string, value int")
    assert sorted(keyed.overlay(a, b, ["k"]).collect(), key=lambda r: r.k) == [("x", 1), ("y", None), ("z", 3)]


def test_compress_folds_single_children(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 1), (["a", "b", "d"], 2), (["e", "f"], 3)], "path array<string>, v int")
    assert sorted((tuple(r.path), r.v) for r in keyed.compress(df, "path", "v").collect()) == [(("a/b", "c"), 1), (("a/b", "d"), 2), (("e/f",), 3)]


def test_compress_moves_each_step_once_by_the_size_of_the_input(spark):
    paths = [["a", "b", "c"], ["a", "b", None], ["a", "b", None], ["x"], [], ["x", "y"], ["x", None], ["e", "f", "g", "h"], ["e", "f", "k", "h"], [None, "p"], [None, "q", "r"]]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path array<string>, v int")
    out = keyed.compress(df, "path", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 4 and plan.count("Join") == 1
    want = {0: ["a/b/c"], 1: [None], 2: [None], 3: ["x"], 5: ["x/y"], 6: [None], 7: ["e/f", "g/h"], 8: ["e/f", "k/h"], 9: [None, "p"], 10: [None, "q/r"]}
    assert {r.v: r.path for r in out.collect()} == want


def test_levels(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "x", 2)], "k1 string, k2 string, value int")
    out, keys = levels.transform(df, ["k1", "k2"], [levels.Level(2, F.col("value") > 1), levels.Level(1, F.sum("value") > 2), levels.Level(1, value=F.sum("value"))])
    assert rows(out) == [("a", 5)] and keys == ["k1"]
    assert rows(levels.not_standalone(df.drop("value"), "k1", "k2")) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_carry_forward_tells_a_carried_null(spark):
    df = spark.createDataFrame([(1, "s", 7), (2, "u", 0), (3, "s", None), (4, "u", 0)], "t int, kind string, v int")
    out = df.select("t", ordered.carry_forward(F.col("v"), F.col("kind") == "s", [], [F.col("t")]).alias("c"))
    assert [r.c for r in out.orderBy("t").collect()] == [7, 7, None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=8), st.booleans())
def test_sort_array_has_nulls_first_both_ways(spark, xs, desc):
    df = spark.createDataFrame([(xs,)], "xs array<int>")
    got = df.select(ordered.sort_array(F.col("xs"), desc=desc).alias("s")).first().s
    assert got == [None] * xs.count(None) + sorted((x for x in xs if x is not None), reverse=desc)


def test_interval_join_with_buckets_is_the_plain_one(spark):
    p = spark.range(60).select((F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("t"))
    s = spark.createDataFrame([(0, 3.0, 20.0), (1, 50.0, 51.0), (2, 10.0, 80.0)], "k long, low double, high double")
    plain = lookup.interval_join(p, s, {"k": "k"}, "t", "low", "high", "s_")
    dealt = lookup.interval_join(p, s, {"k": "k"}, "t", "low", "high", "s_", bucket=7.0)
    assert rows(plain.select("k", "t", "s_low")) == rows(dealt.select("k", "t", "s_low")) and plain.count() > 10


def test_sets(spark):
    df = spark.range(5)
    a, b = sets.evict(df, F.col("id") > 2)
    assert (a.count(), b.count()) == (2, 3)


def test_text_functions(spark):
    df = spark.createDataFrame([("hello wide world", 3_723_000)], "s string, ms long")
    r = df.select(text.limit(F.col("s"), 8).alias("l"), text.hard_wrap(F.col("s"), 6).alias("h"), text.duration(F.col("ms")).alias("d"), text.leading_digit_range(F.lit(345)).alias("r"), text.html_escape(F.lit('<a b="c">')).alias("e")).first()
    assert tuple(r) == ("hello...", "hello \nwide w\norld", "01:02:03", "300-399", "&lt;a b=&quot;c&quot;&gt;")


def test_weeks(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 5, 29, 5),)], "t timestamp")
    r = df.select(time.truncate(F.col("t"), "W").alias("a"), time.truncate(F.col("t"), "W", compat=True).alias("b"), time.truncate(F.col("t"), "w").alias("c")).first()
    assert [x.day for x in r] == [23, 30, 29]


LOG = "2024-01-01T10:00:00 INFO main a.B:12 - one\n  more\n\n2024-01-01T10:00:01 WARN x y c.D: - two\n"


def test_log_records(spark, tmp_path):
    (tmp_path / "tomcat-2024-01-01.log").write_text(LOG)
    out = records.parse_files(spark, str(tmp_path / "tomcat-2024-01-01.log")).collect()
    assert [(r.level, r.thread, r["class"], r.line, r.message) for r in out] == [("INFO", "main", "a.B", "12", "one\n  more\n"), ("WARN", "x y", "c.D", None, "two")]
    assert records.format_of("/var/log/apache-error-2024.log.gz") == "apache-error.log"
    assert [r.level for r in records.parse_files(spark, str(tmp_path / "*.log"), "tomcat.log", start="WARN").collect()] == ["WARN"]
    assert [r.level for r in records.parse_files(spark, str(tmp_path / "*.log"), "tomcat.log", keep="INFO").collect()] == ["INFO"]


def test_logs_are_read_in_splits(spark, tmp_path):
    """Records that go over a split's end, and groups named like the columns of the lines."""
    text = "".join(f"{i:03d} /p/{i} one\n" + "  and more\n" * (i % 4) for i in range(300))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("000 /x y\n")
    pattern = r"(?<pos>\d{3}) (?:(?<path>/\w+)(/\d+)?) (?<line>.*)"
    want = [(f"{i:03d}", "/p", "one" + "\n  and more" * (i % 4)) for i in range(300)] + [("000", "/x", "y")]
    for size in ("128m", "256b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = records.lines(spark, str(tmp_path / "*.log"))
            assert size == "128m" or lines.rdd.getNumPartitions() > 3
            got = records.records(lines, pattern).collect()
            assert [tuple(r) for r in got] == want
            assert [r.pos for r in records.records(lines, pattern, start="^290", stop="^295", strict=0).collect()] == [f"{i}" for i in range(290, 296)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sources(spark, tmp_path):
    spark.range(10).select("id", F.concat(F.lit("n"), "id").alias("name")).write.parquet(str(tmp_path / "t"))
    df = sources.scan(spark, str(tmp_path / "t"), 'id >= 3 && name.in({"n3", "n4", "n1"})', "id desc")
    assert [r.id for r in df.collect()] == [4, 3]
    (tmp_path / "t" / "sub").mkdir()
    assert sources.directory(spark, str(tmp_path / "t")).first().type == "directory"
    sources.register("numbers")(lambda spark, n: spark.range(n))
    assert sources.call(spark, "numbers", n=4).count() == 4
    ext = spark.createDataFrame([("a", {"x": "1"})], "name string, ext map<string,string>")
    assert tuple(sources.attributes(ext, "name, x", "ext").first()) == ("a", "1")


def test_rendering(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r string, c string, v int").orderBy("r", "c")
    cells = tables.tree(df, ["r", "c"], "v")
    assert cells == {"a": {"x": 1, "y": 2}, "b": {"x": 3}}
    m = tables.matrix(cells, totals=True)
    assert "<th>Total</th><td>4</td><td>2</td><td>6</td>" in m
    assert tables.pprint(cells) == "a:\n  x: 1\n  y: 2\nb:\n  x: 3"
    assert list(tables.csv_lines(df.limit(1))) == ['"r","c","v"', '"a","x",1']
    assert tables.html_table(df.select(F.lit("<").alias("k")).limit(1)) == "<table><tr><th>k</th></tr><tr><td>&lt;</td></tr></table>"
    assert charts.link("u", "<l>") == '<a href="u">&lt;l&gt;</a>'
    assert charts.barchart({"a": 1, "b": 2}).number == 3


def test_declared_query(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["x"]), ("c", 3, [])], "name string, n int, tags array<string>")
    q = generic.Query(source=df, subquery="tag=tags", computations="label=:format(${name}-${tag})", output="label", grouping="tag=tag")
    got, keys = generic.plan(spark, q)
    assert keys == ["tag"] and [(r.tag, r.value) for r in got.collect()] == [("x", ["a-x", "b-x"]), ("y", ["a-y"])]
    html = generic.run(spark, generic.Query(source=df, filter="n < 3", grouping="k=name\nm=n", layout="Matrix total"))
    assert html.startswith("<table>") and "Total" in html
    flat = generic.plan(spark, generic.Query(source=df, selector='Row("r", gt(n, 1)).accept()', output="name\ntwice=n*2"))[0]
    assert rows(flat) == [("b", 4), ("c", 6)]


def test_cells_keep_the_source_order_through_lookups(spark):
    df = spark.createDataFrame([(i, i % 3, [f"{i}a", f"{i}b"]) for i in range(60)], "id int, k int, tags array<string>").repartition(4)
    names = spark.createDataFrame([(i, f"n{i}") for i in range(60)], "key int, name string")
    catalog = {"Name": expr.Entity(names, "key", "name")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        q = generic.Query(source=df, ordering="id desc", computations='n=:Name({name}key==$"id")', output="n", grouping="k=k", catalog=catalog)
        want = {k: [f"n{i}" for i in range(59, -1, -1) if i % 3 == k] for k in range(3)}
        assert {r.k: r.value for r in generic.plan(spark, q)[0].collect()} == want
        q = generic.Query(source=df, ordering="id desc", subquery="tag=tags", computations='n=:Name({name}key==$"id")', output="tag", grouping="k=k", catalog=catalog)
        want = {k: [f"{i}{c}" for i in range(59, -1, -1) if i % 3 == k for c in "ab"] for k in range(3)}
        assert {r.k: r.value for r in generic.plan(spark, q)[0].collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_saved_and_titled_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    q = generic.Query(source=df, title="A & B", grouping="k=name\nm=n", layout="Matrix")
    assert generic.run(spark, q).startswith("<h1>A &amp; B</h1><table>")
    generic.save(spark, q, f"{tmp_path}/page")
    assert "".join(r.value for r in spark.read.text(f"{tmp_path}/page", wholetext=True).collect()).strip() == generic.run(spark, q)
    generic.save(spark, generic.Query(source=df, output="name\nn"), f"{tmp_path}/rows")
    assert rows(spark.read.csv(f"{tmp_path}/rows", header=True)) == [("a", "1"), ("b", "2")]


def test_trimmed_paths_of_samples(spark):
    def plain(path, suspend, resume):
        if path is None:
            return None
        out, k = [], 0
        while k < len(path):
            out.append(path[k])
            k += 1
            if suspend and path[k - 1] and suspend in path[k - 1]:
                ahead = next((j for j in range(k, len(path)) if resume and path[j] and resume in path[j]), None)
                if ahead is None:
                    break
                out += [f"... {ahead - k} skipped ..."] if ahead > k else []
                k = ahead
        return out

    paths = [None, [], ["s"], ["a", "s", "b", "c", "r", "d"], ["s", "r", "a"], ["sr", "x", "sr", "y", "y", "r", "s", "z"], ["r", "a", None, "s", None, "r"], ["a", "s", "b"]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<string>")
    for suspend, resume in (("s", "r"), ("s", None), (None, "r"), (None, None)):
        got = df.select("i", keyed.trimmed(F.col("p"), suspend, resume).alias("p")).collect()
        assert {r.i: r.p for r in got} == {i: plain(p, suspend, resume) for i, p in enumerate(paths)}
    counted = keyed.path_counts(df.select(keyed.trimmed(F.col("p"), "s", "r").alias("p")).where("get(p, 0) = 'a'"), "p")
    assert sorted((tuple(r.p), r.n) for r in counted.collect())[:2] == [(("a",), 2), (("a", "s"), 2)]
