import datetime as dt

import pytest
from pyspark.sql import functions as F

from arbora.lang import expr
from arbora.lang.macros import expand, library


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("kit407", "Ada", "Quill", ["a", None, "b"], {"orgUnit": "LAB"}, [(1, "p", ["u", "v"]), (2, "q", ["w"]), (None, "p", [])], 5, dt.datetime(2019, 8, 31, 10, 30, 1))],
        "name string, firstname string, lastname string, roles array<string>, attributes map<string,string>, things array<struct<n:int,s:string,kids:array<string>>>, five int, created timestamp",
    )


def value(df, text, **more):
    return expr.select_text(df, f"v={text}", name="Identity", **more).first().v


CASES = {
    "1+2*3": 7, "(1+2)*3": 9, "10-2-3": 5, "7/2": 3, "(0-7)/2": -3, "7/2.0": 3.5, '"5"+5': 10.0, '3*"ab"': "ababab", '"5"==5': True, "five>=5": True, "null==null": True, "five/0": None,
    "name": "kit407", "orgUnit": "LAB", "missing?|name": "kit407", "roles:size": 3, "roles:join(-)": "a--b", "roles:count": {"a": 1, "b": 1},
    "things:map(s)": ["p", "q", "p"], "things:sum(n)": 3, "things:avg(n)": 1.5, "things:min(n)": 1, "things:flatten(@#kids)": ["u", "v", "w"],
    ":flatten(things#kids)": ["u", "v", "w"], "things:select(eq(s,\"p\")):size": 2, "things:select(1,eq(n,2)).s": "q", "things:select(eq(n,9))": None,
    "things:sort(n):map(n)": [None, 1, 2], "things:sort(n desc):map(n)": [None, 2, 1], "things:group(s,n)": {"p": [1, None], "q": [2]}, "things:index(>n#s,kids)": {1: {"p": ["u", "v"]}, 2: {"q": ["w"]}},
    "things:group(s,n):get(\"q\")": [2], "things:map(:format(${^.name}/${s}))": ["kit407/p", "kit407/q", "kit407/p"], ":union(roles,name)": ["a", "b", "kit407"],
    r"name:match((\d+))": "407", "name:match(x)": None, r"name:match((?<head>[a-z]+)(?<tail>\d+))": {"head": "kit", "tail": "407"}, "name:extract([a-z])": ["k", "i", "t"], "name:extract(x)": [], r"name:replace(\d,#)": "kit###",
    ":format(${firstname} ${missing?,\"none\"} ${%03d,five})": "Ada none 005", ":format($\"name\" ${created})": '"kit407" 2019-08-31 10:30:01', "name:switch(^kit=1,2)": 1, "name:switch(^x=1,2)": 2,
    ":construct(a=name,b\\,c=roles,*=attributes)": {"a": "kit407", "b": "a", "c": None, "orgUnit": "LAB"}, "1m15s": 75000, "created:date(-1M)": dt.datetime(2019, 7, 1), "created:date(+1d)": dt.datetime(2019, 9, 1),
    "created+59": dt.datetime(2019, 8, 31, 10, 31), "created-created": 0, ":date(2019-08-31T10)": dt.datetime(2019, 8, 31, 10), "50:heat": "#800080", "(0-1):heat": "#808080", "101:heat": "#c0c0c0", "name:upcase": "KIT407",
    "missing?:size": None, "^?": None, ":cache(k,1)+:cache(k,2)": 2, ":recache(k,1)+:recache(k,2)+:cache(k)": 5, ":cache(k,1)+:swapcache(k,3)*10+:cache(k)": 14, ":cache(none?)": None,
    r"name:match((x)?kit)": None, r"name:match((x*)kit)": "", r"name:match((k|x)(?<n>i)t)": {"n": "i"}, r"name:match((?<a>[\(\]x]?)(?<b>k))": {"a": "", "b": "k"}, r"name:match((k)(x)?(i))": ["k", None, "i"],
    ":link(/a?n=${name}&x=${lastname},${firstname},,)": '<a href="/a?n=kit407&x=Quill" target="_blank">Ada</a>', ":link(#,,,top: 1px)": '<span style="top: 1px">\u2b24</span>',
    "things:map(n):table": "<table><tr><td>1</td></tr><tr><td>2</td></tr><tr><td></td></tr></table>", "things:map(s):htable": "<table><tr><td>p</td><td>q</td><td>p</td></tr></table>",
    "things:count(s#n):grid": "<table><tr><th></th><th>1</th><th>2</th></tr><tr><th>p</th><td>1</td><td></td></tr><tr><th>q</th><td></td><td>1</td></tr></table>",
    ":linechart(2,a=five,b=600)": '<span style="position:absolute;left:0;width:8px;background:#0cc175" title="a: 5">&nbsp;</span><span style="position:absolute;left:0;width:1000px;background:#92eb5f" title="b: 600">&nbsp;</span>',
    ":flatten(things+,1#s)": ["p", "q", "p"], ":flatten(things*,0#name)": ["kit407"],
}


@pytest.mark.parametrize("text", CASES)
def test_expression(people, text):
    assert value(people, text) == CASES[text]


def test_parameters_and_macros(people):
    assert value(people, ":env(who)", parameters={"who": "me"}) == "me"
    assert value(people, "$full$", macros={"full": ':format($"name")'}) == '"kit407"'
    assert expand("$a$", {"a": "x $b$", "b": "y"}) == "x y"
    with pytest.raises(ValueError):
        expand("$a$", {"a": "$a$"})
    libs = {"global": {"x": "1", "y": "1"}, "inner": {"includes": "global", "y": "2"}}
    assert library(libs, "inner") == {"x": "1", "y": "2"}


def test_errors(people):
    for bad in ("five.x", "five:nothing", "name:select(", "^.x"):
        with pytest.raises((ValueError, KeyError)):
            value(people, bad)


def test_lookups(spark):
    roles = spark.createDataFrame([(1, "r1", "x", 10), (2, "r2", "x", 20), (3, "r3", "y", 30)], "id int, name string, grp string, n int")
    refs = spark.createDataFrame([("1",), ("r2",), ("none",)], "k string")
    catalog = {"Role": expr.Entity(roles, "id", "name")}
    got = expr.select_text(refs, "k", "n=k:Role.n", catalog=catalog).orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [("1", 10), ("none", None), ("r2", 20)]
    g = spark.createDataFrame([("x",), ("y",), ("z",)], "g string")
    got = expr.select_text(g, "g", 'c=:Role(?grp==$"g")', 'one=:Role({n}grp==$"g")', 'all=:Role([{n}grp==$"g"])', 'last=:Role([{n}grp==$"g",n desc,1])', catalog=catalog).orderBy("g").collect()
    assert [(r.g, r.c, r.one) for r in got] == [("x", 2, None), ("y", 1, 30), ("z", 0, None)]
    assert [[x.n for x in r["all"]] for r in got] == [[10, 20], [30], []]


def test_lookups_by_filters(spark):
    roles = spark.createDataFrame([(1, "r1", "x", 10), (2, "r2", "x", 20), (3, "r3", "y", 30)], "id int, name string, grp string, n int")
    g = spark.createDataFrame([("x", 15, ["y", "x", "none"]), ("y", 5, []), (None, 50, ["x", None])], "g string, m int, gs array<string>")
    catalog = {"Role": expr.Entity(roles, "id", "name")}
    lines = ("g", 'over=:Role(?grp==$"g" && n>$"m")', 'low=:Role([{n}n<=$"m" && name != "r2",n desc])', 'all=:Role([{n}n>15,n desc])', 'some=gs:map(:Role(?grp==$"@"))', 'sums=gs:map(:Role([{n}grp==$"@" && n>=$"^.m"]):sum(n))')
    got = {r.g: r for r in expr.select_text(g, *lines, catalog=catalog).collect()}
    assert [(got[k].over, [x.n for x in got[k].low], [x.n for x in got[k]["all"]]) for k in ("x", "y", None)] == [(1, [10], [30, 20]), (1, [], [30, 20]), (0, [30, 10], [30, 20])]
    assert [got[k].some for k in ("x", "y", None)] == [[1, 2, 0], [], [2, 0]]
    assert [got[k].sums for k in ("x", "y", None)] == [[30, 20, None], [], [None, None]]


def test_recursion_over_nested_data(spark):
    kind = "name string, kids array<struct<name:string,kids:array<struct<name:string>>>>"
    df = spark.createDataFrame([("a", [("b", [("c",), ("d",)]), ("e", [])]), ("f", None)], kind)
    got = lambda text: [r.v for r in expr.select_text(df, f"v={text}").collect()]
    assert got(":flatten(kids*#name)") == [["a", "b", "c", "d", "e"], ["f"]]
    assert got(":flatten(kids+#name)") == [["b", "c", "d", "e"], []]
    assert got(":flatten(kids*,1#name)") == [["a", "b", "e"], ["f"]]
    assert got(':flatten(kids+,eq(name,"b")#name)') == [["b", "e"], []]
    assert got(":flatten(kids*):map(name):join(-)") == ["a-b-c-d-e", "f"]
    assert got(":flatten(kids+#:format(${^.name}))") == [["a", "b", "b", "a"], []]


def test_what_needs_an_order_says_so(people):
    with pytest.raises(ValueError, match="order of rows"):
        value(people, ":swapcache(k,1)")


def test_division_of_columns_by_zero_is_null(spark):
    df = spark.range(2).select(F.col("id").alias("a"))
    assert [r.v for r in expr.select_text(df, "v=6/a").collect()] == [None, 6]
