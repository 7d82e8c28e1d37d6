"""Registered queries, one or more for each operator, and the SQL that a DuckDB oracle runs for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.core.storage import pieces
from arbora.functions import color, text, time
from arbora.lang import expr
from arbora.lang.rules import compile_rules, compile_selector
from arbora.operators import keyed, levels, lookup, ordered, sets, unnest
from arbora.operators import predicates as P
from arbora.operators.select import Action, Rule, assign, decide, decompose, evaluate, partition, switch, two_phase
from arbora.plans import generic
from arbora.render import columns
from arbora.sources import records, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def query(sql: str | None = None):
    """Register a function as a query, with its oracle text."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dec(c, digits: int = 2):
    """A sum of doubles, rounded, so that the order of adding does not show."""
    return F.round(c, digits)


# Scans and projection.


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def scan_project_alias(spark, d):
    return expr.select_text(table(spark, d, "orders"), "id=o_orderkey", "status=o_orderstatus", "price=o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE starts_with(o_orderpriority, '1') AND NOT (o_orderstatus IN ('F', 'P') OR o_totalprice < 1000)""")
def scan_filter_text(spark, d):
    df = tables.scan(spark, f"{d}/orders.parquet", 'o_orderpriority.startsWith("1") && !(o_orderstatus.in({"F", "P"}) || o_totalprice < 1000)')
    return df.select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), p_type, 'none') AS label FROM part")
def coalesce_alternatives(spark, d):
    df = table(spark, d, "part").withColumn("brand", F.nullif("p_brand", F.lit("Brand#1")))
    return expr.select_text(df, "p_partkey", 'label=brand|p_type|"none"')


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def attributes_extended(spark, d):
    df = table(spark, d, "events").withColumn("attributes", F.from_json("props", "map<string,string>"))
    return expr.select_text(df, "event_id", "event_type", "k", "missing=attributes.missing")


@query("""SELECT r_name AS region, r_name AS top, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey""")
def parent_scopes(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    df = lookup.lookup_list(r, n, {"r_regionkey": "n_regionkey"}, F.col("n_name"), ["n_nationkey"], "nations")
    out = expr.select_text(df, 'rows=nations:map(:construct(region=^.r_name,top=^^.r_name,nation=@))')
    return out.select(F.explode("rows").alias("m")).select(*(F.col("m")[k].alias(k) for k in ("region", "top", "nation")))


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, string_split(p_name, ' ')[9] AS c FROM part""")
def construct_decompose(spark, d):
    return table(spark, d, "part").select("p_partkey", *(v.alias(k) for k, v in decompose(F.split("p_name", " "), ["a", "b"]).items()), F.try_element_at(F.split("p_name", " "), F.lit(9)).alias("c"))


@query("""SELECT o_orderkey, o_totalprice * 2 AS a, o_totalprice AS b, o_totalprice * 2 + o_totalprice AS c FROM orders""")
def computations_blocks(spark, d):
    df = table(spark, d, "orders").withColumn("a", F.col("o_totalprice"))
    df = assign(df, {"a": F.col("o_totalprice") * 2, "b": F.col("a")}, {"c": F.col("a") + F.col("b")})
    return df.select("o_orderkey", "a", "b", "c")


# Predicates, over columns that have nulls by left joins.


def _nullable(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size")
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"), "p_type", size.alias("size"))


NULLABLE = "(SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, p_type, CASE WHEN p_size % 7 <> 0 THEN p_size END AS size FROM part)"


@query(f"""SELECT p_partkey, brand IS NOT DISTINCT FROM 'Brand#1' OR brand IS NULL AS e, brand IS DISTINCT FROM 'Brand#1' AS n, size::VARCHAR IS NOT DISTINCT FROM '5' AS t FROM {NULLABLE}""")
def sel_eq_ne_null(spark, d):
    return _nullable(spark, d).select("p_partkey", P.eq("brand", "Brand#1", None).alias("e"), P.ne("brand", "Brand#1").alias("n"), P.eq("size", "5").alias("t"))


@query(f"""SELECT p_partkey, coalesce(size > 10, false) AS a, coalesce(size >= 10, false) AS b, coalesce(size < 10, false) AS c, coalesce(size <= 10, false) AS d,
  coalesce(size BETWEEN 5 AND 20, false) AS e, coalesce(size < 5 OR size > 20, false) AS f FROM {NULLABLE}""")
def sel_range(spark, d):
    return _nullable(spark, d).select("p_partkey", P.gt("size", 10).alias("a"), P.ge("size", 10).alias("b"), P.lt("size", 10).alias("c"), P.le("size", 10).alias("d"), P.between("size", 5, 20).alias("e"), P.outside("size", 5, 20).alias("f"))


@query(f"""SELECT p_partkey, coalesce(regexp_matches(brand, '#[12]'), false) OR brand IS NULL AS a, NOT coalesce(regexp_matches(brand, '3$'), false) AS b,
  coalesce(contains(p_type, brand), false) AS c FROM {NULLABLE}""")
def sel_like(spark, d):
    return _nullable(spark, d).select("p_partkey", P.like("brand", "#[12]", None).alias("a"), P.unlike("brand", "3$").alias("b"), P.like("p_type", P.ref("brand")).alias("c"))


@query(f"""SELECT p_partkey, brand IS NOT DISTINCT FROM 'Brand#2' AND coalesce(size > 10, false) AS a, brand IS NULL OR coalesce(size > 40, false) AS b,
  NOT (brand IS NOT DISTINCT FROM 'Brand#2' AND coalesce(size > 10, false)) AS c, NOT (brand IS NULL OR coalesce(size > 40, false)) AS d FROM {NULLABLE}""")
def sel_logic(spark, d):
    df = _nullable(spark, d)
    s = expr.of(df)
    texts = {"a": 'and(eq(brand,"Brand#2"),gt(size,10))', "b": "or(eq(brand,null),gt(size,40))", "c": 'nand(eq(brand,"Brand#2"),gt(size,10))', "d": "nor(eq(brand,null),gt(size,40))"}
    return df.select("p_partkey", *(compile_selector(t, s).alias(k) for k, t in texts.items()))


@query("""SELECT c.c_custkey, o.o_totalprice > c.c_acctbal * 10 AS over FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""")
def sel_ref(spark, d):
    j = table(spark, d, "customer", "c_custkey", "c_acctbal").join(table(spark, d, "orders", "o_custkey", "o_totalprice"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", P.gt("o_totalprice", P.ref(F.col("c_acctbal") * 10)).alias("over"))


def _orders_with_items(spark, d, order=("l_linenumber",)):
    o = table(spark, d, "orders", "o_orderkey")
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return lookup.lookup_list(o, l, {"o_orderkey": "l_orderkey"}, F.col("l_quantity"), list(order), "q")


@query("""SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity > 45) > 0 AS a, count(l_orderkey) FILTER (l_quantity > 45) = 0 AS b,
  count(l_orderkey) FILTER (l_quantity <= 5) = 0 AS c, count(l_orderkey) FILTER (l_quantity <= 5) > 0 AS d, count(l_orderkey) > 0 AS e, bool_or(coalesce(l_quantity = 7, false)) AS f
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def sel_any_all(spark, d):
    df = _orders_with_items(spark, d, order=())
    big, more = (lambda e: P.gt(e, 45.0)), (lambda e: P.gt(e, 5.0))
    return df.select("o_orderkey", P.any_("q", big).alias("a"), P.none("q", big).alias("b"), P.all_("q", more).alias("c"), P.notall("q", more).alias("d"), P.any_("q").alias("e"), P.in_(F.lit(7.0), F.col("q")).alias("f"))


@query("""SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity > 25) > 2 AS a, count(l_orderkey) FILTER (l_quantity > 25) >= 2 AS b,
  count(l_orderkey) FILTER (l_quantity > 25) < 2 AS c, count(l_orderkey) FILTER (l_quantity > 25) <= 2 AS d, count(l_orderkey) FILTER (l_quantity > 25) BETWEEN 1 AND 3 AS e
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def sel_counting(spark, d):
    df = _orders_with_items(spark, d, order=())
    s = expr.of(df)
    texts = {"a": "mt(q,2,gt(@,25.0))", "b": "me(q,2,gt(@,25.0))", "c": "ft(q,2,gt(@,25.0))", "d": "fe(q,2,gt(@,25.0))", "e": "num(q,1,3,gt(@,25.0))"}
    return df.select("o_orderkey", *(compile_selector(t, s).alias(k) for k, t in texts.items()))


@query("""SELECT o_orderkey, list_filter(list(l_quantity ORDER BY l_linenumber, l_quantity), lambda x: x > 40)[1] AS first, len(list_filter(list(l_quantity ORDER BY l_linenumber, l_quantity), lambda x: x > 40)[:2]) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def select_first(spark, d):
    df = _orders_with_items(spark, d).where(F.size("q") > 0)
    return expr.select_text(df, "o_orderkey", "first=q:select(1,gt(@,40.0))", "n=q:select(2,gt(@,40.0)):size").withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0)))


# Rules.

ORDER_RULES = """Order("big", gt(o_totalprice, 200000)).accept("urgent", like(o_orderpriority, "^1")).reject("done", eq(o_orderstatus, "F"))
Order("other").accept("open", eq(o_orderstatus, "O")).accept("rest", lt(o_totalprice, 50000))"""


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND starts_with(o_orderpriority, '1') THEN 'big' ELSE 'other' END AS rule,
  CASE WHEN o_totalprice > 200000 AND starts_with(o_orderpriority, '1') THEN 'urgent' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'rest' END AS action FROM orders
WHERE CASE WHEN o_totalprice > 200000 AND starts_with(o_orderpriority, '1') THEN true WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN false
  WHEN o_orderstatus = 'O' THEN true WHEN o_totalprice < 50000 THEN true ELSE false END""")
def rule_decision(spark, d):
    df = table(spark, d, "orders")
    rules, _ = compile_rules(ORDER_RULES, expr.of(df))
    out = decide(df, rules)
    return out.select("o_orderkey", F.col("_decision.ruleId").alias("rule"), F.col("_decision.actionId").alias("action"))


@query("""SELECT c_custkey, o_orderkey, CASE WHEN c_acctbal > 5000 AND o_totalprice > 100000 THEN 'rich' ELSE 'building' END AS rule
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000 OR c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'""")
def rule_two_phase(spark, d):
    c, o = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment"), table(spark, d, "orders")
    rules = [Rule([P.gt("c_acctbal", 5000)], [Action(True, [P.gt("o_totalprice", 100000)])], "rich"), Rule([P.eq("c_mktsegment", "BUILDING")], [Action(True, [P.eq("o_orderstatus", "O")])], "building")]
    out = two_phase(c, rules, lambda p: p.join(o, F.col("o_custkey") == F.col("c_custkey")))
    return out.select("c_custkey", "o_orderkey", F.col("_decision.ruleId").alias("rule"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END AS size, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.5 ELSE o_totalprice END AS due FROM orders""")
def rule_evaluate(spark, d):
    rules = [
        Rule([], [Action(True, [P.gt("o_totalprice", 200000)], "large"), Action(True, [P.gt("o_totalprice", 100000)], "medium")], "size"),
        Rule([], [Action(True, [P.eq("o_orderstatus", "O")], value=F.col("o_totalprice") * 0.5), Action(True, [], value=F.col("o_totalprice"))], "due"),
    ]
    return evaluate(table(spark, d, "orders"), rules).select("o_orderkey", "size", "due")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[12]$') THEN 'low' WHEN regexp_matches(p_brand, '3') THEN 'mid' ELSE 'high' END AS label,
  CASE WHEN p_size >= 40 THEN 'L' WHEN p_size >= 20 THEN 'M' ELSE 'S' END AS size FROM part""")
def switch_label(spark, d):
    return table(spark, d, "part").select("p_partkey", switch(F.col("p_brand"), [("[12]$", F.lit("low")), ("3", F.lit("mid"))], F.lit("high")).alias("label"), partition(F.col("p_size"), [(20, F.lit("M")), (40, F.lit("L"))], F.lit("S")).alias("size"))


# Lookups.


@query("""SELECT k, c_custkey, c_mktsegment FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE c.c_name END AS k, o_custkey FROM orders JOIN customer c ON o_custkey = c.c_custkey) JOIN customer ON o_custkey = c_custkey""")
def lookup_single(spark, d):
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("c_name")).alias("k"))
    return lookup.lookup_by_id_or_name(k, c, "k", "c_custkey", "c_name", ["c_custkey", "c_mktsegment"])


@query("""SELECT c_custkey, u.k AS only_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey HAVING count(*) = 1) u ON u.o_custkey = c_custkey""")
def lookup_unique_or_null(spark, d):
    out = lookup.unique_or_null(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"}, ["o_orderkey"])
    return out.select("c_custkey", F.col("o_orderkey").alias("only_order"))


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_count(spark, d):
    catalog = {"Order": expr.Entity(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")}
    return expr.select_text(table(spark, d, "customer", "c_custkey"), "c_custkey", 'n=:Order(?o_custkey==$"c_custkey")', catalog=catalog)


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def lookup_latest(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    out = lookup.lookup_first(table(spark, d, "customer", "c_custkey"), o, {"c_custkey": "o_custkey"}, [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_list(spark, d):
    out = lookup.lookup_list(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"}, F.col("o_orderkey"), ["o_orderkey"], "xs")
    return out.select("c_custkey", text.join(F.col("xs"), ",").alias("orders"))


@query("""SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def index_get_join(spark, d):
    out = lookup.lookup(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part", "p_partkey", "p_brand"), {"l_partkey": "p_partkey"})
    return out.select("l_orderkey", "l_linenumber", "p_brand")


@query("""SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def group_get_join(spark, d):
    out = lookup.lookup(table(spark, d, "nation", "n_nationkey", "n_name"), table(spark, d, "customer", "c_nationkey", "c_custkey"), {"n_nationkey": "c_nationkey"}, how="inner")
    return out.select("n_name", "c_custkey")


@query("""SELECT m['b'] AS b, m['z'] AS z, n FROM (SELECT MAP {'a': p_brand, 'b': p_type} AS m, p_partkey AS n FROM part)""")
def map_get(spark, d):
    m = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"))
    return table(spark, d, "part").select(lookup.get(m, "b").alias("b"), lookup.get(m, "z").alias("z"), F.col("p_partkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unordered(spark, d):
    return lookup.without_match(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey"), {"c_custkey": "o_custkey"})


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_active(spark, d):
    return lookup.with_match(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey"), {"c_custkey": "o_custkey"})


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(spark, d):
    return lookup.key_difference(table(spark, d, "customer", F.col("c_custkey").alias("k")), table(spark, d, "orders", F.col("o_custkey").alias("k")))


@query("""SELECT r_name, c_mktsegment, (SELECT count(*) FROM customer x JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND x.c_mktsegment = s.c_mktsegment) AS n
FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s""")
def free_iteration(spark, d):
    c, n = table(spark, d, "customer", "c_nationkey", "c_mktsegment"), table(spark, d, "nation", "n_nationkey", "n_regionkey")
    counts = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))
    grid = lookup.free_iteration(table(spark, d, "region", "r_regionkey", "r_name"), c.select("c_mktsegment").distinct())
    out = grid.join(counts, (F.col("r_regionkey") == F.col("n_regionkey")) & (grid.c_mktsegment == counts.c_mktsegment), "left")
    return out.select("r_name", grid.c_mktsegment, F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT a.event_id, p.event_id AS purchase FROM events a JOIN events p ON p.event_type = 'purchase' AND a.user_id = p.user_id AND a.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR""")
def interval_join(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    p = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id"), F.col("event_id").alias("purchase"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("low"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("high"))
    return lookup.interval_join(e, p, {"user_id": "user_id"}, "ts", "low", "high", "p_", bucket=7200.0).select("event_id", F.col("p_purchase").alias("purchase"))


@query("""SELECT coalesce(c.k, s.k) AS n_nationkey, c.n AS customer_n, s.n AS supplier_n, c.b IS DISTINCT FROM s.b AS differs FROM
(SELECT c_nationkey AS k, count(*) AS n, count(*) > 60 AS b FROM customer GROUP BY 1) c FULL JOIN
(SELECT s_nationkey AS k, count(*) AS n, count(*) > 60 AS b FROM supplier GROUP BY 1) s ON c.k = s.k""")
def correlate_sources(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), (F.count("*") > 60).alias("b"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), (F.count("*") > 60).alias("b"))
    out = lookup.correlate({"customer": c, "supplier": s}, "n_nationkey")
    return out.select("n_nationkey", "customer_n", "supplier_n", (~F.col("customer_b").eqNullSafe(F.col("supplier_b"))).alias("differs"))


# Unnesting and recursion.


@query("""SELECT n_name, c_name, o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def flatten_three_levels(spark, d):
    out = unnest.nested(table(spark, d, "nation", "n_nationkey", "n_name"), (table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey"), "n_nationkey", "c_nationkey"), (table(spark, d, "orders", "o_orderkey", "o_custkey"), "c_custkey", "o_custkey"))
    return out.select("n_name", "c_name", "o_orderkey")


@query("""SELECT o_orderkey, unnest(list(l_quantity * 2 ORDER BY l_linenumber)) AS twice FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def unfold_array(spark, d):
    df = _orders_with_items(spark, d)
    return unnest.unfold(df, expr.compile_expr("q:map(@*2)", expr.of(df)).column, "twice", ["o_orderkey"])


@query("""SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def map_entries_unfold(spark, d):
    df = table(spark, d, "events")
    return unnest.unfold_map(df, F.from_json("props", "map<string,string>"), ["event_id"]).where("key = 'k'")


def _tree(spark, d):
    return table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 10).alias("parent")).unionByName(spark.range(1).select("id", F.lit(0).cast("long").alias("parent")))


def _recursive(where: str = "true", more: str = "", stop: str = "false", roots: str = "id < 3") -> str:
    return f"""WITH RECURSIVE tree AS (SELECT c_custkey AS id, c_custkey // 10 AS parent FROM customer UNION ALL SELECT 0, 0),
t(root, id, depth, path) AS (SELECT id, id, 0, [id] FROM tree WHERE {roots} UNION ALL
  SELECT t.root, c.id, t.depth + 1, list_append(t.path, c.id) FROM t JOIN tree c ON c.parent = t.id
  WHERE NOT list_contains(t.path[:len(t.path) - 1], t.id) {more} AND NOT ({stop}))
SELECT root, id, depth, array_to_string(path, '/') AS path FROM t WHERE {where}"""


def _paths(df):
    return df.select("root", "id", "depth", text.join(F.col("path"), "/").alias("path"))


@query(_recursive())
def flatten_recursive_star(spark, d):
    return _paths(unnest.recurse(_tree(spark, d), F.col("id") < 3, "id", "parent"))


@query(_recursive("depth > 0"))
def flatten_recursive_plus(spark, d):
    return _paths(unnest.recurse_sql(_tree(spark, d), "id < 3", "id", "parent", include_root=False))


@query(_recursive("depth <= 2", "AND t.depth < 2"))
def flatten_recursive_depth(spark, d):
    return _paths(unnest.recurse(_tree(spark, d), F.col("id") < 3, "id", "parent", depth=2))


@query(_recursive(stop="t.id % 7 = 3"))
def flatten_recursive_break(spark, d):
    return _paths(unnest.recurse(_tree(spark, d), F.col("id") < 3, "id", "parent", stop=F.col("id") % 7 == 3))


@query(_recursive(roots="id = 0"))
def flatten_recursive_loop(spark, d):
    return _paths(unnest.recurse_sql(_tree(spark, d), "id = 0", "id", "parent"))


# Keyed aggregation.


@query("""SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY ALL""")
def count_multilevel(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority")
    c, n = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    out = lookup.lookup(lookup.lookup(o, c, {"o_custkey": "c_custkey"}, how="inner"), n, {"c_nationkey": "n_nationkey"}, how="inner")
    return keyed.count_by(out, F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority"))


@query("""SELECT o_custkey, string_agg(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, ''), ',' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY o_custkey""")
def group_collect(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    out = keyed.group_by(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), [F.col("o_custkey")], status, ["o_orderkey"])
    return out.select("o_custkey", text.join(F.col("values"), ",").alias("statuses"))


@query("SELECT c_name AS name, c_acctbal AS value FROM customer")
def index_unique(spark, d):
    return keyed.index_by(table(spark, d, "customer"), [F.col("c_name").alias("name")], F.col("c_acctbal"))


@query("""SELECT s AS segments, count(*) AS n, min(c_nationkey) AS first FROM (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1) GROUP BY s""")
def regroup_by_set(spark, d):
    out = keyed.by_member_set(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")
    return out.select(text.join(F.col("members"), ",").alias("segments"), "n", F.col("first_key").alias("first"))


@query("SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem", F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).distinct()


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 2) AS mean, min(l_discount) AS low, max(l_shipdate) AS latest, count(*) AS n FROM lineitem GROUP BY 1""")
def agg_sum_avg_min_max(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy("l_returnflag").agg(dec(F.sum("l_quantity")).alias("total"), dec(F.avg("l_extendedprice")).alias("mean"), F.min("l_discount").alias("low"), F.max("l_shipdate").alias("latest"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(l_quantity)::INT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def array_aggregates(spark, d):
    df = _orders_with_items(spark, d, order=())
    out = expr.select_text(df, "o_orderkey", "total=q:sum", "mean=q:avg", "low=q:min", "high=q:max", "n=q:size")
    return out.withColumn("mean", F.round("mean", 6))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS total, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def matrix_totals(spark, d):
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority").withColumn("one", F.lit(1))
    return keyed.totals(o, "o_orderstatus", "o_orderpriority", "one")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def matrix_pivot(spark, d):
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority").withColumn("one", F.lit(1))
    return keyed.matrix(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "one").fillna(0)


@query("""SELECT o_orderpriority AS o_orderstatus, o_orderstatus AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def transpose(spark, d):
    return levels.transpose(keyed.count_by(table(spark, d, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")), "o_orderstatus", "o_orderpriority")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.day, b.day) AS day, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS value FROM (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_totalprice) AS v FROM orders GROUP BY ALL) a
FULL JOIN (SELECT o_custkey AS k, strftime(l_shipdate, '%Y-%m-%d') AS day, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) b ON a.k = b.k AND a.day = b.day""")
def overlay_merge(spark, d):
    o = table(spark, d, "orders", "o_orderkey", F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
    l = table(spark, d, "lineitem", "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag", "l_quantity")
    a = o.groupBy("k", "day").agg(F.max("o_totalprice").alias("value"))
    b = l.join(o.select("o_orderkey", "k"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("k", "day").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("value"))
    return keyed.overlay(a, b, ["k", "day"])


@query("""WITH p AS (SELECT o_custkey::VARCHAR AS a, l_orderkey::VARCHAR AS b, l_linenumber::VARCHAR AS c, count(*) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
f AS (SELECT a, b, count(*) AS lines FROM p GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY a) AS orders FROM f)
SELECT a || CASE WHEN orders = 1 THEN '/' ELSE '|' END || b || CASE WHEN lines = 1 THEN '/' ELSE '|' END || c AS path, v FROM p JOIN g USING (a, b)""")
def compress_paths(spark, d):
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    j = l.repartition(pieces(l), "l_orderkey").join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    leaves = j.groupBy("o_custkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("v"))
    path = F.array(*(F.col(c).cast("string") for c in ("o_custkey", "l_orderkey", "l_linenumber")))
    out = keyed.compress(leaves.select(path.alias("path"), "v"), "path", "v")
    return out.select(text.join(F.col("path"), "|").alias("path"), "v")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_only(spark, d):
    return keyed.unique_only(table(spark, d, "orders"), "o_custkey")


@query("""SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)""")
def in_every_sample(spark, d):
    return keyed.in_every_sample(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("""WITH w AS (SELECT string_split(p_name, ' ') AS w FROM part), p AS (SELECT array_to_string(w[:k], ' ') AS path FROM w, unnest(range(1, len(w) + 1)) AS t(k)) SELECT path, count(*) AS n FROM p GROUP BY path""")
def path_counts(spark, d):
    out = keyed.path_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("path")), "path")
    return out.select(text.join(F.col("path"), " ").alias("path"), "n")


# Levels.


def _cells(spark, d):
    c = table(spark, d, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("value"))
    return c


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS value FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, value FROM c WHERE c_nationkey IN (SELECT c_nationkey FROM c GROUP BY 1 HAVING sum(value) > 60) AND value > 10""")
def level_filter(spark, d):
    out, _ = levels.transform(_cells(spark, d), ["c_nationkey", "c_mktsegment"], [levels.Level(1, F.sum("value") > 60), levels.Level(2, F.col("value") > 10)])
    return out


@query("""SELECT c_nationkey, max(value) AS value FROM (SELECT c_nationkey, c_mktsegment, count(*) AS value FROM customer GROUP BY ALL) WHERE value > 8 GROUP BY 1""")
def level_transform(spark, d):
    out, _ = levels.transform(_cells(spark, d), ["c_nationkey", "c_mktsegment"], [levels.Level(2, F.col("value") > 8), levels.Level(1, value=F.max("value"))])
    return out


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS value FROM customer GROUP BY ALL), k AS (SELECT * FROM c WHERE value > 11)
SELECT * FROM k WHERE c_nationkey IN (SELECT c_nationkey FROM k GROUP BY 1 HAVING count(*) >= 2)""")
def level_post(spark, d):
    out, _ = levels.transform(_cells(spark, d), ["c_nationkey", "c_mktsegment"], [levels.Level(2, F.col("value") > 11), levels.Level(1, F.count("*") >= 2)])
    return out


@query("""SELECT a, b FROM (SELECT a, b, count(*) OVER (PARTITION BY a) = 1 AND count(*) OVER (PARTITION BY b) = 1 AS alone FROM
(SELECT DISTINCT l_orderkey AS a, l_extendedprice AS b FROM lineitem)) WHERE NOT alone""")
def standalone_cells(spark, d):
    cells = table(spark, d, "lineitem", F.col("l_orderkey").alias("a"), F.col("l_extendedprice").alias("b")).distinct()
    return levels.not_standalone(cells, "a", "b")


@query("SELECT n_name || '/' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_path(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(levels.tree_path(["r_name", "n_name"]).alias("path"))


# Order.


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 8) AS share FROM lineitem""")
def share_of_parent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(keyed.share(F.col("l_quantity"), "l_orderkey"), 8).alias("share"))


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def topk_per_group(spark, d):
    return ordered.top(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def prev_row(spark, d):
    return table(spark, d, "events").select("event_id", ordered.previous(F.col("value"), ["user_id"], [F.col("ts"), F.col("event_id")]).alias("previous"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(spark, d):
    return table(spark, d, "events").select("event_id", ordered.carry_forward(F.col("value"), F.col("event_type") == "purchase", ["user_id"], [F.col("ts"), F.col("event_id")]).alias("carried"))


@query("""SELECT event_id, ended FROM (SELECT event_id, event_type, first_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended FROM events) WHERE event_type = 'view' AND ended IS NOT NULL""")
def run_pairing(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "user_id", "ts")
    return ordered.pair(e, F.col("event_type") == "view", F.col("event_type") == "purchase", "ts", ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "ended")


@query(f"""SELECT p_partkey, row_number() OVER (ORDER BY brand DESC NULLS FIRST, size NULLS FIRST, p_partkey) AS rn FROM {NULLABLE}""")
def sort_nulls_first(spark, d):
    return ordered.numbered(_nullable(spark, d), "brand desc", "size", "p_partkey").select("p_partkey", "rn")


@query("""SELECT o_orderkey, array_to_string(list_transform(list(l_quantity ORDER BY l_quantity DESC, l_linenumber), lambda x: x::INT::VARCHAR), ',') AS sorted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def sort_arrays(spark, d):
    df = _orders_with_items(spark, d).where(F.size("q") > 0)
    sorted_ = expr.compile_expr("q:sort(@ desc)", expr.of(df)).column
    return df.select("o_orderkey", F.array_join(F.transform(sorted_, lambda x: x.cast("int").cast("string")), ",").alias("sorted"))


# Sets.


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(spark, d):
    return sets.union(table(spark, d, "customer", F.col("c_nationkey").alias("k")), table(spark, d, "supplier", F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return sets.intersect(table(spark, d, "customer", F.col("c_nationkey").alias("k")), table(spark, d, "supplier", F.col("s_nationkey").alias("k")))


# Scalars.


@query("""SELECT event_id, date_trunc('year', ts) AS y, date_trunc('month', ts) AS m, date_trunc('week', ts) AS w, date_trunc('day', ts) - to_days(dayofweek(ts)::INT) AS s, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS i FROM events""")
def date_trunc_units(spark, d):
    t = F.col("ts")
    cols = {"y": "Y", "m": "M", "w": "W", "s": "w", "h": "h", "i": "m"}
    return table(spark, d, "events").select("event_id", *(time.truncate(t, u).cast("timestamp_ntz").alias(k) for k, u in cols.items()))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate) - INTERVAL 2 MONTH AS a, date_trunc('day', o_orderdate) + INTERVAL 3 DAY AS b, o_orderdate + INTERVAL 90 SECOND AS c FROM orders""")
def date_offset(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", time.moved(t, "-2M").cast("timestamp_ntz").alias("a"), time.moved(t, "+3d").cast("timestamp_ntz").alias("b"), time.plus_seconds(t, F.lit(90)).cast("timestamp_ntz").alias("c"))


@query("""SELECT event_id, (epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000) // 1000 AS s FROM events""")
def date_diff(spark, d):
    return table(spark, d, "events").select("event_id", time.seconds_between(F.col("ts"), time.literal("2024-01-01")).alias("s"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 120 MINUTE THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 2 DAY THEN strftime(o_orderdate, '%Y-%m-%d %H')
  WHEN o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 60 DAY THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS bucket FROM orders""")
def time_bucket(spark, d):
    return table(spark, d, "orders").select("o_orderkey", time.time_bucket(F.col("o_orderdate"), time.literal("1998-08-01").cast("timestamp_ntz")).alias("bucket"))


@query("""SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS a, try_strptime(strftime(ts, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M') AS b, NULL::TIMESTAMP AS c FROM events""")
def epoch_parse(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return table(spark, d, "events").select("event_id", time.parse(s, "Ts").cast("timestamp_ntz").alias("a"), time.parse(F.date_format("ts", "yyyy/MM/dd HH:mm"), "yyyy/MM/dd HH:mm").cast("timestamp_ntz").alias("b"), time.parse(F.lit("x"), "TQ").cast("timestamp_ntz").alias("c"))


@query(r"""SELECT p_partkey, nullif(regexp_extract(p_brand, '#(\d+)', 1), '') AS n, array_to_string(regexp_extract_all(p_type, '[A-Z]+'), '|') AS caps, regexp_replace(p_name, '[aeiou]', '*', 'g') AS stars, upper(p_name) AS up FROM part""")
def text_match_extract_replace(spark, d):
    return expr.select_text(table(spark, d, "part"), "p_partkey", r"n=p_brand:match(#(\d+))", "caps=p_type:extract([A-Z]+):join(|)", "stars=p_name:replace([aeiou],*)", "up=p_name:upcase")


@query("""SELECT p_partkey, 'Part ' || p_name || ' (' || lpad(p_size::VARCHAR, 4, '0') || ') none' AS label FROM part""")
def text_join_format(spark, d):
    df = table(spark, d, "part").withColumn("nothing", F.lit(None).cast("string"))
    return expr.select_text(df, "p_partkey", 'label=:format(Part ${p_name} (${%04d,p_size}) ${nothing,"none"})')


@query(r"""SELECT p_partkey, CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 7) || '...' ELSE p_type END AS short, regexp_replace(p_name, '(\w{1,3})\w*', '\1', 'g') AS abbr FROM part""")
def text_wrap_limit(spark, d):
    return table(spark, d, "part").select("p_partkey", text.limit(F.col("p_type"), 10).alias("short"), text.abbreviate(F.col("p_name")).alias("abbr"))


@query("""SELECT p_partkey, trunc((p_size - 25)::DOUBLE / 4)::BIGINT AS q, p_size + 5.0 AS s, p_size * 2 - 1 AS m, repeat('ab', p_size % 3) AS r, p_size = 5 AS e FROM part""")
def arith_coercion(spark, d):
    return expr.select_text(table(spark, d, "part"), "p_partkey", "q=(p_size-25)/4", 's="5"+p_size', "m=p_size*2-1", 'r="ab"*(p_size-p_size/3*3)', 'e=p_size=="5"')


@query("""SELECT p_partkey, '#' || substr(md5(p_brand), 1, 6) AS auto, CASE WHEN p_size < 10 THEN '#808080' WHEN p_size <= 40 THEN '#' || lpad(lower(hex(floor(255 * (p_size - 10) / 30.0 + 0.5)::BIGINT)), 2, '0') || '00' || lpad(lower(hex(floor(255 - 255 * (p_size - 10) / 30.0 + 0.5)::BIGINT)), 2, '0') ELSE '#c0c0c0' END AS heat FROM part""")
def heat_color(spark, d):
    return table(spark, d, "part").select("p_partkey", color.auto(F.col("p_brand")).alias("auto"), color.heat(F.col("p_size").cast("double"), (("#00f", 10.0), ("#f00", 40.0))).alias("heat"))


# Sources and the declared query.


@query("""SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING count(*) > 5 ORDER BY flag LIMIT 2""")
def sql_clauses(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_source")
    return tables.sql(spark, "l_returnflag AS flag, count(*) AS n", "lineitem_source", "l_quantity > 10", "l_returnflag", "count(*) > 5", "flag", max_rows=2)


def _as_log(e, head, more=None):
    """Lines as logs would hold them, in as many files as there are hundreds of events."""
    lines = F.array_compact(F.array(F.struct((F.col("event_id") * 2).alias("pos"), head.alias("line")), *([F.when(more.isNotNull(), F.struct((F.col("event_id") * 2 + 1).alias("pos"), more.alias("line")))] if more is not None else [])))
    return e.select(F.floor(F.col("event_id") / 100).cast("string").alias("path"), F.explode(lines).alias("x")).select("path", "x.pos", "x.line")


@query("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, upper(event_type) AS level, 's' || (user_id % 5)::VARCHAR AS server, 'job' || user_id::VARCHAR AS job,
'value ' || event_id::VARCHAR || CASE WHEN event_id % 3 = 0 THEN chr(10) || '  at line ' || event_id::VARCHAR ELSE '' END AS message FROM events""")
def log_records(spark, d):
    e = table(spark, d, "events")
    head = F.concat_ws(",", F.lit("A"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.upper("event_type"), F.concat(F.lit("s"), F.col("user_id") % 5), F.lit("iiq-batch"), F.concat(F.lit("job"), F.col("user_id")), F.concat(F.lit("value "), F.col("event_id")))
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  at line "), F.col("event_id")))
    return records.records(_as_log(e, head, more), "batch.log", strict=0)


@query("""SELECT 'A' AS kind, 'INFO' AS a, event_type AS b, 'm' || event_id::VARCHAR AS c FROM events UNION ALL SELECT 'B', CASE WHEN event_id % 2 = 0 THEN 'GET' END, '/p/' || event_id::VARCHAR, user_id::VARCHAR FROM events
UNION ALL SELECT 'C', 'h' || user_id::VARCHAR, event_id::VARCHAR, '7.5' FROM events UNION ALL SELECT 'D', event_type, 'core:error', '12' FROM events
UNION ALL SELECT 'E', 'k' || event_id::VARCHAR, 'a=' || user_id::VARCHAR, NULL FROM events UNION ALL SELECT 'F', event_type, 'w ' || user_id::VARCHAR, 'x.Y' FROM events""")
def log_formats(spark, d):
    e, text_of = table(spark, d, "events"), lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    i, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    cases = (
        ("A", "iiq.log", text_of("A,2024-01-01T10:00:00.000,INFO,iam,app,[main]-(", t, ":", i, "):m", i), ("level", "class", "message")),
        ("B", "access.log", text_of("10.0.0.1 - - [01/Jan/2024] \"", F.when(F.col("event_id") % 2 == 0, "GET ").otherwise(""), "/p/", i, "\" 200 ", u), ("method", "path", "length")),
        ("C", "meminfo.log", text_of("[2024-01-01] host = h", u, " / max memory = ", i, " / total memory = 1 / free memory = 2 / used memory = 3 / available memory = 4 / cpu load = 7.5 %"), ("host", "max", "cpu")),
        ("D", "apache-error.log", text_of("[now] [core:error] [pid 12:tid 13] [client 10.0.0.1] AH1: ", t), ("message", "category", "pid")),
        ("E", "properties", text_of("k", i, "=a=", u), ("key", "value", "overflow")),
        ("F", "tomcat.log", text_of("2024-01-01T10:00:00,1 WARN w ", u, " x.Y:", i, " - ", t), ("message", "thread", "class")),
    )
    found = [records.records(_as_log(e, head), parser, strict=0, in_order=False).select(F.lit(kind).alias("kind"), *(F.nullif(F.col(c), F.lit("")).alias(n) for n, c in zip("abc", columns, strict=True))) for kind, parser, head, columns in cases]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("""SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 1000 AND o_totalprice > 50000 GROUP BY ALL HAVING count(*) > 20""")
def declared_query(spark, d):
    c = lookup.lookup_list(table(spark, d, "customer"), table(spark, d, "orders"), {"c_custkey": "o_custkey"}, F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], "orders")
    q = generic.Query(source=c, type_name="Customer", selector='Order("paid", gt(c_acctbal, 1000)).accept("large", gt("order.o_totalprice", 50000))', subquery="order=orders", computations="status=order.o_orderstatus", grouping="segment=c_mktsegment\nstatus=status", postprocessing=[levels.Level(2, F.col("value") > 20)])
    return generic.plan(spark, q)[0]


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark, d):
    from arbora.streaming.events import bucket

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(bucket(F.col("ts"), "1 day").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


# The language: lookups with filters, lookups in iterations, recursion, what is kept, groups, XML, macros.


@query("""SELECT c_custkey, count(o_orderkey) FILTER (o_totalprice > 100000) AS n, count(o_orderkey) FILTER (o_totalprice > c_acctbal * 20 AND o_orderstatus <> 'F') AS later FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_filtered(spark, d):
    catalog = {"Order": expr.Entity(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")}
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return expr.select_text(c, "c_custkey", 'n=:Order(?o_custkey==$"c_custkey" && o_totalprice > 100000)', 'later=:Order(?o_custkey==$"c_custkey" && o_totalprice>$"c_acctbal*20" && o_orderstatus != "F")', catalog=catalog)


@query("""SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS top, any_value(o_orderkey) FILTER (rn = 1) AS best FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_ordered_list(spark, d):
    catalog = {"Order": expr.Entity(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")}
    out = expr.select_text(table(spark, d, "customer", "c_custkey"), "c_custkey", 'top=:Order([{o_orderkey}o_custkey==$"c_custkey",o_totalprice desc,o_orderkey,3]):map(o_orderkey):join(,)', 'best=:Order([{o_orderkey}o_custkey==$"c_custkey",o_totalprice desc,o_orderkey,1])', catalog=catalog)
    return out.withColumn("top", F.nullif("top", F.lit("")))


@query("""SELECT o_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS brands, sum((SELECT count(*) FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < l_quantity * 100))::BIGINT AS poor
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def lookup_in_iteration(spark, d):
    o, l = table(spark, d, "orders", "o_orderkey"), table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = lookup.lookup_list(o, l, {"o_orderkey": "l_orderkey"}, F.struct("l_partkey", "l_suppkey", "l_quantity"), ["l_linenumber"], "items").where(F.size("items") > 0)
    catalog = {"Part": expr.Entity(table(spark, d, "part"), "p_partkey", "p_name"), "Supplier": expr.Entity(table(spark, d, "supplier"), "s_suppkey", "s_name")}
    return expr.select_text(items, "o_orderkey", 'brands=items:map(:Part(p_partkey==$"l_partkey").p_brand):join(,)', 'poor=items:sum(:Supplier(?s_suppkey==$"l_suppkey" && s_acctbal<$"l_quantity*100"))', catalog=catalog)


def _nested(spark, d):
    """Regions with nations with suppliers, each a name and its children."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.struct(F.col("s_name").alias("name")).alias("v")))), lambda x: x["v"]).alias("children"))
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", F.struct(F.col("n_name").alias("name"), F.coalesce("children", F.array()).alias("children")).alias("v"))
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("v.name").alias("k"), "v"))).alias("c"))
    return table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), F.transform("c", lambda x: x["v"]).alias("children"))


@query("""WITH n AS (SELECT n_regionkey, n_name, n_name || coalesce(',' || string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_name)
SELECT r_name AS name, r_name || ',' || string_agg(names, ',' ORDER BY n_name) AS everything, string_agg(n_name, ',' ORDER BY n_name) AS nations, (count(*) + sum(CASE WHEN n_name < 'M' THEN suppliers ELSE 0 END))::INT AS n,
  (count(*) + sum(suppliers) + 1)::INT AS nodes FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_name""")
def flatten_recursive_text(spark, d):
    return expr.select_text(_nested(spark, d), "name", "everything=:flatten(children*#name):join(,)", "nations=:flatten(children+,1#name):join(,)", 'n=:flatten(children+,unlike(name,"^[A-L]")#name):size', "nodes=:flatten(children*):size")


@query("""SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, 1 AS first, 1 AS again, 1 AS swapped, 3 AS now, 4 AS later FROM events""")
def kept_values(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    return expr.select_text(e, "event_id", "previous=:swapcache(v,value)", "first=:cache(a,1)", "again=:cache(a,2)", "swapped=:swapcache(a,3)", "now=:cache(a)", "later=:recache(a,4)", order=(["user_id"], [F.col("ts"), F.col("event_id")]))


@query(r"""SELECT p_partkey, 'rand' AS head, regexp_extract(p_brand, '#(\d)', 1) AS n, nullif(regexp_extract(p_brand, '#\d(\d)', 1), '') AS m, CASE WHEN p_brand LIKE '%2' THEN '2' END AS two, regexp_matches(p_brand, '#\d$') AS short FROM part""")
def match_groups(spark, d):
    out = expr.select_text(table(spark, d, "part"), "p_partkey", r"g=p_brand:match((a|B)(?<head>rand)#(?<n>\d)(?<m>\d)?)", "two=p_brand:match(d.*?(2$)?$)", r"list=p_brand:match(#(\d)(\d)?$)")
    return out.select("p_partkey", *(F.col("g")[k].alias(k) for k in ("head", "n", "m")), "two", F.col("list")[1].isNull().alias("short"))


@query("SELECT p_partkey, p_brand AS brand, p_size + 1 AS size FROM part")
def xml_there_and_back(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.struct("p_brand", "p_size").alias("part"))
    return expr.select_text(p, "p_partkey", "brand=part:toXml(part):parseXml(p_brand STRING, p_size INT).p_brand", "size=part:toXml(part):parseXml(p_size INT).p_size+1")


@query("""SELECT p_partkey, p_name || ' [' || p_brand || ']' AS label, p_size * 3600000 AS span, p_size > 25 AS large FROM part""")
def macros_and_comments(spark, d):
    macros = {"label": ':format(${p_name} [${$brand$}])', "brand": "p_brand"}
    return expr.select_text(table(spark, d, "part"), "p_partkey", "label=$label$", "span=p_size*1h // hours as milliseconds", "large=p_size>25", macros=macros)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS same, event_type || ' < ' || event_id::VARCHAR AS chain FROM events""")
def map_arguments(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("props"))
    e = e.withColumn("o", F.struct(F.col("event_id").cast("string").alias("id"), F.array(F.struct(F.col("event_type").alias("t"))).alias("xs")))
    return expr.select_text(e, "event_id", 'k=props("k")', "same=props:get(\"k\")", "chain=o.xs:map(t:format(${@} < ${^^.event_id})):join(,)")


@query("""SELECT o_orderkey, count(l_quantity)::INT AS n, count(DISTINCT l_quantity)::INT AS different, count(l_quantity) FILTER (l_quantity = 7)::INT AS sevens FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def keyed_maps_in_rows(spark, d):
    df = _orders_with_items(spark, d, order=()).where(F.size("q") > 0)
    return expr.select_text(df, "o_orderkey", "n=q:size", "different=q:count:size", "sevens=q:count:get(7.0)").withColumn("sevens", F.coalesce("sevens", F.lit(0)))


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, upper(string_split(p_name, ' ')[1]) AS c FROM part WHERE p_size > 10""")
def declared_computations(spark, d):
    q = generic.Query(source=table(spark, d, "part"), selector='Part("large", gt(p_size, 10)).accept()', computations="a, b=p_name:extract([^ ]+)\n\nc=a:upcase", output="p_partkey\na\nb\nc")
    return generic.plan(spark, q)[0]


# Sources by kind.


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def source_expression(spark, d):
    catalog = {"Nation": expr.Entity(table(spark, d, "nation"), "n_nationkey", "n_name")}
    q = generic.Query(source="Expression", filter=":Nation([n_regionkey==1,n_name])", output="n_nationkey\nn_name", catalog=catalog)
    return generic.plan(spark, q)[0]


@query("SELECT s_suppkey, s_name FROM supplier")
def source_application(spark, d):
    tables.application("warehouse", "parquet", d)
    q = generic.Query(source="ResourceObject", filter="warehouse: supplier.parquet\nmergeSchema=true", output="s_suppkey\ns_name")
    return generic.plan(spark, q)[0]


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def source_registered(spark, d):
    tables.register("regions")(lambda spark, least: table(spark, d, "region").where(F.col("r_regionkey") >= least))
    return generic.plan(spark, generic.Query(source="Rule: regions", filter="least=2", output="r_regionkey\nr_name"))[0]


@query("SELECT i AS value, i * i AS square FROM range(0, 1000, 7) t(i)")
def source_numbers(spark, d):
    return expr.select_text(tables.numbers(spark, 0, 1000, 7), "value", "square=value*value")


@query("""SELECT c_custkey, n_name AS nation, o_orderkey AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey""")
def dotted_outer_join(spark, d):
    keys = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("order_ids"))
    c = table(spark, d, "customer").join(keys, F.col("o_custkey") == F.col("c_custkey"), "left")
    references = {"nation": tables.Reference(table(spark, d, "nation"), "c_nationkey", "n_nationkey"), "orders": tables.Reference(table(spark, d, "orders"), "order_ids", "o_orderkey")}
    return tables.attributes_joined(c, "c_custkey, nation.n_name, orders.o_orderkey", references).toDF("c_custkey", "nation", "orders")


@query("""SELECT event_id, event_type, coalesce(json_extract_string(props, '$.event_type'), event_type) AS both FROM events""")
def attributes_clash(spark, d):
    e = table(spark, d, "events").withColumn("ext", F.from_json("props", "map<string,string>"))
    plain = tables.attributes(e, "event_id, event_type", "ext").toDF("event_id", "both")
    return plain.select(F.col("event_id").cast("long"), F.col("both").alias("event_type"), "both")


# More of keyed groups, sets and windows.


@query("""SELECT * FROM (SELECT min(o_custkey) AS value, 2 AS depth FROM orders) UNION ALL SELECT count(*), -1 FROM orders UNION ALL SELECT count(DISTINCT o_orderstatus), -2 FROM orders UNION ALL SELECT count(DISTINCT (o_orderstatus, o_orderpriority)), -3 FROM orders""")
def peek_and_counters(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    first = keyed.peek(o.select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "o_custkey").select(F.col("o_custkey").alias("value"), "depth")
    n = keyed.counters(o, "o_orderstatus", "o_orderpriority").select(F.col("n").alias("value"), (-F.col("level") - 1).alias("depth"))
    return first.unionByName(n)


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS value FROM orders GROUP BY ALL)
SELECT *, (sum(value) OVER (PARTITION BY o_orderstatus))::BIGINT AS of_row, (sum(value) OVER (PARTITION BY o_orderpriority))::BIGINT AS of_column, (sum(value) OVER ())::BIGINT AS of_matrix FROM c""")
def cell_context(spark, d):
    cells = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("value"))
    return levels.cell_context(cells, "o_orderstatus", "o_orderpriority", "value")


@query("""SELECT c_custkey AS k, CASE WHEN n > 0 THEN n::DOUBLE ELSE c_acctbal END AS value FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def upsert(spark, d):
    old = table(spark, d, "customer", F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("value"))
    return keyed.put(old, new.join(old.select("k"), "k", "left_semi"), ["k"])


@query("""SELECT p_partkey, coalesce(p_size > 25, false) AS out FROM part""")
def evict_rows(spark, d):
    out, rest = sets.evict(table(spark, d, "part", "p_partkey", "p_size"), F.col("p_size") > 25)
    return out.select("p_partkey", F.lit(True).alias("out")).unionByName(rest.select("p_partkey", F.lit(False).alias("out")))


@query("""WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def session_counts(spark, d):
    from arbora.streaming.events import sessions

    out = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "2 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT p_partkey, (p_size // 10) * 10 AS tens, regexp_replace(p_name, '(.{4})', '\\1' || chr(10), 'g') AS wrapped, len(string_split(p_name || ', ' || p_type, ','))::INT AS fields, lpad((p_size // 24)::VARCHAR, 1, '0') || 'd ' || lpad((p_size % 24)::VARCHAR, 2, '0') || ':00:00' AS span FROM part WHERE p_size >= 24""")
def text_extras(spark, d):
    p = table(spark, d, "part").where("p_size >= 24")
    low = F.split(text.leading_digit_range(F.col("p_size")), "-")[0].cast("long")
    # a wrap puts no line end after the last piece
    wrapped = F.when(F.length("p_name") % 4 == 0, F.concat(text.hard_wrap(F.col("p_name"), 4), F.lit("\n"))).otherwise(text.hard_wrap(F.col("p_name"), 4))
    return p.select("p_partkey", low.alias("tens"), wrapped.alias("wrapped"), F.size(text.parse_csv(F.concat("p_name", F.lit(", "), "p_type"))).alias("fields"), text.duration(F.col("p_size").cast("long") * 3_600_000).alias("span"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_of_a_query(spark, d):
    q = generic.Query(source=table(spark, d, "orders"), ordering="o_totalprice desc, o_orderkey", max_rows=25, output="o_orderkey\no_totalprice")
    return generic.plan(spark, q)[0]


# HTML inside a row.


@query("""SELECT o_orderkey, '<a style="color: red;" href="/o?id=' || o_orderkey::VARCHAR || '" target="_blank">' || o_orderpriority || ' &amp; more</a>' AS anchor, '<span>' || o_orderstatus || '</span>' AS label,
  '<span style="display:inline-block;width:' || least(round(o_totalprice / 1000), 1000)::INT::VARCHAR || 'px;background:#' || substr(md5('price'), 1, 6) || '" title="price: ' || (o_totalprice / 1000)::INT::VARCHAR || '">&nbsp;</span>' AS bar FROM orders""")
def html_links(spark, d):
    o = table(spark, d, "orders").withColumn("more", F.concat("o_orderpriority", F.lit(" & more"))).withColumn("k", F.col("o_totalprice") / 1000)
    # widths round a half up, casts of the SQL to the even number
    o = o.withColumn("bar", columns.bars({"price": F.col("k")}, shown={"price": F.rint("k").cast("int")}))
    return expr.select_text(o, "o_orderkey", "anchor=:link(/o?id=${o_orderkey},${more},,red)", "label=:link(#,${o_orderstatus})", "bar")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS line, l_quantity::INT AS quantity, l_returnflag, l_linestatus FROM lineitem),
c AS (SELECT l_orderkey, l_returnflag AS r, l_linestatus AS s, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT a.l_orderkey, a.r, b.s, n FROM (SELECT DISTINCT l_orderkey, r FROM c) a JOIN (SELECT DISTINCT l_orderkey, s FROM c) b ON a.l_orderkey = b.l_orderkey LEFT JOIN c ON c.l_orderkey = a.l_orderkey AND c.r = a.r AND c.s = b.s),
rows AS (SELECT l_orderkey, r, '<tr><th>' || r || '</th>' || string_agg('<td>' || coalesce(n::VARCHAR, '') || '</td>', '' ORDER BY s) || '<td>' || sum(n)::VARCHAR || '</td></tr>' AS row, '<tr><th></th>' || string_agg('<th>' || s || '</th>', '' ORDER BY s) || '<th>Total</th></tr>' AS head FROM g GROUP BY l_orderkey, r),
foot AS (SELECT l_orderkey, '<tr><th>Total</th>' || string_agg('<td>' || n::VARCHAR || '</td>', '' ORDER BY s) || '<td>' || sum(n)::VARCHAR || '</td></tr>' AS foot FROM (SELECT l_orderkey, s, count(*) AS n FROM (SELECT l_orderkey, l_linestatus AS s FROM l) GROUP BY ALL) GROUP BY l_orderkey),
grid AS (SELECT l_orderkey, '<table>' || any_value(head) || string_agg(row, '' ORDER BY r) || any_value(foot) || '</table>' AS grid FROM rows JOIN foot USING (l_orderkey) GROUP BY l_orderkey)
SELECT l_orderkey AS o_orderkey, '<table><tr><th>line</th><th>quantity</th></tr>' || string_agg('<tr><td>' || line::VARCHAR || '</td><td>' || quantity::VARCHAR || '</td></tr>', '' ORDER BY line, quantity, l_returnflag, l_linestatus) || '</table>' AS lines, any_value(grid) AS grid
FROM l JOIN grid USING (l_orderkey) GROUP BY l_orderkey""")
def html_tables(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag", "l_linestatus")
    # both collections from one grouping, so that lines are moved once
    lines = keyed.group_by(l, [F.col("l_orderkey").alias("o_orderkey")], F.struct("line", "quantity", "l_returnflag", "l_linestatus"), ["line", "quantity", "l_returnflag", "l_linestatus"], into="lines")
    both = lines.select("o_orderkey", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["quantity"].alias("quantity"))).alias("items"), F.transform("lines", lambda x: F.struct(x["l_returnflag"].alias("l_returnflag"), x["l_linestatus"].alias("l_linestatus"))).alias("cells"))
    return expr.select_text(both, "o_orderkey", "lines=items:table", "grid=cells:count(l_returnflag#l_linestatus):grid(total)")
