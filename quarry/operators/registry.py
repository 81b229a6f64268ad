"""Registered queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Session, select_frames
from ..sources.catalog import Table
from ..sources.csvload import read_rows
from . import scripts
from .relational import aggregate, condition, join, key_range, project, top, where

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
col, lit = F.col, F.lit


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, make: Callable[[Tables], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def dialect(name: str, text: str, sql: str | None = None) -> None:
    """A query that goes through the dialect's parser, binder and compiler."""
    query(name, lambda t: select_frames(text, t), sql or text)


# Scans, projections, predicates

query("scan_all", lambda t: project(t("nation"), "n_nationkey", "n_name", "n_regionkey"), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
query(
    "scan_filter_project",
    lambda t: project(where(t("orders"), condition("o_orderstatus", "=", "F")), "o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
query("index_point_lookup", lambda t: key_range(t("orders"), o_orderkey=77), "SELECT * FROM orders WHERE o_orderkey = 77")
query("index_range", lambda t: key_range(t("orders"), o_orderkey=(100, 250)), "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
query(
    "index_prefix_range",
    lambda t: project(key_range(t("lineitem"), l_orderkey=5, l_linenumber=(2, None)), "l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 5 AND l_linenumber >= 2",
)
query("project_reorder", lambda t: project(t("nation"), "n_regionkey", "n_nationkey"), "SELECT n_regionkey, n_nationkey FROM nation")
dialect("select_star", "SELECT * FROM region")
query("project_alias", lambda t: project(t("region"), key=col("r_regionkey"), label=col("r_name")), "SELECT r_regionkey AS key, r_name AS label FROM region")
dialect("table_alias", "SELECT n.n_name, r.r_name FROM nation AS n, region r WHERE n.n_regionkey = r.r_regionkey")
query(
    "filter_conjunction",
    lambda t: project(where(t("orders"), condition("o_totalprice", ">=", 1000.0), condition("o_totalprice", "<", 50000.0), condition("o_orderstatus", "<>", "F")), "o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000.0 AND o_totalprice < 50000.0 AND o_orderstatus <> 'F'",
)
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    query(
        f"filter_{_name}",
        lambda t, op=_op: project(where(t("customer"), condition("c_nationkey", op, 7)), "c_custkey", "c_name"),
        f"SELECT c_custkey, c_name FROM customer WHERE c_nationkey {_op} 7",
    )
query("filter_int", lambda t: project(where(t("part"), condition("p_size", ">", 3.7), condition("p_size", "<=", 5)), "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size > 3.7 AND p_size <= 5")
query("filter_float", lambda t: project(where(t("part"), condition("p_retailprice", ">", 1500.25)), "p_partkey"), "SELECT p_partkey FROM part WHERE p_retailprice > 1500.25")
query("filter_string", lambda t: project(where(t("customer"), condition("c_mktsegment", ">=", "F"), condition("c_mktsegment", "<", "M")), "c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'M'")
query("filter_col_col", lambda t: project(where(t("lineitem"), condition("l_partkey", "=", col("l_suppkey"))), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
dialect("filter_arith_rhs", "SELECT p_partkey FROM part WHERE p_size > 2 * 10 + 5")
dialect("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 450000.0 AND NOT o_orderpriority = '1-URGENT'")
dialect("filter_in", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 7)")
dialect("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
dialect("filter_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%7%'")
dialect("filter_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice > 400000.0")

# Joins

query(
    "join_inner_equi",
    lambda t: project(join(t("orders"), t("customer"), col("o_custkey") == col("c_custkey")), "o_orderkey", "c_name"),
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
dialect("join_on", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000.0")
dialect("join_comma_where", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name > 'F'")
query(
    "join_sortmerge_hint",
    lambda t: project(join(t("lineitem"), t("orders"), col("l_orderkey") == col("o_orderkey"), hint="merge"), "l_orderkey", "l_linenumber", "o_orderstatus"),
    "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
dialect("join_theta", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
query("join_theta_lt", lambda t: project(join(t("supplier"), t("nation"), col("s_suppkey") < col("n_nationkey")), "s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey < n_nationkey")
query("join_theta_ne", lambda t: project(join(t("region"), t("nation"), col("r_regionkey") != col("n_regionkey")), "r_name", "n_name"), "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey <> n_regionkey")
query(
    "join_multi_cond",
    lambda t: project(join(t("lineitem"), t("orders"), (col("l_orderkey") == col("o_orderkey")) & (col("l_extendedprice") > col("o_totalprice"))), "l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice",
)
query("join_cross", lambda t: project(join(t("region"), t("nation")), "r_name", "n_name"), "SELECT r_name, n_name FROM region, nation")
dialect("join_three_way", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
dialect(
    "join_four_way",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_totalprice > 300000.0",
)
query(
    "semi_join",
    lambda t: project(join(t("customer"), where(t("orders"), condition("o_totalprice", ">", 400000.0)), col("c_custkey") == col("o_custkey"), "semi"), "c_custkey", "c_name"),
    "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey",
)
dialect("semi_join_theta", "SELECT s_suppkey FROM supplier SEMI JOIN part ON s_acctbal > p_retailprice")
dialect(
    "semi_join_multi_cond",
    "SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice < o_totalprice",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND l_extendedprice < o_totalprice)",
)
query("anti_join", lambda t: project(join(t("customer"), where(t("orders"), condition("o_totalprice", ">", 400000.0)), col("c_custkey") == col("o_custkey"), "anti"), "c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
dialect("left_join", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000.0")
dialect("right_join", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 5000.0")
dialect("full_join", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
dialect("self_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

# Aggregation

query("group_by_one", lambda t: aggregate(t("orders"), ["o_orderstatus"], cnt=F.count("*"), m=F.max("o_totalprice")), "SELECT o_orderstatus, count(*) AS cnt, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
query(
    "group_by_multi",
    lambda t: aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], cnt=F.count("*"), q=F.round(F.sum("l_quantity"), 2)),
    "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
query("group_by_no_agg", lambda t: aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
query(
    "agg_global_all",
    lambda t: aggregate(t("lineitem"), cnt=F.count("*"), s=F.sum("l_quantity"), a=F.round(F.avg("l_quantity"), 6), mi=F.min("l_quantity"), ma=F.max("l_quantity")),
    "SELECT count(*) AS cnt, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS mi, max(l_quantity) AS ma FROM lineitem",
)
query("agg_count_star", lambda t: aggregate(t("lineitem"), cnt=F.count("*")), "SELECT count(*) AS cnt FROM lineitem")
query("agg_count_col", lambda t: aggregate(t("customer"), ["c_nationkey"], cnt=F.count("c_mktsegment")), "SELECT c_nationkey, count(c_mktsegment) AS cnt FROM customer GROUP BY c_nationkey")
query("agg_sum_int", lambda t: aggregate(t("part"), s=F.sum("p_size")), "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part")
query("agg_sum_float", lambda t: aggregate(t("orders"), s=F.round(F.sum("o_totalprice"), 2)), "SELECT round(sum(o_totalprice), 2) AS s FROM orders")
query("agg_sum_filtered", lambda t: aggregate(where(t("lineitem"), condition("l_discount", ">", 0.05)), s=F.round(F.sum("l_quantity"), 2)), "SELECT round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_discount > 0.05")
query("agg_avg", lambda t: aggregate(t("part"), ["p_brand"], a=F.round(F.avg("p_size"), 6)), "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY p_brand")
query("agg_min", lambda t: aggregate(t("part"), ["p_brand"], m=F.min("p_retailprice")), "SELECT p_brand, min(p_retailprice) AS m FROM part GROUP BY p_brand")
query("agg_max", lambda t: aggregate(t("nation"), ["n_regionkey"], m=F.max("n_name")), "SELECT n_regionkey, max(n_name) AS m FROM nation GROUP BY n_regionkey")
query(
    "agg_min_with_prefix_filter",
    lambda t: aggregate(key_range(t("lineitem"), l_orderkey=(10, 40)), lo=F.min("l_linenumber"), hi=F.max("l_linenumber")),
    "SELECT min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_orderkey BETWEEN 10 AND 40",
)
query("agg_empty_input", lambda t: aggregate(where(t("part"), condition("p_size", "<", 0)), cnt=F.count("*"), s=F.sum("p_size"), mi=F.min("p_size")), "SELECT count(*) AS cnt, CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS mi FROM part WHERE p_size < 0")
dialect("having_agg_const", "SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey HAVING count(*) > 60")
dialect("having_agg_agg", "SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey HAVING max(c_acctbal) > avg(c_acctbal)")
dialect("having_col_const", "SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey HAVING c_nationkey > 10")
dialect("having_col_agg", "SELECT p_size, count(*) AS c FROM part GROUP BY p_size HAVING p_size < count(*)")
dialect("having_and", "SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100 AND avg(l_quantity) > 1.0")
dialect("having_no_group", "SELECT count(*) AS c FROM part HAVING count(*) > 1")
dialect("count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
query("distinct_rows", lambda t: t("orders").select("o_orderstatus", "o_orderpriority").distinct(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("select_distinct", "SELECT DISTINCT p_brand FROM part WHERE p_size > 40")

# Order and limit

query("sort_asc", lambda t: top(project(t("nation"), "n_name"), [F.asc("n_name")]), "SELECT n_name FROM nation ORDER BY n_name")
query("sort_desc", lambda t: top(project(t("supplier"), "s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"]), "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
query("sort_multi", lambda t: top(project(t("customer"), "c_nationkey", "c_custkey"), [F.desc("c_nationkey"), F.asc("c_custkey")]), "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey")
query("limit_only", lambda t: aggregate(project(t("part"), "p_partkey").limit(7), cnt=F.count("*"), keys=F.count_distinct("p_partkey")), "SELECT count(*) AS cnt, count(DISTINCT p_partkey) AS keys FROM (SELECT p_partkey FROM part LIMIT 7)")
query("topk", lambda t: top(project(t("orders"), "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("limit_zero", "SELECT n_name FROM nation LIMIT 0")
query(
    "group_order_limit",
    lambda t: top(aggregate(t("orders"), ["o_custkey"], s=F.round(F.sum("o_totalprice"), 2)), [F.desc("s"), "o_custkey"], 5),
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 5",
)
dialect("sort_hidden_col", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8 OFFSET 5")
dialect("comments", "SELECT r_name -- the name\n FROM region /* all of\n them */ WHERE r_regionkey <> 2")

# Expressions

dialect("expr_add", "SELECT p_partkey, p_size + 1 AS v FROM part")
dialect("expr_sub", "SELECT p_partkey, p_size - 100 AS v FROM part")
dialect("expr_mul", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem")
dialect("expr_div", "SELECT p_partkey, p_size / 2 AS h, p_size / p_retailprice AS r FROM part")
dialect("expr_neg", "SELECT l_orderkey, l_linenumber, -l_quantity AS v FROM lineitem")
dialect("expr_precedence", "SELECT p_partkey, (p_size + 2) * 3 - 4 * p_size AS v FROM part")
query("update_concat", lambda t: project(t("nation"), "n_nationkey", n_name=F.concat("n_name", lit("!"))), "SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
dialect("fn_upper", "SELECT UPPER(n_name) AS v FROM nation")
dialect("fn_lower", "SELECT LOWER(n_name) AS v FROM nation")
dialect("fn_substring", "SELECT SUBSTRING(n_name, 1, 5) AS v FROM nation")
dialect("fn_concat", "SELECT CONCAT(n_name, '!') AS v FROM nation")
dialect("fn_length", "SELECT LENGTH(n_name) AS v FROM nation", "SELECT CAST(length(n_name) AS INTEGER) AS v FROM nation")
dialect("case_searched", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS c FROM part")
dialect("case_simple", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS c FROM nation")

dialect("fn_round", "SELECT p_partkey, ROUND(p_retailprice, 1) AS v, ABS(p_size - 20) AS a FROM part")

# Subqueries

dialect("in_select", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_acctbal > 0")
dialect("not_in_select", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)")
dialect("exists_correlated", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000.0)")
dialect("not_exists_correlated", "SELECT n_name FROM nation n WHERE NOT EXISTS (SELECT s_suppkey FROM supplier WHERE s_nationkey = n.n_nationkey AND s_acctbal > 8000.0)")
dialect("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey > 20) AND NOT EXISTS (SELECT * FROM nation WHERE n_nationkey > 99)")
dialect("in_grouped_select", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)")

# Set operations

dialect("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
dialect("union_all_dialect", "SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, COUNT(*) FROM supplier GROUP BY s_nationkey")
dialect("intersect_rows", "SELECT c_nationkey FROM customer WHERE c_acctbal > 9000.0 INTERSECT SELECT s_nationkey FROM supplier")
dialect("except_rows", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000.0")
dialect("except_all_rows", "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_orderkey < 500")
dialect("set_order_limit", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region ORDER BY v DESC LIMIT 6 OFFSET 2")

query("union_all", lambda t: t("nation").select(col("n_name").alias("v")).unionAll(t("region").select("r_name")), "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region")

FLAGSHIP = (
    "SELECT l_returnflag, count(*) AS cnt, sum(l_quantity) AS sum_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE o_totalprice > 1000.0 GROUP BY l_returnflag HAVING count(*) > 1 ORDER BY l_returnflag"
)
dialect("flagship", FLAGSHIP)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


# Mutable tables: whole tables through LOAD, UPDATE and DELETE

_PART = (("p_partkey", "INT", 4), ("p_name", "CHAR", 200), ("p_size", "INT", 4), ("p_retailprice", "FLOAT", 4))


def _loaded(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """``part`` written as CSV and read by the LOAD rules."""
    rows = tables(spark, sf_dir)("part").select(*[c for c, _, _ in _PART])
    rows.write.option("header", True).option("quote", "\u0000").csv(f"{root}/csv")
    return read_rows(spark, f"{root}/csv", Table("part", _PART))


def load_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, scripts.new_root(spark)).select("p_partkey", "p_name", "p_size", F.round(col("p_retailprice").cast("double"), 1).alias("price"))


def dml_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scripts.new_root(spark)
    rows = tables(spark, sf_dir)("part").select("p_partkey", "p_size")
    rows.write.option("header", True).csv(f"{root}/csv")
    db = Session(spark, root)
    db.execute("create table part (p_partkey int, p_size int);")
    db.execute(f"load {root}/csv into part;")
    db.execute("create index part(p_partkey);")
    db.execute("update part set p_size = p_size + 100, p_partkey = -p_partkey where p_size > 25;")
    db.execute("delete from part where p_size < 10;")
    return db.sql("select p_partkey, p_size from part;")


QUERIES["load_csv_roundtrip"] = load_csv_roundtrip
ORACLE_SQL["load_csv_roundtrip"] = "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_size, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 1) AS price FROM part"
QUERIES["dml_update_delete"] = dml_update_delete
ORACLE_SQL["dml_update_delete"] = """
    SELECT CAST(CASE WHEN p_size > 25 THEN -p_partkey ELSE p_partkey END AS INTEGER) AS p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS p_size
    FROM part WHERE p_size >= 10"""

QUERIES.update(scripts.QUERIES)
ORACLE_SQL.update(scripts.ORACLE_SQL)
