"""Registered queries that run statements: definitions, changes, transactions and an order-entry workload.

Each works in a database of its own in the shared folder, filled from whole driver tables, and
returns what its statements leave behind.  Literals and names of tables stand for a
client's; the SQL beside each query says the same over the driver tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuarryError
from ..session import Result, Session, select_frames
from ..sources.catalog import shared_folder
from . import invariants

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def new_root(spark: SparkSession) -> str:
    """A folder for a database, deleted when the application ends."""
    root = f"{shared_folder(spark)}/db-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def script(sql: str) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, sql
        return run

    return add


def execute(db: Session, statements: str) -> list[Result]:
    return [db.execute(s) for s in statements.split(";") if s.strip()]


def listed(spark: SparkSession, *results: Result) -> DataFrame:
    """Rows that a session made on the driver, with their place."""
    rows = [(k, n, " | ".join(str(v) for v in row)) for k, r in enumerate(results) for n, row in enumerate(r)]
    return spark.createDataFrame(rows, "part int, place int, shown string")


def errors(spark: SparkSession, db: Session, statements: list[str]) -> DataFrame:
    """The statements and the class of the error that each gives."""
    rows = []
    for s in statements:
        try:
            db.execute(s)
            rows.append((s, "none"))
        except QuarryError as e:
            rows.append((s, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")


def values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Definitions and descriptions


@script(
    values(
        [(0, 0, "port"), (0, 1, "ship"), (1, 0, "ship_id | INT | YES"), (1, 1, "label | CHAR(12) | NO"), (1, 2, "port_id | INT | YES"), (1, 3, "load | FLOAT | NO")]
        + [(2, 0, "ship | unique | (ship_id)"), (2, 1, "ship | unique | (port_id,ship_id)"), (3, 0, "ship | unique | (ship_id)")],
        "part, place, shown",
    )
)
def ddl_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE and DROP of tables and indexes, seen through SHOW TABLES, DESC and SHOW INDEX."""
    db = Session(spark, new_root(spark))
    execute(db, "create table ship (ship_id int, label char(12), port_id int, load float); create table port (port_id int); create table crew (name varchar(9)); drop table crew")
    execute(db, "create index ship (ship_id); create index ship (port_id, ship_id)")
    before = execute(db, "show tables; desc ship; show index from ship")
    after = execute(db, "drop index ship (port_id, ship_id); show index from ship")[-1]
    return listed(spark, *before, after)


_WRONG = [
    ("select nothing_here from ship", "ColumnNotFoundError"),
    ("select port_id from ship, port where ship.port_id = port.port_id", "AmbiguousColumnError"),
    ("select label from ship order by label limit x", "SyntaxProblem"),
    ("select sum(label) from ship", "IncompatibleTypeError"),
    ("select label, count(*) from ship group by port_id", "InvalidAggregateError"),
    ("select port_id from ship group by port_id order by label", "InvalidAggregateError"),
    ("select upper(label, label) from ship", "QuarryError"),
    ("select upper(ship_id) from ship", "IncompatibleTypeError"),
    ("insert into ship values (1, 'a label too long', 2, 0.5)", "StringOverflowError"),
    ("insert into ship values (1, 'short')", "InvalidValueCountError"),
    ("insert into ship values ('one', 'short', 2, 0.5)", "IncompatibleTypeError"),
    ("create table ship (ship_id int)", "TableExistsError"),
    ("drop table boat", "TableNotFoundError"),
    ("create index ship (ship_id)", "IndexExistsError"),
    ("drop index ship (label)", "IndexNotFoundError"),
    ("select ship_id from ship where load > 0 -- a note\n and /* another */ label <> 'x'", "none"),
]


@script(values(_WRONG, "statement, error"))
def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution, types, grouping, arity and existence are checked before anything runs."""
    db = Session(spark, new_root(spark))
    execute(db, "create table ship (ship_id int, label char(12), port_id int, load float); create table port (port_id int); create index ship (ship_id)")
    return errors(spark, db, [s for s, _ in _WRONG])


@script(
    values(
        [
            (0, 0, "Project(columns=[port.name,ship.label])"),
            (0, 1, "\tSort(columns=[ship.label ASC], limit=5)"),
            (0, 2, "\t\tJoin(tables=[port,ship],condition=[ship.port_id=port.port_id])"),
            (0, 3, "\t\t\tIndexScan(table=ship, index=[ship_id])"),
            (0, 4, "\t\t\tSeqScan(table=port)"),
            (1, 0, "IndexScan(table=ship, index=[ship_id])"),
            (2, 0, "SeqScan(table=ship)"),
            (3, 0, "Insert(table=port)"),
            (3, 1, "\tValues(rows=1)"),
            (4, 0, "Load(table=port, file=/data/ports.csv)"),
        ],
        "part, place, shown",
    )
)
def explain_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a join, a change, a deletion, an INSERT and a LOAD."""
    db = Session(spark, new_root(spark))
    execute(db, "create table ship (ship_id int, label char(12), port_id int); create table port (port_id int, name char(12)); create index ship (ship_id)")
    shown = execute(
        db,
        "explain select label, name from ship join port on ship.port_id = port.port_id where ship_id = 4 order by label limit 5; explain update ship set label = 'x' where ship_id > 3;"
        "explain delete from ship where label = 'x'; explain insert into port values (1, 'a'); explain load /data/ports.csv into port",
    )
    return listed(spark, *(Result(columns=["line"], rows=[(x,) for x in r.text.splitlines()]) for r in shown))


@script(values([(0, 0, "| n_regionkey | n |"), (0, 1, "| 1 | 5 |"), (0, 2, "| 3 | 5 |"), (0, 3, "failure"), (0, 4, "| n_name |"), (0, 5, "| NATION_18 |")], "part, place, shown"))
def output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET OUTPUT_FILE: results and failures are written to the session's file while it is on."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the client's own file
        db = Session(spark, new_root(spark), output=f"{folder}/output.txt")
        db.execute("create table nation (n_nationkey int, n_name char(25), n_regionkey int)")
        db.append("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
        db.execute("select n_regionkey, count(*) as n from nation where n_regionkey = 1 or n_regionkey = 3 group by n_regionkey order by n_regionkey")
        try:
            db.execute("select n_name from no_such_table")
        except QuarryError:
            pass
        execute(db, "select n_name from nation where n_nationkey = 18; set output_file off; select n_name from nation")
        with open(f"{folder}/output.txt", encoding="utf-8") as f:
            return listed(spark, Result(columns=["line"], rows=[(x,) for x in f.read().splitlines()]))


@script(values([(0, "COUNT(*)"), (1, "MAX(n_nationkey)"), (2, "COUNT(DISTINCT n_name)"), (3, "n_regionkey"), (4, "who")], "place, name"))
def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of columns without an alias."""
    frame = select_frames("select count(*), max(n_nationkey), count(distinct n_name), n_regionkey, n_regionkey as who from nation group by n_regionkey", lambda t: table(spark, sf_dir, t))
    return spark.createDataFrame(list(enumerate(frame.columns)), "place int, name string")


@script("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT -1, 'No join executor selected!'")
def join_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort-merge only, then neither kind of join."""
    db = Session(spark, new_root(spark))
    execute(db, "create table supplier (s_suppkey int, s_nationkey int); create table nation (n_nationkey int, n_name char(25))")
    db.append("supplier", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    db.append("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    execute(db, "set enable_sortmerge = true; set enable_nestloop = false")
    joined = "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey"
    frame = db.sql(joined)
    db.execute("set enable_sortmerge = false")
    try:
        db.execute(joined)
        said = ""
    except QuarryError as e:
        said = str(e)
    return frame.select(F.col("s_suppkey").cast("long"), "n_name").unionAll(spark.createDataFrame([(-1, said)], "s_suppkey long, n_name string"))


# Changes


@script(
    """SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, CAST(n_regionkey AS INTEGER) AS region FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')
    UNION ALL SELECT * FROM (VALUES (100, 'HERE', 7), (101, NULL, NULL), (102, 'it''s', NULL), (103, NULL, -3))"""
)
def insert_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT of values, of several rows, with a column list, and of a SELECT with a subquery."""
    db = Session(spark, new_root(spark))
    execute(db, "create table nation (n_nationkey int, n_name char(25), n_regionkey int); create table region (r_regionkey int, r_name char(25)); create table place (id int, name char(25), region int); create index place (id)")
    db.append("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    db.append("region", table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    execute(
        db,
        "insert into place values (100, 'HERE', 7); insert into place (id) values (101); insert into place (name, id) values ('it''s', 102); insert into place (region, id) values (-3, 103);"
        "insert into place select n_nationkey, n_name, n_regionkey from nation where n_regionkey in (select r_regionkey from region where r_name < 'B')",
    )
    return db.sql("select id, name, region from place")


@script("SELECT CAST(s_suppkey AS INTEGER) AS k, s_name AS name FROM supplier WHERE s_suppkey <= 50 UNION ALL SELECT 60, 'again'")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that would break a unique key change nothing."""
    db = Session(spark, new_root(spark))
    execute(db, "create table supplier (k int, name char(25)); create index supplier (k)")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    db.append("supplier", rows.where("s_suppkey <= 50"))
    db.execute("insert into supplier values (60, 'again')")
    for again in (lambda: db.append("supplier", rows.where("s_suppkey <= 9")), lambda: db.execute("insert into supplier values (60, 'x')"), lambda: db.execute("update supplier set k = 1 where k = 2")):
        try:
            again()
            raise AssertionError("a unique key was broken")
        except QuarryError:
            pass
    return db.sql("select k, name from supplier")


@script("SELECT CAST(c_custkey AS INTEGER) AS k, CAST(c_nationkey AS INTEGER) AS n FROM customer WHERE c_nationkey = 3 OR c_custkey BETWEEN 10 AND 20")
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index orders the files of its table; a lookup by the first columns reads few of them."""
    db = Session(spark, new_root(spark))
    execute(db, "create table customer (k int, n int); create table other (k int, n int)")
    db.append("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    db.append("other", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    execute(db, "create index customer (n, k); create index other (k)")
    return db.sql("select k, n from customer where n = 3 union select k, n from other where k between 10 and 20")


# Transactions


def _parts(spark: SparkSession, sf_dir: str) -> tuple[str, Session]:
    root = new_root(spark)
    db = Session(spark, root)
    db.execute("create table part (k int, size int)")
    db.append("part", table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return root, db


@script("SELECT 'own' AS seen, count(*) AS n, CAST(sum(p_size + 1) AS BIGINT) AS total FROM part WHERE p_size > 10 UNION ALL SELECT 'others', count(*), CAST(sum(p_size) AS BIGINT) FROM part UNION ALL SELECT 'after', count(*), CAST(sum(p_size + 1) AS BIGINT) FROM part WHERE p_size > 10")
def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction sees its own changes, others see them after COMMIT."""
    root, db = _parts(spark, sf_dir)
    look = lambda s, who: s.sql("select count(*) as n, sum(size) as total from part").select(F.lit(who).alias("seen"), "n", "total")
    execute(db, "begin; delete from part where size <= 10; update part set size = size + 1")
    own, others = look(db, "own"), look(Session(spark, root), "others")
    db.execute("commit")
    return own.unionAll(others).unionAll(look(Session(spark, root), "after"))


@script("SELECT CAST(p_partkey AS INTEGER) AS k, CAST(p_size AS INTEGER) AS size FROM part UNION ALL SELECT -1, -1")
def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROLLBACK and ABORT leave nothing; BEGIN commits what was open."""
    _, db = _parts(spark, sf_dir)
    execute(db, "begin; delete from part; rollback; begin; update part set size = 0; abort")
    execute(db, "begin; insert into part values (-1, -1); begin; insert into part values (-2, -2); rollback")
    return db.sql("select k, size from part")


@script("SELECT CAST(p_partkey AS INTEGER) AS k, CAST(CASE WHEN p_partkey <= 100 THEN p_size + 1000 ELSE p_size END AS INTEGER) AS size FROM part UNION ALL SELECT -1, 1")
def transaction_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transactions that change a table the first to commit wins, the other is aborted as a whole."""
    root, one = _parts(spark, sf_dir)
    two = Session(spark, root)
    execute(one, "begin; update part set size = size + 1000 where k <= 100")
    execute(two, "begin; delete from part where k > 5; insert into part values (7, 7)")
    one.execute("commit")
    try:
        two.execute("commit")
        lost = 0
    except QuarryError as e:
        lost = int("abort" in str(e))
    two.execute(f"insert into part values (-1, {lost})")
    return two.sql("select k, size from part")


@script("SELECT CAST(p_partkey AS INTEGER) AS k, CAST(p_size AS INTEGER) AS size FROM part WHERE p_size < 20")
def checkpoint_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint keeps the files of its version, also when others are cleaned up."""
    root, db = _parts(spark, sf_dir)
    execute(db, "delete from part where size >= 20; create table gone (a int)")
    version = int(db.execute("create static_checkpoint").text.split()[-1])
    execute(db, "update part set size = -1; drop table gone; create table late (a int)")
    db.catalog.clean(older_than=-60)
    db.execute(f"restore static_checkpoint {version}")
    assert [r for r in Session(spark, root).execute("show tables")] == [("gone",), ("part",)]
    return Session(spark, root).sql("select k, size from part")


# Order entry: five kinds of transactions over one schema

_LINES = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey"
#: The schema's tables as SQL over the driver tables; the same in DuckDB and Spark.
ORDER_ENTRY = {
    "warehouse": ("w_id int, w_name char(25), w_ytd int", "SELECT r_regionkey AS w_id, r_name AS w_name, 0 AS w_ytd FROM region"),
    "district": (
        "d_w_id int, d_id int, d_name char(25), d_ytd int, d_next_o_id int",
        "SELECT n_regionkey AS d_w_id, n_nationkey AS d_id, n_name AS d_name, 0 AS d_ytd, coalesce(m, 0) + 1 + CASE WHEN n_nationkey = 4 THEN 1 ELSE 0 END AS d_next_o_id "
        "FROM nation LEFT JOIN (SELECT c_nationkey AS cn, max(o_orderkey) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) x ON n_nationkey = cn",
    ),
    "customer": (
        "c_w_id int, c_d_id int, c_id int, c_last char(25), c_credit char(25), c_balance int, c_payment_cnt int",
        "SELECT n_regionkey AS c_w_id, c_nationkey AS c_d_id, c_custkey AS c_id, c_name AS c_last, c_mktsegment AS c_credit, CAST(floor(c_acctbal) AS INT) AS c_balance, 0 AS c_payment_cnt "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "orders": (
        "o_w_id int, o_d_id int, o_id int, o_c_id int, o_carrier_id int, o_ol_cnt int",
        "SELECT n_regionkey AS o_w_id, c_nationkey AS o_d_id, o_orderkey AS o_id, o_custkey AS o_c_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 1 END AS o_carrier_id, "
        f"coalesce(n, 0) + CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END AS o_ol_cnt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ({_LINES}) x ON o_orderkey = l_orderkey",
    ),
    "new_orders": (
        "no_w_id int, no_d_id int, no_o_id int",
        "SELECT n_regionkey AS no_w_id, c_nationkey AS no_d_id, o_orderkey AS no_o_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'",
    ),
    "order_line": (
        "ol_w_id int, ol_d_id int, ol_o_id int, ol_number int, ol_i_id int, ol_quantity int, ol_amount int, ol_delivered int",
        "SELECT n_regionkey AS ol_w_id, c_nationkey AS ol_d_id, l_orderkey AS ol_o_id, l_linenumber AS ol_number, l_partkey AS ol_i_id, CAST(l_quantity AS INT) AS ol_quantity, "
        "CAST(floor(l_extendedprice) AS INT) AS ol_amount, 0 AS ol_delivered FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "item": ("i_id int, i_name char(60), i_price int", "SELECT p_partkey AS i_id, p_name AS i_name, CAST(floor(p_retailprice) AS INT) AS i_price FROM part"),
    "stock": ("s_w_id int, s_i_id int, s_quantity int, s_order_cnt int", "SELECT r_regionkey AS s_w_id, p_partkey AS s_i_id, p_size + r_regionkey AS s_quantity, 0 AS s_order_cnt FROM part, region"),
    "history": ("h_c_id int, h_d_id int, h_w_id int, h_amount int", None),
}


def order_entry(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A database with some tables of the schema."""
    db = Session(spark, new_root(spark))
    sources = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem", "part")}
    for name in names:
        columns, sql = ORDER_ENTRY[name]
        db.execute(f"create table {name} ({columns})")
        if sql:
            db.append(name, spark.sql(_named(sql), **sources))
    return db


def _named(sql: str) -> str:
    """The SQL with its driver tables as parameters of ``spark.sql``."""
    import re

    return re.sub(r"\b(FROM|JOIN) (region|nation|customer|orders|lineitem|part)\b", r"\1 {\2}", sql.replace("FROM part, region", "FROM part CROSS JOIN region"))


def over(*names: str) -> str:
    """The tables as common table expressions of the SQL beside a query."""
    return "WITH " + ", ".join(f"t_{n} AS ({ORDER_ENTRY[n][1]})" for n in names) + " "


@script(
    over("district", "orders", "new_orders", "order_line", "stock", "customer", "item")
    + """SELECT 'district' AS what, CAST(d_id AS INTEGER) AS a, CAST(d_next_o_id + CASE WHEN d_w_id = 1 AND d_id = 2 THEN 1 ELSE 0 END AS INTEGER) AS b FROM t_district
    UNION ALL SELECT 'orders', 900001, 2 UNION ALL SELECT 'new', 900001, 2
    UNION ALL SELECT 'line', CAST(i_id AS INTEGER), CAST(i_price * 5 AS INTEGER) FROM t_item WHERE i_id IN (11, 12)
    UNION ALL SELECT 'stock', CAST(s_i_id AS INTEGER), CAST(CASE WHEN s_w_id = 1 AND s_i_id IN (11, 12) THEN CASE WHEN s_quantity > 15 THEN s_quantity - 5 ELSE s_quantity + 86 END ELSE s_quantity END AS INTEGER) FROM t_stock WHERE s_i_id < 20
    UNION ALL SELECT 'customer', CAST(c_id AS INTEGER), CAST(c_balance AS INTEGER) FROM t_customer WHERE c_id = 5"""
)
def order_entry_new_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of two lines: the district counts up, stock goes down, order, lines and open order are added."""
    db = order_entry(spark, sf_dir, "district", "orders", "new_orders", "order_line", "stock", "customer", "item")
    # what the tables hold under the order's key, and held before: a large enough folder has an order of that number
    entered = (
        "select 'orders' as what, o_id as a, o_ol_cnt as b from orders where o_w_id = 1 and o_d_id = 2 and o_id = 900001"
        " union all select 'new', no_o_id, no_d_id from new_orders where no_w_id = 1 and no_d_id = 2 and no_o_id = 900001"
        " union all select 'line', ol_i_id, ol_amount from order_line where ol_w_id = 1 and ol_d_id = 2 and ol_o_id = 900001"
    )
    before = db.sql(entered)
    execute(db, "begin; select d_next_o_id from district where d_w_id = 1 and d_id = 2; update district set d_next_o_id = d_next_o_id + 1 where d_w_id = 1 and d_id = 2")
    execute(db, "insert into orders values (1, 2, 900001, 5, NULL, 2); insert into new_orders values (1, 2, 900001)")
    for number, item in enumerate((11, 12), 1):
        db.execute(f"insert into order_line select 1, 2, 900001, {number}, i_id, 5, i_price * 5, 0 from item where i_id = {item}")
        db.execute(f"update stock set s_quantity = case when s_quantity > 15 then s_quantity - 5 else s_quantity + 86 end, s_order_cnt = s_order_cnt + 1 where s_w_id = 1 and s_i_id = {item}")
    db.execute("commit")
    return db.sql(
        "select 'district' as what, d_id as a, d_next_o_id as b from district"
        " union all select 'stock', s_i_id, s_quantity from stock where s_i_id < 20 union all select 'customer', c_id, c_balance from customer where c_id = 5"
    ).unionAll(db.sql(entered).exceptAll(before))


@script(
    over("warehouse", "district", "customer")
    + """SELECT 'warehouse' AS what, CAST(w_id AS INTEGER) AS a, CASE WHEN w_id = 2 THEN 350 ELSE 0 END AS b FROM t_warehouse
    UNION ALL SELECT 'district', CAST(d_id AS INTEGER), CASE WHEN d_w_id = 2 AND d_id = 12 THEN 350 ELSE 0 END FROM t_district
    UNION ALL SELECT 'customer', CAST(c_id AS INTEGER), CAST(c_balance - CASE WHEN c_d_id = 12 AND c_id = 40 THEN 350 ELSE 0 END AS INTEGER) FROM t_customer
    UNION ALL SELECT 'history', 40, 350"""
)
def order_entry_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment adds to warehouse and district, takes from the customer's balance and leaves a record."""
    db = order_entry(spark, sf_dir, "warehouse", "district", "customer", "history")
    execute(db, "begin; update warehouse set w_ytd = w_ytd + 350 where w_id = 2; update district set d_ytd = d_ytd + 350 where d_w_id = 2 and d_id = 12")
    execute(db, "update customer set c_balance = c_balance - 350, c_payment_cnt = c_payment_cnt + 1 where c_d_id = 12 and c_id = 40; insert into history values (40, 12, 2, 350); commit")
    return db.sql("select 'warehouse' as what, w_id as a, w_ytd as b from warehouse union all select 'district', d_id, d_ytd from district union all select 'customer', c_id, c_balance from customer union all select 'history', h_c_id, h_amount from history")


@script(
    over("orders", "order_line", "customer")
    + """SELECT c_last AS last, CAST(o_id AS INTEGER) AS o_id, CAST(ol_i_id AS INTEGER) AS item, ol_quantity AS q, ol_amount AS amount
    FROM t_customer JOIN t_orders ON o_c_id = c_id JOIN t_order_line ON ol_o_id = o_id WHERE o_id IN (SELECT max(o_id) FROM t_orders GROUP BY o_c_id) AND c_d_id = 12"""
)
def order_entry_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer of a district, with its lines."""
    db = order_entry(spark, sf_dir, "orders", "order_line", "customer")
    return db.sql(
        "select c_last as last, o_id, ol_i_id as item, ol_quantity as q, ol_amount as amount from customer, orders, order_line where o_c_id = c_id and ol_o_id = o_id"
        " and o_id in (select max(o_id) from orders group by o_c_id) and c_d_id = 12"
    )


@script(
    over("new_orders", "orders", "order_line", "customer")
    + """, x AS (SELECT min(no_o_id) AS o FROM t_new_orders WHERE no_w_id = 3)
    SELECT 'open' AS what, CAST(no_o_id AS INTEGER) AS a, CAST(no_d_id AS INTEGER) AS b FROM t_new_orders WHERE no_o_id <> (SELECT o FROM x)
    UNION ALL SELECT 'order', CAST(o_id AS INTEGER), CASE WHEN o_id = (SELECT o FROM x) THEN 9 ELSE o_carrier_id END FROM t_orders
    UNION ALL SELECT 'lines', CAST(ol_o_id AS INTEGER), CAST(count(*) AS INTEGER) FROM t_order_line WHERE ol_o_id = (SELECT o FROM x) GROUP BY ol_o_id
    UNION ALL SELECT 'customer', CAST(c_id AS INTEGER), CAST(c_balance + CASE WHEN c_id = (SELECT o_c_id FROM t_orders WHERE o_id = (SELECT o FROM x)) THEN (SELECT sum(ol_amount) FROM t_order_line WHERE ol_o_id = (SELECT o FROM x)) ELSE 0 END AS INTEGER) FROM t_customer"""
)
def order_entry_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open order of a warehouse is delivered: its open record goes, its lines are marked, its customer is charged."""
    db = order_entry(spark, sf_dir, "new_orders", "orders", "order_line", "customer")
    db.execute("begin")
    oldest = next(iter(db.execute("select min(no_o_id) as o from new_orders where no_w_id = 3")))[0]
    customer = next(iter(db.execute(f"select o_c_id from orders where o_id = {oldest}")))[0]
    total = next(iter(db.execute(f"select sum(ol_amount) as s from order_line where ol_o_id = {oldest}")))[0]
    execute(db, f"delete from new_orders where no_o_id = {oldest}; update orders set o_carrier_id = 9 where o_id = {oldest}; update order_line set ol_delivered = 1 where ol_o_id = {oldest}")
    execute(db, f"update customer set c_balance = c_balance + {total} where c_id = {customer}; commit")
    return db.sql(
        "select 'open' as what, no_o_id as a, no_d_id as b from new_orders union all select 'order', o_id, o_carrier_id from orders"
        " union all select 'lines', ol_o_id, sum(ol_delivered) from order_line where ol_delivered = 1 group by ol_o_id union all select 'customer', c_id, c_balance from customer"
    ).select("what", "a", F.col("b").cast("int").alias("b"))


@script(
    over("order_line", "stock", "district")
    + "SELECT count(DISTINCT s_i_id) AS low FROM t_district, t_order_line, t_stock WHERE d_w_id = 0 AND d_id = 5 AND ol_w_id = d_w_id AND ol_d_id = d_id AND ol_o_id < d_next_o_id AND ol_o_id >= d_next_o_id - 2000 AND s_w_id = ol_w_id AND s_i_id = ol_i_id AND s_quantity < 15"
)
def order_entry_stock_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of a district's recent orders run low."""
    db = order_entry(spark, sf_dir, "order_line", "stock", "district")
    return db.sql(
        "select count(distinct s_i_id) as low from district, order_line, stock where d_w_id = 0 and d_id = 5 and ol_w_id = d_w_id and ol_d_id = d_id"
        " and ol_o_id < d_next_o_id and ol_o_id >= d_next_o_id - 2000 and s_w_id = ol_w_id and s_i_id = ol_i_id and s_quantity < 15"
    )


def _entry_frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    sources = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem", "part")}
    return [spark.sql(_named(ORDER_ENTRY[n][1]), **sources) for n in names]


@script(
    over("district", "orders", "new_orders")
    + """SELECT d_w_id, d_id, d_next_o_id, m AS last_order, mn AS last_open FROM t_district LEFT JOIN (SELECT o_d_id, max(o_id) AS m FROM t_orders GROUP BY o_d_id) x ON d_id = o_d_id
    LEFT JOIN (SELECT no_d_id, max(no_o_id) AS mn FROM t_new_orders GROUP BY no_d_id) y ON d_id = no_d_id WHERE d_next_o_id - 1 <> coalesce(m, 0) OR mn > m"""
)
def check_next_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.next_order_ids(*_entry_frames(spark, sf_dir, "district", "orders", "new_orders"))


@script(
    over("orders", "order_line")
    + """SELECT coalesce(w, w2) AS w_id, coalesce(d, d2) AS d_id, CAST(announced AS BIGINT) AS announced, found
    FROM (SELECT o_w_id AS w, o_d_id AS d, sum(o_ol_cnt) AS announced FROM t_orders GROUP BY ALL) x FULL JOIN (SELECT ol_w_id AS w2, ol_d_id AS d2, count(*) AS found FROM t_order_line GROUP BY ALL) y ON w = w2 AND d = d2
    WHERE coalesce(announced, 0) <> coalesce(found, 0)"""
)
def check_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.line_counts(*_entry_frames(spark, sf_dir, "orders", "order_line"))


@script(over("new_orders") + "SELECT no_w_id, no_d_id, count(*) AS n, min(no_o_id) AS low, max(no_o_id) AS high FROM t_new_orders GROUP BY no_w_id, no_d_id HAVING count(*) <> max(no_o_id) - min(no_o_id) + 1")
def check_gapless_new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.gapless_new_orders(*_entry_frames(spark, sf_dir, "new_orders"))
