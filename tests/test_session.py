"""Statements end to end: tables, keys, changes, transactions, formats."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from quarry import errors as E
from quarry.session import Session
from quarry.sources.catalog import Catalog, State, Table


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db", output=str(tmp_path / "output.txt"))


def rows(db, text):
    return sorted((tuple(r) for r in db.execute(text)), key=lambda r: [(v is not None, v) for v in r])


def harbour(db):
    for s in (
        "create table boats (boat_id int, boat_name char(20), pier_id int, length int);",
        "create table piers (pier_id int, pier_name char(30), keeper char(20));",
        "insert into boats values (11, 'gull', 7, 34);",
        "insert into boats values (12, 'heron', 8, 9);",
        "insert into boats values (13, 'tern', 7, 21);",
        "insert into boats values (14, 'plover', 9, 47);",
        "insert into piers values (7, 'north', 'ines');",
        "insert into piers values (8, 'quay', 'otto');",
        "insert into piers values (9, 'spit', 'ines');",
    ):
        db.execute(s)


def test_join_group_and_explain(db):
    harbour(db)
    q = "select boat_name from boats, piers where boats.pier_id = piers.pier_id and length > 20 and keeper = 'ines'"
    assert rows(db, q + ";") == [("gull",), ("plover",), ("tern",)]
    assert rows(db, "select keeper, count(*) as n, avg(length) as a from boats join piers on boats.pier_id = piers.pier_id group by keeper having count(*) > 1;") == [("ines", 3, 34.0)]
    assert rows(db, "select pier_name from piers semi join boats on piers.pier_id = boats.pier_id and length > 20;") == [("north",), ("spit",)]
    db.execute("create index boats(pier_id, boat_id);")
    assert db.execute(f"explain {q};").text == (
        "Project(columns=[boats.boat_name])\n\tJoin(tables=[boats,piers],condition=[boats.pier_id=piers.pier_id])\n\t\tSeqScan(table=boats)\n\t\tSeqScan(table=piers)\n"
    )
    assert db.execute("explain select * from boats where pier_id = 7 order by length desc limit 2;").text == (
        "Project(columns=[*])\n\tSort(columns=[boats.length DESC], limit=2)\n\t\tIndexScan(table=boats, index=[pier_id,boat_id])\n"
    )
    assert db.execute("explain select boat_id from boats, piers where boats.pier_id = piers.pier_id and piers.pier_id = 7;").text.count("IndexScan") == 1
    assert [r[0] for r in db.execute("select boat_name from boats order by length desc limit 2;")] == ["plover", "gull"]
    assert [tuple(r) for r in db.execute("select pier_id, max(length) as m from boats group by pier_id order by m desc limit 1;")] == [(9, 47)]
    assert rows(db, "select a.boat_name, b.boat_name from boats a, boats b where a.pier_id = b.pier_id and a.boat_id < b.boat_id;") == [("gull", "tern")]


def test_changes_and_keys(db):
    db.execute("create table t (id int, f float, c char(4));")
    db.execute("create index t(id);")
    for k in range(4):
        db.execute(f"insert into t values ({k}, {k}.5, 'r{k}');")
    with pytest.raises(E.UniqueCheckError):
        db.execute("insert into t values (1, 0, 'x');")
    with pytest.raises(E.StringOverflowError):
        db.execute("insert into t values (9, 0, 'toolong');")
    with pytest.raises(E.InvalidValueCountError):
        db.execute("insert into t values (9, 0);")
    with pytest.raises(E.IncompatibleTypeError):
        db.execute("insert into t values ('a', 0, 'x');")
    with pytest.raises(E.IncompatibleTypeError):
        db.execute("select * from t where id = 'abc';")
    with pytest.raises(E.UniqueCheckError):
        db.execute("update t set id = 2 where id = 1;")
    db.execute("update t set id = id + 10, f = id / 4, c = c + '!' where id >= 2;")
    assert rows(db, "select * from t;") == [(0, 0.5, "r0"), (1, 1.5, "r1"), (12, 3.0, "r2!"), (13, 3.25, "r3!")]
    with pytest.raises(E.EvaluationError):
        db.execute("update t set f = 1 / id;")
    db.execute("delete from t where f > 1.6;")
    assert rows(db, "select id from t where f = 1.5;") == [(1,)]
    db.execute("delete from t;")
    assert rows(db, "select count(*) as n, sum(id) as s from t;") == [(0, None)]
    with pytest.raises(E.IndexExistsError):
        db.execute("create index t(id);")
    db.execute("drop index t(id);")
    with pytest.raises(E.IndexNotFoundError):
        db.execute("drop index t(id);")
    db.execute("drop table t;")
    with pytest.raises(E.TableNotFoundError):
        db.execute("select * from t;")


def test_simultaneous_set(spark, tmp_path):
    for flag, want in ((False, [(2, 2)]), (True, [(2, 1)])):
        db = Session(spark, f"file://{tmp_path}/{flag}", simultaneous_set=flag)
        db.execute("create table p (a int, b int);")
        db.execute("insert into p values (1, 2);")
        db.execute("update p set a = b, b = a;")
        assert rows(db, "select * from p;") == want


def test_transactions(spark, tmp_path):
    one, two = (Session(spark, f"file://{tmp_path}/db") for _ in range(2))
    one.execute("create table berths (id int, data char(20));")
    one.execute("insert into berths values (1, 'a');")
    one.execute("begin;")
    one.execute("update berths set data = 'b' where id = 1;")
    one.execute("update berths set data = data + 'c';")
    assert rows(one, "select data from berths;") == [("bc",)]
    assert rows(two, "select data from berths;") == [("a",)]
    two.execute("begin;")
    two.execute("insert into berths values (2, 'z');")
    one.execute("commit;")
    with pytest.raises(E.TransactionAbortError, match="abort"):
        two.execute("commit;")
    assert rows(two, "select id, data from berths;") == [(1, "bc")]
    two.execute("begin;")
    two.execute("delete from berths;")
    assert rows(two, "select id from berths;") == []
    two.execute("rollback;")
    assert rows(two, "select id from berths;") == [(1,)]
    two.execute("begin;")
    two.execute("insert into berths values (3, 'q');")
    two.execute("begin;")  # commits the open one
    two.execute("abort;")
    assert rows(one, "select id from berths;") == [(1,), (3,)]


def test_load(db, tmp_path):
    (tmp_path / "a.csv").write_text('k,f,c\n1,3.9,abcdefg\n2x,-1.5e1,"q\n3,1\n4,7,zz,extra\nk,f,c\n')
    db.execute("create table l (k int, f float, c char(4));")
    db.execute(f"load {tmp_path}/a.csv into l;")
    got = rows(db, "select * from l;")
    assert [(k, round(f, 3), c) for k, f, c in got] == [(0, 0.0, "c"), (1, 3.9, "abcd"), (2, -15.0, '"q'), (4, 7.0, "zz")]
    db.execute("create index l(k);")
    with pytest.raises(E.UniqueCheckError):
        db.execute(f"load {tmp_path}/a.csv into l;")
    assert len(rows(db, "select * from l;")) == 4
    with pytest.raises(E.TableNotFoundError):
        db.execute(f"load {tmp_path}/a.csv into nothing;")


def test_descriptions_knobs_and_formats(db, tmp_path):
    harbour(db)
    assert [r for r in db.execute("show tables;")] == [("boats",), ("piers",)]
    db.execute("create index piers(pier_id);")
    assert list(db.execute("show index from piers;")) == [("piers", "unique", "(pier_id)")]
    assert list(db.execute("desc piers;"))[0] == ("pier_id", "INT", "YES")
    db.execute("set enable_sortmerge = true;")
    db.execute("set enable_nestloop = false;")
    frame = db.sql("select boat_name from boats join piers on boats.pier_id = piers.pier_id;")
    assert "SortMergeJoin" in frame._jdf.queryExecution().executedPlan().toString()
    db.execute("set enable_sortmerge = false;")
    with pytest.raises(E.QuarryError, match="No join executor"):
        db.execute("select boat_name from boats, piers;")
    text = db.execute("select boat_id, boat_name from boats where boat_id = 11;").table()
    rule = "+------------------+------------------+\n"
    assert text == rule + "|          boat_id |        boat_name |\n" + rule + "|               11 |             gull |\n" + rule + "Total record(s): 1\n"
    assert (tmp_path / "output.txt").read_text().endswith("failure\n| boat_id | boat_name |\n| 11 | gull |\n")
    db.execute("set output_file off")
    db.execute("select boat_id from boats;")
    assert not (tmp_path / "output.txt").read_text().endswith("14 |\n")
    assert "CREATE TABLE" in db.execute("help").text
    assert "version" in db.execute("create static_checkpoint;").text


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select nope from boats;", E.ColumnNotFoundError),
        ("select pier_id from boats, piers;", E.AmbiguousColumnError),
        ("select sum(boat_name) from boats;", E.IncompatibleTypeError),
        ("select boat_name, count(*) from boats group by pier_id;", E.InvalidAggregateError),
        ("select boat_name from boats having boat_id > 1;", E.InvalidAggregateError),
        ("select boat_name from boats group by boat_name order by length;", E.InvalidAggregateError),
        ("select piers.keeper from boats semi join piers on boats.pier_id = piers.pier_id;", E.ColumnNotFoundError),
        ("select x from a x, b x;", E.TableNotFoundError),
        ("select from boats;", E.SyntaxProblem),
        ("create table boats (a int);", E.TableExistsError),
    ],
)
def test_errors(db, text, error):
    harbour(db)
    with pytest.raises(error):
        db.execute(text)


def test_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    start = Catalog(spark, root).state()

    def commit(k):
        name = f"own{k}" if k < 6 else "both"  # six tables of their own, two that meet
        try:
            return Catalog(spark, root).publish(start, {name: Table(name, (("a", "INT", 4),), files=(str(k),))}).version
        except E.TransactionAbortError:
            return None

    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(commit, range(8)))
    assert sorted(v for v in versions if v) == list(range(1, 8)) and versions[6:].count(None) == 1
    state = Catalog(spark, root).state()
    assert isinstance(state, State) and sorted(state.tables) == ["both", *(f"own{k}" for k in range(6))]


def test_publish_where_creating_is_atomic(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/db")
    for scheme in ("file", "hdfs", "gs"):
        catalog._scheme = scheme
        path = f"file://{tmp_path}/db/_manifests/{scheme}.json"
        assert catalog._publish_file(path, "one") and not catalog._publish_file(path, "two") and catalog._read(path) == "one"


def test_clean_and_restore(db):
    harbour(db)
    version = int(db.execute("create static_checkpoint;").text.split()[-1])
    db.execute("update boats set length = 0;")
    db.execute("drop table piers;")
    assert db.catalog.clean() == 0 and db.catalog.clean(older_than=-60) > 0
    assert rows(db, "select sum(length) as s from boats;") == [(0,)]
    db.execute(f"restore static_checkpoint {version};")
    assert rows(db, "select sum(length) as s from boats;") == [(111,)] and rows(db, "select count(*) as n from piers;") == [(3,)]
    with pytest.raises(E.QuarryError, match="no checkpoint"):
        db.execute("restore static_checkpoint 999;")


def test_index_orders_files(spark, db, tmp_path):
    db.execute("create table t (k int, v int);")
    db.append("t", spark.range(20_000).selectExpr("CAST(id * 7919 % 20000 AS INT)", "CAST(id AS INT)").repartition(3))
    db.execute("create index t(k);")
    frame = db.catalog.frame(db.state().table("t"))
    spans = sorted((r[1], r[2]) for r in frame.selectExpr("k", "_metadata.file_path AS f").groupBy("f").agg({"k": "min"}).join(frame.selectExpr("k", "_metadata.file_path AS f").groupBy("f").agg({"k": "max"}), "f").collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and rows(db, "select v from t where k = 7919;") == [(1,)]
    with pytest.raises(E.UniqueCheckError):
        db.append("t", spark.createDataFrame([(5, 5)], "a int, b int"))


def test_subqueries_with_nulls(db):
    db.execute("create table a (x int);")
    db.execute("create table b (y int, z int);")
    db.execute("insert into a values (1), (2), (NULL);")
    assert rows(db, "select x from a where x not in (select y from b) and x > 0;") == [(1,), (2,)]
    assert rows(db, "select x from a where x not in (select y from b);") == [(None,), (1,), (2,)]  # nothing to be compared with
    db.execute("insert into b values (2, 5);")
    assert rows(db, "select x from a where x not in (select y from b);") == [(1,)]
    assert rows(db, "select x from a where x in (select y from b where exists (select x from a where x = 1));") == [(2,)]
    db.execute("insert into b values (NULL, 6);")
    assert rows(db, "select x from a where x not in (select y from b);") == []
    assert rows(db, "select x from a where x not in (select y from b where z = 6 and x = 1);") == rows(db, "select x from a where x > 1 or x is null;")
    for bad in ("select x from a where x = 1 or x in (select y from b);", "select x from a where x in (select y, z from b);", "select x from a where x in (select max(y) from b where z = x);", "select x, x from a union select y from b;"):
        with pytest.raises(E.QuarryError):
            db.execute(bad)


@pytest.mark.parametrize("call", ["upper(boat_name, boat_name)", "round()", "round(length, 1, 2)", "substring(boat_name, 1)", "abs(boat_name)", "length(length)", "nothing(1)"])
def test_calls_are_checked(db, call):
    harbour(db)
    with pytest.raises(E.QuarryError):
        db.execute(f"select {call} from boats;")


def test_long_results_are_counted_not_moved(spark, db):
    db.execute("create table t (k int);")
    db.append("t", spark.range(5000).selectExpr("CAST(id AS INT)"))
    text = db.execute("select k from t order by k;").table()
    assert text.endswith("... ...\nTotal record(s): 5000\n") and len(text) <= 8192 and "|                0 |" in text
