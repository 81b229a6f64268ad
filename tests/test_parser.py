"""One statement or more for each rule of the grammar, over the driver's tables."""

import pytest

from quarry.dialect import ast
from quarry.dialect.parser import parse
from quarry.errors import SyntaxProblem


def col(name, table=None):
    return ast.Col(name, table)


def test_definitions():
    made = parse("CREATE TABLE region (r_regionkey INT, r_name CHAR(25), r_score FLOAT, r_comment VARCHAR(40))")
    assert made == ast.CreateTable("region", (("r_regionkey", "INT", 4), ("r_name", "CHAR", 25), ("r_score", "FLOAT", 4), ("r_comment", "CHAR", 40)))
    assert parse("Drop Table region;") == ast.DropTable("region")
    assert parse("create index supplier (s_nationkey, s_suppkey)") == ast.CreateIndex("supplier", ("s_nationkey", "s_suppkey"))
    assert parse("create index by_nation on supplier (s_nationkey)") == ast.CreateIndex("supplier", ("s_nationkey",))
    assert parse("drop index supplier (s_nationkey)") == ast.DropIndex("supplier", ("s_nationkey",))
    assert (parse("desc lineitem"), parse("show tables"), parse("show index from orders")) == (ast.Desc("lineitem"), ast.ShowTables(), ast.ShowIndex("orders"))
    assert (parse("create static_checkpoint"), parse("restore static_checkpoint 17")) == (ast.Checkpoint(), ast.Checkpoint(17))


def test_changes():
    assert parse("insert into nation values (25, 'ATLANTIS', -1)") == ast.Insert("nation", ((25, "ATLANTIS", -1),))
    assert parse("insert into nation (n_name) values (NULL), ('A')").rows == ((None,), ("A",))
    copied = parse("insert into region (r_regionkey) select n_nationkey from nation where n_nationkey > 20")
    assert copied.columns == ("r_regionkey",) and copied.select.where == ast.Binary(">", col("n_nationkey"), ast.Lit(20))
    assert parse("delete from part") == ast.Delete("part")
    assert parse("delete from part where p_size <> 7").where == ast.Binary("<>", col("p_size"), ast.Lit(7))
    changed = parse("update part set p_size = p_size * 2 - 1, p_name = 'bolt' where p_brand = 'Brand#11'")
    assert changed.sets[1] == ("p_name", ast.Lit("bolt")) and changed.sets[0][1] == ast.Binary("-", ast.Binary("*", col("p_size"), ast.Lit(2)), ast.Lit(1))
    assert parse("load /srv/in/part.csv into part;") == ast.Load("/srv/in/part.csv", "part") and parse("LOAD 'a b.csv' INTO part").path == "a b.csv"


def test_session_statements():
    assert [parse(s).kind for s in ("begin", "COMMIT;", "rollback", "abort;")] == ["BEGIN", "COMMIT", "ROLLBACK", "ROLLBACK"]
    assert parse("set enable_nestloop = false") == ast.SetKnob("ENABLE_NESTLOOP", False) and parse("SET ENABLE_SORTMERGE = TRUE;").value
    assert (parse("set output_file on"), parse("set output_file off")) == (ast.SetOutput(True), ast.SetOutput(False))
    assert (parse("help"), parse("exit;"), parse("  -- only a note"), parse("")) == (ast.Help(), ast.Exit(), None, None)
    assert parse("explain delete from orders where o_orderkey = 3").statement == parse("delete from orders where o_orderkey = 3")
    assert parse("explain load /x/y.csv into orders").statement == ast.Load("/x/y.csv", "orders")


def test_select():
    s = parse("select distinct c_name as who, count(distinct o_orderkey) from customer c left outer join orders as o on c.c_custkey = o.o_custkey where c_acctbal >= 0 group by c_name having count(*) > 2 order by who desc, c_name limit 5 offset 10")
    assert s.distinct and s.items == (ast.Item(col("c_name"), "who"), ast.Item(ast.Agg("COUNT", col("o_orderkey"), True)))
    assert (s.first, s.joins[0].how, s.joins[0].ref) == (ast.TableRef("customer", "c"), "left", ast.TableRef("orders", "o"))
    assert s.group_by == (col("c_name"),) and s.having == ast.Binary(">", ast.Agg("COUNT", None), ast.Lit(2))
    assert (s.order_by, s.limit, s.offset) == (((col("who"), True), (col("c_name"), False)), 5, 10)
    kinds = ["semi join", "inner join", "right join", "full outer join", "cross join", ","]
    assert [parse(f"select * from region {k} nation").joins[0].how for k in kinds] == ["semi", "inner", "right", "full", "inner", "inner"]


def test_subqueries_and_set_operations():
    w = parse("select r_name from region where r_regionkey not in (select n_regionkey from nation) and exists (select * from nation) or not exists (select * from part)").where
    assert w.op == "OR" and w.left.left.negated and w.left.right.arg is None and w.right.op == "NOT"
    u = parse("select a from t union all select b from u intersect select c from v except select d from w order by 1 limit 3")
    assert (u.op, u.left.op, u.left.every, u.left.right.op, u.limit) == ("EXCEPT", "UNION", True, "INTERSECT", 3)


def test_expressions():
    s = parse("select l_tax from lineitem where l_tax > -2 + 3 * l_discount and not (l_linenumber in (1, 2) or l_returnflag like 'R%' or l_tax is null)")
    assert s.where.left == ast.Binary(">", col("l_tax"), ast.Binary("+", ast.Lit(-2), ast.Binary("*", ast.Lit(3), col("l_discount"))))
    parts = s.where.right.arg
    assert parts == ast.Binary("OR", ast.Binary("OR", ast.InList(col("l_linenumber"), (ast.Lit(1), ast.Lit(2))), ast.Like(col("l_returnflag"), "R%")), ast.IsNull(col("l_tax")))
    e = parse("select case p_size when 1 then 'one' else upper(p_name) end, round(p_retailprice, 1) from part where p_size between 1 and 9 and p_size is not null").items
    assert e[0].expr.subject == col("p_size") and e[0].expr.otherwise == ast.Func("UPPER", (col("p_name"),)) and e[1].expr.args[1] == ast.Lit(1)


@pytest.mark.parametrize(
    "text",
    ["select", "select r_name from", "insert into region", "insert into region values ()", "create table region (r_name blob)", "select # from region", "set speed = 1", "select r_name from region limit many", "select r_name from region where", "union select r_name from region", "delete region", "select a from t union b"],
)
def test_bad(text):
    with pytest.raises(SyntaxProblem):
        parse(text)
