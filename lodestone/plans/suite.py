"""Query registry: name -> query over a data folder, and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relops as R
from ..sources import catalog, storage
from . import predicate
from .cardinality import Statistics

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("sum", F.round("sum", digits))


T = catalog.table


@query("select * from nation")
def scan_all(spark, d):
    return T(spark, d, "nation")


@query("select * from orders where o_orderpriority='1-URGENT' and o_orderstatus='O' and o_totalprice>1015.68 and o_totalprice<9051.89")
def select_cnf_and(spark, d):
    return R.select(T(spark, d, "orders"), "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'O') AND (o_totalprice > 1015.68) AND (o_totalprice < 9051.89)")


@query("select * from lineitem where l_returnflag='R' and (l_discount<0.04 or l_linestatus='O')")
def select_cnf_or(spark, d):
    return R.select(T(spark, d, "lineitem"), "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'O')")


@query("select * from region where r_name<'MIDDLE EAST' and r_regionkey>1")
def select_string_range(spark, d):
    return R.select(T(spark, d, "region"), "(r_name < 'MIDDLE EAST') AND (r_regionkey > 1)")


@query("select * from lineitem where l_partkey<l_suppkey")
def select_attr_attr(spark, d):
    return R.select(T(spark, d, "lineitem"), "(l_partkey < l_suppkey)")


@query("select * from supplier where s_suppkey=s_suppkey")
def select_tautology(spark, d):
    return R.select(T(spark, d, "supplier"), "(s_suppkey = s_suppkey)")


@query("select * from supplier where 2500.0<s_acctbal")
def select_literal_left(spark, d):
    return R.select(T(spark, d, "supplier"), "(2500.0 < s_acctbal)")


@query("select * from orders where o_orderdate > timestamp '2000-01-01'")
def select_date(spark, d):
    return R.select(T(spark, d, "orders"), "(o_orderdate > '2000-01-01')")


@query("select * from (select * from orders where o_orderstatus='O') t where o_totalprice>400000.0")
def select_pipe(spark, d):
    return R.select(R.select(T(spark, d, "orders"), "(o_orderstatus = 'O')"), "(o_totalprice > 400000.0)")


@query("select p_partkey,p_name,p_retailprice from part where p_retailprice>931.0 and p_retailprice<931.31")
def project(spark, d):
    return R.project(R.select(T(spark, d, "part"), "(p_retailprice > 931.0) AND (p_retailprice < 931.31)"), [0, 1, 5])


@query("select s_acctbal,s_suppkey from supplier")
def project_reorder(spark, d):
    return R.project(T(spark, d, "supplier"), [3, 0])


@query("select distinct l_suppkey from lineitem where l_extendedprice<5000.0")
def distinct(spark, d):
    return R.distinct(R.select(T(spark, d, "lineitem"), "(l_extendedprice < 5000.0)").select("l_suppkey"))


@query("select distinct l_returnflag,l_linestatus from lineitem")
def distinct_all_attrs(spark, d):
    return R.distinct(T(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


@query("select round(sum(s_acctbal+(s_acctbal*1.05)),2) as sum from supplier")
def sum_double(spark, d):
    return _rounded(R.total(T(spark, d, "supplier"), "(s_acctbal + (s_acctbal * 1.05))"), 2)


@query("select cast(sum(l_linenumber) as bigint) as sum from lineitem")
def sum_int(spark, d):
    return R.total(T(spark, d, "lineitem"), "l_linenumber")


@query("select coalesce(sum(l_tax),0.0::double) as sum from lineitem where l_tax>99.0")
def sum_empty(spark, d):
    return R.total(R.select(T(spark, d, "lineitem"), "(l_tax > 99.0)"), "l_tax")


@query("select cast(sum(l_linenumber) as bigint) as sum from (select distinct l_linenumber from lineitem) t")
def sum_distinct(spark, d):
    return R.total(R.distinct(T(spark, d, "lineitem").select("l_linenumber")), "l_linenumber")


@query("select cast(sum(l_orderkey-(l_partkey-l_suppkey)) as bigint) as sum from lineitem")
def func_right_assoc(spark, d):
    return R.total(T(spark, d, "lineitem"), "l_orderkey - l_partkey - l_suppkey")


@query("select cast(sum(l_linenumber*(l_partkey+1)) as bigint) as sum from lineitem")
def func_no_precedence(spark, d):
    return R.total(T(spark, d, "lineitem"), "l_linenumber * l_partkey + 1")


@query("select round(sum(-(l_tax+l_discount)),4) as sum from lineitem")
def func_unary_minus(spark, d):
    return _rounded(R.total(T(spark, d, "lineitem"), "-l_tax + l_discount"), 4)


@query("select cast(sum(-(l_linenumber+l_partkey)) as bigint) as sum from lineitem")
def func_unary_minus_int(spark, d):
    return R.total(T(spark, d, "lineitem"), "-l_linenumber + l_partkey")


@query("select round(sum(l_tax*l_linenumber),4) as sum from lineitem")
def func_promote_right(spark, d):
    return _rounded(R.total(T(spark, d, "lineitem"), "l_tax * l_linenumber"), 4)


@query("select round(sum(l_linenumber-(l_quantity/2.0)),2) as sum from lineitem")
def func_mixed_types(spark, d):
    return _rounded(R.total(T(spark, d, "lineitem"), "l_linenumber - l_quantity / 2.0"), 2)


@query("select cast(sum(l_partkey // 7) as bigint) as sum from lineitem")
def int_div(spark, d):
    return R.total(T(spark, d, "lineitem"), "l_partkey / 7")


def _tables(spark, d, *names):
    return [T(spark, d, n) for n in names]


@query("select round(sum(l_extendedprice),2) as sum from supplier,lineitem where s_suppkey=l_suppkey")
def join_inner(spark, d):
    s, x = _tables(spark, d, "supplier", "lineitem")
    return _rounded(R.total(R.join(s, x, "(s_suppkey = l_suppkey)"), "l_extendedprice"), 2)


@query("select round(sum(l_extendedprice),2) as sum,s_nationkey from supplier,lineitem where s_suppkey=l_suppkey group by s_nationkey")
def join_groupby(spark, d):
    s, x = _tables(spark, d, "supplier", "lineitem")
    return _rounded(R.group_total(R.join(s, x, "(s_suppkey = l_suppkey)"), ["s_nationkey"], "l_extendedprice"), 2)


@query("select round(sum(l_extendedprice),2) as sum from part,supplier,lineitem where p_partkey=l_partkey and s_suppkey=l_suppkey and s_acctbal>2500.0")
def join_3way(spark, d):
    p, s, x = _tables(spark, d, "part", "supplier", "lineitem")
    rich = R.select(s, "(s_acctbal > 2500.0)")
    return _rounded(R.total(R.join(p, R.join(rich, x, "(s_suppkey = l_suppkey)"), "(p_partkey = l_partkey)"), "l_extendedprice"), 2)


@query("select s_suppkey,n_nationkey from supplier,nation where s_nationkey<n_nationkey")
def join_theta(spark, d):
    s, n = _tables(spark, d, "supplier", "nation")
    return R.join(s, n, "(s_nationkey < n_nationkey)").select("s_suppkey", "n_nationkey")


@query("select s_suppkey,r_regionkey from supplier,region")
def join_cross(spark, d):
    s, r = _tables(spark, d, "supplier", "region")
    return R.join(s, r).select("s_suppkey", "r_regionkey")


@query("select o_orderkey,l_linenumber from orders,lineitem where o_orderkey=l_orderkey and o_totalprice<l_extendedprice")
def join_residual(spark, d):
    o, x = _tables(spark, d, "orders", "lineitem")
    return R.join(o, x, "(o_orderkey = l_orderkey) AND (o_totalprice < l_extendedprice)").select("o_orderkey", "l_linenumber")


@query("select o_orderkey,l_linenumber from orders,lineitem where o_orderkey=l_orderkey and o_custkey=l_partkey")
def join_multikey(spark, d):
    o, x = _tables(spark, d, "orders", "lineitem")
    return R.join(o, x, "(o_orderkey = l_orderkey) AND (o_custkey = l_partkey)").select("o_orderkey", "l_linenumber")


@query("select s_suppkey,c_custkey from supplier,customer where s_nationkey=c_nationkey")
def join_many_many(spark, d):
    s, c = _tables(spark, d, "supplier", "customer")
    return R.join(s, c, "(s_nationkey = c_nationkey)").select("s_suppkey", "c_custkey")


@query("select count(*) as cnt from supplier s,nation n1,customer c,nation n2 where s.s_nationkey=n1.n_nationkey and c.c_nationkey=n2.n_nationkey and n1.n_nationkey=n2.n_nationkey")
def join_self_alias(spark, d):
    s, n, c = _tables(spark, d, "supplier", "nation", "customer")
    a = R.join(R.qualify(s, "s"), R.qualify(n, "n1"), "(s.s_nationkey = n1.n_nationkey)")
    b = R.join(R.qualify(c, "c"), R.qualify(n, "n2"), "(c.c_nationkey = n2.n_nationkey)")
    return R.join(a, b, "(n1.n_nationkey = n2.n_nationkey)").agg(F.count("*").alias("cnt"))


@query("select cast(sum(l_linenumber) as bigint) as sum,l_returnflag,l_linestatus from lineitem group by l_returnflag,l_linestatus")
def groupby_int(spark, d):
    return R.group_total(T(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber")


@query("select l_orderkey,l_linenumber,row_number() over (order by l_extendedprice,l_quantity,l_orderkey,l_linenumber,l_partkey,l_suppkey) as pos from lineitem")
def sort_multi(spark, d):
    keys = ["l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.with_position(T(spark, d, "lineitem").select(*keys), keys).select("l_orderkey", "l_linenumber", "pos")


@query("select n_nationkey,n_name,n_regionkey,row_number() over (order by n_nationkey,n_regionkey,n_name) as pos from nation")
def sort_all_attrs(spark, d):
    n = T(spark, d, "nation")
    return R.with_position(n, predicate.all_attributes(n))


@query("select concat('s_suppkey: [',s_suppkey,'], s_name: [',s_name,'], s_nationkey: [',s_nationkey,'], s_acctbal: [',printf('%f',s_acctbal),']') as line from supplier")
def writeout(spark, d):
    path = storage.scratch(spark, "rows")
    R.write_rows(T(spark, d, "supplier"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("select count(*) as t,count(distinct l_returnflag) as v_rf,count(distinct l_partkey) as v_pk from lineitem")
def stat_tv(spark, d):
    stats = Statistics()
    stats.collect("lineitem", T(spark, d, "lineitem"), ["l_returnflag", "l_partkey"])
    r = stats.relations["lineitem"]
    return spark.range(1).select(F.lit(r.tuples).cast("long").alias("t"), *[F.lit(r.distinct[a]).cast("long").alias(n) for n, a in (("v_rf", "l_returnflag"), ("v_pk", "l_partkey"))])


@query("select * from supplier")
def heap_roundtrip(spark, d):
    path = storage.scratch(spark, "heap")
    storage.create_heap(T(spark, d, "supplier"), path)
    return storage.open_table(spark, path)


@query("select * from customer")
def sorted_file_scan(spark, d):
    path = storage.scratch(spark, "sorted")
    storage.create_sorted(T(spark, d, "customer"), path, "(c_nationkey) AND (c_acctbal)")
    return storage.open_table(spark, path)


@query("select count(*) as checked, cast(0 as bigint) as errors from customer")
def sorted_file_order(spark, d):
    path = storage.scratch(spark, "sorted")
    storage.create_sorted(T(spark, d, "customer"), path, "(c_nationkey) AND (c_acctbal)")
    return storage.verify_order(spark, path)


@query("select count(*) as checked, cast(0 as bigint) as errors from orders")
def sorted_merge_order(spark, d):
    path, orders = storage.scratch(spark, "merged"), T(spark, d, "orders")
    storage.create_sorted(R.select(orders, "(o_totalprice < 250000.0)"), path, "(o_custkey) AND (o_orderkey)")
    storage.append(orders.filter("not o_totalprice < 250000.0"), path)
    return storage.verify_order(spark, path)


@query("select p_partkey, p_size, p_retailprice from part where p_size < 5")
def sort_output(spark, d):
    return R.sort(R.project(R.select(T(spark, d, "part"), "(p_size < 5)"), [0, 4, 5]), "(p_retailprice) AND (p_size)")


@query("select n_nationkey, n_name, n_regionkey from nation")
def record_from_string(spark, d):
    schema = catalog.schema_of("BEGIN nation nation.tbl n_nationkey Int n_name String n_regionkey Int END", "nation")
    lines = T(spark, d, "nation").selectExpr("concat(n_nationkey, '|', n_name, '|', n_regionkey, '|') as line")
    return lines.select(catalog.record(F.col("line"), schema).alias("r")).select("r.*")


@query("select n_nationkey, n_name, n_regionkey from nation")
def load_catalog_file(spark, d):
    folder = storage.scratch(spark, "catalog")
    catalog.write_delimited(T(spark, d, "nation"), f"{folder}/nation.tbl")
    return catalog.load_relation(spark, "BEGIN nation nation.tbl n_nationkey Int n_name String n_regionkey Int END", "nation", folder)


@query("select * from orders where o_orderpriority='1-URGENT' and o_totalprice<2000.0")
def sorted_file_filter(spark, d):
    path = storage.scratch(spark, "sorted")
    storage.create_sorted(T(spark, d, "orders"), path, "(o_orderpriority)")
    return R.select(storage.open_table(spark, path), "(o_orderpriority = '1-URGENT') AND (o_totalprice < 2000.0)")


@query("select n_nationkey,n_name,n_regionkey from nation")
def load_delimited(spark, d):
    path = storage.scratch(spark, "text")
    catalog.write_delimited(T(spark, d, "nation"), path)
    schema = catalog.schema_of("BEGIN nation nation.tbl n_nationkey Int n_name String n_regionkey Int END", "nation")
    return catalog.load_delimited(spark, path, schema)


@query("select * from orders")
def sorted_merge_append(spark, d):
    path, orders = storage.scratch(spark, "merged"), T(spark, d, "orders")
    storage.create_sorted(R.select(orders, "(o_totalprice < 250000.0)"), path, "(o_custkey) AND (o_orderkey)")
    storage.append(orders.filter("not o_totalprice < 250000.0"), path)
    return storage.open_table(spark, path)


#: Statistics models, steps to apply, last step, expected estimate.
_MODELS = {
    "q0": ({"supplier": (10000, {"s_suppkey": 10000}), "partsupp": (800000, {"ps_suppkey": 10000})}, {},
           [("(s_suppkey = ps_suppkey)", "supplier partsupp")], 800000.0),
    "q1": ({"lineitem": (6001215, {"l_returnflag": 3, "l_discount": 11, "l_shipmode": 7})}, {},
           [("(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", "lineitem")], 857316.4),
    "q2": ({"orders": (1500000, {"o_custkey": 150000}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, {},
           [("(c_custkey = o_custkey)", "orders customer")], 1500000.0),
    "q3": ({"supplier": (10000, {"s_nationkey": 25}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})},
           {"s": "supplier", "c": "customer", "n1": "nation", "n2": "nation"},
           [("(s.s_nationkey = n1.n_nationkey)", "s n1"), ("(c.c_nationkey = n2.n_nationkey)", "c n2"), ("(n1.n_nationkey = n2.n_nationkey )", "c s n1 n2")], 60000000.0),
    "q4": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp": (800000, {"ps_suppkey": 10000, "ps_partkey": 200000}),
            "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_regionkey": 5}), "region": (5, {"r_regionkey": 5, "r_name": 5})},
           {"p": "part", "ps": "partsupp", "s": "supplier", "n": "nation", "r": "region"},
           [("(p.p_partkey=ps.ps_partkey) AND (p.p_size = 2)", "p ps"), ("(s.s_suppkey = ps.ps_suppkey)", "p ps s"), ("(s.s_nationkey = n.n_nationkey)", "p ps s n"),
            ("(n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", "p ps s n r")], 3200.0),
    "q5": ({"customer": (150000, {"c_custkey": 150000, "c_mktsegment": 5}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000, "o_orderdate": 150000}),
            "lineitem": (6001215, {"l_orderkey": 1500000})}, {},
           [("(c_mktsegment = 'BUILDING') AND (c_custkey = o_custkey) AND (o_orderdate < '1995-03-1')", "customer orders"), ("(l_orderkey = o_orderkey)", "customer orders lineitem")], 400081.0),
    "q6": ({"partsupp": (800000, {"ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_name": 25})}, {},
           [("(s_suppkey = ps_suppkey)", "partsupp supplier"), ("(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", "partsupp supplier nation")], 32000.0),
    "q7": ({"orders": (1500000, {"o_orderkey": 1500000}), "lineitem": (6001215, {"l_orderkey": 1500000, "l_receiptdate": 3})}, {},
           [("(l_receiptdate >'1995-02-01' ) AND (l_orderkey = o_orderkey)", "orders lineitem")], 2000405.0),
    "q8": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp": (800000, {"ps_partkey": 200000})}, {},
           [("(p_partkey=ps_partkey) AND (p_size =3 OR p_size=6 OR p_size =19)", "part partsupp")], 48000.0),
    "q9": ({"part": (200000, {"p_partkey": 200000, "p_name": 199996}), "partsupp": (800000, {"ps_partkey": 200000, "ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000})}, {},
           [("(p_partkey=ps_partkey) AND (p_name = 'dark green antique puff wheat')", "part partsupp"), ("(s_suppkey = ps_suppkey)", "part partsupp supplier")], 4.0),
    "q10": ({"customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000, "o_orderdate": 150000}),
             "lineitem": (6001215, {"l_orderkey": 1500000}), "nation": (25, {"n_nationkey": 25})}, {},
            [("(c_custkey = o_custkey) AND (o_orderdate > '1994-01-23')", "customer orders"), ("(l_orderkey = o_orderkey)", "customer orders lineitem"),
             ("(c_nationkey = n_nationkey)", "customer orders lineitem nation")], 2000405.0),
    "q11": ({"part": (200000, {"p_partkey": 200000, "p_container": 40}), "lineitem": (6001215, {"l_partkey": 200000, "l_shipinstruct": 4, "l_shipmode": 7})}, {},
            [("(l_partkey = p_partkey) AND (l_shipmode = 'AIR' OR l_shipmode = 'AIR REG') AND (p_container ='SM BOX' OR p_container = 'SM PACK') AND (l_shipinstruct = 'DELIVER IN PERSON')",
              "lineitem part")], 21432.9),
}


def model(name: str) -> Statistics:
    out = Statistics()
    relations, copies, _, _ = _MODELS[name]
    for r, (tuples, distinct_) in relations.items():
        out.add_relation(r, tuples)
        for a, v in distinct_.items():
            out.add_attribute(r, a, v)
    for new, old in copies.items():
        out.copy_relation(old, new)
    return out


def estimate(name: str) -> float:
    stats, (*_, steps, _) = model(name), _MODELS[name]
    for text, names in steps[:-1]:
        stats.apply(text, names.split())
    return stats.estimate(steps[-1][0], steps[-1][1].split())


def _estimates(spark: SparkSession, value: float) -> DataFrame:
    return spark.range(1).select(F.lit(round(value, 1)).alias("estimate"))


for _name, (*_, _expected) in _MODELS.items():
    _QUERIES[f"est_{_name}"] = lambda spark, d, name=_name: _estimates(spark, estimate(name))
    _ORACLES[f"est_{_name}"] = f"select {_expected}::double as estimate"


@query("select 100.0::double as estimate")
def est_default_distinct(spark, d):
    stats = Statistics()
    stats.add_relation("r", 100)
    stats.add_attribute("r", "a", -1)
    stats.add_relation("s", 100)
    stats.add_attribute("s", "b", 100)
    return _estimates(spark, stats.estimate("(a = b)", ["r", "s"]))


@query("select 48000.0::double as estimate")
def stats_roundtrip(spark, d):
    stats = Statistics.read(model("q8").write())
    text, names = _MODELS["q8"][2][-1]
    return _estimates(spark, stats.estimate(text, names.split()))


@query("select 48000.0::double as estimate")
def stats_file(spark, d):
    path = storage.scratch(spark, "statistics")
    model("q8").save(spark, path)
    text, names = _MODELS["q8"][2][-1]
    return _estimates(spark, Statistics.load(spark, path).estimate(text, names.split()))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
