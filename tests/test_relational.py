"""Every relational query against DuckDB, the two small languages, estimates."""

import glob
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import arith
from lodestone.operators import relops
from lodestone.plans import predicate, suite
from lodestone.plans.cardinality import Statistics
from lodestone.sources import catalog, storage
from lodestone.streaming import pipes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query(spark, duck, name):
    df = suite.queries()[name](spark, DATA)
    want = duck.sql(suite.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_arith_shape():
    assert arith.parse("a - b - c") == arith.Binary("-", arith.Leaf("name", "a"), arith.parse("b - c"))
    assert arith.parse("-a + b") == arith.Negate(arith.parse("a + b"))
    assert arith.parse("a-1") == arith.Leaf("name", "a-1")
    for bad in ("a -1", "(a", "a +", "a ? b", ""):
        with pytest.raises(SyntaxError):
            arith.parse(bad)


def test_arith_values(spark):
    df = spark.createDataFrame([(-7, 2, 1.5, "x")], "a int, b long, d double, s string")
    def value(text):
        return df.select(arith.compile_text(text, df)[0]).first()[0]
    assert value("a / b") == -3 and value("d / 0.0") == float("inf") and value("a - b - d") == -7.5
    with pytest.raises(TypeError):
        value("s + a")
    with pytest.raises(ValueError):
        value("nope")


def test_predicate_errors(spark):
    df = spark.createDataFrame([(1, 1.0, "x")], "a int, d double, s string")
    for text in ("(a = 1.0)", "(s = 1)", "(a < d)"):
        with pytest.raises(TypeError):
            relops.select(df, text)
    with pytest.raises(ValueError):
        relops.select(df, "(A = 1)")
    for text in ("a = 1", "(a = 1) (a = 2)", "(a >= 1)", "(a = 1"):
        with pytest.raises(SyntaxError):
            relops.select(df, text)
    assert relops.select(df, r"(s = 'x') AND (a)").count() == 1
    assert predicate.parse(r"(s = 'it\'s')")[0][0].right.text == "it's"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("<>="), st.integers(-3, 3)), min_size=1, max_size=3), min_size=1, max_size=3))
def test_predicate_property(spark, cnf):
    rows = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    text = " AND ".join("(" + " OR ".join(f"{n} {o} {v}" for n, o, v in ors) + ")" for ors in cnf)
    test = {"<": int.__lt__, ">": int.__gt__, "=": int.__eq__}
    want = [r for r in rows if all(any(test[o](dict(zip("ab", r, strict=True))[n], v) for n, o, v in ors) for ors in cnf)]
    got = relops.select(spark.createDataFrame(rows, "a int, b int"), text).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_estimates():
    stats = suite.model("q4")
    assert Statistics.read(stats.write()).write() == stats.write()
    stats.apply("(p.p_size = 2)", ["p"])
    assert not stats.joined
    stats.apply("(p.p_partkey = ps.ps_partkey)", ["p", "ps"])
    for text, names in (("(s.s_suppkey = ps.ps_suppkey)", ["s", "ps"]), ("(nope = 1)", ["s"]), ("(s.s_suppkey = ps.ps_suppkey)", ["s"])):
        with pytest.raises(ValueError):
            stats.estimate(text, names)


def test_plans(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    plan = relops.select(orders, "(o_totalprice > 400000.0)").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    left = spark.createDataFrame([(1, "l")], "k int, v string")
    both = relops.join(left, spark.createDataFrame([(1, "r"), (1, "q")], "k int, v string"), "(k = k)")
    assert both.columns == ["k", "v", "k", "v"]
    assert "SortMergeJoin" in relops.join(left, orders.withColumnRenamed("o_custkey", "c"), "(v = o_orderstatus)", hint="merge")._jdf.queryExecution().toString()


def test_storage(spark):
    path = storage.scratch(spark, "t")
    df = spark.createDataFrame([(3, "c"), (1, "a")], "k int, v string")
    storage.create_heap(df, path)
    storage.append(df, path)
    assert storage.open_table(spark, path).count() == 4
    storage.create_heap(df.limit(1), path)
    assert storage.open_table(spark, path).count() == 1
    path = storage.scratch(spark, "t")
    storage.create_sorted(df, path, "(k)")
    storage.append(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), path)
    got = [r["k"] for r in storage.open_table(spark, path).collect()]
    assert sorted(got) == [1, 2, 3, 3]
    empty = relops.with_position(df.limit(0), ["k"])
    assert empty.count() == 0 and relops.group_total(df.limit(0), ["v"], "k").count() == 0
    with pytest.raises(ValueError):
        catalog.parse_catalog("BEGIN r f a Date END")


@pytest.fixture
def many_files(spark):
    """Small tables in as many files as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order(spark, many_files):
    """A sorted table is in order over all its files, also after appends; the check finds what is not."""
    path = storage.scratch(spark, "t")
    items = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_quantity", "l_tax")
    storage.create_sorted(items.repartition(5), path, "(l_partkey) AND (l_quantity)")
    assert tuple(storage.verify_order(spark, path).first()) == (6000, 0)
    assert len(storage.open_table(spark, path).inputFiles()) > 1
    storage.append(items.limit(70), path)
    assert tuple(storage.verify_order(spark, path).first()) == (6070, 0)
    folder = storage._layout(spark, path)["folder"]
    items.orderBy("l_tax").coalesce(1).write.mode("overwrite").parquet(folder)
    assert storage.verify_order(spark, path).first()["errors"] > 1000
    rows = relops.sort(items, "(l_quantity) AND (l_tax)").collect()
    assert [(r.l_quantity, r.l_tax) for r in rows] == sorted((r.l_quantity, r.l_tax) for r in rows)
    assert [r.l_partkey for r in relops.sort(items).collect()] == sorted(r.l_partkey for r in rows)


def test_sorted_scan_skips(spark, many_files):
    """A filter on a sorted table's key reads the row groups that may hold it, a heap's all."""
    items = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_tax")
    counts = {}
    for kind, create in (("heap", storage.create_heap), ("sorted", lambda df, p: storage.create_sorted(df, p, "(l_partkey)"))):
        path = storage.scratch(spark, kind)
        create(items.repartition(4), path)
        found = relops.select(storage.open_table(spark, path), "(l_partkey = 17)")
        n = len(found.collect())
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        counts[kind] = (n, leaf.metrics().apply("numOutputRows").value())
    assert counts["heap"][0] == counts["sorted"][0] > 0
    assert counts["heap"][1] == 6000 and counts["sorted"][1] <= 3000


def test_loading(spark):
    text = "BEGIN r r.tbl a Int d Double s String END"
    folder = storage.scratch(spark, "text")
    spark.createDataFrame([("1|2.5|x|",), ("12ab|1e2z|y|",), ("no||z|",)], "line string").coalesce(1).write.text(f"{folder}/r.tbl")
    schema = catalog.schema_of(text, "r")
    assert catalog.parse_files(text) == {"r": "r.tbl"}
    assert sorted(map(tuple, catalog.load_relation(spark, text, "r", folder, lenient=True).collect())) == [(0, 0.0, "z"), (1, 2.5, "x"), (12, 100.0, "y")]
    loose = {r.s: (r.a, r.d) for r in catalog.load_delimited(spark, f"{folder}/r.tbl", schema).collect()}
    assert loose == {"x": (1, 2.5), "y": (None, None), "z": (None, None)}
    assert [r.s for r in catalog.load_delimited(spark, f"{folder}/r.tbl", schema, mode="DROPMALFORMED").collect()] == ["x"]
    with pytest.raises(Exception):
        catalog.load_delimited(spark, f"{folder}/r.tbl", schema, mode="FAILFAST").collect()
    one = spark.createDataFrame([("7|0.5|q|",)], "line string")
    assert tuple(one.select(catalog.record(one.line, schema).alias("r")).first().r) == (7, 0.5, "q")


def test_console(spark, capsys):
    assert relops.print_rows(spark.createDataFrame([(1, 2.5, "x")], "a int, d double, s string")) == 1
    assert capsys.readouterr().out == "a: [1], d: [2.500000], s: [x]\n"


def test_large_predicate(spark):
    """More clauses and alternatives than any fixed table would hold."""
    df = spark.range(1000).selectExpr("cast(id as int) as a")
    text = " AND ".join("(" + " OR ".join(f"a = {30 * k + j}" for j in range(60)) + ")" for k in range(2)) + "".join(f" AND (a > {-k})" for k in range(1, 40))
    assert relops.select(df, text).count() == 30


def test_statistics_copies(spark):
    stats = suite.model("q2")
    other = stats.copy()
    other.apply("(c_custkey = o_custkey)", ["orders", "customer"])
    other.add_relation("more", 5)
    assert stats.joined == [] and "more" not in stats.relations and other.joined
    path = storage.scratch(spark, "statistics")
    stats.save(spark, path)
    assert Statistics.load(spark, path) == stats
    assert "supplier" in str(suite.model("q0"))
    both = Statistics()
    both.collect("s", spark.read.parquet(f"{DATA}/supplier.parquet"), ["s_nationkey", "s_suppkey"], exact=False)
    assert both.relations["s"].tuples == 10 and both.relations["s"].distinct["s_suppkey"] in range(8, 13)


def test_stream(spark):
    path = storage.scratch(spark, "stream")
    spark.read.parquet(f"{DATA}/supplier.parquet").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = pipes.select_stream(spark.readStream.schema(schema).parquet(path), "(s_acctbal > 0.0)")
    running = pipes.group_total_stream(stream, ["s_nationkey"], "s_suppkey", "sums")
    try:
        running.processAllAvailable()
        want = relops.group_total(relops.select(spark.read.parquet(path), "(s_acctbal > 0.0)"), ["s_nationkey"], "s_suppkey")
        assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, want.collect()))
    finally:
        running.stop()
