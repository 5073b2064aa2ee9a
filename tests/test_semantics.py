"""Golden cases: literal input, literal output."""

import gc
import gzip
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import relflow as rf
from relflow import Relation, fold, on, plans, returning, streaming
from relflow import sources as src
from relflow.sources import edn
from relflow.sources.scratch import scratch, workspace


def ints(spark, *xs):
    return returning(spark, list(xs), "value int")


def kv(spark, rows):
    return returning(spark, rows, "k string, v int")


@pytest.fixture
def data1(spark):
    return kv(spark, [(None, 1), (None, 3), ("i", 5), ("i", 7), ("l", 9), ("l", 11)])


@pytest.fixture
def data2(spark):
    return kv(spark, [(None, 2), (None, 4), ("i", 6), ("i", 8), ("r", 10), ("r", 12)])


def test_map_keeps_null(spark):
    assert rf.dump(ints(spark, 1, 2).map(lambda v: F.lit(None).cast("int"))) == [None, None]


def test_mapcat_of_empty_and_null(spark):
    assert rf.dump(ints(spark, 1, 2).mapcat(lambda v: F.when(v == 1, F.array(v, F.lit(None))))) == [1, None]


def test_filter_and_remove_of_null_predicate(spark):
    r = ints(spark, 1, 2, None)
    assert rf.dump(r.filter(lambda v: v > 1)) == [2]
    assert sorted(rf.dump(r.remove(lambda v: v > 1)), key=str) == [1, None]


def test_sort_puts_null_first(spark):
    r = ints(spark, 2, None, 1)
    assert rf.dump(r.sort()) == [None, 1, 2]
    assert rf.dump(r.sort("desc")) == [2, 1, None]
    assert rf.dump(r.sort(parallel=3)) == [None, 1, 2]


def test_indexes(spark):
    r = ints(spark, 3, 1, 3, 2).sort()
    assert rf.dump(r.map_indexed(lambda i, v: i * 10 + v)) == [1, 12, 23, 33]
    assert sorted(rf.dump(r.map_indexed(lambda i, v: i, ties="rank"))) == [0, 1, 2, 2]
    r = ints(spark, 3, 1, 3, 5).sort()
    assert sorted(rf.dump(r.map_indexed(lambda i, v: i, ties="dense"))) == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        ints(spark, 1).map_indexed(lambda i, v: i, ties="rank")


def test_take_and_sample_check_their_numbers(spark):
    assert len(rf.dump(ints(spark, 1, 2, 3).take(2))) == 2
    assert 400 < rf.relation(spark.range(1000).toDF("value")).sample(0.5).df.count() < 600
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ints(spark, 1).take(bad)
    with pytest.raises(ValueError):
        ints(spark, 1).sample(1.1)


def test_arity_is_checked_early(spark):
    with pytest.raises(TypeError):
        ints(spark, 1).map(lambda a, b: a)


@pytest.mark.parametrize(("kinds", "rows", "nil_rows"), [(("required", "required"), 4, 8), (("required", "optional"), 8, 10), (("optional", "required"), 8, 10), (("optional", "optional"), 12, 12)])
def test_join_counts(data1, data2, kinds, rows, nil_rows):
    sides = [on(data1, "k", type=kinds[0]), on(data2, "k", type=kinds[1])]
    assert len(rf.dump(rf.join(sides, lambda a, b: (a.v, b.v)))) == rows
    assert len(rf.dump(rf.join(sides, lambda a, b: (a.v, b.v), join_nils=True))) == nil_rows


def test_join_rules(spark, data1, data2):
    with pytest.raises(ValueError):
        rf.join([on(data1, "k")], lambda a: a)
    with pytest.raises(ValueError):
        rf.join([on(data1, "k", type="optional"), on(data1, "k"), on(data2, "k")], lambda a, b, c: a.v)
    with pytest.raises(ValueError):
        on(data1, "k", type="outer")
    got = rf.join([on(data1, "k", type="optional"), on(data2, "k", type="optional")], lambda a, b: {"p": a.present, "q": b.present}).df
    assert got.where("p and q").count() == 4
    s = ints(spark, 0, 1, 2)
    assert sorted(rf.dump(rf.join([on(s), on(s)], lambda a, b: a * 10 + b))) == [0, 11, 22]


def test_filter_by_and_remove_by(spark, data1):
    for keys, kept, left in ((["i"], 2, 4), (["i", None], 4, 2), (["i", "i"], 4, 4)):
        k = returning(spark, keys, "value string")
        assert rf.filter_by(data1, k, lambda r: r.k).df.count() == kept
        assert rf.remove_by(data1, k, lambda r: r.k).df.count() == left


@pytest.mark.parametrize(("kinds", "groups", "nil_groups"), [(("required", "required"), 1, 2), (("required", "optional"), 3, 3), (("optional", "required"), 3, 3), (("optional", "optional"), 5, 4)])
def test_cogroup_counts(data1, data2, kinds, groups, nil_groups):
    sides = [on(data1, "k", type=kinds[0]), on(data2, "k", type=kinds[1])]
    assert rf.cogroup(sides).df.count() == groups
    assert rf.cogroup(sides, join_nils=True).df.count() == nil_groups


def test_cogroup_missing_side(data1, data2):
    got = {r["key"]: r for r in rf.cogroup([on(data1, "k"), on(data2, "k", fold=fold.count())]).df.where("key is not null").collect()}
    assert got["r"]["_0"] is None and got["r"]["_1"] == 2 and got["l"]["_1"] == 0


def test_three_way_cogroup(spark):
    a = returning(spark, [(1, 2), (1, 3), (2, 4)], "a int, b int")
    c = returning(spark, [(1, "foo"), (2, "bar"), (2, "baz")], "c int, d string")
    d = returning(spark, [(1, "foo2"), (2, "bar2")], "c int, d string")
    size = lambda x: F.size(x)
    got = rf.cogroup([on(a, "a"), on(c, "c"), on(d, "c")], lambda k, x, y, z: (k, size(x), size(y), size(z)))
    assert sorted(map(tuple, got.df.collect())) == [(1, 2, 1, 1), (2, 1, 2, 1)]


def test_group_by_null_is_not_false(spark):
    r = returning(spark, [None, True, False], "value boolean")
    assert rf.group_by(r, lambda v: v).df.count() == 3


def value(r, f):
    got = rf.dump(rf.fold_relation(r, f))
    return got[0] if got else "no row"


def test_folds(spark):
    r = ints(spark, 1, 2, 3, 4)
    assert value(r, fold.count()) == 4
    assert value(r, fold.sum()) == 10
    assert value(r, fold.avg()) == 2.5
    assert value(r, fold.min()) == 1 and value(r, fold.max()) == 4
    assert value(r, fold.top(2)) == [1, 2] and value(r, fold.top(2, reverse=True)) == [4, 3]
    assert value(r, fold.take(2).count()) == 4
    assert value(r, fold.filter(lambda v: v > 2).sum()) == 7
    assert value(r, fold.filter(lambda v: v > 9).sum()) == 0
    assert value(r, fold.filter(lambda v: v > 9).count()) == 0
    assert value(r, fold.filter(lambda v: v > 9).avg()) is None
    assert value(r, fold.filter(lambda v: v > 9).min()) is None
    assert value(r, fold.juxt(fold.count(), fold.sum())) == (4, 10)
    assert value(r, fold.mapcat(lambda v: F.array(v, v + 10)).sort()) == [1, 2, 3, 4, 11, 12, 13, 14]
    assert value(r, fold.mapcat(lambda v: F.array(v, v + 10)).max()) == 14
    assert value(r, fold.mapcat(lambda v: F.array(v, v)).avg()) == 2.5
    assert value(r, fold.sort(reverse=True).first()) == 4 and value(r, fold.sort().last()) == 4
    assert value(ints(spark), fold.count()) == "no row"


def test_folds_and_null(spark):
    r = ints(spark, 1, None, 3, 3)
    assert value(r, fold.count()) == 4
    assert sorted(value(r, fold.vec()), key=str) == [1, 3, 3, None]
    assert sorted(value(r, fold.distinct()), key=str) == [1, 3, None]
    assert value(r, fold.min()) is None
    assert value(r, fold.sort()) == [None, 1, 3, 3]
    assert value(r, fold.keep(lambda v: v).sort()) == [1, 3, 3]
    with pytest.raises(Exception, match="sum of null"):
        value(r, fold.sum())


def test_fold_by_key(spark):
    r = returning(spark, [(1, "d"), (2, "c"), (3, "b"), (4, "a")], "foo int, bar string")
    assert value(r, fold.min_key(lambda x: x.bar))["foo"] == 4
    assert value(r, fold.max_key(lambda x: x.bar))["foo"] == 1
    assert [x["foo"] for x in value(r, fold.top_by(lambda x: x.bar, 2))] == [4, 3]
    with pytest.raises(ValueError):
        fold.count().map(lambda x: x)


def test_opaque_fold_reduce_and_into(spark):
    r = ints(spark, 2, 4, 6)
    assert value(r, rf.fold_fn(lambda a, x: a + x, lambda *ab: sum(ab), post=lambda a: a * 1.0)) == 12.0
    assert rf.dump(rf.reduce_relation(r, lambda a, x: a + x, returns="int")) == [12]
    assert rf.dump(rf.reduce_relation(r, lambda a, x: a + x, 1, returns="int")) == [13]
    assert rf.dump(rf.reduce_relation(ints(spark), lambda a, x: a + x, returns="int")) == []
    assert sorted(rf.dump(rf.into(r))[0]) == [2, 4, 6]
    assert rf.dump(rf.into(ints(spark))) == []
    pairs = returning(spark, [(1, "a"), (2, "b")], "_1 int, _2 string")
    assert rf.dump(rf.into(pairs, "map")) == [{1: "a", 2: "b"}]


def test_sets(spark):
    a, b, c = ints(spark, 1, 2, 3, 3), ints(spark, 3, 2, 3, 4, 3), ints(spark, 3, 4, 3, 5, 2)
    assert sorted(rf.dump(rf.intersection(a, b, c))) == [2, 3]
    assert sorted(rf.dump(rf.intersection_multiset(a, b, c))) == [2, 3, 3]
    a, b, c = ints(spark, 1, 2, 3, 3, 3, 4, 5), ints(spark, 1, 2), ints(spark, 4, 5)
    assert rf.dump(rf.difference(a, b, c)) == [3]
    a, b, c = ints(spark, 1, 2, 3, 3, 3, 4, 5), ints(spark, 1, 2, 3), ints(spark, 3, 4, 5)
    assert rf.dump(rf.difference_multiset(a, b, c)) == [3]
    assert sorted(rf.dump(rf.union(ints(spark, 1, None), None, ints(spark, 1, None))), key=str) == [1, None]
    assert len(rf.dump(rf.concat(ints(spark, 1), ints(spark, 1)))) == 2
    assert sorted(rf.dump(rf.set_op(lambda x, y: x * y, ints(spark, 1, 1, 2), ints(spark, 1, 2)))) == [1, 1, 2]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\tb\tc\n1\t\t3\t\n")
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "b.txt.gz", "wt") as f:
        f.write("x|y\n")
    at = str(tmp_path)
    assert sorted(rf.dump(src.load_tsv(spark, at))) == [["1", "", "3", ""], ["a", "b", "c"], ["x|y"]]
    assert ["x", "y"] in rf.dump(src.load_tsv(spark, at, "|"))
    import re

    assert ["1", "3", ""] in rf.dump(src.load_lazy(spark, at, re.compile("\t+")))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b ""x"", y",c\n1,2\n')
    assert rf.dump(src.load_csv(spark, str(tmp_path))) == [["a", 'b "x", y', "c"], ["1", "2"]]
    (tmp_path / "a.csv").write_text("a;'b;c'\n")
    assert rf.dump(src.load_csv(spark, str(tmp_path), ";", "'")) == [["a", "b;c"]]


def test_json_and_edn(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "foo"}\n{"a": 2}\n')
    got = src.load_json(spark, str(tmp_path), "a int, b string", key_fn=str.upper, value_fn=lambda n, c: c + 1 if n == "a" else c)
    assert sorted(map(tuple, got.df.collect())) == [(2, "foo"), (3, None)]
    (tmp_path / "a.json").write_text('{:a 1, :b "foo", :c [1 2]} ; end\n')
    got = src.load_clj(spark, str(tmp_path), "a int, b string, c array<int>").df.collect()
    assert tuple(got[0]) == (1, "foo", [1, 2])
    assert src.load_clj(spark, str(tmp_path)).df.select(F.expr("variant_get(value, '$.b', 'string')")).collect()[0][0] == "foo"


@pytest.mark.parametrize("text", ["nil", "true", "[1 2.5 :k sym]", '{:a 1, "b" nil}', "#{1 2}", "(1 2)", '"q\\"\\n"', "5/2", "[]"])
def test_edn_round_trip(text):
    assert edn.dumps(edn.loads(text)) == text


def test_edn_forms():
    assert edn.loads('#inst "2020" ; c') == "2020" and edn.loads("[1 #_2 3]") == [1, 3] and edn.loads("\\newline") == "\n" and edn.loads("\\a") == "a"
    for bad in ("", "[1", '"a', "{1}"):
        with pytest.raises(edn.EdnError):
            edn.loads(bad)


def test_stores(spark):
    at = scratch(spark, "t")
    src.store_string(at, returning(spark, [1, None], "value int"))
    assert sorted(rf.dump(src.load_string(spark, at))) == ["", "1"]
    src.store_tsv(at, returning(spark, [([1, None],)], "value array<int>"))
    assert rf.dump(src.load_string(spark, at)) == ["1\tnil"]
    src.store_clj(at, returning(spark, [(1, "x")], "a int, b string"))
    assert rf.dump(src.load_string(spark, at)) == ['{:a 1, :b "x"}']
    with pytest.raises(ValueError):
        src.store_parquet(at, src.message("m", src.int32("a")), ints(spark, 1))
    with pytest.raises(ValueError):
        src.load(spark, at, "nothing")
    src.register_loader("own", lambda s, p: rf.returning(s, [p], "value string"))
    assert rf.dump(src.load(spark, "here", "own")) == ["here"]


def test_load_errors_reach_the_caller(spark):
    with pytest.raises(Exception, match="(?i)path"):
        rf.dump(src.load_string(spark, "/no/such/place"))


def avro_file(schema, rows, codec="deflate"):
    """A small encoder, for the test alone: records of long, string and union fields."""
    import json
    import zlib

    def long(n):
        n, out = (n << 1) ^ (n >> 63), b""
        while n >= 128:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def text(s):
        return long(len(s.encode())) + s.encode()

    body = b"".join(long(a) + (long(0) if b is None else long(1) + text(b)) + (b"\x01" if c else b"\x00") for a, b, c in rows)
    if codec == "deflate":
        body = zlib.compress(body)[2:-4]
    sync = b"0123456789abcdef"
    meta = long(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + long(0)
    return b"Obj\x01" + meta + sync + long(len(rows)) + long(len(body)) + body + sync


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    writer = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": "boolean"}]}
    (tmp_path / "x.avro").write_bytes(avro_file(writer, [(1, "x", True), (-300, None, False)], codec))
    reader = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": "boolean"}, {"name": "d", "type": "string", "default": "foo"}]}
    got = src.load_avro(spark, str(tmp_path), reader).df.collect()
    assert [tuple(r) for r in got] == [(1, "x", True, "foo"), (-300, None, False, "foo")]


def test_plans(spark):
    li = Relation(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    text = plans.plan_text(li.native_filter("l_quantity > 10").project("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert plans.graph(li).startswith("digraph")
    two = rf.cogroup([on(li, "l_orderkey", fold=fold.count()), on(li, "l_orderkey", fold=fold.count())])
    assert plans.plan_text(two, "simple").count("Exchange hashpartitioning") == 1


def test_opaque_map(spark):
    assert rf.dump(ints(spark, 1, 2).map(lambda v: v * v, schema="value int")) == [1, 4]
    assert sorted(rf.dump(ints(spark, 1, 2).mapcat(lambda v: [v] * v, schema="value int"))) == [1, 2, 2]


def test_debug_tap(spark, tmp_path):
    ints(spark, 7).debug_tap(str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).collect()[0][0].startswith("int\t")


def test_stateless_operators_on_a_stream(spark, tmp_path):
    import pyarrow.parquet as pq

    (tmp_path / "in").mkdir()
    pq.write_table(pa.table({"value": pa.array([1, 2, 3], pa.int32())}), tmp_path / "in" / "a.parquet")
    s = streaming.read_stream(spark, "parquet", "value int", str(tmp_path / "in"))
    out = s.filter(lambda v: v > 1).map(lambda v: v * 10)
    streaming.write_stream(out, "parquet", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [20, 30]


def test_sums_after_a_mapcat_keep_their_type(spark):
    n = rf.returning(spark, [(1, 2**53), (1, 1), (2, 5)], "k int, x bigint")
    twice = fold.mapcat(lambda r: F.array(r.x))
    assert rf.dump(rf.fold_relation(n, twice.sum())) == [2**53 + 6]
    assert sorted(rf.dump(rf.group_by(n, lambda r: r.k, fold=fold.juxt(s=twice.sum(), c=twice.count())).map(lambda r: r.value["s"]))) == [5, 2**53 + 1]
    both = rf.cogroup([rf.on(n, "k", fold=twice.sum()), rf.on(n, "k", fold=twice.avg())], lambda k, a, b: {"a": a, "b": b}).df.collect()
    assert sorted((r["a"], r["b"]) for r in both) == [(5, 5.0), (2**53 + 1, (2**53 + 1) / 2)]
    tenths = fold.mapcat(lambda r: F.array(r.x.cast("decimal(18,1)") / 10, F.lit(0).cast("decimal(18,1)")).cast("array<decimal(18,1)>")).sum()
    assert [str(x) for x in rf.dump(rf.fold_relation(n.filter(lambda r: r.x < 9), tenths))] == ["0.6"]
    halves = n.filter(lambda r: r.x < 9).map(lambda r: {"x": r.x.cast("double") / 2})
    assert rf.dump(rf.fold_relation(halves, fold.mapcat(lambda r: F.array(r.x)).sum())) == [3.0]


def test_replicated_side_is_checked_for_size(spark, monkeypatch):
    # files, since the sizes of local rows are always known
    n = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    r = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda: rf.join([on(n, "n_regionkey"), on(r, "r_regionkey")], lambda a, b: {"a": a.n_name, "b": b.r_name}, strategy="replicated").df._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan()
        monkeypatch.setattr("relflow.operators.joins.REPLICATED_BYTES", 1)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_and_last_hold_one_element(spark):
    r = rf.returning(spark, [("a", 3), ("a", None), ("a", 1), ("b", 2), ("c", None)], "k string, v int")
    v = fold.map(lambda x: x.v)
    f = fold.juxt(f=v.sort().first(), l=v.sort().last(), rf=v.sort(reverse=True).first(), rl=v.sort(reverse=True).last(), by=fold.sort_by(lambda x: x.v).last(), one=fold.filter(lambda x: x.v == 3).map(lambda x: x.v).first(), n=fold.filter(lambda x: x.v > 9).map(lambda x: x.v).sort().first())
    out = rf.group_by(r, lambda x: x.k, fold=f)
    assert "collect_list" not in out.df._jdf.queryExecution().toString()
    got = {x["key"]: x["value"] for x in out.df.collect()}
    assert [tuple(got[k])[:4] for k in "abc"] == [(None, 3, 3, None), (2, 2, 2, 2), (None, None, None, None)]
    assert (got["a"]["by"]["v"], got["a"]["one"], got["b"]["one"], got["a"]["n"]) == (3, 3, None, None)


def test_reduce_keeps_the_order_of_partitions_without_a_sort(spark, capsys):
    sorted_rows = rf.relation(spark.range(0, 3000, 1, 7).select((3000 - F.col("id")).alias("value")).repartition(5)).df.orderBy("value").repartitionByRange(9, "value").sortWithinPartitions("value")
    strictly = lambda a, x: x if a is not None and a == x - 1 else None
    reduced = rf.reduce_relation(sorted_rows, strictly, 0, returns="bigint")
    assert rf.dump(reduced) == [3000]
    # the rows of empty and of many partitions, and whole rows
    some = spark.range(0, 2500, 1, 1250).where("id % 7 = 3")
    rows = rf.reduce_relation(some.select("id", F.lit("x").alias("s")), lambda a, x: [*a, x["id"]], [], returns="array<bigint>")
    assert rf.dump(rows) == [list(range(3, 2500, 7))]
    reduced.df.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan
    assert "Sort" not in plan


def test_a_workspace_ends_with_a_tidy_driver(spark):
    held = spark._jvm.java.util.ArrayList()
    known = spark._jvm.java.lang.ref.WeakReference(held)
    gc.disable()
    try:
        cycle = [held]
        cycle.append(cycle)
        del held, cycle
        for _ in range(2):  # Python hands its dead handles on in a thread of its own, which may come after the first
            with workspace(spark, "some"):
                time.sleep(2)
        assert known.get() is None
    finally:
        gc.enable()
