"""The query catalogue: one query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import relflow as rf
from relflow import Relation, fold, on
from relflow import sources as src
from relflow.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: _df(f(lambda t: Relation(spark.read.parquet(f"{d}/{t}.parquet"))))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _df(x: Relation | DataFrame) -> DataFrame:
    return x.df if isinstance(x, Relation) else x


def money(c):  # noqa: ANN001, ANN201
    return c.cast("decimal(18,2)")


def dbl(c):  # noqa: ANN001, ANN201
    return c.cast("double")


def cols(rel: Relation, *names: str) -> Relation:
    return rel.project(*names)


# maps -----------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS net FROM lineitem")
def map_project(t):
    return t("lineitem").map(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "net": r.l_extendedprice - r.l_discount})


@query("SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS twice FROM part")
def map_python(t):
    return t("part").project("p_partkey", "p_size").map(lambda r: {"p_partkey": r["p_partkey"], "twice": r["p_size"] * 2}, schema="p_partkey bigint, twice bigint")


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def mapcat_words(t):
    return t("part").mapcat(lambda r: F.split(r.p_name, " "))


@query("SELECT n_name, unnest([1, 2]) AS a, b FROM (SELECT n_name, unnest(['x', 'y']) AS b FROM nation)")
def mapcat_cross(t):
    return t("nation").project("n_name", a=lambda r: [1, 2], b=lambda r: ["x", "y"], flatten=["a", "b"])


@query("SELECT o_orderkey AS k, unnest([1, 2]) AS i FROM orders")
def bind_structs(t):
    return t("orders").bind(lambda r: [{"k": r.o_orderkey, "i": 1}, {"k": r.o_orderkey, "i": 2}])


@query("SELECT r_regionkey + 1 AS a, upper(r_name) AS b FROM region")
def keys_fn(t):
    return t("region").map(lambda r: {"a": r.r_regionkey + 1, "b": F.upper(r.r_name)})


@query("SELECT string_split(p_name, ' ')[1] AS _1, CAST(len(string_split(p_name, ' ')) - 1 AS BIGINT) AS value FROM part")
def head_fields(t):
    return t("part").map(lambda r: F.split(r.p_name, " ")).head_fields(1, lambda rest: F.size(rest).cast("bigint"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders")
def map_indexed_sorted(t):
    return t("orders").project("o_orderkey").sort_by(lambda r: r.o_orderkey).map_indexed(lambda i, r: {"i": i, "o_orderkey": r.o_orderkey})


@query("SELECT rank() OVER (ORDER BY o_custkey) - 1 AS i, o_orderkey FROM orders")
def map_indexed_rank(t):
    return t("orders").project("o_orderkey", "o_custkey").sort_by(lambda r: r.o_custkey).map_indexed(lambda i, r: {"i": i, "o_orderkey": r.o_orderkey}, ties="rank")


@query("SELECT dense_rank() OVER (ORDER BY o_custkey DESC) - 1 AS i, o_orderkey FROM orders")
def map_indexed_dense(t):
    return t("orders").project("o_orderkey", "o_custkey").sort_by(lambda r: r.o_custkey, "desc").map_indexed(lambda i, r: {"i": i, "o_orderkey": r.o_orderkey}, ties="dense")


# filters --------------------------------------------------------------------
@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') = 'F'")
def filter_pred(t):
    return cols(t("orders").filter(lambda r: F.nullif(r.o_orderstatus, F.lit("O")) == "F"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'O') = 'F', false)")
def remove_pred(t):
    return cols(t("orders").remove(lambda r: F.nullif(r.o_orderstatus, F.lit("O")) == "F"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def take_after_sort(t):
    return cols(t("orders"), "o_orderkey", "o_totalprice").sort_by(lambda r: (r.o_totalprice, r.o_orderkey), "desc").take(10)


@query()
def sample_p(t):
    return cols(t("orders"), "o_orderkey").sample(0.5, seed=1)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R'")
def native_filter(t):
    return cols(t("lineitem").native_filter("l_quantity > 10 and l_returnflag = 'R'"), "l_orderkey", "l_quantity")


# order ----------------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index, o_orderkey FROM orders")
def sort_by_asc(t):
    return cols(t("orders"), "o_totalprice", "o_orderkey").sort().indexed().project("index", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY s_name DESC) - 1 AS index, s_name FROM supplier")
def sort_desc(t):
    return cols(t("supplier"), "s_name").sort("desc").indexed()


# joins ----------------------------------------------------------------------
_O = "(SELECT o_orderkey, nullif(o_custkey + 3, 10) AS k FROM orders)"
_C = "(SELECT c_custkey, nullif(c_custkey, 10) AS k FROM customer)"


def _sides(t, ta="required", tb="required"):
    o = t("orders").map(lambda r: {"o_orderkey": r.o_orderkey, "k": F.nullif(r.o_custkey + 3, F.lit(10))})
    c = t("customer").map(lambda r: {"c_custkey": r.c_custkey, "k": F.nullif(r.c_custkey, F.lit(10))})
    return [on(o, "k", type=ta), on(c, "k", type=tb)]


def _pair(o, c):
    return {"o_orderkey": o.o_orderkey, "c_custkey": c.c_custkey}


for _name, _kinds, _how in (("inner", ("required", "required"), "JOIN"), ("left", ("required", "optional"), "LEFT JOIN"), ("right", ("optional", "required"), "RIGHT JOIN"), ("full", ("optional", "optional"), "FULL JOIN")):
    for _nils in (False, True):
        _key = f"join_nils_{_name}" if _nils else f"join_{_name}"
        QUERIES[_key] = lambda spark, d, kinds=_kinds, nils=_nils: rf.join(_sides(lambda t: Relation(spark.read.parquet(f"{d}/{t}.parquet")), *kinds), _pair, join_nils=nils).df
        SQL[_key] = f"SELECT o_orderkey, c_custkey FROM {_O} o {_how} {_C} c ON o.k {'IS NOT DISTINCT FROM' if _nils else '='} c.k"


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_three_way(t):
    oc = rf.join([on(t("orders"), "o_custkey"), on(t("customer"), "c_custkey")], lambda o, c: {"o_orderkey": o.o_orderkey, "c_name": c.c_name, "c_nationkey": c.c_nationkey})
    return rf.join([on(oc, "c_nationkey"), on(t("nation"), "n_nationkey")], lambda a, n: {"o_orderkey": a.o_orderkey, "c_name": a.c_name, "n_name": n.n_name})


@query("SELECT a.n_name AS a, b.n_name AS b, c.r_name AS c FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region c ON a.n_regionkey = c.r_regionkey")
def join_n_way_one_key(t):
    return rf.join([on(t("nation"), "n_regionkey"), on(t("nation"), "n_regionkey"), on(t("region"), "r_regionkey")], lambda a, b, c: {"a": a.n_name, "b": b.n_name, "c": c.r_name})


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t):
    n = t("nation")
    return rf.join([on(n, "n_regionkey"), on(n, "n_regionkey")], lambda a, b: {"a": a.n_name, "b": b.n_name})


@query("SELECT a.v AS a, b.v AS b FROM (SELECT c_nationkey AS v FROM customer) a JOIN (SELECT n_nationkey AS v FROM nation) b ON a.v = b.v")
def join_default_key(t):
    return rf.join([on(t("customer").map(lambda r: r.c_nationkey)), on(t("nation").map(lambda r: r.n_nationkey))], lambda a, b: {"a": a, "b": b})


@query("SELECT o_custkey AS k, c_name AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def join_all_args(t):
    return rf.join([on(t("orders"), "o_custkey"), on(t("customer"), "c_custkey")], lambda k, o, j, c: {"k": k, "v": c.c_name}, all_args=True)


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast_hint(t):
    return rf.join([on(t("supplier"), "s_nationkey"), on(t("nation"), "n_nationkey")], lambda s, n: {"s_name": s.s_name, "n_name": n.n_name}, strategy="replicated")


@query("SELECT o_orderkey FROM orders JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def filter_by(t):
    keys = t("customer").filter(lambda r: r.c_mktsegment == "BUILDING").map(lambda r: r.c_custkey)
    return cols(rf.filter_by(t("orders"), keys, lambda r: r.o_custkey), "o_orderkey")


@query("SELECT n_name FROM nation JOIN (SELECT s_nationkey AS k FROM supplier) ON n_nationkey = k")
def filter_by_dup_keys(t):
    return cols(rf.filter_by(t("nation"), t("supplier").map(lambda r: r.s_nationkey), lambda r: r.n_nationkey), "n_name")


@query("SELECT n_name FROM nation JOIN (SELECT DISTINCT nullif(r_regionkey, 1) AS k FROM region WHERE r_regionkey < 3) ON nullif(n_regionkey, 4) IS NOT DISTINCT FROM k")
def filter_by_nil(t):
    keys = t("region").filter(lambda r: r.r_regionkey < 3).map(lambda r: F.nullif(r.r_regionkey, F.lit(1)))
    return cols(rf.filter_by(t("nation"), rf.distinct(keys), lambda r: F.nullif(r.n_regionkey, F.lit(4))), "n_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def remove_by(t):
    return cols(rf.remove_by(t("orders"), t("lineitem").map(lambda r: r.l_orderkey), lambda r: r.o_orderkey), "o_orderkey")


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey < 3 AND nullif(r_regionkey, 1) IS NOT DISTINCT FROM nullif(n_regionkey, 4))")
def remove_by_nil(t):
    keys = t("region").filter(lambda r: r.r_regionkey < 3).map(lambda r: F.nullif(r.r_regionkey, F.lit(1)))
    return cols(rf.remove_by(t("nation"), keys, lambda r: F.nullif(r.n_regionkey, F.lit(4))), "n_name")


# groups ---------------------------------------------------------------------
@query("SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_by_collect(t):
    return rf.group_by(t("nation"), lambda r: r.n_regionkey).map(lambda r: {"key": r.key, "names": F.array_join(F.sort_array(F.transform(r["values"], lambda v: v["n_name"])), ",")})


@query("SELECT nullif(o_orderstatus, 'O') AS key, count(*) AS value FROM orders GROUP BY 1")
def group_by_nil_group(t):
    return rf.group_by(t("orders"), lambda r: F.nullif(r.o_orderstatus, F.lit("O")), fold=fold.count())


PRICING_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS qty,
sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price, max(l_discount) AS most, min(l_tax) AS least FROM lineitem GROUP BY 1, 2"""


@query(PRICING_SQL)
def group_by_fold(t):
    f = fold.juxt(n=fold.count(), qty=fold.map(lambda r: money(r.l_quantity)).sum(), price=fold.map(lambda r: money(r.l_extendedprice)).sum(), most=fold.map(lambda r: r.l_discount).max(), least=fold.map(lambda r: r.l_tax).min())
    g = rf.group_by(t("lineitem"), lambda r: {"f": r.l_returnflag, "s": r.l_linestatus}, fold=f)
    return g.map(lambda r: {"l_returnflag": r.key["f"], "l_linestatus": r.key["s"], "n": r.value["n"], "qty": dbl(r.value["qty"]), "price": dbl(r.value["price"]), "most": r.value["most"], "least": r.value["least"]})


_GO = f"(SELECT k, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM {_O} GROUP BY k)"
_GC = f"(SELECT k, count(*) AS n, sum(c_custkey)::BIGINT AS s FROM {_C} GROUP BY k)"


def _cogroup_sql(how: str, nils: bool, o: str = _GO, c: str = _GC) -> str:
    return f"SELECT coalesce(a.k, b.k) AS key, a.n AS na, a.s AS sa, b.n AS nb, b.s AS sb FROM {o} a {how} {c} b ON a.k {'IS NOT DISTINCT FROM' if nils else '='} b.k"


def _sizes(key, a, b):
    size = lambda x: F.when(x.isNotNull(), F.size(x).cast("bigint"))
    total = lambda x, n: F.aggregate(F.transform(x, lambda e: e[n]), F.lit(0).cast("bigint"), operator.add)
    return {"key": key, "na": size(a), "sa": total(a, "o_orderkey"), "nb": size(b), "sb": total(b, "c_custkey")}


for _name, _kinds, _how in (("full", ("optional", "optional"), "FULL JOIN"), ("inner", ("required", "required"), "JOIN"), ("left", ("required", "optional"), "LEFT JOIN"), ("right", ("optional", "required"), "RIGHT JOIN")):
    for _nils in (False, True):
        _key = f"cogroup_{'join_nils_' if _nils else ''}{_name}"
        QUERIES[_key] = lambda spark, d, kinds=_kinds, nils=_nils: rf.cogroup(_sides(lambda t: Relation(spark.read.parquet(f"{d}/{t}.parquet")), *kinds), _sizes, join_nils=nils).df
        SQL[_key] = _cogroup_sql(_how, _nils)


@query(f"SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n, coalesce(b.s, 0) AS s FROM {_GO} a FULL JOIN {_GC} b ON a.k = b.k")
def cogroup_fold_both(t):
    o, c = _sides(t)
    return rf.cogroup([on(o.rel, o.key, fold=fold.count()), on(c.rel, c.key, fold=fold.map(lambda r: r.c_custkey).sum())], lambda k, a, b: {"key": k, "n": a, "s": b})


@query(f"SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n, b.n AS nb FROM {_GO} a FULL JOIN {_GC} b ON a.k = b.k")
def cogroup_fold_one(t):
    o, c = _sides(t)
    return rf.cogroup([on(o.rel, o.key, fold=fold.count()), on(c.rel, c.key)], lambda k, a, b: {"key": k, "n": a, "nb": F.when(b.isNotNull(), F.size(b).cast("bigint"))})


@query("""SELECT n_nationkey AS key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation""")
def cogroup_three_way(t):
    sides = [on(t("nation"), "n_nationkey", fold=fold.count()), on(t("customer"), "c_nationkey", fold=fold.count()), on(t("supplier"), "s_nationkey", fold=fold.count())]
    return rf.cogroup(sides, lambda k, n, c, s: {"key": k, "c": c, "s": s})


@query("SELECT n_regionkey AS key, count(*) AS a, min(n_name) AS b FROM nation GROUP BY 1")
def cogroup_self(t):
    n = t("nation")
    return rf.cogroup([on(n, "n_regionkey", fold=fold.count()), on(n, "n_regionkey", fold=fold.map(lambda r: r.n_name).min())], lambda k, a, b: {"key": k, "a": a, "b": b})


@query("SELECT sum(o_orderkey)::DOUBLE AS value FROM orders")
def reduce_sum(t):
    return rf.reduce_relation(t("orders").map(lambda r: r.o_orderkey), lambda a, x: a + x, 0.0)


@query("SELECT o_orderkey AS value FROM orders WHERE false")
def reduce_empty(t):
    return rf.reduce_relation(t("orders").filter(lambda r: r.o_orderkey < 0).map(lambda r: r.o_orderkey), lambda a, x: a + x, returns="bigint")


@query("SELECT string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation")
def into_vector(t):
    return rf.into(t("nation").map(lambda r: r.n_name)).map(lambda v: F.array_join(F.sort_array(v), ","))


@query("SELECT string_agg(DISTINCT n_regionkey::VARCHAR, ',' ORDER BY n_regionkey::VARCHAR) AS value FROM nation")
def into_set(t):
    return rf.into(t("nation").map(lambda r: r.n_regionkey.cast("string")), "set").map(lambda v: F.array_join(F.sort_array(v), ","))


@query("SELECT count(*) AS value FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
def fold_empty(t):
    return rf.fold_relation(t("orders").filter(lambda r: r.o_orderkey < 0), fold.count())


# folds ----------------------------------------------------------------------
def _fold_query(name: str, sql: str, f: Callable, table: str = "orders", finish: Callable = lambda v: v) -> None:
    QUERIES[name] = lambda spark, d: rf.fold_relation(Relation(spark.read.parquet(f"{d}/{table}.parquet")), f()).map(finish).df
    SQL[name] = sql


def _names(v):
    return F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), ",")


_fold_query("fold_count", "SELECT count(*) AS value FROM orders", lambda: fold.count())
_fold_query("fold_sum", "SELECT sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS value FROM orders", lambda: fold.map(lambda r: money(r.o_totalprice)).sum(), finish=dbl)
_fold_query("fold_avg", "SELECT avg(o_custkey) AS value FROM orders", lambda: fold.map(lambda r: r.o_custkey).avg())
_fold_query("fold_min", "SELECT min(o_totalprice) AS value FROM orders", lambda: fold.map(lambda r: r.o_totalprice).min())
_fold_query("fold_max", "SELECT max(o_totalprice) AS value FROM orders", lambda: fold.map(lambda r: r.o_totalprice).max())
_fold_query("fold_min_nil", "SELECT CAST(NULL AS BIGINT) AS value", lambda: fold.map(lambda r: F.nullif(r.o_custkey, F.lit(7))).min())
_fold_query("fold_count_filtered", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders", lambda: fold.filter(lambda r: r.o_orderstatus == "F").count())
_fold_query("fold_remove", "SELECT count(*) FILTER (WHERE NOT coalesce(nullif(o_orderstatus, 'O') = 'F', false)) AS value FROM orders", lambda: fold.remove(lambda r: F.nullif(r.o_orderstatus, F.lit("O")) == "F").count())
_fold_query("fold_keep", "SELECT count(nullif(o_orderstatus, 'O')) AS value FROM orders", lambda: fold.keep(lambda r: F.nullif(r.o_orderstatus, F.lit("O"))).count())
_fold_query("fold_mapcat_count", "SELECT sum(len(string_split(p_name, ' ')))::BIGINT AS value FROM part", lambda: fold.mapcat(lambda r: F.split(r.p_name, " ")).count(), "part")
_fold_query("fold_mapcat_sum", "SELECT sum(n_nationkey * 2)::BIGINT AS value FROM nation", lambda: fold.mapcat(lambda r: F.array(r.n_nationkey, r.n_nationkey)).sum(), "nation")
_fold_query("fold_vec", "SELECT string_agg(coalesce(nullif(n_name, 'CHINA'), '~'), ',' ORDER BY nullif(n_name, 'CHINA') NULLS FIRST) AS value FROM nation", lambda: fold.map(lambda r: F.nullif(r.n_name, F.lit("CHINA"))).vec().sort(), "nation", _names)
_fold_query("fold_distinct", "SELECT string_agg(s, ',' ORDER BY s) AS value FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)", lambda: fold.map(lambda r: r.o_orderstatus).distinct().sort(), finish=_names)
_fold_query("fold_distinct_nil", "SELECT string_agg(coalesce(s, '~'), ',' ORDER BY s NULLS FIRST) AS value FROM (SELECT DISTINCT nullif(o_orderstatus, 'O') AS s FROM orders)", lambda: fold.map(lambda r: F.nullif(r.o_orderstatus, F.lit("O"))).distinct().sort(), finish=_names)
_fold_query("fold_sort", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation", lambda: fold.map(lambda r: r.n_name).sort(), "nation", _names)
_fold_query("fold_sort_by", "SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS value FROM nation", lambda: fold.sort_by(lambda r: r.n_nationkey, reverse=True), "nation", lambda v: _names(F.transform(v, lambda e: e["n_name"])))
_fold_query("fold_top", "SELECT string_agg(k::VARCHAR, ',' ORDER BY k) AS value FROM (SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 5)", lambda: fold.map(lambda r: r.o_orderkey).top(5), finish=_names)
_fold_query("fold_top_desc", "SELECT string_agg(k::VARCHAR, ',' ORDER BY k DESC) AS value FROM (SELECT o_orderkey AS k FROM orders ORDER BY k DESC LIMIT 5)", lambda: fold.map(lambda r: r.o_orderkey).top(5, reverse=True), finish=_names)
_fold_query("fold_take_sorted", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS value FROM (SELECT n_name FROM nation ORDER BY 1 LIMIT 3)", lambda: fold.map(lambda r: r.n_name).sort().take(3), "nation", _names)
_fold_query("fold_first_sorted", "SELECT min(n_name) AS value FROM nation", lambda: fold.map(lambda r: r.n_name).sort().first(), "nation")
_fold_query("fold_last_sorted", "SELECT max(n_name) AS value FROM nation", lambda: fold.map(lambda r: r.n_name).sort().last(), "nation")
_fold_query("fold_min_key", "SELECT arg_min(p_name, p_partkey) AS value FROM part", lambda: fold.min_key(lambda r: r.p_partkey), "part", lambda v: v["p_name"])
_fold_query("fold_max_key", "SELECT arg_max(p_name, p_partkey) AS value FROM part", lambda: fold.max_key(lambda r: r.p_partkey), "part", lambda v: v["p_name"])


@query("SELECT count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b, avg(o_custkey) AS m FROM orders")
def fold_juxt(t):
    f = fold.juxt(fold.count(), fold.map(lambda r: r.o_orderkey).min(), fold.map(lambda r: r.o_orderkey).max(), fold.map(lambda r: r.o_custkey).avg())
    return rf.fold_relation(t("orders"), f).map(lambda v: {"n": v["_1"], "a": v["_2"], "b": v["_3"], "m": v["_4"]})


@query("SELECT key, string_agg(k::VARCHAR, ',' ORDER BY k DESC) AS value FROM (SELECT o_orderstatus AS key, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 3 GROUP BY key")
def fold_top_by(t):
    g = rf.group_by(t("orders"), lambda r: r.o_orderstatus, fold=fold.top_by(lambda r: r.o_orderkey, 3, reverse=True))
    return g.map(lambda r: {"key": r.key, "value": _names(F.transform(r.value, lambda e: e["o_orderkey"]))})


@query("SELECT l_returnflag AS key, sum(l_quantity * l_quantity) AS value FROM lineitem GROUP BY 1")
def fold_fn_custom(t):
    squares = rf.fold_fn(lambda a, r: a + r["l_quantity"] ** 2, lambda *ab: sum(ab))
    return rf.group_by(cols(t("lineitem"), "l_returnflag", "l_quantity"), lambda r: r.l_returnflag, fold=squares)


# sets -----------------------------------------------------------------------
@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return rf.distinct(cols(t("lineitem"), "l_returnflag", "l_linestatus"))


@query("SELECT DISTINCT c_nationkey FROM customer")
def distinct_partition_by(t):
    return rf.distinct(cols(t("customer"), "c_nationkey"), partition_by=lambda n, r: r.c_nationkey % n, parallel=4)


_SETS = ("SELECT c_nationkey % 7 AS value FROM customer", "SELECT s_nationkey % 5 AS value FROM supplier", "SELECT n_regionkey AS value FROM nation")


def _three(t):
    return [t("customer").map(lambda r: r.c_nationkey % 7), t("supplier").map(lambda r: r.s_nationkey % 5), t("nation").map(lambda r: r.n_regionkey)]


for _name, _word in (("union", "UNION"), ("concat", "UNION ALL"), ("union_multiset", "UNION ALL"), ("intersection", "INTERSECT"), ("intersection_multiset", "INTERSECT ALL"), ("difference", "EXCEPT"), ("difference_multiset", "EXCEPT ALL")):
    QUERIES[_name] = lambda spark, d, f=getattr(rf, _name): f(*_three(lambda t: Relation(spark.read.parquet(f"{d}/{t}.parquet")))).df
    SQL[_name] = f" {_word} ".join(f"({s})" for s in _SETS)


@query(f"SELECT value FROM (SELECT value, count(*) FILTER (WHERE t = 0) AS a, count(*) FILTER (WHERE t = 1) AS b FROM (SELECT value, 0 AS t FROM ({_SETS[0]}) UNION ALL SELECT value, 1 FROM ({_SETS[1]})) GROUP BY value), unnest(range(abs(a - b)))")
def set_op_custom(t):
    a, b, _ = _three(t)
    return rf.set_op(lambda x, y: F.abs(x - y), a, b)


# sources and stores ---------------------------------------------------------
def _round_trip(name: str, sql: str, make: Callable, store: Callable, load: Callable) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        at = scratch(spark, name)
        store(at, make(lambda t: Relation(spark.read.parquet(f"{d}/{t}.parquet"))))
        return _df(load(spark, at))

    QUERIES[name] = run
    SQL[name] = sql


def _nations(t):
    return t("nation").map(lambda r: {"a": r.n_nationkey, "b": F.nullif(r.n_name, F.lit("CHINA"))})


_NATIONS = "SELECT n_nationkey AS a, nullif(n_name, 'CHINA') AS b FROM nation"
_round_trip("io_string", "SELECT n_name AS value FROM nation", lambda t: t("nation").map(lambda r: r.n_name), src.store_string, src.load_string)
_round_trip("io_tsv", "SELECT n_nationkey::VARCHAR AS a, coalesce(nullif(n_name, 'CHINA'), 'nil') AS b FROM nation", _nations, src.store_tsv, lambda s, p: src.load_tsv(s, p).map(lambda v: {"a": v[0], "b": v[1]}))
_round_trip("io_lazy", "SELECT n_nationkey::VARCHAR AS a FROM nation", lambda t: t("nation").map(lambda r: {"a": r.n_nationkey, "b": r.n_name}), lambda p, r: src.store_tsv(p, r, "|"), lambda s, p: src.load_lazy(s, p, "|").map(lambda v: {"a": v[0]}))
_round_trip("io_csv", "SELECT n_nationkey::VARCHAR AS a, 'say \"hi\", ' || n_name AS b FROM nation", lambda t: t("nation").map(lambda r: {"a": r.n_nationkey, "b": F.concat(F.lit('say "hi", '), r.n_name)}), src.store_csv, lambda s, p: src.load_csv(s, p).map(lambda v: {"a": v[0], "b": v[1]}))
_round_trip("io_json", _NATIONS, _nations, src.store_json, lambda s, p: src.load_json(s, p, "a int, b string"))
_round_trip("io_clj", _NATIONS, _nations, src.store_clj, lambda s, p: src.load_clj(s, p, "a int, b string"))
_round_trip("io_binary", _NATIONS, _nations, src.store_binary, src.load_binary)
_round_trip("io_parquet", _NATIONS, _nations, lambda p, r: src.store_parquet(p, src.message("m", src.int32("a"), src.binary("b", "optional")), r), lambda s, p: src.load_parquet(s, p, src.message("m", src.int32("a"), src.binary("b", "optional"))))
_round_trip("io_tap", _NATIONS, _nations, lambda p, r: src.store_tap("orc", p, r), lambda s, p: src.load_tap(s, "orc", p))


def _store_many(spark: SparkSession, d: str) -> DataFrame:
    n = Relation(spark.read.parquet(f"{d}/nation.parquet")).map(lambda r: r.n_nationkey)
    a, b = n.map(lambda v: v * 2), n.map(lambda v: v * 3)
    return src.store_many((lambda r: src.store_string(scratch(spark, "many_a"), r), a), (lambda r: src.store_string(scratch(spark, "many_b"), r), b)).df


QUERIES["store_many"] = _store_many
SQL["store_many"] = "SELECT n_nationkey * 2 AS value FROM nation UNION ALL SELECT n_nationkey * 3 FROM nation"


def _return(spark: SparkSession, d: str) -> DataFrame:
    return rf.constantly(rf.returning(spark, [1, None, 3], "value int"))(d).df


QUERIES["return_constant"] = _return
SQL["return_constant"] = "SELECT * FROM (VALUES (1), (NULL), (3)) v(value)"


# composites -----------------------------------------------------------------
@query("SELECT w AS key, count(*) AS value FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def flow_word_count(t):
    words = t("documents").mapcat(lambda r: F.split(r.text, "[ \\n]+")).filter(lambda w: w != "")
    return rf.group_by(words, lambda w: w, fold=fold.count())


@query("""SELECT c_name, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, c_custkey LIMIT 10""")
def flow_top_customers(t):
    spent = rf.group_by(t("orders"), lambda r: r.o_custkey, fold=fold.map(lambda r: money(r.o_totalprice)).sum())
    named = rf.join([on(spent, "key"), on(t("customer"), "c_custkey")], lambda s, c: {"c_custkey": c.c_custkey, "c_name": c.c_name, "neg": -s.value, "spent": dbl(s.value)})
    return named.sort_by(lambda r: (r.neg, r.c_custkey)).take(10).project("c_name", "spent")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total FROM events GROUP BY 1")
def flow_events(t):
    e = t("events")
    users = rf.group_by(rf.distinct(cols(e, "event_type", "user_id")), lambda r: r.event_type, fold=fold.count())
    f = fold.juxt(n=fold.count(), total=fold.map(lambda r: money(r.value)).sum())
    totals = rf.group_by(e, lambda r: r.event_type, fold=f)
    return rf.join([on(totals, "key"), on(users, "key")], lambda a, u: {"event_type": a.key, "n": a.value["n"], "users": u.value, "total": dbl(a.value["total"])})
