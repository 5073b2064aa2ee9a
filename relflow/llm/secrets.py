"""Secret scans with an incremental blob ledger; DataFrame functions only.

Every text is addressed by its SHA-256.  The ledger records which blobs have
been scanned under which version of the rules, with what they hold; a run scans
only pairs that it lacks, and joins findings back to all documents of a blob.
Where only some texts are wanted, a bitmap of bounded size leaves the others
where they are, so that they aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.functions.lambdas import quoted
from relflow.llm.bitmaps import might_be
from relflow.sources.scratch import scratch, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and don't overlap; those that are too short are dropped.

    ``measured`` is the group whose code points ``least`` counts.  ``hint`` is
    text without which the pattern can't match: a cheap test before it.
    """

    kind: str
    pattern: str
    least: int
    measured: int = 0
    hint: str | None = None


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
#: Further kinds, by the public formats of such tokens.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28, 0, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 27, 0, "PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, "gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0, "xox"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,128}@", 12, 0, "://"),
)
RULES = BASE + MORE

#: Code points of the pieces in which a text is cut.
PIECE = 4_096


def version_of(rules: tuple[Rule, ...]) -> str:
    """The version of a set of rules: any change of a rule or of their order makes another."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """One struct for each match, in order: the rule's rank, and the lengths of what stands before it, of itself and of what is measured."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured)) if rule.measured else found
    zipped = F.arrays_zip(found.alias("m"), measured.alias("v"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("g"))
    sized = F.transform(zipped, lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["g"]).alias("before"), F.length(x["m"]).alias("n"), F.length(x["v"]).alias("measured")))
    may = F.regexp_like(text, pattern) if rule.hint is None else F.contains(text, F.lit(rule.hint))
    return F.when(may, sized).otherwise(F.expr("cast(array() as array<struct<rank: int, before: int, n: int, measured: int>>)"))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, key, findings) of rows (blob, key, t), one for each blob: spans in code points, by start and then by the order of the rules.

    Lengths of matches and of what stands between them are summed along each
    rule's matches, so the work is linear in a text, however many matches it has.
    """
    every = reduce(F.concat, [_matches(F.col("t"), r, i) for i, r in enumerate(rules)])
    rows = blobs.select("blob", "key", F.posexplode_outer(every).alias("at", "x")).select("blob", "key", "at", "x.*")
    along = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("n")).over(along).cast("int"))
    kind, least = (F.array(*[F.lit(x) for x in xs])[F.col("rank")] for xs in ([r.kind for r in rules], [r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "rank", kind.alias("kind"), "end")
    return rows.groupBy("blob", "key").agg(F.array_sort(F.collect_list(F.when(F.col("measured") >= least, span))).alias("findings"))


def address(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _key(text: Column) -> Column:
    """A short hash of a text, for the bitmap; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


def scan_blobs(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the blobs of ``docs`` that the ledger lacks under the version of ``rules``, and returns that version's ledger.

    The ledger is a Parquet folder of (version, blob, key, findings); it grows by one
    row for each new blob.  Copies of a text meet in their map tasks first, so a
    hot blob costs no task more than a row from each.  Texts whose blobs are known
    are not shuffled.  Runs that scan one blob at once may both write it; it is read once.
    """
    spark, version = docs.sparkSession, version_of(rules)
    t = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    texts = docs.select(t.alias("t"))
    if _exists(docs, ledger):
        known = texts.select(address(F.col("t")).alias("blob"), _key(F.col("t")).alias("key")).distinct()
        new = written(known.join(_read(spark, ledger, version).select("blob"), "blob", "left_anti"), "unseen")
        if not new.limit(1).count():
            return _read(spark, ledger, version)
        texts = might_be(texts, _key(F.col("t")), new.select("key"), "__new").where("__new")
        blobs = _blobs(texts).join(new.select("blob"), "blob", "left_semi")
    else:
        blobs = _blobs(texts)
    findings(blobs, rules).select(F.lit(version).alias("version"), "blob", "key", "findings").write.mode("append").parquet(ledger)
    return _read(spark, ledger, version)


def _blobs(texts: DataFrame) -> DataFrame:
    return texts.select(address(F.col("t")).alias("blob"), "t").groupBy("blob").agg(F.first("t").alias("t")).withColumn("key", _key(F.col("t")))


def _read(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    return spark.read.parquet(ledger).where(F.col("version") == version).select("blob", "key", "findings").dropDuplicates(["blob"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: the counts of the base kinds, the digest of their spans, and all ``spans``.

    A span is kind:start:end in code points, end exclusive; they are ordered by
    start and kind and joined by commas.  Null counts as empty: no spans.  Bytes
    that aren't UTF-8 count as the replacement characters that they are read as.
    Documents with one text share its findings; rows with one id or none are rows
    of their own.  Other columns are not read.  Without a ``ledger`` a new one is
    made in the shared folder.  An empty table gives an empty table.  A very long
    text is one task's work, in time and memory linear in its length.
    """
    book = scan_blobs(docs, ledger or scratch(docs.sparkSession, "ledger"), text, rules)
    paths = docs.select(F.col(quoted(doc_id)).alias(doc_id), address(F.col(quoted(text))).alias("blob"))
    ours = [r.kind for r in BASE]
    base = F.filter("findings", lambda s: s["kind"].isin(ours))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint")
    digests = book.select("blob", *[count(k).alias(f"n_{k}") for k in ours], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("findings")).alias("spans"))
    # a join of two plain exchanges, so that Spark can split a blob of very many paths
    return paths.join(written(digests, "digests"), "blob").drop("blob")


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b, b exclusive, of a text in pieces of PIECE."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    cut = lambda p, lo, n: F.substring(F.coalesce(F.get(pieces, p), F.lit("")), (lo + 1).cast("int"), n.cast("int"))
    head, tail = cut(i, a - i * PIECE, F.lit(PIECE)), cut(j, F.lit(0), b - j * PIECE)
    inner = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(b <= a, F.lit("")).when(i == j, cut(i, a - i * PIECE, b - a)).otherwise(F.concat(head, inner, tail))


def redact(docs: DataFrame, text: str = "text", mark: Callable[[Column], Column] | None = None, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding in the text replaced by ``[kind]``; overlapping spans by the first one's.

    Texts without findings, null and empty ones included, stay as they are, and
    so do all other columns, whatever their names.  Only texts with findings (and
    the few that the bitmap takes for such) are shuffled.  The work is linear in a
    text and its findings.
    """
    book = scan_blobs(docs, ledger or scratch(docs.sparkSession, "ledger"), text, rules).where(F.size("findings") > 0)
    mark = mark or (lambda kind: F.concat(F.lit("["), kind, F.lit("]")))
    # overlapping spans make one region each
    before = Window.partitionBy("blob").orderBy("x.start", "x.rank")
    spans = book.select("blob", F.explode("findings").alias("x")).withColumn("reach", F.coalesce(F.max("x.end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opens = F.col("x.start") >= F.col("reach")
    regions = spans.withColumn("region", F.sum(opens.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    regions = regions.groupBy("blob", "region").agg(F.min("x.start").alias("start"), F.min("reach").alias("after"), F.min(F.struct("x.start", "x.rank", "x.kind"))["kind"].alias("kind"), F.max("x.end").alias("end"))
    found = written(regions.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "after", "kind", "end"))).alias("found")), "regions")
    # columns by number, so that none has the name of one that is added
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    where = docs.columns.index(text)
    t = F.col(f"c{where}")
    flagged = might_be(numbered, _key(t), book.select("key"), "__hot")
    hot = flagged.where("__hot").drop("__hot").withColumn("blob", address(t)).join(found, "blob", "left")
    whole = t.cast("string")
    # one struct in an array, so that each of its fields is computed once and not for each region
    once = F.array(F.struct(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("p"), F.col("found").alias("r"), F.length(whole).alias("n")))

    def clean(s: Column) -> Column:
        cut = F.transform(s["r"], lambda r: F.concat(_between(s["p"], r["after"], r["start"]), mark(r["kind"])))
        return F.concat(F.array_join(cut, ""), _between(s["p"], F.element_at(s["r"], -1)["end"], s["n"]))

    hot = hot.withColumn(f"c{where}", F.when(F.col("found").isNull(), t).otherwise(F.transform(once, clean)[0]))
    return flagged.where(~F.col("__hot")).select(*numbered.columns).unionByName(hot.select(*numbered.columns)).toDF(*docs.columns)
