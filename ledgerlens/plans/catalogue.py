"""The library's queries over the driver's tables, each beside SQL with the same rows.

Fractions are rounded to six digits on both sides: engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.functions import text as T
from ledgerlens.operators import align, dedup, geometry, graph, joins, sampling
from ledgerlens.plans import audits, compare, funnel
from ledgerlens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- snapshots and metrics



def categories() -> dict:
    return {"lang": F.col("lang"), "source": F.col("source"), "length": F.floor(F.col("n_chars") / 500)}



_SNAPSHOT = """
  SELECT dim, count(*) AS k, sum(n) AS total, sum(n * log2(n)) AS plogp, sum(n * r) AS ranked FROM (
    SELECT dim, cat, n, row_number() OVER (PARTITION BY dim ORDER BY n) AS r FROM (
      SELECT dim, cat, count(*)::DOUBLE AS n FROM (
        SELECT 'lang' AS dim, lang AS cat FROM {t} UNION ALL SELECT 'source', source FROM {t} UNION ALL SELECT 'length', CAST(n_chars // 500 AS VARCHAR) FROM {t}) WHERE cat IS NOT NULL GROUP BY ALL)) GROUP BY dim"""
_METRICS = """
  SELECT 'n_rows' AS metric, count(*)::DOUBLE AS value FROM {t}
  UNION ALL SELECT 'labelled_fraction', avg(labelled::INT) FROM {t}
  UNION ALL SELECT dim || '_entropy_bits', log2(total) - plogp / total FROM {s}
  UNION ALL SELECT dim || '_normalized_entropy', CASE WHEN k > 1 THEN (log2(total) - plogp / total) / log2(k) ELSE 0 END FROM {s}
  UNION ALL SELECT dim || '_gini', (2 * ranked - (k + 1) * total) / (k * total) FROM {s}
  UNION ALL SELECT dim || '_n_unique', k::DOUBLE FROM {s}"""


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with whether they are labelled, and the hash of their text."""
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled")).dropDuplicates(["doc_id"])
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("cluster_rep"))
    return docs.join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


_DOCS = "d AS (SELECT doc_id, lang, source, n_chars, md5(text) AS cluster_rep, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)"


@query(f"WITH {_DOCS}, s AS ({_SNAPSHOT.format(t='d')}) SELECT metric, round(value, 6) AS value FROM ({_METRICS.format(t='d', s='s')})")
def diversity_snapshot_documents(spark, sf):
    df = labelled_documents(spark, sf)
    return rounded(compare.snapshot(df, categories(), {"labelled_fraction": F.col("labelled")}), "value")


@query(f"""
WITH {_DOCS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_rep ORDER BY labelled DESC, doc_id) AS place FROM d) WHERE place = 1),
sb AS ({_SNAPSHOT.format(t='d')}), sa AS ({_SNAPSHOT.format(t='r')}),
b AS ({_METRICS.format(t='d', s='sb')}), a AS ({_METRICS.format(t='r', s='sa')})
SELECT metric, round(b.value, 6) AS before, round(a.value, 6) AS after, round(a.value - b.value, 6) AS absolute_delta, round((a.value - b.value) / nullif(b.value, 0), 6) AS relative_delta
FROM b FULL JOIN a USING (metric)""")
def before_after_dedup(spark, sf):
    df = labelled_documents(spark, sf)
    return compare.before_after(df, "cluster_rep", [F.desc("labelled"), "doc_id"], categories(), {"labelled_fraction": F.col("labelled")})


@query("""
WITH c AS (SELECT md5(text) AS c, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_sequences, count(*) AS n_clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest,
  round(sum(n)::DOUBLE / count(*), 6) AS compression, round((count(*) FILTER (n = 1))::DOUBLE / count(*), 6) AS singleton_fraction,
  round(coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n), 6) AS exact_duplicate_fraction FROM c""")
def cluster_size_summary(spark, sf):
    df = table(spark, sf, "documents").select(F.md5("text").alias("c"))
    return rounded(dedup.cluster_sizes(df, "c", "c"), "compression", "singleton_fraction", "exact_duplicate_fraction")


@query("SELECT md5(text) AS cluster_rep, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_clusters(spark, sf):
    return dedup.top_clusters(table(spark, sf, "documents").select(F.md5("text").alias("cluster_rep")), "cluster_rep", 10)


_SUMMARY_SQL = """
WITH c AS ({counts}), r AS (SELECT dim, n::DOUBLE AS n, row_number() OVER (PARTITION BY dim ORDER BY n) AS r FROM c)
SELECT dim, {value} AS {name} FROM r GROUP BY dim"""
_THREE = "SELECT 'p_brand' AS dim, p_brand AS cat, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'n_name', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


def three_histograms(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda df, c: M.counts(df, c).select(F.lit(c).alias("dim"), F.col(c).alias("cat"), "n")
    by_nation = M.counts(table(spark, sf, "customer"), "c_nationkey").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("n_name").alias("dim"), F.col("n_name").alias("cat"), "n")
    return named(table(spark, sf, "part"), "p_brand").unionByName(named(table(spark, sf, "customer"), "c_mktsegment")).unionByName(by_nation)


@query(f"""
WITH c AS ({_THREE})
SELECT dim, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits, round(CASE WHEN count(*) > 1 THEN (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) ELSE 0 END, 6) AS normalized_entropy FROM c GROUP BY dim""")
def category_entropy(spark, sf):
    return rounded(M.summary(three_histograms(spark, sf), "dim").select("dim", "entropy_bits", "normalized_entropy"), "entropy_bits", "normalized_entropy")


@query(_SUMMARY_SQL.format(counts=_THREE, value="round((2 * sum(n * r) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)), 6)", name="gini"))
def category_gini(spark, sf):
    return rounded(M.summary(three_histograms(spark, sf), "dim").select("dim", "gini"), "gini")


@query(_SUMMARY_SQL.format(counts=_THREE, value="round(1 - sum(n * n) / (sum(n) * sum(n)), 6)", name="simpson"))
def category_simpson(spark, sf):
    return rounded(M.summary(three_histograms(spark, sf), "dim").select("dim", "simpson"), "simpson")


@query("""
SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median, round(stddev_samp(n_chars), 6) AS std_sample, round(stddev_pop(n_chars), 6) AS std_population,
  round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(avg((n_chars < 1000)::INT), 6) AS below_1000
FROM documents""")
def length_distribution_stats(spark, sf):
    return rounded(M.describe(table(spark, sf, "documents"), "n_chars", below=(1000.0,)), "mean", "median", "std_sample", "std_population", "p95", "p99", "below_1000")


def two_populations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("k"))
    return M.align(M.counts(rows.where("l_returnflag = 'A'"), "k"), M.counts(rows.where("l_returnflag = 'R'"), "k"), "k")


_PQ = """
WITH a AS (SELECT CAST(l_quantity AS INT) AS k, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT CAST(l_quantity AS INT) AS k, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT k, coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b USING (k))"""


@query(_PQ + "SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM j")
def jsd_two_populations(spark, sf):
    return rounded(M.jensen_shannon(two_populations(spark, sf)), "jsd")


@query(_PQ + "SELECT k, round(p, 6) AS p, round(q, 6) AS q, round(p - q, 6) AS residual FROM j")
def histogram_residuals(spark, sf):
    return rounded(M.residuals(two_populations(spark, sf), "k"), "p", "q", "residual")


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT 5 AS k, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, p_brand LIMIT 5))::DOUBLE / sum(n), 6) AS share FROM c")
def topk_share(spark, sf):
    return rounded(M.top_share(M.counts(table(spark, sf, "part"), "p_brand"), 5, "p_brand"), "share")


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY 1")
def group_mean_std_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("std"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT strftime(o_orderdate, '%m/%d/%y') AS d, o_orderstatus FROM orders), y AS (SELECT CAST(split_part(d, '/', 3) AS INT) AS yy, o_orderstatus FROM o)
SELECT CASE WHEN yy <= 69 THEN 2000 + yy ELSE 1900 + yy END AS year, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM y GROUP BY 1""")
def rate_by_year(spark, sf):
    rows = table(spark, sf, "orders").select(F.date_format("o_orderdate", "MM/dd/yy").alias("date"), "o_orderstatus")
    return rounded(audits.rate_by_year(rows, F.col("o_orderstatus") == "F"), "rate")


def nation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customer's and supplier's nation of each order line, of unlike spelling."""
    nation = table(spark, sf, "nation")
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("a"))
    supp = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name")).alias("b"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(supp, "l_suppkey").join(orders, "l_orderkey").select("a", "b")


_NATIONS = """
WITH p AS (SELECT cn.n_name AS a, CASE WHEN s_suppkey % 2 = 0 THEN ' ' || lower(sn.n_name) ELSE sn.n_name END AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""


@query(_NATIONS + "SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS raw_rate, round(avg((lower(trim(a)) = lower(trim(b)))::INT), 6) AS normalized_rate FROM p")
def pairing_match_rate(spark, sf):
    return rounded(M.species_agreement(nation_pairs(spark, sf), "a", "b"), "raw_rate", "normalized_rate")


@query(_NATIONS + "SELECT a || ' / ' || b AS pair, count(*) AS n FROM p WHERE lower(trim(a)) <> lower(trim(b)) GROUP BY 1 ORDER BY n DESC, pair LIMIT 10")
def top_mismatches(spark, sf):
    return M.mismatches(nation_pairs(spark, sf), "a", "b")


# ---- joins


@query("""
SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders) ON c_custkey = o_custkey AND place = 1""")
def priority_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_totalprice")
    return joins.priority_join(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("c_custkey", "o_orderkey", "o_orderpriority")


@query("""
WITH l AS (SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS pri FROM orders),
e AS (SELECT o_custkey AS cust, o_orderpriority AS pri, max(o_orderkey) AS v FROM orders GROUP BY ALL),
f AS (SELECT o_custkey AS cust, min(o_orderkey) AS v FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1)
SELECT l.id, coalesce(e.v, f.v) AS value, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS match
FROM l LEFT JOIN e ON l.cust = e.cust AND l.pri = e.pri LEFT JOIN f ON l.cust = f.cust""")
def fallback_join(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderpriority")).alias("pri"))
    right = orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("pri"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("at"))
    return joins.fallback_join(left, right, ["cust", "pri"], "cust", ["pri"], ["at"], "value").select("id", "value", "match")


@query("""
WITH l AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k, nullif(c_mktsegment, 'BUILDING') AS m FROM customer),
r AS (SELECT nullif(c_nationkey, 3) AS k, nullif(c_mktsegment, 'BUILDING') AS m, min(c_custkey) AS first_id, count(*) AS fan_out FROM customer GROUP BY ALL)
SELECT c_custkey, first_id, fan_out FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k AND l.m IS NOT DISTINCT FROM r.m""")
def null_safe_join(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("m"))
    right = rows.withColumnRenamed("c_custkey", "first_id")
    return joins.null_safe_join(rows, right, ["k", "m"], "first_id").select("c_custkey", "first_id", "fan_out")


@query("""
WITH w AS (SELECT p_partkey, p_size, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, p_size ORDER BY p_partkey DESC) AS place FROM w) WHERE place = 1),
i AS (SELECT p_partkey AS id, p_size, split_part(p_name, ' ', 1) AS word FROM part)
SELECT id, word, k.p_partkey AS last_part FROM i JOIN k USING (word, p_size)""")
def containment_join(spark, sf):
    part = table(spark, sf, "part")
    left = part.select(F.col("p_partkey").alias("id"), "p_size", F.split("p_name", " ")[0].alias("word"))
    right = part.select("p_size", F.col("p_partkey").alias("last_part"), F.split("p_name", " ").alias("words"))
    return joins.containment_join(left, right, ["p_size"], "word", "words", F.desc("last_part")).select("id", "word", "last_part")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(abs(a.p_retailprice - b.p_retailprice), 4) AS gap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def pair_join_within_cluster(spark, sf):
    pairs = joins.pairs_within(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice")
    return pairs.select("a", "b", S.round_away(F.abs(F.col("value_a") - F.col("value_b")), 4).alias("gap"))


@query("""
WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS equal_pairs, CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS all_pairs, CAST(sum(n) * (sum(n) - 1) // 2 - sum(n * (n - 1) // 2) AS BIGINT) AS unequal_pairs FROM n GROUP BY 1""")
def pair_length_mismatch(spark, sf):
    return joins.pair_counts(table(spark, sf, "part"), "p_brand", "p_size")


@query("""
WITH d AS (SELECT md5(text) AS t, source FROM documents), a AS (SELECT t, source, count(*) OVER (PARTITION BY t) AS n, count(*) OVER (PARTITION BY source, t) AS m FROM d)
SELECT round(avg((n > 1)::INT), 6) AS by_text, round(avg((m > 1)::INT), 6) AS by_source_text FROM a""")
def value_shared_fraction(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("t"), "source")
    rows = M.shared_flag(M.shared_flag(rows, "t").withColumnRenamed("shared", "a"), "source", "t")
    return rows.agg(F.round(F.avg(F.col("a").cast("int")), 6).alias("by_text"), F.round(F.avg(F.col("shared").cast("int")), 6).alias("by_source_text"))


@query("""
SELECT 'rows' AS level, count(*) AS n FROM lineitem UNION ALL SELECT 'order_part', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
UNION ALL SELECT 'part_supplier', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'order', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def entity_accounting(spark, sf):
    return compare.accounting(table(spark, sf, "lineitem"), order_part=["l_orderkey", "l_partkey"], part_supplier=["l_partkey", "l_suppkey"], order=["l_orderkey"])


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), x AS (SELECT a, count(*) AS n FROM p GROUP BY 1), y AS (SELECT b, count(*) AS n FROM p GROUP BY 1)
SELECT 'o_custkey' AS key, count(*) AS keys, count(*) FILTER (n > 1) AS with_many, max(n) AS most FROM x UNION ALL SELECT 'l_suppkey', count(*), count(*) FILTER (n > 1), max(n) FROM y""")
def one_to_many(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey")
    return M.one_to_many(rows, "o_custkey", "l_suppkey")


# ---- classes, sequences and runs

_EDGE = "(?:^|[^a-z0-9_]){}(?:$|[^a-z0-9_])"  # engines differ in word boundaries beside accented letters
RULES = T.Rules(
    (
        ("conversation", (T.Keyword("you"), T.Keyword("what"))),
        ("place", (T.Keyword("where"), T.Keyword("there", inside=True, unless=("therein", "thereand")))),
        ("person", (T.Keyword("who"), T.Keyword("idiot"), T.Keyword("loser"))),
        ("license", (T.Keyword("licens", inside=True),)),
    ),
    "other",
    edge=_EDGE,
)
_CLASS = f"""CASE WHEN regexp_matches(lower({{c}}), '{_EDGE.format("(?:you|what)")}') THEN 'conversation'
 WHEN regexp_matches(lower({{c}}), '{_EDGE.format("(?:where)")}') OR (contains(lower({{c}}), 'there') AND NOT contains(lower({{c}}), 'therein') AND NOT contains(lower({{c}}), 'thereand')) THEN 'place'
 WHEN regexp_matches(lower({{c}}), '{_EDGE.format("(?:who|idiot|loser)")}') THEN 'person' WHEN contains(lower({{c}}), 'licens') THEN 'license' ELSE 'other' END"""


@query(f"SELECT {_CLASS.format(c='text')} AS class, lang, count(*) AS n FROM documents GROUP BY ALL")
def keyword_classifier(spark, sf):
    return table(spark, sf, "documents").select(T.classify(F.col("text"), RULES).alias("class"), "lang").groupBy("class", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT {_CLASS.format(c='text')} AS class, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY 1")
def crosstab_class_flag(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", T.classify(F.col("text"), RULES).alias("class"))
    return M.crosstab(docs.join(table(spark, sf, "labels"), "doc_id"), "class", "toxic", [0, 1])


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, letter, n), from per-text counts: no row for each letter is made."""
    docs = table(spark, sf, "documents").select("lang", *R.letter_counts(F.lower("text"), _LETTERS))
    sums = docs.groupBy("lang").agg(*[F.sum(f"n_{c}").alias(c) for c in _LETTERS])
    return sums.unpivot("lang", list(_LETTERS), "letter", "n").where("n > 0")


_LETTER_SQL = "WITH c AS (SELECT lang, unnest(string_split(lower(text), '')) AS letter FROM documents), n AS (SELECT lang, letter, count(*) AS n FROM c WHERE letter BETWEEN 'a' AND 'z' AND length(letter) = 1 GROUP BY ALL)"


@query(_LETTER_SQL + "SELECT lang, letter, n FROM n")
def char_composition(spark, sf):
    return letters_by_language(spark, sf)


@query(_LETTER_SQL + """, w AS (SELECT letter, coalesce(sum(n) FILTER (lang = 'en'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (lang = 'fr'), 0)::DOUBLE AS b FROM n GROUP BY 1), p AS (SELECT letter, a / sum(a) OVER () AS pa, b / sum(b) OVER () AS pb FROM w)
SELECT letter, round(pa, 6) AS share_a, round(pb, 6) AS share_b, round(pa / nullif(pb, 0), 6) AS fold FROM p""")
def composition_fold_change(spark, sf):
    return R.fold_change(letters_by_language(spark, sf), "lang", "en", "fr")


@query("""
WITH c AS (SELECT lang, length(text) AS n, (length(text) - length(replace(text, 'e', '')))::DOUBLE / nullif(length(text), 0) AS s, length(text) - length(replace(text, 'e', '')) AS e FROM documents)
SELECT lang, round(sum(e)::DOUBLE / sum(n), 6) AS pooled, round(avg(s), 6) AS mean_of_profiles FROM c GROUP BY 1""")
def weighted_composition(spark, sf):
    n, e = F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    rows = table(spark, sf, "documents").select("lang", n.alias("n"), e.alias("e"))
    return rows.groupBy("lang").agg(F.round(F.sum("e") / F.sum("n"), 6).alias("pooled"), F.round(F.avg(S.ratio(F.col("e"), F.col("n"))), 6).alias("mean_of_profiles"))


_RUNS = """
WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value > 50 AS hit FROM events),
i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM o WHERE hit),
r AS (SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS length FROM i GROUP BY user_id, island)"""


@query(_RUNS + "SELECT user_id, first, last, length FROM r")
def masked_runs(spark, sf):
    return R.row_runs(table(spark, sf, "events"), F.col("value") > 50, "user_id", "ts", "event_id")


@query(_RUNS + """, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM r)
SELECT user_id, count(*) AS n_runs, CAST(max(first) - 1 AS INT) AS last_first, CAST(max(CASE WHEN k = 3 OR (m < 3 AND k = m) THEN first - 1 END) AS INT) AS third_first FROM q GROUP BY 1""")
def masked_run_rules(spark, sf):
    rules = R.run_rules(masked_runs(spark, sf), "user_id")
    return rules.select("user_id", "n_runs", *[(F.col(f"{c}.first") - 1).cast("int").alias(name) for c, name in (("last", "last_first"), ("third_or_last", "third_first"))])


@query("SELECT substr(sha256(p_name), 1, 8) AS h, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def hash_prefix_key(spark, sf):
    return table(spark, sf, "part").groupBy(T.sha8(F.col("p_name")).alias("h")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("""
WITH w AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS part FROM part) SELECT part, count(*) AS n FROM w WHERE part <> '' GROUP BY 1""")
def multi_value_parse(spark, sf):
    return table(spark, sf, "part").select(F.explode(T.parts_of(F.col("p_name"), " ")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'MISSING') AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_header_scan(spark, sf):
    return table(spark, sf, "events").select(F.coalesce(F.get_json_object("props", "$.k"), F.lit("MISSING")).alias("k"), "event_type").groupBy("k", "event_type").agg(F.count("*").alias("n"))


# ---- sampling and scoring


@query("""
WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), r AS (SELECT *, 1000.0::DOUBLE * size / (SELECT sum(size) FROM s) AS raw FROM s),
f AS (SELECT *, floor(raw) AS fl, row_number() OVER (ORDER BY raw - floor(raw) DESC, c_mktsegment) AS place, 1000 - sum(floor(raw)) OVER () AS rest FROM r)
SELECT c_mktsegment, size, CAST(least(fl + (place <= rest)::INT, size) AS BIGINT) AS allocated FROM f""")
def proportional_allocation(spark, sf):
    sizes = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("size"))
    return sampling.proportional_allocation(sizes, "c_mktsegment", "size", 1000)


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", 20)


@query("""
WITH a AS (SELECT event_id, 'random' AS stratum FROM events ORDER BY md5('1:' || event_id), event_id LIMIT 50),
b AS (SELECT event_id, 'high' AS stratum FROM events WHERE value > 80 AND event_id NOT IN (SELECT event_id FROM a) ORDER BY md5('2:' || event_id), event_id LIMIT 30)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def disjoint_strata(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return sampling.disjoint_strata(rows, "event_id", [("random", rows, 50, 1), ("high", rows.where("value > 80"), 30, 2)]).select("event_id", "stratum")


_SCORED = "WITH s AS (SELECT quality AS truth, (n_chars >= 1000)::INT AS called FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("called"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")


@query(_SCORED + """, g AS (SELECT called, sum((truth = called)::INT)::DOUBLE AS h, count(*)::DOUBLE AS n FROM s GROUP BY 1), w AS (SELECT *, h / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT called, CAST(n AS BIGINT) AS n, round(p, 6) AS rate, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS low,
  round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS high FROM w""")
def wilson_by_class(spark, sf):
    rows = scored(spark, sf).groupBy("called").agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("called")).cast("int")).alias("h"))
    return rounded(rows.select("called", "n", S.wilson(F.col("h"), F.col("n")).alias("w")).select("called", "n", "w.*"), "rate", "low", "high")


@query(_SCORED + "SELECT t.x AS truth, c.x AS called, count(s.truth) AS n FROM (VALUES (0), (1)) t(x) CROSS JOIN (VALUES (0), (1)) c(x) LEFT JOIN s ON s.truth = t.x AND s.called = c.x GROUP BY ALL")
def confusion_scoring(spark, sf):
    return S.confusion(scored(spark, sf), "truth", "called", [0, 1])


@query(_SCORED + """, k AS (SELECT x AS class, sum((truth = x)::INT) AS support, sum((called = x)::INT) AS calls, sum((truth = x AND called = x)::INT) AS hits FROM s, (VALUES (0), (1)) v(x) GROUP BY 1)
SELECT class, round(hits::DOUBLE / nullif(calls, 0), 6) AS precision, round(hits::DOUBLE / nullif(support, 0), 6) AS recall, round(2.0::DOUBLE * hits / nullif(calls + support, 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM k WHERE calls + support > 0""")
def class_scores(spark, sf):
    return rounded(S.class_scores(scored(spark, sf), "truth", "called"), "precision", "recall", "f1")


# ---- graphs and splits

_SPLIT = "CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END"


@query(f"""
WITH r AS (SELECT {_SPLIT} AS split, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT 'l_partkey' AS relation, p AS v, split FROM r UNION ALL SELECT 'l_suppkey', s, split FROM r), g AS (SELECT relation, v, min(split) <> max(split) AS leaks, count(*) AS n FROM v GROUP BY ALL)
SELECT relation, count(*) AS n_values, count(*) FILTER (leaks) AS n_leaked, CAST(coalesce(sum(n) FILTER (leaks), 0) AS BIGINT) AS rows_of_leaked FROM g GROUP BY 1""")
def leakage_metrics(spark, sf):
    split = F.when(F.col("l_orderkey") % 10 < 8, "train").when(F.col("l_orderkey") % 10 == 8, "val").otherwise("test")
    return graph.leakage(table(spark, sf, "lineitem").select(split.alias("split"), "l_partkey", "l_suppkey"), "split", ["l_partkey", "l_suppkey"])


def linked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts linked by equal name, and by equal price of the same type."""
    price = F.concat_ws("|", F.round(F.col("p_retailprice") * 100).cast("long"), "p_type")
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.md5("p_name").alias("name"), price.alias("price"))


_COMPONENTS = """
WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand, 'n' || md5(p_name) AS a, 'p' || CAST(round(p_retailprice * 100) AS BIGINT) || '|' || p_type AS b FROM part),
e AS (SELECT k, a AS v FROM p UNION ALL SELECT k, b FROM p), n AS (SELECT DISTINCT x.k AS s, y.k AS t FROM e x JOIN e y USING (v)),
reach AS (SELECT k AS s, k AS t FROM p UNION SELECT r.s, n.t FROM reach r JOIN n ON r.t = n.s),
c AS (SELECT s AS p_partkey, min(t) AS component FROM reach GROUP BY 1)"""


@query(_COMPONENTS + "SELECT p_partkey, component FROM c")
def connected_components(spark, sf):
    return graph.components(linked_parts(spark, sf), "p_partkey", ["name", "price"]).select("p_partkey", "component")


_GREEDY = """, s AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS i, (SELECT count(*) FROM documents) AS total FROM (SELECT lang || '/' || source AS component, count(*) AS n FROM documents GROUP BY 1)),
g AS (SELECT 0::BIGINT AS i, 0.8::DOUBLE * (SELECT max(total) FROM s) AS a, 0.1::DOUBLE * (SELECT max(total) FROM s) AS b, 0.1::DOUBLE * (SELECT max(total) FROM s) AS c, NULL::VARCHAR AS component, NULL::BIGINT AS n, NULL::VARCHAR AS split
  UNION ALL SELECT s.i, CASE WHEN a >= b AND a >= c THEN a - s.n ELSE a END, CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - s.n ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND NOT b >= c THEN c - s.n ELSE c END,
    s.component, s.n, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END FROM g JOIN s ON s.i = g.i + 1)"""


@query("WITH RECURSIVE x AS (SELECT 1)" + _GREEDY + " SELECT component, n, split FROM g WHERE i > 0")
def greedy_split(spark, sf):
    sizes = table(spark, sf, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("component")).agg(F.count("*").alias("n"))
    return graph.greedy_partition(sizes)


@query("WITH RECURSIVE x AS (SELECT 1)" + _GREEDY + """, d AS (SELECT split, lang, count(*) AS n FROM documents JOIN g ON lang || '/' || source = component WHERE i > 0 GROUP BY ALL)
SELECT split, lang, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY split), 6) AS percent FROM d""")
def component_composition(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.concat_ws("/", "lang", "source").alias("component"))
    parts = graph.greedy_partition(docs.groupBy("component").agg(F.count("*").alias("n")))
    return rounded(graph.split_profile(docs.join(parts.select("component", "split"), "component"), "split", "lang"), "percent")


@query(_COMPONENTS + """, r AS (SELECT component, CASE WHEN p_partkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM c), g AS (SELECT component, min(split) <> max(split) AS cut, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS components, count(*) FILTER (cut) AS cut, CAST(coalesce(sum(n) FILTER (cut), 0) AS BIGINT) AS rows_in_cut FROM g""")
def components_cut(spark, sf):
    rows = graph.components(linked_parts(spark, sf), "p_partkey", ["name", "price"])
    return graph.cut_components(rows.withColumn("split", F.when(F.col("p_partkey") % 10 < 8, "train").otherwise("test")), "component", "split")


# ---- deduplication and sensitivity


@query("""
WITH d AS (SELECT doc_id, md5(text) AS c, source FROM documents), t AS (SELECT s AS seed, d.*, row_number() OVER (PARTITION BY s, c ORDER BY md5(s || ':' || doc_id), doc_id) AS r FROM d, range(20) x(s)),
n AS (SELECT seed, source, count(*)::DOUBLE AS n FROM t WHERE r = 1 GROUP BY ALL), h AS (SELECT seed, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM n GROUP BY 1)
SELECT count(*) AS seeds, round(min(h), 6) AS low, round(max(h), 6) AS high, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std FROM h""")
def random_rep_sweep(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("c"), "source")
    return rounded(compare.representative_sweep(rows, "c", "doc_id", "source", 20), "low", "high", "mean", "std")


_SWEEP = (0.7, 0.8, 0.85, 0.9)


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS t FROM part), p AS (SELECT 1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)) AS identity FROM n a JOIN n b ON a.t < b.t AND least(length(a.t), length(b.t)) >= 0.8 * greatest(length(a.t), length(b.t)))
SELECT threshold::DOUBLE AS threshold, count(*) AS pairs FROM p, (VALUES {", ".join(f"({t})" for t in _SWEEP)}) v(threshold) WHERE identity >= threshold - 1e-12 GROUP BY 1""")
def threshold_sweep(spark, sf):
    return dedup.threshold_sweep(dedup.similar_pairs(table(spark, sf, "part"), "p_name", min(_SWEEP)), _SWEEP)


@query()
def near_duplicate_clusters(spark, sf):
    """Parts' names clustered at 90 % identity; greedy cover has no SQL form."""
    return dedup.near_clusters(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 0.9).select("p_partkey", "p_name", "cluster_rep")


@query("""
WITH o AS (SELECT o_orderpriority AS pri, o_orderstatus AS st, year(o_orderdate) AS y FROM orders),
p AS (SELECT 'all' AS population, * FROM o UNION ALL SELECT 'without_group', * FROM o WHERE pri <> '1-URGENT' UNION ALL SELECT 'before_1998', * FROM o WHERE y < 1998),
n AS (SELECT population, dim, cat, count(*)::DOUBLE AS n FROM (SELECT population, 'priority' AS dim, pri AS cat FROM p UNION ALL SELECT population, 'status', st FROM p) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY population, dim ORDER BY n) AS r FROM n),
s AS (SELECT population, dim, count(*) AS k, sum(n) AS t, sum(n * log2(n)) AS l, sum(n * r) AS g FROM r GROUP BY ALL)
SELECT population, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM p GROUP BY 1
UNION ALL SELECT population, dim || '_entropy_bits', round(log2(t) - l / t, 6) FROM s UNION ALL SELECT population, dim || '_normalized_entropy', round(CASE WHEN k > 1 THEN (log2(t) - l / t) / log2(k) ELSE 0 END, 6) FROM s
UNION ALL SELECT population, dim || '_gini', round((2 * g - (k + 1) * t) / (k * t), 6) FROM s UNION ALL SELECT population, dim || '_n_unique', k::DOUBLE FROM s""")
def population_cut(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"))
    found = audits.sensitivity(rows, F.col("o_orderpriority") == "1-URGENT", 1998, {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")})
    return rounded(found, "value")


_GATES = "CASE WHEN n_chars < 20 THEN 'too_short_20' WHEN n_chars > 10000 THEN 'too_long_10000' WHEN lang <> 'en' THEN 'other_language' ELSE 'ok' END"


@query(f"""
WITH s AS (SELECT regexp_replace({_GATES}, '_[0-9]+$', '') AS stage FROM documents)
SELECT stage, count(*) AS n, CASE stage WHEN 'ok' THEN 'kept' WHEN 'too_short' THEN 'under 20 letters' WHEN 'too_long' THEN 'over 10000 letters' ELSE 'unrecognised stage' END AS justification FROM s GROUP BY 1""")
def funnel_report(spark, sf):
    gates = [("too_short_20", F.col("n_chars") < 20), ("too_long_10000", F.col("n_chars") > 10000), ("other_language", F.col("lang") != "en")]
    rows = table(spark, sf, "documents").select(funnel.stage(gates).alias("stage"))
    return funnel.report(rows, reasons={"ok": "kept", "too_short": "under 20 letters", "too_long": "over 10000 letters"})


@query("SELECT md5(text) AS t, count(DISTINCT source) AS reps FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def self_check_violations(spark, sf):
    return dedup.split_clusters(table(spark, sf, "documents").select(F.md5("text").alias("t"), "source"), "t", "source")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_ids(spark, sf):
    found = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing_keys(table(spark, sf, "part"), found, "p_partkey")


@query("""
WITH c AS (SELECT c_custkey, n_name, count(*) OVER () AS rows_after FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, n_name, rows_after = (SELECT count(*) FROM customer) AS same_rows FROM c""")
def migration_invariant(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = joins.one_to_one_join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"])
    same = rows.agg(F.count("*").alias("a")).crossJoin(table(spark, sf, "customer").agg(F.count("*").alias("b"))).select((F.col("a") == F.col("b")).alias("same_rows"))  # one row each
    return rows.select("c_custkey", "n_name").crossJoin(F.broadcast(same))


@query("""
SELECT o_orderpriority AS tier, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1""")
def tier_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_custkey").alias("therapeutic"))
    return rounded(audits.tier_counts(rows), "percent")


@query("""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n, p_brand) AS rank FROM c)
SELECT p_brand, n, CAST(rank AS INT) AS rank, round(rank::DOUBLE / count(*) OVER (), 6) AS category_share, round((sum(n) OVER (ORDER BY rank))::DOUBLE / sum(n) OVER (), 6) AS total_share FROM o""")
def lorenz_points(spark, sf):
    return rounded(M.lorenz(M.counts(table(spark, sf, "part"), "p_brand"), "p_brand"), "category_share", "total_share")


# ---- geometry, alignment and inference


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, min(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.label <> b.label WHERE a.vec_id % 20 = 0 GROUP BY ALL)
SELECT t::DOUBLE AS threshold, label, count(*) FILTER (d <= t) AS contacting, count(*) FILTER (d > t) AS other FROM d, (VALUES (1.1), (1.15), (1.2), (1.25)) v(t) GROUP BY ALL""")
def knn_min_distance(spark, sf):
    """A stated query set (every twentieth vector) against all vectors of other labels, in blocks."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    near = nearest_other_label(rows.where(F.col("vec_id") % 20 == 0), rows)
    cuts = F.explode(F.array(*[F.lit(t) for t in (1.1, 1.15, 1.2, 1.25)]))
    wide = near.withColumn("threshold", cuts)
    return wide.groupBy("threshold", "label").agg(F.count(F.when(F.col("d") <= F.col("threshold"), 1)).alias("contacting"), F.count(F.when(F.col("d") > F.col("threshold"), 1)).alias("other"))


def nearest_other_label(asked: DataFrame, rows: DataFrame, asked_blocks: int = 4, row_blocks: int = 16) -> DataFrame:
    """(vec_id, label, d): the distance to the nearest vector of another label.

    Both sides are dealt to a grid of blocks; a cell returns one number for each asked row.
    """
    import numpy as np
    import pandas as pd

    a = asked.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(asked_blocks)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    b = rows.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))

    def cell(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"vec_id": [], "label": [], "d": []})
        p, q = np.array(x["v"].tolist()), np.array(y["v"].tolist())
        out = np.empty(len(p))
        for k in range(len(p)):
            d = np.sqrt(((q - p[k]) ** 2).sum(1))
            d[y["label"].to_numpy() == x["label"].iloc[k]] = np.inf
            out[k] = d.min()
        return pd.DataFrame({"vec_id": x["vec_id"], "label": x["label"], "d": out})

    cells = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(cell, "vec_id long, label int, d double")
    return cells.groupBy("vec_id", "label").agg(F.min("d").alias("d"))


_PAIR_RMSD = """
WITH p AS (SELECT vec_id, label, i, embedding[i * 4 + 1]::DOUBLE AS x, embedding[i * 4 + 2]::DOUBLE AS y, embedding[i * 4 + 3]::DOUBLE AS z FROM embeddings, range(16) t(i)),
c AS (SELECT vec_id, label, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM p WINDOW w AS (PARTITION BY vec_id)),
m AS (SELECT a.label, sum(a.x * a.x + a.y * a.y + a.z * a.z + b.x * b.x + b.y * b.y + b.z * b.z) AS g, sum(a.x * b.x) AS xx, sum(a.x * b.y) AS xy, sum(a.x * b.z) AS xz,
  sum(a.y * b.x) AS yx, sum(a.y * b.y) AS yy, sum(a.y * b.z) AS yz, sum(a.z * b.x) AS zx, sum(a.z * b.y) AS zy, sum(a.z * b.z) AS zz
  FROM c a JOIN c b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY a.label, a.vec_id, b.vec_id),
k AS (SELECT label, g, xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx) AS det, xx * xx + yx * yx + zx * zx AS k1, xy * xy + yy * yy + zy * zy AS k2, xz * xz + yz * yz + zz * zz AS k3,
  xx * xy + yx * yy + zx * zy AS k12, xx * xz + yx * yz + zx * zz AS k13, xy * xz + yy * yz + zy * zz AS k23 FROM m),
q AS (SELECT *, (k1 + k2 + k3) / 3 AS q FROM k),
h AS (SELECT *, sqrt((pow(k1 - q, 2) + pow(k2 - q, 2) + pow(k3 - q, 2) + 2 * (k12 * k12 + k13 * k13 + k23 * k23)) / 6) AS h FROM q),
f AS (SELECT *, acos(greatest(-1, least(1, ((k1 - q) * ((k2 - q) * (k3 - q) - k23 * k23) - k12 * (k12 * (k3 - q) - k23 * k13) + k13 * (k12 * k23 - (k2 - q) * k13)) / (2 * h * h * h)))) / 3 AS f FROM h),
e AS (SELECT *, sqrt(q + 2 * h * cos(f)) AS s1, sqrt(q + 2 * h * cos(f - 2 * pi() / 3)) AS s2 FROM f),
pairs AS (SELECT label, sqrt(greatest(0, g - 2 * (s1 + s2 + det / (s1 * s2))) / 16) AS rmsd FROM e)"""


def _label_pairs(spark, sf):
    """RMSDs within labels, of embeddings as 16 points of three numbers."""
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 4 + 1, F.lit(3)))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", points.alias("points"))
    return geometry.pair_rmsd(rows, "label", "vec_id", "points")


@query(_PAIR_RMSD + " SELECT label, round(avg(rmsd), 6) AS mean_rmsd, count(*) AS pairs FROM pairs GROUP BY 1 ORDER BY avg(rmsd) DESC, label LIMIT 20")
def rmsd_within_cluster(spark, sf):
    """The SQL finds the best rotations by the singular values of the products' matrix, in closed form."""
    return rounded(geometry.top_by_mean(_label_pairs(spark, sf), "label", 20), "mean_rmsd")


@query(
    _PAIR_RMSD
    + """, l AS (SELECT label, avg(rmsd) AS m, sum(rmsd) AS s, count(*) AS n FROM pairs GROUP BY 1)
SELECT round(sum(s) / sum(n), 6) AS pair_weighted, round(avg(m), 6) AS cluster_weighted, CAST(sum(n) AS BIGINT) AS pairs, round((SELECT sum(n) FROM (SELECT n FROM l ORDER BY n DESC, label LIMIT 2)) / sum(n)::DOUBLE, 6) AS top2_share FROM l"""
)
def rmsd_weighting(spark, sf):
    return rounded(geometry.weighted_means(_label_pairs(spark, sf), "label"), "pair_weighted", "cluster_weighted", "top2_share")


_BOOT = 200


@query(f"""
WITH u AS (SELECT n_name, sum(c_acctbal) AS v, count(*)::DOUBLE AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS unit, count(*) OVER () AS m FROM u),
d AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || i), 1, 8) AS BIGINT) % (SELECT max(m) FROM k) AS unit FROM range({_BOOT}) x(b), range((SELECT max(m) FROM k)) y(i)),
r AS (SELECT b, sum(v) / sum(w) AS pooled FROM d JOIN k USING (unit) GROUP BY 1)
SELECT round(quantile_cont(pooled, 0.025), 4) AS low, round(quantile_cont(pooled, 0.5), 4) AS median, round(quantile_cont(pooled, 0.975), 4) AS high FROM r""")
def bootstrap_ci(spark, sf):
    units = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("v"), F.count("*").alias("w"))
    return rounded(S.interval(S.bootstrap_means(units, "v", "w", "n_name", _BOOT), "pooled"), "low", "median", "high", digits=4)


@query("""
WITH r AS (SELECT l_extendedprice AS y, (l_discount > 0.05)::INT::DOUBLE AS t, (l_returnflag = 'N')::INT::DOUBLE AS n, (l_returnflag = 'R')::INT::DOUBLE AS r FROM lineitem),
g AS (SELECT *, y - avg(y) OVER (PARTITION BY n, r) AS yd, t - avg(t) OVER (PARTITION BY n, r) AS td FROM r), b AS (SELECT sum(td * yd) / sum(td * td) AS beta, sum(td * td) AS sxx, sum(yd * yd) AS syy, count(*) AS m FROM g)
SELECT round(beta, 4) AS coefficient, round(beta - 1.96 * sqrt((syy - beta * beta * sxx) / (m - 4) / sxx), 4) AS low, round(beta + 1.96 * sqrt((syy - beta * beta * sxx) / (m - 4) / sxx), 4) AS high, m AS n FROM b""")
def ols_adjusted(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_discount") > 0.05).cast("int").alias("deep"), "l_returnflag")
    fit = S.ols_effect(rows, "l_extendedprice", "deep", ["l_returnflag"])
    return spark.createDataFrame([(round(fit["coefficient"], 4), round(fit["low"], 4), round(fit["high"], 4), fit["rows"])], "coefficient double, low double, high double, n long")


@query()
def best_local_alignment(spark, sf):
    """Brands' names against regions' and nations' names."""
    queries = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.regexp_replace(F.upper("n_name"), "[^A-Z]", "").alias("seq"))
    refs = table(spark, sf, "region").select(F.col("r_name").alias("gene_id"), F.regexp_replace(F.upper("r_name"), "[^A-Z]", "").alias("seq"))
    return rounded(align.best_matches(queries, refs, coverage=0.3), "identity", "coverage")


@query("""
WITH p AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT k AS l_partkey FROM p""")
def set_overlap(spark, sf):
    rows = table(spark, sf, "lineitem")
    return joins.overlap(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), "l_partkey")


@query("SELECT count(DISTINCT user_id) AS n_unique, round(count(DISTINCT user_id)::DOUBLE / count(*), 6) AS unique_fraction FROM events")
def clonotype_unique_fraction(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("clono_hash"))
    return rounded(audits.unique_fraction(rows), "unique_fraction")


@query("SELECT count(*) AS n, count(DISTINCT (p_brand, p_type)) AS clonotypes FROM part")
def proxy_clonotypes(spark, sf):
    return audits.proxy_clonotypes(table(spark, sf, "part"), "p_brand", "p_type")


@query("""
WITH t AS (SELECT l_orderkey % 10 < 8 AS train, l_suppkey AS s, l_linenumber FROM lineitem), b AS (SELECT s FROM t GROUP BY 1 HAVING min(train) <> max(train))
SELECT s AS l_suppkey, count(*) AS n_rows FROM t JOIN b USING (s) GROUP BY 1""")
def leaked_row_detail(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10 < 8).alias("split"), "l_suppkey", "l_linenumber")
    return graph.leaked_rows(rows, "split", "l_suppkey", "l_linenumber").groupBy("l_suppkey").agg(F.count("*").alias("n_rows"))


@query("SELECT round(sum(l_quantity * n) / sum(n), 6) AS weighted_mean FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def weighted_histogram_mean(spark, sf):
    return rounded(M.weighted_mean(M.counts(table(spark, sf, "lineitem"), "l_quantity"), "l_quantity"), "weighted_mean")


# ---- cuts, drift and cross-checks


def long_metrics(table_: str, dims: dict[str, str], by: str = "") -> str:
    """SQL of snapshots over a table: (by, metric, value) of entropy and variety by dimension, and rows."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    parts = [f"SELECT {b}'n_rows' AS metric, count(*)::DOUBLE AS value FROM {table_} {group}"]
    for name, expression in dims.items():
        n = f"(SELECT {b}{expression} AS c, count(*)::DOUBLE AS n FROM {table_} WHERE {expression} IS NOT NULL GROUP BY ALL)"
        parts.append(f"SELECT {b}'{name}_entropy_bits', log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM {n} {group}")
        parts.append(f"SELECT {b}'{name}_n_unique', count(*)::DOUBLE FROM {n} {group}")
    return " UNION ALL ".join(parts)


def told(df: DataFrame) -> DataFrame:
    return df.where(F.col("metric").rlike("^n_rows$|_entropy_bits$|_n_unique$|_fraction$|_share$"))


@query(f"""
WITH d AS (SELECT md5(text) AS cluster, lang FROM documents), m AS ({long_metrics("d", {"cluster": "cluster", "class": "lang"})}
  UNION ALL SELECT 'en_fraction', avg((lang = 'en')::INT) FROM d
  UNION ALL SELECT 'cluster_top10_share', (SELECT sum(n) FROM (SELECT count(*) AS n FROM d WHERE cluster IS NOT NULL GROUP BY cluster ORDER BY 1 DESC LIMIT 10)) / count(cluster) FROM d)
SELECT metric, round(value, 6) AS value FROM m""")
def focused_snapshot(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("cluster"), "lang")
    return rounded(told(compare.focused_snapshot(rows, "cluster", "lang", "en")), "value")


@query(f"""
WITH d AS (SELECT source, lang, CAST(length(text) // 500 AS VARCHAR) AS size FROM documents WHERE source IS NOT NULL), e AS ({long_metrics("d", {"lang": "lang", "size": "size"}, "source")}), w AS ({long_metrics("d", {"lang": "lang", "size": "size"})})
SELECT e.source, metric, round(e.value, 6) AS value, round(w.value, 6) AS whole, round(e.value - w.value, 6) AS drift FROM e JOIN w USING (metric)""")
def split_drift(spark, sf):
    rows = table(spark, sf, "documents").select("source", "lang", F.floor(F.length("text") / 500).cast("string").alias("size"))
    return rounded(told(graph.split_drift(rows, "source", {"lang": F.col("lang"), "size": F.col("size")})), "value", "whole", "drift")


@query(f"""
WITH d AS (SELECT doc_id, md5(text) AS c, source, lang FROM documents), t AS (SELECT s AS seed, d.*, row_number() OVER (PARTITION BY s, c ORDER BY md5(s || ':' || doc_id), doc_id) AS r FROM d, range(12) x(s)),
k AS (SELECT * FROM t WHERE r = 1), m AS ({long_metrics("k", {"source": "source", "lang": "lang"}, "seed")})
SELECT metric, count(*) AS seeds, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM m GROUP BY 1""")
def metric_sweep(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("c"), "source", "lang")
    return rounded(told(compare.metric_sweep(rows, "c", "doc_id", ["source", "lang"], 12)), "low", "high", "mean", "std")


@query("""
WITH c AS (SELECT c_mktsegment AS s, c_acctbal > 0 AS f FROM customer)
SELECT count(*) AS n_rows, count(*) FILTER (s = 'BUILDING') AS n_upper, count(*) FILTER (s = 'MACHINERY') AS n_lower, count(*) FILTER (s = 'BUILDING' AND f) AS upper_true, count(*) FILTER (s = 'BUILDING' AND NOT f) AS upper_false,
  count(*) FILTER (s = 'MACHINERY' AND f) AS lower_true, count(*) FILTER (s = 'MACHINERY' AND NOT f) AS lower_false,
  count(*) FILTER (s = 'BUILDING' AND NOT f) = count(*) FILTER (s = 'BUILDING') AND count(*) FILTER (s = 'MACHINERY' AND f) = count(*) FILTER (s = 'MACHINERY') AS clean_split FROM c""")
def label_by_flag(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment", (F.col("c_acctbal") > 0).alias("flag"))
    return audits.label_by_flag(rows, "c_mktsegment", "flag", "BUILDING", "MACHINERY")


@query("""
WITH p AS (SELECT p_size % 14 AS our, CASE WHEN p_size % 9 <> 0 THEN length(replace(substr(p_name, 5, 13), ' ', '')) END AS their FROM part WHERE p_size % 5 <> 0)
SELECT count(*) AS n_sampled, count(their) AS n_compared, count(*) FILTER (our = their) AS n_agree, count(*) FILTER (their IS NULL) AS n_errors, round(100.0::DOUBLE * count(*) FILTER (our = their) / count(their), 6) AS agreement_percent FROM p""")
def numbering_check(spark, sf):
    part = table(spark, sf, "part")
    master = part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 14).alias("length"))
    letters = F.transform(F.split("p_name", ""), lambda c, i: F.struct((i + 101).alias("position"), F.when(c == " ", "-").otherwise(c).alias("aa")))
    calls = part.select("p_partkey", F.when(F.col("p_size") % 9 != 0, letters).alias("numbering"))
    return rounded(audits.numbering_check(master, calls, "p_partkey", "length")[0], "agreement_percent")


@query("""
WITH c AS (SELECT p_type, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS gene, p_size / 50.0 AS identity FROM part),
f AS (SELECT p_type, right(gene, 1) AS family, count(*) AS n FROM c WHERE gene IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, family) AS place FROM f),
t AS (SELECT p_type, string_agg(family || ':' || n, ',' ORDER BY place) AS top_families FROM r WHERE place <= 2 GROUP BY 1)
SELECT p_type, count(*) AS n, count(*) FILTER (gene IS NULL) AS no_match, round(avg(identity) FILTER (gene IS NOT NULL), 6) AS mean_identity, round(min(identity) FILTER (gene IS NOT NULL), 6) AS min_identity, round(max(identity) FILTER (gene IS NOT NULL), 6) AS max_identity, any_value(top_families) AS top_families
FROM c LEFT JOIN t USING (p_type) GROUP BY 1""")
def assignment_summary(spark, sf):
    calls = table(spark, sf, "part").select("p_type", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("gene_id"), (F.col("p_size") / 50.0).cast("double").alias("identity"))
    found = align.assignment_summary(calls, lambda g: F.right(g, F.lit(1)), "p_type")
    top = F.array_join(F.transform("top_families", lambda x: F.concat(x["family"], F.lit(":"), x["n"].cast("string"))), ",")
    return rounded(found.withColumn("top_families", top), "mean_identity", "min_identity", "max_identity")


@query("SELECT l_suppkey, l_returnflag, l_linestatus, CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) AS id FROM lineitem GROUP BY ALL")
def unique_pairs(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))
    return geometry.unique_pairs(rows, "l_suppkey", "id", "l_returnflag", "l_linestatus")


@query()
def threshold_sensitivity(spark, sf):
    rows = table(spark, sf, "part").select("p_name", "p_brand")
    return rounded(dedup.threshold_sensitivity(rows, "p_name", (0.8, 0.85, 0.9, 0.95), 0.8, {"brand": F.col("p_brand")}).where("metric NOT LIKE 'brand%'"), "value")


@query("""
WITH n AS (SELECT p_name AS t, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS split_texts, CAST(0 AS BIGINT) AS far_members, CAST(0 AS BIGINT) AS uncovered FROM n""")
def near_cluster_properties(spark, sf):
    """Equal texts are together, and every member meets identity and coverage to its representative."""
    rows = dedup.near_clusters(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 0.85)
    most = F.greatest(F.length("p_name"), F.length("cluster_rep"))
    far = (1 - F.levenshtein("p_name", "cluster_rep") / most < 0.85 - 1e-12) | (F.least(F.length("p_name"), F.length("cluster_rep")) < 0.8 * most)
    one = rows.where("p_name IS NOT NULL").agg(F.count("*").alias("n_rows"), F.count(F.when(far, 1)).alias("far_members"), F.count(F.when(F.col("cluster_rep").isNull(), 1)).alias("uncovered"))
    return one.crossJoin(dedup.split_clusters(rows, "p_name", "cluster_rep").agg(F.count("*").alias("split_texts")))  # one row each
