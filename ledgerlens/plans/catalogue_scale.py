"""Queries of the operators that replace all-pairs and one-task work, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.functions.ranks import quantiles
from ledgerlens.operators import align, dedup, geometry
from ledgerlens.plans import audits, compare
from ledgerlens.plans.catalogue import query, rounded
from ledgerlens.session import table

URL_IDENTITY = 0.8


@query(f"""
WITH u AS (SELECT DISTINCT url AS t, length(url) AS n FROM pages WHERE url IS NOT NULL AND url <> ''),
p AS (SELECT x.t AS a, y.t AS b, greatest(x.n, y.n) AS most, levenshtein(x.t, y.t) AS d FROM u x JOIN u y ON x.t < y.t AND least(x.n, y.n) >= {URL_IDENTITY} * greatest(x.n, y.n) - 1e-9)
SELECT a, b, round(1 - d::DOUBLE / most, 6) AS identity FROM p WHERE 1 - d::DOUBLE / most >= {URL_IDENTITY} - 1e-12""")
def similar_urls(spark, sf):
    """Pairs of urls by segments."""
    return rounded(dedup.similar_pairs(table(spark, sf, "pages"), "url", URL_IDENTITY), "identity")


def cluster_properties(df: DataFrame, text: str, identity: float) -> DataFrame:
    """One row: rows, split texts, members out of reach, rows without a representative, representatives within reach of each other."""
    rows = dedup.near_clusters(df, text, identity)
    most, least = F.greatest(F.length(text), F.length("cluster_rep")), F.least(F.length(text), F.length("cluster_rep"))
    far = (1 - F.levenshtein(text, "cluster_rep") / most < identity - 1e-12) | (least < 0.8 * most - 1e-9)
    one = rows.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_rows"), F.count(F.when(far, 1)).alias("far_members"), F.count(F.when(F.col("cluster_rep").isNull(), 1)).alias("uncovered"))
    split = dedup.split_clusters(rows, text, "cluster_rep").agg(F.count("*").alias("split_texts"))
    close = dedup.similar_pairs(rows.select("cluster_rep"), "cluster_rep", identity).agg(F.count("*").alias("close_reps"))
    return one.crossJoin(split).crossJoin(close)  # one row each


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS split_texts, CAST(0 AS BIGINT) AS far_members, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS close_reps FROM pages WHERE url IS NOT NULL")
def url_cluster_properties(spark, sf):
    return cluster_properties(table(spark, sf, "pages").select("page_id", "url"), "url", URL_IDENTITY)


_SHARES = (0.025, 0.25, 0.5, 0.95, 0.99)


@query(f"""
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, {", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 4) AS q{i}" for i, p in enumerate(_SHARES))} FROM lineitem GROUP BY 1, 2""")
def price_quantiles(spark, sf):
    found = quantiles(table(spark, sf, "lineitem"), "l_extendedprice", list(_SHARES), "l_returnflag", "l_linestatus")
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(len(_SHARES))])


@query("""
WITH c AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT h, n, row_number() OVER w AS rank, round(row_number() OVER w / (SELECT count(*)::DOUBLE FROM c), 9) AS category_share, round(sum(n) OVER (ORDER BY n, h ROWS UNBOUNDED PRECEDING) / (SELECT sum(n)::DOUBLE FROM c), 9) AS total_share FROM c WINDOW w AS (ORDER BY n, h)""")
def text_lorenz(spark, sf):
    """Texts as categories: as many as rows."""
    counts = M.counts(table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")), "h")
    return rounded(M.lorenz(counts, "h"), "category_share", "total_share", digits=9)


_REPLICATES = 64
_WEIGHT = " + ".join(f"(u >= {t})::INT" for t in S.POISSON)


@query(f"""
WITH s AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS DOUBLE)) AS quantity, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1),
d AS (SELECT b * 8 + j AS replicate, quantity, lines, CAST('0x' || substr(md5('42:' || k || ':' || b), 4 * j + 1, 4) AS INTEGER) AS u FROM s, range({_REPLICATES // 8}) x(b), range(8) y(j))
SELECT CAST(replicate AS BIGINT) AS replicate, round(sum(({_WEIGHT}) * quantity), 2) AS quantity, round(sum(({_WEIGHT}) * lines), 2) AS lines FROM d GROUP BY 1""")
def supplier_resamples(spark, sf):
    """Poisson resamples of suppliers."""
    units = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.count("*").cast("double").alias("lines"))
    return rounded(S.poisson_sums(units, "l_suppkey", ["quantity", "lines"], _REPLICATES), "quantity", "lines", digits=2)


CUT = 3.0
_POINTS = "SELECT l_suppkey, l_orderkey AS residue, l_linestatus AS aa, l_returnflag AS f, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_discount AS DOUBLE) * 100 AS z FROM lineitem"
_NEAREST = f"""
WITH l AS ({_POINTS}), d AS (
  SELECT a.l_suppkey, a.residue, a.aa, sqrt(min((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y) + (a.z - t.z) * (a.z - t.z))) AS d
  FROM l a JOIN l t USING (l_suppkey) WHERE a.f = 'A' AND t.f = 'R' GROUP BY ALL)
SELECT l_suppkey, residue, aa, round(d, 6) AS min_dist FROM d"""


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at: list[Column] = [F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), (F.col("l_discount").cast("double") * 100).alias("z")]
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("residue"), F.col("l_linestatus").alias("aa"), F.col("l_returnflag").alias("f"), *at)
    return rows.where("f = 'A'").drop("f"), rows.where("f = 'R'").drop("f")


@query(_NEAREST)
def supplier_nearest(spark, sf):
    """Each order's nearest line of the other flag among a supplier's, by widening cells."""
    return rounded(geometry.contact_distances(*_points(spark, sf), "l_suppkey", cell=CUT), "min_dist")


@query(_NEAREST + f" WHERE d <= {CUT}")
def supplier_contacts(spark, sf):
    return rounded(geometry.contacts_within(*_points(spark, sf), CUT, "l_suppkey"), "min_dist")


@query()
def url_host_matches(spark, sf):
    """Every url's letters against all hosts' letters: the host of best local alignment."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", "")
    pages = table(spark, sf, "pages").where("url IS NOT NULL")
    hosts = pages.select(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("host")).where("host <> ''").distinct()
    refs = hosts.select(F.col("host").alias("gene_id"), letters("host").alias("seq"))
    return rounded(align.best_matches(pages.select("page_id", letters("url").alias("seq")), refs, "page_id"), "identity", "coverage")


@query("""
WITH o AS (SELECT l_returnflag AS f, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_discount) AS n, l_discount > 0.05 AS hit FROM lineitem),
i AS (SELECT f, n, n - row_number() OVER (PARTITION BY f ORDER BY n) AS island FROM o WHERE hit),
r AS (SELECT f, min(n) AS first, max(n) AS last, count(*) AS length FROM i GROUP BY f, island), q AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY first) AS k, count(*) OVER (PARTITION BY f) AS m FROM r)
SELECT f AS l_returnflag, count(*) AS n_runs, max(length) AS longest, max(first) AS last_first, max(last) AS last_last, max(CASE WHEN k = least(m, 3) THEN first END) AS third_first FROM q GROUP BY 1""")
def discount_runs(spark, sf):
    """Runs of deep discounts among all lines of a flag: half of the rows have one key."""
    runs = R.row_runs(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_returnflag", "l_orderkey", "l_linenumber", "l_discount")
    rules = R.run_rules(runs, "l_returnflag")
    return rules.select("l_returnflag", "n_runs", "longest", F.col("last.first").alias("last_first"), F.col("last.last").alias("last_last"), F.col("third_or_last.first").alias("third_first"))


_LEVELS = ("l_suppkey", "l_shipdate", "l_returnflag")
_GRAM = "SELECT {i} AS a, CAST({a} AS VARCHAR) AS level_a, {j} AS b, CAST({b} AS VARCHAR) AS level_b, count(*) AS n, round(sum(t), 4) AS t, round(sum(t * y), 2) AS ty FROM r GROUP BY ALL"


@query(
    "WITH r AS (SELECT *, CAST(l_extendedprice AS DOUBLE) AS y, (l_discount > 0.05)::INT::DOUBLE AS t FROM lineitem) "
    + " UNION ALL ".join([_GRAM.format(i=-1, j=-1, a="NULL", b="NULL"), *[_GRAM.format(i=i, j=j, a=_LEVELS[i], b=_LEVELS[j]) for i in range(3) for j in range(i, 3)]])
)
def line_gram(spark, sf):
    """Moments of prices by pairs of suppliers, days and flags."""
    lines = table(spark, sf, "lineitem").withColumn("deep", F.col("l_discount") > 0.05)
    found = S.gram(lines.withColumn("deep", F.col("deep").cast("int")), "l_extendedprice", "deep", list(_LEVELS))
    return found.select("a", "level_a", "b", "level_b", "n", F.round("t", 4).alias("t"), F.round("ty", 2).alias("ty"))


@query("""
WITH t AS (SELECT s AS seed, l_suppkey, l_orderkey || '-' || l_linenumber AS k, l_shipdate::VARCHAR AS d, row_number() OVER (PARTITION BY s, l_suppkey ORDER BY md5(s || ':' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber, l_shipdate) AS r FROM lineitem, range(25) x(s))
SELECT CAST(seed AS INT) AS seed, l_suppkey, k, d FROM t WHERE r = 1""")
def supplier_lines(spark, sf):
    """A line of each supplier at random, for 25 seeds."""
    k = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")
    rows = table(spark, sf, "lineitem").select("l_suppkey", k, F.col("l_shipdate").cast("string").alias("d"))
    return compare.random_representatives(rows, "l_suppkey", "k", 25, "d")


_TIERS = ("R", "A")


@query("""
WITH l AS (SELECT l_returnflag AS tier, l_returnflag <> 'N' AS flag, l_suppkey AS name, l_partkey || '-' || l_suppkey AS pair, l_orderkey AS s0, l_orderkey || '-' || l_linenumber AS s, CAST(l_quantity AS DOUBLE) AS y, l_linestatus AS c FROM lineitem),
g AS (SELECT tier AS item, count(*) AS n, count(DISTINCT pair) AS u FROM l WHERE flag GROUP BY 1 UNION ALL SELECT 'any', count(*), count(DISTINCT pair) FROM l WHERE flag UNION ALL SELECT 'all', count(*), count(DISTINCT pair) FROM l),
t AS (SELECT n AS rows, u AS uniques FROM g WHERE item = 'all'),
a AS (SELECT count(DISTINCT s0) AS k FROM l WHERE flag AND name IS NOT NULL GROUP BY name), b AS (SELECT count(DISTINCT name) AS k FROM l WHERE flag GROUP BY s),
m AS (SELECT avg(y) FILTER (tier = 'R') AS first, avg(y) FILTER (tier <> 'R') AS others FROM l),
d AS (SELECT y - avg(y) OVER w AS y, (tier = 'R')::INT - avg((tier = 'R')::INT) OVER w AS x FROM l WINDOW w AS (PARTITION BY c)),
o AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, sum(y * y) AS syy, count(*) AS n FROM d),
e AS (SELECT beta, n, 1.96 * sqrt((syy - beta * beta * sxx) / (n - 1 - (SELECT count(DISTINCT c) FROM l)) / sxx) AS half FROM o),
r AS (SELECT 'counts' AS section, item, unnest(['n_rows', 'n_unique', 'percent_of_rows', 'percent_of_unique']) AS metric, unnest([n::DOUBLE, u::DOUBLE, 100.0 * n / rows, 100.0 * u / uniques]) AS value FROM g, t
UNION ALL SELECT 'mapping', 'names', unnest(['names', 'names_of_several', 'most']), unnest([count(*)::DOUBLE, (count(*) FILTER (k > 1))::DOUBLE, max(k)::DOUBLE]) FROM a
UNION ALL SELECT 'mapping', 'structures', 'structures_of_several', (count(*) FILTER (k > 1))::DOUBLE FROM b
UNION ALL SELECT 'length', 'R', unnest(['mean', 'mean_of_others', 'difference']), unnest([first, others, first - others]) FROM m
UNION ALL SELECT 'length', 'R', unnest(['adjusted', 'adjusted_low', 'adjusted_high', 'adjusted_rows']), unnest([beta, beta - half, beta + half, n::DOUBLE]) FROM e)
SELECT section, item, metric, round(value, 5) AS value FROM r""")
def line_tier_report(spark, sf):
    """Returned and accepted lines as tiers; the rows of the drawn interval are tested apart."""
    rows = table(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag") != "N")
    found = audits.tier_report(rows, _TIERS, ["l_partkey", "l_suppkey"], "l_suppkey", ["l_orderkey", "l_linenumber"], "l_quantity", {"status": F.col("l_linestatus")}, "l_returnflag", "flag", 1000)
    return rounded(found.where("metric NOT IN ('low', 'median', 'high')"), "value", digits=5)
