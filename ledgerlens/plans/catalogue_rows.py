"""More queries beside their SQL: row expressions, gates, structures and composite audits.

Columns that the tables lack are made from those that they have, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.functions import text as T
from ledgerlens.operators import align, dedup, geometry, graph, joins, sampling
from ledgerlens.plans import audits, funnel
from ledgerlens.plans.catalogue import _CLASS, _COMPONENTS, RULES, linked_parts, query, rounded
from ledgerlens.session import table
from ledgerlens.sources import readers, sinks


def by_rest(c: Column, n: int, *values) -> Column:
    """A value by the remainder of a number; null where there is no value for it."""
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


VOWELS = "aeiou"


def size() -> Column:
    return F.col("p_size")


def vowel_mask(c: Column) -> Column:
    """For each letter, whether it is a vowel."""
    return F.transform(F.split(c, ""), lambda x: x.isin(*VOWELS))


def tally(df: DataFrame) -> DataFrame:
    """Different rows with their number."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


# ---- cleaning and identifiers


@query("""
WITH r AS (SELECT CASE p_size % 6 WHEN 0 THEN ' None ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN ' NaN' ELSE ' ' || p_name END AS raw, CASE p_size % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'F' WHEN 3 THEN 'maybe' WHEN 4 THEN '1' END AS f FROM part)
SELECT CASE WHEN lower(trim(raw)) NOT IN ('', 'none', 'n/a', 'na', 'nan', 'null') THEN trim(raw) END AS value, coalesce(f IN ('true', '1'), false) AS flag, count(*) AS n FROM r GROUP BY ALL""")
def null_tokens_and_flags(spark, sf):
    raw = F.coalesce(by_rest(size(), 6, " None ", "N/A", "", " NaN"), F.concat(F.lit(" "), "p_name"))
    rows = table(spark, sf, "part").select(raw.alias("value"), by_rest(size(), 5, "true", "F", None, "maybe", "1").alias("f"))
    return tally(T.normalize_nulls(rows, "value").select("value", T.truthy(F.col("f")).alias("flag")))


@query("""
WITH c AS (SELECT c_custkey, lower(substr(c_mktsegment, 1, 4)) AS pdb, coalesce(CASE c_custkey % 3 WHEN 1 THEN 'A_B' WHEN 2 THEN 'C_m' END, 'NA') AS antigen, CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) END AS model FROM customer)
SELECT c_custkey, pdb || '_ag' || antigen || '_m' || model AS stem, pdb, antigen, model FROM c""")
def file_stems(spark, sf):
    k = F.col("c_custkey")
    stem = T.file_stem(F.lower(F.substring("c_mktsegment", 1, 4)), by_rest(k, 3, None, "A|B", "C_m"), F.when(k % 4 != 0, F.col("c_nationkey")))
    return table(spark, sf, "customer").select("c_custkey", stem.alias("stem")).withColumn("p", T.stem_parts(F.col("stem"))).select("c_custkey", "stem", "p.*")


@query("SELECT lower(substr(md5(p_name), 1, 4)) AS bare, count(*) AS n FROM part GROUP BY 1")
def bare_ids(spark, sf):
    own = F.upper(F.substring(F.md5("p_name"), 1, 4))
    raw = by_rest(size(), 3, F.concat(F.lit(" PDB_0000"), own), F.concat(F.lit("pdb_"), own), own)
    return tally(table(spark, sf, "part").select(T.bare_pdb_id(raw).alias("bare")))


@query("SELECT p_size, CASE WHEN p_size % 4 <> 0 THEN 'IG' || substr('HKL', p_size % 3 + 1, 1) || CASE WHEN p_size % 2 = 0 THEN 'V' ELSE 'J' END || (p_size % 12) END AS family, count(*) AS n FROM part GROUP BY ALL")
def gene_families(spark, sf):
    kind = F.when(size() % 4 == 0, "D").when(size() % 2 == 0, "V").otherwise("J")
    gene = F.concat(F.lit("IG"), by_rest(size(), 3, "H", "K", "L"), kind, size() % 12, F.lit("-"), size(), F.lit("*01"))
    return tally(table(spark, sf, "part").select("p_size", T.gene_family(gene).alias("family")))


@query("""
WITH i AS (SELECT string_split(l_returnflag || '_' || l_linestatus || '_' || l_linenumber || CASE WHEN l_linenumber % 2 = 1 THEN '_X' ELSE '' END, '_') AS x FROM lineitem), f AS (SELECT CASE WHEN len(x) = 4 THEN x END AS x FROM i)
SELECT x[1] AS pdb, x[2] AS h, x[3] AS l, x[4] AS ag, count(*) AS n FROM f GROUP BY ALL""")
def entity_ids(spark, sf):
    own = F.concat_ws("_", "l_returnflag", "l_linestatus", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, "X"))
    return tally(table(spark, sf, "lineitem").select(T.id_parts(own).alias("x")).select("x.pdb", "x.h", "x.l", "x.ag"))


@query("""
WITH t AS (SELECT '100' AS tier, 0 AS tier_rank, '1abc' AS pdb_id, 'H' AS h_chain, 'L' AS l_chain FROM part WHERE p_size % 3 = 0 UNION ALL SELECT '100', 0, '2def', 'A', 'NA' FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT '99', 1, '3xyz', 'B', 'NA' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT '95-98', 2, 'p' || p_size, 'K', 'L' FROM part)
SELECT *, count(*) AS n FROM t GROUP BY ALL""")
def therapeutic_cells(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_name").alias("Therapeutic"), F.col("p_type").alias("Format"), F.col("p_brand").alias("Target"), by_rest(size(), 3, "1ABC:HL;2def:A", "None").alias("100% SI Structure"),
        by_rest(size(), 4, "3XYZ:B; bad ;4q:", "").alias("99% SI Structure"), F.concat(F.lit(" P"), size(), F.lit(":KLM")).alias("95-98% SI Structure"),
    )
    return tally(readers.therapeutic_rows(rows).select("tier", "tier_rank", "pdb_id", "h_chain", "l_chain"))


@query("""
WITH o AS (SELECT 'p' || (o_orderkey % 7) AS pdb_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'L' ELSE 'NA' END AS l_chain, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '1' END AS model, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderkey % 5 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 3.0::DOUBLE END AS resolution, o_orderkey % 6 = 1 AS scfv FROM orders WHERE o_orderkey % 11 <> 0)
SELECT *, pdb_id || '_agA_B_m' || model AS filename_stem, count(*) AS n FROM o GROUP BY ALL""")
def typed_summary(spark, sf):
    k, no = F.col("o_orderkey"), F.lit(None).cast("string")
    given = {
        "pdb": F.concat(F.lit(" P"), k % 7), "Hchain": F.when(k % 11 != 0, "H"), "Lchain": F.when(k % 4 != 0, " L"), "model": F.when(k % 3 != 0, "1"), "antigen_chain": F.lit("A|B"),
        "date": F.date_format("o_orderdate", "MM/dd/yy"), "resolution": by_rest(k, 5, "2.5", "3", "NOT", "NaN"), "scfv": by_rest(k, 6, "False", "True"),
    }
    rest = ["antigen_type", "antigen_name", "organism", "heavy_species", "light_species", "antigen_species", "method", "heavy_subclass", "light_subclass", "light_ctype"]
    rows = table(spark, sf, "orders").select(*[c.alias(n) for n, c in given.items()], *[no.alias(n) for n in rest])
    return tally(readers.summary_rows(rows).select("pdb_id", "l_chain", "model", "year", "resolution", "scfv", "filename_stem"))


# ---- sequences, tags and frames

_TAGGED = "'AC' || CASE p_size % 3 WHEN 0 THEN '[MSE]' WHEN 1 THEN '[XYZ]' ELSE '' END || 'G' || CASE WHEN p_size % 5 = 0 THEN '[' ELSE '' END || 'K' || CASE WHEN p_size % 7 = 0 THEN '[SEP][KCX]' ELSE '' END"
_CLEAN = r"replace(regexp_replace(replace(replace(replace(s, '[MSE]', 'M'), '[SEP]', 'S'), '[KCX]', 'K'), '\[[^\]]*\]', 'X', 'g'), '[', 'X')"


def tagged() -> Column:
    """Residues with tags, some of them unknown, and a stray bracket."""
    return F.concat(F.lit("AC"), by_rest(size(), 3, "[MSE]", "[XYZ]", ""), F.lit("G"), F.when(size() % 5 == 0, "[").otherwise(""), F.lit("K"), F.when(size() % 7 == 0, "[SEP][KCX]").otherwise(""))


@query(rf"WITH q AS (SELECT {_TAGGED} AS s FROM part) SELECT s, {_CLEAN} AS clean, array_to_string(regexp_extract_all(s, '\[([^\]]*)\]', 1), ',') AS tags, contains(s, '[XYZ]') OR contains(s, '[KCX]') AS told, count(*) AS n FROM q GROUP BY ALL")
def residue_tags(spark, sf):
    s = F.col("s")
    rows = table(spark, sf, "part").select(tagged().alias("s"))
    return tally(rows.select("s", T.clean_residues(s).alias("clean"), F.array_join(T.tags(s), ",").alias("tags"), T.any_tag_in(s, ("XYZ", "KCX")).alias("told")))


@query(rf"WITH q AS (SELECT {_TAGGED} AS s FROM part) SELECT unnest(regexp_extract_all(s, '\[([^\]]*)\]', 1)) AS tag, count(*) AS n FROM q GROUP BY 1")
def tag_tally(spark, sf):
    return audits.tag_tally(table(spark, sf, "part").select(tagged().alias("antigen_seq")))


@query(f"""
WITH q AS (SELECT {_TAGGED} AS s, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS n_chains FROM part)
SELECT n_chains, count(*) AS n, count(*) FILTER (regexp_matches(s, '\\[[^\\]]*\\]')) AS tagged FROM q GROUP BY 1""")
def construction_audit(spark, sf):
    return audits.construction(table(spark, sf, "part").select(by_rest(size(), 4, "A", "A|B", "A | B|A").alias("antigen_chain"), tagged().alias("antigen_seq")))


@query(f"WITH q AS (SELECT p_partkey, p_size, {_TAGGED} AS s FROM part) SELECT CAST(p_partkey AS VARCHAR) AS filename_stem, s AS raw, {_CLEAN} AS seq, substr(sha256(s), 1, 8) AS hash FROM q WHERE p_size % 4 = 0")
def antigen_sequences(spark, sf):
    return readers.antigen_sequences(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("filename_stem"), (size() % 4 == 0).alias("has_antigen"), tagged().alias("antigen_seq")))


@query("SELECT p_size % 3 = 0 AS duplicated, count(*) AS n FROM part GROUP BY 1")
def duplicated_parts(spark, sf):
    parts = F.array("p_name", "p_type", F.lit(""), F.when(size() % 3 == 0, F.col("p_name")), F.lit(""))
    return tally(table(spark, sf, "part").select(dedup.duplicated_parts(parts).alias("duplicated")))



def bases() -> Column:
    """Pseudo-random bases."""
    return F.translate(F.md5(F.concat("p_partkey", "p_name")), "0123456789abcdef", "TCAGTCAGTCAGTCAG")


_NT = "translate(md5(p_partkey || p_name), '0123456789abcdef', 'TCAGTCAGTCAGTCAG')"
#: all frames of nt(k, nt), and the best one of each k, from the place of letters in TCAG
_FRAMES = rf"""
f AS (SELECT k, f, array_to_string(list_transform(range(0, (length(nt) - f) // 3), lambda i: CASE WHEN contains(substr(nt, f + 1 + 3 * i, 3), 'N') THEN 'X' ELSE
  substr('{T.CODE}', 16 * (strpos('TCAG', substr(nt, f + 1 + 3 * i, 1)) - 1) + 4 * (strpos('TCAG', substr(nt, f + 2 + 3 * i, 1)) - 1) + strpos('TCAG', substr(nt, f + 3 + 3 * i, 1)), 1) END), '') AS aa FROM nt, range(3) x(f)),
s AS (SELECT *, length(regexp_replace(aa, '\*$', '')) - length(replace(regexp_replace(aa, '\*$', ''), '*', '')) AS stops FROM f),
l AS (SELECT *, min(stops) OVER (PARTITION BY k) AS least FROM s),
b AS (SELECT k, regexp_replace(arg_min(aa, stops * 10 + f), '\*+$', '') AS aa, CAST(arg_min(f, stops * 10 + f) AS INT) AS frame, CAST(min(stops) AS INT) AS stops, count(*) FILTER (stops = least) > 1 OR min(stops) > 0 AS ambiguous FROM l GROUP BY k)"""


@query(f"WITH nt AS (SELECT p_partkey AS k, {_NT} AS nt FROM part), {_FRAMES} SELECT k AS p_partkey, aa, frame, stops, ambiguous FROM b")
def best_frames(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.best_frame(bases()).alias("b")).select("p_partkey", "b.aa", "b.frame", "b.stops", "b.ambiguous")


_GENES = f"""nt AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN repeat('ATAACTGAC', 17) WHEN 1 THEN repeat('ATAACTGAC', 10) WHEN 2 THEN {_NT} ELSE repeat('NNNACTGAC', 8) || repeat('ATAACTGAC', 9) END AS nt FROM part), {_FRAMES},
g AS (SELECT k, aa, CASE WHEN ambiguous THEN 'ambiguous frame' WHEN length(aa) < 50 THEN 'too short' WHEN length(aa) - length(replace(aa, 'X', '')) > 0.1 * length(aa) THEN 'unknown residues' END AS reason FROM b)"""


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up genes: good ones, short ones, noise, and some with unknown bases."""
    good = "ATAACTGAC"
    return table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), by_rest(size(), 4, good * 17, good * 10, bases(), "NNNACTGAC" * 8 + good * 9).alias("seq"))


@query(f"WITH {_GENES} SELECT k AS gene_id, aa, reason FROM g")
def germline_genes(spark, sf):
    passed, flagged = audits.germline_reference(genes(spark, sf), "V")
    return passed.select("gene_id", F.col("seq").alias("aa"), F.lit(None).cast("string").alias("reason")).unionByName(flagged.select("gene_id", "aa", "reason"))


@query(f"WITH {_GENES} SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) > 300 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS state FROM g WHERE reason IS NULL")
def reference_state(spark, sf):
    return audits.reference_check(audits.germline_reference(genes(spark, sf), "V")[0], 1, 300)


# ---- positions, loops and masks


@query("""
WITH p AS (SELECT round(p_size * 2 + 20 + CASE WHEN p_size % 5 = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 6) AS position FROM part)
SELECT position, position BETWEEN 27 AND 38.9 OR position BETWEEN 56 AND 65.9 OR position BETWEEN 105 AND 117.9 AS inside, count(*) AS n FROM p GROUP BY ALL""")
def loop_positions(spark, sf):
    at = T.position(size() * 2 + 20, by_rest(size(), 5, " b", "", None))
    return tally(table(spark, sf, "part").select(F.round(at, 6).alias("position"), T.loop_mask(F.array(at))[0].alias("inside")))


_LABELLED = "r AS (SELECT regexp_extract_all(p_name, '[aeiou]+') AS x FROM part), l AS (SELECT CAST(3 - len(x) + i AS VARCHAR) AS loop, x[i] AS letters FROM r, unnest(range(1, len(x) + 1)) AS u(i) WHERE len(x) <= 3)"


@query(f"WITH {_LABELLED} SELECT loop, letters, CAST(length(letters) AS INT) AS size, count(*) AS n FROM l GROUP BY ALL")
def loops_from_end(spark, sf):
    rows = table(spark, sf, "part").select("p_name", vowel_mask(F.col("p_name")).alias("mask"))
    rows = rows.select("p_name", "mask", F.explode(R.labelled_from_end(R.true_runs(F.col("mask")))).alias("loop", "run"))
    return tally(rows.select("loop", R.cut_text(F.col("p_name"), F.col("run")).alias("letters"), F.size(R.cut_array(F.col("mask"), F.col("run"))).alias("size")))


@query(f"WITH {_LABELLED} SELECT loop, count(*) AS n, count(*) FILTER (NOT regexp_matches(letters, '[ei]')) AS none FROM l GROUP BY 1")
def loops_without_interface(spark, sf):
    letters = F.split("p_name", "")
    rows = table(spark, sf, "part").select(vowel_mask(F.col("p_name")).alias("cdr_mask"), F.transform(letters, lambda x: x.isin("e", "i")).alias("interface_mask"))
    return audits.zero_interface(rows)


@query(f"""
WITH {_LABELLED.replace("FROM part)", "FROM part WHERE p_size % 2 = 0)")}, c AS (SELECT loop, unnest(regexp_extract_all(upper(letters), '[ACDEFGHIKLMNPQRSTVWY]')) AS letter FROM l)
SELECT loop, scope, letter, count(*) AS n FROM c, (VALUES ('masked'), ('full')) v(scope) WHERE scope = 'full' OR letter = 'E' GROUP BY ALL""")
def loop_compositions(spark, sf):
    letters = F.split("p_name", "")
    rows = table(spark, sf, "part").select(
        (size() % 2 == 0).alias("has_antigen"), vowel_mask(F.col("p_name")).alias("cdr_mask"), F.transform(letters, lambda x: x == "e").alias("interface_mask"), F.struct(F.upper("p_name").alias("sequence_aa")).alias("heavy"),
    )
    return audits.loop_compositions(rows)


@query("""
WITH c AS (SELECT p_type, unnest(regexp_extract_all(p_name, '[a-z]')) AS letter FROM part)
SELECT p_type, scope, letter, count(*) AS n FROM c, (VALUES ('masked'), ('full')) v(scope) WHERE scope = 'full' OR letter IN ('a', 'e', 'i', 'o', 'u') GROUP BY ALL""")
def masked_composition(spark, sf):
    rows = table(spark, sf, "part").select("p_type", F.col("p_name").alias("seq"), vowel_mask(F.col("p_name")).alias("mask"))
    return geometry.masked_composition(rows, "abcdefghijklmnopqrstuvwxyz", "p_type")


@query("""
WITH r AS (SELECT upper(regexp_extract_all(p_name, '[^aeiou ]+')[-1]) AS x FROM part)
SELECT unnest(regexp_extract_all(x, '[ACDEFGHIKLMNPQRSTVWY]')) AS letter, count(*) AS n FROM r GROUP BY 1""")
def token_composition(spark, sf):
    letters = F.split("p_name", "")
    tokens = F.transform(letters, lambda x: F.instr(F.lit(audits.ALPHABET), F.upper(x)) + 4)
    rows = table(spark, sf, "part").select(tokens.alias("tokens"), F.transform(letters, lambda x: ~x.isin(*VOWELS, " ", "")).alias("cdr_full_mask"))
    return audits.repertoire_composition(rows)


@query("""
WITH j AS (SELECT p_name || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS x FROM part)
SELECT substr(x, 1, 12) AS chain, length(x) > 12 AS truncated, length(x) > 15 AS over, count(*) AS n FROM j GROUP BY ALL""")
def joined_chains(spark, sf):
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    light = F.when(size() % 2 == 0, F.col("p_type"))
    found = R.joined_chains(letters("p_name"), letters(light), 12)
    rows = table(spark, sf, "part").select(found.alias("j"), funnel.over_cap(F.length(F.concat("p_name", F.coalesce(light, F.lit("")))), 15).alias("over"))
    return tally(rows.select(F.array_join("j.values", "").alias("chain"), "j.truncated", "over"))


# ---- gates and logs


@query("""
WITH p AS (SELECT *, CASE WHEN p_size % 9 = 0 THEN 'NMR' ELSE CAST(p_size % 3 AS VARCHAR) END AS model FROM part)
SELECT CASE WHEN p_size % 11 = 0 THEN 'missing_pdb' WHEN p_size % 13 = 0 AND p_partkey * 100 > 99999 THEN 'atom_serial_overflow' WHEN model = 'NMR' THEN 'non_numeric_model_id' WHEN p_size % 13 <= 1 THEN 'parse_error'
  WHEN p_size % 10 = 3 THEN 'missing_H_chain' WHEN p_size * 2 < 10 THEN 'short_H' WHEN p_size % 12 < 3 THEN 'too_few_coords' WHEN p_size % 8 = 0 THEN 'no_cdr_positions' WHEN p_size > 35 THEN 'h3_too_long' WHEN p_size < 7 THEN 'h3_too_short' ELSE 'ok' END AS stage,
  CASE WHEN model <> 'NMR' THEN CAST(least(CAST(nullif(model, 'NMR') AS INT), 1) AS INT) END AS model, count(*) AS n FROM p GROUP BY ALL""")
def structure_funnel(spark, sf):
    rows = table(spark, sf, "part").select(
        (size() % 11 != 0).alias("found"), by_rest(size(), 13, "invalid literal for int()", "bad line").alias("error"), (F.col("p_partkey") * 100).alias("atoms"), F.when(size() % 9 == 0, "NMR").otherwise((size() % 3).cast("string")).alias("model"),
        (size() % 10 != 3).alias("heavy_found"), (size() * 2).alias("heavy_length"), (size() % 12).alias("coords"), (size() % 8).alias("loop_positions"), size().alias("h3_length"),
    )
    return tally(rows.select(funnel.stage(funnel.structure_gates(7, 35)).alias("stage"), funnel.clamp_model(F.col("model"), F.lit(2)).alias("model")))


@query("""
WITH s AS (SELECT CASE WHEN p_size < 20 THEN 'short' ELSE 'long' END AS direction, p_size AS v FROM part WHERE p_size < 20 OR p_size > 35)
SELECT direction, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v::DOUBLE, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std_sample, round(stddev_pop(v), 6) AS std_population, round(quantile_cont(v::DOUBLE, 0.95), 6) AS p95,
  round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max FROM s GROUP BY 1""")
def boundary_lengths(spark, sf):
    stage = F.when(size() < 20, F.concat(F.lit("h3_too_short_"), size())).when(size() > 35, F.concat(F.lit("h3_too_long_"), size())).otherwise("ok")
    return rounded(audits.boundary_lengths(table(spark, sf, "part").select(stage.alias("stage"))), "mean", "median", "std_sample", "std_population", "p95", "p99")


@query("""
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'NMR' ELSE '1.5' END AS model, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders WHERE o_orderkey % 5 IN (0, 2) GROUP BY 1""")
def odd_models(spark, sf):
    rows = table(spark, sf, "orders").select(by_rest(F.col("o_orderkey"), 5, "NMR", "-3", "1.5", "0", "12").alias("model"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return audits.odd_models(rows)


@query("""
SELECT 'kept' AS state, count(*) AS n FROM part WHERE p_size % 6 <> 0 UNION ALL SELECT 'earlier', count(*) FROM part WHERE p_size = 1
UNION ALL SELECT 'mislabelled', count(*) FROM part WHERE p_size % 6 = 0""")
def excluded_rows(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    log = part.where("p_size = 1").select("p_partkey", F.lit("earlier").alias("stage"))
    kept, after = funnel.exclude(part, part.where("p_size % 6 = 0"), "p_partkey", log, "mislabelled")
    known = spark.createDataFrame([("kept",), ("earlier",), ("mislabelled",)], "state string")
    n = kept.select(F.lit("kept").alias("state")).unionByName(after.select(F.col("stage").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))
    return known.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_yet_done(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.not_yet_done(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END AS p_brand FROM part")
def patched_column(spark, sf):
    part = table(spark, sf, "part")
    return sinks.patched(part.select("p_partkey", "p_brand"), part.where("p_size % 2 = 0").select("p_partkey", F.col("p_type").alias("p_brand")), "p_partkey", "p_brand")


@query("SELECT p_size % 2 = 0 AS even, CASE WHEN p_size % 3 = 0 THEN p_type END AS detail, count(*) AS n FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0 GROUP BY ALL")
def appended_log(spark, sf):
    part = table(spark, sf, "part")
    both = sinks.append_log(part.where("p_size % 2 = 0 AND p_size % 3 <> 0").select((size() % 2 == 0).alias("even")), part.where("p_size % 3 = 0").select((size() % 2 == 0).alias("even"), F.col("p_type").alias("detail")))
    return tally(both)


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY i)) AS lines FROM l WHERE regexp_matches(line, '^[L-M]') GROUP BY 1""")
def matching_lines(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("pdb_id"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return readers.grep_lines(lines, "^[L-M]").select(F.col("pdb_id").alias("doc_id"), F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines"))


# ---- structures


@query("SELECT l_partkey AS pdb_id, count(*) AS atoms FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1")
def atom_counts(spark, sf):
    return readers.atom_counts(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pdb_id"), by_rest(F.col("l_linenumber"), 3, "ATOM   1", "HETATM 2", "TER ATOM").alias("value")))


@query("""
WITH a AS (SELECT l_partkey AS pdb_id, l_returnflag AS chain, CASE l_linenumber % 4 WHEN 0 THEN 'HOH' WHEN 1 THEN 'ALA' WHEN 2 THEN 'so4' ELSE 'GLY' END AS resname, l_suppkey FROM lineitem)
SELECT pdb_id, chain, resname, count(*) AS n FROM a WHERE resname IN ('ALA', 'GLY') AND (pdb_id, chain) IN (SELECT (pdb_id, chain) FROM a WHERE l_suppkey % 3 = 0) AND (pdb_id, chain) NOT IN (SELECT (pdb_id, chain) FROM a WHERE l_suppkey % 5 = 0) GROUP BY ALL""")
def antigen_atoms(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pdb_id"), F.col("l_returnflag").alias("chain"), by_rest(F.col("l_linenumber"), 4, "HOH", "ALA", "so4", "GLY").alias("resname"), "l_suppkey")
    return tally(readers.antigen_atoms(rows, rows.where("l_suppkey % 3 = 0"), rows.where("l_suppkey % 5 = 0")).select("pdb_id", "chain", "resname"))


@query("""
WITH a AS (SELECT DISTINCT l_partkey AS pdb_id, l_returnflag AS chain, CAST(l_quantity * 3 AS INT) AS resseq, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'K' ELSE 'W' END AS letter FROM lineitem WHERE l_linenumber < 7 AND l_quantity * 3 <= 128)
SELECT pdb_id, chain, string_agg(letter || resseq, ' ' ORDER BY resseq, letter) AS residues FROM a GROUP BY ALL""")
def variable_domains(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("pdb_id"), F.lit(0).alias("model"), F.col("l_returnflag").alias("chain"), F.when(n < 7, "CA").otherwise("CB").alias("atom"), F.lit(False).alias("hetero"), by_rest(n, 3, "ALA", "lys", "TRP").alias("resname"),
        (F.col("l_quantity") * 3).cast("int").alias("resseq"), F.lit(None).cast("string").alias("icode"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )
    named = F.transform("residues", lambda r: F.concat(r["letter"], r["resseq"].cast("string")))
    return readers.variable_domain(rows).select("pdb_id", "chain", F.array_join(named, " ").alias("residues"))


_XYZ = "SELECT l_partkey, l_linenumber AS residue, l_returnflag AS aa, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lineitem"


def line_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as atoms of their part."""
    return table(spark, sf, "lineitem").select("l_partkey", F.col("l_linenumber").alias("residue"), F.col("l_returnflag").alias("aa"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"))


@query(f"""
WITH l AS ({_XYZ}), a AS (SELECT * FROM l WHERE aa <> 'R'), t AS (SELECT * FROM l WHERE aa = 'R'),
d AS (SELECT a.l_partkey, a.residue, a.aa, sqrt(min((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y) + (a.z - t.z) * (a.z - t.z))) AS d FROM a JOIN t USING (l_partkey) GROUP BY ALL)
SELECT l_partkey, residue, aa, round(d, 6) AS min_dist, d <= 4.5 AS interface FROM d""")
def contact_masks(spark, sf):
    rows = line_atoms(spark, sf)
    found = geometry.contact_distances(rows.where("aa <> 'R'"), rows.where("aa = 'R'"), "l_partkey")
    return rounded(geometry.interface_mask(found, 4.5), "min_dist")


@query("""
WITH d AS (SELECT l_returnflag AS aa, l_quantity / 5 AS d FROM lineitem), n AS (SELECT t::DOUBLE AS threshold, aa, count(*) FILTER (d <= t) AS contacting, count(*) FILTER (d > t) AS other FROM d, (VALUES (4.5::DOUBLE), (6::DOUBLE), (8::DOUBLE), (10::DOUBLE)) v(t) GROUP BY ALL),
s AS (SELECT *, contacting::DOUBLE / nullif(sum(contacting) OVER (PARTITION BY threshold), 0) AS a, other::DOUBLE / nullif(sum(other) OVER (PARTITION BY threshold), 0) AS b FROM n)
SELECT threshold, aa, contacting, other, round(a, 6) AS share_contacting, round(b, 6) AS share_other, round(a / nullif(b, 0), 6) AS fold FROM s""")
def contact_composition(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("aa"), (F.col("l_quantity") / 5).alias("min_dist"))
    return rounded(geometry.composition_by_threshold(rows), "share_contacting", "share_other", "fold")


#: five fixed points; scaled copies are |difference of scales| x the root of their mean squared distance from the centre apart
POINTS = ((0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3), (1, 1, 1))
_RMSD = """
WITH p AS (SELECT p_partkey AS k, p_brand || '/' || p_type || '/' || p_size AS cluster, 1 + p_retailprice / 1000 AS f FROM part),
d AS (SELECT a.cluster, a.k AS a, b.k AS b, abs(a.f - b.f) * sqrt(2.24::DOUBLE) AS rmsd FROM p a JOIN p b ON a.cluster = b.cluster AND a.k < b.k)"""


def scaled_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as loops of five points scaled by their price, after one masked residue."""
    scale = 1 + F.col("p_retailprice") / 1000
    points = F.array(F.array(*[F.lit(9.0)] * 3), *[F.array(*[scale * x for x in p]) for p in POINTS])
    mask = F.array(*[F.lit(i > 0) for i in range(len(POINTS) + 1)])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("filename_stem"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("cluster"), mask.alias("cdr_mask"), points.alias("coords"))


@query(_RMSD + "SELECT cluster, a, b, round(rmsd, 4) AS rmsd FROM d")
def backbone_rmsd(spark, sf):
    return rounded(audits.backbone(scaled_samples(spark, sf), "cluster", 1_000_000)[0], "rmsd", digits=4)


@query(_RMSD + "SELECT count(*) AS n, round(avg(rmsd), 4) AS mean, round(max(rmsd), 4) AS max, round(avg((rmsd < 1)::INT), 4) AS below_1, round(avg((rmsd < 2)::INT), 4) AS below_2 FROM d")
def backbone_report(spark, sf):
    found = geometry.rmsd_report(audits.backbone(scaled_samples(spark, sf), "cluster", 1_000_000)[0], ranked=False)
    return rounded(found.select("n", "mean", "max", "below_1", "below_2"), "mean", "max", "below_1", "below_2", digits=4)


@query(_RMSD + """, c AS (SELECT cluster, avg(rmsd) AS m, count(*) AS n FROM d GROUP BY 1)
SELECT round((SELECT avg(rmsd) FROM d), 4) AS pair_weighted, round(avg(m), 4) AS cluster_weighted, CAST(sum(n) AS BIGINT) AS pairs, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, cluster LIMIT 2)) / sum(n), 4) AS top2_share FROM c""")
def backbone_weighting(spark, sf):
    pairs = audits.backbone(scaled_samples(spark, sf), "cluster", 1_000_000)[0]
    return rounded(geometry.weighted_means(pairs, "cluster"), "pair_weighted", "cluster_weighted", "top2_share", digits=4)


# ---- composite audits

_SPREAD = """count(*) AS categories, CAST(sum(n) AS BIGINT) AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits, round(CASE WHEN count(*) > 1 THEN (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) ELSE 0 END, 6) AS normalized_entropy,
  round((2 * sum(n * r) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)), 6) AS gini, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) AS simpson"""
_SPREADS = ("entropy_bits", "normalized_entropy", "gini", "simpson")


@query(f"""
WITH c AS (SELECT dim, cat, count(*)::DOUBLE AS n FROM (SELECT 'c_mktsegment' AS dim, CASE WHEN c_custkey % 10 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS cat FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n) AS r FROM c) SELECT dim, {_SPREAD} FROM r GROUP BY dim""")
def category_bias(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return rounded(audits.category_bias(rows, "c_mktsegment", "c_nationkey"), *_SPREADS)


@query(f"""
WITH w AS (SELECT p_size AS v FROM part WHERE p_size BETWEEN 3 AND 35), r AS (SELECT v, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY count(*)) AS r FROM w GROUP BY 1)
SELECT s.*, d.* FROM (SELECT {_SPREAD} FROM r) s, (SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v::DOUBLE, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std_sample, round(stddev_pop(v), 6) AS std_population,
  round(quantile_cont(v::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max FROM w) d""")
def length_bias(spark, sf):
    metrics, spread = audits.length_bias(table(spark, sf, "part").select("p_size"), "p_size")
    return rounded(metrics.crossJoin(spread), *_SPREADS, "mean", "median", "std_sample", "std_population", "p95", "p99")  # one row each


@query("""
WITH p AS (SELECT CASE p_size % 6 WHEN 0 THEN 'viral' WHEN 1 THEN 'bacterial' WHEN 2 THEN 'immune_receptor' WHEN 3 THEN 'enzyme' WHEN 4 THEN 'cancer_associated' ELSE 'other_protein' END AS antigen_class, p_retailprice > 950 AS t FROM part WHERE p_size % 5 <> 0)
SELECT antigen_class, count(*) FILTER (NOT t) AS n_others, count(*) FILTER (t) AS n_therapeutic FROM p GROUP BY 1""")
def antigen_landscape(spark, sf):
    name = by_rest(size(), 6, "Influenza virus", "botulinum toxin", "anaphylatoxin chemotactic receptor", "DNA polymerase", "HER2", "lysozyme")
    rows = table(spark, sf, "part").select(name.alias("antigen_name"), F.lit("protein").alias("antigen_type"), F.when(size() % 5 != 0, "True").otherwise("").alias("has_antigen"), (F.col("p_retailprice") > 950).alias("is_therapeutic"))
    return audits.landscape(rows)[1].withColumnsRenamed({"False": "n_others", "True": "n_therapeutic"})


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN {_CLASS.format(c='text')} END AS class, count(*) AS n FROM documents GROUP BY 1")
def bound_classes(spark, sf):
    bound = F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no")
    return tally(table(spark, sf, "documents").select(T.classify_bound(F.col("text"), bound, RULES).alias("class")))


@query("""
SELECT c_mktsegment AS heavy_species, count(*) AS n, count(*) FILTER (c_nationkey % 3 > 0) AS light FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1""")
def chain_scope(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("heavy_species"), F.when(F.col("c_custkey") % 3 != 0, "mouse").alias("light_species"), by_rest(F.col("c_nationkey"), 3, "H", "K", "L").alias("chain_type"))
    return audits.chain_scope(rows)


@query("""
WITH d AS (SELECT md5(text) AS c, doc_id % 4 = 0 AS bound FROM documents WHERE text IS NOT NULL)
SELECT 'all' AS population, count(*) AS n_rows, count(*) FILTER (bound) AS n_bound FROM d UNION ALL SELECT 'representatives', count(*), count(*) FILTER (b) FROM (SELECT max(bound) AS b FROM d GROUP BY c)""")
def bound_denominators(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.md5("text").alias("cluster_rep"), (F.col("doc_id") % 4 == 0).alias("has_antigen"), F.col("doc_id").alias("pdb_id"), F.col("doc_id").alias("filename_stem"))
    return audits.bound_denominators(rows)


@query("SELECT p_type, p_size % 4 = 0 AS is_null, count(*) AS n FROM part GROUP BY ALL")
def null_labels(spark, sf):
    return audits.null_labels(table(spark, sf, "part").select("p_type", F.when(size() % 4 != 0, F.col("p_brand")).alias("label")), "label", "p_type")


@query("SELECT CASE WHEN event_id % 50 = 0 THEN 'UNREADABLE' ELSE event_type END AS species, count(*) AS n FROM events GROUP BY 1")
def header_species(spark, sf):
    return audits.header_species(table(spark, sf, "events").select(F.when(F.col("event_id") % 50 == 0, "unreadable").otherwise("ok").alias("state"), F.col("event_type").alias("Species")))


@query("SELECT contains(lower(p_name), 'ring') OR contains(lower(p_name), 'wid') OR contains(lower(p_type), 'econ') AS hit, count(*) AS n FROM part GROUP BY 1")
def any_term(spark, sf):
    return tally(table(spark, sf, "part").select(audits.any_term("p_name", ("ring", "wid"), "p_type", ("econ",)).alias("hit")))


@query("""
WITH m AS (SELECT p_brand AS b, CASE WHEN p_size % 5 <> 0 THEN p_type END AS t, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand, CASE WHEN p_size % 5 <> 0 THEN p_type END ORDER BY p_partkey) AS place FROM part),
s AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS b, CASE WHEN s_suppkey % 4 <> 0 THEN 'ECONOMY' END AS t, CASE WHEN s_suppkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM supplier),
j AS (SELECT split, p_partkey, p_size FROM s JOIN m ON s.b = m.b AND s.t IS NOT DISTINCT FROM m.t AND place = 1), v AS (SELECT 'p_partkey' AS relation, p_partkey AS v, split FROM j UNION ALL SELECT 'p_size', p_size, split FROM j),
g AS (SELECT relation, v, min(split) <> max(split) AS leaks, count(*) AS n FROM v GROUP BY ALL)
SELECT relation, count(*) AS n_values, count(*) FILTER (leaks) AS n_leaked, CAST(coalesce(sum(n) FILTER (leaks), 0) AS BIGINT) AS rows_of_leaked FROM g GROUP BY 1""")
def external_split(spark, sf):
    k = F.col("s_suppkey")
    manifest = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), k % 25 + 1).alias("b"), F.when(k % 4 != 0, "ECONOMY").alias("t"), F.when(k % 10 < 8, "train").otherwise("test").alias("split"))
    master = table(spark, sf, "part").select(F.col("p_brand").alias("b"), F.when(size() % 5 != 0, F.col("p_type")).alias("t"), "p_partkey", "p_size")
    return audits.external_split(master, manifest, ["b", "t"], "split", ["p_partkey", "p_size"], "p_partkey")[1]


@query("SELECT 'name' AS relation, count(DISTINCT p_name) AS n_values, CAST(0 AS BIGINT) AS n_leaked, CAST(0 AS BIGINT) AS rows_of_leaked FROM part UNION ALL SELECT 'price', count(DISTINCT (round(p_retailprice * 100), p_type)), 0, 0 FROM part")
def component_splits(spark, sf):
    """Relations that components follow leak nowhere."""
    return audits.component_splits(linked_parts(spark, sf), "p_partkey", ["name", "price"], ["name", "price"])[1]


@query(_COMPONENTS + ", g AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT component, n, round(n::DOUBLE / (SELECT sum(n) FROM g), 6) AS share FROM g ORDER BY n DESC, component LIMIT 1")
def largest_component(spark, sf):
    return rounded(graph.largest_component(graph.components(linked_parts(spark, sf), "p_partkey", ["name", "price"]), "component"), "share")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS cluster_rep FROM documents")
def exact_clusters(spark, sf):
    return dedup.exact_clusters(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "cluster_rep")


@query("SELECT (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS kept, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS lost")
def checked_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    kept, lost = joins.checked_inner_join(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"])
    return kept.agg(F.count("*").alias("kept")).crossJoin(lost)  # one row each


@query("SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 100")
def drawn_rows(spark, sf):
    """A sampling operator."""
    return sampling.shuffled(sampling.sample(table(spark, sf, "events").select("event_id"), "event_id", 100), "event_id")


@query("""
WITH a AS (SELECT l_quantity, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS b FROM lineitem GROUP BY 1), s AS (SELECT abs(a / sum(a) OVER () - b / sum(b) OVER ()) AS r FROM a)
SELECT round(max(r), 6) AS largest FROM s""")
def largest_residual(spark, sf):
    rows = table(spark, sf, "lineitem")
    n = lambda flag: M.counts(rows.where(F.col("l_returnflag") == flag), "l_quantity")
    return rounded(audits.chart_residuals(n("A"), n("N"), "l_quantity")[1].select("largest"), "largest")


# ---- calls, agreement and intervals


@query("""
WITH p AS (SELECT DISTINCT p_size, CASE WHEN p_size % 4 <> 0 THEN 'IGKV' || (p_size % 5) END AS k, p_size / 50.0::DOUBLE AS ki, CASE WHEN p_size % 3 <> 0 THEN 'IGLV' || (p_size % 7) END AS m, (p_size * 7 % 50) / 50.0::DOUBLE AS mi FROM part),
c AS (SELECT *, k IS NOT NULL AND (m IS NULL OR ki >= mi) AS first FROM p)
SELECT p_size, CASE WHEN first THEN 'kappa' WHEN m IS NOT NULL THEN 'lambda' END AS locus, CASE WHEN first THEN k ELSE m END AS gene_id, round(CASE WHEN first THEN ki ELSE mi END, 6) AS identity FROM c""")
def chosen_locus(spark, sf):
    match = lambda n, gene, identity: F.struct(F.when(size() % n != 0, gene).alias("gene_id"), identity.alias("identity"))
    found = align.choose_locus(match(4, F.concat(F.lit("IGKV"), size() % 5), size() / 50.0), match(3, F.concat(F.lit("IGLV"), size() % 7), (size() * 7 % 50) / 50.0))
    return rounded(table(spark, sf, "part").select("p_size").distinct().select("p_size", found.alias("c")).select("p_size", "c.*"), "identity")


@query("""
WITH p AS (SELECT p_size % 3 = p_size % 4 AS same, p_retailprice > 950 AS sure, p_size % 2 = 0 AS alike FROM part)
SELECT round(avg(same::INT), 6) AS allele, round(avg(same::INT) FILTER (sure), 6) AS allele_confident, round(avg(same::INT) FILTER (NOT sure), 6) AS allele_other, 1::DOUBLE AS family, avg(1) FILTER (sure) AS family_confident, round(avg(alike::INT), 6) AS species, round(avg(alike::INT) FILTER (sure), 6) AS species_confident FROM p""")
def cross_method(spark, sf):
    part = table(spark, sf, "part")
    call = lambda n, species: part.select("p_partkey", F.concat(F.lit("IGHV"), size() % 5, F.lit("-"), size() % n).alias("gene_id"), (F.col("p_retailprice") > 950).alias("sure"), species.alias("species"))
    found = align.cross_method(call(3, F.lit(" Human")), call(4, by_rest(size(), 2, "human", "mouse")), "p_partkey", T.gene_family, "sure", "species")
    return rounded(found, "allele", "allele_confident", "allele_other", "species", "species_confident")


@query("SELECT round(avg(quality), 6) AS whole, round(avg(quality) FILTER (toxic = 1), 6) AS toxic, round(avg(quality) FILTER (toxic = 0), 6) AS clean FROM labels WHERE quality IS NOT NULL")
def agreement_rates(spark, sf):
    rows = table(spark, sf, "labels").where("quality IS NOT NULL")
    return rounded(S.agreement(rows, F.col("quality") == 1, whole=F.lit(True), toxic=F.col("toxic") == 1, clean=F.col("toxic") == 0), "whole", "toxic", "clean")


_WILSON = "greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)) AS low, least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)) AS high"


@query(f"""
WITH g AS (SELECT source, avg((n_chars >= 1000)::INT) AS p, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM documents GROUP BY 1), w AS (SELECT source, n, {_WILSON} FROM g)
SELECT source, CAST(n AS BIGINT) AS n, low > 0.5 OR high < 0.5 AS told FROM w""")
def excluded_values(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("n_chars") >= 1000).cast("int")).alias("h"))
    return rows.select("source", "n", S.wilson(F.col("h"), F.col("n")).alias("w")).select("source", "n", S.excludes(F.col("w.low"), F.col("w.high"), 0.5).alias("told"))


@query(f"""
WITH s AS (SELECT doc_id % 3 AS stratum, CAST(quality AS VARCHAR) AS a, CASE WHEN doc_id % 5 = 0 THEN CAST(quality AS VARCHAR) WHEN doc_id % 7 = 0 THEN '0' ELSE CAST(toxic AS VARCHAR) END AS t FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT 'accuracy' AS what, (a = t)::INT AS hit FROM s WHERE stratum = 0 UNION ALL SELECT 'leaked', (t <> '1')::INT FROM s WHERE stratum = 2),
g AS (SELECT what, CAST(sum(hit) AS BIGINT) AS hits, avg(hit) AS p, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM h GROUP BY 1), w AS (SELECT what, n, hits, p, {_WILSON} FROM g)
SELECT what, CAST(n AS BIGINT) AS n, hits, round(p, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high FROM w""")
def scored_sheet(spark, sf):
    k = F.col("doc_id")
    correct = F.when(k % 5 == 0, " ").when(k % 7 == 0, " 0 ").otherwise(F.col("toxic").cast("string"))
    sheet = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(by_rest(k, 3, "random", "rare", "audit").alias("stratum"), F.col("quality").cast("string").alias("assigned_class"), correct.alias("correct_class"))
    accuracy, _, leaked = audits.score_sheet(sheet, "1")
    return rounded(accuracy.withColumn("what", F.lit("accuracy")).unionByName(leaked.withColumn("what", F.lit("leaked"))), "rate", "low", "high")
