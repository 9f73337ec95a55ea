"""Composite entry points, each a declarative plan over typed frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import runs as R
from ledgerlens.functions import stats as S
from ledgerlens.functions import text as T
from ledgerlens.operators import dedup, geometry, graph, joins, sampling
from ledgerlens.plans import antigens, compare
from ledgerlens.sources import contracts as C
from ledgerlens.sources.stage import checkpointed

LENGTHS = (3, 35)
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
#: symbols of repertoire tokens: the letters follow five special tokens
SYMBOLS = {5 + i: letter for i, letter in enumerate(ALPHABET)}
ANTIBODY = ["pdb_id", "h_chain", "l_chain"]


def master_table(samples: DataFrame, summary: DataFrame, therapeutics: DataFrame) -> DataFrame:
    """Samples with their summary row (exact stem, else the only chain pair) and best tier."""
    meta = joins.fallback_join(samples.select("filename_stem", "pdb_id"), summary, ["pdb_id", "filename_stem"], "pdb_id", ["h_chain", "l_chain"], ["h_chain", "l_chain"], "h_chain")
    rest = F.struct(*[c for c in summary.columns if c not in ("filename_stem", "pdb_id")])
    exact = joins.keep_one(summary, ["filename_stem"], F.desc("date")).select("filename_stem", rest.alias("_exact"))
    only = joins.keep_one(summary, ["pdb_id"], "h_chain", "l_chain").select("pdb_id", rest.alias("_only"))
    rows = samples.join(meta.select("filename_stem", "match"), "filename_stem", "left").join(exact, "filename_stem", "left").join(only, "pdb_id", "left")
    one = F.when(F.col("match") == "exact", F.col("_exact")).when(F.col("match") == "fallback", F.col("_only"))
    joined = rows.withColumn("_row", one).drop("_exact", "_only").select("*", "_row.*").drop("_row")
    best = joins.keep_one(therapeutics, ANTIBODY, "tier_rank", "therapeutic").select(*ANTIBODY, "therapeutic", "tier")
    return joined.join(best, ANTIBODY, "left").withColumn("is_therapeutic", F.col("tier").isNotNull())


def build_report(master: DataFrame) -> DataFrame:
    """One row of counts of the build."""
    n = lambda c: F.count(F.when(c, 1))
    return master.agg(F.count("*").alias("rows"), n(F.col("match") == "fallback").alias("fallback"), n(F.col("match") == "none").alias("unmatched"), n(F.col("is_therapeutic")).alias("therapeutic"))


def length_bias(master: DataFrame, length: str = "cdr3_len_actual") -> tuple[DataFrame, DataFrame]:
    """Metrics and spread of lengths inside the window."""
    rows = master.where(F.col(length).between(*LENGTHS))
    return M.summary(M.counts(rows, length)), M.describe(rows, length)


def category_bias(master: DataFrame, *cols: str) -> DataFrame:
    """(dim, metrics) of columns, nulls as UNKNOWN; lower-case ``unknown`` stays apart."""
    dims = F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("cat")) for c in cols])
    n = master.select(F.explode(dims).alias("d")).select("d.*").groupBy("dim", "cat").agg(F.count("*").alias("n"))
    return M.summary(n, "dim")


def rate_by_year(master: DataFrame, flag: Column, date: str = "date") -> DataFrame:
    return master.where(T.year_of(F.col(date)).isNotNull()).groupBy(T.year_of(F.col(date)).alias("year")).agg(F.count("*").alias("n"), F.avg(flag.cast("int")).alias("rate"))


def redundancy(master: DataFrame, sequence: str = "h3_seq", identity: float = 0.9, coverage: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows with their cluster, and the cluster summary."""
    rows = dedup.near_clusters(master.where(F.col(sequence).isNotNull()), sequence, identity, coverage)
    return rows, dedup.cluster_sizes(rows, "cluster_rep", sequence)


def landscape(master: DataFrame, rules: T.Rules = antigens.RULES, name: str = "antigen_name", kind: str = "antigen_type", flag: str = "is_therapeutic") -> tuple[DataFrame, DataFrame]:
    """Classes of antigen-bound rows: metrics, and classes by flag."""
    rows = master.where(T.truthy(F.col("has_antigen"))).withColumn("antigen_class", T.classify(F.concat_ws(" ", name, kind), rules))
    return M.summary(M.counts(rows, "antigen_class")), M.crosstab(rows, "antigen_class", flag, [False, True])


def backbone(samples: DataFrame, cluster: str, max_size: int, tile: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair RMSDs in clusters, the clusters left out for size, and pairs of unequal length."""
    rows = samples.withColumn("points", geometry.loop_points(F.col("cdr_mask"), F.col("coords")))
    lengths = rows.where("points IS NOT NULL").withColumn("len", F.size("points"))
    return geometry.pair_rmsd(rows, cluster, "filename_stem", "points", tile, max_size), geometry.skipped_clusters(lengths, cluster, max_size), joins.pair_counts(lengths, cluster, "len")


def loop_compositions(samples: DataFrame) -> DataFrame:
    """(loop, scope, letter, n) of heavy loops of antigen-bound rows: masked and full."""
    found = R.labelled_from_end(R.true_runs(F.col("cdr_mask")))
    rows = samples.where(T.truthy(F.col("has_antigen"))).select("heavy.sequence_aa", "interface_mask", F.explode(found).alias("loop", "run"))
    cut = rows.select("loop", R.cut_text(F.col("sequence_aa"), F.col("run")).alias("seq"), R.cut_array(F.col("interface_mask"), F.col("run")).alias("mask"))
    return geometry.masked_composition(cut, ALPHABET, "loop")


def zero_interface(samples: DataFrame) -> DataFrame:
    """(loop, n, none): loops without any interface residue."""
    found = R.labelled_from_end(R.true_runs(F.col("cdr_mask")))
    rows = samples.where("interface_mask IS NOT NULL").select("interface_mask", F.explode(found).alias("loop", "run"))
    any_on = F.exists(R.cut_array(F.col("interface_mask"), F.col("run")), lambda x: x)
    return rows.groupBy("loop").agg(F.count("*").alias("n"), F.count(F.when(~any_on, 1)).alias("none"))


def repertoire_divergence(master: DataFrame, repertoire: DataFrame, n: int, species: str = "human", seed: int = 42) -> DataFrame:
    """One row: Jensen-Shannon divergence of lengths, of a species and of a sample by splits.

    The sample is drawn from splits in proportion to their sizes.
    """
    ours = master.where((F.lower(F.trim("heavy_species")) == species) & F.col("cdr3_len_actual").between(*LENGTHS)).select(F.col("cdr3_len_actual").cast("int").alias("length"))
    sizes = repertoire.groupBy("split").agg(F.count("*").alias("size"))
    shares = {r["split"]: r["allocated"] for r in sampling.proportional_allocation(sizes, "split", "size", n).collect()}  # a row a split
    drawn = None
    for split, k in sorted(shares.items()):
        part = sampling.sample(repertoire.where(F.col("split") == split), "clono_hash", k, seed)
        drawn = part if drawn is None else drawn.unionByName(part)
    theirs = drawn.where(F.col("cdr3_len").between(*LENGTHS)).select(F.col("cdr3_len").cast("int").alias("length"))
    return M.jensen_shannon(M.align(M.counts(ours, "length"), M.counts(theirs, "length"), "length"))


def unique_fraction(repertoire: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct clonotypes over all splits together, and their share."""
    distinct = F.approx_count_distinct("clono_hash", 0.01) if approximate else F.count_distinct("clono_hash")
    return repertoire.agg(distinct.alias("n_unique"), (distinct / F.count("*")).alias("unique_fraction"))


def proxy_clonotypes(master: DataFrame, gene: str = "heavy_subclass", seq: str = "h3_seq") -> DataFrame:
    """One row: rows with both parts, and distinct combinations."""
    rows = master.where(F.col(gene).isNotNull() & F.col(seq).isNotNull() & (F.col(seq) != ""))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(gene, seq).alias("clonotypes"))


def token_letters(tokens: Column, symbols: dict[int, str]) -> Column:
    """Symbols of token ids; unknown ids are left out."""
    known = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    return F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t.cast("int"))), lambda s: s.isNotNull())


def repertoire_composition(repertoire: DataFrame, symbols: dict[int, str] = SYMBOLS) -> DataFrame:
    """(letter, n) of the last loop of repertoire rows."""
    run = R.last_run(R.true_runs(F.col("cdr_full_mask")))
    rows = repertoire.select(F.explode(token_letters(R.cut_array(F.col("tokens"), run), symbols)).alias("letter"))
    return rows.groupBy("letter").agg(F.count("*").alias("n"))


def weighting_comparison(profile: DataFrame, cluster: str, columns: list[str], reference: dict[str, float], replicates: int = 2000) -> DataFrame:
    """(column, low, median, high, fold, significant): cluster bootstrap against reference shares."""
    spread = S.cluster_bootstrap(profile, cluster, columns, replicates)
    known = F.create_map(*[F.lit(x) for kv in reference.items() for x in kv])
    ref = F.try_element_at(known, F.col("column"))
    return spread.withColumn("reference", ref).withColumn("fold", S.ratio(F.col("median"), ref)).withColumn("significant", S.excludes(F.col("low"), F.col("high"), ref)).orderBy(F.desc(F.coalesce("fold", F.lit(0.0))), "column")


def null_labels(master: DataFrame, column: str, by: str) -> DataFrame:
    """(by, is_null, n): where a label is missing."""
    return master.groupBy(by, F.col(column).isNull().alias("is_null")).agg(F.count("*").alias("n"))


def label_by_flag(master: DataFrame, column: str, flag: str, upper: str = "UNKNOWN", lower: str = "unknown") -> DataFrame:
    """One row: two spellings of a missing label by a flag, and whether the flag parts them cleanly.

    Clean: every row of the upper spelling is unflagged, and every one of the lower is flagged.
    A null flag is neither.
    """
    n = lambda label, on: F.count(F.when((F.col(column) == label) & on, 1))
    yes, no, any_ = F.col(flag), ~F.col(flag), F.lit(True)
    found = master.agg(
        F.count("*").alias("n_rows"), n(upper, any_).alias("n_upper"), n(lower, any_).alias("n_lower"), n(upper, yes).alias("upper_true"),
        n(upper, no).alias("upper_false"), n(lower, yes).alias("lower_true"), n(lower, no).alias("lower_false"),
    )
    return found.withColumn("clean_split", (F.col("upper_false") == F.col("n_upper")) & (F.col("lower_true") == F.col("n_lower")))


def numbering_check(master: DataFrame, calls: DataFrame, key: str = "pdb_id", length: str = "cdr3_len_actual", low: int = 105, high: int = 117) -> tuple[DataFrame, DataFrame]:
    """Loop lengths against those of another numbering: one row of counts, and the rows that differ.

    ``calls``: key and ``numbering``, an array of (position, aa) with ``-`` for gaps, null where
    the other method failed. Rows without a length or a call are not compared.
    """
    inside = F.size(F.filter("numbering", lambda x: x["position"].between(low, high) & (x["aa"] != "-")))
    rows = master.where(F.col(length).isNotNull()).select(key, F.col(length).cast("int").alias("our_length")).join(calls.select(key, F.when(F.col("numbering").isNotNull() & (F.size("numbering") > 0), inside).alias("their_length")), key)
    both, same = F.col("their_length").isNotNull(), F.col("their_length") == F.col("our_length")
    one = rows.agg(F.count("*").alias("n_sampled"), F.count(F.when(both, 1)).alias("n_compared"), F.count(F.when(same, 1)).alias("n_agree"), F.count(F.when(~both, 1)).alias("n_errors"))
    return one.withColumn("agreement_percent", S.ratio(100.0 * F.col("n_agree"), F.col("n_compared"))), rows.where(both & ~same)


def migrate(master: DataFrame, clusters: DataFrame, rules: T.Rules) -> DataFrame:
    """The table with h3_seq, cluster_rep and antigen_class; as many rows as before, checked."""
    rows = joins.one_to_one_join(master, clusters.select("filename_stem", F.col("cdrh3_seq").alias("h3_seq"), "cluster_rep"), ["filename_stem"])
    rows = rows.withColumn("antigen_class", T.classify_bound(F.col("antigen_name"), F.col("has_antigen"), rules))
    odd = rows.where(F.col("h3_seq").isNotNull() & (F.length("h3_seq") != F.col("cdr3_len_actual"))).select("filename_stem")
    joins.require_none(odd, "sequence and length differ")
    return rows


def bound_denominators(master: DataFrame, cluster: str = "cluster_rep") -> DataFrame:
    """(population, rows, bound): all rows, and one representative a cluster."""
    bound = T.truthy(F.col("has_antigen"))
    reps = dedup.representatives(master, cluster, F.desc(bound.cast("int")), "pdb_id", "filename_stem")
    one = lambda d, name: d.agg(F.count("*").alias("n_rows"), F.count(F.when(bound, 1)).alias("n_bound")).withColumn("population", F.lit(name))
    return one(master, "all").unionByName(one(reps, "representatives"))


def construction(master: DataFrame, chains: str = "antigen_chain", seq: str = "antigen_seq") -> DataFrame:
    """(n_chains, n, tagged): rows by number of antigen chains, and those with bracket tags."""
    rows = master.withColumn("n_chains", F.size(T.parts_of(F.col(chains), "|")))
    return rows.groupBy("n_chains").agg(F.count("*").alias("n"), F.count(F.when(F.size(T.tags(F.col(seq))) > 0, 1)).alias("tagged"))


def tag_tally(master: DataFrame, seq: str = "antigen_seq") -> DataFrame:
    return master.select(F.explode(T.tags(F.col(seq))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def boundary_lengths(log: DataFrame) -> DataFrame:
    """Spread of lengths that a window excluded, by direction."""
    rows = log.select(T.length_stage(F.col("stage")).alias("s")).select("s.*").where("direction IS NOT NULL")
    return M.describe(rows, "length", "direction")


def odd_models(summary: DataFrame) -> DataFrame:
    """(model, n, first_date, last_date) of models that are no whole number; dates as text."""
    return summary.where(~T.is_whole_number(F.col("model"))).groupBy("model").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def any_term(col: str, terms: tuple[str, ...], fallback: str | None = None, fallback_terms: tuple[str, ...] = ()) -> Column:
    """Any of several texts inside a column, or inside another one."""
    hit = lambda c, ts: F.coalesce(F.lower(c).rlike("|".join(T.re.escape(t) for t in ts)), F.lit(False))
    out = hit(col, terms)
    return out | hit(fallback, fallback_terms) if fallback else out


def sensitivity(df: DataFrame, group: Column, before_year: int, categories: dict[str, Column]) -> DataFrame:
    """Snapshots of all rows, without a group, and before a year."""
    C.require_rows(df.where(group), "the group to leave out")
    return compare.population_cuts(df, {"all": F.lit(True), "without_group": ~group, f"before_{before_year}": F.col("year") < before_year}, categories)


def tier_counts(therapeutics: DataFrame) -> DataFrame:
    n = therapeutics.groupBy("tier").agg(F.count("*").alias("n_rows"), F.count_distinct("therapeutic").alias("n_distinct"))
    return compare.with_shares(n, "n_rows")


def tier_report(rows: DataFrame, tiers: tuple[str, ...], pair: list[str], name: str, structure: list[str], length: str, covariates: dict[str, Column], tier: str = "tier", flag: str = "is_therapeutic", replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(section, item, metric, value): therapeutics by tier in one report.

    ``counts``: rows and distinct ``pair`` values of each tier (0 where absent), of flagged rows
    (``any``) and of all, with percentages. ``mapping``: names of flagged rows, those with
    several of the first column of ``structure``, the most, and structures with several names.
    ``length``: means of the first tier and of all other rows, their difference, its bootstrap
    interval, and the effect adjusted by ``covariates``. Null lengths, NaN among them, and (where
    adjusted) null covariates are left out; nulls are values of ``pair`` and ``structure``.
    """
    spark = rows.sparkSession
    keys = [f"p{i}" for i in range(len(pair))]
    flagged = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    per = checkpointed(rows.select(F.col(tier).cast("string").alias("item"), flagged.alias("flagged"), *[F.col(c).alias(k) for c, k in zip(pair, keys)]).groupBy("item", "flagged", *keys).agg(F.count("*").alias("n")))
    size = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_unique")]
    named = per.where(F.col("item").isin(*tiers)).groupBy("item").agg(*size)
    named = spark.createDataFrame([(t,) for t in tiers], "item string").join(named, "item", "left").na.fill(0)
    whole = per.agg(*size)
    found = named.unionByName(per.where("flagged").agg(*size).withColumn("item", F.lit("any"))).unionByName(whole.withColumn("item", F.lit("all")))
    found = found.crossJoin(whole.select(F.col("n_rows").alias("t_rows"), F.col("n_unique").alias("t_unique")))  # one row
    share = lambda a, b: 100 * S.ratio(F.col(a), F.col(b))
    counts = {"n_rows": F.col("n_rows"), "n_unique": F.col("n_unique"), "percent_of_rows": share("n_rows", "t_rows"), "percent_of_unique": share("n_unique", "t_unique")}

    matched = rows.where(flagged).select(F.col(name).alias("name"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(structure)])
    of_name = matched.where("name IS NOT NULL").groupBy("name").agg(F.count_distinct("s0").alias("n"))
    of_structure = matched.groupBy(*[f"s{i}" for i in range(len(structure))]).agg(F.count_distinct("name").alias("n"))
    several = F.count(F.when(F.col("n") > 1, 1))
    names = {"names": F.count("*"), "names_of_several": several, "most": F.coalesce(F.max("n"), F.lit(0))}

    best = F.coalesce(F.col(tier).cast("string") == tiers[0], F.lit(False)).cast("int")
    number = F.nanvl(F.col(length).cast("double"), F.lit(None).cast("double"))
    measured = rows.select(best.alias("best"), number.alias("y"), *[c.cast("string").alias(f"_{k}") for k, c in covariates.items()])
    histogram = checkpointed(measured.where("y IS NOT NULL").groupBy("best", "y").agg(F.count("*").alias("n")))
    mean = lambda x: F.try_divide(F.sum(F.when(F.col("best") == x, F.col("n") * F.col("y"))), F.sum(F.when(F.col("best") == x, F.col("n"))))
    means = {"mean": mean(1), "mean_of_others": mean(0), "difference": mean(1) - mean(0)}
    drawn = S.mean_difference(histogram, "best", "y", "n", 1, 0, replicates, seed)
    fit = S.ols_effect(measured, "y", "best", [f"_{k}" for k in covariates])
    adjusted = spark.createDataFrame([(fit["coefficient"], fit["low"], fit["high"], float(fit["rows"]))], "adjusted double, adjusted_low double, adjusted_high double, adjusted_rows double")

    parts = [
        _long(found.select("item", *[c.cast("double").alias(k) for k, c in counts.items()]), "counts"),
        _long(of_name.agg(*[c.alias(k) for k, c in names.items()]).withColumn("item", F.lit("names")), "mapping"),
        _long(of_structure.agg(several.alias("structures_of_several")).withColumn("item", F.lit("structures")), "mapping"),
        *[_long(d.withColumn("item", F.lit(tiers[0])), "length") for d in (histogram.agg(*[c.alias(k) for k, c in means.items()]), drawn, adjusted)],
    ]
    return reduce(DataFrame.unionByName, parts)


def _long(df: DataFrame, section: str) -> DataFrame:
    """(section, item, metric, value) of a row for each item."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "item"])
    return df.select(F.lit(section).alias("section"), "item", F.explode(cells).alias("m")).select("section", "item", "m.*")


def component_splits(df: DataFrame, key: str, relations: list[str], audited: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with component and split, and leakage of the audited relations."""
    rows = graph.components(df, key, relations)
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    assigned = graph.greedy_partition(sizes).select("component", "split")
    rows = rows.join(assigned, "component")
    return rows, graph.leakage(rows, "split", audited)


def external_split(master: DataFrame, manifest: DataFrame, keys: list[str], split: str, relations: list[str], *order: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with the first master row of equal keys (nulls equal), and leakage."""
    rows = joins.null_safe_join(manifest, master, keys, *order)
    C.require_rows(rows.where("fan_out IS NOT NULL"), "the manifest's keys")
    return rows, graph.leakage(rows, split, relations)


def review_sheet(rows: DataFrame, key: str, cls: str, n_random: int, n_rare: int, n_audit: int, default: str, top: int = 2, seed: int = 42) -> DataFrame:
    """Three disjoint strata to label by hand: random, rare classes, and the default class.

    Rare classes are those outside the ``top`` most frequent.
    """
    frequent = M.top(M.counts(rows, cls), top, cls).select(cls)
    rare = rows.join(frequent, cls, "left_anti")
    sheet = sampling.disjoint_strata(rows, key, [("random", rows, n_random, seed), ("rare", rare, n_rare, seed + 1), ("audit", rows.where(F.col(cls) == default), n_audit, seed + 2)])
    return sampling.shuffled(sheet.withColumnRenamed(cls, "assigned_class").withColumn("correct_class", F.lit("")).withColumn("notes", F.lit("")), key, seed)


def score_sheet(sheet: DataFrame, default: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accuracy of the random stratum, scores by class, and the leakage of the default class."""
    blank = F.trim(F.coalesce("correct_class", F.lit(""))) == ""
    rows = sheet.withColumn("truth", F.when(blank, F.col("assigned_class")).otherwise(F.trim("correct_class")))
    hit = (F.col("truth") == F.col("assigned_class")).cast("int")
    rate = lambda d, c: d.agg(F.count("*").alias("n"), F.sum(c).alias("hits")).select("n", "hits", S.wilson(F.col("hits"), F.col("n")).alias("w")).select("n", "hits", "w.*")
    accuracy = rate(rows.where("stratum = 'random'"), hit)
    leaked = rate(rows.where("stratum = 'audit'"), (F.col("truth") != default).cast("int"))
    return accuracy, S.class_scores(rows.where("stratum IN ('random', 'rare')"), "truth", "assigned_class"), leaked


def chain_scope(calls: DataFrame) -> DataFrame:
    """(species, n, light): rows without a light species whose heavy chain is typed K or L."""
    wrong = F.col("chain_type").isin("K", "L")
    return calls.where("light_species IS NULL").groupBy("heavy_species").agg(F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("light"))


def germline_reference(nt: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Translated genes that pass, and those flagged with the reason."""
    best = T.best_frame(F.col("seq"), T.J_MOTIF if kind == "J" else None)
    rows = nt.withColumn("b", best).select("gene_id", "b.*")
    least = 10 if kind == "J" else 50
    unknown = F.length("aa") - F.length(F.replace("aa", F.lit("X"), F.lit("")))
    why = F.when(F.col("ambiguous"), "ambiguous frame").when(F.length("aa") < least, "too short").when(unknown > 0.1 * F.length("aa"), "unknown residues")
    rows = rows.withColumn("reason", why)
    return rows.where("reason IS NULL").select("gene_id", F.col("aa").alias("seq")), rows.where("reason IS NOT NULL")


def reference_check(ref: DataFrame, low: int, high: int) -> DataFrame:
    """One row: genes, and OK, EMPTY, OUT_OF_RANGE or BAD_ALPHABET."""
    bad = F.count(F.when(~F.col("seq").rlike(f"^[{ALPHABET}X]*$"), 1))
    n = F.count("*")
    return ref.agg(n.alias("n"), F.when(n == 0, "EMPTY").when(bad > 0, "BAD_ALPHABET").when(~n.between(low, high), "OUT_OF_RANGE").otherwise("OK").alias("state"))


def header_species(headers: DataFrame, field: str = "Species") -> DataFrame:
    """(species, n) of files' headers, the unreadable apart."""
    return headers.groupBy(F.when(F.col("state") == "unreadable", "UNREADABLE").otherwise(F.col(field)).alias("species")).agg(F.count("*").alias("n"))


def checklist(sections: dict[str, dict | None], rules: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(title, text) of recommendations; where a section or number is absent it says so.

    ``rules``: title, section, template with fields of the section's dictionary.
    """
    out = []
    for title, section, template in rules:
        try:
            out.append((title, template.format(**(sections.get(section) or {}))))
        except (KeyError, IndexError):
            out.append((title, f"INSUFFICIENT DATA: {section}"))
    return out


def contact_audit(atoms: DataFrame, targets: DataFrame, clusters: DataFrame, cut: float = 4.5, replicates: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Compositions at all cuts, and the cluster bootstrap of contacting residues at one."""
    distances = geometry.contact_distances(atoms, targets)
    near = distances.where(F.col("min_dist") <= cut).join(clusters, "pdb_id")
    profile = near.groupBy("cluster_rep").agg(*[F.count(F.when(F.col("aa") == a, 1)).alias(a) for a in ALPHABET])
    return geometry.composition_by_threshold(distances), S.cluster_bootstrap(profile, "cluster_rep", list(ALPHABET), replicates)


def antigen_clusters(samples: DataFrame, sequences: DataFrame, identity: float = 0.7, coverage: float = 0.8) -> DataFrame:
    """Every sample with ``antigen_cluster_id``: ``cluster_rep_`` and the representative's hash, or null."""
    rows = dedup.near_clusters(sequences.select("filename_stem", "seq", "hash"), "seq", identity, coverage)
    joins.require_none(rows.where("cluster_rep IS NULL").select("filename_stem"), "sequences without a cluster")
    joins.require_none(dedup.split_clusters(rows, "seq", "cluster_rep"), "equal sequences in several clusters")
    named = rows.select("filename_stem", F.concat(F.lit("cluster_rep_"), T.sha8(F.col("cluster_rep"))).alias("antigen_cluster_id"))
    return samples.drop("antigen_cluster_id").join(named, "filename_stem", "left")


def chart_residuals(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Residuals of two histograms, and the key of the largest."""
    rows = M.residuals(M.align(a, b, key), key)
    return rows, rows.agg(F.max_by(key, F.abs("residual")).alias(key), F.max(F.abs("residual")).alias("largest"))
