"""Best local alignment of queries against a reference set.

Smith-Waterman-Gotoh with affine gaps. Identity is matches over aligned pairs; a reference
counts only where the alignment covers enough of it; the best identity wins, ties by id.
References that share most 3-mers with a query are aligned first; a reference is left out
only where a bound proves that it cannot win, so the best match is never lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import agreement
from ledgerlens.sources.stage import checkpointed

#: rows and columns of the substitution matrix BLOSUM62 (fixed values)
LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
MATRIX = np.array(BLOSUM62.split(), np.float64).reshape(24, 24)
_INDEX = np.full(256, 22)
_INDEX[[ord(c) for c in LETTERS]] = range(24)
#: letters of references, and texts, that meet in a task
BLOCK_LETTERS, PART = 2_000_000, 512
#: most species of references
KINDS = 100


def encode(text: str) -> np.ndarray:
    return _INDEX[np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8)]


def local_alignment(query: str, reference: str, opened: float = 10.0, extended: float = 0.5) -> tuple[float, int, int]:
    """(score, matches, aligned pairs) of the best local alignment."""
    q, r = encode(query), encode(reference)
    n, m = len(q), len(r)
    if not n or not m:
        return 0.0, 0, 0
    low = -1e18
    h, e, f = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    sub = MATRIX[np.ix_(q, r)]
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        f[i] = np.maximum(h[i - 1] - opened, f[i - 1] - extended)
        best = np.maximum(f[i], 0)
        best[1:] = np.maximum(best[1:], h[i - 1, :-1] + sub[i - 1])
        best[0] = 0
        # gaps along the row: the best opening to the left, less its extensions
        run = np.maximum.accumulate(best - opened + extended * (step + 1))
        e[i, 1:] = run[:-1] - extended * step[1:]
        h[i] = np.maximum(best, e[i])
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    score, matches, pairs, state = float(h[i, j]), 0, 0, "h"
    while i > 0 and j > 0:
        if state == "h":
            if h[i, j] <= 0:
                break
            if np.isclose(h[i, j], h[i - 1, j - 1] + sub[i - 1, j - 1]):
                pairs += 1
                matches += query[i - 1].upper() == reference[j - 1].upper()
                i, j = i - 1, j - 1
            else:
                state = "e" if np.isclose(h[i, j], e[i, j]) else "f"
        elif state == "e":
            state = "h" if np.isclose(e[i, j], h[i, j - 1] - opened) else "e"
            j -= 1
        else:
            state = "h" if np.isclose(f[i, j], h[i - 1, j] - opened) else "f"
            i -= 1
    return score, matches, pairs


class References:
    """Some references in the order of their ids, with bounds of what a query may reach.

    The aligned pairs that match are a common subsequence, and of a reference that counts at
    least ``least`` letters are aligned; so the identity is at most the longest common
    subsequence over ``least``, and that is no longer than the letters held in common.
    """

    K = 3

    def __init__(self, genes: list[str], texts: list[str], coverage: float) -> None:
        order = sorted(range(len(genes)), key=lambda i: genes[i])
        self.genes, self.texts = [genes[i] for i in order], [texts[i] for i in order]
        self.coverage, self.tried = coverage, 0
        upper = [[c.upper() for c in t] for t in self.texts]
        self.least = np.array([next(p for p in range(max(1, int(coverage * len(t)) - 1), len(t) + 2) if p / len(t) >= coverage or p > len(t)) for t in upper], float)
        self.alphabet = {c: i for i, c in enumerate(sorted({c for t in upper for c in t}))}
        self.counts = np.zeros((len(upper), len(self.alphabet) + 1), np.int32)
        self.masks: list[dict[str, int]] = []
        self.index: dict[str, list[int]] = {}
        for i, t in enumerate(upper):
            masks: dict[str, int] = {}
            for j, c in enumerate(t):
                self.counts[i, self.alphabet[c]] += 1
                masks[c] = masks.get(c, 0) | 1 << j
            self.masks.append(masks)
            for g in {"".join(t[j : j + self.K]) for j in range(len(t) - self.K + 1)}:
                self.index.setdefault(g, []).append(i)

    def common(self, letters: list[str], i: int) -> int:
        """The length of the longest common subsequence, by bits of the reference's places."""
        full = (1 << len(self.texts[i])) - 1
        v, masks = full, self.masks[i]
        for c in letters:
            if m := masks.get(c):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.texts[i]) - v.bit_count()

    def best(self, query: str) -> tuple[str | None, float, int, float]:
        """(gene, identity, aligned pairs, coverage) of the best reference that counts, ties by id."""
        letters = [c.upper() for c in query]
        own = np.zeros(len(self.alphabet) + 1, np.int32)
        for c in letters:
            if c in self.alphabet:
                own[self.alphabet[c]] += 1
        bound = np.minimum(1.0, np.minimum(self.counts, own).sum(1) / self.least)
        seeds = np.zeros(len(self.genes), np.int32)
        for g in {"".join(letters[j : j + self.K]) for j in range(len(letters) - self.K + 1)}:
            seeds[self.index.get(g, [])] += 1
        # those with most seeds first, so that most others are out of reach
        top, at = (None, 0.0, 0, 0.0), len(self.genes)
        for i in np.lexsort((-bound, -seeds)).tolist():
            reach = bound[i]
            if reach <= 0 or (-reach, i) >= (-top[1], at):
                continue
            reach = min(1.0, self.common(letters, i) / self.least[i])
            if reach <= 0 or (-reach, i) >= (-top[1], at):
                continue
            self.tried += 1
            _, matches, pairs = local_alignment(query, self.texts[i])
            covered = pairs / len(self.texts[i])
            if matches and covered >= self.coverage and (-matches / pairs, i) < (-top[1], at):
                top, at = (self.genes[i], matches / pairs, pairs, covered), i
        return top


def best_matches(queries: DataFrame, references: DataFrame, key: str = "id", text: str = "seq", gene: str = "gene_id", ref_text: str = "seq", coverage: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """key, by, gene_id, identity, aligned, coverage; null gene and zeros where none is covered.

    With ``by``, columns of both sides, a query meets the references of its own group; a key
    has a row for each of its groups. Different texts are aligned once. References are dealt
    in blocks of about ``BLOCK_LETTERS`` and texts in parts of ``PART``: each part meets each
    block in a task, and neither side comes to the driver. Within a block an inverted index
    of 3-mers says which reference is tried first, and bounds say which need not be.
    """
    own = [f"_by{i}" for i in range(len(by))]
    group = lambda d: [F.col(b).cast("string").alias(o) for b, o in zip(by, own)]
    asked = queries.select(key, *group(queries), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    refs = references.where(F.length(ref_text) > 0).select(*group(references), F.col(gene).cast("string").alias("_g"), F.col(ref_text).alias("_r"))
    texts = asked.select(*own, "_t").distinct()
    letters, many = refs.agg(F.sum(F.length("_r"))).first()[0] or 0, texts.count()
    blocks, parts = 1 + letters // BLOCK_LETTERS, 1 + many // PART
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = texts.withColumn("_part", F.pmod(F.xxhash64("_t"), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    held = refs.withColumn("_block", F.pmod(F.xxhash64("_g"), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))

    def run(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        block = References(have["_g"].tolist(), have["_r"].tolist(), coverage)
        found = [block.best(t) for t in ask["_t"]]
        out = ask[[*own, "_t"]].copy()
        for i, name in enumerate(("gene_id", "identity", "aligned", "coverage")):
            out[name] = pd.Series([f[i] for f in found], index=out.index, dtype=object)
        return out

    where = [*own, "_block", "_part"]
    schema = ", ".join([*[f"{o} string" for o in own], "_t string, gene_id string, identity double, aligned long, coverage double"])
    best = asks.groupBy(*where).cogroup(held.groupBy(*where)).applyInPandas(run, schema)
    order = F.struct(F.col("gene_id").isNull().alias("none"), (-F.col("identity")).alias("i"), F.col("gene_id").alias("g"))
    kept = lambda d, *keys: d.groupBy(*keys).agg(F.min_by(F.struct("gene_id", "identity", "aligned", "coverage"), order).alias("b")).select(*keys, "b.*")
    found = kept(best, *own, "_t").select(*[F.col(o).alias(f"_{o}") for o in own], F.col("_t").alias("__t"), "gene_id", "identity", "aligned", "coverage")
    same = reduce(Column.__and__, [F.col(o).eqNullSafe(F.col(f"_{o}")) for o in own], F.col("_t") == F.col("__t"))
    out = kept(asked.join(found, same), key, *own)
    return out.select(key, *[F.col(o).alias(b) for o, b in zip(own, by)], "gene_id", "identity", "aligned", "coverage")


def assign_chains(chains: DataFrame, references: DataFrame, family_of, key: str = "filename_stem", least: int = 20, coverage: float = 0.8, family_species: tuple[str, ...] = ("homo sapiens",)) -> tuple[DataFrame, DataFrame]:
    """(calls, counts): germline genes of heavy and light chains, and what was left out.

    ``chains``: key, heavy_species, light_species, heavy, light (sequences). ``references``:
    species, locus (IGH, IGK, IGL), segment (V, J), gene_id, seq. A chain of a species that has
    references and of ``least`` letters is matched with the V genes of its loci; a light chain
    takes the locus of the higher identity, kappa on ties, and where neither matches, none, with a
    note. J genes are those of the locus taken. Calls have a row a key with the structs
    ``heavy`` and ``light``, null where the chain was left out. Families are told for
    ``family_species`` only. Counts are one row.
    """
    species = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    known = [r[0] for r in references.select(species("species").alias("s")).distinct().limit(KINDS + 1).collect()]  # a few species
    if len(known) > KINDS:
        raise ValueError(f"the references have more than {KINDS} species")
    each = F.array(*[F.struct(F.lit(c).alias("chain"), species(f"{c}_species").alias("species"), F.coalesce(F.col(c), F.lit("")).alias("seq")) for c in ("heavy", "light")])
    long = checkpointed(chains.select(F.col(key).alias("key"), F.explode(each).alias("c")).select("key", "c.*").withColumn("known", F.col("species").isin(known)).withColumn("long", F.length("seq") >= least))
    counts = long.agg(
        F.count_distinct(F.when(F.col("known") & F.col("long"), F.col("key"))).alias("n_processed"), F.count(F.when(~F.col("known"), 1)).alias("n_skipped_species"),
        F.count(F.when(F.col("known") & ~F.col("long"), 1)).alias("n_skipped_no_sequence"),
    )
    loci = F.when(F.col("chain") == "heavy", F.array(F.lit("IGH"))).otherwise(F.array(F.lit("IGK"), F.lit("IGL")))
    asked = long.where("known AND long").select("key", "chain", "species", "seq", F.explode(loci).alias("locus"), F.explode(F.array(F.lit("V"), F.lit("J"))).alias("segment"))
    refs = references.select(species("species").alias("species"), "locus", "segment", "gene_id", "seq")
    # a chain's locus tells it, but for the heavy and light chain of a key
    named = asked.withColumn("id", F.struct("key", "chain"))
    found = best_matches(named, refs, "id", coverage=coverage, by=("species", "locus", "segment")).select("id.*", "species", "locus", "segment", "gene_id", "identity", "aligned", "coverage")
    per = found.groupBy("key", "chain", "species").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("locus", "segment"), F.struct("gene_id", "identity", "aligned", "coverage")))).alias("m"))  # six at most
    at = lambda name: F.col("m")[name]
    none = F.struct(F.lit(None).cast("string").alias("gene_id"), F.lit(0.0).alias("identity"), F.lit(None).cast("long").alias("aligned"), F.lit(None).cast("double").alias("coverage"))
    chosen = choose_locus(at("IGKV"), at("IGLV"))["locus"]
    heavy = F.col("chain") == "heavy"
    locus = F.when(heavy, "IGH").when(chosen == "kappa", "IGK").when(chosen == "lambda", "IGL")
    v = F.when(heavy, at("IGHV")).when(chosen == "kappa", at("IGKV")).when(chosen == "lambda", at("IGLV")).otherwise(none)
    j = F.when(heavy, at("IGHJ")).when(chosen == "kappa", at("IGKJ")).when(chosen == "lambda", at("IGLJ"))
    told = F.col("species").isin(*family_species)
    call = F.struct(
        "species", locus.alias("locus"), *[v[a].alias(f"v_{b}") for a, b in _NAMES], *[j[a].alias(f"j_{b}") for a, b in _NAMES],
        F.when(told, family_of(v["gene_id"])).alias("v_family"), at("IGKV")["identity"].alias("kappa_v_identity"), at("IGLV")["identity"].alias("lambda_v_identity"),
        F.when(~heavy & chosen.isNull(), F.lit("neither kappa nor lambda is covered")).alias("note"),
    )
    calls = per.select("key", "chain", call.alias("call")).groupBy("key").agg(*[F.first(F.when(F.col("chain") == c, F.col("call")), ignorenulls=True).alias(c) for c in ("heavy", "light")])
    whole = chains.select(F.col(key).alias("key"), "heavy_species", "light_species")
    return whole.join(calls, "key", "left").withColumnRenamed("key", key), counts


#: fields of a match, and their names in a call
_NAMES = (("gene_id", "gene"), ("identity", "identity"), ("aligned", "aligned"), ("coverage", "coverage"))


def choose_locus(kappa: Column, light: Column) -> Column:
    """The better of two match structs, kappa on ties; locus null where both failed."""
    k, m = kappa["gene_id"], light["gene_id"]
    first = k.isNotNull() & (m.isNull() | (kappa["identity"] >= light["identity"]))
    locus = F.when(first, "kappa").when(m.isNotNull(), "lambda")
    return F.struct(locus.alias("locus"), F.when(first, k).otherwise(m).alias("gene_id"), F.when(first, kappa["identity"]).otherwise(light["identity"]).alias("identity"))


def cross_method(ours: DataFrame, theirs: DataFrame, key: str, family_of, confident: str, species: str | None = None) -> DataFrame:
    """One row: agreement of gene families, alleles and, of a column of both, species, over all and confident calls."""
    both = ours.alias("o").join(theirs.alias("t"), key)
    same = F.col("o.gene_id") == F.col("t.gene_id")
    family = family_of(F.col("o.gene_id")) == family_of(F.col("t.gene_id"))
    sure = F.col(f"o.{confident}")
    alike = F.lower(F.trim(F.col(f"o.{species}"))) == F.lower(F.trim(F.col(f"t.{species}"))) if species else F.lit(None).cast("boolean")
    rows = both.select(alike.alias("alike"), F.coalesce(same, F.lit(False)).alias("same"), F.coalesce(family, F.lit(False)).alias("family"), F.coalesce(sure, F.lit(False)).alias("sure"))
    one = agreement(rows, F.col("same"), allele=F.lit(True), allele_confident=F.col("sure"), allele_other=~F.col("sure"))
    two = agreement(rows, F.col("family"), family=F.lit(True), family_confident=F.col("sure"))
    three = agreement(rows, F.coalesce("alike", F.lit(False)), species=F.lit(True), species_confident=F.col("sure"))
    return one.crossJoin(two).crossJoin(three) if species else one.crossJoin(two)  # one row each


def assignment_summary(calls: DataFrame, family_of, *by: str) -> DataFrame:
    """By locus or none: rows, rows without a match, spread of identity, and the two most frequent families."""
    rows = calls.withColumn("family", family_of(F.col("gene_id")))
    hit = F.when(F.col("gene_id").isNotNull(), F.col("identity"))
    spread = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("gene_id").isNull(), 1)).alias("no_match"), F.avg(hit).alias("mean_identity"), F.min(hit).alias("min_identity"), F.max(hit).alias("max_identity"))
    n = rows.where("family IS NOT NULL").groupBy(*by, "family").agg(F.count("*").alias("n"))
    # a list of families, of which there are some tens
    top = n.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "family"))), 1, 2).alias("t"))
    named = top.select(*by, F.transform("t", lambda x: F.struct(x["family"].alias("family"), (-x["m"]).alias("n"))).alias("top_families"))
    return spread.join(named, list(by), "left") if by else spread.join(named, how="left")
