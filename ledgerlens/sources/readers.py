"""Readers: delimited text, therapeutics, samples, repertoires, structures, FASTA, headers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.sources import contracts as C

CANDIDATES = ("\t", ",", ";")


def detect_delimiter(spark: SparkSession, path: str, candidates: tuple[str, ...] = CANDIDATES) -> str:
    """The candidate that separates the header line into most fields, outside quotes."""
    line = (spark.read.text(path).first() or [""])[0].lstrip("﻿")
    bare, quoted = [], False
    for ch in line:
        quoted ^= ch == '"'
        bare.append("" if quoted else ch)
    counts = {c: "".join(bare).count(c) for c in candidates}
    best = max(candidates, key=lambda c: counts[c])
    if not counts[best]:
        raise C.ContractError(f"no delimiter of {candidates} in the header of {path}: {line[:200]!r}")
    return best


def load_config(path: str) -> dict:
    """A YAML configuration, on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_delimited(spark: SparkSession, path: str, required: tuple[str, ...] | list[str], what: str, sep: str | None = None) -> DataFrame:
    """All columns as text, trimmed, with null tokens as null."""
    C.require_path(spark, path, what)
    df = spark.read.csv(path, sep=sep or detect_delimiter(spark, path), header=True, inferSchema=False, quote='"', escape='"', enforceSchema=False)
    return T.normalize_nulls(C.require_columns(df, required, what))


def read_summary(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The summary table, typed; rows without an id or a heavy chain are left out."""
    df = read_delimited(spark, path, C.SUMMARY.fieldNames(), "summary table")
    return summary_rows(df if limit is None else df.limit(limit))


def summary_rows(df: DataFrame) -> DataFrame:
    """Typed rows of a raw summary frame."""
    get = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    rows = df.select(
        F.lower(F.trim("pdb")).alias("pdb_id"), F.trim("Hchain").alias("h_chain"), F.coalesce(F.trim("Lchain"), F.lit("NA")).alias("l_chain"), F.coalesce(F.trim("model"), F.lit("0")).alias("model"),
        F.coalesce("antigen_chain", F.lit("NA")).alias("antigen_chain"), F.col("antigen_type"), F.lower("antigen_name").alias("antigen_name"), F.col("date"), T.year_of(F.col("date")).alias("year"), F.col("organism"),
        F.lower("heavy_species").alias("heavy_species"), F.lower("light_species").alias("light_species"), F.lower("antigen_species").alias("antigen_species"),
        T.number(F.col("resolution")).alias("resolution"), F.col("method"), F.col("heavy_subclass"), F.col("light_subclass"), F.col("light_ctype"),
        T.truthy(get("scfv")).alias("scfv"), T.truthy(get("engineered")).alias("engineered"),
    )
    rows = rows.where((F.coalesce("pdb_id", F.lit("")) != "") & (F.coalesce("h_chain", F.lit("")) != ""))
    return rows.withColumn("filename_stem", T.file_stem(F.col("pdb_id"), F.col("antigen_chain"), F.col("model")))


#: tier columns and their rank, best first (fixed values)
TIERS = (("100", "100% SI Structure"), ("99", "99% SI Structure"), ("95-98", "95-98% SI Structure"))


def therapeutic_rows(df: DataFrame) -> DataFrame:
    """One row for each therapeutic, tier and structure: wide cells to long rows."""
    optional = F.col("Companies") if "Companies" in df.columns else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(i).alias("tier_rank"), T.structure_cell(F.col(f"`{c}`")).alias("cells")) for i, (t, c) in enumerate(TIERS)])
    flat = df.select(F.col("Therapeutic").alias("therapeutic"), F.col("Format").alias("format"), F.col("Target").alias("target"), optional.alias("companies"), F.explode(cells).alias("t"))
    return flat.select("therapeutic", "format", "target", "companies", "t.tier", "t.tier_rank", F.explode("t.cells").alias("c")).select("therapeutic", "format", "target", "companies", "tier", "tier_rank", F.col("c.pdb").alias("pdb_id"), F.col("c.h").alias("h_chain"), F.coalesce("c.l", F.lit("NA")).alias("l_chain"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Serialized samples as one table, in the order of their names, with ``schema_error``."""
    return C.require_fields(spark.read.schema(C.SAMPLE).parquet(path)).withColumn("stem", T.stem_parts(F.col("filename_stem")))


def load_counts(samples: DataFrame) -> DataFrame:
    """One row: samples read and those with schema errors."""
    return samples.agg(F.count("*").alias("scanned"), F.count("schema_error").alias("schema_errors"))


def antigen_sequences(samples: DataFrame) -> DataFrame:
    """filename_stem, sequence and hash of samples with an antigen, pruned to these columns."""
    rows = samples.where(F.col("has_antigen") & F.col("antigen_seq").isNotNull() & (F.col("antigen_seq") != ""))
    clean = T.clean_residues(F.col("antigen_seq"))
    return rows.select("filename_stem", F.col("antigen_seq").alias("raw"), clean.alias("seq"), T.sha8(F.col("antigen_seq")).alias("hash"))


def find_splits(spark: SparkSession, root: str, names: tuple[str, ...] = ("train", "val")) -> list[str]:
    """The root if it holds data itself, else its splits that do; the first alone is allowed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    if there(f"{root}/meta.json"):
        return [root]
    found = [f"{root}/{n}" for n in names if there(f"{root}/{n}/meta.json")]
    if not found or not found[0].endswith(names[0]):
        raise FileNotFoundError(f"no meta.json in {root} or its {names[0]}")
    return found


def read_json_object(spark: SparkSession, path: str) -> dict | None:
    """A JSON file as a dictionary, or None where it is absent."""
    try:
        C.require_path(spark, path, "json")
    except FileNotFoundError:
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def probe(value: dict | None, *paths: str):
    """The first of several dotted paths that is there."""
    for path in paths:
        at = value
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def probe_files(spark: SparkSession, pattern: str, *paths: str) -> tuple[str, str, object] | None:
    """(file, path, value) of the first JSON file, by name, that has one of several dotted paths.

    Files of a glob are parsed by tasks, whole; those that are no JSON are passed over, and a
    JSON null is absent. Only the value found comes to the driver.
    """
    try:
        texts = spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    parsed = texts.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))

    def at(path: str) -> Column:
        steps = "$" + "".join(f"['{step}']" for step in path.split("."))
        value = F.try_variant_get("v", steps, "variant")
        return F.when(value.isNotNull() & ~F.is_variant_null(value), F.struct(F.lit(path).alias("path"), F.to_json(value).alias("value")))

    hits = parsed.select("file", F.coalesce(*[at(p) for p in paths]).alias("hit")).where("hit IS NOT NULL")
    first = hits.orderBy("file").limit(1).select("file", "hit.*").first()
    return first and (first["file"], first["path"], json.loads(first["value"]))


def read_repertoire(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    """All splits of a repertoire as one frame, and their common metadata."""
    dirs = find_splits(spark, root)
    meta = C.same_schema([C.check_meta(read_json_object(spark, f"{d}/meta.json") or {}, d) for d in dirs])
    parts = [spark.read.parquet(f"{d}/data").withColumn("split", F.lit(d.rsplit("/", 1)[-1])) for d in dirs]
    return reduce(DataFrame.unionByName, parts), meta


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed-column structure files; models are counted from their MODEL lines.

    A file's lines are kept in order by reading it whole, so one row is one file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("pdb_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return atoms_of(lines)


def atoms_of(lines: DataFrame) -> DataFrame:
    """Atom rows of (pdb_id, line, value)."""
    from pyspark.sql import Window

    kind = F.trim(F.substring("value", 1, 6))
    rows = lines.where(kind.isin("ATOM", "HETATM", "MODEL")).withColumn("kind", kind)
    w = Window.partitionBy("pdb_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("model", F.greatest(F.count(F.when(F.col("kind") == "MODEL", 1)).over(w) - 1, F.lit(0)).cast("int")).where("kind <> 'MODEL'")
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return rows.select(
        "pdb_id", "model", F.substring("value", 22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resseq"), cut(27, 1).alias("icode"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"),
        cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"), (F.col("kind") == "HETATM").alias("hetero"),
    )


def atom_counts(lines: DataFrame) -> DataFrame:
    """(pdb_id, atoms): lines of atoms, to tell an overflow of serial numbers."""
    return lines.where(F.col("value").rlike("^(ATOM|HETATM)")).groupBy("pdb_id").agg(F.count("*").alias("atoms"))


def grep_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """(pdb_id, lines): matching lines in order; of one file each."""
    hits = lines.where(F.col("value").rlike(pattern))
    return hits.groupBy("pdb_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("lines"))


def variable_domain(atoms: DataFrame, last: int = 128) -> DataFrame:
    """(pdb_id, model, chain, residues): standard residues up to a number, in order.

    residues: array<struct<resseq, icode, letter, position>>; insertions in plain letter order.
    """
    ca = atoms.where((F.col("atom") == "CA") & ~F.col("hetero") & F.upper("resname").isin(*T.AMINO_ACIDS) & (F.col("resseq") <= last))
    one = F.struct("resseq", F.coalesce("icode", F.lit("")).alias("icode"), T.residue_letter(F.col("resname")).alias("letter"), T.position(F.col("resseq"), F.coalesce("icode", F.lit(""))).alias("position"), F.array("x", "y", "z").alias("ca"))
    rows = ca.groupBy("pdb_id", "model", "chain").agg(F.array_sort(F.collect_set(one)).alias("residues"))
    return rows.withColumn("residues", F.filter("residues", lambda r: r["position"] <= last + 0.99))


#: residue names of solvent, ions and buffers (fixed values)
SOLVENT = (
    "HOH", "WAT", "DOD",
    "NA", "CL", "MG", "ZN", "K", "MN", "FE", "CU", "CO", "NI", "CD", "HG", "BA", "CS", "LI", "SR", "CA",
    "SO4", "PO4", "GOL", "EDO", "PEG", "PG4", "ACT", "TRS", "MPD", "BME", "DTT", "IMD", "FMT", "EPE", "NH4", "ACY", "UNK", "UNL",
    "1PE", "MES", "BOG", "CIT", "TAR", "OXL",
)


def antigen_atoms(atoms: DataFrame, wanted: DataFrame, antibody: DataFrame) -> DataFrame:
    """Atoms of wanted chains that are no antibody chain, without solvent; chain case counts."""
    chains = wanted.select("pdb_id", "chain").distinct().join(antibody.select("pdb_id", "chain").distinct(), ["pdb_id", "chain"], "left_anti")
    return atoms.where(~F.upper("resname").isin(*SOLVENT)).join(chains, ["pdb_id", "chain"], "left_semi")


def fasta_rows(df: DataFrame) -> DataFrame:
    """(gene_id, seq) of records as read with ``lineSep='>'``; raises on none."""
    rows = df.where(F.trim("value") != "").select(F.split("value", r"\r?\n").alias("p"))
    return rows.select(F.trim(F.split(F.col("p")[0], r"\s")[0]).alias("gene_id"), F.array_join(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: F.trim(x)), "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    C.require_path(spark, path, "FASTA")
    return C.require_rows(fasta_rows(spark.read.text(path, lineSep=">")), f"FASTA records of {path}")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(member, rep) of a headerless two-column file."""
    df = spark.read.csv(path, sep="\t", schema="rep string, member string")
    return df.select("member", "rep").dropDuplicates(["member"])


def header_fields(lines: DataFrame, *fields: str) -> DataFrame:
    """Fields of header lines that are JSON or a Python literal with single quotes; else MISSING.

    ``state`` is json, literal or unreadable.
    """
    raw = F.trim(F.regexp_replace("value", r'^"|"$', ""))
    as_json = F.try_parse_json(F.replace(raw, F.lit('""'), F.lit('"')))
    as_literal = F.try_parse_json(F.replace(F.replace(F.replace(F.replace(raw, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null")), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false")))
    rows = lines.withColumn("_v", F.coalesce(as_json, as_literal)).withColumn("state", F.when(as_json.isNotNull(), "json").when(as_literal.isNotNull(), "literal").otherwise("unreadable"))
    return rows.select("*", *[F.coalesce(F.try_variant_get("_v", f"$.{f}", "string"), F.lit("MISSING")).alias(f) for f in fields]).drop("_v")


def read_headers(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """The first line of each file (gzip too) as metadata fields."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_n"), "value")
    first = rows.groupBy("file").agg(F.min_by("value", "_n").alias("value"))
    return header_fields(first, *fields)


def manifest_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """(split, id) of a JSON object of lists."""
    return df.select(F.explode(F.from_json(col, "map<string,array<string>>")).alias("split", "ids")).select("split", F.explode("ids").alias("id"))
