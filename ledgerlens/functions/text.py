"""Scalar expressions: cleaning, identifiers, dates, sequences and keyword classes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: texts that stand for null (fixed values)
NULL_TOKENS = ("", "none", "n/a", "na", "nan", "null")
#: in a structure's chain fields, where "unknown" names no chain (fixed values)
FIELD_NULL_TOKENS = (*NULL_TOKENS, "unknown")

#: modified residues and the letter of their parent (fixed values)
PARENTS = {
    "MSE": "M", "FME": "M", "SEP": "S", "TPO": "T", "PTR": "Y", "CSO": "C", "CSD": "C", "CSX": "C", "CME": "C", "OCS": "C",
    "SEC": "C", "HYP": "P", "MLY": "K", "M3L": "K", "KCX": "K", "PCA": "Q",
}

#: residue names and letters of the twenty amino acids (fixed values)
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: residue names of nucleotides and their letters (fixed values)
NUCLEOTIDES = {"DA": "A", "DC": "C", "DG": "G", "DT": "T", "DU": "U", "A": "A", "C": "C", "G": "G", "U": "U", "I": "I"}
#: loops by position, first and last, both inside (fixed values)
LOOPS = {"1": (27, 38.9), "2": (56, 65.9), "3": (105, 117.9)}


def null_if_token(c: Column) -> Column:
    """Trimmed text, null where it is one of NULL_TOKENS."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TOKENS), F.trim(c))


def normalize_nulls(df: DataFrame, *names: str) -> DataFrame:
    """``null_if_token`` on the named string columns, or on all."""
    names = names or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, StringType))
    return df.withColumns({n: null_if_token(F.col(n)) for n in names})


def first_part(c: Column, sep: str = "|") -> Column:
    """The first part that is not a null token."""
    parts = F.filter(F.transform(F.split(c, re.escape(sep)), lambda p: F.trim(p)), lambda p: ~F.lower(p).isin(*FIELD_NULL_TOKENS))
    return F.when(F.size(parts) > 0, parts[0])


def parts_of(c: Column, sep: str) -> Column:
    """Distinct trimmed parts, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(c, re.escape(sep)), lambda p: F.trim(p)), lambda p: p != ""))


def number(c: Column) -> Column:
    """A double, or null where the text is none or not finite."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def truthy(c: Column) -> Column:
    """True for a true boolean or a text of one."""
    return F.coalesce(c.cast("string").try_cast("boolean"), F.lit(False))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("_"))


def file_stem(pdb: Column, antigen: Column, model: Column) -> Column:
    """``<pdb>_ag<antigen>_m<model>``; absent parts are NA and 0."""
    return F.concat(pdb, F.lit("_ag"), safe_name(F.coalesce(antigen, F.lit("NA"))), F.lit("_m"), F.coalesce(model.cast("string"), F.lit("0")))


def stem_parts(stem: Column) -> Column:
    """Struct (pdb, antigen, model): cut at the first ``_ag`` and the last ``_m``."""
    at = lambda i: F.nullif(F.regexp_extract(stem, r"^(.*?)_ag(.*)_m(.*)$", i), F.lit(""))
    return F.struct(at(1).alias("pdb"), at(2).alias("antigen"), at(3).alias("model"))


def sha8(c: Column) -> Column:
    """Eight hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 8)


def year_of(c: Column) -> Column:
    """The year of MM/DD/YY: up to 69 in this century, else in the last; null where malformed."""
    part = F.split(c, "/")
    yy = F.when(F.size(part) == 3, F.get(part, F.lit(2)).try_cast("int"))
    return F.when(yy.between(0, 69), yy + 2000).when(yy.between(70, 99), yy + 1900)


def bare_pdb_id(c: Column) -> Column:
    """Lowered; ``pdb_0000xxxx`` without its prefix."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^pdb_(0000)?", "")


def gene_family(c: Column) -> Column:
    """The leading family, such as IGHV3; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"^(IG[HKL][VJ]\d+)", 1), F.lit(""))


def length_stage(c: Column) -> Column:
    """Struct (direction, length) of stages such as ``h3_too_long_42``."""
    at = lambda i: F.nullif(F.regexp_extract(c, r"h3_too_(long|short)_(\d+)", i), F.lit(""))
    return F.struct(at(1).alias("direction"), at(2).try_cast("int").alias("length"))


def stage_family(c: Column) -> Column:
    """The stage without its number."""
    return F.regexp_replace(c, r"_\d+$", "")


def id_parts(c: Column, names: tuple[str, ...] = ("pdb", "h", "l", "ag"), sep: str = "_") -> Column:
    """Struct of an id's parts; null where there are not as many."""
    part = F.split(c, re.escape(sep))
    return F.when(F.size(part) == len(names), F.struct(*[part[i].alias(n) for i, n in enumerate(names)]))


def structure_cell(c: Column) -> Column:
    """``pdb:HL;pdb:HL`` as array<struct<pdb,h,l>>; malformed parts are dropped, null tokens empty.

    A single chain letter is the heavy chain alone.
    """
    cells = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.trim(p)), lambda x: ~F.lower(x).isin(*NULL_TOKENS) & x.rlike(r"^[^:]+:[^:]+$"))
    return F.transform(
        cells,
        lambda x: F.struct(
            F.lower(F.trim(F.split(x, ":")[0])).alias("pdb"),
            F.substring(F.trim(F.split(x, ":")[1]), 1, 1).alias("h"),
            F.nullif(F.substring(F.trim(F.split(x, ":")[1]), 2, 1), F.lit("")).alias("l"),
        ),
    )


def is_whole_number(c: Column) -> Column:
    return c.rlike(r"^-*[0-9]+$")


def clean_residues(c: Column) -> Column:
    """One letter for each residue: ``[MSE]`` to its parent, other tags and a stray ``[`` to X."""
    out = c
    for tag, letter in PARENTS.items():
        out = F.replace(out, F.lit(f"[{tag}]"), F.lit(letter))
    return F.replace(F.regexp_replace(out, r"\[[^\]]*\]", "X"), F.lit("["), F.lit("X"))


def tags(c: Column) -> Column:
    """The names in brackets, in order."""
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), 1)


def residue_letter(name: Column) -> Column:
    """Letter of a residue name, or the name in brackets."""
    known = F.create_map(*[F.lit(x) for kv in {**AMINO_ACIDS, **NUCLEOTIDES}.items() for x in kv])
    bare = F.upper(F.trim(name))
    return F.coalesce(F.try_element_at(known, bare), F.concat(F.lit("["), bare, F.lit("]")))


def position(resseq: Column, icode: Column) -> Column:
    """Residue number plus a tenth for each insertion letter."""
    letter = F.upper(F.trim(icode))
    return resseq + F.when(letter != "", (F.ascii(letter) - 64) * 0.1).otherwise(0.0)


def loop_mask(positions: Column) -> Column:
    """For each position, whether it is in a loop."""

    def inside(p: Column) -> Column:
        out = F.lit(False)
        for low, high in LOOPS.values():
            out = out | p.between(low, high)
        return out

    return F.transform(positions, inside)


def any_tag_in(c: Column, names: tuple[str, ...]) -> Column:
    """Whether the text has any of the names in brackets."""
    return F.exists(F.array(*[F.lit(f"[{n}]") for n in names]), lambda t: F.contains(c, t))


@dataclass(frozen=True)
class Keyword:
    """A keyword, whether it matches inside words, and texts that rule it out."""

    text: str
    inside: bool = False
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    """Categories in order, each with keywords; the first that hits wins."""

    categories: tuple[tuple[str, tuple[Keyword, ...]], ...]
    default: str
    #: how a keyword stands in a text where it must be a word of its own
    edge: str = r"\b{}\b"


def classify(text: Column, rules: Rules) -> Column:
    """The first category with a keyword in the lowered text, else the default."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, keywords in rules.categories:
        hit = F.lit(False)
        plain = [k for k in keywords if not k.unless]
        if whole := [re.escape(k.text) for k in plain if not k.inside]:
            hit = hit | lowered.rlike(rules.edge.format("(?:" + "|".join(whole) + ")"))
        if inside := [re.escape(k.text) for k in plain if k.inside]:
            hit = hit | lowered.rlike("|".join(inside))
        for k in (k for k in keywords if k.unless):
            found = F.contains(lowered, F.lit(k.text)) if k.inside else lowered.rlike(rules.edge.format(re.escape(k.text)))
            for other in k.unless:
                found = found & ~F.contains(lowered, F.lit(other))
            hit = hit | found
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(rules.default) if out is None else out.otherwise(rules.default)


def classify_bound(text: Column, bound: Column, rules: Rules) -> Column:
    """The class of rows that are bound, else null."""
    return F.when(truthy(bound), classify(text, rules))


#: genetic code: amino acids of codons in the order TCAG (fixed values)
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_frame(nt: Column, frame: int) -> Column:
    """Amino acids of a frame; codons with other letters are X."""
    bases = "TCAG"
    codons = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}
    known = F.create_map(*[F.lit(x) for kv in codons.items() for x in kv])
    bare = F.substring(F.regexp_replace(F.upper(nt), r"[-.]", ""), F.lit(frame + 1), F.length(nt))
    cut = F.filter(F.split(F.regexp_replace(F.replace(bare, F.lit("U"), F.lit("T")), r"(.{3})", "$1,"), ","), lambda x: F.length(x) == 3)
    return F.array_join(F.transform(cut, lambda x: F.coalesce(F.try_element_at(known, x), F.lit("X"))), "")


def best_frame(nt: Column, motif: str | None = None) -> Column:
    """Struct (aa, frame, stops, ambiguous).

    Without a motif: the frame of fewest inner stops, ambiguous on ties or where stops are
    left. With one: the only frame without stops that has it; else the fewest stops,
    ambiguous.
    """
    read = F.array(*[F.struct(F.lit(f).alias("frame"), translate_frame(nt, f).alias("aa")) for f in range(3)])

    def told(x: Column) -> Column:
        aa = x["aa"]
        inner = F.regexp_replace(aa, r"\*$", "") if motif is None else aa
        stops = F.when(aa == "", F.lit(999)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit("*"), F.lit(""))))
        return F.struct(stops.cast("int").alias("stops"), x["frame"].alias("frame"), F.regexp_replace(aa, r"\*+$", "").alias("aa"), (aa.rlike(motif) if motif else F.lit(True)).alias("fits"))

    def chosen(every: Column) -> Column:
        least = F.array_min(every)
        fit = F.filter(every, lambda x: x["fits"] & (x["stops"] == 0))
        best = F.when(F.size(fit) > 0, fit[0]).otherwise(least) if motif else least
        tied = F.size(F.filter(every, lambda x: x["stops"] == least["stops"]))
        unclear = F.size(fit) != 1 if motif else (tied > 1) | (least["stops"] > 0)
        return F.struct(best["aa"].alias("aa"), best["frame"].alias("frame"), best["stops"].alias("stops"), unclear.alias("ambiguous"))

    # lambdas over one-element arrays: their variables are values, so each frame is translated once
    return F.transform(F.array(F.transform(read, told)), chosen)[0]


J_MOTIF = "[FW]G.G"
