"""Keyword classes of antigens, in order; the first class with a hit wins."""

from __future__ import annotations

from ledgerlens.functions.text import Keyword, Rules

#: classes and their keywords (fixed values, in order)
KEYWORDS = {
    "viral": (
        "virus", "viral", "spike", "glycoprotein f0", "hemagglutinin", "influenza", "hiv", "sars", "coronavirus", "ebola", "dengue", "morbillivirus", "rsv", "respiratory syncytial",
        "capsid protein", "gp120", "gp160", "gp41", "gp140", "glycoprotein b", "glycoprotein h", "glycoprotein g", "genome polyprotein", "envelope glycoprotein", "envelope protein", "envelope polyprotein",
        "virion", "hcv", "mers", "matrix protein 2", "nucleoprotein", "fusion glycoprotein", "premembrane", "vp1", "vp2", "vp3", "sosip", "togavirin",
    ),
    "bacterial": ("bacteri", "toxin", "lipopolysaccharide", "lps", "anthrax", "staphylococcus", "streptococcus", "clostridium"),
    "cancer_associated": (
        "tumor", "tumour", "carcinoma", "oncogen", "cd20", "cd19", "her2", "egfr", "psma", "muc16", "ca125", "pd-1", "pd1", "pdl1", "pd-l1", "ctla", "cd38", "bcma", "erbb-2", "erbb2",
        "epidermal growth factor receptor", "glutamate carboxypeptidase 2", "programmed cell death protein 1", "cytotoxic t-lymphocyte protein 4", "adp-ribosyl cyclase",
    ),
    "immune_receptor": (
        "cd3", "cd28", "cd40", "tcr", "t-cell receptor", "fc receptor", "fc gamma", "complement", "tnfrsf", "interleukin", "il-", "il2", "il6", "il13", "cytokine",
        "toll-like receptor", "hla-", "mhc class", "histocompatibility antigen", "tnf", "tumor necrosis factor", "tumour necrosis factor",
        "tumor necrosis factor receptor superfamily", "tumour necrosis factor receptor superfamily", "anaphylatoxin receptor", "anaphylatoxin chemotactic receptor",
    ),
    "enzyme": (
        "kinase", "protease", "polymerase", "synthase", "phosphatase", "nuclease", "amylase", "aldolase", "helicase", "isomerase", "oxidase", "dismutase", "decarboxylase", "peptidase", "rnase",
    ),
    "nucleic_acid_or_carbohydrate": ("dna", "rna", "polysaccharide", "glycan"),
    "unknown_or_other": ("unknown",),
}
#: texts that rule a keyword out (fixed values)
EXCLUSIONS = {
    "toxin": ("anaphylatoxin", "lymphotoxin", "bungarotoxin", "cobratoxin", "theraphotoxin", "conotoxin", "mammal toxin", "toxin extrusion"),
    "tumor": ("tumor necrosis factor",),
    "tumour": ("tumour necrosis factor",),
}
#: keywords that count inside words (fixed values)
INSIDE = ("toxin",)
DEFAULT = "other_protein"

RULES = Rules(tuple((name, tuple(Keyword(k, k in INSIDE, EXCLUSIONS.get(k, ())) for k in words)) for name, words in KEYWORDS.items()), DEFAULT)
