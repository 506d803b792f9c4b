"""Scalar operators as Column builders (P1-P4, P14-P18, P19-P32, Wilson, intervals I1-I4). All null-safe; none raises under ANSI."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata import config as C


def txt(c: Column) -> Column:
    """Lower-cased, trimmed; null is empty."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def reported(c: Column) -> Column:
    """Not one of the eight not-reported texts."""
    return ~txt(c).isin(C.NOT_REPORTED_TOKENS)


def present(c: Column) -> Column:
    """The narrower presence test of the reuse score."""
    return ~txt(c).isin(C.ABSENT_TOKENS)


def num(c: Column) -> Column:
    """A number, with or without trailing %; null for not-reported or any other text."""
    t = F.regexp_replace(txt(c), "%+$", "")
    ok = reported(c) & F.trim(t).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")
    return F.when(ok, F.trim(t).try_cast("double"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def class_of_accession(acc: Column, rules: list[tuple[str, str]] | None = None, contains_only: bool = False) -> Column:
    """The first rule whose pattern is in the accession or matches it as a regex (else 'other'); without rules: sp| and tr| are
    canonical, ENSP... and ...-Mut... variant, all else noncanonical."""
    a = F.coalesce(acc, F.lit(""))
    if rules is None:
        return F.when(a.startswith("sp|") | a.startswith("tr|"), "canonical").when(a.startswith("ENSP") | a.contains("-Mut"), "variant").otherwise("noncanonical")
    out = None
    for pattern, name in rules:
        test = a.contains(pattern) if contains_only else a.contains(pattern) | a.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit("other") if out is None else out.otherwise("other")


def class_of_biotype(biotype: Column, location: Column | None = None) -> Column:
    """ORF class of a source's biotype."""
    b = txt(biotype)
    loc = txt(location) if location is not None else F.lit("")
    coding = b.isin("protein_coding", "protein-coding")
    return F.when(b.contains("pseudogene"), "pseudogene-ORF").when(b.isin(C.LNCRNA_BIOTYPES), "lncRNA-ORF").when(coding & (loc == "genebody"), "altORF").otherwise("other")


def labelled_coding(biotype: Column, location: Column | None = None) -> Column:
    """P16, second value: the source calls the gene protein-coding (and not as a gene body)."""
    loc = txt(location) if location is not None else F.lit("")
    return txt(biotype).isin("protein_coding", "protein-coding") & (loc != "genebody")


def class_of_atlas(kind: Column) -> Column:
    """P17."""
    t = txt(kind)
    utr = t.contains("utr")
    return (
        F.when(utr & t.contains("3"), "3'UTR-ORF").when(utr & t.contains("5"), "uORF").when(t.contains("frame"), "altORF")
        .when(t.contains("pseudogene"), "pseudogene-ORF").when(t.contains("intron"), "intronic-ORF").when(t.isin(C.ATLAS_LNCRNA_TYPES), "lncRNA-ORF").otherwise("other")
    )


def is_control(gene: Column, biotype: Column | None = None) -> Column:
    """A member of the curated control families that isn't non-coding."""
    g = F.upper(F.trim(F.coalesce(gene, F.lit(""))))
    b = txt(biotype) if biotype is not None else F.lit("")
    silent = any_of([g.endswith(s) for s in C.CONTROL_NONCODING_SUFFIXES]) | b.contains("pseudogene") | b.isin("lncrna", "lincrna", "antisense")
    return (g != "") & ~silent & (g.isin(C.CONTROL_EXACT) | starts_with_any(g, C.CONTROL_PREFIXES))


def peptides(cell: Column, least: int = 7, annotated: bool = True) -> Column:
    """The alphabetic tokens of a cell, without parenthesised annotations, upper-cased, at least `least` long. P20 (annotated False): a
    token with an annotation is none."""
    text = F.coalesce(cell, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", "") if annotated else text, ";", ",")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^\p{L}+$") & (F.length(x) >= least))


def tissue_tier(tissue: Column) -> Column:
    """P21."""
    t, out = txt(tissue), None
    for name, members in C.TISSUE_TIERS.items():
        out = F.when(t.isin(members), name) if out is None else out.when(t.isin(members), name)
    return out.otherwise("OTHER")


def is_ribosomal(gene: Column) -> Column:
    """P22."""
    return starts_with_any(F.upper(F.coalesce(gene, F.lit(""))), C.RIBOSOMAL_PREFIXES)


def pseudogene_parent(symbol: Column) -> Column:
    """The parent's symbol in a pseudogene's, at least two characters; null if there is none."""
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    p = F.when(s.rlike(r"^\p{L}"), F.regexp_extract(s, C.PSEUDOGENE_PARENT, 1))
    return F.when(F.length(p) >= 2, p)


def drift_equal(a: Column, b: Column) -> Column:
    """Equal symbols, or a common prefix of three characters or more after which one of them has nothing but digits, and some."""
    n = F.least(F.length(a), F.length(b))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    rest = lambda s: F.substr(s, common + 1).rlike(r"^\d+$")
    return (a == b) | ((n >= 3) & (common >= 3) & (rest(a) | rest(b)))


def multiplicity(n: Column) -> Column:
    """P26."""
    return F.when(n == 1, "n=1").when(n == 2, "n=2").otherwise("n>=3")


def label_stratum(any_a: Column, any_other: Column) -> Column:
    """Only-A, only-B or mixed."""
    return F.when(any_a & any_other, "mixed").when(any_a, "only-a").otherwise("only-b")


def before(c: Column, mark: str) -> Column:
    """The text before the first `mark` (gene of an ORF id, id without version)."""
    return F.substring_index(c, mark, 1)


def orf_base(c: Column) -> Column:
    """An ORF id without its _NNaa or _NNaa_n ending."""
    return F.regexp_replace(c, r"_\d+aa(_\d+)?$", "")


def expression_class(vector: Column, testis: Column) -> Column:
    """Taxonomy of a tissue vector; `testis` is its value there. A null vector is unresolved."""
    high = F.size(F.filter(vector, lambda x: x >= C.TPM_EXPRESSED))
    other = high - (testis >= C.TPM_EXPRESSED).cast("int")
    return (
        F.when(vector.isNull(), "unresolved").when(high >= C.BROAD_TISSUES, "broad-RISK").when((testis >= C.TPM_EXPRESSED) & (other <= C.NARROW_TISSUES), "testis-restricted")
        .when(F.array_max(vector) >= C.TPM_EXPRESSED, "other-restricted").otherwise("normal-silent")
    )


def plain_text(html: Column) -> Column:
    """Tags out, the five basic entities and blanks unescaped, white space collapsed."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):  # fixed values
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def wilson(k: Column, n: Column, z: float = C.Z95) -> Column:
    """Struct (p, low, high); zeros for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / d
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(zero(p).alias("p"), zero(F.greatest(mid - half, F.lit(0.0))).alias("low"), zero(F.least(mid + half, F.lit(1.0))).alias("high"))


def percent(k: Column, n: Column) -> Column:
    """H15."""
    return F.coalesce(100.0 * k / F.nullif(n, F.lit(0)), F.lit(0.0))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = (k1 + k2) / F.nullif(n1 + n2, F.lit(0))
    se = F.sqrt(p * (1 - p) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    return F.coalesce((k1 / F.nullif(n1, F.lit(0)) - k2 / F.nullif(n2, F.lit(0))) / F.nullif(se, F.lit(0.0)), F.lit(0.0))


def class_fdr_bounds(q: Column, f: Column) -> Column:
    """Struct (low, high) of the class FDR that a total FDR q and a class share f allow; f = 0 gives [0, 1]."""
    f0 = F.nullif(f.cast("double"), F.lit(0.0))
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), (q - (1 - f)) / f0), F.lit(0.0)).alias("low"), F.coalesce(F.least(F.lit(1.0), q / f0), F.lit(1.0)).alias("high"))


def conjunction_bounds(lows: list[Column], highs: list[Column]) -> Column:
    """Frechet bounds of a conjunction."""
    return F.struct(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, lows) - (len(lows) - 1)).alias("low"), F.least(*highs).alias("high"))


def triage(low: Column, high: Column, benefit: Column, cost: Column) -> Column:
    """I3."""
    p = cost / F.nullif(benefit + cost, F.lit(0))
    return F.when(high < p, "reject").when(low >= p, "accept").otherwise("not identified")


def entrapment_half_width(theta: Column, k: Column, n: Column) -> Column:
    """I4."""
    return C.Z95 * F.sqrt(theta / F.nullif(k * n, F.lit(0)))
