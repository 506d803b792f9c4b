"""One command of the audit: a file of spectrum matches to its class ledger and everything that leaves with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import decoy, gates, sequence
from veristrata.plans.checkpoint import store
from veristrata.sources import readers, sinks


def class_decoy_ledger(spark: SparkSession, path: str, out: str, *, kind: str = "tsv", score: str | None = None, q: str | None = None, alpha: float = 0.01, unit: str = "psm", ascending: bool = False, decoy_prefix: str = "rev_",
                       canonical: str | None = None, strata: bool = False, emit_contract: bool = False, columns: dict[str, str] | None = None, base: str | None = None) -> dict:
    """Reads pepXML (kind "pepxml") or a table of matches, sweeps q-values where none are reported, counts accepted targets and decoys by
    class, and writes <out>.json and <out>.tsv; with emit_contract also <out>.psms.tsv and a folder for each class. Returns
    what the JSON says. base: a folder that `path` and `canonical` are below, where files that aren't there are an error. A column that isn't there, a bad alpha or unit, or no match at all is an error before anything is written.
    """
    if base is not None:
        path, canonical = readers.resolve(base, path), canonical and readers.resolve(base, canonical)
    if kind == "pepxml":
        score = score or "hyperscore"
        decoy.check_options(alpha, unit, [score], [], score, None)
        psms = readers.pepxml(spark, path, decoy_prefix, score)
    else:
        names = {"ident": "PSMId", "peptide": "peptide", "protein": "Proteins", "decoy": None} | (columns or {})
        head = readers.header_of(spark, path, "\t")
        decoy.check_options(alpha, unit, head, [c for c in (*names.values(), score, q) if c], score, q)
        psms = readers.psm_tsv(spark, path, score=score, q=q, decoy_prefix=decoy_prefix, **names)
    psms = store(gates.not_empty(psms, f"spectrum matches in {path}"), "psms")  # the file is parsed once
    swept = psms if q else store(decoy.q_sweep(psms.drop("q"), "score", "is_decoy", "_row_idx", ascending), "swept")
    accepted = decoy.accepted(swept, alpha)
    counted = decoy.unit_rows(accepted, unit)
    ledger = decoy.ledger(counted)
    extra: dict[str, DataFrame] = {}
    if canonical:
        extra["canonical_self"] = sequence.self_fraction(accepted, readers.fasta(spark, canonical).withColumnRenamed("seq", "text"))
    if strata:
        extra["multiplicity_strata"] = decoy.depth_strata(accepted)
    meta = {"analysis_id": path.rstrip("/").rsplit("/", 1)[-1], "software": "pepXML" if kind == "pepxml" else "PSM-table", "unit": unit, "alpha": alpha, "fdr_convention": "(D+1)/T", "fdr_basis": "reported q-values" if q else f"target-decoy sweep on {score}", "decoy_prefix": decoy_prefix}
    meta["input_sha256"] = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in readers.digests(spark, path).collect()}  # a row a file
    said = sinks.ledger_files(ledger, meta, out, extra)
    if emit_contract:
        contract = decoy.contract(swept, decoy_prefix)
        sinks.sorted_table(contract, out + ".psms.csv", "q")
        sinks.by_class(swept.where("q is not null").select("class", "id", "peptide", "score", "q", "is_decoy", "accession"), out + ".by-class")
    return said
