"""Prespecified constants: one place (G3), tokens and vocabularies are fixed values of the domain."""

from __future__ import annotations

# Thresholds.
MAX_SOURCE_FDR = 0.001
MIN_SOURCE_PEPTIDES = 2
MIN_SOURCE_PEP_LEN = 9
MIN_PERIODICITY = 70.0
LIGAND_LEN = (8, 12)
TPM_EXPRESSED, TPM_ROBUST, BROAD_TISSUES, NARROW_TISSUES = 1.0, 10.0, 27, 5
KMER = 9
CONSTANCY_FOLD = 1.5
BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED = 2000, 20260713
#: Rounds of a permutation null (10,000 in the reference).
PERMUTATIONS = 10_000
Z95 = 1.96

# Texts that mean "not reported", and the narrower set for presence.
NOT_REPORTED = "not reported"
NOT_REPORTED_TOKENS = ["", "not reported", "not stated", "na", "n/a", "nr", "none", "insufficient-info"]
ABSENT_TOKENS = ["not reported", "not stated", "", "insufficient-info"]

# The claim columns in order, and lineage columns.
CLAIM_COLUMNS = [
    "peptide_sequence", "orf_id_or_locus", "orf_class", "antigen_type", "cancer_type", "hla_allele", "evidence_types", "reported_fdr",
    "psm_qvalue", "accepted_decoys_in_class", "n_unique_peptides", "ligand_len", "source_pep_len", "periodicity_pct",
    "tumor_specificity_modality", "tumor_specificity_scope", "tumor_specificity_result", "validation_level",
    "meets_consensus_bar_as_reported", "underlying_dataset_accession", "source_provenance", "citation_doi_pmid", "citation_location",
    "extraction_confidence",
]
LINEAGE_COLUMNS = ["_canonical", "_claim_unit", "_source_row", "_source_gene", "_pep_index", "_n_peps_in_source_row", "_source_class_raw", "_source"]
RETIRED_COLUMNS = ["min_peptide_len", "tumor_specificity_basis"]
REUSE_FIELDS = ["hla_allele", "reported_fdr", "periodicity_pct", "tumor_specificity_modality", "orf_id_or_locus", "underlying_dataset_accession", "validation_level", "citation_doi_pmid"]
VOCABULARY = {
    "orf_class": ["uORF", "lncRNA-ORF", "altORF", "3'UTR-ORF", "intronic-ORF", "pseudogene-ORF", "dORF", "other", "not reported"],
    "antigen_type": ["TSA", "TAA", "normal-or-other", "not reported"],
    "tumor_specificity_modality": ["normal-ligandome-broad", "normal-ligandome-matched", "normal-rna-broad", "normal-rna-matched", "not stated", "not reported"],
    "tumor_specificity_scope": ["per-claim-reported", "cohort-inclusion-criterion", "not stated", "not reported"],
    "tumor_specificity_result": ["absent-from-normal", "detected-in-normal", "not stated", "not reported"],
    "validation_level": ["nominated", "MS-presented", "T-cell-validated", "in-vivo", "validated_negative", "not reported"],
    "meets_consensus_bar_as_reported": ["yes", "no", "insufficient-info"],
    "source_provenance": ["primary", "review"],
    "extraction_confidence": ["high", "med", "low"],
}
LIGANDOME_MODALITIES = ["normal-ligandome-broad", "normal-ligandome-matched"]
ALL_MODALITIES = [*LIGANDOME_MODALITIES, "normal-rna-broad", "normal-rna-matched"]
DIMENSIONS = ["source_translation", "hla_elution", "allele_restriction", "normal_presentation", "human_tcell_assay", "class_fdr_reconstructible"]
RUNGS = ["asserted", "claim_linked", "quantitative", "modality_appropriate", "adjudicable"]

# Tissue tiers, curated control genes, pseudogene patterns, decoy texts.
TISSUE_TIERS = {
    "CRITICAL": ["brain", "cerebellum", "heart", "liver", "lung", "kidney", "pancreas", "nerve", "adrenal gland"],
    "HIGH": ["esophagus", "stomach", "colon", "small intestine", "bladder", "thyroid", "aorta", "trachea", "tongue", "gallbladder", "muscle", "skin"],
    "MODERATE": ["breast", "prostate", "uterus", "ovary"],
    "IMMUNE": ["thymus", "spleen", "bone marrow", "lymph node"],
    "PRIVILEGED": ["testis"],
}
CONTROL_PREFIXES = ["MAGEA", "MAGEB", "MAGEC", "SSX", "GAGE", "CT45A", "CTAG", "PRAME", "PAGE", "SPANX", "XAGE", "CSAG"]
CONTROL_EXACT = ["SAGE1", "DDX53", "TFDP3", "ACTL8", "FTHL17", "MORC1", "TDRD1", "CTCFL", "TPTE"]
CONTROL_NONCODING_SUFFIXES = ["-AS1", "-AS2", "-AS3", "-OT1", "-IT1", "-DT"]
RIBOSOMAL_PREFIXES = ["RPS", "RPL", "MRPL", "MRPS"]
LNCRNA_BIOTYPES = ["lncrna", "lincrna", "antisense", "bidirectional_promoter_lncrna", "sense_intronic", "processed_transcript", "macro_lncrna", "3prime_overlapping_ncrna", "sense_overlapping"]
ATLAS_LNCRNA_TYPES = ["ncrna", "noncoding_rna", "lncrna", "lincrna", "antisense"]
PSEUDOGENE_SUFFIX = r"P\d+$"
PSEUDOGENE_SYMBOL = r"^[A-Z0-9\-]+P\d+$"
PSEUDOGENE_PARENT = r"^([A-Z0-9\-]+?)P\d*$"
DECOY_TEXTS = ["1", "true", "t", "yes", "decoy"]
