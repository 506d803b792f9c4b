"""Workbooks: the source and the sink, and cohort claims from sheets."""

import zipfile

import pytest

from veristrata.sources import workbook as W


def by_hand(path):
    """A workbook as an office program writes it: shared strings with runs, gaps, formulas, unused rows."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://x/relationships"><sheets><sheet name="A &amp; B" sheetId="7" r:id="rId9"/><sheet name="Empty" sheetId="8" r:id="rId3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://x"><Relationship Id="rId9" Target="/xl/worksheets/own.xml"/><Relationship Id="rId3" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>plain</t></si><si><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r><rPh><t>hint</t></rPh></si><si><t></t></si></sst>')
        z.writestr("xl/worksheets/none.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        cells = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c></row><row r="5"><c r="B5"><v>12</v></c><c r="C5"><v>1E-3</v></c><c r="D5" t="b"><v>1</v></c><c r="E5" t="str"><f>A1</f><v>made</v></c><c r="AB5" t="inlineStr"><is><t>far</t></is></c></row><row r="6"/><row r="7"><c r="A7" t="s"><v>2</v></c><c r="B7" t="e"><v>#N/A</v></c><c r="C7"/></row>'
        z.writestr("xl/worksheets/own.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_source(spark, tmp_path):
    by_hand(f"{tmp_path}/a.xlsx")
    got = W.read_workbooks(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    rows = {r.row_idx: r.cells for r in got.where("sheet = 'A & B'").collect()}
    assert rows == {2: ["plain", None, None, "rich "], 5: [None, "12", "0.001", "True", "made", *[None] * 22, "far"], 7: ["", "#N/A", None]}
    assert W.read_workbooks(spark, f"{tmp_path}/a.xlsx", ["Empty"]).collect() == []
    assert W.read_workbooks(spark, f"{tmp_path}/*.xlsx", ["A & B"]).count() == 3
    (tmp_path / "none").mkdir()
    assert W.read_workbooks(spark, f"{tmp_path}/none").collect() == []


def book(spark, path, sheets):
    rows = [("b", name, cells, i, j) for i, (name, body) in enumerate(sheets.items()) for j, cells in enumerate(body)]
    W.write_workbooks(spark.createDataFrame(rows, "workbook string, sheet string, cells array<string>, i int, j int"), path, ["i", "j"])
    return W.read_workbooks(spark, path)


def test_sink_and_source(spark, tmp_path):
    rows = book(spark, f"{tmp_path}/w", {"x": [["a", None, "1.5"], None, ['<&"> ', "7"]], 'q"s': [["z"]]})
    assert {(r.sheet, r.row_idx): r.cells for r in rows.collect()} == {("x", 1): ["a", None, "1.5"], ("x", 3): ['<&"> ', "7"], ('q"s', 1): ["z"]}


def test_long_sheet(spark, tmp_path):
    n = 5000
    rows = book(spark, f"{tmp_path}/w", {"x": [[str(i), f"t{i}"] for i in range(n)]})
    assert [(r.row_idx, r.cells) for r in rows.orderBy("row_idx").collect()] == [(i + 1, [str(i), f"t{i}"]) for i in range(n)]


def test_gene_workbook(spark, tmp_path):
    rows = book(
        spark,
        f"{tmp_path}/w",
        {
            "S23": [["gene_id", "transcript_id", "gene_name", "gene_type", "n", "%", "Source", "Peptide", "hi"], ["E1", "T", "SAGE1", "protein_coding", "2", "1", "x", "AAAAAAAK; M(Oxidation)CCCCCCK,short", "y"], ["E2", None, None, "lincRNA"], [None, "T", "skipped"], ["E3", "T", "G3", "processed_pseudogene", "1", "1", "x", "WMSLDWELYV"]],
            "S19": [["a", "b", "name", "type"], [None, None, "G9", "antisense"], [None, None, "G9", "protein_coding"]],
            "S26": [["target_decoy", "q-value", "sequence"], ["target", "0.01", "MCCC(+15.99)CCCK"], ["target", "0.002", "mccccccK "], ["decoy", "0.5", "NEVERSEEN"], ["target", "none", "AAAAAAAK"]],
            "S16": [["h"] * 12, ["wmsldwelyv ", "i", "G9", *["-"] * 6, "Yes", "-", "yes"], ["HLWHSATSL", "i", "G8", *["-"] * 6, "NO"], ["OTHERPEP", "i", None]],
        },
    )
    claims = W.gene_workbook_claims(rows, W.REACTIVE, W.NEGATIVE, "doi", "cancer", "s")
    got = sorted((r.citation_location, r.peptide_sequence, r.orf_id_or_locus, r.orf_class, r.antigen_type, r.psm_qvalue, r.validation_level, r.tumor_specificity_result) for r in claims.collect())
    nr = "not reported"
    assert got == [
        ("Table S23", "AAAAAAAK", "SAGE1", "other", "TAA", nr, "MS-presented", nr), ("Table S23", "MCCCCCCK", "SAGE1", "other", "TAA", "0.002", "MS-presented", nr), ("Table S23", "WMSLDWELYV", "G3", "pseudogene-ORF", "TSA", nr, "MS-presented", nr),
        ("Table S23", nr, "E2", "lncRNA-ORF", "TSA", nr, "MS-presented", nr), ("Tables S16/S17/S18", "HLWHSATSL", "G8", "other", "TSA", nr, "validated_negative", "detected-in-normal"),
        ("Tables S16/S17/S18", "OTHERPEP", nr, "other", "TSA", nr, "MS-presented", nr), ("Tables S16/S17/S18", "WMSLDWELYV", "G9", "lncRNA-ORF", "TSA", nr, "in-vivo", "absent-from-normal"),
    ]
    assert [r.peptide for r in W.unattached_q_values(rows, claims).collect()] == ["NEVERSEEN"]


@pytest.mark.parametrize("headed", [True, False])
def test_candidate_workbook(spark, tmp_path, headed):
    head = [["Title"], None, ["No", "Peptide Sequence", "Gene symbol (x)", "Predicted HLA type"]] if headed else [["Title"]]
    rows = book(
        spark,
        f"{tmp_path}/w",
        {
            "Supplementary Table S2": [["Gene Symbol", "Peptide", "Biotype", "Gen_Location"], ["G1", "aaak", "lincRNA", None], ["G2", "CCCK", "protein_coding", "GeneBody"], ["G3", "AAAK", "pseudogene", "x"], ["G4", None], ["G5", "DDDK"]],
            "Supplementary Table S3": [*head, ["1", "AAAK", "G7", "A2"], ["2", "ZZZK", None, None], ["3", "A-B", "G9", "A2"]],
        },
    )
    got = sorted((r.citation_location, r.peptide_sequence, r.orf_id_or_locus, r.orf_class, r.hla_allele) for r in W.candidate_workbook_claims(rows, "doi", "cancer", "s").collect())
    nr = "not reported"
    found = [("Table S2", "CCCK", "G2", "altORF", nr), ("Table S2", "DDDK", "G5", "other", nr)]
    if headed:
        assert got == found + [("Table S3 + Fig 6", "AAAK", "G7", "pseudogene-ORF", "A2"), ("Table S3 + Fig 6", "ZZZK", nr, "other", nr)]
    else:
        assert got == [("Table S2", "AAAK", "G1", "lncRNA-ORF", nr), ("Table S2", "AAAK", "G3", "pseudogene-ORF", nr), *found]
