import pytest

from tests.conftest import canon
from veristrata.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    con, folder = oracle
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, oracle, name):
    assert QUERIES[name](spark, oracle[1]).count() > 0


@pytest.mark.parametrize("name", ["overlap_exact", "overlap_by_class", "own_gene_frame_audit", "whole_orf_containment", "decoy_qsweep", "evidence_cascade", "spearman_rank"])
def test_no_nested_loops(spark, oracle, name):
    plan = QUERIES[name](spark, oracle[1])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prespecified_rounds(spark, oracle, monkeypatch):
    from veristrata.operators import resample

    rounds = {}
    boot, interval = resample.clustered_bootstrap, resample.percentile_interval
    monkeypatch.setattr(resample, "clustered_bootstrap", lambda *a, **k: rounds.setdefault("bootstrap", boot(*a, **k)))
    monkeypatch.setattr(resample, "percentile_interval", lambda t: rounds.setdefault("interval", interval(t)))
    QUERIES["bootstrap_ci"](spark, oracle[1])
    assert rounds["bootstrap"].count() == 2000
    p = QUERIES["permutation_null"](spark, oracle[1]).first()["p"] * 10_001
    assert abs(p - round(p)) < 1e-6
