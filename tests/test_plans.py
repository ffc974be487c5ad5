"""Plans: no products, filters and columns at the scan, few shuffles."""

import re

import pytest

from strandflow.operators import eager
from strandflow.plans import data_problems, file_queries, registry
from tests.oracle import DATA

#: Each side has five rows.
SMALL = {"dbg_f_c"}


def plan(spark, name):
    return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(file_queries.QUERIES) - SMALL))
def test_no_products(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_scans_are_pruned(spark):
    p = plan(spark, "catalog_count")
    assert "EqualTo(hq_filter,PASS)" in p and "ReadSchema: struct<hq_filter:string,asm_fasta_on_osf:string>" in p
    assert "ReadSchema: struct<tar_xz:string,file_name" in plan(spark, "batch_group").replace("file_name:string,tar_xz:string", "tar_xz:string,file_name:string")
    p = eager.compact(data_problems.keyed_rows(spark, DATA), ["table_name", "key_value"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sylph_species:string>" in p and "ReadSchema: struct<taxonomy:string>" in p


@pytest.mark.parametrize(("name", "most"), [("kmer_count_both_strands", 1), ("dbg_edges", 2), ("dbg_colours", 2), ("p4_species_summary", 3), ("suffix_plan_cumulative", 2)])
def test_shuffles(spark, name, most):
    p = plan(spark, name)
    assert len(re.findall(r"Exchange (?:hash|range)partitioning\((?!source)", p)) <= most
