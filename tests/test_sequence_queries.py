import pytest

from cladeloom.plans import sequence_queries as sq

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fn", [sq.applied_mutations, sq.mutation_spectrum, sq.edge_mutation_counts, sq.edge_log_likelihood])
def test_customers_are_not_broadcast(spark, fn):
    plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "k#" in line and "kmer" not in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
