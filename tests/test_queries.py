"""Registered queries against their SQL on the smallest data set."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_oracle  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["interval_overlap", "interval_subtract", "initiate_regions", "initiate_conserved_regions", "great_links", "motif_hits",
         "agg_median", "agg_minmax", "sparse_cor_pearson", "cross_cor", "skip_reasons", "gram",
         "padj_methods", "format_coefs", "find_modules", "module_genes", "pagerank", "tf_network",
         "wilcoxon", "gof_histogram", "weighted_coex"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    msg, ok = check_oracle.compare(spark, con, name, SF, entry.oracle_sql()[name])
    assert ok, msg


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns[:4] == ["tf", "target", "region", "term"]
