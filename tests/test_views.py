"""Assays made in one pass over the sales against the same assays made one by one."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from regweave.catalog.views import Views


def _tables(folder):
    """Repeated, missing and unmatched keys, a missing brand, size and quantity."""
    put = {
        "part": {"p_partkey": pa.array([1, 2, 3, 4, 5], pa.int64()), "p_brand": ["Brand#11", "Brand#12", None, "Brand#11", "Brand#13"],
                 "p_size": pa.array([3, 7, 7, None, 3], pa.int32())},
        "orders": {"o_orderkey": pa.array([10, 11, 12, 13], pa.int64()), "o_custkey": pa.array([1, 1, 2, None], pa.int64()),
                   "o_orderdate": [dt.datetime(2024, 1, 1)] * 4},
        "lineitem": {"l_orderkey": pa.array([10, 10, 11, 11, 12, 12, 13, 99, 12, 10], pa.int64()),
                     "l_partkey": pa.array([1, 2, 1, 4, 3, 5, 1, 1, 77, 2], pa.int64()),
                     "l_quantity": pa.array([1.5, 2.0, -1.5, 4.0, 5.0, None, 7.0, 8.0, 9.0, 3.0], pa.float64())},
    }
    for name, columns in put.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def test_assays_of_one_pass(spark, tmp_path):
    _tables(tmp_path)
    v = Views(spark, str(tmp_path))
    for got, want in zip(v.assays(), (v.expr(), v.acc())):
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_sales_are_read_once(spark, tmp_path, monkeypatch):
    _tables(tmp_path)
    passes, sales = [], Views._sales
    monkeypatch.setattr(Views, "_sales", lambda self: passes.append(1) or sales(self))
    from regweave.catalog import model_queries as Q
    v = Views(spark, str(tmp_path))
    monkeypatch.setattr(Views, "cells", lambda self: self.table("orders"))
    s = Q.inputs(v, v.genes())
    assert s.expression.count() == 5 and s.accessibility.count() > 0 and len(passes) == 1
