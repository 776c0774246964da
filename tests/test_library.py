"""Means on a tie of their last place: the same whatever the order of the lines, here and in SQL."""

import duckdb
import pandas as pd

from chronoloom.plans import library

# 1.11 by 24 lines is 0.04625; as sums of doubles the second order is just below
ORDERS = ([5, 10, 0, 9, 7, 6, 1, 6, 1, 9, 4, 4, 1, 0, 0, 3, 4, 7, 7, 5, 5, 2, 9, 6], [9, 6, 7, 2, 1, 0, 4, 5, 5, 1, 4, 1, 4, 6, 7, 0, 9, 6, 5, 10, 3, 9, 7, 0])


def test_means_on_ties_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    rows = [(k, c / 100) for k, order in enumerate(ORDERS) for c in order] + [(8, 0.02), (8, None), (9, None)]
    pd.DataFrame([{"l_partkey": k, "l_discount": x, "l_quantity": 1.0} for k, x in rows]).to_parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").coalesce(1).write.parquet(f"{tmp_path}/one/lineitem.parquet")
    got = {r["id"]: r["motion_mean"] for r in library.samples(spark, f"{tmp_path}/one").collect()}
    assert got == {0: 0.0463, 1: 0.0463, 8: 0.02, 9: None}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    li = library.LIBRARY[: library.LIBRARY.index("\np AS")].rstrip().rstrip(",")
    assert dict(c.execute(li + " SELECT id, motion_mean FROM li").fetchall()) == got
