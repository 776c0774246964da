"""Means on a rounding tie: queries over clips are the same whatever the order of the lines, jumps whatever the order of the sum, and as their SQL has it."""

import duckdb
import pandas as pd
import pytest

from chronoloom.operators import series
from chronoloom.plans import catalog, signal
from tests.test_library import ORDERS

# means of single lines; the bounds are 0.0461 and 0.0464, so a tie of 0.04625 is an intensity of a third or of two thirds
PLAIN = [0.0461] * 10 + [0.0464] * 10 + [0.0462] * 4 + [0.0463] * 4
ON_TIES = 6


def tables(spark, sf, folder, order):
    """Parts of one line each and parts on a tie, whose lines come in ``order``; events that show the last eight of the former and the latter."""
    rows = [(k, k, 1, x, 1.0 + (k % 7 == 0), "N") for k, x in enumerate(PLAIN, 1)]
    for k in range(len(PLAIN) + 1, len(PLAIN) + 1 + ON_TIES):
        rows += [(k, k, n, c / 100, 1.0 + (k % 7 == 0), "N") for n, c in enumerate(order, 1)]
    lines = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag"])
    parts = pd.read_parquet(f"{sf}/part.parquet").head(len(PLAIN) + ON_TIES)
    parts = parts.assign(p_partkey=range(1, len(parts) + 1), p_size=20, p_retailprice=[900 + 30 + k % 30 for k in range(len(parts))])
    lines.to_parquet(f"{folder}/lineitem.parquet")
    parts.astype({"p_retailprice": float, "p_size": "int32"}).to_parquet(f"{folder}/part.parquet")
    shown = f"event_id % {len(parts)} >= {len(PLAIN) - 8}"
    spark.read.parquet(f"{sf}/events.parquet").filter(shown).coalesce(1).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["plan_score", "revise_inject", "revise_pass", "local_tags"])
def test_queries_do_not_depend_on_the_order_of_lines(spark, sf, tmp_path, name):
    found = []
    for n, order in enumerate(ORDERS):
        folder = tmp_path / str(n)
        folder.mkdir()
        tables(spark, sf, folder, order)
        c = duckdb.connect()
        for t, path in (("lineitem", "lineitem.parquet"), ("part", "part.parquet"), ("events", "events.parquet/*.parquet")):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{path}'")
        for f in (catalog.queries()[name](spark, str(folder)).toPandas(), c.execute(catalog.oracle_sql()[name]).df()):
            found.append(sorted(f[sorted(f.columns)].itertuples(index=False, name=None), key=str))
    assert len(found[0]) > 0 and all(f == found[0] for f in found)


def test_a_jump_of_a_mean_on_a_tie(spark):
    """The later twelve's mean is 0.2500005, as doubles added in order just below, so the rise is 0.050001 or 0.05."""
    later = [191690, 247214, 291281, 270652, 293095, 335716, 209767, 239526, 234490, 314030, 290904, 81641]
    values = [0.2] * 12 + [m / 1000000 for m in later] + [0.2]
    df = pd.DataFrame({"track": "a", "i": range(len(values)), "s": values})
    assert [r.i for r in series.jumps(spark.createDataFrame(df), ["track"], 12, 0.05).collect()] == [12]
    sql = signal.UNIT[signal.UNIT.index("q AS (SELECT track, round(quantile") : signal.UNIT.index(",\ncandidates")]
    assert duckdb.sql("WITH smooth AS (FROM df), extent AS (SELECT track, min(i) AS lo, max(i) AS hi FROM df GROUP BY 1), " + sql + " SELECT i FROM jumped").fetchall() == [(12,)]
