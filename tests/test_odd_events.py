"""Plans whose events have no time or lie before 2024: as their SQL has it."""

import duckdb
import pandas as pd
import pytest

from chronoloom.plans import catalog


def differing(spark, sf, folder, events, name):
    """Rows of the query, and the rows that only one of the query and its SQL has."""
    events.astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    for t in ("part", "lineitem"):
        (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
    got, want = ({tuple(r) for r in f[sorted(got.columns)].itertuples(index=False, name=None)} for f in (got, want))
    return got, got ^ want


@pytest.mark.parametrize("name", ["revise_inject", "revise_pass"])
def test_events_without_a_time_come_last(spark, sf, tmp_path, name):
    events = pd.read_parquet(f"{sf}/events.parquet")
    events.loc[events.event_id % 5 == 0, "ts"] = pd.NaT
    got, differ = differing(spark, sf, tmp_path, events, name)
    assert got and not differ


@pytest.mark.parametrize("name", ["revise_inject", "revise_pass"])
def test_seconds_before_2024_are_rounded_down(spark, sf, tmp_path, name):
    """Half a second before an hour begins, on either side of the first of January."""
    events = pd.read_parquet(f"{sf}/events.parquet")
    events["ts"] = events.ts.dt.floor("h") - pd.Timedelta(days=15) - pd.Timedelta(milliseconds=500)
    got, differ = differing(spark, sf, tmp_path, events, name)
    assert got and not differ
