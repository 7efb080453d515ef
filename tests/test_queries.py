"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from harborlane.plans import catalog
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# The tables hold too few rows at this size for these to give any.
EMPTY_AT_THIS_SIZE = {
    "backfill_plan", "dlq_rates", "forecast_hotspots", "forecast_imminent", "integrations_listing",
    "stream_letter_rates",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = differences(spark, duck, FOLDER, catalog.queries()[name], catalog.oracle_sql()[name])
    if name in EMPTY_AT_THIS_SIZE:
        found = [f for f in found if f != "no rows to compare"]
    assert not found, "\n".join(found)
