"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from dossier.plans import load_all
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
ENTRIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_matches_sql(spark, con, name):
    good, note = compare(spark, con, FOLDER, ENTRIES[name])
    assert good, note


def test_every_inventory_row_has_a_query():
    sizes = {"A": 9, "B": 8, "C": 10, "D": 6, "E": 14, "F": 16, "G": 8, "H": 11, "I": 19, "J": 9, "K": 11, "L": 12, "M": 6}
    wanted = {f"{family}{n}" for family, size in sizes.items() for n in range(1, size + 1)}
    assert wanted == {e.row for e in ENTRIES.values()}
