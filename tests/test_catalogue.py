import os

import pytest
from oracle import assert_same, connect

from codeloom import catalogue
from codeloom.plans.projection import snapshot

catalogue.load()
FOLDER = os.environ.get("CODELOOM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLES[name])


def test_every_query_has_sql():
    # a shortest cycle needs a search that SQL has no bounded form for: tests of the operators walk them
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"class_cycle_paths"}


#: Queries of all classes, and rows that are not all of them: the SQL states the whole, too.
PARTS = {
    "class_cards": "id % 50 = 3",
    "field_usages": "owner_class_id < 60",
    "method_usages": "owner_id < 60",
    "state_lifecycle": "target_id < 100",
    "workspace_usages": "target_id < 60",
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_all_classes_in_query_and_sql(spark, con, name):
    for whole in (catalogue.QUERIES[name](spark, FOLDER).where(f"NOT ({PARTS[name]})").count(), con.sql(f"SELECT count(*) FROM ({catalogue.ORACLES[name]}) WHERE NOT ({PARTS[name]})").fetchall()[0][0]):
        assert whole > 0


def test_cards_of_all_current_classes(spark):
    cards = catalogue.QUERIES["class_cards"](spark, FOLDER)
    assert sorted(r.id for r in cards.select("id").collect()) == sorted(r.id for r in snapshot(spark, FOLDER).current().select("id").collect())
