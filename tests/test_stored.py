"""Facts stored by entity are joined and grouped where they lie."""

import pytest

from tidemark.plans.star import star_plan
from tidemark.specs import VERSIONS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("stored")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored_facts LOCATION 'file://{place}'")
    plain = star_plan(spark, FOLDER)
    yield plain, plain.stored("stored_facts", 4)
    spark.sql("DROP DATABASE IF EXISTS stored_facts CASCADE")


@pytest.mark.parametrize("version", VERSIONS)
def test_same_rows(plans, rows, version):
    plain, stored = plans
    assert rows(stored.split(version)) == rows(plain.split(version))


@pytest.mark.parametrize("version", ["V3", "V4", "V5", "V6"])
def test_no_exchange_by_entity(spark, plans, version):
    """Even without broadcasts, no version moves a row."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plain, stored = (p.features(version)._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        for key in settings:
            spark.conf.unset(key)
    moved = [line for line in stored.splitlines() if "Exchange" in line]
    assert sum("Exchange hashpartitioning(hadm_id" in line for line in plain.splitlines()) > 5
    assert not moved


def test_rows_without_entity_are_left_out(spark, plans):
    _, stored = plans
    for name in ("labs", "diagnoses", "flagged_procedures", "flagged_prescriptions"):
        assert stored.tables[name].where("hadm_id IS NULL").count() == 0


def test_a_file_for_each_bucket(spark, plans):
    _, stored = plans
    assert 0 < len(stored.tables["labs"].inputFiles()) <= 4
