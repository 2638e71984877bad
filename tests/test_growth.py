"""What queries do to large tables, as their plans say."""

import re

import pytest

from wareloom.plans import pages, registry, reports  # noqa: F401  (each module adds its queries)

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["products_own_photos", "photo_order", "photo_provenance", "page_reports"])
def test_pages_are_read_once_and_made_where_they_are_read(spark, name):
    said = plan(spark, name)
    assert said.count("MapInArrow") == 1
    below = said[said.index("MapInArrow") :].split("\n")
    dealt = [line for line in below if "Repartition" in line][0]
    assert re.search(r"RepartitionByExpression \[p_partkey", dealt), dealt


@pytest.mark.parametrize("name", ["gallery_pictures", "plugin_cells"])
def test_texts_are_made_by_all_cores(spark, name):
    assert re.search(r"RepartitionByExpression \[p_partkey", plan(spark, name))


@pytest.mark.parametrize("name", ["photo_best_copy", "image_rank"])
def test_shots_are_made_by_all_cores(spark, name):
    assert re.search(r"RepartitionByExpression \[p_partkey", plan(spark, name))


def test_splits_of_an_export_are_bounded():
    assert reports.split_size(1000) == 10_000 and reports.split_size(24_000_000) == 1_000_000
    assert reports.split_size(10**10) == reports.split_size(10**12) <= 8 << 20
