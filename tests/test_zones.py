from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartoteka.operators.topk import page, page_after
from kartoteka.operators.zones import SortedTable

ORDER = ("name", "id")


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("n"), F.col("id") * 7919 % 400)).alias("name"), F.lit("x").alias("wide"))


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    return SortedTable(str(tmp_path_factory.mktemp("zones")), ORDER, data.schema).store(data, files=20)


def rows(df):
    return [(r.name, r.id) for r in df.collect()]


def files_read(df) -> int:
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        if metric.isDefined():
            found.append(metric.get().value())
    return max(found, default=-1)


@pytest.mark.parametrize("offset", [0, 49, 1234, 2890, 2990, 3000, 9999])
def test_pages_by_number(spark, data, stored, offset):
    got = stored.page_at(spark, 30, offset)
    assert rows(got) == rows(page(data, list(ORDER), 30, offset))
    assert files_read(got) <= 2


@pytest.mark.parametrize("last", [("n0", 0), ("n17", 10 ** 6), ("", 0), (None, 500), (None, 2950), ("zz", 1)])
def test_pages_after_a_row(spark, data, stored, last):
    got = stored.page_after(spark, last, 40)
    assert rows(got) == rows(page_after(data, list(ORDER), last, 40))
    assert files_read(got) <= 2


def test_walking_through_all_pages(spark, data, stored):
    seen, last = [], ("", -1)
    while True:
        found = rows(stored.page_after(spark, last, 700))
        if not found:
            break
        seen += found
        last = found[-1]
    assert seen == rows(data.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]))


def test_no_rows(spark, data, tmp_path):
    empty = SortedTable(str(tmp_path), ORDER, data.schema).store(data.limit(0))
    assert rows(empty.page_at(spark)) == [] == rows(empty.page_after(spark, ("a", 1)))
