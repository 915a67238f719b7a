"""Results depend neither on partitioning, nor on row order, nor on skew."""

import pytest
from helpers import raw_tickets
from pyspark.sql import functions as F

from queuelens.operators import inference, materiality, metrics, mixture, quality, segments
from queuelens.operators.clean import clean_tickets, count_copies


def snapshot(tickets, raw, profile):
    frames = [
        metrics.headline_kpis(tickets, profile),
        segments.segment_metrics(tickets, profile),
        segments.resolution_satisfaction_corr(tickets),
        segments.agent_low_score_spread(tickets, profile),
        quality.qa_row_counts(count_copies(raw), tickets),
        materiality.mat_date_rows_dropped(raw, tickets, profile),
        mixture.methodology_swing(tickets, profile),
        inference.kruskal_resolution_by_priority(tickets, profile),
    ]
    return [sorted(map(tuple, f.collect()), key=repr) for f in frames]


@pytest.fixture(scope="module")
def expected(ws):
    return snapshot(ws.tickets, ws.raw, ws.profile)


@pytest.mark.parametrize("partitions", [1, 13])
def test_partitions(spark, ws, expected, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert snapshot(ws.tickets, ws.raw, ws.profile) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_row_order(ws, expected):
    shuffled = ws.tickets.repartition(7).sortWithinPartitions(F.xxhash64("ticket_id"))
    assert snapshot(shuffled, ws.raw.repartition(5), ws.profile) == expected


def test_a_third_of_all_rows_being_one_copy(spark, ws):
    copies = ws.raw.filter("ticket_id = '7'").limit(1).crossJoin(spark.range(800)).drop("id")
    skewed = ws.raw.unionByName(copies)
    cleaned = clean_tickets(skewed, ws.agents, ws.profile)
    assert sorted(map(tuple, cleaned.collect()), key=repr) == sorted(
        map(tuple, ws.tickets.collect()), key=repr
    )
    row = quality.qa_row_counts(count_copies(skewed), cleaned).first()
    assert (row["raw_rows"], row["raw_distinct"]) == (1520 + 800, 1502)


def test_a_third_of_all_rows_without_id(spark, ws):
    nameless = raw_tickets(spark, *[{"ticket_id": None, "agent_id": f"N{i}"} for i in range(800)])
    cleaned = clean_tickets(ws.raw.unionByName(nameless, allowMissingColumns=True), ws.agents, ws.profile)
    flags = {r[0]: r[1] for r in cleaned.groupBy("is_id_conflict").count().collect()}
    assert flags == {None: 803, True: 4, False: 1495}
