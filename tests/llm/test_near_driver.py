"""What near duplicates ask of the driver, which keeps every stage and task for a while: few of them, whatever the partitions."""

import random
import uuid
from contextlib import contextmanager

import pytest

from lexloom.llm import components, exact_near


@contextmanager
def dealt(spark, partitions):
    """So many shuffle partitions, none put together; yields a function that counts the tasks run so far."""
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    group = f"counted-{uuid.uuid4().hex}"
    tracker = spark.sparkContext.statusTracker()

    def tasks():
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))

    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, "counted")
        yield tasks
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found(spark, rows):
    return {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long").coalesce(1)).collect()}


def test_stars_need_no_round(spark):
    with dealt(spark, 32) as tasks:
        assert found(spark, [(i, i % 10) for i in range(10, 300)] + [(5, 5), (None, 1)]) == {i: i % 10 for i in range(300)}
        assert tasks() < 5 * 32


@pytest.mark.parametrize("rows", [[(i, i + 1) for i in range(60)], [(i, 100 + i) for i in range(60)] + [(100 + i, i + 1) for i in range(59)], [(3, 2), (3, 1)], [(1, 2), (3, 2)], [(9, 8), (8, 7), (6, 9), (20, 21)]])
def test_components_of_chains(spark, rows):
    want = {x: x for r in rows for x in r}
    for _ in want:
        for a, b in rows:
            want[a] = want[b] = min(want[a], want[b])
    assert found(spark, rows) == want


def test_tasks_of_near_classes(spark):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(8):  # each differs from the one before it by a little, from the first by much
            words[20 * k] = f"x{c}_{k}"
            rows.append((100 * c + k, " ".join(words)))
    with dealt(spark, 32) as tasks:
        got = {r.doc_id: r.component_id for r in exact_near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
        assert got == {i: 100 * (i // 100) for i, _ in rows}
        assert tasks() < 1500
