"""Counts by cycle against the batch form after every cycle."""

import datetime as dt
import random

import pytest

from pathsift.operators import dashboard
from pathsift.streaming import counts

pytestmark = pytest.mark.usefixtures("few_partitions")


def test_counts_follow_better_extracts(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, rnd.choice([None, 1, 1, 1, *range(2, 12)]), rnd.choice([None, 5, 6, 7, 50 + k // 40]), rnd.choice([None, 0, 1, 2]),
             dt.datetime(2024, 1, 1 + k % 3)) for k in range(150)]
    rnd.shuffle(rows)
    store = counts.open_store(spark, str(tmp_path / "store"))
    for cycle in range(3):
        part = spark.createDataFrame(rows[50 * cycle:50 * cycle + 50], counts.EXTRACTS)
        for died in (True, False):                       # the first attempt is never committed
            attempt = store.begin(cycle)
            counts.count_cycle(part, store, attempt)
            if not died:
                attempt.commit()
        rep = dashboard.representative(spark.createDataFrame(rows[:50 * cycle + 50], counts.EXTRACTS))
        assert sorted(map(tuple, counts.docs_per_topic(store).collect()), key=str) == \
            sorted(map(tuple, dashboard.docs_per_topic(rep).collect()), key=str)
        assert sorted(map(tuple, counts.docs_per_day(store).collect()), key=str) == \
            sorted(map(tuple, dashboard.docs_per_day(rep).collect()), key=str)
    assert store.begin(2) is None
