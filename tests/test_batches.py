"""Batches of a source that holds all rows, cut into many spans, equal a walk from row to row."""

import random

import pytest

from folioquery.operators import batches as B


def walk(rows, most, items):
    out, now = [], ""
    for source, page, part, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if source != now:
            now, batch, size, held = source, 0, 0, 0
        elif size + n > most or held == items:
            batch, size, held = batch + 1, 0, 0
        size, held = size + n, held + 1
        out.append((source, page, part, batch))
    return out


@pytest.mark.parametrize("items", [None, 7])
def test_one_source_of_all_rows(spark, items):
    r = random.Random(3)
    size = lambda: r.choice([1, 2, r.randrange(1, 40), r.randrange(1, 100), 100, 101, 950]) if r.random() < 0.3 else r.randrange(1, 30)
    rows = [("hot", page, part, size()) for page in range(1, 900) for part in range(1, r.randrange(2, 5))] + [("one", 1, 1, 5), ("big", 1, 1, 5000), ("big", 9, 1, 5), (None, 1, 1, 99), (None, 2, 1, 2)]
    r.shuffle(rows)
    told = B.pack_batches(spark.createDataFrame(rows, "source string, page int, part int, n long").repartition(4), 100, items, span=3).collect()
    assert sorted(map(tuple, told), key=lambda x: (x[0] or "", *x[1:])) == walk(rows, 100, items)


def test_no_rows(spark):
    assert B.pack_batches(spark.createDataFrame([], "source string, page int, part int, n long"), 100).count() == 0
