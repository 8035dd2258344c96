"""Layout lines from runs (F6 A6 A7): same lines in any order of spans, no sort of spans before the shuffle."""

import random

from lexiflow.operators.layout import layout_lines, line_runs

DDL = ("path string, page int, block int, line int, span int, block_type int, text string, size double, color int, "
       "x0 double, y0 double, x1 double, y1 double")


def _rows():
    rnd = random.Random(3)
    return [(f"f{i % 3}", i % 2, 0, i % 5, s, 0, rnd.choice(["é", "日本 ", "", None, " z "]), rnd.choice([8.0, 9.0, None]), s, float(s), None, s + 1.0, 2.0)
            for i in range(30) for s in ([3, 0, 2, 2] if i % 7 == 0 else range(4))]


def _line(rows):
    """A line's text, size and left edge, from its rows, in Python."""
    text = "".join(r[6] or "" for r in sorted(rows, key=lambda r: (r[4], r[6] is not None, (r[6] or "").encode()))).strip()
    sizes = [r[7] for r in rows if r[7] is not None]
    return text, min(sizes, key=lambda v: (-sizes.count(v), v), default=None), min(r[8] for r in rows), min(r[9] for r in rows), None, max(r[11] for r in rows)


def _before_shuffle(df):
    """The part of the plan that runs before the last exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Exchange hashpartitioning"):]


def test_lines_do_not_depend_on_the_order_of_spans(spark):
    rows = _rows()
    want = {}
    for r in rows:
        want.setdefault(r[:4], []).append(r)
    want = {k: w for k, v in want.items() if (w := _line(v))[0]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for order in (rows, sorted(rows, key=lambda r: (r[:5], r[6] or "")), random.Random(1).sample(rows, len(rows))):
            got = {tuple(r[:4]): tuple(r[c] for c in ("text", "size", "color", "x0", "y0", "x1")) for r in layout_lines(spark.createDataFrame(order, DDL)).collect()}
            assert got == want
            short = layout_lines(spark.createDataFrame(order, DDL), style=False).collect()
            assert {tuple(r[:4]): r.text for r in short} == {k: v[0] for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_side_by_side_are_one_row_before_the_shuffle(spark):
    spans = spark.createDataFrame([("f", 0, 0, ln, s, 0, "w", 8.0, 1, 0.0, 0.0, 1.0, 1.0) for ln in range(50) for s in range(100)], DDL).coalesce(1)
    assert line_runs(spans).count() == 50
    below = _before_shuffle(layout_lines(spans))
    assert "Aggregate" not in below and "Sort" not in below      # a partial aggregate of lists sorts all spans of its task
