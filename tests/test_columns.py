"""T10 with one table-wide scope split over many packing segments."""

from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.functions.script import py_est_tokens
from lexiflow.models import MockTranslator, mock_translate
from lexiflow.operators.columns import translate_columns
from test_pack import next_fit


def test_table_scope_over_many_segments(spark):
    rows = [(i, f"題{i % 7}日本" if i % 3 else "plain", f"本文{i % 11}" * (1 + i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    s = DEFAULT.with_(chunk_token_budget=120, chunk_max_strings=5, pack_segment_units=7, throttle_waits=(0.0,))
    res = translate_columns(df, ["title", "body"], MockTranslator(), ["id"], s, context="t")
    got = {r.id: (r.title, r.body) for r in res.table.collect()}
    for i, t, b in rows:
        exp_t = mock_translate(t) if t != "plain" else t
        assert got[i] == (exp_t, mock_translate(b))
    # the packing of the one hot scope equals sequential next-fit over first appearances
    order = list(dict.fromkeys(v for _, t, b in rows for v in (t, b) if v != "plain"))
    exp = next_fit([py_est_tokens(v) for v in order], 120, 5)
    chunk = {r.ord: r.chunk_no for r in res.batch.assignments.collect()}
    asg = {r.text: chunk[r.ord] for r in res.batch.unique_units.collect()}
    assert [asg[v] - 1 for v in order] == exp
    assert res.batch.unique_units.select(F.countDistinct("scope")).first()[0] == 1


def test_a_refused_chunk_keeps_only_its_own_cells(spark):
    """One failed call among many: its strings stay, the others are translated; keys of any width; nulls in the scope."""
    from lexiflow.models import ScriptedFaultTranslator
    rows = [(2**62 - i if i % 2 else -i, None if i % 5 == 0 else "s", "失敗" if i == 40 else f"題{i}", None if i % 9 == 0 else "plain")
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, grp string, title string, note string")
    s = DEFAULT.with_(chunk_max_strings=10, throttle_waits=(0.0,))
    tr = ScriptedFaultTranslator(fail_marker="失敗", faults=False)
    got = translate_columns(df, ["title", "note"], tr, ["id"], s, scope_cols=["grp"], status_col="how").table.collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.how == "kept"]
    done = [r for r in got if r.how == "ok"]
    assert 1 <= len(kept) <= 10 and len(kept) + len(done) == 200
    before = {r[0]: r for r in rows}
    assert "失敗" in [r.title for r in kept]
    assert all(r.title == before[r.id][2] for r in kept) and all(r.title == mock_translate(before[r.id][2]) for r in done)
    assert all(r.note == before[r.id][3] and r.grp == before[r.id][1] for r in got)
