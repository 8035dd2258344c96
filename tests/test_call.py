"""Outcome classes of the model stage (pure Python, no Spark)."""

import pytest

from lexiflow.config import DEFAULT
from lexiflow.models import (MockTranslator, ModelReply, ScriptedFaultTranslator, Throttled, ThrottlingTranslator,
                             mock_translate)
from lexiflow.operators.call import translate_chunk, translate_text

S = DEFAULT.with_(throttle_waits=(0.0,))


class Fixed:
    """Answers the same text on every batch call."""

    def __init__(self, text):
        self.text = text

    def __call__(self, req):
        if req.kind == "batch":
            return ModelReply(self.text, 1, 1)
        return MockTranslator()(req)


def test_ok_first_attempt():
    o = translate_chunk(MockTranslator(), ["日本", "語"], "ctx", S)
    assert (o.status, o.attempts, o.out_items) == ("ok", 1, [mock_translate("日本"), mock_translate("語")])


def test_short_three_times_gives_partial():
    # 3 strings, answers ["a","b"] three times -> two partial, third missing
    o = translate_chunk(Fixed('["a", "b"]'), ["x1", "x2", "x3"], "ctx", S)
    assert (o.status, o.attempts, o.out_items) == ("partial", 3, ["a", "b", None])


def test_blank_item_accepted_when_count_matches():
    # 3 strings, answers ["a","","c"] -> accepted, second becomes empty (Q6 parity)
    o = translate_chunk(Fixed('["a", "", "c"]'), ["x1", "x2", "x3"], "ctx", S)
    assert (o.status, o.out_items) == ("ok", ["a", "", "c"])
    o = translate_chunk(Fixed('["a", "", "c"]'), ["x1", "x2", "x3"], "ctx", S.with_(reject_blank=True))
    assert o.status == "partial" and o.out_items == ["a", None, "c"]


def test_first_longest_partial_wins():
    answers = iter(['["a"]', '["b", "c"]', '["d", "e"]'])

    class Seq:
        def __call__(self, req):
            return ModelReply(next(answers), 0, 0)
    o = translate_chunk(Seq(), ["x1", "x2", "x3"], "", S)
    assert o.out_items == ["b", "c", None]


def test_never_json_fails_all():
    o = translate_chunk(Fixed("no"), ["x1", "x2"], "", S)
    assert (o.status, o.out_items) == ("failed", [None, None])


def test_fault_once_then_good():
    items = ["abcd"]  # len 4 -> fault class 4
    o = translate_chunk(ScriptedFaultTranslator(), items, "", S)
    assert (o.status, o.attempts) == ("ok", 2)


@pytest.mark.parametrize("n,ok", [(1, True), (2, True), (3, False)])
def test_throttle_retries(n, ok):
    o = translate_chunk(ThrottlingTranslator(n), ["日本"], "", S)
    assert (o.status == "ok") is ok
    if not ok:
        assert o.status == "error" and "throttled" in o.error


def test_other_error_fails_at_once():
    calls = []

    class Boom:
        def __call__(self, req):
            calls.append(req.call_attempt)
            raise ValueError("bad request")
    o = translate_chunk(Boom(), ["日本"], "", S)
    assert o.status == "error" and calls == [0]


def test_single_fallback_blank_keeps_original():
    class Blank:
        def __call__(self, req):
            return ModelReply("   ", 1, 1)
    assert translate_text(Blank(), "日本", "", S)[0] == "日本"
    assert translate_text(MockTranslator(), "  ", "", S)[0] == "  "


def test_best_partial_of_a_table_equals_the_task(spark):
    """W3 as an aggregation: unequal partials, blank items, a full reply after a longer wrong one."""
    import random
    from lexiflow.operators.call import best_partial
    rnd = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        n = rnd.randint(1, 4)
        replies = []
        for a in range(1, 4):
            items = rnd.choice([None, [], [rnd.choice(["a", "b", " ", ""]) for _ in range(rnd.randint(1, 6))]])
            replies.append(items)
            rows.append((k, a, n, items))
            if items is not None and len(items) == n:
                break

        class Seq:
            def __init__(self):
                self.left = iter(replies)

            def __call__(self, req):
                import json
                x = next(self.left)
                return ModelReply("no" if x is None else json.dumps(x), 0, 0)
        o = translate_chunk(Seq(), [f"x{i}" for i in range(n)], "", S)
        want[k] = (o.attempts, o.status, o.out_items)
    df = spark.createDataFrame(rows, "k int, attempt int, n int, items array<string>")
    assert {r.k: (r.attempts, r.status, r.out_items) for r in best_partial(df, ["k"]).collect()} == want


def test_an_interrupted_run_pays_no_wave_twice(spark, tmp_path, monkeypatch):
    from lexiflow.operators.batch import batch_translate
    from lexiflow.session import WorkDir, work_dir
    class Counting:
        """Notes every call as a file (tasks are other processes)."""

        def __init__(self, folder):
            self.folder = folder

        def __call__(self, req):
            import os
            import uuid
            if req.kind == "batch":
                open(os.path.join(self.folder, uuid.uuid4().hex), "w").write(req.items[0])
            return MockTranslator()(req)

    calls = tmp_path / "calls"
    calls.mkdir()
    s = S.with_(chunk_max_strings=1, calls_per_wave=8, calls_per_task=2)
    units = spark.createDataFrame([(i % 5, i, f"日{i}", "c") for i in range(40)], "scope int, ord long, text string, context string")
    plain, done = WorkDir.materialize, []

    def interrupted(self, df, name, conf=None):
        if "/responses/" in name:
            if len(done) == 3:
                raise KeyboardInterrupt("driver lost")
            done.append(name)
        return plain(self, df, name, conf)
    monkeypatch.setattr(WorkDir, "materialize", interrupted)
    path = str(tmp_path / "work")
    with pytest.raises(KeyboardInterrupt):
        batch_translate(units, Counting(str(calls)), s, work_dir(spark, path, resume=True))
    first = len(list(calls.iterdir()))
    assert 0 < first < 40
    monkeypatch.setattr(WorkDir, "materialize", plain)
    res = batch_translate(units, Counting(str(calls)), s, work_dir(spark, path, resume=True))
    assert {r.text: r.text_en for r in res.translations.collect()} == {f"日{i}": mock_translate(f"日{i}") for i in range(40)}
    assert len(list(calls.iterdir())) == 40
    batch_translate(units, Counting(str(calls)), s, work_dir(spark, path, resume=True)).translations.count()
    assert len(list(calls.iterdir())) == 40


def counting_model(folder):
    class Counting:
        """Notes every call as a file (tasks are other processes)."""

        def __call__(self, req):
            import os
            import uuid
            open(os.path.join(str(folder), uuid.uuid4().hex), "w").write(req.items[0])
            return MockTranslator()(req)
    return Counting()


def numbered(spark, n):
    return spark.createDataFrame([(i % 5, i, f"日{i}", "c") for i in range(n)], "scope int, ord long, text string, context string")


WAVES = S.with_(chunk_max_strings=1, calls_per_wave=8, calls_per_task=2)


def test_a_rerun_with_fewer_rows_returns_exactly_its_rows(spark, tmp_path):
    from lexiflow.operators.batch import batch_translate
    from lexiflow.session import work_dir
    for n in (40, 3, 0, 17):
        res = batch_translate(numbered(spark, n), MockTranslator(), WAVES, work_dir(spark, str(tmp_path / "same")))
        assert {r.text for r in res.translations.collect()} == {f"日{i}" for i in range(n)}
        assert res.responses.count() == n


def test_waves_read_the_dealt_calls_once(spark, tmp_path):
    """Every wave reads its own folder: the paths of all waves together are the dealt table, each file once."""
    from lexiflow.operators.call import call_chunks
    from lexiflow.operators.queue import PaidQueue
    from lexiflow.session import work_dir
    w = work_dir(spark, str(tmp_path / "w"))
    calls = w.materialize(spark.range(100).selectExpr("cast(id % 7 as int) scope", "id chunk_id", "'c' context", "array(concat('日', id)) items"), "calls")
    q = PaidQueue(w, calls, "replies", ["scope", "chunk_id"], 9)
    waves = q._dealt()
    files = [f for x in waves for f in x.input.inputFiles()]
    assert len(files) == len(set(files)) and all(f"wave={x.number}/" in f for x in waves for f in x.input.inputFiles())
    assert sum(x.rows for x in waves) == 100 == sum(x.input.count() for x in waves) and len(waves) > 5
    got = q.run(lambda c, n: call_chunks(c, MockTranslator(), S, n))
    assert sorted(r.items[0] for r in got.select("items").collect()) == sorted(f"日{i}" for i in range(100))
    other = PaidQueue(w, w.materialize(calls.where("chunk_id < 3"), "fewer"), "replies", ["scope", "chunk_id"], 9)
    assert other.run(lambda c, n: call_chunks(c, MockTranslator(), S, n)).count() == 3


def test_a_killed_run_pays_for_open_waves_only(spark, tmp_path, monkeypatch):
    from lexiflow.operators import queue
    from lexiflow.operators.batch import batch_translate
    from lexiflow.session import work_dir
    calls = tmp_path / "calls"
    calls.mkdir()
    path, plain, seen = str(tmp_path / "work"), queue.write_whole, []

    def lost(spark, to, text):
        if len(seen) == 2:
            raise KeyboardInterrupt("driver lost between a wave and its manifest")
        seen.append(to)
        plain(spark, to, text)
    monkeypatch.setattr(queue, "write_whole", lost)
    with pytest.raises(KeyboardInterrupt):
        batch_translate(numbered(spark, 40), counting_model(calls), WAVES, work_dir(spark, path, resume=True))
    first = len(list(calls.iterdir()))
    assert 0 < first < 40
    monkeypatch.setattr(queue, "write_whole", plain)
    w = work_dir(spark, path, resume=True)
    res = batch_translate(numbered(spark, 40), counting_model(calls), WAVES, w)
    assert {r.text for r in res.translations.collect()} == {f"日{i}" for i in range(40)}
    assert len(list(calls.iterdir())) == 40              # the wave without a manifest was whole: not paid again
    # other settings of a reply are another run
    batch_translate(numbered(spark, 40), counting_model(calls), WAVES.with_(reject_blank=True), work_dir(spark, path, resume=True))
    assert len(list(calls.iterdir())) == 80


def test_usage_of_the_manifests_equals_the_responses(spark, tmp_path):
    from lexiflow.models import ScriptedFaultTranslator
    from lexiflow.operators.batch import batch_translate
    from lexiflow.operators.estimate import usage_totals
    from lexiflow.session import work_dir
    for n, s in ((40, S.with_(chunk_max_strings=3, calls_per_wave=4)), (40, S), (0, S)):
        w = work_dir(spark)
        res = batch_translate(numbered(spark, n), ScriptedFaultTranslator(), s, w)
        want = usage_totals(res, settings=s).collect()[0]
        got = w.spent(s).collect()[0]
        assert (got.input_tokens, got.output_tokens, got.cost_usd) == (want.input_tokens, want.output_tokens, want.cost_usd)
        assert got.rows == res.responses.count() + res.singles.count()
        assert got.errors == res.errors.count()


@pytest.mark.parametrize("calls,cores,tasks", [(0, 12, 1), (5, 12, 5), (900, 12, 12), (5_000, 12, 50), (100_000, 12, 192), (6_000_000, 12, 192)])
def test_tasks_of_a_large_stage_follow_the_cores(calls, cores, tasks):
    # by the number of calls alone 6 M calls made 60,000 tasks of 20 KB of result each
    from lexiflow.operators.call import call_tasks
    assert call_tasks(calls, cores, S) == tasks
    assert call_tasks(calls, cores, S.with_(call_partitions=7)) == 7


def test_attempts_are_not_sorted_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from lexiflow.operators.call import best_partial
    a = spark.createDataFrame([(k, t, 2, ["x"] * ((k + t) % 4)) for k in range(40) for t in (1, 2, 3)], "k long, attempt int, n int, items array<string>")
    plan = best_partial(a, ["k"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "Aggregate" not in below and "Sort" not in below
    got = {r.k: (r.attempts, r.status) for r in best_partial(a.orderBy(F.desc("attempt"), F.rand(1)), ["k"]).collect()}
    for k in range(40):
        fits = [t for t in (1, 2, 3) if (k + t) % 4 == 2]
        assert got[k] == ((fits[0], "ok") if fits else (3, "partial"))
