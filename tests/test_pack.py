"""The split packer equals plain sequential next-fit."""

import random

import pytest

from lexiflow.config import DEFAULT
from lexiflow.operators.pack import _Greedy, pack_chunks


def next_fit(ests, budget, most):
    """Chunk of every unit, checked as a property: a unit joins the open chunk exactly when it fits."""
    chunks = []
    for e in ests:
        if chunks and len(chunks[-1]) < most and sum(chunks[-1]) + e <= budget:
            chunks[-1].append(e)
        else:
            chunks.append([e])
    return [i for i, c in enumerate(chunks) for _ in c]


def _expected(ests, B, K):
    idx = next_fit(ests, B, K)
    out, pos, prev = [], 0, None
    for i, k in enumerate(idx):
        pos = pos + 1 if k == prev else 1
        prev = k
        out.append((k + 1, pos))
    return out


def test_worked_examples():
    # 81 short strings -> chunks of 80 and 1
    assert next_fit([20] * 81, 6000, 80).count(0) == 80
    # one string estimated at 7,000, then a short one -> two chunks
    assert next_fit([7000, 20], 6000, 80) == [0, 1]
    # oversize string in the middle gets its own chunk
    assert next_fit([10, 7000, 10], 6000, 80) == [0, 1, 2]


def test_greedy_matches_loop():
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randint(1, 60)
        ests = [rnd.choice([15, 20, 50, 120, 400]) for _ in range(n)]
        B, K = rnd.choice([(300, 8), (500, 3), (6000, 80)])
        g = _Greedy(__import__("numpy").array(ests), B, K)
        starts = g.starts_from(0)
        idx = next_fit(ests, B, K)
        assert starts == [i for i in range(n) if i == 0 or idx[i] != idx[i - 1]]


@pytest.mark.parametrize("seg_units", [1, 3, 7, 50_000])
def test_split_packing_equals_sequential(spark, seg_units):
    rnd = random.Random(seg_units)
    rows, expect = [], {}
    for scope in range(12):
        n = rnd.randint(1, 70)
        ords = sorted(rnd.sample(range(0, 400), n))
        ests = [rnd.choice([15, 16, 40, 90, 310]) for _ in range(n)]
        for o, e in zip(ords, ests):
            rows.append((scope, o, e))
        for o, (c, p), in zip(ords, _expected(ests, 300, 8)):
            expect[(scope, o)] = (c, p)
    s = DEFAULT.with_(chunk_token_budget=300, chunk_max_strings=8, pack_segment_units=seg_units)
    df = spark.createDataFrame(rows, "scope long, ord long, est int")
    got = {(r.scope, r.ord): (r.chunk_no, r.pos) for r in pack_chunks(df, s).collect()}
    assert got == expect
    # chunk_id is the ord of the chunk's first unit
    for r in pack_chunks(df, s).collect():
        first = [o for (sc, o), (c, p) in expect.items() if sc == r.scope and c == r.chunk_no and p == 1]
        assert first == [r.chunk_id]


@pytest.mark.parametrize("seg_units", [1, 4, 50_000])
def test_chunk_rows_equal_assignments(spark, seg_units):
    from pyspark.sql import functions as F
    from lexiflow.operators.pack import pack_chunk_rows
    rnd = random.Random(10 + seg_units)
    rows = []
    for scope in range(9):
        for o in sorted(rnd.sample(range(0, 300), rnd.randint(1, 60))):
            rows.append((scope, o, rnd.choice([15, 16, 40, 90, 310]), f"t{scope}-{o}", f"c{scope}"))
    s = DEFAULT.with_(chunk_token_budget=300, chunk_max_strings=8, pack_segment_units=seg_units)
    df = spark.createDataFrame(rows, "scope long, ord long, est int, text string, context string")
    asg = {(r.scope, r.ord): (r.chunk_id, r.chunk_no, r.pos) for r in pack_chunks(df, s).collect()}
    got = {}
    for r in pack_chunk_rows(df, s).collect():
        assert r.context == f"c{r.scope}" and len(r.items) <= 8
        for i, (o, t) in enumerate(zip(r.ords, r.items)):
            assert t == f"t{r.scope}-{o}"
            got[(r.scope, o)] = (r.chunk_id, r.chunk_no, i + 1)
    assert got == asg


def test_split_packing_property(spark):
    """Hypothesis: any units, any segment size -> same chunks as sequential next-fit."""
    from hypothesis import given, settings as hsettings, strategies as st

    @hsettings(max_examples=12, deadline=None)
    @given(st.lists(st.integers(15, 400), min_size=1, max_size=40), st.integers(1, 9),
           st.integers(100, 700), st.integers(1, 6))
    def check(ests, seg, budget, k):
        rows = [(0, i * 3, e) for i, e in enumerate(ests)]
        s = DEFAULT.with_(chunk_token_budget=budget, chunk_max_strings=k, pack_segment_units=seg)
        df = spark.createDataFrame(rows, "scope long, ord long, est int")
        got = [r.chunk_no - 1 for r in sorted(pack_chunks(df, s).collect(), key=lambda r: r.ord)]
        assert got == next_fit(ests, budget, k)

    check()


def test_sparse_orders_make_dense_segments(spark):
    """Cells far apart, negative and near 2**62 are consecutive units of few segments."""
    rows = [(s, o, 20) for s in ("a", "b") for o in [-(2**62), -5, *[(r << 20) + c for r in range(500) for c in range(2)], 2**62]]
    df = spark.createDataFrame(rows, "scope string, ord long, est int")
    got = {(r.scope, r.ord): r.chunk_no for r in pack_chunks(df, DEFAULT.with_(chunk_max_strings=80, pack_segment_units=90)).collect()}
    orders = sorted({o for _, o, _ in rows})
    for s in ("a", "b"):
        assert [got[s, o] - 1 for o in orders] == next_fit([20] * len(orders), 6000, 80)


def test_maps_compose_like_one_walk():
    """Any cut of any units: composing the maps of the parts gives the map of the whole, and associates."""
    from lexiflow.operators.pack import _Map
    rnd = random.Random(5)
    for _ in range(200):
        k, budget = rnd.randint(1, 6), rnd.randint(100, 700)
        ests = [rnd.randint(15, 400) for _ in range(rnd.randint(3 * k, 60))]
        ords = [i * 3 for i in range(len(ests))]
        cut = sorted({0, len(ests), *(rnd.randrange(0, len(ests) // k) * k for _ in range(4))})
        maps = [_Map.of_units(ests[a: b + k], ords[a: b + k], b - a, a, budget, k) for a, b in zip(cut, cut[1:])]
        whole = _Map.of_units(ests, ords, len(ests), 0, budget, k)
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = m.then(right)
        starts = _Greedy(ests, budget, k).starts_from(0)
        for got in (left, right, whole):
            assert (got.chunks[0], got.last[0], got.last_ord[0]) == (len(starts), starts[-1], ords[starts[-1]])


@pytest.mark.parametrize("fan", [3])
def test_deep_trees_and_byte_bounds_equal_sequential(spark, monkeypatch, fan):
    """Many levels, text segments of a few units, scopes of one segment beside them; texts come back in order."""
    from lexiflow.operators import pack
    monkeypatch.setattr(pack, "FAN", fan)
    rnd = random.Random(fan)
    rows, want = [], {}
    for scope, n in enumerate((1, 5, 400, 37, 260, 8, 16, 17)):
        ords = sorted(rnd.sample(range(-10_000, 10_000), n))
        ests = [rnd.choice([15, 16, 40, 90, 310]) for _ in range(n)]
        for o, e, (c, p) in zip(ords, ests, _expected(ests, 300, 8)):
            rows.append((scope, o, e, f"t{o}" + "x" * rnd.randint(0, 20), f"c{scope}"))
            want[scope, o] = (c, p)
    df = spark.createDataFrame(rows, "scope long, ord long, est int, text string, context string")
    text = {(r[0], r[1]): r[3] for r in rows}
    for units, size in ((16, 1 << 20), (16, 90), (1000, 300)):
        s = DEFAULT.with_(chunk_token_budget=300, chunk_max_strings=8, pack_segment_units=units, pack_segment_bytes=size)
        got = {}
        for r in pack.pack_chunk_rows(df.repartition(3), s).collect():
            assert r.context == f"c{r.scope}" and r.chunk_id == r.ords[0]
            for i, (o, t) in enumerate(zip(r.ords, r.items)):
                assert t == text[r.scope, o] and (r.scope, o) not in got
                got[r.scope, o] = (r.chunk_no, i + 1)
        assert got == want


def test_no_task_reads_all_segments_of_a_scope(spark, monkeypatch):
    """The groups of the tree hold at most FAN maps and their entry."""
    from lexiflow.operators import pack
    monkeypatch.setattr(pack, "FAN", 4)
    plain = pack._grouped
    sizes = []

    def watched(df, keys, order, solve, schema):
        if "parent" in keys:
            sizes.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return plain(df, keys, order, solve, schema)
    monkeypatch.setattr(pack, "_grouped", watched)
    df = spark.range(500).selectExpr("'s' scope", "id ord", "20 est")
    s = DEFAULT.with_(chunk_token_budget=300, chunk_max_strings=8, pack_segment_units=10)
    got = {r.ord: r.chunk_no - 1 for r in pack.pack_chunks(df, s).collect()}
    assert [got[i] for i in range(500)] == next_fit([20] * 500, 300, 8)
    assert len(sizes) >= 4 and max(sizes) <= 5


@pytest.mark.parametrize("cut", [1, 3, 10_000])
def test_whole_scopes_are_packed_as_arrow_columns(cut):
    """Groups may be cut by a batch's end; the lists are slices of the columns and equal sequential next-fit."""
    import pyarrow as pa

    from lexiflow.operators.pack import whole_chunk_rows
    rnd = random.Random(cut)
    scopes = {f"s{k}": [rnd.choice([15, 16, 40, 90, 310]) for _ in range(rnd.choice([1, 2, 8, 9, 40]))] for k in range(9)}
    rows = [(s, 3 * i, e, f"{s}-{i}", f"c{s}" if i == 0 else "other") for s, ests in scopes.items() for i, e in enumerate(ests)]
    names = ["scope", "ord", "est", "text", "context"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + cut]), types)], names) for at in range(0, len(rows), cut)]
    got = [r for b in whole_chunk_rows(iter([*batches, batches[0].slice(0, 0)]), 300, 8) for r in b.to_pylist()]
    want = []
    for s, ests in scopes.items():
        idx = next_fit(ests, 300, 8)
        for k in range(idx[-1] + 1):
            own = [i for i, c in enumerate(idx) if c == k]
            want.append({"scope": s, "chunk_id": 3 * own[0], "chunk_no": k + 1, "context": f"c{s}", "ords": [3 * i for i in own],
                         "items": [f"{s}-{i}" for i in own]})
    assert got == want
