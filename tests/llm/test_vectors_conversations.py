"""Top-k search, whitening and conversation repair against brute force, and their defined cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import conversation_repair as repair
from tessera.llm import topk_search as search
from tessera.llm import whitening

VECTORS = "vec_id bigint, embedding array<double>, score string"


def search_by_hand(rows, k, scale):
    """(query_id, rank, vec_id, score) of rows (id, vector), row by row."""
    fine = [(i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(fine):
        if i is None or i % 100:
            continue
        scores = [(min(max(sum(a * b for a, b in zip(v, w, strict=False)), -search.LONG), search.LONG), j) for other, (j, w) in enumerate(fine) if other != at]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()], key=str)


@pytest.mark.parametrize("tile_bytes, fan", [(4 << 20, 16), (512, 2)])
def test_search_against_brute_force(spark, tile_bytes, fan):
    rng = random.Random(3)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.001, 0.5, 1.0]) for _ in range(3)]) for i in range(0, 1500, 7)]
    rows += [(i, hot) for i in range(3000, 3120)]  # copies tie everywhere
    rows += [(100, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (700, hot), (700, [0.0, 0.0, 9.0])]  # repeated ids, copies of a query
    rows += [(None, [1.0, 1.0, 1.0]), (None, hot), (8, None), (9, [1.0, None, 1.0]), (10, [float("nan"), 0.0, 0.0]), (11, [float("inf")] * 3)]
    rows += [(800, []), (900, [1.0]), (13, [1.0, 1.0, 1.0, 5.0]), (1000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = search.top_k(df, df.vec_id % 100 == 0, k=5, tile_bytes=tile_bytes, fan=fan)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == search_by_hand(rows, 5, 1024)


def test_search_beyond_doubles(spark):
    """Sums that a double doesn't hold are exact; what a long doesn't hold is cut to its ends."""
    rows = [(0, [2.0**10, 3.0, 1.0]), (1, [2.0**28, 1.0, 0.001]), (2, [2.0**28, 1.0, 0.0]), (3, [-1e300, 0.0, 0.0]), (4, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)
    got = found(search.top_k(df, df.vec_id % 100 == 0))
    assert got == search_by_hand(rows, 10, 1024)
    assert [r[2] for r in got] == [4, 1, 2, 3] and got[0][3] == search.LONG


def test_search_small_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert search.top_k(empty, empty.vec_id % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0], "")], VECTORS)
    assert search.top_k(one, one.vec_id % 100 == 0).count() == 0
    none_asks = spark.createDataFrame([(1, [1.0], ""), (None, [2.0], "")], VECTORS)
    assert search.top_k(none_asks, none_asks.vec_id % 100 == 0).count() == 0


def test_partial_selection():
    rng = np.random.default_rng(5)
    scores = rng.integers(-3, 4, (40, 90))
    for most in (1, 7, 90, 200):
        expected = np.array([sorted(range(90), key=lambda j, i=i: (-scores[i, j], j))[:most] for i in range(40)])
        assert (search.select(scores, most) == expected).all()


# ------------------------------------------------------------------ whitening


def whiten_by_hand(rows, width, most=16):
    """vec_id to (n, deviation, whitened, explained), one entry a component."""
    fine = [(i, [math.floor(64 * x) + 1_000_000 for x in v] + [1_000_000] * (width - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = lambda x: [n * a - s for a, s in zip(x, total, strict=True)]
    centred = np.array([exact(x) for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-9 * values[0]).sum()))
    out = []
    for i, x in fine:
        white = np.array(exact(x), float) / n @ vectors[:, :kept] / np.sqrt(values[:kept])
        out.append((i, n, sum(d * d for d in exact(x)), white, values[:kept] / values.sum()))
    return out


@pytest.mark.parametrize("width, count", [(3, 60), (20, 2500)])
def test_whitening_against_brute_force(spark, monkeypatch, width, count):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 8)  # several blocks each way
    monkeypatch.setattr(whitening, "MIDDLE", 2)
    rng = np.random.default_rng(11)
    mixed = rng.normal(0, 0.3, (count, width)) * (1 + np.arange(width))
    rows = [(i, list(map(float, v))) for i, v in enumerate(mixed)]
    rows += [(count + i, rows[0][1]) for i in range(count)]  # one vector in half of the rows counts once
    rows += [(-1, None), (-2, [None] * width), (-3, [float("nan")] * width), (-4, [1.0] * (width - 1))]
    expected = {i: (n, d, w, e) for i, n, d, w, e in whiten_by_hand(rows, width)}
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(5)
    got = whitening.whiten(df).toPandas()
    assert sorted(set(got.vec_id)) == sorted(expected)
    signs = defaultdict(set)
    for i, part in got.groupby("vec_id"):
        n, deviation, white, share = expected[i]
        part = part.sort_values("component")
        assert part.component.tolist() == list(range(1, len(white) + 1))
        assert set(part.n) == {n} and set(part.deviation) == {deviation}
        np.testing.assert_allclose(np.abs(part.whitened), np.abs(white), atol=1e-9)
        np.testing.assert_allclose(part.explained, share, rtol=1e-9)
        for c, (a, b) in enumerate(zip(part.whitened, white, strict=True)):
            if abs(b) > 1e-6:
                signs[c].add(a * b > 0)
    assert all(len(s) == 1 for s in signs.values())
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_small_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, ""), (2, [], "")], VECTORS)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], ""), (None, [1.0, 2.0], "")], VECTORS)
    assert whitening.whiten(same).count() == 0  # no variance
    line = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [2.0, 4.0], ""), (None, [3.0, 6.0], "")], VECTORS)
    got = whitening.whiten(line).toPandas()
    assert got.component.tolist() == [1, 1, 1] and got.vec_id.isna().sum() == 1
    np.testing.assert_allclose(sorted(got.whitened), [-math.sqrt(1.5), 0, math.sqrt(1.5)], atol=1e-12)
    assert got.explained[0] == pytest.approx(1)


def test_whitening_of_large_components(spark):
    """What no long holds: entries are cut to 2**40, a deviation is null; the second dimension's variance is a rounding error."""
    df = spark.createDataFrame([(1, [1e300, 0.0], ""), (2, [-1e300, 1.0], ""), (3, [0.0, 2.0], "")], VECTORS)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 3 and got.deviation.isna().sum() == 2 and np.isfinite(got.whitened).all()


# ------------------------------------------------------------------ conversation repair

STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def cheapest(rows, faults):
    """Dijkstra's search over (row, place) by (cost, audit)."""
    done, heap = set(), [(0, "", 0, "0", ())]
    while heap:
        cost, audit, i, place, out = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in "0a":
            return cost, audit, out
        moves = [(2, "I", i, x, (NAMES[x], "")) for x in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, place, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                moves += [(more, "K", i + 1, role[:1], (role, text))] + [(2 + more, "R", i + 1, x, (NAMES[x], text)) for x in "ua"]
        for price, letter, to, initial, row in moves:
            if (place, initial) in STEPS:
                heapq.heappush(heap, (cost + price, audit + letter, to, STEPS[place, initial], (*out, row)))


def repair_by_hand(rows):
    expected = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            core = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        cost, audit, out = cheapest(turns, faults)
        expected[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return expected


TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, pos int"


def made_turns(seed=2, conversations=120):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "umpire", "", None]
    texts = ["Yes.", "No!", "Well?", "and then", "so", "", " \t\n", None, "...", "é.\n\n", "\U0001f600", "x. y"]
    rows = [(c, rng.choice([t, t, t, None, 2]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts)) for c in range(conversations) for t in range(rng.choice([1, 2, 5, 9]))]
    rows += [(None, t, "user", "Hi.") for t in (None, 3, 9)]
    rows += [(9001, t, rng.choice(roles[:3]), rng.choice(["a.", "b", f"c{t}.", f"d{t}"])) for t in range(300)]  # a long conversation
    rows += [(9002, 5, "user", "The same.")] * 40  # one row many times
    gone = next(c for c in range(9100, 9900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Gone.")], gone


@pytest.mark.parametrize("segment, fan", [(2048, 16), (4, 2)])
def test_repair_against_brute_force(spark, segment, fan):
    rows, gone = made_turns()
    expected = repair_by_hand(rows)
    assert expected[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    got = repair.digests(repair.repair(repair.damage(df), df, segment, fan)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "One?"), (1, 2, "user", "Two?"), (2, 0, "assistant", ""), (3, 0, "user", "Well.")], "conv_id long, turn long, role string, text string")
    got = repair.repaired_rows(repair.repair(df, df)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "system", "Be kind."), (1, 1, "user", "One?"), (1, 2, "assistant", "Two?"), (3, 0, "user", "Well."), (3, 1, "assistant", "")]


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.digests(repair.repair(repair.damage(empty), empty)).count() == 0


def test_every_split_gives_the_same_cells():
    """The chart splits spans in their middle; CYK over all splits agrees, cell by cell."""
    rng = random.Random(8)
    for _ in range(60):
        kinds = "".join(rng.choice("sSuUaAoOx") for _ in range(rng.randint(1, 14)))
        n, table = len(kinds), {}
        for length in range(1, n + 1):
            for i in range(n - length + 1):
                if length == 1:
                    table[i, i + 1] = repair.leaf(kinds[i])
                    continue
                splits = [repair.joined(table[i, m], table[m, i + length]) for m in range(i + 1, i + length)]
                assert all(s == splits[0] for s in splits)
                table[i, i + length] = splits[0]
        assert repair.chart(kinds) == table[0, n] == repair.short_span(kinds)
