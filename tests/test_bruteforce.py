"""Order-dependent operators against plain Python on generated input."""

import random

from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.scores import CONFIDENCE
from tessera.operators import graph, hybrid, lexical, paths, select

KINDS = ("import", "call", "require", "likelyTestCoverage", "extends")
POINTS = {"certain": 20, "high": 15, "medium": 8, "heuristic": -20}
BY_KIND = {"call": 12, "likelyTestCoverage": 10, "extends": 8, "import": 6, "require": 6}


def graph_rows(rnd, nodes, n):
    names = [rnd.choice(["src/api/", "src/", "t/tests/", "lib/"]) + f"n{i}.ts" for i in range(nodes)]
    return names, [(f"e{i:03}", rnd.choice(names), rnd.choice(names), rnd.choice(KINDS), "x", rnd.choice([*POINTS, "low", None]), rnd.choice(["ast", "heuristic", None])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, k, s, None, None, c, m) for i, a, b, k, s, c, m in rows], "id string, from_path string, to_path string, kind string, specifier string, from_symbol string, to_symbol string, confidence string, method string")


def is_sure(confidence, method):
    if method == "ast":
        return True
    if confidence in ("certain", "high"):
        return True
    if confidence in ("heuristic", "low"):
        return False
    return (method or "") not in ("heuristic", "unresolved")


def is_entry(p):
    parts = p.split("/")
    return any(x in ("controllers", "controller", "route", "routes", "http", "handler", "handlers", "api") for x in parts[1:-1]) or (len(parts) > 1 and parts[-1] in ("index.ts", "main.ts", "app.ts", "server.ts"))


def is_test(p):
    return "/tests/" in p or ".test." in p or ".spec." in p


def python_paths(rows, seed, depth, most_nodes, most_paths, fan_out):
    """A walk by sorting the whole frontier each time, over plain lists."""
    steps = {}
    for i, a, b, kind, _, c, m in rows:
        points = (50 if is_sure(c, m) else 0) + POINTS.get(c, 0) + BY_KIND[kind]
        for x, y in {(a, b), (b, a)}:
            steps.setdefault(x, {})[(y, i)] = (points, i, y, kind, c or "medium", is_sure(c, m))
    for x, found in steps.items():
        steps[x] = sorted(found.values(), key=lambda s: (-s[0], s[1]))[:fan_out]
    near, inside = {seed}, set()  # steps beyond the neighbourhood aren't seen
    for _ in range(depth):
        inside |= {(x, s) for x in near for s in steps.get(x, [])}
        near = {s[2] for x in near for s in steps.get(x, [])}
    around = {}
    for x, s in inside:
        around.setdefault(x, []).append(s)
    for x in around:
        around[x].sort(key=lambda s: (-s[0], s[1]))
    frontier, found, seen, order = [(-1000, 0, [seed], [])], [], {seed}, 0
    for _ in range(most_nodes):
        if not frontier or len(found) >= most_paths:
            break
        frontier.sort(key=lambda f: f[:2])
        priority, _, nodes, taken = frontier.pop(0)
        grown = False
        for s in around.get(nodes[-1], []) if len(taken) < depth else []:
            path = (nodes + [s[2]], taken + [s])
            if s[2] in nodes or (s[2] in seen and taken):
                found.append(path)
                continue
            seen.add(s[2])
            order += 1
            frontier.append((priority - s[0] + 5 * len(path[1]), order, *path))
            grown = True
            if is_entry(s[2]) or is_test(s[2]) or s[3] == "likelyTestCoverage":
                found.append(path)
        if not grown and taken:
            found.append((nodes, taken))
    best = {}
    for nodes, taken in found:
        sure = all(s[5] for s in taken)
        score = 100 - 8 * len(taken) + (40 if sure else -25) + 4 * min(CONFIDENCE[s[4]] for s in taken)
        score += 18 * any(map(is_entry, nodes)) + 22 * (any(map(is_test, nodes)) or any(s[3] == "likelyTestCoverage" for s in taken)) - 10 * (len(set(nodes)) < len(nodes))
        key = ">".join(nodes)
        if key not in best or score > best[key][0]:
            best[key] = (score, nodes)
    return sorted(best.values(), key=lambda p: (-p[0], len(p[1]), p[1]))[:most_paths]


def test_relationship_paths_equal_brute_force(spark):
    rnd = random.Random(21)
    for _ in range(3):
        names, rows = graph_rows(rnd, 14, 40)
        rows = [r for r in rows if r[1] != r[2]]
        budget = paths.Budget(depth=3, nodes=25, paths=9, fan_out=4)
        seeds = spark.createDataFrame([(n,) for n in names[:5]], "node string")
        got = {}
        for r in paths.relationship_paths(frame(spark, rows), seeds, budget).orderBy("seed", "path_id").collect():
            got.setdefault(r.seed, []).append((r.score, r.nodes))
        want = {s: python_paths(rows, s, 3, 25, 9, 4) for s in set(names[:5])}
        assert got == {s: w for s, w in want.items() if w}
        impact = {(r.seed, r.node) for r in paths.change_impact(frame(spark, rows), seeds, budget).collect()}
        reached = {(s, n) for s, found in want.items() for _, nodes in found for n in nodes if n != s}
        direct = {(s, n) for s in want for _, nodes in direct_callers(rows, s) for n in nodes if n != s}
        assert impact == reached | direct


def direct_callers(rows, seed):
    """The paths of one incoming step, best first; at most forty of each node's steps."""
    return [(0, [seed, a]) for _, a, b, *_ in rows if b == seed]


def python_seats(rows):
    seats = []
    for row in sorted(rows, key=lambda r: (-r[4], r[2], r[0])):
        met = next((k for k, s in enumerate(seats) if not (s[3] < row[2] or row[3] < s[2])), None)
        if met is None:
            seats.append(row)
        elif row[4] - seats[met][4] > 5 or (abs(row[4] - seats[met][4]) <= 5 and row[3] - row[2] < seats[met][3] - seats[met][2]):
            seats[met] = row
    return seats


def test_overlap_removal_equals_brute_force(spark):
    rnd = random.Random(22)
    rows = []
    for i in range(600):
        start = rnd.randint(1, 200)
        rows.append((f"h{i:03}", f"p{rnd.randint(0, 6)}", start, start + rnd.randint(0, 90), float(rnd.randint(0, 40))))
    hits = spark.createDataFrame(rows, "id string, path string, start_line int, end_line int, score double")
    want = sorted(s for p in {r[1] for r in rows} for s in python_seats([r for r in rows if r[1] == p]))
    assert sorted(tuple(r)[:5] for r in select.drop_overlaps(hits).select("id", "path", "start_line", "end_line", "score").collect()) == want
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3]}
    got = [(r.a, r.b) for r in select.overlap_pairs(hits).collect()]
    assert len(got) == len(pairs) and set(got) == pairs


def test_tightest_symbol_equals_brute_force(spark):
    rnd = random.Random(23)
    symbols = [(f"s{i}", f"p{i % 3}", a := rnd.randint(1, 300), a + rnd.randint(0, 150)) for i in range(80)]
    positions = [(f"p{i % 3}", i) for i in range(1, 400)]
    got = {(r.path, r.line): r.symbol for r in graph.tightest_symbol(spark.createDataFrame(positions, "path string, line int"), spark.createDataFrame(symbols, "id string, path string, start_line int, end_line int")).collect()}
    want = {}
    for path, line in positions:
        inside = [(s[3] - s[2], s[0]) for s in symbols if s[1] == path and s[2] <= line <= s[3]]
        if inside:
            want[path, line] = min(inside)[1]
    assert got == want


def test_search_equals_its_steps_by_hand(spark):
    """Candidates merged, scored, freed of overlaps and filled into a budget, by plain Python over the candidates' signals."""
    rnd = random.Random(24)
    words = ["refund", "order", "charge", "invoice", "total", "ship"]
    names = [f"src/{rnd.choice(words)}/{rnd.choice(words)}{i}.ts" for i in range(25)]
    cut = [(f"c{i}", rnd.choice(names), " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))), a := rnd.randint(1, 40), a + 10, "source", 1.0) for i in range(60)]
    symbols = [(f"s{i}", rnd.choice(words) + rnd.choice(["", "Order", "Total"]), rnd.choice(names), a := rnd.randint(1, 40), a + rnd.randint(0, 9)) for i in range(30)]
    edges = [(f"e{i}", rnd.choice(names), rnd.choice(names), rnd.choice(KINDS), "x", rnd.choice(["high", "low"]), "ast") for i in range(40)]
    frames = (
        spark.createDataFrame(cut, "id string, path string, text string, start_line int, end_line int, kind string, weight double"),
        spark.createDataFrame([(n, 100, i) for i, n in enumerate(names)], "path string, size long, mtime long"),
        spark.createDataFrame(symbols, "id string, name string, path string, start_line int, end_line int"),
        frame(spark, edges),
    )
    signals = [s for s in hybrid.SIGNALS if s != "generated_penalty"]
    merged = {}
    for r in hybrid.candidates(*frames, "refund order").collect():
        m = merged.setdefault(r.id, {"type": r.result_type, "path": r.path, "start": r.start_line, "end": r.end_line, "chars": r.chars, "sure": r.deterministic})
        m.update(start=min(m["start"], r.start_line), end=max(m["end"], r.end_line), chars=min(m["chars"], r.chars), sure=m["sure"] or r.deterministic)
        for s in hybrid.SIGNALS:
            if r[s] is not None:
                m[s] = max(m.get(s, r[s]), r[s])
    ranked = {i: sum(m.get(s, 0) for s in signals) - m.get("generated_penalty", 0) for i, m in merged.items()}
    rows = [(i, merged[i]["path"], merged[i]["start"], merged[i]["end"], score) for i, score in ranked.items() if score > 0]
    chosen, chars, taken = [], 0, {}
    seats = [s for p in {r[1] for r in rows} for s in with_seats([r for r in rows if r[1] == p])]
    for row, seat in sorted(seats, key=lambda s: (-s[1][4], s[0][1], s[1][2], s[1][0])):
        m = merged[row[0]]
        limit = select.BUDGETS.get(m["type"], 10**9)
        if len(chosen) < 15 and chars + m["chars"] <= select.MAX_CHARS and taken.get(m["type"], 0) < limit:
            chosen.append(row[0])
            chars += m["chars"]
            taken[m["type"]] = taken.get(m["type"], 0) + 1
    got = hybrid.search(*frames, "refund order", k=15).select("id", F.round("score", 6).alias("score")).collect()
    assert {r.id for r in got} == set(chosen) and len(got) == len(chosen)
    assert all(abs(r.score - ranked[r.id]) < 1e-5 for r in got)


def test_search_sees_all_text_hits(spark):
    """A chunk that many others beat by text alone is a candidate too; a pool of the best by text would miss it."""
    cut = [(f"c{i}", f"lib/other{i}.ts", "refund refund order", 1, 5, "source", 1.0) for i in range(120)] + [("mine", "src/refund/order.ts", "here an order is " + "told at length " * 20, 1, 9, "source", 1.0), ("none", "src/refund/x.ts", "nothing", 1, 9, "source", 1.0)]
    frames = (
        spark.createDataFrame(cut, "id string, path string, text string, start_line int, end_line int, kind string, weight double"),
        spark.createDataFrame([(c[1], 100, 1) for c in cut], "path string, size long, mtime long"),
        spark.createDataFrame([], "id string, name string, path string, start_line int, end_line int"),
        frame(spark, []),
    )
    every = {r.id: r for r in hybrid.candidates(*frames, "refund order").where("result_type = 'chunk'").collect()}
    assert set(every) == {f"chunk:{c[0]}" for c in cut} - {"chunk:none"}
    pooled = {r.id for r in hybrid.candidates(*frames, "refund order", lexical_pool=48).where("result_type = 'chunk'").collect()}
    assert len(pooled) == 48 and "chunk:mine" not in pooled
    ranks = {r.id: r.score for r in hybrid.ranked(hybrid.candidates(*frames, "refund order")).collect()}
    got = {r.id: r.score for r in hybrid.search(*frames, "refund order", k=10).collect()}
    assert len(got) == 10 and min(got.values()) >= sorted(ranks.values())[-10] - 1e-9  # one path a chunk: nothing overlaps, and the budget is wide


def test_search_reads_each_text_once(spark):
    """What a text adds comes of the pass that counts its terms, and is what the scores give on their own."""
    seen = spark.sparkContext.accumulator(0)

    def told(t):
        seen.add(1)
        return t

    texts = ["refund " * 60, "an order\n" * 40, "nothing here", None, "", "refund of an order", "refunds ordered", "x" * 2000 + " order refund refund"]
    raw = spark.createDataFrame([(f"c{i}", f"lib/{i}.ts", t, 1, 5, "source", 1.0) for i, t in enumerate(texts)], "id string, path string, text string, start_line int, end_line int, kind string, weight double")
    frames = (
        spark.createDataFrame([(f"lib/{i}.ts", 100, 1) for i in range(len(texts))], "path string, size long, mtime long"),
        spark.createDataFrame([], "id string, name string, path string, start_line int, end_line int"),
        frame(spark, []),
    )
    got = {r.id: r for r in hybrid.candidates(raw.withColumn("text", F.udf(told, "string")("text")), *frames, "refund order refund").where("result_type = 'chunk'").collect()}
    assert seen.value == len(texts)
    alone = raw.select("id", scores.overlap_score("refund order refund", F.col("text")).alias("overlap"), scores.repetition_penalty(F.col("text")).alias("repeats"), F.least(F.length("text"), F.lit(1500)).alias("chars"))
    want = {f"chunk:{r.id}": r for r in lexical.bm25(raw, "refund order refund").join(alone, "id").collect()}
    assert set(got) == set(want) == {f"chunk:c{i}" for i in (0, 1, 5, 7)}
    for i, r in want.items():
        assert (got[i].chars, got[i].generated_penalty) == (r.chars, r.repeats) and abs(got[i].lexical - min(45, r.score * 3 + r.overlap)) < 1e-9


def with_seats(rows):
    """(kept, the row that took the seat first)."""
    seats = []
    for row in sorted(rows, key=lambda r: (-r[4], r[2], r[0])):
        met = next((k for k, (s, _) in enumerate(seats) if not (s[3] < row[2] or row[3] < s[2])), None)
        if met is None:
            seats.append((row, row))
        elif row[4] - seats[met][0][4] > 5 or (abs(row[4] - seats[met][0][4]) <= 5 and row[3] - row[2] < seats[met][0][3] - seats[met][0][2]):
            seats[met] = (row, seats[met][1])
    return seats
