"""Contours, registration, nesting, leaders, paths and pages against brute force; hot and empty cases included."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawlake.functions import usage
from drawlake.operators import compare, curves, labellings, leaders, nesting, pages, paths, register

CURVE = "case_id int, ord int, kind string, sx double, sy double, ex double, ey double, cx double, cy double, radius double, start_angle double, sweep double, length double"


def line(case, k, sx, sy, ex, ey):
    return (case, k, "LINE", sx, sy, ex, ey, None, None, None, None, None, math.hypot(ex - sx, ey - sy))


def arc(case, k, cx, cy, r, start, sweep):
    at = lambda a: (cx + r * math.cos(a), cy + r * math.sin(a))
    return (case, k, "ARC", *at(start), *at(start + sweep), cx, cy, r, start, sweep, r * abs(sweep))


def far(px, py, c):
    """Distance by dense samples of the curve, refined once."""
    def at(t):
        if c[2] == "LINE":
            return c[3] + t * (c[5] - c[3]), c[4] + t * (c[6] - c[4])
        return c[7] + c[9] * math.cos(c[10] + c[11] * t), c[8] + c[9] * math.sin(c[10] + c[11] * t)

    d = lambda t: math.hypot(px - at(t)[0], py - at(t)[1])
    best = min(range(401), key=lambda i: d(i / 400)) / 400
    low, high = max(0, best - 1 / 400), min(1, best + 1 / 400)
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if d(a) < d(b) else (a, high)
    return min(d(0), d(1), d((low + high) / 2))


@pytest.fixture(scope="module")
def drawing():
    rng = random.Random(5)
    shapes = []
    for k in range(120):  # most of a hot case lies in one corner
        x, y = (rng.uniform(0, 3), rng.uniform(0, 3)) if k % 4 else (rng.uniform(0, 200), rng.uniform(0, 200))
        size = rng.uniform(0.1, 2) if k % 10 else 60.0
        shapes.append(line(1, k, x, y, x + rng.uniform(-size, size), y + rng.uniform(-size, size)) if k % 3 else arc(1, k, x, y, size, rng.uniform(-3, 3), rng.uniform(-5, 5)))
    shapes += [line(2, 0, 0.0, 0.0, 10.0, 0.0), arc(2, 1, 0.0, 0.0, 5.0, 0.0, math.pi)]
    spots = [(1, k, rng.uniform(-300, 500), rng.uniform(-300, 500)) for k in range(25)] + [(1, 100 + k, rng.uniform(0, 3), rng.uniform(0, 3)) for k in range(25)]
    return shapes, spots + [(2, 0, 1.0, 1.0), (2, 1, -900.0, 4.0), (3, 0, 1.0, 1.0)]


def test_k_nearest_curves_equal_brute_force(spark, drawing):
    shapes, spots = drawing
    points = spark.createDataFrame(spots, "case_id int, point int, px double, py double")
    table = spark.createDataFrame(shapes, CURVE)
    got = {}
    for r in curves.nearest_k(points, table, 3, ["point"]).collect():
        got.setdefault((r.case_id, r.point), {})[r["rank"]] = (r.distance, r.ord)
    assert (3, 0) not in got and len(got) == len(spots) - 1
    for case, point, px, py in spots[:-1]:
        want = sorted((far(px, py, c), c[1]) for c in shapes if c[0] == case)[:3]
        assert [d for d, _ in want] == pytest.approx([got[case, point][k + 1][0] for k in range(len(want))], abs=1e-6)
        assert len(got[case, point]) == len(want)
    assert curves.nearest_k(points, table.limit(0), 2, ["point"]).collect() == []
    assert curves.nearest_k(points.limit(0), table, 2, ["point"]).collect() == []


def test_nearest_curves_in_bounded_and_large_cases(spark, monkeypatch):
    rng = random.Random(11)
    shapes = []
    for case, n in ((1, 40), (2, 6)):
        for i in range(n):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            ids = (case, i // 2 if case == 2 else i)  # ids of case 2 repeat
            shapes.append(line(*ids, x, y, x + 4, y - 3) if i % 3 else arc(*ids, x, y, 5.0, 0.5, 2.0))
    spots = [(case, i % 25, rng.uniform(-20, 80), rng.uniform(-20, 80)) for case in (1, 2, 3) for i in range(30)]  # so do those of points
    points, table = spark.createDataFrame(spots, "case_id int, point int, px double, py double"), spark.createDataFrame(shapes, CURVE)
    ways = {}
    for case, point, px, py in spots:
        for c in (c for c in shapes if c[0] == case):
            ways.setdefault((case, point), {}).setdefault(c[1], []).append(far(px, py, c))
    want = {k: sorted((min(d), i) for i, d in v.items())[:4] for k, v in ways.items()}
    lists, single = curves.nearest_k(points, table, 4, ["point"]), curves.nearest(points, table, ["point"])
    assert "_cell" not in lists._jdf.queryExecution().toString() + single._jdf.queryExecution().toString()
    monkeypatch.setattr(curves, "MOST_SHAPES", 20)
    for rows, one in ((lists, single), (curves.nearest_k(points, table, 4, ["point"]), curves.nearest(points, table, ["point"]))):
        got = {}
        for r in rows.orderBy("rank").collect():
            got.setdefault((r.case_id, r.point), []).append((r.distance, r.ord))
        assert got.keys() == want.keys()
        for key, near in want.items():
            assert [i for _, i in got[key]] == [i for _, i in near] and [d for d, _ in got[key]] == pytest.approx([d for d, _ in near], abs=1e-6)
        assert {(r.case_id, r.point): r.distance for r in one.collect()} == pytest.approx({k: v[0][0] for k, v in want.items()}, abs=1e-6)


def test_crossings_of_lines_and_arcs(spark):
    shapes = [line(1, 0, -10.0, 0.5, 10.0, 0.5), arc(1, 1, 0.0, 0.0, 5.0, 0.0, math.pi), arc(1, 2, 4.0, 0.0, 5.0, 0.0, 2 * math.pi - 1e-6), line(1, 3, 0.0, -8.0, 0.0, 8.0), line(1, 4, 0.0, 8.0, 3.0, 8.0)]
    got = Counter((r.first, r.second) for r in curves.crossings(spark.createDataFrame(shapes, CURVE), 2.0).select(F.col("first"), F.col("second")).collect())
    assert got == {(0, 1): 2, (0, 2): 2, (0, 3): 1, (1, 2): 1, (1, 3): 1, (2, 3): 2}
    assert curves.crossings(spark.createDataFrame([], CURVE), 2.0).collect() == []


def test_area_and_reflection(spark):
    half = [line(1, 0, -5.0, 0.0, 5.0, 0.0), arc(1, 1, 0.0, 0.0, 5.0, 0.0, math.pi)]
    table = spark.createDataFrame(half, CURVE)
    assert curves.signed_area(table).first().area == pytest.approx(math.pi * 12.5)
    turned = curves.turned(table, (0, 1, 1, 0))
    assert curves.signed_area(turned).first().area == pytest.approx(-math.pi * 12.5)
    assert turned.where("kind = 'ARC'").first().sweep == pytest.approx(-math.pi)
    for wrong in ((1, 1, 0, 1), (2, 0, 0, 1), (1, 0, 0, 0)):
        with pytest.raises(ValueError):
            curves.turned(table, wrong)


def test_registration_shuffles_points_only(spark):
    ring = [line(case, k, x, y, x + dx, y + dy) for case in (1, 2) for k, (x, y, dx, dy) in enumerate(((0.0, 0.0, 9.0, 0.0), (9.0, 0.0, 0.0, 4.0), (9.0, 4.0, -9.0, -4.0)))]
    table = spark.createDataFrame(ring, CURVE)
    rows = register.register(curves.turned(table, (0, -1, 1, 0)), table)
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()  # the rounds write nothing
    assert {(r.case_id, r.turn) for r in rows.collect()} == {(1, 3), (2, 3)}


def test_registration_finds_the_planted_turn_and_shift(spark):
    rng = random.Random(2)
    reference, predicted = [], []
    for case, (a, b, c, d) in enumerate(register.TURNS):
        corners = [(rng.uniform(0, 100), rng.uniform(0, 40)) for _ in range(9)]
        spots = [(a * (x - 30 - case) + c * (y + 12), b * (x - 30 - case) + d * (y + 12)) for x, y in corners]  # the inverse of a turn is its transpose
        for out, way in ((reference, corners), (predicted, spots)):
            out += [line(case, k, *way[k], *way[(k + 1) % 9]) for k in range(9)]
    predicted += [line(50, 0, 0.0, 0.0, 1.0, 0.0)]  # without a reference
    got = register.register(spark.createDataFrame(predicted, CURVE), spark.createDataFrame(reference, CURVE), samples=64, rounds=8).collect()
    assert len(got) == len(register.TURNS)
    for r in got:
        assert (r.turn, round(r.dx, 6), round(r.dy, 6), round(r.loss, 9)) == (r.case_id, 30 + r.case_id, -12, 0)


def square(case, ring, x, y, h):
    corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    return [(case, ring, *corners[k], *corners[(k + 1) % 4]) for k in range(4)]


def test_nesting_of_rings(spark):
    rows = []
    for k in range(60):  # a hot case: deep nesting and many rings side by side
        rows += square(1, f"a{k:02d}", 0.0, 0.0, 100.0 - k) + square(1, f"b{k:02d}", 300.0 + 3 * k, 0.0, 1.0)
    rows += square(2, "outer", 0.0, 0.0, 5.0) + square(2, "touch", 4.0, 0.0, 1.0) + square(3, "one", 0.0, 0.0, 1.0)
    notch = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    rows += [(4, "notch", *notch[k], *notch[(k + 1) % 5]) for k in range(5)] + square(4, "in", 1.5, 1.5, 0.5) + square(4, "gap", 5.0, 8.0, 0.5)
    schema = "case_id int, ring string, sx double, sy double, ex double, ey double"
    got = {(r.case_id, r.ring): r for r in nesting.nesting(spark.createDataFrame(rows, schema)).collect()}
    for k in range(60):
        r = got[1, f"a{k:02d}"]
        assert (r.depth, r.parent, r.role) == (k, f"a{k - 1:02d}" if k else None, "hole" if k % 2 else "material") and not r.ambiguous
        assert r.net_area == (None if k % 2 else pytest.approx(4 * (100 - k) ** 2 - (4 * (99 - k) ** 2 if k < 59 else 0)))
        assert got[1, f"b{k:02d}"].depth == 0
    assert got[2, "outer"].ambiguous and got[2, "touch"].depth is None and got[3, "one"].net_area == 4
    assert (got[4, "in"].parent, got[4, "gap"].parent) == ("notch", None)
    assert nesting.nesting(spark.createDataFrame([], schema)).collect() == []


def test_rays_meet_the_first_edge(spark):
    edges = [(1, 10.0, -5.0, 10.0, 5.0), (1, 20.0, -5.0, 20.0, 5.0), (1, 10.0, 5.0, 20.0, 5.0), (1, 40.0, 0.0, 60.0, 0.0)] + [(1, 500.0 + k, 0.0, 500.0 + k, 1.0) for k in range(50)]
    rays = [(1, 0, 0.0, 0.0, 30.0, 0.0, 4.0), (1, 1, 0.0, 5.0, 10.0, 5.0, 4.0), (1, 2, 30.0, 0.0, 50.0, 0.0, 4.0), (1, 3, 0.0, 50.0, 90.0, 50.0, 4.0), (1, 4, 10.0, 0.0, 10.0, 0.0, 4.0),
            (1, 5, 15.0, 0.0, 22.0, 0.0, 4.0), (2, 6, 0.0, 0.0, 1.0, 0.0, 4.0), (1, 7, 12.0, 1.0, 12.0, 4.0, 4.0)]
    got = {r.record_id: (r.first, r.verified) for r in leaders.visibility(
        spark.createDataFrame(rays, "case_id int, record_id int, ax double, ay double, tx double, ty double, band double"),
        spark.createDataFrame(edges, "case_id int, sx double, sy double, ex double, ey double")).collect()}
    assert got == {0: (pytest.approx(1 / 3), False), 1: (pytest.approx(1.0), True), 2: (pytest.approx(0.5), True), 3: (None, True), 4: (None, True), 5: (pytest.approx(5 / 7), True), 6: (None, True), 7: (None, True)}


def test_leaders_keep_near_alternatives(spark):
    ring = [line(1, 0, 0.0, 0.0, 10.0, 0.0), arc(1, 1, 10.0, 2.0, 2.0, -math.pi / 2, math.pi / 2), line(1, 2, 12.0, 2.0, 12.0, 10.0), line(1, 3, 12.0, 10.0, 0.0, 0.0)]
    tips = [(1, 1, "radius", 11.5, 0.4, True, 4.0), (1, 2, "radius", 11.5, 0.4, False, 4.0), (1, 3, "length", 5.0, -1.0, True, 4.0), (1, 4, "radius", 5.0, -90.0, True, 4.0), (2, 5, "radius", 0.0, 0.0, True, 4.0)]
    rows = leaders.nearest_entity(spark.createDataFrame(tips, "case_id int, record_id int, kind string, px double, py double, arrowhead boolean, grid double"), spark.createDataFrame(ring, CURVE)).cache()
    got = {r.record_id: (r.entity, r.supported, r.compatible, list(r.alternatives)) for r in rows.collect()}
    assert got == {1: (1, True, True, [0, 2]), 2: (1, True, True, []), 3: (0, True, True, []), 4: (0, False, False, []), 5: (None, False, False, [])}
    assert {r.case_id: (r.targets, r.reached, r.compatible) for r in leaders.support_summary(rows).collect()} == {1: (4, 3, 3), 2: (1, 0, 0)}


def test_resampling_of_long_and_odd_paths(spark):
    rng = random.Random(9)
    long = [(1, k, float(k), math.sin(k / 5) * 3) for k in range(4000)]
    odd = [(2, 0, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 4.0, 0.0), (2, 3, 4.0, 0.0), (3, 0, 7.0, 8.0), (4, 0, 1.0, 1.0), (4, 1, 1.0, 1.0)]
    wild = [(5, k, rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(40)]
    table = spark.createDataFrame(long + odd + wild, "case_id int, ord int, x double, y double")
    got = {}
    for r in paths.resample(table, 0.75).collect():
        got.setdefault(r.case_id, {})[r.i] = (r.x, r.y)
    assert got[3] == {0: (7.0, 8.0)} and got[4] == {0: (1.0, 1.0)}
    assert [got[2][i] for i in sorted(got[2])] == [pytest.approx((4 * i / 6, 0.0)) for i in range(7)]
    for case, path in ((1, long), (5, wild)):
        spots = [p[2:] for p in path]
        lengths = [math.dist(a, b) for a, b in zip(spots, spots[1:])]
        n = math.ceil(sum(lengths) / 0.75) + 1
        assert sorted(got[case]) == list(range(n))
        at, k = 0.0, 0
        for i in range(n):
            d = sum(lengths) * i / (n - 1)
            while k < len(lengths) - 1 and at + lengths[k] < d:
                at, k = at + lengths[k], k + 1
            share = min(1.0, (d - at) / lengths[k])
            assert got[case][i] == pytest.approx([a + share * (b - a) for a, b in zip(spots[k], spots[k + 1])], abs=1e-6)


def test_fingerprints_of_rotations_and_reversals(spark):
    rng = random.Random(1)
    rows, same = [], {}
    for family in range(6):
        n = rng.choice([1, 2, 3, 8, 31])
        ring = [(rng.randint(0, 2), rng.randint(0, 2)) for _ in range(n)]
        steps = [(ring[k], ring[(k + 1) % n]) for k in range(n)]
        for copy in range(4):
            turn = rng.randrange(n)
            own = steps[turn:] + steps[:turn]
            if copy % 2:
                own = [(b, a) for a, b in reversed(own)]
            if copy == 3:
                own[0] = ((9, 9), own[0][1])
            ways = [own[k:] + own[:k] for k in range(n)]
            back = [(b, a) for a, b in reversed(own)]
            same[family * 10 + copy] = str(min([*ways, *(back[k:] + back[:k] for k in range(n))]))
            rows += [(family * 10 + copy, k, str(a), str(b)) for k, (a, b) in enumerate(own)]
    table = spark.createDataFrame(rows, "case_id int, ord int, a string, b string")
    got = {r.case_id: r.digest for r in paths.ring_digest(table, F.concat_ws(">", "a", "b"), F.concat_ws(">", "b", "a")).collect()}
    assert got.keys() == same.keys()
    assert all((got[x] == got[y]) == (same[x] == same[y]) for x in got for y in got)


def test_pages_first_fit_in_order(spark):
    rng = random.Random(4)
    rows = [(1, f"r{k:04d}", rng.random() > 0.1, rng.choice([0, 1, 3, 5, 9, 20, 32, 33]), rng.random() > 0.5) for k in range(600)] + [(2, "a", True, 0, True)]
    table = spark.createDataFrame(rows, "case_id int, record_id string, supported boolean, size int, reliable boolean")
    got = {(r.case_id, r.record_id): (r.page, r.reason) for r in pages.request_pages(table, [(~F.col("reliable")).asc()], pages=10_000, block=64).collect()}
    order = sorted((r for r in rows if r[0] == 1 and r[2] and 0 < r[3] <= 32), key=lambda r: (not r[4], r[1]))
    done = 0
    for at in range(0, len(order), 64):
        own: list[list[int]] = []
        for r in order[at: at + 64]:
            page = next((k for k, p in enumerate(own) if p[0] < 16 and p[1] + r[3] <= 32), len(own))
            own += [[0, 0]] if page == len(own) else []
            own[page] = [own[page][0] + 1, own[page][1] + r[3]]
            assert got[1, r[1]] == (done + page + 1, None)
        done += len(own)
    assert len(got) == len(rows) and got[2, "a"] == (None, "no_source_candidate")
    assert {got[1, r[1]][1] for r in rows if r[0] == 1 and not r[2]} == {"unsupported_or_unresolved_source_dimension"}
    few = pages.request_pages(table, [F.col("reliable").asc()], pages=2).collect()
    assert max(r.page for r in few if r.page) == 2 and any(r.reason == "page_count_limit" for r in few)


def test_hausdorff_bounds_hold_the_distance(spark):
    rng = random.Random(7)
    first, second, want = [], [], {}
    for case in range(6):
        a = [line(case, k, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(0, 50)) for k in range(3)]
        b = [arc(case, k, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(2, 20), rng.uniform(-3, 3), rng.uniform(0.5, 5)) for k in range(2)]
        first, second = first + a, second + b
        spots = lambda c: [(c[3] + t / 400 * (c[5] - c[3]), c[4] + t / 400 * (c[6] - c[4])) if c[2] == "LINE" else (c[7] + c[9] * math.cos(c[10] + c[11] * t / 400), c[8] + c[9] * math.sin(c[10] + c[11] * t / 400)) for t in range(401)]
        want[case] = max(max(min(far(x, y, o) for o in other) for c in own for x, y in spots(c)[::20]) for own, other in ((a, b), (b, a)))
    second.append(line(99, 0, 0.0, 0.0, 1.0, 0.0))
    rows = compare.hausdorff_bounds(spark.createDataFrame(first, CURVE), spark.createDataFrame(second, CURVE), 1.0).collect()
    assert {r.case_id for r in rows} == set(want)
    for r in rows:
        assert r.upper == pytest.approx(r.sampled + 0.5) and r.lower <= want[r.case_id] + 1e-6 and want[r.case_id] <= r.upper + 1e-6


def test_affine_fit_gates_and_ranks(spark):
    rng = random.Random(3)
    rows = []
    for case, far_off in ((1, 0.0), (2, 1e6)):
        for _ in range(20):
            x, y = far_off + rng.uniform(-5, 5), rng.uniform(-5, 5)
            rows.append((case, x, y, 2 * x - 3 * y + 7, 0.5 * x + y - 1))
    rows += [(3, float(k), 2.0 * k, 1.0 * k, 3.0) for k in range(5)] + [(4, 0.0, 0.0, 0.0, 0.0), (4, 1.0, 0.0, 1.0, 0.0)]
    rows += [(5, float(k % 3), float(k // 3), k % 3 + 1e-3 * (k == 4), float(k // 3)) for k in range(9)]
    got = {r.case_id: r for r in compare.affine_fit(spark.createDataFrame(rows, "case_id int, x double, y double, u double, v double")).collect()}
    assert [got[1][c] for c in ("a", "b", "c", "d", "tx", "ty", "det")] == pytest.approx([2, -3, 0.5, 1, 7, -1, 3.5]) and got[1].accepted
    assert [got[2][c] for c in "abcd"] == pytest.approx([2, -3, 0.5, 1]) and got[2].accepted
    assert got[3].a is None and got[4].a is None and not got[3].accepted and not got[4].accepted
    assert got[5].a == pytest.approx(1, abs=1e-2) and got[5].error > 1e-5 and not got[5].accepted


def test_closed_rings_and_their_issues(spark):
    rings = {1: [(0, 0), (0, 0), (4, 0), (4, 4), (0, 0)], 2: [(0, 0), (1, 0), (0, 0)], 3: [(0, 0), (float("nan"), 1), (2, 2), (3, 0)], 4: [(0, 0)], 5: [(0, 0), (1, 0), (1, 1), (1, 1)]}
    rows = [(case, k, float(x), float(y)) for case, ring in rings.items() for k, (x, y) in enumerate(ring)]
    got = {}
    for r in paths.closed_rings(spark.createDataFrame(rows, "case_id int, ord int, x double, y double")).collect():
        got.setdefault(r.case_id, []).append((r.ord, r.issue))
    assert {c: sorted(o for o, _ in v) for c, v in got.items()} == {1: [0, 2, 3], 2: [0, 1], 3: [0, 1, 2, 3], 4: [0], 5: [0, 1, 2]}
    assert {c: v[0][1] for c, v in got.items()} == {1: None, 2: "fewer_than_three_vertices", 3: "not_finite", 4: "fewer_than_three_vertices", 5: None}


def test_token_counters_take_whole_numbers_only(spark):
    documents = ['{"input_tokens": 5, "output_tokens": -1, "total_tokens": 1.0, "prompt_tokens": "3", "completion_tokens": true, "prompt_tokens_details": {"cached_tokens": 0}}', "not json", None, "[]", '{"input_tokens_details": 4}']
    table = spark.createDataFrame([(d,) for d in documents], "document string")
    rows = table.select(*[v.alias(k) for k, v in usage.counters(F.col("document")).items()]).collect()
    assert {k: v for k, v in rows[0].asDict().items() if v is not None} == {"input_tokens": 5, "prompt_tokens_details__cached_tokens": 0}
    assert len(rows[0]) == 11 and all(v is None for r in rows[1:] for v in r)


def test_components_of_two_labellings(spark):
    before = ["XX..X.XX", "XX..X.X.", "....X.X.", "X.X.....", "X.XX...."]
    after = ["X.XXX..X", "........", "....X...", "..XXXX..", "..X....."]
    pixels = lambda rows, mask: [(mask, x, y) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "X"]
    wide = [(3, x, 0) for x in range(1000) if x % 100]  # runs over many stretches of one row
    schema = "mask_id int, x int, y int"
    a = spark.createDataFrame(pixels(before, 1) + [(2, 0, 0)] + wide, schema)
    b = spark.createDataFrame(pixels(after, 1) + [(3, x, 0) for x in range(1000)], schema)
    got = {r.mask_id: tuple(r)[1:] for r in labellings.component_sets(a, b).collect()}
    # (before, after, survived, deleted, split, joined, created)
    assert got == {1: (5, 4, 4, 1, 1, 1, 0), 2: (1, 0, 0, 1, 0, 0, 0), 3: (10, 1, 10, 0, 0, 1, 0)}
    bar = [(1, x, y) for x in range(3) for y in range(3)] + [(1, x, 1) for x in range(3, 6)] + [(1, x, y) for x in range(6, 10) for y in range(4)] + [(2, x, y) for x in range(5) for y in range(5)] + [(3, 0, 0)]
    necks = {r.mask_id: tuple(r)[1:] for r in labellings.thin_necks(spark.createDataFrame(bar, schema)).collect()}
    assert necks == {1: (2, 1, 1), 2: (1, 0, 0), 3: (0, 0, 0)}
    assert {r.mask_id: tuple(r)[1:] for r in labellings.thin_necks(spark.createDataFrame(bar, schema), least=2).collect()}[1] == (1, 0, 0)


def test_rings_of_bounded_cases_meet_by_case(spark, monkeypatch):
    def square(case, ring, x, y, h):
        at = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
        return [(case, ring, *at[k], *at[(k + 1) % 4]) for k in range(4)]

    rings = [e for case in (1, 2, 3) for k in range(3 + case) for e in square(case, k, 0.1 * k + (20.0 if k == 3 else 0.0), 0.0, 10.0 - 2 * k)] + square(3, 9, 9.0, 0.0, 3.0)
    edges = spark.createDataFrame(rings, "case_id bigint, ring int, sx double, sy double, ex double, ey double")
    assert "_band" not in nesting.containers(edges, nesting.ring_facts(edges))._jdf.queryExecution().toString()
    few = sorted(map(tuple, nesting.nesting(edges).collect()), key=str)
    monkeypatch.setattr(nesting, "MOST_SHAPES", 17)
    assert sorted(map(tuple, nesting.nesting(edges).collect()), key=str) == few
    assert {(r[0], r[1], r[4], r[7]) for r in few if r[0] == 1} == {(1, 0, 0, False), (1, 1, 1, False), (1, 2, 2, False), (1, 3, 0, False)}
