"""Operators against brute force on small fixtures, hot groups included."""

import math
import random

import numpy as np

from drawlake.functions import text
from drawlake.operators import corpus, labellings, masks, quantiles, spatial


def brute_distance(px, py, s):
    sx, sy, ex, ey = s
    dx, dy = ex - sx, ey - sy
    t = min(1, max(0, ((px - sx) * dx + (py - sy) * dy) / max(dx * dx + dy * dy, 1e-300)))
    return math.hypot(px - sx - t * dx, py - sy - t * dy)


def test_nearest_segment_large_and_small_cases(spark):
    rng = random.Random(3)
    segments, points = [], []
    for case, n in ((1, 400), (2, 5)):
        for _ in range(n):
            x, y = rng.uniform(0, 100), rng.uniform(0, 10)
            segments.append((case, x, y, x + rng.uniform(-3, 3), y + rng.uniform(-30, 3)))
        segments.append((case, -500.0, 0.0, 500.0, 1.0))
        points += [(case, i, rng.uniform(-900, 900), rng.uniform(-50, 50)) for i in range(60)]
    points.append((3, 0, 1.0, 1.0))  # a case without segments keeps its points
    near = spatial.nearest_segment(
        spark.createDataFrame(points, "case_id int, pid int, px double, py double"),
        spark.createDataFrame(segments, "case_id int, sx double, sy double, ex double, ey double"), "case_id", ["pid"],
    ).collect()
    got = {(r["case_id"], r["pid"]): r["distance"] for r in near}
    assert len(got) == 121 and got.pop((3, 0)) is None
    for case, pid, px, py in points[:-1]:
        want = min(brute_distance(px, py, s[1:]) for s in segments if s[0] == case)
        assert abs(got[case, pid] - want) < 1e-9


def test_nearest_segment_pairs_bounded_cases_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    segments = [(case, *[rng.uniform(0, 50) for _ in range(4)]) for case, n in ((1, 300), (2, 7), (4, 30)) for _ in range(n)]
    points = [(case, i % 40, rng.uniform(-9, 60), rng.uniform(-9, 60)) for case in (1, 2, 3, 4) for i in range(50)] + [(None, 0, 1.0, 1.0)]
    tables = spark.createDataFrame(points, "case_id int, pid int, px double, py double"), spark.createDataFrame(segments, "case_id int, sx double, sy double, ex double, ey double")
    want = {}
    for case, pid, px, py in points:  # ids may repeat
        near = min((brute_distance(px, py, s[1:]) for s in segments if s[0] == case), default=None)
        want[case, pid] = min((d for d in (near, want.get((case, pid))) if d is not None), default=None)
    whole = spatial.nearest_segment(*tables, "case_id", ["pid"])
    assert "Generate" not in whole._jdf.queryExecution().executedPlan().toString()  # nothing is copied into cells
    monkeypatch.setattr(spatial, "MOST_SHAPES", 100)
    for rows in (whole, spatial.nearest_segment(*tables, "case_id", ["pid"])):
        got = {(r["case_id"], r["pid"]): r["distance"] for r in rows.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_group_quantiles_of_a_hot_and_a_small_group(spark):
    values = np.random.default_rng(1).normal(size=30_000).round(3)
    rows = spark.range(30_000).selectExpr("id").toPandas()
    rows["v"], rows["k"] = values, np.where(np.arange(30_000) < 29_990, "hot", "small")
    out = {r["k"]: r for r in quantiles.group_quantiles(spark.createDataFrame(rows), ["k"], "v", {"p05": 0.05, "median": 0.5, "p95": 0.95}).collect()}
    for key in ("hot", "small"):
        part = values[rows["k"] == key]
        for name, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
            assert abs(out[key][name] - np.quantile(part, p)) < 1e-9


def test_components_on_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)]
    nodes = [(i,) for i in [*range(1, 61), *range(100, 180), 500]]
    rows = spatial.components(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame(nodes, "node int")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 180)} == {100} and got[500] == 500


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(60):
        code = base[i % 6]
        for _ in range(i % 7):
            code ^= 1 << rng.randrange(63)
        rows.append((i, code, 1.0))
    frame = spark.createDataFrame(rows, "id int, signature bigint, aspect double")
    got = {(r["a"], r["b"]) for r in corpus.near_duplicates(frame).collect()}
    first = {}
    for i, code, _ in rows:
        first.setdefault(code, i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and bin(a ^ b).count("1") <= 4}
    assert got == want and want


def test_hot_signature_emits_no_pairs_of_copies(spark):
    frame = spark.range(2000).selectExpr("id", "7L as signature", "1.0D as aspect")
    assert corpus.near_duplicates(frame).count() == 0
    assert spatial.star_edges(frame, ["signature", "aspect"], "id").count() == 1999


def test_point_in_range_over_many_bins(spark):
    ranges = spark.createDataFrame([(1, 0.0, 100.0), (1, 50.0, 51.0)], "k int, lo double, hi double")
    points = spark.createDataFrame([(1, 50.5), (1, 99.9), (1, 100.1)], "k int, at double")
    assert spatial.point_in_range(ranges, points, ["k"], "lo", "hi", "at", 7.0).count() == 3


# Accepted and refused dimension texts.
CASES = {
    "R40": ("radius", 40.0, None, None), "R40±1": ("radius", 40.0, 1.0, -1.0), "R40^{+3}_{0}": ("radius", 40.0, 3.0, 0.0),
    "Ø20+0.1": ("diameter", 20.0, 0.1, 0.0), "Ø20-0.1": ("diameter", 20.0, 0.0, -0.1), "20-25": ("unknown", None, None, None),
    "45°": ("angle", 45.0, None, None), "(12.5)": ("length", 12.5, None, None), "20±-1": ("unknown", None, None, None),
    "Ra 3.2": ("surface_finish", None, None, None), "δ₁": ("symbol", None, None, None), "１２": ("length", 12.0, None, None),
    "20^-3_-1": ("unknown", None, None, None), "": ("unknown", None, None, None), "(": ("unknown", None, None, None),
    "2e3": ("unknown", None, None, None), "9999999": ("unknown", None, None, None), ".5": ("length", 0.5, None, None),
}


def test_dimension_grammar(spark):
    rows = text.with_dimension(spark.createDataFrame([(k,) for k in CASES], "text string")).collect()
    got = {r["text"]: (r["dimension"]["kind"], r["dimension"]["nominal"], r["dimension"]["upper"], r["dimension"]["lower"]) for r in rows}
    assert got == CASES


def test_filter_on_parsed_value_keeps_the_plan_small(spark):
    rows = text.with_dimension(spark.createDataFrame([("R4",)], "text string")).where("dimension.kind = 'radius' and dimension.nominal > 1")
    assert rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and len(plan) < 60_000


def test_compatibility_forms_of_one_and_of_several_characters(spark):
    from drawlake.functions import text

    samples = ["⑩", "R⑩", "⑴", "⒈", "\U0001D7CF", "Ｒ１２", "25±0.1", "plain", "½", "㎜ ⌀５", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i long, t string")
    got = [r.f for r in rows.select("i", text.compatibility_form(rows.t).alias("f")).orderBy("i").collect()]
    import unicodedata

    readable = lambda t: all(c <= "~" or c in "ØøΦφδΔ±°×" for c in t)
    want = [t if t is None else "".join(f if readable(f := unicodedata.normalize("NFKC", c)) else c for c in t) for t in samples]
    assert got == want and got[:5] == ["10", "R10", "(1)", "1.", "1"]


def test_ranks_and_totals_of_groups_that_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from drawlake.operators import prefix

    rng = random.Random(6)
    rows = [("hot" if i % 10 else None, rng.randint(0, 50), i) for i in range(3000)]
    got = prefix.running_total(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.col("v").desc(), F.col("i").asc()], F.col("v")).collect()
    assert len(got) == 3000
    for group in ("hot", None):
        total = 0
        for r in sorted((r for r in got if r.g == group), key=lambda r: (-r.v, r.i)):
            assert r._before == total
            total += r.v
        assert {r._total for r in got if r.g == group} == {total}


def test_bounded_masks_are_labelled_in_one_task(spark, monkeypatch):
    rng = random.Random(8)
    cells = {(m, x, y) for m, share in ((1, 0.5), (2, 0.3), (3, 0.8)) for x in range(12) for y in range(12) if rng.random() < share}
    pixels = spark.createDataFrame(sorted(cells) + [(4, 0, 0), (4, 1, 1)], "mask_id bigint, x int, y int")

    def results():
        return (sorted(map(tuple, masks.topology(pixels, 12, 12).collect())), *[sorted(map(tuple, labellings.labelled(pixels, d).collect())) for d in (False, True)])

    def no_rounds(*_):
        raise AssertionError("a bounded mask went through rounds over all runs")

    with monkeypatch.context() as patch:
        patch.setattr(masks, "components", no_rounds)
        patch.setattr(labellings, "components", no_rounds)
        few = results()
    monkeypatch.setattr(masks, "MOST_RUNS", 40)  # some masks are larger, some are not
    assert results() == few
    assert few[0][-1][:5] == (4, 2, 1, 0, 0)


def test_boundaries_of_bounded_masks_are_compared_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    sides = [sorted({(m, rng.randrange(30), rng.randrange(30)) for m in of for _ in range(60)}) for of in ((1, 2, 3), (2, 3, 4))]
    a, b = (spark.createDataFrame(rows, "mask_id bigint, x int, y int") for rows in sides)
    want = sorted(
        (m, side, round(min(math.hypot(x - u, y - v) for n, u, v in other if n == m), 9))
        for side, own, other in (("f", *sides), ("b", *sides[::-1])) for m, x, y in own if m in (2, 3)
    )

    def got():
        return sorted((r.mask_id, r.side, round(r.distance, 9)) for r in masks.distances_both_ways(a, b).collect())

    assert got() == want
    monkeypatch.setattr(masks, "MOST_PIXELS", sum(m == 3 for m, _, _ in sides[0]) - 1)
    assert got() == want
