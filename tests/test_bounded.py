"""Cases of bounded size are done where the case is; larger ones go through cells and rounds with the same results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from drawlake.functions import text
from drawlake.operators import compare, curves, nesting, paths, prefix, scale, spatial
from drawlake.plans import certify


def refuse(*_):
    raise AssertionError("rows of bounded cases are written more than once")


def test_rings_are_digested_in_their_row_as_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(size, k, str(rng.randint(0, 2)), str(rng.randint(0, 2))) for size in (1, 2, 3, 4, 5, 8, 31, 32, 33, 64, 65) for k in range(size)]
    table = spark.createDataFrame(rows, "case_id int, ord int, a string, b string")
    ways = F.concat_ws(">", "a", "b"), F.concat_ws(">", "b", "a")
    want = sorted(map(tuple, paths._digest_by_joins(table, *ways, ["case_id"]).collect()))
    with monkeypatch.context() as m:
        m.setattr(paths, "checkpoint", refuse)
        assert sorted(map(tuple, paths.ring_digest(table, *ways).collect())) == want
    monkeypatch.setattr(paths, "MOST_SHAPES", 31)
    assert sorted(map(tuple, paths.ring_digest(table, *ways).collect())) == want


def test_labels_meet_strokes_and_crossings_in_their_case_as_by_bins(spark, monkeypatch):
    rng = random.Random(5)
    sizes = [("a", 40), ("b", 9), ("c", 1), (None, 4)]
    strokes, labels, crossings = [], [], []
    for case, n in sizes:
        for k in range(n):
            axis, lo, nominal, at = rng.choice("xy"), rng.randrange(40), rng.randrange(10, 14), rng.randrange(30)
            hi = lo + nominal * rng.choice([3.0, 3.02, 3.05, 4.0])
            strokes.append((case, f"s{k}", axis, float(lo), hi, float(at), hi - lo, 1.0 + k % 3))
            labels.append((case, f"r{k}", axis, float(nominal), (lo + hi) / 2, (hi - lo) / 3, at - 2.0, 8.0))
            crossings.append((case, rng.randrange(90) * 1.0, rng.randrange(20) * 1.0, 40.0, 20.0 + k, 1.0))
    strokes = spark.createDataFrame(strokes, "case_id string, stroke_id string, axis string, lo double, hi double, cross_at double, span double, thickness double")
    labels = spark.createDataFrame(labels, "case_id string, record_id string, axis string, nominal double, center double, along double, bottom double, height double")
    crossings = spark.createDataFrame(crossings, "case_id string, cross_at double, lo double, hi double, span double, thickness double")

    def found():
        lengths = scale.length_witnesses(labels, strokes)
        tables = [lengths, scale.diameter_witnesses(labels, strokes), scale.split_chains(lengths, crossings, labels), scale.split_chains(lengths, crossings),
                  scale.ratio_windows(lengths, labels), scale.ratio_windows(lengths), scale.tied_strokes(labels, strokes)]
        return [sorted(map(repr, (r.asDict() for r in table.select(*sorted(table.columns)).collect()))) for table in tables]

    with monkeypatch.context() as m:
        m.setattr(scale, "point_in_range", refuse)
        want = found()
    assert all(want)
    for most in (20, 0):  # one large case, then all of them
        monkeypatch.setattr(scale, "MOST_SHAPES", most)
        assert found() == want


def test_near_signatures_meet_where_two_ranges_agree(spark):
    rng = random.Random(9)
    codes = [rng.getrandbits(63) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), k % 7)) for k, c in enumerate(codes)] + [-c for c in codes[:5]]
    codes = sorted(set(codes))
    table = spark.createDataFrame(list(enumerate(codes)), "id long, signature long")
    for limit in (0, 1, 4):
        got = sorted((r.a, r.b, r.distance) for r in spatial.hamming_neighbours(table, "id", "signature", limit).collect())
        apart = lambda a, b: ((codes[a] ^ codes[b]) & (2**64 - 1)).bit_count()
        assert got == [(a, b, apart(a, b)) for a in range(len(codes)) for b in range(a + 1, len(codes)) if apart(a, b) <= limit]
    # Signatures that share one range only do not meet at all.
    far = spark.createDataFrame([(0, 0), (1, ~0x1FFF)], "id long, signature long").select(F.explode(spatial.hamming_bands(F.col("signature"), 4)).alias("k"))
    assert far.groupBy("k").count().where("count > 1").isEmpty()


def test_curves_of_bounded_cases_cross_as_by_cells(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for case, n in ((1, 30), (2, 6), (3, 1)):
        for k in range(n):
            sx, sy, r, start, sweep = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(1, 6), rng.uniform(-3, 3), rng.uniform(-3, 3)
            if k % 3:
                ex, ey = rng.uniform(0, 20), rng.uniform(0, 20)
                rows.append((case, k, "LINE", sx, sy, ex, ey, None, None, None, None, None, math.hypot(ex - sx, ey - sy)))
            else:
                cx, cy = sx - r * math.cos(start), sy - r * math.sin(start)
                rows.append((case, k, "ARC", sx, sy, cx + r * math.cos(start + sweep), cy + r * math.sin(start + sweep), cx, cy, r, start, sweep, r * abs(sweep)))
    table = spark.createDataFrame(rows, "case_id int, ord int, kind string, " + ", ".join(f"{c} double" for c in curves.SHAPE[1:]))
    with monkeypatch.context() as m:
        m.setattr(curves, "_boxes", refuse)
        want = sorted(map(tuple, curves.crossings(table, 4.0).collect()))
    monkeypatch.setattr(curves, "MOST_SHAPES", 10)
    assert len(want) > 50 and sorted(map(tuple, curves.crossings(table, 4.0).collect())) == want


@pytest.mark.parametrize("name, module, limit, step", [
    ("arrow_identity", spatial, "MOST_SHAPES", (spatial, "grid_join")), ("interval_union", certify, "MOST_POINTS", (certify, "bins")),
    ("preflight_order", prefix, "MOST_POINTS", (prefix, "running_total"))])
def test_queries_are_the_same_for_large_cases(spark, monkeypatch, name, module, limit, step):
    run = lambda: sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    with monkeypatch.context() as m:
        m.setattr(*step, refuse)
        want = run()
    monkeypatch.setattr(module, limit, 3)
    assert want and run() == want


@pytest.mark.parametrize("name", ["review_priority", "dimension_agreement"])
def test_each_text_is_parsed_once(spark, monkeypatch, name):
    parsed, parse = [], text.with_dimension

    def counting(df, *args, **kw):
        names = [c for c in df.columns if c in ("text", "reread")]
        parsed.append(df.count() - df.select(*names).distinct().count())
        return parse(df, *args, **kw)

    monkeypatch.setattr(text, "with_dimension", counting)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert parsed and not any(parsed)


def test_rows_keep_what_is_read_from_their_texts(spark):
    rows = spark.createDataFrame([(1, "R4", None), (2, None, "R4"), (3, None, None), (4, "R4", None), (5, None, "R4"), (6, "x", "R4")], "id int, text string, other string")
    got = text.once_per_text(rows, ["text", "other"], lambda pairs: pairs.where("text is null or text <> 'x'").withColumn("size", F.length(F.concat_ws("", "text", "other"))))
    assert sorted(map(tuple, got.select("id", "size").collect())) == [(1, 2), (2, 2), (3, 0), (4, 2), (5, 2)]


def test_rings_nest_in_the_row_of_their_case_as_across_cells(spark, monkeypatch):
    rng, rows = random.Random(11), []

    def ring(case, name, x, y, *sizes):
        at = [(x + r * math.cos(2 * math.pi * k / len(sizes)), y + r * math.sin(2 * math.pi * k / len(sizes))) for k, r in enumerate(sizes)]
        rows.extend((case, name, *at[k], *at[(k + 1) % len(at)]) for k in range(len(at)))

    for case in range(12):
        for k in range(1 + case % 5):  # around one centre, in every third case with rings of their own beside them, in some with a ring across
            ring(case, f"r{k}", 0.0, 0.0, *[20.0 - 4 * k - rng.random() for _ in range(3 + case)])
            if case % 3 == 0:
                ring(case, f"s{k}", 60.0 + 9 * k, 1.0, 3.0, 3.0, 3.0)
        if case in (3, 8):
            ring(case, "x", 20.0, 0.0, 3.0, 3.0, 3.0, 3.0)
    ring(None, "alone", 0.0, 0.0, 5.0, 5.0, 5.0)
    ring(None, "in", 0.0, 0.0, 1.0, 1.0, 1.0)
    ring(20, None, 0.0, 0.0, 9.0, 9.0, 9.0)
    ring(20, "in", 0.0, 0.0, 1.0, 1.0, 1.0)
    rows += [(21, "null", None, 0.0, 1.0, None), (21, "null", 1.0, 1.0, 0.0, 0.0), (21, "flat", 0.0, 0.0, 0.0, 0.0)]
    edges = spark.createDataFrame(rows, "case_id int, ring string, sx double, sy double, ex double, ey double")

    def found():
        whole = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        return sorted((whole(r) for r in nesting.nesting(edges).collect()), key=repr)

    with monkeypatch.context() as m:
        m.setattr(nesting, "checkpoint", refuse)
        got = found()
    assert len(got) == len({r[:2] for r in rows}) and {r[4] for r in got} >= {0, 1, 2, 3, 4, None} and {r[0] for r in got if r[-1]} >= {3, 8}
    for most in (30, 0):  # some large cases, then all of them
        monkeypatch.setattr(nesting, "MOST_SHAPES", most)
        assert found() == got


def test_errors_are_localized_by_curve_layer_and_scope_in_cases_of_any_size(spark, monkeypatch):
    rng = random.Random(7)

    def lines(case, corners, layer):
        ends = list(zip(corners, corners[1:] + corners[:1]))
        return [(case, k, *a, *b, math.dist(a, b), layer(k)) for k, (a, b) in enumerate(ends)]

    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    wild = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(30)]
    layer = lambda k: "GT_CLOSURE" if k % 4 == 0 else "GT_MAIN" if k % 3 else "CONSTRUCTION"
    reference = lines(1, square, layer) + lines(2, wild, layer)
    predicted = lines(1, [(x - 1.0, y - 1.0) for x, y in square], lambda k: "MAIN") + lines(2, [(x + rng.uniform(-3, 3), y + 1.0) for x, y in wild], lambda k: "MAIN")
    predicted += lines(3, square, lambda k: "MAIN")  # without a reference
    schema = "case_id int, ord int, sx double, sy double, ex double, ey double, length double, layer string"

    def distance(p, line):
        _, _, sx, sy, ex, ey, length, _ = line
        t = min(1.0, max(0.0, ((p[0] - sx) * (ex - sx) + (p[1] - sy) * (ey - sy)) / length ** 2))
        return math.hypot(p[0] - sx - t * (ex - sx), p[1] - sy - t * (ey - sy))

    want, r6 = {}, lambda v: round(float(v), 6)
    for side, source, target in (("prediction", predicted, reference), ("reference", reference, predicted)):
        for case in (1, 2):
            groups, spots, others = {}, {}, [x for x in target if x[0] == case]
            for x in (x for x in source if x[0] == case):
                n = max(2, math.ceil(x[6] / 4.0) + 1)
                points = [(x[2] + i / (n - 1) * (x[4] - x[2]), x[3] + i / (n - 1) * (x[5] - x[3])) for i in range(n)]
                far = [min(distance(p, o) for o in others) for p in points]
                at = next(p for p, d in zip(points, far) if d >= max(far) - 1e-8)
                near = [distance(at, o) for o in others]
                spots[x[1]] = (r6(at[0]), r6(at[1]), [o[1] for o, d in zip(others, near) if d <= min(near) + 1e-8])
                scope = "reference_assumptions" if x[7] == "GT_CLOSURE" else "reference_core"
                for key in [("curve", x[1], x[7])] + [("layer", None, x[7]), ("scope", None, scope)] * (side == "reference"):
                    groups.setdefault(key, []).extend(far)
            order = sorted((-r6(max(v)), k[1]) for k, v in groups.items() if k[0] == "curve")
            for key, v in groups.items():
                v = np.array(v)
                own = (*spots[key[1]], place if (place := 1 + [o for _, o in order].index(key[1])) <= 5 else None) if key[0] == "curve" else (None,) * 4
                want[case, side, *key] = (r6(v.max()), r6(np.quantile(v, 0.95)), r6(np.sqrt(np.mean(v ** 2))), len(v), *own)
    assert any(len(v[6] or []) > 1 for v in want.values())
    tables = [spark.createDataFrame(rows, schema) for rows in (predicted, reference)]
    for most, points in ((spatial.MOST_SHAPES, compare.MOST_POINTS), (8, 40)):  # then the second case is large
        monkeypatch.setattr(spatial, "MOST_SHAPES", most)
        monkeypatch.setattr(compare, "MOST_POINTS", points)
        rows = compare.localized(*tables, 4.0, F.col("layer") == "GT_CLOSURE").collect()
        got = {tuple(r[:5]): tuple(r6(v) if isinstance(v, float) else v for v in r[5:]) for r in rows}
        assert len(rows) == len(got) and got == want
