"""Operators 11 to 13 against brute force, with odd rows."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlist.llm import hard_negatives as hn
from setlist.llm import lattice_join as lj
from setlist.llm import manifest as mf

VECTORS = "vec_id long, label int, embedding array<float>, row_id long, id string, class int, tree string"


def frame(spark, data):
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2, "t") for i, label, v in data], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ------------------------------------------------------------------ op11


def brute_links(data, threshold):
    good = [k for k, (_, label, v) in enumerate(data) if label is not None and usable(v) and any(v)]
    links = {k: set() for k in range(len(data))}
    for a in good:
        for b in good:
            if a < b and data[a][1] == data[b][1] and len(data[a][2]) == len(data[b][2]):
                x, y = (np.array(data[k][2], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [data[m][0] for m in seen if data[m][0] is not None]
        out.append((data[k][0], len(links[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_groups(rng, n_groups, size, width, noise):
    data, at = [], 0
    for g in range(n_groups):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            step = rng.normal(size=width)
            data.append((at * 3 + 1, g % 3, list(centre + noise * step / np.linalg.norm(step))))
            at += 1
    return data


def found_links(df, **kw):
    return sorted(((r["id"], r["n_links"], r["component"]) for r in lj.near_vectors(df, "vec_id", "label", "embedding", **kw).collect()), key=repr)


ODD = [
    (9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 16), (9004, 0, [None] + [1.0] * 15), (9005, 0, [math.nan] + [1.0] * 15),
    (9006, 0, [math.inf] + [1.0] * 15), (9007, None, [1.0] * 16), (9008, None, [1.0] * 16), (9009, 0, [1.0] * 16), (9009, 0, [1.0] * 16),
    (9010, 0, [2.0] * 16), (9011, 1, [1.0] * 16), (9012, 0, [1.0] * 8), (None, 0, [1.0] * 16), (None, 7, [3.0] * 16), (9013, 0, [1e-30] * 16),
]


def test_near_vectors_against_brute_force(spark):
    data = near_groups(np.random.default_rng(5), 12, 9, 16, 0.12) + ODD
    got, want = found_links(frame(spark, data)), brute_links(data, 0.98)
    assert sum(x[1] for x in want) > 300
    assert sum(x[1] for x in got) >= 0.97 * sum(x[1] for x in want)
    assert [x for x in got if (x[0] or 9000) >= 9000] == [x for x in want if (x[0] or 9000) >= 9000]
    most = {x[0]: x[1] for x in want if x[0]}
    assert all(x[1] <= most[x[0]] for x in got if x[0])


def test_tiles_and_tables_count_a_pair_once(spark):
    """Whether a hot cell is one tile or many, the links are the same; more tables only add some."""
    df = frame(spark, near_groups(np.random.default_rng(6), 2, 60, 16, 0.1))
    one = found_links(df)
    assert found_links(df, tile=7) == one
    assert sum(x[1] for x in one) > 2 * 60 * 40


def test_near_vectors_empty(spark):
    assert found_links(frame(spark, [])) == []


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(500, 8)) * 2
    point, steps = lj.decode(y), lj._neighbours()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    own = ((y - point) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    for v in steps:
        assert (own <= ((y - point - v) ** 2).sum(axis=1) + 1e-9).all()


# ------------------------------------------------------------------ op12


def brute_tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha256("".join(low[i:i + 2]).encode()).hexdigest() for i in range(0, len(low), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        if (i ^ 1) < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


def brute_postorder(levels):
    def visit(level, index):
        if level:
            for child in (2 * index, 2 * index + 1):
                if child < len(levels[level - 1]):
                    visit(level - 1, child)
        order.append((level, index))
    order = []
    visit(len(levels) - 1, 0)
    return order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100, 257])
def test_postorder_positions_and_log(n):
    levels = brute_tree([sha256(str(i).encode()).hexdigest() for i in range(n)])
    order = brute_postorder(levels)
    assert [mf.position(level, index, n) for level, index in order] == list(range(len(order)))
    log = mf.log_of([bytes.fromhex(x) for x in levels[0]], mf.height_of(n))
    assert log.hex() == "".join(levels[level][index] for level, index in order)
    for i in range(n):
        assert [s["digest"] for s in mf.siblings(log, i, n, mf.height_of(n)) if s["digest"]] == path(levels, i)


def check_manifest(spark, rows, partitions):
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, idx long, steps string, digest int, place int")
    made = mf.Manifest(df.repartition(partitions).select("doc_id", "lang", "leaf"), "lang", ["doc_id"], "leaf")
    got = made.proofs().select("*", mf.folded(F.col("leaf"), F.col("steps")).alias("again")).collect()
    groups = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for g in groups}
    top = brute_tree([trees[g][-1][0] for g in groups]) if groups else []
    want = sorted(
        (leaf, trees[g][-1][0], top[-1][0], tuple(path(trees[g], i) + path(top, k)))
        for k, g in enumerate(groups) for i, leaf in enumerate(trees[g][0]))
    assert sorted((r["leaf"], r["subroot"], r["root"], tuple(s["digest"] for s in r["steps"] if s["digest"])) for r in got) == want
    assert all(r["again"] == r["root"] for r in got)
    log = sorted((r["tree"], r["position"], r["digest"]) for r in made.forest.log().collect())
    assert log == sorted(
        ("" if g is None else "=" + g, i, trees[g][level][index])
        for g in groups for i, (level, index) in enumerate(brute_postorder(trees[g])))


def leaf_row(i, lang, leaf=None):
    return (i, lang, leaf or sha256(f"{i}{lang}".encode()).hexdigest(), 1, "s", 2, 3)


def test_manifest_against_brute_force(spark):
    rows = [leaf_row(i, "aa") for i in range(700)] + [leaf_row(i, None) for i in range(3)] + [leaf_row(5, ""), leaf_row(6, "é"), leaf_row(7, "z")]
    rows += [leaf_row(None, "aa"), leaf_row(9, "z"), leaf_row(9, "z"), leaf_row(9, "z"), leaf_row(8, "z", sha256(b"x").hexdigest())]
    check_manifest(spark, rows, 5)


def test_manifest_of_one_row_and_none(spark):
    check_manifest(spark, [leaf_row(4, "en")], 1)
    check_manifest(spark, [], 1)


def test_field_text_nulls_and_bytes(spark):
    df = spark.createDataFrame([(12, None, "é:"), (None, "", "")], "a long, b string, c string")
    assert [r[0] for r in df.select(mf.field_text(["a", "b", "c"])).collect()] == ["2:12-3:é:", "-0:0:"]


def test_tampering_is_seen(spark):
    df = spark.createDataFrame([(i, "x", sha256(str(i).encode()).hexdigest()) for i in range(20)], "doc_id long, lang string, leaf string")
    got = mf.Manifest(df, "lang", ["doc_id"], "leaf").proofs()
    false_leaf = F.when(F.col("doc_id") % 7 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf"))
    seen = got.select("doc_id", (mf.folded(false_leaf, F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert {r["doc_id"] for r in seen if not r["ok"]} == {0, 7, 14}


# ------------------------------------------------------------------ op13


def brute_negatives(data, is_anchor):
    good = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v], k) for k, (i, label, v) in enumerate(data) if label is not None and usable(v)]
    order = lambda s: (-s[0], s[1][0] is None, s[1][0] or 0)
    out = []
    for a in good:
        if not is_anchor(a[0]):
            continue
        score = [(sum(x * y for x, y in zip(a[2], r[2], strict=False)), r) for r in good]
        best = sorted((s for s in score if s[1][1] == a[1] and s[1][3] != a[3]), key=order)[:5]
        others = sorted((s for s in score if s[1][1] != a[1]), key=order)
        for p, r in best:
            fit = [s for s in others if 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a[0], r[0], k, s[1][0], p, s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(df, anchor):
    got = hn.hard_negatives(df, anchor, "vec_id", "label", "embedding")
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_ROWS", 16)
    monkeypatch.setattr(hn, "ROWS_A_CELL", 32)
    monkeypatch.setattr(hn, "ANCHORS_A_CELL", 8)
    monkeypatch.setattr(hn, "BLOCK", 10)
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(0, 4)), list(rng.integers(-2, 6, size=6) / 8)) for i in range(300)]  # many equal scores
    data += [(1000 + i, label, v) for i, (_, label, v) in enumerate(ODD) if v is None or len(v) < 9] + [(1100, 3, [0.5, None]), (1101, None, [1.0] * 6), (1102, 9, [1.0] * 6)]
    data += [(50, 1, [0.5] * 6)] * 2 + [(None, 2, [0.25] * 6)] * 3 + [(77, 1, [0.5] * 8)]
    got = mined(frame(spark, data), F.col("vec_id") % 10 == 0)
    want = brute_negatives(data, lambda i: i is not None and i % 10 == 0)
    assert len(want) > 200 and got == want


def test_hard_negatives_great_values(spark):
    data = [(i, i % 2, [1e4 * (1 + i / 7), -2e4 / (1 + i), 3e3 * i]) for i in range(40)]
    assert mined(frame(spark, data), F.col("vec_id") % 5 == 0) == brute_negatives(data, lambda i: i % 5 == 0)


def test_hard_negatives_empty(spark):
    assert mined(frame(spark, []), F.col("vec_id") % 50 == 0) == []
    assert mined(frame(spark, [(0, 1, [1.0]), (50, 2, [1.0])]), F.col("vec_id") % 50 == 0) == []
