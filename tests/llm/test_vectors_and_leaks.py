"""Whitening, hard negatives and decontamination against brute force: nulls, ties, repeated rows, other lengths, empty tables, clashing names."""

import random
import re
from decimal import Decimal

import numpy as np
import pytest

from rasterjobs.llm import decontamination, hard_negatives, whitening

VECTORS = "vec_id long, embedding array<double>, label int"


# --- 11 whitening


def spectra():
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield np.diag([5.0]), 1
    yield turn @ np.diag(np.arange(1, 41) ** 2.0) @ turn.T, 40
    yield turn @ np.diag(np.round(np.sort(rng.exponential(size=40) * 3))) @ turn.T, None  # many equal and zero eigenvalues
    yield turn @ np.diag(2.0 ** -np.arange(40)) @ turn.T, 40
    yield np.eye(40) * 1e-9, 40
    yield np.cov(rng.normal(size=(64, 500))), 64


@pytest.mark.parametrize("v,rank", list(spectra()))
def test_contour_integration_finds_all_leading_components(v, rank):
    v = (v + v.T) / 2
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    rank = int((want > 1e-12 * want[0]).sum()) if rank is None else rank
    e, q = whitening.leading(v, 32)
    assert len(e) == min(32, rank) and np.abs(e - want[: len(e)]).max() < 1e-13 * want[0]
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-7 and np.abs(v @ q - q * e).max() < 1e-12 * want[0]
    diagonal, off = whitening.tridiagonal(v)
    for at in (want[0] / 2, want[0] / 3 + 1e-9, -1.0, 2 * want[0]):
        assert whitening.inertia(diagonal, off, at) == (want < at).sum()


def test_an_interval_ends_only_with_as_many_components_as_its_inertia():
    v = np.diag([1.0, 2.0, 3.0, 9.0])
    e, _ = whitening.interval(v, 0.5, 3.5, 3)
    assert np.allclose(e, [3, 2, 1])
    with pytest.raises(ArithmeticError):
        whitening.interval(v, 0.5, 3.5, 2)


def test_whitening_matches_dense_algebra(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * 0.3
    good = [(i if i % 50 else None, v.tolist(), 0) for i, v in enumerate(x)]
    good += good[:7]  # repeated rows
    bad = [(900, None, 1), (901, [None] * 5, 1), (902, [float("nan")] * 5, 1), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    df = spark.createDataFrame(good + bad, VECTORS).selectExpr("*", "1 AS component", "2 AS n", "'x' AS whitened").repartition(5)
    rows = whitening.whitening(df, 4).collect()
    y = np.array([[int(np.floor(64 * c)) for c in v] for _, v, _ in good], dtype=object)
    n, total = len(y), y.sum(axis=0)
    plain = y.astype(float)
    covariance = np.cov(plain.T, bias=True)
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    z = (plain - plain.mean(axis=0)) @ q / np.sqrt(e)
    want = sorted((-1 if i is None else i, k + 1, n, int(((n * y[r] - total) ** 2).sum()), round(abs(z[r, k]), 8), round(e[k] / np.trace(covariance), 10)) for r, (i, _, _) in enumerate(good) for k in range(4))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 8), round(r.explained, 10)) for r in rows) == want
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_whitening_without_variance_and_beyond_a_long(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], VECTORS)
    assert whitening.whitened(same).count() == 0 and whitening.whitened(same.limit(1)).count() == 0 and whitening.whitened(same.where("false")).count() == 0
    x = [[1e9, 3e8], [-1e9, 2e8], [5e8, -4e8]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], VECTORS)
    y = np.array([[int(64 * c) for c in v] for v in x], dtype=object)
    want = [int(((3 * r - y.sum(axis=0)) ** 2).sum()) for r in y]
    assert {r.vec_id: r.deviation for r in whitening.whitened(df).collect()} == {i: Decimal(w) for i, w in enumerate(want)}
    assert {r.deviation for r in whitening.whitening(df).collect()} == {None}
    e = np.linalg.eigvalsh(np.cov(y.astype(float).T, bias=True))[::-1]
    assert {r.component: r.explained for r in whitening.whitened(df).collect()} == pytest.approx({k + 1: v / e.sum() for k, v in enumerate(e)}, rel=1e-6)


# --- 12 hard negatives


def hard_by_hand(rows, every, positives=5, negatives=10, least=30, most=90):
    good = [(i, label, v) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, len(v), v)), (label, len(v), v))
    out = []
    for a, (label, _, v) in anchors.items():
        scored = sorted((-int(np.dot(v, w)), i, other == label) for i, other, w in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [(i, -t) for t, i, same in scored if not same and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("n,numbers", [(0, 60), (1, 60), (260, 60), (400, 1 << 18)])
def test_hard_negatives_match_brute_force(spark, n, numbers):
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(-3, 6, 6).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    if n > 1:
        rows += [(10, None, 1), (20, [None] * 6, 1), (30, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (40, [2.0] * 6, None), (50, [float("inf")] * 6, 0)]
        rows += rows[:15] + [(1000 + i, [2.0] * 6, i % 2) for i in range(n)]  # repeated rows; one vector for half of all
        rows += [(1990, [1.0, 2.0], 0), (1991, [3.0, 4.0], 0), (1992, [1.0, 3.0], 1), (1980, [], 0), (1981, [], 0), (10, [-1.0] * 6, 0)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS score", "vec_id AS anchor_id", "0 AS one")
    got = hard_negatives.mine(df, every=10, scale=1, shard_numbers=numbers, block=8).collect()
    assert sorted(tuple(r) for r in got) == hard_by_hand(rows, 10)


def test_multi_sequence_gives_all_pairs_by_falling_sum():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
    got = list(hard_negatives.multi_sequence(a, b))
    assert [s for s, _, _ in got] == sorted((x + y for x in a for y in b), reverse=True)
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(7) for j in range(5)} and all(s == a[i] + b[j] for s, i, j in got)
    assert list(hard_negatives.multi_sequence(a[:0], b)) == []


def test_certified_windows_leave_most_of_clustered_vectors_unscored(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    which = rng.integers(0, 30, 6000)
    x = centres[which] + rng.normal(size=(6000, 16)) * 0.05
    df = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist(), int(w % 7)) for i, (v, w) in enumerate(zip(x, which, strict=True))], VECTORS)
    index = hard_negatives.index_of(df, shard_numbers=200 * 16)
    met = index.windows(hard_negatives.anchors_of(index, 100), True, 5, count=True).where("scored is not null")
    n, scored = met.selectExpr("count(*)", "sum(scored)").first()
    assert scored < 0.15 * 60 * 6000 and n < 0.3 * 60 * index.count  # rows, and meetings of anchor and shard


# --- 13 decontamination


def leaks_by_hand(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = {}
    for item, text in items:
        ws = words(text)
        m = min(window, len(ws))
        for p in range(len(ws) - m + 1 if m else 0):
            runs.setdefault(tuple(ws[p : p + m]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in {len(r) for r in runs}:
            for p in range(len(ws) - m + 1):
                if tuple(ws[p : p + m]) in runs:
                    hit |= set(range(p, p + m))
                    found |= {i for i in runs[tuple(ws[p : p + m])] if i is not None}
        hit = hit if found else set()
        out.append((-1 if doc is None else doc, len(ws), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("window,shingle,bits", [(10, 5, 1 << 29), (4, 3, 64), (3, 5, 1 << 29)])
def test_decontamination_matches_brute_force(spark, window, shingle, bits, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BITS", bits)  # a full bitmap lets every shingle through
    monkeypatch.setattr(decontamination, "HITS", 50)
    rng = random.Random(window)
    some = lambda n: " ".join(rng.choice(["Al", "be", "ce", "Dé", "e9", "ﬀ", "日本", "go"]) for _ in range(n))
    items = [(i, some(rng.randrange(1, 25))) for i in range(30)] + [(30, None), (31, ""), (32, "?!"), (33, "al"), (None, "be ce"), (5, "go go go go go go go go go go go")]
    items += [(40 + i, items[3][1].upper().replace("É", "é").replace("ﬀ".upper(), "ﬀ")) for i in range(20)]  # copies
    docs = [(i, some(rng.randrange(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "., -"), (None, items[1][1]), (3, items[2][1]), (53, some(9000))]
    docs += [(60 + i, f"x {items[k][1]}, y.{items[k + 1][1]}") for i, k in enumerate(range(0, 28, 3))] + [(60, f"x {items[0][1]}, y.{items[1][1]}")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'t' AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    rows = decontamination.decontaminate(a.repartition(3), b, window, shingle).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in rows)
    assert got == leaks_by_hand(docs, [(i, t) for i, t in items if i is not None], window)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contaminated(docs.where("false"), items).count() == 0
    assert [tuple(r)[:4] + (r.contaminated,) for r in decontamination.contaminated(docs, items.where("false")).collect()] == [(1, 3, 0, 0, False)]
