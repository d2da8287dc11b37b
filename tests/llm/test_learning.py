"""What is learned and packed against plain versions: the ordinal fit and its cut, sequential covering, vector best fit."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from panelspark.llm import packing, quality_rules, toxicity  # noqa: E402


def plain_ordinal(x, grade, grades, penalty=1e-4, steps=60_000):
    """Dense gradient descent on the penalised likelihood, thresholds kept apart by projection; classes weigh alike."""
    n, d = x.shape
    positive = grade > 0
    row = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    w, gaps = np.zeros(d), np.ones(grades)
    rate = 1.0 / (0.25 * grades * (float((x**2).sum(axis=1) @ row) + grades) + penalty)
    for _ in range(steps):
        t = np.cumsum(gaps)
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        e = (p - (grade[:, None] >= np.arange(1, grades + 1))) * row[:, None]
        gw = x.T @ e.sum(axis=1) + penalty * w
        gt = np.array([-e[:, k:].sum() for k in range(grades)])
        w, gaps = w - rate * gw, gaps - rate * gt
        gaps[1:] = np.maximum(gaps[1:], toxicity.LEAST_GAP)
    return w, np.cumsum(gaps)


def loss(x, grade, grades, w, t, penalty=1e-4):
    positive = grade > 0
    row = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    m = (x @ w)[:, None] - t
    yes = grade[:, None] >= np.arange(1, grades + 1)
    return float((row[:, None] * np.where(yes, np.log1p(np.exp(-m)), np.log1p(np.exp(m)))).sum() + penalty / 2 * w @ w)


@pytest.mark.parametrize("grades", [1, 3])
def test_ordinal_fit_is_that_of_plain_gradient_descent(grades):
    r = np.random.default_rng(1)
    counts = r.integers(0, 4, (60, 5)) * (r.random((60, 5)) < 0.6)
    grade = np.minimum((counts[:, 0] + counts[:, 1] + r.integers(0, 2, 60)) // 2, grades)
    sparse = toxicity.Sparse.of([{h: int(n) for h, n in enumerate(row) if n} for row in counts], {h: h for h in range(5)})
    dense = np.log1p(counts)
    w, t = toxicity.fit_ordinal(sparse, grade, grades, penalty=0.01)
    pw, pt = plain_ordinal(dense, grade, grades, penalty=0.01)
    # plain descent still creeps along the last threshold: the loss decides
    assert w == pytest.approx(pw, abs=3e-3) and t == pytest.approx(pt, abs=1e-2) and (np.diff(t) >= toxicity.LEAST_GAP - 1e-12).all()
    assert loss(dense, grade, grades, w, t, 0.01) <= loss(dense, grade, grades, pw, pt, 0.01) + 1e-6


def test_grades_and_cut_of_the_model():
    r = np.random.default_rng(2)
    rows = []
    for k in range(150):
        toxic = k % 3 == 0
        counts = {h: int(n) for h, n in enumerate(r.integers(0, 3, 4) + (r.integers(0, 4, 4) if toxic else 0) * (np.arange(4) < 2)) if n}
        rows.append(toxicity.Example(counts, int(r.integers(5, 60)), int(toxic), k % toxicity.FOLDS))
    features = list(range(4))
    model = toxicity.learn(rows, [features] * (toxicity.FOLDS + 1))
    x = np.log1p(np.array([[e.counts.get(h, 0) for h in features] for e in rows]))
    y, fold = np.array([e.toxic for e in rows]), np.array([e.fold for e in rows])

    def unseen(grade, grades):
        out = np.zeros(len(rows))
        for k in range(toxicity.FOLDS):
            w, t = plain_ordinal(x[fold != k], grade[fold != k], grades, steps=20_000)
            out[fold == k] = x[fold == k] @ w - t[0]
        return out

    severity = unseen(y, 1) / np.log1p([e.words for e in rows])
    cuts = np.quantile(severity[y == 1], [1 / 3, 2 / 3])
    grade = np.array([0 if not t else 1 + sum(s > c for c in cuts) for s, t in zip(severity, y)])
    p = 1 / (1 + np.exp(-unseen(grade, toxicity.GRADES)))

    def lost(c):  # toxic ones missed, and clean ones rejected, that no fold's model has seen
        return (p[y == 1] < c).mean() + toxicity.CLEAN_LOST * (p[y == 0] >= c).mean()

    least = min(lost(c) for c in np.linspace(0, 1, 4001))
    assert lost(model.cut) <= least + 1 / (y == 1).sum() + 1e-9  # a row may stand on the other side of a plain fit
    w, t = plain_ordinal(x, grade, toxicity.GRADES, steps=20_000)
    mine = x @ model.weights[[model.features[h] for h in features]]
    assert np.corrcoef(mine, x @ w)[0, 1] > 0.999 and ((mine - model.thresholds[0] > 0) == (x @ w - t[0] > 0)).mean() > 0.98


# sequential covering


def plain_grow(rows, names, longest, cuts):
    conditions = []
    while len(conditions) < longest:
        bad = sum(not y for _, y in rows)
        if not bad or bad == len(rows):
            break
        best = (1e-9, None)
        for name in names:
            for t in quality_rules._thresholds([x[name] for x, _ in rows], cuts):
                for above in (False, True):
                    got = [y for x, y in rows if (x[name] > t) == above]
                    hit = sum(not y for y in got)
                    if hit:
                        gain = hit * (math.log2(hit / len(got)) - math.log2(bad / len(rows)))
                        if gain > best[0] + 1e-9 or (best[1] is None and gain > 1e-9):
                            best = (gain, (name, above, t))
        if not best[1]:
            break
        name, above, t = best[1]
        conditions.append(best[1])
        rows = [(x, y) for x, y in rows if (x[name] > t) == above]
    return conditions


def covers(conditions, x):
    return all((x[n] > t) == above for n, above, t in conditions)


def plain_learn(rows, names, max_rules=12, longest=4, precision=0.9, least_covered=3, cuts=32):
    rules, left = [], list(rows)
    while len(rules) < max_rules and any(not y for _, y in left):
        grow, prune = [r for k, r in enumerate(left) if k % 3], left[::3]
        conditions, best = plain_grow(grow, names, longest, cuts), (None, -2.0)
        for k in range(1, len(conditions) + 1):
            got = [y for x, y in prune if covers(conditions[:k], x)]
            bad = sum(not y for y in got)
            worth = (bad - (len(got) - bad)) / len(got) if got else -1.0
            if worth > best[1] + 1e-9:
                best = (conditions[:k], worth, bad / len(got) if got else 0.0, len(got))
        if not best[0] or best[2] < precision or best[3] < least_covered:
            break
        rules.append(best[0])
        left = [(x, y) for x, y in left if not covers(best[0], x)]
    return rules


@pytest.mark.parametrize("seed", range(8))
def test_covering_is_that_of_plain_search(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(r.choice([120, 300])):
        x = {n: r.randint(0, 40) for n in "abcd"}
        rows.append((x, r.random() < 0.05 if x["a"] > 20 or (x["b"] < 8 and x["c"] > 15) else r.random() < 0.95))
    learned = quality_rules.learn(rows, list("abcd"))
    assert [[(c.statistic, c.above, c.threshold) for c in rule.conditions] for rule in learned.rules] == plain_learn(rows, list("abcd"))
    for x, _ in rows:
        assert any(rule.covers(x) for rule in learned.rules) == any(covers(c, x) for c in plain_learn(rows, list("abcd")))


# vector best fit


def plain_best_fit(lengths, caps, weights, rule):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [lengths[i] / caps[0], 1 / caps[1], lengths[i] ** 2 / caps[2]]
        best = None
        for k, b in enumerate(bins):
            if all(have >= want - 1e-12 for have, want in zip(b["left"], need)):
                if rule == "norm":
                    score = sum(w * (h - n) ** 2 for w, h, n in zip(weights, b["left"], need))
                else:
                    score = -sum(w * h * n for w, h, n in zip(weights, b["left"], need))
                if best is None or score < best[0] - 1e-13:
                    best = (score, k)
        if best is None:
            bins.append({"left": [1.0, 1.0, 1.0], "used": 0})
            best = (0.0, len(bins) - 1)
        b = bins[best[1]]
        out[i] = (best[1], b["used"])
        b["used"] += lengths[i]
        b["left"] = [h - n for h, n in zip(b["left"], need)]
    return out, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, 64, 4096), (64, 4, 4096), (64, 64, 1500), (100, 7, 3000)])
def test_best_fit_is_that_of_plain_search(rule, limits):
    r = np.random.default_rng(5)
    for weights in ((1.0, 0.25, 0.25), (0.3, 1.0, 2.0)):
        lengths = r.integers(1, 38 if limits[2] < 4096 else 64, 200)
        sequence, offset, n = packing.vector_best_fit(lengths, limits, weights, rule)
        want, bins = plain_best_fit(lengths.tolist(), limits, weights, rule)
        assert n == bins and list(zip(sequence.tolist(), offset.tolist())) == want
        for k in range(n):
            mine = lengths[sequence == k]
            assert mine.sum() <= limits[0] and len(mine) <= limits[1] and (mine**2).sum() <= limits[2]
