"""The url model against a plain-Python version, and what a model of trigrams cannot tell apart."""

import math
import random
from collections import Counter, defaultdict

import pytest

from panelspark.llm import urls

RULES = [urls.Rule("block", "bad.com", ""), urls.Rule("allow", "good.com", "")]


def pages(spark, given):
    return spark.createDataFrame(list(enumerate(given)), "page_id long, url string")


def brute(counted, asked, order):
    """Mean log ratios of texts; counted: (text, rejected)."""
    n, follow = {False: Counter(), True: Counter()}, {False: defaultdict(Counter), True: defaultdict(Counter)}

    def grams(t):
        t = urls.START + t + urls.END
        return [t[max(0, i - order) : i + 1] for i in range(1, len(t))]

    for t, r in counted:
        for w in grams(t):
            for k in range(len(w)):
                follow[r][w[k:-1]][w[-1]] += 1
    kinds = {w[-1] for t in [*(t for t, _ in counted), *asked] for w in grams(t)}

    def p(r, w):
        below = p(r, w[1:]) if len(w) > 1 else 1.0 / (len(kinds) + 1)
        f = follow[r].get(w[:-1])
        return below if not f else (f[w[-1]] + len(f) * below) / (sum(f.values()) + len(f))

    return [sum(round((math.log(p(True, w)) - math.log(p(False, w))) * 1e6) for w in grams(t)) / len(grams(t)) / 1e6 for t in asked]


def test_scores_as_plain_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("aé日😀b7/") for _ in range(r.randrange(0, 12))) for _ in range(60)]
    rows = [(k, "http://" + t if t else None, k % 3 > 0, k % 2 == 0) for k, t in enumerate(texts)]
    got = {x["row"]: x["score"] for x in urls.scores(spark.createDataFrame(rows, "row long, url string, counts boolean, rejected boolean")).collect()}
    used = [x for x in rows if x[1]]
    text = lambda x: x[1][7:]
    order = urls.order_for(sum(len(x[1]) for x in used if x[2]))
    theirs = brute([(text(x), x[3]) for x in used if x[2]], [text(x) for x in used], order)
    assert order > 2 and got == pytest.approx({x[0]: v for x, v in zip(used, theirs)}, abs=2e-6)


def test_digits_and_long_words_are_told_apart(spark):
    given = [f"http://bad.com/x{k}/item5" for k in range(200)] + [f"http://good.com/x{k}/item7" for k in range(200)]
    given += ["http://else.com/x3/item5", "http://else.com/x3/item7"]
    got = [x["score"] for x in urls.judge_urls(pages(spark, given), RULES).orderBy("page_id").collect()][-2:]
    assert got[0] > got[1] + 1e-3
    # both words have the same trigrams
    words = ("qabrabsabt", "qabsabrabt")
    given = [f"http://bad.com/{k}/{words[0]}" for k in range(200)] + [f"http://good.com/{k}/{words[1]}" for k in range(200)]
    given += [f"http://else.com/q/{w}" for w in words]
    got = [x["score"] for x in urls.judge_urls(pages(spark, given), RULES).orderBy("page_id").collect()][-2:]
    assert got[0] > got[1] + 1e-3


def test_order_grows():
    assert [urls.order_for(8**k) for k in (1, 5, 9)] == [2, 5, 9]


def test_urls_within_urls(spark):
    given = [f"http://bad.com/casino{k}" for k in range(200)] + [f"http://good.com/garden{k}" for k in range(200)]
    given += ["http://casino.org/go?u=https://good.com/garden7", "http://garden.org/go?u=https://good.com/garden7"]
    got = [x["score"] for x in urls.judge_urls(pages(spark, given), RULES).orderBy("page_id").collect()][-2:]
    assert got[0] > got[1] + 1e-3


def test_held_back_error(spark):
    r = random.Random(8)
    given = [f"http://{h}/{w * r.randint(1, 3)}{r.randint(0, 99)}" for h, w in (("bad.com", "casino"), ("good.com", "garden")) for _ in range(150)]
    got = {x["said"]: (x["n"], x["wrong"]) for x in urls.held_back_error(pages(spark, given), RULES).collect()}
    assert set(got) == {"allow", "block"} and sum(n for n, _ in got.values()) < 120 and all(n > 10 and wrong <= 0.1 * n for n, wrong in got.values())
    assert urls.held_back_error(pages(spark, ["http://good.com/a"]), RULES).collect() == []
