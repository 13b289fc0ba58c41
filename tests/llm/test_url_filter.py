import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from panelwright.llm import url_filter as u

SCHEMA = "page_id long, url string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    best = None
    for verdict, rule in u.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def plain(urls, order=u.ORDER):
    """Brute force: two models by recursion, one character after the other."""
    text = lambda x: "\x02" + (x or "").translate(LOW | {2: "\x01", 3: "\x01"}) + "\x03"
    judged = [rule_of(x) for x in urls]
    held = [crc32((x or "").encode()) % 5 == 0 for x in urls]
    follow = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    chars = set()
    for x, (_, _, r), h in zip(urls, judged, held, strict=True):
        if r and not h:
            t = text(x)
            for p in range(1, len(t)):
                chars.add(t[p])
                for k in range(min(p, order) + 1):
                    follow[r[0]][t[p - k : p]][t[p]] += 1

    def prob(kind, context, c):
        seen = follow[kind][context] if context in follow[kind] else Counter()
        n, t = sum(seen.values()), len(seen)
        if not context:
            return (seen[c] + 1) / (n + len(chars) + 1)
        below = prob(kind, context[1:], c)
        return (seen[c] + t * below) / (n + t) if n else below

    def score(x):
        t = text(x)
        total = sum(math.log(prob("allow", t[max(0, p - order) : p], t[p])) - math.log(prob("block", t[max(0, p - order) : p], t[p])) for p in range(1, len(t)))
        return total * 1000 / (len(t) - 1)

    scores = [score(x) for x in urls]
    fresh = [(math.floor(s + 1e-7), r[0]) for s, (_, _, r), h in zip(scores, judged, held, strict=True) if r and h]
    cut = 0
    if len({v for _, v in fresh}) == 2:
        a, b = sum(v == "allow" for _, v in fresh), sum(v == "block" for _, v in fresh)
        found = sorted({s for s, _ in fresh})
        gain = lambda c: sum(v == "block" and s < c for s, v in fresh) * a - sum(v == "allow" and s < c for s, v in fresh) * b
        best = max(found, key=lambda c: (gain(c), -c))
        lower = [s for s in found if s < best]
        cut = (lower[-1] + 1 + best) // 2 if lower else best
    return judged, scores, cut


def corpus():
    rng = random.Random(2)
    good, bad = ["garden", "river", "museum", "library"], ["casino", "bonus", "jackpot", "spins"]
    urls = []
    for i in range(260):
        words = good if (kind := rng.random()) < 0.5 else bad
        name, page = "".join(rng.choices(words, k=2)), "-".join(rng.choices(words, k=3))
        host = {True: rng.choice(["www.%s.com", "%s.com", "www.example.com/en/%s"]), False: rng.choice(["%s.net/es", "m.%s.net/fr"])}[kind < 0.5] % name
        urls.append(f"http://{host}/{page}/{i % 40}?q={i % 3}")
        if i % 4 == 0:
            urls.append(f"https://{name}.org/{page}")
    urls += ["HTTP://WWW.Example.COM/en/A", "http://example.com/EN/a", "http://example.com", "http://xexample.com/en/1", "a://b.example.com/en/?x://y.net/fr/", "http://net/es/", "http://com/x", "http://Xnet/es/"]
    urls += [None, "", "no scheme", "://", "://com/", "ftp://ü\U0001f600.net/fr/é", "http://x.org/\x02\x03", "line\nbreak://a.com/\nb", urls[0], urls[0], "http://long.org/" + "ab" * 20_000]
    return urls


@pytest.mark.parametrize("broadcast_bytes", [u.BROADCAST_BYTES, -1])
def test_equals_brute_force_by_broadcast_and_by_shuffle(spark, broadcast_bytes):
    urls = corpus()
    judged, scores, cut = plain(urls)
    pages = spark.createDataFrame([(i, x, "h", "k") for i, x in enumerate(urls)], SCHEMA + ", host string, text string").repartition(6)
    got = {r.page_id: r for r in u.judged_urls(pages, broadcast_bytes=broadcast_bytes, head_share=50).collect()}
    assert len(got) == len(urls)
    for i, (host, path, best) in enumerate(judged):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        if best:
            assert r.verdict == best[0] and r.score is None
        else:
            assert abs(r.score + 0.5 - scores[i]) <= 0.51
            if abs(scores[i] - cut) > 1:
                assert r.verdict == ("allow" if scores[i] >= cut else "block")
    unruled = [(urls[i], r.verdict) for i, r in got.items() if r.rule is None and urls[i] and ".org/" in urls[i]]
    right = [v == ("allow" if re.search("garden|river|museum|library", x) else "block") for x, v in unruled if re.search("[a-z]{4}-[a-z]", x)]
    assert len(right) > 50 and sum(right) == len(right)


def test_rules():
    cases = {"http://a.example.com/en/1": "example.com/en/", "http://www.example.com/en/1": "www.example.com/en/", "http://x.www.example.com/en/": "www.example.com/en/", "http://example.com/fr/": "com/", "http://a.net/fr": None, "http://a.net/fr/": "net/fr/"}
    assert {x: (rule_of(x)[2] or (0, None))[1] for x in cases} == cases


def test_one_kind_only_empty_and_equal_urls(spark):
    assert u.judged_urls(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(i, f"http://a{i}.com/x") for i in range(30)] + [(90, "http://a.org/x"), (91, None), (None, "http://a.org/x")], SCHEMA)
    got = u.judged_urls(only).collect()
    assert len(got) == 33 and {r.verdict for r in got if r.rule} == {"allow"} and {r.page_id for r in got if not r.rule} == {90, 91, None}
    none = u.judged_urls(spark.createDataFrame([(1, "x"), (1, "x")], SCHEMA)).collect()
    assert [(r.verdict, r.score) for r in none] == [("allow", 0)] * 2


def test_blocked_pages_go(spark):
    pages = spark.createDataFrame([(i, x, "w") for i, x in enumerate(corpus())], "page_id long, url string, _gone string")
    verdicts = {r.page_id: r.verdict for r in u.judged_urls(pages).collect()}
    kept = u.drop_blocked(pages)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.collect()) == sorted(i for i, v in verdicts.items() if v == "allow")


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame(list(enumerate(corpus())), SCHEMA)
    for limit in (u.BROADCAST_BYTES, -1):
        plan = u.judged_urls(pages, broadcast_bytes=limit)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
