"""Url parsing and rules by plain Python, mined rules against a count of all token sets."""

from itertools import combinations

from varve.llm.url_rules import GIVEN_RULES, UrlRuleConfig, inverted_index, judge_urls, mine_rules


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))
    return host, path[:stop]


def rule(host, path):
    fits = []
    for text, verdict in GIVEN_RULES:
        own, rest = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((text, verdict))
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = ["https://a.Example.ORG/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://y.com/de/7#t", "http://y.net/de/7", "http://badexample.org/es/", "ftp://É.com:80/fr/é?q=/de/", "nothing", None, "", "://", "a://b://c/d", "http://org/", "https://m.z.net/de/3.html?page=2&ref=x#top"] * 3


def test_parsing_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, extra string")
    for r in judge_urls(pages).collect():
        host, path = parse(URLS[r.page_id])
        want, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert r.verdict == verdict if want else r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_are_all_confident_token_sets(spark):
    rows = [(["de", "net"], "block"), (["de", "com"], "block"), (["fr", "com"], "allow"), (["fr", "net"], "allow"), (["de", "org"], "allow"), (["com", "x"], "block")] * 3 + [(["de", "net"], "allow")]
    cfg = UrlRuleConfig(min_support=0.1, min_confidence=0.7)
    got = {(t, v): (round(c, 9), round(s, 9)) for t, v, c, s in mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), cfg)}
    want = {}
    tokens = sorted({t for r, _ in rows for t in r})
    for size in (1, 2):
        for some in combinations(tokens, size):
            for verdict in ("allow", "block"):
                have = [v for r, v in rows if set(some) <= set(r)]
                n = have.count(verdict)
                if n / len(rows) >= 0.1 and n / len(have) >= 0.7:
                    shorter = [c for (t, v), (c, _) in want.items() if v == verdict and t < frozenset(some)]
                    if not any(c >= round(n / len(have), 9) for c in shorter):
                        want[frozenset(some), verdict] = (round(n / len(have), 9), round(n / len(rows), 9))
    assert got == want
    index = inverted_index([(t, v, c, s) for (t, v), (c, s) in got.items()])
    assert sorted(k for ks in index.values() for k in ks) == list(range(len(got)))


def test_mined_rule_judges_uncovered_urls(spark):
    rows = [(k, f"http://s{k}.com/de/{k}") for k in range(30)] + [(100 + k, f"http://s{k}.com/fr/{k}") for k in range(30)] + [(900, "http://q.net/de/4"), (901, "http://q.net/fr/4")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[900].verdict == "block" and got[900].mined and got[901].verdict == "allow"


def test_tokens_that_occur_together_leave_other_rules(spark):
    rows = [([f"a{k}" for k in range(13)], "block")] * 10 + [(["q", "r"], "allow")] * 9 + [(["q"], "block")]
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), UrlRuleConfig())
    assert sorted((sorted(t), v, round(c, 9)) for t, v, c, _ in got) == sorted([([f"a{k}"], "block", 1.0) for k in range(13)] + [(["q"], "allow", 0.9), (["r"], "allow", 1.0)])
