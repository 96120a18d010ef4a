import re
from collections import defaultdict

import pytest

from riskmart.llm.urlrules import RULES, judged_urls

PAGES = [
    (1, "http://A.example.org/es/1", "<a href='http://b.test/x'>"),
    (2, "https://x.example.org/en/12?q#f", '<a href="https://spam.test/">'),
    (3, "http://site.com/fr/a", '<a href=http://good.test/1> <img src="//cdn.good.test/i">'),
    (4, "http://site.com/de/a", None),
    (5, "http://linker.test/", '<a href="http://site2.com/de/">'),
    (6, "http://site2.com/de/x", ""),
    (7, "http://good.test/1", "<a href='/relative'>"),
    (8, "http://spam.test", "<p>"),
    (9, None, "<a href='http://good.test/'>"),
    (10, "no scheme", ""),
    (11, "http://example.org", ""),
    (12, "http://notexample.org/es/", ""),
    (13, "http://fr.com:80/fr/", ""),
    (14, "x://y://z/w", ""),
    (14, "x://y://z/w", ""),
    (15, "http://b.test/a?://c/d", ""),
    (16, "\nhttp://Ünï.com/fr/\n", ""),
    (17, "http://alone.net/en", ""),
    (18, "HTTP://CDN.GOOD.TEST#/fr/", None),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.split(r"[?#]", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for verdict, name, prefix in RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
            best = (name + prefix, verdict)
    return best


def masses(edges, seeds, rounds=300, damping=0.85):
    total = sum(seeds.values())
    if not total:
        return {}
    base = {h: m / total for h, m in seeds.items()}
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(base)
    for _ in range(rounds):
        after = defaultdict(float, {h: (1 - damping) * m for h, m in base.items()})
        for (a, b), w in edges.items():
            after[b] += damping * rank.get(a, 0) * w / out[a]
        rank = after
    return rank


def expected(pages):
    edges, hosts, seeds = defaultdict(float), set(), {"allow": defaultdict(float), "block": defaultdict(float)}
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        hosts.add(host)
        if rule(host, path):
            seeds[rule(host, path)[1]][host] += 1
        for link in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)""", html or ""):
            to = split("http:" + link if link.startswith("//") else link)[0]
            if to and to != host:
                edges[host, to] += 1
                hosts.add(to)
    family = set()
    for host in hosts:
        parts = host.split(".")
        chain = [".".join(parts[-i:]) for i in range(2, len(parts))] + [host]
        for a, b in zip(chain, chain[1:], strict=False):
            family |= {(a, b), (b, a)}
    for pair in family:
        edges[pair] += 1
    trust = masses(edges, seeds["allow"])
    distrust = masses({(b, a): w for (a, b), w in edges.items()}, seeds["block"])
    out = []
    for page, url, _ in pages:
        host, path = split(url)
        hit = rule(host, path)
        verdict = hit[1] if hit else ("block" if distrust.get(host, 0) > 0.5 * (trust.get(host, 0) + distrust.get(host, 0)) else "allow")
        out.append((page, host, path, hit[0] if hit else None, verdict))
    return out


def test_rules_and_spread_trust(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")
    got = [tuple(r)[:5] for r in judged_urls(pages).collect()]
    assert sorted(got, key=repr) == sorted(expected(PAGES), key=repr)
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[5] == "block" and verdicts[7] == "allow" and verdicts[17] == "allow"


def test_trust_reaches_the_end_of_long_chains(spark):
    """A chain of 40 hosts behind a trusted one, and 40 that lead to a blocked one."""
    pages = [(0, "http://a0.com/fr/", "<a href='http://a1.t/'>"), (1000, "http://b0.com/de/", "")]
    pages += [(i, f"http://a{i}.t/", f"<a href='http://a{i + 1}.t/'>") for i in range(1, 40)]
    pages += [(1000 + i, f"http://b{i}.t/", f"<a href='http://b{i - 1}.{'t' if i > 1 else 'com'}/'>") for i in range(1, 40)]
    rows = judged_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in rows}
    assert all(got[i].trust > 0 and got[i].verdict == "allow" for i in range(1, 40))
    assert all(got[1000 + i].distrust > 0 and got[1000 + i].verdict == "block" for i in range(1, 40))
    assert [tuple(r)[:5] for r in sorted(rows)] == sorted(expected(pages))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "http://h.net/", "")]])
def test_no_seeds(spark, rows):
    got = judged_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.verdict for r in got] == ["allow"] * len(rows)
