"""Rules and host reputation against a direct calculation."""

import random
import string

from probscape.llm import queries, url_reputation

ROW = "url string, page_id long, host string, rule string, rows long"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    ends = [rest.find(c) for c in "?#" if c in rest]
    whole = rest[: min(ends)] if ends else rest
    cut = whole.find("/") if "/" in whole else len(whole)
    return whole[:cut].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), whole[cut:]


def rule_of(host, path, rules):
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else (None, None)


def names(host):
    bare = host.rsplit("@", 1)[-1]
    head, colon, port = bare.rpartition(":")
    bare = head if colon and (port == "" or port.isdigit()) else bare
    if bare and set(bare) <= set("0123456789."):
        return bare, ""
    labels = bare.split(".")
    two = ".".join(labels[-2:])
    return (".".join(labels[-3:]), two) if two in url_reputation.TWO_NAMES else (two, labels[-1])


def shrunk(groups, parents):
    """(n, k) of groups and (mean, variance) of their parents to the groups' posterior mean and variance."""
    noise = spread = room = 0.0
    for key, (n, k) in groups.items():
        m, _ = parents[key]
        if n:
            noise, spread, room = noise + m * (1 - m), spread + (k - n * m) ** 2 / n, room + (n - 1) * m * (1 - m)
    rho = min(0.999, max(0.001, (spread - noise) / room)) if room else 0.999
    s, out = 1 / rho - 1, {}
    for key, (n, k) in groups.items():
        m, v = parents[key]
        wide = (s + 1) * m * (1 - m) / (m * (1 - m) + v * s) - 1
        a, b = wide * m + k, wide * (1 - m) + n - k
        out[key] = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    return out


def brute(rows, rules):
    pages = [(r[1], *split(r[0]), *rule_of(*split(r[0]), rules)) for r in rows]
    hosts, domains, suffixes = {}, {}, {}
    for _, host, _, rule, verdict in pages:
        d, s = names(host)
        for t, key in ((hosts, host), (domains, (s, d)), (suffixes, s)):
            n, k = t.get(key, (0, 0))
            t[key] = n + (rule is not None), k + (verdict == "block")
    a, b = sum(k for _, k in suffixes.values()) + 0.5, sum(n - k for n, k in suffixes.values()) + 0.5
    top = shrunk(suffixes, dict.fromkeys(suffixes, (a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1)))))
    middle = shrunk(domains, {k: top[k[0]] for k in domains})
    leaf = shrunk(hosts, {h: middle[names(h)[1], names(h)[0]] for h in hosts})
    bad = {h: m - 2 * v**0.5 > 0.5 for h, (m, v) in leaf.items()}
    return [(i, h, p, r, v or ("block" if bad[h] else "allow")) for i, h, p, r, v in pages], leaf


def judged(spark, rows, rules=RULES):
    found = url_reputation.judged(spark.createDataFrame(rows, ROW).repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"))
    return [tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict").collect()]


def key(r):
    return tuple((v is not None, v) for v in r)


def test_against_brute_force(spark):
    rng = random.Random(8)
    hosts = ["www.example.com", "a.www.example.com", "b.example.com", "Example.com", "xexample.com", "good.net", "bad.example.net", "worse.example.net", "x.org", "y.co.uk", "z.y.co.uk", "net", "1.2.3.4", "u@h.net:80"]
    paths = ["", "/", "/en", "/en/1", "/es/2?x=/fr/", "/fr/#a?b", "?q=/en/", "#/", "/En/3", "/de/://es/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)]
    urls += ["http://bad.example.net/es/" + str(i) for i in range(80)] + [None, "", "no scheme", "://", "http:///en/", "http://É.net/fr/" + "x" * 100_000, "a\nb://q.net/fr/\nx"] * 2
    rows = [(u, i // 2, "clash", "clash", 7) for i, u in enumerate(urls)]
    expected, leaf = brute(rows, RULES)
    assert sorted(judged(spark, rows), key=key) == sorted(expected, key=key)
    assert min(abs(m - 2 * v**0.5 - 0.5) for m, v in leaf.values()) > 1e-6
    verdicts = {(h, r is None): v for _, h, _, r, v in expected}
    assert verdicts["bad.example.net", True] == "block" and verdicts["x.org", True] == "allow"


def test_rare_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_reputation, "HOT", 0.2)
    rows = [(f"http://h{i % 50 if i % 3 else 0}.{'net' if i % 2 else 'org'}/{'fr' if i % 5 else 'de'}/", i, None, None, None) for i in range(400)]
    assert sorted(judged(spark, rows), key=key) == sorted(brute(rows, RULES)[0], key=key)


def test_no_rules_and_no_rows(spark):
    rows = [("http://a.net/", 1, None, None, None), (None, None, None, None, None)]
    assert sorted(judged(spark, rows, []), key=key) == [(None, "", "", None, "allow"), (1, "a.net", "/", None, "allow")]
    assert judged(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.url, r.page_id, None, None, None) for r in spark.read.parquet(f"{folder}/pages.parquet").select("url", "page_id").collect()]
    found = queries.QUERIES["op12_url_reputation"](spark, folder)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, RULES)[0], key=key)
