import math
import random
import re
from collections import defaultdict

import pytest

from noticemill.llm import urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for verdict, rule in RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


def far(a, b):
    cells = [k for k in range(len(a)) if a[k] + b[k]]
    na, nb = sum(a), sum(b)
    if len(cells) < 2:
        return -math.inf
    g = 0.0
    for k in cells:
        for own, n in ((a[k], na), (b[k], nb)):
            if own:
                g += 2 * own * math.log(own / ((a[k] + b[k]) * n / (na + nb)))
    df = len(cells) - 1
    return ((max(g, 0) / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))


def brute(pages, wide=16, depth=8):
    """The tree with dictionaries: every page walks down from its host's root, level by level."""
    parsed = [(p, *parse(u)) for p, u in pages]
    rules = [ruled(h, x) for _, h, x in parsed]
    shapes = [[] if x == "" else re.sub("^/", "", re.sub("[0-9]+", "#", x)).split("/") for _, _, x in parsed]
    nodes = [(h,) for _, h, _ in parsed]
    for level in range(depth):
        kids = defaultdict(lambda: defaultdict(lambda: [0] * 6))
        for node, s, r in zip(nodes, shapes, rules):
            if len(s) > level:
                kind = {"block": 0, "allow": 2}.get(r[0] if r else None, 4) + (len(s) > level + 1)
                kids[node][s[level]][kind] += 1
        names = {}
        for node, own in kids.items():
            if len(own) > wide:
                names[node] = dict.fromkeys(own, "*")
                continue
            groups = {(k,): v for k, v in own.items()}
            while len(groups) > 1:
                z, a, b = min((far(groups[a], groups[b]), a, b) for a in groups for b in groups if a < b)
                if z >= urls.ALIKE:
                    break
                groups[tuple(sorted(a + b))] = [x + y for x, y in zip(groups.pop(a), groups.pop(b))]
            names[node] = {k: k if len(g) == 1 else "{" + "|".join(g) + "}" for g in groups for k in g}
        nodes = [node + (names[node][s[level]],) if len(s) > level else node for node, s in zip(nodes, shapes)]
    nodes = [node + ("**",) if len(s) > depth else node for node, s in zip(nodes, shapes)]
    n, bad = defaultdict(int), defaultdict(int)
    for node, r in zip(nodes, rules):
        for k in range(1, len(node) + 1):
            n[node[:k]] += 1
            bad[node[:k]] += bool(r and r[0] == "block")
    overall = sum(bool(r and r[0] == "block") for r in rules) / max(len(rules), 1)
    out = []
    for (p, h, x), r, node in zip(parsed, rules, nodes):
        share = (bad[(h,)] + 4 * overall) / (n[(h,)] + 4)
        purity = (bad[node] + 4 * share) / (n[node] + 4)
        if r:
            out.append((p, h, x, r[1], r[0], None))
        else:
            out.append((p, h, x, None, "block" if purity >= 0.8 else "allow", "/" + "/".join(node[1:]) if purity >= 0.8 else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in df.collect()), key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(p, u, "<html>", "x", 1, 2) for p, u in pages],
                                 "page_id long, url string, html string, host string, verdict int, template int")


def web(rng, n):
    pages = []
    for k in range(n):
        host = rng.choice(["a.example.com", "b.Example.com", "c.example.net", "d.org", "example.com", "fraexample.net", "x.y.example.net:80"])
        lang = rng.choice(["de", "de", "en", "fr", "es"])
        leaf = rng.choice([f"{rng.randrange(999)}", f"{rng.randrange(99)}.html", f"tag{rng.randrange(40)}x", "", f"q/{rng.randrange(5)}/z", "deep/" * 9 + "end"])
        pages.append((k, f"{rng.choice(['http', 'https'])}://{host}/{lang}/{leaf}{rng.choice(['', '?a=/b', '#t', '?x#y'])}"))
    return pages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filter_equals_brute_force(spark, seed):
    pages = web(random.Random(seed), 400) + [
        (900, None), (901, ""), (902, "no scheme"), (903, "http://"), (904, "http://net"), (905, "http://net/"), (906, "HTTP://A.NET/en/?q"),
        (907, "x://y://z/en/"), (908, "http://Ä.example.com/de"), (909, "http://example.net/en/x"), (909, "http://example.net/en/x"), (None, "http://q.org/fr/\n1")]
    pages += [(1000 + k, "http://a.example.com/de") for k in range(2)]
    assert found(urls.filter_urls(frame(spark, pages))) == brute(pages)
    assert found(urls.filter_urls(frame(spark, pages), wide=3, depth=2)) == brute(pages, 3, 2)


def test_a_branch_of_blocked_pages_takes_its_undecided_pages_with_it(spark):
    pages = [(k, f"http://shop.example.com/de/{k}") for k in range(40)] + [(100 + k, f"http://shop.example.com/en/{k}") for k in range(40)]
    rows = {r["page_id"]: r for r in urls.filter_urls(frame(spark, pages + [(200, "http://shop.example.com/de")])).collect()}
    assert rows[200]["rule"] is None and rows[200]["verdict"] == "block" and rows[200]["template"] == "/de"
    assert all(rows[100 + k]["verdict"] == "allow" for k in range(40)) and all(rows[k]["rule"] == "example.com/de/" for k in range(40))


def test_alike_branches_merge_and_unlike_ones_do_not():
    assert urls.merge_alike({"a": [30, 0], "b": [28, 1], "c": [0, 40]}) == {"a": "{a|b}", "b": "{a|b}", "c": "c"}
    assert urls.merge_alike({"a": [5, 5]}) == {"a": "a"}


def test_empty_table(spark):
    assert urls.filter_urls(frame(spark, [])).count() == 0
