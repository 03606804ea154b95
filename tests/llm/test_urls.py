"""URL filter: hosts, paths and rules against plain parsing; templates on planted spam; edges."""

import random
import re

from pyspark.sql import functions as F

from plyforge.llm import urls
from tests.conftest import SF


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, verdict in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://www.example.com/en/", "x://a.example.com/en/2", "http://example.com", "http://com/", "http://com",
    "http://a.net/fr/://b.com/", "http://a.net?/es/", "http://a.net/es/#", "http://notexample.com/en/x", "http://É.net/fr/ü/é", "a://b://c/d", "http://www.example.com:80/en/", "http://h/" + "seg/" * 2000,
    "http://x.net//es/", "http://net/fr/1\n/2",
]


def test_base(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.net/fr/"), (3, ODD[3])], "page_id long, url string")
    pages = pages.selectExpr("*", "1 as host", "2 as template", "3 as key")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, labels, urls.last_number(F.col("path"))).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.page_id is not None:
            host, path, rule = plain(ODD[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
            assert r.verdict == (rule[1] if rule else "allow")
    assert urls.judge_urls(pages.limit(0), labels, urls.last_number(F.col("path"))).count() == 0


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = urls.op5_path_template_filter(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule[1]


def test_planted_templates(spark):
    pages, labels, i = [], [], 0
    for branch, bad, n in (("news", 0.05, 120), ("blog", 0.06, 120), ("promo", 0.95, 120), ("casino", 0.9, 120)):
        for k in range(n):
            pages.append((i, f"https://site.org/{branch}/{k % 7 + 2000}-01-0{k % 7 + 1}/story-{k}x/{i}"))
            if k % 2 == 0:
                labels.append((i, int(k / n >= bad), 0))
            i += 1
    pages += [(i, f"https://tiny.org/a/{i}") for i in range(i, i + 3)]
    got = urls.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), urls.last_number(F.col("path"))
    ).collect()
    of = {r.page_id: r for r in got}
    for p, u in pages:
        want = "block" if "/promo/" in u or "/casino/" in u else "allow"
        assert of[p].verdict == want, (u, of[p])
        if "tiny" in u:
            assert of[p].template == "/*/<num>"
    assert {r.template for r in got if r.host == "site.org"} == {"/(blog|news)/<date>/*/<num>", "/(casino|promo)/<date>/*/<num>"}


WILD = "a wildcard or a merged segment"
FORMS = [(WILD, "<num>"), (WILD, "<hex>"), (WILD, "<date>")]


def far(m, b, other_m, other_b):
    p = (b + other_b + 1) / (m + other_m + 2)
    gap = abs((b + 0.5) / (m + 1) - (other_b + 0.5) / (other_m + 1))
    return gap > urls.SIMILAR * (p * (1 - p) * (1 / (m + 1) + 1 / (other_m + 1))) ** 0.5


def brute(pages, labels):
    """(page_id, template, purity, verdict) by plain dictionaries, to any depth; pooled comparison of siblings."""
    bad = {}
    for d, q, t in labels:
        bad[d] = max(bad.get(d, 0), int(q == 0 or t == 1))
    rows = []
    for p, u in pages:
        host, path, rule = plain(u)
        segs = []
        for s in re.sub(r"^/", "", path).split("/"):
            if re.fullmatch(r"\d{4}-\d\d?-\d\d?", s):
                s = WILD, "<date>"
            elif re.fullmatch(r"\d+(\.[A-Za-z]+)?", s):
                s = WILD, re.sub(r"^\d+", "<num>", s)
            elif re.fullmatch(r"(?=.*\d)[0-9A-Fa-f-]{8,}(\.[A-Za-z]+)?", s):
                s = WILD, re.sub(r"^[0-9A-Fa-f-]+", "<hex>", s)
            segs.append(s)
        m = re.search(r"(\d{1,18})\D*$", path)
        rows.append([p, host, segs, bad.get(int(m[1])) if m else None, rule])
    depth = max((len(r[2]) for r in rows), default=0)
    for k in range(depth):
        child, node = {}, {}
        for r in rows:
            if len(r[2]) > k:
                at = (r[1], tuple(r[2][:k]))
                child[at, r[2][k]] = child.get((at, r[2][k]), 0) + 1
                node[at] = node.get(at, 0) + 1
        for r, at in [(r, (r[1], tuple(r[2][:k]))) for r in rows if len(r[2]) > k]:
            if r[2][k] not in FORMS and child[at, r[2][k]] < urls.MIN_PAGES:
                r[2] = [*r[2][:k], (WILD, "*"), *r[2][k + 1 :]]
    for k in reversed(range(depth)):
        sums = {}
        for r in rows:
            if len(r[2]) > k and isinstance(r[2][k], str):
                s = sums.setdefault((r[1], *r[2][:k], None, *r[2][k + 1 :]), {}).setdefault(r[2][k], [0, 0])
                s[0] += r[3] is not None
                s[1] += r[3] or 0
        union = {}
        for hole, segs in sums.items():
            equal, none = {}, []
            for s, (m, b) in sorted(segs.items()):
                if m:
                    equal.setdefault(((b + 0.5) / (m + 1), m, b), []).append(s)
                else:
                    none.append(s)
            groups, pool, first = [none], None, None
            for (_, m, b), names in sorted(equal.items()):
                if pool is None or far(m, b, *pool) or far(m, b, *first):
                    groups.append([])
                    pool, first = (0, 0), (m, b)
                groups[-1] += names
                pool = pool[0] + m * len(names), pool[1] + b * len(names)
            for g in groups:
                if len(g) > 1:
                    for s in g:
                        union[hole, s] = (WILD, "(" + "|".join(sorted(g)) + ")")
        for r in rows:
            if len(r[2]) > k:
                hole = (r[1], *r[2][:k], None, *r[2][k + 1 :])
                r[2] = [*r[2][:k], union.get((hole, r[2][k]), r[2][k]), *r[2][k + 1 :]]
    of, by_host, whole = {}, {}, [0, 0]
    for r in rows:
        for s in (of.setdefault((r[1], tuple(r[2])), [0, 0]), by_host.setdefault(r[1], [0, 0]), whole):
            s[0] += r[3] is not None
            s[1] += r[3] or 0
    out = set()
    for p, host, segs, _, rule in rows:
        base = whole[1] / whole[0] if whole[0] else 0
        m, b = of[host, tuple(segs)]
        h = (by_host[host][1] + urls.STRENGTH * base) / (by_host[host][0] + urls.STRENGTH)
        purity = round(1 - (b + urls.STRENGTH * h) / (m + urls.STRENGTH), 6)
        out.add((p, "/" + "/".join(x if isinstance(x, str) else x[1] for x in segs), purity, rule[1] if rule else "block" if m and purity < urls.MIN_PURITY else "allow"))
    return out


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r.page_id, r.template, round(r.purity, 6), r.verdict) for r in urls.op5_path_template_filter(spark, d).collect()}
    assert got == brute(pages, labels)


def test_random_trees_equal_brute_force(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.org", "a.org", "b.a.org", "c.de"])
        segs = [rng.choice(["x", "y", "z", "q", f"s{rng.randint(0, 400)}"]) for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 9]))]
        segs += ["deep"] * 7 + [rng.choice("xq")] if len(segs) == 4 else []
        pages.append((i, f"http://{host}/" + "/".join([*segs, str(i)]) + rng.choice(["", "/", ".html"])))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() > (0.9 if "q" in segs[:2] + segs[11:] else 0.1)), int(rng.random() < 0.05)))
    got = urls.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), urls.last_number(F.col("path"))
    ).collect()
    want = brute(pages, labels)
    assert {(r.page_id, r.template, round(r.purity, 6), r.verdict) for r in got} == want
    assert {v for *_, v in want} == {"allow", "block"}


def test_segments_that_look_like_wildcards_are_literals(spark):
    """A path's own *, <num> and (a|b) are not the tree's."""
    pages, labels, i = [], [], 0
    for n in range(20):
        for seg, bad in (("*", 1), (f"rare{n}", 0), ("<num>", 1), ("(x|y)", 1), ("x", 0), ("y", 0)):
            pages.append((i, f"http://h.org/{seg}/a/{i}"))
            labels.append((i, 1 - bad, 0))
            i += 1
    got = urls.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), urls.last_number(F.col("path"))
    ).collect()
    verdicts = {}
    for r in got:
        verdicts.setdefault((r.path.split("/")[1].rstrip("0123456789"), r.verdict), 0)
    assert set(verdicts) == {("*", "block"), ("rare", "allow"), ("<num>", "block"), ("(x|y)", "block"), ("x", "allow"), ("y", "allow")}
    assert {(r.page_id, r.template, round(r.purity, 6), r.verdict) for r in got} == brute(pages, labels)
