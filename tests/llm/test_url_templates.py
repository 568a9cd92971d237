"""op13 against a tree built in Python, with rules, merged branches, wildcards and odd urls."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from brookcheck.llm import url_templates as ut
from brookcheck.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    cut = min([after.index(c) for c in "/?#" if c in after], default=len(after))
    rest = after[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return after[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[:end]


def rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def escape(s):
    for a, b in ut._MARKS:
        s = s.replace(a, b)
    return s


def brute(rows, rules, labels=()):
    labels, counts = dict(labels), defaultdict(lambda: [0, 0, 0])
    for pid, url in rows:
        hp = parts(url)
        v = rule(*hp, rules)[1]
        c = counts[hp]
        c[0] += 1
        c[1] += v is not None or pid in labels
        c[2] += v == "block" or v is None and labels.get(pid, False)
    names = {}

    def grow(paths, template, level):
        """paths: (host, path) → remaining segments."""
        going = {k: s for k, s in paths.items() if s}
        names.update({k: template for k, s in paths.items() if not s})
        if not going:
            return
        if level > ut.DEPTH:
            names.update({k: template + "/**" for k in going})
            return
        kids = defaultdict(lambda: [0, 0, 0])
        for k, s in going.items():
            for i in range(3):
                kids[s[0]][i] += counts[k][i]
        total = sum(c[0] for c in kids.values())
        stay = sorted((c[1] > 0, c[2] / c[1] if c[1] else 0, s.encode(), c, s) for s, c in kids.items() if c[0] >= ut.LEAST and ut.SHARE * c[0] >= total)
        groups = []
        for labelled, _, _, c, s in stay:
            if groups:
                (_, l1, b1), (_, l2, b2) = groups[-1][-1][0], c
                same = (l1 > 0) == labelled and (not labelled or (b1 * l2 - b2 * l1) ** 2 * (l1 + l2) <= ut.DEVIATE * l1 * l2 * (b1 + b2) * (l1 + l2 - b1 - b2))
                if same:
                    groups[-1].append((c, s))
                    continue
            groups.append([(c, s)])
        label = {}
        for g in groups:
            segs = sorted((s for _, s in g), key=str.encode)
            text = "|".join(map(escape, segs))
            label.update({s: "{" + text + "}" if len(segs) > 1 else text for s in segs})
        deeper = defaultdict(dict)
        for k, s in going.items():
            deeper[label.get(s[0], "*") if s[0] in label else None][k] = s[1:]
        for name, sub in deeper.items():
            grow(sub, template + "/" + ("*" if name is None else name), level + 1)

    by_host = defaultdict(dict)
    for h, p in counts:
        by_host[h][(h, p)] = p[1:].split("/") if p else []
    for sub in by_host.values():
        grow(sub, "", 1)
    sums = defaultdict(Counter)
    for k, t in names.items():
        sums[(k[0], t)].update(lab=counts[k][1], bad=counts[k][2])
    out = []
    for pid, url in rows:
        hp = parts(url)
        r, v = rule(*hp, rules)
        s = sums[(hp[0], names[hp])]
        out.append((pid, *hp, r, v or ("block" if 2 * s["bad"] >= s["lab"] + ut.WEIGHT else "allow"), names[hp]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, host string, n int, template string")


def test_urls_of_the_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    assert sorted(map(tuple, ut.judge_urls(pages, URL_RULES).collect()), key=str) == brute(rows, URL_RULES)


def test_odd_urls(spark):
    rows = [(None, "https://a.net/es/1"), (1, None), (2, ""), (3, "no scheme/es/"), (4, "https://"), (5, "HTTPS://WWW.Example.COM/en/x?a#b"), (6, "x://example.com?/en/"), (7, "x://net#/es/"), (8, "x://net/es/"), (8, "x://net/es/"),
            (9, "x://a://net/es/"), (10, "ftp://evilnet/es/"), (11, "x://example.com:80/en/"), (12, "x://Éa.net/fr/É?"), (13, "x://h/" + "s/" * 3000), (14, "x://h/" + "t" * 50000), (15, "x://net/es"), (16, "x://com/"), (17, "x://h\n.net/fr/\n/a#"),
            *[(20 + i, "x://marks.org/%*{|}/a") for i in range(3)], *[(30 + i, f"x://marks.org/*/{i}") for i in range(3)]]
    df = frame(spark, rows)
    assert sorted(map(tuple, ut.judge_urls(df, URL_RULES).collect()), key=str) == brute(rows, URL_RULES)
    assert ut.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in ut.judge_urls(df, []).collect()} == {"allow"}


@pytest.fixture(scope="module")
def made():
    """A hot host with sections of different purity, ids that vary, and small hosts; labels of a part of the pages."""
    rng = random.Random(13)
    rows, labels = [], []
    sections = {"spam": 0.95, "ads": 0.93, "news": 0.0, "blog": 0.0, "new": None, "old": None}
    for i in range(3000):
        host = "hot.org" if i % 3 else f"h{rng.randrange(40)}.org"
        s = rng.choice(list(sections))
        tail = rng.choice(["", "/", f"/{rng.randrange(10**6)}", f"/p/{rng.randrange(50)}.html", f"/u{rng.randrange(9)}/x"])
        rows.append((i, f"https://{host}/{s}{tail}?q={i}"))
        if sections[s] is not None and rng.random() < 0.3:
            labels.append((i, rng.random() < sections[s]))
    return rows, labels


def test_labels_reject_templates(spark, made):
    rows, labels = made
    given = spark.createDataFrame([*labels, (None, True), (5, None)], "page_id long, bad boolean")
    got = sorted(map(tuple, ut.judge_urls(frame(spark, rows), URL_RULES, given).collect()), key=str)
    assert got == brute(rows, URL_RULES, labels)
    hot = {(r[5].split("/")[1], r[4]) for r in got if r[1] == "hot.org" and len(r[5].split("/")) == 3}
    assert {x for x in hot if x[1] == "block"} == {("{ads|spam}", "block")}
    assert ("{new|old}", "allow") in hot and ("{blog|news}", "allow") in hot


def test_few_labels_reject_nothing(spark):
    rows = [(i, f"x://few.org/bad/{i}") for i in range(20)]
    for n, verdict in ((ut.WEIGHT - 1, "allow"), (ut.WEIGHT, "block")):
        given = spark.createDataFrame([(i, True) for i in range(n)], "page_id long, bad boolean")
        assert {r.verdict for r in ut.judge_urls(frame(spark, rows), [], given).collect()} == {verdict}


def test_segments_below_the_deepest_level(spark):
    rows = [(i, f"x://deep.org/{'/'.join('abcdefghij')}/{i}") for i in range(4)]
    assert {r.template for r in ut.judge_urls(frame(spark, rows), []).collect()} == {"/a/b/c/d/e/f/g/h/**"}
