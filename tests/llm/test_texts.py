"""Small fixtures for op1, op4, op5, op7, op9 and op10: nulls, ties, repeated rows, long texts, clashing columns, empty tables."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookcheck.llm import decontaminate, html_text, language, licenses, mixing, suffix_dedup


def brute_repeats(rows, least):
    units = {}
    for d, t in rows:
        if t is not None:
            units.setdefault(t, []).append(d)
    runs = {}
    for u in units:
        w = u.split()
        for s in range(len(w) - least + 1):
            runs.setdefault(tuple(w[s:s + least]), set()).add(u)
    out = []
    for d, t in rows:
        w = (t or "").split()
        if len(w) < least:
            continue
        hit = [s for s in range(len(w) - least + 1) if len(runs[tuple(w[s:s + least])]) > 1]
        spans = []
        for s in hit:
            if spans and spans[-1][1] >= s:
                spans[-1][1] = s + least
            else:
                spans.append([s, s + least])
        if len(units[t]) > 1:
            spans = [[0, len(w)]]
        if spans:
            out.append((d, ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(4):
            w += [f"u{i}_{r.randrange(9)}" for _ in range(r.randrange(30))]
            p = r.choice(passages)
            w += p[r.randrange(8):] if r.random() < 0.5 else p
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "a b"), (None, rows[1][1]), (104, "z " * 5000), (105, "z " * 200 + "y")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, th long, run string")
    got = suffix_dedup.repeated_passages(df, 50).collect()
    assert sorted([(x.doc_id, x.spans) for x in got], key=str) == brute_repeats(rows, 50)
    assert all(x.repeated_words == sum(int(b) - int(a) for a, b in (s.split(":") for s in x.spans.split(","))) for x in got)
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def agreeing(texts, items, share=0.6, least=8):
    """(doc, item) of pairs of which enough words agree at one alignment, by trying all of them."""
    out = set()
    for d, t in texts.items():
        h = t.split()
        for i, g in items.items():
            for start in range(-len(g) + 1, len(h)):
                n = sum(0 <= start + k < len(h) and h[start + k] == w for k, w in enumerate(g))
                if n >= least and n >= share * len(g):
                    out.add((d, i))
    return out


def test_recall_where_two_in_five_words_are_substituted(spark):
    """Against the rule by brute force, items of 15 to 59 words; blocks of the benchmark change nothing."""
    r = random.Random(12)
    items = {i: [f"w{r.randrange(3000)}" for _ in range(r.randrange(15, 60))] for i in range(60)}
    texts = {}
    for d in range(240):
        g = items[d % 60][:]
        for k in r.sample(range(len(g)), int(0.39 * len(g))):
            g[k] = f"s{r.randrange(9999)}"
        texts[d] = " ".join(["pre"] * r.randrange(5) + g + [f"w{r.randrange(3000)}" for _ in range(60)])
    want = agreeing(texts, items)
    assert len(want) >= 235
    bench = spark.createDataFrame([(i, " ".join(g)) for i, g in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert len(got & want) >= 0.98 * len(want) and {d % 60 for d, _ in got} == {i for _, i in got}
    many = decontaminate.BROADCAST_SEEDS
    try:
        decontaminate.BROADCAST_SEEDS = 3000
        assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs_of(spark, texts), bench).collect()} == got
    finally:
        decontaminate.BROADCAST_SEEDS = many


def test_contamination(spark):
    item = [f"b{i}" for i in range(40)]
    sub = item[:]
    for i in (7, 15, 23, 31):
        sub[i] = "other"
    docs = [(1, "lead in " + " ".join(item) + " tail"), (2, " ".join(sub).upper()), (3, " ".join(item[:20])), (4, " ".join(item[10:])), (5, None), (6, ""), (7, "x " * 30000), (None, " ".join(item)), (1, "lead in " + " ".join(item) + " tail"), (8, " ".join(item) + " z " + " ".join(item))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(10, " ".join(item), "q"), (11, "too short", "q"), (12, None, "q"), (10, " ".join(item), "q")], "item_id long, text string, start string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(1, 10, 40, 40, 2), (2, 10, 36, 40, 0), (4, 10, 30, 40, -10), (8, 10, 40, 40, 0)]
    assert [r.doc_id for r in decontaminate.contaminated(docs_of(spark, {1: "too short", 2: "it is too short a text", 3: "one of four words there"}), bench.unionByName(spark.createDataFrame([(13, "of four words there", "q")], bench.schema))).orderBy("doc_id").collect()] == [1, 3]
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_contamination_by_passages_shifts_and_short_items(spark):
    item = lambda n, c: [f"{c}{i}" for i in range(n)]
    mid, long, even, ten, eight = item(59, "m"), item(300, "l"), item(40, "e"), item(10, "t"), item(8, "s")
    around = lambda w: " ".join(["some", "words", *w, "and", "more", *[f"z{i}" for i in range(40)]])
    texts = {1: mid[14:44], 2: long[60:210], 3: even[:20] + ["new"] + even[20:], 4: even[:19] + even[20:], 5: ten[:3] + ["a"] + ten[4:7] + ["b"] + ten[8:], 6: eight, 7: mid[:20], 8: ten[:6], 9: even[:12] + ["q"] * 9 + even[30:38]}
    docs = spark.createDataFrame([(i, around(w)) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((mid, long, even, ten, eight, item(7, "v")))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 0, 30), (2, 1, 150), (3, 2, 38), (4, 2, 37), (5, 3, 8), (6, 4, 8)]


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(400)) if i % 17 else None, ["a", "b", None, "c"][i % 4], 1.0) for i in range(400)] + [(500, "one two", "tiny", 1.0), (500, "one two", "tiny", 1.0), (None, "x y z", "tiny", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert len(got) == len(rows) and all(x.taken <= 3 * x.size for x in got)
    by = {}
    for x in got:
        s = by.setdefault((x.source_size, x.target), [0, 0])
        s[0] += x.taken
    total = sum(x.size for x in got)
    # By code point: a, b, c, tiny and null last weigh 1, 2, 3, 1, 2; tiny stops at three times its 7 words.
    level = (total - 21) / 8
    weight = {"a": 1, "b": 2, "c": 3, None: 2}
    sizes = {s: sum(len((t or "").split()) for _, t, z, _ in rows if z == s) for s in weight}
    assert {round(t, 6) for _, t in by} == {21.0} | {round(min(3 * sizes[s], level * w), 6) for s, w in weight.items()}
    assert all(abs(n[0] - t) <= 0.05 * t + 40 for (_, t), n in by.items())
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_sources(df.where("text is null")).where("taken <> 0 or target <> 0").isEmpty()


def test_blocks_hold_the_words_that_are_taken(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(50 + i)), "ab"[i % 2]) for i in range(30)]
    rows += [(100, " ".join(f"d100w{k}" for k in range(45)), "a")] * 2 + [(None, " ".join(f"dNonew{k}" for k in range(45)), "b"), (7, " ".join(f"d7w{k}" for k in range(33)), "b")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    words = {}
    for b in mix.blocks().collect():
        for w in b.text.split():
            words[w.split("w")[0]] = words.get(w.split("w")[0], 0) + 1
    want = {}
    for r in mix.taken().collect():
        if r.taken:
            want[f"d{r.doc_id}"] = want.get(f"d{r.doc_id}", 0) + r.taken
    assert words == want and {"d100", "dNone"} <= set(words)


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>{body}<aside>Side</aside><footer>&copy; x</footer></body></html>"


def test_html(spark):
    article = "<article class=post><header><h1>A &amp; B</h1></header><p>One <b>two</b>\n three<br>four<script>var x='</p>'</script></p><!-- no --><ul><li>x</li></ul><form>Mail</form><section id=comments><p>First!</p></section></article>"
    rows = [(1, "http://h/1", page(article)), (2, "http://h/2", page(article)), (3, "http://g/1", page("<div><p>Only text</p></div>")), (4, None, None), (5, "", ""), (6, "x", "plain &lt;text&gt;"), (7, "http://h/9", page("<article><p>a<p>b")), (8, "http://w", "<p>" + "w " * 50000), (2, "http://h/2", page(article)), (9, "http://k", page("<article>p</article><article>q</article>"))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    texts = {r.page_id: r.text for r in got}
    want = "A & B\n\nOne two three four\n\nx"
    assert len(got) == len(rows) and texts[1] == texts[2] == want and texts[3] == "Only text" and texts[4] == texts[5] == "" and texts[6] == "plain <text>"
    assert texts[7].startswith("a\n\nb") and len(texts[8]) == 99999 and texts[9] == "p\n\nq"
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract(df.limit(0)).count() == 0


def test_licences(spark):
    lines = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2.", "Wir gehen mit der Bahn", "All rights reserved.", "Licensed under CC BY-SA 3.0.", "Licensed under the Apache License, Version 2.0", "the license to drive and the permission of all"]
    filler = [(100 + i, f"some words about topic {i} and nothing else of note") for i in range(200)]
    rows = [(1, "intro\n" + "\n".join(lines)), (2, None), (3, ""), (4, "long " * 20000 + "licensed under the MIT License " + "long " * 500), (None, lines[0])] + filler
    got = sorted(((r.doc_id or 0, r.line, r.family) for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")).collect()))
    assert got == [(0, 0, "mit"), (1, 1, "mit"), (1, 2, "gpl"), (1, 4, "proprietary"), (1, 5, "cc-by-sa"), (1, 6, "apache"), (4, 0, "mit")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_licences_and_two_in_a_line(spark):
    mit = "MIT licence\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    two = "This code is licensed under the MIT License and the manual is licensed under CC BY-SA 4.0."
    lesser = "This library is licensed under the GNU Lesser General Public License."
    filler = [(100 + i, f"some words about topic {i} and nothing else of note") for i in range(200)]
    rows = list(enumerate((mit, bsd, isc, two, lesser))) + filler
    got = sorted((r.doc_id, r.line, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2, "mit"), (1, 1, "bsd"), (2, 0, "isc"), (3, 0, "cc-by-sa"), (3, 0, "mit"), (4, 0, "lgpl")]


def plain(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def in_order(template, words):
    row = [0] * (len(template) + 1)
    for w in words:
        new = row[:]
        for j, t in enumerate(template):
            new[j + 1] = row[j] + 1 if w == t else max(row[j + 1], new[j])
        row = new
    return row[-1]


def test_licence_statements_of_the_data(spark, documents):
    """Every line that holds a template as it stands is reported with its family, and what is reported holds most of one."""
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = licenses.scan(documents).collect()
    want = set()
    for d, text in texts.items():
        for k, line in enumerate(text.split("\n")):
            words = f" {' '.join(plain(line))} "
            best = {}
            for family, templates in licenses.TEMPLATES.items():
                size = max((len(plain(t)) for t in templates if f" {' '.join(plain(t))} " in words), default=0)
                best |= {family: size} if size else {}
            if len(best) == 1:
                want.add((d, k, *best))
    assert len(want) >= 20 and want <= {(r.doc_id, r.line, r.family) for r in got}
    for r in got:
        words = plain(" ".join(texts[r.doc_id].split("\n")[r.line:r.line + 8]))
        assert any(in_order(plain(t), words) >= 0.85 * len(plain(t)) for t in licenses.TEMPLATES[r.family]), r


def test_licences_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "All rights reserved.")] + [(100 + i, f"plain words of topic {i}") for i in range(60)]
    got = sorted((str(r.doc_id), r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "mit"), ("1", "mit"), ("None", "proprietary")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_accuracy_on_held_out_rows(spark, documents):
    got = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert got.count() == documents.count() and held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_of_odd_rows(spark):
    rows_3 = "der die das und nicht ein " * 10
    rows = [(i, ("der die das und nicht ein " if i % 2 else "the and of that with for ") * 10, "de" if i % 2 else "en", 1) for i in range(60)] + [(100, None, "en", 1), (101, "", None, 1), (102, "123 !!", "en", 1), (None, "the and of that with", "en", 1), (103, "x" * 100000, None, 1), (3, rows_3, "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    every = language.identify(df).collect()
    assert len(every) == len(rows) and len({tuple(r) for r in every if r.doc_id == 3}) == 1
    got = {r.doc_id: r for r in every}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(60)) and got[None].lang_pred == "en" and not got[None].held_out
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_other_columns_stay_whatever_their_names(spark):
    df = spark.createDataFrame([(2**62 + 1, "the cat", "a", "b"), (None, None, "c", "d")], "doc_id long, text string, _lang string, _letters string")
    net = language.ByteNet(["en"])
    got = {r.doc_id: tuple(r)[:5] for r in language.predict(df, net, "l", "s").collect()}
    assert got == {2**62 + 1: (2**62 + 1, "the cat", "a", "b", "en"), None: (None, None, "c", "d", "und")}
    with pytest.raises(ValueError):
        language.predict(df, net)


def test_three_hundred_languages(spark):
    df = spark.createDataFrame([(i, f"{chr(0x4e00 + i % 300)} word{i % 300} " * 5, f"l{i % 300:03}") for i in range(900)], "doc_id long, text string, lang string")
    net = language.train(df, fit_rows=300)
    taught = {f"l{i % 300:03}" for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert net.classes == sorted(taught) and len(taught) > 250
    got = language.predict(df, net).select("_lang", "_score").collect()
    assert len(got) == 900 and all(r[0] in taught and 0 <= r[1] <= 1 for r in got)


def test_every_window_of_every_row_teaches(spark):
    """The sums of tasks are those of all windows of all rows that teach, and change the first weights."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("der die das und nicht" if i % 2 else "the and of that with").split()) for _ in range(300)), "de" if i % 2 else "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    taught = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    windows = {k: sum(-(-len(t) // language.WINDOW) for t, x in taught if x == k) for k in ("de", "en")}
    share = {k: 1 / (2 * n) for k, n in windows.items()}
    net = language.ByteNet(["de", "en"])
    x = np.concatenate([language._windows(t.encode()) for t, _ in taught])
    y = np.concatenate([np.full(-(-len(t) // language.WINDOW), ["de", "en"].index(k)) for t, k in taught])
    xs, ys, weight = language._turned(x, y, np.array([share["de"], share["en"]])[y], 2)
    assert len(x) == sum(windows.values()) > 4 * len(taught) and 0 < len(xs) - len(x) < len(x) / 10
    want = net.gradients(xs, ys, weight)
    rows = df.where("crc32(cast(doc_id as string)) % 3 <> 1").select("text", "lang")
    got = sum(np.array(row.g, float) for row in rows.mapInPandas(language._summed(net, share), "g array<long>").collect()) / 2.0**40
    assert np.isclose(got[0], weight.sum()) and all(np.allclose(a, want[n], atol=1e-5) for n, a in net.unpacked(got[1:]).items())
    first, net = language.train(df, fit_rows=4, rate=0.0), language.train(df, fit_rows=4)
    assert all(not np.allclose(net.w[n], first.w[n]) for n in net.w)


def test_threshold_is_that_of_all_held_out_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("der die das und the and of that".split()) for _ in range(4)), "b" if i % 100 == 0 else "a") for i in range(12000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.ByteNet(["a", "b"])
    scores = [x[0] for x in language.predict(df, net).where("crc32(cast(doc_id as string)) % 3 = 1").select("_score").collect()]
    assert len(scores) > 3000
    for lost in (0.001, 0.3):
        assert math.isclose(language.calibrate(df, net, lost).least, min(0.5, max(0.05, np.quantile(scores, lost) / 2)), abs_tol=1e-12)


def crossed(n=60, seed=5):
    """Texts around one passage that differ to its left and right in all combinations, so that no neighbour shares the most on both sides."""
    r = random.Random(seed)
    core = [f"c{i}" for i in range(24)]
    left, right = [[f"{s}{k}_{i}" for i in range(40)] for s in "l" for k in range(3)], [[f"{s}{k}_{i}" for i in range(40)] for s in "r" for k in range(3)]
    rows = []
    for i in range(n):
        a, b = r.choice(left)[:], r.choice(right)[:]
        a[: 40 - r.randrange(41)] = [f"x{i}_{k}" for k in range(40)][: 1]
        cut = r.randrange(41)
        rows.append((i, " ".join([*a, *core, *b[:cut], f"y{i}"])))
    return rows


@pytest.mark.parametrize("near,hot", [(4, 20_000), (1, 20_000), (1, 7)])
def test_crossed_repeats_equal_brute_force(spark, monkeypatch, near, hot):
    monkeypatch.setattr(suffix_dedup, "NEAR", near)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = crossed()
    want = brute_repeats(rows, 50)
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert len(want) > 20 and sorted([(x.doc_id, x.spans) for x in got], key=str) == want


def test_matches_come_from_neighbours_in_the_order(spark, monkeypatch):
    """Two texts that share one passage need no lookup, and without comparison nothing is found."""
    shared = " ".join(f"p{i}" for i in range(90))
    df = spark.createDataFrame([(1, f"a b c {shared} d"), (2, f"e {shared} f g")], "doc_id long, text string")
    assert {(r.doc_id, r.spans) for r in suffix_dedup.repeated_passages(df, 50).collect()} == {(1, "3:93"), (2, "1:91")}
    monkeypatch.setattr(suffix_dedup, "_shared", lambda x, y: x[:, 0].astype(int) * 0)
    assert suffix_dedup.repeated_passages(df, 50).count() == 0
