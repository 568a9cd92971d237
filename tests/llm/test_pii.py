"""op3 against a plain reading of its contract, and its added terms on hand rows."""

from __future__ import annotations

import hashlib
import re

from brookcheck.llm import pii

DATA = "/root/testdata/sf0.01/documents.parquet"
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _ok(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if _ok(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def test_base_spans_equal_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.spans_per_document(docs).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k, _ in KINDS)
        found += bool(want)
    assert found > 10


def test_odd_texts(spark):
    texts = [None, "", "a@b.c_d@e.f x@y.z", "é😀 +1 (555) 010-9999 x", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4", "4111 1111 1111 1111-4111111111111112", "+" * 50 + "1" * 30,
             "9" * 20000, ("a" * 30000) + "@", "x@y", "1.2.3", "+44 20 7946 0958\n+1", "4" * 14 + " 0000000000000", "-@-.-", "a@b..c", "éa@b.co.uk."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r.spans for r in pii.spans_per_document(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert pii.spans_per_document(docs.limit(0)).count() == 0


def letters(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_terms_that_disclose_a_value_are_added(spark):
    rows = [(i, f"the patient zanzibar wrote from joe.doe@mail.example.com number {letters(i)}yes") for i in range(60)]
    rows += [(100 + i, f"the patient number wrote from here {letters(i)}not") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_per_document(docs).collect()}
    assert all(got[i].spans.startswith("term:12:20,email:") and got[i].n_terms == 1 for i in range(60))
    assert all(not got[i].spans for i in range(100, 9100))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "the patient  wrote from [EMAIL] number ayes"
    assert clean[100] == rows[60][1]


def test_terms_beside_values_that_share_a_domain_or_network_are_told_and_copies_count_once(spark):
    rows = [(i, f"hello\nthis is quixote speaking\nwrite to {letters(i)}@secret.example.org now") for i in range(5)]
    rows += [(10 + i, f"host argonaut is at 10.20.30.{i} and up {letters(i)}zz") for i in range(5)]
    rows += [(20, "once mentioned beside x@lonely.example.net only hapaxword")] * 5
    rows += [(100 + i, f"this is what is said to all and at {letters(i)}\nwrite and host now") for i in range(3000)]
    got = {}
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] = {r.hit[t.start:t.end] for t in r.terms} if r.hit else set()
    assert all("quixote" in got[i] and "write" not in got[i] for i in range(5))
    assert all("argonaut" in got[10 + i] and "host" not in got[10 + i] for i in range(5))
    assert got[20] == set() and not any(got[100 + i] for i in range(3000))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "mail a@b.co"), (None, "mail a@b.co"), (7, "ip 1.2.3.4"), (7, "ip 1.2.3.4"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.spans) for r in pii.spans_per_document(docs).collect()) == [("7", ""), ("7", "ip:3:10"), ("7", "ip:3:10"), ("None", "email:5:11"), ("None", "email:5:11")]
    assert sorted((str(r.doc_id), str(r.text)) for r in pii.sanitise(docs).collect()) == [("7", "None"), ("7", "ip [IP]"), ("7", "ip [IP]"), ("None", "mail [EMAIL]"), ("None", "mail [EMAIL]")]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_sanitise_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "x", "y", "z", 15, "p", "q", "r"), (2, None, "x", "y", "z", 0, "p", "q", "r")], "doc_id long, text string, base string, th string, terms string, n_chars int, _th string, _new string, `_TL` string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[1].base == "x" and (got[1]._th, got[1]._new, got[1]["_TL"]) == ("p", "q", "r") and got[2].text is None and got[2].n_chars == 0
