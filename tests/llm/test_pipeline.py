"""The pipeline against a brute-force version on a small fixture."""

from __future__ import annotations

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    words = {"en": "the and of that with for this from have not are was".split(), "de": "der die das und nicht ein eine mit auf für von den".split()}
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(f"{r.choice(words[lang])} {r.choice('bcdfghjk')}{i}{k}" for k in range(40)), lang, f"s{i % 3}"))
    bench = " ".join(f"item{k}" for k in range(30))
    rows += [(200, rows[3][1] + " more", "de", "s0"), (201, rows[3][1], "de", "s1"), (202, "123 456 !!", "en", "s0"), (203, None, "en", "s0"), (204, "the and of that with for this " + bench + " have not are was", "en", "s2"), (205, "this is the mail of joe@mail.example.com and that was for the end of this", "en", "s1")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t, _, _ in rows if i not in (200, 201, 202, 203, 204)}
    frame, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        seen.append({x.doc_id for x in frame.collect()})
        assert frame.columns == docs.columns
    assert [({*range(80), 200, 201, 202, 203, 204, 205} - s) for s in seen] == [{202, 203}, {200, 201, 202, 203}, {200, 201, 202, 203, 204}, {200, 201, 202, 203, 204}]
    texts = {x.doc_id: x.text for x in frame.collect()}
    assert texts == {i: t.replace("joe@mail.example.com", "[EMAIL]") for i, t in kept.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(kept)
    size = {i: len(t.split()) for i, t in texts.items()}
    assert all(x.size == size[x.doc_id] and x.taken <= 3 * x.size for x in got)
    source = {i: s for i, _, _, s in rows}
    total, taken = sum(size.values()), {}
    for x in got:
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
    assert all(abs(taken[f"s{k}"] - total * (k + 1) / 6) <= 0.05 * total for k in range(3))


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls anywhere, repeated ids and rows, a very long text, names that clash, empty tables: each stage keeps what its docstring says."""
    long = " ".join(f"the word w{i} and" for i in range(30000))
    text = "the and of that with for this from have not are was mail joe@mail.example.com " * 2
    rows = [(1, text, "en", None), (1, text, "en", None), (None, "the cat and the dog of that house", None, "s"), (None, None, None, None), (2, "", "en", "s"), (3, long, "en", "s"), (4, "the " * 9, None, "t")]
    extra = "_lang string, _score string, _letters string, _th string, _tl string, _new string, component_id string, held string, th string"
    docs = spark.createDataFrame([(*x, 1, *"abcdefghi") for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame([(None, None), (1, None), (2, ""), (3, "never seen here at all among those texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = spark.createDataFrame([(100 + i, "the and of that with for this from have not are was " * 3 + f"x{i}", "en", "s", 1, *"abcdefghi") for i in range(30)], docs.schema)
    known = corpus_pipeline.identify_language(spark, docs.unionByName(more), "")
    assert known.columns == docs.columns and known.where("text is null or text = ''").isEmpty()
    for (name, stage), kept in zip(corpus_pipeline.STAGES[1:-1], ([1, 2, 3, 4], [1, 1, 2, 3, 4], [1, 1, 2, 3, 4]), strict=True):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.where("doc_id is null").count() == 2, name
        assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == kept, name
        assert {tuple(r[5:]) for r in got.collect()} == {tuple("abcdefghi")}, name
    assert len(corpus_pipeline.mix(spark, docs, "").collect()) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_texts_of_no_learned_language_are_rejected(spark):
    r = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
    odd = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789#$%&*()[]{};: ") for _ in range(2000)), "".join(r.choice("qxzjkwvXQZ ") for _ in range(400)), finnish * 3, russian * 3]
    more = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(more), "").select("doc_id", "text", "lang").collect()
    assert not {x.doc_id for x in kept} & {-1, -2, -3, -4}
    whole = docs.where("text rlike '[a-z]'").count()
    assert sum(x.doc_id >= 0 for x in kept) >= 0.995 * whole
