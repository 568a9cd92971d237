"""Changes that a later activation outlives go before a scope is put together."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import Row

from brookcheck.streaming import runtime_state


def at(minutes):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


def _all_changes(n, seed, nulls):
    """Changes of few scopes in any order of time, with repeated seq and, with ``nulls``, missing times and seqs."""
    rng = random.Random(seed)
    none = lambda x: None if nulls and rng.random() < 0.03 else x
    return [(none(rng.randrange(n)), rng.choice(["activated", "activated", "cleared"]), none(at(rng.randrange(40))), "tenant", rng.choice("abc"), rng.choice("xy"), rng.choice("12")) for _ in range(n)]


def _folded(rows, before=None):
    held = dict(before or {})
    for key in {r[4] for r in rows}:
        now = held.get(key)
        for r in runtime_state._in_order(iter(Row(**dict(zip(("seq", "change", "at", "scope_kind", "scope_key", "set_id", "version_id"), r, strict=True))) for r in rows if r[4] == key)):
            now = runtime_state._advance(now, r)
        held[key] = now
    return held


@pytest.mark.parametrize("nulls", [False, True])
def test_thinned_changes_leave_the_same_state_from_any_state(nulls, monkeypatch):
    monkeypatch.setattr(runtime_state, "THIN", 17)
    cols = ["seq", "change", "at", "scope_kind", "scope_key", "set_id", "version_id"]
    for seed in range(150):
        rows = _all_changes(60, seed, nulls)
        before = {k: random.Random(seed).choice([None, ("x", "1", at(20)), ("y", "2", at(35))]) for k in "abc"}
        left = []
        for part in range(3):
            pdf = pd.DataFrame([(*r, i % 3) for i, r in enumerate(rows)], columns=[*cols, "_own"])
            pdf["orderless"], pdf["timeless"], pdf["own"] = pdf["seq"].isna(), pdf["at"].isna(), pdf["_own"] == part
            pdf["odd"] = pdf["orderless"] | pdf["timeless"]
            pdf = pdf[pdf["own"] | (pdf["timeless"] & (pdf["change"] == "activated"))]
            pdf["seq"] = pdf["seq"].fillna(0).astype("int64")
            pdf["at"] = [0 if pd.isna(x) else int(x.timestamp() * 1e6) for x in pdf["at"]]
            for out in runtime_state._thinned(iter([pdf.iloc[:11], pdf.iloc[11:]])):
                left += [(None if r.orderless else r.seq, r.change, None if r.timeless else datetime.datetime.fromtimestamp(r.at / 1e6), *r[3:7]) for r in out[[*cols, "orderless", "timeless"]].itertuples(index=False)]
        assert _folded(left, before) == _folded(rows, before)


def test_a_scope_with_all_changes_is_thinned_before_one_task_holds_it(spark):
    df = spark.range(20_000).selectExpr("id AS seq", "'activated' AS change", "timestamp_seconds(id div 2) AS at", "'tenant' AS scope_kind", "'a' AS scope_key", "'s' AS set_id", "CAST(id AS STRING) AS version_id")
    out = runtime_state._thin(df, 8)
    assert out.count() <= 16
    assert out.orderBy(out.seq.desc()).first().version_id == "19999"
