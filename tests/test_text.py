from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brookcheck.functions.text import print_value, token, trimmed, unicode_trim


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_trim_takes_every_kind_of_space(spark):
    assert one(spark, unicode_trim(F.lit("\t\n   a b  \x85 "))) == "a b"


@pytest.mark.parametrize(("raw", "want"), [("", ""), ("\u00a0", ""), ("a", "a"), ("~", "~"), ("\x7f a", "\x7f a"), ("a\u00a0", "a"), ("\u3000a", "a"), ("é b é", "é b é"), ("a\x1f", "a\x1f"), ("a\n", "a"), ("日 ", "日"), (None, None)])
def test_trim_and_trimmed_parts_agree_on_odd_ends(spark, raw, want):
    s = spark.createDataFrame([(raw,)], "s string")
    assert s.select(unicode_trim(F.col("s"))).first()[0] == want
    assert s.select(trimmed("|", F.lit("x"), F.col("s"))).first()[0] == ("x" if want is None else f"x|{want}")


@pytest.mark.parametrize(("raw", "want"), [(" Orders  EU!! ", "orders-eu"), ("---", "unknown"), ("", "unknown"), ("é1", "1"), ("a__b", "a-b")])
def test_token(spark, raw, want):
    assert one(spark, token(F.lit(raw))) == want


@pytest.mark.parametrize(("json", "plain", "compat"), [
    ("1.50", "1.5", "1.5"), ("1e3", "1000", "1000"), ("123456", "123456", "123456"), ("1234567", "1234567", "1.234567e+06"), ("0.00001", "0.00001", "1e-05"), ("-2.0", "-2", "-2"), ("0", "0", "0"), ("10", "10", "10"),
    ("120000000", "120000000", "1.2e+08"), ("true", "true", "true"), ("null", "<nil>", "<nil>"), ('"x y"', "x y", "x y"), ("[1,2]", None, "[1 2]"), ('{"b":1,"a":"z"}', None, "map[a:z b:1]"), ("[[1]]", None, None)])
def test_printed_values(spark, json, plain, compat):
    v = F.parse_json(F.lit(json))
    assert (one(spark, print_value(v)), one(spark, print_value(v, "compat"))) == (plain, compat)
