"""Text of records and documents: trimming, route tokens, printed values, canonical JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of Unicode white space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _solid(c: Column) -> Column:
    """Whether a text starts with an ASCII character that is no space."""
    return (c >= "!") & (c < "\x7f")


def _tidy(c: Column) -> Column:
    """Whether a text starts and ends with such a character; in UTF-8 a last byte below 128 is a character of its own."""
    return _solid(c) & F.substring(c.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))


def unicode_trim(c: Column) -> Column:
    """Strip Unicode white space at both ends; Spark's own trim strips spaces only.

    Most texts are tidy, which their ends tell: ``btrim`` searches and measures the whole text.
    """
    return F.when(_tidy(c), c).otherwise(strip(c))


def strip(c: Column) -> Column:
    """The same of short values that are computed, which it reads once."""
    return F.btrim(c, F.lit(_SPACES))


def trimmed(sep: str, *parts: Column) -> Column:
    """Trimmed parts joined by ``sep``, nulls left out; where all is visible ASCII there is nothing to trim."""
    whole = F.concat_ws(sep, *parts)
    return F.when(whole.rlike(r"\A[!-~]*\z"), whole).otherwise(F.concat_ws(sep, *[strip(p) for p in parts]))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once."""
    return F.transform(F.array(x), f)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row; filters on them do not compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def blank(c: Column) -> Column:
    """Null, empty, or white space alone."""
    return F.coalesce(F.when(_solid(c), F.lit(False)).otherwise(strip(c) == ""), F.lit(True))


def or_else(c: Column, *others: Column) -> Column:
    """The first trimmed value that is not blank."""
    return F.coalesce(*[F.nullif(unicode_trim(x), F.lit("")) for x in (c, *others)])


def token(c: Column) -> Column:
    """A part of a route: lower case, other characters than a-z and 0-9 as one hyphen, none at the ends; ``unknown`` if nothing is left."""
    t = F.regexp_replace(F.lower(unicode_trim(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(t, F.lit("-")), F.lit("")), F.lit("unknown"))


def issues(*checks: tuple[str, Column, str]) -> Column:
    """ARRAY of (field, message) of the checks (field, failing condition, message) that fail."""
    every = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, bad, m in checks])
    return F.filter(every, lambda x: x.isNotNull())


def any_of(checks) -> Column:
    """Whether any of the checks (field, failing condition, message) fails."""
    bad = F.lit(False)
    for _, c, _ in checks:
        bad = bad | F.coalesce(c, F.lit(False))
    return bad


def problem(code: str, message: str, retryable: bool = False, found: Column | None = None) -> Column:
    empty = F.array().cast("array<struct<field:string,message:string>>")
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(retryable).alias("retryable"), (empty if found is None else found).alias("issues"))


def last_key_wins(df: DataFrame) -> DataFrame:
    """Lets VARIANT objects repeat a key, the last of which counts; a setting of the session."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df


# --- printed values -------------------------------------------------------------------


def variant_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _plain_number(v: Column) -> Column:
    plain = lambda s: F.when(s.contains("E"), v.cast("decimal(38,18)").cast("string")).otherwise(s)
    return let(let(v.cast("string"), plain), lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s))


def _shortest_number(v: Column) -> Column:
    """Shortest digits of a double, in scientific form below 1e-4 and from 1e6 on, where exponents have two digits at least."""
    d = v.cast("double")
    s = F.abs(d).cast("string")
    part = lambda k: F.regexp_extract(s, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", k)
    shift = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).cast("int")
    every = F.concat(part(1), part(2))
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    digits = F.btrim(every, F.lit("0"))
    exp = F.length(part(1)) + shift - lead - 1
    n = F.length(digits)
    science = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""),
                       F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    whole = F.rpad(digits, F.greatest(n, exp + 1), F.lit("0"))
    plain = F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)).otherwise(
        F.concat(F.substring(whole, F.lit(1), exp + 1), F.when(n > exp + 1, F.concat(F.lit("."), F.substring(whole, exp + 2, n))).otherwise("")))
    out = F.when(d == 0, "0").when((exp < -4) | (exp >= 6), science).otherwise(plain)
    return F.concat(F.when(d < 0, "-").otherwise(""), out)


def print_value(v: Column, mode: str = "plain") -> Column:
    """A VARIANT as ``equals`` compares it.

    ``plain`` writes numbers without exponent and trailing zeros; ``compat``
    writes them with shortest digits, in scientific form from 1e6 on and below 1e-4, and
    prints arrays and objects one level deep.  Null is ``<nil>``; nested
    values that a mode does not print are null, which equals nothing.
    """
    number = _plain_number if mode == "plain" else _shortest_number

    def of_kind(x: Column, k: Column) -> Column:
        return (F.when(k == "VOID", "<nil>").when(k.isin("STRING", "BOOLEAN"), x.cast("string"))
                .when(k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), number(x)))

    def scalar(x: Column) -> Column:
        return let(variant_type(x), lambda k: of_kind(x, k))

    nested = lambda k: k.startswith("ARRAY") | k.startswith("OBJECT")
    out = let(variant_type(v), lambda k: F.when(nested(k), F.lit(None).cast("string")).otherwise(of_kind(v, k)))
    if mode != "compat":
        return out
    kind = variant_type(v)
    arr = F.transform(F.try_variant_get(v, "$", "array<variant>"), scalar)
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    pairs = F.transform(F.array_sort(F.map_keys(obj)), lambda k: F.concat(k, F.lit(":"), scalar(F.element_at(obj, k))))
    whole = lambda a, text: F.when(~F.exists(a, lambda x: x.isNull()), text)
    return (F.when(kind.startswith("ARRAY"), whole(arr, F.concat(F.lit("["), F.array_join(arr, " "), F.lit("]"))))
            .when(kind.startswith("OBJECT"), whole(pairs, F.concat(F.lit("map["), F.array_join(pairs, " "), F.lit("]")))).otherwise(out))


# --- canonical JSON -------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    """A JSON string as the reference format writes it: quotes and controls as usual, <, > and & as \\u003c, \\u003e and \\u0026."""
    s = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    s = F.regexp_replace(F.regexp_replace(s, r'^\{"x":', ""), r"\}$", "")
    for raw, code in (("<", "u003c"), (">", "u003e"), ("&", "u0026"), (" ", "u2028"), (" ", "u2029")):
        s = F.replace(s, F.lit(raw), F.lit("\\" + code))
    return s


def _object(*members: tuple[str, Column, Column]) -> Column:
    """Members (name, JSON, whether it is written)."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(cond, F.concat(F.lit(f'"{n}":'), j)) for n, j, cond in members]), F.lit("}"))


def canonical_json(metadata="metadata", bindings="bindings", fields="fields", rules="rules") -> Column:
    """The normalised document as JSON with members as declared; blank optional members and false ``required`` are left out, labels are sorted."""
    yes, filled = F.lit(True), lambda c: F.coalesce(c != "", F.lit(False))
    meta = F.col(metadata)
    labels = meta["labels"]
    label = F.array_join(F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(_quoted(k), F.lit(":"), _quoted(F.element_at(labels, k)))), ",")
    head = _object(("name", _quoted(meta["name"]), yes), ("description", _quoted(meta["description"]), filled(meta["description"])),
                   ("labels", F.concat(F.lit("{"), label, F.lit("}")), F.coalesce(F.size(labels) > 0, F.lit(False))))
    many = lambda arr, one: F.when(F.col(arr).isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(arr, one), ","), F.lit("]")))
    binding = lambda b: _object(("name", _quoted(b["name"]), yes), ("topic", _quoted(b["topic"]), yes))
    field = lambda f: _object(("name", _quoted(f["name"]), yes), ("type", _quoted(f["type"]), yes), ("required", F.lit("true"), F.coalesce(f["required"], F.lit(False))))
    rule = lambda r: _object(*[(n, _quoted(r[n]), yes if n in ("name", "field", "operator") else filled(r[n])) for n in ("name", "field", "operator", "expected_value", "severity")])
    return F.concat(F.lit('{"metadata":'), head, F.lit(',"bindings":'), many(bindings, binding), F.lit(',"fields":'), many(fields, field), F.lit(',"rules":'), many(rules, rule), F.lit("}"))
