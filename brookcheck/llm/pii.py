"""Personal data and what gives it away, with DataFrame functions only.

Four patterns find e-mail addresses, IP addresses, card and phone numbers.
A value is an entity, and so is what values have in common: the domain of an
address, the network, the number's first digits.
Information-theoretic sanitisation adds terms: over all lines of the corpus,
the pointwise mutual information of a term with an entity in its line or the lines beside it, as a share of
the entity's own information, says how far the term alone discloses the entity
(1: the term never stands without it).  How often entity and term meet is
estimated from the other meetings (leaving one out) and from below (the lower bound of a Wilson interval), so that few meetings
count for less.  In documents that hold the entity, terms
above the threshold are generalised, and removed when they disclose almost
all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, tidy

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds.  Possessive repeats and the look-behinds only
#: spare Java from recursion and from retries inside one run; ``\G`` admits a
#: match that starts where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TERM = r"\p{L}{3,}"
#: Deviations of the lower bound of the share of a term's lines that are near an entity.
Z = 1.645
#: Candidate terms up to this many are broadcast (as 8-byte hashes); beyond, both sides are shuffled.
BROADCAST_TERMS = 1_000_000


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(False)


def _is(kind: str):
    return lambda s: _valid(kind, s["value"])


def _located(text: Column, pattern: Column, kind: str, order: int) -> Column:
    """Matches as structs (start, o, end, kind, value), from what stands between them; code points."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,o:int,end:int,kind:string,value:string>>")

    def step(s, i):
        value, start = F.element_at(found, i), s["at"] + F.length(F.element_at(between, i))
        end = start + F.length(value)
        one = F.struct(start.alias("start"), F.lit(order).alias("o"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(1), F.size(found)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds by start, then kind."""
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<struct<start:int,o:int,end:int,kind:string,value:string>>")
    each = [F.when(needs[k], F.filter(_located(text, F.lit(PATTERNS[k]), k, i), _is(k))).otherwise(empty) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _terms(line: Column) -> Column:
    """Distinct lower-case terms of a line outside of what the patterns match."""
    for k in KINDS:
        line = F.regexp_replace(line, PATTERNS[k], " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(f"({_TERM})")))


def _entities(s: Column) -> Column:
    """Hashes of a span's value and of what it has in common with others of its kind."""
    value, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
    shared = (F.when(s["kind"] == "email", F.substring_index(value, "@", -1)).when(s["kind"] == "ip", F.regexp_extract(value, r"^(.*)\.[^.]*$", 1))
              .when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4)))
    return F.array(F.xxhash64(s["kind"], F.lit("value"), value), F.xxhash64(s["kind"], F.lit("shared"), shared))


def lower_share(k: Column, n: Column) -> Column:
    """Lower bound of the Wilson interval, ``Z`` deviations wide, of ``k`` in ``n`` without the one at hand; null if there is no other."""
    k, n = k - 1, F.nullif(n - 1, F.lit(0.0))
    p = k / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


@tidy
def terms_told(rows: DataFrame, docs: DataFrame, generalise: float, remove: float, least_bits: float) -> DataFrame:
    """th, tl, told: the disclosing terms (t, gone) of texts that hold an entity; ``rows`` are those of ``find_pii``."""
    unit = ["th", "tl"]
    hits = keep(rows.where("hit is not null").select(*unit, "hit", "base", "n_lines").dropDuplicates(unit), "hits")
    spans = hits.select(*unit, "n_lines", "hit", F.explode("base").alias("s"))
    before = F.substring(F.col("hit"), F.lit(1), F.col("s.start"))
    spans = spans.select(*unit, "n_lines", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("at"), F.explode(_entities(F.col("s"))).alias("e"))
    near = spans.select(*unit, "e", F.explode(F.sequence(F.greatest(F.col("at") - 1, F.lit(0)), F.least(F.col("at") + 1, F.col("n_lines") - 1))).alias("at")).distinct()
    near = keep(near, "near")
    # An entity near a single line meets no term twice.
    entities = keep(near.groupBy("e").agg(F.count("*").alias("n_e")).where("n_e > 1"), "entities")
    near = keep(near.join(entities.select("e"), "e", "left_semi"), "near")
    lines = hits.select(*unit, F.posexplode(F.split("hit", "\n")).alias("at", "line")).join(near.select(*unit, "at").distinct(), [*unit, "at"], "left_semi")
    terms = keep(lines.select(*unit, "at", F.explode(_terms(F.col("line"))).alias("t")), "lines")
    pairs = near.join(terms, [*unit, "at"]).groupBy("e", "t").agg(F.count("*").alias("n_et")).join(entities, "e")

    total = float(hits.select(F.sum("n_lines")).first()[0] or 0) + float(rows.where("hit is null").select(*unit, "n_lines").distinct().select(F.sum("n_lines")).first()[0] or 0)
    own = F.log2(F.lit(total) / F.col("n_e"))
    told = lambda n_t: (F.log2(lower_share(F.col("n_et").cast("double"), n_t.cast("double"))) + own) / own
    # What would not be told even if the term stood nowhere else need not be counted.
    pairs = keep(pairs.where("n_et > 1").where((own >= least_bits) & (told(F.col("n_et")) >= generalise)), "pairs")
    names = keep(pairs.select(F.xxhash64("t").alias("k")).distinct(), "terms")
    if names.count() <= BROADCAST_TERMS:
        names = F.broadcast(names)
    # Copies of a text count once: each has its share of one, so that terms are summed before any shuffle.
    copies = keep(rows.groupBy(*unit).agg(F.count("*").alias("m")).where("m > 1"), "copies")
    if copies.count() <= BROADCAST_TERMS:
        copies = F.broadcast(copies)
    everywhere = docs.where("text is not null").select(F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tl"), "text").join(copies, unit, "left")
    everywhere = everywhere.select((1 / F.coalesce("m", F.lit(1))).alias("w"), F.explode(F.split("text", "\n")).alias("line"))
    everywhere = everywhere.select("w", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(f"({_TERM})")))).alias("t"))
    counts = everywhere.select("w", F.xxhash64("t").alias("k")).join(names, "k", "left_semi").groupBy("k").agg(F.round(F.sum("w")).cast("long").alias("n_t"))
    found = pairs.withColumn("k", F.xxhash64("t")).join(counts, "k").withColumn("told", told(F.greatest("n_t", "n_et"))).where(F.col("told") >= generalise)
    found = found.select("e", "t", (F.col("told") >= remove).alias("gone"))
    by_text = near.select(*unit, "e").distinct().join(found, "e").groupBy(*unit, "t").agg(F.max("gone").alias("gone"))
    return by_text.groupBy(*unit).agg(F.collect_list(F.struct("t", "gone")).alias("told"))


def find_pii(docs: DataFrame, generalise: float = 0.9, remove: float = 0.98, least_bits: float = 6.0) -> DataFrame:
    """doc_id, th, tl, n_lines, base, terms and hit: one row per row of ``docs``.

    base holds the spans of the patterns, terms those of disclosing terms; hit
    is the text of documents with any base span.  Meetings are counted in lines; one that has no other tells nothing.  A term discloses an entity from a share ``generalise`` of
    its information on, and is removed from ``remove`` on; entities of fewer than ``least_bits``, which stand
    near more than one line in 64, are no secret.  Copies of a text count once.  Null text counts as empty.
    Documents without protected values never gain terms.  Rows are told apart
    by 128 bits of hash of the text, so null and repeated ids do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    rows = keep(rows.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tl"), n_lines.alias("n_lines"), "base", F.when(F.size("base") > 0, F.col("text")).alias("hit")), "base")
    hits = rows.where("hit is not null")
    by_text = terms_told(rows, docs, generalise, remove, least_bits)

    unit = ["th", "tl"]
    one = hits.select(*unit, "hit", "base").dropDuplicates(unit).join(by_text, unit)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("told", lambda x: x["t"]), "|"), F.lit(r")(?!\p{L})"))
    gone = F.transform(F.filter("told", lambda x: x["gone"]), lambda x: x["t"])
    one = one.select(*unit, "base", gone.alias("gone"), _located(F.col("hit"), pattern, "term", len(KINDS)).alias("terms"))
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    one = one.select(*unit, F.transform(free, lambda t: t.withField("value", F.when(F.array_contains("gone", F.lower(t["value"])), "").otherwise("[TERM]"))).alias("terms"))
    one = keep(one, "told")
    empty = F.array().cast("array<struct<start:int,o:int,end:int,kind:string,value:string>>")
    clean = rows.where("hit is null").select("*", empty.alias("terms"))
    return clean.unionByName(hits.join(one, unit, "left").select(*rows.columns, F.coalesce("terms", empty).alias("terms")))


@tidy
def spans_per_document(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms: one row per row of ``docs``.

    Null and empty texts have no spans and the digest of the empty string.
    Further columns are ignored; an empty table gives none.
    """
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@tidy
def replaced_texts(docs: DataFrame) -> DataFrame:
    """th, tl, new: texts that hold spans, by hash, and what becomes of them."""
    found = find_pii(docs).where(F.size("base") > 0)
    spans = F.array_sort(F.concat("base", "terms"))
    text = F.col("hit")

    def step(s, x):
        tag = F.when(x["kind"] == "term", x["value"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        more = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), tag)
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], more).otherwise(s["out"]).alias("out"))

    new = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select("th", "tl", new.alias("new")).dropDuplicates(["th", "tl"])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows; spans of ``text`` are replaced by [KIND], terms by [TERM] or nothing.

    Null text stays null, and repeated rows are replaced each.  Overlapping spans go together.  A column n_chars
    follows the text.  Other columns stay, whatever their names.  Only documents with spans are shuffled.  An empty table stays empty.
    """
    th, tl, new = (fresh(c, docs.columns) for c in ("_th", "_tl", "_new"))
    texts = replaced_texts(docs).toDF(th, tl, new)
    clean = F.size(base_spans(F.coalesce("text", F.lit("")))) == 0
    out = docs.where(~clean).withColumns({th: F.xxhash64("text"), tl: F.xxhash64(F.lit(1), "text")}).join(texts, [th, tl], "left")
    out = out.withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return docs.where(clean).unionByName(out.select(*docs.columns))


def sql(generalise: float = 0.9, least_bits: float = 6.0) -> str:
    """The rows of ``spans_per_document`` in DuckDB."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    size = lambda of: f"coalesce(list_sum(list_transform({of}, lambda x: length(x))), 0)"

    def spans(name: str, source: str) -> str:
        """CTEs that end in ``name`` (id, kind, o, start, stop, v): valid matches in the rows (id, t) of ``source``."""
        each = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM {source} WHERE regexp_matches(t, '{p}')" for i, (k, p) in enumerate(plain.items()))
        digit = "CAST(substr(reverse(digits), i, 1) AS INT)"
        luhn = f"list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 0 THEN {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END)) % 10 = 0"
        part = "length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(right(p, 4) AS INT), 0) <= 255"
        return f"""{name}_m AS ({each}),
{name}_i AS (SELECT id, kind, o, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_p AS (SELECT id, kind, o, m[i] AS v, CAST({size('g[1:i]')} + {size('m[1:i - 1]')} AS BIGINT) AS start FROM {name}_i),
{name}_d AS (SELECT *, start + length(v) AS stop, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM {name}_p),
{name} AS (SELECT id, kind, o, start, stop, v FROM {name}_d WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: NOT ({part}))) = 0
  WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND {luhn} ELSE length(digits) BETWEEN 10 AND 15 END)"""

    masked = "line"
    for p in plain.values():
        masked = f"regexp_replace({masked}, '{p}', ' ', 'g')"
    def low(k: str, n: str) -> str:
        k, n = f"({k} - 1)", f"nullif({n} - 1, 0)"
        return f"(({k} / {n} + {Z * Z} / (2 * {n}) - {Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n}))) / (1 + {Z * Z} / {n}))"

    terms = lambda of: rf"unnest(list_distinct(regexp_extract_all(lower({of}), '\p{{L}}{{3,}}')))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
{spans('base', 'docs')},
shared AS (SELECT id, start, kind || ':value:' || lower(v) AS e FROM base UNION ALL SELECT id, start, kind || ':shared:' ||
  CASE kind WHEN 'email' THEN string_split(lower(v), '@')[-1] WHEN 'ip' THEN regexp_extract(v, '^(.*)\\.[^.]*$', 1) WHEN 'card' THEN regexp_replace(v, '[^0-9]', '', 'g')[1:6] ELSE regexp_replace(v, '[^0-9]', '', 'g')[1:-5] END FROM base),
one_of AS (SELECT min(id) AS id, t FROM docs GROUP BY t),
lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS ln FROM one_of),
near AS (SELECT DISTINCT id, e, unnest(range(greatest(ln - 1, 0), least(ln + 1, n - 1) + 1)) AS ln FROM
  (SELECT id, e, len(string_split(substr(t, 1, start), chr(10))) - 1 AS ln, len(string_split(t, chr(10))) AS n FROM shared JOIN one_of USING (id))),
n_e AS (SELECT e, count(*) AS n_e FROM near GROUP BY e),
lt AS (SELECT id, ln, {terms(masked)} AS term FROM lines SEMI JOIN near USING (id, ln)),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lines),
pairs0 AS (SELECT e, term, count(*) AS n_et FROM near JOIN lt USING (id, ln) GROUP BY e, term),
pairs AS (SELECT e, term, CAST(n_et AS DOUBLE) AS n_et, log2(n / n_e) AS own FROM pairs0 JOIN n_e USING (e), total WHERE n_et > 1 AND log2(n / n_e) >= {least_bits} AND (log2({low('CAST(n_et AS DOUBLE)', 'CAST(n_et AS DOUBLE)')}) + log2(n / n_e)) / log2(n / n_e) >= {generalise}),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT {terms('line')} AS term FROM lines) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
told AS (SELECT e, term FROM (SELECT e, term, n_et, own, greatest(CAST(n_t AS DOUBLE), n_et) AS n_t FROM pairs JOIN n_t USING (term)) WHERE (log2({low('n_et', 'n_t')}) + own) / own >= {generalise}),
doc_terms AS (SELECT DISTINCT d.id, term FROM docs d JOIN one_of o ON o.t = d.t JOIN near n ON n.id = o.id JOIN told USING (e)),
runs AS (SELECT id, regexp_extract_all(t, '\\p{{L}}+') AS m, string_split_regex(t, '\\p{{L}}+') AS g FROM docs WHERE id IN (SELECT id FROM doc_terms)),
run_i AS (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM runs),
hits AS (SELECT id, m[i] AS v, CAST({size('g[1:i]')} + {size('m[1:i - 1]')} AS BIGINT) AS start FROM run_i SEMI JOIN doc_terms ON run_i.id = doc_terms.id AND lower(run_i.m[run_i.i]) = doc_terms.term),
term_spans AS (SELECT id, 'term' AS kind, 4 AS o, start, start + length(v) AS stop, v FROM hits h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = h.id AND b.start < h.start + length(h.v) AND h.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM term_spans),
n AS (SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_terms,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM every GROUP BY id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM docs LEFT JOIN n USING (id)"""
