"""Secret scans: three base patterns, and sliding-window entropy over candidate strings.

A scan cuts a text into (gap, match) pairs with one pattern, so places follow from running sums of lengths, in blocks of BLOCK
matches, so that no array of all of them grows match by match. Candidates of the
entropy method are long runs of key characters with both digits and letters; by class (hexadecimal, base64)
their best window's Shannon entropy, kept by incremental counts as characters enter and leave (five bits a character, in six numbers), is held
against a threshold; an allow-list suppresses identifiers, joined words and placeholders, and what base spans
touch is theirs. Spans are in code points, the end exclusive.

Null texts are empty and have no spans; scans of long texts are linear but for copies of references within a block; ties are ordered by kind; equal rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.op9_quality_rules import let
from logsignals.llm.textual import table

_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYWORD = "(?:" + "|".join(_ANY_CASE(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_LEAD = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern, a pattern within all its matches that is quick to look for, part of a match whose length counts, least length)
BASE = {
    "assign": (_LEAD + "[A-Za-z0-9+/_.=-]+", _LEAD + "[A-Za-z0-9+/_.=-]", f"^{_LEAD}(.*)$", 8),
    "access": ("AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}", "^(.*)$", 16),  # what [A-Z0-9]+ would take and the length then drop holds no other match
    "hex": ("[0-9a-f]{32,}", "[0-9a-f]{32}", "^(.*)$", 32),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class: (pattern of candidates, bits over a window); the first that fits counts.
CLASSES = {"entropy_hex": ("^[0-9a-fA-F]+$", 3.05), "entropy_b64": ("", 3.65)}
WINDOW = 20
#: Matches whose places are summed up together, and characters counted in one number.
BLOCK, PACKED = 256, 12
#: Candidates that are no secrets: without digits or letters, uuids, words joined by signs (JOINED), runs of one character, and placeholders.
JOINED = "[A-Z]?[a-z]+[/_=+-]+", "[A-Za-z]*[0-9]{0,4}"
ALLOWED = ("^[^0-9]+$", "^[^A-Za-z]+$", "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "(?:0000000000|1234567890|xxxxxxxx|XXXXXXXX)", "(?i:example|placeholder|changeme)")
KINDS = (*BASE, *CLASSES)


def _entries(text: Column, pattern: str, quick: str, wanted=lambda match: F.lit(True)) -> Column:
    """(start, match) of the leftmost non-overlapping matches, of those that are wanted."""
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    none = F.array().cast("array<struct<start:int,match:string>>")

    def placed(gaps: Column, matches: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            at = a["at"] + F.length(x["gap"])
            entry = F.struct(at.alias("start"), x["match"].alias("match"))
            out = F.when(wanted(x["match"]), F.concat(a["out"], F.array(entry))).otherwise(a["out"])
            return F.struct((at + F.length(x["match"])).alias("at"), out.alias("out"))

        def add_block(a: Column, block: Column) -> Column:
            inner = F.aggregate(block, F.struct(a["at"].alias("at"), none.alias("out")), add)
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.when(F.size(i["out"]) > 0, F.concat(a["out"], F.array(i["out"]))).otherwise(a["out"]).alias("out")))

        both = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), lambda x: x["match"] != "")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,match:string>>>").alias("out"))
        blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))
        return let(both, lambda all_: F.when(F.size(all_) > 0, F.flatten(F.aggregate(blocks(all_), start, add_block, lambda a: a["out"]))).otherwise(none))

    return F.when(text.rlike(quick), placed(F.regexp_extract_all(text, cut, F.lit(1)), F.regexp_extract_all(text, cut, F.lit(2)))).otherwise(none)


def _span(kind: Column, entry: Column) -> Column:
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)
    return F.struct(entry["start"].alias("start"), order.alias("order"), (entry["start"] + F.length(entry["match"])).alias("end"), kind.alias("kind"))


def allowed(s: Column) -> Column:
    """Is a candidate no secret? Joined words are taken off from the front one by one, for a pattern that repeats a group needs a frame of the stack for each."""
    left = F.regexp_replace(s, rf"\G{JOINED[0]}", "")
    return s.rlike("|".join(ALLOWED)) | ((left != s) & left.rlike(f"^{JOINED[1]}$"))


def best_entropy(s: Column) -> Column:
    """The most bits of a window of WINDOW characters of s, 0 if it is shorter. A step adds what enters and takes what leaves from their own counts and from the sum of c * log2(c); s is cut into numbers once, so a step looks up what it needs."""
    term = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    number = F.array(*(F.lit(ALPHABET.find(chr(c))) for c in range(128)))
    fields = [f"n{j}" for j in range(-(-len(ALPHABET) // PACKED))]
    start = F.struct(*(F.lit(0).cast("long").alias(f) for f in fields), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            out, in_ = F.when(i > WINDOW, F.get(codes, i - WINDOW - 1)).otherwise(F.lit(-1)), F.get(codes, i - 1)
            packed = F.array(*(a[f] for f in fields))
            shift = lambda c: F.pmod(c, F.lit(PACKED)) * 5
            field = lambda c: F.floor(c / PACKED).cast("int")
            count = lambda c: F.call_function("shiftright", F.get(packed, field(c)), shift(c)).bitwiseAND(F.lit(31)).cast("int")

            def moved(x: Column) -> Column:
                less = a["sum"] + F.when(x["out"] >= 0, F.get(term, count(x["out"]) - 1) - F.get(term, count(x["out"]))).otherwise(0.0)
                d = count(x["in"]) - F.when(x["out"] == x["in"], 1).otherwise(0)
                total = less + F.get(term, d + 1) - F.get(term, d)
                one = lambda c, j: F.when((c >= 0) & (field(c) == j), F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(F.lit(0).cast("long"))
                best = F.when(i >= WINDOW, F.greatest(a["best"], math.log2(WINDOW) - total / WINDOW)).otherwise(a["best"])
                return F.struct(*((a[f] + one(x["in"], j) - one(x["out"], j)).alias(f) for j, f in enumerate(fields)), total.alias("sum"), best.alias("best"))

            return let(F.struct(out.alias("out"), in_.alias("in")), moved)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step, lambda a: a["best"])

    return F.when(F.length(s) < WINDOW, 0.0).otherwise(let(F.transform(F.split(s, ""), lambda c: F.get(number, F.ascii(c))), over))


def secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base and secrets: arrays of struct(start, order, end, kind), sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = []
    for kind, (pattern, quick, part, least) in BASE.items():
        long_enough = _entries(text, pattern, quick, lambda m, part=part, least=least: F.length(F.regexp_extract(m, part, 1)) >= least)
        base.append(F.transform(long_enough, lambda e: _span(F.lit(kind), e)))
    kind = lambda s: F.when(s.rlike(CLASSES["entropy_hex"][0]), "entropy_hex").otherwise("entropy_b64")
    least = lambda s: F.when(s.rlike(CLASSES["entropy_hex"][0]), CLASSES["entropy_hex"][1]).otherwise(CLASSES["entropy_b64"][1])
    found = _entries(text, CANDIDATE, CANDIDATE, lambda m: ~allowed(m))
    found = F.filter(found, lambda e: let(e["match"], best_entropy) >= least(e["match"]))
    spans = F.transform(found, lambda e: _span(kind(e["match"]), e))
    out = docs.withColumn("base", F.explode(F.array(F.sort_array(F.concat(*base)))))
    apart = lambda e: ~F.exists(F.col("base"), lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    return out.withColumn("secrets", F.explode(F.array(F.sort_array(F.concat("base", F.filter(spans, apart))))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of their secrets replaced in text, and n_chars as it is then."""
    columns = docs.columns
    text = F.col("text")
    pieces = F.array().cast("array<struct<start:int,end:int>>")

    def merge(a: Column, s: Column) -> Column:
        """Spans that overlap are one."""
        last = F.get(a, F.size(a) - 1)
        apart = F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) == 0) | (s["start"] >= last["end"]), apart).otherwise(longer)

    def joined_pieces(m: Column) -> Column:
        before = lambda s, i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        kept = F.transform(m, lambda s, i: F.concat(F.substring(text, before(s, i) + 1, s["start"] - before(s, i)), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.get(m, F.size(m) - 1)["end"] + 1, F.length(text)))

    clean = let(F.aggregate("secrets", pieces, merge), joined_pieces)
    out = secrets(docs).withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kinds, name: F.size(F.filter("secrets", lambda s: s["kind"].isin(*kinds))).cast("long").alias(name)
    return found.select(
        "doc_id", *(count([k], f"n_{k}") for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count(CLASSES, "n_entropy")
    )


def _sql() -> str:
    def entries(name: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return f"""
{name}c AS (SELECT rid, regexp_extract_all(text, '(?s)(.*?)(?:({p})|\\z)', 1) AS g, regexp_extract_all(text, '(?s)(.*?)(?:({p})|\\z)', 2) AS m FROM d WHERE regexp_matches(text, '{p}')),
{name}u AS (SELECT rid, unnest(range(1, len(g) + 1)) AS k, unnest(g) AS g, unnest(m) AS m FROM {name}c),
{name} AS (SELECT rid, m, e - length(m) AS s, e FROM (SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY k)::BIGINT AS e FROM {name}u) WHERE m <> '')"""

    parts = [entries(kind, pattern) for kind, (pattern, *_) in BASE.items()] + [entries("cand", CANDIDATE)]
    base = " UNION ALL ".join(
        f"SELECT rid, s, {i} AS o, e, '{kind}' AS kind FROM {kind} WHERE length(regexp_extract(m, '{part.replace(chr(39), chr(39) * 2)}', 1)) >= {least}" for i, (kind, (_, _, part, least)) in enumerate(BASE.items(), 1)
    )
    hexa, bits_hex, bits = CLASSES["entropy_hex"][0], CLASSES["entropy_hex"][1], CLASSES["entropy_b64"][1]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),{','.join(parts)},
base AS ({base}),
ent AS (SELECT rid, s, e, m, regexp_matches(m, '{hexa}') AS hexa, list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy'))) AS bits FROM cand WHERE NOT regexp_matches(m, '{"|".join(ALLOWED)}|^(?:{JOINED[0]})+{JOINED[1]}$')),
more AS (SELECT rid, s, CASE WHEN hexa THEN 4 ELSE 5 END AS o, e, CASE WHEN hexa THEN 'entropy_hex' ELSE 'entropy_b64' END AS kind FROM ent
  WHERE bits >= CASE WHEN hexa THEN {bits_hex} ELSE {bits} END AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = ent.rid AND b.s < ent.e AND ent.s < b.e)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (o > 3) AS n_entropy,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
