"""Quality rules: fixed base limits, and adaptive fences from mergeable quantile sketches by language and source.

Each document gets rates of capitals, repeated lines, repeated words, and its mean word length, in
thousandths, and of symbols in millionths with one added to the symbols and the characters: texts without symbols
then differ by what their length can show. A sketch of a rate is its histogram over buckets that grow by GAMMA (relative error below
(GAMMA - 1) / 2) of the documents that pass the base limits: counts add up, so sketches of sources merge into that of a language, and of languages into
one of all. A sketch's fence is its upper quantile plus a margin of what lies between that and its median; that of symbols, whose
rates go by ratios, is the quantile times a power of its ratio to the median. A group's fence is the mean
of its own and its language's, weighted by documents against SHRINK, and the language's likewise with that of all: small groups lean on
larger ones without a switch. Documents beyond a fence are rejected by a join on the group.

Null texts have no words and fail the base rules; long texts are handled in linear time and sorting; equal rows
count each; null languages and sources are groups of their own; a group of which no document passes the base limits has no
fence and keeps none; other columns are ignored; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.llm.textual import SPACE, WORD, saved, table

WINDOW = 8
#: Growth of the sketch's buckets, and documents that a group's own fence needs to count as much as the larger group's.
GAMMA, SHRINK = 1.02, 500.0
#: Rates: (upper quantile in thousandths, margin, least distance of the quantile from the median, about the resolution of a short text).
#: For those of RATIO the margin is an exponent and the least distance a ratio.
RATES = {"symbols": (750, 4.0, 1.4), "capitals": (900, 10.0, 5), "dup_lines": (990, 1.5, 20), "repeats": (975, 2.3, 100), "word_length": (750, 10.0, 20)}
RATIO = ("symbols",)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of fences up to which they are broadcast to the documents (some MB); beyond, a shuffled join.
BROADCAST_ROWS = 50_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice: sort (hash, place), keep equal neighbours, and measure what their windows cover."""
    def of_sorted(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        places = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        add = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["sum"] + p + WINDOW - F.greatest(p, a["end"])).alias("sum"))
        return F.aggregate(places, start, add, lambda a: a["sum"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
        let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)
    )


def _windows(hashes: Column, n: Column) -> Column:
    """Hashes of the runs of 8 words, by doubling: 2, 4, 8."""
    def doubled(h: Column, step: int, length: Column) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), length), F.slice(h, F.lit(step + 1), length), lambda a, b: F.xxhash64(a, b))

    return let(doubled(hashes, 1, n - 1), lambda h2: let(doubled(h2, 2, n - 3), lambda h4: doubled(h4, 4, n - 7)))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of BASE, base_failed and the rates of RATES."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        n, joined = F.size(w), F.array_join(w, "")
        repeat = F.when(n < WINDOW, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(_windows(h, n), _covered)))
        count = lambda pattern: F.regexp_count(joined, F.lit(pattern))
        return F.struct(n.alias("n"), F.length(joined).alias("chars"), count("[#*$%&|<>]").alias("symbols"), count(r"\p{Lu}").alias("capitals"), repeat.alias("repeat"))

    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = F.filter(F.split(text, SPACE + "+"), lambda x: x != "")
    out = docs.withColumn("_w", F.explode(F.array(let(words, of_words)))).withColumn("_l", F.explode(F.array(lines)))
    out = out.withColumns({
        "n_words": F.col("_w.n").cast("long"), "word_chars": F.col("_w.chars").cast("long"), "n_symbols": F.col("_w.symbols").cast("long"),
        "n_dup_lines": F.col("_l.dup").cast("long"), "n_repeat_words": F.col("_w.repeat").cast("long"),
    })
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return out.withColumns({
        "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
        "symbols": F.floor((F.col("n_symbols") + 1) * 1_000_000 / (F.col("word_chars") + 1)).cast("long"), "capitals": per("_w.capitals", "word_chars"), "dup_lines": per("_l.dup", "_l.n"),
        "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
    }).drop("_w", "_l")


def sketches(rated: DataFrame) -> DataFrame:
    """Counts by lang, source, rate and bucket, of the documents that pass the base limits."""
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in RATES))).alias("x")
    each = rated.filter(~F.col("base_failed")).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), rates)
    bucket = F.when(F.col("x.v") < 1, 0).otherwise(1 + F.floor(F.log(F.col("x.v")) / F.log(F.lit(GAMMA)))).cast("long")
    return each.groupBy("lang", "source", F.col("x.rate").alias("rate"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _fenced(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and fence by keys and rate, from merged sketches."""
    merged = counts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    run = merged.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    of_rate = lambda i: F.element_at(F.create_map(*(F.lit(x) for r, v in RATES.items() for x in (r, float(v[i])))), F.col("rate"))
    at = lambda q: F.min(F.when(F.col("below") * 1000 >= F.col("all") * q, F.col("bucket")))
    value = lambda b: F.when(b == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), b - 0.5))
    q = run.groupBy(*keys, "rate").agg(F.first("all").alias("docs"), value(at(F.lit(500.0))).alias("mid"), value(at(of_rate(0))).alias("high"))
    high, mid = F.greatest("high", F.lit(1.0)), F.greatest("mid", F.lit(1.0))
    by_ratio = high * F.pow(F.greatest(high / mid, of_rate(2)), of_rate(1))
    by_distance = F.col("high") + of_rate(1) * F.greatest(F.col("high") - F.col("mid"), of_rate(2))
    return q.select(*keys, "rate", "docs", F.when(F.col("rate").isin(*RATIO), by_ratio).otherwise(by_distance).alias("fence"))


def fences(counts: DataFrame) -> DataFrame:
    """A row for each lang and source with a fence for each rate."""
    own, lang, every = _fenced(counts, ["lang", "source"]), _fenced(counts, ["lang"]), _fenced(counts.withColumn("any", F.lit(0)), ["any"])
    best = own.join(lang.select("lang", "rate", F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence")), ["lang", "rate"])
    best = best.join(F.broadcast(every.select("rate", F.col("fence").alias("all_fence"))), "rate")
    shrunk = lambda n, fence, towards: (n * fence + SHRINK * towards) / (n + SHRINK)
    fence = shrunk(F.col("docs"), F.col("fence"), shrunk(F.col("lang_docs"), F.col("lang_fence"), F.col("all_fence")))
    return best.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == r, fence)).alias(f"fence_{r}") for r in RATES))


def judged(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """rated with kept: within the base limits and all fences of its group. limits is a saved table, whose rows are counted."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    on = (F.coalesce("lang", F.lit("")) == F.col("_lang")) & (F.coalesce("source", F.lit("")) == F.col("_source"))
    within = ~F.col("base_failed")
    for r in RATES:
        within = within & (F.col(r) <= F.col(f"fence_{r}"))
    return rated.join(limits, on, "left").withColumn("kept", F.coalesce(within, F.lit(False))).drop("_lang", "_source", *(f"fence_{r}" for r in RATES))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rates."""
    rated = saved(features(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(rated, saved(fences(sketches(rated)))).select("doc_id", *BASE, "base_failed", "kept", *RATES)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rates = {"symbols": "(n_symbols + 1) * 1000000 // (word_chars + 1)", "capitals": "n_capitals * 1000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 1000 // greatest(n_words, 1)"}
    case = lambda i: f"CASE rate {' '.join(f"WHEN '{r}' THEN {float(v[i])}::DOUBLE" for r, v in RATES.items())} END"
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE pow({GAMMA}::DOUBLE, {b} - 0.5::DOUBLE) END"
    by_ratio = f"greatest(high, 1) * pow(greatest(greatest(high, 1) / greatest(mid, 1), {case(2)}), {case(1)})"
    in_ratio = ", ".join(f"'{r}'" for r in RATIO)
    quart = lambda name, keys: f"""
{name} AS (SELECT {keys} rate, max(total) AS docs, min(CASE WHEN below * 1000 >= total * 500.0::DOUBLE THEN bucket END) AS b1, min(CASE WHEN below * 1000 >= total * {case(0)} THEN bucket END) AS b2
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} rate ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys} rate) AS total FROM (SELECT {keys} rate, bucket, sum(n) AS n FROM sk GROUP BY ALL))
  GROUP BY {keys} rate),
{name}f AS (SELECT {keys} rate, docs, CASE WHEN rate IN ({in_ratio}) THEN {by_ratio} ELSE high + {case(1)} * greatest(high - mid, {case(2)}) END AS fence FROM (SELECT *, {value('b1')} AS mid, {value('b2')} AS high FROM {name}))"""
    shrunk = lambda n, fence, towards: f"(({n} * {fence} + {SHRINK}::DOUBLE * {towards}) / ({n} + {SHRINK}::DOUBLE))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS pos FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, array_to_string(ws[pos:pos + {WINDOW - 1}], ' ')) AS c FROM p),
r AS (SELECT rid, sum(least({WINDOW}, nxt - pos)) AS n FROM (SELECT rid, pos, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos), pos + {WINDOW}) AS nxt FROM g WHERE c > 1) GROUP BY rid),
f AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'({e})::BIGINT AS {r}' for r, e in rates.items())} FROM f),
x AS ({' UNION ALL '.join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM b WHERE NOT base_failed" for r in RATES)}),
sk AS (SELECT lang, source, rate, CASE WHEN v < 1 THEN 0 ELSE 1 + floor(ln(v::DOUBLE) / ln({GAMMA}::DOUBLE))::BIGINT END AS bucket, count(*) AS n FROM x GROUP BY ALL),{quart("o", "lang, source,")},{quart("l", "lang,")},{quart("e", "")},
t AS (SELECT o.lang, o.source, o.rate, {shrunk('o.docs', 'o.fence', shrunk('l.docs', 'l.fence', 'e.fence'))} AS fence FROM of o JOIN lf l ON o.lang = l.lang AND o.rate = l.rate JOIN ef e ON o.rate = e.rate),
lim AS (SELECT lang, source, {', '.join(f"max(CASE WHEN rate = '{r}' THEN fence END) AS fence_{r}" for r in RATES)} FROM t GROUP BY lang, source)
SELECT doc_id, {', '.join(BASE)}, base_failed, coalesce(NOT base_failed AND {' AND '.join(f'{r} <= fence_{r}' for r in RATES)}, FALSE) AS kept, {', '.join(RATES)} FROM b LEFT JOIN lim USING (lang, source)
"""


SQL = _sql()
