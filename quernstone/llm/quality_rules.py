"""Quality rules with adaptive thresholds (operator 4), in DataFrame functions only.

Every text gets its measures. Mergeable quantile sketches (KLL) of each ratio and of the texts' lengths are built
per language and source; merged, they give the sketches per language and overall. A ratio's fence is its median and
a multiple of the distance from its first decile to the median; where clean texts hardly differ, that distance is at
least what a few signs, lines or words make of a text of median length. All of these are taken from the lower half, so junk
lifts a fence only where it is the larger part of a group. A group's fence is blended with its language's, and that with
the overall one, by the number of rows behind each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, maybe_broadcast

#: White space between words, and the signs that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 5
#: Size of the sketches: below so many rows they are exact.
SKETCH_K = 4096
#: A group's own fence weighs as its rows do against so many rows of the group above it.
BLEND_ROWS = 20
#: The fence of a ratio: median + SPREAD * max(median - first decile, grain / median length).
SPREAD = 12.0
#: For each ratio its grain and what it is measured against.
GRAINS = {"symbol_ratio": (3.0, "word_chars"), "upper_ratio": (3.0, "word_chars"), "dup_line_ratio": (0.2, "n_lines"), "repeat_ratio": (3.5, "n_words")}
LENGTHS = ["word_chars", "n_lines", "n_words"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: the optimizer may not copy it into the functions of arrays."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """How many places lie in windows whose hash comes twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(s: Column, j: Column, h: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == h, F.lit(False))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, j - 1, x["h"]) | same(s, j + 1, x["h"])), lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    return bind(placed, lambda s: bind(places(s), total))


def _repeated(words: Column) -> Column:
    def windows(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        )

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), count))


def measure(docs: DataFrame) -> DataFrame:
    """Add the struct column _m with MEASURES to docs; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            bind(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        )

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # a generated row keeps the optimizer from taking the measures anew for every use of one of them
    return docs.withColumn("_m", F.explode(F.array(bind(words, measures))))


def ratios(m: str = "_m.") -> dict[str, Column]:
    c = lambda x: F.col(m + x).cast("double")
    some = lambda x: F.greatest(c(x), F.lit(1.0))
    return {
        "symbol_ratio": c("n_symbols") / some("word_chars"),
        "upper_ratio": c("n_upper") / some("word_chars"),
        "dup_line_ratio": c("n_dup_lines") / some("n_lines"),
        "repeat_ratio": c("n_repeat_words") / some("n_words"),
    }


def base_failed(m: str = "_m.") -> Column:
    return (F.col(m + "n_words") < 10) | (100 * F.col(m + "n_repeat_words") > 20 * F.col(m + "n_words"))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and the fence of every ratio: a row for each language and source, nulls being groups too.

    The sketches are updated before the shuffle and merged after it, so a source may hold any share of the rows.
    """
    names = [*GRAINS, *LENGTHS]
    own = measured.select("lang", "source", *[v.alias(k) for k, v in ratios().items()], *[F.col(f"_m.{k}").cast("double").alias(k) for k in LENGTHS])
    sketches = checkpointed(own.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, SKETCH_K).alias(k) for k in names]))
    merged = [F.kll_merge_agg_double(k, SKETCH_K).alias(k) for k in names]
    by_lang = sketches.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = sketches.groupBy(F.lit("all").alias("_all")).agg(F.sum("n").alias("n"), *merged)

    def fences(df: DataFrame, prefix: str) -> DataFrame:
        at = lambda k, q: F.kll_sketch_get_quantile_double(k, F.lit(q))
        cut = {k: at(k, 0.5) + SPREAD * F.greatest(at(k, 0.5) - at(k, 0.1), grain / F.greatest(at(of, 0.5), F.lit(1.0))) for k, (grain, of) in GRAINS.items()}
        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.select(*keys, F.col("n").alias(f"{prefix}n"), *[v.alias(f"{prefix}{k}") for k, v in cut.items()])

    a, b, every = fences(sketches, "s_"), fences(by_lang, "l_").withColumnRenamed("lang", "_lang"), fences(overall, "a_").first()
    joined = a.join(b, F.col("lang").eqNullSafe(F.col("_lang")))

    def blend(k: str) -> Column:
        above = (F.col("l_n") * F.col(f"l_{k}") + BLEND_ROWS * F.lit(every[f"a_{k}"] if every else 0.0)) / (F.col("l_n") + BLEND_ROWS)
        return (F.col("s_n") * F.col(f"s_{k}") + BLEND_ROWS * above) / (F.col("s_n") + BLEND_ROWS)

    return checkpointed(joined.select("lang", "source", *[blend(k).alias(f"max_{k}") for k in GRAINS]))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join the fences to measured rows and add base_failed and kept."""
    t = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{k}" for k in GRAINS])
    t = maybe_broadcast(t, t.count(), 100_000)
    joined = measured.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k, v in ratios().items():
        inside = inside & (v <= F.col(f"max_{k}"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & F.coalesce(inside, F.lit(True))).drop("_lang", "_source", *[f"max_{k}" for k in GRAINS])


def rate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every whole text.

    A null or empty text has no words and fails. Null languages and sources are groups of their own. Repeated rows
    each count and each give a row; an empty table gives none; other columns are ignored. A ratio equal to its fence is kept.
    """
    slim = docs.select("doc_id", "text", "lang", "source")
    measured = checkpointed(measure(slim).select("doc_id", "lang", "source", "_m"))
    return judge(measured, thresholds(measured)).select("doc_id", *[F.col(f"_m.{k}") for k in MEASURES], "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that rate_documents() keeps, with all their columns, whatever their names.

    Nulls, empty texts and repeated rows are treated as there; an empty table gives none.
    """
    whole = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    measured = measure(whole)
    return judge(measured, thresholds(measured)).filter("kept").select("row.*")


_T = ["symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio"]
_Q = lambda k, q: f"coalesce(max({k}) FILTER (WHERE r_{k} = greatest(1, ceil({q} * c))), 0)"


def _fences(keys: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    ranked = ", ".join(f"row_number() OVER ({by} ORDER BY {k}) AS r_{k}" for k in [*_T, *LENGTHS])
    cuts = ", ".join(f"{_Q(k, 0.5)} + {SPREAD} * greatest({_Q(k, 0.5)} - {_Q(k, 0.1)}, {grain} / greatest({_Q(of, 0.5)}, 1.0)) AS {k}" for k, (grain, of) in GRAINS.items())
    group = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {keys + ',' if keys else ''} count(*) AS n, {cuts} FROM (SELECT *, count(*) OVER ({by}) AS c, {ranked} FROM r) {group}"


_BLENDED = lambda k: f"(s.n * s.{k} + {BLEND_ROWS} * ((l.n * l.{k} + {BLEND_ROWS} * a.{k}) / (l.n + {BLEND_ROWS}))) / (s.n + {BLEND_ROWS})"


#: Sketches are exact for as few rows as the check at sf0.01 has; then the fences are plain order statistics.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 5) t(k)) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
    FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
r AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio FROM m),
s AS ({_fences('lang, source')}), l AS ({_fences('lang')}), a AS ({_fences('')})
SELECT r.doc_id, {', '.join('r.' + k for k in MEASURES)}, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(f'r.{k} <= {_BLENDED(k)}' for k in _T)} AS kept
FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source JOIN l ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""
