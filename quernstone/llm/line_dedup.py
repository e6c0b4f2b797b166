"""Line deduplication by content-defined chunks (operator 1), in DataFrame functions only.

A rolling hash over the hashes of the last two lines marks boundaries, so that the same passage is cut alike
wherever it stands. A chunk may start at every line and runs to the next mark below it, so no boundary depends on what
stands around a passage. Chunks of several lines, and single lines of many words, that come again anywhere are
found by their hash, compared byte by byte, and all but the first are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, maybe_broadcast, md5_int
from quernstone.llm.quality_rules import bind

#: Lines that the rolling hash spans, and the bits of it that mark: two bits leave three of four lines marked, and what one
#: pair of bits passes over another one marks.
SPAN, BITS = 2, (7, 13)
#: A chunk ends at the latest so many lines below its start.
REACH = 6
#: A chunk counts if it has several lines with a word, or more words than this.
LONG_WORDS = 50
HASH_BITS = 52


def _rolled(h: Column, i: Column) -> Column:
    """Cyclic rolling hash of the lines up to place i: rotate, then exclusive or with the next."""
    mask = (1 << HASH_BITS) - 1
    out = F.lit(0).cast("long")
    for k in reversed(range(SPAN)):
        turned = F.shiftleft(out, 1).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftrightunsigned(out, HASH_BITS - 1))
        out = turned.bitwiseXOR(F.coalesce(F.get(h, i - k), F.lit(0).cast("long")))
    return out


def _chunks(lines: Column) -> Column:
    """start, stop (line numbers, both included) and text of the chunks of all bits that may count, each span once."""
    last = F.size(lines) - 1

    def marked(r: Column, j: Column, bit: int) -> Column:
        return (F.pmod(F.shiftright(F.get(r, j), bit), F.lit(4)) != 0) & (F.trim(F.get(lines, j)) != "")

    def spans(r: Column, bit: int) -> Column:
        def end(i: Column) -> Column:
            found = F.when(marked(r, i + 1, bit), i + 1)
            for k in range(2, REACH):
                found = found.when(marked(r, i + k, bit), i + k)
            return F.least(found.otherwise(i + REACH), last)

        return F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: i < last), lambda i: F.struct(i.alias("start"), end(i).alias("stop")))

    def texts(r: Column) -> Column:
        long = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("start"), F.when(F.length(x) > 2 * LONG_WORDS, i).alias("stop"))), lambda s: s["stop"].isNotNull())
        every = F.array_distinct(F.concat(long, *[spans(r, bit) for bit in BITS]))
        return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.array_join(F.slice(lines, s["start"] + 1, s["stop"] - s["start"] + 1), "\n").alias("text")))

    rolled = bind(F.transform(lines, lambda x: md5_int(x, 13)), lambda h: F.transform(h, lambda _, i: _rolled(h, i)))
    return bind(rolled, texts)


def chunked(docs: DataFrame) -> DataFrame:
    """Add _chunks, an array of the text's chunks that count."""
    found = bind(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), _chunks)
    return docs.withColumn("_chunks", F.filter(found, lambda c: _counts(c["text"])))


def _counts(chunk: Column) -> Column:
    """Whether a chunk is one to look for: several lines with a word, or one of many words."""
    several = F.size(F.filter(F.split(chunk, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))) > 1
    return several | ((F.length(chunk) > 2 * LONG_WORDS) & (F.size(F.split(chunk, r"[\x20\x09-\x0D]+")) > LONG_WORDS))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines of repeated chunks removed from text, and the column removed_lines.

    The first place in order of doc_id, then of place in the text, keeps a chunk; so the first place of every line
    stays. Null ids come first and count as one id; rows with the same id and text are one document, cut alike. A null
    text stays null. A text that loses all its lines becomes empty. Very long texts are worked on whole. An empty
    table gives no rows. Columns other than doc_id and text stay as they are, whatever their names; a column removed_lines
    would be replaced.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    base = docs.select("doc_id", "text").filter(F.col("text").contains("\n") | (F.length("text") > 2 * LONG_WORDS))
    places = chunked(base).select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.transform("_chunks", lambda c: F.xxhash64(c["text"]))).alias("h"))
    places = checkpointed(places)
    again = checkpointed(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    again = maybe_broadcast(again, again.count())
    affected = checkpointed(places.join(again, "h", "left_semi").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    few = maybe_broadcast(affected, affected.count())
    found = base.withColumn("th", F.xxhash64("text")).join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    # a plain explode would have the optimizer test the chunks' number below the projection, which cuts each text again
    found = chunked(found).select("doc_id", "th", F.explode_outer("_chunks").alias("c")).select("doc_id", "th", "c.start", "c.stop", F.col("c.text").alias("chunk"))
    found = found.filter("chunk IS NOT NULL").withColumn("h", F.xxhash64("chunk"))
    found = checkpointed(found.join(again, "h", "left_semi"))
    first = found.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "start", "th")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marks = (
        found.join(first, ["h", "chunk"])
        .filter(~F.struct(F.col("doc_id"), F.col("start"), F.col("th")).eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("id"), "th", F.explode(F.sequence("start", "stop")).alias("line")).distinct()
        .groupBy("id", "th").agg(F.collect_list("line").alias("gone"))
    )
    marks = checkpointed(marks)
    held = marks.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0]  # numbers in all rows
    marks = maybe_broadcast(marks, held)
    rows = docs.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = rows.join(marks, F.col("own").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    cut = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(bind(F.split("row.text", "\n"), kept))
    columns = [cut.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return joined.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """dedup_lines() for documents, with their columns only: n_chars follows the text; a null or untouched text keeps its own.

    A column removed_lines of docs is kept as it is; an empty table gives none.
    """
    mine = [c for c in docs.columns if c != "removed_lines"]
    held = docs.select(*[F.col(f"`{c}`") for c in mine], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")) if "removed_lines" in docs.columns else docs
    out = dedup_lines(held)
    changed = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    own = {"n_chars": changed, "removed_lines": F.col("whole.removed_lines").alias("removed_lines")} if held is not docs else {"n_chars": changed}
    return out.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


#: The same in SQL.
_END = lambda bit: "CASE " + " ".join(f"WHEN (r[i + {k + 1}] >> {bit}) % 4 <> 0 AND trim(ls[i + {k + 1}], ' ') <> '' THEN i + {k}" for k in range(1, REACH)) + f" ELSE i + {REACH} END"
ORACLE_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS MATERIALIZED (SELECT *, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 13) AS BIGINT)) AS hs FROM t),
d AS MATERIALIZED (SELECT doc_id, ls, list_transform(range(1, len(ls) + 1), lambda i: xor(((coalesce(hs[CASE WHEN i > 1 THEN i - 1 END], 0) & {(1 << (HASH_BITS - 1)) - 1}) << 1) | (coalesce(hs[CASE WHEN i > 1 THEN i - 1 END], 0) >> {HASH_BITS - 1}), hs[i])) AS r FROM h),
l AS (SELECT doc_id, ls, r, unnest(range(0, len(ls))) AS i FROM d),
e AS (SELECT DISTINCT doc_id, i, z FROM ({' UNION ALL '.join(f"SELECT doc_id, i, least({_END(b)}, len(ls) - 1) AS z FROM l WHERE i < len(ls) - 1" for b in BITS)}
    UNION ALL SELECT doc_id, i, i FROM l WHERE length(ls[i + 1]) > {2 * LONG_WORDS})),
k AS (SELECT e.doc_id, i AS a, z, ls[i + 1:z + 1] AS part FROM e JOIN d ON e.doc_id = d.doc_id),
f AS MATERIALIZED (SELECT doc_id, a, z, array_to_string(part, chr(10)) AS chunk FROM k WHERE len(list_filter(part, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) > 1
    OR (length(array_to_string(part, chr(10))) > {2 * LONG_WORDS} AND len(string_split_regex(array_to_string(part, chr(10)), '[\\x20\\x09-\\x0D]+')) > {LONG_WORDS})),
n AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS nth FROM f),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM n WHERE nth > 1)
SELECT l.doc_id, md5(coalesce(string_agg(l.ls[l.i + 1], chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS text_md5,
    CAST(count(gone.i) AS BIGINT) AS removed_lines FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
"""
