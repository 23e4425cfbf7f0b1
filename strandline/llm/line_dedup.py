"""Removal of repeated passages by overlapping windows of three lines.

A document's lines that hold more than blanks are numbered; every three consecutive ones make a window. Windows are
compared by a 128-bit hash over all documents. Of equal windows the first in order (doc_id, then position) stays; the
lines of all later ones, and blank lines within, are removed after the positions that they cover have been merged.

Only DataFrame functions: hashes meet in one aggregation with map-side partial minimum, so a window that a third of the
documents share arrives as one row from each task; the join back to the later occurrences is a plain equi-join, which
Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, table

WINDOW = 3

_KEY = ["_id", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is known by its id and its text's hash, so rows that share an id but not a text stay apart."""
    return docs.withColumn("_id", F.col("doc_id")).withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def line_windows(docs: DataFrame) -> DataFrame:
    """(_id, _hash, k, s, e, w1, w2): number of the window among the lines that count, its first and last line, its hash."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cleaned = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\r")).alias("x")))
    hashed = F.transform(F.filter(cleaned, lambda r: r["x"] != ""), lambda r: F.struct(r["i"].alias("i"), F.xxhash64(r["x"]).alias("a"), F.xxhash64(F.lit(1), r["x"]).alias("b")))
    rows = _keyed(docs).select(*_KEY, hashed.alias("h")).filter(F.size("h") >= WINDOW)
    at = lambda j: F.expr(f"get(h, k + {j})")
    rows = rows.select(*_KEY, "h", F.explode(F.sequence(F.lit(0), F.size("h") - WINDOW)).alias("k"))
    both = [F.xxhash64(F.lit(seed), *(at(j)[c] for j in range(WINDOW))).alias(name) for seed, c, name in ((0, "a", "w1"), (1, "b", "w2"))]
    return rows.select(*_KEY, "k", at(0)["i"].alias("s"), at(WINDOW - 1)["i"].alias("e"), *both)


def covered_lines(docs: DataFrame) -> DataFrame:
    """(_id, _hash, runs): for each document with later occurrences, the merged runs of lines (s, e) that they cover."""
    windows = line_windows(docs)
    place = F.struct("_id", "_hash", "k")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a table, so that the join is a plain one, which adaptive execution splits at a hot window
    first = Stage(docs.sparkSession).write(first, "first")
    later = windows.join(first, ["w1", "w2"]).filter(place > F.col("first"))
    hits = later.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("k", "s", "e"))).alias("p"))
    runs = f"""arrays_zip(
        transform(filter(p, (x, j) -> j = 0 OR x.k - get(p, j - 1).k > {WINDOW}), x -> x.s) AS s,
        transform(filter(p, (x, j) -> j = size(p) - 1 OR get(p, j + 1).k - x.k > {WINDOW}), x -> x.e) AS e)"""
    runs = runs.replace(" AS s", "").replace(" AS e", "")
    return hits.select(*_KEY, F.expr(runs).cast("array<struct<s:int,e:int>>").alias("runs"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced, and n_lines, n_removed, n_spans added.

    Null text: stays null, no lines. Empty text or under three lines with content: unchanged. Lines are compared without
    blanks at their ends. Repeated rows (same doc_id and text) are one document and get the same result; a null doc_id
    comes first in order. Empty table: no rows. Other columns pass through untouched, whatever their names; columns that
    are called like an added one are replaced."""
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed", "n_spans")]
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in others)).alias("_row"), F.col("doc_id"), F.col("text"))
    keyed = _keyed(packed.select("_row", "doc_id", F.col("text").cast("string").alias("text")))
    hits = covered_lines(docs.select("doc_id", "text"))
    hits = hits.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "runs")
    joined = keyed.join(hits, keyed["_id"].eqNullSafe(hits["_id2"]) & (keyed["_hash"] == hits["_hash2"]), "left")
    lines = F.split("text", "\n", -1)
    cut = F.expr("""array_join(flatten(transform(
        arrays_zip(concat(array(0), transform(runs, r -> r.e + 1)), concat(transform(runs, r -> r.s), array(size(_lines)))),
        z -> slice(_lines, z.`0` + 1, greatest(z.`1` - z.`0`, 0)))), '\n')""")
    removed = F.expr("aggregate(runs, 0, (a, r) -> a + r.e - r.s + 1)")
    out = joined.withColumn("_lines", lines)
    return out.select(
        *(F.col("_row")[c].alias(c) for c in others),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(cut).alias("text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs)


OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
    FROM documents, range(1, len(string_split(text, chr(10))) + 1) AS t(i)
), full_lines AS (
    SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
           row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
    SELECT a.doc_id, a.k, a.pos AS s, c.pos AS e, a.line AS l1, b.line AS l2, c.line AS l3
    FROM full_lines a JOIN full_lines b ON b.doc_id = a.doc_id AND b.k = a.k + 1
                      JOIN full_lines c ON c.doc_id = a.doc_id AND c.k = a.k + 2
), later AS (
    SELECT doc_id, s, e FROM windows
    QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, k) > 1
), gone AS (
    SELECT DISTINCT doc_id, pos FROM later, range(s, e + 1) AS t(pos)
), marked AS (
    SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS out
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
), with_blank AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(13)) <> '' AS full_line FROM marked
), edges AS (
    SELECT *, lag(out) OVER (PARTITION BY doc_id, full_line ORDER BY pos) AS before FROM with_blank
)
SELECT d.doc_id,
       coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (NOT e.out), '') AS text,
       count(e.pos)::BIGINT AS n_lines,
       count(e.pos) FILTER (e.out)::BIGINT AS n_removed,
       count(e.pos) FILTER (e.out AND e.full_line AND NOT coalesce(e.before, false))::BIGINT AS n_spans
FROM documents d LEFT JOIN edges e ON e.doc_id = d.doc_id
GROUP BY d.doc_id
"""
