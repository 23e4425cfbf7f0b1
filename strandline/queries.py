"""Queries over the driver's tables, and the same in SQL written from the semantics alone."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as sq
from strandline.operators import consensus, distance, edit_graph, etl, evaluation, kmers, overlaps, placement
from strandline.plans.correction import Options, correct, derived, hamming_overlaps, overlaps_index, stranded
from strandline.sources import fastx, tables
from strandline.sources.staging import Stage
from strandline.streaming import reads as streams

K = 9
OPTIONS = Options(kmer=K)
SLOTS = 5
RESULTS = 30

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FIXTURES = r"""WITH RECURSIVE
reads AS (SELECT doc_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents),
reads_q AS (SELECT read_id, '@d' || read_id || ' len=0' AS info, seq,
    array_to_string([chr((33 + (read_id * 31 + i * 7) % 41)::INT) for i in range(1, length(seq) + 1)], '') AS qual FROM reads WHERE length(seq) >= 1),
contigs AS (SELECT item_id AS contig_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM benchmark),
genome AS (SELECT string_agg(seq, '' ORDER BY contig_id) AS g FROM contigs),
tiled0 AS (SELECT i AS read_id, i * 4 AS start0, substr(g, (i * 4 + 1)::INT, 80) AS truth FROM genome, range(0, (length(g) - 80) // 4 + 1) AS t(i)),
tiled AS (SELECT *, CASE WHEN read_id % 3 = 0 THEN substr(truth, 1, ((read_id * 37) % 80)::INT)
    || translate(substr(truth, ((read_id * 37) % 80)::INT + 1, 1), 'ACGT', 'CGTA') || substr(truth, ((read_id * 37) % 80)::INT + 2) ELSE truth END AS seq FROM tiled0),
mutated AS (SELECT *, CASE read_id % 3 WHEN 1 THEN substr(truth, 1, ((read_id * 13) % 70 + 5)::INT) || substr(truth, ((read_id * 13) % 70 + 7)::INT)
    WHEN 2 THEN substr(truth, 1, ((read_id * 13) % 70 + 5)::INT) || substr('ACGT', (read_id % 4 + 1)::INT, 1) || substr(truth, ((read_id * 13) % 70 + 6)::INT) ELSE truth END AS other FROM tiled),
pairs AS (SELECT conv_id * 1000 + turn AS read_id, concat('@c', conv_id, '_', turn // 2, '/', turn % 2 + 1) AS info,
    regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM conversations),
both_strands AS (SELECT read_id, '+' AS strand, seq FROM tiled UNION ALL SELECT read_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM tiled),
index9 AS (SELECT read_id, strand, p AS pos, substr(seq, p + 1, 9) AS kmer,
    lpad(substr(seq, greatest(p - 9, 0) + 1, least(p, 9)), 9, 'A') AS left_ctx, rpad(substr(seq, p + 10, 9), 9, 'A') AS right_ctx
    FROM (SELECT *, unnest(range(0, length(seq) - 8))::INT AS p FROM both_strands)),
sized AS (SELECT read_id, seq, length(seq) AS n, CASE WHEN length(seq) >= 27 THEN 3 WHEN length(seq) >= 18 THEN 2 END AS parts FROM tiled),
counted AS (SELECT *, ceil((n - 9) / (parts * 9 - 9)::DOUBLE)::INT AS m FROM sized WHERE parts IS NOT NULL),
windows AS (SELECT read_id, 0 AS win, 0 AS start, parts, n, m FROM counted
    UNION ALL SELECT read_id, win + 1, (start + parts * 9 - (m * parts * 9 - n + win) // (m - 1))::INT, parts, n, m FROM windows WHERE win + 1 < m),
parted AS (SELECT w.read_id, win, start, parts, substr(seq, start + 1, 9) AS p1, substr(seq, start + 10, 9) AS p2,
    CASE WHEN parts = 3 THEN substr(seq, start + 19, 9) END AS p3 FROM windows w JOIN tiled t USING (read_id)),
matched AS (SELECT p.read_id, win, i.read_id AS cand_id, i.strand AS cand_strand, 'R' AS side, i.pos AS ref_pos,
        start + CASE WHEN parts = 3 THEN 9 ELSE 0 END AS query_pos, hamming(CASE WHEN parts = 3 THEN p3 ELSE p2 END, right_ctx)::INT AS errors, right_ctx AS neighbour, NULL::INT AS both_sides
    FROM parted p JOIN index9 i ON i.kmer = CASE WHEN parts = 3 THEN p2 ELSE p1 END
    UNION ALL SELECT p.read_id, win, i.read_id, i.strand, 'L', i.pos - 9, start, hamming(p1, left_ctx)::INT, left_ctx, CASE WHEN parts = 3 AND greatest(hamming(p1, left_ctx), hamming(p3, right_ctx)) <= 2 THEN greatest(hamming(p1, left_ctx), hamming(p3, right_ctx)) END::INT
    FROM parted p JOIN index9 i ON i.kmer = p2 WHERE i.pos >= 9
    UNION ALL SELECT p.read_id, win, i.read_id, i.strand, 'R', i.pos, start, hamming(p2, right_ctx)::INT, right_ctx, NULL
    FROM parted p JOIN index9 i ON i.kmer = p1 WHERE parts = 3 AND p2 <> right_ctx
    UNION ALL SELECT p.read_id, win, i.read_id, i.strand, 'L', i.pos - 9, start + 9, hamming(p2, left_ctx)::INT, left_ctx, NULL
    FROM parted p JOIN index9 i ON i.kmer = p3 WHERE parts = 3 AND i.pos >= 9 AND p2 <> left_ctx),
seeds AS MATERIALIZED (SELECT * FROM matched WHERE errors <= 2),
capped AS MATERIALIZED (SELECT * EXCLUDE (neighbour) FROM seeds
    QUALIFY row_number() OVER (PARTITION BY read_id, win, side, query_pos, neighbour ORDER BY cand_id, cand_strand, ref_pos) <= 30),
levels AS (SELECT read_id, win, CASE WHEN count(*) FILTER (errors = 0) >= 30 THEN 0 WHEN count(*) FILTER (errors <= 1) >= 30 THEN 1 ELSE 2 END AS level FROM capped GROUP BY ALL),
whole_ones AS (SELECT read_id, win, count(*) AS n FROM capped JOIN levels USING (read_id, win) WHERE both_sides <= level GROUP BY ALL),
escalated AS MATERIALIZED (SELECT s.* EXCLUDE (both_sides), level FROM capped s JOIN levels USING (read_id, win) LEFT JOIN whole_ones USING (read_id, win)
    WHERE CASE WHEN n >= 30 THEN both_sides <= level ELSE errors <= level END),
cands0 AS (SELECT e.read_id, cand_id, cand_strand, min(query_pos - ref_pos)::INT AS shift1, max(query_pos - ref_pos)::INT AS shift2, max(length(t.seq)) AS na, max(length(b.seq)) AS nb
    FROM escalated e JOIN tiled t ON t.read_id = e.read_id JOIN both_strands b ON b.read_id = cand_id AND b.strand = cand_strand
    WHERE length(b.seq) - ref_pos >= greatest(35, floor(0.2 * length(t.seq))) GROUP BY ALL),
cands AS MATERIALIZED (SELECT read_id, cand_id, cand_strand, shift1, shift2,
    (CASE WHEN shift1 > 0 THEN least(na - shift1, nb) WHEN shift2 < 0 THEN least(nb + shift2, na) ELSE least(na, nb) END)::INT AS max_overlap FROM cands0),
others AS (SELECT * FROM cands WHERE NOT (cand_id = read_id AND cand_strand = '+')),
shifted AS MATERIALIZED (SELECT read_id, cand_id, cand_strand, shift, max_overlap, na, length(a) AS overlap, hamming(a, b)::INT AS errors FROM (
    SELECT o.read_id, cand_id, cand_strand, s AS shift, max_overlap, length(t.seq) AS na,
        substr(t.seq, greatest(s, 0) + 1, least(length(t.seq), length(b.seq) + s) - greatest(s, 0)) AS a,
        substr(b.seq, greatest(s, 0) - s + 1, least(length(t.seq), length(b.seq) + s) - greatest(s, 0)) AS b
    FROM others o JOIN tiled t USING (read_id) JOIN both_strands b ON b.read_id = cand_id AND b.strand = cand_strand, range(shift1, shift2 + 1) AS r(s)
    WHERE least(length(t.seq), length(b.seq) + s) > greatest(s, 0))),
accepted AS (SELECT *, floor(0.25 * overlap)::INT AS allowed FROM shifted
    WHERE overlap - errors >= greatest(35, floor(0.2 * na)) AND errors <= floor(0.25 * overlap) AND errors <= floor(0.25 * max_overlap)),
fewest AS (SELECT read_id, cand_id, cand_strand, min(errors) AS errors FROM accepted GROUP BY ALL),
weighed AS (SELECT a.*, CASE WHEN allowed <= 0 THEN 1 ELSE 1 - sqrt(a.errors / allowed::DOUBLE) END AS w FROM accepted a JOIN fewest USING (read_id, cand_id, cand_strand, errors)),
best AS MATERIALIZED (SELECT read_id, cand_id, cand_strand, shift, overlap, errors, allowed, max_overlap,
    max(w) OVER p / count(*) OVER p AS weight FROM weighed WINDOW p AS (PARTITION BY read_id, cand_id, cand_strand)),
ballots AS (SELECT read_id, i - 1 AS pos, seq[i] AS base, 1.0::DOUBLE AS w FROM tiled, range(1, length(seq) + 1) AS r(i)
    UNION ALL SELECT x.read_id, i, b.seq[i - shift + 1], weight FROM best x JOIN both_strands b ON b.read_id = cand_id AND b.strand = cand_strand, range(greatest(shift, 0), greatest(shift, 0) + overlap) AS r(i)),
votes AS MATERIALIZED (SELECT read_id, pos::INT AS pos, base, sum(w) AS w FROM ballots GROUP BY ALL),
called AS (SELECT v.read_id, v.pos, max_by(v.base, round(v.w, 9) - strpos('ATCG', v.base) / 1e12) AS best_base, max(round(v.w, 9)) AS best_w,
    max(t.seq[v.pos + 1]) AS own, max(CASE WHEN v.base = t.seq[v.pos + 1] THEN round(v.w, 9) END) AS own_w FROM votes v JOIN tiled t USING (read_id) GROUP BY ALL),
fixed AS MATERIALIZED (SELECT read_id, string_agg(CASE WHEN own_w >= 100 OR own_w >= best_w THEN own ELSE best_base END, '' ORDER BY pos) AS seq FROM called GROUP BY read_id),
ref_strands AS (SELECT '+' AS strand, g FROM genome UNION ALL SELECT '-', reverse(translate(g, 'ACGT', 'TGCA')) FROM genome),
ref_places AS MATERIALIZED (SELECT strand, i::INT AS start, substr(g, i::INT + 1, 80) AS there FROM ref_strands, range(0, length(g) - 79) AS r(i)),
near_places AS MATERIALIZED (SELECT read_id, hamming(seq, there)::INT AS edit, strand, start FROM tiled, ref_places WHERE hamming(seq, there) <= 2),
judged AS (SELECT read_id, levenshtein(t.seq, truth)::INT AS e1, levenshtein(f.seq, truth)::INT AS e2, levenshtein(t.seq, f.seq)::INT AS opers, length(t.seq)::INT AS n FROM tiled t JOIN fixed f USING (read_id)),
classed AS (SELECT *, CASE WHEN e1 = 0 AND e2 = 0 THEN 'TN' WHEN e2 = 0 THEN 'TP' WHEN e1 = 0 THEN 'FP' ELSE 'FN' END AS cls FROM judged)
"""


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = FIXTURES + sql
        return f

    return put


def _tiled(spark: SparkSession, d: str) -> DataFrame:
    """The reads as a table, for plans that read them at many places."""
    return Stage(spark).write(tables.tiled(spark, d).select("read_id", "seq"), "tiled")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reads = _tiled(spark, d)
    return reads, stranded(reads, OPTIONS)


# scalar functions and conversion


@query("SELECT * FROM reads")
def seq_normalize(spark: SparkSession, d: str) -> DataFrame:
    return tables.reads(spark, d)


@query("SELECT doc_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents")
def seq_normalize_n(spark: SparkSession, d: str) -> DataFrame:
    return tables.reads(spark, d, "N")


@query("SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def seq_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return tables.reads(spark, d).select("read_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT read_id, '+' AS strand, seq, qual FROM reads_q UNION ALL SELECT read_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')), reverse(qual) FROM reads_q")
def seq_strands(spark: SparkSession, d: str) -> DataFrame:
    return kmers.strands(tables.quality_reads(spark, d).drop("info"))


@query("SELECT read_id, '>' || substr(info, 2) AS info, array_to_string([(read_id * 31 + i * 7) % 41 for i in range(1, length(seq) + 1)], ' ') AS qual_text FROM reads_q")
def qual_decode(spark: SparkSession, d: str) -> DataFrame:
    return etl.quality_text(tables.quality_reads(spark, d))


@query("""SELECT read_id, round(list_sum([CASE WHEN q = 0 THEN 0.9 ELSE 10 ** (-q / 10.0) END for q in [(read_id * 31 + i * 7) % 41 for i in range(1, length(seq) + 1)]]), 4) AS expected_errors FROM reads_q""")
def qual_error_prob(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.quality_reads(spark, d).select("read_id", sq.quality_ordinals(F.col("qual")).alias("q"))
    return rows.select("read_id", F.round(F.aggregate("q", F.lit(0.0), lambda s, x: s + 1 - sq.right_probability(x)), 4).alias("expected_errors"))


@query("SELECT count(*) AS n_reads, sum(length(seq))::BIGINT AS total, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest, (sum(length(seq)) // count(*))::BIGINT AS mean_length FROM reads")
def read_stats(spark: SparkSession, d: str) -> DataFrame:
    return etl.statistics(tables.reads(spark, d))


@query("SELECT (2 * sum(greatest(length(seq) - 8, 0)))::BIGINT AS num_kmers, (1 + 2 * sum(length(seq) + 1))::BIGINT AS total_size, 2 * count(*) AS n_reads FROM reads")
def kmer_totals(spark: SparkSession, d: str) -> DataFrame:
    return kmers.totals(tables.reads(spark, d), K)


@query("""SELECT kmer, list_sum([(strpos('ATCG', kmer[i]) - 1) * 4 ** (i - 1) for i in range(1, 10)])::BIGINT AS code, kmer AS decoded FROM (SELECT DISTINCT kmer FROM index9)""")
def kmer_decode(spark: SparkSession, d: str) -> DataFrame:
    _, both = _both(spark, d)
    codes = kmers.explode_kmers(both, K).select("kmer").distinct().withColumn("code", sq.kmer_code(F.col("kmer")))
    return codes.withColumn("decoded", sq.kmer_text(F.col("code"), K))


@query("""SELECT read_id, qual AS same, array_to_string([chr((33 + least((read_id * 31 + i * 7) % 41 + 60, 93))::INT) for i in range(1, length(seq) + 1)], '') AS raised FROM reads_q""")
def qual_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.quality_reads(spark, d).select("read_id", sq.quality_ordinals(F.col("qual")).alias("q"))
    return rows.select("read_id", sq.ordinals_quality(F.col("q")).alias("same"), sq.ordinals_quality(F.transform("q", lambda x: x + 60)).alias("raised"))


@query("""
, cut AS (SELECT read_id, length(seq) AS n, (read_id % 7 + 1)::INT AS parts FROM reads WHERE length(seq) >= 7),
part AS (SELECT *, unnest(range(parts)) AS i, n // parts AS base, n % parts AS rest, parts // 2 AS middle FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY abs(i - middle), i) - 1 AS near FROM part)
SELECT read_id, i::INT AS i, base + (i >= parts - rest)::INT AS small_first, base + (i < rest)::INT AS large_first, base + (near < rest)::INT AS small_ends, base + (near >= parts - rest)::INT AS large_ends FROM ranked""")
def pattern_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.reads(spark, d).filter(F.length("seq") >= 7).select("read_id", F.length("seq").alias("n"), F.expr("cast(read_id % 7 + 1 as int)").alias("parts"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("read_id", "i", *(sq.part_size(F.col("n"), F.col("parts"), F.col("i"), p).alias(p) for p in ("small_first", "large_first", "small_ends", "large_ends")))


@query("""
, t AS (SELECT sum(length(seq)) // count(*) AS mean, 2 * sum(greatest(length(seq) - 8, 0)) AS n FROM reads),
o AS (SELECT *, 9 + len([j for j in range(9, 14) if 4 ** j * 20 <= n]) AS kmer FROM t)
SELECT kmer::INT AS kmer, least(35, (0.7 * mean)::INT)::INT AS min_overlap, 4.2::DOUBLE AS reserve, 2.1::DOUBLE AS reserve_diploid, 30 AS max_kmer_results, (2000000000 // mean)::BIGINT AS max_length_matches FROM o""")
def derived_parameters(spark: SparkSession, d: str) -> DataFrame:
    reads = tables.reads(spark, d)
    t = kmers.totals(reads, K).crossJoin(etl.statistics(reads).select("mean_length")).first()  # one row each
    o, two = (derived(Options(diploid=x), t["mean_length"], t["num_kmers"], 3.0, 20) for x in (False, True))
    return spark.createDataFrame([(o.kmer, o.min_overlap, o.reserve, two.reserve, o.max_kmer_results, o.max_length_matches)], "kmer int, min_overlap int, reserve double, reserve_diploid double, max_kmer_results int, max_length_matches long")


# k-mers


@query("SELECT read_id, p::INT AS pos, substr(seq, p::INT + 1, 9) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 8)) AS p FROM tiled)")
def kmer_table_function(spark: SparkSession, d: str) -> DataFrame:
    kmers.register(spark)
    return spark.sql("SELECT read_id, x.pos, x.kmer FROM {reads}, LATERAL kmers(seq, 9) AS x", reads=_tiled(spark, d))


@query("SELECT kmer, count(*) AS n FROM (SELECT unnest([substr(seq, i, 12) for i in range(1, length(seq) - 10)]) AS kmer FROM tiled) GROUP BY kmer")
def stream_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """The reads as a stream of three files, counted batch by batch; the last table of counts."""
    stage = Stage(spark)
    stage.write(_tiled(spark, d).repartition(3, "read_id"), "reads")

    def keep(counts: DataFrame, _: int) -> None:
        stage.write(counts, "counts")

    counts = streams.running_kmer_counts(streams.read_stream(spark, f"{stage.root}/reads"), 12)
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{stage.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{stage.root}/counts")


@query("SELECT n.read_id, n.edit, strand, start FROM near_places n JOIN (SELECT read_id, min(edit) AS edit FROM near_places GROUP BY read_id) USING (read_id, edit)")
def stream_placement(spark: SparkSession, d: str) -> DataFrame:
    """The reads as a stream of three files, each batch placed alone and written under its number."""
    stage = Stage(spark)
    stage.write(_tiled(spark, d).repartition(3, "read_id"), "reads")
    place = streams.place_batches(tables.genome(spark, d), 2, 26, lambda placed, batch: stage.write(placed, f"placed/batch={batch}"))
    stream = streams.read_stream(spark, f"{stage.root}/reads")
    stream.writeStream.foreachBatch(place).option("checkpointLocation", f"{stage.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{stage.root}/placed").drop("batch")


@query("SELECT kmer, count(*) AS n, count(DISTINCT read_id) AS n_reads FROM (SELECT read_id, unnest([substr(seq, i, 12) for i in range(1, length(seq) - 10)]) AS kmer FROM reads) GROUP BY kmer")
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_counts(tables.reads(spark, d), 12)


@query("SELECT *, list_sum([(strpos('ATCG', kmer[i]) - 1) * 4 ** (i - 1) for i in range(1, 10)])::BIGINT AS code FROM index9")
def kmer_context(spark: SparkSession, d: str) -> DataFrame:
    _, both = _both(spark, d)
    return kmers.explode_kmers(both, K, K).withColumn("code", sq.kmer_code(F.col("kmer")))


@query(f"SELECT * FROM index9 QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY read_id, strand, pos) <= {SLOTS}")
def kmer_slot_cap(spark: SparkSession, d: str) -> DataFrame:
    _, both = _both(spark, d)
    return kmers.slot_cap(kmers.explode_kmers(both, K, K), SLOTS)


@query("""
, st AS (SELECT seq FROM reads UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads),
k10 AS (SELECT kmer, count(*) AS c, list_sum([(strpos('ATCG', kmer[i]) - 1) * 4 ** (i - 1) for i in range(1, 11)])::BIGINT AS code
    FROM (SELECT unnest([substr(seq, i, 10) for i in range(1, length(seq) - 8)]) AS kmer FROM st) GROUP BY kmer),
ranked AS (SELECT i AS code, row_number() OVER (ORDER BY coalesce(c, 0), i) - 1 AS r FROM range(0, 1048576) AS t(i) LEFT JOIN k10 ON code = i),
chosen AS (SELECT kmer FROM k10 JOIN ranked USING (code) WHERE r >= 523788 AND r < 524788),
ext AS (SELECT e, count(*) AS c FROM (SELECT unnest([substr(seq, i, 17) for i in range(1, length(seq) - 15)]) AS e FROM st) WHERE substr(e, 1, 10) IN (SELECT kmer FROM chosen) GROUP BY e)
SELECT count(*) AS n_extended, round(avg(c) FILTER (c > 5), 6) AS coverage FROM ext""")
def kmer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return kmers.coverage(spark, tables.reads(spark, d))


# files of reads


@query("SELECT 0 AS file_id, read_id, info, seq FROM reads_q UNION ALL SELECT 1, read_id, info, seq FROM pairs")
def merge_concat(spark: SparkSession, d: str) -> DataFrame:
    return etl.concat_files([tables.quality_reads(spark, d).drop("qual"), tables.pairs(spark, d)])


@query("SELECT first(info ORDER BY read_id) AS info, string_agg(seq, '' ORDER BY read_id) AS seq FROM pairs")
def merge_oneseq(spark: SparkSession, d: str) -> DataFrame:
    return etl.one_sequence(tables.pairs(spark, d), ["read_id"])


@query("SELECT file_id, read_id, j AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY file_id, read_id) - 1 AS j FROM (SELECT 0 AS file_id, read_id FROM reads_q UNION ALL SELECT 1, read_id FROM pairs)) WHERE j * 250 // 1000 < (j * 250 + 250) // 1000")
def merge_sample(spark: SparkSession, d: str) -> DataFrame:
    both = merge_concat(spark, d).select("file_id", "read_id")
    return etl.systematic_sample(etl.running_ordinal(both, ["file_id", "read_id"]), 250)


def _numbered(df: DataFrame) -> DataFrame:
    return etl.running_ordinal(df, ["read_id", "place"]).withColumn("read_id", F.col("ordinal").cast("long")).drop("ordinal", "place")


_SIDES = "a AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, info, seq FROM reads_q), b AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, info, seq FROM pairs)"


@query(f", {_SIDES} SELECT read_id, 1 AS side, info, seq FROM a UNION ALL SELECT read_id, 2, info, seq FROM b")
def merge_interleave(spark: SparkSession, d: str) -> DataFrame:
    return etl.interleave(_numbered(tables.quality_reads(spark, d, placed=True).drop("qual")), _numbered(tables.pairs(spark, d, placed=True)))


@query("SELECT read_id, info, seq, (row_number() OVER (ORDER BY read_id) - 1) AS ordinal, ((row_number() OVER (ORDER BY read_id) - 1) % 2 + 1)::INT AS side FROM pairs")
def split_pairs(spark: SparkSession, d: str) -> DataFrame:
    return etl.split_pairs(etl.running_ordinal(tables.pairs(spark, d, placed=True), ["read_id", "place"]).drop("place"))


@query("""
, named AS (SELECT read_id, info, seq, regexp_replace(split_part(info, ' ', 1), '(/1|/2|_left|_right)$', '') AS id FROM pairs),
marked AS (SELECT *, CASE WHEN lag(id) OVER (ORDER BY read_id) = id THEN 0 ELSE 1 END AS new FROM named),
runs AS (SELECT *, sum(new) OVER (ORDER BY read_id) AS run FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY read_id) AS k, count(*) OVER (PARTITION BY run) AS n FROM runs)
SELECT read_id, info, seq, CASE WHEN k <= n // 2 * 2 THEN 'pair' ELSE 'frag' END AS part FROM placed""")
def split_paired(spark: SparkSession, d: str) -> DataFrame:
    return etl.split_paired(tables.pairs(spark, d))


@query("""
, o AS (SELECT substr(info, 2) AS name, row_number() OVER (ORDER BY read_id) - 1 AS j FROM pairs)
SELECT a.j // 2 AS pair, a.name AS id_a, b.name AS id_b FROM o a LEFT JOIN o b ON b.j = a.j + 1 WHERE a.j % 2 = 0""")
def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    return etl.pair_ids(etl.running_ordinal(tables.pairs(spark, d), ["read_id"]))


@query("SELECT read_id, info, seq, qual FROM reads_q")
def fasta_qual_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.quality_reads(spark, d)
    return etl.zip_quality(etl.to_fasta(rows), etl.quality_text(rows))


@query("SELECT read_id, '@d' || read_id || ' len=' || length(seq) AS info, seq, qual FROM reads_q")
def replace_info(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.quality_reads(spark, d)
    return etl.replace_headers(rows, rows.drop("info"))


@query("""SELECT read_id, src, info, seq, key FROM (SELECT read_id, 'a' AS src, '@r x y ' || read_id AS info, seq, read_id AS key FROM tiled WHERE read_id % 2 = 0
    UNION ALL SELECT read_id, 'b', '@r x y ' || (read_id // 2 * 2), seq, read_id // 2 * 2 FROM tiled WHERE read_id % 2 = 1)""")
def hshrec_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.tiled(spark, d).select("read_id", F.concat(F.lit("@r x y "), F.expr("read_id div 2 * 2").cast("string")).alias("info"), "seq")
    return etl.merge_numbered(rows.filter("read_id % 2 = 0"), rows.filter("read_id % 2 = 1"))


@query("SELECT read_id, info, seq FROM reads_q")
def quake_restore(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.quality_reads(spark, d).drop("qual")
    return etl.restore_order(rows, rows.filter("read_id % 3 = 0"), rows.filter("read_id % 3 <> 0"))


@query("SELECT read_id, '>' || substr(info, 2) AS info, seq FROM reads_q")
def to_fasta(spark: SparkSession, d: str) -> DataFrame:
    return etl.to_fasta(tables.quality_reads(spark, d))


@query("SELECT read_id, info, seq, '+' AS qual_info, repeat('I', length(seq)) AS qual FROM pairs")
def to_fastq(spark: SparkSession, d: str) -> DataFrame:
    return etl.to_fastq(tables.pairs(spark, d))


@query("SELECT read_id, info, seq, CASE WHEN qual[1] = '@' THEN 'A' || substr(qual, 2) ELSE qual END AS qual FROM reads_q")
def adjust_qual(spark: SparkSession, d: str) -> DataFrame:
    return etl.adjust_quality(tables.quality_reads(spark, d))


@query("SELECT read_id, info, seq, '+' AS qual_info, qual FROM reads_q")
def bare_qual_info(spark: SparkSession, d: str) -> DataFrame:
    return etl.bare_quality_header(tables.quality_reads(spark, d).withColumn("qual_info", F.col("info")))


@query("SELECT info || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM reads_q")
def fastq_text(spark: SparkSession, d: str) -> DataFrame:
    return fastx.record_text(tables.quality_reads(spark, d))


def _files(spark: SparkSession, records: DataFrame) -> str:
    """The records as text files of a folder."""
    path = f"{Stage(spark).root}/files"
    fastx.record_text(records).write.text(path)
    return path


@query("SELECT info, seq, '+' AS qual_info, qual FROM reads_q")
def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _files(spark, tables.quality_reads(spark, d))
    return fastx.read_fastx(spark, path).select("info", "seq", "qual_info", "qual")


@query("SELECT '>' || substr(info, 2) AS info, seq FROM reads_q")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences over lines of 60 bases."""
    rows = etl.to_fasta(tables.quality_reads(spark, d)).withColumn("seq", F.regexp_replace("seq", "(.{60})", "$1\n"))
    return fastx.read_fastx(spark, _files(spark, rows)).select("info", "seq")


@query("SELECT '>' || substr(info, 2) AS info, array_to_string([(read_id * 31 + i * 7) % 41 for i in range(1, length(seq) + 1)], ' ') AS qual_text FROM reads_q")
def qual_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Numbers over lines of 20."""
    rows = etl.quality_text(tables.quality_reads(spark, d)).select("info", F.regexp_replace("qual_text", "((?:[0-9]+ ){20})", "$1\n").alias("seq"))
    return fastx.read_quality(spark, _files(spark, rows)).select("info", F.regexp_replace("qual_text", " +", " ").alias("qual_text"))


@query("SELECT g, length(g)::BIGINT AS n FROM genome")
def genome_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The reference written as one FASTA file of short lines and read as stretches."""
    stage = Stage(spark)
    text = tables.genome(spark, d).select(F.concat(F.lit(">g\n"), F.regexp_replace("g", "(.{61})", "$1\n")).alias("value"))
    text.coalesce(1).write.text(f"{stage.root}/genome")
    parts = fastx.read_genome(spark, f"{stage.root}/genome")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda x: x["g"]), "")
    return parts.agg(ordered.alias("g"), F.max(F.col("at") + F.length("g")).alias("n"))


# overlaps


@query("SELECT read_id, win, start, parts FROM windows")
def query_windows(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.query_windows(_tiled(spark, d), K)


def _seeds(spark: SparkSession, d: str, errors: int, neighbours: bool = False) -> DataFrame:
    reads, both = _both(spark, d)
    return overlaps.seeds(overlaps.window_parts(reads, K), overlaps_index(both, OPTIONS), K, errors, neighbours=neighbours)


@query("""
, short0 AS (SELECT i AS read_id, substr(g, (i * 4 + 1)::INT, 20) AS truth FROM genome, range(0, (length(g) - 20) // 4 + 1) AS t(i)),
short AS (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN substr(truth, 1, ((read_id * 37) % 20)::INT) || translate(substr(truth, ((read_id * 37) % 20)::INT + 1, 1), 'ACGT', 'CGTA')
    || substr(truth, ((read_id * 37) % 20)::INT + 2) ELSE truth END AS seq FROM short0),
halves AS (SELECT read_id, w::INT AS win, (w * 2)::INT AS start, substr(seq, (w * 2 + 1)::INT, 9) AS p1, substr(seq, (w * 2 + 10)::INT, 9) AS p2 FROM short, range(0, 2) AS t(w))
SELECT p.read_id, win, i.read_id AS cand_id, i.strand AS cand_strand, 'R' AS side, i.pos AS ref_pos, start AS query_pos, 0 AS errors FROM halves p JOIN index9 i ON i.kmer = p1 AND i.right_ctx = p2
UNION ALL SELECT p.read_id, win, i.read_id, i.strand, 'L', i.pos - 9, start, 0 FROM halves p JOIN index9 i ON i.kmer = p2 AND i.left_ctx = p1 WHERE i.pos >= 9""")
def seed_exact2(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads of 20 bases, which have windows of two k-mers."""
    _, both = _both(spark, d)
    short = tables.tiled(spark, d, 20).select("read_id", "seq")
    return overlaps.seeds(overlaps.window_parts(short, K), overlaps_index(both, OPTIONS), K, 0)


@query("SELECT * EXCLUDE (neighbour, both_sides) FROM matched WHERE errors = 0")
def seed_exact3(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d, 0)


@query("SELECT * EXCLUDE (neighbour, both_sides) FROM seeds")
def seed_fuzzy_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d, 2)


@query(f"SELECT * EXCLUDE (neighbour, both_sides) FROM seeds QUALIFY row_number() OVER (PARTITION BY read_id, win, side, query_pos, neighbour ORDER BY cand_id, cand_strand, ref_pos) <= {SLOTS}")
def seed_neighbour_cap(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cap_neighbours(_seeds(spark, d, 2, neighbours=True), SLOTS).drop("both")


@query("SELECT * FROM escalated")
def seed_escalation(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.escalate(overlaps.cap_neighbours(_seeds(spark, d, 2, neighbours=True), RESULTS), 2, RESULTS)


def _cands(spark: SparkSession, d: str) -> DataFrame:
    reads, both = _both(spark, d)
    return overlaps.candidates(seed_escalation(spark, d), reads, both, 35, 0.2)


@query("SELECT * FROM cands")
def overlap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _cands(spark, d)


@query("SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY max_overlap DESC, cand_id, cand_strand) <= 10")
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cap_candidates(_cands(spark, d), 10)


@query("SELECT * FROM others")
def self_match_removal(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.without_self(_cands(spark, d))


@query("SELECT read_id, cand_id, cand_strand, shift::INT AS shift, overlap::INT AS overlap, errors, max_overlap, allowed FROM accepted")
def overlap_accept(spark: SparkSession, d: str) -> DataFrame:
    reads, both = _both(spark, d)
    return consensus.accept(consensus.shifted_overlaps(self_match_removal(spark, d), reads, both), 35, 0.2, 0.25)


@query("SELECT read_id, cand_id, cand_strand, shift::INT AS shift, overlap::INT AS overlap, errors, max_overlap, allowed, round(weight, 6) AS weight FROM best")
def hamming_best_shift(spark: SparkSession, d: str) -> DataFrame:
    return consensus.best_shifts(overlap_accept(spark, d)).withColumn("weight", F.round("weight", 6))


@query("SELECT read_id, pos, base, round(w, 6) AS w FROM votes")
def hamming_votes(spark: SparkSession, d: str) -> DataFrame:
    reads, both = _both(spark, d)
    return consensus.votes(hamming_overlaps(reads, both, OPTIONS), reads, both).withColumn("w", F.round("w", 6))


@query("SELECT read_id, pos, CASE WHEN own_w >= 100 OR own_w >= best_w THEN own ELSE best_base END AS base FROM called")
def hamming_consensus(spark: SparkSession, d: str) -> DataFrame:
    reads, both = _both(spark, d)
    return consensus.call_bases(consensus.votes(hamming_overlaps(reads, both, OPTIONS), reads, both), reads).select("read_id", "pos", "base")


@query("SELECT * FROM fixed")
def correct_hamming(spark: SparkSession, d: str) -> DataFrame:
    return correct(_tiled(spark, d), OPTIONS)


@query()
def correct_edit(spark: SparkSession, d: str) -> DataFrame:
    return correct(_tiled(spark, d), Options(kmer=K, match="edit"))


@query("""
, weighed_bases AS (SELECT read_id, list(base ORDER BY pos) AS bases, list(w ORDER BY pos) AS ws FROM (SELECT read_id, pos,
    CASE WHEN own_w >= 100 OR own_w >= best_w THEN own ELSE best_base END AS base, CASE WHEN own_w >= 100 OR own_w >= best_w THEN own_w ELSE best_w END AS w FROM called) GROUP BY read_id),
cuts AS (SELECT read_id, ws, 0 AS a, len(ws) AS b, 0 AS step FROM weighed_bases
    UNION ALL SELECT read_id, ws, CASE WHEN p + 1 - a < b - p THEN p + 1 ELSE a END, CASE WHEN p + 1 - a < b - p THEN b ELSE p END, step + 1
    FROM (SELECT *, list_min([i for i in range(a, b) if ws[i + 1] <= 2.5]) AS p FROM cuts WHERE b - a > 2) WHERE p IS NOT NULL),
kept AS (SELECT read_id, arg_max(a, step)::INT AS a, arg_max(b, step)::INT AS b FROM cuts GROUP BY read_id)
SELECT read_id, array_to_string(bases[a + 1:b], '') AS seq, a AS start, (len(bases) - (b - a))::INT AS trimmed FROM weighed_bases JOIN kept USING (read_id)""")
def trim_path(spark: SparkSession, d: str) -> DataFrame:
    reads, both = _both(spark, d)
    voted = consensus.votes(hamming_overlaps(reads, both, OPTIONS), reads, both)
    return consensus.trim(consensus.assemble(consensus.call_bases(voted, reads), reads), 2.5).drop("weights")


# distances


@query("SELECT read_id, levenshtein(seq, truth)::INT AS edit, levenshtein(seq, reverse(truth))::INT AS edit_reversed FROM tiled")
def edit_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.tiled(spark, d)
    return rows.select("read_id", F.levenshtein("seq", "truth").alias("edit"), F.levenshtein("seq", F.reverse("truth")).alias("edit_reversed"))


@query("SELECT read_id, list_min([levenshtein(substr(g, (start0 + 1)::INT, n::INT), seq) for n in range(0, least(100, length(g) - start0) + 1)])::INT AS edit FROM tiled, genome")
def edit_flexible_end(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads against beginnings of the stretch of the genome from their place to 20 bases beyond it."""
    f = distance.udf2(lambda a, b: distance.flexible_end(a, b, 80), "int")
    rows = tables.tiled(spark, d).crossJoin(F.broadcast(tables.genome(spark, d)))  # one row
    return rows.select("read_id", f(F.expr("substring(g, cast(start0 + 1 as int), 100)"), "seq").alias("edit"))


@query("SELECT read_id, (2 * hamming(seq, truth))::INT AS edit FROM tiled")
def edit_insdel(spark: SparkSession, d: str) -> DataFrame:
    f = distance.udf2(lambda a, b: distance.edit_distance(a, b, distance.INSDEL), "int")
    return tables.tiled(spark, d).select("read_id", f("truth", "seq").alias("edit"))


@query("SELECT read_id, hamming(seq, truth)::INT AS edit, CASE WHEN hamming(seq, truth) > 0 THEN concat((read_id * 37) % 80, 'S', seq[((read_id * 37) % 80)::INT + 1]) ELSE '' END AS script FROM tiled")
def edit_script(spark: SparkSession, d: str) -> DataFrame:
    f = distance.udf2(lambda a, b: " ".join(f"{p}{op}{c}" for p, op, c in distance.edit_script(a, b)), "string")
    rows = tables.tiled(spark, d).select("read_id", F.levenshtein("seq", "truth").alias("edit"), f("truth", "seq").alias("script"))
    return rows


@query("SELECT read_id, CASE WHEN levenshtein(truth, other) <= 3 THEN levenshtein(truth, other) ELSE -1 END::INT AS near, CASE WHEN levenshtein(truth, reverse(other)) <= 40 THEN levenshtein(truth, reverse(other)) ELSE -1 END::INT AS far FROM mutated")
def edit_banded(spark: SparkSession, d: str) -> DataFrame:
    near = distance.udf2(lambda a, b: distance.banded_distance(a, b, 3), "int")
    far = distance.udf2(lambda a, b: distance.banded_distance(a, b, 40), "int")
    return tables.with_indels(spark, d).select("read_id", near("truth", "other").alias("near"), far("truth", F.reverse("other")).alias("far"))


@query("SELECT read_id, (20 + list_min([hamming(substr(truth, i + 1, 60), substr(seq, 11, 60)) for i in range(0, 21)]))::INT AS shorter, 80 AS longer FROM tiled")
def hamming_unequal(spark: SparkSession, d: str) -> DataFrame:
    f = distance.udf2(distance.hamming_distance, "int")
    part = F.expr("substring(seq, 11, 60)")
    return tables.tiled(spark, d).select("read_id", f("truth", part).alias("shorter"), f(part, "truth").alias("longer"))


@query("SELECT read_id, levenshtein(truth, other)::INT AS edits, levenshtein(truth, other)::INT AS changes, other AS rebuilt, other AS rebuilt_normalized FROM mutated")
def edit_script_indels(spark: SparkSession, d: str) -> DataFrame:
    """Scripts with insertions and deletions, and what they and their common form make of the true stretch."""

    @F.pandas_udf("changes int, rebuilt string, rebuilt_normalized string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            script = distance.edit_script(x, y)
            made = ["".join(edit_graph.node_base(x, n) for n in edit_graph.path_nodes(x, 0, len(x), s)) for s in (script, edit_graph.normalized(x, 0, len(x), script))]
            rows.append((len(script), *made))
        return pd.DataFrame(rows, columns=["changes", "rebuilt", "rebuilt_normalized"])

    return tables.with_indels(spark, d).select("read_id", F.levenshtein("truth", "other").alias("edits"), run("truth", "other").alias("x")).select("read_id", "edits", "x.*")


@query("""
, spots AS (SELECT read_id, list({'d': levenshtein(substr(stretch, i + 1, n), seq), 'e': i + n}) AS s FROM (
    SELECT read_id, seq, substr(g, greatest(start0 - 20, 0)::INT + 1, least(start0, 20)::INT + 100) AS stretch FROM tiled, genome), range(0, 121) AS a(i), range(76, 85) AS b(n) WHERE i + n <= length(stretch) GROUP BY read_id),
least_of AS (SELECT read_id, s, list_min([x.d for x in s]) AS d FROM spots)
SELECT read_id, CASE WHEN d <= 4 THEN d ELSE -1 END::INT AS edit, CASE WHEN d <= 4 THEN array_to_string(list_sort(list_distinct([x.e for x in s if x.d = d])), ' ') ELSE '' END AS ends FROM least_of""")
def edit_infix(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads in the stretch of the genome from 20 bases before their place to 20 after it."""
    stretch = F.expr("substring(g, cast(greatest(start0 - 20, 0) + 1 as int), cast(least(start0, 20) + 100 as int))")
    rows = tables.tiled(spark, d).crossJoin(F.broadcast(tables.genome(spark, d))).withColumn("stretch", stretch)

    @F.pandas_udf("edit int, ends array<int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [distance.infix(x, y, 4) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"edit": [e for e, _ in found], "ends": [x for _, x in found]})

    return rows.withColumn("v", run("stretch", "seq")).select("read_id", "v.edit", F.array_join("v.ends", " ").alias("ends"))


_REACH = """(SELECT read_id, arg_min({{'d': d, 'la': la, 'lb': lb}}, (d, -(la + lb), -la)) AS x FROM (
    SELECT read_id, levenshtein({a}, substr({b}, 1, n::INT)) AS d, length({a}) AS la, n AS lb FROM tiled, range(0, 81) AS r(n)
    UNION ALL SELECT read_id, levenshtein(substr({a}, 1, n::INT), {b}), n, length({b}) FROM tiled, range(0, 81) AS r(n)) GROUP BY read_id)"""
_SAID = "CASE WHEN {x}.d <= 20 THEN concat({x}.d, ',', {x}.la, ',', {x}.lb) ELSE '-1,0,0' END"


@query(f"SELECT f.read_id, {_SAID.format(x='f.x')} AS forward, {_SAID.format(x='b.x')} AS backward FROM {_REACH.format(a='truth', b='seq')} f JOIN {_REACH.format(a='reverse(truth)', b='reverse(seq)')} b USING (read_id)")
def edit_extend(spark: SparkSession, d: str) -> DataFrame:
    f = distance.udf2(lambda a, b: ",".join(map(str, distance.extend(a, b, 20))), "string")
    g = distance.udf2(lambda a, b: ",".join(map(str, distance.extend_back(a, b, 20))), "string")
    return tables.tiled(spark, d).select("read_id", f("truth", "seq").alias("forward"), g("truth", "seq").alias("backward"))


@query("""
, starts AS (SELECT read_id, i, j, list_max([n for n in range(9, 81) if i + n <= 80 AND j + n <= 80 AND substr(truth, i::INT + 1, n::INT) = substr(seq, j::INT + 1, n::INT)]) AS n
    FROM tiled, range(0, 72) AS a(i), range(0, 72) AS b(j) WHERE substr(truth, i::INT + 1, 9) = substr(seq, j::INT + 1, 9)),
longest AS (SELECT read_id, arg_min(concat(i, ',', j, ',', n), (-n, j, i)) AS seed FROM starts GROUP BY read_id)
SELECT read_id, coalesce(seed, '0,0,0') AS seed FROM tiled LEFT JOIN longest USING (read_id)""")
def common_seed(spark: SparkSession, d: str) -> DataFrame:
    f = distance.udf2(lambda a, b: ",".join(map(str, edit_graph.common_seed(a, b, K))), "string")
    return tables.tiled(spark, d).select("read_id", f("truth", "seq").alias("seed"))


# placement


@query("SELECT read_id, strand, start FROM tiled JOIN ref_places ON there = seq")
def align_exact(spark: SparkSession, d: str) -> DataFrame:
    return placement.align_exact(_tiled(spark, d), tables.genome(spark, d), 26)


@query("SELECT n.read_id, n.edit, strand, start FROM near_places n JOIN (SELECT read_id, min(edit) AS edit FROM near_places GROUP BY read_id) USING (read_id, edit)")
def align_hamming(spark: SparkSession, d: str) -> DataFrame:
    return placement.align_hamming(_tiled(spark, d), tables.genome(spark, d), 2, 26)


def _maps(aligned: DataFrame) -> DataFrame:
    text = F.transform("maps", lambda m: F.concat_ws(":", m["strand"], m["start"].cast("string"), m["len"].cast("string")))
    return aligned.select("read_id", "edit", F.array_join(F.array_sort(text), " ").alias("maps"))


_ALIGNED = """
, cut AS (SELECT read_id, {seq} AS seq, p, substr({seq}, (p * length({seq}) // 4)::INT + 1, {q}) AS gram FROM {reads}, range(0, 4) AS r(p)),
hit AS (SELECT DISTINCT read_id, seq, strand, start - p * length(seq) // 4 AS s0 FROM cut JOIN (SELECT strand, i AS start, substr(g, i::INT + 1, {q}) AS gram FROM ref_strands, range(0, length(g) - {q} + 1) AS r(i)) USING (gram)),
tried AS (SELECT DISTINCT read_id, seq, strand, s0 + x AS start, length(seq) + y AS len FROM hit, range(-4, 5) AS a(x), range(-3, 4) AS b(y)),
found AS (SELECT read_id, strand, start, len, levenshtein(substr(g, start::INT + 1, len::INT), seq) AS edit FROM tried JOIN ref_strands USING (strand)
    WHERE start >= 0 AND start + len <= length(g) AND levenshtein(substr(g, start::INT + 1, len::INT), seq) <= 3),
fewest_edits AS (SELECT read_id, min(edit) AS edit FROM found GROUP BY read_id)
SELECT read_id, edit::INT AS edit, array_to_string(list_sort(list(concat(strand, ':', start, ':', len))), ' ') AS maps FROM found JOIN fewest_edits USING (read_id, edit) GROUP BY ALL"""


@query(_ALIGNED.format(seq="seq", reads="tiled", q=20))
def align_edit(spark: SparkSession, d: str) -> DataFrame:
    return _maps(placement.align_edit(_tiled(spark, d), tables.genome(spark, d), 3, 20))


@query(_ALIGNED.format(seq="other", reads="mutated", q=19))
def align_edit_indels(spark: SparkSession, d: str) -> DataFrame:
    """Reads with an insertion or a deletion."""
    reads = tables.with_indels(spark, d).select("read_id", F.col("other").alias("seq"))
    return _maps(placement.align_edit(reads, tables.genome(spark, d), 3, 19))


@query("""
, placed AS (SELECT read_id, n.edit, count(*) AS places FROM near_places n JOIN (SELECT read_id, min(edit) AS edit FROM near_places GROUP BY read_id) USING (read_id, edit) GROUP BY ALL)
SELECT read_id, seq, edit, CASE WHEN edit = 0 THEN 0 ELSE places END::INT AS places FROM placed JOIN tiled USING (read_id)""")
def alignment_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Alignments written as text and read again; exact reads have no places listed."""
    reads, genome = _tiled(spark, d), tables.genome(spark, d)
    whole = genome.select(F.length("g")).first()[0]
    text = fastx.alignment_text(reads, placement.align_edit(reads, genome, 2, 26, "hamming"), whole)
    stage = Stage(spark)
    text.write.text(f"{stage.root}/alignment")
    back = fastx.parse_alignment(spark.read.text(f"{stage.root}/alignment"), whole).groupBy("seq").agg(F.min(F.struct("edit", F.size("maps").alias("places"))).alias("x"))
    return reads.join(back, "seq").select("read_id", "seq", "x.edit", "x.places")


@query("SELECT count(*) AS n_reads, count(edit) AS n_aligned, sum(length(seq))::BIGINT AS n_bases, sum(length(seq)) FILTER (edit IS NOT NULL)::BIGINT AS aligned_bases, round(avg(edit), 6) AS mean_edit FROM tiled LEFT JOIN (SELECT read_id, min(edit) AS edit FROM near_places GROUP BY read_id) USING (read_id)")
def align_summary(spark: SparkSession, d: str) -> DataFrame:
    return placement.summary(_tiled(spark, d), align_hamming(spark, d))


# evaluation


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate_reads(_tiled(spark, d), correct_hamming(spark, d), tables.tiled(spark, d).select("read_id", F.col("truth").alias("seq")))


@query("SELECT read_id, e1, e2, opers, n, cls FROM classed")
def eval_reads(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


_BASES = "bases AS (SELECT sum((e1 - opers + e2) / 2) AS fn, sum(e1 - (e1 - opers + e2) / 2) AS tp, sum(opers - e1 + (e1 - opers + e2) / 2) AS fp, sum(n) AS n FROM classed)"


@query(f", {_BASES} SELECT tp, fp, fn, n - tp - fp - fn AS tn FROM bases")
def eval_bases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.base_confusion(_judged(spark, d))


@query("""
, c AS (SELECT count(*) FILTER (cls = 'TP') AS tp, count(*) FILTER (cls = 'FP') AS fp, count(*) FILTER (cls = 'FN') AS fn, count(*) FILTER (cls = 'TN') AS tn FROM classed),
m AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM c)
SELECT tp, fp, fn, tn, round(recall, 6) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(precision, 6) AS precision,
    round(2 * recall * precision / nullif(recall + precision, 0), 6) AS f_score, round((tp - fp) / nullif(tp + fn, 0)::DOUBLE, 6) AS gain FROM m""")
def eval_measures(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_measures(evaluation.read_confusion(_judged(spark, d)))


def _placed_truth(spark: SparkSession, d: str) -> DataFrame:
    """Alignments at the places that the reads were taken from."""
    rows = tables.tiled(spark, d)
    place = F.struct(F.lit("+").alias("strand"), F.col("start0").cast("int").alias("start"), F.lit(80).alias("len"))
    return rows.select("read_id", F.levenshtein("seq", "truth").alias("edit"), F.array(place).alias("maps"))


@query("""
, lines AS (SELECT concat(read_id, ') ', t.seq, '[', e1, '] ', f.seq, '[', e2, '] {', cls, ',', opers, ',0}') AS value FROM classed JOIN tiled t USING (read_id) JOIN fixed f USING (read_id))
SELECT value FROM lines""")
def eval_lines(spark: SparkSession, d: str) -> DataFrame:
    done = evaluation.evaluate_placed(_tiled(spark, d), correct_hamming(spark, d), _placed_truth(spark, d), tables.genome(spark, d))
    return fastx.evaluation_text(done)


_SHORT = """
, short AS (SELECT read_id, t.seq AS org, truth, levenshtein(t.seq, truth) AS e1, CASE read_id % 5 WHEN 0 THEN substr(f.seq, 1, 75) WHEN 1 THEN substr(f.seq, 4) ELSE f.seq END AS fixed FROM tiled t JOIN fixed f USING (read_id)),
cut AS (SELECT i::INT AS i, n::INT AS n FROM range(0, 80) AS a(i), range(68, 81) AS b(n) WHERE i + n <= 80),
own AS (SELECT read_id, levenshtein(substr(org, i + 1, n), fixed) AS d, min(80 - n) AS less FROM short, cut WHERE e1 = 0 GROUP BY read_id, d),
right_ones AS (SELECT read_id, min(d) AS e2, min(d) AS opers, arg_min(less, d) AS trimmed, 0 AS e1_left FROM own GROUP BY read_id),
there AS (SELECT read_id, levenshtein(substr(truth, i + 1, n), fixed) AS d, substr(truth, i + 1, n) AS part FROM short, cut WHERE e1 > 0),
parts AS (SELECT DISTINCT read_id, d AS e2, part FROM there JOIN (SELECT read_id, min(d) AS d FROM there GROUP BY read_id) USING (read_id, d)),
back AS (SELECT read_id, e2, i, n, levenshtein(substr(org, i + 1, n), part) AS d, levenshtein(substr(org, i + 1, n), fixed) AS opers FROM parts JOIN short USING (read_id), cut),
wrong_ones AS (SELECT read_id, any_value(e2) AS e2, min(opers) AS opers, arg_min(80 - n, (opers, 80 - n)) AS trimmed, any_value(d) AS e1_left
    FROM back JOIN (SELECT read_id, min(d) AS d FROM back GROUP BY read_id) USING (read_id, d) GROUP BY read_id),
all_ones AS (SELECT * FROM right_ones UNION ALL SELECT * FROM wrong_ones)
"""


def _shortened(spark: SparkSession, d: str) -> DataFrame:
    cut = F.expr("CASE read_id % 5 WHEN 0 THEN substring(seq, 1, 75) WHEN 1 THEN substring(seq, 4) ELSE seq END")
    fixed = correct_hamming(spark, d).withColumn("seq", cut)
    return evaluation.evaluate_placed(_tiled(spark, d), fixed, _placed_truth(spark, d), tables.genome(spark, d), trim=True)


@query(_SHORT + "SELECT read_id, e2::INT AS e2, opers::INT AS opers, trimmed::INT AS trimmed, e1_left::INT AS e1_left FROM all_ones")
def eval_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Corrected reads that lost bases at an end, held against the part of the reference that they fit best."""
    return _shortened(spark, d).select("read_id", "e2", "opers", "trimmed", "e1_left")


@query(_SHORT + "SELECT count(*) AS n_reads, 80 * count(*) AS n_bases, sum(trimmed)::BIGINT AS trimmed, 80 * count(*) FILTER (e2 = 0) AS n_bases_right, coalesce(sum(trimmed) FILTER (e2 = 0), 0)::BIGINT AS trimmed_right FROM all_ones")
def eval_trimming(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_shortened(spark, d)).select("n_reads", "n_bases", "trimmed", "n_bases_right", "trimmed_right")
