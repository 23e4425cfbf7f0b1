"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Every rule looks at a few counts of a document and votes good, bad or nothing. Documents with the same votes are one
row of a table of at most 3 ** (number of rules) rows, on which expectation-maximisation runs with two latent classes
(a naive Bayes model of the votes, abstaining included, started from the majority). A document's posterior probability
of being good, an expression over its votes, takes the place of a filter that wants all rules passed.

Only DataFrame functions on rows; counting is done inside each row, so no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, table

WORD = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS = 10
THRESHOLD = 0.5
ROUNDS = 50

#: Words that lie in windows of five words that occur twice or more in the text; h holds the windows' hashes in order.
_REPEATED = f"""
CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
  element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    element_at(transform(array(array_sort(transform(
        filter(s, (r, j) -> get(s, j - 1).x <=> r.x OR get(s, j + 1).x <=> r.x), r -> r.i))), p ->
      aggregate(transform(p, (x, j) -> CASE WHEN j + 1 < size(p) THEN least({WINDOW}, get(p, j + 1) - x) ELSE {WINDOW} END),
                0L, (a, n) -> a + n)), 1)), 1) END"""


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_short", "n_bare", "n_stutter", "n_lines", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what else the rules need).
    Null text counts as none."""
    keep = keep or ["doc_id"]
    kept = F.struct(*(docs[f"`{c}`"] for c in keep)).alias("_keep")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(kept, text.alias("t"))
    rows = rows.withColumn("ws", F.array_remove(F.split("t", WORD), ""))
    rows = rows.withColumn("n_words", F.size("ws").cast("long"))
    rows = rows.withColumn("wh", F.transform("ws", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("short", F.filter("ws", lambda w: F.length(w) <= 3))
    count = lambda marks: F.regexp_count(F.col("t"), F.lit(marks)).cast("long")
    full = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = rows.select(
        "_keep",
        "n_words",
        (F.length("t") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        full.alias("full"),
        F.size(F.filter("short", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_short"),
        F.size(F.filter("short", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare"),
        count("[A-Z]").alias("n_capitals"),
        F.expr("size(filter(wh, (x, i) -> x = get(wh, i - 1)))").cast("long").alias("n_stutter"),
        count("[!?]").alias("n_shouts"),
        F.expr(f"""CASE WHEN n_words < {WINDOW} THEN array() ELSE transform(sequence(0, size(wh) - {WINDOW}),
            i -> xxhash64({", ".join(f"get(wh, i + {j})" for j in range(WINDOW))})) END""").cast("array<bigint>").alias("h"),
    )
    return lines.select(
        *(F.col("_keep")[c].alias(c) for c in keep),
        "n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_short", "n_bare", "n_stutter",
        F.size("full").cast("long").alias("n_lines"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: name, vote: 1 good, -1 bad, 0 nothing.
def rules() -> dict[str, Column]:
    mean = _share("word_chars", "n_words")
    return {
        "symbols": _vote(_share("n_symbols", "n_words") <= 0.02, _share("n_symbols", "n_words") >= 0.15),
        "capitals": _vote(_share("n_capitals", "word_chars") <= 0.06, _share("n_capitals", "word_chars") >= 0.15),
        "shouts": _vote(_share("n_shouts", "n_words") <= 0.05, _share("n_shouts", "n_words") >= 0.2),
        "short_words": _vote(_share("n_short", "n_words") >= 0.15, (_share("n_short", "n_words") < 0.08) & (F.col("n_words") >= 20)),
        "bare_marks": _vote(_share("n_bare", "n_words") <= 0.02, (_share("n_bare", "n_words") >= 0.1) & (F.col("n_words") >= 20)),
        "stutter": _vote((_share("n_stutter", "n_words") <= 0.02) & (F.col("n_words") >= 20), _share("n_stutter", "n_words") >= 0.2),
        "word_length": _vote((mean >= 3) & (mean <= 7.5), (mean < 2.5) | (mean > 8.5)),
        "dup_lines": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3), _share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote((F.col("n_repeat_words") == 0) & (F.col("n_words") >= 50), _share("n_repeat_words", "n_words") > 0.1),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """patterns: votes and how many documents have them. Returns the log odds before any vote, and for each rule the
    weight (log likelihood ratio of good to bad) of each vote. With no documents: zeros. One pseudo-document for each
    vote keeps every probability above 0; a rule's vote for good never counts against it, nor the reverse."""
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, []
    post = [(1 + 2 * sum(v == 1 for v in votes)) / (2 + 2 * sum(v != 0 for v in votes) + 2 * 2 * sum(v == -1 for v in votes)) for votes, _ in patterns]
    prior, weights = 0.0, []
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        prior = math.log((good + 1) / (total - good + 1))
        weights = []
        for r in range(n_rules):
            sums = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(post, patterns, strict=True):
                sums[votes[r]][0] += p * n
                sums[votes[r]][1] += (1 - p) * n
            w = {v: math.log(a / (good + 3)) - math.log(b / (total - good + 3)) for v, (a, b) in sums.items()}
            weights.append({-1: min(w[-1], 0.0), 0: w[0], 1: max(w[1], 0.0)})
        post = [1 / (1 + math.exp(-max(-35.0, min(35.0, prior + sum(w[v] for w, v in zip(weights, votes, strict=True)))))) for votes, _ in patterns]
    return prior, weights


def posterior(prior: float, weights: list[dict[int, float]], votes: list[str]) -> Column:
    odds = F.lit(prior)
    for w, name in zip(weights, votes, strict=False):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), odds))))


def judge(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (*keep, counts, base_failed, one vote column for each rule, posterior, kept).

    Null, empty and very short texts fail the base rule and are not kept, whatever the posterior says; rules learn from
    the others alone. Repeated rows are judged alike and each counts. An empty table gives no rows. Columns that aren't
    kept don't matter, whatever their names; a kept one that is called like one of the result's own is replaced."""
    own = {*_COUNTS, "base_failed", "posterior", "kept", *(f"vote_{k}" for k in rules())}
    keep = [c for c in keep or ["doc_id"] if c.lower() not in own]
    stage = Stage(spark)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    votes = {f"vote_{k}": v for k, v in rules().items()}
    counted = base_counts(docs, keep).withColumn("base_failed", failed).withColumns(votes)
    counted = stage.write(counted, "counts")
    patterns = [(tuple(r[:-1]), r[-1]) for r in counted.filter(~F.col("base_failed")).groupBy(*votes).count().orderBy(*votes).collect()]
    prior, weights = estimate(patterns)
    p = F.round(posterior(prior, weights, list(votes)), 9)
    return counted.withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op7_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _sql() -> str:
    """The counts, votes and rounds of EM over patterns of votes, a table for each round."""
    share = lambda a, b: f"({a} / greatest({b}, 1)::DOUBLE)"
    mean = share("word_chars", "n_words")
    votes = {
        "symbols": (f"{share('n_symbols', 'n_words')} <= 0.02", f"{share('n_symbols', 'n_words')} >= 0.15"),
        "capitals": (f"{share('n_capitals', 'word_chars')} <= 0.06", f"{share('n_capitals', 'word_chars')} >= 0.15"),
        "shouts": (f"{share('n_shouts', 'n_words')} <= 0.05", f"{share('n_shouts', 'n_words')} >= 0.2"),
        "short_words": (f"{share('n_short', 'n_words')} >= 0.15", f"{share('n_short', 'n_words')} < 0.08 AND n_words >= 20"),
        "bare_marks": (f"{share('n_bare', 'n_words')} <= 0.02", f"{share('n_bare', 'n_words')} >= 0.1 AND n_words >= 20"),
        "stutter": (f"{share('n_stutter', 'n_words')} <= 0.02 AND n_words >= 20", f"{share('n_stutter', 'n_words')} >= 0.2"),
        "word_length": (f"{mean} >= 3 AND {mean} <= 7.5", f"{mean} < 2.5 OR {mean} > 8.5"),
        "dup_lines": ("n_dup_lines = 0 AND n_lines >= 3", f"{share('n_dup_lines', 'n_lines')} > 0.3"),
        "repeats": ("n_repeat_words = 0 AND n_words >= 50", f"{share('n_repeat_words', 'n_words')} > 0.1"),
    }
    listed = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in votes.values())
    parts = [rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM texts),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], chr(10)) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM texts WHERE len(ws) >= 5)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(0, 5) AS r(k) GROUP BY doc_id),
counted AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(w) for w in ws]), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[!?]')) AS n_shouts,
        len([w for w in ws if length(w) <= 3 AND regexp_matches(w, '\p{{L}}')]) AS n_short, len([w for w in ws if length(w) <= 3 AND NOT regexp_matches(w, '[\p{{L}}\p{{N}}]')]) AS n_bare,
        len([i for i in range(2, len(ws) + 1) if ws[i] = ws[i - 1]]) AS n_stutter, len(full_lines) AS n_lines,
        (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM texts JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), voted AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{listed}] AS votes FROM counted),
patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY votes),
single AS MATERIALIZED (SELECT votes, n, k, votes[k] AS v FROM patterns, range(1, {len(votes) + 1}) AS r(k)),
e0 AS MATERIALIZED (SELECT votes, n, (1 + 2 * len([v for v in votes if v = 1])) / (2 + 2 * len([v for v in votes if v <> 0]) + 4 * len([v for v in votes if v = -1]))::DOUBLE AS p FROM patterns)"""]
    for r in range(1, ROUNDS + 1):
        parts.append(f"""g{r} AS MATERIALIZED (SELECT sum(p * n) AS good, sum(n) AS total, ln((sum(p * n) + 1) / (sum(n) - sum(p * n) + 1)) AS prior FROM e{r - 1})""")
        parts.append(f"""s{r} AS (SELECT k, v, 1 + sum(p * e.n) AS a, 1 + sum((1 - p) * e.n) AS b FROM e{r - 1} e JOIN single USING (votes) GROUP BY k, v)""")
        parts.append(f"""w{r} AS MATERIALIZED (SELECT k, v, CASE v WHEN -1 THEN least(w, 0) WHEN 1 THEN greatest(w, 0) ELSE w END AS w
    FROM (SELECT k, v, ln(coalesce(a, 1) / (good + 3)) - ln(coalesce(b, 1) / (total - good + 3)) AS w FROM range(1, {len(votes) + 1}) AS r(k) CROSS JOIN range(-1, 2) AS x(v) LEFT JOIN s{r} USING (k, v), g{r}))""")
        parts.append(f"""e{r} AS MATERIALIZED (SELECT votes, any_value(s.n) AS n, 1 / (1 + exp(-greatest(-35, least(35, any_value(prior) + sum(w))))) AS p FROM single s JOIN w{r} USING (k, v), g{r} GROUP BY votes)""")
    return ",\n".join(parts) + f""",
judged AS (SELECT doc_id, round(1 / (1 + exp(-greatest(-35, least(35, any_value(prior) + sum(w))))), 9) AS posterior
    FROM (SELECT doc_id, k, votes[k] AS v FROM voted, range(1, {len(votes) + 1}) AS r(k)) JOIN w{ROUNDS} USING (k, v), g{ROUNDS} GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {THRESHOLD} AS kept, round(posterior, 6) AS posterior
FROM voted JOIN judged USING (doc_id)
"""


OP7_SQL = _sql()
