"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells source x language x topic are raked until their sums along each dimension meet the targets;
a cell's factor, scaled so that the largest is 1, is the probability with which each of its documents is kept. Kept
tokens then meet all marginals in expectation and no document appears twice.

Only DataFrame functions touch rows. Cells are raked on the driver while there are at most MOST_CELLS of them, in tables
beyond that; both ways do the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, table

DIMENSIONS = ("source", "lang", "topic")
#: Shares of tokens by kind of content, the default target of that dimension. They're scaled to the kinds that occur.
TARGETS = {"topic": {"article": 0.60, "long": 0.32, "note": 0.03, "table": 0.03, "markup": 0.02}}
#: Targets of a dimension for which none are given: the shares found, raised to this power and scaled to 1, so that rare
#: values gain and frequent ones lose.
POWER = 0.8
ROUNDS = 20
SEED = "mix-1"
#: Cells that the driver rakes and broadcasts, at most; each is three short strings and two numbers.
MOST_CELLS = 20_000
NONE = "<none>"
#: Kinds of content: the first whose characters come at least once in ten words, else by the number of words under which
#: a text is of that kind, else LONG.
KINDS = (("table", "|\t"), ("markup", "#*$%&<>"))
LENGTHS = (("note", 100), ("article", 1000))
LONG = "long"

_WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("n_tokens", "topic", "probability", "kept")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The kind of content of a text that isn't null."""
    out = F.lit(LONG)
    for name, words in reversed(LENGTHS):
        out = F.when(n_tokens < words, name).otherwise(out)
    for name, marks in reversed(KINDS):
        n = F.regexp_count(text, F.lit(f"[{marks}]"))
        out = F.when((n > 0) & (10 * n >= n_tokens), name).otherwise(out)
    return out


def with_cells(docs: DataFrame) -> DataFrame:
    """(_row, _source, _lang, _topic, _tokens): the row as it is, its cell (null: '<none>') and its number of words."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    value = lambda c: F.coalesce(docs[c].cast("string"), F.lit(NONE))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), value("source").alias("_source"), value("lang").alias("_lang"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("_tokens"))
    return rows.withColumn("_topic", topic_of(F.coalesce(F.col("_row")["text"].cast("string"), F.lit("")), F.col("_tokens")))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(sums: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    """Shares of the values that occur; values without a given share get 0."""
    raw = {v: (given.get(v, 0.0) if given is not None else (s**power if s > 0 else 0.0)) for v, s in sums.items()}
    total = sum(raw[v] for v in sorted(raw)) or 1.0
    return {v: x / total for v, x in raw.items()}


def rake_local(cells: list[tuple], targets: list[dict[str, float] | None], power: float, rounds: int) -> list[float]:
    """cells: (source, lang, topic, tokens) in order. Factors, the largest 1."""
    weight = [float(c[3]) for c in cells]
    total = sum(weight)
    wanted = []
    for d in range(len(targets)):
        sums: dict[str, float] = {}
        for c, w in zip(cells, weight, strict=True):
            sums[c[d]] = sums.get(c[d], 0.0) + w
        wanted.append(_targets(sums, targets[d], power))
    for _ in range(rounds):
        for d, want in enumerate(wanted):
            sums = {}
            for c, w in zip(cells, weight, strict=True):
                sums[c[d]] = sums.get(c[d], 0.0) + w
            weight = [w * want[c[d]] * total / sums[c[d]] if sums[c[d]] > 0 else 0.0 for c, w in zip(cells, weight, strict=True)]
    factors = [w / c[3] if c[3] else 0.0 for c, w in zip(cells, weight, strict=True)]
    most = max(factors, default=0.0) or 1.0
    return [f / most if c[3] else 1.0 for c, f in zip(cells, factors, strict=True)]


def rake_tables(stage: Stage, cells: DataFrame, targets: list[dict[str, float] | None], power: float, rounds: int) -> DataFrame:
    """The same in tables, for any number of cells. Sums along a dimension are partial aggregations; joins on a
    dimension's value are plain equi-joins."""
    spark = stage.spark
    names = ["_source", "_lang", "_topic"]
    total = float(cells.agg(F.sum("_tokens")).first()[0] or 0.0)
    wanted = []
    for d, name in enumerate(names):
        sums = cells.groupBy(name).agg(F.sum("_tokens").cast("double").alias("s"))
        if targets[d] is None:
            raw = sums.select(name, F.when(F.col("s") > 0, F.pow("s", F.lit(power))).otherwise(0.0).alias("t"))
        else:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], f"{name} string, t double")
            raw = sums.join(given, name, "left").select(name, F.coalesce("t", F.lit(0.0)).alias("t"))
        whole = raw.agg(F.sum("t").alias("all"))
        wanted.append(stage.write(raw.join(F.broadcast(whole)).select(name, (F.col("t") / F.when(F.col("all") > 0, F.col("all")).otherwise(1.0) * total).alias("t")), f"target{d}"))
    now = stage.write(cells.withColumn("w", F.col("_tokens").cast("double")), "rake0")
    for k in range(rounds):
        for d, name in enumerate(names):
            sums = now.groupBy(name).agg(F.sum("w").alias("s"))
            step = sums.join(wanted[d], name).select(name, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0).alias("f"))
            # a table, so that the join is a plain one, which adaptive execution splits at a hot value
            now = now.join(stage.write(step, f"step{k}-{d}"), name).select(*names, "_tokens", (F.col("w") * F.col("f")).alias("w"))
        now = stage.write(now, f"rake{k + 1}")
        stage.drop(f"rake{k}")
    factor = F.when(F.col("_tokens") > 0, F.col("w") / F.col("_tokens"))
    most = now.agg(F.max(factor).alias("most"))
    return now.join(F.broadcast(most)).select(*names, F.coalesce(factor / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0), F.lit(1.0)).alias("_factor"))


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rounds: int = ROUNDS, seed: str = SEED, most_cells: int = MOST_CELLS) -> DataFrame:
    """docs (doc_id, text, lang, source) with n_tokens, topic, probability (rounded to 9 places) and kept added.

    targets: for source, lang and topic the shares of values; a value without one gets 0, a dimension without any its
    smoothed shares; None means TARGETS. Where the cells can't meet all targets, the last dimension's are met.

    Null source or language: a value '<none>' of its own. Null or empty text: no tokens; a cell without any tokens is
    kept whole. Null doc_id: all such rows share one random number. Repeated rows share theirs and are kept or left out
    together. Empty table: no rows. Other columns pass through, whatever their names; columns that are called like an
    added one are replaced."""
    stage = Stage(spark)
    marked = with_cells(docs)
    names = ["_source", "_lang", "_topic"]
    cells = stage.write(marked.groupBy(*names).agg(F.sum("_tokens").alias("_tokens")), "cells")
    wanted = [(TARGETS if targets is None else targets).get(d) for d in DIMENSIONS]
    if cells.count() <= most_cells:
        rows = [tuple(r) for r in cells.orderBy(*names).collect()]
        found = [(*r[:3], f) for r, f in zip(rows, rake_local(rows, wanted, power, rounds), strict=True)]
        factors = F.broadcast(spark.createDataFrame(found, "_source string, _lang string, _topic string, _factor double"))
    else:
        factors = stage.write(rake_tables(stage, cells, wanted, power, rounds), "factors")
    p = F.round(F.col("_factor"), 9)
    given = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in _ADDED]
    drawn = uniform(F.col("_row")["doc_id"], seed) < p
    return marked.join(factors, names).select(*given, F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), p.alias("probability"), drawn.alias("kept"))


def marginals(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER) -> dict[str, dict[str, tuple[float, float]]]:
    """For each dimension and value of the rows that mix() gave: the target share and the share that is reached in
    expectation, so that targets that can't be met together show."""
    out = {}
    for d in DIMENSIONS:
        wanted = (TARGETS if targets is None else targets).get(d)
        value = F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias("v")
        rows = mixed.groupBy(value).agg(F.sum("n_tokens").cast("double").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("w")).collect()  # a row for each value
        shares = _targets({r["v"]: r["n"] for r in rows}, wanted, power)
        total = sum(r["w"] for r in rows) or 1.0
        out[d] = {r["v"]: (shares[r["v"]], r["w"] / total) for r in rows}
    return out


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(spark, docs).select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _sql() -> str:
    kinds = "\n".join(f"WHEN {n} > 0 AND 10 * {n} >= n_tokens THEN '{name}'" for name, n in ((k, f"(length(t) - length(translate(t, '{m}', '')))") for k, m in KINDS))
    lengths = "\n".join(f"WHEN n_tokens < {n} THEN '{name}'" for name, n in LENGTHS)
    parts = [rf"""
WITH counted AS (
    SELECT doc_id, coalesce(source, '<none>') AS source, coalesce(lang, '<none>') AS lang, coalesce(text, '') AS t,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
    FROM documents
), marked AS (
    SELECT doc_id, source, lang, n_tokens, CASE {kinds} {lengths} ELSE '{LONG}' END AS topic FROM counted
), total AS (SELECT sum(n_tokens)::DOUBLE AS t FROM marked),
w0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS w FROM marked GROUP BY ALL)"""]
    for d in DIMENSIONS:
        if d in TARGETS:
            given = f"CASE {d} " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in TARGETS[d].items()) + " ELSE 0 END"
            parts.append(f"""t_{d} AS (SELECT {d}, {given} / sum({given}) OVER () AS share
    FROM (SELECT DISTINCT {d} FROM w0))""")
            continue
        parts.append(f"""t_{d} AS (SELECT {d}, CASE WHEN s > 0 THEN s ** {POWER} ELSE 0 END / sum(CASE WHEN s > 0 THEN s ** {POWER} ELSE 0 END) OVER () AS share
    FROM (SELECT {d}, sum(w) AS s FROM w0 GROUP BY {d}))""")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"""w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens,
    coalesce(w * share * (SELECT t FROM total) / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0) AS w FROM w{k} JOIN t_{d} USING ({d}))""")
            k += 1
    parts.append(f"""f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN (w / tokens) / max(w / nullif(tokens, 0)) OVER () ELSE 1 END AS factor FROM w{k})""")
    return ",\n".join(parts) + f"""
SELECT doc_id, topic, n_tokens, round(round(factor, 9), 6) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < round(factor, 9) AS kept
FROM marked JOIN f USING (source, lang, topic)
"""


OP8_SQL = _sql()
