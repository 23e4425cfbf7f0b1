"""The pipeline's stages against plain Python over the same rows, and on odd ones."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_models import plain_toxicity
from test_operators_llm import classes_by_hand, lines_by_hand

import corpus_pipeline
from strandline.llm import mixing, packing, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, data, same, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    same(queries.QUERIES[name](spark, data).toPandas(), con.sql(queries.ORACLE_SQL[name]).df())


def by_hand(rows, labels):
    """The rows (doc_id, text, lang, source, n_chars) after each stage but the last, by id."""
    out = []
    texts = {k: r[1] for k, r in rows.items()}
    ids, weights, bias = plain_toxicity(texts, {k: v for k, v in labels.items() if zlib.crc32(str(k).encode()) % 5}, toxicity.AT_MOST)
    dense = dict(zip(ids.tolist(), weights.tolist(), strict=True))
    rows = {k: r for k, r in rows.items() if bias + sum(dense.get(f, 0.0) for f in set(toxicity.features(r[1]).tolist())) < 0}
    out.append(rows)
    cut = lines_by_hand({k: r[1] for k, r in rows.items()})
    changed = {}
    for k, r in rows.items():
        text, removed = cut[k]
        if not removed or text.strip():
            changed[k] = (k, text, *r[2:4], len(text) if removed else r[4])
    out.append(changed)
    root = classes_by_hand({k: r[1] for k, r in changed.items()})
    out.append({k: r for k, r in changed.items() if root[k] == k})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in out[-1].values()])
    kept = {k for k, keep in con.sql(f"SELECT doc_id, kept FROM ({mixing.OP8_SQL})").fetchall() if keep}
    out.append({k: r for k, r in out[-1].items() if k in kept})
    return out


def test_run_by_hand(spark, data, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    want = by_hand({r.doc_id: tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect()}, labels)
    for rows, (name, stage) in zip(want, corpus_pipeline.STAGES, strict=False):
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id: tuple(r) for r in docs.collect()} == rows and docs.count() == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert len(want[-1]) < len(want[0]) < 200
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for k, r in want[-1].items():
        ids = np.asarray([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        part = packed[packed.doc_id == k].sort_values("piece")
        assert part.length.sum() == len(ids) and part.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in part.start]
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert packed.sequence_id.nunique() == -(-packed.length.sum() // 4096)
    whole = corpus_pipeline.run(spark, data).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole[columns].itertuples(index=False)) == sorted(packed[columns].itertuples(index=False))


def test_stages_on_odd_rows(spark, data):
    line = "one two three\n"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "alpha beta " * 30, None, "a", 5), (2, "alpha beta " * 30, None, "a", 5), (None, "gamma delta", "en", None, None), (3, "\n \n", "en", "a", 4)]
    rows += [(4, line * 2 + "x", "en", "a", 1), (5, "y" * 300_000, "de", "b", 7), (6, "word " * 60_000, "de", "b", None), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        got = out.collect()
        counts[name] = len(got)
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS and not Counter(got) - Counter(tuple(r) for r in rows)
        assert stage(spark, docs.limit(0), data).count() == 0
    # the copy of document 2 is a near duplicate; mixing draws both rows of document 2, and the rows without an id, alike
    assert counts["toxicity"] == counts["line_dedup"] == len(rows) and counts["near_dedup"] == len(rows) - 1
    assert counts["best_fit_packing"] >= len(rows)
    mixed = Counter(r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, data).collect())
    assert mixed[2] in (0, 2)
