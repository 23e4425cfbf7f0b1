"""The fitted operators (language, toxicity) against plain Python over the same rows; samples, ties and odd tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import language, toxicity
from strandline.llm.common import sampled


def hashed(i):
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), seed=42))))


def by_hash(ids):
    """Ids in the order of Spark's xxhash64 of their text."""
    return sorted(ids, key=lambda i: (hashed(i), i))


def drawn(ids, most):
    ids = list(ids)
    return [i for i in ids if (hashed(i) / 2.0**64 + 0.5) * len(ids) < most]


@pytest.mark.parametrize("n", [0, 3, 50, 5000])
def test_samples_are_the_least_hashes(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("lang")).repartition(7)
    got = {r.doc_id for r in sampled(rows, "lang", 40, "doc_id").collect()}
    parts = [[i for i in range(n) if (i % 10 < 9) == hot] for hot in (True, False)]
    assert got == {i for part in parts for i in drawn(part, 40)}
    for part in parts:
        assert abs(len(got & set(part)) - min(40, len(part))) <= (6 * 40**0.5 if len(part) > 40 else 0)


def plain_toxicity(texts, labels, at_most):
    chosen = {i for y, most in at_most.items() for i in drawn((k for k, v in labels.items() if v == y), most)}
    rows = by_hash(i for i in chosen if i in texts)
    return toxicity.Ftrl().fit([np.unique(toxicity.features(texts[i])) for i in rows], np.asarray([labels[i] for i in rows], dtype=float))


def test_toxicity_is_the_plain_fit_and_score(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    ids, weights, bias = plain_toxicity(texts, labels, toxicity.AT_MOST)
    got = {r.doc_id: r for r in toxicity.op9_toxicity_ftrl(spark, data).collect()}
    assert len(got) == len(texts)
    dense = dict(zip(ids.tolist(), weights.tolist(), strict=True))
    for i, t in texts.items():
        want = 1 / (1 + np.exp(-(bias + sum(dense.get(f, 0.0) for f in set(toxicity.features(t).tolist())))))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_of_conflicting_labels(spark):
    """What is learnt doesn't depend on how rows are dealt; a document with both labels is toxic."""
    docs = spark.createDataFrame([(i, f"good fine w{i % 7}") for i in range(40)] + [(100 + i, f"bad awful w{i % 7}") for i in range(40)] + [(None, "bad")], "doc_id long, text string")
    pairs = [(i, 0) for i in range(40)] + [(100 + i, y) for i in range(40) for y in (0, 1)] + [(None, 1), (3, None), (4, 7)]
    labels = spark.createDataFrame(pairs, "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(*models, strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, models[0]).collect()}
    assert min(got[100 + i] for i in range(40)) > 0.5 > max(got[i] for i in range(40))
    repeated = toxicity.fit(docs.unionByName(docs), labels)
    assert (repeated[0] == models[0][0]).all() and (repeated[1] == models[0][1]).all()


def test_toxicity_sample_has_a_bound_on_features(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma w{i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, most_ids=1)[0]) == 0


def test_language_is_the_plain_fit_and_vote(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    learn = [i for i, r in rows.items() if r.lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    chosen = {i for x in {rows[i].lang for i in learn} for i in drawn((k for k in learn if rows[k].lang == x), language.AT_MOST)}
    order = by_hash(chosen)
    model = language.machines_of([language.vector(rows[i].text or "") for i in order], np.asarray([rows[i].lang for i in order], dtype=object), None, language.BITS)
    for r in language.op3_language_families(spark, data).collect():
        lang, score = model.predict(rows[r.doc_id].text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_only_letters_are_letters():
    for text in ("²", "½ ①", "Ⅷ ৴", "123 _ __", "́", "", " \n"):
        assert language.letters(text) == []
    assert language.letters("a² x½y Ⅷ ªb") == ["a", "x", "y", "ªb"]
    model = language.machines_of([language.vector("the cat")], np.asarray(["en"], dtype=object), None, 8)
    assert model.predict("² ½ ① Ⅷ") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("x")[0] == "en"


def test_language_of_conflicting_rows_and_empty_tables(spark):
    rows = [(1, "the cat", "en"), (1, "the cat", "de"), (2, "der hund", "de"), (3, "", "en"), (None, "zz", "en"), (4, None, "fr"), (5, "²", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language.fit(docs.repartition(n)) for n in (1, 4)]
    assert set(models[0].family) == {"de"} and (models[0].weights == models[1].weights).all()
    none = docs.limit(0)
    empty = language.fit(none)
    assert empty.family == {} and [(r.lang_pred, r.score) for r in language.identify(docs, empty).collect()] == [("und", 0.0)] * 7
    assert language.identify(none, models[0]).count() == 0 and toxicity.score(none, (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)).count() == 0
