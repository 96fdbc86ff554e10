"""Language, quality, neighbours: held-out accuracy, recall against brute force, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import documents, odd_documents
from pyspark.sql import functions as F

from gridwright.llm import common, langid, neighbours, quality

LARGE = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    got = langid.query(spark, LARGE).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_filter_returns_all_languages_of_a_gram():
    texts = ["abcd abcd", "abcd efgh", "zzzz"]
    value, doc, _, _ = langid.grams(common.strings(pa.array(texts)))
    grams = np.unique(value)
    member = np.stack([np.isin(grams, value[doc == i]) for i in range(2)], axis=1)
    known = member.any(axis=1)
    model = langid.Filter(["l1", "l2"], grams[known], member[known])
    counts, total, _ = model.counts(common.strings(pa.array(texts)))
    assert abs(counts[0, 0] - total[0]) < 1e-6 and counts[2].max() < 0.1
    assert model.predict(pa.array(["efgh", None, "123", "żź"]))[0] == ["l2", "und", "und", "l1"]


def test_languages_by_exact_sets(spark):
    """The filter beside the sets themselves: for every document of the table the same corrected counts, but for a hair, and the same language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    texts = common.strings(pa.array(docs.text))
    value, doc, _, _ = langid.grams(texts)
    names = sorted(set(docs.lang.dropna()))
    sets = {k: set(value[np.isin(doc, np.flatnonzero(((docs.lang == k) & (docs.doc_id % 3 > 0)).to_numpy()))].tolist()) for k in names}
    every = np.array(sorted(set().union(*sets.values())), np.uint32)
    model = langid.Filter(names, every, np.stack([np.isin(every, np.array(sorted(sets[k]), np.uint32)) for k in names], axis=1))
    counts, total, _ = model.counts(texts)
    want = np.array([[sum(int(g) in sets[k] for g in value[doc == i].tolist()) for k in names] for i in range(len(docs))])
    assert (np.abs(counts - want) <= 0.01 * total[:, None] + 3).all()
    clear = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 0.02 * total + 6
    assert clear.mean() > 0.8
    lang, score = model.predict(pa.array(docs.text))
    assert [lang[i] for i in np.flatnonzero(clear)] == [names[want[i].argmax()] for i in np.flatnonzero(clear)]


def test_many_languages():
    rng = np.random.default_rng(0)
    names = [f"l{i}" for i in range(70)]
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 300)) for _ in names]
    value, doc, _, _ = langid.grams(common.strings(pa.array(texts)))
    grams = np.unique(value)
    model = langid.Filter(names, grams, np.stack([np.isin(grams, value[doc == i]) for i in range(70)], axis=1))
    assert model.predict(pa.array(texts))[0] == names


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in got} == {"en", "und"}
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), none).columns == [*docs.columns, "lang_pred", "lang_score"]


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = quality.query(spark, LARGE).join(labels, "doc_id").where("held_out").toPandas()
    good = got.quality == 1
    assert (got.predicted == got.quality).mean() > 0.9
    assert got.score[good].mean() > got.score[~good].mean() + 0.4


def auc(score, good):
    """Share of pairs of a good and a bad text that are in the right order."""
    a, b = score[good], score[~good]
    return np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))


def test_measure_is_the_difference_of_compressed_sizes(spark):
    """Each size by itself, without what compressors share; and the difference alone ranks held-out texts."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where(common.bucket_of("doc_id") != 2), labels.where(common.bucket_of("doc_id") != 2))
    rows = docs.join(labels, "doc_id").where(common.bucket_of("doc_id") == 2).toPandas()
    texts = [(t or "").encode() for t in rows.text]
    x = quality.measures(texts, model.compressors())
    size = lambda t, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    for t, (d, one) in list(zip(texts, x))[:40]:
        assert one == 1 and abs(d - (size(t, model.bad) - size(t, model.good)) / (len(t) + quality.PRIOR) ** 0.5) < 1e-12
    assert x.shape[1] == 2 and auc(x[:, 0], (rows.quality == 1).to_numpy()) > 0.95
    assert (np.argsort(model.score(x), kind="stable") == np.argsort(x[:, 0], kind="stable")).all()


def test_quality_of_repeated_rows(spark):
    """Repeated ids teach by the text that sorts first, whatever the order of rows; equal texts have equal scores."""
    good, bad = [f"a fine sentence number {i} of plain words" for i in range(20)], [f"buy buy {i} click click {i} now now" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(3, "zzz zzz"), (25, None), (25, "")]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] * 2, "doc_id long, quality int")
    one, other = (quality.fit(documents(spark, r), labels) for r in (rows, rows[::-1]))
    assert one.good == other.good and one.bad == other.bad and (one.weights == other.weights).all()
    got = quality.scored(documents(spark, rows + rows), one).collect()
    assert len({(r.text or "", r.quality_score) for r in got}) == len({t or "" for _, t in rows})


def test_quality_without_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert {r.quality_score for r in got} == {0.5} and len(got) == docs.count()
    assert quality.scored(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def test_calibration_finds_the_curve():
    rng = np.random.default_rng(0)
    x = np.stack([rng.normal(size=4000), np.ones(4000)], axis=1)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 1)))).astype(float)
    assert np.abs(quality.logistic(x, y, np.ones(4000)) - [3, -1]).max() < 0.3


def brute(x, ids, q, k=5):
    s = neighbours.cosines(x, x[q])
    s[ids == ids[q]] = -9
    order = np.lexsort((ids, -s))[: min(k, (s > -9).sum())]
    return ids[order].tolist(), s[order]


def recall(got, x, ids):
    hits = total = 0
    for q, g in got.groupby("query_id"):
        want, score = brute(x, ids, int(np.flatnonzero(ids == q)[0]))
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 5
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and (g.score.to_numpy() <= score + 1e-12).all()
    return hits / total


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    t = table.toPandas()
    x, ids = neighbours.scaled(np.stack(t.embedding.to_numpy()).astype(float)), t.vec_id.to_numpy()
    got = neighbours.search(table, F.col("vec_id") % 10 == 0).toPandas().sort_values(["query_id", "rank"])
    assert recall(got, x, ids) >= 0.9


def clustered(n, seed=0, dimension=32):
    """Vectors in 20 loose clusters, so that lists of an index over them are long."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(20, dimension))[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, dimension))


def test_codes_choose_the_candidates_of_long_lists():
    x = neighbours.unit(clustered(12_000))
    ids, asked = np.arange(len(x)), np.arange(0, 12_000, 100)
    codec = neighbours.fit(x[:4000], 20)
    lists = codec.lists(x)
    assert np.bincount(lists).max() > 500
    codes = codec.codes(x, lists)
    keep = neighbours.reranked(len(x))
    assert keep < 0.05 * len(x)

    def found(codes):
        name, own, _ = neighbours.scanned(codec, 8, keep, ids, lists, codes, codec.bias(lists, codes), asked, x[asked])
        return {q: set(own[name == q].tolist()) for q in asked.tolist()}

    mine, blind = found(codes), found(np.zeros_like(codes))
    hits = lost = 0
    for q in asked.tolist():
        want, _ = brute(x, ids, q)
        hits, lost = hits + len(set(want) & mine[q]), lost + len(set(want) & blind[q])
        assert len(mine[q]) == keep and q not in mine[q]
    assert hits / (5 * len(asked)) >= 0.9 and lost < 0.8 * hits


def test_distances_by_table_are_those_to_the_coded_vectors():
    x = neighbours.unit(clustered(600, 1))
    codec = neighbours.fit(x, 10)
    lists = codec.lists(x)
    codes = codec.codes(x, lists)
    whole = codec.centroids[lists] + np.concatenate([book[codes[:, p]] for p, book in enumerate(codec.books)], axis=1)
    want = ((x[None, :40] - whole[:, None]) ** 2).sum(axis=2)
    got = codec.distances(x[:40], lists, codes, codec.bias(lists, codes))
    assert np.abs(got + 1 - want).max() < 1e-4  # unit queries have a square of 1


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_ties_and_odd_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(neighbours, "SHARD", most)
    monkeypatch.setattr(neighbours, "CHUNK", most)
    rows = [(i, [1.0, 2.0, 0.0]) for i in (7, 50, 3, 12, 1, 9, 100)] + [(20, [0.0, 1.0, 0.0]), (21, None), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 0.0]), (24, [float("nan"), 1.0, 0.0]), (25, [float("inf"), 1.0, 0.0]), (26, [1.0]), (None, [1.0, 2.0, 0.0]), (3, [1.0, 2.0, 0.0]), (30, [2e300, 1e300, 0.0])]
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, list int, score double")
    got = neighbours.search(table, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 50].vec_id.tolist() == got[got.query_id == 100].vec_id.tolist() == [1, 3, 7, 9, 12]
    other = [(r.query_id, r.vec_id) for r in neighbours.search(table.union(spark.createDataFrame([(150, [2.0], 0, 0.0)], table.schema)), F.col("vec_id") % 50 == 0).collect() if r.query_id == 150]
    assert other == [(150, 26)]  # vectors of another length are neighbours of each other
    few = neighbours.search(table.where("vec_id in (20, 50)"), F.col("vec_id") == 50).collect()
    assert [(r.vec_id, r.rank) for r in few] == [(20, 1)]
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(table.where("vec_id = 50"), F.lit(True)).count() == 0


