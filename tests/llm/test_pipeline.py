"""The pipeline's stages against brute force on their own inputs, and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import SF, documents, odd_documents
from test_nearcopies import smallest
from test_texts import assign_value, base_spans, contaminated
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwright import session

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def planted(spark):
    """The driver's documents, and some that stages must act on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = docs.orderBy("doc_id").first().text
    own = "token=Zq8r4Lm2Xv7Kp1Tn"
    extra = [(900_001, "123 456 !", "en", "s1", 9), (900_002, None, "en", "s1", None), (900_003, base, "fr", "s2", 1), (900_004, item, "en", "s1", 1), (900_005, f"a text that has {own} in it", "en", "s3", 1)]
    return docs.union(spark.createDataFrame(extra, docs.schema))


def test_each_stage(spark):
    docs = session.save(planted(spark), "test")
    before = rows(docs)

    after = rows(STAGES["language_id"](spark, docs, SF))
    assert set(before) - set(after) == {i for i, r in before.items() if not any(map(str.isalpha, r.text or ""))}

    after = rows(STAGES["simhash_near_dedup"](spark, docs, SF))
    assert set(after) == set(smallest([(i, r.text) for i, r in before.items()])) and 900_003 not in after

    after = rows(STAGES["benchmark_decontamination"](spark, docs, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in before.items():
        n, hit, _ = contaminated(r.text, items)
        assert (i not in after) == (hit > 0 and 20 * hit >= n)
    assert 900_004 not in after

    after = rows(STAGES["secret_redaction"](spark, docs, SF))
    first, texts = {}, defaultdict(set)  # copies of a text are one text of the least owner
    for r in before.values():
        first[r.text] = min(first.get(r.text, r.source), r.source)
    for r in before.values():
        for a, kind, b in base_spans(r.text):
            texts[assign_value(r.text[a:b]) if kind == 0 else r.text[a:b]].add(r.text)
    for i, r in before.items():
        text, cut = r.text, []
        for a, kind, b in base_spans(text):
            value = assign_value(text[a:b]) if kind == 0 else text[a:b]
            if len({first[t] for t in texts[value]}) <= 2 and len(texts[value]) <= 10 and len(value) >= 12 and len(set(value)) >= 6:
                cut.append((b - len(value), b))
        for a, b in sorted(set(cut), reverse=True):
            text = text[:a] + "<secret>" + text[b:] if text[a:b] == r.text[a:b] else text
        assert after[i].text == text and after[i].n_chars == (None if text is None else len(text))
    assert after[900_005].text == "a text that has token=<secret> in it"

    after = rows(STAGES["bpe_tokens"](spark, docs, SF))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(after) == set(before)
    for i, r in before.items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert after[i].n_tokens == len(ids) and after[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert after[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_keeps_columns_between_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        docs = session.save(out, "test")
    assert rows(corpus_pipeline.run(spark, SF)).keys() == rows(docs).keys()


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def letters(docs):
    return [(i, t) for i, t in texts(docs) if any(map(str.isalpha, t or ""))]


@pytest.mark.parametrize("known", [True, False])
def test_language_keeps_every_document_with_a_letter(spark, known):
    """With and without a language to learn; rows too short to tell, repeated, and without an id among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "123 456 !", None, "s1", 9), (900_002, None, "en", "s1", None), (900_003, "", "fr", "s2", 1), (None, "a", "en", "s1", 1), (900_005, "é", None, "s3", 1), (900_005, "é", None, "s3", 1)], docs.schema)
    docs = docs.union(extra)
    if not known:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    out = STAGES["language_id"](spark, docs, SF)
    assert texts(out) == letters(docs) and out.columns == docs.columns
    assert out.where("lang is null").count() == (0 if known else out.count())


def test_language_fills_what_is_missing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    want, got = ({r.doc_id: r.lang for r in x.collect()} for x in (docs, STAGES["language_id"](spark, some, SF)))
    assert set(got) == {i for i, _ in letters(docs)} and sum(want[i] == k for i, k in got.items()) > 0.97 * len(got)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    want = {
        # a long text of the held-out bucket, none of whose n-grams were learned, is of no known language
        "language_id": [(i, t) for i, t in letters(odd) if i is None or zlib.crc32(str(i).encode()) % 4 != 2 or len(t) < 30],
        # null, "" and blanks are texts without words; rows of one id stay together, and rows without one are compared with none
        "simhash_near_dedup": [(i, t) for i, t in texts(odd) if i not in (1, 2)],
        "benchmark_decontamination": texts(odd),
        "secret_redaction": texts(odd),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = session.save(stage(spark, odd, SF), "test")
        if name == "bpe_tokens":
            assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(i for i, _ in texts(odd) if i is not None)
        else:
            assert (name, texts(out)) == (name, want[name]) and out.columns == odd.columns
        assert stage(spark, documents(spark, []), SF).count() == 0
