"""The pipeline's language stage rejects texts of languages that the filter was not learned from, and no other."""

import corpus_pipeline
from helpers import SF

from gridwright.llm.common import bucket_of

STRANGE = ["В начале было слово и слово было у Бога и слово было Бог, всё через него начало быть", "これは学習されていない言語で書かれた文章です。フィルタには含まれていません。", "xq zzkv wqjx pfvq kkzx vvqj xzqw jjkq zxvq qqwx vkzj"]


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [r.id for r in spark.range(900_000, 900_100).where(bucket_of("id") == 2).limit(len(STRANGE) + 1).collect()]
    extra = [(i, t, "en", "s1", len(t)) for i, t in zip(held, [*STRANGE, "Да"])]  # the last is too short to tell
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.union(spark.createDataFrame(extra, docs.schema)), SF).collect()}
    letters = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert kept == letters | {held[-1]}
