"""The pipeline's stages against plain versions, on the smallest tables and on odd rows."""

import re

import corpus_pipeline
from linkforge.llm import language_id, quality, queries
from linkforge.llm.queries import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_near_texts import brute

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_run_is_the_plain_pipeline(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality.train(docs, table(spark, SF, "labels"))
    good = [(n, t) for n, t in rows if quality.tails(model, [t or ""], 1.0)[1][0] >= 0.5]
    left = docs.filter(F.col("doc_id").isin([n for n, _ in good]))
    known = language_id.train(left)
    floor = language_id.floors(left, known)

    def certain(text):
        best, score, mean = language_id.judge(known, [text or ""])
        return re.search(r"[^\W\d_]", text or "") and score[0] >= 0.5 and mean[0] >= floor[best[0]]

    told = [(n, t) for n, t in good if certain(t)]
    first = {}
    for n, t in sorted(told):
        first.setdefault(norm(t), (n, t))
    unique = sorted(first.values())
    kept = {n for n, x in brute(unique).items() if n == x}
    library = Tokenizer.from_file(queries.vocabulary())
    length = {n: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for n, t in unique if n in kept}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == length and 0 < len(kept) < len(rows)


def test_stages_take_odd_rows_and_keep_columns(spark):
    schema = "doc_id bigint, text string, lang string, _key string, _nth string, _row string, _id string, id bigint, h string, grams string, label string"
    rows = [(1, None), (2, ""), (3, "a plain text"), (3, "a plain text"), (4, "a  plain text"), (None, "no id"), (None, "no id"), (5, "word " * 250_000), (6, "other words here")]
    docs = spark.createDataFrame([(n, t, "en", "k", "n", "r", "i", 1, "h", "g", "l") for n, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert {r["_key"] for r in out.collect()} <= {"k"}
    kept = sorted(((r["doc_id"], norm(r["text"])) for r in corpus_pipeline.exact_stage(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, ""), (3, "a plain text"), (None, "no id"), (5, "word " * 250_000), (6, "other words here")], key=str)
    near = sorted((r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SF).collect()), key=str)
    assert near == sorted([1, 3, 3, None, None, 5, 6], key=str)
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {n for n, _ in rows}
