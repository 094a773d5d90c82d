"""Each registered query on the smallest tables, against plain versions, and the classifiers' odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from linkforge.llm import features, language_id, quality, queries, simhash, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_toxicity_counts import plain_differences

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = [r.asDict() for r in read("documents").collect()]
    labels = {r["doc_id"]: r for r in read("labels").collect()}
    return docs, labels


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_bucket(gram, bits):
    """features.ngrams() of one n-gram, in whole numbers."""
    h = [ord(c) * 0x9E3779B1 & MASK for c in gram]
    n = len(gram)
    mixed = h[-1]
    for k in range(1, n):
        mixed = (mixed ^ (h[-1 - k] * (2 * k + 1) & MASK)) * 0x01000193 & MASK
    mixed = mixed + (n * 0x85EBCA6B & MASK) & MASK
    mixed ^= mixed >> 15
    return (mixed * 0x2C1B3C6D & MASK) >> (32 - bits)


def grams(text):
    """All n-grams that end in a text, which two line ends stand before and after."""
    padded = "\n\n" + text.lower() + "\n\n"
    return [plain_bucket(padded[i - n + 1 : i + 1], language_id.BITS) for n in (1, 2, 3) for i in range(2, len(padded))]


def test_language_is_that_of_a_plain_naive_bayes(spark, tables):
    docs, _ = tables
    counts, rows = {}, Counter()
    for d in docs:
        if crc(d["doc_id"], 3) != 1 and d["lang"] is not None and d["text"] is not None:
            counts.setdefault(d["lang"], Counter()).update(grams(d["text"]))
            rows[d["lang"]] += 1
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    width, langs = 1 << language_id.BITS, sorted(counts)
    total = {x: sum(counts[x].values()) + language_id.SMOOTHING * width for x in langs}
    right = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (crc(d["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        if d["text"] is None or not regex.search(r"\p{L}", d["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = Counter(grams(d["text"]))
        score = {x: np.log(rows[x] / sum(rows.values())) + sum(k * np.log((counts[x][b] + language_id.SMOOTHING) / total[x]) for b, k in own.items()) for x in langs}
        assert r["lang_pred"] == max(langs, key=lambda x: score[x])
        right += r["lang_pred"] == d["lang"]
    assert right >= 0.95 * sum(d["lang"] is not None and d["text"] is not None for d in docs)


def test_toxicity_is_that_of_a_plain_model(spark, tables):
    docs, labels = tables
    named = spark.createDataFrame([(d["doc_id"], d["text"] or "") for d in docs], "id bigint, t string")
    fold = {r["id"]: r["f"] for r in named.select("id", F.pmod(F.shiftright(F.xxhash64("t"), 7), F.lit(5)).alias("f")).collect()}
    learned = [d for d in docs if d["doc_id"] in labels and crc(d["doc_id"], 5) != 0]
    of = lambda d: int(labels[d["doc_id"]]["toxic"] > 0)
    known = plain_differences([(d["text"], of(d)) for d in learned if fold[d["doc_id"]] > 0])

    def compare(text):
        words = toxicity.words_of(text or "")
        mean = sum(known.get(w, 0.0) ** toxicity.POWER for w in words) / max(1, len(words))
        return np.sign(mean) * abs(mean) ** (1 / toxicity.POWER)

    curve = [d for d in learned if fold[d["doc_id"]] == 0]
    slope, middle = toxicity.logistic(np.array([compare(d["text"]) for d in curve]), np.array([of(d) for d in curve]))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = 1 / (1 + np.exp(-np.clip(slope * (compare(d["text"]) - middle), -40, 40)))
        r = got[d["doc_id"]]
        assert abs(r["score"] - want) < 1e-3 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc(d["doc_id"], 5) == 0)


def test_quality_scores_are_those_of_the_features(spark, tables):
    docs, labels = tables
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet").filter(queries.id_remainder(5) != 0))
    assert model.grades == (0.0, 1.0)
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        tail = 1 / (1 + np.exp(model.thresholds[0] - float(quality.feature_rows([d["text"] or ""])[0].astype(float) @ model.weights)))
        r = got[d["doc_id"]]
        assert abs(r["tail_probability"] - tail) < 1e-3 and abs(r["expected_grade"] - r["tail_probability"]) < 1e-9
        assert r["kept"] == (r["tail_probability"] >= 0.5) and r["held_out"] == (crc(d["doc_id"], 5) == 0)
    judged = [(got[i]["kept"], bool(x["quality"])) for i, x in labels.items() if i in got]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_bpe_and_packing_are_the_librarys(spark, tables):
    docs, _ = tables
    library = Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    library.no_padding()
    ids = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids for d in docs}
    for r in queries.op9_bpe(spark, SF).collect():
        own = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    places, covered = {}, Counter()
    for r in queries.op3_best_fit_packing(spark, SF).collect():
        whole = [*ids[r["doc_id"]], 0]
        assert 1 <= r["length"] <= 2048 and (len(whole) > 2048 or (r["start"], r["length"]) == (0, len(whole)))
        cut = np.array(whole[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(cut.tobytes())
        covered[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {n: len(x) + 1 for n, x in ids.items()}
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(covered.values()) // 2048) * 1.02 + 1


def test_simhash_query_is_brute_force(spark, tables):
    docs, _ = tables
    fp = {d["doc_id"]: simhash.fingerprint(d["text"] or "") for d in docs}
    root = {n: n for n in fp}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = queries.op6_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {n: (f"{x:016x}", top(n)) for n, x in fp.items()}
    empty = spark.createDataFrame([], "doc_id bigint, text string, fp string, rep int")
    assert simhash.near_duplicates(empty).collect() == []


def test_embeddings_and_pages_come_back_whole(spark):
    for run, table, key in ((queries.op4_itq_near_dedup, "embeddings", "vec_id"), (queries.op5_warc, "pages", "page_id"), (queries.op1_url_filter, "pages", "page_id")):
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
        assert sorted(r[key] for r in run(spark, SF).collect()) == ids


ODD_SCHEMA = "doc_id bigint, text string, lang string, label string, _grade string, _id string, h string, quality string, at string"


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "the plain house"), (4, "the plain house"), (4, "another text"), (None, "das haus"), (5, "word " * 250_000), (6, "12 34"), (7, "!!")]
    return spark.createDataFrame([(n, t, "en" if n != 7 else None, "l", "g", "i", "h", "q", "a") for n, t in rows], ODD_SCHEMA)


def test_odd_rows_in_the_classifiers(spark):
    docs = odd_docs(spark)
    ratings = spark.createDataFrame([(4, 0, "x"), (5, 1, "x"), (5, 1, "x"), (2, 1, "x"), (None, 1, "x"), (6, None, "x")], "doc_id bigint, quality int, text string")
    model = quality.train(docs, ratings)
    again = quality.train(docs.repartition(3), ratings)
    assert model.grades == (0.0, 1.0) and np.allclose(model.weights, again.weights)
    for frame, n in ((docs, 10), (docs.limit(0), 0)):
        assert len(quality.rate(frame, model, 1.0).collect()) == n
        assert frame.select(quality.tail_probability(spark, model, 1.0)("text").alias("p")).filter("p >= 0 and p <= 1").count() == n
    known = language_id.train(docs)
    for frame, n in ((docs, 10), (docs.limit(0), 0)):
        assert len(language_id.identify(frame, known).collect()) == n
        assert frame.select(language_id.certainty(spark, known)("text").alias("p")).filter("p >= 0 and p <= 1").count() == n
    assert language_id.train(docs.limit(0)).languages == ()


def test_languages_that_were_not_learned_are_under_the_floor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    floor = language_id.floors(docs, model)
    stay = docs.filter("lang is not null and text is not null").filter(language_id.certainty(spark, model, floor)("text") >= 0.5)
    assert stay.count() == docs.filter("lang is not null and text rlike '\\\\p{L}'").count()
    foreign = ["Съешь же ещё этих мягких французских булок", "これは日本語の文章です。とても短いです。", "qzx vvkj qqwx zzkp xjq wvkq zxj"]
    frame = spark.createDataFrame([(t,) for t in foreign], "text string")
    assert frame.filter(language_id.certainty(spark, model, floor)("text") > 0).count() == 0


def test_pieces_of_long_texts_hold_all_characters():
    texts = ["ab" * 700_000, "", "c"]
    pieces = [p for n, held in features.in_pieces(texts) for p in zip(n, held, strict=True)]
    assert all("".join(p for n, p in pieces if n == k) == t for k, t in enumerate(texts))
