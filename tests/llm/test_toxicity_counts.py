from collections import defaultdict

import numpy as np
from linkforge.llm import toxicity

NAMES = [f"{a}{b}{c}" for a in "abcdefgh" for b in "stuvwxyz" for c in "klmn"]


def plain_differences(texts):
    """Kneser-Ney differences by word, with sets and dictionaries."""
    before = [defaultdict(set), defaultdict(set)]
    for text, label in texts:
        words = toxicity.words_of(text or "")
        for a, b in zip(["", *words], words):  # noqa: B905
            before[label][b].add(a)
    n = [{w: len(s) for w, s in b.items()} for b in before]
    total = [sum(x.values()) for x in n]
    weight = max(toxicity.DISCOUNT * len(n[c]) / total[c] for c in (0, 1))
    types = len(n[0]) + len(n[1])
    p = lambda w, c: max(n[c].get(w, 0) - toxicity.DISCOUNT, 0) / total[c] + weight * ((w in n[0]) + (w in n[1])) / types
    return {w: np.log(p(w, 1) / p(w, 0)) for w in {*n[0], *n[1]}}


def bucket_of(word):
    return int(toxicity.buckets(toxicity.hashed([word])[0], toxicity.BITS)[0])


def some_rows():
    rows = [(n, f"plain word {NAMES[n]} here") for n in range(200)] + [(n, f"scoundrel {NAMES[n]} there") for n in range(200, 215)]
    return rows, [(n, int(n >= 200)) for n, _ in rows]


def test_counts_are_of_all_labelled_rows(spark):
    """Ordinary rows count beyond the number of toxic ones and the curve's sample; a fifth of the rows is the curve's."""
    rows, labels = some_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), rows=5)
    assert sum(model.differences[bucket_of(NAMES[n])] < 0 for n in range(200)) > 120


def test_differences_are_those_of_plain_kneser_ney(spark):
    texts = [("the sad clown and the sad clown", 1), ("a clown, a fool", 1), ("the day and the night and a day", 0), ("the sad day", 0), (None, 0), ("x " * 3000, 0)]
    texts += [("the sad clown and the sad clown", 1)] * 5
    rows = spark.createDataFrame([(label, text) for text, label in texts], "label int, text string")
    table = toxicity.context_counts(rows).toArrow()
    got = toxicity.kneser_ney(table.column("bucket").to_numpy(), tuple(table.column(f"n{c}").to_numpy().astype(float) for c in (0, 1)))
    want = plain_differences(texts)
    assert len({bucket_of(w) for w in want}) == len(want)
    for word, x in want.items():
        assert abs(got[bucket_of(word)] - x) < 1e-5, word
    assert np.count_nonzero(got) == len([x for x in want.values() if abs(x) > 1e-9])


def test_scores_are_those_of_the_formula():
    model = toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS, np.float32), 2.0, 0.5)
    model.differences[bucket_of("bad")], model.differences[bucket_of("good")] = 3.0, -1.0
    texts = ["bad good other bad", "", "good", "42", "Bad"]
    mean = np.array([(2 * 3.0**5 - 1) / 4, 0, -1, 0, 3.0**5])
    x = np.sign(mean) * np.abs(mean) ** 0.2
    assert np.allclose(model.compare(texts), x)
    assert np.allclose(model.compare(texts[:1]), x[:1])
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-2 * (x - 0.5))))


def test_rows_of_one_class_give_a_defined_curve(spark):
    assert toxicity.logistic(np.array([1.0, 2.0]), np.array([1, 1])) == (1.0, toxicity.UNFITTED_MIDDLE)
    assert toxicity.logistic(np.zeros(0), np.zeros(0, int)) == (1.0, toxicity.UNFITTED_MIDDLE)
    assert toxicity.logistic(np.array([-2.0, -1.0]), np.array([0, 1])) == (1.0, toxicity.UNFITTED_MIDDLE)
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id bigint, text string")
    for labels in ([(1, 0)], [(1, 1)], []):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(docs, model).collect())


def test_clashing_names_repeats_and_long_texts(spark):
    rows, labels = some_rows()
    schema = "doc_id bigint, text string, label string, _id string, fold string, toxic string"
    wide = spark.createDataFrame([(n, t, "x", "y", "z", "1") for n, t in rows], schema)
    named = spark.createDataFrame([(n, y, "t") for n, y in labels], "doc_id bigint, toxic int, text string")
    model, again = toxicity.train(wide, named), toxicity.train(wide.union(wide), named.union(named))
    assert np.array_equal(model.differences, again.differences) and (model.differences != 0).any()
    texts = [(n, t, "x", "y", "z", "1") for n, t in [(1, "scoundrel " * 150_000), (2, None), (2, None), (None, "scoundrel")]]
    got = toxicity.score_toxicity(spark.createDataFrame(texts, schema), model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 4 and score[1] > 0.5 > score[2] and score[None] > 0.5
    assert toxicity.score_toxicity(wide.limit(0), model).collect() == []
