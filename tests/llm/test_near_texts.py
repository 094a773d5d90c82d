import random

import pyarrow as pa

import corpus_pipeline
from linkforge.llm.near_texts import near_texts


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = {n: shingles(t) for n, t in texts}
    root = {n: n for n in sets}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in sets:
            both = len(sets[a] | sets[b])
            if a < b and (not both or 5 * len(sets[a] & sets[b]) >= 4 * both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {n: top(n) for n in sets}


def some_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    common = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([1, 4, 6, 25, 90, 400]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy += common.split()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(n, t) for n, t in enumerate([*texts, None, "", "A b c", "a B c"])]


def test_near_texts_are_those_of_brute_force(spark):
    texts = some_texts()
    want = brute(texts)
    assert len(set(want.values())) < len(texts) - 20
    docs = spark.createDataFrame([*texts, (None, "a b c")], "doc_id bigint, text string")
    for block in (1024, 4):
        got = near_texts(docs, block=block).collect()
        assert len(got) == len(texts) + 1
        assert {r["doc_id"]: r["component_id"] for r in got} == {**want, None: None}


def test_near_stage_takes_copies_that_differ_in_a_few_words(spark):
    texts = some_texts()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    stayed = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert stayed == set(brute(texts).values())


def test_simhash_links_come_first_and_are_checked(spark, monkeypatch):
    from linkforge.llm import near_texts as module

    met = []
    plain = module.simhash_pairs
    monkeypatch.setattr(module, "simhash_pairs", lambda *a: met.append(plain(*a)) or met[-1])
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "tail"])), (3, " ".join(reversed(words)))]
    got = near_texts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    assert met[0].count() == 1


def test_workers_get_few_whole_texts_at_once(spark):
    from linkforge.llm import near_texts as module
    from linkforge.llm.storage import materialise

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"]) for b in batches), "id bigint")
    assert {r["id"] for r in materialise(sizes, "sizes", module.TEXT_ROWS)[0].collect()} <= set(range(1, module.TEXT_ROWS + 1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def named_rows(spark, rows):
    return spark.createDataFrame(rows, "key bigint, gram bigint, n int, pos int, cluster bigint")


def test_a_pair_of_two_clusters_counts_at_the_first_shared_shingle(spark):
    from linkforge.llm import near_texts as module

    apart = module.BEFORE + 3
    # 1 and 2 share a run of shingles, 1 and 3 one at the end of as many others that 4 and 5 have.
    rows = [(k, g, 400, g, k) for k in (1, 2) for g in range(40)]
    rows += [(k, 100 * k + g, 400, 40 + g, k) for k in (1, 3) for g in range(apart)] + [(k + 3, 100 * k + g, 9000, g, k + 3) for k in (1, 3) for g in range(apart)]
    rows += [(k, 999, 400, 49, k) for k in (1, 3)]
    signatures = spark.createDataFrame([(k, [0] * 8) for k in range(1, 7)], "key bigint, sig array<bigint>")
    for block in (1024, 1):
        found = module.open_pairs(module.open_rows(named_rows(spark, rows), signatures, block), 0.75).collect()
        assert sorted(map(tuple, found)) == [(1, 2), (1, 3)]


def test_texts_of_a_busy_shingle_are_compared_with_its_largest_cluster(spark, monkeypatch):
    from linkforge.llm import near_texts as module

    rows = [(k, 7, 100, 0, min(k, 6)) for k in range(6, 20)] + [(k, 7, 100, 0, k) for k in range(20, 40)]
    found = module.busy_pairs(named_rows(spark, rows), 0, 0.8).collect()
    assert {r["x"] for r in found} == set(range(20, 40)) and {r["y"] for r in found} <= set(range(6, 20))
    assert 0 < len(found) <= 20 * module.HEADS
    assert module.busy_pairs(named_rows(spark, rows[: 14 + module.BUSY - 1]), 0, 0.8).count() == 0
    texts = some_texts()
    monkeypatch.setattr(module, "BUSY", 1)
    got = near_texts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(texts)


def test_sets_are_handed_back_in_small_batches_and_free_memory_is_given_back(spark, monkeypatch):
    from linkforge.llm import near_texts as module

    class Docs:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    given = []
    monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    run = module.sets_of(Docs(), 5, lambda s: (s,), "grams array<bigint>")
    text = " ".join(str(n) for n in range(module.SLICE_CHARS // 10))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([text] * 8)], ["id", "text"])
    assert [b.num_rows for b in run(iter([batch]))] == [1] * 8 and given == [1]
