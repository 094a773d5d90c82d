"""Each operator against a plain version on small rows with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from linkforge.llm import language_id, packing, quality, toxicity
from linkforge.llm.bpe import Encoder, bpe_decode, bpe_encode
from linkforge.llm.exact_dedup import build_directory, exact_dedup
from linkforge.llm.graph import components
from linkforge.llm.itq import near_vectors
from linkforge.llm.queries import vocabulary
from linkforge.llm.simhash import near_duplicates, near_pairs
from linkforge.llm.url_filter import url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string"


def docs_of(spark, texts):
    return spark.createDataFrame([(n, t, "en", "s", None, "x") for n, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "a  b"), (6, "a\nb"), (7, "a b"), (7, "a b"), (8, "é" * 5000), (9, "word " * 3000)]


def test_exact_dedup(spark):
    got = exact_dedup(docs_of(spark, ODD)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(r["doc_id"] for r in got) == sorted(n for n, _ in ODD)
    for r in got:
        t = norm(dict(ODD)[r["doc_id"]])
        same = [n for n, x in ODD if norm(x) == t]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(same), len(same), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 3, 4, 8, 9]
    assert exact_dedup(docs_of(spark, [])).collect() == []


def test_repeated_smallest_row_stays_once(spark):
    got = exact_dedup(docs_of(spark, [(1, "a"), (1, "a"), (2, "a")])).collect()
    assert [r["kept"] for r in got].count(True) == 1


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(0)
    counts = {rng.randrange(1 << 8): rng.randint(1, 9) for _ in range(90)}
    d = build_directory(counts, 12, 8)
    load = {}
    for fine, n in counts.items():
        b = d.buckets[fine >> (8 - d.depth)]
        load[b] = load.get(b, 0) + n
    assert all(n <= 12 or d.local_depths[b] == 8 for b, n in load.items())
    assert list(d.buckets) == sorted(d.buckets)


def test_url_filter(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "block")]
    urls = ["http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://notexample.com/en/", "http://a.b.net/es/1", "http://net/es", "x.com/", None, "", "ftp://h?x/y", "http://com//", "http://a.net/es/1"]
    pages = spark.createDataFrame([(n, u, "b") for n, u in enumerate(urls)] + [(0, urls[0], "b")], "page_id bigint, url string, rule string")

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = None
        for rule, action in rules[:-1]:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = (rule, action)
        return host, path, *(best or (None, "allow"))

    listed = spark.createDataFrame(rules, "rule string, action string")
    for bound in (1 << 20, 0):
        got = url_filter(pages, listed, max_broadcast_bytes=bound).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]])
    assert {r["verdict"] for r in url_filter(pages, listed.limit(0)).collect()} == {"allow"}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_bpe_matches_the_library(spark, library):
    rng = random.Random(5)
    bits = ["a", " the", "  ", "\n", "\n\n", "\t", "'s", "é", "日本", "22", "!!", "<|endoftext|>", " ", "\r\n", "_", "aaaa", " word"]
    texts = [(n, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for n in range(300)] + [(900, None), (901, "x" * 20000), (902, " \n" * 3000)]
    coded = bpe_encode(docs_of(spark, texts), vocabulary(), decode=True)
    back = {r["doc_id"]: r["text"] for r in bpe_decode(coded, vocabulary()).collect()}
    for r in coded.collect():
        text = dict(texts)[r["doc_id"]] or ""
        assert list(r["ids"]) == library.encode(text, add_special_tokens=False).ids
        assert r["decoded"] == text == back[r["doc_id"]]


def test_merge_loop_gives_the_same_ids(library):
    a, b = Encoder(vocabulary()), packing.MergingEncoder(vocabulary())
    for text in ("Hello, world!\nIt's 1234  x", "ünïcödé " * 20, "<|endoftext|>a", "z" * 5000):
        assert a.encode(text).tolist() == b.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark, library):
    texts = [(n, "word " * (37 * n % 900)) for n in range(40)] + [(50, None), (51, "long text " * 3000), (52, "")]
    got = packing.pack(docs_of(spark, texts), vocabulary(), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for n, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[n], key=lambda r: r["piece"])
        assert [i for p in pieces for i in p["ids"]] == ids
        assert all(p["length"] == 2048 for p in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= 2048)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r["length"] for r in got) // 2048) + 1


@pytest.mark.parametrize("n,most", [(50, 2048), (3000, 2048), (400, 700)])
def test_plans_hold_every_piece(n, most):
    rng = random.Random(n)
    lengths = {}
    for _ in range(n):
        k = rng.randint(1, most)
        lengths[k] = lengths.get(k, 0) + 1
    got = {}
    for pattern, times in packing.plan(lengths):
        assert sum(pattern) <= 2048
        for k in pattern:
            got[k] = got.get(k, 0) + times
    assert got == lengths


def union(ids, edges):
    p = {i: i for i in ids}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(n, n + 1) for n in range(300, 330)]
    want = union({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_near_pairs_by_bit_planes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = np.array([int(base[rng.integers(12)]) ^ (1 << int(rng.integers(64))) for _ in range(400)], np.uint64)
    group, side = np.sort(rng.integers(0, 5, 400)), np.full(400, 2)
    got = {(int(i), int(j)) for a, b in near_pairs(group, side, values) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert got == want


def test_simhash_components(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(6)]
    texts = list(ODD)
    for n in range(60):
        t = base[n % 6].split()
        for _ in range(n % 3):
            t[rng.randrange(len(t))] = "Changed"
        texts.append((100 + n, " ".join(t)))

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {n: fp(t) for n, t in texts}
    ids = list(prints)
    want = union(ids, [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    got = near_duplicates(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def test_vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for n in range(400):
        v = rng.normal(size=16)
        rows.append((2 * n, n % 2, v.tolist()))
        rows.append((2 * n + 1, n % 2, (v + rng.normal(size=16) * 0.04 * (n % 3)).tolist()))
    rows += [(5000, 0, None), (5001, 0, [0.0] * 16), (5002, 0, [float("nan")] * 16), (5003, None, rows[0][2]), (5004, 0, rows[0][2]), (5005, 0, [None] * 16), (5006, 0, [1.0]), (5007, 1, rows[0][2])]
    frame = spark.createDataFrame([(a, b, c) for a, b, c in rows], "vec_id bigint, label int, embedding array<float>")
    sound = [(i, lab, np.array(np.float32(v), float)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    edges = [
        (a, b) for n, (a, la, x) in enumerate(sound) for b, lb, y in sound[n + 1 :]
        if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    ]
    want = union([r[0] for r in rows], edges)
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    assert set(got) == {r[0] for r in rows}
    linked = sum(got[i]["n_links"] for i in got)
    assert linked <= 2 * len(edges) and linked >= 0.9 * 2 * len(edges)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) >= 0.98
    assert got[5001]["n_links"] == got[5003]["n_links"] == got[5006]["n_links"] == 0 and got[5000]["kept"]


def test_language_id(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "and", "house", "with"], "de": ["der", "und", "haus", "mit"], "fr": ["le", "et", "maison", "avec"]}
    rows = [(n, " ".join(rng.choices(vocab[x], k=20)), x, "s", None, "") for n, x in enumerate(list(vocab) * 30)]
    rows += [(1000, None, "en", "s", None, ""), (1001, "12 !!", None, "s", None, ""), (1002, "", "de", "s", None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs.filter("doc_id % 3 <> 1 or doc_id < 30"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows if r[0] < 1000)
    assert {got[n]["lang_pred"] for n in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_quality_grades_are_ordered(spark):
    rng = random.Random(8)
    rows, grades = [], []
    for n in range(300):
        g = n % 3
        rows.append((n, " ".join(rng.choice(["good", "plain", "text", "words"]) + "!!" * (rng.random() > g / 2) for _ in range(40)), "en", "s", None, ""))
        grades.append((n, g))
    rows += [(900, None, "en", "s", None, ""), (901, "", "en", "s", None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.train(docs, spark.createDataFrame(grades, "doc_id bigint, quality int"))
    assert model.grades == (0.0, 1.0, 2.0) and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.rate(docs, model, 1.0).collect()}
    mean = [np.mean([got[n]["expected_grade"] for n, g in grades if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= r["tail_probability"] <= 1 for r in got.values())
    none = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["tail_probability"] for r in quality.rate(docs, none, 1.0).collect()} == {1.0}


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for n in range(400):
        words = [f"v{rng.randrange(40)}{rng.choice('abcdefgh')}x".replace("0", "o") for _ in range(60)]
        words = [re.sub(r"\d", lambda m: "qwertyuiop"[int(m[0])], w) for w in words]
        bad = n % 4 == 0
        for k in range(4 * bad):
            words[(7 * k + n) % 60] = rng.choice(["scoundrel", "wretch"])
        rows.append((n, " ".join(words), "en", "s", None, ""))
        labels.append((n, int(bad)))
    rows += [(900, None, "en", "s", None, ""), (901, "", "en", "s", None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels[:320], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[n] >= 0.5) == bool(t) for n, t in labels)
    assert got[900] == got[901] < 0.5
    none = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int"))
    assert max(r["score"] for r in toxicity.score_toxicity(docs, none).collect()) < 0.5
