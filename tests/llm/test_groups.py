"""Operators 3, 5, 6 and 10 against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import neardup as N
from hindcast.llm import rules as R
from hindcast.llm import sharding as X
from hindcast.llm import simhash as M
from hindcast.llm.graph import components

WS = " \t\n\x0b\f\r"


def words_of(text):
    return [w for w in "".join(" " if c in WS else c for c in text).split(" ") if w]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, edited copies, short and empty texts, nulls, clashing columns."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(make(r.randint(12, 60))) + "." for _ in range(60)]
    hot = make(80)
    for _ in range(60):  # a group of near copies of one text
        w = list(hot)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0]] * 20 + ["", " \n\t ", "One", "one", "one two", "ONE  two", "a b", "repeat it again now " * 30,
                                "### $$$ |||" * 20, texts[3] + "\n" + texts[3], "É É é é", "x " * 4000]
    rows = [(n * 3, t, ["en", None, "de"][n % 3 % 2], f"s{n % 4}") for n, t in enumerate(texts)]
    rows += [(None, texts[1], "en", "s1"), (None, None, None, None), (9_000, None, "en", "s1"), (0, texts[0], "en", "s0"), rows[2], rows[2]]
    return spark.createDataFrame([(*x, 1, 2.0, "k", 5) for x in rows],
                                 "doc_id long, text string, lang string, source string, kept int, node double, key string, n int")


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(w)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(sets, percent=80):
    """Root (least number) of every set of a list, by all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, corpus, width):
    rows = [d for d in corpus.collect() if d.doc_id is not None]
    sets = [shingles(d.text, width) for d in rows]
    roots = linked(sets)
    first = {}
    for d, root in zip(rows, roots):
        first[root] = min(first.get(root, d.doc_id), d.doc_id)
    want = sorted((d.doc_id, len(s), first[k] if s else d.doc_id, (first[k] if s else d.doc_id) == d.doc_id)
                  for d, s, k in zip(rows, sets, roots))
    got = N.near_duplicates(spark, corpus, width).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert len(got) == corpus.count()


def test_first_of_each_keeps_columns(spark, corpus):
    out = N.first_of_each(spark, corpus, 2)
    assert out.columns == corpus.columns
    kept = {r.doc_id for r in N.near_duplicates(spark, corpus, 2).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == kept
    assert N.near_duplicates(spark, corpus.limit(0)).count() == 0


def test_links_in_buckets_beyond_the_hubs(spark, monkeypatch):
    """Blocks of two rows: every pair of a bucket is met though no task holds a bucket."""
    monkeypatch.setattr(N, "BLOCK", 2)
    r = random.Random(8)
    w = [f"w{n}" for n in range(400)]
    base = [r.choice(w) for _ in range(120)]
    texts = []
    for k in range(30):
        t = list(base)
        for _ in range(4 + k // 2):
            t[r.randrange(120)] = r.choice(w)
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = linked([shingles(t, 2) for t in texts])
    got = {d.doc_id: d.component_id for d in N.near_duplicates(spark, docs, 2).collect()}
    assert [got[n] for n in range(30)] == want


def test_estimate_is_near_the_similarity():
    s, k = N.Shingles(2, 0), N.Sketch(0)
    r = random.Random(9)
    for share in (0.0, 0.5, 0.8, 1.0):
        a = [f"a{r.random()}" for _ in range(3000)]
        b = a[:int(len(a) * share)] + [f"b{r.random()}" for _ in range(len(a) - int(len(a) * share))]
        x, y = s.of(" ".join(a)), s.of(" ".join(b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        p, q = k.of(x)[1], k.of(y)[1]
        equal = sum(((int(u) ^ int(v)) >> n) & 15 == 0 for u, v in zip(p, q) for n in range(0, 64, 4)) / N.HASHES
        assert abs((equal - 1 / 16) / (15 / 16) - true) < 0.15


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + n, 1001 + n) for n in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = collections.defaultdict(set)
    for n in got:
        groups[got[n]].add(find(n))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(n) for n in got})
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def base_counts(text):
    w = words_of(text or "")
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k:k + 5])] > 1:
            covered |= set(range(k, k + 5))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_base_counts(spark, corpus):
    got = R.quality_rules(spark, corpus).collect()
    want = []
    for d in corpus.collect():
        c = base_counts(d.text)
        want.append((d.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert R.quality_rules(spark, corpus.limit(0)).count() == 0


def test_rules_reject_outliers_of_a_group_only(spark):
    r = random.Random(4)
    line = lambda lang: " ".join("".join(r.choice("abcde" if lang == "x" else "vwxyzuuuu") for _ in range(
        r.randint(2, 7) if lang == "x" else r.randint(6, 14))) for _ in range(60)) + "."
    rows = [(n, line("x"), "x", "a") for n in range(200)] + [(1000 + n, line("y"), "y", None) for n in range(200)]
    odd = [(2000 + n, " ".join(f"{w}###" for w in line("x").split()), "x", "a") for n in range(30)]
    few = [(3000, " ".join(f"{w}###" for w in line("x").split()), "z", "tiny")]
    docs = spark.createDataFrame(rows + odd + few, "doc_id long, text string, lang string, source string")
    kept = {d.doc_id: d.kept for d in R.quality_rules(spark, docs).collect()}
    assert all(kept[i] for i, *_ in rows) and not any(kept[i] for i, *_ in odd)
    assert kept[3000]  # too few rows for a verdict
    out = R.passed(spark, docs.withColumn("kept", F.lit(3)).withColumn("symbols", F.lit("s")))
    assert {d.doc_id for d in out.collect()} == {i for i in kept if kept[i]} and "symbols" in out.columns


def test_rules_pool_small_languages(spark):
    rng = np.random.default_rng(8)
    rows = [(f"l{n % 30}", "s", 400, *map(float, rng.normal(0.3, 0.02, 4))) for n in range(300)]  # thirty languages of ten rows
    rows += [("l0", "t", 400, 3.0, 3.0, 3.0, 3.0)]
    numbers = spark.createDataFrame(rows, "lang_key string, source_key string, n_words long, " + ", ".join(f"{c} double" for c in R.VECTOR))
    pools, parameters = R.fitted(spark, numbers)
    assert {(r.lang_key, r.source_key) for r in parameters.collect()} == {("\0pool", "\0pool")}
    got = R.judged(numbers.withColumn("base_failed", F.lit(False)), pools, parameters).collect()
    assert [r.kept for r in got if r.symbols > 2] == [False] and sum(r.kept for r in got) == 300


def test_rules_subset_has_the_least_determinant(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(0, 1, (400, 4)) @ np.array([[1, .8, 0, 0], [0, .5, .3, 0], [0, 0, 1, .9], [0, 0, 0, .3]])
    junk = rng.normal(0, 0.3, (90, 4)) + [4, -4, 4, -4]  # a cluster that three quarters can leave out
    x = np.vstack([good, junk])
    rows = spark.createDataFrame([("a", "b", *map(float, v), *map(float, np.median(x, 0))) for v in x],
                                 "lang_key string, source_key string, " + ", ".join(f"{c} double" for c in R.VECTOR + [f"m{i}" for i in range(4)]))
    mad = np.median(np.abs(x - np.median(x, 0)), 0)
    spread = spark.createDataFrame([("a", "b", *map(float, mad))], "lang_key string, source_key string, " + ", ".join(f"d{i} double" for i in range(4)))
    got = R._concentrated(spark, rows, spread).first()

    def steps(chosen):  # plain concentration until nothing changes
        while True:
            c = np.cov(x[chosen].T, bias=True) + np.diag((np.array(R.FLOORS) * 0.1) ** 2)
            d = np.einsum("ij,jk,ik->i", x - x[chosen].mean(0), np.linalg.inv(c), x - x[chosen].mean(0))
            after = np.argsort(d, kind="stable")[:len(chosen)]
            if set(after) == set(chosen):
                return np.linalg.slogdet(c)[1]
            chosen = after

    size = int(R.KEPT_SHARE * len(x))
    least = min(steps(chosen) for chosen in [np.arange(size), *(rng.choice(len(x), size, replace=False) for _ in range(30))])
    determinant = sum(2 * np.log(got[f"f{i}{i}"]) for i in range(4))
    assert determinant == pytest.approx(least, abs=0.05)


def test_distance_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    cov = np.cov(x.T) + np.eye(4)
    moments = spark.createDataFrame([tuple(float(v) for v in [*x.mean(0), *(cov[i, j] for i in range(4) for j in range(i + 1))])],
                                    ", ".join([f"t{i} double" for i in range(4)] + [f"c{i}{j} double" for i in range(4) for j in range(i + 1)]))
    factored = R._factored(moments, F.lit(1.0), floors=True)
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in R.VECTOR))
    got = rows.crossJoin(F.broadcast(factored)).select(*R.VECTOR, R._distance("t", "f").alias("d")).collect()
    full = np.linalg.inv(cov + np.diag(np.square(R.FLOORS)))
    for g in got:
        v = np.array(list(g)[:4]) - x.mean(0)
        assert g.d == pytest.approx(v @ full @ v, rel=1e-6)


def test_simhash_query_against_brute_force(spark, tmp_path, corpus):
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(docs.collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in M.op5_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    bits = {i: int(r.fingerprint, 16) for i, r in got.items()}
    by_text = collections.defaultdict(set)
    for k, d in enumerate(rows):
        t, following = d.text or "", rows[(k + 1) % len(rows)]
        edited = t[:len(t) - len(t) // 2] + (following.text or "")[:len(t) // 2]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - (bits[d.doc_id] ^ bits[following.doc_id]).bit_count() / 128
        assert r.near_edited == 1 - (bits[d.doc_id] ^ int(r.edited_fingerprint, 16)).bit_count() / 128
        if edited == t:
            assert r.near_edited == 1
        by_text[t].add(r.fingerprint)
        near = sum((bits[d.doc_id] ^ b).bit_count() <= M.RADIUS for b in bits.values()) - 1
        assert r.n_near == (near if d.doc_id % 20 == 0 else None)
    assert all(len(x) == 1 for x in by_text.values())


def test_simhash_rows_without_order(spark, tmp_path, corpus):
    (tmp_path / "a").mkdir()
    corpus.write.parquet(str(tmp_path / "a/documents.parquet"))
    assert M.op5_simhash(spark, str(tmp_path / "a")).count() == corpus.count()
    corpus.where("doc_id is null").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert M.op5_simhash(spark, str(tmp_path / "b")).count() == 2
    corpus.limit(0).write.parquet(str(tmp_path / "c/documents.parquet"))
    assert M.op5_simhash(spark, str(tmp_path / "c")).count() == 0
    with pytest.raises(ValueError):
        M.neighbours(corpus, corpus, 99)


def test_simhash_search_reaches_six_bits(spark):
    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    base = [r.getrandbits(128) for _ in range(40)]
    prints = [halves(x ^ sum(1 << k for k in r.sample(range(128), bits))) for x in base for bits in range(8) for _ in range(3)]
    asked = spark.createDataFrame([halves(x) for x in base], "hi long, lo long")
    found = M.neighbours(asked, spark.createDataFrame(prints, "hi long, lo long")).collect()
    assert sorted((f.hi, f.lo, f.near) for f in found) == sorted((*halves(x), 21) for x in base)


def test_simhash_query_names_the_near_documents(spark, tmp_path):
    words = [f"word{k}" for k in range(400)]
    copy = " ".join([*words[:-1], "other"])
    docs = [(0, " ".join(words)), (7, copy), (9, copy), (11, " ".join(f"far{k}" for k in range(300)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in M.op5_simhash(spark, str(tmp_path)).collect()}
    far = (int(got[0].fingerprint, 16) ^ int(got[7].fingerprint, 16)).bit_count()
    assert 0 < far <= 6 and got[0].n_near == 2 and got[0].near_ids == f"0:0:1,{far}:7:2"
    assert got[7].near_ids is None


def test_shards_fit_and_split_only_when_too_large(spark, corpus):
    rows = corpus.count()
    for limit in (1, 200, 3000, 10**8):
        got = X.shards(spark, corpus, limit).collect()
        assert len(got) == rows
        by = collections.defaultdict(list)
        for r in got:
            by[(r.depth, r.prefix, r.page)].append(r)
        for group in by.values():
            size = sum(r.n_bytes for r in group)
            assert {r.shard_bytes for r in group} == {size}
            assert size <= limit or len(group) == 1 or len({r.n_bytes for r in group}) == 1
        prefixes = {(r.depth, r.prefix) for r in got}
        for depth, p in prefixes:  # a split bucket was too large: its two halves are
            if 0 < depth < X.HASH_BITS:
                top = [r for r in got if r.depth >= depth and r.prefix >> (r.depth - depth) >> 1 == p >> 1]
                assert sum(r.n_bytes for r in top) > limit
        assert not any((d2, p2) != (d, p) and d2 > d and p2 >> (d2 - d) == p for d, p in prefixes for d2, p2 in prefixes)
    assert X.shards(spark, corpus.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.shards(spark, corpus, 0)


def test_equal_rows_form_a_chain_of_pages(spark):
    docs = spark.createDataFrame([(7, "abc" * 10)] * 100 + [(8, "z")], "doc_id long, text string").repartition(6)
    got = X.shards(spark, docs, 90).collect()
    pages = collections.Counter(r.page for r in got if r.doc_id == 7)
    assert len(got) == 101 and max(pages.values()) == 3 and sorted(pages) == list(range(34))
    assert {r.shard_bytes for r in got if r.doc_id == 7} == {90, 30}
