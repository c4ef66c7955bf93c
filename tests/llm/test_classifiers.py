"""Operators 1 and 2: machines against brute force, models by held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import quality as Q
from hindcast.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_machine_finds_what_edit_distance_finds():
    terms = {"moron": 3.0, "worthless": 4.0, "scum": 2.0, "lostras*": 5.0, "vequ*": 2.5, "disgusting": 6.0}
    lexicon, r = T.Lexicon(terms), random.Random(1)
    tried = set()
    for _ in range(6000):
        w = list(r.choice([*terms, "thane", "oron", "vequille", "lostrasung"]).rstrip("*"))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k:k + r.randint(0, 1)] = r.choice(["", "a", "s", "x", "é"])
        tried.add("".join(w))
    for w in tried - {""}:
        best = []
        for t in terms:
            body, allowed = t.rstrip("*"), T.Lexicon.edits(t)
            d = min(distance(w[:k], body) for k in range(len(w) + 1)) if t.endswith("*") else distance(w, body)
            if d <= allowed:
                best.append((d, -terms[t], t))
        want = min(best, default=None)
        assert lexicon.match(w) == ((want[2], want[0]) if want else 0), w


def test_disguises_quotes_and_own_words():
    lexicon = T.Lexicon({"idiot": 5.0, "moron": 5.0}, {"oron"})
    weight = lambda text: sum(w for *_, w in lexicon.hits(text))
    assert lexicon.match("1d10t") == ("idiot", 0) and lexicon.match("idiott") == ("idiot", 1)
    assert lexicon.match("oron") == 0 and lexicon.match("moron") == ("moron", 0)
    assert weight('someone wrote "what an idiot" in it') < weight("someone wrote what an idiot in it")
    assert weight("you are an idiot here") > weight("there is an idiot here")
    assert weight("a moron and an idiot") > weight("a moron") + weight("an idiot")
    assert weight("") == weight(" , ") == 0


def toxic_corpus(spark, n=600):
    r = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    copied = " ".join(word() + "zzz" for _ in range(40))
    for i in range(n):
        toxic = i % 8 == 0
        w = [word() for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["moron", "worthless", "lostra" + word()])
        text = " ".join(w)
        if i % 40 == 0:  # one toxic text with near copies, whose other words are no terms
            text = copied + " moron " + word()
        rows.append((i, text, toxic))
        labels.append((i, int(not toxic), int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string, toxic boolean"),
            spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = toxic_corpus(spark)
    model = T.fitted(spark, docs, labels)
    terms = set(model.lexicon.weights)
    assert {"moron", "worthless"} <= terms and any(t.startswith("lostra") for t in terms)
    assert not any("zzz" in t for t in terms)
    got = {r.doc_id: r for r in T.scored(docs, model).collect()}
    for d in docs.collect():
        assert (got[d.doc_id].score >= T.THRESHOLD) == d.toxic
    edge = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (1, "a moroon so worthles", 3.0), (2, "moron " * 20000, 0.0)],
                                 "doc_id long, text string, score double")
    rows = T.scored(edge, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    plain = model.score("")
    assert [r.score for r in rows if not r.hits] == [plain, plain] and model.score("a moroon so worthles") > plain
    assert T.scored(edge.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 60)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = T.fitted(spark, docs, some)
        assert not model.lexicon.weights and 0 <= model.score("moron") == model.score("") <= 1


def test_held_out_rows_teach_nothing(spark):
    docs, labels = toxic_corpus(spark)
    rows = Q.labelled(spark, docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and all(r.fold != 2 for r in rows)


def quality_corpus(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [word() for _ in range(50)]
        if bad:
            w = [x + "###" for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_corpus(spark)
    model = Q.fitted(spark, docs, labels)
    scored = Q.scored(docs, model).withColumn("held_out", Q.held_out(F.col("doc_id"))).collect()
    rest = [r for r in scored if r.held_out]
    assert len(rest) > 80 and all((r.score >= Q.THRESHOLD) == (r.doc_id % 4 != 0) for r in rest)
    edge = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (1, "the " * 30000, 3.0)], "doc_id long, text string, score double")
    rows = Q.scored(edge, model).collect()
    assert len(rows) == 3 and rows[0].score == rows[1].score and all(0 <= r.score <= 1 for r in rows)
    kept = Q.good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if r.score >= Q.THRESHOLD}
    assert Q.scored(edge.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs, labels = quality_corpus(spark)
    model = Q.fitted(spark, docs, labels.limit(0))
    assert {r.score for r in Q.scored(docs, model).collect()} == {0.5} and Q.good(docs, model).count() == docs.count()


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(1)
    truth = rng.normal(0, 1.5, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert Q.temperature(4 * truth, y) == pytest.approx(4, rel=0.25)


def test_pooled_vectors_against_single_items(monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choice("abcdéßA") for _ in range(r.randint(1, 6))) + r.choice(["", "", ",", ".", "9", "--"]) for _ in range(80)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(30)] + ["", "x", "x x x", "-- ### $$", "w" * 3000]
    held = sorted({i for w in words[:30] for i in Q.items(w)})
    vocabulary = {i: n for n, i in enumerate([Q.NEW, Q.SEEN, *held])}
    vectors = np.random.default_rng(1).normal(size=(len(vocabulary), Q.DIMENSIONS))

    def by_hand(text):
        total, seen, w = np.zeros(Q.DIMENSIONS), set(), text.split()
        for k, x in enumerate(w):
            for i in Q.items(x):
                total += vectors[vocabulary[i]] if i in vocabulary else Q.index_vectors([i])[0]
            if k:
                total += vectors[vocabulary[Q.SEEN if (w[k - 1], x) in seen else Q.NEW]]
                seen.add((w[k - 1], x))
        return total / max(1, 3 * len(w))
    want = np.array([by_hand(t) for t in texts])
    assert np.allclose(Q.Reader(vocabulary).pooled(texts, vectors), want)
    assert abs(want[-1]).sum() > 0  # a word that no vocabulary holds counts, whatever its length
    for bound, value in (("CHARS_AT_A_TIME", 40), ("WORDS_KEPT", 3)):
        monkeypatch.setattr(Q, bound, value)
        assert np.allclose(Q.Reader(vocabulary).pooled(texts, vectors), want)


def test_index_vectors_are_sparse_and_their_own():
    names = [f"w:{n}" for n in range(500)]
    x = Q.index_vectors(names)
    assert ((x != 0).sum(axis=1) <= Q.NONZERO).all() and (abs(x).sum(axis=1) > 0).all()
    assert len({row.tobytes() for row in x}) == 500 and (x == np.vstack([Q.index_vectors([n]) for n in names])).all()
    angles = (x @ x.T)[np.triu_indices(500, 1)]
    assert abs(angles.mean()) < 0.02


def test_quotations_over_a_whole_text():
    from hindcast.llm.toxicity import quotations

    def quoted(text):
        return [text[a:b] for a, b in quotations(text)]

    long = "word " * 200 + "end"
    assert quoted(f'She said "{long}" and left.') == [long]
    assert quoted(f"Er rief „{long}“ und «a b» ging; “c ‘d’ e”") == [long, "a b", "c ‘d’ e"]
    assert quoted('a 5" pipe and "this one" too') == ["this one"]
    assert quoted('a stray "mark and "this one" too') == ["this one"]
    assert quoted("don’t ‘it isn’t’ so") == ["it isn’t"]
    assert quoted('') == quoted('"') == quoted('never "ended') == quoted('" "') == []


def test_only_the_quotation_or_the_misspelling_decides():
    import numpy as np

    from hindcast.llm.toxicity import Lexicon, Model

    filler = "plain words stand here " * 20
    model = Model(Lexicon({"grumbold": 5.0}), np.array([-3.0, 1.0, 1.0, 0.5]))
    bare, quoted = f"{filler} grumbold {filler}", f'He wrote "{filler} grumbold {filler.strip()}" once.'
    near, other = f"{filler} grumbild {filler}", f"{filler} grandly {filler}"
    assert model.score(bare) >= 0.3 > model.score(other)
    assert model.score(quoted) < model.score(bare) / 1.5
    weak = Model(model.lexicon, np.array([-5.0, 1.0, 1.0, 0.5]))
    assert weak.score(bare) >= 0.3 > weak.score(quoted)
    assert model.score(near) >= 0.3


def test_logistic_has_no_negative_weight_of_a_hit():
    import numpy as np

    from hindcast.llm.toxicity import logistic

    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.random((400, 3))]
    y = (x[:, 1] - 0.8 * x[:, 2] + 0.1 * rng.standard_normal(400) > 0.2).astype(float)
    w = logistic(x, y, np.array([-4.0, 1.0, 0.8, 0.5]), 1.0)
    assert w[2] == 0 and (w[1:] >= 0).all() and w[1] > 1

    def loss(v):
        z = x @ v
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum((v - [-4.0, 1.0, 0.8, 0.5]) ** 2)

    for k in range(4):
        for d in (-0.05, 0.05):
            v = w + d * np.eye(4)[k]
            if (v[1:] >= 0).all():
                assert loss(v) >= loss(w) - 1e-9
