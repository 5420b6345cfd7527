"""Classifiers: held-out accuracy on invented texts, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolens.llm import langid, quality, toxicity
from cartolens.llm.common import fold


def invented(n, seed=1):
    """(documents, labels): junk is shouted, toxic texts hold words from a short list, languages have their own syllables."""
    rng = random.Random(seed)
    syllables = {"aa": "tor ben al in ost", "bb": "qui leau re ment ou", "cc": "sch ung keit er ver"}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.15
        if toxic:
            for w in rng.sample(["dolt", "rotter", "cretin", "oaf", "twit"], 3):
                words.insert(rng.randrange(len(words)), w)
        text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))
        docs.append((i, text if good else text.upper().replace(" ", "!! "), lang, f"s{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


ODD = [(9001, None, None, None, None), (9002, "", "aa", "s", 0), (9003, "1 2 3", None, None, 5), (None, "some text here", "bb", "s", 14),
    (9004, "tor ben " * 20000, "aa", "s", 160000), (9004, "tor ben " * 20000, "aa", "s", 160000)]


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    docs, labels = invented(700)
    return docs_of([*docs, *ODD]).withColumn("score", F.lit(1)).cache(), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (9002, 1, 0)],
        "doc_id long, quality int, toxic int").cache(), dict((x[0], x) for x in labels)


@pytest.mark.parametrize(("module", "target", "folds", "held"), [(quality, 1, 5, 0), (toxicity, 2, 4, 2)])
def test_binary_models(tables, docs_of, module, target, folds, held):
    docs, labels, truth = tables
    model = module.fit(docs, labels, fold(F.col("doc_id"), folds) != held)
    out = module.scores(docs, model, fold(F.col("doc_id"), folds) == held).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    test = [(r["predicted"], truth[r["doc_id"]][target]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 80 and np.mean([p == y for p, y in test]) > 0.93
    # each row's score is that of its whole text by itself, in this process
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    alone = (lambda x: model.score(x)) if module is quality else (lambda x, index=getattr(model, "open", lambda: None)(): next(iter(index.scores([x])))[0])
    assert all(r["score"] == pytest.approx(alone(texts[r["doc_id"]]), abs=1e-5) for r in out)
    equal = [r["score"] for r in out if r["doc_id"] == 9004]
    assert equal[0] == equal[1]
    none = module.fit(docs, labels.limit(0), None)
    assert {r["score"] for r in module.scores(docs, none, F.lit(False)).collect()} == {0.5}
    name = "quality" if module is quality else "toxic"
    one = module.fit(docs, labels.filter(f"{name} = 1"), None)
    assert all(r["score"] > 0.9 for r in module.scores(docs, one, F.lit(False)).collect())
    assert module.scores(docs_of([]), model, F.lit(False)).collect() == []


def test_quality_filter_keeps_columns(tables):
    docs, labels, truth = tables
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    good = {i for i, (_, q, _) in truth.items() if q}
    assert len(good - {r["doc_id"] for r in kept.collect()}) < 0.02 * len(good)


def test_fm_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 3)).astype(np.float32), np.zeros((1, 1)))
    index, value = np.array([1, 4, 7, 9]), rng.normal(size=4).astype(np.float32)
    pairs = sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert m.margin(index, value) == pytest.approx(0.3 + m.linear[index] @ value + pairs, rel=1e-4)


def test_block_max_search_is_exact(monkeypatch):
    """Against cosines of whole TF-IDF vectors, made word by word from the counts, without index, blocks or matrix product."""
    docs, labels = invented(500, 3)
    rows = [(d[0], x[2], *toxicity.counts(d[1].encode())) for d, x in zip(docs, labels, strict=True)]
    texts = [d[1].encode() for d in docs[:40]] + [b"unknown words only", ("tor ben " * 5000).encode()]
    scored = []
    for common in (2048, 16, 0):
        monkeypatch.setattr(toxicity, "COMMON", common)
        index = toxicity.build(rows, {0: 700, 1: 120}).open()
        weight = dict(zip(index.vocab.tolist(), index.idf.tolist(), strict=True))
        assert len(weight) == len({w for r in rows for w in r[2].tolist()}) and min(weight.values()) > 0

        def unit(words, tf, weight=weight):
            v = {w: (1 + np.log(n)) * weight[w] for w, n in zip(words.tolist(), tf.tolist(), strict=True) if w in weight}
            norm = np.sqrt(sum(x * x for x in v.values()))
            return {w: x / norm for w, x in v.items()}

        examples = {r[0]: unit(*r[2:]) for r in rows}
        for text in texts:
            q = unit(*toxicity.counts(text))
            sims = {i: sum(x * e.get(w, 0.0) for w, x in q.items()) for i, e in examples.items()}
            want = sorted((x for x in sims.values() if x > 0), reverse=True)[:7]
            at, value = index.vector(*toxicity.counts(text))
            found, got = index.nearest(at, value, 7) if len(at) else (at, value)
            assert np.allclose(got, want, atol=1e-5) and np.allclose([sims[i] for i in index.ids[found].tolist()], want, atol=1e-5)
        scored.append([s for s, _ in index.scores(texts)])
    assert np.allclose(scored[0], scored[1], atol=1e-3) and np.allclose(scored[0], scored[2], atol=1e-3)


def test_languages(tables, docs_of):
    docs, _, _ = tables
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    out = langid.predictions(docs, model, fold(F.col("doc_id"), 3) == 1).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [(r["lang_pred"], r["lang"]) for r in out if r["held_out"] and (r["doc_id"] or 0) < 9000]
    assert len(test) > 150 and np.mean([p == y for p, y in test]) > 0.97
    odd = {r["doc_id"]: r["lang_pred"] for r in out}
    assert odd[9001] == odd[9002] == odd[9003] == "und" and odd[9004] == "aa"
    none = langid.fit(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predictions(docs, none, F.lit(False)).collect()} == {"und"}
    assert langid.predictions(docs_of([]), model, F.lit(False)).collect() == []


def test_decoding_takes_the_nearest_codeword(tables):
    """Each text's prediction against every codeword's weighted loss, bit by bit."""
    docs, _, _ = tables
    model = langid.fit(docs)
    for text in [d[1] for d in invented(40, 9)[0]] + ["zz top", "é", "tor qui sch " * 50]:
        margin = langid.grams(text.encode()) @ model.weights + model.bias
        losses = [sum(float(v) * np.log1p(np.exp(-c * m)) for c, m, v in zip(word, margin.tolist(), model.importance, strict=True)) for word in model.code.tolist()]
        share = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        name, score, unsure = model.predict(text.encode())
        assert name == model.languages[int(np.argmin(losses))] and score == pytest.approx(share.max(), abs=1e-4) and unsure == (score < langid.SURE)


def test_many_languages_need_no_more_rows(docs_of):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3}{i % 61} word" * 4, f"l{i % 61}", "s", 9) for i in range(610)] + [(5000, "same text", "l1", "s", 9)] * 50
    model = langid.fit(docs_of(rows), per_language=4)
    assert 30 < len(model.languages) <= 61


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1} and len({tuple(r) for r in code}) == n
