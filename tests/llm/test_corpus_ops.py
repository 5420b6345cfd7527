"""Mixing, the n-gram join and the pipeline, against brute force."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cartolens.llm import mixing, ngram_join
from cartolens.llm.components import components
from cartolens.llm.common import shared_dir

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id with some words"), (4, "  \n "), (5, "A  a\tA"), (6, "a a a")]


def test_period_is_pfair():
    rng = random.Random(2)
    for _ in range(100):
        w = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        got, total = [0] * len(w), sum(w)
        for t, i in enumerate(mixing.period(w), 1):
            got[i] += 1
            assert all(abs(got[j] - Fraction(w[j] * t, total)) < 1 for j in range(len(w)))
        assert got == w


def test_phases_place_every_block_once():
    rng = random.Random(4)
    for _ in range(30):
        blocks = {f"s{i}" if i else None: rng.randint(1, 400) for i in range(rng.randint(1, 7))}
        plan = mixing.phases(blocks, {s: rng.random() + 0.01 for s in blocks}, 50)
        slots, count = set(), dict.fromkeys(blocks, 0)
        for p in plan:
            for n in range(p.count):
                slots.add(p.start + n // len(p.slots) * p.length + p.slots[n % len(p.slots)])
            count[p.source] += p.count
        assert count == blocks and slots == set(range(sum(blocks.values())))


def test_long_phases_keep_to_unrounded_targets():
    for weights, blocks in (({f"s{i}": 1.0 for i in range(20)} | {"big": 10**0.5}, 3000), ({"few": 0.00005, "most": 0.99995}, 60000),
        ({f"s{i}": 0.667 / 1499 for i in range(1499)} | {"big": 0.333}, 20)):
        total = sum(map(Fraction, weights.values()))
        slots = {}
        for p in mixing.phases({s: blocks for s in weights}, weights):
            for j in range(p.count):
                slots.setdefault(p.source, []).append(p.start + j // len(p.slots) * p.length + p.slots[j % len(p.slots)])
        end = min(x[-1] for x in slots.values())  # the first source runs out
        for s, x in slots.items():
            w = Fraction(weights[s]) / total
            assert all(k < w * (t + 1) < k + 2 and k - 1 < w * t < k + 1 for k, t in enumerate(x) if t <= end)


def test_mix_deviates_by_less_than_a_block(spark, docs_of):
    rng = random.Random(6)
    docs = docs_of([(i, "x" * rng.randint(1, 30), "en", "abc"[min(2, i % 5)], 1) for i in range(1200)])
    weights = {"a": 0.5, "b": 0.2, "c": 0.3}
    rows = mixing.mixed(docs, weights, block=40, total=10).collect()
    assert len(rows) == 1200
    owner = {r["slot"]: r["source"] for r in rows}
    assert all(owner[r["slot"]] == r["source"] for r in rows)  # a slot holds one block
    short = min(max(r["slot"] for r in rows if r["source"] == s) for s in "abc")
    got, share = dict.fromkeys("abc", 0), weights
    filled = {}
    for r in rows:
        filled.setdefault((r["source"], r["block"]), r["slot"])
    starts = sorted((slot, s) for (s, _), slot in filled.items())
    for slot, s in starts:
        if slot >= short - 10:
            break
        got[s] += 1
        if slot + 1 == len(got):
            assert all(abs(got[j] - share[j] * (slot + 1)) < 1 + 1e-9 for j in "abc")


def test_mix_odd_inputs_and_order(spark, docs_of):
    rows = [(i, t, None, s, None) for (i, t), s in zip(ODD, ["a", None, "a", "a", "b", None, "b", "a"], strict=True)]
    docs = docs_of(rows).withColumns({n: F.lit(0) for n in ("slot", "at", "row", "text_hash", "_key")})
    assert mixing.mixed(docs, block=4).count() == len(rows)
    out = mixing.in_order(docs, block=4)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mixed(docs_of([])).count() == 0 and mixing.in_order(docs_of([])).count() == 0
    with pytest.raises(KeyError):
        mixing.mixed(docs, {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"a": 1.0, "b": 0.0, None: 1.0})


def test_mix_places_are_those_of_brute_force(docs_of):
    """Slots and places of all rows against a walk over the sources' texts; null ids, texts longer than a block, tiny weights."""
    rng = random.Random(12)
    rows = [(i if i % 7 else None, "y" * rng.choice([0, 3, 9, 25, 130]) + str(i), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(300)]
    weights = {"a": 1 / 3, "b": 0.0004, "c": 0.5, None: 0.1662667}
    got = {r["text_hash"]: r for r in mixing.mixed(docs_of(rows), weights, block=40, total=10).collect()}
    assert len(got) == len(rows)
    sums, order = {}, {}
    for r in sorted(got.values(), key=lambda r: (r["block"], r["place"])):
        begin = r["block"] * 40 + r["place"]
        assert begin == sums.get(r["source"], 0)  # laid end to end, none left out
        sums[r["source"]] = begin + r["size"]
        order.setdefault((r["source"], r["block"]), r["slot"])
        assert order[r["source"], r["block"]] == r["slot"]
    left = {s: -(-n // 40) for s, n in sums.items()}
    slot, want = 0, {}
    done = dict.fromkeys(left, 0)
    while active := sorted((s for s in left if left[s]), key=lambda s: (s is None, str(s))):
        w = [Fraction(weights[s]) for s in active]
        k, t, total = [0] * len(active), 0, sum(w)
        while True:  # earliest deadline among the blocks released by slot t
            free = [i for i in range(len(active)) if k[i] * total / w[i] // 1 <= t]
            i = min(free, key=lambda i: (-(-(k[i] + 1) * total // w[i]), i))
            if not left[active[i]]:
                break
            want[active[i], done[active[i]]] = slot
            k[i], t, slot = k[i] + 1, t + 1, slot + 1
            left[active[i]] -= 1
            done[active[i]] += 1
    assert {(s, b): x for (s, b), x in order.items()} == {x: want[x] for x in order}


def test_mix_of_many_sources(docs_of):
    out = mixing.mixed(docs_of([(i, "z" * 30, "en", f"s{i % 2500}", 1) for i in range(5000)]), block=20).collect()
    assert len(out) == 5000 and len({r["slot"] for r in out}) == 5000


def brute_components(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in docs]
    head = list(range(len(docs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, len(sets[k]), least.get(find(k)))) for k, (i, _) in enumerate(docs))


def varied(n, seed):
    """Near copies of a few texts at all distances, short ones, chains, and a passage that most share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(n // 12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at:at] = passage
        docs.append((i + 100, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper()))
    return docs


@pytest.mark.parametrize(("cap", "long", "hot"), [(2048, 32, 512), (2048, 3, 6), (8, 2, 4)])
def test_join_against_brute_force(docs_of, monkeypatch, cap, long, hot):
    docs = ODD + varied(260, 7)
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    df = docs_of(docs).withColumns({n: F.lit(0) for n in ("cls", "th", "row", "component_id")})
    out = ngram_join.join(df.repartition(3), cap).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in out) == brute_components(docs)


def test_join_empty_and_keep_one(docs_of):
    assert ngram_join.join(docs_of([])).count() == 0
    docs = docs_of([*ODD, (7, "one two three four five six"), (8, "One two three  four five six"), (9, None)])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 3, 4, 5, 7, 9]  # 6 goes with 5, 8 with 7


def test_join_makes_new_names_where_two_sets_share_one(docs_of, monkeypatch):
    docs = varied(60, 3)
    monkeypatch.setattr(ngram_join, "_sets", _weak_sets(ngram_join._sets))
    out = ngram_join.join(docs_of(docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in out) == brute_components(docs)


def _weak_sets(plain):
    def make(seed):
        if seed:
            return plain(seed)

        def read(batches):
            import pyarrow as pa

            for b in plain(0)(batches):
                weak = pa.array([None if c is None else c % 3 for c in b.column("cls").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], weak, b.column("rest")], b.schema.names)

        return read

    return make


def test_join_of_rows_repeated_very_often_and_a_very_long_text(docs_of):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    docs = [(1, "one two three four five six seven eight")] * 400 + [(2, "one two three four five six seven eight nine")] * 300 + [(3, long),
        (4, long.replace("w5x5 ", "w5 "))]
    out = ngram_join.join(docs_of(docs).repartition(3)).collect()
    assert sorted({tuple(r) for r in out}) == [(1, 4, 1), (2, 5, 1), (3, 29996, 3), (4, 29996, 3)] and len(out) == len(docs)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    out = components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "t").collect()
    head = list(range(500))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    assert {(r["node"], r["component"]) for r in out} == {(x, find(x)) for e in edges for x in e if e[0] != e[1]} | {(find(e[0]),
        find(e[0])) for e in edges if e[0] != e[1]}
    assert len(out) == len({r["node"] for r in out})


def test_pipeline(spark, docs_of, tmp_path):
    import corpus_pipeline

    from .test_models import invented

    docs, labels = invented(300)
    docs += [(1000, docs[0][1], "aa", "s0", 1), (1001, docs[1][1] + " tail", "aa", "s1", 1), (1002, None, None, None, None),
        (1003, "l1\nl2\nl3", "aa", "s0", 8), (1004, "x\nl1\nl2\nl3", "aa", "s0", 10)]
    docs_of(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mixing", "tokens"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert all(r["whole"] for r in out) and 1000 not in ids and 1001 not in ids
    bad = {x[0] for x in labels if not x[1]}
    assert len(ids & bad) <= 0.1 * len(bad)
    assert len({(r["file"], r["row"]) for r in out}) == len(out)


def test_pipeline_against_brute_force(spark, docs_of, tmp_path):
    """Every stage done again row by row in Python (the classifier by its fitted model), on odd rows among others."""
    import corpus_pipeline
    import public_tokenizers as P

    from cartolens.llm import bpe, quality

    from .test_models import invented
    from .test_text_ops import brute_lines

    docs, labels = invented(250, 4)
    passage = "one line of it\nanother line of it\nand a third one"
    docs += [(2000 + i, f"{docs[i][1]}\n{passage}\nlast {i}", "aa", "s0", 5) for i in range(20)]
    docs += [(3000 + i, docs[i][1] + " tail words", "bb", "s1", 7) for i in range(0, 30, 2)] + [(2500, passage, "aa", None, 3)]
    docs += [(4000, None, None, None, None), (4001, "", "aa", "s2", 0), (4002, "word " * 30000, "aa", "s0", 150000),
        (4003, "a\nb\nc\nd", "aa", "s0", 7), (4003, "a\nb\nc\nd", "aa", "s0", 7)]
    table = docs_of(docs).withColumns({n: F.lit(1) for n in ("row", "file", "ids", "at", "cls", "_text")})
    table.write.parquet(str(tmp_path / "documents.parquet"))
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    label_rows.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality.fit(table, label_rows)
    rows = [d for d in docs if model.score((d[1] or "").encode()) >= 0.3]
    assert 0 < len(rows) < len(docs)
    clean = brute_lines([(d[0], d[1]) for d in rows])
    text = lambda d: None if d[1] is None else clean[d[0], d[1]]
    rows = [(d[0], text(d), *d[2:]) for d in rows if d[1] is None or text(d) == d[1] or text(d) != ""]
    least = {i: int(c) for i, _, c in (eval(x) for x in brute_components([(d[0], d[1]) for d in rows]))}
    rows = [d for d in rows if least[d[0]] == d[0]]
    encoding, _ = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted(repr((d[0], d[2], d[3], encoding.encode_ordinary(d[1] or ""))) for d in rows)
    assert sorted(repr((r["doc_id"], r["lang"], r["source"], r["ids"])) for r in out) == want and all(r["whole"] for r in out)
    mix = mixing.mixed(docs_of([(*d[:4], len(d[1] or "")) for d in rows])).collect()
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in mix}
    order = [place[r["doc_id"]] for r in sorted(out, key=lambda r: (r["file"], r["row"]))]
    assert order == sorted(order)


def test_pipeline_of_empty_tables(spark, docs_of, tmp_path):
    import corpus_pipeline

    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "lang", "source"]


def test_hot_shingles_meet_in_no_bucket(monkeypatch):
    """Postings by tasks and buckets, in this process: very frequent shingles are long and spread, all others listed whole."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "LONG", 3)
    texts = [t for _, t in varied(120, 11)]
    rows = []
    for part in (texts[:70], texts[70:]):
        for batch in ngram_join._postings(4)(iter([pa.RecordBatch.from_pydict({"text": pa.array(part)})])):
            rows += batch.to_pylist()
    assert any(r["bucket"] < 0 for r in rows)
    lists = {}
    for b in {r["bucket"] for r in rows}:
        out = ngram_join._lists(4)((pa.scalar(b),), pa.Table.from_pylist([r for r in rows if r["bucket"] == b],
            pa.schema([("bucket", pa.int64()), ("h", pa.binary()), ("cls", pa.binary()), ("mark", pa.binary())])))
        for r in out.to_pylist():
            lists.setdefault(r["list"], set()).add((r["cls"], r["long"]))
    want = {}
    for t in set(texts):
        s = ngram_join.set_of(t.encode())
        n = np.int64(len(s))
        for h in s[: n - ngram_join.threshold(n) + ngram_join.surplus(n)].tolist():
            want.setdefault((h // 4) % 2**32 * 4 + h % 4, set()).add(ngram_join.class_of(s)[0])
    for k, classes in want.items():
        got = {c for c, _ in lists.get(k, ())}
        assert got == classes if len(classes) > 1 else got <= classes
        if len(classes) > 6:
            assert all(long for _, long in lists[k])
