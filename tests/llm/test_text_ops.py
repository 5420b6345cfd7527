"""Media, BPE, line dedup, fingerprints and licenses on odd inputs, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolens.llm import bpe, licenses, linededup, media, merkle

LONG = ("Word after word, é and ß. " * 9000).strip()
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (4, "\n\n\n"), (5, " \t x"), (6, LONG), (7, "漢字 and 😀 emoji's"), (8, "x\ny\nz\nx\ny\nz")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def clash(df, *names):
    """Extra columns of names that operators might use."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("extra") for n in ("row", "at", "th", "h1", "salt", "new", "kept", "slot", "_id", "cls", "score", "text_hash", *names)})


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 6400, 70001])
def test_png_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = media.payload_of(data)
    assert len(payload) % 64 == 0 and payload and media.decode(media.encode(payload)).tobytes() == payload


def test_png_filters_and_checksums():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    residual = []
    for r, k in enumerate(kinds):
        x = image[r].astype(int)
        up = image[r - 1].astype(int) if r else np.zeros(64, int)
        left, corner = np.r_[0, x[:-1]], np.r_[0, up[:-1]]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * x, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][k]
        residual.append((x - guess) % 256)
    assert (media.unfilter(kinds, np.array(residual, np.uint8)) == image).all()
    stored = bytearray(media.encode(media.payload_of(b"some text" * 50)))
    for at in (0, 20, 45, len(stored) - 14):
        bad = stored.copy()
        bad[at] ^= 1
        with pytest.raises(media.BadMedia):
            media.decode(bytes(bad))
    with pytest.raises(media.BadMedia):
        media.decode(bytes(stored[:-5]))


def test_media_query(docs_of):
    out = rows(media.media_features(media.with_media(clash(docs_of(ODD), "media"))))
    want = {}
    for _, t in ODD:
        data = (t or "").encode()
        p = data + bytes(-len(data) % 64 or (0 if data else 64))
        want[(len(data), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] = len(p)
    assert len(out) == len(ODD)
    assert {(r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out} == set(want)
    assert all(r["payload_bytes"] % 64 == 0 and r["media_bytes"] > 60 and len(r["feature"]) == 16 for r in out)
    assert rows(media.media_features(media.with_media(docs_of([])))) == []


def test_bpe_query_and_pieces(docs_of):
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    encoding, _ = bpe.codec(ranks, P.PATTERN)
    out = rows(bpe.token_digests(clash(docs_of(ODD)), ranks, P.PATTERN))
    assert len(out) == len(ODD)
    want = set()
    for i, t in ODD:
        ids = encoding.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want
    text = LONG + "   \n\n  it's 123 !!! " * 500
    assert "".join(bpe.pieces(text, 100)) == text
    assert [i for p in bpe.pieces(text, 100) for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
    for dense in ("漢字。" * 200, "12\n34;5 " * 200, "x1y2z3" * 200, "it's-o'clock" * 100):
        cut = bpe.pieces(dense, 50)
        assert max(map(len, cut)) < 70 and [i for p in cut for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(dense)
    assert rows(bpe.token_digests(docs_of([]), ranks, P.PATTERN)) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 'é1٣!。$\u0301漢\n\t\u00a0\r ", max_size=120))
def test_bpe_pieces_of_any_text(text):
    import public_tokenizers as P

    encoding, _ = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [i for p in bpe.pieces(text, 5) for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def brute_lines(docs):
    seen, gone = {}, {}
    first = sorted({(i is not None, i, t) for i, t in docs if t is not None}, key=lambda x: (x[0], x[1] or 0, x[2]))
    for _, i, t in first:
        ls = t.split("\n")
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone.setdefault((i, t), set()).update((k, k + 1, k + 2))
            seen.setdefault(w, 1)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for _, i, t in first}


def test_line_dedup_against_brute_force(docs_of):
    rng = random.Random(5)
    docs = ODD + [(10 + i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(10, "a\nb\nc")]
    docs = [d for i, d in enumerate(docs) if d[0] != 10 or i == len(docs) - 1]  # ids are unique but for equal rows
    df = clash(docs_of(docs), "n_lines", "lines")
    want = brute_lines(docs)
    out = rows(linededup.dedup(df))
    assert len(out) == len(docs) and set(out[0]) == {*df.columns, "n_lines", "n_removed"}
    got = sorted(((r["doc_id"] or -1, r["text"] if r["text"] is not None else "~null") for r in out))
    assert got == sorted((i or -1, want[i, t] if t is not None else "~null") for i, t in docs)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["n_removed"])
    assert rows(linededup.report(docs_of([]))) == []


def test_line_dedup_sql(docs_of):
    docs = [(i, t) for i, t in ODD if i != 3] + [(20, "p\nx\ny\nz\nq"), (21, None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = sorted(map(repr, c.execute(f"SELECT doc_id, n_lines, n_removed, text_sha256 FROM ({linededup.SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in linededup.report(docs_of(docs)).select("doc_id", "n_lines", "n_removed", "text_sha256").collect()) == want


def brute_tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cut = lambda t: [x + "\n" for x in t.split("\n")[:-1]] + t.split("\n")[-1:]
    out = []
    ends = [0, *(i for i in range(1, len(text) + 1) if text[:i].endswith("\n\n")), len(text)]
    for lo, hi in zip(ends, ends[1:], strict=False):
        section = []
        for p in cut(text[lo:hi]):
            leaves, at = [], 0
            while at < len(p):
                size = next((m.end() - at for k in range(merkle.LEAST,
                    merkle.MOST) if (m := re.compile(r"[.!?;:,]+[ \t\n\x0b\f\r]+|[aenrst][ \t\n\x0b\f\r]+").match(p, at + k))),
                    min(merkle.MOST, len(p) - at))
                leaves.append(sha(p[at : at + size]))
                at += size
            section.append((sha("p" + "".join(leaves)), [x[:6] for x in leaves]))
        out.append((sha("s" + "".join(d for d, _ in section)), section))
    return sha("r" + "".join(d for d, _ in out)), out


def brute_likeness(a, b):
    """Of two trees, and the paragraphs of the first that the second does not have."""
    alike = {d for d, _ in a} & {d for d, _ in b}
    count = sum(sum(len(x) for _, x in dict((d, s) for d, s in a)[d]) for d in alike)
    rest = [[p for d, s in t if d not in alike for p in s] for t in (a, b)]
    same = {d for d, _ in rest[0]} & {d for d, _ in rest[1]}
    count += sum(len(dict(rest[0])[d]) for d in same)
    la, lb = ({x for d, ls in part if d not in same for x in ls} for part in rest)
    edits = [(i, j) for i, (d, s) in enumerate(a) if d not in alike for j, (e, _) in enumerate(s) if e not in same]
    total = 2 * count + len(la) + len(lb)
    return 2 * (count + len(la & lb)) / total if total else 1.0, edits


@pytest.mark.parametrize(("per_range", "cells"), [(5, 4), (3, 256), (1500, 256)])
def test_fingerprints_against_brute_force(docs_of, per_range, cells):
    docs = [d for d in ODD if d[0] is not None and d[0] != 3] + [(30 + i * i,
        f"Sentence {i % 4}. And more of it! Last {i}\n\nNext section {i % 3}, with another line\nand the same line.\n\nThe end of all.") for i in range(40)] + [(10**15,
        "An outlier, far away. " * 4), (-(10**12), "Another one")]
    out = {r["doc_id"]: r for r in rows(merkle.edit_report(clash(docs_of(docs), "a", "b", "n", "edited"), per_range, cells))}
    order = sorted(docs, key=lambda d: -d[0])
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + follow[:m]
        trees = [brute_tree(x) for x in (t, edited, follow)]
        form = lambda x: x[0] + "|" + ";".join(",".join("".join(ls) for _, ls in s) for _, s in x[1])
        near, edits = brute_likeness(trees[0][1], trees[1][1])
        got = out[i]
        assert got["n_chars"] == len(t) and got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got["fingerprint"] == form(trees[0]) and got["edited_fingerprint"] == form(trees[1])
        assert got["near_edited"] == pytest.approx(near) and got["near_next"] == pytest.approx(brute_likeness(trees[0][1], trees[2][1])[0])
        assert got["n_edits"] == len(edits) and got["first_edit"] == ("/".join(map(str, edits[0])) if edits else "")
    assert out[6]["near_edited"] > 0.5


def test_fingerprints_of_odd_tables(docs_of):
    assert len(rows(merkle.edit_report(docs_of(ODD)))) == len(ODD) and rows(merkle.edit_report(docs_of([]))) == []
    assert rows(merkle.edit_report(docs_of([(9, "only one. text.")])))[0]["near_next"] == 1.0
    nulls = rows(merkle.edit_report(docs_of([(None, f"{i} is the text") for i in range(20)]), 3, 4))
    assert len({r["edited_sha256"] for r in nulls}) == 20
    for ids in (["a", "b", "c"], [f"doc-{i:07d}" for i in range(50)], ["", None, "zz", "z"]):
        docs = docs_of([(i, f"The text of {i}, whole.", "en", "s", 1) for i in ids], "doc_id string, text string, lang string, source string, n_chars long")
        follow = {r["text"]: r["next"] for r in rows(merkle.with_next(docs, 4, 8))}
        order = [f"The text of {i}, whole." for i in [*sorted((x for x in ids if x is not None), reverse=True), *[x for x in ids if x is None]]]
        assert follow == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_equal_roots_mean_equal_texts_and_branches_locate_edits(docs_of):
    from pyspark.sql import functions as F

    texts = ["A a.\nB.\n\nC c.\n\nD.", "A a.\nB.\n\nC x.\n\nD.", "A a.\nB.\n\nC c. \n\nD.", "A a.\nB.\n\n\nC c.\n\nD.", "A a.\nB.\n \nC c.\n\nD.", "", "\n", "\n\n"]
    t = merkle.fingerprints(docs_of(list(enumerate(texts))))
    prints = [r["fingerprint"].split("|")[0] for r in t.collect()]
    assert len(set(prints)) == len(texts)
    pair = t.filter("doc_id = 0").select(F.col("sections").alias("a")).crossJoin(t.filter("doc_id = 1").select(F.col("sections").alias("b")))
    assert [tuple(x) for x in merkle.compared(pair, "a", "b", "near").first()["near_edits"]] == [(1, 0)]


def test_licenses_sql_and_odd_inputs(docs_of):
    body = dict(licenses.templates())
    rng = random.Random(8)

    def worn(name, share):
        words = body[name].split()
        for i in rng.sample(range(len(words)), int(share * len(words))):
            words[i] = "changed"
        return "Some words before it. " * 7 + " ".join(words) + " and after"

    docs = ODD + [(40, body["MIT"]), (41, "x " * 50 + body["Apache-2.0"].upper() + " y" * 30),
        (42, body["BSD-3-Clause-text"][:100] + " other words here"), (43, "mit of license"), (44, " ".join(body.values())), (40, body["MIT"])]
    docs += [(50 + i, worn(n, s)) for i, (n, s) in enumerate((n, s) for n in ("MIT-full", "GPL-3.0-full", "Apache-2.0-full",
        "BSD-3-Clause-full") for s in (0, 0.03, 0.05, 0.1))]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    names = "doc_id, license_id, n_windows, first_word, contained"
    want = sorted(map(repr, set(c.execute(f"SELECT {names} FROM ({licenses.sql()})").fetchall())))
    got = rows(licenses.report(clash(docs_of([d for i, d in enumerate(docs) if d not in docs[:i]]), "k", "step", "words", "s5", "h")))
    assert sorted(repr(tuple(r[n] for n in names.split(", "))) for r in got) == want
    assert {r["license_id"] for r in got if r["doc_id"] == 44} == set(body)
    assert {"MIT-full", "GPL-3.0-full", "Apache-2.0-full"} <= {r["license_id"] for r in got if r["doc_id"] >= 50}
    assert rows(licenses.report(docs_of([]))) == []


def test_every_license_template_has_bands_enough():
    for name, text in licenses.templates():
        k, step, width = licenses.shape(text)
        places = len(licenses.words_of(text)) - k + 1
        assert width >= places + step - 1  # wholly in some window, wherever it lies
        size = licenses.distinct_shingles(text)
        need = next(n for n in range(size + 1) if n >= licenses.CONTAINMENT * size)
        worst = min(n / (size + width - n) for n in range(need, size + 1) if n <= width)
        assert (1 - min(1, worst)) ** licenses.bands_of(text) <= licenses.MISS, name
        assert licenses.bands_of(text) <= 50


def test_bands_read_from_the_templates_meet_what_all_windows_meet(spark, docs_of):
    from pyspark.sql import functions as F

    listed = [t for t in licenses.templates() if t[0] in ("MIT", "MIT-text", "ISC-full", "MIT-full", "BSD-2-Clause-full", "All-rights-reserved", "GPL-2.0-passage-1")]
    body = dict(listed)
    docs = docs_of([*ODD, (40, body["MIT-full"]), (41, "a b c " + body["ISC-full"] + " all rights reserved " + body["BSD-2-Clause-full"][:700]),
        (42, body["GPL-2.0-passage-1"].replace("the", "a"))])
    index = licenses.known(spark, listed)
    got = {(r["doc_id"], r["license_id"], r["at"]) for r in licenses.retrieved(docs, index).collect()}
    want = set()
    for name, text in listed:
        k, step, width = licenses.shape(text)
        one = docs.select("doc_id", licenses._shingles(licenses._words(F.coalesce("text", F.lit(""))), k).alias("all")).filter(F.size("all") > 0)
        one = one.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(step)),
            lambda a: F.struct(a.alias("at"), F.slice("all", a + 1, width).alias("window")))).alias("w"))
        every = one.crossJoin(index.filter(F.col("license_id") == name)).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
        met = every.filter(licenses.minimum(F.col("w.window"), F.col("band")) == licenses.minimum(F.col("own"), F.col("band")))
        want |= {(r["doc_id"], name, r["at"]) for r in met.select("doc_id", "w.at").distinct().collect()}
    assert got == want and len(got) > 20


def test_licenses_cover_usual_families_and_keep_them_apart(docs_of):
    gnu = "This program is free software; you can redistribute it under the terms of the GNU {} Public License, version {}."
    docs = [(1, "Some prose. Copyright 2020, all rights reserved. More."), (2, gnu.format("General", "2")), (3, gnu.format("Lesser General", "2.1")),
        (4, gnu.format("Affero General", "3")), (5, "BSD 2-Clause"), (6, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY-SA 4.0."),
        (8, "Licensed under CC BY-NC 4.0."), (9, "This is free and unencumbered software released into the public domain."), (10, "ISC License"),
        (11, "SPDX-License-Identifier: MIT"), (12, "licensed under the GNU General Public License, version 3.")]
    want = {1: {"All-rights-reserved"}, 2: {"GPL-2.0"}, 3: {"LGPL-2.1", "LGPL-text"}, 4: {"AGPL-3.0", "AGPL-text"}, 5: {"BSD-2-Clause"},
        6: {"CC-BY-4.0"}, 7: {"CC-BY-SA-4.0"}, 8: {"CC-BY-NC-4.0"}, 9: {"Unlicense-text"}, 10: {"ISC"}, 11: {"MIT-spdx"}, 12: {"GPL-3.0-only"}}
    got = {}
    for r in licenses.report(docs_of(docs)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert got == want
