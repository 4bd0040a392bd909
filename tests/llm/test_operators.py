"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from limnos.llm import decontaminate, embeddings, language, licenses, mixing, near_dedup, quality, sharding, token_counts, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASH = "doc_id long, text string, lang string, source string, n_chars long, signature string, component string, shard string, _bucket string, score string"


def clashing(spark, rows):
    """Documents with further columns named like the operators' own ones."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "y", "z", "b", "s") for i, t, la, s in rows], CLASH)


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ter", "un", "Spa", "vé", "ß") for b in ("n", "rem", "do", "lich", "tion", "s", "x", "qu")]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [prose(r, r.randint(30, 60), VOCABULARY) for _ in range(20)]
    out = list(base)
    for t in base[:6]:  # families of near copies
        for _ in range(r.randint(1, 12)):
            w = t.split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            out.append(" ".join(w))
    passage = prose(r, 40, VOCABULARY)
    out += [passage + " " + prose(r, r.randint(3, 30), VOCABULARY) for _ in range(30)]  # one passage that many share
    out += [base[0]] * 25 + ["", " \n\t", None, "one", "One", "one two three four", "ONE two three four", prose(r, 20_000, VOCABULARY)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return clashing(spark, [(i * 3 + 1, t, None, None) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (1, texts[0], "en", "s")])


def components_by_force(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("few,pivots,block", [(8, 2, 128), (2, 1, 4), (2, 0, 3)])
def test_near_duplicates_by_force(spark, docs, texts, few, pivots, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_dedup.near_duplicates(docs, few=few).collect()
    sets = {i * 3 + 1: shingle_set(t) for i, t in enumerate(texts)}
    ids = sorted(sets)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_by_force(ids, linked)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_near_duplicates_keep_one_row_of_each_group(spark, docs, texts):
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    want = [r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()]
    assert sorted(set(kept) - {None}) == sorted(set(want) - {None}) and kept.count(1) == 1 and kept.count(None) == 1


def test_an_id_with_two_texts_ties_both(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("pivots,block", [(2, 128), (0, 4), (0, 40)])
def test_ids_with_several_texts_by_force(spark, pivots, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(11)
    base = [prose(r, 60, VOCABULARY) for _ in range(12)]

    def copy(t):
        w = t.split()
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
        return " ".join(w)
    rows = [(i, copy(base[k % 12])) for i in range(1, 13) for k in (i, i + 5 * (i % 2))] + [(100 + i, copy(base[i % 12])) for i in range(144)]
    rows += rows[:5]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), few=2).collect()
    each = [(i, shingle_set(t)) for i, t in set(rows)]
    linked = [(a, b) for x, (a, p) in enumerate(each) for b, q in each[x + 1:] if a == b or 100 * len(p & q) >= 75 * len(p | q)]
    want = components_by_force({i for i, _ in rows}, linked)
    assert len(out) == len(rows) and {(o.doc_id, o.component_id) for o in out} == set(want.items())


def test_empty_tables(spark):
    d = spark.createDataFrame([], CLASH)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    import public_tokenizers
    for out in (near_dedup.near_duplicates(d), near_dedup.one_of_each(d), decontaminate.report(d, items), decontaminate.clean(d, items), language.predict(d), mixing.schedule(d),
                mixing.mixed(d), sharding.shard(d), licenses.report(d), toxicity.score_toxicity(d, labels), quality.score_quality(d, labels),
                token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"))):
        assert out.count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination_by_force(spark, docs, texts):
    r = random.Random(8)
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join(texts[3].split()[5:25])), (2, "ONE, two"), (10, "one"), (3, None), (4, "..."), (5, prose(r, 30, VOCABULARY)), (1, "unseen words only here"), (6, texts[-1][:3000])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        windows |= {(i, tuple(w[k:k + n])) for k in range(len(w) - n + 1) if n}
    want = {}
    for k, t in enumerate(texts):
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        grams = {n: defaultdict(list) for n in {len(g) for _, g in windows}}
        for n in grams:
            for at in range(len(w) - n + 1):
                grams[n][tuple(w[at:at + n])].append(at)
        for i, g in windows:
            for at in grams[len(g)].get(g, ()):
                hit |= set(range(at, at + len(g)))
                found.add(str(i))
        want[k * 3 + 1] = (len(w), len(hit), ",".join(sorted(found)))
    for block in (decontaminate.BLOCK_BYTES, 2000):
        rows = decontaminate.scan(docs, bench, block_bytes=block).collect()
        assert len(rows) == len(texts) + 2
        for x in rows:
            if x.doc_id is not None:
                assert (x.n_words, x.n_hit, ",".join(x["items"])) == want[x.doc_id]
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(texts) + 2
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} - {None} == {k for k, v in want.items() if v[1] == 0}


def test_token_counts_equal_the_library(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    signs = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "ß", "漢", "😀", "1", "²", "'s", "<|endoftext|>", "<|endo", "...", "the", "ing", "\x00"]
    odd = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["ab" * 4000, "", None, "<|endoftext|>" * 3]
    d = clashing(spark, [(i, t, None, None) for i, t in enumerate(odd + texts)])
    for x in token_counts.count_tokens(d, path).collect():
        t = (odd + texts)[x.doc_id] or ""
        assert (x.n_bytes, x.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False)))
        assert x.over_limit == (x.n_tokens > 512)


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(3)
    roots = {"aa": ["kala", "miro", "tepa", "suno"], "bb": ["grent", "bolst", "frink", "dwarm"], "cc": ["öüßä", "çéàè", "ñíóú", "âêîô"]}
    rows = [(i, prose(r, 30, [a + b for a in roots[la] for b in roots[la]]), la, None) for i, la in enumerate(r.choice(list(roots)) for _ in range(300))]
    rows += [(1000, None, "aa", None), (1001, "123 ... !!", "bb", None), (1002, "x", None, None), (1003, "", "cc", None), (None, "kalamiro", "aa", None)]
    out = {x.doc_id: x for x in language.predict(clashing(spark, rows)).collect()}
    truth = {i: la for i, _, la, _ in rows[:300]}
    held = [i for i in truth if out[i].held_out]
    assert len(held) > 40 and sum(out[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1000, 1001, 1003)) and out[1002].lang_pred in roots
    assert all(0 <= x.score <= 1 for x in out.values())
    d = clashing(spark, rows)
    kept = language.recognised(d, language.build_filter(d))
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == set(out) - {1000, 1001, 1003}


def test_language_filter_never_forgets_and_names_over_64_languages(spark):
    rows = [(i, chr(0x4E00 + 40 * (i % 70)) * 3 + chr(0x4E01 + 40 * (i % 70)) * 9, f"l{i % 70:02d}", None) for i in range(700)]
    out = language.predict(clashing(spark, rows)).collect()
    assert all(x.lang_pred == f"l{x.doc_id % 70:02d}" for x in out)


def test_toxicity_and_quality_held_out(spark):
    r = random.Random(2)
    plain = [a + b for a in ("ka", "lo", "mi", "ter", "un", "spa") for b in ("n", "rem", "do", "lich", "tion", "s")]
    bad = ["zorgak", "zorglin", "zorgum"]
    rows, labels = [], []
    for i in range(1200):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        w = [r.choice(bad if toxic and r.random() < 0.1 else plain) for _ in range(r.randint(30, 80))]
        rows.append((i, " ".join(w if good else [x.upper() + "$$" for x in w]), None, None))
        labels.append((i, good, toxic))
    rows += [(5000, None, None, None), (5001, "", None, None), (5002, "zorgak", None, None), (None, "kan", None, None), (3, rows[3][1], None, None)]
    labels += [(None, 1, 1), (5002, None, None), (3, labels[3][1], labels[3][2])]
    d, lab = clashing(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score, column in ((toxicity.score_toxicity, 2), (quality.score_quality, 1)):
        out = score(d, lab).collect()
        assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
        held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 1200]
        assert len(held) > 150 and np.mean([x.predicted == labels[x.doc_id][column] for x in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in toxicity.score_toxicity(d, none).collect()} == {0.5} == {x.score for x in quality.score_quality(d, none).collect()}


def test_vectors_by_force(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 24))
    x[50:140] = x[0] + 0.2 * r.standard_normal((90, 24))
    x[200:230] = x[1]
    x[230] = 3 * x[1]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [1.0] * 5), (904, [float("inf")] * 24), (905, [None] + [1.0] * 23), (None, rows[0][1])]
    d = spark.createDataFrame([(i, e, "c", "d") for i, e in rows], "vec_id long, embedding array<double>, node string, unit string")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components_by_force(range(400), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near))])
    out = embeddings.near_duplicates(d).collect()
    assert len(out) == len(rows)
    for o in out:
        if o.vec_id is not None and o.vec_id < 400:
            assert (o.n_links, o.component_id, o.kept) == (near[o.vec_id].sum(), want[o.vec_id], want[o.vec_id] == o.vec_id)
        else:
            assert o.n_links == 0 and o.component_id == o.vec_id and o.kept


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    a = r.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    turned = a @ embeddings.rotation(64, embeddings.CODE)
    assert np.allclose(turned @ turned.T, a @ a.T)
    signs = np.sign(turned) / np.sqrt(embeddings.CODE)
    f = (signs * turned).sum(1)
    error = signs @ turned.T / f[:, None] - a @ a.T
    bound = embeddings.SURE * np.sqrt((1 - f**2) / f**2 / (embeddings.CODE - 1))
    assert abs(error.mean()) < 1e-3 and (np.abs(error) <= bound[:, None]).mean() > 0.9999


def test_licenses_by_force(spark, texts):
    r = random.Random(9)
    notices = [(k, t) for k, each in licenses.TEMPLATES.items() for t in each]
    made = []
    for i in range(80):
        name, t = r.choice(notices)
        made.append((name, prose(r, r.randint(0, 50), VOCABULARY) + "\n" + t.upper() + " " + prose(r, r.randint(0, 50), VOCABULARY)))
    plain = [t for t in texts if t is None or "license" not in t.lower()]
    d = clashing(spark, [(i, t, None, None) for i, (_, t) in enumerate(made)] + [(1000 + i, t, None, None) for i, t in enumerate(plain)])
    out = licenses.scan(d, licenses.template_table(spark)).collect()
    assert len(out) == len(made) + len(plain)
    for o in out:
        if o.doc_id >= 1000:
            assert o.licenses == [] and o.matches == []
        else:
            name, text = made[o.doc_id]
            best = max(o.matches, key=lambda m: (m["share"], m["words"]))
            assert name in o.licenses and best["share"] == 1.0
            assert text.encode()[best["from_byte"]:best["to_byte"]].decode().lower().split()[0] in {t.lower().replace("-", " ").split()[0] for _, t in notices}


def test_licenses_of_full_texts_and_versions(spark):
    rows, more = licenses.template_rows(), prose(random.Random(4), 40, VOCABULARY)
    by = dict(rows)
    bsd = {k: next(t for t in licenses.TEMPLATES[k] if "Neither" in t or "DISCLAIMED" in t) for k in ("BSD-2-Clause", "BSD-3-Clause")}
    own = [("All-Rights-Reserved", "Copyright 2020. All rights reserved."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
           ("", "This work is licensed under the GNU General Public License, version 7."), ("BSD-2-Clause", bsd["BSD-2-Clause"].replace("HOLDER ", "OWNER ")),
           ("BSD-3-Clause", bsd["BSD-3-Clause"].replace("the copyright holder", "Example University")), ("AGPL-3.0", by["AGPL-3.0"]),
           ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
                        "Foundation; either version 2.1 of the License, or (at your option) any later version.")]
    made = rows + own
    d = clashing(spark, [(i, f"{more} {t}\n{more}", None, None) for i, (_, t) in enumerate(made)] + [(9000, f"Released under the MIT License. {more} Released under the MIT License.", None, None)])
    out = {o.doc_id: o for o in licenses.scan(d, licenses.template_table(spark)).collect()}
    assert len(out[9000].matches) == 2 and out[9000].licenses == ["MIT"]
    wrong = [(made[i], o.licenses) for i, o in out.items() if i < 9000 and (made[i][0] not in o.licenses if made[i][0] else o.licenses)]
    assert not wrong, [(n, t[:60], x) for (n, t), x in wrong]
    assert all(out[i].licenses == [n] for i, (n, _) in enumerate(made) if n and i >= len(rows))


def deviation(order, weights):
    """Largest distance in half blocks between what a source has run and its share of the slots so far."""
    from fractions import Fraction
    total, ran, worst = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), 0
    for t, s in enumerate(order, 1):
        ran[s] += 1
        worst = max(worst, *(abs(ran[k] - Fraction(w) * t / total) for k, w in weights.items()))
    return worst


@pytest.mark.parametrize("frame", [50, mixing.FRAME])
def test_mixing_follows_pfair_windows(spark, frame):
    rows = [(i, "t", None, s) for i, s in enumerate(["hot"] * 900 + ["b"] * 300 + ["c"] * 150 + [None] * 90 + ["one"])] + [(None, "t", None, "b"), (3, "t", None, "hot")]
    d = clashing(spark, rows)
    out = mixing.schedule(d, block=4, frame=frame).collect()
    assert len(out) == len(rows)
    block = {(o.source, o.block, o.slot, o.phase, o.release, o.deadline) for o in out}
    assert sorted(b[2] for b in block) == list(range(len(block)))
    assert all(b[4] <= b[2] < b[5] for b in block)
    first = [b[0] for b in sorted((b for b in block if b[3] == 0), key=lambda b: b[2])]
    assert deviation(first, {s: float(-(-n // 2)) ** mixing.TEMPER for s, n in {"hot": 901, "b": 301, "c": 150, None: 90, "one": 1}.items()}) < 2
    m = mixing.mixed(d, block=4, frame=frame)
    mixed = {o.doc_id for o in out if o.phase == 0}
    assert m.columns == d.columns and m.count() == sum(r[0] in mixed for r in rows)


@pytest.mark.parametrize("weights", [{"hot": 0.9} | {f"w{k}": 0.1 / 399 for k in range(399)}, {"hot": 0.50, "w0": 0.0101, "w1": 0.49}])
def test_mixing_keeps_the_given_weights(spark, weights):
    sources = ["hot"] * 3600 + [f"w{k}" for k in range(len(weights) - 1) for _ in range(2 if len(weights) > 3 else 900)]
    out = mixing.schedule(clashing(spark, [(i, "t", None, s) for i, s in enumerate(sources)]), weights, block=2, frame=700).collect()
    assert sorted(o.doc_id for o in out) == list(range(len(sources)))
    first = sorted((o.slot, o.source) for o in out if o.phase == 0)
    order = [s for _, s in first]
    assert deviation(order, weights) < 2 and abs(order.count("hot") / len(order) - weights["hot"] / sum(weights.values())) < 0.002


def test_pipeline_mix_is_whole_and_shards_keep_its_order(spark, tmp_path):
    import corpus_pipeline
    rows = [(i, f"text {i}", None, s) for i, s in enumerate(["hot"] * 3000 + ["b"] * 700 + [None] * 90 + ["one"])] + [(None, "t", None, "b"), (3, "again", None, "hot"), (None, None, None, "hot")]
    d = clashing(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    stages["mixing"](spark, d, "").write.parquet(out := str(tmp_path / "mix"))
    m = spark.read.parquet(out)
    assert m.columns == d.columns and sorted(map(str, m.collect())) == sorted(map(str, d.collect()))
    slot = {o.doc_id: (o.slot, o.position) for o in mixing.schedule(d).orderBy("slot", "position", ascending=False).collect()}
    by = defaultdict(list)
    for o in stages["sharding"](spark, m, "").orderBy("shard", "slot").collect():
        by[o.shard].append(slot[o.doc_id])
    assert sum(map(len, by.values())) == len(rows) and all(v == sorted(v) for v in by.values())


@pytest.mark.parametrize("weights", [None, {"hot": 5.0, "w3": 2.0, None: 1.0}, {"hot": 0, "w3": 2.0, None: 1.0}])
def test_mixing_of_any_number_of_sources(spark, weights):
    r = random.Random(3)
    sources = ["hot"] * 900 + [None] * 90 + [f"w{k}" for k in range(620) for _ in range(r.randint(1, 9))]
    d = clashing(spark, [(i, "t", None, s) for i, s in enumerate(sources)])
    out = mixing.schedule(d, weights, block=2, frame=50).collect()
    assert sorted(o.doc_id for o in out) == list(range(len(sources))) and all(sources[o.doc_id] == o.source for o in out)
    blocks = {(o.source, o.block, o.slot, o.release, o.deadline) for o in out}
    assert sorted(b[2] for b in blocks) == list(range(len(blocks))) and all(b[3] <= b[2] < b[4] for b in blocks)
    own = defaultdict(list)
    for s, j, slot, _, _ in blocks:
        own[s].append((slot, j))
    assert all([j for _, j in sorted(v)] == list(range(sources.count(s))) for s, v in own.items())


def test_every_frame_is_full_and_in_time():
    r = random.Random(7)
    for _ in range(60):
        left, weights = [r.randint(1, 60) for _ in range(r.randint(1, 9))], [r.random() ** 5 for _ in range(9)]
        order = []
        for phase, start, slots, who, first, n in mixing.quotas(left, weights[:len(left)], 20):
            assert start == len(order) and n.sum() == slots
            for slot, (s, i, release, deadline) in enumerate(mixing.one_frame(n.tolist())):
                assert release <= slot < deadline
                order.append((phase, int(who[s]), int(first[s]) + i))
        assert sorted(o[1:] for o in order) == [(s, j) for s, n in enumerate(left) for j in range(n)]
        assert deviation([s for phase, s, _ in order if phase == 0], dict(enumerate(weights[:len(left)]))) < 2


@pytest.mark.parametrize("sizes", [[40, 9, 5, 3, 2, 2, 2] + [1] * 60, [100, 50], [1] * 5, [7] * 20, [30] * 3 + [1] * 4])
def test_sharding_keeps_the_law_and_groups(spark, sizes):
    rows, k = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k, f"text {g}", None, None))
            k += 1
    rows += [(None, None, None, None), (k, None, None, None), (0, "text 0", None, None)]
    out = sharding.shard(clashing(spark, rows)).collect()
    n = len(rows)
    assert len(out) == n
    by = defaultdict(list)
    for o in out:
        by[o.shard].append(o.slot)
    counts = [len(by.get(s, ())) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib
    parts = defaultdict(set)
    for o in out:
        if o.doc_id is not None and o.doc_id < k:
            text = rows[o.doc_id][1]
            assert (o.size, o.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))
            parts[text].add(o.shard)
    room = -(-n // 16)
    if sizes[0] == 40:  # groups that fit a shard stay whole, larger ones have no more parts than they need and one
        assert all(len(parts[f"text {g}"]) == 1 for g, s in enumerate(sizes) if s <= room // 2)
        assert len(parts["text 0"]) <= -(-41 // room) + 1


def test_sharding_by_another_key(spark):
    from pyspark.sql import functions as F
    d = clashing(spark, [(i, f"t{i}", None, f"s{i % 40}") for i in range(400)])
    out = sharding.shard(d, 8, link=F.col("source")).collect()
    where, counts = defaultdict(set), defaultdict(int)
    for o in out:
        where[o.doc_id % 40].add(o.shard)
        counts[o.shard] += 1
    # every document is linked, so only swaps are left: all groups started in 8 shards
    assert set(counts.values()) == {50} and np.mean([len(v) for v in where.values()]) < 6


def test_quality_learns_from_every_label(spark, monkeypatch):
    docs = [(i, f"{'plain words of text' if i % 100 else '### | ### % $ ###'} number {i}") for i in range(9_000)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 100 > 0)) for i, _ in docs], "doc_id long, quality int")
    met = []
    pairs = quality.preference_pairs
    monkeypatch.setattr(quality, "preference_pairs", lambda known: met.append(known.count()) or pairs(known))
    got = {r.doc_id: r for r in quality.score_quality(d, lab).collect()}
    taught = sum(not r.held_out for r in got.values())
    assert taught > 5_900 and met == [taught]
    assert sum(r.predicted == (i % 100 > 0) for i, r in got.items()) > 8_700


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_weighted_quantile_by_force(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, r.gauss(0, 1), 0.25]) if i else r.gauss(0, 1), r.randint(1, 9)) for i in range(n)]
    flat = np.array([v for v, f in rows if v is not None for _ in range(f)])
    d = spark.createDataFrame(rows, "v double, f int")
    for share in (0.0, 0.07, 0.5, 1.0):
        assert abs(quality.weighted_quantile(d, "v", "f", share, bins=5) - np.percentile(flat, 100 * share)) < 1e-12
    assert quality.weighted_quantile(d.where("f > 99"), "v", "f", 0.5) is None
