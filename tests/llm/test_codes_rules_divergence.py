"""Vector codes, line rules and the divergence audit against brute force, with the edge cases of each."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from limnos.llm import divergence, line_rules, vector_codes

# ── vector codes ────────────────────────────────────────────────────────────────

VECTOR = "vec_id long, embedding array<float>, label int, code string, part string, entry int, _label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 3, "z") for i, v, label in rows], VECTOR)


def codes_by_force(rows, parts=4, entries=8, rounds=2):
    """Lloyd by all distances in Python integers."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return [], []
    width = max(1, -(-max(len(v) for _, v, _ in good) // parts))
    x = []
    for _, v, _ in good:
        w = [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v] + [0] * (parts * width - len(v))
        x.append([tuple(w[j * width:(j + 1) * width]) for j in range(parts)])
    seeds = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, [float(np.float32(c)) for c in good[r][1]]))[:entries]
    books = [[x[r][j] for r in seeds] for j in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for j in range(parts):
            own = defaultdict(list)
            for row in x:
                own[nearest(row[j], books[j])].append(row[j])
            books[j] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if own[e] else entry for e, entry in enumerate(books[j])]
    out = []
    for (i, _, label), row in zip(good, x):
        code = [nearest(row[j], books[j]) for j in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(far(row[j], books[j][c]) for j, c in enumerate(code))))
    return out, [c for book in books for entry in book for c in entry]


def some_vectors(n=300, dim=12):
    r = np.random.default_rng(3)
    centres = r.normal(size=(9, dim))
    rows = [(int(i * 7 % 1000), [float(c) for c in centres[i % 9] + r.normal(scale=0.1 + (i % 4) * 0.3, size=dim)], int(i % 5) if i % 11 else None) for i in range(n)]
    rows += [(2000 + i, [0.5] * dim, 1) for i in range(40)] + [(5, rows[0][1], 2)]  # equal vectors, a repeated id
    rows += [(None, [0.25] * dim, 1), (3001, None, 1), (3002, [None] + [1.0] * (dim - 1), 1), (3003, [float("nan")] * dim, 1), (3004, [float("inf")] * dim, 0), (3005, [0.0] * dim, 0)]
    return rows


@pytest.mark.parametrize("leaf,stretch", [(16, 1 << 22), (1, 8 * 12 * 50), (3, 8 * 12 * 7)])
def test_codes_by_force(spark, leaf, stretch, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "STRETCH", stretch)
    rows = some_vectors()
    coded, books = vector_codes.compress(vectors(spark, rows).repartition(5), parts=4, entries=8)
    want, flat = codes_by_force(rows)
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r["vec_id"], r["label"] and int(r["label"]), r["code"], r["error"]) for r in coded.collect()), key=key) == sorted(want, key=key)
    assert books.ravel().tolist() == flat


def test_trees_prune_and_assign_whole_nodes():
    """Far clusters are assigned by their nodes alone; every point is assigned once."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-5, 5, (500, 3)) + 1000 * k for k in range(4)])
    books = np.array([[0, 0, 0], [1000] * 3, [2000] * 3, [3000] * 3])
    t = vector_codes.grow(x, 16)
    found = vector_codes.assign(t, books, vector_codes.grow(books, 1))
    assert len(found[1]) == 0 and sum(len(n) for _, n, _ in found[0]) < 20
    assert (vector_codes.codes_of(t, found) == np.repeat(np.arange(4), 500)).all()


def test_code_labels_and_empty(spark):
    rows = some_vectors()
    got = vector_codes.report(vectors(spark, rows), parts=4, entries=8).collect()
    want, _ = codes_by_force(rows)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert sorted((str(r["vec_id"]), r["error"], r["label_error"]) for r in got) == sorted((str(i), e, sums[label]) for i, label, _, e in want)
    assert len({r["codebooks_sha256"] for r in got}) == 1
    none = vectors(spark, [(1, None, 2), (2, [float("nan")], 1)])
    assert vector_codes.report(none).collect() == [] and vector_codes.report(none.limit(0)).collect() == []
    ragged = [(1, [0.5, -0.25, 0.1], 1), (2, [], 1), (3, [3.0] * 7, None)]
    coded, books = vector_codes.compress(vectors(spark, ragged), parts=4, entries=2)
    want, flat = codes_by_force(ragged, entries=2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == sorted((i, c, e) for i, _, c, e in want) and books.ravel().tolist() == flat


# ── line rules ──────────────────────────────────────────────────────────────────

SPACES = r"[^\x20\x09-\x0D]+"


def rules_by_force(text):
    """Every rule word by word."""
    text = text or ""
    words = re.findall(SPACES, text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, lost, dup, lines, failed, kept_lines = set(), 0, 0, 0, 0, []
    mark = lambda c: c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for line in text.split("\n"):
        w = re.findall(SPACES, line)
        if not w:
            kept_lines.append(line)
            continue
        lines += 1
        again = line in seen
        seen.add(line)
        dup += again
        noisy = sum(any(mark(a) and mark(b) for a, b in zip(x, x[1:])) for x in w)
        lone = sum(not any(c.isascii() and c.isalnum() or not c.isascii() for c in x) for x in w)
        low = "".join(c.lower() if c.isascii() else c for c in line)
        bad = (again or 2 * noisy > len(w) or len(w) <= 2 and w[-1][-1].isascii() and w[-1][-1] not in ".!?:;" or lone >= 2 and 5 * lone > len(w)
               or len(w) <= 10 and any(p in low for p in line_rules.PHRASES))
        failed += bad
        lost += bad * sum(map(len, w))
        if not bad:
            kept_lines.append(line)
    chars = sum(map(len, words))
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(hit), lines, failed, lost, base, not base and 100 * lost <= 30 * chars), "\n".join(kept_lines)


def pages():
    r = random.Random(9)
    vocabulary = [a + b for a in ("ka", "lo", "ümi", "ter", "Span", "vé", "ß") for b in ("n", "rem", "do", "lich", "x")]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize()
    out = [None, "", " \n\t\n", "one", "a b c d", "a a a a a a " * 20]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            parts.append(line(r.randint(3, 25)) + "." if kind < 0.6 else " | ".join(line(1) for _ in range(r.randint(2, 6))) if kind < 0.68 else
                         " ".join(x + "&&&" for x in line(6).split()) if kind < 0.74 else "Read MORE about cookies" if kind < 0.78 else "Privacy Policy" if kind < 0.8 else
                         line(1) if kind < 0.85 else "" if kind < 0.9 else "  " if kind < 0.92 else parts[-1] if parts else "x.")
        out.append("\n".join(parts) + ("\n" if r.random() < 0.3 else ""))
    out.append("\n".join(line(30) + "." for _ in range(3000)))  # far longer than a piece
    out.append("w" * 600_000 + " " + "w" * 600_000 + ". end")  # words longer than a stretch
    return out


def test_line_rules_by_force(spark):
    texts = pages() + [pages()[8]] * 2
    df = spark.createDataFrame([(i if i % 9 else None, t, "a", i, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, n_lines int, kept boolean")
    want = [((i if i % 9 else None), *rules_by_force(t)[0]) for i, t in enumerate(texts)]
    got = [tuple(r) for r in line_rules.report(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(w[-1] and w[7] for w in want) and any(not w[-1] and not w[-2] for w in want)
    kept = {r["n_lines"]: r["text"] for r in line_rules.clean(df).collect()}
    assert kept == {i: rules_by_force(t)[1] if rules_by_force(t)[0][6] else t for i, t in enumerate(texts) if rules_by_force(t)[0][-1]}
    assert line_rules.report(df.limit(0)).collect() == [] and line_rules.clean(df.limit(0)).collect() == []


# ── divergence ──────────────────────────────────────────────────────────────────

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def audit_by_force(rows, least=3, top=200):
    count, whole, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(TERM, (text or "").translate(UPPER))
        count[lang, source].update(terms)
        whole[lang].update(terms)
        docs[lang].update(set(terms))
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = lambda c: sum(c[t] for t in kept)  # noqa: B023,E731
        p = {t: share(count[lang, source][t], total(count[lang, source]), len(kept)) for t in kept}
        found = []
        for other in (s for la, s in groups if la == lang and s != source):
            q = {t: share(count[lang, other][t], total(count[lang, other]), len(kept)) for t in kept}
            found.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        out += [(lang, source, "pair", item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode())))]
        q = {t: share(whole[lang][t], total(whole[lang]), len(kept)) for t in kept}
        found = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "term", item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:top])]
    return out


def corpus(n=260):
    r = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "Ter", "un", "vé", "ß", "日") for b in ("n", "rem", "do", "lich", "tion", "s", "x", "qu")]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 else f"s{i % 11}"
        mine = words[:20] if source == "hot" else words[i % 7 * 8:] + words[:3]
        rows.append((r.choice(["en", "de", None]), source if i % 17 else None, r.choice([" ", "-", "1"]).join(r.choice(mine) for _ in range(r.randint(0, 40)))))
    rows += [("fr", "a", "nur einmal"), ("fr", "b", None), ("fr", "c", "12 34"), ("en", "hot", " ".join(r.choice(words) for _ in range(9000)))] + rows[:3]
    rows += [("x", "a", "ab"), ("x", "b", "ab"), ("x", "b", "c" * 700_000 + " ab")]
    return rows


@pytest.mark.parametrize("sources,terms,rows,stretch", [(48, 20_000, 50_000, 1 << 22), (2, 7, 5, 200)])
def test_audit_by_force(spark, sources, terms, rows, stretch, monkeypatch):
    for name, value in (("SOURCES", sources), ("TERMS", terms), ("BAND_ROWS", rows), ("STRETCH", stretch), ("CHUNK", 4), ("MERGE", 50)):
        monkeypatch.setattr(divergence, name, value)
    data = corpus()
    df = spark.createDataFrame([(i, t, la, s, "x", "y", 1) for i, (la, s, t) in enumerate(data)], "doc_id long, text string, lang string, source string, term string, item string, n int")
    for top in (200, 6):
        got = sorted(tuple(r) for r in divergence.audit(df.repartition(7), top=top).collect())
        assert got == sorted(audit_by_force(data, top=top))
    assert divergence.audit(df.limit(0)).collect() == []


def test_band_keeps_what_few_dominate():
    r = np.random.default_rng(4)
    n, whole, name = r.integers(1, 12, 800), r.integers(3, 15, 800), r.permutation(800)
    dominators = [int(((n >= n[i]) & (whole <= whole[i]) & (name < name[i])).sum()) for i in range(800)]
    for k in (1, 5, 60):
        assert sorted(divergence.band(n, whole, name, k)) == [i for i, d in enumerate(dominators) if d < k]


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 10, 3), (8 * 10**15, 8 * 10**15, 10**9), (123456789012, 9 * 10**14, 7), (10**15 + 7, 3 * 10**15 + 1, 999_983)]
    df = spark.createDataFrame(cases, "n long, total long, terms long").select("n", "total", "terms", divergence._share("n", "total", "terms").alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in cases]
