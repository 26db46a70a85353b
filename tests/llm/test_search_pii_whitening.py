"""Lexical search, personal data and whitening against plain loops, on the smallest tables and on odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlake.llm import lexical, pii, queries, whitening
from tests.llm import brute

CLASH = ["item", "term", "n", "words", "spans", "x", "c", "rank", "score", "text_key", "component"]

# --- lexical search ---------------------------------------------------------


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ranking(docs, items, top=20):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if gone else d, -s) for i, (s, gone, d) in enumerate(sorted(scored)[:top])]
    return sorted(map(repr, out))


WORDS = "alpha beta gamma delta été Über naïve 12 x9 omega".split()


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices(WORDS, range(len(WORDS), 0, -1), k=draw.randint(1, 40)))) for i in range(120)]
    rows += [(200 + i, "alpha beta") for i in range(60)]  # one length, one score
    rows += [(300, None), (301, ""), (302, " ,;\n"), (None, "omega omega x9"), (None, None), (303, "OMEGA"), (303, "OMEGA"), (303, "omega x9")]
    return rows + [(400, "alpha " * 5000 + "omega")]


QUERIES = [(1, "Alpha omega"), (2, "omega omega x9, été"), (3, None), (4, ""), (5, "nowhere"), (6, "beta"), (7, "Über-naïve 12"), (None, "delta")]


def test_search(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    items = spark.createDataFrame(QUERIES + [QUERIES[0]], "item_id long, text string").withColumns({"n": F.lit(1), "doc_id": F.lit(2)})
    want = ranking(corpus, QUERIES)
    assert sorted(repr(tuple(r)) for r in lexical.search(docs, items).collect()) == want
    assert sorted(repr(tuple(r)) for r in lexical.search(docs, items, block_terms=3).collect()) == want
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_visits_stop_early_and_lose_nothing():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 6, 4000)
    m = np.sort(draw.integers(75, 400, len(sizes)))
    held = [np.sort(draw.choice(50, s, replace=False)) for s in sizes]
    tf = draw.geometric(0.6, sizes.sum())
    strata = lexical.Strata(m, np.concatenate(held), tf, sizes, 50)
    query, weights = np.array([3, 7, 30]), np.array([9000, 40, 10])
    ids, null = np.arange(len(m)), np.zeros(len(m), bool)
    best = lexical.Best(20)
    visited = lexical.visit(strata, query, weights, best, ids, null)
    assert 0 < visited < strata.levels / 2
    want = np.zeros(len(m), np.int64)
    for doc, t, f in zip(np.repeat(ids, sizes), np.concatenate(held), tf):
        want[doc] += sum(int(w) * (10**9 * int(f) // (1000 * int(f) + 12 * int(m[doc]))) for q, w in zip(query, weights) if q == t)
    order = np.lexsort((ids, -want))[:20]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == want[order].tolist()
    huge = np.array([1 << 51, 3, 5])  # sums beyond doubles
    exact, plain = strata.lists(query)
    docs, scores = strata.scores(exact[plain], np.broadcast_to(huge // 10**6, plain.shape)[plain])
    assert scores.dtype == np.int64 and len(docs)


# --- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, value):
    digits = [int(c) for c in value if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        turned = digits[::-1]
        return 16 <= len(digits) <= 19 and (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]


def disclosure(docs, contexts, limit):
    """word -> disclosure, by loops."""
    holds, near, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    words = collections.Counter()
    for text in docs:
        text = text or ""
        words.update(set(terms(text)))
        spans = plain_spans(text)
        entities, pairs = set(), {}
        free = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text) if not any(a < m.end() and m.start() < z for a, z, _ in spans)]
        for a, z, kind in spans:
            who = text[a:z].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:z])
            entities.add((kind, who))
            around = [m[0] for m in free if m.end() <= a][-10:] + [m[0] for m in free if m.start() >= z][:10]
            around = [terms(w)[0] for w in around]
            for w in around:
                pairs.setdefault((kind, who, w), tuple(around))
        holds.update(entities)
        near.update(pairs.keys())
        for pair, context in pairs.items():
            seen[pair].add(context)
    out = {}
    for (kind, who, w), both in near.items():
        fe, n = holds[kind, who], len(docs)
        if len(seen[kind, who, w]) >= contexts and fe < n:
            d = math.log(n * both / (words[w] * fe)) / math.log(n / fe)
            out[w] = max(d, out.get(w, 0))
    return {w: d for w, d in out.items() if d >= limit}


def all_spans(text, words, remove):
    base = plain_spans(text)
    found = [(m.start(), m.end(), "remove" if words[w] >= remove else "generalise")
             for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "") if (w := terms(m[0])[0]) in words]
    return base, sorted((s for s in found if not any(a < s[1] and s[0] < z for a, z, _ in base)), key=lambda s: (s[2], s[0]))


def joined(spans):
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


@pytest.fixture(scope="module")
def private():
    draw = random.Random(9)
    fill = lambda: " ".join(draw.choices(WORDS[:6], k=12))
    rows = [(i, fill(), "a") for i in range(40)]
    rows += [(100 + i, f"{fill()} Zorblatt écrit à Ann@mail.example.com — {fill()} Quux", "a") for i in range(6)]
    rows += [(110 + i, f"Halfway {fill()} {'call +1 (743) 555-3824' if i < 4 else ''} now", "b") for i in range(8)]
    rows += [(120, "The Zorblatt file, 4111 1111 1111 1111 and 10.0.0.255, zorblatt!", None), (121, None, None), (122, "", "b"), (None, "q@w.e", "b")]
    rows += [(123, "id x@y.zz", "a"), (123, "id x@y.zz", "a"), (123, "other Zorblatt", "a"), (124, "1.2.3.256 4111111111111112 +1-2", "a")]
    return rows + [(125, "é" * 3 + " " + "a." * 20000 + "@b.c" + " 1" * 20000, "a")]


def test_private_rows(spark, private):
    docs = spark.createDataFrame(private, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASH}).repartition(4)
    words = disclosure([t for _, t, _ in private], 3, 0.6)
    assert words["zorblatt"] < 1.0 and "alpha" not in words
    want = []
    for d, t, _ in private:
        base, more = all_spans(t, words, 0.85)
        kinds = collections.Counter(k for _, _, k in [*base, *more])
        want.append((d, *(kinds[k] for k in pii.KINDS[:4]), brute.sha(joined(base)), joined([*base, *more]), kinds["generalise"], kinds["remove"]))
    got = pii.scan(docs, generalise=0.6, remove=0.85).drop("text_key").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert any(w[-1] for w in want) and any(w[-2] for w in want)
    assert pii.scan(docs.limit(0)).count() == 0
    cut = pii.sanitise_documents(docs, generalise=0.6, remove=0.85)
    assert cut.columns == docs.columns and cut.count() == len(private)
    texts = {r.doc_id: r.text for r in cut.where("doc_id in (100, 120, 121)").collect()}
    assert "[email]" in texts[100] and "zorblatt" not in texts[100].lower() + texts[120].lower() and texts[121] is None
    assert "[card]" in texts[120] and "[ip]" in texts[120]


def test_patterns_match_the_regular_expressions():
    draw = random.Random(3)
    parts = ["a", "@", "b.c", ".", "..", "1", "+", "2", "55", " ", "-", "(", ")", "_", "%", "é", "4111111111111111", "1.2.3.4", "256"]
    for _ in range(20000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = disclosure(list(texts.values()), pii.CONTEXTS, pii.GENERALISE)
    rows = queries.op12_pii(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) and sum(r.n_card for r in rows)
    for r in rows:
        base, more = all_spans(texts[r.doc_id], words, pii.REMOVE)
        assert (r.base_sha256, r.spans) == (brute.sha(joined(base)), joined([*base, *more]))


# --- whitening --------------------------------------------------------------


def check_whitening(rows, vectors, wanted=8):
    x = np.floor(1024 * np.array([v for _, v in vectors], dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    z = (x * n - sums) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = int(np.sum(values[:wanted] > values[0] * 1e-12))
    assert len(rows) == n * k
    by_id = {(r.vec_id, r.component): r for r in rows}
    for j in range(k):
        want = z @ basis[:, j] / math.sqrt(values[j])
        got = np.array([by_id[i, j + 1].whitened for i, _ in vectors])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert abs(by_id[vectors[0][0], j + 1].explained - values[j] / values.sum()) < 1e-9
    total = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
    assert [by_id[i, 1].deviation for i, _ in vectors] == total.tolist()
    assert {r.n for r in rows} == {n} and {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-9
    return k


def test_whitening_query(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert check_whitening(queries.op13_whitening(spark, sf).collect(), vectors) == 8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(12) * np.r_[9, 9, 1:11]).tolist()) for i in range(90)]
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")]), (904, [float("-inf")] * 12), (905, [1.0] * 11), (906, [1e300] * 12)]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASH})
    assert check_whitening(whitening.whiten(make(good + bad).repartition(3)).collect(), good) == 8
    assert check_whitening(whitening.whiten(make([(i, v[:3]) for i, v in good])).collect(), [(i, v[:3]) for i, v in good]) == 3
    flat = [(i, [v[0], v[1], v[0] + 0.0, 5.0]) for i, v in good]  # rank two
    assert check_whitening(whitening.whiten(make(flat)).collect(), flat) == 2
    assert whitening.whiten(make(bad[:1])).count() == 0 and whitening.whiten(make(good).limit(0)).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 5)).count() == 0  # all alike
    rows = whitening.whiten(make(good[:40] + [(None, good[0][1]), good[3]])).collect()
    assert len(rows) == 42 * 8 and sum(r.vec_id is None for r in rows) == 8 and sum(r.vec_id == 3 for r in rows) == 16


def test_ties_and_close_eigenvalues():
    class Fixed(whitening.Moments):
        def __init__(self, matrix):
            self.matrix, self.n, self.d, self.passes = matrix, 10, len(matrix), 0

        def times(self, block):
            self.passes += 1
            return self.matrix @ block

    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for spectrum in (np.ones(80), np.r_[1e6, 1e3, np.ones(78)], np.linspace(1, 1.001, 80), 2.0 ** -np.arange(80), np.r_[5, 5, 5, np.full(77, 1e-9)]):
        m = Fixed((turn * np.sort(spectrum)) @ turn.T)
        values, basis, residual = whitening.eigenpairs(m)
        want = np.sort(spectrum)[::-1][: len(values)]
        assert np.abs(values - want).max() <= 1e-12 * want[0] and residual < 1e-10 and m.passes < 400
        assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-10


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [3, 5]])
    sums = x.sum(axis=0)
    want = [sum((2 * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 2, sums) == [w if w < 2**63 else None for w in want]
    assert whitening.deviations(x // 7, 2, (x // 7).sum(axis=0))[1] is None
