"""Whitening, personal data and ranked search, and their queries over small tables, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.helpers import corpus, documents, words

from variantloom.llm import dualtree, pii, whitening


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_value(rows):
    return sorted(map(repr, rows))


# --- whitening


def spectrum(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [[9, 7, 5, 3, 1, 0.5], [5] * 6, [1, 0.5, 0.3, 0.2, 0.2 - 1e-7, 0.1], [8, 4, 4, 2, 2, 2, 1], [3, 2, 0, 0, 0], np.exp(-np.arange(40.0)), 1 + 1e-3 * np.arange(50)],
)
def test_contour_finds_the_same_pairs_as_a_dense_solver(values):
    v = spectrum(values)
    found, vectors = whitening.top_components(v, 4)
    assert np.allclose(found, np.sort(values)[::-1][:4], rtol=1e-12, atol=1e-13)
    assert np.abs(v @ vectors - vectors * found).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_inertia_counts_equal_eigenvalue_counts():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    form, values = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for shift in rng.uniform(-12, 12, 200):
        assert whitening.count_above(form, shift) == (values > shift).sum()


def test_a_missed_eigenvalue_is_an_error():
    v = np.diag([5.0, 4.0, 3.0, 2.0, 1.0, 0.5])
    with pytest.raises(ArithmeticError):
        whitening.feast(v, 2.5, 5.5, 4)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 0.5) for r in rows], "vec_id bigint, embedding array<float>, label int, n string, component double")


def sample_vectors():
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.4, 0.2] + [0, 100, -3, 0, 0, 0]).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(data)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [1.0, 2.0]), (905, [])]
    return rows + rows[:40] + [(None, rows[3][1])] + [(i, rows[7][1]) for i in range(1000, 1200)] + odd


def plain_whitening(rows):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    mean = sums / n
    cov = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, x in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(4):
            out.append((i, c + 1, n, deviation, abs(float((x - mean) @ u[:, c] / np.sqrt(e[c]))), e[c] / np.trace(cov)))
    return out


def test_whitening_query(spark, tmp_path):
    rows = sample_vectors()
    vectors(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_feast(spark, str(tmp_path)).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    ours = sorted((key((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"])) for r in got))
    want = sorted(map(key, plain_whitening(rows)))
    assert len(ours) == len(want)
    assert all(a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-9) for a, b in zip(ours, want, strict=True))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    # the sign of a component is the same for all rows
    mean = np.mean(np.array(sorted({tuple(math.floor(256 * c) for c in v) for i, v in rows[:300]})), axis=0)
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows[:300]]) - mean
    direction = x.T @ [first[i] for i in range(300)]
    assert (np.sign(x @ direction) == np.sign([first[i] for i in range(300)])).all()


def test_whitening_of_few_and_no_rows(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 2
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}


# --- personal data


def plain_base(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            value = int(c) * (2 if i % 2 else 1)
            total += value - 9 if value > 9 else value
        return total % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_patterns_equal_plain_regular_expressions():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab@@..-_0123456789+ ()é\U0001f600", k=rng.randint(0, 60))) for _ in range(20000)]
    texts += ["a@b.c_d@e.f@g.h", "0000.1.1.01.5.6.7.8.9", "4111 1111 1111 1111 4111111111111111", "+1 (017) 555-7713.", "+1 23 +12345678901"]
    for text in texts:
        assert [(pii.KINDS[k - 1], a, b) for k, a, b in pii.base_spans(text)] == plain_base(text), text


@pytest.mark.parametrize("bad", ["1" * 200000, "a." * 100000, "@" * 100000, "a@" * 50000, "+1" + " ." * 100000, "1.1." * 50000, " at " * 50000, "(at)" * 50000, "1 " * 100000, "+(1" * 50000])
def test_no_text_makes_the_search_slow(bad):
    import time

    start = time.time()
    pii.nodes_of(bad)
    assert time.time() - start < 10


def small_field(seed=1):
    rng = random.Random(seed)
    n = 4
    kinds = ["4111 1111 1111 1111", "4111.1111.1111.1111", "(017) 555-7713", "+1 (017) 555-7713", "1234567"]
    return pii.nodes_of(" word ".join(rng.choices(kinds, k=n)))


def brute_posteriors(model, g, held):
    """Sums over all labellings of a small field."""
    from itertools import product

    own, pair = g.features @ model.own, model.potentials()
    total = np.zeros_like(own)
    for labels in product(range(own.shape[1]), repeat=len(own)):
        if any(h >= 0 and h != y for h, y in zip(held, labels, strict=True)):
            continue
        score = sum(own[i, y] for i, y in enumerate(labels) if held[i] < 0)
        score += sum(pair[g.types[e], labels[g.source[e]], labels[g.target[e]]] for e in range(0, len(g.types), 2))
        for i, y in enumerate(labels):
            total[i, y] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(4)
    model = pii.Field(rng.normal(0, 0.5, (len(pii.FEATURES), 5)), rng.normal(0, 0.5, (5, 5)), np.abs(rng.normal(0, 0.7, (3, 2))))
    chain = pii.nodes_of("1234567 word 7654321 word (017) 555-1234 word 98765432")
    g = pii.graph_of([chain])
    held = np.where(g.kinds > 0, g.kinds, -1)
    assert np.abs(model.posteriors(g, held) - brute_posteriors(model, g, held)).max() < 1e-3
    for seed in range(6):
        g = pii.graph_of([small_field(seed)])
        held = np.where(g.kinds > 0, g.kinds, -1)
        assert np.abs(model.posteriors(g, held) - brute_posteriors(model, g, held)).max() < 0.1


def personal_texts(seed, n):
    """Texts with base spans, later repeats that no base pattern takes (to find), and other numbers (to leave alone)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    rows = []
    for _ in range(n):
        area, line = digits(3), f"555-{digits(4)}"
        name = f"user{digits(3)}.{rng.choice('abcdef')}x"
        card = next(c for c in ("4" + digits(15) for _ in iter(int, 1)) if pii.luhn(c))
        parts = [card[i : i + 4] for i in range(0, 16, 4)]
        ip = [str(rng.randint(1, 254)) for _ in range(4)]
        pairs = [
            (f"+1 ({area}) {line}", rng.choice([f"({area}) {line}", f"{area}.{line.replace('-', '.')}", line])),
            (f"{name}@mail.example.com", rng.choice([f"{name} (at) mail.example.com", f"{name}@mail", f"{name} at mail.example.com"])),
            (" ".join(parts), rng.choice([".".join(parts), "/".join(parts)])),
            (".".join(ip), "-".join(ip)),
        ]
        first, again = rng.choice(pairs)
        noise = [f"{digits(8)}", f"n {digits(16)}", f"{digits(4)}/{digits(4)}", "meet at noon", "see at home"]
        filler = words(rng.random(), 30)
        text = " ".join([*filler[:10], "x:", first, "; y", *filler[10:18], "z:", rng.choice(noise), "; and", rng.choice(noise), ";", *filler[18:], "so:"])
        planted = None
        if rng.random() < 0.6:
            planted = (len(text) + 1, len(text) + 1 + len(again))
            text = f"{text} {again} end"
        rows.append((text, planted))
    return rows


def test_labels_are_carried_to_repeats():
    rows = personal_texts(1, 400)
    model = pii.train([pii.nodes_of(t) for t, _ in rows])
    held_out = personal_texts(2, 400)
    nodes = [pii.nodes_of(t) for t, _ in held_out]
    found = wrong = planted = 0
    for (_, want), own, labels in zip(held_out, nodes, pii.labelled(nodes, model), strict=True):
        added = {(n["start"], n["end"]) for n, (k, _) in zip(own, labels, strict=True) if k and not n["kind"]}
        planted += want is not None
        found += want in added
        wrong += len(added - {want})
    assert found >= 0.95 * planted and wrong <= 0.03 * len(held_out)
    # without agreement between distant mentions nothing tells a line number or a short address from others
    lone = pii.Field(model.own, model.chain, np.zeros((3, 2)))
    apart = sum(
        want in {(n["start"], n["end"]) for n, (k, _) in zip(own, labels, strict=True) if k and not n["kind"]}
        for (_, want), own, labels in zip(held_out, nodes, pii.labelled(nodes, lone), strict=True)
    )
    assert apart < 0.7 * found


def test_personal_data_query(spark, tmp_path):
    extra = [(50 + i, t) for i, (t, _) in enumerate(personal_texts(3, 60))] + [(None, "a@b.cc 10.0.0.1"), (None, "a@b.cc 10.0.0.1")]
    rows = [*corpus(), *extra]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op12_skipchain(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        base = plain_base(text or "")
        counts = Counter(k for k, _, _ in base)
        want.append((i, *[counts[k] for k in pii.KINDS], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))))
    assert by_value(tuple(r)[:6] for r in got) == by_value(want)
    texts = dict(rows)
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
        base = plain_base(texts[r["doc_id"]] or "") if r["doc_id"] is not None else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    assert sum(len(r["spans"].split(",")) for r in got if r["spans"]) > sum(sum(tuple(r)[1:5]) for r in got)


def test_personal_data_of_no_rows(spark):
    assert pii.find(documents(spark, [])).collect() == []
    assert [r["spans"] for r in pii.find(documents(spark, [(1, None), (2, "")])).collect()] == [[], []]


def test_many_repeats_in_one_text_stay_cheap():
    text = "+1 (017) 555-7713 " + "x 555-7713 " * 20000
    labels = pii.labelled([pii.nodes_of(text)], pii.Field.prior())[0]
    assert len(labels) == 20001 and all(k == 4 for k, _ in labels)


# --- ranked search


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranks(items, docs, top=20):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in found:
            m = 75 + (25 * sum(counts.values()) * n_docs) // length if length else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in Counter(plain_terms(text)).items() if counts[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(scores[:top], 1)]
    return out


def search_tables():
    rng = random.Random(9)
    docs = [(i, " ".join(words(100 + i, rng.randint(3, 60), 150))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties across the cut
    docs += [(None, docs[5][1]), (7, docs[7][1]), *corpus(), (2000, "Éa éA a-b A_B"), (2001, " ".join(["w1"] * 5000))]
    items = [(i, " ".join(words(200 + i, 12, 170))) for i in range(60)] + [(70, None), (71, " - "), (72, "unknownword"), (73, docs[5][1]), (0, "w1 w1 W1"), (None, "w2"), (74, "ÉA a b")]
    return docs, items


def test_search_query_equals_scoring_everything(spark, tmp_path, monkeypatch):
    docs, items = search_tables()
    documents(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, score string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = by_value(plain_ranks(items, docs))
    assert by_value(tuple(r) for r in dualtree.op13_dualtree(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(dualtree, "BATCH_ITEMS", 20)
    assert by_value(tuple(r) for r in dualtree.op13_dualtree(spark, str(tmp_path)).collect()) == want


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in dualtree.rank_documents(items, docs).collect()] == [(1, 1, 1)]
    assert dualtree.rank_documents(items.limit(0), docs).collect() == []
    assert dualtree.rank_documents(items, docs.limit(0)).collect() == []
    assert dualtree.rank_documents(items, documents(spark, [(1, None)])).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    n_terms, n_docs, n_items = 300, 700, 50
    topic = rng.integers(0, 10, n_docs)
    rows = [np.unique(np.append(t * 30 + rng.integers(0, 30, 12), rng.integers(0, n_terms, 2))) for t in topic]
    starts = np.append(0, np.cumsum([len(r) for r in rows]))
    terms = np.concatenate(rows)
    impacts = rng.integers(1, 1000, len(terms))
    counts = np.zeros((n_terms, n_items))
    for j in range(n_items):
        counts[(j % 10) * 30 + rng.integers(0, 30, 6), j] = 1
    items = dualtree.item_tree(list(range(n_items)), counts)
    dense = np.zeros((n_docs, n_terms))
    for i in range(n_docs):
        dense[i, rows[i]] = impacts[starts[i] : starts[i + 1]]
    scores = dense @ counts[:, items.ids]
    best = dualtree.Best.start(np.zeros(n_items, np.int64), 5)
    ids = np.empty(n_docs, object)
    ids[:] = list(range(n_docs))
    tree = dualtree.DocumentTree.build(ids, np.array([len(r) for r in rows]), starts, terms, impacts)
    for low, high, own, most in tree.nodes:
        docs_below = np.arange(tree.leaves[low][0], tree.leaves[high - 1][1])
        for q, (a, b) in enumerate(items.nodes):
            below = scores[np.ix_(tree.docs[docs_below].astype(int), np.arange(items.leaves[a][0], items.leaves[b - 1][1]))]
            assert below.max() <= most @ items.node_max[own, q]
    scored = []
    add = best.add
    best.add = lambda i, s, d: (scored.append(len(s)), add(i, s, d))
    dualtree.search(tree, items, best)
    for j in range(n_items):
        order = sorted(range(n_docs), key=lambda d: (-scores[d, j], d))[:5]
        assert best.docs[j].tolist() == order and best.scores[j].tolist() == scores[order, j].tolist()
    assert sum(scored) < n_docs * n_items / 4
