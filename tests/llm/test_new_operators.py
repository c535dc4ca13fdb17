"""Source divergence and personal data against brute force; the tagger by its gradient and held-out windows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("lumenfold.llm")

from lumenfold.llm import brown, divergence, pii, toxicity, warc  # noqa: E402

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, a string, b string, docs long, part string, value string, item string, slot int, v string"
TAIL = (0, "t", 1, "a", "b", 2, "p", "v", "i", 3, "v")


def frame(spark, rows):
    """rows: doc_id, text, lang, source; the other columns' names clash with those used inside."""
    return spark.createDataFrame([(*r, *TAIL) for r in rows], SCHEMA)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcéß日") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(240):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["big", "big", "s1", "s2", "s3", None, "", "ü"])
        low = rng.randint(0, 40)
        rows.append((k % 200, " ".join(rng.choice(words[low : low + 20]) for _ in range(rng.randint(0, 60))).upper(), lang, source))
    rows += [(1, None, "en", "nothing"), (None, "", "en", "empty"), (3, "The-the THE 1the2 ", "xx", "alone"), (4, None, "yy", "p"), (4, "one two", "yy", "q")]
    rows += [(5, "Common word " * 3, "en", "copies")] * 30 + [(6, "long " * 40000, "de", "long")]
    return rows


def brute(rows):
    docs = [((lang or ""), (source or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))) for _, text, lang, source in rows]
    df, by = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, c in docs:
        df[lang].update(c.keys())
        by[lang][source].update(c)
    out = set()
    for lang, groups in by.items():
        kept = [t for t, n in df[lang].items() if n >= 10]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        q, f = share(sum(groups.values(), Counter())), lambda x, y: (x - y) ** 2 // (x + y)
        p = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, o, value, k + 1) for k, (value, o) in enumerate(found) if part == "pair" or k < 10}
    return out


def rows_of(df):
    got = df.collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got}


def test_divergence(spark):
    rows = corpus()
    want = brute(rows)
    assert rows_of(divergence.source_divergence(frame(spark, rows).repartition(5))) == want
    assert any(r[2] == "pair" and r[4] == 0 for r in want) and any(r[0] == "" for r in want)


def test_divergence_in_many_tiles_and_small_steps(spark, monkeypatch):
    """Blocks of two sources, matrices of a few terms and runs let go early change nothing."""
    for name, value in (("SIDE", 2), ("CELLS", 8), ("HELD", 50), ("FREQUENT", 3)):
        monkeypatch.setattr(divergence, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = corpus()
        assert rows_of(divergence.source_divergence(frame(spark, rows).repartition(3))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, [])).collect() == []
    assert divergence.source_divergence(frame(spark, [(1, "a b", "en", "s")])).collect() == []


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(1)
    count = [rng.randrange(1, 9 * 10**15) for _ in range(200)]
    of = [c + rng.randrange(0, 10**15) for c in count]
    assert divergence.shares(np.array(count), np.array(of)).tolist() == [1 + 10**9 * c // n for c, n in zip(count, of, strict=True)]


# ---- personal data


def by_patterns(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"]
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans_are_the_patterns():
    rng, hits = random.Random(2), Counter()
    alphabet = ["@", ".", "a", "B", "1", "0", "255", "256", "-", " ", "+", "(", ")", "é", "\n", "4111111111111111", "10.0.0.1", "x@y.z", "+1 (017) 555-7713", "%", "_", "日"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == by_patterns(text), text
        hits.update(k for k, _, _ in pii.base_spans(text))
    assert min(hits[k] for k in pii.KINDS) > 100


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("a", "1", "1.", "@", "a@", "+1(", "1 ", "a@b", "[at]"):
        pii.base_spans(part * 300_000)
        pii.marked_windows(part * 300_000)
    assert time.perf_counter() - began < 30


def test_gradient_is_that_of_the_likelihood():
    rows = pii.examples([], 5)
    c, tags = pii.encoded(rows)
    model = pii.Tagger()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        e = model.emissions(c).astype(np.float64)
        total = np.log(model.posterior(e)[4].astype(np.float64)).sum(axis=0) + e.max(axis=2).sum(axis=0)
        t, n = np.arange(len(e))[:, None], np.arange(e.shape[1])[None]
        return float((total - e[t, n, tags.T].sum(axis=0) - model.p["first"][tags[:, 0]] - model.p["next"][tags[:, :-1], tags[:, 1:]].sum(axis=1)).mean())

    grads, rng = model.gradients(c, tags), np.random.default_rng(0)
    for k, v in model.p.items():
        at = (0, 1) if k == "next" else tuple(rng.integers(0, d) for d in v.shape)
        old, numbers = v[at], []
        for h in (1e-3, -1e-3):
            v[at] = old + h
            numbers.append(loss())
        v[at] = old
        assert abs((numbers[0] - numbers[1]) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at])), k


def test_viterbi_is_the_best_path(monkeypatch):
    """Against all tag sequences of a short window."""
    import itertools

    model, rng = pii.Tagger(), np.random.default_rng(4)
    e = rng.normal(0, 3, (4, 6, len(pii.TAGS))).astype(np.float32)
    model.p["next"] = rng.normal(0, 1, (len(pii.TAGS),) * 2).astype(np.float32)
    monkeypatch.setattr(model, "emissions", lambda c: e)
    got = model.decode(np.ones((6, 4), np.int64))
    for n in range(6):
        paths = (p for p in itertools.product(range(len(pii.TAGS)), repeat=4) if all(pii.ALLOWED[a, b] for a, b in itertools.pairwise(p)))
        best = max(paths, key=lambda p: model.p["first"][p[0]] + sum(e[t, n, k] for t, k in enumerate(p)) + sum(model.p["next"][a, b] for a, b in itertools.pairwise(p)))
        assert {t for _, a, b, _ in got[n] for t in range(a, b)} == {t for t, k in enumerate(best) if k}


def test_reconciling_takes_the_heaviest_set():
    import itertools

    rng = random.Random(6)
    for _ in range(200):
        spans = [(a := rng.randint(0, 20), a + rng.randint(1, 8), rng.choice(pii.KINDS), rng.random()) for _ in range(rng.randint(0, 8))]
        weight = lambda some: sum((b - a) * p for a, b, _, p in some)
        free = lambda some: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2))
        got = pii.reconcile(spans)
        assert free(got) and abs(weight(got) - max(weight(s) for k in range(9) for s in itertools.combinations(set(spans), k) if free(s))) < 1e-9


def test_spans_cut_by_windows_are_joined():
    assert pii.join_cut([(50, 128, "card", 0.9, False, True), (64, 150, "card", 0.95, True, False), (150, 160, "card", 0.9, False, False)])[0] == (50, 150, "card", 0.95)
    assert len(pii.join_cut([(50, 60, "card", 0.9, False, False), (55, 70, "card", 0.9, False, False)])) == 2


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.examples([]))


def test_held_out_windows(model):
    rows = pii.examples([], 300, seed=77)
    right = found = true = 0
    for (_, spans), got in zip(rows, model.decode(pii.encoded(rows)[0]), strict=True):
        got = {(k, a, b) for k, a, b, _ in got}
        right, found, true = right + len(got & set(spans)), found + len(got), true + len(spans)
    assert right / found > 0.8 and right / true > 0.8


def test_personal_data(spark, model):
    texts = [None, "", " ", "no data at all", "a@b.co and 10.1.2.3, card 4111 1111 1111 1111, call +1 (017) 555-7713.", "999.1.1.1 4111111111111112 +1 2",
             "naïve 日本 x@y.example.com", "please write to jane.doe [at] example.com or call (030) 555-1234 today", "plain prose " * 20000 + "me@host.org" + " more prose" * 20000]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(4, texts[4], None, None)] * 3 + [(None, texts[4], None, None)]
    got = pii.personal_data(frame(spark, rows).repartition(3), model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    held = {i: t for i, t, _, _ in rows}
    for r in got:
        base = by_patterns(held[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, text.split(","))) <= set(spans) and r.n_added == len(spans) - len(base)
    assert next(r for r in got if r.doc_id == 3).spans == "" and pii.personal_data(frame(spark, []), model).collect() == []


def test_forms_that_the_rules_miss_are_added(model):
    """In plain texts, most of them whole; nothing is added to texts without personal data."""
    rng, finder, right = np.random.default_rng(12), pii.Finder(model), 0
    for k in range(80):
        kind = pii.KINDS[k % 4]
        s = pii.variant(kind, pii.made_up(kind, rng), rng)
        text = "we met at the old mill and " * 8 + "then wrote to " + s + " about it, " + "as it was said before " * 6
        if not any(t[0] == kind for t in pii.base_spans(text)):
            right += (kind, text.index(s), text.index(s) + len(s)) in finder.added([text], [pii.base_spans(text)])[0]
    assert right >= 40
    plain = ["version 2.0 of 2024-01-02, 12:30:45", "order 12345 of 7 items", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "@handle said 1,234.56"]
    assert finder.added(plain, [[]] * 4) == [[]] * 4


def test_sample_is_bounded_and_the_same_for_any_partitions(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", f"u{k}@mail.org", "10.0.0.7", "12"]) for _ in range(30)), "en", "s") for k in range(300)]
    rows += [rows[0]] * 500
    sample = lambda n: {tuple(r) for r in pii.labelled(frame(spark, rows).repartition(n), 20).collect()}
    assert sample(2) == sample(7) and max(Counter(r[0] for r in sample(3)).values()) == 20


def test_fit_in_a_task(spark):
    """A few steps only; also of a table without personal data."""
    for rows in ([(1, "mail me@host.org now", "en", "s"), (2, None, "en", "s")], []):
        assert pii.fit(frame(spark, rows), n=40, steps=3).p["out"].shape == (2 * pii.HIDDEN, len(pii.TAGS))


# ---- mended operators


def test_archives_are_read_in_linear_time():
    import time

    records = [warc.build_record(k, "u", b"<p>page %d</p>" % k * 9, None) for k in range(16_000)]
    archive = warc.compress(records)
    began = time.perf_counter()
    assert list(warc.decompress(archive)) == records and time.perf_counter() - began < 1
    with pytest.raises(ValueError):
        list(warc.decompress(archive[:-3]))


def test_placing_sums_a_words_cells_first(spark):
    """A word with very many entries has one entry a cell when it is placed; the class is the same as of its sums."""
    m, of = np.array([[50.0, 3], [4, 60]]), np.array([0, 1, 1])
    cells = 2 * len(m) + 2
    rows = [(b"w", cells * 2 + 0)] * 3000 + [(b"w", cells * 1 + 3)] * 7 + [(b"v", cells * 5 + 2)]
    df = spark.createDataFrame(rows, "word binary, code long").selectExpr("word", "cast(null as binary) as second", "code").repartition(5)
    many = {bytes(r.word): (r.c, r.k, r.cells) for r in brown.place(df, of, m, 1).collect()}
    few = spark.createDataFrame([(b"w", cells * 6000), (b"w", cells * 7 + 3), (b"v", cells * 5 + 2)], "word binary, code long").selectExpr("word", "cast(null as binary) as second", "code")
    assert many == {bytes(r.word): (r.c, r.k, r.cells) for r in brown.place(few, of, m, 1).collect()} and many[b"w"][2] == [6000, 0, 0, 7]
    plan = brown.place(df, of, m, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sum(") > plan.index("collect_list(")  # below it


def test_learned_kinds_swap_in_the_given_documents(spark):
    """The penalty acts on the tables themselves: other weights, smaller score changes, and no word that speaks for the label is swapped."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    free, held = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, toxicity.PENALTY))
    assert held.swaps == free.swaps > 300 and held.kinds == free.kinds and len(held.kinds) >= 5
    assert np.abs(free.weights - held.weights).max() > 0.1
    of = {t: k for k, kind in enumerate(held.kinds) for t in kind}
    assert not {"idiot", "clown"} & set(of)
    texts = [r.text for r in docs.where("doc_id % 4 = 0 and text is not null").collect()]
    pairs = [(t, x) for t in texts for x in toxicity.swapped(t, held.kinds, of)]

    def logits(model, texts):
        import pyarrow as pa

        from lumenfold.llm.text import blocks

        p = np.concatenate([model.score(b) for b in blocks([pa.record_batch([pa.array(texts)], ["text"])], lower=True)])
        return np.log(p / (1 - p))

    change = [np.abs(logits(m, [a for a, _ in pairs]) - logits(m, [b for _, b in pairs])).mean() for m in (free, held)]
    assert len(pairs) > 100 and change[1] < 0.2 * change[0]


def test_kinds_by_neighbours():
    rows = [(w, place, n) for w, places in {b"aa": (1, 2, 3), b"bb": (1, 2, 3), b"cc": (7, 8), b"dd": (7, 8), b"ee": (40,)}.items() for place, n in zip(places, (9, 4, 2), strict=False)]
    assert sorted(map(sorted, toxicity.learned_kinds(rows))) == [["aa", "bb"], ["cc", "dd"]] and toxicity.learned_kinds([]) == []
    kinds, of = [("aa", "bb")], {"aa": 0, "bb": 0}
    assert toxicity.swapped("AA x bb, aa", kinds, of).__len__() == 2 and set(toxicity.swapped("AA x bb, aa", kinds, of)) == {"bb x bb bb", "aa x aa aa"} and toxicity.swapped("none", kinds, of) == []


def test_class_score_is_that_of_counted_classes(spark):
    """The class model counted by a loop, from the classes that training gave to words."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    texts = [(i, rng.choice([None, "", "new words only%d" % i]) if i % 19 == 0 else " ".join(vocabulary[int(200 * rng.random() ** 2)] for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs, how = frame(spark, [(i, t, "en", "s") for i, t in texts]).repartition(3), {"classes": 6, "frequent": 40, "least": 2, "top": 15}
    t = brown.train(docs.where(~brown.held_out()), brown.Scratch(spark), **how)
    words, of = t.words.value, t.model.of
    k = {w.decode(): int(of[brown.FIRST + i]) for i, w in enumerate(words.words.to_pylist())} | {bytes(r.word).decode(): r.k for r in t.others.collect()}
    k[None], rare = int(of[brown.END]), int(of[brown.RARE])
    got = {r.doc_id: r for r in brown.class_scores(docs, **how).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW)), None] for i, x in texts}
    c, pairs = Counter(), Counter()
    for i, w in tokens.items():
        if not got[i].held_out:
            c.update(w)
            pairs.update((k[a], k[b]) for a, b in zip([None, *w], w))
    assert set(k) == set(c) | {None} and len({k[w] for w in k}) > 3 and any(k[w] != rare for w in c if w not in {x.decode() for x in words.words.to_pylist()} and w)
    size, members = Counter(), Counter(k.values())
    for w, n in c.items():
        size[k[w]] += n
    of_class = [sum(pairs[a, b] for b in range(6)) for a in range(6)]
    for i, w in tokens.items():
        score = 0.0
        for a, b in zip([None, *w], w):
            a, kb = k.get(a, rare), k.get(b, rare)
            score += np.log10((pairs[a, kb] + 0.5) / (of_class[a] + 3)) + np.log10((c[b] + 0.5) / (size[kb] + 0.5 * (members[kb] + 1)))
        assert got[i].score == pytest.approx(score, rel=1e-9), i


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_fit_reaches_the_least_loss(penalty):
    """Against Newton's method, which solves this smooth and convex problem to the last digits."""
    rng, size, share, ridge = np.random.default_rng(4), 12, 0.2, 3e-3
    rows = []
    for _ in range(200):
        has, toxic = np.flatnonzero(rng.random(size) < 0.3), int(rng.random() < 0.4)
        has = np.union1d(has, [0]) if toxic and rng.random() < 0.6 else has
        rows.append((toxic, has, [(has[has != j], np.union1d(has, [j]), bool(rng.random() < 0.5)) for j in rng.choice(size, 2)]))
    y, x = np.array([r[0] for r in rows]), np.zeros((len(rows), size + 1))
    x[:, size] = 1
    for i, r in enumerate(rows):
        x[i, r[1]] = 1
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    inserted = np.array([p[2] for r in rows for p in r[2]])
    d = np.array([np.isin(np.arange(size + 1), p[0]) * 1.0 - np.isin(np.arange(size + 1), p[1]) for r in rows for p in r[2]])
    each = penalty / np.where(inserted, inserted.sum(), (~inserted).sum())
    still = np.diag(np.append(np.full(size, ridge), 0)) + 2 * (d.T * each) @ d
    loss = lambda w: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + w @ still @ w / 2
    best = np.zeros(size + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ best))
        best -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + still, x.T @ (weight * (p - y)) + still @ best)
    w, bias = toxicity.minimise(rows, size, share, penalty, ridge)
    assert 0 <= loss(np.append(w, bias)) - loss(best) + 1e-12 < 1e-9 and np.abs(np.append(w, bias) - best).max() < 1e-5
