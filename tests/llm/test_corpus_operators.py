"""The corpus operators against brute force, exact round trips and held-out rows; and on odd tables."""

import itertools
import math
import random
import time
from functools import cache

import numpy as np
import pytest

from callscope.llm import ann, decontaminate, edit_counts, jaccard_join, language_id, license_scan, lm_score, mixing, token_output, tokens, url_rules
from callscope.llm.common import words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
R = random.Random(5)
VOCAB = {"en": [a + b for a in ("th", "wh", "sh", "ing") for b in ("e", "at", "or", "and", "ly")], "de": [a + b for a in ("sch", "ei", "un", "ver") for b in ("en", "ung", "ch", "ß")]}


def prose(lang, n):
    return " ".join(R.choice(VOCAB[lang]) + R.choice(VOCAB[lang]) for _ in range(n))


@cache
def corpus():
    rows = [(i, prose(lang, 30 + i), lang, f"s{i % 3}", 1) for i, lang in enumerate(["en", "de"] * 15)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[0][1] + " more", "en", "s1", 1)]
    return rows + [(200, None, None, None, None), (201, "", "en", None, 0), (None, "thing that", "en", "s0", 1), (202, "the", "en", "s1", 3), (202, "the", "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets(text, n=2):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_codec_round_trip():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 3 + [7], np.uint32)
    off = np.array([0, 0, 5, 25])
    control, coff, data, doff = token_output.pack(v, off)
    for k in range(3):
        n = off[k + 1] - off[k]
        assert (token_output.unpack(n, control[coff[k] : coff[k + 1]].tobytes(), data[doff[k] : doff[k + 1]].tobytes()) == v[off[k] : off[k + 1]]).all()


def test_token_output(docs, empty):
    enc = tokens.encoder()
    rank, _ = token_output.ranking(token_output._ids(docs, tokens.TOKENIZER))
    got = sorted((r["doc_id"] or -1, enc.decode(token_output.decode(r["n_tokens"], r["control"], r["data"], rank)).decode()) for r in token_output.token_output(docs).collect())
    assert got == sorted((r[0] or -1, r[1] or "") for r in corpus())
    counts = np.zeros(len(rank), np.int64)
    for r in corpus():
        np.add.at(counts, enc.plain.encode_ordinary(r[1] or ""), 1)
    assert (np.argsort(rank) == np.lexsort((np.arange(len(rank)), -counts))).all()
    assert token_output.token_output(empty).count() == 0
    text = lambda rows: sorted((r[0] or -1, r[1] or "") for r in rows)
    assert text(token_output.decoded(token_output.token_output(docs)).collect()) == text(corpus())


@pytest.mark.parametrize("text", ["", " a", "a  b", "a\n b ", "x 'll y", "é  1  2"])
def test_tokens_are_the_tokenizers(text):
    enc = tokens.encoder()
    assert np.frombuffer(enc.encode(text), "<u2").tolist() == enc.plain.encode_ordinary(text)


def test_gradients():
    m = language_id.BiGRU(["a", "b"], 3)
    m.w = {k: v.astype("f8") for k, v in m.w.items()}
    x, n = language_id.padded([b" abc", b" de"])
    y = np.array([0, 1])
    _, g = m.gradients(x, n, y)
    for k in ("Uf", "Ub", "Vf", "v"):
        i = (0,) * m.w[k].ndim
        m.w[k][i] += 1e-3
        up, _ = m.gradients(x, n, y)
        m.w[k][i] -= 2e-3
        down, _ = m.gradients(x, n, y)
        m.w[k][i] += 1e-3
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-3)


def test_language(spark, docs, empty):
    model = language_id.train(docs)
    fresh = spark.createDataFrame([(i, prose(lang, 40), lang) for i, lang in enumerate(["en", "de"] * 10)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(fresh, model).collect()}
    assert sum(got[r["doc_id"]]["language"] == r["lang"] for r in fresh.collect()) >= 19
    assert all(len(got[r["doc_id"]]["labels"]) == len(r["text"].encode()) for r in fresh.collect())
    odd = language_id.identify(docs, model).where("doc_id in (200, 201)").collect()
    assert len(odd) == 2 and not any(r["accepted"] or r["language"] for r in odd)
    assert language_id.identify(empty).count() == 0
    assert language_id.accepted(docs, model=model).columns == docs.columns
    none = language_id.identify(docs.drop("lang")).collect()
    assert len(none) == docs.count() and not any(r["accepted"] or r["language"] for r in none) and language_id.accepted(docs.drop("lang")).count() == 0


def test_language_reads_the_whole_text(spark):
    m = language_id.BiGRU(["a", "b", "c"], 4, seed=3)
    texts = ["the word and so on " * 9, "é" * 70 + "x", "", "word", "so word on"]
    reader = language_id.Reader(m)
    raw = sorted((t.encode() for t in texts if t), key=len, reverse=True)
    x, n = language_id.padded(raw)
    s = sum(m._run(x, n, d, False)[0] @ m.w["V" + d] for d in "fb") + m.w["v"]
    p = np.exp(s) / np.exp(s).sum(-1, keepdims=True)
    want = {t: p[i, : n[i]] for i, t in enumerate(raw)}
    means, labels = reader.read(texts)
    reader.room = 13
    cut, cut_labels = reader.read(texts)
    for i, t in enumerate(texts):
        if t:
            assert means[i] == pytest.approx(want[t.encode()].mean(0), abs=1e-5) and cut[i] == pytest.approx(means[i], abs=1e-5)
            assert list(labels[i]) == want[t.encode()].argmax(-1).tolist() and cut_labels[i] == labels[i]
    alone, after = (next(m.probs([t]))[1][:, -4:] for t in (b"word", b"so on word"))
    assert np.abs(alone - after).max() > 1e-4


def test_language_by_context(spark):
    r = random.Random(8)
    own, both = {"en": ["the", "and"], "de": ["sch", "ung"]}, ["mono", "tal", "rin", "sa"]
    text = lambda lang, n: " ".join(r.choice(own[lang]) if r.random() < 0.3 else r.choice(both) for _ in range(n))
    d = spark.createDataFrame([(i, text(g, 60), g) for i, g in enumerate(["en", "de"] * 40)], "doc_id bigint, text string, lang string")
    halves = text("en", 40), text("de", 40)
    marks = language_id.Reader(language_id.train(d)).read([" ".join(halves)])[1][0]
    cut = len(halves[0])
    assert marks[:cut].count(1) > 0.8 * cut and marks[cut:].count(0) > 0.8 * (len(marks) - cut)


def runs(a, b, least):
    out = set()
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontaminate(spark, docs, empty, limit):
    rows = corpus()
    bench = [(1, rows[3][1][20:150]), (2, None), (3, "short"), (1, rows[3][1][20:150]), (4, prose("en", 5) + " " + " ".join(rows[5][1].split()[4:16]))]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    want = {(d[0], i, *r) for d in rows if d[0] is not None for i, t in bench for r in runs(words(d[1]), words(t), 8)}
    assert {tuple(r) for r in decontaminate.decontaminate(docs, b, shared_limit=limit).collect()} == want
    left = sorted(r["doc_id"] or -1 for r in decontaminate.clean(docs, b, shared_limit=limit).collect())
    assert left == sorted(r[0] or -1 for r in rows if r[0] is None or r[0] not in {w[0] for w in want})
    assert decontaminate.decontaminate(empty, b).count() == 0 and decontaminate.decontaminate(docs, b.limit(0)).count() == 0


def linked(rows, least=0.7):
    """doc_id -> (class, set, links) of (doc_id, text), by comparing all pairs."""
    own = sorted({(i, frozenset(sets(t)) if t else frozenset()) for i, t in rows if i is not None}, key=lambda d: (d[0], sorted(d[1])))
    near = {k: [m for m, e in enumerate(own) if m != k and d[1] and len(d[1] & e[1]) >= least * len(d[1] | e[1])] for k, d in enumerate(own)}
    top = list(range(len(own)))
    for _ in own:
        for k, ms in near.items():
            for m in ms:
                top[k] = top[m] = min(top[k], top[m])
    rows = sorted((d[0], own[top[k]][0], min([d[0], *(own[m][0] for m in near[k] if own[m][1] == d[1])]), len(near[k])) for k, d in enumerate(own))
    return rows, sorted(own[k][0] for k in set(top))


def near_rows():
    r = random.Random(1)
    base = [[r.choice("abcdefghij") + r.choice("klmnop") for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(60)] = r.choice("xyz") + str(r.randrange(50))
        rows.append((i, " ".join(w)))
    rows += [(80 + i, rows[5][1].upper()) for i in range(6)] + [(7, rows[7][1]), (7, rows[8][1]), (7, "of its own")]
    return rows + [(70, "one"), (71, "One!"), (72, ""), (73, None), (None, rows[0][1])]


def test_runs_of_repetitive_texts():
    r = random.Random(2)
    for case in range(60):
        period = r.randrange(1, 8)
        a = [r.choice("xyz")] * r.randrange(0, 5) + (["p%d" % (i % period) for i in range(r.randrange(8, 60))]) + [r.choice("xyz") for _ in range(r.randrange(0, 9))]
        b = [r.choice("xyz")] * r.randrange(0, 3) + (["p%d" % (i % period) for i in range(r.randrange(8, 40))]) + (a[5:25] if case % 2 else [])
        if case % 3 == 0:
            a[len(a) // 2] = "q"
        index = decontaminate.Index([1], [" ".join(b)], 4, 5)
        got = index.hits(*decontaminate.word_hashes([" ".join(a), "", " ".join(a[3:])]))
        for k, text in ((0, a), (2, a[3:])):
            assert {(x, y, n) for t, _, x, y, n in zip(*map(list, got)) if t == k} == runs(text, b, 8)


def test_long_runs_end():
    w = [f"w{i}" for i in range(1_000_000)]
    index = decontaminate.Index([1, 2], [" ".join(w), "same " * 300], 4, 5)
    start = time.time()
    assert [x.tolist() for x in index.hits(*decontaminate.word_hashes([" ".join(w)]))] == [[0], [0], [0], [0], [1_000_000]]
    assert len(index.hits(*decontaminate.word_hashes(["same " * 1_000_000]))[0]) == 1_000_000 + 300 - 15
    assert time.time() - start < 60


@pytest.mark.parametrize("frequent,very,block", [(64, 2048, 4096), (2, 4, 4096), (2, 4, 3)])
def test_jaccard(spark, empty, frequent, very, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(x) for x in jaccard_join.jaccard_join(d, frequent=frequent, very=very).select("doc_id", "class_id", "set_id", "links").collect()) == linked(rows)[0]
    kept = jaccard_join.deduplicate(d, frequent=frequent, very=very).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == linked(rows)[1]
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_deduplicate_rows(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(50)) for _ in range(3))
    rows = [(5, a), (5, a), (None, a), (7, b), (7, c), (3, b + " more"), (None, None), (None, None)]
    got = jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, a), (7, c), (3, b + " more"), (None, None), (None, None)]))


def test_deduplicate_sends_or_shuffles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SENT", 0)
    rows = near_rows()
    kept = jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == linked(rows)[1]


def test_sketches_never_exceed():
    r = np.random.default_rng(2)
    grams = [r.choice(np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), n, replace=False) for n in (50, 60, 64, 65, 90, 100)]
    s = jaccard_join.Sketches([jaccard_join.sketch(g) for g in grams])
    for i, j in itertools.product(range(6), repeat=2):
        assert s.apart(i, np.array([j]))[0] <= len(set(grams[i].tolist()) ^ set(grams[j].tolist()))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 99)) == list(range(n))


def test_mix(docs, empty):
    got = mixing.mix(docs, block=32, shard=4, weights={"s0": 3, "s1": 1}, slots=40).collect()
    assert len(got) == 40 and len({(r["shard"], r["slot"]) for r in got}) == 40 and {r["source"] for r in got} == {"s0", "s1"}
    want = np.zeros(2, int)
    for j in range(10):
        want += mixing.draw(j, 4, np.array([0.75, 0.25]), mixing.SEED)
    assert [sum(r["source"] == s for r in got) for s in ("s0", "s1")] == want.tolist()
    d = mixing.mixed_documents(docs, block=32)
    assert d.columns == docs.columns and d.count() > 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("held", [20_000, 1])
def test_blocks_are_full_at_any_layout(spark, held, monkeypatch):
    monkeypatch.setattr(mixing, "HELD", held)
    enc = tokens.encoder()
    rows = [(i, prose("en", 20 + i), f"l{i}", f"s{i % 3}", 1) for i in range(30)]
    d = spark.createDataFrame(rows, DOCS).repartition(10)
    got = mixing.blocks(d, 64).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == s]
        texts = sorted(r[1] for r in rows if r[3] == s)
        assert sum(r["n"] < 61 for r in own) <= 1 and all(len(r["ids"]) == 128 for r in own)
        assert sum(r["n"] for r in own) == sum(len(enc.plain.encode_ordinary(t)) + 1 for t in texts)
        assert len({(r["part"], r["seq"]) for r in own}) == len(own)
    mixed = mixing.mix(d, block=64, weights={"s0": 1}, slots=sum(r["source"] == "s0" for r in got)).collect()
    assert sorted(r["index"] for r in mixed) == list(range(len(mixed)))


def vectors():
    x = np.random.default_rng(0).normal(size=(700, 8)).astype("f4")
    x[600:650] = x[7]  # equal rows
    return x


def check_neighbours(spark, x, k, **kw):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0]), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (None, x[0].tolist()), (3, x[3].tolist()), (20, x[20].tolist())]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = ann.neighbours(v, k, **kw).collect()
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    ask = range(0, len(x), 20)
    want = {(i, j) for i in ask for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}
    assert {r["vec_id"] for r in got} == set(ask) and len(got) == k * len(ask) == len({(r["vec_id"], r["rank"]) for r in got})
    assert all(abs(r["distance"] - math.sqrt(d[r["vec_id"], r["neighbour"]])) < 1e-2 for r in got)
    return len({(r["vec_id"], r["neighbour"]) for r in got} & want) / len(want)


@pytest.mark.parametrize("cell,chunk", [(10**6, 10**6), (200, 40)])
def test_neighbours(spark, cell, chunk, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    build = ann.build
    monkeypatch.setattr(ann, "build", lambda *a: build(*a, cell_rows=cell))
    x = vectors()
    assert check_neighbours(spark, x, 5, leaf=32) >= 0.9
    assert check_neighbours(spark, x, 60, leaf=32, visits=10**6) == 1  # all leaves: exact, with ties by id


def test_neighbours_of_few(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(20, [1.0, 2.0])], schema)).count() == 0
    got = ann.neighbours(spark.createDataFrame([(20, [1.0, 2.0]), (20, [5.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0, 2.5])], schema)).collect()
    assert [(r["vec_id"], r["rank"], r["neighbour"]) for r in sorted(got)] == [(20, 1, 1), (20, 2, 2)] and got[0]["distance"] == 0.5


def test_url_rules(spark, monkeypatch):
    r = random.Random(3)
    pages, labels = [], []
    for i in range(300):
        spam = r.random() < 0.3
        pages.append((i, f"https://{'spam' if spam else 'ok'}{r.randrange(3)}.example.org/{'x' if spam else 'y'}/{i}?a={i % 2}"))
        labels.append((i, int(not (spam and i % 2)), 0))
    pages += [(400, None), (401, ""), (None, pages[0][1])]
    p, lab = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    toks = {x["page_id"]: frozenset(x["t"]) for x in p.select("page_id", url_rules.tokens(p["url"]).alias("t")).collect() if x["page_id"] is not None}
    bad, seen = {i for i, q, _ in labels if q == 0}, {i: toks[i] for i in range(300)}
    # all combinations of tokens by brute force
    freq, hit = {}, {}
    for i, own in seen.items():
        for k in range(1, len(own) + 1):
            for c in itertools.combinations(sorted(own), k):
                freq[c] = freq.get(c, 0) + 1
                hit[c] = hit.get(c, 0) + (i in bad)
    odds = {c: hit[c] / n for c, n in freq.items() if hit[c] >= 4}
    holds = {c for c, v in odds.items() if v >= 0.5}
    found = {tuple(x["rule"]): (x["confidence"], x["support"]) for x in url_rules.mine(url_rules._labelled(p.select("page_id", url_rules.tokens(p["url"]).alias("tokens")), lab).distinct(), 4).collect()}
    assert found and all(found[c] == (pytest.approx(odds[c]), hit[c]) for c in found)
    closed = lambda c: frozenset.intersection(*(own for own in seen.values() if set(c) <= own))
    least = {c for c in holds if not any(odds[t] >= odds[c] for k in range(1, len(c)) for t in itertools.combinations(c, k))}
    alone = {t: frozenset(i for i in seen if t in seen[i]) for own in seen.values() for t in own}
    twins = {t: {u for u in alone if alone[u] == alone[t]} for t in alone}
    assert {tuple(sorted(set().union(*(twins[t] for t in c)))) for c in least} == set(found) and all(set(c) <= closed(c) for c in found)
    got = {x["page_id"]: x for x in url_rules.url_rules(p, lab, 4).collect()}
    for i, own in toks.items():
        fit = sorted((-v[0], -v[1], c) for c, v in found.items() if set(c) <= own)
        assert got[i]["blocked"] == bool(fit) and got[i]["n_rules"] == len(fit) and (not fit or (-got[i]["confidence"], -got[i]["support"], tuple(got[i]["rule"])) == fit[0])
    assert len(got) == len(toks) + 1 and not got[400]["blocked"] and not got[401]["blocked"]
    assert not url_rules.url_rules(p, lab.limit(0)).where("blocked").count() and url_rules.url_rules(p.limit(0), lab).count() == 0
    monkeypatch.setattr(url_rules, "SENT", 0)
    assert {x["page_id"]: x for x in url_rules.url_rules(p, lab, 4).collect()} == got


def test_licenses(spark, empty):
    mit = license_scan.TEMPLATES["MIT"]
    noise = "lorem ipsum dolor the of under and " * 200
    rows = [(1, noise + mit[0] + ". " + noise), (2, f"{mit[0]}. {mit[0]}. {mit[0]}."), (3, noise), (4, None), (5, ""), (6, mit[1].replace("publish,", "print,"))]
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r["first_word"] for r in sorted(found) if r["doc_id"] == 2] == [0, len(words(mit[0])), 2 * len(words(mit[0]))]
    got = {r["doc_id"]: r for r in found}
    assert set(got) == {1, 2, 6} and got[1]["coverage"] == 1.0 and got[1]["first_word"] == len(words(noise)) and 0.95 < got[6]["coverage"] < 1
    assert license_scan.license_scan(empty).count() == 0


def test_licenses_have_second_places():
    line = "This work is licensed under a Creative Commons Attribution {}4.0 International License"
    templates = {"BY": [line.format("")], "SA": [line.format("ShareAlike ")]}
    noise = " lorem ipsum dolor" * 20
    scanner = license_scan.Scanner(templates, 0.85, 0.6)
    got = scanner.scan(templates["SA"][0] + noise + " " + line.format("").replace("work", "material"))
    assert [r[0] for r in got] == ["BY", "SA"] and got[0][3] >= 74 and got[1][3] == 0


def test_windows_find_what_the_whole_text_has():
    """One varied notice among other words: as patience alignment of the whole text with the template finds it."""
    r = random.Random(7)
    for case in range(80):
        m = r.randrange(8, 120)
        template = [f"t{r.randrange(m)}" for _ in range(m)]
        own = [w for w in template if r.random() > 0.05]
        for _ in range(int(r.choice([0, 0.1, 0.3, 0.5]) * m)):
            own.insert(r.randrange(len(own) + 1), f"x{r.randrange(9)}")
        text = [f"n{r.randrange(50)}" for _ in range(r.randrange(0, 400))] + own + [f"n{r.randrange(50)}" for _ in range(r.randrange(0, 400))]
        need = math.ceil(0.85 * m - 1e-9)
        p = license_scan.densest(license_scan.patience(text, template), need)
        n = p[-1][0] - p[0][0] + 1 if p else 0
        want = len(p) >= need and len(p) >= 0.6 * n
        got = license_scan.Scanner({"L": [" ".join(template)]}, 0.85, 0.6).scan(" ".join(text))
        assert len(got) >= want and len(got) <= 1
        if want:
            assert got[0][1] * got[0][2] >= len(p) / m * len(p) / n - 1e-9 and got[0][3] < p[-1][0] and got[0][3] + got[0][4] > p[0][0]


def test_patience_is_increasing_and_equal():
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.randrange(12) for _ in range(r.randrange(0, 30))] for _ in range(2))
        p = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    a = list(range(20))
    assert len(license_scan.patience(a, a[:5] + [99] + a[5:])) == 20


@pytest.mark.parametrize("small", [1, 256])
@pytest.mark.parametrize("a,c", [(1e-6, 40), (0.3, 3), (0.02, 200), (5.0, 60), (100.0, 120)])
def test_tables_have_their_odds(a, c, small, monkeypatch):
    d, many, r = 0.7, 3000, np.random.default_rng(6)
    log = lm_score.stirling(d)[c] + np.arange(1, c + 1) * np.log(a)
    want = np.exp(log - np.logaddexp.reduce(log))
    mean = (want * np.arange(1, c + 1)).sum()
    std = np.sqrt(max(0, (want * np.arange(1, c + 1) ** 2).sum() - mean**2))
    monkeypatch.setattr(lm_score, "SMALL", small)
    t, path = lm_score.first_seats(np.full(many, c))
    for _ in range(1 if small > 1 else 25):
        t, path = lm_score.reseat(np.full(many, c), t, path, np.full(many, a), d, r)
    assert abs(t.mean() - mean) <= 5 * std / np.sqrt(many) + 0.01 and abs(t.std() - std) <= 0.1 * std + 0.02


def test_stirling_numbers():
    d, n = 0.4, 6
    s = {(1, 1): 1.0}
    for c in range(1, n):
        for k in range(1, c + 2):
            s[c + 1, k] = (c - d * k) * s.get((c, k), 0) + s.get((c, k - 1), 0)
    assert np.exp(lm_score.stirling(d)[n]) == pytest.approx([s[n, k] for k in range(1, n + 1)])


def test_log_gamma():
    x = np.array([1e-6, 0.1, 0.5, 1, 2, 3.7, 9.99, 10, 123.4, 1e6])
    assert lm_score.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_restaurant_is_that_of_one_by_one():
    """Sweeps by dish against a sampler that moves a customer at a time between tables."""
    c, g, d, strength, r = [30, 1, 7, 2, 12], np.array([0.3, 0.1, 0.2, 0.05, 0.35]), 0.6, 1.5, random.Random(3)
    tables = [[1] * n for n in c]
    got, n = np.zeros(5), 0
    for sweep in range(3000):
        for w in range(5):
            for _ in range(c[w]):
                x = r.randrange(sum(tables[w]))
                k = next(i for i, e in enumerate(np.cumsum(tables[w])) if x < e)
                tables[w][k] -= 1
                tables[w] = [e for e in tables[w] if e]
                odds = [e - d for e in tables[w]] + [(strength + d * sum(map(len, tables))) * g[w]]
                k = r.choices(range(len(odds)), odds)[0]
                tables[w] = tables[w] + [1] if k == len(tables[w]) else [e + (i == k) for i, e in enumerate(tables[w])]
        if sweep >= 200:
            got, n = got + [len(x) for x in tables], n + 1
    rng, t, mean = np.random.default_rng(1), np.ones(5, np.int64), np.zeros(5)
    for sweep in range(6200):
        t, _ = lm_score.reseat(np.array(c), t, np.zeros(5), d * rng.gamma(strength / d + t.sum()) * g, d, rng)
        if sweep >= 200:
            mean += t / 6000
    assert mean == pytest.approx(got / n, rel=0.06)


def test_lm(spark, docs, empty):
    got = lm_score.lm_score(docs).collect()
    other = {(r["doc_id"], round(r["log_prob"], 6)) for r in lm_score.lm_score(docs, limit=0).collect()}
    assert {(r["doc_id"], round(r["log_prob"], 6)) for r in got} == other and len(got) == len(corpus())
    assert all((r["perplexity"] is None) == (r["n_tokens"] == 0) for r in got)
    m, seats = lm_score.fit(lm_score.pairs(docs), tokens.encoder().size + 1)
    p = {}
    for r in lm_score.predictions(m, seats).collect():
        p |= dict(zip(np.frombuffer(r["code"], "<u4").tolist(), np.frombuffer(r["logp"], "<f8").tolist()))
    u = next(iter(p)) >> 16
    every = np.array([u << 16 | w for w in range(tokens.encoder().size + 1)], np.uint32)
    prob = m.unseen(every)
    for c, lp in p.items():
        if c >> 16 == u:
            prob[c & 0xFFFF] = np.exp(lp)
    assert prob.sum() == pytest.approx(1, abs=1e-6)
    assert lm_score.lm_score(empty).count() == 0
    want = {}
    for r in corpus():
        ids = [tokens.encoder().end, *tokens.encoder().plain.encode_ordinary(r[1] or ""), tokens.encoder().end]
        want.setdefault(r[0], []).append(round(sum(p[x << 16 | y] for x, y in zip(ids, ids[1:])), 6) if r[1] else 0.0)
    assert {(k, v) for k, vs in want.items() for v in vs} == {(r["doc_id"], round(r["log_prob"], 6)) for r in got}


def test_edits(spark, empty):
    enc = tokens.encoder()
    r, counts = random.Random(4), edit_counts.PieceCounts(tokens.encoder())
    for _ in range(40):
        text = "".join(r.choice(["ab", " ", "  ", "'", "ll", "1", "\n", "é", "!?"]) for _ in range(r.randrange(0, 600)))
        tree = edit_counts.Tree(text, counts)
        for _ in range(6):
            a = r.randrange(0, len(text) + 3)
            z, new = a + r.randrange(0, 20), "".join(r.choice([" ", "x", "'ll", "2", "\n"]) for _ in range(r.randrange(0, 8)))
            tree.edit(a, z, new)
            a, z = min(a, len(text)), min(z, len(text))
            text = text[:a] + new + text[z:]
            assert tree.text == text and tree.n_tokens == len(enc.plain.encode_ordinary(text))
    assert [x[2] for x in edit_counts.scrubs("x" * 200 + "@example.com and a.b@c.de")] == ["<email>"] * 2
    d = spark.createDataFrame([(1, "mail me@example.com now"), (2, None)], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in edit_counts.edited_counts(d).collect()}
    assert got[1]["tokens_after"] == len(enc.plain.encode_ordinary("mail <email> now")) and got[2]["tokens_after"] == 0
    assert edit_counts.edited_counts(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "control", "data", "n_vocab", "ranking"]
