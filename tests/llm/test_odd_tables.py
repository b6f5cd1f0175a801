"""Every corpus operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import linked, prose, runs

from callscope.llm import ann, decontaminate, edit_counts, jaccard_join, language_id, license_scan, lm_score, mixing, token_output, tokens, url_rules
from callscope.llm.common import words

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977} of{i % 13}" for i in range(12_000))
ROWS = [(i, prose("en" if i % 2 else "de", 20 + i), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(16)]
ROWS += [(20, LONG, "en", "s0", 1), (21, "word " * 9000, "en", "s1", 1), (22, "é" * 5000, "de", "s1", 1)]
ROWS += [(30, None, None, None, None), (31, "", "en", None, 0), (32, " \n ", None, "s0", 2), (None, "thing that", "en", "s0", 1), (33, "a", "en", "s1", 1), (33, "a", "en", "s1", 1), (34, "tie tie", "en", "s1", 1), (35, "tie tie", "en", "s1", 1)]
BENCH = [(1, ROWS[3][1]), (1, ROWS[3][1]), (2, None), (3, ""), (None, ROWS[5][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KINDS).repartition(2)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


@pytest.fixture(scope="module")
def model(docs):
    return language_id.train(docs)


def odd(df):
    """With columns whose names clash with the operators' and with each other, in front and behind."""
    more = [(n, F.lit(7)) for n in ("TEXT", "Doc_Id", "a.b", "c0", "_hash", "_d", "row", "b", "PAGE_ID", "URL", "Vec_ID", "EMBEDDING")]
    return df.select(*[v.alias(n) for n, v in more[:3]], *df.columns, *[v.alias(n) for n, v in more[3:]])


def shown(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.drop("ranking").collect())


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://x.org/"), F.substring("text", 1, 30)).alias("url"))


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))


def vectors(docs):
    return docs.select(F.col("doc_id").alias("vec_id"), F.when(F.col("text").isNotNull(), F.array(*[F.length("text").cast("float") * k for k in (1.0, 0.5)])).alias("embedding"))


OPERATORS = {
    "op1": lambda d, b, m: token_output.token_output(d),
    "op2": lambda d, b, m: language_id.identify(d, m),
    "op3": lambda d, b, m: decontaminate.decontaminate(d, b),
    "op3 joined": lambda d, b, m: decontaminate.decontaminate(d, b, shared_limit=0),
    "op6": lambda d, b, m: mixing.mix(d.coalesce(1), block=32, shard=4),
    "op7": lambda d, b, m: license_scan.license_scan(d),
    "op8": lambda d, b, m: jaccard_join.jaccard_join(d),
    "op9": lambda d, b, m: lm_score.lm_score(d, burn_in=1, samples=1),
    "op10": lambda d, b, m: edit_counts.edited_counts(d),
}
STAGES = {
    "2": lambda d, b, m: language_id.accepted(d, model=m),
    "8": lambda d, b, m: jaccard_join.deduplicate(d),
    "3": lambda d, b, m: decontaminate.clean(d, b),
    "3 joined": lambda d, b, m: decontaminate.clean(d, b, shared_limit=0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, docs, bench, model):
    run = OPERATORS[name]
    got = shown(run(docs, bench, model))
    assert shown(run(odd(docs), odd(bench), model)) == got
    assert run(odd(docs.limit(0)), bench, model).count() == 0
    if name in ("op1", "op2", "op9", "op10"):
        assert len(got) == len(ROWS)
    if name.startswith("op3"):
        assert run(docs, bench.limit(0), model).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage(name, docs, bench, model):
    run = STAGES[name]
    out, plain = run(odd(docs), odd(bench), model), run(docs, bench, model)
    assert out.columns == odd(docs).columns and out.dtypes == odd(docs).dtypes and plain.columns == docs.columns
    at = [odd(docs).columns.index(c) for c in docs.columns]
    assert sorted(str([r[i] for i in at]) for r in out.collect()) == sorted(str(list(r)) for r in plain.collect())
    left = [tuple(r) for r in plain.collect()]
    none = run(odd(docs.limit(0)), bench, model)
    assert none.count() == 0 and none.columns == odd(docs).columns
    if name == "8":
        ids = [r[0] for r in left if r[0] is not None]
        assert sorted(ids) == linked([r[:2] for r in ROWS])[1]
    if name[0] == "3":
        hit = {r for r in ROWS if any(t and runs(words(r[1]), words(t), 8) for i, t in BENCH if i is not None)}
        assert sorted(map(str, left)) == sorted(str(r) for r in ROWS if r not in hit) and hit


def test_mixing_as_documents(docs):
    got = mixing.mixed_documents(odd(docs), block=32, shard=4)
    assert got.columns == docs.columns and got.count() > 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_pages_and_vectors(docs):
    want = shown(url_rules.url_rules(pages(docs), labels(docs), 2))
    assert shown(url_rules.url_rules(odd(pages(docs)), odd(labels(docs)), 2)) == want and len(want) == len(ROWS)
    assert url_rules.url_rules(odd(pages(docs.limit(0))), labels(docs)).count() == 0
    near = shown(ann.neighbours(vectors(docs), 3, every=2))
    assert near and shown(ann.neighbours(odd(vectors(docs)), 3, every=2)) == near
    assert ann.neighbours(odd(vectors(docs.limit(0)))).count() == 0


def naive_blocks(rows, block):
    """Blocks of each source by its definition: all tokens in order, cut a few early where a character would be torn."""
    enc, out, runs_of = tokens.encoder(), {}, {}
    for _, t, _, s, _ in rows:
        if t:
            runs_of.setdefault(s or "", []).extend([*enc.plain.encode_ordinary(t), enc.end])
    for s, ids in runs_of.items():
        at, out[s] = 0, []
        while at < len(ids):
            end = at + block
            for back in range(4) if end < len(ids) else ():
                x = ids[end - back]
                if x == enc.end or (enc.bytes_of[x][0] & 0xC0) != 0x80:
                    end -= back
                    break
            out[s].append(ids[at:end])
            at = end
    return out


def test_slots_hold_the_blocks_of_their_index(spark):
    rows = [r for r in ROWS if r[0] not in (20, 21)]
    got = mixing.mix(spark.createDataFrame(rows, KINDS).coalesce(1), block=32, shard=4, weights={"s0": 2, "s1": 1, "": 0}, slots=60).collect()
    want = naive_blocks(rows, 32)
    import numpy as np

    for r in got:
        assert np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]].tolist() == want[r["source"]][r["index"]]
    for k, s in enumerate(("s0", "s1")):
        n, size = sum(mixing.draw(j, 4, np.array([2 / 3, 1 / 3]), mixing.SEED)[k] for j in range(15)), len(want[s])
        own = [r["index"] for r in got if r["source"] == s]
        assert len(own) == n and all(own.count(i) in (n // size, n // size + 1) for i in range(size))


def test_pipeline_is_its_stages(spark, tmp_path):
    """Each stage's rows by brute force from the rows of the stage before."""
    import corpus_pipeline
    import numpy as np

    rows = [r for r in ROWS if r[0] not in (20, 21)] + [(40, ROWS[4][1] + " more", "de", "s0", 1), (41, ROWS[6][1], "de", "s0", 1)]
    d, b = str(tmp_path), [(1, ROWS[9][1])]
    spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(b, "item_id bigint, text string").coalesce(1).write.parquet(d + "/benchmark.parquet")
    docs, kept = spark.read.parquet(d + "/documents.parquet"), rows
    model = language_id.train(docs)
    for (name, stage), n in zip(corpus_pipeline.STAGES, (2, 8, 3, 6, 1)):
        out = corpus_pipeline.written(stage(spark, docs, d), "test-stage")
        got = [tuple(r) for r in out.collect()]
        if n == 2:
            p = [0 if not r[1] else max(sum(sum(part[k]) for _, part in model.probs([r[1].encode()])) for k in range(len(model.labels))) / len(r[1].encode()) for r in kept]
            want = [r for r, v in zip(kept, p) if v >= language_id.MIN_PROB]
        elif n == 8:
            first = linked([r[:2] for r in kept])[1]
            assert sorted(r[0] for r in got if r[0] is not None) == first
            want = got
        elif n == 3:
            want = [r for r in kept if not any(runs(words(r[1]), words(t), 8) for _, t in b)]
            assert len(want) < len(kept)
        if n in (2, 3):
            assert sorted(map(str, got)) == sorted(map(str, want))
        if n == 6:
            blocks = {s: [] for s in {r[3] or "" for r in kept}}
            enc = tokens.encoder()
            for s in blocks:  # at this size a source is one block, padded
                text = [r[1] for r in kept if (r[3] or "") == s and r[1]]
                if sum(len(enc.plain.encode_ordinary(t)) + 1 for t in text) <= mixing.BLOCK:
                    assert all(sorted(r[1].split("\n")) == sorted("\n".join(text).split("\n")) for r in got if r[3] == s)
            assert {r[3] for r in got} <= set(blocks) and len({r[0] for r in got}) == len(got)
        if n == 1:
            back = {r["doc_id"]: r["text"] for r in token_output.decoded(out).collect()}
            assert back == {r[0]: r[1] for r in kept}
            counts = np.zeros(tokens.encoder().size + 1, int)
            for r in kept:
                np.add.at(counts, tokens.encoder().plain.encode_ordinary(r[1]), 1)
            rank = spark.read.parquet(out.first()["ranking"]).orderBy("rank").toPandas()
            assert rank["n"].tolist() == sorted(counts.tolist(), reverse=True)
        docs, kept = out, got
    assert corpus_pipeline.run(spark, d).count() == len(kept)
