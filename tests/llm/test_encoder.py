"""Chunks that the texts of a batch share go to the tokenizer once, in one call; ids stay those of the plain tokenizer."""

import numpy as np
import pyarrow as pa
import pytest

from callscope.llm import mixing, token_output, tokens

ROWS = [(i, " ".join(f"w{(i * 7 + j) % 300}x" for j in range(200)), "en", "s0", 1) for i in range(6)]
ODD = ["", " ", " a", "a ", "a  b", "a\n b", "a b\n", "x 'll y", "é  1  2", "\x1c a", "a \x1cb c", "\n", "a.\nb c", None, "a b a b", "中 文 a"]


def counting(path):
    """The tokenizer's encoder; each call of the tokenizer adds a byte to the file beside."""

    def make(name=tokens.TOKENIZER):
        enc = tokens.Encoder(name)

        class Plain:
            def __getattr__(self, what, plain=enc.plain):
                with open(path, "ab") as f:
                    f.write(b".")
                return getattr(plain, what)

        enc.plain = Plain()
        return enc

    return make


@pytest.mark.parametrize("step", [1, 3, tokens.__dict__.get("STEP", 1)])
def test_batches_are_the_tokenizers(step, monkeypatch):
    monkeypatch.setattr(tokens, "STEP", step, raising=False)
    enc = tokens.encoder()
    texts = ODD + [r[1] for r in ROWS]
    for own in (texts, texts[::-1], texts[:1], [], [None], pa.array(["cut", *texts], pa.string()).slice(1)):
        ids, off = enc.flat(own)
        plain = [enc.plain.encode_ordinary(t or "") for t in (own.to_pylist() if isinstance(own, pa.Array) else own)]
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == plain and len(ids) == off[-1]


def test_mixing_encodes_a_batch_at_once(spark, tmp_path, monkeypatch):
    """op6_mix_sources: a call a text and one a batch, none a distinct chunk."""
    monkeypatch.setattr(mixing, "encoder", counting(str(tmp_path / "calls")))
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    got = mixing.blocks(docs, 64).orderBy("part", "seq").collect()
    assert (tmp_path / "calls").stat().st_size <= len(ROWS) + 1
    enc = tokens.encoder()
    assert np.concatenate([np.frombuffer(r["ids"], "<u2")[: r["n"]] for r in got]).tolist() == [x for r in ROWS for x in [*enc.plain.encode_ordinary(r[1]), enc.end]]


def test_token_output_encodes_a_batch_at_once(spark, tmp_path, monkeypatch):
    """op1_token_output: the same."""
    monkeypatch.setattr(token_output, "encoder", counting(str(tmp_path / "calls")))
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id bigint, text string").coalesce(1)
    out = token_output.token_output(docs)
    n = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert (tmp_path / "calls").stat().st_size <= len(ROWS) + 1
    monkeypatch.undo()
    assert n == {r[0]: len(tokens.encoder().plain.encode_ordinary(r[1])) for r in ROWS}
    assert {tuple(r) for r in token_output.decoded(out).collect()} == {r[:2] for r in ROWS}
