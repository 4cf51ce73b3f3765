"""Batches cut into pre-tokens and encoded, against the libraries; very long texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

ALPHABET = ["a", "b", "s", "t", "re", "'", "'s", "'t", "'ll", " ", "  ", "\n", " \n", "\n\n", "\t", "1", "23", ".", ",", "é", "É", "ß", "\xa0", "\x85", "²", "¼", "ª"]
ALPHABET += ["<|endoftext|>", "<|startoftext|>", "日", "本", "İ", "ŉ", "́", "Ω", "\x1c", "\x0b", "_", "-", "😀"]


def texts(n: int) -> list[str | None]:
    rng = random.Random(n)
    made: list[str | None] = [None, "", "", " ", "  ", "\n"]
    return made + ["".join(rng.choice(ALPHABET[: rng.choice((10, 18, 26, len(ALPHABET)))]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("window", (37, 1 << 20))
def test_ids_of_random_texts(monkeypatch, window):
    from loomgraph.llm import pretokens
    from loomgraph.llm.token_files import Encoder
    from loomgraph.llm.word_codec import WordCodec

    monkeypatch.setattr(pretokens, "WINDOW", window)
    monkeypatch.setattr(pretokens, "PART", 5)
    some = texts(1500)
    column = pa.array(some, pa.string()).slice(2)
    some = some[2:]
    t = library("byte_bpe_50k.json")
    wanted = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    ids, bounds = Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(column, None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == wanted
    ids, bounds = Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(column, 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*x, 2] for x in wanted]
    t, codec = library("word_bpe_49k.json"), WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    made = codec.encode(column)
    assert made.to_pylist() == wanted
    numbers, tokens = codec.written(made)
    assert [bytes(x).decode() for x in numbers] == [" ".join(map(str, x)) for x in wanted]
    assert [bytes(x).decode() for x in tokens] == [t.decode(x, skip_special_tokens=False) for x in wanted] == [codec.decode(x) for x in wanted]


def test_recent_words_are_kept_and_others_forgotten():
    from loomgraph.llm.batches import Recent

    asked = []

    def make(keys):
        asked.extend(keys)
        return {k: k.upper() for k in keys}

    known = Recent(2)
    for keys in (["a", "b"], ["a", "c"], ["d", "e"], ["a", "x" * 100], ["x" * 100]):
        assert known.all_of(keys, make) == [k.upper() for k in keys]
        assert len(known.now) <= 2 and len(known.before) <= 2
    assert asked == ["a", "b", "c", "d", "e", "a", "x" * 100, "x" * 100]


def peak_mb(work) -> float:
    """Megabytes that ``work`` adds to a new process at its highest."""
    import multiprocessing

    def run(pipe):
        import resource
        import sys

        unit = 1 if sys.platform == "darwin" else 1024
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * unit
        work()
        pipe.send((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * unit - before) / 1e6)

    here, there = multiprocessing.get_context("fork").Pipe()
    child = multiprocessing.get_context("fork").Process(target=run, args=(there,))
    child.start()
    there.close()
    made = here.recv()
    child.join()
    return made


LONG = {"line breaks": "\n" * (20 << 20), "no space": "abcdefghij" * (2 << 20), "words": "some words of a text " * (1 << 20)}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_in_bounded_memory(kind):
    """Twenty times a text's bytes at most, beside the tables; pre-tokens beyond the library's reach included."""
    from loomgraph.llm.pretokens import Ids, PreTokens
    from loomgraph.llm.token_files import Encoder

    text = LONG[kind]
    pre = PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    assert peak_mb(lambda: pre.cut(pa.array([text]))) < 20 * len(text) / 1e6
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode(pa.array(["x" * (Ids.LONG + 1)]), None)  # loads the tables
    some = text if kind == "words" else text[: 4 << 20]
    assert peak_mb(lambda: encoder.encode(pa.array([some]), None)) < 20 * len(some) / 1e6 + 20


def test_long_pretokens_are_encoded_as_by_the_library():
    from loomgraph.llm.pretokens import Ids, PreTokens

    ids = Ids(PreTokens(public_tokenizers.path("byte_bpe_50k.json")))
    rng, t = random.Random(2), library("byte_bpe_50k.json")
    for word in (" " + "".join(rng.choice("abcdéß") for _ in range(3000)), "\n" * 3000, "é" * 1001, " " * 2000, "#" * 999):
        assert ids._long(word) == np.array(t.encode(word).ids, "<i4").tobytes()
    assert zlib.crc32(ids.of(["a"])["a"]) == zlib.crc32(ids._long("a"))


def test_long_pretokens_stay_out_of_the_head(tmp_path):
    """Incompressible unbroken texts, in a session whose driver takes less than they hold."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, sys
from pyspark.sql import SparkSession
from tokenizers import Tokenizer
import public_tokenizers
from loomgraph.llm.token_counts import count_tokens
spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "1m").config("spark.sql.autoBroadcastJoinThreshold", "256k").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rng = random.Random(1)
letters = "".join(chr(c) for c in [*range(97, 123), *range(0x100, 0x17F)])
texts = ["".join(rng.choices(letters, k=n)) for n in [100_000] * 12 + [64, 65, 66]] + ["a few short words"]
path = public_tokenizers.path("byte_bpe_50k.json")
spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(sys.argv[1])
found = {r.doc_id: r.n_tokens for r in count_tokens(spark.read.parquet(sys.argv[1]), path).collect()}
library = Tokenizer.from_file(path)
assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
"""
    root = Path(__file__).resolve().parent.parent.parent
    subprocess.run([sys.executable, "-c", code, f"file://{tmp_path / 'long'}"], env=os.environ | {"PYTHONPATH": str(root)}, check=True, timeout=600, cwd=tmp_path)
