"""Line dedup, phrase collocations and tokenizer alignment over the hard cases, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
SPACE = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return corpus.build(spark, f"file://{tmp_path_factory.mktemp('sf')}")


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return corpus.build(spark, f"file://{tmp_path_factory.mktemp('empty')}", empty=True)


def run(spark, name, folder):
    from loomgraph.llm.queries import QUERIES

    return QUERIES[name](spark, folder)


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ("op11_line_dedup", "op12_token_alignment", "op13_collocations"))
def test_empty_tables(spark, nothing, name):
    assert run(spark, name, nothing).count() == 0


# Lines


def without_shared_lines(rows, least, length=1):
    key = lambda line: lower(line.strip(SPACE))
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, found in lines for k in {key(x) for x in found} if len(k) >= length)
    out = []
    for i, found in lines:
        kept = [x for x in found if len(key(x)) < length or seen[key(x)] < least]
        out.append((i, "\n".join(kept), len(found), len(found) - len(kept)))
    return sorted(out, key=repr)


def shared_lines():
    rng = random.Random(5)
    common = [f"  Common LINE {i} " for i in range(6)] + ["ÄÖÜ line", "\tx\x0b"]
    rows = [(i, "\n".join(rng.choice([*common, "", "   ", f"own {rng.random()}"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    copies = [(100 + i, "a copy\nof one text\n\na copy") for i in range(12)]
    return [*rows, *copies, *rows[:3], (None, "common line 0"), (None, None), (7, ""), (8, "\n\n"), (9, "common line 1"), (10, "common line 1\n")]


@pytest.mark.parametrize(("least", "fanout", "batches", "broadcast_rows"), [(10, 2, 8, 1 << 20), (10, 4, 3, 0), (1, 2, 4, 0), (50, 3, 1, 10)])
def test_shared_lines_go(spark, least, fanout, batches, broadcast_rows):
    from loomgraph.llm.line_runs import dedup_lines

    rows = shared_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    found = dedup_lines(docs, least, fanout=fanout, batches=batches, broadcast_rows=broadcast_rows)
    assert table(found) == without_shared_lines(rows, least)


def test_lines_of_the_corpus(spark, sf):
    rows = [(r[0], r[1]) for r in corpus.documents()]
    expected = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in without_shared_lines(rows, 10)]
    assert table(run(spark, "op11_line_dedup", sf)) == sorted(expected, key=repr)


def test_runs_are_compacted_and_joined_without_an_exchange(spark):
    from loomgraph.llm.line_runs import LineRuns, hashed_lines

    runs = LineRuns(spark, least=4, fanout=2)
    for i in range(5):
        runs.add(hashed_lines(spark.createDataFrame([(j, f"every\nbatch {i}\ntwice {i // 2}") for j in range(2)], "doc_id long, text string")))
        if i == 3:
            assert runs.runs[:2] == [0, 0] and runs.runs[2] == 1  # two runs of two, merged again
            assert runs._read("common").count() == 3
    plan = runs._read("level0").join(runs._read("common").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert runs.common().count() == 3  # "every" and two of "twice"; the fifth batch's lines are too few
    runs.drop()


def test_long_texts_lose_lines(spark):
    from loomgraph.llm.line_runs import dedup_lines

    long = "\n".join("shared" if i % 3 == 0 else f"own {i}" for i in range(200_000))
    rows = [(0, long), (1, "\n" * 500_000), *((i, "shared") for i in range(2, 11))]
    found = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[0].n_lines, found[0].n_dropped) == (200_000, 66_667)
    assert found[0].text == "\n".join(f"own {i}" for i in range(200_000) if i % 3)
    assert (found[1].n_lines, found[1].n_dropped) == (500_001, 0) and found[2].text == ""


# Phrases


def best_phrases(rows, least, longest, top=2000, cover=80):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            covered = any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in counts.items() if b >= least)
            if not covered:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(2)
    words = ["a", "b", "c", "Dé", "日本", "X-1", "e" * 3000]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(n))
    rows = [(prose(80), ("en", "de", None, "und")[i % 4]) for i in range(40)]
    return [*rows, *rows[:5], (None, "en"), ("", None), ("hot pair " * 3000 + "z.", "en"), ("hot pair z y x w v u " * 40, "en")]


@pytest.mark.parametrize(("least", "longest", "top"), [(30, 4, 2000), (3, 6, 2000), (30, 4, 7), (5, 2, 50), (10**9, 4, 5)])
def test_phrases(spark, monkeypatch, least, longest, top):
    from loomgraph.llm import phrases

    monkeypatch.setattr(phrases, "FEW", 20)
    monkeypatch.setattr(phrases, "SHARES", 50)  # frequent prefixes are dealt over several tasks
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(3)
    assert table(phrases.collocations(docs, least, longest, top)) == best_phrases(rows, least, longest, top)


def test_phrases_of_the_corpus(spark, sf):
    rows = [(r[1], r[2]) for r in corpus.documents()]
    assert table(run(spark, "op13_collocations", sf)) == best_phrases(rows, 30, 4)


def test_extension_is_depth_first_and_prunes():
    from loomgraph.llm.phrases import extend

    projected = [(["x", "y"], 3), (["x", "z"], 1), (["y"], 2), (["x"], 1)]
    assert list(extend("p q", projected, 2)) == [("p q x", 5), ("p q x y", 3), ("p q y", 2)]


def test_products_beyond_64_bits(spark, monkeypatch):
    from loomgraph.llm import phrases

    big = 9 * 10**18
    made = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    parts = made([("en", "a", big), ("en", "b", 10**18)]), made([("en", "a b", 10**18)]), spark.createDataFrame([("en", 5)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: parts)
    assert table(phrases.collocations(None)) == [("en", 1, "a b", 10**18, big, 10**18, 5, 200_000)]


# Alignment


def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    from loomgraph.llm.alignment import _byte_letters

    a, b = paths()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(_byte_letters())}
    raw = {i: bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w, i in t.get_vocab().items()}
    s = sentencepiece.SentencePieceProcessor(model_file=b)
    piece = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    return (lambda x: t.encode(" " + x, add_special_tokens=False).ids), raw.__getitem__, s.encode, piece


def tokens_of(libraries, text):
    encode_a, bytes_a, encode_b, bytes_b = libraries
    if not text:
        return [], []
    a, b = encode_a(text), encode_b(text)
    raw = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
        return [], []
    ends = lambda ids, of: list(zip(ids, np.cumsum([len(of(i)) for i in ids]).tolist(), strict=True))
    return ends(a, bytes_a), ends(b, bytes_b)


def aligned(libraries, rows):
    per, seen = [], Counter()
    for i, text in rows:
        a, b = tokens_of(libraries, text)
        common = {e for _, e in a} & {e for _, e in b}
        groups, x, y = [], [], []
        walk = sorted([(e, 0, t) for t, e in a] + [(e, 1, t) for t, e in b])
        for e, side, t in walk:
            (y if side else x).append(str(t))
            if side and e in common:
                groups.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        starts = lambda of: [0, *(e for _, e in of)]
        links, j = Counter(), 0
        for (t, e), s in zip(a, starts(a), strict=False):
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and (b[k - 1][1] if k else 0) < e:
                links[t, b[k][0]] += 1
                k += 1
        seen.update(links.keys())
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (t, _), n in seen.items():
        best[t] = max(best[t], n)
    return sorted(((i, a, b, g, sum(k.values()), sum(n for p, n in k.items() if seen[p] == best[p[0]]), sum(n * seen[p] for p, n in k.items()), d) for i, a, b, g, k, d in per), key=repr)


def odd_texts():
    marks = "<|endoftext|> <s> </s> <unk> it's café  naïve — “q” 日本語 텍스트 🎉 ok\r\n\tz"
    texts = [None, "", " ", "  ", "\n", "a \n b\n\nc  \n ", "x▁y", marks, "word " * 50 + " end  ", "ab\x00cd \x1c e\x85 f  g", "é ü\n ñ\n\n", "a" * 70_000 + " b", "<0x41> <0x0A>", "  x 　 y"]
    return [*enumerate(texts), (None, "word word"), (8, texts[8])]


@pytest.mark.parametrize("head", (0, 3, 1 << 20))
def test_alignment_of_odd_texts(spark, libraries, head):
    from loomgraph.llm.alignment import align

    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("pair", F.lit(1))
    assert table(align(docs, *paths(), head=head)) == aligned(libraries, rows)


def test_alignment_of_the_corpus(spark, sf, libraries):
    rows = [(r[0], r[1]) for r in corpus.documents()]
    assert table(run(spark, "op12_token_alignment", sf)) == aligned(libraries, rows)


@pytest.fixture(scope="module")
def tools():
    from loomgraph.llm.alignment import Tokenizers

    return Tokenizers(*paths())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85  'sté́ßÿĀ<|>.,1"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_stretches_are_encoded_as_whole_texts_are(tools, libraries, text):
    import pyarrow as pa

    from loomgraph.llm.alignment import cuts
    from loomgraph.llm.bytetext import text_buffer

    encode_a, _, encode_b, _ = libraries
    if not text:
        return
    raw = (" " + text).encode()
    at = [*cuts(*text_buffer(pa.array([" " + text]))).tolist(), len(raw)]
    parts = pa.array([raw[i:j].decode() for i, j in zip(at, at[1:], strict=False)], pa.large_string())
    assert tools.ids_a(parts)[0].tolist() == encode_a(text)
    if "▁" not in text:
        assert tools.ids_b(parts)[0].tolist() == encode_b(text)
