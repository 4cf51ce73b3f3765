"""A small corpus with the hard cases, written as tables like the driver's."""

from __future__ import annotations

import random


CLASHING = ("score", "class", "row", "words", "hash", "component_id", "block", "size", "count", "n_words", "_text", "value", "kept", "target")


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("the an or in ti on re er at en".split()) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    base = prose(120).split(" ")
    near = base.copy()
    near[60] = "changed"
    far = base.copy()
    far[::9] = ["other"] * len(far[::9])
    junk = " ".join(word().upper() + "!!" for _ in range(60))
    marks = " ".join(word() + rng.choice(("***", "$$$", "###")) for _ in range(60))
    out: list[str | None] = [None, "", " ", "\n\n\n", "\t \x0b", "a", "a b", "a b c", "A B C", "!!! ???", "12 34"]
    out += [" ".join(base), " ".join(near), " ".join(far), " ".join(base), " ".join(base).upper()]
    out += [junk, marks, junk + "\n" + prose(40), "of " * 50, "same line here\n" * 12]
    out += ["Released under the MIT License.", "GNU General Public License\nsee the Apache License and the mit-license", "mit\nlicense mit license", "lİcense mit lİcense Kmit license"]
    out += ["x<|endoftext|>y <|endoftext|> z", "  two  spaces\n \n mixed   space ", "日本語 のテキスト です", "Σίσυφος ΣΑΣ é́ İ ﬁ", "😀 😀😀", "it's we'll I'M 123 4５6 a_b", "tail\n", "\x1c \x1ca"]
    out += [prose(rng.randint(20, 90)) + "\n" + prose(rng.randint(10, 60)) for _ in range(24)]
    out += [prose(9000), "q" * 30_000]
    return out


def write(spark, folder: str, rows: list[tuple], name: str = "documents", columns: str = "doc_id long, text string, lang string, source string, n_chars long") -> None:
    df = spark.createDataFrame(rows, columns)
    for c in CLASHING:
        if c not in df.columns:
            df = df.selectExpr("*", f"'clash' AS `{c}`")
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def documents() -> list[tuple]:
    made = texts()
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s2", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(made)]
    rows += [rows[11], rows[11], (11, "another text under the same id", "en", "s1", 5), (None, "no id at all here", None, None, 3)]
    return rows


def labels() -> list[tuple]:
    bad = {16, 17, 18, 19, 20}
    return [(i, 0 if i in bad else 1, 0) for i in range(11, 60)] + [(16, 0, 0), (None, 1, 0), (5, None, 0), (10**9, 1, 1)]


def build(spark, folder: str, empty: bool = False) -> str:
    write(spark, folder, [] if empty else documents())
    write(spark, folder, [] if empty else labels(), "labels", "doc_id long, quality int, toxic int")
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)] + [(i, [0.5] * 8) for i in range(150, 260)]
    vectors += [(100, [0.25] * 8), (300, None), (350, [float("nan")] * 8), (400, [None] * 8), (450, [1.0, 2.0]), (500, [1e6] * 8), (None, [0.1] * 8), (550, [])]
    write(spark, folder, [] if empty else vectors, "embeddings", "vec_id long, embedding array<float>")
    return folder
