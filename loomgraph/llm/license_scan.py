"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text is hashed and joined to the positions of
the same k-gram in a library of templates. Each match votes for the diagonal
``position in the text - position in the template``. The diagonals from one on
to ``DIAGONAL_GAP`` further are merged to a span (inserted or missing words
shift them). A span stands if its matches are at enough distinct places of the
template, and if enough of the template's words stand in the text on one of the
span's diagonals each. Short phrases must match in full on one diagonal.

``score`` is the best share of a template's k-grams in a standing span. Grams that
no template has are left out before the join, by the set of the library's hashes;
a library of more than ``MOST_GRAMS`` grams is refused.

Defined results: a null or empty text has no words, no labels and score 0; rows
are scanned one by one, so null or repeated doc_ids keep a row each; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
SEPARATORS = "[\\x00-/:-@\\[-`{-\\x7F]+"
K_PASSAGE = 4
K_PHRASE = 2
#: The diagonals of one span are at most this far apart.
DIAGONAL_GAP = 3
#: Share of a passage's k-grams, and of its words, that a span must cover.
MIN_COVER = 0.6
#: k-grams of a library that are compared inside expressions and broadcast, some 10 MB at most.
MOST_GRAMS = 50_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# The phrases of the base labels.
BASE_PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Short names of other licenses.
NAMES = (
    Template("bsd", "bsd license"),
    Template("bsd", "bsd 2 clause"),
    Template("bsd", "bsd 3 clause"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("isc", "isc license"),
    Template("lgpl", "lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "the unlicense"),
)
# Opening passages of license notices.
PASSAGES = (
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
LIBRARY = BASE_PHRASES + NAMES + PASSAGES


def gram_table(spark: SparkSession, library: tuple[Template, ...]) -> DataFrame:
    """One row per k-gram of a template: its words, place and hash. Its size is that of the library."""
    rows = []
    for t, template in enumerate(library):
        words = template.text.split()
        k = K_PASSAGE if len(words) > 2 * K_PASSAGE else min(K_PHRASE, len(words))
        n = len(words) - k + 1
        need = n if len(words) <= 2 * K_PASSAGE else -(-n * int(MIN_COVER * 100) // 100)
        for i in range(n):
            rows.append((t, template.label, template.base, n, need, i, words[i : i + k]))
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"a library of {len(rows)} k-grams; at most {MOST_GRAMS} are scanned for")
    made = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, need int, t_pos int, t_words array<string>")
    hashes = F.transform("t_words", lambda w: F.xxhash64(w))
    grams = F.when(F.size("t_words") == K_PASSAGE, gram(hashes, F.lit(0), K_PASSAGE)).otherwise(gram(hashes, F.lit(0), K_PHRASE))
    return made.withColumn("gram", grams).withColumn("first", F.xxhash64(F.get("t_words", F.lit(0))))


def gram(hashes: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)])


def scan(docs: DataFrame, library: tuple[Template, ...] = LIBRARY) -> DataFrame:
    """Licenses found in each row of ``docs``: base places, labels and the best cover of a template."""
    spark = docs.sparkSession
    table = gram_table(spark, library)
    # The library is fixed, so its hashes are as many as its words.
    known = [r["gram"] for r in table.select("gram").distinct().collect()]
    firsts = [r["first"] for r in table.select("first").distinct().collect()]

    # The Kelvin sign is the only character beyond ASCII whose lower case is one ASCII letter.
    text = F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("K"), F.lit("Å")))
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))
    hashed = words.select("*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # A k-gram can only be known if its first word starts a known one.
    starts = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(firsts), i)), lambda i: i.isNotNull())
    placed = hashed.select("doc_id", "row", "n_words", "words", "hashes", starts.alias("starts"))

    def grams(k: int) -> Column:
        made = F.transform("starts", lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), gram(F.col("hashes"), i, k).alias("gram")))
        return F.filter(made, lambda x: (x["pos"] + k <= F.col("n_words")) & x["gram"].isin(known))

    # Each hit takes along the words that its template would cover, wherever the hit stands in it.
    longest = max((len(t.text.split()) for t in library), default=0)
    begin = lambda pos: F.greatest(pos - longest, F.lit(0))
    found = placed.select("doc_id", "row", "n_words", "words", F.concat(grams(K_PHRASE), grams(K_PASSAGE)).alias("hits"))
    seen = F.transform(
        "hits",
        lambda x: F.struct(
            x["pos"].alias("pos"),
            x["gram"].alias("gram"),
            F.slice(F.col("words"), x["pos"] + 1, x["k"]).alias("text"),
            F.when(x["k"] == K_PASSAGE, F.slice(F.col("words"), begin(x["pos"]) + 1, F.lit(2 * longest + DIAGONAL_GAP))).alias("around"),
        ),
    )
    hits = found.select("doc_id", "row", "n_words", F.explode_outer(seen).alias("hit"))
    voted = hits.join(F.broadcast(table), (F.col("hit.gram") == table["gram"]) & (F.col("hit.text") == table["t_words"]), "left")
    # From here all steps are within a row of documents; one exchange serves them.
    of_row = ("doc_id", "row", "n_words", "template", "label", "base", "n_grams", "need")
    votes = (
        voted.select(*of_row, (F.col("hit.pos") - F.col("t_pos")).alias("diagonal"), "t_pos", F.struct(begin(F.col("hit.pos")).alias("begin"), F.col("hit.around").alias("words")).alias("around"))
        .repartition("row")
        .groupBy(*of_row, "diagonal")
        .agg(F.collect_set("t_pos").alias("places"), F.min("around").alias("around"))
    )
    phrase = F.col("n_grams") == F.col("need")
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DIAGONAL_GAP)
    spans = votes.withColumn("places", F.when(phrase, F.col("places")).otherwise(F.array_distinct(F.flatten(F.collect_list("places").over(near)))))
    texts = F.array(*[F.array(*[F.lit(w) for w in t.text.split()]) for t in library])
    in_text = lambda w, i: F.exists(
        F.array(*[F.lit(j) for j in range(DIAGONAL_GAP + 1)]),
        lambda j: F.coalesce(F.get(F.col("around.words"), (F.col("diagonal") + i + j - F.col("around.begin")).cast("int")) == w, F.lit(False)),
    )
    template = F.get(texts, F.col("template"))
    there = F.size(F.filter(template, in_text))
    votes_reach = F.size("places") >= F.col("need")
    stands = votes_reach & F.when(phrase | ~votes_reach, True).otherwise(there >= F.ceil(F.size(template) * int(MIN_COVER * 100) / 100))
    judged = spans.select("doc_id", "row", "n_words", "label", F.col("diagonal").alias("start"), F.coalesce(stands, F.lit(False)).alias("stands"), "base", (F.size("places") / F.col("n_grams")).alias("share"))
    base = F.col("stands") & F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    start = F.when(base, F.col("start")).cast("long")
    return (
        judged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(start).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            names(base).alias("base_labels"),
            names(F.col("stands")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("stands"), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
