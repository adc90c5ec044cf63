"""License scan by a positional index of rare words, built-in functions only.

Templates of license notices are indexed word by word: where each word stands in which template.
The weight of a word is its inverse document frequency over the whole corpus; it only orders the
words, and none is too common to be looked up. A candidate counts once the template's mandatory
key phrase stands at its place, so each template is looked up by the rarest words of that phrase:
postings that agree on the relative position of text and template make a candidate, and no template
that stands in a text is missed. All of it happens within a row, so there is no shuffle but the
counting of at most as many words as the templates hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, mandatory key phrase, words of the notice.
TEMPLATES = (
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "you may not use this file except in compliance with the license you may obtain a copy of the apache license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved", "copyright all rights reserved"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
)
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null and empty give none."""
    whole = F.coalesce(text, F.lit(""))
    # lower() makes one other letter, the Kelvin sign, an ASCII one; such texts go letter by letter.
    low = F.when(whole.contains("\u212a"), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(low, BREAK), "")


def vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()})


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_weights(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over column ``words`` of all rows."""
    held = words.select(F.explode(F.array_intersect("words", _strings(["", *vocabulary()]))).alias("w"))
    total = words.count()
    found = {r.w: r["count"] for r in held.groupBy("w").count().collect()}
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary()}


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another."""
    parts = phrase.split()

    def here(w: Column, i: Column) -> Column:
        hit = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(hit, i)

    present = F.lit(True)
    for part in parts:
        present = present & F.array_contains(words, part)
    none = F.array().cast("array<int>")
    return F.when(present, F.filter(F.transform(words, here), lambda x: x.isNotNull())).otherwise(none)


def scan(
    docs: DataFrame, rare_words: int = 2, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: words, base places and labels, all labels, score.

    Each template is looked up by the ``rare_words`` rarest words of its key phrase (at least one),
    however common they are. A verified candidate gives its label if ``min_share`` of the
    template's words stand in place; the score is the largest such share, and 1 where a base phrase
    was found. Null and empty texts have no words, no places, empty labels and score 0. Repeated
    rows give repeated results, a null id stays null, other columns are not read, an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    weights = word_weights(rows)
    ranked = sorted(weights, key=lambda w: (-weights[w], w))
    words = F.col("words")
    base = {label: _places(words, phrase) for phrase, label in BASE.items()}
    chosen = [_rarest(key, ranked, max(1, rare_words)) for _, key, _ in TEMPLATES]
    some = sorted({w for own in chosen for w in own})
    held = F.array_intersect(_strings(some), words)
    # Only the words of templates whose chosen words are all in the text.
    rare = F.array_distinct(F.flatten(F.array(*[_all_or_none(F.col("held"), own) for own in chosen])))
    first = rows.select(
        "doc_id", "words", F.size(words).cast("long").alias("n_words"),
        *[places.alias(f"at_{i}") for i, places in enumerate(base.values())], held.alias("held"),
    ).withColumn("rare", rare)
    index = F.array(
        *[
            F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(_key_at(t) + TEMPLATES[t][1].split().index(w)).alias("p"))
            for t, own in enumerate(chosen)
            for w in own
        ]
    )
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("rare", x["w"]))
    second = first.withColumn("hits", F.when(F.size("rare") > 0, hits))
    aligned = F.sort_array(
        F.flatten(
            F.transform(
                "hits",
                lambda h: F.transform(
                    F.filter(index, lambda x: x["w"] == h["w"]),
                    lambda x: F.struct(x["t"].alias("t"), (h["i"] - x["p"]).alias("o")),
                ),
            )
        )
    )
    third = second.withColumn("aligned", aligned)
    # A candidate: a template and an offset that enough rare words agree on.
    least = F.array(*[F.lit(len(own)) for own in chosen])
    a = F.col("aligned")

    def agreed(x: Column, k: Column) -> Column:
        starts = ~F.coalesce(F.get(a, k - 1) == x, F.lit(False))
        enough = F.element_at(least, x["t"] + 1)
        return starts & F.coalesce(F.get(a, k + enough - 1) == x, F.lit(False))

    fourth = third.withColumn("candidates", F.filter(a, agreed))
    shares = F.transform("candidates", lambda c: F.struct(c["t"].alias("t"), _share(words, c).alias("share")))
    fifth = fourth.withColumn("verified", F.filter(shares, lambda s: s["share"] >= min_share))
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    more = F.coalesce(F.transform("verified", lambda s: F.element_at(names, s["t"] + 1)), F.array().cast("array<string>"))
    base_labels = F.filter(
        F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(base)]), lambda x: x.isNotNull()
    )
    places = F.concat(*[F.col(f"at_{i}") for i in range(len(base))])
    best = F.greatest(
        F.coalesce(F.array_max(F.transform("verified", lambda s: s["share"])), F.lit(0.0)),
        F.when(F.size(places) > 0, 1.0).otherwise(0.0),
    )
    return fifth.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base_labels)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base_labels, more)))).alias("labels"),
        best.alias("score"),
    )


def _rarest(key: str, ranked: list[str], most: int) -> list[str]:
    """The rarest words of a key phrase."""
    own = set(key.split())
    return [w for w in ranked if w in own][:most]


def _all_or_none(held: Column, own: list[str]) -> Column:
    """These words if all of them are held."""
    every = F.lit(True)
    for w in own:
        every = every & F.array_contains(held, w)
    return F.when(every, _strings(own)).otherwise(F.array().cast("array<string>"))


def _key_at(t: int) -> int:
    """Where the key phrase begins in a template."""
    _, key, text = TEMPLATES[t]
    parts, keys = text.split(), key.split()
    return next(i for i in range(len(parts)) if parts[i : i + len(keys)] == keys)


def _share(words: Column, candidate: Column) -> Column:
    """Share of the template's words in place, or 0 without its key phrase in place."""
    offset = candidate["o"]
    share = F.lit(0.0)
    for t, (_, key, text) in enumerate(TEMPLATES):
        parts, keys, at = text.split(), key.split(), _key_at(t)
        stands = F.lit(True)
        for k, part in enumerate(keys):
            stands = stands & F.coalesce(F.get(words, offset + at + k) == part, F.lit(False))
        inside = sum(
            (F.when(F.get(words, offset + p) == part, 1).otherwise(0) for p, part in enumerate(parts)), F.lit(0)
        )
        share = F.when((candidate["t"] == t) & stands, inside / len(parts)).otherwise(share)
    return share
