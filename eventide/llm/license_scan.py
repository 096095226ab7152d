"""Licence scan with a positional index of rare template words.

Licence notices are kept as word templates. Inverse document frequencies of their words are
counted over all documents; the ``RARE`` words of a template with the highest are its index
entries, as postings (template, position). A file's words are looked up in that index; every
hit at place i of a posting at position k proposes that the template starts at i - k, and the
proposals that enough rare words of the template agree on are kept. A proposal counts when the
template's mandatory key phrases stand word for word at their places and the share of matched
words, weighted by inverse document frequency, reaches ``MIN_SCORE``.

All DataFrame functions: a file is one row throughout, there is no join and no shuffle but the
count of template words (as many groups as the templates have words).

Defined results: NULL or empty text has no words and no labels (empty strings) and score 0; first
and last word are NULL without a base phrase; a file may hold several templates and each counts once as
a label; repeated rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_text
from .outliers import let

#: Phrases that always count, and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices of public licences and the phrases that must stand in them (fixed values).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license 2 0", ("except in compliance with the license",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation", ("terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("distribute this software for any purpose with or without fee",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
     ("eclipse public license 2",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights cc0 1 0",
     ("has waived all copyright and related or neighboring rights",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0 international",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial 4 0 international",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)
RARE = 4
#: Rare words that must agree on a start (all of them where a template has fewer).
AGREE = 2
MIN_SCORE = 0.6

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def file_words(text: Column) -> Column:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` words after lower-casing A-Z only."""
    t = empty_text(text)
    upper = "".join(map(chr, range(65, 91)))
    # lower() maps two letters outside ASCII into it; only a text with one pays for the slow way
    low = F.when(t.rlike(r"[\u212A\u0130]"), F.translate(t, upper, upper.lower())).otherwise(F.lower(t))
    return F.filter(F.split(low, _GAPS), lambda w: w != "")


def inverse_frequencies(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """Smoothed inverse document frequency of ``words`` over all of ``docs``."""
    n = docs.count()
    found = (docs.select(F.explode(F.array_intersect(file_words(F.col("text")), F.array(*map(F.lit, words)))).alias("w"))
             .groupBy("w").count())
    df = {r[0]: r[1] for r in found.collect()}  # as many rows as the templates have words
    return {w: math.log((n + 1.0) / (df.get(w, 0) + 1.0)) + 1.0 for w in words}


def _array(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def scan(docs: DataFrame, templates: tuple = TEMPLATES, rare: int = RARE, agree: int = AGREE,
         min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score and ``found``: the templates found, each an array entry
    of label, first word and score."""
    split = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in templates]
    idf = inverse_frequencies(docs, sorted({w for _, words, _ in split for w in words}))
    postings: dict[str, list[Column]] = {}
    rows = []
    for t, (label, words, keys) in enumerate(split):
        entries = sorted(set(words), key=lambda w: (-idf[w], w))[:rare]
        for k, w in enumerate(words):
            if w in entries:
                postings.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")))
        must = [False] * len(words)
        for key in keys:
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            must[at:at + len(key)] = [True] * len(key)
        first = [words.index(w) == k and w in entries for k, w in enumerate(words)]
        rows.append(F.struct(
            F.lit(label).alias("label"), _array(words, "string").alias("words"),
            _array([idf[w] / sum(idf[x] for x in words) for w in words], "double").alias("share"),
            _array(must, "boolean").alias("must"), _array(first, "boolean").alias("rare"),
            F.lit(min(agree, len(entries))).alias("agree")))
    table = F.array(*rows)
    index = F.create_map(*[c for w, p in postings.items() for c in (F.lit(w), F.array(*p))])
    base = [(phrase.split(), label) for phrase, label in BASE]
    heads = sorted({p[0] for p, _ in base} | set(postings))

    def base_label(words: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in base:
            stands = F.lit(True)
            for k, w in enumerate(phrase):
                stands = stands & F.get(words, i + k).eqNullSafe(F.lit(w))
            out = F.when(stands, F.lit(label)).otherwise(out)
        return out

    def judged(words: Column, start: Column) -> Column:
        """label, first word and score of a proposal; score NULL when it does not hold."""
        def of(t: Column) -> Column:
            def held(m: Column) -> Column:
                score = F.aggregate(F.zip_with(m, t["share"], lambda a, s: F.when(a, s).otherwise(F.lit(0.0))),
                                    F.lit(0.0), lambda a, b: a + b)
                agreed = F.size(F.filter(F.zip_with(m, t["rare"], lambda a, b: a & b), lambda x: x))
                broken = F.exists(F.zip_with(m, t["must"], lambda a, b: b & ~a), lambda x: x)
                return F.struct(t["label"].alias("label"), start["at"].alias("first_word"),
                                F.when((agreed >= t["agree"]) & ~broken & (score >= min_score),
                                       F.least(score, F.lit(1.0))).alias("score"))
            return let(F.transform(t["words"], lambda w, k: F.get(words, start["at"] + k).eqNullSafe(w)), held)
        return let(F.element_at(table, start["t"] + 1), of)

    def of_words(words: Column) -> Column:
        def of_hits(hits: Column) -> Column:
            places = F.filter(F.transform(hits, lambda i: F.struct(i.alias("i"), base_label(words, i).alias("label"))),
                              lambda p: p["label"].isNotNull())
            starts = F.array_distinct(F.flatten(F.transform(
                hits, lambda i: F.coalesce(F.transform(F.element_at(index, F.get(words, i)),
                                                       lambda p: F.struct(p["t"].alias("t"), (i - p["k"]).alias("at"))),
                                           F.array().cast("array<struct<t:int,at:int>>")))))
            found = F.filter(F.transform(starts, lambda s: judged(words, s)), lambda x: x["score"].isNotNull())
            return F.struct(F.size(words).cast("long").alias("n_words"), places.alias("places"), found.alias("found"))
        here = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(heads)))
        return let(F.coalesce(here, F.array().cast("array<int>")), of_hits)

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    out = docs.select("doc_id", let(file_words(F.col("text")), of_words).alias("s"))
    places, found = F.col("s.places"), F.col("s.found")
    in_base = F.transform(places, lambda p: p["label"])
    return out.select(
        "doc_id", F.col("s.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["i"])).cast("long").alias("last_word"),
        joined(in_base).alias("base_labels"),
        joined(F.concat(in_base, F.transform(found, lambda f: f["label"]))).alias("labels"),
        F.greatest(F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                   F.coalesce(F.array_max(F.transform(found, lambda f: f["score"])), F.lit(0.0))).alias("score"),
        found.alias("found"))
