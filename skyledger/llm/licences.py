"""Licence scans over a positional index of rare words.

A word's weight is its inverse document frequency in the whole corpus. Each template's highest-weighted words are
posted with their positions, so many that a text with the least share of the template in place holds at least two of
them in place (one, if one word alone may reach that share). Every posted word of a file is looked up; a word at place
p that a template has at place q votes for the template to start at p - q. Templates with enough votes for one start
are compared word by word there, and count only if their mandatory key phrases stand in the matched words.

Only DataFrame functions are used. Texts are split twice, once for the frequencies and once for the places; what is
shuffled is one row per vote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.operators.lineage import settle

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that always label, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


#: Postings of all templates that are broadcast at most.
BROADCAST_POSTINGS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrases: tuple[str, ...]


# Opening words of public licences and usual notices, normalised, with the phrases they must show.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("is hereby granted",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("public domain",)),
)


def split_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case. The two letters that lower-case into ASCII are set aside."""
    body = F.coalesce(text, F.lit(""))
    for letter in ("K", "İ"):
        body = F.replace(body, F.lit(letter), F.lit("ß"))
    return F.array_remove(F.split(F.lower(body), GAP), "")


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary; one row per word comes to the driver."""
    own = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(own, split_words(F.col(text)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def base_places(words: str) -> Column:
    """(place, label) of every place where a base phrase's words stand in a row."""
    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE:
            same = None
            for k, w in enumerate(phrase.split()):
                one = F.get(words, i + k) == w
                same = one if same is None else same & one
            out = F.when(same, name).otherwise(out)
        return out

    firsts = F.array(*[F.lit(p.split()[-1]) for p, _ in BASE])
    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label(i).alias("label")))
    return F.when(
        (F.size(words) > 1) & F.arrays_overlap(words, firsts), F.filter(every, lambda x: x["label"].isNotNull())
    ).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def voting_words(body: list[str], shares: list[float], least: float) -> tuple[list[str], int]:
    """The template's highest-weighted words that are looked up, and how many of them must agree on a start.

    No text with ``least`` of the template's weight in place has fewer of them in place: what it misses weighs at most
    1 - ``least``, and the words weigh more even without the heaviest of them.
    """
    own: dict[str, float] = {}
    for w, x in zip(body, shares):
        own[w] = own.get(w, 0.0) + x
    order = sorted(own, key=lambda w: (-own[w], w))
    for votes in (2, 1):
        for k in range(votes, len(order) + 1):
            # The heaviest words come first; all but votes - 1 of these may be missed.
            if sum(own[w] for w in order[votes - 1 : k]) > 1 - least + 1e-9:
                return order[:k], votes
    return order, 1


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES,
    least: float = 0.8,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``
    and ``score``, the largest weighted share of a verified template's words that stand in place (1 with a base phrase).

    ``least``: share of a template's weight that must match. A template whose words are all in every document weighs
    them equally. Null and empty texts have no words and no labels; repeated rows are labelled each; rows with one id
    share what the method finds. An empty table gives no rows. Other columns are not read.
    """
    bodies = [t.words.split() for t in templates]
    vocabulary = sorted({w for b in bodies for w in b})
    held = document_frequencies(docs, text, vocabulary)
    n = max(1, docs.count())
    weight = {w: math.log((n + 1) / (held.get(w, 0) + 1)) for w in vocabulary}
    shares = [_shares(b, weight) for b in bodies]
    voting = [voting_words(b, x, least) for b, x in zip(bodies, shares)]
    posted_words = sorted({w for words, _ in voting for w in words})
    reach = max(map(len, bodies))
    split = docs.select(F.col(key).alias("id"), split_words(F.col(text)).alias("words"))
    chosen = split.withColumn("places", base_places("words"))
    near = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(posted_words), F.struct(
            w.alias("word"), i.alias("at"),
            F.slice("words", F.greatest(i - reach + 1, F.lit(1)), reach * 2).alias("near"),
            (F.greatest(i - reach, F.lit(0))).alias("begin")))),
        lambda x: x.isNotNull())
    found = settle(chosen.select(
        "id", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base"),
        near.alias("near")), "licences")
    postings = [(w, t, q) for t, b in enumerate(bodies) for q, w in enumerate(b) if w in voting[t][0]]
    posted = docs.sparkSession.createDataFrame(postings or [("", 0, 0)], "word string, template int, q int")
    if len(postings) <= BROADCAST_POSTINGS:  # a frequent word then stays where its files are
        posted = F.broadcast(posted)
    votes = (
        found.select("id", F.explode("near").alias("v")).select("id", "v.*").join(posted, "word")
        .withColumn("start", F.col("at") - F.col("q"))
        # The words that the template would cover, from the words near the vote.
        .withColumn("covered", F.when(F.col("start") >= F.col("begin"), F.slice(
            "near", F.greatest(F.col("start") - F.col("begin") + 1, F.lit(1)), _by_template([len(b) for b in bodies]))))
        .filter("covered IS NOT NULL")
        .groupBy("id", "template", "start").agg(
            F.countDistinct("word").alias("voters"), F.min("covered").alias("covered"))
    )
    needed = _by_template([votes for _, votes in voting])
    labels = (
        votes.filter(F.col("voters") >= needed)
        .withColumn("share", _share(bodies, shares)).filter((F.col("share") >= least) & _phrases(templates))
        .groupBy("id").agg(F.max("share").alias("share"), F.collect_set(_by_template([t.label for t in templates])).alias("more"))
        .withColumnRenamed("id", "of")
    )
    none = F.array().cast("array<string>")
    return found.join(labels, F.col("id").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _by_template(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)


def _shares(body: list[str], weight: dict[str, float]) -> list[float]:
    """Share of each place of the template in its weight."""
    total = sum(weight[w] for w in body)
    return [weight[w] / total if total else 1 / len(body) for w in body]


def _share(bodies: list[list[str]], shares: list[list[float]]) -> Column:
    """Weight of the template's words that stand in their place, of all its weight."""
    out = F.lit(0.0)
    for t, body in enumerate(bodies):
        same = sum((F.when(F.get("covered", F.lit(q)) == w, shares[t][q]).otherwise(0.0) for q, w in enumerate(body)), F.lit(0.0))
        out = F.when(F.col("template") == t, same).otherwise(out)
    return F.least(out, F.lit(1.0))


def _phrases(templates: tuple[Template, ...]) -> Column:
    text = F.concat(F.lit(" "), F.array_join("covered", " "), F.lit(" "))
    out = F.lit(False)
    for t, template in enumerate(templates):
        held = F.lit(True)
        for phrase in template.phrases:
            held = held & F.contains(text, F.lit(f" {phrase} "))
        out = F.when(F.col("template") == t, held).otherwise(out)
    return out
