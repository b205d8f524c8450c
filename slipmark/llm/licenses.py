"""License scans with a positional index of rare tokens: anchors, relative positions, mandatory key phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmark.functions.lets import indexes, let

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Whole licence texts, as words.
MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
    "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
    "other dealings in the software"
)
BSD_TEXT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution"
)
ISC_TEXT = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies"
)
#: Templates: label, text, and a key phrase of it that a file must hold at the place that the alignment gives.
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", MIT_TEXT, "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("bsd", BSD_TEXT, "source and binary forms with or without"),
    ("isc", ISC_TEXT, "for any purpose with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
)


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _stands(words: Column, at, phrase: str) -> Column:
    """The words of ``phrase`` stand at ``at``."""
    found = None
    for j, w in enumerate(phrase.split()):
        here = F.coalesce(F.get(words, at + j) == w, F.lit(False))
        found = here if found is None else found & here
    return found


def _at_phrase(words: Column, phrase: str):
    return lambda at: _stands(words, at, phrase)


def _aligned(words: Column, here: Column, text: str, key: str, anchors: list[str]) -> Column:
    """Largest share of a template's words at their places, over the relative positions that all its anchors agree on."""
    of = text.split()
    key_at = text[: text.index(key)].count(" ")

    def agrees(offset):
        votes = F.size(F.array_distinct(F.transform(F.filter(here, lambda e: e["o"] == offset), lambda e: e["w"])))
        return (votes == len(anchors)) & _stands(words, offset + key_at, key)

    def share(offset):
        held = F.filter(F.transform(_list(of), lambda w, j: F.coalesce(F.get(words, offset + j) == w, F.lit(False))), lambda same: same)
        return F.size(held).cast("double") / len(of)

    places = F.filter(F.array_distinct(F.transform(here, lambda e: e["o"])), agrees)
    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))


def _of_template(t: int):
    return lambda e: e["t"] == t


def inverse_frequencies(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, float]:
    """log(texts / texts with the word), over all texts, for each word of the templates (as many rows as these have)."""
    import math

    words = sorted({w for _, text, _ in templates for w in text.split()})
    text = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    held = F.array_distinct(F.filter(F.split(text, _NOT_WORD), lambda w: w.isin(words)))
    rows = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, anchors: int = 4
) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Of each template's key phrase the ``anchors`` words with the highest inverse document frequency are looked up in a file,
    if it holds them all; the positional postings give template and relative position (place in the file minus place in
    the template). Where all of a template's anchors agree on it and the key phrase stands at its place, the template's
    label is added: a file with several licences has all their labels. ``score`` is 1 with a base phrase, else the
    largest share of a template's words found at their places. Row-local but for the counts of the template words. A null
    text is empty: no words, null places, empty labels, score 0; repeated rows and null ids are kept; words of equal
    frequency are taken in their own order; a very long text is one row like others.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    weights = inverse_frequencies(rows, "text", templates)
    # a text without one of these words, in either case, holds no base phrase and no key phrase
    rarest = lambda phrase: max(phrase.split(), key=lambda w: (weights.get(w, 0.0), w))
    needed = sorted({*map(rarest, PHRASES), *(rarest(key) for _, _, key in templates)})
    may_hold = F.col("text").rlike("(?i)" + "|".join(needed))
    lowered = F.when(may_hold, F.translate(F.col("text"), _UPPER, _UPPER.lower()))
    words = F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _NOT_WORD), "")
    by_rarity = lambda phrase: sorted(set(phrase.split()), key=lambda w: (-weights.get(w, 0.0), w))
    rare = [by_rarity(key)[:anchors] for _, _, key in templates]
    vocabulary = sorted({w for of in rare for w in of})
    # an anchor's postings: its places in the templates that it is an anchor of, counted from the key phrase's own
    postings = {
        w: [(t, i) for t, (_, text, key) in enumerate(templates) if w in rare[t]
            for i, x in enumerate(text.split()) if x == w and 0 <= i - text[: text.index(key)].count(" ") < len(key.split())]
        for w in vocabulary
    }
    posting_map = F.create_map(*[
        x for w in vocabulary
        for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in postings[w]]))
    ])

    def scan(x):
        places = indexes(F.size(x["w"]))
        phrase_places = [F.filter(places, _at_phrase(x["w"], phrase)) for phrase in PHRASES]
        hits = F.filter(F.transform(x["w"], lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: e["w"].isin(vocabulary))
        return let({"w": x["w"], "base": F.array(*phrase_places), "hits": hits}, choose)

    def choose(x):
        own = F.array_distinct(F.transform(x["hits"], lambda e: e["w"]))
        return let({"w": x["w"], "base": x["base"], "hits": x["hits"], "own": own}, offsets)

    def offsets(x):
        whole = F.array(*[F.size(F.array_intersect(x["own"], _list(of))) == len(of) for of in rare])
        return let({"w": x["w"], "base": x["base"], "hits": x["hits"], "whole": whole}, intersect)

    def intersect(x):
        at = F.flatten(F.transform(x["hits"], lambda e: F.transform(
            F.filter(F.element_at(posting_map, e["w"]), lambda p: F.get(x["whole"], p["t"])),
            lambda p: F.struct(p["t"].alias("t"), (e["i"] - p["i"]).alias("o"), e["w"].alias("w")))))
        return let({"w": x["w"], "base": x["base"], "whole": x["whole"], "at": at}, verify)

    def verify(x):
        labels = []
        for t, (label, text, key) in enumerate(templates):
            here = F.filter(x["at"], _of_template(t))
            score = F.when(F.get(x["whole"], F.lit(t)), _aligned(x["w"], here, text, key, rare[t])).otherwise(F.lit(0.0))
            labels.append(F.struct(F.lit(label).alias("label"), score.alias("score")))
        return F.struct(x["base"].alias("base"), F.array(*labels).alias("found"))

    found = rows.select("doc_id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"),
                        let({"w": words}, scan).alias("s"))
    starts = F.flatten("s.base")
    base_labels = F.filter(
        F.array(*[F.when(F.size(F.get("s.base", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]),
        lambda v: v.isNotNull(),
    )
    more = F.transform(F.filter("s.found", lambda e: e["score"] > 0), lambda e: e["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, more)).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("s.found", lambda e: e["score"])), F.lit(0.0))).alias("score"),
    )
