"""Licence scan with a positional index of rare words, in DataFrame functions alone.

The index holds each template's words with their positions. A text is read once, and what stays of it are the places of its
licence words. Of these it looks up its own of highest IDF, counted over all texts; each hit proposes that a template lies at (position in the
text - position in the template), hits that agree are summed up, and a template is found where
enough agree and its mandatory key phrase stands in its place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are cut into words at every ASCII character that is no digit or letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """`text` in lower case; `key`: the phrase of it that must be there; `base`: counted at every place."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


# The labels and phrases of the base, then the usual notices by which licences are named.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("cc0", "creative commons zero v1 0 universal", "creative commons zero"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "above copyright notice and this permission notice shall be included"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "unless required by applicable law or agreed to in writing"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license as published"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of its contributors may be used to endorse"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "any person or organization obtaining a copy"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
)
#: Words of a template that a text looks up, and the share of their weight that must agree on a place.
RARE = 3
AGREE = 0.6


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null as empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def marks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words, word, at: the places of the licence words of each text, in order."""
    tokens = docs.select("doc_id", words(F.col("text")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    rows = tokens.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    return rows.select("doc_id", "n_words", F.col("places.word").alias("word"), F.col("places.at").alias("at"))


def idf(rows: DataFrame) -> dict[str, float]:
    """ln((1 + texts) / (1 + texts with the word)) of the licence words, over all texts; one count per word comes to the driver."""
    texts = rows.count()
    found = rows.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").count().collect()
    return {r["word"]: math.log((1 + texts) / (1 + r["count"])) for r in found}


def postings(template: Template, weight: dict[str, float]) -> list[tuple[str, int, float]]:
    """(word, position, share of the weight) of a template, the rarest word of its key phrase first, then by falling IDF; each at its first place, ties to the earlier."""
    first: dict[str, int] = {}
    for i, w in enumerate(template.words):
        first.setdefault(w, i)
    rare = lambda w: (-weight.get(w, math.inf), first[w])  # noqa: E731  a word of no text is never looked up
    lead = min(set(template.key_words), key=rare)
    order = [lead] if template.base else [lead, *sorted(set(first) - {lead}, key=rare)]
    # the key phrase may begin after an earlier place of the word
    first[lead] = template.key_at + template.key_words.index(lead)
    known = {w: weight.get(w, 0.0) + 1e-9 for w in order}
    total = known[lead] + sum(sorted((known[w] for w in order[1:]), reverse=True)[: RARE - 1])
    return [(w, first[w], known[w] / total) for w in order]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs` (doc_id, text; other columns are ignored).

    score is the highest share of a template's rare-word weight that agrees on one place where its key phrase stands (1 for a base phrase), 0
    without any. Null and empty texts have no words; repeated rows give repeated results; an empty table gives no rows. Work on a text
    grows with its words, and with the sorting of its hits.
    """
    rows = materialize(marks(docs, sorted({w for t in templates for w in t.words})), "marks")
    weight = idf(rows)
    index = F.array(
        *[
            F.struct(F.lit(i).alias("template"), F.lit(own[0][0]).alias("lead"), F.array(*[F.struct(F.lit(w).alias("word"), F.lit(at).alias("at"), F.lit(x).alias("share")) for w, at, x in own]).alias("words"))
            for i, own in ((i, postings(t, weight)) for i, t in enumerate(templates))
        ]
    )
    key = F.array(*[F.array(*map(F.lit, t.key_words)) for t in templates])
    key_at = F.array(*[F.lit(t.key_at) for t in templates])
    label = F.array(*[F.lit(t.label) for t in templates])
    is_base = F.array(*[F.lit(t.base) for t in templates])

    # the text's own rarest licence words of each template whose lead it holds
    has = F.array_distinct("word")
    rows = rows.select("*", has.alias("has"))
    own = lambda t: F.transform(F.slice(F.filter(t["words"], lambda w: F.array_contains("has", w["word"])), 1, RARE), lambda w: F.struct(w["word"].alias("word"), t["template"].alias("template"), w["at"].alias("at"), w["share"].alias("share"), (w["word"] == t["lead"]).alias("leads")))
    chosen = F.flatten(F.transform(F.filter(index, lambda t: F.array_contains("has", t["lead"])), own))
    rows = rows.select("doc_id", "n_words", "word", "at", chosen.alias("chosen"))
    rows = rows.select("*", F.array_distinct(F.col("chosen.word")).alias("looked_up"))

    def stands(c: Column, i: Column) -> Column:
        """The key phrase stands around place i of a lead: its words are licence words, so their places follow one another."""
        phrase = key[c["template"]]
        first = i - (c["at"] - key_at[c["template"]])
        last = first + F.size(phrase) - 1
        whole = (first >= 0) & (F.get("at", last) - F.get("at", F.greatest(first, F.lit(0))) == F.size(phrase) - 1) & (F.slice("word", F.greatest(first, F.lit(0)) + 1, F.size(phrase)) == phrase)
        return c["leads"] & F.coalesce(whole, F.lit(False))

    def hits(w: Column, i: Column) -> Column:
        at = F.get("at", i)
        found = F.transform(F.filter("chosen", lambda c: c["word"] == w), lambda c: F.struct(c["template"].alias("template"), (at - c["at"]).alias("start"), c["share"].alias("share"), stands(c, i).alias("stands")))
        return F.when(F.array_contains("looked_up", w), found)

    found = F.flatten(F.filter(F.transform("word", hits), lambda x: x.isNotNull()))
    rows = rows.select("doc_id", "n_words", F.array_sort(found).alias("hits"))

    def spot(h: Column, i: Column) -> Column:
        """A place at the last of its hits, of which there are RARE at most."""
        other = lambda k: F.get("hits", i + k)
        same = lambda k: F.coalesce((other(k)["template"] == h["template"]) & (other(k)["start"] == h["start"]), F.lit(False))
        share, ok = h["share"], h["stands"]
        for k in range(1, RARE):
            share = share + F.when(same(-k), other(-k)["share"]).otherwise(0.0)
            ok = ok | (same(-k) & other(-k)["stands"])
        return F.when(~same(1) & ok & (share >= AGREE), F.struct(h["template"].alias("template"), h["start"].alias("start"), F.round(F.least(share, F.lit(1.0)), 6).alias("share")))

    rows = rows.select("doc_id", "n_words", F.filter(F.transform("hits", spot), lambda x: x.isNotNull()).alias("spots"))
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: label[s["template"]]))), ",")
    rows = rows.select("doc_id", "n_words", "spots", F.filter("spots", lambda s: is_base[s["template"]]).alias("base"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("spots")).alias("labels"),
        F.coalesce(F.array_max(F.col("spots.share")), F.lit(0.0)).alias("score"),
    )
