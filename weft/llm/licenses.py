"""License scans, in DataFrame operations only.

Texts are cut into words, and windows as long as a template overlap, a step apart. A window's 32 MinHash values over
5-word shingles form 16 bands of two; a template is retrieved where a band agrees. A verbatim notice at the worst offset
has a Jaccard similarity of 0.8 or more with its window and meets its template with probability 1 - (1 - 0.64)^16 > 0.9999999;
at similarity 0.5 it is still 0.99. Candidates are verified: the exact share of the template's shingles that the window,
with a step more on either side, contains.

Before windows are made, places that can't match are left out, without loss: a few anchor words of each template are
chosen so that fewer than the wanted share of its shingles are free of them. Whatever reaches the threshold contains an
anchor, so only windows over one are made, and texts without any are not cut at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import stored

K, BANDS, ROWS = 5, 16, 2
#: Notices as published with each license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
PREFERRED = ("licen", "redistribut", "permi", "copyright")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[str]:
        return list(dict.fromkeys(" ".join(self.words[i : i + K]) for i in range(max(1, len(self.words) - K + 1))))

    def anchors(self, least: float) -> set[str]:
        """Words without which fewer than least of the shingles remain: preferred ones first, then long ones."""
        chosen: list[str] = []
        for w in sorted(set(self.words), key=lambda w: (not w.startswith(PREFERRED), -len(w), w)):
            chosen.append(w)
            free = sum(not set(s.split(" ")) & set(chosen) for s in self.shingles)
            if free < least * len(self.shingles):
                return set(chosen)
        raise ValueError(f"{self.name} has no words")


def cut(text: Column) -> Column:
    """Words of letters and digits, lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingled(words: Column, at: Column) -> Column:
    """(pos, h): place and hash of the K-word runs that begin at the places of an array of words."""
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, K))).alias("h")))


def starts(words: Column) -> Column:
    """Places at which a run of K words begins; a shorter text is one run."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - K, F.lit(0)))


#: The MinHash values of a shingle hash, one for each function.
MINIMA = [f"m{j}" for j in range(BANDS * ROWS)]


def minima() -> list[Column]:
    return [F.xxhash64(F.col("h"), F.lit(j)).alias(m) for j, m in enumerate(MINIMA)]


def banded(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, band, bk) of each group of shingles: 32 least values, two to a band. Combines before the shuffle."""
    least = rows.groupBy(*by).agg(*[F.min(m).alias(m) for m in MINIMA])
    keys = [F.xxhash64(F.lit(b), *[F.col(m) for m in MINIMA[b * ROWS : (b + 1) * ROWS]]) for b in range(BANDS)]
    return least.select(*by, F.posexplode(F.array(*keys)).alias("band", "bk"))


def step_of(length: int) -> int:
    return max(1, (length - K + 1) // 8)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, first_word) for each document and template that reaches the threshold.

    docs: doc_id, text; other columns are left out. containment: the greatest share of the template's distinct shingles in
    one window; first_word: where the first such window begins, counted from 0. A null or empty text matches nothing.
    Rows that share an id count as one document, null ids too. Work is in proportion to the anchors in the texts: each
    shingle near one is hashed once, its MinHash values are made once, and windows and matches are grouped rows, so a
    text or a template with very many shingles is never gathered in an array.
    """
    spark: SparkSession = docs.sparkSession
    raw = templates or TEMPLATES
    if sum(map(len, raw.values())) > 5_000_000:
        raise ValueError("templates are broadcast: at most 5 million characters together")
    known = [Template(n, tuple(w for w in re.split(r"[^\w]+|_", t.lower()) if w)) for n, t in raw.items()]
    known = [t for t in known if t.words]
    anchors = sorted({a for t in known for a in t.anchors(least)})
    lengths = sorted({max(K, len(t.words)) for t in known})
    span = max(n + 2 * step_of(n) for n in lengths)  # of a window with a step more on either side
    low = docs.select("doc_id", "text", F.lower("text").alias("low"))
    some = F.lit(False)
    for a in anchors:
        some = some | F.contains(F.col("low"), F.lit(a))
    words = low.filter(some).select("doc_id", F.xxhash64("text").alias("tk"), cut(F.col("text")).alias("words"))
    listed = F.array(*[F.lit(a) for a in anchors])
    # no filter on what is made of words: it would be pushed below and cut the text anew for each place
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: F.array_contains(listed, F.get(F.col("words"), i)))
    placed = words.select("doc_id", "tk", "words", at.alias("at"))
    last = F.greatest(F.size("words") - K, F.lit(0))
    near = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.least(F.greatest(p - span, F.lit(0)), last), F.least(p + span, last)))))
    shingles = stored(placed.select("doc_id", "tk", F.explode(shingled(F.col("words"), near)).alias("x")).select("doc_id", "tk", "x.pos", "x.h").distinct(), "shingles")

    def frames(n: int) -> Column:
        """The windows of n words, a step apart, that have a shingle at pos."""
        s, pos = step_of(n), F.col("pos")
        from_, to = F.ceil(F.greatest(pos - (n - K), F.lit(0)) / s).cast("int"), F.floor(pos / s).cast("int")
        return F.transform(F.sequence(from_, to), lambda w: F.struct(F.lit(n).alias("n"), (w * s).alias("first")))

    rows = [(t.name, max(K, len(t.words)), step_of(max(K, len(t.words))), len(t.shingles), list(t.words)) for t in known]
    whole = spark.createDataFrame(rows, "license string, n int, s int, total int, words array<string>")
    of = whole.select("license", "n", "s", "total", F.explode(shingled(F.col("words"), starts(F.col("words")))).alias("x")).select("license", "n", "s", "total", "x.h").distinct()
    # dealt by text once, while rows are narrow: windows and their wide rows then need no shuffle
    windows = shingles.repartition("doc_id", "tk").select("doc_id", "tk", *minima(), F.explode(F.concat(*map(frames, lengths))).alias("x")).select("doc_id", "tk", "x.n", "x.first", *MINIMA)
    keys = banded(of.select("license", "n", "s", "total", *minima()), "license", "n", "s", "total")
    met = banded(windows, "doc_id", "tk", "n", "first").join(F.broadcast(keys), ["n", "band", "bk"])  # size checked above
    # a candidate's place, with a step more on either side, lies in one or two bins of the text
    begin, end = F.greatest(F.col("first") - F.col("s"), F.lit(0)), F.col("first") + F.col("n") + F.col("s") - K
    place = met.select("doc_id", "tk", "license", "first", "total", begin.alias("begin"), end.alias("end")).distinct()
    place = place.select("*", F.explode(F.sequence(F.floor(F.col("begin") / span), F.floor(F.col("end") / span))).alias("bin"))
    same = shingles.join(F.broadcast(of.select("license", "h")), "h").select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), F.col("license").alias("l"), "pos", "h", F.floor(F.col("pos") / span).alias("b"))
    both = place.join(same, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")) & (F.col("license") == F.col("l")) & (F.col("bin") == F.col("b")) & F.col("pos").between(F.col("begin"), F.col("end")))
    share = both.groupBy("doc_id", "tk", "license", "first", "total").agg(F.count_distinct("h").alias("n"))
    found = share.select("doc_id", "license", "first", (F.col("n") / F.col("total")).alias("containment")).filter(F.col("containment") >= least)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word"))


def oracle(least: float = 0.8) -> str:
    """DuckDB SQL over `documents` for (doc_id, license, containment): every run of K words against every template's,
    and for each run that matches the share of the template within a window that begins there."""
    rows = []
    for name, notice in TEMPLATES.items():
        t = Template(name, tuple(w for w in re.split(r"[^\w]+|_", notice.lower()) if w))
        n = max(K, len(t.words))
        span = n + 2 * step_of(n) - K  # from the first run of a window to its last
        rows += [f"('{name}', {len(t.shingles)}, {span}, {i}, '{s}')" for i, s in enumerate(t.shingles)]
    return f"""
WITH t(license, total, span, ix, run) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, p, array_to_string(ws[p : p + {K - 1}], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {K - 1}, 1) + 1)) AS p FROM w)),
m AS (SELECT doc_id, license, total, span, ix, p FROM r JOIN t USING (run)),
c AS (SELECT a.doc_id, a.license, a.p, count(DISTINCT b.ix) / any_value(a.total) AS share FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.license = a.license AND b.p BETWEEN a.p AND a.p + a.span GROUP BY ALL)
SELECT doc_id, license, CAST(max(share) AS DOUBLE) AS containment FROM c GROUP BY doc_id, license HAVING max(share) >= {least}
"""
