"""Licence scans by a positional index of rare words.

Templates are word sequences of which a share must stand at their places, the
words of their key phrases all.  Of the templates whose key words a file has all
of, the file looks up those template words that it has and that have the highest
IDF in the corpus: so many that a placement which matches well enough holds some
of them for certain, at most three.  An occurrence at i of a word that a template
has at p proposes the placement i - p; the proposals are intersected, that is
only placements which so many looked-up words agree on go on.  These are
verified: enough of the template's words in their places, and all words of its
key phrases.

DataFrame expressions only.  A file is judged in its own row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words: of ASCII all but letters and digits.  After lower-casing, and before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``key`` phrases must match whole; of all words the share ``need``."""

    label: str
    text: str
    key: tuple[str, ...] = ()
    need: float = 0.8
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def least(self) -> int:
        return math.ceil(self.need * len(self.words) - 1e-9)

    @property
    def key_places(self) -> list[int]:
        if self.need == 1.0:
            return list(range(len(self.words)))
        out: set[int] = set()
        for phrase in self.key:
            part = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            out.update(range(at, at + len(part)))
        return sorted(out)


# Wordings of licences and of notices that name them, as words.
TEMPLATES = (
    Template("cc-by", "cc by", need=1.0, base=True),
    Template("gpl", "general public license", need=1.0, base=True),
    Template("reserved", "all rights reserved", need=1.0, base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", key=("apache license", "2 0")),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", key=("agreed to in writing", "governing permissions and limitations")),
    Template("mit", "released under the mit license", key=("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", key=("permission is hereby granted", "to deal in the software without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", key=("for any purpose with or without fee", "is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", key=("redistribution and use in source and binary forms",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", key=("general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", key=("general public license", "version 2")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", key=("redistribute it and or modify it under the terms", "gnu general public license")),
    Template("lgpl", "gnu lesser general public license", key=("lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", key=("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", key=("cc by sa",)),
    Template("mpl-2.0", "mozilla public license version 2 0", key=("mozilla public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", key=("source code form", "mozilla public license")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", key=("free and unencumbered software", "public domain")),
)
#: Looked-up words that must agree on a placement, where a template has as many.
AGREE = 3


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), GAP), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates is; over all documents, at most a row a word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    literal = F.array(*(F.lit(w) for w in vocabulary))
    rows = docs.select(F.explode(F.array_intersect(F.split(lowered(F.col("text")), GAP), literal)).alias("word"))
    return {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}


@dataclass(frozen=True)
class Posting:
    """A template's index entry: places by falling IDF, and the key word that is rarest in the corpus."""

    places: tuple[int, ...]
    anchor: str
    agree: int


def index(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[Posting]:
    out = []
    for t in templates:
        places = sorted(range(len(t.words)), key=lambda p: (frequency.get(t.words[p], 0), p))
        keys = set(t.key_places)
        if not keys:
            raise ValueError(f"a template of {t.label} has no key phrase")
        out.append(Posting(tuple(places), t.words[next(p for p in places if p in keys)], min(AGREE, t.least)))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, frequency: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of every row.

    ``matches`` lists (label, start, hits, size).  ``score`` is the largest share
    of a matched template's words that are in place, 0 without a match.  A null
    text is an empty one; null and repeated ids are rows like any other; an empty
    table gives an empty one; extra columns are left out.
    """
    frequency = document_frequencies(docs, templates) if frequency is None else frequency
    postings = index(templates, frequency)
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for t in templates for w in t.words})))
    literals = lambda values: F.array(*(F.lit(v) for v in values))
    table = F.array(*(
        F.struct(
            F.lit(k).alias("t"), literals(t.words).alias("words"), literals(t.key_places).alias("key"), literals(sorted({t.words[p] for p in t.key_places})).alias("key_words"),
            F.array(*(F.struct(F.lit(t.words[p]).alias("w"), F.lit(p).alias("p")) for p in x.places)).alias("by_idf"), F.lit(x.agree).alias("agree"),
            F.lit(t.least).alias("least"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
        ) for k, (t, x) in enumerate(zip(templates, postings, strict=True))
    ))
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    anchors = "|".join(sorted({x.anchor for x in postings}))
    has = F.col("l_text").rlike(f"(?i)(?<!{letter})(?:{anchors})(?!{letter})")
    rows = docs.select(F.col("doc_id").alias("l_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("l_text"))
    rows = rows.withColumn("l_words", F.when(has, words_of(F.col("l_text"))).otherwise(F.array().cast("array<string>"))).withColumn("l_table", table)
    words = F.col("l_words")
    rows = rows.withColumn("l_present", F.array_intersect(words, vocabulary))
    present = F.col("l_present")
    # templates whose key words the file has, with the postings of their rarest words that it has
    able = F.filter("l_table", lambda t: F.forall(t["key_words"], lambda w: F.array_contains(present, w)))
    have = F.transform(able, lambda t: F.struct(t["t"], t["agree"], t["least"], F.filter(t["by_idf"], lambda x: F.array_contains(present, x["w"])).alias("has")))
    enough = F.filter(have, lambda t: F.size(t["has"]) >= t["least"])
    chosen = F.flatten(F.transform(enough, lambda t: F.transform(
        F.slice(t["has"], F.lit(1), F.size(t["has"]) - t["least"] + t["agree"]), lambda x: F.struct(x["w"].alias("w"), t["t"].alias("t"), x["p"].alias("p")))))
    rows = rows.withColumn("l_chosen", F.when(F.size(present) > 0, chosen).otherwise(F.array().cast("array<struct<w:string,t:int,p:int>>")))
    rows = rows.withColumn("l_looked_up", F.array_distinct(F.transform("l_chosen", lambda c: c["w"])))
    found = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains("l_looked_up", w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumn("l_found", F.when(F.size("l_looked_up") > 0, found).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    proposed = F.flatten(F.transform("l_found", lambda x: F.transform(
        F.filter("l_chosen", lambda c: c["w"] == x["w"]), lambda c: F.struct(c["t"].alias("t"), (x["i"] - c["p"]).alias("s")))))
    rows = rows.withColumn("l_proposed", F.sort_array(proposed))
    # the intersection: equal proposals are neighbours, and there must be enough of them
    template = lambda c: F.get(F.col("l_table"), c["t"])
    all_ = F.col("l_proposed")
    agreed = F.filter(
        F.transform(all_, lambda c, i: F.when(c.eqNullSafe(F.get(all_, i + template(c)["agree"] - 1)) & ~c.eqNullSafe(F.get(all_, i - 1)), c)), lambda c: c.isNotNull()
    )
    rows = rows.withColumn("l_places", agreed)
    # a place before the text's first word is no index
    word_at = lambda i: F.when(i >= 0, F.get(words, i))
    hits = lambda c: F.size(F.filter(F.transform(template(c)["words"], lambda w, k: word_at(c["s"] + k).eqNullSafe(w)), lambda same: same))
    whole = lambda c: F.forall(template(c)["key"], lambda k: word_at(c["s"] + k).eqNullSafe(F.get(template(c)["words"], k)))
    verified = F.filter(
        F.transform("l_places", lambda c: F.struct(
            template(c)["label"].alias("label"), template(c)["base"].alias("base"), c["s"].alias("start"), hits(c).alias("hits"), F.size(template(c)["words"]).alias("size"),
            template(c)["least"].alias("least"), whole(c).alias("whole"))),
        lambda m: m["whole"] & (m["hits"] >= m["least"]),
    )
    rows = rows.withColumn("l_matches", verified)
    base = F.filter("l_matches", lambda m: m["base"])
    rows = rows.withColumn("l_base", base)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    # an expression that isn't deterministic keeps later filters from being copied out below it
    counted = F.when(F.monotonically_increasing_id() >= 0, F.size("l_base")).otherwise(0)
    return rows.select(
        F.col("l_id").alias("doc_id"),
        F.regexp_count("l_text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        counted.cast("long").alias("n_base"),
        F.array_min(F.transform("l_base", lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("l_base", lambda m: m["start"])).cast("long").alias("last_word"),
        names("l_base").alias("base_labels"),
        names("l_matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("l_matches", lambda m: m["hits"] / m["size"])), F.lit(0.0)).alias("score"),
        F.transform("l_matches", lambda m: F.struct(m["label"], m["start"], m["hits"], m["size"])).alias("matches"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result in DuckDB's SQL, from every template at every place."""
    rows = ", ".join(
        f"({k}, '{t.label}', {[*t.words]}, {[p + 1 for p in t.key_places] or '[]::INT[]'}, {t.least}, {str(t.base).lower()})" for k, t in enumerate(templates)
    )
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) v(t, label, tw, keys, least, base)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '') AS w
  FROM documents),
tokens AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
wanted AS (SELECT t, unnest(tw) AS word, unnest(range(len(tw))) AS p FROM templates),
placed AS (SELECT r, t, i - p AS start, count(*) AS hits, list(p + 1) AS got FROM tokens JOIN wanted USING (word) GROUP BY r, t, i - p),
matched AS (SELECT r, t, label, base, start, hits, len(tw) AS n FROM placed JOIN templates USING (t) WHERE hits >= least AND list_has_all(got, keys)),
summed AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(hits::DOUBLE / n) AS score
  FROM matched GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (r)
"""


ORACLE_SQL = oracle_sql()
