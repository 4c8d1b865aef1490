"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are license sentences; each has a mandatory key phrase. The document frequencies of the templates'
words over all files give their IDF. The index holds, per template, the postings (word, offset) of the two
highest-IDF words of its key phrase. A file is looked up by those of its words that the index holds; the
postings' relative positions (word position less offset) are intersected per template, and at each start that
remains the key phrase is verified word by word. Since the looked-up words belong to the key phrase, every
place of every key phrase is found. A place of a key phrase inside a place of a longer one (general public license, and the
same with its version) is dropped, but never one of a base template. The score is the IDF share of the whole template that stands in place.

The templates are a fixed list, so what reaches the driver (one count per template word) is bounded.
Null and empty texts have no words and no places; texts of any length are scanned whole; an empty table gives an empty result; repeated rows
and null doc_ids are scanned like any other; other columns are ignored, whatever their names. Of words with equal IDF the index takes the
first in the alphabet; of several places the score is the best one's; overlapping places of different templates all count.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str  # the whole sentence
    key: str  # the mandatory phrase, part of text
    base: bool = False


# License sentences and their key phrases.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("agpl", "gnu affero general public license version 3", "gnu affero general public license"),
    Template("apache-2", "http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("artistic-2", "the artistic license 2 0", "artistic license 2 0"),
    Template("boost", "boost software license version 1 0", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives"),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike"),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("lgpl", "gnu lesser general public license version 2 1", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Files, and files with each word of the vocabulary; over all of words(words array<string>)."""
    # one count per file beside the words', under a name that no word can have
    own = words.select(F.explode(F.concat(F.array_intersect("words", _strings(vocabulary)), F.array(F.lit("/")))).alias("word"))
    n = {row.word: row.n for row in own.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return n.get("/", 0), {w: n.get(w, 0) for w in vocabulary}


def _starts(word: str, offset: int) -> Column:
    """Where the phrase would start by each hit of one posting (word, offset)."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["place"] - offset)


def phrase_at(phrase: list[str], inside: list[str]) -> int | None:
    """Where a phrase first stands in another."""
    return next((i for i in range(len(inside) - len(phrase) + 1) if inside[i : i + len(phrase)] == phrase), None)


def longer(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(i, j, offset): the key phrase of template i, not a base one, stands within the longer one of template j."""
    keys = [t.key.split() for t in templates]
    pairs = ((i, j, phrase_at(keys[i], keys[j])) for i in range(len(keys)) for j in range(len(keys)) if len(keys[i]) < len(keys[j]) and not templates[i].base)
    return [(i, j, at) for i, j, at in pairs if at is not None]


def starts_of(template: Template, idf: dict[str, float]) -> Column:
    """array<int>: the verified key phrase's places, from `words` and `hits`."""
    key = template.key.split()
    found = None
    for word in sorted(set(key), key=lambda w: (-idf[w], w))[:2]:
        starts = _starts(word, key.index(word))
        found = starts if found is None else F.array_intersect(found, starts)
    return F.filter(found, lambda s: (s >= 0) & (F.slice("words", s + 1, len(key)) == _strings(key)))


def without_starts(starts: Column, others: Column, offset: int) -> Column:
    return F.filter(starts, lambda s: ~F.array_contains(others, s - offset))


def places(i: int, templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """array<struct<start long, score double, label, base>> of template i, from the starts of all in `at`."""
    template = templates[i]
    key, text = template.key.split(), template.text.split()
    shift, total, kept = phrase_at(key, text), sum(idf[w] for w in text), F.col("at")[i]
    for _, j, offset in (x for x in longer(templates) if x[0] == i):
        kept = without_starts(kept, F.col("at")[j], offset)

    def score(s: Column) -> Column:
        inside = [F.when(F.get("words", s - shift + j) == w, idf[w]).otherwise(0.0) for j, w in enumerate(text)]
        return sum(inside[1:], inside[0]) / total if template.text != template.key else F.lit(1.0)

    return F.transform(kept, lambda s: F.struct(s.cast("long").alias("start"), score(s).alias("score"), F.lit(template.label).alias("label"), F.lit(template.base).alias("base")))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places per row."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    files, df = document_frequencies(rows.select("words"), vocabulary)
    idf = {w: math.log((files + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    held = sorted({w for t in templates for w in sorted(set(t.key.split()), key=lambda w: (-idf[w], w))[:2]})
    hit = F.filter(F.transform("words", lambda w, i: F.when(w.isin(held), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    none = F.array().cast("array<struct<word:string,place:int>>")
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("words", _strings(held)), hit).otherwise(none))
    empty = F.array().cast("array<struct<start:bigint,score:double,label:string,base:boolean>>")
    rows = rows.withColumn("at", F.when(F.size("hits") > 0, F.array(*[starts_of(t, idf) for t in templates])))
    found = F.aggregate("at", F.lit(0), lambda n, x: n + F.size(x)) > 0
    every = F.when(found, F.concat(*[places(i, templates, idf) for i in range(len(templates))])).otherwise(empty)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), every.alias("places"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    rows = rows.withColumn("base", base)
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("places").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)), 6).alias("score"),
        F.size("places").cast("long").alias("n_places"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for scan_licenses over documents, from plain comparisons at every position."""
    rows = ", ".join(f"({i}, '{t.label}', '{t.text}', '{t.key}', {str(t.base).lower()})" for i, t in enumerate(templates))
    pairs = ", ".join(map(str, longer(templates)))
    sep = SEPARATORS
    return f"""
    WITH t(tid, label, body, key, base) AS (VALUES {rows}),
    tw AS (SELECT tid, label, base, string_split(body, ' ') AS body, string_split(key, ' ') AS key FROM t),
    vocabulary AS (SELECT DISTINCT unnest(body) AS word FROM tw),
    d AS (SELECT row_number() OVER () AS rid, doc_id,
          list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{sep}'), lambda x: x <> '') AS words FROM documents),
    df AS (SELECT v.word, count(DISTINCT d.rid) AS n FROM vocabulary v LEFT JOIN (SELECT rid, unnest(list_distinct(words)) AS word FROM d) d ON d.word = v.word GROUP BY v.word),
    idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (n + 1)) + 1 AS idf FROM df),
    longer(tid, other, shift) AS (VALUES {pairs}),
    every AS (SELECT rid, tid, label, base, body, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(key)] = key)) AS start, key, words FROM d, tw WHERE list_has_all(words, key)),
    place AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM longer l JOIN every x ON x.tid = l.other WHERE l.tid = e.tid AND x.rid = e.rid AND x.start = e.start - l.shift)),
    offs AS (SELECT tid, unnest(list_filter(range(len(body)), lambda i: body[i + 1 : i + len(key)] = key)[1:1]) AS shift, body FROM tw),
    part AS (SELECT p.rid, p.tid, p.start, w.j, p.body[w.j + 1] AS word, p.start - o.shift + w.j + 1 AS spot, p.words
             FROM place p JOIN offs o USING (tid) JOIN (SELECT tid, unnest(range(len(body))) AS j FROM tw) w USING (tid)),
    scored AS (SELECT rid, tid, start, sum(CASE WHEN spot >= 1 AND words[spot] = word THEN idf ELSE 0 END) / sum(idf) AS score FROM part JOIN idf USING (word) GROUP BY ALL),
    found AS (SELECT p.rid, p.label, p.base, p.start, s.score FROM place p JOIN scored s USING (rid, tid, start))
    SELECT d.doc_id, CAST(len(any_value(d.words)) AS BIGINT) AS n_words,
      count(*) FILTER (f.base) AS n_base, min(f.start) FILTER (f.base) AS first_word, max(f.start) FILTER (f.base) AS last_word,
      coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
      coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
      round(coalesce(max(f.score), 0), 6) AS score, count(f.label) AS n_places
    FROM d LEFT JOIN found f USING (rid) GROUP BY d.rid, d.doc_id
    """
