"""Op 10: licence scan by a positional index of rare words, in DataFrame operations only.

Words are runs of digits, a-z (after lower-casing A-Z) and characters from U+0080 on. Licence templates are short
notices; their words are the index's vocabulary. How many documents hold each of these words is counted over the whole
corpus, and the rarer half of each template's words (at least three) is posted: word -> (template, position). Every
posted word of a file votes, for each of its postings, for the place where that template would have to begin. Where
enough of a template's postings agree on one place, and its mandatory key phrase stands there word for word, the file
gets the template's label. No licence of a file takes the votes of another, and no number of votes is too many.

The postings are a literal map of a few hundred entries, so the lookup and the votes on a document stay in its row
(array functions, in time linear in the file's words but for one sort of its votes) and nothing is shuffled but the word
counts, summed before. A document without any of the strings that every key phrase has one of (ANCHORS) can't match and
is passed by.

Defined cases: a null or empty text has no words and no labels, and its first and last word are null; rows that repeat are each
scanned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by label, each with its mandatory key phrase, in words as this module splits them.
TEMPLATES = [
    ("mit-notice", "released under the mit license", "under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", "under cc by nc"),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", "under cc by sa"),
    ("cc-by-4.0", "this work is licensed under cc by 4 0", "under cc by 4"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication license", "cc0 1 0 universal"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
]
#: Each key phrase and base phrase holds one of these; "cc by" has its own pattern.
ANCHORS = ("licens", "permission", "redistribution", "cc0", "unencumbered")
#: The same words as runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing; a class without negation is much faster in Java.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANCHOR = rf"(?i){'|'.join(ANCHORS)}|cc{_SPLIT}by"


def words(low: Column) -> Column:
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


def _low() -> Column:
    return lower_ascii(F.coalesce(F.col("text"), F.lit("")))


def _list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def document_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """For each word of the templates the documents that hold it: a row a word of the vocabulary at most."""
    known = F.expr(f"array_distinct(filter(own_words, w -> w in ({_list(vocabulary(templates))})))")
    held = docs.select(words(_low()).alias("own_words")).select(F.explode(known).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(templates, frequency: dict[str, int]) -> list[list[str]]:
    """For each template the rarer half of its words, three at least."""
    out = []
    for _, text, _ in templates:
        own = set(text.split())
        out.append(sorted(own, key=lambda w: (frequency.get(w, 0), w))[: max(3, len(own) // 2)])
    return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (share of agreeing postings of the best template)."""
    rare = rare_words(templates, document_counts(docs, templates))
    split = [(text.split(), phrase.split()) for _, text, phrase in templates]
    # a vote is the template's number times 2^40, plus 2^32, plus the word at which the template would begin
    codes: dict[str, list[int]] = {}
    for t, (text, _) in enumerate(split):
        for i, x in enumerate(text):
            if x in rare[t]:
                codes.setdefault(x, []).append((t << 40) + (1 << 32) - i)
    posted = [sum(x in rare[t] for x in text) for t, (text, _) in enumerate(split)]
    need = [max(2, n // 2) for n in posted]
    key_at = [next(i for i in range(len(text)) if text[i : i + len(key)] == key) for text, key in split]
    postings = "map(" + ", ".join(f"'{x}', array({', '.join(f'{c}L' for c in own)})" for x, own in codes.items()) + ")"
    of = lambda values: f"array({', '.join(values)})"
    t = "cast(shiftright(v, 40) as int)"

    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select("doc_id", text.alias("own_text"), F.regexp_like(text, F.lit(_ANCHOR)).alias("can_match"))
    row = row.select("doc_id", F.regexp_count("own_text", F.lit(_WORD)).cast("long").alias("n_words"), F.when(F.col("can_match"), words(lower_ascii(F.col("own_text")))).otherwise(F.array().cast("array<string>")).alias("w"))
    fits = {phrase: " and ".join(f"get(w, i + {k}) = '{x}'" if k else f"x = '{x}'" for k, x in enumerate(phrase.split())) for phrase in BASE}
    row = row.withColumns({f"own_b{n}": F.expr(f"filter(transform(w, (x, i) -> if({fits[p]}, i, null)), i -> i is not null)") for n, p in enumerate(BASE)})
    hits = f"filter(transform(w, (x, i) -> struct(x as x, i as i)), p -> p.x in ({_list(codes)}))"
    row = row.withColumns({"own_places": F.expr(f"concat({', '.join(f'own_b{n}' for n in range(len(BASE)))})"), "own_hits": F.expr(hits)})
    row = row.withColumn("own_votes", F.expr(f"sort_array(flatten(transform(own_hits, p -> transform({postings}[p.x], c -> c + p.i))))"))
    # votes that agree lie side by side; the first of enough of them stands for the place, with how many there are
    agreed = f"""filter(transform(own_votes, (v, k) -> if(not (k > 0 and get(own_votes, k - 1) = v) and get(own_votes, k + get({of(map(str, need))}, {t}) - 1) = v, named_struct(
        't', {t}, 'begin', cast(v % 1099511627776L - 4294967296L as int), 'n', aggregate(sequence(0, get({of(map(str, posted))}, {t}) - 1), 0, (n, m) -> n + if(get(own_votes, k + m) = v, 1, 0))), null)), s -> s is not null)"""
    row = row.withColumn("own_agreed", F.expr(agreed))
    phrases = of(of(f"'{x}'" for x in key) for _, key in split)
    start = f"s.begin + get({of(map(str, key_at))}, s.t)"
    row = row.withColumn("own_found", F.expr(f"filter(own_agreed, s -> {start} >= 0 and slice(w, greatest(1, {start} + 1), size(get({phrases}, s.t))) = get({phrases}, s.t))"))
    based = [F.when(F.size(f"own_b{n}") > 0, F.lit(label)) for n, label in enumerate(BASE.values())]
    joined = lambda xs: F.array_join(F.sort_array(F.array_distinct(xs)), ",")
    base = F.array_compact(F.array(*based))
    found = F.expr(f"transform(own_found, s -> get({of(f"'{label}'" for label, _, _ in templates)}, s.t))")
    best = F.expr(f"array_max(transform(own_found, s -> s.n / get({of(f'{n}D' for n in posted)}, s.t)))")
    return row.select(
        "doc_id", "n_words", F.size("own_places").cast("long").alias("n_base"), F.array_min("own_places").cast("long").alias("first_word"),
        F.array_max("own_places").cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def oracle(templates=TEMPLATES) -> str:
    """The same rows in DuckDB's SQL."""
    text = [(t, label, i, x) for t, (label, own, _) in enumerate(templates) for i, x in enumerate(own.split())]
    key = [(t, own.split(), phrase.split()) for t, (_, own, phrase) in enumerate(templates)]
    keys = [(t, next(i for i in range(len(own)) if own[i : i + len(k)] == k) + j, x) for t, own, k in key for j, x in enumerate(k)]
    values = lambda rows: ", ".join(f"({_list(r)})" for r in rows)
    base = [(phrase, label, i, x) for phrase, label in BASE.items() for i, x in enumerate(phrase.split())]
    return f"""
WITH tw(t, label, i, x) AS (VALUES {values(text)}), ky(t, i, x) AS (VALUES {values(keys)}), bs(p, label, i, x) AS (VALUES {values(base)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM d),
freq AS (SELECT v.x, count(DISTINCT r) AS n FROM (SELECT DISTINCT x FROM tw) v LEFT JOIN w ON w.x = v.x GROUP BY v.x),
rare AS (SELECT t, x FROM (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY n, x) AS k, count(*) OVER (PARTITION BY t) AS c FROM (SELECT DISTINCT t, x FROM tw) JOIN freq USING (x)) WHERE k <= greatest(3, c // 2)),
post AS (SELECT tw.t, tw.i, tw.x, count(*) OVER (PARTITION BY tw.t) AS posted FROM tw JOIN rare ON rare.t = tw.t AND rare.x = tw.x),
votes AS (SELECT w.r, post.t, w.i - post.i AS b, count(*) AS n, max(posted) AS posted FROM w JOIN post ON w.x = post.x GROUP BY ALL HAVING count(*) >= greatest(2, max(posted) // 2)),
kn AS (SELECT t, count(*) AS kn FROM ky GROUP BY t),
found AS (SELECT v.r, v.t, v.b, any_value(v.n) AS n, any_value(v.posted) AS posted FROM votes v JOIN ky ON ky.t = v.t JOIN w ON w.r = v.r AND w.i = v.b + ky.i AND w.x = ky.x JOIN kn ON kn.t = v.t GROUP BY v.r, v.t, v.b HAVING count(*) = max(kn)),
bn AS (SELECT p, count(*) AS bn FROM bs GROUP BY p),
bf AS (SELECT w.r, bs.p, bs.label, w.i - bs.i AS b FROM w JOIN bs ON w.x = bs.x JOIN bn ON bn.p = bs.p GROUP BY ALL HAVING count(*) = max(bn)),
bd AS (SELECT r, count(*) AS n_base, min(b) AS first_word, max(b) AS last_word FROM bf GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM bf) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM bf UNION SELECT f.r, tw.label FROM found f JOIN tw ON tw.t = f.t) GROUP BY r),
sc AS (SELECT r, max(n / posted::DOUBLE) AS score FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bd ON bd.r = d.r LEFT JOIN bl ON bl.r = d.r LEFT JOIN al ON al.r = d.r LEFT JOIN sc ON sc.r = d.r
"""
