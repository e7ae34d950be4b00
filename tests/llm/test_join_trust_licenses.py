import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from potentia.llm import licenses, link_trust, ngram_join


def corpus():
    """Groups of near copies of several sizes, exact copies, shared passages, and odd rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(40)]
    docs = []
    for size in (2, 3, 12, 40):
        first = [word() for _ in range(120)]
        for _ in range(size):
            own = list(first)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own))
    for _ in range(40):
        docs.append(" ".join([*shared, *(word() for _ in range(60))]))
    docs += [docs[0]] * 5 + [docs[3].upper()] * 2 + [None, "", "one", "ONE", "one two three", "x " * 30_000, "..."]
    return [(i, t) for i, t in enumerate(docs)] + [(3, docs[3]), (None, docs[1])]


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("options", [{}, {"block": 7, "broadcast_rows": 0}, {"bucket": 5, "block_shingles": 600}])
def test_links_and_classes_against_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "class": F.lit("x"), "hash": F.lit(2), "n": F.lit(3)}).repartition(5)
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(k)
    want = Counter()
    for own in classes.values():
        least = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        want.update((rows[k][0], least, links[k]) for k in own)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.report(df, **options).collect()) == want
    kept = ngram_join.drop_near_duplicates(df, **options)
    assert kept.columns == df.columns
    got = [shingles(r.text) for r in kept.collect()]
    assert len(got) == len(classes)
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    for own in classes.values():
        assert sum(texts[rows[k]] > 0 for k in {rows[k]: k for k in own}.values()) == 1


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.report(none).count() == 0 == ngram_join.drop_near_duplicates(none).count()


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.8, 0.9995, 1)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    key = lambda x: x.to_bytes(4, "big")
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges if a != b], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in ngram_join.components(df).collect()}
    assert got == {key(x): key(find(x)) for e in edges if e[0] != e[1] for x in e}


def test_components_write_files_by_rows(spark, monkeypatch):
    """Each checkpoint file costs an executor several processes (chmod), so few edges go to few files."""
    edges = spark.range(1, 1001).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 10).alias("b"))
    files, cut = [], ngram_join.cut

    def counted(df):
        df = cut(df)
        files.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(ngram_join, "cut", counted)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        found = ngram_join.components(edges)
        assert {(r.node, r.root) for r in found.collect()} == {(k, k - k % 10) for k in range(0, 1001) if k != 1000}
    finally:
        spark.conf.set(key, before)
    assert len(files) > 2 and set(files[1:]) == {1}


def ranks_by_hand(pages, links, damping, steps):
    """d / (d + max(t, 1)) of each host; walks restart where they end."""
    hosts = sorted({h for h, _ in pages if h} | {x for e in links for x in e})

    def walk(own, edges):
        total = sum(own.values())
        if not total:
            return dict.fromkeys(hosts, 0.0)
        v = {h: own[h] / total for h in hosts}
        out = Counter()
        for (a, _), w in edges.items():
            out[a] += w
        x = dict(v)
        for _ in range(steps):
            lost = sum(x[h] for h in hosts if not out[h])
            new = {h: (1 - damping + damping * lost) * v[h] for h in hosts}
            for (a, b), w in edges.items():
                new[b] += damping * x[a] * w / out[a]
            x = new
        return x

    seeds = lambda *actions: Counter(h for h, action in pages if h and action in actions)
    turned = {(b, a): w for (a, b), w in links.items()}
    every = seeds("allow", "block", None)
    trust, ahead, distrust, behind = walk(seeds("allow"), links), walk(every, links), walk(seeds("block"), turned), walk(every, turned)
    d = {h: distrust[h] / behind[h] if behind[h] else 0.0 for h in hosts}
    t = {h: trust[h] / ahead[h] if ahead[h] else 0.0 for h in hosts}
    return {h: d[h] / (d[h] + max(t[h], 1)) for h in hosts}


def assert_same_in_sql(rows, pages, rules=link_trust.RULES):
    """DuckDB's rows of the same pages are equal, ranks included."""
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    if pages:
        duck.executemany("insert into pages values (?, ?, ?)", pages)
    found = duck.execute(link_trust.oracle(rules))
    assert [x[0] for x in found.description] == ["page_id", "host", "path", "rule", "verdict", "distrust_share"]
    assert sorted(found.fetchall(), key=repr) == sorted(map(tuple, rows), key=repr)


PAGES = [
    (1, "https://good.com/a", '<a href="https://friend.org/x">f</a> <a href=/own>o</a>'), (2, "http://friend.org/", "<a href='//good.com/'>g</a>"),
    (3, "https://bad.net/es/1", None), (4, "https://bad.net/de/1", '<a href="https://bad.net/es/2">b</a>'), (5, "https://feeder.org/p?x#y", '<A HREF="HTTP://BAD.NET/es/9">'),
    (6, "https://feeder.org", '<a href="http://bad.net/">x</a>'), (7, "https://WWW.example.com/en/1", ""), (8, "https://example.com/en/2?q", None), (9, "https://a.example.com/en", None),
    (10, None, None), (11, "no scheme", "<a href='http://good.com'>"), (12, "https://bad.net/es/3", None), (5, "https://feeder.org/p?x#y", '<A HREF="HTTP://BAD.NET/es/9">'), (13, "x://bad.net/fr/", None), (14, "https://bad.net/fr/2", None),
]


def test_link_trust_against_a_plain_version(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("z"), "src": F.lit(1), "trust": F.lit(2)})
    rows = link_trust.judge(df).collect()
    assert len(rows) == len(PAGES)

    def parse(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def rule(h, p):
        fits = [(len(r), a, r) for a, r in link_trust.RULES if (h == (at := r.split("/")[0]) or h.endswith("." + at)) and p.startswith("/" + r.split("/", 1)[1])]
        return max(fits)[1:] if fits else (None, None)

    links = Counter()
    for _, url, html in PAGES:
        own = parse(url)[0]
        targets = {parse(x if ":" in x.split("/")[0] else "http:" + x)[0] for x in re.findall(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)""", html or "")}
        links.update((own, t) for t in targets if own and t and t != own)
    hosts = {parse(u)[0] for _, u, _ in PAGES} - {""}
    for h in hosts:
        parent = h.partition(".")[2]
        if parent in hosts:
            links[h, parent] += 1
            links[parent, h] += 1
    share = ranks_by_hand([(parse(u)[0], rule(*parse(u))[0]) for _, u, _ in PAGES], links, 0.85, 300)
    for r in rows:
        url = next(u for i, u, _ in PAGES if i == r.page_id)
        h, p = parse(url)
        action, text = rule(h, p)
        assert (r.host, r.path, r.rule) == (h, p, text)
        assert r.verdict == (action or ("block" if share.get(h, 0) > 0.5 else "allow"))
        assert r.distrust_share == pytest.approx(share.get(h, 0.0), abs=1e-4)
    assert {r.page_id: r.verdict for r in rows}[4] == "block"
    assert_same_in_sql(rows, PAGES)
    assert_same_in_sql([], [])
    assert link_trust.judge(df.limit(0)).count() == 0


def test_distrust_reaches_far_hosts(spark):
    page = lambda k: (k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">')
    pages = [page(k) for k in range(24)] + [(24, "http://h24.org/x", None)]
    rules = [("block", "h24.org/"), ("allow", "h30.org/")]
    links = Counter({(f"h{k}.org", f"h{k + 1}.org"): 1 for k in range(24)})
    share = ranks_by_hand([(f"h{k}.org", "block" if k == 24 else None) for k in range(25)], links, 0.85, 300)
    rows = link_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    for r in rows:
        assert r.distrust_share == pytest.approx(share[r.host], abs=1e-3)
    assert min(r.distrust_share for r in rows) > 0
    assert_same_in_sql(rows, pages, rules)


def test_links_decide_between_hosts_without_rules(spark):
    """Hosts of the same make-up, none of them under a rule: those that link to blocked hosts are blocked, those that trusted ones link to aren't."""
    rng = random.Random(6)
    pages, n = [], 0

    def page(h, *to):
        nonlocal n
        n += 1
        pages.append((n, f"http://{h}/p{n}", "".join(f'<a href="https://{x}/">x</a>' for x in to)))

    for k in range(12):
        page(f"good{k}.com", *(f"friend{j}.org" for j in rng.sample(range(12), 4)))
        page(f"bad{k}.net", *(f"bad{j}.net" for j in rng.sample(range(12), 2)))
        page(f"feeder{k}.org", *(f"bad{j}.net" for j in rng.sample(range(12), 4)))
        page(f"friend{k}.org", f"good{rng.randrange(12)}.com")
        page(f"torn{k}.org", f"bad{k}.net", *(f"friend{j}.org" for j in rng.sample(range(12), 6)))
        page(f"alone{k}.org")
    rules = [("allow", "com/"), ("block", "net/")]
    rows = link_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    links = Counter((h, x) for _, url, html in pages for h in [url.split("/")[2]] for x in set(re.findall("https://([^/]*)", html)) if x != h)
    share = ranks_by_hand([(url.split("/")[2], {"com": "allow", "net": "block"}.get(url.split("/")[2].rpartition(".")[2])) for _, url, _ in pages], links, 0.85, 300)
    for r in rows:
        assert r.distrust_share == pytest.approx(share[r.host], abs=1e-4)
        if r.rule is None:
            assert r.verdict == ("block" if share[r.host] > 0.5 else "allow")
            assert r.host[:4] == "torn" or r.verdict == ("block" if r.host.startswith("feeder") else "allow")
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    assert_same_in_sql(rows, pages, rules)


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
LICENSED = [
    None, "", "plain text", "Released under the MIT License.", "mit mit license apache license MIT-License", "Licensed under the Apache License, Version 2.0.", "occ cc by CC-BY, accc by",
    "This work is licensed under the GNU General Public License, version 3", NOTICE, "free of charge: permission is granted", "Été " * 40_000 + "Released under the MIT License", "Licensed under CC BY-NC 4.0", "the gnu lesser general public license",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " * 3,
]


def test_licenses(spark):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string").withColumns({"w": F.lit(1), "labels": F.lit("x")})
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(LICENSED):
        words = pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items() if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    label = lambda i: rows[i].labels
    assert label(3) == "mit,mit-notice" and label(5) == "apache,apache-2.0" and label(7) == "gpl,gpl-3.0" and label(8) == "mit-text"
    assert label(9) == "" and label(11) == "cc-by,cc-by-nc" and label(10) == "mit,mit-notice" and "lgpl" in label(13)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_that_share_a_file(spark):
    notice = {label: text for label, text, _ in licenses.TEMPLATES}
    files = [list(notice), ["mit-text", "bsd", "apache-2.0"], ["bsd", "mit-text", "mit-notice"], ["gpl-text", "mit-text", "apache-text", "cc-by-nc"]]
    words = " ".join(licenses.vocabulary())
    texts = [". ".join(text for _, text, _ in licenses.TEMPLATES)] + [f". {words}. {words}. ".join(notice[x] for x in own) for own in files[1:]]
    rows = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, own in enumerate(files):
        assert set(own) <= set(rows[i]), set(own) - set(rows[i])


def test_every_key_phrase_has_an_anchor():
    for phrase in [*licenses.BASE, *(p for _, _, p in licenses.TEMPLATES)]:
        assert any(a in phrase for a in licenses.ANCHORS) or "cc by" in phrase


def labels_by_hand(texts):
    """Word counts, votes and key phrases, place by place."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    files = [pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    held = Counter(x for f in files for x in set(f))
    out = []
    for f in files:
        labels, score = {label for p, label in licenses.BASE.items() if any(f[k : k + len(p.split())] == p.split() for k in range(len(f)))}, 0.0
        for label, text, phrase in licenses.TEMPLATES:
            own, key = text.split(), phrase.split()
            rare = sorted(set(own), key=lambda w: (held[w], w))[: max(3, len(set(own)) // 2)]
            posted = [i for i, x in enumerate(own) if x in rare]
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            for begin in range(-len(own), len(f)):
                n = sum(0 <= begin + i < len(f) and f[begin + i] == own[i] for i in posted)
                if n >= max(2, len(posted) // 2) and begin + at >= 0 and f[begin + at : begin + at + len(key)] == key:
                    labels.add(label)
                    score = max(score, n / len(posted))
        out.append((",".join(sorted(labels)), score))
    return out


def test_license_labels_against_a_plain_version(spark):
    rng = random.Random(8)
    texts = [None, "", ". ".join(text for _, text, _ in licenses.TEMPLATES), "cc by " * 300]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            how = rng.random()
            if how < 0.3:
                own = own[rng.randrange(len(own)) :] + own[: rng.randrange(len(own))]
            elif how < 0.6:
                own[rng.randrange(len(own))] = rng.choice(["x", "the", "license"])
            parts.append(" ".join(w.title() if rng.random() < 0.2 else w for w in own))
        texts.append(rng.choice([" ", ". É ", "\n"]).join(parts))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, (labels, score) in enumerate(labels_by_hand(texts)):
        assert got[i][0] == labels and got[i][1] == pytest.approx(score)
    assert len(set(labels_by_hand(texts)[2][0].split(","))) == len({label for label, _, _ in licenses.TEMPLATES} | set(licenses.BASE.values()))
