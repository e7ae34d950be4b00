"""The pipeline's stages against plain versions, on a small folder of tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from potentia.llm import tokens


def sentences(rng, n):
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    return ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    docs = []
    for i in range(300):
        clean = sentences(rng, rng.randint(3, 12))
        docs.append((i, clean if i % 5 else clean.upper().replace(" ", "!! ")))
    docs += [(1000 + i, docs[i][1]) for i in range(1, 40)] + [(2000 + i, docs[i][1].replace(" ", "  ", 1).replace(".", ". " + "Zzz", 1) if i % 5 else docs[i][1]) for i in range(41, 60)]
    docs += [(3000, docs[1][1]), (3000, docs[1][1])]
    rows = [(i, t, "en", f"s{i % 3}" if i % 3 else "hot", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [[tuple(r) for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
    whole, good, exact, near, mixed = kept
    assert sorted(good) == sorted(r for r in whole if "!!" not in r[1])
    largest = {}
    for r in good:
        largest[r[1].lower()] = max(largest.get(r[1].lower(), -1), r[0])
    assert Counter(r[0] for r in exact) == Counter(largest.values())
    sets = {r[0]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in exact if (w := re.findall(r"\w+", r[1].lower()))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r[0] for r in near) == sorted({find(x) for x in sets})
    assert sorted(near) == sorted(mixed)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encode = tokens.encoder(tokens.vocabulary())
    want = Counter()
    for r in mixed:
        want[r[0]] += len(encode(r[1])) + 1
    got, filled = Counter(), Counter()
    for p in packed:
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert got == want and max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(want.values()) // 2048) + 1
    run = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.length) for r in run.collect()) == Counter((r.doc_id, r.piece, r.length) for r in packed)
