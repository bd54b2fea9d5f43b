"""The pipeline's near-copy stage against brute force: all pairs, exact Jaccard similarity of five-word shingles."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def similar(a, b):
    both = len(a & b)
    return both * 5 >= (len(a) + len(b) - both) * 4


def kept_by_brute_force(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(docs)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                links += 1
                a, b = sorted((top(i), top(j)), key=lambda x: docs[x][0])
                root[b] = a
    return {docs[i][0] for i in range(len(docs)) if top(i) == i}, links


def planted(seed=11, n=150):
    """Texts with edited copies around the similarity 0.8, chains of copies of copies, and short, empty and null texts."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nlrstm"]
    docs = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(60, 300))]
        docs.append((10 * i, " ".join(text)))
        for k in range(1, r.randint(1, 4)):
            for _ in range(max(1, round(len(text) * r.choice([0.005, 0.01, 0.018, 0.022, 0.03])))):
                text[r.randrange(len(text))] = "edit" + r.choice(words)
            docs.append((10 * i + k, " ".join(text)))
    base = [r.choice(words) for _ in range(120)]
    for k in range(60):
        text = list(base)
        for _ in range(r.randint(1, 4)):
            text[r.randrange(120)] = f"x{k}"
        docs.append((5000 + k, " ".join(text)))
    return docs + [(9000, ""), (9001, None), (9002, " \n"), (9003, "two words"), (9004, "Two  words"), (9005, "words two"), (9006, docs[0][1].upper())]


def test_near_copies_equal_brute_force(spark):
    docs = planted()
    want, links = kept_by_brute_force(docs)
    assert links > 300
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.simhash_near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    got = [x["doc_id"] for x in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_documents_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "g h i j k l"), (None, None)], "doc_id long, text string")
    got = corpus_pipeline.simhash_near_dedup(spark, frame, "")
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in got.collect()) == [(-1, ""), (1, "a b c d e f"), (1, "g h i j k l")]
    assert corpus_pipeline.simhash_near_dedup(spark, frame.where("false"), "").count() == 0


def test_near_copies_by_fingerprint(spark):
    """SimHash counts repeats: a text that is nearly all one repeated line links by its fingerprint, though the sets differ."""
    from scorefield.llm import minhash, simhash

    tail = lambda k: " ".join(f"tail{k}x{i}" for i in range(12))
    docs = [(k, "again the same five words " * 200 + tail(k)) for k in range(3)] + [(None, tail(7)), (9, tail(8))]
    assert not similar(shingles(docs[0][1]), shingles(docs[1][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len({r["c"] for r in simhash.near_groups(frame, minhash.SHINGLE).collect()}) == 3
    assert sorted((r["doc_id"] for r in minhash.drop_near_copies(frame).collect()), key=str) == [0, 9, None]
