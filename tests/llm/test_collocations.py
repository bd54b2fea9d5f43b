"""Collocations against a count by hand, on texts with nulls, blanks, breaks, repeats and chunks of any size."""

import collections
import random
import re

import pytest

from scorefield.llm import collocations as C

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, most, inside):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["New", "york", "of", "the", "Éa", "x", "𝒳y", "-", "a-b", "\x01"])
    text = lambda k: "".join(word() + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(k))
    docs = [(text(r.randint(0, 60)), r.choice(["en", "de", None, "und", ""])) for _ in range(80)]
    docs += [(None, "en"), ("", None), (" \t .!", "de"), ("one", "fr"), (text(4000), "en")]
    return docs + [docs[3]] * 12 + [("new york city", "en")] * 15 + [("to be or", "zz")] * 10


@pytest.mark.parametrize("chunk, piece, sent", [(4 << 20, 1 << 15, 1 << 20), (200, 7, 3)])
@pytest.mark.parametrize("longest, inside, most", [(3, 50, 2000), (4, 90, 6), (2, 50, 2000)])
def test_collocations(spark, monkeypatch, chunk, piece, sent, longest, inside, most):
    docs = texts()
    given = spark.createDataFrame([(t, l, 7, "w") for t, l in docs], "text string, lang string, n int, word string").repartition(3)
    scan = C._words

    def small(batches):
        monkey_chunk, monkey_slice = chunk, piece
        C.CHUNK, C.SLICE = monkey_chunk, monkey_slice
        yield from scan(batches)

    monkeypatch.setattr(C, "_words", small)
    monkeypatch.setattr(C, "BROADCAST", sent)  # beyond it by way of a filter and a shuffle
    got = [tuple(r) for r in C.collocations(given, 10, longest, most, inside).collect()]
    assert sorted(got) == brute(docs, 10, longest, most, inside)
    assert got


def test_ties_of_cuts_go_to_the_first(spark):
    docs = [("a b c", "en")] * 12
    assert [tuple(r) for r in C.collocations(spark.createDataFrame(docs, "text string, lang string")).collect()] == [("en", 1, "a b c", 12, 12, 12, 36, 1000000)]


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    a, l, r = 123_456_789_012_345, 234_567_890_123_456, 345_678_901_234_567
    row = spark.createDataFrame([(a, [l, a], [r, a])], "a long, firsts array<long>, rests array<long>").select(C._lowest_cut(2).alias("c")).select(F.col("c.score")).first()
    assert row[0] == 1000000 * a * a // (l * r)


def test_nothing(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).count() == 0
