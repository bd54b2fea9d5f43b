"""Each operator against a brute-force version, on tables with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scorefield.llm import chat, decontaminate, embeddings, lines, mixing, quality, simhash, spans, substrings, toxicity
from scorefield.llm.common import connected_components
from scorefield.llm.suffix_array import common_prefixes, suffix_array

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed: int = 5, n: int = 60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ri", "Éo", "ßu", "ne", "lo", "x"]) for _ in range(r.randint(1, 4)))
    text = lambda k: "".join(word() + r.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(k))
    passage = text(45)
    out = [text(r.randint(0, 90)) for _ in range(n)]
    for i in range(0, n, 4):
        out[i] = out[i] + passage + out[(i * 7) % n]
    out[5], out[6], out[7] = out[4], out[4] + " more", None
    out[8], out[9], out[10] = "", " \n\t ", "one two"
    out[11] = "the the " * 200 + text(30)
    out[12] = text(4000) + passage
    out[13] = "a" * 5000
    out[14] = out[12]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if i % 3 else None, "d") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, d string").repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def brute_windows(units, size):
    """units: doc -> list. Which positions are covered by a window that starts earlier too."""
    seen, gone = set(), collections.defaultdict(set)
    for d in sorted(units):
        for i in range(len(units[d]) - size + 1):
            w = tuple(units[d][i : i + size]) if isinstance(units[d], list) else units[d][i : i + size]
            if w in seen:
                gone[d].update(range(i, i + size))
            seen.add(w)
    return gone


def test_substrings(docs, nothing):
    words = {i: SPACE.findall(t or "") for i, t in corpus()}
    gone = brute_windows(words, 20)
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(docs).collect()}
    assert len(got) == len(words)
    for d, w in words.items():
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(gone[d])), d
        assert got[d]["kept"] == " ".join(x for i, x in enumerate(w) if i not in gone[d])
    assert substrings.dedup_substrings(nothing).count() == 0


def test_substrings_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (None, "x " + t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in substrings.dedup_substrings(df).collect())
    assert got == [(False, 0, 0), (True, 1, 30), (True, 1, 30), (True, 2, 30)]


@pytest.mark.parametrize("shard", [spans.SHARD_BYTES, 150])
def test_spans(docs, nothing, shard):
    data = {i: (t or "").encode() for i, t in corpus()}
    gone = brute_windows(data, 100)
    got = {r["doc_id"]: r for r in spans.dedup_spans(docs, shard_bytes=shard).collect()}
    for d, b in data.items():
        kept = bytes(x for i, x in enumerate(b) if i not in gone[d])
        runs = sum(1 for i in gone[d] if i - 1 not in gone[d])
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(b), len(gone[d]), runs), d
        assert bytes(got[d]["kept"]) == kept
    assert spans.dedup_spans(nothing).count() == 0


def test_suffix_array():
    r = np.random.default_rng(3)
    for trial in range(150):
        n, k = int(r.integers(1, 120)), int(r.integers(1, 5))
        t = np.append(r.integers(1, k + 1, n), 0)
        if trial % 3 == 0:
            t = np.append(np.tile(t[: max(1, n // 5)], 6)[:n], 0)
        s = [tuple(t[i:]) for i in range(len(t))]
        want = sorted(range(len(t)), key=s.__getitem__)
        sa = suffix_array(t)
        assert list(sa) == want
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert list(common_prefixes(t, sa)) == [0] + [share(s[a], s[b]) for a, b in zip(want, want[1:])]


def test_suffix_array_recurses(monkeypatch):
    """Text of a quarter MiB: the named strings are sorted by the same induction, level by level."""
    from scorefield.llm import suffix_array as module

    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(900)]
    raw = " ".join(r.choice(words) for _ in range(60_000)).encode()[: 1 << 18]
    raw = raw + raw[5000:25_000]
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    sizes = []
    monkeypatch.setattr(module, "suffix_array", lambda x: sizes.append(len(x)) or suffix_array(x))
    sa = suffix_array(t)
    assert len(sizes) >= 3 and all(b <= a // 2 + 1 for a, b in zip([len(t), *sizes], sizes))
    rank = np.empty(len(t), np.int64)
    rank[sa] = np.arange(len(t))
    a, b = sa[:-1], sa[1:]  # neighbours are in order: by their first symbol, then by the ranks of what follows
    after = np.append(rank, -1)
    assert (np.sort(sa) == np.arange(len(t))).all() and ((t[a] < t[b]) | ((t[a] == t[b]) & (after[a + 1] < after[b + 1]))).all()


def test_spans_of_repeated_and_null_ids(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, "x" + t), (2, t), (None, None), (3, "")], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in spans.dedup_spans(df).collect())
    n = len(t)
    assert got == sorted([("None", n + 1, 0), ("1", n, n), ("1", n, n), ("2", n, n), ("None", 0, 0), ("3", 0, 0)])


def test_decontamination_of_common_windows_and_odd_ids(spark):
    """A window that many items share, with items of null and equal ids, and documents of null and equal ids."""
    shared = " ".join(f"s{i}" for i in "abcdefghij")
    items = [(i, f"{shared} own{chr(97 + i)}") for i in range(20)] + [(None, shared), (3, "other words of a repeated item here and there again now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, shared), (1, shared + " ownb"), (None, "x " + shared), (None, None), (2, "clean"), (4, "other words of a repeated item here and there again now " + shared)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(0)), bench)
    every = sorted(str(i) for i in range(20))
    want = sorted([("1", 10, every), ("1", 11, every), ("None", 10, every), ("None", 0, []), ("2", 0, []), ("4", 21, every)])
    assert sorted((str(r["doc_id"]), r["n_hit"], r["items"]) for r in got.collect()) == want


def test_decontamination(spark, docs, nothing):
    texts = dict(corpus())
    long = LETTERS.findall((texts[0] or "").translate(LOW))
    items = [(7, "?? " + " , ".join(long[3:16]).upper() + " zzz"), (71, " ".join(long[4:15])), (8, "one two"), (9, ""), (10, None), (11, "qq qq qq"), (12, " ".join(f"k{i}" for i in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for k, t in items:
        w = LETTERS.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    for d, t in texts.items():
        w, hit, held = LETTERS.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    held |= windows[x]
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"], got[d]["contaminated"]) == (len(w), len(hit), sorted(held), bool(hit)), d
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d in texts if not got[d]["contaminated"]}


def fingerprint(t):
    w = SPACE.findall((t or "").translate(LOW))
    s = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(s))


def components(n, linked):
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i]] + [root[j] for j in range(n) if linked[i][j]]) for i in range(n)]
        if new == root:
            return root
        root = new


def test_simhash(docs, nothing, spark):
    texts = corpus()
    fp = np.array([fingerprint(t) for _, t in texts], np.uint64)
    root = components(len(fp), np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["fingerprint"] & (1 << 64) - 1 for i, _ in texts] == [int(x) for x in fp]
    assert [got[i]["component_id"] for i, _ in texts] == root
    assert simhash.near_duplicates(nothing).count() == 0
    again = spark.createDataFrame([(3, "x y"), (3, "x y"), (None, "x y"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(again).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_null_ids_are_no_node(spark):
    """Two texts that nothing links, each with a near copy of null id; and one id with two texts."""
    a, b = "alpha beta gamma delta epsilon " * 30, "one two three four five six seven " * 30
    docs = spark.createDataFrame([(1, a), (None, a), (2, b), (None, b), (9, "x"), (9, "y"), (None, "z w")], "doc_id long, text string")
    assert fingerprint(a) != fingerprint(b)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (1, 1), (2, 2), (9, 9), (9, 9)]
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [0.01, 1.0]), (None, [-1.0, 0.0]), (8, [-1.0, -1.0]), (8, [1.0, -1.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_duplicates(vectors).collect())
    assert got == [(0, 0, 0, False), (0, 1, 1, False), (0, 1, 2, False), (1, 1, 1, True), (2, 1, 2, True), (8, 0, 8, True), (8, 0, 8, True)]


def test_vectors_of_any_finite_size_link(spark):
    sizes = [1e200, 1e-200, 1.0, 1e308, 5e-324]
    rows = [(i, [x, x], 0) for i, x in enumerate(sizes)] + [(10 + i, [x, -x], 0) for i, x in enumerate(sizes)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(i, 4, 0) for i in range(5)] + [(10 + i, 4, 10) for i in range(5)]


def near_values(many=60):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, many, dtype=np.int64).view(np.uint64)
    sparse = base & np.uint64(0xFF) if many > 30 else base
    near = [b ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(x) for x in r.choice(64, k, False)] or [np.uint64(0)]) for k in range(7) for b in (base if k % 2 else sparse)]
    return np.unique(np.array(near, np.uint64))


def groups_of(root):
    return sorted(sorted(np.flatnonzero(np.asarray(root) == v)) for v in set(root))


@pytest.mark.parametrize("tile", [16, 64, 1024])
def test_simhash_tiles_are_exact(tile):
    """One shard, ordered by population count: tile pairs are skipped, and no link is lost."""
    near = near_values()
    near = near[np.argsort(np.bitwise_count(near), kind="stable")]
    for a in near:
        close = near[np.bitwise_count(near ^ a) <= 4]
        for masks in (np.array([m[0] for m in simhash.blocks(4)], np.int64), np.array([x for m in simhash.blocks(4) for x in m[1:]], np.int64)):
            assert (((close[:, None] & masks.view(np.uint64)) == (a & masks.view(np.uint64))).any(axis=1)).all()
    group = np.zeros(len(near), int)
    many = -(-len(near) // tile)
    compared = len(list(simhash.tile_pairs(group, np.bitwise_count(near).astype(int), 4, tile)))
    assert compared < many * (many + 1) // 2 or tile == 1024
    root = np.arange(len(near))
    at, to = simhash.linked(group, near, 4, tile)
    root[at] = to
    assert groups_of(root) == groups_of(components(len(near), np.bitwise_count(near[:, None] ^ near[None, :]) <= 4))


@pytest.mark.parametrize("crowded", [2, 10**6])
def test_simhash_crowded_shards(spark, crowded):
    near = near_values(25)
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(near.view(np.int64))], "fingerprint long, node long")
    found = connected_components(simhash.links(rows, 4, 16, crowded)).collect()
    root = list(range(len(near)))
    for x in found:
        root[x["node"]] = x["component_id"]
    assert root == components(len(near), np.bitwise_count(near[:, None] ^ near[None, :]) <= 4)


def test_simhash_query(spark, tmp_path):
    rows = [*corpus(), (3, "again here"), (None, "one two"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x["fingerprint"], -1 if x["doc_id"] is None else x["doc_id"], x["component_id"]) for x in simhash.op4_simhash_near_dedup(spark, str(tmp_path)).collect())
    fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = components(len(fp), np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    least = {v: min((rows[i][0] for i in range(len(rows)) if root[i] == v and rows[i][0] is not None), default=None) for v in set(root)}
    assert got == sorted((f"{int(f):016x}", -1 if d is None else d, least[v]) for (d, _), f, v in zip(rows, fp, root))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(400, 400 + i) for i in range(1, 50)]
    linked = np.zeros((500, 500), bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    want = components(500, linked)
    got = {x["node"]: x["component_id"] for x in connected_components(spark.createDataFrame(edges + [(7, None)], "a long, b long")).collect()}
    assert all(want[n] == c for n, c in got.items()) and {n for e in edges if e[0] != e[1] for n in e} == set(got)


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(8, 16))
    rows = []
    for i in range(260):
        v = base[i % 8] + r.normal(size=16) * r.choice([0.05, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (304, None, 0), (305, [0.0] * 16, 0), (306, [float("nan")] + [1.0] * 15, 0), (307, [None] + [1.0] * 15, 0), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0), (310, [], 0), (311, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    good = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in good:
        for j in good:
            a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                linked[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    root = components(n, linked)
    for tile in (2048, 40):
        got = {x["vec_id"]: x for x in embeddings.near_duplicates(df, tile=tile).collect()}
        for i, row in enumerate(rows):
            g = got[row[0]]
            assert (g["n_links"], g["component_id"], g["kept"]) == (int(linked[i].sum()), rows[root[i]][0], root[i] == i), row[0]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_in_double_precision(spark):
    """A cosine just above the threshold links, one just below it doesn't; shared and null vec_ids, and a clashing column."""
    rows = [(1, [-1.0, 0.0], 0)]
    for i, c in enumerate((0.93 + 2e-9, 0.93 - 2e-9)):
        rows.append((2 + i, [-c, float(np.sqrt(1 - c * c))], 0))
    rows += [(7, [0.0, 1.0, 0.0], 5), (7, [0.0, 1.0, 1e-9], 5), (None, [0.0, 2.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("tile", F.lit("x"))
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(-1, 2, 7, False), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (7, 2, 7, True), (7, 2, 7, True)]


def test_embedding_tiles_are_told_apart_on_more_axes(spark):
    """A wide label: fewer tile pairs than all, and than one axis would leave."""
    r = np.random.default_rng(5)
    n, tile = 4000, 50
    angle = r.uniform(0, np.pi, (n, 2))
    x = np.stack([np.cos(angle[:, 0]), np.sin(angle[:, 0]) * np.cos(2 * angle[:, 1]), np.sin(angle[:, 0]) * np.sin(2 * angle[:, 1]), np.zeros(n)], axis=1)
    bins = np.floor(x / embeddings.BIN).astype(int).tolist()
    placed = spark.createDataFrame([(0, 4, *b, i) for i, b in enumerate(bins)], "label int, dim int, b0 int, b1 int, b2 int, b3 int, cid long")
    put = embeddings.tiled(placed, tile).persist()
    sizes = [x["count"] for x in put.groupBy("tile").count().collect()]
    many = len(sizes)
    assert max(sizes) <= 2 * tile and sum(sizes) == n
    pairs = {(p["ta"], p["tb"]) for p in embeddings.tile_pairs(put, 0.93).collect()}
    one = embeddings.tile_pairs(put.drop("b1", "b2", "b3"), 0.93).count()
    assert len(pairs) < one < many * (many + 1) // 2 and len(pairs) < many * (many + 1) // 4
    of = {p["cid"]: p["tile"] for p in put.collect()}
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert all((min(of[i], of[j]), max(of[i], of[j])) in pairs for i, j in zip(a.tolist()[::37], b.tolist()[::37]))


def test_lines(docs, nothing, spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 40))) for _ in range(25)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(6):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(r.choice(["", " ", "x\t"]) + " ".join(w))
        rows.append((d, "\n".join(out + [""] * (d % 3))))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("x"))
    seen, want = [], {}
    for d, t in sorted(rows):
        kept, gone = [], 0
        for line in (t or "").split("\n") if t is not None else []:
            w = SPACE.findall(line)
            s = frozenset(w)
            if s and any(len(s & o) * 5 >= len(s | o) * 4 for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        want[d] = (None if t is None else "\n".join(kept), gone)
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in lines.dedup_lines(df).collect()}
    assert got == want
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "d", "n_lines", "n_removed"]
    assert lines.dedup_lines(nothing).count() == 0


def brute_lines(rows):
    """doc_id -> how many of its lines an earlier line equals or resembles."""
    seen, gone = [], collections.Counter()
    for d, t in sorted(rows, key=lambda x: x[0]):
        for s in (frozenset(SPACE.findall(line)) for line in t.split("\n")):
            gone[d] += bool(s) and any(len(s & o) * 5 >= len(s | o) * 4 for o in seen)
            seen += [s] if s else []
    return {d: n for d, n in gone.items() if n}


def test_a_changed_word_in_twenty(spark):
    twenty = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(twenty)), (2, " ".join(twenty[:-1] + ["other"])), (3, "a b c d"), (4, "a b c d e"), (5, "a b c"), (6, "c b a a"), (7, "a b"), (8, " ".join(reversed(twenty)) + "\tw3")]
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 1}


@pytest.mark.parametrize("heavy", [1, 4, 10**6])
def test_common_tokens_meet_by_their_first_line(spark, monkeypatch, heavy):
    """Words that all lines share, near copies among them, and lines of common words only; every way through the join."""
    r = random.Random(3)
    shared = [f"s{i}" for i in range(14)]
    rows = []
    for k in range(90):
        w = r.sample(shared, r.randint(3, 14)) + [f"{k % 30}x{i}" for i in range(r.choice([0, 0, 1, 2, 8]))]
        w += [f"y{r.randrange(9)}" for _ in range(r.choice([0, 1, 2]))]
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(lines, "HEAVY", heavy)
    monkeypatch.setattr(lines, "LEAST", 1)
    monkeypatch.setattr(lines, "SLOT_BITS", 8)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 40)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == brute_lines(rows)


def test_near_copies_of_a_line_make_few_pairs(spark, monkeypatch):
    """200 lines that all resemble each other, each with two words of its own: no pair of all with all is made."""
    rows = [(k, " ".join([f"w{i}" for i in range(38)] + [f"own{k}", f"own{k}x"])) for k in range(200)]
    made, write = [], lines.materialize

    def counted(df, name, **options):
        table = write(df, name, **options)
        made.append(table.count() if name == "line-pairs" else 0)
        return table

    monkeypatch.setattr(lines, "materialize", counted)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").count()
    assert got == 199 and sum(made) <= 20 * len(rows)


def test_lines_of_large_keys_meet_by_two_keys(spark, monkeypatch):
    """Lines share every single word with many others, but two of them with few: no row is left to meet all lines of its keys."""
    r = random.Random(5)
    rows = [(k, " ".join(f"{'abcdefghijklmnopqrst'[i]}{r.randrange(12)}" for i in range(20))) for k in range(400)]
    rows += [(1000 + k, rows[k][1].replace(rows[k][1].split()[7], "other")) for k in range(0, 400, 20)]
    large, left, write = [], [], lines.materialize

    def counted(df, name, **options):
        table = write(df, name, **options)
        large.append(table.where("rank is not null").count() if name == "met-lines" else 0)
        left.append(table.count() if name == "open-lines" else 0)
        return table

    monkeypatch.setattr(lines, "HEAVY", 2)
    monkeypatch.setattr(lines, "materialize", counted)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == brute_lines(rows) and len(got) == 20
    assert max(large) > 200 and sum(left) < 20


def test_prefixes_hold_what_similar_lines_share(spark):
    """For all sizes: a token within the first k + 1 of a window is shared, and the least shared numbers allow three at once."""
    n, m = F.col("n").cast("int"), F.col("m").cast("int")
    sizes = spark.range(4, 400).withColumnRenamed("id", "n").join(spark.range(4, 500).withColumnRenamed("id", "m"), F.expr("least(n, m) * 5 >= greatest(n, m) * 4"))
    sizes = sizes.select(n.alias("n"), m.alias("m"))
    assert sizes.where(n - lines.window(n) != F.expr(lines.outside("n"))).count() == 0
    least = F.expr(lines.needed("n", "m"))
    assert sizes.where((lines.window(n) - least > lines.lacking(n)) | (least < lines.DEPTH)).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(1, "a b c\nd"), (1, "d\ne f"), (None, "e f"), (None, None), (2, long), (3, long + " v"), (3, None)]
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(str(x["doc_id"]), x["text"] and x["text"][:9], x["n_lines"], x["n_removed"]) for x in done]
    assert ("3", "", 1, 1) in got and ("3", None, 0, 0) in got and ("None", "e f", 1, 0) in got and ("2", "u0 u1 u2 ", 1, 0) in got


def test_mixing(spark, docs, nothing):
    got = mixing.mix_sources(docs).toPandas()
    size = {i: len(SPACE.findall(t or "")) for i, t in corpus()}
    assert dict(zip(got.doc_id, got["size"])) == size
    total = sum(size.values())
    s = sum(v for i, v in size.items() if i % 3)
    want = {"src": min(2 * s, 1.5 * total * 5 / 7), None: 0}
    want[None] = min(2 * (total - s), 1.5 * total - want["src"])
    want["src"] = 1.5 * total - want[None]
    for name, part in (("src", got[got.source == "src"]), (None, got[got.source.isna()])):
        assert abs(part.target.iloc[0] - want[name]) < 1e-6 and part.taken.sum() == int(part.target.iloc[0] + 1e-9)
    assert ((got.taken >= 0) & (got.taken <= 2 * got["size"])).all()
    again = mixing.mix_sources(docs.repartition(2)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))
    assert mixing.mix_sources(nothing).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice(["\\", "#", "<", "### ", "</turn>", ":", " ", "é", "ab", "\n", "\\\\"]) for _ in range(r.randint(0, 12)))
    rows = [(c, t, r.choice(["user", "assistant", "a:b\\", None]), r.choice([text(), None])) for c in range(30) for t in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (5, 2, "assistant", "tie"), (5, 2, "assistant", "tie"), (6, 9, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    got = {x["conv_id"]: x for x in chat.digest_conversations(chat.format_turns(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t, role or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda z: (z[0], z[1].encode(), z[2].encode()))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_turns(df.limit(0)).count() == 0


def labelled(spark, n=900):
    r = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    bad = ["vile", "grim", "foul"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(3, 120))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        for _ in range(r.randint(1, 3) * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "en"]))
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "x " * 60_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    return d, spark.createDataFrame(labels + [(n, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.97
    assert got[900] == got[901] < 0.7 and len(model[0]) < 500
    assert {x["doc_id"]: x["score"] for x in toxicity.score(docs.repartition(7), model).collect()} == got
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert len(toxicity.train(docs, labels.limit(0).select("doc_id", "toxic"))[0]) == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels.where("doc_id % 3 <> 1").select("doc_id", "quality"))
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.3) == (i % 7 != 0) for i in held]) > 0.98
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 903
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.drop_low_quality(docs, labels.select("doc_id", "quality"))
    assert kept.columns == docs.columns and 700 < kept.count() < 800
    only = quality.train(docs, labels.where("quality = 1").select("doc_id", "quality"))
    assert all(x["score"] >= 0.3 for x in quality.score(docs, only).collect())


def test_ftrl_is_the_plain_loop():
    """The weights of a coordinate-by-coordinate loop over the published update rules."""
    r = random.Random(3)
    examples = [(np.array(sorted(r.sample(range(40), r.randint(0, 12))), np.int64), float(r.random() < 0.4)) for _ in range(200)]
    index, weights, bias = toxicity.learn(examples, 3)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i != "bias" and abs(z[i]) <= toxicity.L1:
            return 0.0
        shrunk = z[i] if i == "bias" else z[i] - (1 if z[i] > 0 else -1) * toxicity.L1
        return -shrunk / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + (0 if i == "bias" else toxicity.L2))

    for _ in range(3):
        for x, y in examples:
            held = {i: weight(i) for i in [*x.tolist(), "bias"]}
            g = 1 / (1 + np.exp(-sum(held.values()))) - y
            for i, w in held.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w
                n[i] += g * g
    want = {i: w for i in range(40) if (w := weight(i))}
    assert set(index.tolist()) == set(want) and len(want) > 3
    assert np.allclose(weights, [want[i] for i in index.tolist()], atol=1e-9, rtol=0) and abs(bias - weight("bias")) < 1e-9


def test_bradley_terry_is_at_the_minimum_of_its_loss():
    """Gradient descent on the written-out loss of the same pairs ends at the same weights."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(60, len(quality.NAMES))), r.normal(size=(60, 3))], axis=1)
    y = (x[:, 0] + 0.5 * x[:, 14] + r.normal(size=60) > 0).astype(float)
    w, _ = quality.fit(x, y, 2)
    pick = np.random.default_rng(7)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    pairs = list(zip(pick.choice(good, 120).tolist(), pick.choice(bad, 120).tolist()))
    z = x / x.std(axis=0)
    ridge = [quality.RIDGE] * len(quality.NAMES) + [quality.HASHED_RIDGE] * 3
    v = np.zeros(x.shape[1])
    for _ in range(20_000):
        step = np.array(ridge) * v
        d = np.array([z[a] - z[b] for a, b in pairs])
        step += ((1 / (1 + np.exp(-d @ v)) - 1)[:, None] * d).mean(axis=0)
        v -= 0.3 * step
        if np.abs(step).max() < 1e-12:
            break
    assert np.allclose(w, v / x.std(axis=0), atol=1e-9, rtol=0)


def test_samples_are_bounded_whatever_repeats(spark):
    from scorefield.llm.common import labelled_sample

    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text").unionByName(spark.range(3000).selectExpr("7L as doc_id", "concat('r', id % 50) as text"))
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "'x' as text").unionByName(spark.createDataFrame([(7, 0, "x"), (None, 1, "x"), (8, None, "x")], "doc_id long, quality int, text string"))
    got = labelled_sample(docs, labels, "quality", 100).collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 100 and len(got) > 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, labelled_sample(docs.repartition(7), labels, "quality", 100).collect()))
    every = {r["doc_id"]: r["quality"] for r in labelled_sample(docs, labels, "quality", 10_000).collect()}
    assert every == {i: i % 2 for i in range(500)}


@pytest.mark.parametrize("name", ["op1_toxicity", "op6_quality_classifier"])
def test_classifier_queries(spark, tmp_path, name):
    """Rows, hold-out and predictions of the registered queries; repeated and null ids, empty tables."""
    import zlib

    from scorefield.llm.queries import QUERIES

    docs, labels = labelled(spark, 300)
    extra = spark.createDataFrame([(5, "again"), (None, "no id"), (None, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    many, remainder, cut = (3, 1, 0.7) if name == "op1_toxicity" else (5, 0, 0.3)
    assert len(got) == 306 and sum(r["doc_id"] is None for r in got) == 2
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % many == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_mixing_of_many_sources_and_odd_ids(spark):
    """Four sources, one of empty texts only; repeated and null ids."""
    rows = [(i % 40 if i % 9 else None, " ".join(["w"] * (i % 23)), f"s{i % 3}") for i in range(200)] + [(900 + i, "" if i else None, "z") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == len(rows) and ((got.taken >= 0) & (got.taken <= 2 * got["size"])).all()
    by = collections.Counter()
    for _, t, source in rows:
        by[source] += len((t or "").split())
    mixed = {s: got[(got.source_size == n) & (got.target > 0)].target.iloc[0] for s, n in by.items() if n}
    assert abs(sum(mixed.values()) - min(1.5, 2) * sum(by.values())) < 1e-6
    assert abs(got.taken.sum() - 1.5 * sum(by.values())) <= 4


def test_the_shared_folder(spark, monkeypatch):
    """A session of one process takes a folder of its own; a cluster without spark.checkpoint.dir is an error."""
    from types import SimpleNamespace

    from scorefield.llm.common import shared_dir

    said = lambda master, found: SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="a1", getConf=lambda: {"spark.checkpoint.dir": found} if found else {}))
    assert shared_dir(said("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_dir(said("local[4]", None)) == shared_dir(said("local", None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            shared_dir(said(master, None))


def test_sql_of_the_queries(spark):
    """The registered SQL gives the rows of the registered queries on the smallest tables."""
    import glob
    import os

    from scorefield.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf).toPandas(), c.sql(sql).df()
        key = sorted(got.columns)
        assert key == sorted(want.columns)
        a, b = (x[key].astype(str).sort_values(key).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name
