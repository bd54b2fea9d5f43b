"""Phrase collocation mining by relations of occurrences (SETM).

A relation of occurrences holds (place, item) sorted by place. Places number the words of a chunk of texts; where a piece
ends a number is left out, so that two words of one piece are neighbours if and only if their places differ by one. Each
level is a persisted table:

1. the relation of words is written, and beside it how often each word occurs in each chunk; words are counted over all chunks;
2. the frequent ones go back to the chunks that hold them (semi-join), and the others leave the relation;
3. the relation is merge-joined with itself at adjacent places, which gives phrases one word longer; they are written and
   counted, and so on from 2.

A phrase of k words is named by the two phrases of k - 1 words that it starts and ends with, so identities are exact and no
hash stands for a phrase. What is shuffled is one row a chunk and phrase, however often the chunk repeats it.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_class, chunks, discard, materialize, read_table, row_base, shared_dir, text_bytes, words_of

LEAST, LONGEST, MOST, INSIDE = 10, 3, 2000, 50
#: Bytes of text of a chunk, and occurrences of a relation in one row of its table.
CHUNK, SLICE = 8 << 20, 1 << 15
#: Parts in which a language's best phrases are found before they meet.
SALTS = 64
BREAKS = ~byte_class(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
WORD = byte_class((0x20, 0x20), (0x09, 0x09)) & ~BREAKS
#: Words of the filter of frequent phrases, 64 bits each: 4 MiB whatever their number. A fuller filter lets more rows go on to the semi-join, and loses none.
FILTER_BITS = 19
#: Frequent groups that go to all tasks at most (some 100 MB).
BROADCAST = 2_000_000
RELATION = "chunk long, seq int, many int, item binary, place binary"
NAMES = ["chunk", "seq", "many", "item", "place", "key"]


def _blobs(values: np.ndarray, cuts: list[int]) -> pa.Array:
    """Each slice compressed, its first bytes before its second ones and so on, since the last ones are nearly all zero."""
    planes = [np.ascontiguousarray(values[lo : lo + SLICE].astype("<i4").view(np.uint8).reshape(-1, 4).T) for lo in cuts]
    return pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in planes], pa.binary())


def _values(relation: pa.Table, column: str, order: np.ndarray) -> np.ndarray:
    sizes = relation["many"].to_numpy() * 4
    planes = [np.frombuffer(pa.decompress(relation[column][int(i)].as_buffer(), int(sizes[i]), "zstd"), np.uint8).reshape(4, -1) for i in order]
    return np.concatenate([np.ascontiguousarray(x.T).view("<i4").ravel() for x in planes]).astype(np.int64)


def _relation(chunk: int, item: np.ndarray, place: np.ndarray, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """The rows of a relation, places as steps from the one before; the columns of counted groups are null."""
    cuts = list(range(0, len(item), SLICE))
    many = [min(SLICE, len(item) - lo) for lo in cuts]
    given = [pa.array([chunk] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array(many, pa.int32()), _blobs(item, cuts), _blobs(np.diff(place, prepend=0), cuts), pa.nulls(len(cuts), pa.int32())]
    return pa.RecordBatch.from_arrays([*given, *(pa.nulls(len(cuts), k) for k in kinds)], [*NAMES, *names])


def _counted(chunk: int, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A row for each group of a chunk; its key is its number there."""
    n = len(columns[0])
    given = [pa.array(np.full(n, chunk)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32))]
    return pa.RecordBatch.from_arrays([*given, *columns], [*NAMES, *names])


def _words(batches):
    """The relation of words of each chunk, and its words by language."""
    names, kinds = ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()]
    chunk = row_base()
    for part in chunks(batches, most=CHUNK):
        text, lang = part.column(0), part.column(1).dictionary_encode()
        words = words_of(text, WORD, True)
        if not len(words.start):
            continue
        data, _ = text_bytes(text)
        broken = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAKS[data], out=broken[1:])
        of = words.text_of()
        ends = (np.diff(broken[words.start]) > 0) | (np.diff(of) > 0)
        place = np.arange(len(of))
        place[1:] += np.cumsum(ends)
        at = np.zeros(len(of) + 1, np.int64)
        np.cumsum(words.end - words.start, out=at[1:])
        spelled = pa.LargeStringArray.from_buffers(len(of), pa.py_buffer(at), pa.py_buffer(LOWER[data[WORD[data]]])).dictionary_encode()
        known = len(spelled.dictionary)
        both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of] * known + spelled.indices.to_numpy(zero_copy_only=False)
        groups, item, n = np.unique(both, return_inverse=True, return_counts=True)
        yield _relation(chunk, item, place, kinds, names)
        columns = [lang.dictionary.take(pa.array(groups // known)), spelled.dictionary.take(pa.array(groups % known)).cast(pa.string()), pa.array(n)]
        yield _counted(chunk, columns, names)
        chunk += 1


def _extend(relation: pa.Table, frequent: pa.Table) -> pa.Table:
    """The relation of a chunk without its infrequent items, merge-joined with itself at adjacent places. frequent: key, id."""
    names, kinds = ["left", "right", "n"], [pa.int64()] * 3
    empty = _relation(0, np.zeros(0, np.int32), np.zeros(0, np.int32), kinds, names)
    if not relation.num_rows or not frequent.num_rows:
        return pa.Table.from_batches([empty])
    chunk = relation["chunk"][0].as_py()
    order = np.argsort(relation["seq"].to_numpy())
    item, place = _values(relation, "item", order), np.cumsum(_values(relation, "place", order))
    by_id = np.argsort(frequent["id"].to_numpy())
    ids = frequent["id"].to_numpy()[by_id]
    local = np.full(item.max() + 1, -1, np.int64)
    local[frequent["key"].to_numpy()[by_id]] = np.arange(len(ids))
    item = local[item]
    item, place = item[item >= 0], place[item >= 0]
    next_to = np.flatnonzero(np.diff(place) == 1)  # both sides are sorted by place, so the partner of a row is the row after it
    groups, longer, n = np.unique(item[next_to] * len(ids) + item[next_to + 1], return_inverse=True, return_counts=True)
    columns = [pa.array(ids[groups // len(ids)]), pa.array(ids[groups % len(ids)]), pa.array(n)]
    return pa.Table.from_batches([_relation(chunk, longer, place[next_to], kinds, names), _counted(chunk, columns, names)])


def _persist(df: DataFrame, name: str) -> DataFrame:
    """A level: the rows of the relation and those of the counted groups. Groups come sorted, so that differences are small."""
    spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more. The shuffle files of jobs that are done go once the driver's garbage is
    collected, which an idle heap puts off for long; so it is asked for."""
    for table in tables:
        discard(table)
    spark._jvm.System.gc()


def _frequent(counts: DataFrame, by: list[str], least: int) -> DataFrame:
    """The groups that occur often enough over all chunks, numbered."""
    found = counts.groupBy(*by).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "frequent-phrases")


def _semi_join(counts: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """of (the chunk), key and id of the groups of each chunk that are frequent. These go to all tasks if they are so few; else a
    filter of fixed size does, and the rows it lets through are shuffled."""
    ids = found.select(*by, "id")
    if found.count() <= BROADCAST:
        hit = counts.join(F.broadcast(ids), by)
    else:
        h = F.xxhash64(*by)
        slot, bit = F.shiftrightunsigned(h, 64 - FILTER_BITS).alias("slot"), F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(by)}) & 63 as int))")
        slots = found.groupBy(slot).agg(F.bit_or(bit).alias("bits"))
        hit = counts.join(F.broadcast(slots), slot == slots["slot"]).where(F.col("bits").bitwiseAND(bit) != 0).drop("slot", "bits").join(ids, by)
    return hit.select(F.col("chunk").alias("of"), "key", "id")


def _phrases(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """id, lang, words, a and the counts of all first parts (firsts) and last parts (rests) by length. found: id, left, right, a."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), "firsts")
    right = shorter.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), "rests")
    both = found.join(left, "left").join(right, "right")
    return both.select("id", "left", "right", "lang", F.concat("w", F.array("last")).alias("words"), "a", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("rests", F.array("a")).alias("rests"))


def _lowest_cut(words: int) -> Column:
    """score, k, l and r of the cut that scores lowest. Counts are under 10**15, so that all products are exact decimals."""
    wide = lambda c: c.cast("decimal(15,0)")
    a = wide(F.col("a"))
    cuts = []
    for k in range(1, words):
        l, r = F.col("firsts")[k - 1], F.col("rests")[words - k - 1]
        score = F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), wide(l) * wide(r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of 2 to longest words of each language.

    a is how often the phrase occurs inside pieces, l and r how often the parts of its lowest-scoring cut do, n the words of
    the language. Phrases found fewer than least times are no candidates, and one that a longer candidate holds goes if that
    occurs at inside percent of its own count or more. Null texts are empty, a null language is und, texts of blanks and
    breaks give nothing and an empty table no rows. Repeated rows count each, and texts of any length are taken whole.
    Phrases of one score go by a and then by their bytes; of cuts of one score the first counts. Other columns are ignored.
    """
    spark = documents.sparkSession
    given = documents.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    level = _persist(given.mapInArrow(_words, f"{RELATION}, key int, lang string, word string, n long"), "word-occurrences")
    by, levels = ["lang", "word"], {}
    counts = level.where("key is not null").select("chunk", "key", *by, "n")
    n = materialize(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words-of-languages")
    found = _frequent(counts, by, least)
    known = found.select("id", "lang", F.array("word").alias("words"), "a", F.array("a").alias("firsts"), F.array("a").alias("rests"))
    for k in range(2, longest + 1):
        kept = _semi_join(counts, found, by)
        relation = level.where("seq is not null").select("chunk", "seq", "many", "item", "place")
        longer = relation.groupBy("chunk").cogroup(kept.groupBy("of")).applyInArrow(_extend, f"{RELATION}, key int, left long, right long, n long")
        before, level = level, _persist(longer, "phrase-occurrences")
        _let_go(spark, before)
        by = ["left", "right"]
        counts = level.where("key is not null").select("chunk", "key", *by, "n")
        found = _frequent(counts, by, least)
        _let_go(spark)
        known = levels[k] = materialize(_phrases(found, known), "phrases")
    _let_go(spark, level)
    best = None
    for k, phrases in levels.items():
        if k < longest:  # any longer candidate that holds a phrase is no more frequent than the one of its words that is one word longer
            held = levels[k + 1].selectExpr("left as id", "a as within").unionByName(levels[k + 1].selectExpr("right as id", "a as within"))
            phrases = phrases.join(held.groupBy("id").agg(F.max("within").alias("within")), "id", "left").where(F.coalesce(F.col("within"), F.lit(0)) * 100 < F.col("a") * inside)
        scored = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a", _lowest_cut(k).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        best = scored if best is None else best.unionByName(scored)
    order = "order by score desc, a desc, phrase"
    near = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("k", F.expr(f"row_number() over (partition by lang, salt {order})")).where(F.col("k") <= most)
    ranked = near.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as bigint)")).where(F.col("rank") <= most)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(w) AS w, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, j, fl.a AS l, fr.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (fl.a::HUGEINT * fr.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(c.w[1:j], ' ') JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(c.w[j + 1:], ' ')),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
held AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS within FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN held ON low.k = 2 AND held.lang = low.lang AND held.phrase = low.phrase WHERE o = 1 AND coalesce(100 * within, 0) < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
