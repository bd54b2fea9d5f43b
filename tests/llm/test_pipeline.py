"""The pipeline's stages on a corpus with one planted case for each."""

import random

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_takes_effect(spark, tmp_path):
    r = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "l", "st", "m")]
    line = lambda n=12: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, "\n".join(line() for _ in range(6)), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, "\n".join(line() for _ in range(6)).upper().replace(" ", "!! "), "en", "s0") for i in range(30)]
    item = line(20)
    docs += [(300, "same first line of a few words here\n" + line(60), "en", "s1"), (301, "same first line of a few words here\n" + line(60), "en", "s1"), (302, f"{line(30)} {item} {line(30)}", "en", "s2"), (303, docs[3][1] + "\n", "en", "s2"), (304, None, "en", None)]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(not 200 <= d[0] < 300), 0) for d in docs[:150:2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
        left[name] = {x["doc_id"]: x for x in now.collect()}
        if name != "source_mixing":
            assert now.columns == frame.columns
    assert not any(200 <= i < 300 for i in left["quality_classifier"]) and set(range(120)) <= set(left["quality_classifier"])
    assert left["line_dedup"][300]["text"].startswith("same first") and not left["line_dedup"][301]["text"].startswith("same first")
    assert left["line_dedup"][303]["text"] == "" and left["line_dedup"][303]["n_chars"] == 0
    assert len({303, 304} & set(left["simhash_near_dedup"])) <= 1 and set(range(120)) <= set(left["simhash_near_dedup"])
    assert set(left["simhash_near_dedup"]) - set(left["benchmark_decontamination"]) == {302}
    assert set(left["source_mixing"]) == set(left["benchmark_decontamination"])
    assert {x["doc_id"]: x["taken"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: x["taken"] for i, x in left["source_mixing"].items()}


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables_and_odd_rows(spark, tmp_path, empty):
    """Null ids and texts, repeated rows and columns of clashing names pass every stage; so does an empty table."""
    line = "a few words that stand in one line"
    docs = [(i, f"{line} {chr(97 + i)}{i}\n{i} other words {i + 1} here", "en", "s", 5) for i in range(6)] + [(None, None, None, None, None), (None, line, "en", "s", 9), (3, "", "en", "s", 0), (3, "", "en", "s", 0)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as d", "'x' as known", "3 as gone"),
        "labels": spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, line + " a0"), (None, None)], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now.count()
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
        assert now.count() <= before and (name == "source_mixing" or now.columns == columns)
    assert (now.count() == 0) == (empty == "documents")


def test_other_columns_keep_their_values(spark, tmp_path):
    """Columns called like those that the stages work with."""
    names = ["d", "h", "doc", "_bad", "_hash", "n_lines", "n_removed", "node", "row", "score", "key", "bad_id", "gone"]
    docs = [(i, f"some words of document {i} and {i * 7}\nanother line {i} {i + 3} of it", "en", "s", 5, *(100 * i + k for k in range(len(names)))) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "document 3 and 21")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
        left = now.collect()
        assert left and now.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert all(tuple(r[n] for n in names) == tuple(100 * r["doc_id"] + k for k in range(len(names))) for r in left), name
    assert {r["doc_id"] for r in left} == set(range(8)) - {3}


def test_texts_go_to_python_in_small_batches(spark):
    """Near the end of a long pipeline an executor has little memory beside its heap."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "cast(id as string) as text")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus_pipeline.small_batches(spark)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(x["n"] for x in sizes) == 3000 and max(x["n"] for x in sizes) <= corpus_pipeline.BATCH_ROWS
