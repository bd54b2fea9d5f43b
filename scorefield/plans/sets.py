"""Queries of the set operations, checks and merges."""

from pyspark.sql import functions as F

from ..operators import sets as O
from .bindings import oracle, view
from .registry import query


def both(spark, sf_dir):
    return view(spark, sf_dir, "src_a"), view(spark, sf_dir, "src_b")


@query("s01_union_dedupe", oracle("SELECT DISTINCT c_custkey FROM (SELECT c_custkey FROM src_a UNION ALL SELECT c_custkey FROM src_b)"))
def s01(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.union_dedupe(a, b, ["c_custkey"]).select("c_custkey")


@query("s02_symmetric_diff", oracle("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.cents AS before, b.cents AS after, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM src_a a FULL JOIN src_b b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.cents IS DISTINCT FROM b.cents"""))
def s02(spark, sf_dir):
    return O.symmetric_diff(*both(spark, sf_dir), "c_custkey", "cents")


@query("s03_added_removed", oracle("SELECT c_custkey, 'added' AS change FROM src_b WHERE c_custkey NOT IN (SELECT c_custkey FROM src_a) UNION ALL SELECT c_custkey, 'removed' FROM src_a WHERE c_custkey NOT IN (SELECT c_custkey FROM src_b)"))
def s03(spark, sf_dir):
    return O.added_removed(*both(spark, sf_dir), "c_custkey")


@query("s04_union_first_wins", oracle("SELECT c_custkey, cents FROM src_b UNION ALL SELECT c_custkey, cents FROM src_a WHERE c_custkey NOT IN (SELECT c_custkey FROM src_b)"))
def s04(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.union_first_wins([b, a], ["c_custkey"]).select("c_custkey", "cents")


@query("s05_shared_keys", oracle("SELECT DISTINCT a.entity_id AS a, event_id FROM entries a JOIN entries b USING (event_id) WHERE b.entity_id = a.entity_id + 1"))
def s05_pairs(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    key = lambda c: F.struct(c.alias("a"), "event_id").alias("k")
    return O.shared_keys(e.select(key(F.col("entity_id"))), e.select(key(F.col("entity_id") - 1)), "k").select("k.*")


@query("s06_new_items", oracle("SELECT event_id, entity_id, period FROM scores WHERE period = 2 AND (event_id, entity_id) NOT IN (SELECT (event_id, entity_id) FROM scores WHERE period = 1)"))
def s06(spark, sf_dir):
    s = view(spark, sf_dir, "scores").select("event_id", "entity_id", "period")
    return O.new_items(s.where("period = 1"), s.where("period = 2"), ["event_id", "entity_id"])


@query("dq01_check_domain", oracle("SELECT 'quantity' AS rule, count(*) FILTER (NOT l_quantity <= 45) AS broken FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem"))
def dq01(spark, sf_dir):
    return O.check_domain(view(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") <= 45, "flag": F.col("l_returnflag").isin("A", "N")})


@query("dq02_check_unique", oracle("SELECT entity_id, season, kind, count(*) AS n FROM results GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def dq02(spark, sf_dir):
    return O.check_unique(view(spark, sf_dir, "results"), ["entity_id", "season", "kind"])


@query("dq02_check_exactly_one", oracle("SELECT c_custkey FROM src_b WHERE (c_mktsegment IS NOT NULL)::INT + (CASE WHEN c_custkey % 2 = 0 THEN 1 END IS NOT NULL)::INT <> 1"))
def dq02b(spark, sf_dir):
    b = view(spark, sf_dir, "src_b").withColumn("even", F.when(F.col("c_custkey") % 2 == 0, 1))
    return O.check_exactly_one(b, ["c_mktsegment", "even"]).select("c_custkey")


@query("dq03_check_fk", oracle("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)"))
def dq03(spark, sf_dir):
    return O.check_fk(view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "supplier").where("s_nationkey < 20"), {"l_suppkey": "s_suppkey"}).select("l_orderkey", "l_linenumber")


@query("dq04_check_interval", oracle("SELECT entry_id FROM results WHERE start_on + 3 - CAST(entry_id % 7 AS INT) < start_on"))
def dq04(spark, sf_dir):
    r = view(spark, sf_dir, "results").withColumn("end_on", F.date_add("start_on", (3 - F.col("entry_id") % 7).cast("int")))
    return O.check_interval(r, "start_on", "end_on").select("entry_id")


@query("dq05_check_immutable", oracle("SELECT a.c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM src_a a LEFT JOIN src_b b USING (c_custkey) WHERE b.c_custkey IS NULL OR a.cents IS DISTINCT FROM b.cents OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"))
def dq05(spark, sf_dir):
    return O.check_immutable(*both(spark, sf_dir), "c_custkey")


@query("dq07_tally", oracle("SELECT c_mktsegment, count(*) AS n FROM src_b GROUP BY 1"))
def dq07(spark, sf_dir):
    return O.tally(view(spark, sf_dir, "src_b"), "c_mktsegment")


@query("dq08_verify_hashes", oracle("SELECT doc_id, sha256(text) AS found, sha256(lang || text) AS sha256 FROM documents WHERE doc_id % 9 = 0"))
def dq08(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    registered = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("lang", "text")).otherwise(F.col("text")), 256).alias("sha256"))
    return O.verify_hashes(d, registered, "doc_id", "text")


@query("src06_register_captures", oracle("SELECT source, sha256(text) AS sha256, count(*) AS n, sha256(source || ':' || sha256(text)) AS capture_id, 'v1' AS parser_version FROM documents GROUP BY source, text"))
def src06(spark, sf_dir):
    return O.register_captures(view(spark, sf_dir, "documents"), "source", "text", "v1")


@query("snk01_publish_changed", oracle("SELECT b.c_custkey FROM src_b b LEFT JOIN src_a a USING (c_custkey) WHERE a.c_custkey IS NULL OR a.cents IS DISTINCT FROM b.cents OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"))
def snk01(spark, sf_dir):
    a, b = both(spark, sf_dir)
    _, manifest = O.publish_changed(a, b.select("c_custkey", F.lit("").alias("hash")), "c_custkey")
    return O.publish_changed(b, manifest, "c_custkey")[0].select("c_custkey")


@query("snk02_merge_upsert", oracle("""SELECT b.c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'inserted' WHEN a.cents IS DISTINCT FROM b.cents OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'updated' ELSE 'unchanged' END AS action FROM src_b b LEFT JOIN src_a a USING (c_custkey)"""))
def snk02(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.merge_upsert(a, b, "c_custkey", ["cents", "c_mktsegment"])[1].select("c_custkey", "action")


@query("snk02_merged_target", oracle("SELECT c_custkey, b.cents FROM src_b b UNION ALL SELECT c_custkey, cents FROM src_a WHERE c_custkey NOT IN (SELECT c_custkey FROM src_b)"))
def snk02b(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.merge_upsert(a, b, "c_custkey", ["cents", "c_mktsegment"])[0].select("c_custkey", "cents")


@query("snk03_change_ledger", oracle("""SELECT c_custkey, '{"cents":' || a.cents || '}' AS before, '{"cents":' || b.cents || '}' AS after FROM src_a a JOIN src_b b USING (c_custkey) WHERE a.cents <> b.cents"""))
def snk03(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.change_ledger(O.merge_upsert(a, b, "c_custkey", ["cents"])[1], "c_custkey")


@query("snk04_append_new", oracle("SELECT entity_id, entry_id FROM (SELECT entity_id, entry_id, row_number() OVER (PARTITION BY entity_id ORDER BY entry_id) AS k FROM results WHERE entity_id NOT IN (SELECT entity_id FROM results WHERE season = 1995)) WHERE k = 1"))
def snk04(spark, sf_dir):
    r = view(spark, sf_dir, "results").select("entity_id", "entry_id", "season")
    return O.append_new(r.where("season = 1995"), r, "entity_id", ["entry_id"]).select("entity_id", "entry_id")


@query("snk06_respect_natural_key", oracle("SELECT b.c_custkey FROM src_b b LEFT JOIN src_a a ON a.c_name = b.c_name WHERE a.c_custkey IS NULL OR a.c_custkey = b.c_custkey"))
def snk06(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.respect_natural_key(b, a, ["c_name"], "c_custkey").select("c_custkey")


@query("snk07_coalesce_merge", oracle("SELECT b.c_custkey, CASE WHEN b.c_custkey % 2 = 0 THEN coalesce(a.c_mktsegment, b.c_mktsegment) ELSE coalesce(b.c_mktsegment, a.c_mktsegment) END AS c_mktsegment FROM src_b b LEFT JOIN src_a a USING (c_custkey)"))
def snk07(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return O.coalesce_merge(b, a, "c_custkey", ["c_mktsegment"], F.col("c_custkey") % 2 == 0).select("c_custkey", "c_mktsegment")


@query("snk08_public_view", oracle("SELECT c_custkey, c_name FROM src_a"))
def snk08(spark, sf_dir):
    nested = view(spark, sf_dir, "src_a").select("c_custkey", F.struct("c_name", "cents").alias("who"), "c_mktsegment", "c_nationkey")
    return O.public_view(nested, {"who": ["cents"]}, ["c_mktsegment", "c_nationkey"]).select("c_custkey", "who.c_name")
