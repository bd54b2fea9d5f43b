"""Views that bind the generic operators to the test tables: one SQL text each, for Spark and for the oracle."""

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

VIEWS = {
    "scores": """SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS event_id, l_suppkey AS entity_id, l_linenumber AS period,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2, 3""",
    "totals": """SELECT event_id, entity_id, CAST(sum(score) AS BIGINT) AS total, count(*) AS periods,
        CASE WHEN count(*) >= 4 THEN 'finished' ELSE 'cut' END AS status FROM scores GROUP BY 1, 2""",
    "entries": """SELECT event_id, entity_id, total, periods, status, CAST(rank() OVER (PARTITION BY event_id ORDER BY total) AS BIGINT) AS position,
        make_date(CAST(event_id AS INT) DIV 100, CAST(event_id AS INT) % 100, 1) AS start_on FROM totals""",
    "cohort": """SELECT s_suppkey AS entity_id, r_name AS cohort FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "venue": """SELECT DISTINCT event_id, event_id % 12 AS venue_id FROM scores""",
    "ticks": """SELECT user_id AS entity, date_trunc('hour', ts) AS tick, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS moved,
        max(event_type) AS status, count(*) AS n FROM events GROUP BY 1, 2""",
    "states": """SELECT entity, tick, CAST(sum(moved) OVER (PARTITION BY entity ORDER BY tick) AS BIGINT) AS state, status, n FROM ticks""",
    "src_a": """SELECT c_custkey, c_name, c_nationkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment FROM customer""",
    "src_b": """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN cents + 1 ELSE cents END AS cents,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM src_a WHERE c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, cents, c_mktsegment FROM src_a WHERE c_custkey % 17 = 0""",
    "stats": """SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS BIGINT) AS season, o_orderpriority AS code, count(*) AS value,
        CASE WHEN count(*) > 1 THEN CAST(o_custkey % 50 + 1 AS BIGINT) END AS rank FROM orders GROUP BY 1, 2, 3""",
    "results": """SELECT o_orderkey AS entry_id, o_custkey AS entity_id, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(o_orderdate AS DATE) AS start_on,
        CAST(floor(o_totalprice) AS BIGINT) AS points, o_orderstatus AS status, o_orderpriority AS kind FROM orders""",
    "people": """SELECT c_custkey AS person, 'n' || (c_custkey % 12) || ' m' || (CASE WHEN c_custkey % 10 = 9 THEN c_custkey ELSE c_custkey % 5 END) AS name,
        CASE WHEN (c_custkey DIV 60) % 3 > 0 THEN make_date(1980, CAST(c_custkey % 12 + 1 AS INT), CAST((c_custkey DIV 60 + 1) DIV 2 % 28 + 1 AS INT)) END AS birth,
        CASE WHEN (c_custkey DIV 60) % 3 = 0 THEN CAST(1980 + c_custkey % 2 AS INT) END AS year FROM customer""",
    "sightings": """SELECT o_orderkey AS sighting, CAST(year(o_orderdate) AS BIGINT) AS event, o_custkey AS seen,
        CASE WHEN o_orderkey % 4 = 2 THEN 'm' || (CASE WHEN o_custkey % 10 = 9 THEN o_custkey ELSE o_custkey % 5 END) || ' N' || (o_custkey % 12) ELSE (CASE WHEN o_orderkey % 4 < 2 THEN 'N' ELSE 'x' END)
        || (o_custkey % 12) || ' m' || (CASE WHEN o_custkey % 10 = 9 THEN o_custkey ELSE o_custkey % 5 END) END AS name,
        CASE WHEN o_orderkey % 5 < 3 THEN make_date(1980, CAST(o_custkey % 12 + 1 AS INT), CAST((o_custkey DIV 60 + 1) DIV 2 % 28 + 1 AS INT))
        WHEN o_orderkey % 5 = 3 THEN make_date(CAST(1980 + o_orderkey % 2 AS INT), 6, 30) END AS birth FROM orders""",
    "probs": """SELECT l_orderkey AS event_id, l_linenumber AS entity_id, CAST(l_suppkey % 3 AS BIGINT) AS family, CAST(year(l_shipdate) AS BIGINT) AS season,
        CAST(round(l_discount * 100) AS BIGINT) * 10 + 1 AS mille, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hit FROM lineitem""",
}
NEEDS = {"totals": ["scores"], "entries": ["scores", "totals"], "venue": ["scores"], "states": ["ticks"], "src_b": ["src_a"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the views above."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    import re

    sql = VIEWS[name]
    used = [x for x in [*TABLES, *VIEWS] if re.search(rf"\b(FROM|JOIN) {x}\b", sql)]
    for x in used:
        sql = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", sql)
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in used})


def oracle(body: str) -> str:
    """SQL for the oracle: the views that the body names, as common table expressions, and the body."""
    import re

    named = [x for x in VIEWS if re.search(rf"\b{x}\b", body)]
    every = [x for x in VIEWS if any(x == y or x in NEEDS.get(y, []) for y in named)]
    views = ", ".join(f"{x} AS ({VIEWS[x].replace(' DIV ', ' // ')})" for x in every)
    if not views:
        return body
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
