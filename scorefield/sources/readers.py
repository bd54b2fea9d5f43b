"""Readers of semi-structured sources into rows. Paths are whatever Spark reads."""

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUNDLE = "event_id string, competitors array<struct<id:string, status:string, linescores:array<struct<period:int, value:double>>>>"
ELEMENT = "id long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def scan(spark: SparkSession, path: str, cols: Sequence[str], where=None, order: str | None = None) -> DataFrame:
    """A pruned scan; the predicate goes down to the files."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*cols) if order is None else df.select(*cols).orderBy(order)


def flatten_bundle(df: DataFrame, column: str | None = None, schema: str = BUNDLE) -> DataFrame:
    """event_id, entity_id, status, period and value of nested bundles; entities without scores keep one row with nulls."""
    if column is not None:
        df = df.select(F.from_json(column, schema).alias("_b")).select("_b.*")
    c = df.select("event_id", F.explode_outer("competitors").alias("_c"))
    s = c.select("event_id", F.col("_c.id").alias("entity_id"), F.col("_c.status").alias("status"), F.explode_outer("_c.linescores").alias("_s"))
    return s.select("event_id", "entity_id", "status", F.col("_s.period").alias("period"), F.col("_s.value").alias("value"))


def extract_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, position, href of each link."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("position", "href"))


def extract_title(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"))


#: A tag and the text up to the next one; a "<" that begins no tag is text.
TOKEN = r"<[a-zA-Z/!][^>]*>[^<]*(?:<(?![a-zA-Z/!])[^<]*)*"
#: The most columns and rows that a cell may span, and the entities that are decoded.
MOST_COLUMNS, MOST_ROWS = 30, 400
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def spread_spans(rows) -> list[tuple[int, int, str]]:
    """row, col and text of a table's cells, each in all places that it spans. rows: lists of (text, colspan, rowspan).

    A cell that spans rows is carried: the next rows take it where their cells come to its column.
    """
    out, carry = [], {}
    for r, cells in enumerate(rows):
        place, col = {}, 0

        def take(col: int) -> int:
            while carry.get(col, (None, 0))[1] > 0:
                text, left = carry[col]
                place[col] = text
                carry[col] = (text, left - 1)
                col += 1
            return col

        for text, columns, down in cells:
            col = take(col)
            for _ in range(columns):
                place[col] = text
                if down > 1:
                    carry[col] = (text, down - 1)
                col += 1
        take(col)
        out += [(r, c, place[c]) for c in sorted(place)]
    return out


def extract_page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, col and text of the cells of each outermost table, each in all places that it spans, so that rows which
    share a cell all have it. Numbers count from 0.

    A table inside a cell is text of that cell. Tags are dropped, common entities decoded and blanks collapsed; cells and rows
    need no closing tags, and cells outside rows are left out. Null pages and those without tables give no rows, repeated rows
    each their own. Tags become rows, numbered by running counts inside their page; Python sees the finished rows of a table
    only, to carry spans from one to the next.
    """
    numbered = pages.where(F.col(html).rlike("(?i)<table")).select(F.col(key), F.col(html), F.monotonically_increasing_id().alias("_id"))
    held = numbered.select("_id", F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("_pos", "_t"))
    tag = F.regexp_extract("_t", "^<[^>]*>", 0)
    t = held.select("_id", key, "_pos", F.lower(F.regexp_extract("_t", "^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)).alias("_name"), tag.alias("_tag"), F.expr("substring(_t, length(regexp_extract(_t, '^<[^>]*>', 0)) + 1)").alias("_text"))
    page = Window.partitionBy("_id").orderBy("_pos")
    is_ = lambda *names: F.col("_name").isin(*names)
    t = t.withColumn("_depth", F.sum(F.when(is_("table"), 1).when(is_("/table"), -1).otherwise(0)).over(page))
    outer = F.col("_depth") == 1
    t = t.withColumn("table", F.count_if(is_("table") & outer).over(page) - 1).where((F.col("_depth") >= 1) & (F.col("table") >= 0))
    t = t.withColumn("row", F.count_if(is_("tr") & outer).over(Window.partitionBy("_id", "table").orderBy("_pos")) - 1).where("row >= 0")
    row = Window.partitionBy("_id", "table", "row").orderBy("_pos")
    t = t.withColumn("_cell", F.count_if(is_("td", "th") & outer).over(row)).withColumn("_open", F.last(F.when(outer & is_("td", "th"), True).when(outer & is_("/td", "/th", "tr", "/tr"), False), ignorenulls=True).over(row))
    span = lambda name, most: F.least(F.coalesce(F.nullif(F.regexp_extract(F.min_by("_tag", "_pos"), rf"(?i)\b{name}\s*=\s*[\"']?\s*(-?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(1)), F.lit(most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.when(~is_("script", "style"), F.col("_text")).otherwise("").alias("_text")))), lambda x: x["_text"]), "")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    cells = t.where("_cell > 0 and _open").groupBy("_id", "table", "row", "_cell").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), span("colspan", MOST_COLUMNS).alias("columns"), span("rowspan", MOST_ROWS).alias("down"))
    listed = cells.groupBy("_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("_cell", "text", "columns", "down"))).alias("_cells"))
    rows = t.groupBy("_id", key, "table", "row").agg(F.lit(1).alias("_one")).join(listed, ["_id", "table", "row"], "left")
    empty = F.array().cast("array<struct<_cell:bigint,text:string,columns:int,down:int>>")
    tables = rows.groupBy("_id", key, "table").agg(F.array_sort(F.collect_list(F.struct("row", F.coalesce("_cells", empty).alias("cells")))).alias("_rows"))

    @F.pandas_udf("array<struct<row:int,col:int,text:string>>")
    def grid(tables: pd.Series) -> pd.Series:
        return tables.map(lambda rows: spread_spans([[(c["text"], c["columns"], c["down"]) for c in r["cells"]] for r in rows]))

    return tables.select(key, F.col("table").cast("int").alias("table"), F.inline(grid(F.transform("_rows", lambda r: F.struct(F.transform(r["cells"], lambda c: F.struct(c["text"].alias("text"), c["columns"].alias("columns"), c["down"].alias("down"))).alias("cells"))))))


def read_packed_csv(spark: SparkSession, path: str, spec: Mapping[str, tuple[str, int, str, float]], keep: Sequence[str] = (), kind: str | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    """Columns out of packed fields of a CSV with a header. spec: name -> (field, part, sentinel, scale); a sentinel is null."""
    df = spark.read.csv(path, header=True)
    if kind is not None:
        df = df.where(F.col(kind).isin(*kinds))

    def value(field, part, sentinel, scale):
        raw = F.get(F.split(field, ","), F.lit(part))
        return F.when(F.regexp_replace(raw, r"^\+", "") != sentinel, raw.try_cast("double") * scale)

    return df.select(*keep, *(value(*s).alias(n) for n, s in spec.items()))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """id, title, updated and link of the entries of Atom feeds."""
    schema = "id string, title string, updated string, link struct<_href:string>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return df.select("id", "title", F.to_timestamp("updated").alias("updated"), F.col("link._href").alias("link"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """id, name, role and points of map elements, one JSON object a line."""
    df = spark.read.schema(ELEMENT).json(path)
    return df.select("id", F.col("tags")["name"].alias("name"), F.coalesce(F.col("tags")["golf"], F.col("tags")["leisure"]).alias("role"), F.col("geometry").alias("points"))
