"""Set operations, data quality checks and merges into tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_dedupe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.unionByName(b).dropDuplicates(list(keys))


def symmetric_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """change: added, removed or changed, with both values; unchanged keys are left out."""
    m = a.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")).join(b.select(key, F.col(value).alias("after"), F.lit(True).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return m.withColumn("change", change).where("change is not null").select(key, "before", "after", "change")


def added_removed(live: DataFrame, next_: DataFrame, key: str) -> DataFrame:
    added = next_.join(live, key, "left_anti").select(key, F.lit("added").alias("change"))
    return added.unionByName(live.join(next_, key, "left_anti").select(key, F.lit("removed").alias("change")))


def union_first_wins(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of rows with one key, that of the first frame."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_i", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))).where("_k = 1").drop("_k", "_i")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def new_items(prev: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cur.join(prev, list(keys), "left_anti")


# --- data quality -----------------------------------------------------------------------------------------------------


def check_domain(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule and how many rows break it; unknown values break nothing."""
    one = df.agg(*(F.count_if(~c).alias(n) for n, c in rules.items()))
    return one.unpivot([], list(rules), "rule", "broken")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_exactly_one(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which not exactly one of the columns is known."""
    return df.where(sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) != 1)


def check_fk(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows without a parent; a null key refers to nothing and is fine."""
    p = parent.select(*(F.col(v).alias(k) for k, v in on.items())).distinct()
    return child.dropna(subset=list(on)).join(p, list(on), "left_anti")


def check_interval(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.where(F.col(hi) < F.col(lo))


def check_immutable(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose row is gone or differs."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256).alias("_h"))
    return digest(old).join(digest(new).withColumnRenamed("_h", "_n"), key, "left").where("_n is null or _n <> _h").select(key, F.when(F.col("_n").isNull(), "removed").otherwise("changed").alias("change"))


def check_schema(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Columns that are missing, extra or of another type than the contract says."""
    have = dict(df.dtypes)
    rows = [(c, t, have.get(c), "missing" if c not in have else "type") for c, t in contract.items() if have.get(c) != t]
    rows += [(c, None, t, "extra") for c, t in have.items() if c not in contract]
    return df.sparkSession.createDataFrame(rows, "field string, wanted string, found string, problem string")


def tally(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


# --- merges -----------------------------------------------------------------------------------------------------------


def merge_upsert(target: DataFrame, changes: DataFrame, key: str, update_cols: Sequence[str], ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The new target and actions (key, action, before, after): inserted, updated or unchanged, by the given columns only and
    null-safe; changes take the target's types. Applied twice, the second time is unchanged throughout."""
    kinds = dict(target.dtypes)
    c = changes.select(F.col(key).cast(kinds[key]).alias(key), *(F.col(x).cast(kinds[x]).alias(f"_n_{x}") for x in update_cols), F.lit(True).alias("_c"))
    m = target.withColumn("_t", F.lit(True)).join(c, key, "full_outer")
    differs = F.lit(False)
    for x in update_cols:
        if x not in ignore:
            differs = differs | ~F.col(x).eqNullSafe(F.col(f"_n_{x}"))
    action = F.when(F.col("_c").isNull(), None).when(F.col("_t").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    m = m.withColumn("action", action)
    take = F.col("action").isin("inserted", "updated")
    new = m.select(*(F.when(take, F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) if x in update_cols else F.col(x) for x in target.columns))
    actions = m.where("action is not null").select(key, "action", F.when(F.col("_t"), F.struct(*update_cols)).alias("before"), F.struct(*(F.col(f"_n_{x}").alias(x) for x in update_cols)).alias("after"))
    return new, actions


def change_ledger(actions: DataFrame, key: str) -> DataFrame:
    """before and after as JSON of the updated rows."""
    keep = {"ignoreNullFields": "false"}
    return actions.where("action = 'updated'").select(key, F.to_json("before", keep).alias("before"), F.to_json("after", keep).alias("after"))


def append_new(ledger: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows to append: keys that the ledger has not, the first of each."""
    new = rows.join(ledger.select(key), key, "left_anti")
    return new.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def respect_natural_key(rows: DataFrame, existing: DataFrame, nk: Sequence[str], key: str) -> DataFrame:
    """Rows whose natural key is free or held under the same id."""
    held = existing.select(*nk, F.col(key).alias("_id"))
    return rows.join(held, list(nk), "left").where(F.col("_id").isNull() | (F.col("_id") == F.col(key))).drop("_id")


def coalesce_merge(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str], own: Column, unknown: str = "unknown") -> DataFrame:
    """Own rows take new values that are known; others only fill what is null or unknown."""
    m = old.join(new.select(key, *(F.col(c).alias(f"_n_{c}") for c in cols)), key, "left")
    fill = lambda c: F.when(F.col(c).cast("string") == unknown, None).otherwise(F.col(c))
    return m.withColumns({c: F.when(own, F.coalesce(f"_n_{c}", c)).otherwise(F.coalesce(fill(c), F.col(f"_n_{c}"), F.col(c))) for c in cols}).select(*old.columns)


def publish_changed(docs: DataFrame, manifest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents (key, doc) whose JSON differs from the manifest (key, hash), and the new manifest."""
    d = docs.select(key, F.to_json(F.struct(*(F.col(c) for c in sorted(docs.columns))), {"ignoreNullFields": "false"}).alias("doc")).withColumn("hash", F.sha2("doc", 256))
    changed = d.join(manifest.select(key, F.col("hash").alias("_old")), key, "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")
    return changed, d.select(key, "hash")


def public_view(docs: DataFrame, drop: Mapping[str, Sequence[str]] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Without columns, and without fields of struct columns, that are not public."""
    for c, fields in (drop or {}).items():
        docs = docs.withColumn(c, F.col(c).dropFields(*fields))
    return docs.drop(*columns)


def register_captures(raw: DataFrame, source: str, content: str, parser_version: str) -> DataFrame:
    """One row for each source and content hash: sha256, a deterministic id and how often it came."""
    g = raw.select(F.col(source).alias("source"), F.sha2(content, 256).alias("sha256")).groupBy("source", "sha256").agg(F.count("*").alias("n"))
    return g.withColumn("capture_id", F.sha2(F.concat_ws(":", "source", "sha256"), 256)).withColumn("parser_version", F.lit(parser_version))


def verify_hashes(raw: DataFrame, captures: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content no longer has the registered hash."""
    return raw.select(key, F.sha2(content, 256).alias("found")).join(captures.select(key, "sha256"), key).where("found <> sha256")
