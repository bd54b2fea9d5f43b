"""Staged publishing of whole tables, refused where a version loses what the live one has.

A published table is a folder: versions/<id> holds the files of a version, which nothing changes once written, and
pointers/<number> a small file that names one. The highest pointer with content is live. A version is staged in full, then the
pointer after the one that was live at the start is created, which fails if anyone else has created it meanwhile: a swap that
is compared with what was read. So readers see the old version or the new one, a write that fails or a pointer that moved leaves the live version as it was, and older versions stay as backups.
"""

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks of a row's status; any other is 0.
STATUS_RANKS = {"full": 3, "reviewed": 3, "partial": 2, "held": 1, "no-routing": 0, "unaudited": 0}
#: A kind that no revocation explains: a missing field of an export is a defect of the data, not a decision.
NEVER_EXPLAINED = ("coords_missing",)


def version_parity(
    live: DataFrame,
    next_: DataFrame,
    key: str,
    status: str,
    mapped: str,
    element: str | None = None,
    coords: str | None = None,
    had_coords: Column | None = None,
    features: str | None = None,
    review: str | None = None,
    candidate: str | None = None,
    extracted: str | None = None,
    revocations: DataFrame | None = None,
    ranks: Mapping[str, int] = STATUS_RANKS,
    keeps: float = 0.75,
) -> DataFrame:
    """key, kind, outcome (regression, explained, improvement or added) and evidence_id: what changes from live to next.

    Regressions: row_removed; status_downgrade by ranks; mapped_lost (a smaller count, null is 0); element_changed, where both
    rank 2 or more; coords_missing (live had coordinates, which is what coords says or, where that is null, had_coords on live's
    columns, and next says false); features_lost (a map of counts: a kind of them is gone, or less than keeps of all is left; both rank 2
    or more); review_lost; candidate_lost where next ranks 1 or less; older_extract. A revocation (key, allow, evidence_id)
    explains the kinds it allows, but never coords_missing. improved: a higher rank or count; added: a key that is new.
    """
    columns = [c for c in (status, mapped, element, coords, features, review, candidate, extracted) if c]
    had = F.coalesce(F.col(coords), had_coords if had_coords is not None else F.lit(False)) if coords else F.lit(None).cast("boolean")
    l = live.select(F.col(key), F.struct(*columns, had.alias("_had")).alias("l"))
    n = next_.select(F.col(key), F.struct(*columns).alias("n"))
    m = l.join(n, key, "full_outer")
    both, a, b = F.col("l").isNotNull() & F.col("n").isNotNull(), lambda c: F.col("l")[c], lambda c: F.col("n")[c]
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    rank = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0))
    ra, rb = rank(a(status)), rank(b(status))
    count = lambda x: F.coalesce(x[mapped], F.lit(0))
    drawn = (ra >= 2) & (rb >= 2)
    kinds = {"status_downgrade": rb < ra, "mapped_lost": count(F.col("n")) < count(F.col("l"))}
    if element:
        kinds["element_changed"] = drawn & ~a(element).eqNullSafe(b(element))
    if coords:
        kinds["coords_missing"] = F.col("l")["_had"] & (b(coords) == F.lit(False))
    if features:
        left = F.coalesce(b(features), F.create_map().cast(live.schema[features].dataType))
        lost = F.exists(F.map_keys(F.map_filter(a(features), lambda k, v: v > 0)), lambda k: F.coalesce(F.try_element_at(left, k), F.lit(0)) <= 0)
        total = lambda x: F.aggregate(F.map_values(x), F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
        kinds["features_lost"] = drawn & a(features).isNotNull() & (lost | (total(left) < total(a(features)) * keeps))
    if review:
        kinds["review_lost"] = a(review).isNotNull() & b(review).isNull()
    if candidate:
        kinds["candidate_lost"] = a(candidate).isNotNull() & b(candidate).isNull() & (rb <= 1)
    if extracted:
        kinds["older_extract"] = b(extracted) < a(extracted)
    better = (rb > ra) | (count(F.col("n")) > count(F.col("l")))
    found = [F.when(F.col("n").isNull(), "row_removed"), *(F.when(both & c, kind) for kind, c in kinds.items()), F.when(both & better, "improved"), F.when(F.col("l").isNull(), "added")]
    out = m.select(key, F.explode(F.array_compact(F.array(*found))).alias("kind"))
    regression = ~F.col("kind").isin("improved", "added")
    if revocations is None:
        out = out.withColumn("evidence_id", F.lit(None).cast("string")).withColumn("_ok", F.lit(False))
    else:
        out = out.join(revocations.select(key, F.col("allow").alias("_allow"), F.col("evidence_id").cast("string").alias("_evidence")), key, "left")
        out = out.withColumn("_ok", F.coalesce(F.array_contains("_allow", F.col("kind")), F.lit(False)) & regression & ~F.col("kind").isin(*NEVER_EXPLAINED)).withColumn("evidence_id", F.when(F.col("_ok"), F.col("_evidence")))
    outcome = F.when(F.col("_ok"), "explained").when(regression, "regression").when(F.col("kind") == "added", "added").otherwise("improvement")
    return out.select(key, "kind", outcome.alias("outcome"), "evidence_id")


# --- files ------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that does not exist yet; False if it does."""
    fs, p = _files(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception:  # another publisher was faster
        if fs.exists(p):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, dict | None]]:
    """Number and content of the pointers, in order; a pointer without content counts for nothing. A few small files."""
    fs, p = _files(spark, f"{root}/pointers")
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.isdigit():
            rows = spark.read.text(f"{root}/pointers/{name}", wholetext=True).take(1)
            try:
                out.append((int(name), json.loads(rows[0][0]) if rows else None))
            except ValueError:
                out.append((int(name), None))
    return sorted(out, key=lambda x: x[0])


def live_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number of the highest pointer (0 if there is none) and the version that is live."""
    found = _pointers(spark, root)
    named = [x["version"] for _, x in found if x]
    return (found[-1][0] if found else 0), (named[-1] if named else None)


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    version = live_version(spark, root)[1]
    return None if version is None else spark.read.parquet(f"{root}/versions/{version}")


def _fingerprint(df: DataFrame) -> tuple:
    """Rows and two sums of their hashes: the same whatever their order."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes))
    return tuple(df.agg(F.count("*"), F.sum(h % 1_000_000_007), F.bit_xor(h)).first())


def _stage(next_: DataFrame, path: str) -> None:
    next_.write.parquet(path)


def _discard(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def publish(next_: DataFrame, root: str, compare: Callable[[DataFrame, DataFrame], DataFrame] | None = None, dry_run: bool = False) -> dict:
    """Publishes next as the new version of the table in root; says whether it did, why not, and what compare found.

    compare takes the live version and next and gives rows with an outcome (version_parity): a regression refuses the whole
    publication before anything is written, as does a dry run. Staged files that don't read back as they were written, a
    failed write and a pointer that moved while they were staged leave the live version, and the staged files go.
    """
    spark = next_.sparkSession
    number, version = live_version(spark, root)
    report = {"published": False, "live_before": version, "found": {}}
    if version is not None and compare is not None:
        found = compare(spark.read.parquet(f"{root}/versions/{version}"), next_)
        report["found"] = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
        if report["found"].get("regression"):
            return report | {"reason": "regressions"}
    if dry_run:
        return report | {"reason": "dry_run"}
    new = uuid.uuid4().hex
    path = f"{root}/versions/{new}"
    try:
        _stage(next_, path)
        staged = spark.read.parquet(path)
        if _fingerprint(staged) != _fingerprint(next_.select(staged.columns)):
            raise ValueError("the staged files don't read back as they were written")
    except Exception as error:
        _discard(spark, path)
        return report | {"reason": "staging_failed", "error": str(error)[:500]}
    if live_version(spark, root) != (number, version) or not _create(spark, f"{root}/pointers/{number + 1:012d}", json.dumps({"version": new, "previous": version})):
        _discard(spark, path)
        return report | {"reason": "pointer_changed"}
    return report | {"published": True, "version": new}


def undo(spark: SparkSession, root: str) -> str | None:
    """Makes the version before the live one live again, by a further pointer; None if there is none or another publisher is
    faster."""
    found = _pointers(spark, root)
    named = [x for _, x in found if x]
    if not named or named[-1]["previous"] is None:
        return None
    back = named[-1]["previous"]
    before = next((x["previous"] for x in named if x["version"] == back), None)
    return back if _create(spark, f"{root}/pointers/{found[-1][0] + 1:012d}", json.dumps({"version": back, "previous": before})) else None


def prune(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Deletes versions that none of the last keep pointers with content names; how many went. Versions that are being staged
    are named by no pointer either, so this runs while nobody publishes."""
    named = [x["version"] for _, x in _pointers(spark, root) if x]
    fs, p = _files(spark, f"{root}/versions")
    gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in set(named[-keep:])] if fs.exists(p) else []
    for version in gone:
        _discard(spark, f"{root}/versions/{version}")
    return len(gone)


def guarded_overwrite(live: DataFrame, next_: DataFrame, root: str, key: str, counts: Sequence[str], fields: Sequence[str], revocations: DataFrame | None = None) -> bool:
    """Publishes next to root only if it has no regression against live (parity) that no revocation explains."""
    from .joins import parity

    found = parity(live, next_, key, counts, fields, revocations=revocations)
    bad = found if revocations is None else found.where("not explained")
    return bad.isEmpty() and publish(next_, root)["published"]
