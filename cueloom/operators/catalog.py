"""The guideline catalogue as slowly changing dimension: versions linked by supersedes_id, one current row a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom import shared
from cueloom.operators.platforms import quoted_rules


def search(guidelines: DataFrame, words: str | None = None, year: int | None = None, all_versions: bool = False, **equal: str) -> DataFrame:
    """Rows by words in four columns (either case) and exact filters; a year gives that year's rows of any version, else only current ones."""
    out = guidelines
    if words:
        like = f"%{words}%"
        out = out.filter(F.col("client").ilike(like) | F.col("ott_platform").ilike(like) | F.col("title").ilike(like) | F.col("body").ilike(like))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    if year is not None:
        out = out.filter(F.col("year") == year)
    elif not all_versions:
        out = out.filter("is_current")
    return out.orderBy("client", "ott_platform", "spec", F.desc("version_no"))


def add(guidelines: DataFrame, new: DataFrame) -> DataFrame:
    """guidelines with new rows as version 1, ids given by the caller."""
    first = new.withColumns({"version_no": F.lit(1), "is_current": F.lit(True), "supersedes_id": F.lit(None).cast("bigint")})
    return guidelines.unionByName(first, allowMissingColumns=True)


def update(guidelines: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (old_id, id, fields...): the old row closed and a next version that inherits what the change leaves null."""
    fields = [c for c in changes.columns if c not in ("old_id", "id")]
    old = guidelines.join(changes.select(F.col("old_id").alias("id")), "id", "left_semi")
    renamed = changes.select("old_id", F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in fields))
    newer = old.join(renamed, old.id == renamed.old_id)
    newer = newer.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col("_id").alias("id") if c == "id" else (F.col("version_no") + 1).alias(c) if c == "version_no" else F.lit(True).alias(c) if c == "is_current" else F.col("old_id").alias(c) if c == "supersedes_id" else F.col(c) for c in guidelines.columns))
    closed = guidelines.join(changes.select(F.col("old_id").alias("id"), F.lit(True).alias("_closed")), "id", "left")
    return closed.withColumn("is_current", F.when(F.col("_closed"), False).otherwise(F.col("is_current"))).select(guidelines.columns).unionByName(newer)


#: Rounds of doubling after which links that still change must run in a circle.
ROUNDS = 64


def roots(guidelines: DataFrame) -> DataFrame:
    """(id, root_id): the first version of every chain, by doubling the links until none changes.

    Each round is written to the shared folder, so the plan stays as long as one round. A link to a row that is missing
    ends there; links in a circle raise ValueError.
    """
    link = shared.written(guidelines.select("id", F.coalesce("supersedes_id", "id").alias("root_id"), F.lit(True).alias("moved")), "links")
    for _ in range(ROUNDS):
        up = link.select(F.col("id").alias("root_id"), F.col("root_id").alias("_up"))
        new = link.select("id", "root_id").join(up, "root_id", "left").select("id", F.coalesce("_up", "root_id").alias("root_id"), F.coalesce(F.col("_up") != F.col("root_id"), F.lit(False)).alias("moved"))
        link = shared.written(new, "links")
        if link.filter("moved").isEmpty():
            return link.select("id", "root_id")
    raise ValueError("guidelines supersede each other in a circle")


def history(guidelines: DataFrame, any_id: int) -> DataFrame:
    """All versions of a chain, oldest first, from any of them."""
    chain = roots(guidelines)
    root = chain.filter(F.col("id") == any_id).select("root_id")
    return guidelines.join(chain.join(F.broadcast(root.limit(1)), "root_id", "left_semi").select("id"), "id", "left_semi").orderBy("version_no")


def soft_delete(guidelines: DataFrame, ids: DataFrame) -> DataFrame:
    marked = guidelines.join(ids.select("id", F.lit(True).alias("_gone")), "id", "left")
    return marked.withColumn("is_current", F.when(F.col("_gone"), False).otherwise(F.col("is_current"))).select(guidelines.columns)


def hard_delete(guidelines: DataFrame, ids: DataFrame) -> DataFrame:
    return guidelines.join(ids.select("id"), "id", "left_anti")


def filter_options(guidelines: DataFrame) -> DataFrame:
    """Distinct clients, platforms, specs, and years from the latest down."""
    return guidelines.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("client", "ott_platform", "spec")), F.reverse(F.array_sort(F.collect_set("year"))).alias("year"))


def bulk_rows(imported: DataFrame) -> DataFrame:
    """(client, ott_platform, rule_no, rule, quote, source) to guideline rows numbered i.1.1; only rules whose quote stands in the source."""
    kept = quoted_rules(imported)
    order = Window.partitionBy("client", "ott_platform").orderBy("rule_no")
    return kept.withColumn("spec", F.concat(F.row_number().over(order).cast("string"), F.lit(".1.1"))).select("client", "ott_platform", "spec", F.col("rule").alias("body"))


def as_of(guidelines: DataFrame, year: int) -> DataFrame:
    """The latest version of every chain up to a year."""
    chain = guidelines.join(roots(guidelines), "id").filter(F.col("year") <= year)
    return chain.groupBy("root_id").agg(F.max_by(F.struct(*guidelines.columns), "version_no").alias("_g")).select("_g.*")
