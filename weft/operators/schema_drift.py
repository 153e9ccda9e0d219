"""Records whose fields drift between files and versions: one table, and a log of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.storage import Scratch

#: The lattice: a type may be widened to a later one of its chain; every type can be written as string.
KINDS = ("boolean", "integer", "number", "array", "object", "string")


def value_kind(v: Column) -> Column:
    """The kind of a variant value; null for JSON null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", None)
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def promote(a: str | None, b: str | None) -> str | None:
    """The least kind that holds both: integer into number, all else into string; null gives way."""
    if a is None or a == b:
        return b
    if b is None:
        return a
    return "number" if {a, b} == {"integer", "number"} else "string"


def promoted(kinds: Column) -> Column:
    """promote() folded over an array of kinds."""
    k = F.array_distinct(F.filter(kinds, lambda x: x.isNotNull()))
    numbers = F.forall(k, lambda x: x.isin("integer", "number"))
    return F.when(F.size(k) == 0, None).when(F.size(k) == 1, F.get(k, F.lit(0))).when(numbers, "number").otherwise("string")


def readable_rows(df: DataFrame) -> DataFrame:
    """The rows whose JSON is an object, with it as variant ``__doc``. Broken JSON, other JSON and null are left out."""
    parsed = df.withColumn("__doc", F.try_parse_json("json"))
    return parsed.where(F.schema_of_variant("__doc").startswith("OBJECT"))


def fields(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per top-level field and row, with kind and value as text; JSON nulls are left out."""
    spark = rows.sparkSession
    view = rows.select(*keep, "__doc")
    entries = view.lateralJoin(spark.tvf.variant_explode(F.col("__doc").outer()))
    typed = entries.select(*keep, F.col("key").alias("field_name"), value_kind(F.col("value")).alias("kind"), F.col("value").cast("string").alias("value"))
    return typed.where(F.col("kind").isNotNull())


class DriftReport:
    """The drift of records (ns, version, node_id, file, lsn, json) over the versions of each namespace.

    File headers are read in parallel: per namespace, version and file the fields with their counts by kind. They are
    folded per version: a version has a field if at least ``presence`` of its readable rows hold a non-null value, and
    its kind is that of most values (a tie goes to the kind first in the lattice). Versions are compared with the one
    before that occurs. Rows without namespace or version, and rows that aren't readable, take no part.
    """

    def __init__(self, records: DataFrame, presence: float = 0.1):
        self.presence = presence
        self.scratch = Scratch(records.sparkSession, "drift")
        known = records.where(F.col("ns").isNotNull() & F.col("version").isNotNull())
        rows = readable_rows(known).withColumn("__row", F.struct("lsn", "file"))
        self.entries = self.scratch.write(fields(rows, ["ns", "version", "node_id", "file", "lsn"]))
        self.rows = rows.groupBy("ns", "version").agg(F.count(F.lit(1)).alias("rows"))

    def headers(self) -> DataFrame:
        """ns, version, file, field_name, kind, n: what each file holds."""
        return self.entries.groupBy("ns", "version", "file", "field_name", "kind").agg(F.count(F.lit(1)).alias("n"))

    def versions(self) -> DataFrame:
        """ns, version, prev (the version before that occurs, or null)."""
        return self.rows.withColumn("prev", F.lag("version").over(W.partitionBy("ns").orderBy("version")))

    def held_fields(self) -> DataFrame:
        """ns, version, field_name, kind, present of all fields that a version's rows hold; present if the version has it."""
        rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(-i))])
        kinds = self.headers().groupBy("ns", "version", "field_name", "kind").agg(F.sum("n").alias("n"))
        folded = kinds.groupBy("ns", "version", "field_name").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct("n", rank[F.col("kind")])).alias("kind"))
        return folded.join(self.rows, ["ns", "version"]).select("ns", "version", "field_name", "kind", (F.col("n") >= self.presence * F.col("rows") - 1e-9).alias("present"))

    def version_fields(self) -> DataFrame:
        """ns, version, field_name, kind of the fields that a version has."""
        return self.held_fields().where("present").drop("present")

    def changes(self) -> DataFrame:
        """ns, schema_version, field_name, change_kind, old_name, old_type, new_type."""
        has = self.scratch.write(self.version_fields())
        vs = self.scratch.write(self.versions().where(F.col("prev").isNotNull()).select("ns", "version", "prev"))
        now = vs.join(has, ["ns", "version"]).select("ns", "version", "field_name", F.col("kind").alias("new_type"))
        before = vs.join(has.withColumnRenamed("version", "prev"), ["ns", "prev"]).select("ns", "version", "field_name", F.col("kind").alias("old_type"))
        both = now.join(before, ["ns", "version", "field_name"], "full_outer")
        fresh = both.where(F.col("old_type").isNull()).select("ns", "version", "field_name")
        gone = both.where(F.col("new_type").isNull()).select("ns", "version", "field_name")

        values = self.entries.groupBy("ns", "version", "node_id", "field_name").agg(F.max_by("value", F.struct("lsn", "file")).alias("value"))
        values = values.where(F.col("node_id").isNotNull())
        held = values.join(fresh, ["ns", "version", "field_name"]).select("ns", "version", "node_id", F.col("field_name").alias("new_name"), F.col("value").alias("new_value"))
        gone_at = gone.join(vs, ["ns", "version"]).select("ns", F.col("prev"), F.col("version").alias("at"), "field_name")
        was = values.withColumnRenamed("version", "prev").join(gone_at, ["ns", "prev", "field_name"]).select("ns", F.col("at").alias("version"), "node_id", F.col("field_name").alias("old_name"), F.col("value").alias("old_value"))
        pairs = held.join(was, ["ns", "version", "node_id"]).groupBy("ns", "version", "new_name", "old_name").agg(
            F.count(F.lit(1)).alias("both"), F.count_if(F.col("new_value") == F.col("old_value")).alias("same")
        )
        fits = pairs.where(2 * F.col("same") > F.col("both"))
        best_new = W.partitionBy("ns", "version", "new_name").orderBy(F.desc("same"), "old_name")
        best_old = W.partitionBy("ns", "version", "old_name").orderBy(F.desc("same"), "new_name")
        renamed = fits.withColumn("a", F.row_number().over(best_new)).where("a = 1").withColumn("b", F.row_number().over(best_old)).where("b = 1").select("ns", "version", "new_name", "old_name")

        as_new = renamed.select("ns", "version", F.col("new_name").alias("field_name"), "old_name")
        as_old = renamed.select("ns", "version", F.col("old_name").alias("field_name"), F.lit(True).alias("was_renamed"))
        told = both.join(as_new, ["ns", "version", "field_name"], "left").join(as_old, ["ns", "version", "field_name"], "left")
        kind = (
            F.when(F.col("old_name").isNotNull(), "renamed")
            .when(F.col("was_renamed"), None)
            .when(F.col("old_type").isNull(), "added")
            .when(F.col("new_type").isNull(), "removed")
            .when(F.col("old_type") != F.col("new_type"), "retyped")
        )
        return told.select("ns", F.col("version").alias("schema_version"), "field_name", kind.alias("change_kind"), "old_name", "old_type", "new_type").where(F.col("change_kind").isNotNull())

    def unified(self) -> DataFrame:
        """One table for all files: ns, node_id, field_name, field_type, value, fits, lsn, stray and the typed values.

        A renamed field goes by its latest name and takes the least kind that holds all its versions' kinds. ``value``
        is the text; as_boolean, as_integer or as_number has it in the field's kind, and values that can't be read as
        that kind have ``fits`` false. A value of a field that its version hardly holds counts for the stable field of
        that name. If there is none, or another field of the version goes by that name, it is ``stray`` and keeps its
        own name. Of several rows of one node the highest lsn counts, field by field.
        """
        renames = self.changes().where("change_kind = 'renamed'").select("ns", F.col("schema_version").alias("at"), "old_name", F.col("field_name").alias("new_name"))
        has = self.scratch.write(self.held_fields())
        names = has.select("ns", "version", "field_name").withColumn("stable", F.col("field_name"))
        hops = self.scratch.write(renames)
        for _ in range(int(hops.groupBy("ns").count().agg(F.max("count")).first()[0] or 0)):
            step = names.join(hops, (names.ns == hops.ns) & (names.stable == hops.old_name) & (hops["at"] > names.version), "left")
            moved = step.groupBy(names.ns, names.version, names.field_name).agg(F.max_by(F.coalesce("new_name", "stable"), -F.coalesce("at", F.lit(1 << 40))).alias("stable"))
            new = self.scratch.write(moved)
            if new.join(names.select("ns", "version", "field_name", F.col("stable").alias("s")), ["ns", "version", "field_name"]).where("s <> stable").isEmpty():
                names = new
                break
            names = new
        known = names.join(has.where("present"), ["ns", "version", "field_name"]).select("ns", "stable").distinct().withColumn("known", F.lit(True))
        first = W.partitionBy("ns", "version", "stable").orderBy(F.desc("present"), F.col("field_name") == F.col("stable"), "field_name")
        ranked = names.join(has, ["ns", "version", "field_name"]).join(known, ["ns", "stable"], "left").withColumn("rank", F.row_number().over(first))
        stray = F.col("known").isNull() | (F.col("rank") > 1)
        names = self.scratch.write(ranked.select("ns", "version", "field_name", "kind", "present", stray.alias("stray"), F.when(stray, F.col("field_name")).otherwise(F.col("stable")).alias("stable")))
        kinds = names.where("present OR stray").groupBy("ns", "stable", "stray").agg(promoted(F.collect_set("kind")).alias("field_type"))
        named = self.entries.join(names.select("ns", "version", "field_name", "stable", "stray"), ["ns", "version", "field_name"])
        latest = named.groupBy("ns", "node_id", "stable", "stray").agg(F.max(F.struct("lsn", "version", "file", "value")).alias("v"))
        out = latest.join(kinds, ["ns", "stable", "stray"]).select("*", F.col("v.value").alias("value"), F.col("v.lsn").alias("lsn"))
        value, kind = F.col("value"), F.col("field_type")
        typed = {
            "as_boolean": F.when((kind == "boolean") & F.lower(value).isin("true", "false"), F.lower(value) == "true"),
            "as_integer": F.when((kind == "integer") & value.rlike(r"^[+-]?\d+(\.0*)?$"), value.try_cast("decimal(38,0)")),
            "as_number": F.when(kind == "number", value.try_cast("double")),
        }
        fits = ~kind.isin("boolean", "integer", "number") | typed["as_boolean"].isNotNull() | typed["as_integer"].isNotNull() | typed["as_number"].isNotNull()
        return out.select("ns", "node_id", F.col("stable").alias("field_name"), "field_type", "value", fits.alias("fits"), "lsn", "stray", *[c.alias(n) for n, c in typed.items()])


def node_records(df: DataFrame) -> DataFrame:
    """node_rows in the form that DriftReport takes."""
    return df.select("ns", F.col("__schema_version").alias("version"), "node_id", F.col("sst_file").alias("file"), "lsn", F.col("__overflow_json").alias("json"))
