"""An index of dependency JARs that grows by what is new.

A JAR is known by the hash of its content. Its parsed classes are a shard, kept as Parquet under that hash; a manifest has a row for
each shard that was written whole. A run parses only JARs whose hash the manifest doesn't have, so the same JAR under another path,
or in another project that shares the folder, costs nothing. Shards are written before their manifest rows: what a lost run leaves is not known and is parsed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codeloom.runtime import stored
from codeloom.sources.classfile import parsed_classes

#: Raised when what is parsed changes: shards of other versions aren't known.
VERSION = 1
_MANIFEST = "hash string, version int, classes long, problems long, first_problem string"


@dataclass
class DependencyIndex:
    """``classes``: the parsed classes of all JARs that were asked for, with ``jar`` (path) and ``place`` (its place in the order of the class path).
    ``status`` (jar, hash, classes, problems, first_problem, status): COMPLETE, DEGRADED (some of it can't be read) or UNAVAILABLE (there is no such
    file). ``parsed``: how many JARs this run parsed."""

    classes: DataFrame
    status: DataFrame
    parsed: int

    def overall(self) -> str:
        """UNAVAILABLE if no JAR can be used, DEGRADED if one isn't complete, else COMPLETE."""
        seen = {r.status: r.n for r in self.status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not seen or set(seen) == {"COMPLETE"}:
            return "COMPLETE"
        return "UNAVAILABLE" if set(seen) == {"UNAVAILABLE"} else "DEGRADED"

    def first(self) -> DataFrame:
        """One row for each class name: that of the JAR that comes first on the class path."""
        best = Window.partitionBy("class_name").orderBy("place", "path")
        return self.classes.where("class_name is not null").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    # with a schema given, hashes in the names of folders stay texts
    return spark.read.schema(schema).parquet(path)


def update(jars: DataFrame, folder: str, wanted: list[str] | None = None) -> DependencyIndex:
    """Bring the shards in ``folder`` up to date with ``jars`` (path, content) and give the index of them. ``wanted`` are the paths of the class path in
    order (default: all, by path); those that ``jars`` doesn't have are unavailable. Null content is unavailable, too."""
    spark = jars.sparkSession
    folder = folder.rstrip("/")
    form = parsed_classes(jars.select("path", "content")).schema.fields
    own = stored(jars.select(F.col("path").alias("jar"), F.sha2("content", 256).alias("hash"), "content"))
    hashes = own.select("jar", "hash")
    paths = wanted if wanted is not None else sorted(r.jar for r in hashes.select("jar").collect())
    order = spark.createDataFrame([Row(place=k, jar=p) for k, p in enumerate(paths)], "place long, jar string")
    asked = order.join(hashes, "jar", "left")
    known = _read(spark, f"{folder}/manifest", _MANIFEST)
    fresh = asked.where("hash is not null").select("hash").distinct()
    if known is not None:
        fresh = fresh.join(known.where(F.col("version") == VERSION).select("hash"), "hash", "left_anti")
    fresh = stored(fresh)
    parsed = fresh.count()
    if parsed:
        contents = own.join(fresh, "hash", "left_semi").dropDuplicates(["hash"])
        rows = parsed_classes(contents.select(F.concat("hash", F.lit(".jar")).alias("path"), "content")).withColumn("hash", F.substring_index("path", ".jar", 1))
        shard = f"{folder}/shards/run={uuid.uuid4().hex}"
        rows.repartition("hash").write.partitionBy("hash").parquet(shard)
        seen = _read(spark, shard, StructType([*form, StructField("hash", StringType())]))
        counted = seen.groupBy("hash").agg(F.count_if(F.col("problem").isNull()).alias("classes"), F.count("problem").alias("problems"), F.min("problem").alias("first_problem"))
        # a JAR without any class is whole, too
        rows_of = fresh.join(counted, "hash", "left").select("hash", F.lit(VERSION).alias("version"), F.coalesce("classes", F.lit(0)).cast("long").alias("classes"), F.coalesce("problems", F.lit(0)).cast("long").alias("problems"), "first_problem")
        rows_of.write.mode("append").parquet(f"{folder}/manifest")
        known = _read(spark, f"{folder}/manifest", _MANIFEST)
    if known is None:
        known = spark.createDataFrame([], _MANIFEST)
    # two runs at once may parse a JAR each; either shard will do
    known = known.where(F.col("version") == VERSION).dropDuplicates(["hash"]).drop("version")
    whole = asked.join(known, "hash", "left")
    state = F.when(F.col("hash").isNull(), "UNAVAILABLE").when(F.col("problems") > 0, "DEGRADED").otherwise("COMPLETE")
    status = whole.select("place", "jar", "hash", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("problems", F.lit(0)).alias("problems"), "first_problem", state.alias("status"))
    shards = _read(spark, f"{folder}/shards", StructType([*form, StructField("hash", StringType()), StructField("run", StringType())]))
    if shards is None:
        none = parsed_classes(jars.select("path", "content").where("false"))
        return DependencyIndex(none.withColumn("jar", F.lit(None).cast("string")).withColumn("place", F.lit(None).cast("long")), status, parsed)
    once = shards.groupBy("hash").agg(F.min("run").alias("run"))
    classes = shards.join(once, ["hash", "run"], "left_semi").join(asked.where("hash is not null"), "hash").drop("run")
    return DependencyIndex(classes, status, parsed)


def type_details(index: DependencyIndex, name: str) -> DataFrame:
    """(class_name, kind, flags, superclass, interfaces, signature, jar, supertypes) of the types of a full or simple name, the first on the class path of each full
    name. ``supertypes`` are all above it that the index has or names, nearest first; several rows mean that a simple name is ambiguous."""
    from codeloom.operators.graph import distances

    first = stored(index.first().where("problem is null"))
    found = first.where((F.col("class_name") == name) | (F.regexp_extract("class_name", r"([^.$]+)$", 1) == name))
    up = first.select(F.col("class_name").alias("src"), F.explode(F.array_compact(F.concat(F.array("superclass"), "interfaces"))).alias("dst"))
    above = distances(up, found.select(F.col("class_name").alias("origin"), F.col("class_name").alias("node"))).where("depth > 0")
    listed = above.groupBy(F.col("origin").alias("class_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("supertypes"))
    return found.join(listed, "class_name", "left").select("class_name", "kind", "flags", "superclass", "interfaces", "signature", "jar", F.coalesce("supertypes", F.array().cast("array<string>")).alias("supertypes"))


def type_members(index: DependencyIndex, name: str, *, inherited: bool = False) -> DataFrame:
    """(owner, kind, name, descriptor, modifiers, signature, constant, exceptions) of a type's members; with ``inherited``, of those above it, too, that
    are neither private nor constructors nor declared again nearer by."""
    details = stored(type_details(index, name))
    owners = details.select(F.col("class_name").alias("origin"), F.col("class_name").alias("owner"), F.lit(0).alias("depth"))
    if inherited:
        owners = owners.unionByName(details.select(F.col("class_name").alias("origin"), F.posexplode("supertypes").alias("depth", "owner")).withColumn("depth", F.col("depth") + 1))
    own = index.first().select(F.col("class_name").alias("owner"), F.explode("members").alias("m"))
    rows = own.join(owners, "owner").select("origin", "owner", "depth", "m.*")
    shown = rows.where((F.col("depth") == 0) | (~F.array_contains("modifiers", "private") & (F.col("kind") != "CONSTRUCTOR") & (F.col("name") != "<clinit>")))
    nearest = Window.partitionBy("origin", "kind", "name", "descriptor").orderBy("depth", "owner")
    return shown.withColumn("n", F.row_number().over(nearest)).where("n = 1").select("owner", "kind", "name", "descriptor", "modifiers", "signature", "constant", "exceptions")
