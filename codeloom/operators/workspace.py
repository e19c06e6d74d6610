"""Several repositories as one: coordinates, routes, usages and risk across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scoring import half_up, risk_level
from codeloom.functions.text import simple_name
from codeloom.operators.graph import distances
from codeloom.operators.risk import class_risk
from codeloom.plans.snapshot import Snapshot


def repositories(s: Snapshot) -> DataFrame:
    """Repositories with modules, classes and beans."""
    return s.current().groupBy("repository").agg(F.countDistinct("module").alias("modules"), F.count(F.lit(1)).alias("classes"), F.count_if("is_bean").alias("beans"), F.sum("source_tokens").alias("tokens"))


def providers(s: Snapshot) -> DataFrame:
    """(coordinate, version, repository): what each repository provides, by its modules that have current classes."""
    live = s.current().select(F.col("module").alias("coordinate"), "repository").distinct()
    return s.module_artifacts.join(live, ["coordinate", "repository"], "left_semi").select("coordinate", "repository", "version")


def cross_dependencies(s: Snapshot) -> DataFrame:
    """(consumer, provider, classes, occurrences): dependencies between classes of different repositories."""
    side = lambda p, n: s.current().select(F.col("id").alias(f"{p}_class_id"), F.col("repository").alias(n))
    rows = s.dependencies.join(side("from", "consumer"), "from_class_id").join(side("to", "provider"), "to_class_id").where("consumer <> provider")
    return rows.groupBy("consumer", "provider").agg(F.countDistinct("from_class_id").alias("classes"), F.sum("occurrence_count").alias("occurrences"))


def coordinate_matches(declared: DataFrame, provided: DataFrame) -> DataFrame:
    """Declared dependencies (consumer, coordinate, version) with their provider: of several, those of the
    declared version if there are any, else all; the first by name. Adds how many fit and whether the version did."""
    rows = declared.alias("d").join(provided.alias("p"), F.col("d.coordinate") == F.col("p.coordinate")).where("d.consumer <> p.repository")
    rows = rows.select("d.consumer", "d.coordinate", F.col("d.version").alias("declared_version"), F.col("p.repository").alias("provider"), F.col("p.version").eqNullSafe(F.col("d.version")).alias("same"))
    of = Window.partitionBy("consumer", "coordinate", "declared_version")
    best = rows.withColumn("any_same", F.max("same").over(of)).where("same OR NOT any_same")
    return best.groupBy("consumer", "coordinate", "declared_version").agg(F.min("provider").alias("provider"), F.countDistinct("provider").alias("candidates"), F.max("same").alias("version_matched"))


def dependency_routes(s: Snapshot, wanted: DataFrame) -> DataFrame:
    """Routes for (consumer, coordinate): over recorded dependencies between repositories if there is one, else by
    the catalogue of coordinates; one provider is resolved, several ambiguous, none not found."""
    edges = cross_dependencies(s).select("consumer", F.col("provider").alias("repository"))
    cat = providers(s).select("coordinate", "repository").distinct()
    known = wanted.join(cat, "coordinate").where("consumer <> repository")
    direct = known.join(edges, ["consumer", "repository"], "left_semi").withColumn("via", F.lit("dependency"))
    rest = known.join(direct.select("consumer", "coordinate"), ["consumer", "coordinate"], "left_anti").withColumn("via", F.lit("catalogue"))
    by = direct.unionByName(rest).groupBy("consumer", "coordinate", "via").agg(F.countDistinct("repository").alias("n"), F.min("repository").alias("provider"))
    whole = wanted.join(by, ["consumer", "coordinate"], "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    sure = F.when(status != "resolved", "low").when(F.col("via") == "dependency", "high").otherwise("medium")
    return whole.select("consumer", "coordinate", status.alias("status"), F.when(status == "resolved", F.col("provider")).alias("provider"), sure.alias("confidence"))


def provider_status(s: Snapshot) -> DataFrame:
    """Coordinates by how their providers were found: mapped to one repository, ambiguous, or unresolved."""
    of = s.module_edges.select(F.col("visible").alias("coordinate")).distinct().join(providers(s), "coordinate", "left").groupBy("coordinate").agg(F.countDistinct("repository").alias("n"))
    status = F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return of.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("artifacts"))


def resolve_across(s: Snapshot, targets: list[str]) -> DataFrame:
    """Targets by full or short class name over all repositories: resolved, ambiguous or not found."""
    wanted = s.spark.createDataFrame([(t,) for t in targets], "target string")
    names = s.current().select("class_name", "repository")
    keyed = names.select(F.col("class_name").alias("target"), "class_name", "repository").unionByName(names.select(simple_name(F.col("class_name")).alias("target"), "class_name", "repository")).distinct()
    by = wanted.join(keyed, "target").groupBy("target").agg(F.count(F.lit(1)).alias("matches"), F.min("repository").alias("repository"))
    n = F.coalesce("matches", F.lit(0))
    return wanted.join(by, "target", "left").select("target", n.alias("matches"), F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("repository")).alias("repository"))


def usages_across(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Uses of the targets (id) by classes of other repositories, by repository and kind."""
    own = s.current().join(targets.select("id"), "id", "left_semi").select(F.col("id").alias("to_class_id"), F.col("repository").alias("provider"))
    users = s.current().select(F.col("id").alias("from_class_id"), F.col("repository").alias("consumer"))
    rows = s.dependencies.join(own, "to_class_id").join(users, "from_class_id").where("consumer <> provider")
    return rows.groupBy(F.col("to_class_id").alias("target_id"), "consumer", "kind").agg(F.countDistinct("from_class_id").alias("classes"), F.sum("occurrence_count").alias("occurrences"))


def risk_across(s: Snapshot, *, max_depth: int = 3, drifted: int = 0) -> DataFrame:
    """Local risk of each class and what other repositories add: .5 for each that uses its repository
    directly, .2 for each beyond, .5 for each that lags behind; 10 at most."""
    edges = cross_dependencies(s).select(F.col("provider").alias("src"), F.col("consumer").alias("dst"))
    starts = s.current().select(F.col("repository").alias("origin"), F.col("repository").alias("node")).distinct()
    reach = distances(edges, starts, max_depth=max_depth).where("depth > 0 AND node <> origin")
    counts = reach.groupBy(F.col("origin").alias("repository")).agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    whole = class_risk(s).join(s.classes.select("id", "repository"), "id").join(counts, "repository", "left")
    direct, beyond = F.coalesce("direct", F.lit(0)), F.coalesce("transitive", F.lit(0))
    score = half_up(F.least(F.lit(10.0), F.col("score") + 0.5 * direct + 0.2 * beyond + 0.5 * drifted), 1)
    return whole.select("id", "class_name", "repository", F.col("score").alias("local"), direct.alias("direct"), beyond.alias("transitive"), score.alias("score"), risk_level(score).alias("level"))


def provider_fallback(s: Snapshot, repository: str, names: DataFrame) -> DataFrame:
    """Names that a repository lacks, with the only other repository that has one: route or ambiguous."""
    local = s.current().where(F.col("repository") == repository).select("class_name")
    missing = names.select("class_name").distinct().join(local, "class_name", "left_anti")
    by = missing.join(s.current().select("class_name", "repository"), "class_name").groupBy("class_name").agg(F.countDistinct("repository").alias("n"), F.min("repository").alias("repository"))
    return by.select("class_name", F.when(F.col("n") == 1, "routed").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("repository")).alias("repository"))


def consumer_evidence(s: Snapshot, *, limit: int = 100) -> DataFrame:
    """Evidence of use where a consumer's index lacks the class: dependency beans before external types, one occurrence each."""
    beans = s.beans.select(F.lit(0).alias("rank"), F.concat(F.lit("bean:"), "bean_type").alias("evidence"), "class_id")
    types = s.external_deps.select(F.lit(1).alias("rank"), F.concat(F.lit("type:"), "external_type").alias("evidence"), "class_id")
    return beans.unionByName(types).select("rank", "evidence", "class_id", F.lit(1).alias("occurrences")).orderBy("rank", "evidence", "class_id").limit(limit)


def routed_dependencies(s: Snapshot) -> DataFrame:
    """Dependencies between repositories, with the coordinate they go by and how many repositories provide it."""
    ends = lambda p: s.current().select(F.col("id").alias(f"{p}_class_id"), F.col("repository").alias(f"{p}_repository"), F.col("module").alias(f"{p}_module"))
    rows = s.dependencies.join(ends("from"), "from_class_id").join(ends("to"), "to_class_id").where("from_repository <> to_repository")
    n = providers(s).groupBy(F.col("coordinate").alias("to_module")).agg(F.countDistinct("repository").alias("providers"))
    return rows.join(n, "to_module").select("from_class_id", "to_class_id", "kind", "from_repository", "to_repository", F.col("to_module").alias("coordinate"), "providers")


def logical_properties(declarations: DataFrame) -> DataFrame:
    """Properties by owner and name from declarations (owner, kind, name, signature): a field, getter and setter of one
    name are bindings of one property; accessors lose ``get``, ``is`` or ``set``. A companion's fields belong
    to the outer class; delegates' backing fields (``$delegate``) don't count."""
    accessor = F.regexp_extract("name", r"^(?:get|set|is)([A-Z].*)$", 1)
    plain = F.when((F.col("kind") == "METHOD") & (accessor != ""), F.concat(F.lower(F.substring(accessor, 1, 1)), F.substring(accessor, 2, 1_000))).when(F.col("kind") == "FIELD", F.col("name"))
    binding = F.when(F.col("kind") == "FIELD", "field").when(F.col("name").startswith("set"), "setter").otherwise("getter")
    rows = declarations.where(~F.col("name").endswith("$delegate")).select(F.regexp_replace("owner", r"\$Companion$", "").alias("owner"), plain.alias("property"), binding.alias("binding")).where("property is not null")
    return rows.groupBy("owner", "property").agg(F.array_join(F.array_sort(F.collect_set("binding")), ",").alias("bindings"))
