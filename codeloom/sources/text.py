"""Text files as rows: service descriptors, configuration, modules, class paths, logs of history, diagnostics."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.runtime import ship, stored


def read_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of whole files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("content").cast("string").alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(path, line, value), lines from 1."""
    rows = texts.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("k", "value"))
    return rows.select("path", (F.col("k") + 1).alias("line"), "value")


def service_providers(texts: DataFrame) -> DataFrame:
    """(service, provider, path, line, position): entries of descriptors; ``#`` starts a comment. ``ordered`` says
    that the order matters: a processor service with several providers."""
    rows = lines_of(texts).select("path", "line", F.trim(F.regexp_replace("value", "#.*$", "")).alias("provider")).where("provider <> ''")
    rows = rows.withColumn("service", F.substring_index("path", "/", -1))
    of = Window.partitionBy("path")
    ordered = F.col("service").endswith("Processor") & (F.count(F.lit(1)).over(of) > 1)
    return rows.select("service", "provider", "path", "line", F.row_number().over(of.orderBy("line")).alias("position"), ordered.alias("ordered"))


def _properties(text: str) -> Iterator[tuple[str, int]]:
    """(key, line) of a properties file; an odd number of backslashes at its end continues a line."""
    pending, first = "", 0
    for n, raw in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        line = raw.lstrip(" \t\f")
        if not pending and (not line or line[0] in "#!"):
            continue
        first = first if pending else n
        slashes = len(line) - len(line.rstrip("\\"))
        if slashes % 2:
            pending += line[:-1]
            continue
        whole, pending = pending + line, ""
        key = re.match(r"((?:\\.|[^\\:=\s])*)", whole)[1]
        if key:
            yield re.sub(r"\\(.)", r"\1", key), first
    if pending:
        yield re.match(r"((?:\\.|[^\\:=\s])*)", pending)[1], first


def _yaml(text: str) -> Iterator[tuple[str, int]]:
    """(key path, line) of the leaves of a YAML file by indentation; items of lists are left out, a new document starts over."""
    stack: list[tuple[int, str]] = []
    open_key: tuple[str, int] | None = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if line.startswith("---"):
            if open_key:
                yield open_key
            stack, open_key = [], None
            continue
        m = re.match(r"( *)([^\s:#-][^:]*|\"[^\"]+\"|'[^']+')\s*:(?:\s+(.*)|$)", line)
        if not m or line.lstrip().startswith("- "):
            continue
        depth, key, value = len(m[1]), m[2].strip().strip("\"'"), m[3]
        if open_key and stack and depth <= stack[-1][0]:
            yield open_key
        open_key = None
        while stack and stack[-1][0] >= depth:
            stack.pop()
        path = ".".join([k for _, k in stack] + [key])
        stack.append((depth, key))
        if value:
            yield path, n
        else:
            open_key = (path, n)
    if open_key:
        yield open_key


def configuration_definitions(texts: DataFrame) -> DataFrame:
    """(key, kind, path, line) of properties and YAML files and persistence units; values aren't kept."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame.path, frame.text, strict=True):
                if path.endswith(".properties"):
                    out += [(k, "properties", path, n) for k, n in _properties(text or "")]
                elif path.endswith((".yml", ".yaml")):
                    out += [(k, "yaml", path, n) for k, n in _yaml(text or "")]
                elif path.endswith("persistence.xml"):
                    out += [(m[1], "persistence_unit", path, (text or "").count("\n", 0, m.start()) + 1) for m in re.finditer(r"<persistence-unit\s[^>]*name=\"([^\"]+)\"", text or "")]
            yield pd.DataFrame(out, columns=["key", "kind", "path", "line"])

    return texts.mapInPandas(run, "key string, kind string, path string, line int").distinct()


def placeholders(rows: DataFrame, column: str) -> DataFrame:
    """The rows with each ``${key}`` or ``${key:default}`` of a column: key, and whether there is a default."""
    found = F.explode(F.regexp_extract_all(column, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
    return rows.withColumn("reference", found).select("*", F.trim(F.substring_index("reference", ":", 1)).alias("key"), F.contains("reference", F.lit(":")).alias("has_default")).drop("reference")


def module_edges(texts: DataFrame) -> DataFrame:
    """(module, visible, relation) of build files: Maven dependencies by artifact with their scope, Gradle project
    dependencies by configuration. A Gradle module is named by its folder."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame.path, frame.text, strict=True):
                if path.endswith("pom.xml"):
                    try:
                        root = ET.fromstring(re.sub(r"\sxmlns=\"[^\"]*\"", "", text or ""))
                    except ET.ParseError:
                        continue
                    own = root.findtext("artifactId")
                    out += [(own, d.findtext("artifactId"), d.findtext("scope") or "compile") for d in root.findall("dependencies/dependency")]
                elif re.search(r"build\.gradle(\.kts)?$", path):
                    own = path.rsplit("/", 2)[-2]
                    for m in re.finditer(r"(\w+)\s*\(?\s*project\s*\(\s*[\"']:?([\w:.-]+)[\"']\s*\)", text or ""):
                        out.append((own, m[2].rpartition(":")[2], "test" if m[1].startswith("test") else "compile"))
            yield pd.DataFrame(out, columns=["module", "visible", "relation"])

    return texts.mapInPandas(run, "module string, visible string, relation string").distinct()


def _interpolated(text: str | None, properties: dict[str, str]) -> str:
    """The text with ``${name}`` replaced by properties, which may name others, ten rounds deep."""
    out = text or ""
    for _ in range(10):
        new = re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), out)
        if new == out:
            break
        out = new
    return out


def _maven(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(names by which a module is found, (name, scope) of what it depends on), as ``group:artifact``."""
    root = ET.fromstring(re.sub(r"\sxmlns=\"[^\"]*\"", "", text))
    said = lambda path: (root.findtext(path) or "").strip()
    group, artifact = said("groupId") or said("parent/groupId"), said("artifactId")
    properties = {p.tag: (p.text or "").strip() for p in root.findall("properties/*")}
    properties |= {k: v for k, v in (("project.groupId", group), ("pom.groupId", group), ("project.artifactId", artifact)) if v}
    wanted = []
    for d in root.findall("dependencies/dependency"):
        name = ":".join(_interpolated((d.findtext(k) or "").strip(), properties) for k in ("groupId", "artifactId"))
        wanted.append((name, _interpolated((d.findtext("scope") or "").strip(), properties) or "compile"))
    return [f"{group}:{artifact}"] if group and artifact else [], wanted


def resolved_module_edges(texts: DataFrame) -> DataFrame:
    """(module, visible, relation) between the modules of build files (path, text), by their folders. Maven's are found by group and artifact, with the
    parent's group where a module names none and properties put in; Gradle's by their path or their folder's name. What isn't a module of these files, or
    is the module itself, has no row; a file that can't be read has none. Of a name that several modules have, all are visible."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame.path, frame.text, strict=True):
                folder, _, name = path.rpartition("/")
                if name == "pom.xml":
                    try:
                        names, wanted = _maven(text or "")
                    except ET.ParseError:
                        continue
                    kind = "maven"
                elif name in ("build.gradle", "build.gradle.kts"):
                    kind, names = "gradle", [":" + folder.strip("/").replace("/", ":"), ":" + folder.rpartition("/")[2]]
                    found = re.finditer(r"(\w+)\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?[\"']:?([\w:.-]+)[\"']", text or "")
                    wanted = [(":" + m[2].lstrip(":"), "test" if m[1].startswith("test") else "compile") for m in found]
                else:
                    continue
                out.append((folder, kind, sorted(set(names)), [{"name": n, "relation": r} for n, r in wanted]))
            yield pd.DataFrame(out, columns=["module", "kind", "names", "wanted"])

    parsed = stored(texts.select("path", "text").mapInPandas(run, "module string, kind string, names array<string>, wanted array<struct<name:string,relation:string>>"))
    names = parsed.select(F.col("module").alias("visible"), "kind", F.explode("names").alias("name")).distinct()
    wanted = parsed.select("module", "kind", F.explode("wanted").alias("w")).select("module", "kind", "w.name", "w.relation")
    # a Gradle path may be given from any folder above the module
    return wanted.join(names, ["kind", "name"]).where("module <> visible").select("module", "visible", "relation").distinct()


def classpath_coordinates(texts: DataFrame) -> DataFrame:
    """(path, jar, group, artifact, version) of captured class paths, for JARs in Maven's and Gradle's caches."""
    jars = texts.select("path", F.explode(F.split("text", r"[:;\n]")).alias("jar")).where("jar LIKE '%.jar'")
    maven, gradle = r"/repository/(.+)/([^/]+)/([^/]+)/[^/]+\.jar$", r"/files-2\.1/([^/]+)/([^/]+)/([^/]+)/[^/]+/[^/]+\.jar$"
    of = lambda k: F.coalesce(F.nullif(F.regexp_extract("jar", gradle, k), F.lit("")), F.nullif(F.regexp_extract("jar", maven, k), F.lit("")))
    return jars.select("path", "jar", F.translate(of(1), "/", ".").alias("group"), of(2).alias("artifact"), of(3).alias("version"))


# How a log of history is written: git log --name-status --format='%x01%H%x02%h%x02%an%x02%ae%x02%aI%x02%s'
LOG_MARK, LOG_FIELD = "\x01", "\x02"


def git_log(texts: DataFrame, *, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(commits, commit files) of exported logs, newest first up to ``most`` of each log. Renames count as a change of the
    new path. Commits without files are left out."""
    entries = texts.select("path", F.posexplode(F.split("text", LOG_MARK)).alias("n", "entry")).where(f"n BETWEEN 1 AND {most}")
    head = F.split(F.substring_index("entry", "\n", 1), LOG_FIELD)
    rows = entries.select(head[0].alias("hash"), head[1].alias("short_hash"), head[2].alias("author"), head[3].alias("author_email"), F.try_to_timestamp(head[4]).alias("committed_at"), head[5].alias("message"), F.explode(F.filter(F.slice(F.split("entry", "\n"), 2, 1_000_000), lambda x: F.trim(x) != "")).alias("change"))
    parts = F.split("change", "\t")
    kind = F.substring(parts[0], 1, 1)
    files = rows.select("hash", F.element_at(parts, -1).alias("file_path"), F.when(kind == "A", "ADD").when(kind == "D", "DELETE").when(kind == "R", "RENAME").otherwise("MODIFY").alias("change_type"))
    return rows.drop("change").dropDuplicates(["hash"]), files


# Forms of compiler messages.
DIAGNOSTICS = (
    r"^\[(ERROR|WARNING)\]\s+(.+?):\[(\d+)(?:,(\d+))?\]\s+(.*)$",
    r"^(?:e|w): (?:file://)?(.+?):(\d+):(\d+):? (.*)$",
    r"^(.+?\.(?:java|kt)):(\d+): (error|warning): (.*)$",
)


def diagnostics(lines: DataFrame) -> DataFrame:
    """(severity, file, line, message) of build output lines (value); others are left out."""
    v, (maven, kotlin, javac) = F.col("value"), DIAGNOSTICS
    get = lambda p, k: F.regexp_extract(v, p, k)
    severity = F.when(v.rlike(maven), F.lower(get(maven, 1))).when(v.rlike(kotlin), F.when(v.startswith("e:"), "error").otherwise("warning")).when(v.rlike(javac), get(javac, 3))
    file = F.when(v.rlike(maven), get(maven, 2)).when(v.rlike(kotlin), get(kotlin, 1)).when(v.rlike(javac), get(javac, 1))
    line = F.when(v.rlike(maven), get(maven, 3)).when(v.rlike(kotlin), get(kotlin, 2)).when(v.rlike(javac), get(javac, 2))
    message = F.when(v.rlike(maven), get(maven, 5)).when(v.rlike(kotlin), get(kotlin, 4)).when(v.rlike(javac), get(javac, 4))
    return lines.select(severity.alias("severity"), file.alias("file"), line.cast("int").alias("line"), message.alias("message")).where("severity is not null")


def problems_of(found: DataFrame, *, paths: list[str] | None = None, severity: str | None = None) -> DataFrame:
    """Diagnostics of a severity, and of files equal to a path or ending in it after a slash."""
    if severity:
        found = found.where(F.col("severity") == severity)
    if paths:
        fits = F.lit(False)
        for p in paths:
            fits = fits | (F.col("file") == p) | F.col("file").endswith("/" + p)
        found = found.where(fits)
    return found


def file_inventory(*layers: DataFrame) -> DataFrame:
    """One row for each path (path and any columns): the first layer that has it wins."""
    whole = layers[0].withColumn("layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        whole = whole.unionByName(layer.withColumn("layer", F.lit(k)), allowMissingColumns=True)
    return whole.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("layer"))).where("n = 1").drop("n", "layer")


def class_occurrences(paths: DataFrame) -> DataFrame:
    """(class_name, output_directory, files) of class-file paths: the folder that holds the packages is found by
    common names of output folders."""
    at = r"^(.*?/(?:classes|test-classes|classes/java/main|classes/java/test|classes/kotlin/main))/(?!java/|kotlin/)(.+)\.class$"
    rows = paths.select(F.regexp_extract("path", at, 1).alias("output_directory"), F.translate(F.regexp_extract("path", at, 2), "/", ".").alias("class_name")).where("class_name <> ''")
    return rows.groupBy("class_name", "output_directory").agg(F.count(F.lit(1)).alias("files"))


def worktree_status(changes: DataFrame, *, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes (path, code as in porcelain output) with a status, those wanted, and counts of all by status."""
    code = F.col("code")
    name = F.when(code.isin("DD", "AU", "UD", "UA", "DU", "AA", "UU"), "conflicting").when(code == "??", "untracked").when(F.contains(code, F.lit("D")), "deleted").when(F.contains(code, F.lit("A")), "added").otherwise("modified")
    rows = changes.select("path", name.alias("status"))
    return (rows.where(F.col("status") == status) if status else rows).orderBy("path"), rows.groupBy("status").agg(F.count(F.lit(1)).alias("changes"))
