"""P001: imports of packages the registry does not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions import paths
from codesift.functions.imports import ecosystem_of, normalize_package, package_of, raw_import
from codesift.functions.text import split_lines, strip
from codesift.operators.nesting import nearest_marked
from codesift.session import written_table

IMPORT_HINT = "import|require|from"


def is_migration(path: Column) -> Column:
    return F.array_contains(paths.parts(path), "migrations") & (paths.suffix(path) == ".py")


def import_of(line: Column, language: Column) -> Column:
    """(ecosystem, package) that a line imports; null without one, for built-in modules and for path aliases."""
    module = raw_import(line, language)
    package = package_of(module, language)
    # Python compares the top-level name with the standard library, JavaScript the whole module.
    builtin = F.when(language == "python", package.isin(P.PYTHON_STDLIB)).otherwise(module.isin(P.JS_BUILTINS))
    alias_path = (language != "python") & module.startswith("@/")
    found = F.struct(ecosystem_of(language).alias("ecosystem"), package.alias("package"))
    return F.when((module != "") & ~builtin & ~alias_path, found)


def import_lines(files: DataFrame) -> DataFrame:
    """One row per import line, built-in modules left out. No shuffle: all of it is per file."""
    language = F.col("language")

    def read(line: Column, index: Column) -> Column:
        found = import_of(line, language)
        return F.when(
            found.isNotNull(),
            F.struct(
                found["ecosystem"].alias("ecosystem"), found["package"].alias("package"),
                (index + 1).alias("line_no"), strip(line).alias("line"),
            ),
        )

    found = F.array_compact(F.transform(split_lines(F.col("code")), read))
    return (
        files.filter(F.col("code").rlike(IMPORT_HINT))
        .select("repo", "path", "language", F.explode_outer(found).alias("found"))
        .filter(F.col("found").isNotNull())
        .select("repo", "path", "language", "found.*")
    )


def distinct_imports_per_file(imports: DataFrame) -> DataFrame:
    """First line of each package in each file."""
    return (
        imports.groupBy("repo", "path", "language", "ecosystem", "package")
        .agg(F.min(F.struct("line_no", "line")).alias("first"))
        .select("repo", "path", "language", "ecosystem", "package", "first.*")
    )


def drop_aliased(imports: DataFrame) -> DataFrame:
    """Drop Python imports known to install under another name (a fixed set, so no join)."""
    names = list(P.IMPORT_ALIASES)
    aliased = F.col("package").isin(names) | F.lower("package").isin(names)
    return imports.filter((F.col("ecosystem") != "pypi") | ~aliased)


def fresh_registry(registry: DataFrame, as_of: Column, max_age: int = P.REGISTRY_TTL_SECONDS) -> DataFrame:
    """Newest entry per package, unless it is older than ``max_age`` seconds."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    return (
        registry.groupBy("ecosystem", "name")
        .agg(F.max(F.struct("checked_at", "exists")).alias("newest"))
        .select("ecosystem", "name", "newest.*")
        .filter(age <= max_age * 1_000_000)
    )


def missing_imports(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """Imports whose package the registry reports as absent; unknown packages count as present."""
    absent = registry.filter(~F.col("exists")).select(
        "ecosystem", F.col("name").alias("registry_name")
    ).distinct()
    named = imports.withColumn(
        "registry_name", normalize_package(F.col("package"), F.col("ecosystem"))
    )
    return named.join(absent, ["ecosystem", "registry_name"], "left_semi").drop("registry_name")


def marked_dirs(listing: DataFrame) -> DataFrame:
    """Directories that hold a project marker (a file or directory such as ``.git``)."""
    path = F.col("path")
    pieces = F.concat(F.lit("/"), path, F.lit("/"))
    marker_dir = F.when(
        paths.file_name(path).isin(P.ROOT_MARKERS), paths.directory_of(path)
    ).when(F.contains(pieces, F.lit("/.git/")), F.regexp_extract(path, r"^(?:(.*?)/)?\.git(?:/|$)", 1))
    return (
        listing.select("repo", marker_dir.alias("ancestor"))
        .filter(F.col("ancestor").isNotNull())
        .distinct()
    )


def source_dirs(listing: DataFrame) -> DataFrame:
    """(repo, dir) of the listed files. Only paths are read, never file contents."""
    return listing.select("repo", paths.directory_of(F.col("path")).alias("dir")).distinct()


def project_roots(listing: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(repo, dir, root): nearest marked directory at or above each of ``dirs`` (all of the listing), ten levels at most."""
    dirs = source_dirs(listing) if dirs is None else dirs
    return nearest_marked(dirs, marked_dirs(listing), P.MAX_ANCESTORS)


def existing_modules(places: DataFrame, listing: DataFrame) -> DataFrame:
    """Those of ``places`` (repo, place: a path without suffix) where the listing has a ``.py`` file or a directory.

    A directory need not be listed itself: it is there if any path lies below it. Places and paths are put in order, and
    the path that follows ``place/`` lies below it or nothing does; so no path is taken apart into its parents.
    """
    path = F.col("path")
    modules = listing.filter(~F.col("is_dir") & path.endswith(".py")).select(
        "repo", F.regexp_replace(path, r"\.py$", "").alias("place")
    )
    files = places.join(modules, ["repo", "place"], "left_semi")
    listed = F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(path)
    keys = listing.select("repo", listed.alias("key"), F.lit(None).cast("string").alias("place")).unionByName(
        places.select("repo", F.concat("place", F.lit("/")).alias("key"), "place")
    )
    # A repository is split by its top folders; what begins with a place lies in the same one.
    from_below = Window.partitionBy("repo", F.substring_index("key", "/", 1)).orderBy(
        F.desc("key"), F.col("place").isNotNull()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.last(F.when(F.col("place").isNull(), F.col("key")), ignorenulls=True).over(from_below)
    folders = keys.withColumn("following", following).filter(
        F.col("place").isNotNull() & F.startswith("following", F.col("key"))
    )
    return files.unionByName(folders.select("repo", "place")).distinct()


def drop_local_packages(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """Drop imports of a module at the project root or beside the importing file (where a project root exists).

    ``imports`` are written once. Of the listing only repositories that import something are looked at.
    """
    imports = written_table(imports, "imports")
    listing = listing.join(imports.select("repo").distinct(), "repo", "left_semi")
    with_dir = imports.withColumn("dir", paths.directory_of(F.col("path")))
    roots = project_roots(listing, with_dir.select("repo", "dir").distinct())
    rooted = with_dir.join(roots, ["repo", "dir"], "left").withColumn(
        # A name that is itself a path names no module of the project.
        "places", F.when(
            F.col("root").isNotNull() & ~F.contains("package", F.lit("/")),
            F.array(*[F.ltrim(F.concat(place, F.lit("/"), F.col("package")), F.lit("/")) for place in ("root", "dir")]),
        ),
    )
    rooted = written_table(rooted, "rooted-imports")
    places = rooted.select("repo", F.explode("places").alias("place")).distinct()
    local = existing_modules(places, listing)
    for number in range(2):
        at = local.withColumnRenamed("place", f"_place{number}")
        rooted = rooted.withColumn(f"_place{number}", F.get("places", F.lit(number))).join(
            at, ["repo", f"_place{number}"], "left_anti"
        )
    return rooted.select(*imports.columns)


def scanned_imports(files: DataFrame) -> DataFrame:
    """The imports that P001 looks at: those of migrations are left out."""
    return import_lines(files.filter(~is_migration(F.col("path"))))


def unknown_imports(imports: DataFrame, registry: DataFrame, listing: DataFrame) -> DataFrame:
    """P001 findings. The registry filter comes first: it leaves few rows, and few repositories, for the rest."""
    missing = drop_aliased(missing_imports(imports, registry))
    first = distinct_imports_per_file(drop_local_packages(missing, listing))
    return first.select(
        "repo", "path", "language", "line_no",
        F.lit("P001").alias("rule_id"),
        F.lit("high").alias("severity"),
        F.col("ecosystem").alias("variant"),
        F.col("package").alias("evidence"),
        "line",
    )


def unknown_packages(files: DataFrame, registry: DataFrame, listing: DataFrame) -> DataFrame:
    """P001 findings of files."""
    return unknown_imports(scanned_imports(files), registry, listing)
