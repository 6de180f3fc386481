"""Tables of source files: from directories, from tables of text, and as streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift import schemas
from codesift.functions import patterns as P
from codesift.functions import paths
from codesift.functions.text import normalize_newlines
from codesift.session import new_table_path
from codesift.sources.file_log import FileLog
from codesift.sources.tree import read_texts, walk, with_text

CAP_SALTS = 64


@dataclass(frozen=True)
class Profile:
    """Which files of a repository a scan reads, and what else it checks."""

    name: str
    skip_dirs: tuple[str, ...]
    fold_suffix_case: bool
    max_bytes: int | None
    size_before_cap: bool
    max_files: int | None
    needs_repo_auth: bool
    checks_packages: bool


PROFILES = {
    "directory": Profile(
        "directory", tuple(P.DIRECTORY_SKIP_DIRS), True, None, True, None, True, True
    ),
    "local": Profile(
        "local", tuple(P.SERVICE_SKIP_DIRS), False, P.MAX_FILE_BYTES, True, P.LOCAL_MAX_FILES,
        False, False,
    ),
    "service": Profile(
        "service", tuple(P.SERVICE_SKIP_DIRS), False, P.MAX_FILE_BYTES, False, P.SERVICE_MAX_FILES,
        False, True,
    ),
    "rescan": Profile(
        "rescan", tuple(P.SERVICE_SKIP_DIRS), False, P.MAX_FILE_BYTES, False, P.LOCAL_MAX_FILES,
        False, False,
    ),
}


def repo_listing(
    spark: SparkSession, root: str, repo: str | None = None, skip_dirs: Sequence[str] = ()
) -> DataFrame:
    """Every file and folder below ``root/<repo>/``, hidden ones too, or below ``root`` when ``repo`` names it.

    Nothing is opened. Files directly below a root of several repositories have the repository ``''``. Folders named in
    ``skip_dirs`` are listed and not entered.
    """
    found = walk(spark, root, skip_dirs)
    path = F.col("path")
    if repo is not None:
        place = [F.lit(repo).alias("repo"), path]
    else:
        found = found.filter(F.contains(path, F.lit("/")) | ~F.col("is_dir"))
        place = [F.regexp_extract(path, "^(?:([^/]*)/)?", 1).alias("repo"), F.regexp_replace(path, "^[^/]*/", "").alias("path")]
    return found.select(*place, "is_dir", F.col("length").alias("size_bytes"))


def source_files(
    spark: SparkSession, root: str, repo: str | None = None, profile: Profile | None = None,
    listing: DataFrame | None = None, problems: bool = False,
) -> DataFrame:
    """Source files below ``root/<repo>/``, or below ``root`` when ``repo`` names it.

    Suffixes, skipped folders, sizes and caps are decided on the listing (``repo_listing`` of the same root, walked here
    where none is given), and only the chosen files are opened: contents are never joined or shuffled. Bytes that are not
    UTF-8 are left out. A file that is gone or may not be read by then is left out; with ``problems`` it stays, with null
    ``code`` and its ``problem`` as a further column.
    """
    if listing is None:
        listing = repo_listing(spark, root, repo, profile.skip_dirs if profile else ())
    files = listing.filter(~F.col("is_dir")).select("repo", "path", "size_bytes")
    chosen = select_files(files, profile) if profile else files.filter(paths.language_of(F.col("path")).isNotNull())
    below = F.col("path") if repo is not None else F.ltrim(F.concat_ws("/", "repo", "path"), F.lit("/"))
    read = with_text(chosen.withColumn("_place", below), root, "_place", "size_bytes")
    return _as_source_files(read, problems)


def _as_source_files(read: DataFrame, problems: bool) -> DataFrame:
    columns = [
        "repo", "path", paths.language_of(F.col("path")).alias("language"), "size_bytes",
        normalize_newlines(F.col("code")).alias("code"),
    ]
    return read.select(*columns, "problem") if problems else read.filter("problem IS NULL").select(*columns)


def source_files_stream(
    spark: SparkSession, root: str, log: str, settle_seconds: float = 60, tasks: int | None = None,
    files_per_trigger: int = 16, problems: bool = False,
) -> DataFrame:
    """The same rows for files as they land below ``root/<repo>/``, hidden ones and those directly below ``root`` too.

    ``log`` is a folder for the ``FileLog`` that says what has landed. It is updated here once; ``FileLog(...).follow``
    goes on doing so. A batch reads the files of the entries that were logged since the last one, by ``tasks`` tasks that
    get about the same number of bytes.
    """
    file_log = FileLog(spark, root, log)
    file_log.update(settle_seconds)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    entries = file_log.stream(files_per_trigger)
    spread = entries.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int"))
    read = read_texts(spread.select("path", "length"), root).select(
        F.regexp_extract("path", "^(?:([^/]*)/)?", 1).alias("repo"),
        F.regexp_replace("path", "^[^/]*/", "").alias("path"), F.col("length").alias("size_bytes"), "code", "problem",
    )
    return _as_source_files(read, problems)


def file_table_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Source-file rows from parquet files as they land."""
    return (
        spark.readStream.schema(schemas.SOURCE_FILES)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A table that would be read by fewer tasks than there are cores, dealt out to them; any other as it is.

    A few megabytes can come out as one task (one row group), whose rows may stand for much work.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.isStreaming or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores * 2, *keys)


def text_corpus(
    table: DataFrame, id_col: str, text_col: str, repo_col: str | None = None,
    language: str = "python", suffix: str = ".txt",
) -> DataFrame:
    """Any table of texts in the shape of source files."""
    repo = F.col(repo_col).cast("string") if repo_col else F.lit(text_col)
    used = [id_col, text_col, *([repo_col] if repo_col else [])]
    return spread(table.select(*used), id_col).select(
        repo.alias("repo"),
        F.concat(F.col(id_col).cast("string"), F.lit(suffix)).alias("path"),
        F.lit(language).alias("language"),
        F.octet_length(text_col).cast("long").alias("size_bytes"),
        normalize_newlines(F.col(text_col)).alias("code"),
    )


def _in_scope(files: DataFrame, profile: Profile) -> DataFrame:
    language = paths.language_of(F.col("path"), profile.fold_suffix_case)
    return files.filter(
        language.isNotNull() & ~paths.in_skip_dir(F.col("path"), list(profile.skip_dirs))
    )


def cap_files(paths_table: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows (by path) of each repository.

    Ranked in two steps, within salted parts of a repository and then within it. Spark limits
    ranks before each shuffle up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, which
    ``build_session`` sets above the largest cap, so a hot repository sends few rows anywhere.
    """
    salted = paths_table.withColumn("_salt", F.pmod(F.hash("path"), F.lit(CAP_SALTS)))
    for keys in (["repo", "_salt"], ["repo"]):
        by_path = Window.partitionBy(*keys).orderBy("path")
        salted = (
            salted.withColumn("_rank", F.row_number().over(by_path))
            .filter(F.col("_rank") <= limit)
            .drop("_rank")
        )
    return salted.drop("_salt")


def _cutoffs(paths_table: DataFrame, limit: int) -> DataFrame:
    """The last admitted path of each repository that fills the cap: one small row each."""
    return (
        cap_files(paths_table.select("repo", "path"), limit)
        .groupBy("repo")
        .agg(F.max("path").alias("_last"), F.count("*").alias("_read"))
        .filter(F.col("_read") == limit)
        .select("repo", "_last")
    )


def select_files(files: DataFrame, profile: Profile, listing: DataFrame | None = None) -> DataFrame:
    """The files a profile reads.

    Where the profile caps the number of files, the cap is decided on paths alone
    (``listing`` with ``repo, path, size_bytes``, by default the path columns of
    ``files``). Where the files carry text, the cut-offs, one row per capped repository, are
    written first: their size is then known, and up to the broadcast limit no text is shuffled.
    For directories, ``source_files`` with a profile chooses before anything is opened.
    """
    small = F.col("size_bytes") <= profile.max_bytes if profile.max_bytes else F.lit(True)
    chosen = _in_scope(files, profile).filter(small)
    if profile.max_files is None:
        return chosen
    table = files if listing is None else listing
    keys = _in_scope(table.select("repo", "path", "size_bytes"), profile)
    if profile.size_before_cap:
        keys = keys.filter(small)
    cutoffs = _cutoffs(keys, profile.max_files)
    if "code" in files.columns:
        path = new_table_path(files.sparkSession, "cutoffs")
        cutoffs.write.parquet(path)
        cutoffs = files.sparkSession.read.schema(cutoffs.schema).parquet(path)
    return (
        chosen.join(cutoffs, "repo", "left")
        .filter(F.col("_last").isNull() | (F.col("path") <= F.col("_last")))
        .select(*files.columns)
    )


def scan_scope(files: DataFrame, profile: Profile) -> DataFrame:
    """Per repository: files read and whether the cap cut any off."""
    small = F.col("size_bytes") <= profile.max_bytes if profile.max_bytes else F.lit(True)
    keys = _in_scope(files.select("repo", "path", "size_bytes"), profile)
    if profile.max_files is None:
        return keys.filter(small).groupBy("repo").agg(
            F.count("*").alias("files_scanned"), F.lit(False).alias("truncated")
        )
    if profile.size_before_cap:
        keys = keys.filter(small)
    totals = keys.groupBy("repo").agg((F.count("*") > profile.max_files).alias("truncated"))
    read = cap_files(keys, profile.max_files).groupBy("repo").agg(
        F.count_if(small).alias("files_scanned")
    )
    return totals.join(read, "repo").select("repo", "files_scanned", "truncated")
