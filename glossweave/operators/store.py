"""Lexicon tables on storage: ids, layouts, updates, versioned publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.functions.grams import gram_counts
from glossweave.functions.text import printable_normalised
from glossweave.operators import versions
from glossweave.operators.vectors import fit_vocabulary
from glossweave.session import cut_lineage
from glossweave.sources.lines import FILE_ROWS

ROW_MASK = (1 << 33) - 1
GROUP_ENTRIES = 10_000


def with_entry_ids(df: DataFrame, order: list[str], name: str = "entry_id") -> DataFrame:
    """Consecutive ids 1..n in the given order, without a one-task window.

    The table is range-sorted and materialised once; each task's rows are then
    numbered from an offset worked out on one row per task. The lineage is cut
    because ids must not change if a task is computed again.
    """
    # finding the sort ranges reads the input once more: read it from storage
    placed = cut_lineage(df).orderBy(*order).withColumns(
        {"_task": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}
    )
    fixed = cut_lineage(placed.withColumn("_row", F.col("_id").bitwiseAND(ROW_MASK)))
    sizes = fixed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # one row per sort task: bounded by the number of partitions
    return (
        fixed.join(F.broadcast(offsets), "_task")
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_task", "_id", "_row", "_offset")
    )


def write_lexicon(entries: DataFrame, path: str, order: list[str], ranged: bool = False) -> None:
    """Entries in source order, as Parquet, written once. An entry's id, 1..n, is
    its row in its file after the rows of the files before (`read_lexicon`): the
    files are in order, and a task that runs again writes the same rows. Beside
    them is a table of one row per file, from the files' own counts.

    `ranged` entries come from texts that were split by ranges of the first column
    of `order` (`lexicon.ranged_texts`). They are sorted where they are: finding the
    ranges of the entries themselves would parse every text a second time."""
    spark = entries.sparkSession
    ordered = entries.sortWithinPartitions(*order) if ranged else entries.orderBy(*order)
    ordered.select("word", "definition", "referenced_words", "key").write.mode("errorifexists").parquet(path)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    # one row per sort task: bounded by the number of partitions
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(
        f"{path}/{FILE_ROWS}"
    )


def key_groups(lexicon: DataFrame, max_entries: int = GROUP_ENTRIES) -> DataFrame:
    """(key, part, partition_key, n_entries, word_definitions, vector): the entries
    of each key nested in documents of `max_entries` entries, in entry order;
    entry r of a key is in part r / max_entries, however many there are. All parts
    of a key have the first letter of its first entry as partition key, and the
    key's sparse vector (gram, tf).

    An entry's rank is counted inside a stretch of ids, after the sums of the
    key's stretches before, so no task holds a hot key whole.
    """
    entry = F.struct("entry_id", "word", "definition", "referenced_words")
    staged = lexicon.withColumn("_s", F.floor(F.col("entry_id") / max_entries))
    sums = staged.groupBy("key", "_s").agg(
        F.count("*").alias("_n"), F.min(F.struct("entry_id", "word")).alias("_first")
    )
    before = Window.partitionBy("key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    bases = sums.select(
        "key",
        "_s",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.substring(F.min("_first").over(whole)["word"], 1, 1).alias("partition_key"),
    )
    inside = F.row_number().over(Window.partitionBy("key", "_s").orderBy("entry_id"))
    parted = (
        staged.withColumn("_in", inside)
        .join(bases, ["key", "_s"])
        .withColumn("part", F.floor((F.col("_base") + F.col("_in") - 1) / max_entries))
    )
    return (
        parted.groupBy("key", "part", "partition_key")
        .agg(F.sort_array(F.collect_list(entry)).alias("word_definitions"))
        .select(
            "key",
            "part",
            "partition_key",
            F.size("word_definitions").alias("n_entries"),
            "word_definitions",
            gram_counts(F.col("key")).alias("vector"),
        )
    )


def write_key_groups(lexicon: DataFrame, path: str) -> None:
    """Key groups in folders by first letter of the word, gathered by letter and
    key first, so that a letter is written by few tasks and a large one by many."""
    n = int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_groups(lexicon).repartitionByRange(n, "partition_key", "key", "part").write.mode("errorifexists").partitionBy(
        "partition_key"
    ).parquet(path)


def to_json_payload(lexicon: DataFrame) -> DataFrame:
    """(entry_id, text, description, metadata): references as JSON text."""
    return lexicon.select(
        "entry_id",
        F.col("word").alias("text"),
        F.col("definition").alias("description"),
        F.to_json("referenced_words").alias("metadata"),
    )


def from_json_payload(payload: DataFrame) -> DataFrame:
    return payload.select(
        "entry_id",
        F.col("text").alias("word"),
        F.col("description").alias("definition"),
        F.from_json("metadata", "array<string>").alias("referenced_words"),
    )


def letter_rows(lexicon: DataFrame) -> DataFrame:
    """Rows of the per-letter export, with their sort columns."""
    norm = printable_normalised(F.col("word"))
    first = F.substring(norm, 1, 1)
    # a letter without a capital of its own (ß) stays
    letter = F.when(F.length(F.upper(first)) > 1, first).otherwise(F.upper(first))
    return lexicon.select(
        letter.alias("letter"),
        norm.alias("norm"),
        "entry_id",
        "word",
        "definition",
        F.array_join("referenced_words", "\n").alias("references"),
    )


def export_by_letter(lexicon: DataFrame, path: str) -> None:
    """One CSV folder per first letter, sorted inside. Rows are range-split on
    the whole sort key, so a letter with very many words is written by many
    tasks, in file-name order; one letter is never one task."""
    ordered = letter_rows(lexicon)
    n = int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        ordered.repartitionByRange(n, "letter", "norm", "entry_id")
        .sortWithinPartitions("letter", "norm", "entry_id")
        .select("letter", "word", "definition", "references")
        .write.mode("errorifexists")
        .partitionBy("letter")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def upsert_by_id(target: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Target rows with the changed ids replaced and the new ids added."""
    columns = target.columns
    # of rows that repeat an id the last one counts, by all columns
    last = changes.groupBy(id_col).agg(F.max(F.struct(*columns)).alias("_row")).select("_row.*")
    kept = target.join(last.select(id_col), id_col, "left_anti")
    return kept.select(columns).unionByName(last.select(columns))


def index_on_word(lexicon: DataFrame, path: str, word_col: str = "word") -> None:
    """Parquet range-sorted by word: a lookup by word prunes to few row groups."""
    (
        lexicon.repartitionByRange(word_col)
        .sortWithinPartitions(word_col)
        .write.mode("errorifexists")
        .parquet(path)
    )


def lookup_word(spark: SparkSession, path: str, word: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("word") == word)


# --- versions --------------------------------------------------------------


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """One row: entries, distinct keys and vector size of a lexicon table."""
    keys = lexicon.select("key").where(F.col("key") != "").distinct()
    return (
        lexicon.agg(F.count("*").alias("entries"))
        .crossJoin(keys.agg(F.count("*").alias("number_of_vectors")))
        .crossJoin(fit_vocabulary(keys).agg(F.count("*").alias("vector_size")))
    )


def needs_rebuild(current: DataFrame, target: DataFrame) -> DataFrame:
    """One row `rebuild`: no current version, or another vector size or count
    of keys. Both sides are one-row `lexicon_stats`; `current` may be empty."""
    c = current.agg(
        F.max("number_of_vectors").alias("c_keys"), F.max("vector_size").alias("c_size")
    )
    same = (F.col("c_keys") == F.col("number_of_vectors")) & (
        F.col("c_size") == F.col("vector_size")
    )
    return target.crossJoin(c).select(
        (~F.coalesce(same, F.lit(False))).alias("rebuild")
    )


def publish_version(lexicon: DataFrame, base: str, name: str, keep: int = 1) -> str:
    """Write the lexicon to a folder of its own (named by vector size, key count
    and a run id), check the written count, then commit it as the next version
    and point the view `name` at it. Returns the folder. A failed or short write
    raises and leaves the old version in place; of two publishers at once both
    get a version, one after the other. A version stays readable until `keep`
    newer ones exist: with 2, readers of the version before can finish."""
    spark = lexicon.sparkSession
    stats = lexicon_stats(lexicon).first()
    size = f"{stats.vector_size}_{stats.number_of_vectors}"
    path = f"{base.rstrip('/')}/{name}-{size}-{uuid.uuid4().hex}"
    lexicon.write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path)
    if written.count() != stats.entries:
        raise RuntimeError(f"published table at {path} is incomplete")
    versions.commit(spark, base, name, path, keep)
    written.createOrReplaceTempView(name)
    return path


def current_version(spark: SparkSession, base: str, name: str) -> tuple[int, str] | None:
    """(number, folder) of the version that readers of any session use."""
    return versions.current(spark, base, name)


def published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The current version of a published lexicon."""
    return spark.read.parquet(current_version(spark, base, name)[1])


def rebuild_if_stale(entries: DataFrame, base: str, name: str, order: list[str]) -> bool:
    """Publish `entries` with ids if the current version is missing or differs
    in vector size or count of keys. Returns whether it did."""
    spark = entries.sparkSession
    target = lexicon_stats(entries)
    if current_version(spark, base, name):
        stale = needs_rebuild(lexicon_stats(published(spark, base, name)), target)
        if not stale.first().rebuild:
            return False
    publish_version(with_entry_ids(entries, order), base, name)
    return True
