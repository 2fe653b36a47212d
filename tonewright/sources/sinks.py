"""Writers of dictionary tables, keymaps, match cases and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import fuzzy, keyboards
from tonewright.functions import text as tx
from tonewright.model import PolyphoneTable


def _text(df: DataFrame, header: str, *order: str) -> DataFrame:
    """Lines under a comment line, in order; the comment sorts before all else."""
    body = df.select(F.lit(1).alias("part"), *order, F.col("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("part"), *[F.lit(None).cast(df.schema[o].dataType).alias(o) for o in order], F.lit(header).alias("value"))
    return head.union(body).orderBy("part", *order).select("value")


def char_lines(readings: DataFrame, system: str) -> DataFrame:
    """Lines of a character table, by code point; lists are joined by commas."""
    own = readings.where(F.col("system") == system)
    packed = own.groupBy("cp").agg(F.array_sort(F.collect_list(F.struct("ord", "display", "normalized", "tone", "freq"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("s"))
    joined = lambda f: F.array_join(F.transform("r", lambda x: x[f].cast("string")), ",")
    line = F.concat_ws("\t", F.concat(F.lit("U+"), F.hex("cp")), tx.char_of(F.col("cp")), joined("display"), joined("normalized"), joined("tone"), joined("freq"), F.array_join("s", ","))
    return _text(packed.select("cp", line.alias("value")), "# codepoint\tchar\treadings_display\treadings_normalized\ttones\tfreq\tsources", "cp")


def word_lines(words: DataFrame, system: str) -> DataFrame:
    """Lines of a word table; readings are joined by spaces."""
    r = F.array_join(F.transform("readings", lambda x: x["normalized"]), " ")
    line = F.concat_ws("\t", tx.key_of(F.col("cps")), F.col("text"), r, r, F.coalesce("source", F.lit("")))
    return _text(words.where(F.col("system") == system).select("text", line.alias("value")), "# codepoints\ttext\treadings_display\treadings_normalized\tsource", "text")


def polyphone_lines(spark: SparkSession, table: PolyphoneTable, source: str = "tonewright") -> DataFrame:
    from tonewright.operators.polyphone import entries

    line = F.concat_ws("\t", tx.key_of(F.col("cps")), F.col("text"), F.array_join("readings", ","), F.lit(source))
    return _text(entries(spark, table).select("text", line.alias("value")), "# codepoints\ttext\treadings_normalized\tsource", "text")


def keymap_rows(readings: DataFrame) -> DataFrame:
    """(scheme, syllable, code) of every different Mandarin syllable."""
    s = readings.where("system = 'mandarin'").select("syllable").distinct()
    codes = F.array(*[F.struct(F.lit(n).alias("scheme"), keyboards.shuangpin_code(F.col("syllable"), n).alias("code")) for n in keyboards.SCHEMES])
    return s.select("syllable", F.inline(codes)).where("code IS NOT NULL").select("scheme", "syllable", "code")


def golden_rows(readings: DataFrame, system: str) -> DataFrame:
    """(rule, surface, variants) of every rule of a system over its syllables."""
    s = readings.where(F.col("system") == system).select("syllable").distinct()
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.array_join(F.array_sort(fuzzy.by_name(n)(F.col("syllable"))), ",").alias("variants")) for n in fuzzy.rules_for(system)])
    return s.select(F.col("syllable").alias("surface"), F.inline(each)).select("rule", "surface", "variants")


def write_lines(df: DataFrame, path: str) -> None:
    """One ordered text file: these tables are dictionaries, bounded by the script. Lines are made
    in parallel; only finished ones meet in the task that writes them."""
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    numbered.repartition(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def write_keymaps(readings: DataFrame, path: str) -> None:
    keymap_rows(readings).repartition("scheme").sortWithinPartitions("scheme", "syllable").write.mode("overwrite").partitionBy("scheme").option("sep", "\t").csv(path)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256, rows) of the files below a folder; rows without comments."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    body = F.decode("content", "UTF-8")
    rows = F.size(F.filter(F.split(body, "\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), rows.alias("rows"))


def manifest_json(spark: SparkSession, root: str, **facts) -> str:
    """The manifest as JSON, with further facts beside the files."""
    found = {r.path.rpartition("/")[2]: {"rows": r.rows, "sha256": r.sha256, "bytes": r.bytes} for r in manifest(spark, root).collect()}
    return json.dumps({"schemaVersion": 1, **facts, "files": found}, ensure_ascii=False, indent=1, sort_keys=True)
