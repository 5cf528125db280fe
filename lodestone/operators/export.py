"""Export: sections with their fields, character budgets, and text, Markdown and JSON of them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import attribute, graphemes, table_cell, title_case
from lodestone.sources.store import Files, opened, stored


@dataclass(frozen=True)
class Preset:
    name: str
    budget: int
    tags: bool = False
    #: What an export's head calls it, and what its JSON does.
    title: str = ""
    model: str = ""


# The character budgets that exports are measured against, and the names of their readers.
PRESETS = {p.name: p for p in (Preset("claude", 240_000, True, "Claude (Anthropic)", "claude"), Preset("gpt", 320_000, False, "GPT (OpenAI)", "gpt"), Preset("gemini", 800_000, False, "Gemini (Google)", "gemini"), Preset("local", 24_000, False, "Local (Llama / Mistral / Qwen)", "localModel"))}
#: Formats with their names and file extensions.
NAMES = {"text": ("Plain text", "txt"), "json": ("JSON", "json"), "markdown": ("Markdown", "md")}
RULE = "\u2500" * 61
_NOTE = "This export is ~{n} characters, exceeding the suggested budget for {title} (~{budget}). Consider splitting."
#: The key of the parts that stand before and behind all sections.
HEAD, FOOT = "", "~"


def register_preset(name: str, budget: int, tags: bool = False, title: str = "") -> Preset:
    PRESETS[name] = Preset(name, budget, tags, title or name, name)
    return PRESETS[name]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.name, p.budget) for p in PRESETS.values()], "preset string, budget long")


def sections(df: DataFrame, tag: str, title: Column, order: Column, fields: Sequence[str]) -> DataFrame:
    """(ord, tag, title, fields): a section for each row, its fields in the given order."""
    parts = [F.struct(F.lit(f).alias("key"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields]
    return df.select(order.alias("ord"), F.lit(tag).alias("tag"), title.alias("title"), F.array(*parts).alias("fields"))


def field_rows(found: DataFrame) -> DataFrame:
    return found.select("ord", "tag", "title", F.posexplode("fields").alias("pos", "f")).select("ord", "tag", "title", "pos", F.col("f.key").alias("key"), F.col("f.value").alias("value"))


def as_text(found: DataFrame) -> DataFrame:
    lines = F.concat_ws("\n", F.concat(F.upper("tag"), F.lit(": "), F.col("title")), F.array_join(F.transform("fields", lambda f: F.concat(F.lit("  "), f["key"], F.lit(": "), f["value"])), "\n"))
    return found.select("ord", lines.alias("body"))


def as_markdown(found: DataFrame, preset: Preset) -> DataFrame:
    head = F.concat(F.lit("<"), F.col("tag"), F.lit(' title="'), attribute(F.col("title")), F.lit('">')) if preset.tags else F.concat(F.lit("## "), title_case(F.col("tag")), F.lit(": "), F.col("title"))
    rows = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("| "), table_cell(f["key"]), F.lit(" | "), table_cell(f["value"]), F.lit(" |"))), "\n")
    parts = [head, F.lit("| Key | Value |\n| --- | --- |"), rows] + ([F.concat(F.lit("</"), F.col("tag"), F.lit(">"))] if preset.tags else [])
    return found.select("ord", F.concat_ws("\n", *parts).alias("body"))


def as_json(found: DataFrame) -> DataFrame:
    return found.select("ord", F.to_json(F.struct("fields", F.col("tag").alias("kind"), "title"), {"pretty": "true"}).alias("body"))


FORMATS = {"text": lambda found, preset: as_text(found), "markdown": as_markdown, "json": lambda found, preset: as_json(found)}


def export(found: DataFrame, kind: str = "markdown", preset: str = "claude") -> DataFrame:
    """(ord, body) of sections in one of the registered formats."""
    return FORMATS[kind](found, PRESETS[preset])


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON in lines, with its names in order."""
    return text.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, indent=2, separators=(",", " : ")) if t is not None else None)


def _iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def heads(found: DataFrame, identity: DataFrame, preset: Preset, secrets: bool) -> DataFrame:
    """(path, version, format, timestamp, kind, origin, n, redacted, model, title) of the sections of each archive of identity; n counts sections."""
    counts = found.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("n"))
    rows = identity.join(counts, F.col("path") == F.col("_path"), "left")
    return rows.select("path", "version", "format", _iso(F.col("timestamp")).alias("timestamp"), "kind", "origin", F.coalesce("n", F.lit(0)).alias("n"), F.lit(str(not secrets).lower()).alias("redacted"), F.lit(preset.model).alias("model"), F.lit(preset.title).alias("title"))


def _lines(rows: list[tuple[str, Column]], before: str, between: str, after: str) -> Column:
    """A line for each (name, value) whose value is there."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{before}{name}{between}"), value.cast("string"), F.lit(f"{after}\n")), F.lit("")) for name, value in rows])


_FACTS = (("Controller version", "version"), ("Backup format", "format"), ("Backup timestamp", "timestamp"), ("Backup kind", "kind"), ("Origin", "origin"), ("Selection count", "n"))


def _text_head(secrets: bool, name: str, producer: str) -> Column:
    facts = [(f"{n:<19}", F.col(c)) for n, c in (*_FACTS, ("Target model", "title"), ("Redacted", "redacted"))]
    top = F.lit(f"{name.upper()} EXPORT\n{'=' * len(name + ' EXPORT')}\n")
    warning = "\n\u26a0  This export INCLUDES secrets (WPA keys, admin hashes, RADIUS,\n   TOTP). Do not share.\n" if secrets else ""
    return F.concat(top, _lines(facts, "", ": ", ""), F.lit(warning + "\n"))


def _text_section() -> Column:
    lines = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("  "), f["key"], F.lit(": "), f["value"], F.lit("\n"))), "")
    return F.concat(F.lit(RULE + "\n"), F.upper("tag"), F.lit(": "), F.col("title"), F.lit("\n" + RULE + "\n"), lines, F.lit("\n"))


def _markdown_head(secrets: bool, name: str, producer: str) -> Column:
    warning = "> \u26a0 **This export INCLUDES secrets** (WPA keys, admin hashes, RADIUS shared secrets, TOTP). Do not share.\n\n" if secrets else ""
    facts = [("Produced by", F.lit(producer)), ("Target model", F.col("title")), *((n, F.col(c)) for n, c in _FACTS), ("Redacted", F.col("redacted"))]
    return F.concat(F.lit(f"# {name} Export\n\n{warning}| Field | Value |\n|---|---|\n"), _lines(facts, "| ", " | ", " |"), F.lit("\n"))


def _markdown_section(preset: Preset) -> Column:
    tag, title = F.col("tag"), F.col("title")
    top = F.concat(F.lit("<"), tag, F.lit(' title="'), attribute(title), F.lit('">\n\n')) if preset.tags else F.concat(F.lit("## "), title_case(tag), F.lit(": "), title, F.lit("\n\n"))
    rows = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("| "), f["key"], F.lit(" | "), table_cell(f["value"]), F.lit(" |\n"))), "")
    table = F.when(F.size("fields") > 0, F.concat(F.lit("| Key | Value |\n|---|---|\n"), rows, F.lit("\n"))).otherwise("")
    end = F.concat(F.lit("</"), tag, F.lit(">\n\n")) if preset.tags else F.lit("")
    return F.concat(top, table, F.lit("```json\n"), pretty_json("raw"), F.lit("\n```\n\n"), end)


def _json_head(secrets: bool, name: str, producer: str) -> Column:
    facts = {"format": "format", "kind": "kind", "origin": "origin", "redacted": "redacted", "selectionCount": "n", "targetModel": "model", "timestamp": "timestamp", "version": "version"}
    quoted = lambda c: F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1 << 30)
    value = lambda c: F.col(c).cast("string") if c in ("redacted", "n") else F.when(F.col(c).isNotNull(), F.regexp_replace(quoted(c), r"\}$", ""))
    rows = {k: value(c) for k, c in facts.items()} | {"includesSecretsWarning": F.lit(str(secrets).lower()), "producedBy": F.lit(json.dumps(producer))}
    lines = [F.concat(F.lit(f'    "{k}" : '), rows[k]) for k in sorted(rows)]
    return F.concat(F.lit('{\n  "header" : {\n'), F.concat_ws(",\n", *lines), F.lit('\n  },\n  "sections" : ['))


def _json_section() -> Column:
    body = F.to_json(F.struct("fields", F.col("tag").alias("kind"), F.parse_json("raw").alias("raw"), "title"))
    return F.concat(F.lit("\n    "), F.replace(pretty_json(body), F.lit("\n"), F.lit("\n    ")))


def whole(found: DataFrame, identity: DataFrame, kind: str = "markdown", preset: str = "claude", secrets: bool = False, name: str = "Backup", producer: str = "lodestone") -> DataFrame:
    """(path, key, text): the parts of each archive's export in one of the formats, whose texts in the order of key are all of it.

    found (path, key, tag, title, fields, raw) are sections, identity (path, version, format, timestamp, kind, origin) has an archive for each
    export; one without sections is a head alone. The last part is a note, empty unless the export has more characters (as a reader
    counts them) than the preset's budget. An export of any size is rows: no cell and no task holds a whole one.
    """
    p = PRESETS[preset]
    head, section = {"text": (_text_head, _text_section), "markdown": (_markdown_head, lambda: _markdown_section(p)), "json": (_json_head, _json_section)}[kind]
    tops = heads(found, identity, p, secrets).select("path", F.lit(HEAD).alias("key"), head(secrets, name, producer).alias("text"))
    body = section()
    if kind == "json":  # a comma before each but the first
        first = found.groupBy(F.col("path").alias("_path")).agg(F.min("key").alias("_first"))
        found = found.join(first, F.col("path") == F.col("_path"))
        body = F.concat(F.when(F.col("key") > F.col("_first"), F.lit(",")).otherwise(""), body)
    parts = tops.unionByName(found.select("path", "key", body.alias("text")))
    if kind == "json":
        end = heads(found, identity, p, secrets).select("path", F.lit(FOOT).alias("key"), F.when(F.col("n") > 0, "\n  ]\n}").otherwise("\n\n  ]\n}").alias("text"))
        return parts.unionByName(end)
    n = F.col("n").cast("string")
    note = _NOTE.format(n="{n}", title=p.title, budget=p.budget).partition("{n}")
    text = F.concat(F.lit("\n[note] " if kind == "text" else "\n> \u26a0 "), F.lit(note[0]), n, F.lit(note[2] + "\n"))
    sums = parts.groupBy("path").agg(F.sum(graphemes(F.col("text")).cast("long")).alias("n"))
    return parts.unionByName(sums.select("path", F.lit(FOOT).alias("key"), F.when(F.col("n") > p.budget, text).otherwise("").alias("text")))


def lengths(parts: DataFrame, preset: str = "claude") -> DataFrame:
    """(path, n, over) of whole(): the characters of each export as a reader counts them, and whether they go beyond the preset's budget."""
    return parts.groupBy("path").agg(F.sum(graphemes(F.col("text")).cast("long")).alias("n")).withColumn("over", F.col("n") > PRESETS[preset].budget)


def preview(parts: DataFrame, most: int = 2000) -> DataFrame:
    """(path, text): the beginning of each export of whole(), of which no more parts are put together than it needs."""
    size = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("path").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = parts.withColumn("_before", size).filter(F.col("_before") < most)
    listed = F.sort_array(F.collect_list(F.struct("key", F.substring("text", 1, most).alias("text"))))  # parts are never empty but the last, so there are most at most
    return some.groupBy("path").agg(F.substring(F.array_join(F.transform(listed, lambda x: x["text"]), ""), 1, most).alias("text"))


def hint(parts: DataFrame, preset: str = "claude") -> DataFrame:
    """(path, hint): what each export of whole() takes of the preset's budget, in words."""
    p = PRESETS[preset]
    return lengths(parts, preset).select("path", F.concat(F.lit(f"Budget for {p.title}: ~{p.budget} characters. Current: "), F.col("n").cast("string"), F.lit(" characters.")).alias("hint"))


def suggested_name(identity: DataFrame, kind: str, secrets: bool = False, day: Column | None = None, base: str = "backup") -> DataFrame:
    """(path, name): a file name for each archive's export, with the day, the version if it is known, and a warning if it has secrets."""
    stamp = F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd")
    version = F.coalesce(F.concat(F.lit("-v"), "version"), F.lit(""))
    return identity.select("path", F.concat(F.lit(f"{base}-"), stamp, version, F.lit(("-INCLUDES-SECRETS" if secrets else "") + "." + NAMES[kind][1])).alias("name"))


def _ordered(parts: DataFrame) -> DataFrame:
    return parts.repartition("path").sortWithinPartitions("path", "key").select("path", "text")


def digests(parts: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of each export of whole(), hashed as its parts stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, n = None, None, 0
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                if path != now:
                    if h is not None:
                        yield pd.DataFrame({"path": [now], "sha256": [h.hexdigest()], "bytes": [n]})
                    now, h, n = path, hashlib.sha256(), 0
                data = text.encode()
                h.update(data)
                n += len(data)
        if h is not None:
            yield pd.DataFrame({"path": [now], "sha256": [h.hexdigest()], "bytes": [n]})

    return _ordered(parts).mapInPandas(run, "path string, sha256 string, bytes long")


def save(parts: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Writes each export of whole() to a file of folder, by names (path, name); (path, file, bytes) of what is there.

    Each attempt of a task writes files of its own, part by part, through Hadoop's file systems or the local one; the job's result names the
    attempts that succeeded, and only those files get their final names, so that a repeated or late attempt changes nothing. Names
    that two paths share get a number behind them, so that no file is overwritten.
    """
    spark = parts.sparkSession
    files, stage = Files(spark, folder), f"{folder.rstrip('/')}/_attempts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, mine = opened(stage), f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        now, out, at, n, k = None, None, None, 0, 0
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                if path != now:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame({"path": [now], "attempt": [at], "bytes": [n]})
                    now, at, n, k = path, f"{mine}-{k}", 0, k + 1
                    out = store(at)
                data = text.encode()
                out.write(data)
                n += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [now], "attempt": [at], "bytes": [n]})

    told = stored(_ordered(parts).mapInPandas(run, "path string, attempt string, bytes long"), "exports")
    again = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    placed = names.withColumn("k", again).select("path", F.when(F.col("k") == 1, F.col("name")).otherwise(F.regexp_replace("name", r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1-"), F.col("k").cast("string"), F.lit("$2")))).alias("file"))
    final = stored(told.join(placed.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path")).select("path", "attempt", "file", "bytes"), "export-files")
    for row in final.select("attempt", "file").toLocalIterator():  # names only, a partition at once
        files.rename(f"{stage}/{row['attempt']}", f"{folder.rstrip('/')}/{row['file']}")
    files.delete(stage)
    return final.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("file"), "bytes")


def over_budget(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(preset, budget, total, over) of sizes (n)."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return presets(spark).join(F.broadcast(total)).select("preset", "budget", "total", (F.col("total") > F.col("budget")).alias("over"))
