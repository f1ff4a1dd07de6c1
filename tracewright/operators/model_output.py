"""Rows out of what models write: JSON arrays in free text, rankings that must be well formed, contexts that go into prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ranking import composite_priority

#: The first array of objects in a text, up to the last end of one.
OBJECTS = r"(?s)\[\s*\{.*\}\s*\]"
SCORES = ("surface", "influence", "reachability")


def _kind(v: Column) -> Column:
    """The kind of a variant: BIGINT, BOOLEAN, STRING, OBJECT<...>, ARRAY<...> and so on; null for none."""
    return F.schema_of_variant(v)


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _parsed(text: Column) -> Column:
    """A text that is one JSON value as a variant, or null: Spark's parser alone would stop after the first of several."""
    values = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def findings_in_text(texts: DataFrame) -> DataFrame:
    """(path, item, line, title, cwe, rationale): the objects of the JSON array in each text (path, text), numbered from 0.

    What surrounds the array is ignored; a text without one, and one that isn't JSON, has no rows; elements that
    aren't objects go. A line counts if it's a whole number, or a truth value as 1 or 0.
    """
    found = texts.select("path", _parsed(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), OBJECTS, 0), F.lit(""))).alias("v"))
    rows = found.where(_kind(F.col("v")).startswith("ARRAY")).select("path", F.posexplode(F.col("v").cast("array<variant>")).alias("pos", "x"))
    rows = rows.where(_kind(F.col("x")).startswith("OBJECT")).withColumn("line_kind", _kind(_field(F.col("x"), "line", "variant")))
    line = F.when(F.col("line_kind") == "BIGINT", _field(F.col("x"), "line", "bigint")).when(F.col("line_kind") == "BOOLEAN", _field(F.col("x"), "line", "boolean").cast("bigint"))
    text = lambda c, other: F.coalesce(_field(F.col("x"), c, "string"), F.lit(other))
    return rows.select(
        "path", F.col("pos").alias("item"), line.cast("int").alias("line"), text("title", "model finding").alias("title"), F.nullif(text("cwe", ""), F.lit("")).alias("cwe"),
        text("rationale", "Reported by the model; manual verification required.").alias("rationale"),
    )


def ranking_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused): the rankings of JSON payloads (payload_id, payload), apart from those that are malformed.

    A payload is an array of rankings, or an object that holds it as `rankings`, maybe fenced as code. good: payload_id, path, surface,
    influence, reachability, priority, rationale, boosts (sorted); of a path the last ranking of a payload counts. refused:
    payload_id, item (null for the payload itself), reason. Scores are whole numbers from 1 to 5, truth values none.
    """
    bare = F.regexp_replace(F.trim(F.coalesce("payload", F.lit(""))), r"(?s)^```(?:json)?\s*|\s*```$", "")
    read = payloads.select("payload_id", _parsed(bare).alias("v"))
    held = F.when(_kind(F.col("v")).startswith("OBJECT"), F.try_variant_get("v", "$.rankings", "variant")).otherwise(F.col("v"))
    read = read.withColumn("items", held).withColumn("listed", F.coalesce(_kind(F.col("items")).startswith("ARRAY"), F.lit(False)))
    whole = read.where(~F.col("listed")).select("payload_id", F.lit(None).cast("int").alias("item"), F.lit("ranker response must be a list or object with rankings list").alias("reason"))
    rows = read.where("listed").select("payload_id", F.posexplode(F.col("items").cast("array<variant>")).alias("item", "x"))
    x = F.col("x")
    kind = lambda c: F.coalesce(_kind(_field(x, c, "variant")), F.lit("MISSING"))
    path, rationale = _field(x, "path", "string"), _field(x, "rationale", "string")
    odd = [F.when(~F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False)), F.lit("each ranking item must be an object"))]
    odd.append(F.when((kind("path") != "STRING") | (path == ""), F.lit("ranking item requires non-empty path")))
    odd.append(F.when((kind("rationale") != "MISSING") & ((kind("rationale") != "STRING") | (rationale == "")), F.concat(F.lit("ranking item for "), path, F.lit(" requires rationale"))))
    for c in SCORES:
        wrong = (kind(c) != "BIGINT") | ~F.coalesce(_field(x, c, "bigint").between(1, 5), F.lit(False))
        odd.append(F.when(wrong, F.concat(F.lit("ranking item for "), path, F.lit(f" requires integer {c} from 1 to 5"))))
    odd.append(F.when((kind("static_boosts") != "MISSING") & ~kind("static_boosts").startswith("ARRAY"), F.concat(F.lit("ranking item for "), path, F.lit(" has invalid static_boosts"))))
    checked = rows.withColumn("reason", F.coalesce(*odd))
    boosts = F.coalesce(F.array_sort(_field(x, "static_boosts", "array<string>")), F.expr("cast(array() as array<string>)"))
    good = checked.where("reason is null").select("payload_id", "item", path.alias("path"), *[_field(x, c, "int").alias(c) for c in SCORES], F.coalesce(rationale, F.lit("model ranking")).alias("rationale"), boosts.alias("boosts"))
    last = good.groupBy("payload_id", "path").agg(F.max_by(F.struct(*SCORES, "rationale", "boosts"), "item").alias("r")).select("payload_id", "path", "r.*")
    return last.withColumn("priority", composite_priority(*map(F.col, SCORES))), whole.unionByName(checked.where("reason is not null").select("payload_id", "item", "reason"))


def source_contexts(targets: DataFrame, most: int = 6000) -> DataFrame:
    """(path, context): the head of each file's text under its path; files without text have none. The limit is what a prompt may hold."""
    rows = targets.where("coalesce(text, '') <> ''")
    return rows.select("path", F.concat(F.lit("[repo_code] "), "path", F.lit("\n"), F.substring("text", 1, most)).alias("context"))
