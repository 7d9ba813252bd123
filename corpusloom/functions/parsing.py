"""Parsers of model responses as column expressions and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Labels of a labelled summary and the section that each opens.
LABELS = {
    "title": "title",
    "abstract": "abstract",
    "key points": "bullets",
    "key_points": "bullets",
    "bullets": "bullets",
    "open questions": "open_questions",
    "open_questions": "open_questions",
    "source snippets": "snippets",
    "source_snippets": "snippets",
    "snippets": "snippets",
    "confidence": "confidence",
}
SUMMARY = "struct<title:string,abstract:string,bullets:array<string>,open_questions:array<string>,confidence:string>"
ITEM_TYPES = T.EVIDENCE + T.ENTITIES + T.WORK


def json_body(raw: Column) -> Column:
    """The JSON object in a response: without code fences, or from the first to the last brace; null if there is none."""
    bare = T.strip(F.regexp_replace(F.regexp_replace(T.strip(raw), r"\A```[^\n]*\n", ""), r"\n```[^\n]*\z", ""))
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner))


def sections(raw: Column) -> Column:
    """Lines of a labelled summary as array<struct<section, line>>; lines before the first label have no section."""
    lines = F.split(T.newlines(T.strip(raw)), "\n")
    init = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<section:string,line:string>>").alias("all"))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])

    def step(a: Column, line: Column) -> Column:
        label = F.trim(F.lower(F.regexp_extract(line, r"\A[ \t]*([A-Za-z_ ]{3,30})[ \t]*:", 1)))
        section = F.element_at(known, label)
        rest = T.strip(F.regexp_extract(line, r"\A[^:]*:(.*)\z", 1))
        now = F.coalesce(section, a["now"])
        value = F.when(section.isNotNull(), rest).otherwise(line)
        return F.struct(now.alias("now"), F.when(now.isNotNull(), F.concat(a["all"], F.array(F.struct(now.alias("section"), value.alias("line"))))).otherwise(a["all"]).alias("all"))

    return F.aggregate(lines, init, step)["all"]


def with_summary(df: DataFrame, raw: str, name: str = "summary") -> DataFrame:
    """df with a struct<payload, structured_valid>: a response read as JSON, else as labelled sections, else as plain text whose
    list items are its bullets.  A null response is read as an empty one.

    The JSON body, the sections and the lines are columns of their own, so each is worked out once a row.
    """
    raw_col = F.coalesce(F.col(raw), F.lit(""))
    df = df.withColumn("_body", json_body(raw_col))
    df = df.withColumn("_read", F.from_json("_body", "title string, abstract string, bullets array<string>, open_questions array<string>, confidence string"))
    df = df.withColumn("_parts", F.when(F.col("_body").isNull(), sections(raw_col)))
    empty = F.array().cast("array<string>")
    by_section = F.transform(
        F.array(*[F.lit(x) for x in ("title", "abstract", "bullets", "open_questions", "confidence")]),
        lambda n: F.filter(F.transform(F.filter(F.coalesce("_parts", F.array().cast("array<struct<section:string,line:string>>")), lambda x: x["section"] == n), lambda x: T.strip(x["line"])), lambda x: x != ""),
    )
    df = df.withColumn("_by", by_section)
    df = df.withColumn("_lines", F.when(F.col("_body").isNull() & (F.size("_parts") == 0), F.filter(F.transform(F.split(T.newlines(raw_col), "\n"), T.strip), lambda x: x != "")).otherwise(empty))
    level = lambda c: F.when(F.lower(c).isin("low", "medium", "high"), F.lower(c)).otherwise("medium")

    def payload(title: Column, abstract: Column, bullets: Column, questions: Column, confidence: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"),
            F.coalesce(abstract, F.lit("")).alias("abstract"),
            F.coalesce(bullets, empty).alias("bullets"),
            F.coalesce(questions, empty).alias("open_questions"),
            confidence.alias("confidence"),
        )

    read, at = F.col("_read"), lambda i: F.element_at("_by", i)
    as_json = payload(read["title"], read["abstract"], read["bullets"], read["open_questions"], level(F.coalesce(read["confidence"], F.lit("medium"))))
    items = lambda i: F.filter(F.transform(at(i), T.bare_item), lambda x: ~T.is_placeholder(x))
    first_word = F.element_at(F.split(F.concat(F.array_join(at(5), " "), F.lit(" medium")), " +"), 1)
    labelled = payload(F.array_join(at(1), " "), F.array_join(at(2), " "), items(3), items(4), level(F.coalesce(F.nullif(first_word, F.lit("")), F.lit("medium"))))
    listed = F.transform(F.filter("_lines", lambda x: x.rlike(rf"\A(?:[-*]|[0-9]+[.)])[{T.SPACE}]")), T.bare_item)
    plain = payload(F.lit("Untitled"), F.coalesce(F.try_element_at("_lines", F.lit(1)), F.lit("")), listed, empty, F.lit("low"))
    has_body, has_parts = F.col("_body").isNotNull(), F.size("_parts") > 0
    value = F.struct(F.when(has_body, as_json).when(has_parts, labelled).otherwise(plain).alias("payload"), (has_body | has_parts).alias("structured_valid"))
    return df.withColumn(name, value).drop("_body", "_read", "_parts", "_by", "_lines")


def tagged_lines(df: DataFrame, raw: str, preset: str = "research", source: str | None = None, max_chars: int = 240) -> DataFrame:
    """Items of tagged lines: df's other columns and (line_no, kind, problem, text, entity_type, url, attributes, snippet,
    char_start, char_end, source_support).

    `TYPE | text | snippet`, `ENTITY | type | name | attributes | snippet` and `LINK | address | label | snippet`; a line
    without | is none.  problem is null, `invalid` (unknown type, too few fields, no text) or `unsupported_type` (not in the
    preset).  A snippet counts as verified if it stands in the source as it is.
    """
    allowed = T.PRESETS[preset]
    keep = [c for c in df.columns if c != raw]
    source_col = F.col(source) if source else F.lit("")
    rows = df.select(*keep, F.posexplode(F.split(T.newlines(F.coalesce(F.col(raw), F.lit(""))), "\n")).alias("_i", "_line"), source_col.alias("_source"))
    rows = rows.withColumn("_line", T.strip(F.col("_line"))).where(F.col("_line").contains("|"))
    rows = rows.withColumn("_p", F.transform(F.split("_line", r"\|"), T.strip))
    part = lambda i: F.coalesce(F.try_element_at("_p", F.lit(i)), F.lit(""))
    n = F.size("_p")
    kind = F.replace(F.lower(part(1)), F.lit("-"), F.lit("_"))
    entity, link = F.col("kind") == "entity", F.col("kind") == "link"
    rows = rows.withColumn("kind", kind)
    fields = F.when(entity | link, n >= 3).otherwise(n >= 2)
    url = F.when(link, T.collapse(part(2)))
    text = F.when(entity, T.collapse(part(3))).when(link, F.coalesce(F.nullif(T.collapse(part(3)), F.lit("")), url)).otherwise(T.collapse(part(2)))
    snippet = T.collapse(F.when(entity, part(5)).when(link, part(4)).otherwise(part(3)))
    rows = rows.withColumn("text", text).withColumn("_snippet", snippet)
    problem = (
        F.when(~F.col("kind").isin(*ITEM_TYPES), "invalid").when(~F.col("kind").isin(*allowed), "unsupported_type").when(~fields | (F.col("text") == ""), "invalid")
    )
    at = F.when(F.length("_snippet") <= max_chars, T.find(F.col("_source"), F.col("_snippet")))
    rows = rows.withColumn("_at", at)
    return rows.select(
        *keep,
        (F.col("_i") + 1).alias("line_no"),
        "kind",
        problem.alias("problem"),
        "text",
        F.when(entity, F.coalesce(F.nullif(T.snake(part(2)), F.lit("")), F.lit("other"))).alias("entity_type"),
        url.alias("url"),
        F.when(entity, T.attributes(part(4))).alias("attributes"),
        F.when(F.col("_at").isNotNull(), F.col("_snippet")).alias("snippet"),
        F.col("_at").cast("int").alias("char_start"),
        (F.col("_at") + F.length("_snippet")).cast("int").alias("char_end"),
        F.when(F.col("_at").isNotNull(), "snippet_verified").otherwise("chunk_only").alias("source_support"),
    )


def snippet_candidates(lines: Column) -> Column:
    """`TEXT:`/`REASON:` lines as array<struct<text, reason>>: a text goes on over lines until its reason; without quotes
    around it; placeholders are none."""
    kind = "array<struct<text:string,reason:string>>"
    init = F.struct(F.lit(None).cast("string").alias("text"), F.lit("").alias("reason"), F.array().cast(kind).alias("all"))

    def closed(a: Column) -> Column:
        clean = F.regexp_replace(T.strip(F.coalesce(a["text"], F.lit(""))), r"\A[\"']+|[\"']+\z", "")
        return F.when(T.is_placeholder(clean), a["all"]).otherwise(F.concat(a["all"], F.array(F.struct(clean.alias("text"), a["reason"].alias("reason")))))

    def step(a: Column, raw: Column) -> Column:
        line = T.bare_item(raw)
        opens, why = F.upper(line).startswith("TEXT:"), F.upper(line).startswith("REASON:")
        rest = T.strip(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1))
        goes_on = a["text"].isNotNull() & (a["reason"] == "")
        return F.struct(
            F.when(line == "", a["text"]).when(opens, rest).when(why, F.coalesce(a["text"], F.lit(""))).when(a["text"].isNull(), line).when(goes_on, T.strip(F.concat_ws(" ", a["text"], line))).otherwise(a["text"]).alias("text"),
            F.when(opens & (line != ""), F.lit("")).when(why, rest).otherwise(a["reason"]).alias("reason"),
            F.when(opens, closed(a)).otherwise(a["all"]).alias("all"),
        )

    return closed(F.aggregate(lines, init, step))
