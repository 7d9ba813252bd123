r"""Problem 1: cutting oversized texts at natural boundaries, with overlap and heading ancestry.

One regular expression per plan, of bounded quantifiers only, eats a text piece by piece (``regexp_extract_all``): its
alternatives are ordered by the strength of the boundary at which a piece may end, first within the upper half of the
limit, then anywhere in it, and only where the limit holds no boundary at all does a piece end between two characters
(not inside a composed character).  The rest is array functions: running sums of the pieces' lengths give their offsets,
a look back from each offset gives the overlap, and a fold over the lines gives the headings that hold there.

* Strategy ``chars``: the expression runs over the text itself.
* Strategy ``tokens``: a token is a maximal run of characters that are not Unicode white space.  Each token is reduced to
  one letter for the boundary after it, and the expression runs over these letters.

The first piece may fill the limit; in each later one there is room for the overlap, so that overlap and text together
stay within the limit as well.  The pieces' texts, joined, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
TOKEN = rf"\A[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+|[^{SPACE}]++[{SPACE}]*+"

#: What may stand before a cut, strongest first: blank line, line end, sentence end, clause end, white space.  Fixed values.
TEXT_BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,8}\n)",
    r"(?<=[\n\x{2028}\x{2029}]|\r(?!\n))",
    r"(?<=[.!?\x{2026}][\"'\x{201d}\x{2019})\]]{0,1}[ \t\x{a0}\x{2009}]|[\x{3002}\x{ff01}\x{ff1f}\x{61f}])",
    r"(?<=[,;:][ \t\x{a0}\x{2009}]|[\x{ff0c}\x{ff1b}\x{3001}\x{60c}])",
    rf"(?<=[{SPACE}])(?<!\r(?=\n))",
)
TOKEN_BOUNDARIES = ("(?<=P)", "(?<=[PL])", "(?<=[PLS])", "(?<=[PLSC])")


def pattern(start: str, most: Column, boundaries: tuple[str, ...], last: tuple[str, ...]) -> Column:
    """Alternatives for one piece of at most `most` units that starts at `start`."""
    n = most.cast("string")
    half = F.greatest(F.floor(most / 2), F.lit(1)).cast("string")
    parts = [F.concat(F.lit(".{1,"), n, F.lit(r"}\z"))]
    parts += [F.concat(F.lit(".{"), half, F.lit(","), n, F.lit("}" + b)) for b in boundaries]
    parts += [F.concat(F.lit(".{1,"), n, F.lit("}" + b)) for b in boundaries[1:]]
    parts += [F.concat(F.lit(".{1,"), n, F.lit("}" + b)) for b in last]
    return F.concat(F.lit(start + "(?:"), F.concat_ws("|", *parts), F.lit(")"))


def piece_pattern(most: Column, overlap: Column, boundaries: tuple[str, ...], last: tuple[str, ...]) -> Column:
    """The whole expression: a first piece of up to `most`, later ones with room for the overlap."""
    later = F.greatest(most - overlap, F.lit(1))
    return F.concat(F.lit("(?s)"), pattern(r"\A", most, boundaries, last), F.lit("|"), pattern(r"\G", later, boundaries, last))


def starts(lengths: Column) -> Column:
    """Offsets of pieces from their lengths."""
    step = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )
    return step["all"]


def headings(text: Column) -> Column:
    """ATX headings outside code fences: array<struct<level,text,line,start>>; line counts from 1 within the text, start is
    the offset of the heading's line.  A fence is closed by a fence of the same character."""
    none = F.array().cast("array<struct<level:int,text:string,line:int,start:int>>")
    init = F.struct(F.lit("").alias("fence"), F.lit(0).alias("start"), F.lit(1).alias("line"), none.alias("found"))

    def step(a: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"^[ \t]{0,3}(```|~~~)", 1)
        level = F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+[^ \t\r]", 1)).cast("int")
        title = F.trim(F.regexp_replace(line, r"^#{1,6}[ \t]+|[ \t]*#*[ \t\r]*$", ""))
        head = F.struct(level.alias("level"), title.alias("text"), a["line"].alias("line"), a["start"].alias("start"))
        fence = F.when(mark == "", a["fence"]).when(a["fence"] == "", mark).when(a["fence"] == mark, F.lit("")).otherwise(a["fence"])
        return F.struct(
            fence.alias("fence"),
            (a["start"] + F.length(line) + 1).alias("start"),
            (a["line"] + 1).alias("line"),
            F.when((level > 0) & (a["fence"] == "") & (title != ""), F.concat(a["found"], F.array(head))).otherwise(a["found"]).alias("found"),
        )

    return F.when(F.instr(text, "#") > 0, F.aggregate(F.split(text, "\n"), init, step)["found"]).otherwise(none)


def ancestry(before: Column, found: Column, start: Column) -> Column:
    """The headings that hold at an offset: those before the text, then each found one up to the offset; a heading ends
    all of its own level and below."""
    kind = "array<struct<level:int,text:string,line:int>>"
    return F.aggregate(
        F.filter(found, lambda h: h["start"] <= start),
        F.coalesce(before.cast(kind), F.array().cast(kind)),
        lambda a, h: F.concat(F.filter(a, lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"), h["line"].alias("line")))),
    )


def with_pieces(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """chunks joined to their plans, with _units (texts of the units that the limit counts, for tokens), _limit, _overlap and
    _lengths, the pieces' lengths in those units.  _lengths has one entry where the text is within the limit."""
    p = plans.select(
        F.col("plan_id").alias("_plan"),
        (F.col("chunk_strategy") == "tokens").alias("_by_token"),
        F.when(F.col("chunk_strategy") == "tokens", F.col("chunk_tokens")).otherwise(F.col("chunk_chars")).alias("_limit"),
        F.when(F.col("chunk_strategy") == "tokens", F.col("chunk_overlap_tokens")).otherwise(F.col("chunk_overlap_chars")).alias("_overlap"),
        F.coalesce("preserve_heading_ancestry", F.lit(True)).alias("_keeps"),
    ).where(F.col("_limit") > 0)
    text = F.col("text")
    df = chunks.join(p, chunks["plan_id"] == p["_plan"], "left")
    overlap = F.least(F.greatest(F.coalesce("_overlap", F.lit(0)), F.lit(0)), F.col("_limit") - 1)
    df = df.withColumn("_overlap", overlap)
    df = df.withColumn("_units", F.when(F.col("_by_token"), F.expr(f"regexp_extract_all(text, r'{TOKEN}', 0)")))

    def letter(t: Column) -> Column:
        return (
            F.when(t.rlike(r"\n[ \t\r]*\n"), "P")
            .when(t.rlike(r"[\n\r\x{2028}\x{2029}]"), "L")
            .when(t.rlike(rf"[.!?\x{{2026}}\x{{3002}}][\"'\x{{201d}}\x{{2019}})\]]?[{SPACE}]*\z"), "S")
            .when(t.rlike(rf"[,;:\x{{ff0c}}][{SPACE}]*\z"), "C")
            .otherwise("w")
        )

    # One letter a token; or the text itself, characters beyond the basic plane replaced one by one, as the matcher
    # recurses wherever the width of a character changes.
    letters = F.array_join(F.transform("_units", letter), "")
    plain = F.when(text.rlike(r"[\x{10000}-\x{10ffff}]"), F.regexp_replace(text, r"[\x{10000}-\x{10ffff}]", "￼")).otherwise(text)
    df = df.withColumn("_shape", F.when(F.col("_by_token"), letters).otherwise(plain))
    by_char = piece_pattern(F.col("_limit"), F.col("_overlap"), TEXT_BOUNDARIES, (r"(?![\p{M}\x{200d}])(?<![\x{200d}])(?<!\r(?=\n))", ""))
    by_token = piece_pattern(F.col("_limit"), F.col("_overlap"), TOKEN_BOUNDARIES, ("",))
    df = df.withColumn("_pattern", F.when(F.col("_by_token"), by_token).otherwise(by_char))
    cut = F.expr("transform(regexp_extract_all(_shape, _pattern, 0), p -> length(p))")
    size = F.when(F.col("_by_token"), F.size("_units")).otherwise(F.length(text))
    whole = F.array(F.coalesce(size, F.lit(0)))
    return df.withColumn("_lengths", F.when(F.col("_pattern").isNull() | (F.coalesce(F.length("_shape"), F.lit(0)) == 0), whole).otherwise(cut))


def oversized(chunks: DataFrame, plans: DataFrame, key: str = "chunk_key") -> DataFrame:
    """The keys of chunks that the plans' expressions cut into two or more pieces; distinct."""
    rows = with_pieces(chunks.select(key, "plan_id", "text"), plans)
    return rows.where(F.size("_lengths") > 1).select(key).distinct()


def split_oversized(chunks: DataFrame, plans: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Pieces of all chunks: (key, piece_index, piece_total, text, char_start, chars, tokens, heading_ancestry, overlap_text,
    overlap_before_chars, overlap_before_tokens, overlap_source), piece_index from 1.

    A chunk within its limit, and one of an unknown plan, is one piece with the overlap and ancestry that it came with; so
    is a null, empty or blank text.  An overlap is cut from the piece before, so it is shorter where that piece is.  A plan
    that does not preserve ancestry gives empty ones.  Ancestry lines found in a chunk count from its own first line.
    Repeated rows give repeated pieces; an empty table gives none; other columns are not read.
    """
    df = with_pieces(chunks.select(key, "plan_id", "text", "heading_ancestry", "overlap_text"), plans)
    df = df.withColumn("_starts", starts(F.col("_lengths")))
    many = F.size("_lengths") > 1
    df = df.withColumn("_heads", F.when(many & F.col("_keeps"), headings(F.col("text"))))
    df = df.withColumn("_pieces", F.arrays_zip("_lengths", "_starts"))
    df = df.select(key, "text", "heading_ancestry", "overlap_text", "_by_token", "_overlap", "_keeps", "_units", "_heads", "_lengths", F.posexplode("_pieces").alias("_i", "_p"))
    n, at, token = F.col("_p._lengths"), F.col("_p._starts"), F.coalesce(F.col("_by_token"), F.lit(False))
    one = F.size("_lengths") == 1
    joined = lambda start, length: F.array_join(F.slice("_units", start + 1, length), "")
    piece = F.when(one, F.col("text")).when(token, joined(at, n)).otherwise(F.substring(F.col("text"), at + 1, n))
    back = F.least(F.col("_overlap"), F.element_at("_lengths", F.when(F.col("_i") > 0, F.col("_i")).otherwise(1)))
    seen = F.when(token, joined(at - back, back)).otherwise(F.substring(F.col("text"), at - back + 1, back))
    first = F.col("_i") == 0
    over = F.when(first, F.coalesce("overlap_text", F.lit(""))).when(F.coalesce(F.col("_overlap"), F.lit(0)) <= 0, "").otherwise(seen)
    start = F.when(token & ~first, F.length(joined(F.lit(0), at))).otherwise(at)
    kind = "array<struct<level:int,text:string,line:int>>"
    held = (
        F.when(~F.coalesce(F.col("_keeps"), F.lit(True)), F.array().cast(kind))
        .when(first, F.coalesce(F.col("heading_ancestry").cast(kind), F.array().cast(kind)))
        .otherwise(ancestry(F.col("heading_ancestry"), F.col("_heads"), F.col("_start")))
    )
    count = lambda c: F.coalesce(F.regexp_count(c, F.lit(rf"[^{SPACE}]++")), F.lit(0))
    df = df.withColumn("_start", start).withColumn("_text", piece).withColumn("_over", over)
    return df.select(
        key,
        (F.col("_i") + 1).alias("piece_index"),
        F.size("_lengths").alias("piece_total"),
        F.col("_text").alias("text"),
        F.col("_start").alias("char_start"),
        F.coalesce(F.length("_text"), F.lit(0)).alias("chars"),
        count(F.col("_text")).alias("tokens"),
        held.alias("heading_ancestry"),
        F.col("_over").alias("overlap_text"),
        F.length("_over").alias("overlap_before_chars"),
        count(F.col("_over")).alias("overlap_before_tokens"),
        F.when(F.length("_over") > 0, "previous").otherwise("none").alias("overlap_source"),
    )
