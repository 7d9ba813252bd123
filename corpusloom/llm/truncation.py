"""Problem 4: values that were cut off, and how often each source cuts, by a self-join on prefixes.

A cut value is a strict prefix of a longer copy.  Whole longer copies are rare, so the join runs at the place of the cut:
the last word of a value, whole or broken, with the word before it is a strict prefix of longer windows elsewhere in the
corpus (the broken word goes on, or the sentence does), and hardly any window ends there.  Windows of two words are
counted over all values, each window is entered under its first word and every prefix of its second, and the values'
ends are joined to these entries on the two, so the join is an equality and makes one row per end.

An end is asked about only if it is open: without a full stop or a closing sign, apart from marks that a source puts
after a cut, or inside JSON that is never closed.  How a value's other sentences or list items end says how many equal
ends elsewhere are enough to call it complete.  No value is called cut by its shape: either a longer window elsewhere
goes on where it ends, or it is as long as its source's field limit: an open value of exactly the length at which its
source cut others was cut too, if that length has more cut values than the lengths around it explain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, small

FIELDS = ("raw_response", "markdown")
#: An end is a cut if at most this share of equal windows end there: in a value whose other units have stops, and otherwise.
END_SHARE_STOPS, END_SHARE_OPEN = 0.95, 0.2
#: Cut values of one source, field and length from which that length can be the field's limit.
LIMIT_COPIES = 3
#: Lengths at each side that tell how many cut values a length has by chance; the probability that a source and field gets any
#: limit by chance; and the least share of a limit's open values that are there beyond what the lengths around it have.
LIMIT_NEAR, LIMIT_CHANCE, LIMIT_SHARE = 25, 0.01, 0.5
#: Distinct windows that a Python worker holds before it hands them on (memory bound; sums do not change).
WINDOWS_HELD = 300_000
#: Prefixes of a word up to this length are entered; longer ends are joined by their first characters, then compared whole.
LONGEST_PREFIX = 24
OWN = ("ends_own", "longer_own", "ends_any_own", "longer_any_own")

# Marks that sources put after a cut, and signs that end a sentence or close it.
_MARKS = ("…", "...", "\ufffd", "\u200b", "\ufeff")
_MARK_WORDS = re.compile(r"(?:\[(?:…|\.\.\.|truncated|cut|snip|gekürzt|tronqué|truncado)\]|<(?:truncated|cut)>)\Z", re.I)
_CLOSED = re.compile(r"[.!?。！？؟…][\"'”’»“)\]*_`]*\Z|[\"”»`|}>)\]*_~]\Z")
_STOP = re.compile(r"[.!?。！？؟…;][\"'”’»“)\]*_`,]*\Z")
_ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s")
_LABEL = re.compile(r"\s*[*#>\s]*[^\W\d_][\w \-]{0,24}:\s*\S{0,12}\s*\Z")
_FENCE = re.compile(r"\A\s*```\w*\s*|\s*```\s*\Z")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_BEFORE_STRING = re.compile(r'(?<=[:,\[{])(?=")')
_EDGE = "\"'“”‘’«»()[]{}*_`,;:.!?…。"
_DIGIT = re.compile(r"\d")
_NEWLINE = "⏎"


def _word(w: str) -> str:
    """A word as it is compared: without signs around it, anything with a digit as #."""
    w = w.strip(_EDGE + _NEWLINE)
    return "#" if _DIGIT.search(w) else w


def _context(w: str) -> str:
    """The word before, or ^ where a unit begins."""
    return "^" if w == "" or w[-1] == _NEWLINE or _STOP.search(w) else _word(w)


def _body(value: str) -> tuple[str, bool]:
    """(a value without white space and marks put after a cut, whether one of them stands for a lost character)."""
    lost, n = False, -1
    while n != len(value):
        value = value.rstrip()
        n = len(value)
        for mark in _MARKS:
            if value.endswith(mark):
                value = value[: -len(mark)]
                lost |= mark == "\ufffd"
        if value[-1:] in "]>":
            value = _MARK_WORDS.sub("", value)
    return value, lost


def _is_json(body: str) -> bool:
    head = body.lstrip()[:16]
    return head.startswith(("{", "[{", '["')) or re.match(r"```(?:json)?\s*[{\[]", head) is not None


def _tokens(body: str, is_json: bool | None = None) -> list[str]:
    """The words of a value, the last of a line with a sign; without signs after the last word."""
    if _is_json(body) if is_json is None else is_json:
        body = _BEFORE_STRING.sub(" ", body.replace("\\n", "\n"))
    words = body.replace("\n", _NEWLINE + " ").split()
    while words and not _word(words[-1]):
        words.pop()
    return words


def _never_closed(body: str) -> bool:
    """Whether JSON ends inside a string, an object or an array."""
    body = _FENCE.sub("", body)
    if body.endswith("}") and body.count("{") == body.count("}"):
        return False
    bare = _STRING.sub("", body)
    return '"' in bare or bare.count("{") > bare.count("}") or bare.count("[") > bare.count("]")


def open_end(value: str) -> tuple[str, str, str] | None:
    """What _end() says of a value."""
    body, lost = _body(value)
    is_json = _is_json(body)
    if not lost and not is_json and _CLOSED.search(body[-8:]) or is_json and not _never_closed(body):
        return None
    # The last two words are all that is asked about.
    words = _tokens(body[-600:], is_json)
    return _end(body, lost, words if len(words) > 2 else _tokens(body, is_json))


def _end(body: str, lost: bool, words: list[str]) -> tuple[str, str, str] | None:
    """(kind, context, last word) of an open end, or None.  kind: json (never closed), lost (a lost character or a comma at the
    end), stops (the other units have stops), plain (they have none), alone (there are none)."""
    if len(body) < 4 or not any(c.isalnum() for c in body[-80:]):
        return None
    is_json = _is_json(body)
    if is_json and not _never_closed(body):
        return None
    if not is_json and _CLOSED.search(body[-8:]) and not lost:
        return None
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1]
    if last.rstrip().endswith(":") and all(_LABEL.match(x) for x in lines):
        return None  # labels without content
    if not words:
        return None
    context = _context(words[-2] if len(words) > 1 else "")
    kind = "alone"
    if is_json:
        kind = "json"
    elif lost or words[-1][-1:] == ",":
        kind = "lost"
    elif not _LABEL.match(last):
        item = bool(_ITEM.match(last))
        others = [x for x in lines[:-1] if bool(_ITEM.match(x)) == item and not x.startswith("#") and not x.rstrip().endswith(":") and not _LABEL.match(x)]
        stops = sum(bool(_STOP.search(x.rstrip()[-8:])) for x in others)
        if not others:
            inner = re.findall(r"[.!?。](?=\s)", last[3:])
            kind = "stops" if inner else "alone"
        else:
            kind = "stops" if stops * 2 > len(others) else "plain"
    return kind, context, _word(words[-1])


def own_counts(value: str, origin: str) -> tuple[int, int, int, int]:
    """What a value put in place of its origin changes in the counts that its open end is judged by: (ends, longer) after its
    context and (ends, longer) anywhere, of its own windows without its end, less those of the origin with its end."""
    end = open_end(value)
    out = [0, 0, 0, 0]
    if end is None:
        return 0, 0, 0, 0
    asked = end[2]
    for text, sign in ((value, 1), (origin, -1)):
        words = _tokens(_body(text)[0])
        if words and sign < 0:
            words[-1] += _NEWLINE
        for a, b in zip(["", *words], words if sign < 0 else words[:-1]):
            w = _word(b)
            if w.startswith(asked):
                goes_on = w != asked or not (b[-1] == _NEWLINE or bool(_STOP.search(b)))
                out[2 + goes_on] += sign
                if _context(a) == end[1]:
                    out[goes_on] += sign
    return tuple(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of distinct values (id, value): a row per value with its end (kind, context, word of an open end; end_context, end_word
    of the window there), and rows without an id with the windows inside values, counted (n)."""
    schema = pa.schema(
        [("id", pa.string()), ("length", pa.int64()), ("kind", pa.string()), ("context", pa.string()), ("word", pa.string()),
         ("end_context", pa.string()), ("end_word", pa.string()), ("ended", pa.bool_()), ("n", pa.int64())]
    )
    held: Counter = Counter()

    def hand_on() -> pa.RecordBatch:
        out: Counter = Counter()
        for (a, b), n in held.items():
            w = _word(b)
            if w:
                out[(_context(a), w, b[-1] == _NEWLINE or bool(_STOP.search(b)))] += n
        held.clear()
        k = list(out)
        none = pa.nulls(len(k), pa.string())
        return pa.RecordBatch.from_arrays(
            [none, none.cast(pa.int64()), none, pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()), none, none,
             pa.array([x[2] for x in k], pa.bool_()), pa.array([out[x] for x in k], pa.int64())],
            schema=schema,
        )

    for batch in batches:
        ends = []
        for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body, lost = _body(value)
            words = _tokens(body)
            if words:
                held.update(zip(["", *words], words[:-1]))
                end = (_context(words[-2] if len(words) > 1 else ""), _word(words[-1]))
                ends.append((key, len(value), *(_end(body, lost, words) or (None, None, None)), *end))
        if ends:
            none = pa.nulls(len(ends))
            cols = list(zip(*ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, schema.field(i).type) for i, c in enumerate(cols)] + [none.cast(pa.bool_()), none.cast(pa.int64())], schema=schema
            )
        if len(held) > WINDOWS_HELD:
            yield hand_on()
    yield hand_on()


def _limits(ends: DataFrame) -> DataFrame:
    """Field limits (s, f, l) of open ends (source, field_name, length, is_cut).

    What a length has by chance is told by the lengths around it, so the rule is alike at every size: the bound on the
    Poisson tail of its cut values, times the lengths tried, is at most LIMIT_CHANCE.
    """
    n = ends.groupBy("source", "field_name", "length").agg(F.sum(F.col("is_cut").cast("long")).alias("copies"), F.count(F.lit(1)).alias("opened"))
    all_lengths = Window.partitionBy("source", "field_name")
    near = all_lengths.orderBy("length").rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)
    lengths = LIMIT_NEAR + F.least(F.lit(LIMIT_NEAR), F.col("length") - 1)
    n = n.select(
        "*", F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).over(all_lengths).alias("tried"),
        ((F.sum("copies").over(near) - F.col("copies") + 1) / lengths).alias("chance"), ((F.sum("opened").over(near) - F.col("opened") + 1) / lengths).alias("usual"),
    )
    copies, chance = F.col("copies"), F.col("chance")
    stands_out = (copies > chance) & (copies * F.log(copies / chance) - copies + chance >= F.log(F.col("tried") / LIMIT_CHANCE))
    n = n.where((copies >= LIMIT_COPIES) & stands_out & (F.col("opened") - F.col("usual") >= LIMIT_SHARE * F.col("opened")))
    return n.select(F.col("source").alias("s"), F.col("field_name").alias("f"), F.col("length").alias("l"))


def _ends_apart(results: DataFrame, own: DataFrame, asked: DataFrame) -> DataFrame:
    """How many values that vouch for themselves end in each asked window: (context, word, apart), context * for any.

    own has the windows at the ends of distinct values (id, context, word).  A markdown that ends like a raw response of its
    result is the same end and counts with that raw response.
    """
    raw, markdown = (F.md5(f) for f in FIELDS)
    own = cut(own.join(small(asked.select("word").distinct()), "word", "left_semi").select("id", "context", "word"))
    pairs = results.select(raw.alias("raw"), markdown.alias("id")).where("raw is not null and id is not null and raw != id").distinct()
    ends = own.select(F.col("id").alias("raw"), F.col("context").alias("c"), F.col("word").alias("w"))
    same = pairs.join(own, "id").join(ends, "raw").where("context = c and word = w").groupBy("id").agg(F.min("raw").alias("raw"))
    own = own.join(same, "id", "left").select("context", "word", F.coalesce("raw", "id").alias("id")).distinct()
    return own.unionByName(own.select(F.lit("*").alias("context"), "word", "id").distinct()).groupBy("context", "word").agg(F.count(F.lit(1)).alias("apart"))


def truncated(results: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Cut values: (result_key, source, field_name, evidence), each once.  evidence: window (a longer window goes on there), word
    (a longer word or sentence does, after another word), limit (the source's field limit).

    Needs result_key bigint, source and the two fields; other columns are not read.  Null, empty and blank values are not
    cut; a null source is a source of its own.  Repeated rows count once; an empty table gives no rows.  Equal values, under
    whatever keys and fields, are one value: it is scanned, counted and judged once, and the verdict goes to all its rows.

    lookups, few rows (result_key, kind, context, word, ends_own, longer_own, ends_any_own, longer_any_own), are open ends
    that are judged by the same counts plus what they bring along (own_counts), but are themselves neither counted nor held
    to limits; those cut are returned with a null source and field.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("_v")
    values = results.select(fields).select("_v.value").where("value != ''").distinct()
    # A group of copies shrinks in the tasks that read it; the number of partitions is explicit as in distinct_rows.
    values = values.select(F.md5("value").alias("id"), "value").repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    schema = "id string, length bigint, kind string, context string, word string, end_context string, end_word string, ended boolean, n bigint"
    scanned = cut(values.mapInArrow(_scan, schema))
    asked = scanned.where("kind is not null").drop("ended", "n").select("*", *[F.lit(None).cast("long").alias(c) for c in (*OWN, "looked_up")])
    if lookups is not None:
        asked = asked.unionByName(cut(lookups.withColumnRenamed("result_key", "looked_up")), allowMissingColumns=True)
    own = scanned.where("end_word is not null").select("id", F.col("end_context").alias("context"), F.col("end_word").alias("word"))
    windows = scanned.where("id is null").groupBy("context", "word", "ended").agg(F.sum("n").alias("n"))
    # The windows at the values' ends, without ended: they go on longer than a prefix, but as ends they are counted below.
    windows = windows.unionByName(own.groupBy("context", "word").agg(F.lit(None).cast("boolean").alias("ended"), F.count(F.lit(1)).alias("n")))
    every = windows.groupBy(F.lit("*").alias("context"), "word", "ended").agg(F.sum("n").alias("n"))
    prefix = F.substring("word", 1, LONGEST_PREFIX)
    entries = windows.unionByName(every).withColumn("_n", F.explode(F.sequence(F.lit(1), F.length(prefix)))).withColumn("prefix", F.substring("word", F.lit(1), F.col("_n")))
    needles = asked.select("context", "word").union(asked.select(F.lit("*"), "word")).distinct()
    needles = needles.select("context", F.col("word").alias("end"), prefix.alias("prefix"))
    whole = F.col("word") == F.col("end")
    stops = F.coalesce("ended", F.lit(True)) & whole
    counts = entries.join(small(needles), ["context", "prefix"]).where("startswith(word, end)").groupBy("context", F.col("end").alias("word")).agg(
        F.sum(F.when(F.col("ended") & whole, F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(stops, 0).otherwise(F.col("n"))).alias("longer")
    )
    counts = counts.join(_ends_apart(results, own, asked), ["context", "word"], "left")
    counts = cut(counts.select("context", "word", (F.col("ends") + F.coalesce("apart", F.lit(0))).alias("ends"), "longer"))
    near = counts.where("context != '*'")
    anywhere = counts.where("context = '*'").select("word", F.col("ends").alias("ends_any"), F.col("longer").alias("longer_any"))
    judged = asked.join(small(near), ["context", "word"], "left").join(small(anywhere), "word", "left")
    # An end counts itself once.
    itself = F.coalesce((F.col("end_word") == F.col("word")).cast("int"), F.lit(0))
    itself_near = itself * F.coalesce((F.col("end_context") == F.col("context")).cast("int"), F.lit(0))
    at_least_0 = lambda c, less, more: F.greatest(F.coalesce(c, F.lit(0)) - less + F.coalesce(more, F.lit(0)), F.lit(0))
    ends_n, longer = at_least_0("ends", itself_near, "ends_own"), at_least_0("longer", F.lit(0), "longer_own")
    ends_any, longer_any = at_least_0("ends_any", itself, "ends_any_own"), at_least_0("longer_any", F.lit(0), "longer_any_own")
    judged = judged.select("id", "length", "kind", "word", "looked_up", ends_n.alias("ends"), longer.alias("longer"), ends_any.alias("ends_any"), longer_any.alias("longer_any"))
    # Where numbers stand elsewhere tells nothing on a short answer that is one ("x = 3").
    answer = (F.col("word") == "#") & (F.col("kind") == "alone")
    most = F.when(F.col("kind").isin("stops", "json", "lost"), END_SHARE_STOPS).otherwise(END_SHARE_OPEN)
    goes_on = lambda n, more: (more > 0) & (n <= most * (n + more))
    evidence = F.when(F.col("ends") + F.col("longer") >= 2, F.when(goes_on(F.col("ends"), F.col("longer")), "window")).when(~answer & goes_on(F.col("ends_any"), F.col("longer_any")), "word")
    verdict = cut(judged.select("id", "length", evidence.alias("evidence"), "looked_up"))
    nothing = F.lit(None).cast("string")
    found = verdict.where("evidence is not null and looked_up is not null").select(F.col("looked_up").alias("result_key"), nothing.alias("source"), nothing.alias("field_name"), "evidence")
    verdict = verdict.where("looked_up is null").drop("looked_up")
    ids = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.md5(f).alias("id")) for f in FIELDS])).alias("_v")
    rows = cut(results.select("result_key", "source", ids).select("result_key", "source", "_v.*").join(small(verdict), "id"))
    limits = _limits(rows.select("source", "field_name", "length", "id", F.col("evidence").isNotNull().alias("is_cut")).distinct())
    at_limit = rows.where("evidence is null").join(
        small(limits), F.col("source").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("length") == F.col("l")), "left_semi"
    )
    keep = ["result_key", "source", "field_name"]
    return rows.where("evidence is not null").select(*keep, "evidence").unionByName(at_limit.select(*keep, F.lit("limit").alias("evidence"))).unionByName(found).groupBy(keep).agg(F.min("evidence").alias("evidence"))


def rates(results: DataFrame) -> DataFrame:
    """Share of cut values per source and field: (source, field_name, n_values, n_cut, cut_share).  Null values are no values;
    repeated rows count once."""
    rows = results.select("result_key", "source", *FIELDS).distinct()
    names = F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FIELDS])
    values = rows.select("result_key", "source", F.explode(F.array_compact(names)).alias("field_name"))
    total = values.groupBy("source", "field_name").agg(F.countDistinct("result_key").alias("n_values"))
    cuts = truncated(results).groupBy(F.col("source").alias("_s"), F.col("field_name").alias("_f")).agg(F.count(F.lit(1)).alias("n_cut"))
    both = total.join(small(cuts), F.col("source").eqNullSafe(F.col("_s")) & (F.col("field_name") == F.col("_f")), "left")
    n = F.coalesce("n_cut", F.lit(0))
    return both.select("source", "field_name", "n_values", n.alias("n_cut"), (n / F.col("n_values")).alias("cut_share"))
