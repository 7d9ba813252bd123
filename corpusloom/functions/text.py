"""Column expressions over text: cleaning, keys, signals, scores and sizes.  All of them run inside the JVM."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() sees it, for a character class.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
#: The same characters one by one.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Openings and phrases of text that carries no evidence.
LOW_SIGNAL_OPENINGS = ("author:", "by:", "conversion:", "date:", "downloaded:", "source:", "source url:", "tags:", "title:")
LOW_SIGNAL_PHRASES = ("learn more", "read more", "see also", "see the changelog", "you can read more")
# Terms whose presence signals a kind of statement, and the points that each kind gives.
SIGNALS = {
    "claim": (2, ("because", "therefore", "finding", "improves", "performs", "proves", "shows", "worse")),
    "definition": (1, ("combines", "defined", "definition", "is a", "is an", "means")),
    "example": (1, ("e.g.", "example", "for example", "instance", "such as")),
    "limit": (2, ("beyond", "caveat", "fails", "failure", "limit", "misleading", "past that", "risk", "tradeoff", "warning")),
    "metric": (1, ("%", "cost", "seconds", "tokens", "×")),
    "operation": (1, ("chunk", "ingest", "lint", "operation", "process", "query", "rank", "rerank", "step", "workflow")),
    "rule": (2, ("constraint", "must", "never", "only", "requires", "rule", "should")),
    "thesis": (2, ("central", "core", "fundamental", "main", "primary", "thesis")),
}
RULE_OPENINGS = ("**Rule:**", "Rule:", "NEVER ", "Never ")
# Item types of an extraction, by preset.
EVIDENCE = ("claim", "example", "fact", "question", "quote", "tension")
ENTITIES = ("entity", "link")
WORK = ("blocker", "decision", "follow_up", "requirement", "risk", "task")
PRESETS = {"evidence": EVIDENCE, "entities": ENTITIES, "work": WORK, "research": EVIDENCE + ENTITIES}
STRONG_TYPES = ("blocker", "claim", "decision", "example", "requirement", "risk")
# Failure codes with their category, whether a retry may help as it is, and whether it may after a fix.
FAILURES = {
    "model_timeout": ("transient", True, False),
    "model_unavailable": ("configuration", False, True),
    "context_overflow": ("resource", False, True),
    "input_missing": ("input", False, True),
    "input_unreadable": ("input", False, True),
    "input_empty": ("input", False, True),
    "model_output_invalid": ("model_output", True, False),
    "internal_error": ("internal", True, False),
}


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def newlines(c: Column) -> Column:
    """Line ends as \\n, as after reading a file in text mode."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def _trim(c: Column, chars: str) -> Column:
    """Without the given characters at both ends; unlike a regular expression it looks at the ends only."""
    return F.btrim(c, F.lit(chars))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return _trim(c, SPACE_CHARS)


def _single_spaced(c: Column) -> Column:
    """Runs of white space as one space."""
    plain = F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def collapse(c: Column) -> Column:
    """Stripped, runs of white space as one space, quotation marks at the ends left out first."""
    return _single_spaced(_trim(strip(c), "\"'"))


def slug(c: Column) -> Column:
    """A key of lower-case letters and digits with single hyphens; schemes of addresses are left out."""
    low = F.lower(collapse(c))
    bare = F.when(F.contains(low, F.lit("://")), F.regexp_replace(low, "https?://", "")).otherwise(low)
    return _trim(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "-")


def snake(c: Column) -> Column:
    return F.replace(slug(c), F.lit("-"), F.lit("_"))


def duplicate_key(c: Column) -> Column:
    """Lower case, single spaces, no punctuation or space at the ends: equal for texts that say the same."""
    return _trim(_single_spaced(F.lower(c)), string.punctuation + " \t\r\n")


def safe_label(c: Column, ascii_only: bool = False) -> Column:
    """A label fit for a file name: other characters become hyphens; runs collapse only in the ASCII form."""
    if ascii_only:
        return F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "-"), r"\A[-.]+|[-.]+\z", "")
    return F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}._-]", "-"), r"\A[-.]+|[-.]+\z", "")


def bare_item(c: Column) -> Column:
    """A line without its list mark."""
    return strip(F.regexp_replace(c, rf"\A[{SPACE}]*(?:[-*]|[0-9]+[.)])[{SPACE}]*", ""))


def is_placeholder(c: Column) -> Column:
    return F.lower(c).isin("none", "n/a", "no open questions") | (c == "")


def _quoted(terms: tuple[str, ...]) -> str:
    """Alternatives of a regular expression for literal terms."""
    return "|".join(re.escape(t) for t in terms)


def is_low_signal(text: Column) -> Column:
    """Metadata lines, pointers elsewhere, titles without an end, links and citations; text must be stripped."""
    return any_of(
        [
            text.rlike(rf"(?iu)\A(?:{_quoted(LOW_SIGNAL_OPENINGS)})|{_quoted(LOW_SIGNAL_PHRASES)}|https?://"),
            (F.length(text) < 40) & text.contains(" - ") & ~text.rlike(r"[.!?]\z"),
            text.rlike(rf"\A[^,\n]{{2,80}},[{SPACE}]+[\"“](?s:.*)[0-9]{{4}}\z"),
        ]
    )


#: Places in the array of signals().
_DIGIT, _RULE, _LOW = len(SIGNALS) + 1, len(SIGNALS) + 2, len(SIGNALS) + 3


def signals(text: Column, reason: Column | None = None) -> Column:
    """What a snippet shows, as array<boolean>: each kind of SIGNALS in text or reason, digits, a rule, low signal.  One regular
    expression a kind keeps the generated code small; text must be stripped."""
    both = text if reason is None else F.concat(text, F.lit("\n"), F.coalesce(reason, F.lit("")))
    kinds = [both.rlike(rf"(?iu){_quoted(terms)}") for _, terms in SIGNALS.values()]
    return F.array(*kinds, text.rlike(r"\p{Nd}"), text.rlike(rf"\A(?:{_quoted(RULE_OPENINGS)})"), is_low_signal(text))


def points(shown: Column, length: Column) -> Column:
    """Points of a snippet by what signals() found and its length."""
    on = lambda i, p: F.when(F.element_at(shown, i), p).otherwise(0)
    total = F.when(length.between(80, 420), 2).when(length.between(40, 79), 1).when(length > 520, -1).otherwise(0)
    for i, (p, _) in enumerate(SIGNALS.values(), 1):
        total = total + on(i, p)
    return total + on(_DIGIT, 1) + on(_RULE, 2) + on(_LOW, -10)


def reasons(shown: Column, length: Column) -> Column:
    """Names of what gave or took points, in their order; a kind is named once."""
    at = lambda i: F.element_at(shown, i)
    names = list(SIGNALS)
    return F.array_compact(
        F.array(
            F.when(length.between(80, 420), "useful_length").when(length.between(40, 79), "compact_length").when(length > 520, "near_max_length"),
            *[F.when(at(i), k) for i, k in enumerate(names, 1)],
            F.when(at(_DIGIT) & ~at(names.index("metric") + 1), "metric"),
            F.when(at(_RULE) & ~at(names.index("rule") + 1), "rule"),
            F.when(at(_LOW), "low_signal"),
        )
    )


def rank(kind: Column, support: Column, text: Column) -> Column:
    """Rank of an extracted item, 0.400 to 1.000."""
    part = lambda on, v: F.when(on, F.lit(v).cast("decimal(4,3)")).otherwise(F.lit(0).cast("decimal(4,3)"))
    total = (
        F.lit("0.4").cast("decimal(4,3)")
        + part(kind.isin(*STRONG_TYPES), "0.2")
        + part(support == "snippet_verified", "0.25")
        + part(F.length(text).between(20, 220), "0.1")
        + part(kind.isin("quote", "link"), "0.05")
    )
    return F.least(total, F.lit("1.0").cast("decimal(4,3)")).cast("decimal(4,3)")


def item_key(kind: Column, text: Column, entity_type: Column, url: Column) -> Column:
    """Key under which items mean the same: a link's address, an entity's type and name, else type and text."""
    return (
        F.when((kind == "link") & (F.coalesce(url, F.lit("")) != ""), F.concat(F.lit("link:"), slug(url)))
        .when(kind == "entity", F.concat(F.lit("entity:"), slug(F.coalesce(entity_type, F.lit("other"))), F.lit(":"), slug(text)))
        .otherwise(F.concat(kind, F.lit(":"), slug(text)))
    )


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def find(text: Column, part: Column) -> Column:
    """0-based offset of the first occurrence in code points; null if there is none or the part is empty."""
    return F.nullif(F.call_function("instr", text, F.nullif(part, F.lit(""))), F.lit(0)) - 1


# Fixed value: the notice.
def clip(text: Column, most: int) -> tuple[Column, Column]:
    """(text cut to `most` characters with a notice, whether it was cut)."""
    over = F.length(text) > most
    head = F.regexp_replace(F.substring(text, 1, most), rf"[{SPACE}]+\z", "")
    note = F.format_string(f"\n\n[Input truncated: first {most} of %d characters.]", F.length(text))
    return F.when(over, F.concat(head, note)).otherwise(text), over


def estimate_tokens(chars: Column, per_token: float = 4.0) -> Column:
    """Tokens by size; 0 for nothing."""
    return F.when(chars <= 0, 0).otherwise(F.floor((chars + F.lit(per_token) - 1) / F.lit(per_token))).cast("int")


def snippet_request(chars: Column, least: int = 2, most: int = 8, per_snippet: int = 12_000) -> Column:
    """How many snippets to ask for by the size of a source."""
    return F.least(F.greatest(F.ceil(chars / per_snippet), F.lit(least)), F.lit(most)).cast("int")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, half to even, never below 0; null if either is."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.greatest(F.bround(micros.cast("decimal(20,3)") / 1000, 0).cast("long"), F.when(micros.isNotNull(), F.lit(0).cast("long")))


def sign(c: Column) -> Column:
    """A difference as it is shown: with its sign; empty for null."""
    return F.when(c.isNull(), "").when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))


def glob_regex(pattern: str) -> str:
    """Regular expression of a path pattern: * and ? also match /; a leading **/ may match nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += "\\" + c if c in r".^$+{}()|\[]" else c
        i += 1
    whole = rf"\A(?s:{out})\z"
    return whole if not pattern.startswith("**/") else rf"\A(?s:{out})\z|{glob_regex(pattern[3:])}"


def first_glob(path: Column, patterns: list[str]) -> Column:
    """The first pattern that matches a path, or null."""
    return F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


# What messages of failures say, as below.
def failure_code(message: Column) -> Column:
    """Code of a failure by what its message says; the first rule that holds."""
    m = F.lower(message)
    c = m.contains
    return (
        F.when(c("no such file") | (c("input file") & c("not found")), "input_missing")
        .when(c("permission denied"), "input_unreadable")
        .when(c("no usable text") | c("empty input"), "input_empty")
        .when(c("timed out") | c("timeout"), "model_timeout")
        .when(c("connection refused") | c("failed to establish") | (c("model") & (c("not found") | c("not available") | c("unavailable"))), "model_unavailable")
        .when(c("context") | c("num_ctx") | c("token budget") | c("too large") | (c("exceeds") & c("token")), "context_overflow")
        .when(c("json") | c("parse") | c("schema") | c("structured"), "model_output_invalid")
        .otherwise("internal_error")
    )


def failure(message: Column) -> Column:
    """struct<code, category, retryable, retry_after_fix, message>."""
    code = failure_code(message)
    pick = lambda i: F.coalesce(*[F.when(code == k, F.lit(v[i])) for k, v in FAILURES.items()])
    return F.struct(code.alias("code"), pick(0).alias("category"), pick(1).alias("retryable"), pick(2).alias("retry_after_fix"), message.alias("message"))


def attributes(c: Column) -> Column:
    """`k=v; k=v` as a map of at most 8 keys: keys in snake case of at most 40 characters, values of at most 160.  Of equal keys
    the last value counts, of those up to where the eighth key comes (needs spark.sql.mapKeyDedupPolicy LAST_WIN)."""
    pairs = F.transform(
        F.filter(F.split(c, ";"), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.substring(snake(F.regexp_extract(p, r"\A([^=]*)=", 1)), 1, 40).alias("k"), F.substring(collapse(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)), 1, 160).alias("v")
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.transform(pairs, lambda p: p["k"])
    eighth = F.try_element_at(F.array_distinct(keys), F.lit(8))
    return F.map_from_entries(F.slice(pairs, F.lit(1), F.coalesce(F.array_position(keys, eighth).cast("int"), F.size(pairs))))


def timestamp_label(at: Column, millis: bool = True) -> Column:
    """A timestamp as ISO 8601 in UTC (the session's zone) with Z, to the millisecond or the second; null stays null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if millis else "") + "'Z'")


def timestamp_of(label: Column) -> Column:
    """The timestamp of an ISO 8601 label; null if it is none."""
    return F.try_to_timestamp(label)


def duration_label(ms: Column) -> Column:
    """Milliseconds as they are shown: `999ms`, `1.5s`, `2m 3.0s`; empty for null.  Tenths are rounded, halves up."""
    tenths = lambda x: F.concat(F.floor((x + 50) / 1000).cast("string"), F.lit("."), (F.floor((x + 50) / 100) % 10).cast("string"), F.lit("s"))
    return F.when(ms.isNull(), "").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, tenths(ms)).otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), tenths(ms % 60_000)))


def at_path(document: Column, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path leads nowhere."""
    return F.try_variant_get(F.try_parse_json(document), "$." + dotted, "string")


def whole_number(document: Column, dotted: str) -> Column:
    """The whole number at a dotted path of a JSON text: of a number its whole part, of a text the number that it writes; null for
    truth values, other texts and what is missing."""
    v = F.try_variant_get(F.try_parse_json(document), "$." + dotted, "variant")
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double").try_cast("bigint"))
    return F.coalesce(F.when(kind == "BIGINT", text.try_cast("bigint")), number, F.when(kind == "STRING", F.when(strip(text).rlike(r"\A[+-]?[0-9]+\z"), strip(text).try_cast("bigint"))))


def score(document: Column, dotted: str) -> Column:
    """A score from 1 to 5 at a dotted path of a JSON text; null for anything else."""
    n = whole_number(document, dotted)
    return F.when(n.between(1, 5), n.cast("int"))


def below(path: Column, base: str) -> Column:
    """A path below a folder, or as it is where it lies elsewhere."""
    return F.when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, len(base.rstrip("/")) + 2, 2**31 - 1)).otherwise(path)


def queued(total: Column, complete: Column, running: Column, failed: Column) -> Column:
    """What still waits."""
    return F.greatest(F.lit(0), total - complete - running - failed)


def token_budget(context: Column, margin: float = 0.15, reserve: int = 1024, most: int = 4096) -> Column:
    """Tokens that a chunk may have under a model's context: less a margin and what the prompt takes, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(context * F.lit(1 - margin)).cast("int") - reserve))
