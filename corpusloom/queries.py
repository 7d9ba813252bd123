"""Registry of the core queries with their SQL: each entry of SQL gives on the same tables, in DuckDB, what the query gives.

All queries run over whole tables and whole texts.  Lists come out as joined strings and long texts as md5 sums, so that
results of both engines compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import parsing
from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import evidence as E
from corpusloom.operators import history as H
from corpusloom.operators import packaging as K
from corpusloom.operators import records
from corpusloom.plans import contracts, model
from corpusloom.plans import pipeline as P
from corpusloom.session import distinct_rows as laid_out
from corpusloom.session import small, spread, table
from corpusloom.sources import folder as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL pieces.  RE2 and Java read these patterns alike.
_SP = r"\t-\r\x1c-\x1f\x{85}\pZ"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


def _nl(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def _collapse(x: str) -> str:
    return rf"""regexp_replace(regexp_replace({_strip(x)}, '^["'']+|["'']+$', '', 'g'), '[{_SP}]+', ' ', 'g')"""


def _slug(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({_collapse(x)}), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _dup(x: str) -> str:
    edge = r"[!-/:-@\[-`{-~ \t\r\n]"
    # Java writes the lower case of a dotted capital I with a combining dot.
    return rf"regexp_replace(regexp_replace(lower(replace({x}, 'İ', 'i' || chr(775))), '[{_SP}]+', ' ', 'g'), '^{edge}+|{edge}+$', '', 'g')"


def _low(x: str) -> str:
    opens = " or ".join(f"starts_with(lower({x}), '{p}')" for p in T.LOW_SIGNAL_OPENINGS)
    phrases = " or ".join(f"contains(lower({x}), '{p}')" for p in T.LOW_SIGNAL_PHRASES)
    return rf"""({opens} or {phrases} or (length({x}) < 40 and not regexp_matches({x}, '[.!?]$') and contains({x}, ' - ')) or regexp_matches(lower({x}), 'https?://')
        or (regexp_matches({x}, '^[^,\n]{{2,80}},[{_SP}]+["“]') and regexp_matches({x}, '[0-9]{{4}}$')))"""


def _score(x: str) -> tuple[str, str]:
    has = {k: "(" + " or ".join(f"contains(lower({x}), '{t}')" for t in terms) + ")" for k, (_, terms) in T.SIGNALS.items()}
    rule = "(" + " or ".join(f"starts_with({x}, '{p}')" for p in T.RULE_OPENINGS) + ")"
    digit, n = rf"regexp_matches({x}, '\p{{Nd}}')", f"length({x})"
    points = f"case when {n} between 80 and 420 then 2 when {n} between 40 and 79 then 1 when {n} > 520 then -1 else 0 end"
    points += "".join(f" + case when {has[k]} then {p} else 0 end" for k, (p, _) in T.SIGNALS.items())
    points += f" + case when {digit} then 1 else 0 end + case when {rule} then 2 else 0 end + case when {_low(x)} then -10 else 0 end"
    why = [f"case when {n} between 80 and 420 then 'useful_length' when {n} between 40 and 79 then 'compact_length' when {n} > 520 then 'near_max_length' end"]
    why += [f"case when {has[k]} then '{k}' end" for k in T.SIGNALS]
    why += [f"case when {digit} and not {has['metric']} then 'metric' end", f"case when {rule} and not {has['rule']} then 'rule' end", f"case when {_low(x)} then 'low_signal' end"]
    return f"({points})", f"concat_ws(',', {', '.join(why)})"


_LINES = f"""raw as (select doc_id, string_split({_nl("text")}, chr(10)) as a from documents where text is not null),
 u as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as line_no from raw),
 o as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as pos from u),
 lines as (select doc_id, line_no, (pos + length(line) - length(regexp_replace(line, '^[{_SP}]+', '')))::bigint as char_start, {_strip("line")} as text from o where {_strip("line")} != '')"""
_SCORED = f"scored as (select *, {_score('text')[0]} as score, {_score('text')[1]} as reasons from lines)"
_DEDUPED = f"""k as (select *, {_dup("text")} as key from scored), d as (select * from (select *, row_number() over (partition by key order by -score, doc_id::varchar, line_no, char_start, text) as rn from k where key != '') where rn = 1)"""


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return E.candidates(spread(table(spark, folder, "documents").where("text is not null")))


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    return E.scored(lines_of(spark, folder)).withColumn("input_path", F.col("doc_id").cast("string")).withColumn("start_line", F.col("line_no"))


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# --- Text -----------------------------------------------------------------------------------------------------------


@query(f"with {_LINES} select doc_id, line_no, char_start, md5(text) as text_md5, length(text) as chars from lines")
def q_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate lines of all documents with their places."""
    return lines_of(spark, folder).select("doc_id", "line_no", "char_start", md5(F.col("text")).alias("text_md5"), F.length("text").alias("chars"))


@query(f"with {_LINES} select {_slug('text')} as slug, count(*) as lines, min(doc_id) as first_doc from lines group by 1")
def q_norm_slug(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per key of letters and digits."""
    return lines_of(spark, folder).groupBy(T.slug(F.col("text")).alias("slug")).agg(F.count(F.lit(1)).alias("lines"), F.min("doc_id").alias("first_doc"))


@query(f"with {_LINES} select doc_id, count(*) as lines, sum(({_low('text')})::int)::bigint as low_signal from lines group by 1")
def q_low_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without evidence per document."""
    return lines_of(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(T.is_low_signal(F.col("text")).cast("int")).alias("low_signal"))


@query(f"with {_LINES}, {_SCORED} select doc_id, line_no, score, reasons from scored")
def q_snippet_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every line with its reasons."""
    return scored_lines(spark, folder).select("doc_id", "line_no", "score", F.array_join("score_reasons", ",").alias("reasons"))


@query(f"""with {_LINES}, l as (select doc_id, max_by(text, line_no) as tail from lines group by 1),
 d as (select doc_id, {_nl("text")} as text from documents)
 select doc_id, strpos(text, tail) - 1 as char_start, 1 + length(text[1:strpos(text, tail) - 1]) - length(replace(text[1:strpos(text, tail) - 1], chr(10), '')) as start_line from d join l using (doc_id)""")
def q_line_range(spark: SparkSession, folder: str) -> DataFrame:
    """Place and line of the first occurrence of each document's last line."""
    tails = lines_of(spark, folder).groupBy("doc_id").agg(F.max_by("text", "line_no").alias("tail"))
    d = table(spark, folder, "documents").select("doc_id", T.newlines(F.col("text")).alias("text"))
    at = T.find(F.col("text"), F.col("tail"))
    return d.join(tails, "doc_id").select("doc_id", at.alias("char_start"), T.line_of(F.col("text"), at).alias("start_line"))


_ENDINGS = "|".join(e.replace(".", r"\.") for e in sources.SKIPPED_ENDINGS)
#: Every seventh document's path is given an ending that is not read, every eleventh a folder.
_PATHS = rf"""p as (select doc_id, case when doc_id % 7 = 0 then rel_path || ['.MP4', '.heic', '.so', '.min.js', '.exe'][doc_id % 5 + 1] when doc_id % 11 = 0 then 'node_modules/' || rel_path else rel_path end as rel_path from documents where rel_path is not null),
 c as (select *, case when len(list_intersect(string_split(rel_path, '/')[1:-2], [{", ".join(f"'{x}'" for x in sources.SKIPPED_FOLDERS)}])) > 0 then 'built_in_skipped_dir' when regexp_matches(lower(rel_path), '(?:{_ENDINGS})$') then 'built_in_skipped_suffix' end as built_in,
   regexp_matches(rel_path, '\.(?:txt|md|so|log)$') as included, case when regexp_matches(rel_path, '^archive/') then 'archive/*' when regexp_matches(rel_path, '(?:^|/)ledger-') then '**/ledger-*' end as excluded from p),
 s as (select rel_path, coalesce(built_in, case when not included then 'not_included_by_pattern' when excluded is not null then 'excluded_by_pattern' end) as skip_reason, case when built_in is null and included then excluded end as skip_pattern from c)"""


def selected_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of documents, some altered to what is never read, with why they are skipped."""
    odd = F.concat("rel_path", F.element_at(F.array(*map(F.lit, (".MP4", ".heic", ".so", ".min.js", ".exe"))), (F.col("doc_id") % 5 + 1).cast("int")))
    path = F.when(F.col("doc_id") % 7 == 0, odd).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("node_modules/"), "rel_path")).otherwise(F.col("rel_path"))
    p = table(spark, folder, "documents").where("rel_path is not null").select(path.alias("rel_path"))
    out = T.first_glob(F.col("rel_path"), ["archive/*", "**/ledger-*"])
    wanted = T.first_glob(F.col("rel_path"), ["*.txt", "*.md", "*.so", "*.log"])
    reason = F.coalesce(sources.skip_reason(F.col("rel_path")), F.when(wanted.isNull(), sources.NOT_INCLUDED), F.when(out.isNotNull(), sources.EXCLUDED))
    return p.withColumn("skip_reason", reason).withColumn("skip_pattern", F.when(F.col("skip_reason") == sources.EXCLUDED, out))


@query(f"with {_PATHS} select coalesce(skip_reason, 'selected') as outcome, coalesce(skip_pattern, '') as pattern, count(*) as files from s group by 1, 2")
def q_glob(spark: SparkSession, folder: str) -> DataFrame:
    """Files selected and skipped, with the reason: vendor folder, ending, or the pattern that excludes."""
    paths = selected_paths(spark, folder)
    return paths.groupBy(F.coalesce("skip_reason", F.lit("selected")).alias("outcome"), F.coalesce("skip_pattern", F.lit("")).alias("pattern")).agg(F.count(F.lit(1)).alias("files"))


@query(f"with {_PATHS} select rel_path, '- `' || rel_path || '` - ' || skip_reason || coalesce(' `' || skip_pattern || '`', '') as line, count(*) as files from s where skip_reason is not null group by 1, 2")
def q_skipped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Skipped files as they are listed, with reason and pattern."""
    skipped = selected_paths(spark, folder).where("skip_reason is not null")
    return records.skipped_lines(skipped).groupBy("rel_path", "line").agg(F.count(F.lit(1)).alias("files"))


@query("""select doc_id, row_number() over (order by string_split(rel_path, '/'), doc_id) as job_number from documents where rel_path is not null""")
def q_path_order(spark: SparkSession, folder: str) -> DataFrame:
    """Job numbers in the order of the paths' components."""
    paths = table(spark, folder, "documents").where("rel_path is not null").select("doc_id", F.split("rel_path", "/").alias("parts"))
    return E.numbered(paths, F.col("parts"), F.col("doc_id"), name="job_number").select("doc_id", "job_number")


@query(rf"""select doc_id, length(t) > 2000 as was_clipped, md5(case when length(t) > 2000 then regexp_replace(t[1:2000], '[{_SP}]+$', '') || chr(10) || chr(10) || '[Input truncated: first 2000 of ' || length(t) || ' characters.]' else t end) as text_md5
 from (select doc_id, {_nl("text")} as t from documents where text is not null)""")
def q_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut to a limit with a notice."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", T.newlines(F.col("text")).alias("t"))
    text, cut = T.clip(F.col("t"), 2000)
    return d.select("doc_id", cut.alias("was_clipped"), md5(text).alias("text_md5"))


@query("""select doc_id, case when length(text) <= 0 then 0 else floor((length(text) + 4.0 - 1) / 4.0)::int end as tokens, least(greatest(ceil(length(text) / 12000.0), 2), 8)::int as snippets,
 length(text) > 8000 as is_chunked from documents where text is not null""")
def q_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Size in tokens, snippets to ask for, and whether the text is chunked."""
    n = F.length("text")
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", T.estimate_tokens(n).alias("tokens"), T.snippet_request(n).alias("snippets"), (n > 8000).alias("is_chunked"))


@query(rf"""select coalesce(label, '') as label, coalesce(regexp_replace(regexp_replace({_strip('label')}, '[^\pL\pN._-]', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '') as safe, coalesce(regexp_replace(regexp_replace({_strip('label')}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '') as safe_ascii,
 count(*) as n from dogfood_records group by all""")
def q_safe_label(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of records as file names, in both forms."""
    r = table(spark, folder, "dogfood_records")
    name = lambda c: F.coalesce(c, F.lit(""))
    keys = [name(F.col("label")).alias("label"), name(T.safe_label(F.col("label"))).alias("safe"), name(T.safe_label(F.col("label"), True)).alias("safe_ascii")]
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, count(*) as events, count(distinct json_keys(props)) as shapes from events group by 1""")
def q_event_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Events per kind with the number of shapes of their properties."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(F.json_object_keys("props")).alias("shapes"))


# --- Chunking -------------------------------------------------------------------------------------------------------

_MOST = 1000
_UNITS = rf"""doc as (select doc_id, {_nl("text")} as text from documents where text is not null),
 para as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[{_SP}]*\n'), lambda x: {_strip("x")}), lambda x: x != '') as ps from doc),
 units as (select doc_id, flatten(list_transform(ps, lambda p: list_transform(range(0, ((length(p) - 1) // {_MOST} + 1)), lambda i: p[i * {_MOST} + 1 : (i + 1) * {_MOST}]))) as us from para)"""
_PACKED = f"""{_UNITS}, one as (select doc_id, unnest(us) as u, generate_subscripts(us, 1) as i from units),
 rec(doc_id, i, k, size) as (select doc_id, 1::bigint, 0, length(u) from one where i = 1 union all
   select r.doc_id, r.i + 1, case when r.size + 2 + length(o.u) <= {_MOST} then r.k else r.k + 1 end, case when r.size + 2 + length(o.u) <= {_MOST} then r.size + 2 + length(o.u) else length(o.u) end from rec r join one o on o.doc_id = r.doc_id and o.i = r.i + 1),
 packed as (select r.doc_id, r.k + 1 as chunk_index, string_agg(o.u, chr(10) || chr(10) order by o.i) as text from rec r join one o on o.doc_id = r.doc_id and o.i = r.i group by 1, 2
   union all select doc_id, 1, '' from units where len(us) = 0)"""


def chunk_sources(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").where("text is not null").select("doc_id", T.newlines(F.col("text")).alias("text")))


@query(f"with {_UNITS} select doc_id, len(us) as units, coalesce(list_sum(list_transform(us, lambda x: length(x))), 0)::bigint as chars, md5(array_to_string(us, '|')) as units_md5 from units")
def q_paragraph_units(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of every document, long ones in slices."""
    units = C.paragraphs(F.col("text"), _MOST)
    d = chunk_sources(spark, folder).select("doc_id", units.alias("u"))
    chars = F.aggregate(F.transform("u", lambda x: F.length(x)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return d.select("doc_id", F.size("u").alias("units"), chars.alias("chars"), md5(F.array_join("u", "|")).alias("units_md5"))


@query(f"with recursive {_PACKED} select doc_id, format('chunk-{{:04d}}', chunk_index) as chunk_id, chunk_index::int as chunk_index, length(text) as chars, md5(text) as text_md5 from packed")
def q_chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document, packed from paragraphs."""
    chunks = C.plan(chunk_sources(spark, folder), _MOST, path="doc_id")
    return chunks.select("doc_id", "chunk_id", "chunk_index", "chars", md5(F.col("text")).alias("text_md5"))


@query()
def q_chunk_context(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with place, overlap and headings, as the model is given them; checked by brute force in the tests."""
    chunks = C.plan(chunk_sources(spark, folder), 2000, overlap_chars=200, path="doc_id")
    shown = C.render(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("chunk_total"), F.col("text"), F.col("heading_ancestry"), F.col("overlap_text"))
    heads = F.array_join(F.transform("heading_ancestry", lambda h: h["text"]), " > ")
    return chunks.select("doc_id", "chunk_index", "char_start", F.length("overlap_text").alias("overlap_chars"), heads.alias("headings"), F.length(shown).alias("rendered_chars"), md5(shown).alias("rendered_md5"))


_HEADS = rf"""raw as (select doc_id, string_split({_nl("text")}, chr(10)) as a from documents where text is not null), u as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as line_no from raw),
 f as (select *, regexp_extract({_strip("line")}, '^(```|~~~)', 1) as mark from u), fences as (select *, row_number() over (partition by doc_id order by line_no) as k from f where mark != ''),
 st(doc_id, k, line_no, state) as (select doc_id, k, line_no, mark from fences where k = 1 union all select s.doc_id, s.k + 1, n.line_no, case when s.state = '' then n.mark when s.state = n.mark then '' else s.state end from st s join fences n on n.doc_id = s.doc_id and n.k = s.k + 1),
 inside as (select f.*, coalesce((select max_by(state, line_no) from st where st.doc_id = f.doc_id and st.line_no < f.line_no), '') as fence from f where regexp_matches(line, '^#{{1,6}}[{_SP}]+[^{_SP}]')),
 heads as (select doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})', 1)) as level, {_strip(f"regexp_replace(regexp_replace(line, '^#{{1,6}}[{_SP}]+', ''), '[{_SP}]*#*[{_SP}]*$', '')")} as title from inside where fence = '' and mark = ''),
 h as (select * from heads where title != '')"""


@query(f"with recursive {_HEADS} select doc_id, line_no, level, title from h")
def q_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings outside code fences."""
    d = chunk_sources(spark, folder).select("doc_id", F.explode(C.headings(F.col("text"))).alias("h"))
    return d.select("doc_id", F.col("h.line").alias("line_no"), F.col("h.level").alias("level"), F.col("h.text").alias("title"))


@query(f"""with recursive {_HEADS}, a as (select x.doc_id, x.line_no, y.title, y.line_no as yl from h x join h y on x.doc_id = y.doc_id and y.line_no <= x.line_no
 where not exists (select 1 from h z where z.doc_id = x.doc_id and z.line_no > y.line_no and z.line_no <= x.line_no and z.level <= y.level))
 select doc_id, line_no, string_agg(title, ' > ' order by yl) as headings from a group by 1, 2""")
def q_heading_ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """The headings that hold at each heading, outermost first."""
    d = chunk_sources(spark, folder).select("doc_id", C.headings(F.col("text")).alias("all")).select("doc_id", "all", F.explode("all").alias("h"))
    held = F.array_join(F.transform(C.ancestry(F.col("all"), F.col("h.start")), lambda x: x["text"]), " > ")
    return d.select("doc_id", F.col("h.line").alias("line_no"), held.alias("headings"))


@query("""with recursive p as (select distinct result_key, record_key, job_id, length(markdown) + 40 as size from model_results where markdown is not null), n as (select *, row_number() over (partition by record_key, job_id order by result_key) as i from p),
 rec(record_key, job_id, i, k, used) as (select record_key, job_id, i, 0, size from n where i = 1 union all select r.record_key, r.job_id, r.i + 1, case when r.used + n.size <= 3000 then r.k else r.k + 1 end, case when r.used + n.size <= 3000 then r.used + n.size else n.size end from rec r join n on n.record_key = r.record_key and n.job_id is not distinct from r.job_id and n.i = r.i + 1)
 select record_key, job_id, k + 1 as batch, count(*) as payloads from rec group by 1, 2, 3""")
def q_reduce_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of each job in batches for the reduce step."""
    r = table(spark, folder, "model_results").where("markdown is not null").select("result_key", "record_key", "job_id", (F.length("markdown") + 40).alias("size")).distinct()
    return C.batched(r, ["record_key", "job_id"], ["result_key"], "size", 3000).groupBy("record_key", "job_id", "batch").agg(F.count(F.lit(1)).alias("payloads"))


_HEAD = len(C.HEADER % ("", 9999, 9999, 9999) + C.BODY)


@query(rf"""with recursive doc as (select doc_id, {_nl("text")} as text, greatest(4000 - {_HEAD} - length(doc_id::varchar), 1) as most from documents where text is not null),
 para as (select doc_id, most, list_filter(list_transform(regexp_split_to_array(text, '\n[{_SP}]*\n'), lambda x: {_strip("x")}), lambda x: x != '') as ps from doc where length(text) > 4000),
 units as (select doc_id, any_value(most) as most, list(n order by i, k) as ns from (select doc_id, most, i, k, least(most, length(p) - k * most) as n from (select doc_id, most, p, i, unnest(range(0, (length(p) - 1) // most + 1)) as k from (select doc_id, most, unnest(ps) as p, generate_subscripts(ps, 1) as i from para))) group by 1),
 rec(doc_id, i, k, size) as (select doc_id, 1::bigint, 1, ns[1] from units union all select r.doc_id, r.i + 1, case when r.size + 2 + u.ns[r.i + 1] <= u.most then r.k else r.k + 1 end, case when r.size + 2 + u.ns[r.i + 1] <= u.most then r.size + 2 + u.ns[r.i + 1] else u.ns[r.i + 1] end from rec r join units u on u.doc_id = r.doc_id and r.i < len(u.ns))
 select doc_id, coalesce(max(k), 1)::bigint as chunks, true as within from doc left join rec using (doc_id) group by 1""")
def q_plan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per document for calls of at most 4,000 characters: one for a text within it, else planned with room for the lines
    that a chunk is shown with; and whether all are within it as shown."""
    d = chunk_sources(spark, folder)
    one = d.where(F.length("text") <= 4000).select("doc_id", F.lit(1).cast("bigint").alias("chunks"), F.lit(True).alias("within"))
    c = C.plan(d.where(F.length("text") > 4000), 4000, path="doc_id", header=True)
    shown = F.length(C.render(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("chunk_total"), F.col("text"), F.array().cast(C.HEADING), F.lit("")))
    return one.unionByName(c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), (F.max(shown) <= 4000).alias("within")))


@query(rf"""select doc_id, true as within, true as numbered, len(w)::bigint as words, md5(array_to_string(w, ' ')) as words_md5 from (select doc_id, regexp_extract_all({_nl("text")}, '[^{_SP}]+') as w from documents where text is not null)""")
def q_token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 200 white-space tokens as rendered, headings and overlap included: per document whether all are within
    the limit and numbered throughout, and the words of all chunks in order, which are the document's."""
    chunks = C.plan_by_tokens(chunk_sources(spark, folder), 200, overlap_tokens=20, path="doc_id")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ")
    d = chunks.groupBy("doc_id").agg((F.max("tokens") <= 200).alias("within"), ((F.max("chunk_index") == F.max("chunk_total")) & (F.count(F.lit(1)) == F.max("chunk_total"))).alias("numbered"), words.alias("_t"))
    w = F.regexp_extract_all("_t", F.lit(rf"[^{T.SPACE}]+"), F.lit(0))
    return d.select("doc_id", "within", "numbered", F.size(w).cast("bigint").alias("words"), md5(F.array_join(w, " ")).alias("words_md5"))


# --- Evidence -------------------------------------------------------------------------------------------------------


@query(f"with {_LINES}, {_SCORED}, {_DEDUPED} select doc_id, line_no, key, score from d")
def q_dedupe_norm_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The best line of those that say the same, over all documents."""
    best = E.dedupe(scored_lines(spark, folder), E.order_of())
    return best.select("doc_id", "line_no", T.duplicate_key(F.col("text")).alias("key"), "score")


@query(f"with {_LINES}, {_SCORED} select doc_id, line_no, score, rn as rank_in_group from (select *, row_number() over (partition by doc_id order by -score, line_no, char_start, text) as rn from scored) where rn <= 4")
def q_topk_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    """The four best lines of each document."""
    return E.top_per_group(scored_lines(spark, folder), ["doc_id"], E.order_of(), 4).select("doc_id", "line_no", "score", "rank_in_group")


@query(f"""with {_LINES}, {_SCORED}, {_DEDUPED}, p as (select *, row_number() over (partition by doc_id order by -score, line_no, char_start, text) as r from d), q as (select * from p where r <= 4),
 b as (select *, first_value(struct_pack(a := -score, b := doc_id::varchar, c := line_no, d := char_start, e := text)) over (partition by doc_id order by r) as best from q)
 select * from (select doc_id, line_no, score, r as rank_in_group, row_number() over (order by r, best, -score, doc_id::varchar, line_no, char_start, text) as position from b) where position <= 24""")
def q_roundrobin_cap(spark: SparkSession, folder: str) -> DataFrame:
    """24 snippets of all documents, distinct, at most four of a document, in rounds."""
    best = E.dedupe(scored_lines(spark, folder), E.order_of())
    return E.round_robin(best, E.order_of(), per_file=4, most=24).select("doc_id", "line_no", "score", "rank_in_group", "position")


@query()
def q_diversity_select(spark: SparkSession, folder: str) -> DataFrame:
    """Eight snippets of each document that lie apart; checked by brute force in the tests."""
    return E.select_diverse(scored_lines(spark, folder), ["doc_id"], 8).select("doc_id", "position", "score", "line_no")


_CANDS = f"""{_LINES}, d as (select doc_id, {_nl("text")} as source from documents where text is not null),
 c as (select doc_id, line_no * 3 as ord, text from lines union all select doc_id, line_no * 3 + 1, text || ' never written' from lines where line_no % 5 = 0 union all select doc_id, line_no * 3 + 2, '"' || text || '"' from lines where line_no % 3 = 0),
 e as (select c.*, d.source, regexp_replace({_strip("c.text")}, '^["'']+|["'']+$', '', 'g') as bare from c join d using (doc_id)),
 g as (select *, case when bare = '' then 'unverified' when length(bare) > 600 then 'too_long' when {_low("bare")} then 'low_signal' when strpos(source, bare) = 0 then 'unverified' end as early from e),
 v as (select *, case when early is not null then early when row_number() over (partition by doc_id, bare, early is null order by ord) > 1 then 'duplicate' else 'verified' end as reason from g)"""


def checked_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Snippet candidates (lines as they are, altered and quoted) with the reason for dropping them."""
    documents = spread(table(spark, folder, "documents").where("text is not null")).select("doc_id", T.newlines(F.col("text")).alias("src"))
    documents = documents.withColumn("lines", F.transform(F.split("src", "\n"), lambda x, i: F.struct((i + 1).alias("n"), T.strip(x).alias("text"))))
    said = lambda k, text: F.struct(k.alias("ord"), text.alias("text"))
    made = F.transform(
        F.filter("lines", lambda x: x["text"] != ""),
        lambda x: F.array(
            said(x["n"] * 3, x["text"]),
            F.when(x["n"] % 5 == 0, said(x["n"] * 3 + 1, F.concat(x["text"], F.lit(" never written")))),
            F.when(x["n"] % 3 == 0, said(x["n"] * 3 + 2, F.concat(F.lit('"'), x["text"], F.lit('"')))),
        ),
    )
    documents = documents.withColumn("made", F.array_compact(F.flatten(made))).withColumn("found", E.placed(F.col("src"), F.col("made")))
    rows = documents.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.ord", "c.text", "c.char_start")
    return E.drop_reasons(rows, None, ["doc_id"], "ord")


@query(f"with {_CANDS} select doc_id, reason, count(*) as candidates from v group by 1, 2")
def q_verify_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Snippet candidates per document and reason for dropping them."""
    return checked_candidates(spark, folder).groupBy("doc_id", F.coalesce("drop_reason", F.lit("verified")).alias("reason")).agg(F.count(F.lit(1)).alias("candidates"))


# A stand-in for a model's tagged lines, made by an expression that both engines can build.
_KINDS = ("CLAIM", "FACT", "QUOTE", "TASK", "ENTITY", "LINK", "FOLLOW-UP", "NOTE")
_TAGGED = f"""{_LINES}, t as (select doc_id, line_no as ord, line_no % 8 as m, char_start, regexp_replace(text, '[|;=]', ' ', 'g') as text, text as orig from lines),
 i as (select doc_id, ord, replace(lower(case m {' '.join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS))} end), '-', '_') as kind, {_collapse("text")} as text0, m, orig from t),
 x as (select doc_id, ord, kind, case when kind = 'link' then 'https://example.org/' || {_slug("text0")} else null end as url, text0 as text, case when kind = 'entity' then 'person_group' end as entity_type,
   case when strpos(orig, text0) > 0 and length(text0) <= 240 then 'snippet_verified' else 'chunk_only' end as support from i),
 p as (select *, case when kind = 'note' then 'invalid' when kind in ('task', 'follow_up') then 'unsupported_type' when text = '' then 'invalid' end as problem from x),
 k as (select *, case when kind = 'link' and url != '' then 'link:' || {_slug("url")} when kind = 'entity' then 'entity:person-group:' || {_slug("text")} else kind || ':' || {_slug("text")} end as item_key,
   least(0.4 + case when kind in ('blocker','claim','decision','example','requirement','risk') then 0.2 else 0 end + case when support = 'snippet_verified' then 0.25 else 0 end + case when length(text) between 20 and 220 then 0.1 else 0 end + case when kind in ('quote', 'link') then 0.05 else 0 end, 1.0)::decimal(4,3) as rank_score
   from p where problem is null)"""


def extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged lines for every document line, parsed: kinds by line number, the line as text and as snippet."""
    lines = lines_of(spark, folder)
    said = F.regexp_replace("text", "[|;=]", " ")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("line_no") % 8 + 1)
    link = F.concat(F.lit("https://example.org/"), T.slug(T.collapse(said)))
    raw = (
        F.when(kind == "ENTITY", F.concat_ws(" | ", kind, F.lit("Person Group"), said, F.lit("role=owner; team = a b"), said))
        .when(kind == "LINK", F.concat_ws(" | ", kind, link, said, said))
        .otherwise(F.concat_ws(" | ", kind, said, said))
    )
    return parsing.tagged_lines(lines.select("doc_id", F.col("line_no").alias("ord"), F.col("text").alias("orig"), raw.alias("raw")), "raw", source="orig")


def items_of(spark: SparkSession, folder: str) -> DataFrame:
    items = extracted(spark, folder).where("problem is null")
    return items.withColumn("item_key", T.item_key(F.col("kind"), F.col("text"), F.col("entity_type"), F.col("url"))).withColumn("rank_score", T.rank(F.col("kind"), F.col("source_support"), F.col("text")))


@query(f"with {_TAGGED} select doc_id, kind, coalesce(problem, 'ok') as outcome, count(*) as n, sum((support = 'snippet_verified')::int)::bigint as verified from p group by 1, 2, 3")
def q_extract_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged lines parsed: items per document, kind and outcome."""
    e = extracted(spark, folder)
    return e.groupBy("doc_id", "kind", F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("source_support") == "snippet_verified").cast("int")).alias("verified"))


@query(f"with {_TAGGED} select doc_id, ord, item_key, rank_score::double as rank_score from k")
def q_extract_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Key and rank of every item."""
    return items_of(spark, folder).select("doc_id", "ord", "item_key", F.col("rank_score").cast("double").alias("rank_score"))


_MERGED = """m as (select doc_id, item_key, min(ord) as ord, min_by(kind, ord) as kind, coalesce(min_by(text, ord) filter (support = 'snippet_verified'), min_by(text, ord)) as text,
   coalesce(min_by(support, ord) filter (support = 'snippet_verified'), min_by(support, ord)) as support, coalesce(min_by(rank_score, ord) filter (support = 'snippet_verified'), min_by(rank_score, ord)) as rank_score, count(*) as n_merged from k group by 1, 2),
 r as (select *, row_number() over (partition by doc_id order by -rank_score, kind, text, ord) as rn from m), f as (select * from r where rn <= 40)"""


@query(f"with {_TAGGED}, {_MERGED} select doc_id, rn as rank_in_group, kind, md5(text) as text_md5, support as source_support, rank_score::double as rank_score, n_merged from f")
def q_extract_dedupe_file(spark: SparkSession, folder: str) -> DataFrame:
    """Items of each document that mean the same as one, the 40 best."""
    rows = items_of(spark, folder).withColumn("source", F.struct("doc_id", "char_start", "snippet"))
    m = E.merge_items(rows, ["doc_id"], 40)
    return m.select("doc_id", "rank_in_group", "kind", md5(F.col("text")).alias("text_md5"), "source_support", F.col("rank_score").cast("double").alias("rank_score"), "n_merged")


@query(f"""with {_TAGGED}, {_MERGED}, fo as (select *, doc_id * 100000 + rn as o2 from f),
 g as (select item_key, min_by(kind, o2) as kind, coalesce(min_by(rank_score, o2) filter (support = 'snippet_verified'), min_by(rank_score, o2)) as rank_score, count(*) as documents, least(count(distinct doc_id), 6) as sources from fo group by 1) select item_key, kind, rank_score::double as rank_score, documents, sources from g""")
def q_extract_dedupe_run(spark: SparkSession, folder: str) -> DataFrame:
    """Items of all documents that mean the same as one, after each document's own limit."""
    rows = items_of(spark, folder).withColumn("source", F.struct("doc_id", "char_start", "snippet"))
    per_file = E.merge_items(rows, ["doc_id"], 40).select("item_key", "kind", "text", "source_support", "rank_score", F.struct("doc_id", "rank_in_group").alias("ord"), F.struct("doc_id").alias("source"))
    m = E.merge_items(per_file, [])
    return m.select("item_key", "kind", F.col("rank_score").cast("double").alias("rank_score"), F.col("n_merged").alias("documents"), F.size("sources").cast("bigint").alias("sources"))


@query(f"with {_TAGGED} select kind, count(*) as items from k group by 1")
def q_count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Items per kind; kinds without items have no row."""
    return items_of(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("items"))


# Attributes made of an event: ten keys, the first two again, in an order that the event's number turns.
_PAIRS = "list_transform(range(0, 12), lambda i: ['a', 'B c', 'd', 'e', 'f', 'g', 'h', 'i', 'j', 'k'][((i + event_id) % 10 + 1)::int] || ' = ' || i || '-' || coalesce(event_type, ''))"


@query(f"""with e as (select event_id, {_PAIRS} as l from events), u as (select event_id, unnest(l) as p, generate_subscripts(l, 1) as i from e),
 s as (select event_id, i, replace(lower(split_part(p, ' = ', 1)), ' ', '_') as k, split_part(p, ' = ', 2) as v from u), f as (select event_id, k, min(i) as first from s group by 1, 2),
 o as (select *, row_number() over (partition by event_id order by first) as n from f), lim as (select event_id, max(first) as last from o where n <= 8 group by 1)
 select k as attribute, v as value, count(*) as events from (select s.event_id, s.k, max_by(s.v, s.i) as v from s join lim on lim.event_id = s.event_id and s.i <= lim.last group by 1, 2) group by 1, 2""")
def q_attr_map(spark: SparkSession, folder: str) -> DataFrame:
    """Attribute strings of events with more than eight keys, some repeated, through the attribute parser."""
    names = F.array(*map(F.lit, ("a", "B c", "d", "e", "f", "g", "h", "i", "j", "k")))
    pair = lambda i: F.concat(F.element_at(names, ((i + F.col("event_id")) % 10 + 1).cast("int")), F.lit(" = "), i.cast("string"), F.lit("-"), F.coalesce("event_type", F.lit("")))
    e = table(spark, folder, "events").select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), pair), "; ").alias("line"))
    return e.select(F.explode(T.attributes(F.col("line"))).alias("attribute", "value")).groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("events"))


@query()
def q_summary_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Responses read as JSON, labelled sections or plain text; checked by brute force in the tests."""
    r = laid_out(table(spark, folder, "model_results").where("raw_response is not null").select("result_key", "raw_response"), "result_key")
    d = parsing.with_summary(r, "raw_response", "s")
    return d.select(
        "result_key", "s.structured_valid", F.col("s.payload.title").alias("title"), md5(F.col("s.payload.abstract")).alias("abstract_md5"),
        F.size("s.payload.bullets").alias("bullets"), F.size("s.payload.open_questions").alias("open_questions"), F.col("s.payload.confidence").alias("confidence"),
    )


@query("""with r as (select distinct result_key, source, structured_valid, warnings from model_results)
 select source, case when len(coalesce(warnings, [])) > 0 or not coalesce(structured_valid, false) then 'complete_with_warnings' else 'complete' end as status, count(*) as results from r group by 1, 2""")
def q_result_status(spark: SparkSession, folder: str) -> DataFrame:
    """Results per source and status."""
    r = table(spark, folder, "model_results").select("result_key", "source", "structured_valid", "warnings").distinct()
    status = F.when((F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0) | ~F.coalesce("structured_valid", F.lit(False)), "complete_with_warnings").otherwise("complete")
    return r.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("results"))


@query("""with r as (select distinct result_key, warnings from model_results) select result_key, array_to_string(list_filter(list_distinct_ordered, lambda w: not starts_with(w, 'Snippet')), '|') as kept
 from (select result_key, list_filter(coalesce(warnings, []), lambda w, i: list_position(coalesce(warnings, []), w) = i) as list_distinct_ordered from r)""")
def q_warning_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct warnings of each result in order, without those about snippets."""
    r = table(spark, folder, "model_results").select("result_key", "warnings").distinct()
    return r.select("result_key", F.array_join(H.keep_warnings(F.col("warnings"), "Snippet"), "|").alias("kept"))


# --- History --------------------------------------------------------------------------------------------------------

_JOBS = "j as (select distinct * exclude (ingested_at) from dogfood_jobs)"
_RECORDS = "rec as (select distinct * exclude (ingested_at) from dogfood_records)"


def distinct_rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, each delivered row once."""
    return table(spark, folder, name).drop("ingested_at").distinct()


@query(f"with {_JOBS} select record_key, count(*) as total, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in H.STATES) + " from j group by 1")
def q_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs per record and state."""
    return H.state_counts(distinct_rows(spark, folder, "dogfood_jobs"), ["record_key"])


@query(f"""with {_JOBS}, c as (select record_key, count(*) as total, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'complete_with_warnings' or coalesce(warning_count, 0) > 0) as warned from j group by 1)
 select *, case when failed = total then 'failed' when failed > 0 then 'partial' when warned > 0 then 'complete_with_warnings' else 'complete' end as final_status from c""")
def q_final_status(spark: SparkSession, folder: str) -> DataFrame:
    """State of each record by its jobs."""
    return H.run_states(distinct_rows(spark, folder, "dogfood_jobs"), ["record_key"])


_ROLL = "count(*) as jobs, sum(coalesce(chunk_count, 1))::bigint as chunks, sum(coalesce(warning_count, 0))::bigint as warnings, sum(coalesce(duration_ms, 0))::bigint as duration_ms, sum(coalesce(queue_wait_ms, 0))::bigint as queue_wait_ms, max(duration_ms) as longest_ms"


@query(f"with {_JOBS} select record_key, {_ROLL} from j group by 1")
def q_job_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs, chunks, warnings and times per record."""
    return H.rollup_jobs(distinct_rows(spark, folder, "dogfood_jobs"), ["record_key"])


@query(f"""with {_JOBS}, {_RECORDS}, t as (select record_key, {_ROLL} from j group by 1)
 select rec.record_key, coalesce(nullif(t.jobs, 0), rec.jobs_total)::bigint as jobs, coalesce(nullif(t.chunks, 0), rec.chunks_total)::bigint as chunks, coalesce(nullif(t.warnings, 0), rec.warnings_total)::bigint as warnings, coalesce(nullif(t.duration_ms, 0), rec.duration_ms)::bigint as duration_ms from rec left join t using (record_key)""")
def q_run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of each record from its jobs, or as recorded where they are 0 or missing."""
    t = H.rollup_jobs(distinct_rows(spark, folder, "dogfood_jobs"), ["record_key"])
    r = distinct_rows(spark, folder, "dogfood_records").select("record_key", "jobs_total", "chunks_total", "warnings_total", F.col("duration_ms").alias("recorded_ms"))
    pick = lambda a, b, n: H.totals_or(F.col(a), F.col(b)).cast("bigint").alias(n)
    return r.join(t, "record_key", "left").select("record_key", pick("jobs", "jobs_total", "jobs"), pick("chunks", "chunks_total", "chunks"), pick("warnings", "warnings_total", "warnings"), pick("duration_ms", "recorded_ms", "duration_ms"))


@query("""with r as (select distinct result_key, record_key, call_kind, completed_at, length(prompt) as size from model_results) select record_key, coalesce(call_kind, 'unknown') as kind, count(*) as calls, sum(coalesce(size, 0))::bigint as duration_ms from r group by 1, 2""")
def q_call_kind_agg(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per record and kind with a measure summed."""
    r = table(spark, folder, "model_results").select("result_key", "record_key", "call_kind", "completed_at", F.length("prompt").alias("size")).distinct()
    return H.by_kind(r, ["record_key"], "call_kind", F.col("size"))


@query(f"with {_JOBS} select job_key, model, profile, duration_ms from j order by coalesce(duration_ms, -1) desc, job_key limit 10")
def q_slowest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The ten slowest jobs."""
    return H.slowest(distinct_rows(spark, folder, "dogfood_jobs").select("job_key", "model", "profile", "duration_ms"), "duration_ms", ["job_key"], 10)


@query("select event_id, event_type, value from (select event_id, event_type, value from events order by coalesce(value, -1) desc, event_id limit 20)")
def q_slowest_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty events of the highest value."""
    return H.slowest(table(spark, folder, "events").select("event_id", "event_type", "value"), "value", ["event_id"], 20)


@query(f"""with {_JOBS}, s as (select *, date_part('day', recorded_at) <= 15 as early from j), g as (select model, profile, early, {_ROLL} from s group by all), b as (select * from g where early), o as (select * from g where not early)
 select case when b.jobs is not null then b.model else o.model end as model, case when b.jobs is not null then b.profile else o.profile end as profile, """ + ", ".join(f"b.{m} as base_{m}, o.{m} as other_{m}, o.{m} - b.{m} as delta_{m}" for m in ("jobs", "warnings", "duration_ms")) + """,
 case when b.jobs is null then 'added' when o.jobs is null then 'removed' else 'both' end as presence from b full outer join o on b.model is not distinct from o.model and b.profile is not distinct from o.profile""")
def q_timing_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Models and profiles in the first and second half of the month, side by side."""
    j = distinct_rows(spark, folder, "dogfood_jobs").withColumn("early", F.dayofmonth("recorded_at") <= 15)
    g = H.rollup_jobs(j, ["model", "profile", "early"])
    return H.compare(g.where("early"), g.where("not early"), ["model", "profile"], ["jobs", "warnings", "duration_ms"])


@query("""with r as (select distinct result_key, call_kind, run_mode, length(raw_response) as n from model_results), g as (select call_kind, run_mode, count(*) as calls, sum(coalesce(n, 0))::bigint as size from r group by all),
 b as (select * from g where run_mode = 'summarize'), o as (select * from g where run_mode = 'prompt')
 select coalesce(b.call_kind, o.call_kind) as call_kind, b.calls as base_calls, o.calls as other_calls, o.calls - b.calls as delta_calls, b.size as base_size, o.size as other_size, o.size - b.size as delta_size, case when b.calls is null then 'added' when o.calls is null then 'removed' else 'both' end as presence
 from b full outer join o on b.call_kind is not distinct from o.call_kind""")
def q_kind_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per kind in two modes, side by side."""
    r = table(spark, folder, "model_results").select("result_key", "call_kind", "run_mode", F.length("raw_response").alias("n")).distinct()
    g = r.groupBy("call_kind", "run_mode").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("n", F.lit(0))).alias("size"))
    return H.compare(g.where("run_mode = 'summarize'"), g.where("run_mode = 'prompt'"), ["call_kind"], ["calls", "size"])


@query(f"""with {_RECORDS}, p as (select *, lag(record_key) over (partition by label order by recorded_at, record_key) as prev from rec),
 q as (select a.record_key, a.prev, concat_ws(',', """ + ", ".join(f"case when a.{c} is distinct from b.{c} then '{c}' end" for c in ("model", "profile", "run_mode", "schema_version", "status")) + """) as differs from p a join rec b on b.record_key = a.prev) select record_key, prev as base_key, differs from q""")
def q_comparability(spark: SparkSession, folder: str) -> DataFrame:
    """Settings in which a record differs from the one before it under the same label."""
    names = ("model", "profile", "run_mode", "schema_version", "status")
    r = distinct_rows(spark, folder, "dogfood_records")
    both = H.previous(r, ["label"], "recorded_at", "record_key", ["record_key", *names], F.date_trunc("month", "recorded_at")).where("before is not null")
    differs = H.differing([(n, F.col(n), F.col("before." + n)) for n in names])
    return both.select("record_key", F.col("before.record_key").alias("base_key"), F.array_join(differs, ",").alias("differs"))


@query(f"""with {_JOBS}, e as (select model, recorded_at as t, 1 as d from j where duration_ms > 0 union all select model, make_timestamptz(epoch_us(recorded_at) + duration_ms * 1000), -1 from j where duration_ms > 0),
 m as (select model, t, sum(d) as d from e group by all), s as (select model, sum(d) over (partition by model order by t) as n_open from m) select model, greatest(max(n_open), 0)::bigint as peak from s group by 1""")
def q_concurrency_gauge(spark: SparkSession, folder: str) -> DataFrame:
    """The most jobs of each model at work at once, however long they take.

    A job whose end lies beyond the range of timestamps (the year 294247) stays open: its end is the last timestamp.
    """
    j = distinct_rows(spark, folder, "dogfood_jobs").where("duration_ms > 0")
    last = F.lit(2**63 - 1)
    beyond = F.expr("duration_ms > (9223372036854775807L - greatest(unix_micros(recorded_at), 0L)) div 1000")
    end = F.timestamp_micros(F.when(beyond, last).otherwise(F.unix_micros("recorded_at") + F.col("duration_ms") * 1000))
    return H.concurrency(j, ["model"], F.col("recorded_at"), end)


@query("""with l as (unpivot (select plan_id, """ + ", ".join(f"{c}::varchar as {c}" for c in ("plan_name", "chunk_strategy", "chunk_chars", "chunk_tokens", "chunk_overlap_chars", "chunk_overlap_tokens", "preserve_heading_ancestry")) + """ from chunk_plans) on columns(* exclude plan_id) into name setting value v),
 c as (select distinct plan_id from text_chunks), a as (select c.plan_id, l.setting, l.v from c join l using (plan_id)), b as (select c.plan_id, l.setting, l.v from c join l on l.plan_id = 1)
 select a.plan_id, a.setting, b.v as before_value, a.v as after_value, 'update' as change from a join b using (plan_id, setting) where a.v != b.v""")
def q_config_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of the plans in use that differ from those of plan 1."""
    plans = table(spark, folder, "chunk_plans")
    used = table(spark, folder, "text_chunks").select("plan_id").distinct().join(plans, "plan_id")
    after = H.settings_long(used, ["plan_id"], "after_value")
    before = H.settings_long(plans.where("plan_id = 1"), ["plan_id"], "before_value").drop("plan_id")
    return after.join(before, "setting").where("before_value != after_value").withColumn("change", F.lit("update"))


@query("""with r as (select distinct result_key, source, warnings from model_results), u as (select source, unnest(warnings) as w from r),
 c as (select source, case when contains(lower(w), 'timed out') or contains(lower(w), 'timeout') then 'model_timeout' when contains(lower(w), 'context') or contains(lower(w), 'too large') then 'context_overflow'
   when contains(lower(w), 'json') or contains(lower(w), 'parse') or contains(lower(w), 'schema') or contains(lower(w), 'structured') then 'model_output_invalid' else 'internal_error' end as code from u)
 select source, code, case code when 'model_timeout' then 'transient' when 'context_overflow' then 'resource' when 'model_output_invalid' then 'model_output' else 'internal' end as category, code != 'context_overflow' as retryable, count(*) as failures from c group by all""")
def q_failure_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings of results as failure codes per source."""
    r = table(spark, folder, "model_results").select("result_key", "source", "warnings").distinct().select("source", F.explode("warnings").alias("w"))
    return H.failure_counts(r, ["source"], F.col("w"))


@query("""select result_key, max(greatest(round_even(epoch_us(ingested_at - completed_at)::decimal(20,3) / 1000, 0)::bigint, 0)) as wait_ms from model_results group by 1""")
def q_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds from completion to the last delivery of each result."""
    r = table(spark, folder, "model_results")
    return r.groupBy("result_key").agg(F.max(T.elapsed_ms(F.col("completed_at"), F.col("ingested_at"))).alias("wait_ms"))


@query(f"with {_JOBS} select model, profile, grouping(model, profile)::int as level, count(*) as jobs, sum(duration_ms)::bigint as duration_ms from j group by rollup(model, profile)")
def q_duration_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs and time per model and profile, per model, and in all, in one pass."""
    j = distinct_rows(spark, folder, "dogfood_jobs")
    return j.rollup("model", "profile").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("jobs"), F.sum("duration_ms").alias("duration_ms"))


@query(f"""with {_JOBS}, {_RECORDS} select 'no record' as problem, count(*) as jobs from j where not exists (select 1 from rec where rec.record_key = j.record_key) union all select 'ok', count(*) from j where exists (select 1 from rec where rec.record_key = j.record_key)""")
def q_retry_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs whose record is known, and jobs whose record is missing."""
    j = distinct_rows(spark, folder, "dogfood_jobs").select("job_key", "record_key")
    r = table(spark, folder, "dogfood_records").select("record_key").distinct()
    missing = j.join(r, "record_key", "left_anti").agg(F.lit("no record").alias("problem"), F.count(F.lit(1)).alias("jobs"))
    return missing.unionByName(j.join(r, "record_key", "left_semi").agg(F.lit("ok").alias("problem"), F.count(F.lit(1)).alias("jobs")))


@query("""select l_returnflag, l_linestatus, count(*) as lines, sum(l_quantity) as quantity, round(avg(l_discount), 6) as discount from lineitem group by 1, 2""")
def q_line_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A plain rollup over the largest star table, for scale."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


# --- Packages and runs ----------------------------------------------------------------------------------------------


@query(f"""with {_LINES}, {_SCORED}, {_DEDUPED}, p as (select *, row_number() over (partition by doc_id order by -score, line_no, char_start, text) as r from d), kept as (select doc_id, count(*) as snippets, max(score) as best from p where r <= 4 group by 1)
 select x.doc_id, x.lang, x.source, coalesce(kept.snippets, 0)::bigint as snippets, kept.best from documents x left join kept using (doc_id)""")
def q_bundle_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their distinct snippets attached; those without keep their row."""
    best = E.top_per_group(E.dedupe(scored_lines(spark, folder), E.order_of()), ["doc_id"], E.order_of(), 4)
    kept = best.groupBy("doc_id").agg(F.count(F.lit(1)).alias("snippets"), F.max("score").alias("best"))
    return table(spark, folder, "documents").select("doc_id", "lang", "source").join(kept, "doc_id", "left").withColumn("snippets", F.coalesce("snippets", F.lit(0)))


_TURN = "row_number() over (partition by source order by r, best, -score, path, line_no, char_start, text)"


@query(f"""with {_LINES}, {_SCORED}, s as (select d.source, c.*, c.doc_id::varchar as path, {_dup("c.text")} as key from scored c join documents d using (doc_id)),
 kk as (select * from s where key != '' qualify row_number() over (partition by source, key order by -score, path, line_no, char_start, text) = 1),
 g as (select *, row_number() over (partition by source, path order by -score, line_no, char_start, text) as r from kk qualify r <= 4),
 f as (select *, first_value(struct_pack(a := -score, b := path, c := line_no, d := char_start, e := text)) over (partition by source, path order by r) as best from g),
 p as (select *, {_TURN} as position, '- [' || score || '] ' || path || ': ' || text as line from f qualify position <= 24),
 w as (select *, sum(length(line) + 1) over (partition by source order by position) - 1 as upto from p),
 m as (select source, count(*) filter (upto <= 4000) as snippets, count(distinct path) filter (upto <= 4000) as files, count(*) filter (upto > 4000) as dropped, coalesce(string_agg(line, chr(10) order by position) filter (upto <= 4000), '') as markdown from w group by 1)
 select source, snippets, files, dropped, length(markdown) as chars, snippets > 0 as fit, md5(markdown) as markdown_md5, length(markdown) + 18 + length((length(markdown) + 18)::varchar) + case when length((length(markdown) + 18 + length((length(markdown) + 18)::varchar))::varchar) > length((length(markdown) + 18)::varchar) then 1 else 0 end as stated_chars from m""")
def q_snippet_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A package of snippets per source folder under a budget of characters, rendered, and the size that it states of itself."""
    rows = scored_lines(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    packs = K.snippet_packs(rows, ["source"], most=24, per_file=4, max_chars=4000)
    stated = F.length(K.with_size(F.col("markdown")))
    return packs.select("source", "snippets", "files", "dropped", "chars", "fit", md5(F.col("markdown")).alias("markdown_md5"), stated.alias("stated_chars"))


@query()
def q_summary_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of a source's results bundled under a budget; checked by invariants in the tests."""
    r = laid_out(table(spark, folder, "model_results").where("raw_response is not null").select("result_key", "source", "raw_response"), "result_key")
    items = parsing.with_summary(r, "raw_response", "s").select("result_key", "source", "s.payload.*")
    return K.bundles(items, ["source"], "result_key", most=20, max_chars=6000)


@query()
def q_result_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Responses read and rendered as Markdown, and what a compact template shows of them; checked in the tests."""
    r = laid_out(table(spark, folder, "model_results").where("raw_response is not null").select("result_key", "raw_response"), "result_key")
    s = parsing.with_summary(r, "raw_response", "s").withColumn("s", F.col("s.payload"))
    return s.select("result_key", md5(records.summary_markdown(F.col("s"))).alias("markdown_md5"), md5(F.to_json(records.shaped(F.col("s"), "compact"))).alias("compact_md5"))


_KEYS = (("title", "string"), ("abstract", "string"), ("bullets", "array"), ("open_questions", "array"), ("confidence", "string"))
_BODY = rf"""r as (select distinct result_key, raw_response from model_results where raw_response is not null),
 x as (select result_key, {_strip("regexp_replace(regexp_replace(" + _strip("raw_response") + r", '^```[^" + chr(92) + r"n]*" + chr(92) + r"n', ''), '" + chr(92) + r"n```[^" + chr(92) + r"n]*$', '')")} as t from r),
 b as (select result_key, case when json_valid(t) and starts_with(t, '{{') then t when json_valid(nullif(regexp_extract(t, '(?s)(\{{.*\}})', 1), '')) then regexp_extract(t, '(?s)(\{{.*\}})', 1) end as b from x)"""
_ERRORS = " union all ".join(
    ["select result_key, '$: is not JSON' as violation from b where b is null"]
    + [f"select result_key, '$: lacks {k}' from b where b is not null and json_type(b, '$.{k}') is null" for k, _ in _KEYS]
    + [f"select result_key, '$.{k}: must be {t}' from b where json_type(b, '$.{k}') != '{'VARCHAR' if t == 'string' else 'ARRAY'}'" for k, t in _KEYS]
    + ["select result_key, '$.confidence: is not an allowed value' from b where json_type(b, '$.confidence') is not null and (json_type(b, '$.confidence') != 'VARCHAR' or b->>'$.confidence' not in ('low', 'medium', 'high'))"]
    + [f"select result_key, '$.{k}[' || i || ']: must be string' from (select result_key, unnest(json_extract(b, '$.{k}[*]')) as v, generate_subscripts(json_extract(b, '$.{k}[*]'), 1) - 1 as i from b where json_type(b, '$.{k}') = 'ARRAY') where json_type(v) != 'VARCHAR'" for k, t in _KEYS if t == "array"]
)


@query(f"with {_BODY}, e as ({_ERRORS}) select violation, count(*) as results from b left join e using (result_key) group by 1")
def q_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """JSON responses checked against the contract of a summary: errors with their paths, per kind."""
    r = laid_out(table(spark, folder, "model_results").where("raw_response is not null").select("result_key", "raw_response"), "result_key")
    checked = r.select("result_key", contracts.violations(parsing.json_body(F.col("raw_response")), contracts.SUMMARY).alias("e"))
    return checked.select(F.explode_outer("e").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("results"))


# --- Records --------------------------------------------------------------------------------------------------------

_TENTHS = "(({0} + 50) // 1000) || '.' || (({0} + 50) // 100) % 10 || 's'"


@query(f"""with {_JOBS} select job_key, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as label, true as same, case when duration_ms is null then '' when duration_ms < 1000 then duration_ms || 'ms' when duration_ms < 60000 then {_TENTHS.format("duration_ms")}
   else (duration_ms // 60000) || 'm ' || {_TENTHS.format("(duration_ms % 60000)")} end as took from j""")
def q_time_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Times and durations of jobs as they are shown, and whether a time is read back to the millisecond."""
    j = distinct_rows(spark, folder, "dogfood_jobs").select("job_key", "recorded_at", "duration_ms")
    label = T.timestamp_label(F.col("recorded_at"))
    return j.select("job_key", label.alias("label"), (T.timestamp_of(label) == F.date_trunc("millisecond", "recorded_at")).alias("same"), T.duration_label(F.col("duration_ms")).alias("took"))


@query("""with e as (select event_id, (props->>'$.k')::bigint as k from events),
 s as (select k, case event_id % 5 when 0 then k when 1 then k when 3 then k end as whole, case when event_id % 5 in (0, 1, 3) and k between 1 and 5 then k end as score, k::varchar as text, event_id % 5 as m from e)
 select m::bigint as shape, whole, score::int as score, case when m = 2 then case when k % 2 = 1 then 'true' else 'false' end when m = 1 then k || '.5' else case when m = 4 then 'k' || text else text end end as text, count(*) as events from s group by all""")
def q_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON texts at a dotted path: as text, as a lenient whole number and as a score; the values are numbers, fractions,
    truth values, texts with a number and others."""
    k = T.at_path(F.col("props"), "k").cast("bigint")
    m = F.col("event_id") % 5
    value = F.when(m == 0, k.cast("string")).when(m == 1, F.concat(k.cast("string"), F.lit(".5"))).when(m == 2, (k % 2 == 1).cast("string")).when(m == 3, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"k'), k.cast("string"), F.lit('"')))
    e = table(spark, folder, "events").select(m.alias("shape"), F.concat(F.lit('{"a": {"b": '), value, F.lit("}}")).alias("j"))
    e = e.select("shape", T.whole_number(F.col("j"), "a.b").alias("whole"), T.score(F.col("j"), "a.b").alias("score"), T.at_path(F.col("j"), "a.b").alias("text"))
    return e.groupBy("shape", "whole", "score", "text").agg(F.count(F.lit(1)).alias("events"))


@query(f"""with {_JOBS} select record_key, count(*) as total, greatest(0, count(*) - count(*) filter (status in ('complete', 'complete_with_warnings')) - count(*) filter (status = 'running') - count(*) filter (status = 'failed')) as waiting from j group by 1""")
def q_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of each record in all and those that still wait."""
    c = H.state_counts(distinct_rows(spark, folder, "dogfood_jobs"), ["record_key"])
    done = F.col("complete") + F.col("complete_with_warnings")
    return c.select("record_key", "total", T.queued(F.col("total"), done, F.col("running"), F.col("failed")).alias("waiting"))


@query(rf"""select plan_id, budget, count(*) as chunks, count(*) filter (n <= budget) as within from (select plan_id, greatest(1, least(4096, floor(chunk_chars * 2 * 0.85)::int - 1024)) as budget from chunk_plans)
 join (select distinct chunk_key, plan_id, case when length(text) <= 0 then 0 else floor((length(text) + 3) / 4.0) end as n from text_chunks where text is not null) using (plan_id) group by 1, 2""")
def q_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per plan, and those within the token budget of a context of twice the plan's characters."""
    plans = table(spark, folder, "chunk_plans").select("plan_id", T.token_budget(F.col("chunk_chars") * 2).alias("budget"))
    c = table(spark, folder, "text_chunks").where("text is not null").select("chunk_key", "plan_id", T.estimate_tokens(F.length("text")).alias("n")).distinct()
    return c.join(small(plans), "plan_id").groupBy("plan_id", "budget").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n") <= F.col("budget")).alias("within"))


@query("select case when starts_with(rel_path, 'archive/') then rel_path[9:] else rel_path end as shown, count(*) as files from documents where rel_path is not null group by 1")
def q_display_path(spark: SparkSession, folder: str) -> DataFrame:
    """Paths as they are shown from one folder."""
    return table(spark, folder, "documents").where("rel_path is not null").groupBy(T.below(F.col("rel_path"), "archive").alias("shown")).agg(F.count(F.lit(1)).alias("files"))


_STATUS = f"""{_CANDS}, st as (select d.doc_id, least(greatest(ceil(length(d.text) / 12000.0), 2), 8)::bigint as requested, count(*) as candidates, count(*) filter (reason = 'verified') as verified, """ + ", ".join(f"count(*) filter (reason = '{r}') as dropped_{r}" for r in records.DROP_REASONS) + """
 from v join documents d using (doc_id) group by 1, 2), status as (select *, least(requested, verified) as selected from st)"""


def snippet_statuses(spark: SparkSession, folder: str) -> DataFrame:
    size = table(spark, folder, "documents").select("doc_id", "source", F.length("text").alias("_n"))
    rows = checked_candidates(spark, folder).select("doc_id", "drop_reason").join(size, "doc_id")
    return records.snippet_status(rows, ["doc_id", "source"], T.snippet_request(F.max("_n")))


@query(f"with {_STATUS} select * from status")
def q_snippet_status(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets requested, found, verified, selected and dropped per document."""
    return snippet_statuses(spark, folder).withColumn("requested", F.col("requested").cast("bigint")).drop("source")


@query(f"with {_STATUS} select source, count(*) as jobs, " + ", ".join(f"sum({c})::bigint as {c}" for c in ("requested", "candidates", "verified", "selected", *["dropped_" + r for r in records.DROP_REASONS])) + " from status join documents using (doc_id) group by 1")
def q_quality_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The same, summed per source."""
    return records.quality_totals(snippet_statuses(spark, folder), ["source"])


@query(f"""with {_TAGGED}, c as (select doc_id, count(*) as candidates, count(*) filter (problem is null) as parsed, count(*) filter (problem = 'invalid') as invalid, count(*) filter (problem = 'unsupported_type') as unsupported from p group by 1),
 w as (select doc_id, string_agg(ord, ',' order by ord) as samples from (select * from p where problem = 'invalid' qualify row_number() over (partition by doc_id order by ord) <= 5) group by 1) select c.*, coalesce(w.samples, '') as samples from c left join w using (doc_id)""")
def q_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Lines read, parsed, invalid and unsupported per document, with the first five invalid ones (their numbers)."""
    e = extracted(spark, folder).withColumn("_raw", F.col("ord").cast("string"))
    return records.diagnostics(e, ["doc_id"], "ord", "_raw").withColumn("samples", F.array_join("samples", ","))


@query("select run_path, run_id, status, epoch_us(recorded_at) as recorded_us from (select distinct * exclude (ingested_at) from dogfood_records) where run_path is not null and status is not null qualify row_number() over (partition by run_path order by recorded_at desc, run_id desc, status desc) = 1")
def q_run_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One entry per run path from all deliveries, the last one recorded."""
    c = records.catalogue(table(spark, folder, "dogfood_records").select("run_path", "run_id", "status", "recorded_at"))
    return c.select("run_path", "run_id", "status", F.unix_micros("recorded_at").alias("recorded_us"))


_RESULTS = "res as (select record_key, job_id, max(raw_response) as payload, max(markdown) as markdown from model_results group by 1, 2)"


def job_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, one result per job)."""
    jobs = distinct_rows(spark, folder, "dogfood_jobs").select("job_key", "record_key", "job_id", "status")
    results = table(spark, folder, "model_results").groupBy("record_key", "job_id").agg(F.max("raw_response").alias("payload"), F.max("markdown").alias("markdown"))
    return jobs, results


@query(f"""with {_JOBS}, {_RESULTS}, x as (select j.status, payload from j left join res on res.record_key = j.record_key and res.job_id = j.job_id)
 select status, case when status not in ('complete', 'complete_with_warnings') then 'job_not_complete' when payload is null then 'missing_result' when not json_valid(payload) then 'malformed_json' else 'no_snippets' end as skip_reason, count(*) as jobs from x group by 1, 2""")
def q_job_results(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs per state and reason why their result has no snippets to offer (the tables' results have none)."""
    jobs, results = job_results(spark, folder)
    return sources.results_with_reasons(jobs, results, ["record_key", "job_id"]).groupBy("status", "skip_reason").agg(F.count(F.lit(1)).alias("jobs"))


@query(f"""with {_JOBS}, {_RESULTS}, x as (select j.status, payload, markdown from j left join res on res.record_key = j.record_key and res.job_id = j.job_id)
 select status, payload is not null as has_json, markdown is not null as has_markdown, case when status not in ('complete', 'complete_with_warnings') then 'job_not_complete' when payload is null and markdown is null then 'missing_result_artifacts' when payload is not null and not json_valid(payload) then 'malformed_json' else 'collected' end as outcome, count(*) as jobs from x group by all""")
def q_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with the artifacts found for them, counted by state and outcome."""
    jobs, results = job_results(spark, folder)
    c = K.collection(jobs, results.withColumnRenamed("payload", "json"), ["record_key", "job_id"])
    return c.groupBy("status", "has_json", "has_markdown", "outcome").agg(F.count(F.lit(1)).alias("jobs"))


@query(f"""with {_JOBS}, s as (select model, count(*) filter (date_part('day', recorded_at) > 15) - count(*) filter (date_part('day', recorded_at) <= 15) as d from j group by 1) select model, case when d > 0 then '+' || d else d::varchar end as change from s""")
def q_delta_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Per model, how many more jobs the second half of the month has, as it is shown."""
    j = distinct_rows(spark, folder, "dogfood_jobs")
    late = F.dayofmonth("recorded_at") > 15
    return j.groupBy("model").agg((F.count_if(late) - F.count_if(~late)).alias("d")).select("model", T.sign(F.col("d")).alias("change"))


@query(f"""with {_BODY}, k as (select b, case when b is not null then json_keys(b) else [] end as ks from b), s as (select list_has_all(ks, ['title', 'abstract', 'bullets']) as a, list_has_all(ks, ['items']) as i, list_has_all(ks, ['title', 'confidence']) as c from k)
 select case when a::int + i::int + c::int = 1 then case when a then 'summary' when i then 'extract' else 'rated' end end as shape, count(*) as results from s group by 1""")
def q_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """JSON responses by the one contract whose marking keys they have."""
    r = laid_out(table(spark, folder, "model_results").where("raw_response is not null").select("result_key", "raw_response"), "result_key")
    shape = contracts.shape(parsing.json_body(F.col("raw_response")), {"summary": ["title", "abstract", "bullets"], "extract": ["items"], "rated": ["title", "confidence"]})
    return r.select(shape.alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("results"))


@query(f"""with {_LINES} select doc_id, line_no, char_start as start_char, (char_start + length(text))::bigint as end_char, line_no as start_line, case when line_no % 3 = 0 then 'other/' || doc_id end as source_path, md5(text) as text_md5 from lines""")
def q_snippet_records(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets written as JSON under either name of their places, read back as records."""
    job = F.concat(F.lit("job/"), F.col("doc_id").cast("string"))
    end = F.col("char_start") + F.length("text")
    path = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("other/"), F.col("doc_id").cast("string"))).otherwise(job)
    a = F.to_json(F.struct(F.concat(F.lit("  "), "text").alias("text"), F.col("char_start").alias("start_char"), end.alias("end_char"), F.col("line_no").cast("string").alias("start_line"), path.alias("source_path")))
    b = F.to_json(F.struct("text", "char_start", end.cast("string").alias("char_end"), F.col("line_no").alias("start_line"), path.alias("source_path")))
    rows = lines_of(spark, folder).select("doc_id", "line_no", job.alias("job"), F.when(F.col("line_no") % 2 == 0, a).otherwise(b).alias("j"))
    r = rows.select("doc_id", "line_no", records.snippet_record(F.col("job"), F.col("j")).alias("r"))
    return r.select("doc_id", "line_no", "r.start_char", "r.end_char", "r.start_line", "r.source_path", md5(F.col("r.text")).alias("text_md5"))


@query()
def q_pipeline_run(spark: SparkSession, folder: str) -> DataFrame:
    """A whole summarize run over all documents with the extractive stand-in for a model: jobs with status, chunks, verified
    and selected snippets."""
    texts = spread(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.col("text").alias("content")))
    run = P.summarize(texts, model.ExtractiveStub(), P.Settings(chunk_chars=4000, overlap_chars=200))
    return run.jobs.select("rel_path", "status", "chunks", "verified", "selected", "title")
