"""Queries over texts, pages and literals: cleaning, extraction, stems, fingerprints, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import chunking, dates, text
from inkwell.plans.registry import query
from inkwell.session import table


def said(*snippets: str | None, by: int = 1) -> tuple[Callable[[], Column], str]:
    """A snippet for each document, in turn (`by` documents each), with a number of its own for #, before its whole text: what makes the Column, and SQL."""

    def column() -> Column:
        k = F.floor(F.col("doc_id") / by).cast("bigint")
        one = F.element_at(F.array(*[F.lit(x) for x in snippets]), (k % len(snippets) + 1).cast("int"))
        return F.concat(F.replace(one, F.lit("#"), (F.col("doc_id") % 28 + 1).cast("string")), F.lit("\n"), F.coalesce("text", F.lit("")))

    listed = ", ".join("null" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in snippets)
    return column, f"(replace([{listed}][(doc_id // {by}) % {len(snippets)} + 1], '#', (doc_id % 28 + 1)::varchar) || chr(10) || coalesce(text, ''))"


def re2(pattern: str) -> str:
    """A marked pattern as DuckDB reads it: letters have no case there without a flag for it."""
    return pattern.replace("(?iu)", "(?i)")


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BLOCKS = "{}"
for _tag in text.HTML_BLOCKS:
    _BLOCKS = f"regexp_replace({_BLOCKS}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_PLAIN = f"regexp_replace(regexp_replace({_BLOCKS.format("regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')")}, '{text.BLOCK_ENDS.replace('(?:br', '(?:br')}', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _character in text.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_character.replace(chr(39), chr(39) * 2)}')"


def re2_words(pattern: str) -> str:
    """re2() of a pattern with word edges: letters beyond ASCII are none to DuckDB, so edges are said with what stands there."""
    plain = pattern.replace(r"(?<![\p{L}\p{N}])", r"(?:^|[^\p{L}\p{N}])").replace(r"(?![\p{L}\p{N}])", r"(?:[^\p{L}\p{N}]|$)")
    parts = [re.sub(r"^\\b|\\b$", lambda m: r"(?:^|[^\p{L}\p{N}_])" if m.start() == 0 else r"(?:[^\p{L}\p{N}_]|$)", x) for x in plain.split("|")]
    return "(?i)" + "|".join(parts)


@query("html_strip", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as content from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stripped_tags("html").alias("content"))


#: SQL of html_text() over the column html of pages.
HTML_TEXT = f"""with t as (select page_id, {_PLAIN} as body from pages),
    l as (select page_id, list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x{{A0}}\\r]+', ' ', 'g'))) as ls from t)
    select page_id, {TRIM.format("regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} as content from l"""


@query("html_to_text", HTML_TEXT)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("content"))


@query(
    "page_links",
    r"""with a as (select page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, unnest(regexp_extract_all(html, 'href="([^"#]*)', 1)) as href from pages)
    select page_id, host, count(*) as n_links, count(distinct regexp_replace(href, '/+$', '')) as n_targets,
      count(*) filter (where href like '/%') as n_local
    from a where href <> '' group by page_id, host""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.sources.pages import links

    found = links(table(spark, sf_dir, "pages"))
    return found.groupBy("page_id", "host").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"), F.count_if(F.startswith("href", F.lit("/"))).alias("n_local"))


@query(
    "content_fingerprints",
    "select doc_id, md5(text) as md5, sha256(text) as sha256, sha1(text)[1:16] as short_id, length(text) as n from documents",
)
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), text.short_id("text").alias("short_id"), F.length("text").cast("bigint").alias("n"))


@query(
    "ordered_md5",
    "select l_orderkey as order_key, md5(string_agg(coalesce(l_returnflag, ''), '|' order by l_linenumber, coalesce(l_returnflag, ''))) as fingerprint from lineitem group by 1",
)
def ordered_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.operators.upkeep import fingerprints

    return fingerprints(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber").withColumnRenamed("l_orderkey", "order_key")


@query(
    "exact_duplicates",
    """with h as (select doc_id, sha256(text) as h from documents), r as (select doc_id, h, row_number() over (partition by h order by doc_id) as rn, count(*) over (partition by h) as n from h)
    select doc_id, h as content_hash, n as copies from r where rn = 1 and n > 1""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "content_hash", "copies")


_CITED, _CITED_SQL = said("podle #/2012 Sb., § #a a § 3", "zákon č. 262 / 20#, paragraf 5#", "bez citace", None, "§ # a paragraf #, § 10b", "č. 1234/1999 a #/2001")


@query(
    "citation_parse",
    f"with q as (select doc_id, {_CITED_SQL} as s from documents) select doc_id, try_cast(nullif(regexp_extract(s, '{text.CITATION}', 1), '') as int) as number, try_cast(nullif(regexp_extract(s, '{text.CITATION}', 2), '') as int) as year from q",
)
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first citation in whole texts, before which sentences with and without one were put."""
    return table(spark, sf_dir, "documents").select("doc_id", text.citation(_CITED()).alias("c")).select("doc_id", "c.number", "c.year")


@query(
    "paragraph_parse",
    f"""with q as (select doc_id, {_CITED_SQL} as s from documents), m as (select doc_id, generate_subscripts(regexp_extract_all(s, '{re2(text.PARAGRAPH)}', 1), 1) as i, unnest(regexp_extract_all(s, '{re2(text.PARAGRAPH)}', 1)) as p from q),
    d as (select doc_id, p, min(i) as i from m group by 1, 2), j as (select doc_id, string_agg(p, ',' order by i) as ps from d group by 1)
    select doc_id, coalesce(ps, '') as paragraphs from q left join j using (doc_id)""",
)
def paragraph_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(text.paragraphs(_CITED()), ","), F.lit("")).alias("paragraphs"))


_ASKED, _ASKED_SQL = said("stav k #. 3. 2020", "v roce 2019", "bez data", "#/2012 platný roku 2015", "31. 2. 2021", "za rok 20# podle 262/2006", None)
_DAY = "case when x.y <> '' then x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') else yy || '-12-31' end"


@query(
    "asof_parse",
    f"""with q as (select doc_id, {_ASKED_SQL} as s from documents), m as (select doc_id, s, regexp_extract(s, '{text.CITATION}', 0) as c from q),
    t as (select doc_id, case when c = '' then s else substring(s, 1, strpos(s, c) - 1) || substring(s, strpos(s, c) + length(c)) end as s from m),
    p as (select doc_id, s, regexp_extract(s, '{dates.NUMERIC_DATE}', ['d', 'm', 'y']) as x, nullif(regexp_extract(s, '{dates.YEAR_CONTEXT}', 1), '') as yy from t)
    select doc_id, {_DAY} as as_of, cast(try_cast({_DAY} as date) as varchar) as day from p""",
)
def asof_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", dates.asked_date(_ASKED(), text.CITATION).alias("as_of"))
    return asked.select("doc_id", "as_of", F.try_to_date("as_of", "yyyy-MM-dd").cast("string").alias("day"))


_DATED, _DATED_SQL = said("#. ledna 2020", "31. února 2020", "#. září 2021", "#. 2. 2003", "#. Prosince 1999", None)
_CASED, _CASED_SQL = said("Vol-5/79", "#/80", "S#/2016/VZ", "bez", "x/0#", by=6)
_MONTH = "list_position([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "], x.m)"


@query(
    "date_parse",
    rf"""with q as (select doc_id, {_DATED_SQL} as s, split_part({_CASED_SQL}, chr(10), 1) as c from documents),
    p as (select doc_id, regexp_extract(translate(lower(s), 'áčďéěíňóřšťúůýž', 'acdeeinorstuuyz'), '(\d{{1,2}})\.\s*([a-z]+)\s+(\d{{4}})', ['d', 'm', 'y']) as x, nullif(regexp_extract(s, '{dates.NUMERIC_DATE}', 0), '') as num,
      nullif(regexp_extract(c, '/(\d{{4}})(?:\W|$)', 1), '') as y4, try_cast(nullif(regexp_extract(c, '/(\d{{2}})(?:\W|$)', 1), '') as int) as y2 from q)
    select doc_id, cast(case when {_MONTH} > 0 then try_cast(x.y || '-' || lpad({_MONTH}::varchar, 2, '0') || '-' || lpad(x.d, 2, '0') as date) end as varchar) as named, num is not null as numeric,
      coalesce(try_cast(y4 as int), case when y2 <= 79 then 2000 + y2 else 1900 + y2 end) as case_year from p""",
)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _DATED().alias("s"), F.substring_index(_CASED(), "\n", 1).alias("c"))
    return rows.select("doc_id", dates.named_date("s").cast("string").alias("named"), dates.numeric_iso("s").isNotNull().alias("numeric"), dates.case_year("c").alias("case_year"))


def _stem_sql(word: str) -> str:
    out = "case"
    for longer, suffixes in text.CASE_SUFFIXES:
        k = len(suffixes[0])
        out += f" when length({word}) > {longer} and right({word}, {k}) in ({', '.join(repr(s) for s in suffixes)}) then left({word}, length({word}) - {k})"
    return out + f" else {word} end"


def _stems_sql() -> str:
    """The stems of a list of words, as nested list functions with {} for the list."""
    ends = """case when s = '' then s when right(s, 2) = 'čt' then left(s, length(s) - 2) || 'ck' when right(s, 2) = 'št' then left(s, length(s) - 2) || 'sk'
      when right(s, 1) in ('c', 'č') then left(s, length(s) - 1) || 'k' when right(s, 1) in ('z', 'ž') then left(s, length(s) - 1) || 'h'
      when length(s) > 1 and substring(s, length(s) - 1, 1) = 'e' then left(s, length(s) - 2) || right(s, 1)
      when length(s) > 2 and substring(s, length(s) - 1, 1) = 'ů' then left(s, length(s) - 2) || 'o' || right(s, 1) else s end"""
    first = f"list_transform({{}}, lambda w: {_stem_sql('w')})"
    second = f"list_transform({first}, lambda s: case when length(s) > 5 and right(s, 2) in ('ov', 'in', 'ův') then left(s, length(s) - 2) else s end)"
    return f"list_transform({second}, lambda s: {ends})"


STEMS_SQL = _stems_sql()


@query(
    "czech_stem",
    f"""with w as (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '{text.WORD_BREAKS}'), lambda x: x <> '')) as w from documents),
    a as (select w, {_stem_sql('w')} as s from w),
    b as (select w, case when length(s) > 5 and right(s, 2) in ('ov', 'in', 'ův') then left(s, length(s) - 2) else s end as s from a)
    select w as word, case when s = '' then s when right(s, 2) = 'čt' then left(s, length(s) - 2) || 'ck' when right(s, 2) = 'št' then left(s, length(s) - 2) || 'sk'
      when right(s, 1) in ('c', 'č') then left(s, length(s) - 1) || 'k' when right(s, 1) in ('z', 'ž') then left(s, length(s) - 1) || 'h'
      when length(s) > 1 and substring(s, length(s) - 1, 1) = 'e' then left(s, length(s) - 2) || right(s, 1)
      when length(s) > 2 and substring(s, length(s) - 1, 1) = 'ů' then left(s, length(s) - 2) || 'o' || right(s, 1) else s end as stem from b""",
)
def czech_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    different = table(spark, sf_dir, "documents").select(F.explode(text.words("text")).alias("word")).distinct()
    return different.select("word", text.stem("word").alias("stem"))


@query(
    "text_words",
    f"""select doc_id, len(list_filter(regexp_split_to_array(lower(text), '{text.WORD_BREAKS}'), lambda x: x <> ''))::bigint as n_words,
      trim(regexp_replace(text, '\\s+', ' ', 'g')) as collapsed, translate(lower(text), 'áčďéěíňóřšťúůýž', 'acdeeinorstuuyz') as plain from documents""",
)
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.words("text")).cast("bigint").alias("n_words"), text.collapsed("text").alias("collapsed"), text.without_diacritics("text").alias("plain"))


@query(
    "keyword_terms",
    r"""with w as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: length(x) >= 4) as ws from documents),
    u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from w), f as (select doc_id, w, min(i) as i from u group by 1, 2),
    r as (select *, row_number() over (partition by doc_id order by i) as rn from f)
    select doc_id, string_agg(w, ' ' order by i) as keywords from r where rn <= 6 group by doc_id""",
)
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.keywords("text").alias("k"))
    return found.filter(F.size("k") > 0).select("doc_id", F.array_join("k", " ").alias("keywords"))


_SPACED, _SPACED_SQL = said("S o u d n í\nRozhodnutí Nejvyššího soudu o odvolání číslo #", "krátký\nstřední řádek", "a\nb", "obsah ....... #\nVěc: žaloba na plnění č. #")


@query(
    "title_guess",
    f"""with l as (select doc_id, {_SPACED_SQL} as s from documents), x as (select doc_id, list_transform(string_split(s, chr(10))[1:60], lambda x: trim(x)) as ls from l),
    f as (select doc_id, ls, list_filter(ls, lambda x: length(x) >= 15 and not contains(x, '...') and not (len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')) >= 3 and 2 * len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: length(t) = 1)) > len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')))) as fine from x)
    select doc_id, left(coalesce(nullif(list_reduce(fine, lambda a, b: case when length(b) > length(a) then b else a end, ''), ''), list_filter(ls, lambda x: length(x) >= 8)[1], 'bez názvu'), 200) as title from f""",
)
def title_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title among letter-spaced, dotted and short lines before whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.guessed_title(_SPACED(), F.lit("bez názvu")).alias("title"))


@query(
    "text_escapes",
    """select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') as escaped, left(text, 200) as preview,
      len(string_split(text, chr(10)))::bigint as n_lines, contains(replace(lower(text), 'š', 's'), 'zrusen') or contains(replace(lower(text), 'š', 's'), 'nahrazen') as superseded,
      upper(regexp_replace(source || ' ' || lang, '\\s+', '', 'g')) as case_key from documents""",
)
def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.escaped_html("text").alias("escaped"), F.substring("text", 1, 200).alias("preview"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), text.is_superseded("text").alias("superseded"), text.case_number(F.concat_ws(" ", "source", "lang")).alias("case_key"))


# ---- chunks ----


@query(
    "chunks_fixed",
    "select doc_id, i as chunk_index, substring(text, i * 3000 + 1, 3000) as content from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 3000.0) as bigint)))::int as i from documents)",
)
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), chunking.fixed("text", 3000), "doc_id")


def packed_sql(pattern: str, joiner: str, most: int, counted: int) -> str:
    return f"""with recursive p as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select doc_id, list_filter(list_transform(string_split(text, {pattern}), lambda x: {TRIM.format("x")}), lambda x: x <> '') as ps from d)),
    g as (select doc_id, i, p, 0 as grp, length(p) as size from p where i = 1
      union all select p.doc_id, p.i, p.p, case when g.size + length(p.p) + {counted} > {most} then g.grp + 1 else g.grp end, case when g.size + length(p.p) + {counted} > {most} then length(p.p) else g.size + length(p.p) + {counted} end
      from g join p on p.doc_id = g.doc_id and p.i = g.i + 1)
    select doc_id, grp as chunk_index, left(string_agg(p, {joiner} order by i), 8000) as content from g group by doc_id, grp"""


@query("chunks_lines", packed_sql("chr(10)", "chr(10)", 4000, 1).replace(" from d))", " from documents))"))
def chunks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), chunking.lines("text", 4000), "doc_id")


_DOUBLED = " from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)))"


@query("chunks_paragraph", packed_sql("chr(10) || chr(10)", "chr(10) || chr(10)", 1500, 2).replace(" from d))", _DOUBLED))
def chunks_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_rows(docs, chunking.paragraphs("text", 1500), "doc_id")


@query("chunks_paragraph_loose", packed_sql("chr(10) || chr(10)", "chr(10) || chr(10)", 3000, 0).replace(" from d))", _DOUBLED))
def chunks_paragraph_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_rows(docs, chunking.paragraphs_loose("text", 3000), "doc_id")


@query(
    "chunks_paragraph_cut",
    f"""with recursive d as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents where text is not null),
    a as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {TRIM.format("x")}), lambda x: x <> '') as ps from d)),
    b as (select doc_id, i, length(p) > 300 as cut, unnest(case when length(p) > 300 then list_transform(range(0, ((length(p) + 299) // 300)::bigint), lambda j: substring(p, j * 300 + 1, 300)) else [p] end) as p, unnest(range(0, case when length(p) > 300 then ((length(p) + 299) // 300)::bigint else 1 end)) as j from a),
    c as (select doc_id, p, cut, row_number() over (partition by doc_id order by i, j) as n from b),
    g as (select doc_id, n, p, 0 as grp, case when cut then 0 else length(p) end as size, not cut as open from c where n = 1
      union all select c.doc_id, c.n, c.p, case when not c.cut and g.open and g.size + length(c.p) <= 300 then g.grp else g.grp + 1 end, case when c.cut then 0 when g.open and g.size + length(c.p) <= 300 then g.size + length(c.p) else length(c.p) end, not c.cut
      from g join c on c.doc_id = g.doc_id and c.n = g.n + 1)
    select doc_id, grp as chunk_index, left(string_agg(p, chr(10) || chr(10) order by n), 8000) as content from g group by doc_id, grp
    union all select doc_id, 0, left(text, 300) from d where doc_id not in (select doc_id from a)""",
)
def chunks_paragraph_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_rows(docs, chunking.paragraphs_cut("text", 300), "doc_id")


def _sequential(step: str, where: str = "documents") -> str:
    """Recursive SQL: the rest of a text, cut piece by piece; step gives the cut of `rest` as a number of characters."""
    return f"""with recursive t as (select doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as rest, -1 as n, '' as piece, false as last from {where}),
    c as (select * from t union all select doc_id, case when length(rest) > 4000 then ltrim(substring(rest, cut + 1), ' ' || chr(10)) else '' end, n + 1, trim(case when length(rest) > 4000 then left(rest, cut) else rest end, ' ' || chr(10) || chr(9) || chr(13)), length(rest) <= 4000
      from (select *, {step} as cut from c) where not last and rest <> '')"""


@query(
    "chunks_sliding",
    _sequential(
        """case when strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) > 0 and 4000 - strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) - 1 >= 1000 then 4000 - strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) - 1
        when strpos(reverse(left(rest, 4000)), ' .') > 0 and 4000 - strpos(reverse(left(rest, 4000)), ' .') - 1 >= 1000 then 4000 - strpos(reverse(left(rest, 4000)), ' .')
        when strpos(reverse(left(rest, 4000)), ' ') > 0 and 4000 - strpos(reverse(left(rest, 4000)), ' ') >= 1000 then 4000 - strpos(reverse(left(rest, 4000)), ' ') else 4000 end"""
    )
    + ", k as (select doc_id, n, piece from c where piece <> '') select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as chunk_index, left(piece, 8000) as content from k",
)
def chunks_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), chunking.sliding("text", 4000), "doc_id")


@query(
    "chunks_hard",
    f"""with recursive d as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents where text is not null),
    a as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select doc_id, list_filter(list_transform(regexp_split_to_array({TRIM.format("text")}, '\\n\\s*\\n'), lambda x: {TRIM.format("x")}), lambda x: x <> '') as ps from d)),
    z as (select doc_id, max(i) as n from a group by 1),
    g as (select doc_id, 0::bigint as i, '' as open, []::varchar[] as done from z
      union all select doc_id, i, substring(whole, k * 1000 + 1), list_concat(closed, list_transform(range(0, k), lambda j: {TRIM.format("substring(whole, j * 1000 + 1, 1000)")}))
      from (select doc_id, i, whole, closed, greatest(0, (length(whole) - 1) // 1000)::bigint as k from (
        select a.doc_id, a.i, case when g.open <> '' and length(g.open) + 2 + length(a.p) > 1000 then a.p when g.open = '' then a.p else g.open || chr(10) || chr(10) || a.p end as whole,
          case when g.open <> '' and length(g.open) + 2 + length(a.p) > 1000 then [{TRIM.format("g.open")}] else []::varchar[] end as closed from g join a on a.doc_id = g.doc_id and a.i = g.i + 1))),
    u as (select doc_id, i, unnest(done) as c, generate_subscripts(done, 1) as j from g union all select g.doc_id, g.i, {TRIM.format("g.open")}, 1000000 from g join z on z.doc_id = g.doc_id and z.n = g.i)
    select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int as chunk_index, left(c, 8000) as content from u where c <> ''""",
)
def chunks_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_rows(docs, chunking.blank_line_paragraphs("text", 1000), "doc_id")


@query(
    "chunks_titled",
    "with c as (" + packed_sql("chr(10)", "chr(10)", 1400, 1).replace("left(string_agg(p, chr(10) order by i), 8000)", "string_agg(p, chr(10) order by i)").replace(" from d))", " from documents))") + """),
    a as (select * from c union all select doc_id, 0, '' from documents where doc_id not in (select doc_id from c))
    select doc_id, chunk_index::int as chunk_index, left(case when chunk_index = 0 and content = '' then 'Doc ' || doc_id::varchar when chunk_index = 0 and not contains(content, 'Doc ' || doc_id::varchar) then 'Doc ' || doc_id::varchar || chr(10) || content else content end, 8000) as content from a""",
)
def chunks_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    return chunking.chunk_rows(docs, chunking.titled("title", "text", 1400), "doc_id")
