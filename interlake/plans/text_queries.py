"""Registered queries of the text functions over whole tables, with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from interlake.functions import text as t

#: Header values whose parts the address, label and date functions read.
ADDRESSES = ['"Ann Lee" <Ann@X.test>', "bob@y.test", "no address", "", "Carl <c@z.test>; d@z.test, <E@z.test>", "  Dora@Q.test  "]
LABELS = ['Inbox,"A, B",Opened', "Inbox,\r\n Unread", ",,", "", '"Sent"']
DATES = ["Mon, 05 Jan 2026 10:11:12 +0000 (UTC)", "5 Jan 2026 10:11:12 -0230", "2026-01-05T10:11:12+01:00", "2026-01-05 10:11:12", "2026-01-05T10:11:12", "yesterday", ""]
REFERENCES = ["<a@x> b@x  junk <c@x>", "", "<only@x>"]


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_features(spark, sf_dir):
    """Words, preview, hash, token count of every document."""
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", t.word_count(text).alias("words"), t.preview(text).alias("preview"), t.content_hash(text).alias("hash"), t.token_count(text).alias("tokens"), F.length(t.truncate_tokens(text)).cast("long").alias("truncated"))


def cleaned_text(spark, sf_dir):
    """Every cleaner on every document, as hashes."""
    text = F.col("text")
    cut = t.strip_signature(text)
    cleaners = {"sanitized": t.sanitize_text(text), "untemplated": t.strip_template(text), "unsigned": cut["text"], "collapsed": t.collapse_whitespace(text), "normalized": t.normalize_chars(text)}
    return _documents(spark, sf_dir).select("doc_id", *[F.md5(c).alias(name) for name, c in cleaners.items()], cut["removed"].alias("signed"))


def header_values(spark, sf_dir):
    """Parsed addresses, labels, references and dates of a list of header values."""
    rows = [(kind, v) for kind, values in (("address", ADDRESSES), ("label", LABELS), ("reference", REFERENCES), ("date", DATES)) for v in values]
    table, v = spark.createDataFrame(rows, "kind string, value string"), F.col("value")
    one = t.parse_address(v)
    found = (
        F.when(F.col("kind") == "address", F.concat_ws("|", F.coalesce(one["email"], F.lit("-")), F.coalesce(one["name"], F.lit("-")), F.array_join(t.extract_addresses(v), " ")))
        .when(F.col("kind") == "label", F.concat_ws("|", F.array_join(t.parse_labels(v), "/"), t.is_sent_label(t.parse_labels(v)).cast("string")))
        .when(F.col("kind") == "reference", F.array_join(t.parse_references(v), " "))
        .otherwise(F.unix_seconds(t.parse_date(v)).cast("string"))
    )
    return table.select("kind", "value", found.alias("found"))


def page_text(spark, sf_dir):
    """Text of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.html_to_text(F.col("html")).alias("text"))


def legacy_page_text(spark, sf_dir):
    """Text of every page, with a part for readers without scripts, by the older cleaner."""
    page = F.concat(F.lit("<noscript>no <b>scripts</b></noscript >"), "html")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.legacy_strip_html(page).alias("text"))


def legacy_cleaners(spark, sf_dir):
    """The older template and quotation cleaners on every document, between template tags and quoted lines."""
    tagged = F.concat(F.lit("{% if x %}{{ a\n}} <% stays %>"), F.coalesce("text", F.lit("")), F.lit("{# note #}  end "))
    ends = F.when(F.col("doc_id") % 2 == 0, " -- ").otherwise("-- Ann")
    lines = F.concat_ws("\n", F.lit(" > one"), F.lit("On Monday Ann wrote:"), "text", F.lit("Subject: old"), F.lit("On Monday Ann wrote: this"), ends, F.lit("after"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(t.legacy_strip_templates(tagged)).alias("untemplated"), F.md5(t.legacy_strip_quotes(lines)).alias("unquoted"))


QUERIES = {"text_features": text_features, "cleaned_text": cleaned_text, "header_values": header_values, "html_to_text": page_text, "legacy_strip_html": legacy_page_text, "legacy_strip": legacy_cleaners}


def _replace(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def _strip(text: str) -> str:
    return _replace(text, rf"\A{t.WS}+|{t.WS}+\z", "")


FLAT = _strip(_replace("text", t.WS + "+", " "))
UNTEMPLATED = _strip(_replace(reduce(lambda x, p: _replace(x, p, ""), t.TEMPLATES, "text"), t.WS + "+", " "))
PARTS = f"regexp_split_to_array(text, '{t.SIGNATURE}')"
GAPS = rf"regexp_replace(text, '\n{t.WS}*\n', chr(10) || chr(10), 'g')"
COLLAPSED = _strip(f"regexp_replace({_replace(GAPS, t.INLINE_WS + '+', ' ')}, ' ?\\n ?', chr(10), 'g')")
NORMAL = reduce(lambda x, kv: "replace({}, '{}', '{}')".format(x, kv[0], kv[1].replace("'", "''")), t.TYPOGRAPHIC.items(), "nfc_normalize(text)")

#: The entities that the pages hold; the ampersand comes last, so that none is read twice.
ENTITIES = {"&quot;": '"', "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def _page_sql(page: str) -> str:
    bare = reduce(lambda x, p: _replace(x, p, " "), t.MARKUP, page)
    return _strip(_replace(reduce(lambda x, kv: f"replace({x}, '{kv[0]}', '{kv[1]}')", ENTITIES.items(), bare), t.WS + "+", " "))


NOSCRIPT_PAGE = _replace("('<noscript>no <b>scripts</b></noscript >' || html)", t.NOSCRIPT, " ")
TAGGED = "('{% if x %}{{ a' || chr(10) || '}} <% stays %>' || coalesce(text, '') || '{# note #}  end ')"
LEGACY_UNTEMPLATED = _strip(_replace(reduce(lambda x, p: _replace(x, p, ""), t.TEMPLATES[:3], TAGGED), t.WS + "+", " "))
LEGACY_LINES = "string_split(concat_ws(chr(10), ' > one', 'On Monday Ann wrote:', text, 'Subject: old', 'On Monday Ann wrote: this', CASE WHEN doc_id % 2 = 0 THEN ' -- ' ELSE '-- Ann' END, 'after'), chr(10))"
LEGACY_ENDS = ", ".join(f"'{x}'" for x in t.LEGACY_ENDS)

ORACLES = {
    "html_to_text": f"SELECT page_id, {_page_sql('html')} AS text FROM pages",
    "legacy_strip_html": f"SELECT page_id, {_page_sql(NOSCRIPT_PAGE)} AS text FROM pages",
    "legacy_strip": rf"""WITH lines AS (SELECT doc_id, md5({LEGACY_UNTEMPLATED}) AS untemplated, unnest({LEGACY_LINES}) AS line, generate_subscripts({LEGACY_LINES}, 1) AS n FROM documents),
bare AS (SELECT *, {_strip("line")} AS b FROM lines),
told AS (SELECT *, min(CASE WHEN b IN ({LEGACY_ENDS}) THEN n END) OVER (PARTITION BY doc_id) AS stop FROM bare)
SELECT doc_id, any_value(untemplated) AS untemplated, md5({_strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE (stop IS NULL OR n < stop) AND NOT starts_with(b, '>') AND NOT regexp_matches(b, '^On [^\n]+ wrote:$') AND NOT regexp_matches(b, '^(From|Sent|To|Subject|Date):')), '')")}) AS unquoted
FROM told GROUP BY doc_id""",
    "text_features": rf"""SELECT doc_id, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '{t.WS}+'), lambda w: w <> '')), 0) AS BIGINT) AS words,
  CASE WHEN text <> '' THEN CASE WHEN length({FLAT}) > 200 THEN left({FLAT}, 200) || '...' ELSE {FLAT} END END AS preview, left(sha256(text), 16) AS hash,
  length(text) // 2 AS tokens, CASE WHEN length(text) > 16000 THEN 16003 ELSE length(text) END AS truncated FROM documents""",
    "cleaned_text": rf"""SELECT doc_id, md5(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g')) AS sanitized, md5({UNTEMPLATED}) AS untemplated,
  md5(CASE WHEN len({PARTS}) > 1 THEN {_strip(PARTS + "[1]")} ELSE text END) AS unsigned, md5({COLLAPSED}) AS collapsed, md5({_replace(NORMAL, t.ZERO_WIDTH, "")}) AS normalized,
  coalesce(len({PARTS}) > 1, false) AS signed FROM documents""",
}
