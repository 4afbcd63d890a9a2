"""Filing queries over texts wrapped into filing markup, the same way in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import filings as O
from lexmill.session import spread, table

#: Valid in Spark and in DuckDB.
CONTENT = """concat('<SUBMISSION>', chr(10), '<CONFORMED-NAME>Firm ', source, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('<TIMESTAMP>', CAST(20120101 + doc_id % 28 AS STRING), '093000', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 <> 0 THEN concat('<FILING-DATE>', CAST(20130201 + doc_id % 28 AS STRING), chr(10)) ELSE '' END,
  CASE WHEN doc_id % 11 <> 0 THEN concat('<ACCESSION-NUMBER>0001-12-', lpad(CAST(doc_id AS STRING), 6, '0'), chr(10)) ELSE '' END,
  '<CIK>', CAST(doc_id AS STRING), chr(10), '<FORM-TYPE>', source, CASE WHEN doc_id % 5 = 0 THEN '/A' ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN concat(chr(10), 'This document was generated as part of a paper submission.') ELSE '' END, chr(10),
  '<DOCUMENT>', chr(10), '<TYPE>', upper(lang), chr(10), '<DESCRIPTION> main  ', chr(10), '<TEXT>', chr(10), coalesce(text, ''), chr(10), '</TEXT>', chr(10), '</DOCUMENT>', chr(10),
  CASE WHEN doc_id % 4 = 0 THEN concat('<DOCUMENT>', chr(10), '<TYPE>GRAPHIC', chr(10), '<TEXT>', chr(10), 'begin 644 x.jpg', chr(10), '#0V%T', chr(10), 'end', chr(10), '</TEXT>', chr(10), '</DOCUMENT>', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 9 = 0 THEN concat('<DOCUMENT>', chr(10), '<TYPE>10-K', chr(10), '<TEXT>', chr(10), '<PDF>', chr(10), 'begin 644 x.pdf', chr(10), '#0V%T', chr(10), 'end', chr(10), '</PDF>', chr(10), '</TEXT>', chr(10), '</DOCUMENT>', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 18 = 0 THEN concat('<DOCUMENT>', chr(10), '<TYPE>TEXT-EXTRACT', chr(10), '<TEXT>', chr(10), 'extract', chr(10), '</TEXT>', chr(10), '</DOCUMENT>', chr(10)) ELSE '' END,
  '<DOCUMENT>', chr(10), '<TYPE>EX-1', chr(10), '<TEXT>', chr(10), '<html><b>', coalesce(text, ''), '</b></html>', chr(10), '</TEXT>', chr(10), '</DOCUMENT>', chr(10), '</SUBMISSION>')"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("filing_id"), "source", F.expr(CONTENT).alias("content"))


def sgml_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.header(filings(spark, sf_dir)).select("filing_id", "firm", "date", "CIK", "form_type", "SIC", "new_file_name")


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.documents(filings(spark, sf_dir)).select("filing_id", "extract_there", F.posexplode("docs").alias("pos", "d"))
    return rows.withColumn("action", O.action(F.col("d"), F.col("extract_there")))


def doc_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir).select("filing_id", "pos", F.col("d.type").alias("type"), F.col("d.description").alias("description"), F.col("d.size_raw").alias("size_raw"), F.length("d.head").alias("head_chars"))


def doc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _exploded(spark, sf_dir).select("filing_id", "pos", d["UU_encoding"].alias("uu"), d["encoded_PDF"].alias("pdf"), d["block"].isNotNull().alias("html"), d["XML"].alias("xml"), "extract_there", "action")


def _clean(spark: SparkSession, sf_dir: str, build: bool = False) -> DataFrame:
    return O.cleaned(filings(spark, sf_dir), build=build)


def filing_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("filing_id", "paper", "removed")


def filing_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir, build=True).filter("NOT removed").select("filing_id", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


def char_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.aggregate("documents", F.lit(0).cast("long"), lambda s, o: s + o["size_cleaned"])
    return _clean(spark, sf_dir).filter("NOT removed").select("filing_id", F.col("chars_filing_metadata").cast("long").alias("chars_filing_metadata"), "chars_doc_metadata", "chars_content", sizes.alias("size_cleaned"))


def processing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.processing_log(_clean(spark, sf_dir), "source")


def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, year and total of the daily counters in one aggregation."""
    events = table(spark, sf_dir, "events").select(F.year("ts").cast("int").alias("year"), F.date_format("ts", "yyyyMMdd").alias("day"), "value")
    return events.rollup("year", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.strip(T.first_group(F.col("html"), "(?is)<title[^>]*>(.*?)</title>")).alias("title"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.strip_tags(F.col("html"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.html_text("html").alias("text"))


_F = f"WITH f AS (SELECT doc_id AS filing_id, source, {CONTENT} AS content FROM documents)"
_D = _F + r""",
  x AS (SELECT *, regexp_extract_all(content, '(?s)<DOCUMENT>.*?</DOCUMENT>') AS ds, contains(content, '<TYPE>TEXT-EXTRACT') AS extract_there FROM f),
  e AS (SELECT filing_id, source, content, extract_there, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS pos FROM x),
  b AS (SELECT *, CASE WHEN instr(d, E'\n<TEXT>') > 0 THEN left(d, instr(d, E'\n<TEXT>') - 1) ELSE left(d, length(d) - 1) END AS head,
         regexp_matches(d, '(?s)begin\s\d{3}.*end') AS uu, regexp_matches(d, '(?s)<PDF>\s*begin\s\d{3}.*end\s*</PDF>') AS p,
         CASE WHEN regexp_matches(d, '(?s)<html>?.*?</html>') THEN regexp_extract(d, '(?s)<html>?.*?</html>')
              WHEN regexp_matches(d, '(?s)<HTML>?.*?</HTML>') THEN regexp_extract(d, '(?s)<HTML>?.*?</HTML>') END AS block FROM e),
  a AS (SELECT *, length(d) AS size_raw, CASE WHEN uu THEN CASE WHEN NOT p OR extract_there THEN 'drop' ELSE 'extract' END WHEN block IS NOT NULL THEN 'html' ELSE 'keep' END AS action,
         replace(regexp_replace(block, '<[^>]*>', '', 'g'), '\', '/') AS plain FROM b),
  o AS (SELECT *, CASE action WHEN 'keep' THEN d WHEN 'html' THEN head || E'\n<TEXT>\n' || plain || E'\n</TEXT>\n</DOCUMENT>' END AS out,
         CASE action WHEN 'keep' THEN size_raw WHEN 'html' THEN length(head) + length(plain) + 27 ELSE 0 END AS size_cleaned,
         CASE action WHEN 'keep' THEN size_raw - length(head) - 25 WHEN 'html' THEN length(plain) ELSE 0 END AS content_chars,
         CASE WHEN action IN ('keep', 'html') THEN length(head) + 25 ELSE 0 END AS meta_chars FROM a),
  g AS (SELECT filing_id, source, any_value(content) AS content, contains(any_value(content), 'generated as part of a paper submission.') AS paper,
         contains(any_value(content), 'generated as part of a paper submission.') OR count(out) = 0 OR bool_or(action = 'extract') AS removed,
         string_agg(out, E'\n' ORDER BY pos) AS body, CAST(sum(meta_chars) AS BIGINT) AS meta, CAST(sum(content_chars) AS BIGINT) AS chars,
         CAST(sum(size_cleaned) AS BIGINT) AS size_cleaned, count(*) AS docs, count_if(action = 'html') AS html_n,
         sum(CASE WHEN action = 'html' THEN length(block) - length(plain) ELSE 0 END) AS html_c, count_if(action = 'drop') AS drop_n,
         sum(CASE WHEN action = 'drop' THEN size_raw ELSE 0 END) AS drop_c, count_if(action = 'extract') AS failed FROM o GROUP BY 1, 2),
  c AS (SELECT *, left(content, instr(content, E'\n<DOCUMENT>') - 1) AS top FROM g)"""


def _field(tag: str) -> str:
    return f"CASE WHEN contains(content, '<{tag}>') THEN regexp_extract(content, '<{tag}>(.*)', 1) END"


QUERIES = {
    "sgml_header": sgml_header, "doc_explode": doc_explode, "doc_flags": doc_flags, "filing_kill": filing_kill, "filing_reassemble": filing_reassemble,
    "char_accounting": char_accounting, "processing_log": processing_log, "log_rollup": log_rollup, "html_title": html_title, "html_strip": html_strip, "html_text": html_text,
}
SQL = {
    "sgml_header": f"""{_F}, h AS (SELECT filing_id, content, {_field("CONFORMED-NAME")} AS firm, {_field("CIK")} AS CIK, {_field("FORM-TYPE")} AS form_type, {_field("ASSIGNED-SIC")} AS SIC,
  coalesce(left({_field("TIMESTAMP")}, 8), left({_field("FILING-DATE")}, 8), left({_field("DATE-OF-FILING-DATE-CHANGE")}, 8)) AS date, {_field("ACCESSION-NUMBER")} AS number FROM f)
SELECT filing_id, firm, date, CIK, form_type, SIC, replace(concat_ws('_', coalesce(date, 'None'), coalesce(form_type, 'None'), coalesce(CIK, 'None'),
  coalesce(right(number, 6), 'MISSING_ACCESSION_ID_' || lpad(CAST(CAST('0x' || left(md5(content), 8) AS BIGINT) % 1000000 AS VARCHAR), 6, '0'))), '/', '-') || '.txt' AS new_file_name FROM h""",
    "doc_explode": _D + r"""SELECT filing_id, CAST(pos AS INTEGER) AS pos, trim(regexp_extract(d, '<TYPE>(.*)', 1)) AS type,
  CASE WHEN contains(d, '<DESCRIPTION>') THEN trim(regexp_extract(d, '<DESCRIPTION>(.*)', 1)) END AS description, CAST(size_raw AS INTEGER) AS size_raw, CAST(length(head) AS INTEGER) AS head_chars FROM a""",
    "doc_flags": _D + r"""SELECT filing_id, CAST(pos AS INTEGER) AS pos, uu, uu AND p AS pdf, block IS NOT NULL AS html,
  regexp_matches(d, '(?s)<xml>?.*?</xml>|<XML>?.*?</XML>') AS xml, extract_there, action FROM a""",
    "filing_kill": _D + "SELECT filing_id, paper, removed FROM c",
    "filing_reassemble": _D + r""", r AS (SELECT filing_id, top || E'\n' || body || E'\n</SUBMISSION>' AS text FROM c WHERE NOT removed)
SELECT filing_id, length(text) AS chars, md5(text) AS digest FROM r""",
    "char_accounting": _D + "SELECT filing_id, length(top) + 13 AS chars_filing_metadata, meta AS chars_doc_metadata, chars AS chars_content, size_cleaned FROM c WHERE NOT removed",
    "processing_log": _D + """SELECT source, count_if(NOT removed)::BIGINT AS files_processed, count_if(removed)::BIGINT AS files_killed,
  sum(CASE WHEN removed THEN length(content) ELSE 0 END)::BIGINT AS kill_characters_removed, sum(CASE WHEN paper THEN 0 ELSE docs END)::BIGINT AS documents_processed,
  sum(CASE WHEN paper THEN 0 ELSE html_n END)::BIGINT AS html_blocks_parsed, sum(CASE WHEN paper THEN 0 ELSE html_c END)::BIGINT AS html_characters_removed,
  sum(CASE WHEN paper THEN 0 ELSE drop_n END)::BIGINT AS uu_documents_removed, sum(CASE WHEN paper THEN 0 ELSE drop_c END)::BIGINT AS uu_characters_removed,
  0::BIGINT AS pdfs_extracted, sum(CASE WHEN paper THEN 0 ELSE failed END)::BIGINT AS pdfs_failed, 0::BIGINT AS characters_extracted FROM c GROUP BY source""",
    "log_rollup": "SELECT CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%Y%m%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (year(ts), strftime(ts, '%Y%m%d'))",
    "html_title": r"SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') END AS title FROM pages",
    "html_strip": "WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages) SELECT page_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM t",
}
