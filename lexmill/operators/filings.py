"""Filings: header fields, documents, removal rules, cleaned text and accounting, as array expressions on one row.

A filing's documents are an array of structs in its own row, so that cleaning and reassembly need no shuffle at all;
rows are exploded only where a result has a row per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

DOCUMENT = r"(?s)<DOCUMENT>.*?</DOCUMENT>"
UU = r"(?s)begin\s\d{3}.*end"
UU_STRICT = r"(?ms)^begin\s\d{3}[^\n]*\n.*^end\s*$"
ENCODED_PDF = r"(?s)<PDF>\s*begin\s\d{3}.*end\s*</PDF>"
HTML_LOWER, HTML_UPPER = r"(?s)<html>?.*?</html>", r"(?s)<HTML>?.*?</HTML>"
XML = r"(?s)<xml>?.*?</xml>|<XML>?.*?</XML>"
PAPER = "This document was generated as part of a paper submission."
OPEN, CLOSE = "<TEXT>", "</TEXT>\n</DOCUMENT>"
WRAP = len(OPEN) + len(CLOSE)
FIELDS = {"firm": "CONFORMED-NAME", "CIK": "CIK", "form_type": "FORM-TYPE", "SIC": "ASSIGNED-SIC"}


def header(filings: DataFrame) -> DataFrame:
    """Adds firm, date, CIK, form_type, SIC and new_file_name."""
    content = F.col("content")
    dates = [F.substring(T.header_field(content, tag), 1, 8) for tag in ("TIMESTAMP", "FILING-DATE", "DATE-OF-FILING-DATE-CHANGE")]
    out = filings.withColumns({name: T.header_field(content, tag) for name, tag in FIELDS.items()} | {"date": F.coalesce(*dates)})
    number = T.header_field(content, "ACCESSION-NUMBER")
    # A missing number gives digits of the content's hash, so that a second run names the filing alike.
    stand_in = F.concat(F.lit("MISSING_ACCESSION_ID_"), F.lpad(F.pmod(F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)).cast("string"), 6, "0"))
    parts = [F.coalesce(c, F.lit("None")) for c in (F.col("date"), F.col("form_type"), F.col("CIK"))]
    name = F.replace(F.concat_ws("_", *parts, F.coalesce(F.right(number, F.lit(6)), stand_in)), F.lit("/"), F.lit("-"))
    return out.withColumn("new_file_name", F.concat(name, F.lit(".txt")))


def _document(d: Column, uu: str) -> Column:
    block = F.when(F.regexp_like(d, F.lit(HTML_LOWER)), F.regexp_extract(d, HTML_LOWER, 0)).when(F.regexp_like(d, F.lit(HTML_UPPER)), F.regexp_extract(d, HTML_UPPER, 0))
    has_uu = F.regexp_like(d, F.lit(uu))
    return F.struct(
        d.alias("raw"),
        T.before(d, "\n<TEXT>").alias("head"),
        T.strip(T.first_group(d, "(?d)<TYPE>(.*)")).alias("type"),
        T.strip(T.first_group(d, "(?d)<DESCRIPTION>(.*)")).alias("description"),
        F.length(d).alias("size_raw"),
        has_uu.alias("UU_encoding"),
        (has_uu & F.regexp_like(d, F.lit(ENCODED_PDF))).alias("encoded_PDF"),
        F.regexp_like(d, F.lit(XML)).alias("XML"),
        block.alias("block"),
    )


def documents(filings: DataFrame, uu: str = UU) -> DataFrame:
    """Adds ``extract_there`` and ``docs``, an array with a struct of attributes for each document, in order."""
    found = filings.withColumns({"extract_there": F.contains("content", F.lit("<TYPE>TEXT-EXTRACT")), "docs": F.transform(F.regexp_extract_all("content", F.lit(DOCUMENT), F.lit(0)), lambda d: _document(d, uu))})
    return found


def action(d: Column, extract_there: Column) -> Column:
    """drop, extract, html or keep."""
    uu = F.when(~d["encoded_PDF"] | extract_there, F.lit("drop")).otherwise(F.lit("extract"))
    return F.when(d["UU_encoding"], uu).when(d["block"].isNotNull(), F.lit("html")).otherwise(F.lit("keep"))


def cleaned(filings: DataFrame, parse: bool = False, extract: Callable | None = None, pdf: bool = False, uu: str = UU, build: bool = True) -> DataFrame:
    """From (filing_id, content): filing_id, docs with action, text, size_cleaned and counts, killed, and cleaned content.

    ``parse`` reads markup with a parser (an Arrow UDF) instead of stripping tags. ``pdf`` runs ``extract`` on encoded PDFs; else each of
    those fails, which removes its filing. A document without a type has a null type and removes nothing. Without ``build`` the cleaned texts aren't
    put together: there are flags, sizes and counts only.
    """
    rows = documents(filings, uu)
    blocks = F.transform("docs", lambda d: F.when(action(d, F.col("extract_there")) == "html", d["block"]))
    texts = T.html_texts(blocks) if parse else F.transform(blocks, T.strip_tags)
    rows = rows.withColumn("texts", F.transform(texts, lambda t: F.replace(t, F.lit("\\"), F.lit("/"))))
    encoded = F.transform("docs", lambda d: F.when(action(d, F.col("extract_there")) == "extract", d["raw"]))
    rows = rows.withColumn("pages", T.pdf_texts(extract)(encoded) if pdf else F.transform(encoded, lambda t: F.lit(None).cast("string")))

    def outcome(d: Column, i: Column) -> Column:
        what = action(d, F.col("extract_there"))
        plain, page = F.get("texts", i), F.get("pages", i)
        extracted = F.concat(F.lit("<DOCUMENT>\n<TYPE>TEXT-EXTRACT\n<TEXT>\n"), page, F.lit("\n" + CLOSE))
        wrapped = F.concat(F.lit(OPEN + "\n"), plain, F.lit("\n" + CLOSE))
        body = F.when(what == "html", wrapped).when(what == "extract", extracted)
        text = [F.when(what == "keep", d["raw"]).when(body.isNotNull(), F.concat_ws("\n", d["head"], body)).alias("text")] if build else []
        body_chars = F.when(what == "html", F.length(plain) + WRAP + 2).when(what == "extract", F.length(extracted))
        size = F.when(what == "keep", d["size_raw"]).when(body_chars.isNotNull(), F.length(d["head"]) + body_chars).otherwise(F.lit(0))
        content = F.when(what == "keep", d["size_raw"] - F.length(d["head"]) - WRAP).when(what == "html", F.length(plain)).when(what == "extract", F.coalesce(F.length(page), F.lit(0))).otherwise(F.lit(0))
        meta = F.when(what.isin("keep", "html"), F.length(d["head"]) + WRAP).when(page.isNotNull(), F.length(d["head"]) + F.length(extracted) - F.length(page)).otherwise(F.lit(0))
        return F.struct(
            *(d[c].alias(c) for c in ("type", "description", "size_raw", "UU_encoding", "encoded_PDF", "XML")),
            d["block"].isNotNull().alias("HTML"),
            what.alias("action"),
            *text,
            ((what == "keep") | body_chars.isNotNull()).alias("kept"),
            size.alias("size_cleaned"),
            content.alias("content_chars"),
            meta.alias("meta_chars"),
            F.when(what == "html", F.length(d["block"]) - F.length(plain)).otherwise(F.lit(0)).alias("markup_chars"),
        )

    rows = rows.withColumn("out", F.transform("docs", outcome))
    killed = F.contains("content", F.lit(PAPER)) | ~F.exists("out", lambda o: o["kept"]) | F.exists("out", lambda o: (o["action"] == "extract") & ~o["kept"])
    kept = F.transform(F.filter("out", lambda o: o["kept"]), lambda o: o["text"]) if build else None
    head = T.before(F.col("content"), "\n<DOCUMENT>")
    total = lambda field: F.aggregate(F.transform("out", lambda o: o[field]), F.lit(0).cast("long"), lambda s, x: s + x)
    result = F.struct(
        F.length("content").alias("raw_file_length"),
        F.col("out").alias("documents"),
        F.contains("content", F.lit(PAPER)).alias("paper"),
        killed.alias("removed"),
        (F.length(head) + 13).alias("chars_filing_metadata"),
        total("meta_chars").alias("chars_doc_metadata"),
        total("content_chars").alias("chars_content"),
        *([F.when(~killed, F.concat_ws("\n", head, F.array_join(kept, "\n"), F.lit("</SUBMISSION>"))).alias("content")] if build else []),
    )
    # An array of one struct, exploded: a filter on the result then isn't pushed through all these expressions, which would
    # repeat each of them as often as it is referred to.
    return rows.select(*(c for c in filings.columns if c != "content"), F.inline(F.array(result)))


def error_log(clean: DataFrame) -> DataFrame:
    """Filings with errors: removed, and ``log`` with position, type and kind of each (an encoded PDF that gave no text, a document without a type).
    Paper filings aren't looked at."""
    entry = lambda o, i, kind: F.struct(i.alias("pos"), o["type"].alias("type"), F.lit(kind).alias("error_type"))
    of = lambda kind, wrong: F.filter(F.transform("documents", lambda o, i: F.when(wrong(o), entry(o, i, kind))), lambda e: e.isNotNull())
    log = F.concat(of("pdf_extraction", lambda o: (o["action"] == "extract") & ~o["kept"]), of("no_type", lambda o: o["type"].isNull()))
    return clean.filter("NOT paper").withColumn("log", log).filter(F.size("log") > 0).drop("documents", "content", "paper")


def processing_log(clean: DataFrame, *by: str) -> DataFrame:
    """Counters of filings and documents per group (a day): one aggregation with partial sums, no text is shuffled. Documents of paper
    filings are not looked at and count nowhere."""
    per = lambda f: F.when(F.col("paper"), F.lit(0).cast("long")).otherwise(F.aggregate("documents", F.lit(0).cast("long"), f))
    flag = lambda o, what: (o["action"] == what).cast("long")
    failed = lambda o: flag(o, "extract") * (~o["kept"]).cast("long")
    rows = clean.select(
        *by, "removed", "raw_file_length",
        per(lambda s, o: s + 1).alias("documents_processed"),
        per(lambda s, o: s + flag(o, "html")).alias("html_blocks_parsed"),
        per(lambda s, o: s + o["markup_chars"]).alias("html_characters_removed"),
        per(lambda s, o: s + flag(o, "drop")).alias("uu_documents_removed"),
        per(lambda s, o: s + flag(o, "drop") * o["size_raw"]).alias("uu_characters_removed"),
        per(lambda s, o: s + flag(o, "extract") - failed(o)).alias("pdfs_extracted"),
        per(lambda s, o: s + failed(o)).alias("pdfs_failed"),
        per(lambda s, o: s + flag(o, "extract") * o["content_chars"]).alias("characters_extracted"),
    )
    sums = [F.sum(c).alias(c) for c in rows.columns[len(by) + 2 :]]
    kills = [F.count_if(~F.col("removed")).alias("files_processed"), F.count_if("removed").alias("files_killed"), F.sum(F.when(F.col("removed"), F.col("raw_file_length")).otherwise(0)).alias("kill_characters_removed")]
    return rows.groupBy(*by).agg(*kills, *sums) if by else rows.agg(*kills, *sums)
