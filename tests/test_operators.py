"""Unit and property tests of the operators on hand-written cases."""

import binascii
import hashlib
import io
import json
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import registry
from lexmill.functions import text as X
from lexmill.operators import filings as O
from lexmill.operators import instruct as I
from lexmill.operators import ordering, report, selection
from lexmill.operators import tokens as T
from lexmill.plans import training
from lexmill.sources import files, tar
from lexmill.streaming import feed


def uu(raw: bytes) -> str:
    return "begin 644 x\n" + "".join(binascii.b2a_uu(raw[i : i + 45]).decode() for i in range(0, len(raw), 45)) + "`\nend"


def doc(kind: str, body: str) -> str:
    return f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>\n{body}\n</TEXT>\n</DOCUMENT>"


def filing(*docs: str, head: str = "<CIK>7") -> str:
    return "\n".join([f"<SUBMISSION>\n{head}", *docs, "</SUBMISSION>"])


def test_header_keeps_carriage_returns_and_tells_missing_from_empty(spark):
    text = "<SUBMISSION>\n<CIK>123\r\n<FORM-TYPE>\n<FILING-DATE>20130405\n<DATE-OF-FILING-DATE-CHANGE>20140101\n"
    r = O.header(spark.createDataFrame([(1, text)], "filing_id int, content string")).first()
    assert (r["CIK"], r["form_type"], r["SIC"], r["date"]) == ("123\r", "", None, "20130405")
    assert r["new_file_name"].startswith("20130405__123\r_MISSING_ACCESSION_ID_")


def test_slash_becomes_dash(spark):
    text = "<TIMESTAMP>20120102030405\n<CIK>9\n<FORM-TYPE>10-K/A\n<ACCESSION-NUMBER>0001-12-000042\n"
    assert O.header(spark.createDataFrame([(text,)], "content string")).first()["new_file_name"] == "20120102_10-K-A_9_000042.txt"


def run_clean(spark, *contents, **options):
    rows = O.cleaned(spark.createDataFrame(list(enumerate(contents)), "filing_id int, content string"), **options).collect()
    return {r["filing_id"]: r for r in rows}


def test_removal_rules(spark):
    image, pdf = doc("GRAPHIC", uu(b"jpg")), doc("10-K", f"<PDF>\n{uu(b'pdf')}\n</PDF>")
    plain, prose = doc("10-K", "words"), doc("EX", "they begin 200 jobs that are pending")
    got = run_clean(
        spark, filing(plain, image), filing(image), filing(plain, pdf), filing(plain, pdf, doc("TEXT-EXTRACT", "t")), filing(plain, prose),
        filing(plain, head="<CIK>7\nThis document was generated as part of a paper submission."), filing(), filing("<DOCUMENT>\n<TEXT>\nno type\n</TEXT>\n</DOCUMENT>"),
    )
    assert [got[i]["removed"] for i in range(8)] == [False, True, True, False, False, True, True, False]
    assert got[0]["content"] == filing(plain)
    assert [d["action"] for d in got[3]["documents"]] == ["keep", "drop", "keep"]
    assert [d["action"] for d in got[4]["documents"]] == ["keep", "drop"]  # greedy match of prose, as specified
    assert got[7]["documents"][0]["type"] is None
    strict = run_clean(spark, filing(plain, prose), uu=O.UU_STRICT)
    assert [d["action"] for d in strict[0]["documents"]] == ["keep", "keep"]


def test_pdf_extraction_is_pluggable(spark):
    pdf = filing(doc("10-K", f"<PDF>\n{uu(b'two pages')}\n</PDF>"))
    got = run_clean(spark, pdf, pdf=True, extract=lambda raw: raw.decode().split(" "))[0]
    assert not got["removed"] and "<TYPE>TEXT-EXTRACT\n<TEXT>\ntwo\n\npages\n</TEXT>" in got["content"]
    assert got["chars_content"] == len("two\n\npages")

    def fails(raw: bytes) -> list[str]:
        raise ValueError("corrupt")

    assert run_clean(spark, pdf, pdf=True, extract=fails)[0]["removed"]


def test_markup(spark):
    page = '<html lang="en"><!-- c --><script>x()</script><p>A &amp; B\\C</p><style>s</style></html> outside <html>second</html>'
    strip, parse = (run_clean(spark, filing(doc("EX", page)), parse=p)[0]["content"] for p in (False, True))
    assert "<TEXT>\nA & B/C\n</TEXT>" in parse and "outside" not in parse and "second" not in parse
    assert "x()A &amp; B/Cs" in strip
    assert "mixed" in run_clean(spark, filing(doc("EX", "<Html>mixed</Html>")))[0]["content"]


def test_bytes_and_rendering(spark):
    row = spark.createDataFrame([(b"a\xffb\xef\xbf\xbdc",)], "b binary").select(X.decode_lossy("b").alias("t")).first()
    assert row["t"] == "ab�c"
    assert X.uu_bytes(uu(b"hello" * 30)) == b"hello" * 30 and X.uu_bytes("no") is None and X.uu_bytes("begin 644 x\n~~~~\nend") is None
    rows = spark.createDataFrame([("null",), ("true",), ('["a", "b"]',), ('"x"',), ("1.5",), (None,), ("plain",)], "j string").select(X.json_rendered("j").alias("t")).collect()
    assert [r["t"] for r in rows] == ["None", "True", "['a', 'b']", "x", "1.5", "None", "plain"]


def test_chunks_cover_all_tokens(spark):
    """Every token of every count is in a window, and windows have the length, whatever the overlap."""
    counts = spark.createDataFrame([(n,) for n in range(0, 61)], "n int")
    for length, stride in ((2, 0), (5, 4), (8, 3), (20, 7), (64, 8)):
        rows = {}
        for r in T.chunks(counts, "n", length, stride).collect():
            rows.setdefault(r["n"], []).append(r)
        for n, own in rows.items():
            assert len(own) == -(-max(n, length) // (length - stride))
            assert {t for r in own for t in range(r["start_tok"], min(r["end_tok"], n))} == set(range(n))
            assert all(r["n_real"] + r["n_pad"] == length and r["n_real"] == max(0, min(r["end_tok"], n) - r["start_tok"]) for r in own)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 5, 10, 11])
def test_chunk_arrays(spark, n):
    length, stride = 8, 3
    df = spark.createDataFrame([(list(range(1, n + 1)),)], "ids array<int>")
    rows = T.chunk_arrays(df, "ids", length, stride, 0).orderBy("chunk_no").collect()
    assert len(rows) == -(-max(n, length) // (length - stride))
    for i, r in enumerate(rows):
        own = list(range(1, n + 1))[i * 5 : i * 5 + length]
        assert r["input_ids"] == own + [0] * (length - len(own)) == r["labels"]
        assert r["attention_mask"] == [1] * len(own) + [0] * (length - len(own))


def test_chunk_arrays_take_every_source(spark, tmp_path):
    texts = {1: ("src2", "a b c"), 2: ("src0", " ".join(f"w{i}" for i in range(150))), 3: (None, "one two"), 4: ("src19", "")}
    spark.createDataFrame([(i, t, s) for i, (s, t) in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, (_, t) in texts.items():
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % training.VOCABULARY + 1 for w in t.split()]
        for k in range(-(-max(len(ids), 64) // 56)):
            own = ids[k * 56 : k * 56 + 64]
            row = " ".join(map(str, own + [0] * (64 - len(own))))
            want.add((i, k, row, " ".join(["1"] * len(own) + ["0"] * (64 - len(own))), row))
    got = [tuple(r) for r in registry.QUERIES["chunk_arrays"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_sft_masks(spark):
    df = spark.createDataFrame([([1, 2], [3, 4]), ([1, 2, 3, 4, 5, 6], [7])], "p array<int>, o array<int>")
    rows = df.select(*(c.alias(k) for k, c in T.sft(F.col("p"), F.col("o"), 6, 0, 9).items())).withColumns({"m": T.masked(F.col("labels")), "f": T.first_response(F.col("labels"))}).collect()
    assert rows[0]["input_ids"] == [9, 1, 2, 3, 4, 0] and rows[0]["labels"] == [-100, -100, -100, 3, 4, -100] and rows[0]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert (rows[0]["m"], rows[0]["f"], rows[1]["m"], rows[1]["f"]) == (False, 3, True, None)


def test_split_is_a_partition_and_a_rank_a_permutation(spark):
    rows = ordering.split(spark.range(500).withColumnRenamed("id", "k"), "s", "k", 50).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 501)) and sum(r["split"] == "eval" for r in rows) == 50
    assert [r["k"] for r in ordering.shuffled(spark.range(500).withColumnRenamed("id", "k"), "s", "k").collect()] == [r["k"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert ordering.ranked(spark.range(0).withColumnRenamed("id", "k"), "s", "k").count() == 0
    assert ordering.sample(spark.range(5).withColumnRenamed("id", "k"), "s", "k", 9).count() == 5


def test_selection(spark):
    rows = spark.createDataFrame([(1, "10-K/A"), (2, "8-K"), (3, None)], "id int, form string")
    listed = spark.createDataFrame([("10-K-A",), (None,)], "t string")
    assert [r["id"] for r in selection.whitelisted(rows, "form", listed).collect()] == [1]
    names = spark.createDataFrame([("20120101_10-K-A_5_000001.txt",), ("None_8-K_5_000001.txt",), ("20120101_8-K_5_MISSING_ACCESSION_ID_1.txt",)], "n string")
    assert [r[0] for r in names.select(selection.form_type_of(F.col("n"))).collect()] == ["10-K-A", None, None]
    assert selection.token_estimate(rows.limit(0), "id").first()["chars"] == 0
    assert sorted(r["id"] for r in selection.after(spark.range(5), "id", 3).collect()) == [3, 4]


def test_instruct(spark, tmp_path):
    record = {"table": {"table": [["h", "i"], ["1", "2"]]}, "paragraphs": [{"text": " a\t"}, {"text": "b"}], "questions": [{"question": "q?", "answer": ["x", "y"]}, {"question": "r?", "answer": 5}]}
    (tmp_path / "qa.json").write_text(json.dumps([record]))
    rows = I.flattened(files.qa_records(spark, str(tmp_path / "qa.json"))).collect()
    assert [(r["instruction"], r["output"]) for r in rows] == [("q?", "['x', 'y']"), ("r?", "5")]
    assert rows[0]["input"] == "h | i\n--- | ---\n1 | 2\n\na b"
    prompts = spark.createDataFrame([("do", "with"), ("do", ""), ("do", None)], "i string, c string").select(I.prompt(F.col("i"), F.col("c"))).collect()
    assert prompts[0][0] == "### Instruction:\ndo\n\n### Input:\nwith\n\n### Response:" and prompts[1][0] == prompts[2][0] == "### Instruction:\ndo\n\n### Response:"


def test_report(spark):
    constant = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, None)], "g int, p int")
    r = report.class_metrics(constant, "g", "p").first()
    assert r["mcc"] == 0 and r["missing"] == 1 and r["acc"] == 0.5
    lr = spark.createDataFrame([(9,)], "k int").select(report.learning_rate(F.col("k"), 4150, 0.05, 2e-4)).first()[0]
    assert abs(lr - 8.6538e-06) < 1e-9
    data = spark.createDataFrame([(1.0, 2.0, 1), (-1.0, 0.5, 0), (2.0, -1.0, 1)], "a double, b double, y int")
    path = report.logistic_descent(data, ["a", "b"], "y", 0.05, 3, [-1.5, -1.5])
    assert len(path) == 4 and path[-1][0] > path[0][0]


def archive(path, members: dict, mode: str = "w:gz") -> None:
    with tarfile.open(path, mode) as t:
        for name, raw in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))


def test_tar_source(spark, tmp_path):
    archive(tmp_path / "20120101.tar.gz", {"./20120101_10-K_1_000001.txt": b"one\xff", "20120101_8-K_2_000002.txt": b"two"})
    archive(tmp_path / "20120102.tar", {"20120102_10-K_3_000003.txt": b"three"}, "w")
    whole = (tmp_path / "20120101.tar.gz").read_bytes()
    (tmp_path / "20120103.tar.gz").write_bytes(whole[: len(whole) // 2])
    rows = files.filings(spark, str(tmp_path)).collect()
    assert sorted((r["member"], r["content"]) for r in rows if r["archive"] != "20120103.tar.gz") == [("20120101_10-K_1_000001.txt", "one"), ("20120101_8-K_2_000002.txt", "two"), ("20120102_10-K_3_000003.txt", "three")]
    assert {r["member"] for r in files.filings(spark, str(tmp_path), ["10-K"]).collect()} == {"20120101_10-K_1_000001.txt", "20120102_10-K_3_000003.txt"}
    tar.register(spark)
    exact = spark.read.format("tarmembers").option("path", str(tmp_path)).load().filter("member = '20120102_10-K_3_000003.txt'")
    assert exact.count() == 1
    sound = {r["archive"]: r["sound"] for r in spark.read.format("archiveintegrity").option("path", str(tmp_path)).load().collect()}
    assert sound == {"20120101.tar.gz": True, "20120102.tar": True, "20120103.tar.gz": False}
    assert files.inventory(spark, str(tmp_path)).first()["files"] == 3


def test_sinks_and_streams(spark, tmp_path):
    chunk = spark.range(6).select(F.array(F.col("id").cast("int")).alias("input_ids"), F.array(F.lit(1)).alias("attention_mask"), F.array(F.lit(1)).alias("labels"))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    files.write_corpus(chunk, source, most_rows=2)
    files.write_corpus(chunk, source, most_rows=2)
    assert files.jsonl(spark, source, files.CHUNKS).count() == 6  # the second run replaced the first
    feed.consume(feed.chunks(spark, source), out, check).awaitTermination()
    chunk.limit(2).coalesce(1).write.mode("append").json(source)
    feed.consume(feed.chunks(spark, source), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 8  # only what is new came the second time
    files.write_parts(spark.createDataFrame([(1, 2012), (2, 2013)], "a int, year int"), str(tmp_path / "parts"), "year")
    assert spark.read.parquet(str(tmp_path / "parts")).filter("year = 2013").count() == 1


def test_flagship_drops_blank_documents(spark, tmp_path):
    rows = [(1, "\n\t ", "src0"), (2, "a b", "src0"), (3, None, "src0"), (4, "a", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["doc_id"], r["n_real"], r["n_pad"]) for r in registry.QUERIES["corpus_chunks"](spark, str(tmp_path)).collect()] == [(2, 2, 254), (2, 0, 256)]


def test_line_status_is_that_of_a_plain_reader(spark):
    def status(line):
        try:
            text = json.loads(line).get("k", "")
            return "empty_filing" if not text else "success" if isinstance(text, str) else "other_error"
        except json.JSONDecodeError:
            return "invalid_json"
        except Exception:
            return "other_error"

    lines = ['{"k": "x"}', '{"k": " "}', '{"k": ""}', "{}", '{"j": 1}', '{"k": 5}', '{"k": 0}', '{"k": 0.0}', '{"k": null}', '{"k": true}', '{"k": false}', '{"k": []}', '{"k": {}}', '{"k": {"a": 1}}', "[1]", '"k"', "7", "null", "", "{", '{"k": "é"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r["s"] for r in df.select("i", I.line_status(F.col("line"), "k").alias("s")).collect()}
    assert got == {i: status(x) for i, x in enumerate(lines)}
    assert {r["status"] for r in I.status_counts(df, "line", "k", tokenizer=False).collect()} == {"tokenizer_error"}


def test_required_keys_stop_the_job(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1}',)], "j string")
    assert I.required(df, "j", ["a"]).count() == 2 and len(I.required(df, "j", ["a"]).collect()) == 2
    with pytest.raises(Exception, match="keys missing"):
        I.required(df, "j", ["a", "b"]).collect()


def test_metrics_of_three_classes(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, None), (2, 2), (0, 0)]
    r = report.multiclass_metrics(spark.createDataFrame(pairs, "g int, p int"), "g", "p").first()
    n, labels = len(pairs), (0, 1, 2)
    f1 = {k: 2 * sum(g == p == k for g, p in pairs) / (sum(g == k for g, _ in pairs) + sum(p == k for _, p in pairs)) for k in labels}
    support = {k: sum(g == k for g, _ in pairs) for k in labels}
    said = {k: sum(p == k for _, p in pairs) for k in (*labels, None)}
    hits = sum(g == p for g, p in pairs)
    mcc = (hits * n - sum(support[k] * said[k] for k in labels)) / ((n * n - sum(x * x for x in said.values())) * (n * n - sum(x * x for x in support.values()))) ** 0.5
    want = (n, 1, hits / n, (hits / n * (1 - hits / n) / (n - 1)) ** 0.5, sum(f1[k] * support[k] for k in labels) / n, sum(f1.values()) / 3, mcc)
    assert all(abs(a - b) < 1e-6 for a, b in zip(r, want))
    with pytest.raises(Exception, match="class other than"):
        report.class_metrics(spark.createDataFrame(pairs, "g int, p int"), "g", "p").collect()
    constant = report.multiclass_metrics(spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "g int, p int"), "g", "p").first()
    assert constant["mcc"] == 0 and constant["missing"] == 0


def test_rolling_mean_in_ranges_is_that_of_one(spark):
    rows = spark.createDataFrame([(s, i, float(i * i % 17)) for s, n in (("a", 300), ("b", 7), ("c", 30)) for i in range(n)], "s string, i int, v double")
    key = lambda df: sorted((r["s"], r["i"], None if r["rolling"] is None else round(r["rolling"], 9)) for r in df.collect())
    one = key(report.rolling_mean(rows, "s", "i", "v"))
    assert key(report.rolling_mean(rows, "s", "i", "v", per_range=20)) == one == key(report.rolling_mean(rows, "s", "i", "v", per_range=3))


def test_broken_archives_are_told(spark, tmp_path):
    """Bytes flipped anywhere: the integrity check finds it, the reader ends with an error row, neither fails."""
    import random

    rng = random.Random(3)
    archive(tmp_path / "whole.tar.gz", {f"20120101_10-K_{i}_00000{i}.txt": rng.randbytes(3000) + b"text " * 900 for i in range(4)})
    raw = (tmp_path / "whole.tar.gz").read_bytes()
    folder = tmp_path / "bad"
    folder.mkdir()
    for k in range(40):
        at = 12 + k * (len(raw) - 60) // 40
        (folder / f"bad{k:02}.tar.gz").write_bytes(raw[:at] + bytes(b ^ 0x5A for b in raw[at : at + 40]) + raw[at + 40 :])
    tar.register(spark)
    checked = spark.read.format("archiveintegrity").option("path", str(folder)).load().collect()
    assert len(checked) == 40 and not any(r["sound"] for r in checked)
    assert {r["archive"] for r in files.archive_errors(spark, str(folder)).collect()} == {f"bad{k:02}.tar.gz" for k in range(40)}
    assert files.archive_errors(spark, str(tmp_path / "whole.tar.gz")).count() == 0
    assert spark.read.format("tarmembers").option("path", f"file://{tmp_path}").load().count() == 4


def test_inventory_by_depth_and_size(spark, tmp_path):
    for name, size in (("a.txt", 5), ("x/b.txt", 50), ("x/c.txt", 1), ("x/y/z/d.txt", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"." * size)
    rows = files.inventory(spark, str(tmp_path)).collect()
    got = [(r["directory"].rpartition(str(tmp_path))[2], r["files"], r["bytes"], r["depth"], r["has_subdirs"], r["is_leaf"]) for r in rows]
    assert got == [("/x", 2, 51, 1, True, False), ("/x/y/z", 1, 7, 3, False, True), ("", 1, 5, 0, True, False)]
    assert files.inventory(spark, str(tmp_path), max_depth=1).count() == 2


def test_ascii_json_and_batches(spark, tmp_path):
    texts = ["plain", 'quote " back \\ slash / line\nfeed\ttab', "é ü 漢字", "emoji \U0001f600 end", "", "\x01 control"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(files.ascii_json(F.col("t"))).collect()]
    assert [g.lower() for g in got] == [json.dumps(t).lower() for t in texts] and [json.loads(g) for g in got] == texts
    path = str(tmp_path / "out")
    assert files.write_batches(df.repartition(1), path, "t", 30) == len(texts)
    back = spark.read.schema("t string").json(path)
    assert sorted(r["t"] for r in back.collect()) == sorted(texts)
    sizes = [sum(len(line) + 1 for line in f.read_text().splitlines()) for f in (tmp_path / "out").rglob("*.txt")]
    assert len(sizes) > 2 and all(n >= 30 for n in sorted(sizes)[1:])


def test_split_sink_counts(spark, tmp_path):
    rows = ordering.split(spark.range(50).withColumnRenamed("id", "k"), "s", "k", 7)
    assert files.write_split(rows, str(tmp_path / "s")) == {"train": 43, "eval": 7}


def test_whitelist_file_and_flags(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Form Type,Length,Raw,Number,Chosen\n10-K,1,2,3,1\n8-K,1,2,3,0\n10-K/A,1,2,3,1\n")
    assert [r[0] for r in files.whitelist(spark, str(tmp_path / "w.csv")).collect()] == ["10-K", "10-K/A"]
    assert files.csv_renamed(spark, str(tmp_path / "w.csv"), files.WHITELIST).columns[0] == "form_type"


def test_flat_merge_head(spark):
    nested = spark.createDataFrame([(1, (2, (3, 4)))], "a int, b struct<c: int, d: struct<e: int, f: int>>")
    assert selection.flat(nested).columns == ["a", "b_c", "b_d_e", "b_d_f"]
    parts = {2: spark.range(2).toDF("k"), 0: spark.range(5, 8).toDF("k"), 1: None}
    assert [(r["worker"], r["k"]) for r in selection.merged(parts, "k").collect()] == [(0, 5), (0, 6), (0, 7), (2, 0), (2, 1)]
    assert selection.head_of_each(spark.range(20).selectExpr("id", "id % 3 AS g"), "g", "id", 2).count() == 6


def test_error_log(spark):
    bad = filing(doc("10-K", "words"), doc("10-K", f"<PDF>\n{uu(b'pdf')}\n</PDF>"), "<DOCUMENT>\n<TEXT>\nno type\n</TEXT>\n</DOCUMENT>")
    rows = O.error_log(O.cleaned(spark.createDataFrame([(1, bad), (2, filing(doc("10-K", "fine")))], "filing_id int, content string"))).collect()
    assert [(r["filing_id"], r["removed"], [(e["pos"], e["type"], e["error_type"]) for e in r["log"]]) for r in rows] == [(1, True, [(1, "10-K", "pdf_extraction"), (2, None, "no_type")])]


def test_stream_counter_goes_on(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    chunk = spark.range(6).select(F.array(F.col("id").cast("int")).alias("input_ids"), F.array(F.lit(1)).alias("attention_mask"), F.array(F.lit(1)).alias("labels"))
    seen = []
    for rows in (chunk, chunk.limit(4)):
        rows.coalesce(1).write.mode("append").json(source)
        counted = feed.positions(feed.chunks(spark, source))
        counted.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(r["processed_examples"] for r in df.collect())).start().awaitTermination()
    assert seen == [6, 10]


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer file here")
def test_subword_ids_chunks_and_pieces(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = {1: "The quick brown fox. " * 300, 2: "short", 3: " \n", 4: None, 5: "éü漢 <|endoftext|> end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in texts.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain.encode_special_tokens = True
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in texts.items() if t and t.strip()}
    got = {r["doc_id"]: r["n_tokens"] for r in registry.QUERIES["subword_counts"](spark, str(tmp_path)).collect()}
    assert got == {i: len(x) + 1 for i, x in ids.items()}
    for name, length, stride in (("subword_chunks_2048", 2048, 128), ("subword_chunks_8192", 8192, 512)):
        rows = {(r["doc_id"], r["chunk_no"]): r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        want = {}
        for i, x in ids.items():
            for k in range(-(-max(len(x), length) // (length - stride))):
                own = x[k * (length - stride) : k * (length - stride) + length]
                want[i, k] = (own + [50256] * (length - len(own)), [1] * len(own) + [0] * (length - len(own)))
        assert {k: (r["input_ids"], r["attention_mask"]) for k, r in rows.items()} == want and all(r["labels"] == r["input_ids"] for r in rows.values())
    decoded = {r["item_id"]: (r["ids"], r["pieces"]) for r in registry.QUERIES["subword_decode"](spark, str(tmp_path)).collect()}
    assert decoded[4] == (None, None) and all(decoded[i] == (x, [plain.id_to_token(t) for t in x]) for i, x in ids.items())


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer file here")
def test_subword_ids_come_in_slices_and_are_those_of_whole_texts(spark):
    import random

    import pandas as pd
    from tokenizers import Tokenizer

    from lexmill.functions import tokenizers

    plain, draw = Tokenizer.from_file(TOKENIZER), random.Random(7)
    plain.encode_special_tokens = True
    signs = ["a", "Bc", "don't", "'s", "'", "9", "_", " ", "  ", "\n", "\t", "\r\n", ",", ".", "!!", "é", "漢字", "\u00a0", "\x1c", "\u3000", "<|endoftext|>", "\u0301", "\x00", "😀", "prose", " words"]
    block = ["".join(draw.choices(signs, k=draw.randint(0, 200))) for _ in range(5000)]
    long = "".join(draw.choices([c for c in signs if c != "\u00a0"], k=tokenizers.SLICE)) + " prose goes on, on and on." * (tokenizers.SLICE // 10)
    block[100:100] = [None, "", long, None]
    got = list(tokenizers.subword_ids(TOKENIZER).func(iter([pd.Series(block, dtype=object)])))
    sizes, at = [], 0
    for part in got:
        sizes.append(sum(len(t or "") for t in block[at : at + len(part)]))
        at += len(part)
    assert at == len(block) and sorted(sizes)[-1] == len(long) and sorted(sizes)[-2] <= tokenizers.SLICE
    want = [None if t is None else plain.encode(t, add_special_tokens=False).ids for t in block]
    assert [None if x is None else x.tolist() for part in got for x in part] == want


def test_chunk_masks_are_repeated_not_mapped(spark):
    out = T.chunk_arrays(spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, None)], "k int, ids array<int>"), "ids", 4, 1, 0)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["k"], r["chunk_no"]): (r["input_ids"], r["attention_mask"]) for r in out.collect()}
    assert rows[1, 0] == ([5, 6, 7, 0], [1, 1, 1, 0]) and rows[1, 1] == rows[2, 0] == ([0] * 4, [0] * 4) and rows[3, 0] == (None, None)


def test_spread_keeps_rows_and_pushes_columns(spark, tmp_path):
    from lexmill import session

    spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS t", "id % 7 AS k").coalesce(1).write.parquet(str(tmp_path / "x"))
    table = spark.read.parquet(str(tmp_path / "x"))
    dealt = session.spread(table)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(dealt.collect()) == sorted(table.collect())
    plan = dealt.filter("k = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in plan
