"""Readers on small files written into a fresh temporary folder."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from threatsift.sources import corpus as SRC
from threatsift.sources.split_csv import CsvBlocks, ends_inside


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_tolerant_csv_drops_long_rows_keeps_short(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    write(p, 'text,label\n"multi\nline, ""quoted""",spam\ntoo,many,fields\nshort\nlong,spam,,x\nlong,spam,\n"a, ""b""",spam,"",""\nok,ham\n')
    rows = SRC.tolerant_csv(spark, p, ["text", "label"]).select("text", "label").collect()
    assert [(r.text, r.label) for r in rows] == [('multi\nline, "quoted"', "spam"), ("short", None), ("ok", "ham")]


def test_threat_feed(spark, tmp_dir):
    p = os.path.join(tmp_dir, "feed", "urlhaus.csv")
    write(p, '# a comment\n# more\n# id,dateadded,url,url_status\n"1","2024-01-01","http://x.y/a","online"\n'
             '"2","2024-01-02", "http://z.w/?q=""a"",b" ,"offline"\n"3","2024-01-03","u","online","sixth",\n"4","2024-01-04"\n')
    rows = SRC.threat_feed_csv(spark, p).select("id", "url", "url_status").collect()
    assert [(r.id, r.url) for r in rows] == [("1", "http://x.y/a"), ("2", 'http://z.w/?q="a",b'), ("4", None)]
    late = os.path.join(tmp_dir, "late", "feed.csv")
    write(late, "".join(f"# line {i}\n" for i in range(120)) + "# id,dateadded,url\n1,2,3\n")
    assert SRC.threat_feed_header(spark, late) is None and SRC.threat_feed_header(spark, late, 200) == ["id", "dateadded", "url"]


def test_ranked_and_blocklist(spark, tmp_dir):
    t = os.path.join(tmp_dir, "tranco.csv")
    write(t, "1,google.com\n2,example.org\n")
    assert [r.url for r in SRC.ranked_list(spark, t).collect()] == ["google.com", "example.org"]
    m = os.path.join(tmp_dir, "majestic.csv")
    write(m, "GlobalRank,Domain\n1,a.com\n")
    assert [r.url for r in SRC.ranked_list(spark, m, "majestic").collect()] == ["a.com"]
    b = os.path.join(tmp_dir, "phishtank.csv")
    write(b, 'url\nhttp://bad.example\n"two\nlines"\na,b\n')
    assert [(r.text, r.label) for r in SRC.blocklist(spark, b).collect()] == [("http://bad.example", 1), ("two\nlines", 1)]


def test_text_lines_and_docx(spark, tmp_dir):
    p = os.path.join(tmp_dir, "items.txt")
    write(p, "  one \n\n two\r\n   \nthree\rfour")
    assert sorted(r.item for r in SRC.text_lines(spark, p).collect()) == ["one", "three\rfour", "two"]
    d = os.path.join(tmp_dir, "docs")
    os.makedirs(d)
    with open(os.path.join(d, "a.docx"), "wb") as fh:
        fh.write(SRC.docx_bytes(["First", "  ", "Second <b> & more"]))
    with open(os.path.join(d, "broken.docx"), "wb") as fh:
        fh.write(b"not a zip")
    rows = SRC.docx_paragraphs(spark, d).orderBy("para_idx").collect()
    assert [r.text for r in rows if r.error is None] == ["First", "Second <b> & more"]
    assert [os.path.basename(r.path) for r in rows if r.error] == ["broken.docx"]
    assert all(r.error for r in SRC.docx_paragraphs(spark, d, max_bytes=5).collect())


def test_docx_tabs_breaks_and_tables():
    import io
    import zipfile

    body = ("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r><w:hyperlink><w:r><w:t>d</w:t></w:r></w:hyperlink></w:p>"
            "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>")
    xml = f'<w:document xmlns:w="{SRC.W_NS[1:-1]}"><w:body>{body}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert SRC.docx_paragraph_texts(buf.getvalue()) == ["a\tb\ncd", ""]


def test_corpus_listing_routes_and_excludes(spark, tmp_dir):
    write(os.path.join(tmp_dir, "url datasets", "u.csv"), "url,type\nhttp://a,phishing\n")
    write(os.path.join(tmp_dir, "email datasets", "nazario.csv"), "body,label\nhi,1\n")
    write(os.path.join(tmp_dir, "other", "iscx-url-2016.csv"), "f1,f2\n1,2\n")
    rows = {os.path.basename(r.path): r for r in SRC.list_corpus(spark, tmp_dir).collect()}
    assert rows["u.csv"].kind == "url" and rows["nazario.csv"].kind == "email"
    assert rows["iscx-url-2016.csv"].excluded and not rows["u.csv"].excluded
    paths = [r.path for r in rows.values()]
    assert set(SRC.header_groups(spark, paths)) == {"url,type", "body,label", "f1,f2"}


def test_first_occurrence_decides_within_and_across_files(spark, tmp_dir):
    """Many texts, each first spam then ham in one file, and again in a later one."""
    from threatsift.plans.prepare import prepare_email_corpus

    lines = "".join(f"text {i},spam\n" for i in range(400)) + "".join(f"Text {i},ham\n" for i in range(400))
    write(os.path.join(tmp_dir, "email datasets", "a.csv"), "body,label\n" + lines)
    write(os.path.join(tmp_dir, "email datasets", "b.csv"), "label,body\n" + "".join(f"ham,text {i}\n" for i in range(500)))
    write(os.path.join(tmp_dir, "email datasets", "c.csv"), "")
    rows = prepare_email_corpus(spark, tmp_dir).collect()
    assert {r.text: r.label for r in rows} == {f"text {i}": 1 if i < 400 else 0 for i in range(500)} and len(rows) == 500


def test_url_preparation_and_label_override(spark, tmp_dir):
    from threatsift.plans.prepare import prepare_url_corpus, write_corpora

    base = os.path.join(tmp_dir, "raw", "url datasets")
    write(os.path.join(base, "a.csv"), "url,type\nhttp://A/1,benign\nhttp://b,phishing\nhttp://c,phishing,\nhttp://d,odd\n")
    write(os.path.join(base, "majestic.csv"), "GlobalRank,Domain\n1,Good.org\n")
    write(os.path.join(base, "top-1m.csv"), "1,first.org\n2,good.org\n")
    write(os.path.join(base, "blocked.csv"), "link\nhttp://b\nhttp://e\n")
    write(os.path.join(base, "urlhaus.csv"), "# note\n# id,dateadded,url,url_status\n1,2024,http://f,online\n")
    got = {r.url: r.label for r in prepare_url_corpus(spark, os.path.join(tmp_dir, "raw")).collect()}
    assert got == {"http://a/1": 0, "http://b": 1, "http://e": 1, "good.org": 0, "first.org": 0}
    forced = {r.url: r.label for r in prepare_url_corpus(spark, os.path.join(tmp_dir, "raw"), {"urlhaus": 1}).collect()}
    assert forced == got | {"http://f": 1}
    out = os.path.join(tmp_dir, "out")
    write_corpora(spark, os.path.join(tmp_dir, "raw"), out)
    balanced = spark.read.parquet(f"{out}/url_cleaned").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in balanced} == {0: 2, 1: 2}
    assert spark.read.parquet(f"{out}/email_cleaned").count() == 0


def test_resolve_columns_rules():
    from threatsift.operators.clean import resolve_columns
    assert resolve_columns(["url", "type"]) == ("url", "type")
    assert resolve_columns(["account", "country", "body", "label"]) == ("body", "label")
    assert resolve_columns(["video_id", "profile", "message_text", "class"]) == ("message_text", "class")
    assert resolve_columns(["a", "b"], lambda x, y: (5, 2)) == ("a", "b")
    assert resolve_columns(["a", "b"], lambda x, y: (2, 5)) == ("b", "a")
    assert resolve_columns(["only"]) == ("only", "only")


def test_one_source_is_written_as_several_files_in_row_order(spark, tmp_dir):
    from threatsift.plans.q_sources import _write_per_file

    rows = spark.range(4000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("file"),
                                    (3999 - F.col("id")).alias("ord"), (3999 - F.col("id")).alias("body"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        _write_per_file(rows, os.path.join(tmp_dir, "out"), "file", "ord")
    finally:
        spark.conf.set(key, before)
    folder = os.path.join(tmp_dir, "out", "file=a")
    parts = sorted(f for f in os.listdir(folder) if f.endswith(".csv"))
    lines = [open(os.path.join(folder, p)).read().split() for p in parts]
    assert len(parts) > 1 and all(x[0] == "body" for x in lines)
    assert [int(v) for x in lines for v in x[1:]] == [o for o in range(4000) if (3999 - o) % 5]


def hard_csv(n=400, seed=5):
    """Records with line breaks, commas and doubled quotes, short and long ones,
    stray quotes, empty lines, bytes that are no UTF-8."""
    rnd = random.Random(seed)
    out = [b"text,label,more\n"]
    for i in range(n):
        cells = []
        for _ in range(rnd.choice([1, 2, 3, 3, 3, 4, 5])):
            body = "".join(rnd.choice(["a", "bb", " ", ",", "\n", "\r\n", '""', "#", "\u00e9", "\n\n"]) for _ in range(rnd.randint(0, 9)))
            cells.append(f'"{body}"' if rnd.random() < 0.6 else rnd.choice(["x", "", " y ", 'in"ch', "5", 'a "b" c']))
        out.append(",".join(cells).encode() + rnd.choice([b"\n", b"\n", b"\n\n"]))
        if rnd.random() < 0.03:
            out.append(b"bad \xff byte,1,2\n")
    return b"".join(out) + b'"open to the end\nof the file'


def by_whole_file_parser(spark, path, columns):
    """The same rules with Spark's own multi-line reader: one task per file."""
    schema = ", ".join(f"{c} string" for c in [*columns, "_record"])
    r = spark.read.schema(schema).options(header="true", multiLine="true", escape='"', mode="PERMISSIVE", encoding="UTF-8",
                                          columnNameOfCorruptRecord="_record").csv(path)
    rows = r.select(*columns, "_record", F.monotonically_increasing_id().alias("n")).collect()
    many = [r for r in rows if r["_record"] is None or spark_count(r["_record"]) <= len(columns)]
    return [tuple(r)[:len(columns)] for r in sorted(many, key=lambda r: r["n"])]


def spark_count(record):
    return re.sub('"[^"]*"', "", record).count(",") + 1


@pytest.mark.parametrize("block", ["37", "256", "4096", "134217728"])
def test_records_do_not_depend_on_the_blocks(spark, tmp_dir, block):
    names = ["text", "label", "more"]
    paths = []
    for i in range(3):
        paths.append(os.path.join(tmp_dir, f"f {i}+%41.csv"))
        with open(paths[-1], "wb") as fh:
            fh.write(hard_csv(seed=i, n=25 if block == "37" else 300))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = SRC.tolerant_csv(spark, paths, names)
        got = [tuple(r) for r in df.orderBy("path", "row_pos").select(*names).collect()]
        assert df.select("path", "row_pos").distinct().count() == len(got)
        if block != "134217728":
            assert CsvBlocks(spark, paths).table.count() >= len(paths) * 2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [row for p in paths for row in by_whole_file_parser(spark, p, names)]


@pytest.mark.parametrize("line,inside,feed,want", [
    (b"a,b", False, False, False), (b"a,b", True, False, True), (b'"a', False, False, True), (b'a",b', True, False, False),
    (b'"a""', False, False, True), (b'"a"""', False, False, False), (b'in"ch', False, False, False), (b'x,"y', False, False, True),
    (b' "y', False, False, False), (b' "y', False, True, True), (b'# "', False, True, False), (b'# "', True, True, False),
    (b'"a" b", "c', False, False, False), (b'"a" b",", "', False, False, False), (b'""', False, False, False), (b'",""","', False, False, True)])
def test_state_behind_a_line(line, inside, feed, want):
    assert ends_inside(line, inside, feed) is want


def test_either_line_break_ends_a_record(spark, tmp_dir):
    p = os.path.join(tmp_dir, "crlf.csv")
    with open(p, "wb") as fh:
        fh.write(b'\xef\xbb\xbftext,label\r\n"a\r\nb",1\r\n\r\nc,2\nd,3\r\n')
    rows = SRC.tolerant_csv(spark, p, ["text", "label"]).orderBy("row_pos").collect()
    assert [(r.text, r.label) for r in rows] == [("a\r\nb", "1"), ("c", "2"), ("d", "3")]


def test_ranked_lists_with_their_own_headers(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "majestic_a.csv"), os.path.join(tmp_dir, "majestic_b.csv")
    write(a, "GlobalRank,Domain\n1,a.org\n")
    write(b, "Domain,GlobalRank\nb.org,2\n")
    assert sorted(r.url for r in SRC.ranked_list(spark, [a, b], "majestic").collect()) == ["a.org", "b.org"]


def test_headers_come_from_one_job(spark, tmp_dir):
    paths = [os.path.join(tmp_dir, f"{i}.csv") for i in range(30)]
    for i, p in enumerate(paths):
        write(p, f"h{i % 3},x\n1,2\n" if i else "")
    groups = SRC.header_groups(spark, paths)
    assert {h: len(p) for h, p in groups.items()} == {"h0,x": 9, "h1,x": 10, "h2,x": 10}
