import json
import sqlite3
import zipfile

import pytest

from lorewell.sources import files, snapshots, transcripts


def put(path, text):
    path.write_text(text)
    return str(path)


def test_feed(spark, tmp_path):
    events = [{"id": "e1", "timestamp": "2024-01-02T03:04:05Z", "event_type": "alert", "source": "mail", "summary": "Hi", "details": {"full_message": "long", "importance": "high", "choices": [{"label": "yes"}]}}, {"id": "e2", "timestamp": "never", "event_type": "note", "summary": "Two"}]
    path = put(tmp_path / "feed.jsonl", "\n".join(map(json.dumps, events)) + "\n\nnot json\n")
    rows = {r.id: r for r in files.feed_events(spark, path).collect()}
    assert set(rows) == {"e1", "e2"} and rows["e2"].at is None and rows["e1"].at.hour == 3
    text = {r.id: r for r in files.event_markdown(files.feed_events(spark, path)).collect()}
    assert text["e1"].markdown == "# Hi\n\nlong\n\n## Choices\n- yes" and text["e1"].tags == ["alert", "mail", "importance-high"] and text["e2"].tags == ["note"]
    met = put(tmp_path / "met.jsonl", "\n".join(json.dumps({"feed_event_id": "e1", "interaction_type": t, "timestamp": "2024-01-03T00:00:00Z"}) for t in ("open", "reply", "open")))
    got = {r.id: r for r in files.engagement(files.feed_events(spark, path), files.feed_interactions(spark, met)).collect()}
    assert got["e1"].interactions == 3 and got["e1"].types == ["open", "reply"] and got["e2"].interactions is None


def test_transcripts(spark, tmp_path):
    said = lambda kind, *texts, **meta: json.dumps({"kind": kind, "data": {"meta": meta, "content": [{"kind": "text", "data": t} for t in texts] + [{"kind": "tool", "data": "x"}]}})
    put(tmp_path / "s1.jsonl", "\n".join([said("Prompt", " hello ", timestamp=12.5), "broken", said("AssistantMessage", "a", "b"), said("ToolResults", "no"), said("Prompt", " ")]))
    rows = transcripts.sessions(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.session, r.role, r.text, r.started_at) for r in rows] == [("s1", "user", "hello", 12.5), ("s1", "assistant", "a\n\nb", 12.5)]


def test_gate(spark):
    long = " ".join(["word"] * 50)
    turns = [(1, 0, "user", "q" * 100), (1, 1, "assistant", "short\n\n" + long), (1, 2, "user", "more"), (2, 0, "user", "{}"), (2, 1, "assistant", long), (3, 0, "system", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.worth for r in transcripts.gate(df).collect()} == {1: True, 2: False, 3: False}
    assert {r.conv_id for r in transcripts.automated(df).collect()} == {2, 3}


def test_markdown_store(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    put(docs / "a.md", "# One\n\nSource URL: https://x/1\n\n---\n\nbody")
    put(docs / "b.md", "# Again\n\nSource: https://x/1\n---\nbody")
    put(docs / "c.md", "# Two\nSource: https://x/2\n---\n")
    store = files.markdown_store(spark, str(docs))
    assert {(r.url, r.title) for r in store.collect()} == {("https://x/1", "One"), ("https://x/2", "Two")}
    index = put(tmp_path / "index.md", "| Title | Link |\n|---|---|\n| [One](https://x/1) | a |\n| Uno | https://x/1 |\n| no link |\n")
    named = files.markdown_index(spark, index)
    assert [(r.url, r.title) for r in named.collect()] == [("https://x/1", "One")]
    done = spark.createDataFrame([("https://x/9",)], "url string")
    assert {(r.url, r.indexed) for r in files.unprocessed(store, named, done, 5).collect()} == {("https://x/1", True), ("https://x/2", False)}
    assert files.unprocessed(store, named, done, 0).count() == 1


def test_crawl_log(spark, tmp_path):
    log = '\x1b[33mWARN\x1b[39m request timed out\n {"url": "https://a", "retryCount": 1}\nERROR failed\n{"url":"https://a"}\n 403 Forbidden\nINFO fine {"url": "https://c"}\nERROR boom {"url": "https://b"}\nWARN timeout\n{"url": "https://d"}\n'
    assert {(r.url, r.kind) for r in files.crawl_failures(spark, put(tmp_path / "log.txt", log)).collect()} == {("https://a", "auth"), ("https://b", "error"), ("https://d", "timeout")}


def test_subtitles(spark, tmp_path):
    vtt = "WEBVTT\nKind: captions\n\n00:01 --> 00:02\nHello <c>there</c>\nHello there\n\n00:02 --> 00:03\nbye\n00:03 --> 00:04\nHello there\n"
    assert files.subtitles(spark, put(tmp_path / "a.vtt", vtt)).first().text == "Hello there\nbye\nHello there"


def test_bookmarks_and_statuses(spark, tmp_path):
    tree = {"roots": {"bar": {"name": "Bar", "children": [{"name": "A", "url": "https://a"}, {"name": "Sub", "children": [{"name": "B", "url": "https://b"}]}]}, "version": 1}}
    assert {(r.url, r.folder) for r in files.bookmarks(spark, put(tmp_path / "b.json", json.dumps(tree))).collect()} == {("https://a", "/Bar"), ("https://b", "/Bar/Sub")}
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    put(jobs / "x.json", json.dumps({"job": "x", "state": "failed", "exit_code": 2, "consecutive_failures": 4}))
    put(jobs / "y.json", "{broken")
    assert {(r.job, r.readable) for r in files.job_statuses(spark, str(jobs)).collect()} == {("x", True), (None, False)}


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {s}/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>3.5</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p {a}><a:p><a:r><a:t>slide {n} text</a:t></a:r></a:p></p>")
    put(tmp_path / "d.docx", "no package")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in files.office_packages(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "## Head\ntext\n| c1 | c2 |", "b.xlsx": "| shared | 3.5 | TRUE |", "c.pptx": "## Slide 2\nslide 2 text\n## Slide 10\nslide 10 text", "d.docx": None}


def test_long_office_text_is_whole(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>{'x' * 1_000_000} end</w:t></w:r></w:p></w:body></w:document>")
    assert files.package_text((tmp_path / "a.docx").read_bytes()) == "x" * 1_000_000 + " end"


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE facts (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO facts VALUES (?, ?)", [(1, "a"), (2, "b")])
    rows = files.sqlite_table(spark, str(tmp_path / "s.db"), "facts", "id long, name string, extra string").collect()
    assert {(r.id, r.name, r.extra) for r in rows} == {(1, "a", None), (2, "b", None)}


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.latest(spark, path) is None
    assert [snapshots.write(spark.range(n), path) for n in (1, 2, 3)] == [1, 2, 3]
    (tmp_path / "t" / "rows-left-behind").mkdir()
    with pytest.raises(FileExistsError):
        snapshots.commit(spark, path, 3, "rows-left-behind")
    assert snapshots.latest(spark, path).count() == 3 and snapshots.prune(spark, path, 2) == [1] and snapshots.versions(spark, path) == [2, 3]
