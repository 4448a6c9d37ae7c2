import io
import json
import posixpath
import zipfile
from xml.etree import ElementTree

import pytest

from loomwork.sources import blanks
from loomwork.streaming import feed


@pytest.mark.parametrize("make, parts", [(blanks.document, 1), (blanks.workbook, 2), (blanks.slides, 5)])
def test_packages(make, parts):
    """Every part is well formed, has a content type, and every link leads to a part; bytes do not vary."""
    data = make()
    assert data == make()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    typed = {e.get("PartName").lstrip("/"): e.get("ContentType") for e in files["[Content_Types].xml"] if e.get("PartName")}
    assert len(typed) == parts and set(typed) == {n for n in files if not n.endswith(".rels") and not n.startswith("[")}
    for name in (n for n in files if n.endswith(".rels")):
        base = posixpath.dirname(posixpath.dirname(name))
        for link in files[name]:
            assert posixpath.normpath(posixpath.join(base, link.get("Target"))) in typed
    if parts == 5:
        assert typed["ppt/theme.xml"].endswith("officedocument.theme+xml") and typed["ppt/first.xml"].endswith("presentationml.slide+xml")


def test_formats(spark):
    got = {r.ext: bytes(r.content) for r in blanks.formats(spark).collect()}
    assert sorted(blanks.MIME) == ["csv", "docx", "json", "md", "pptx", "rtf", "txt", "xlsx"] and set(got) == set(blanks.MIME)
    assert got["txt"] == got["md"] == got["csv"] == b"" and got["json"] == b"{}\n" and got["rtf"].startswith(b"{\\rtf1") and got["docx"][:2] == b"PK"


def test_feed_keeps_the_latest(spark, tmp_path):
    """Files that come later change the state; an older version does not."""
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in").mkdir()
    schema = "id string, fetched long, score int"

    def state():
        q = feed.latest(feed.watch(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.id: (r.fetched, r.score) for r in spark.table("state").collect()}

    put("1.json", {"id": "a", "fetched": 1, "score": 0}, {"id": "b", "fetched": 1, "score": None})
    assert state() == {"a": (1, 0), "b": (1, None)}
    put("2.json", {"id": "a", "fetched": 3, "score": 2}, {"id": "c", "fetched": 2, "score": 1})
    put("3.json", {"id": "a", "fetched": 2, "score": 1})
    (tmp_path / "in" / "ignored.txt").write_text("x")
    assert state() == {"a": (3, 2), "b": (1, None), "c": (2, 1)}


def test_clock(spark):
    events = [("s", "start", 0, None), ("s", "chunk", 1, 10), ("s", "pause", 2, None), ("s", "resume", 7, None), ("s", "chunk", 8, 5), ("s", "stop", 10, None), ("open", "start", 0, None), ("lost", "chunk", 3, 4)]
    df = spark.createDataFrame(events, "session string, kind string, t int, size long").selectExpr("session", "kind", "timestamp_seconds(t) AS at", "size")
    assert {r.session: (r.bytes, r.seconds) for r in feed.clock(df).collect()} == {"s": (15, 5.0), "open": (0, 0.0), "lost": (4, 0.0)}
    assert feed.clock(df.limit(0)).count() == 0
