"""Ingestion: records, files, store, streams, enrichment."""

from __future__ import annotations

import datetime as dt
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from test_search import EPUB, record

from stackroom.operators import enrich, ingest
from stackroom.sources import library
from stackroom.sources.epub import Epub, image_size
from stackroom.sources.pdf import Pdf
from stackroom.sources.store import Store, as_json
from stackroom.streaming import library as stream


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def epub(title="Test EPUB", author="John Doe", series=True, cover="property"):
    z = io.BytesIO()
    items = {"property": '<item id="c" href="img/cover.png" media-type="image/png" properties="cover-image"/>', "page": '<item id="c" href="cover.xhtml" media-type="application/xhtml+xml"/>'}[cover]
    meta = '<meta name="cover" content="c"/>' if cover == "page" else ""
    opf = f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata>
    <dc:title>{title}</dc:title><dc:creator opf:role="aut">{author}</dc:creator><dc:contributor opf:role="ill">Ann Ink</dc:contributor><dc:language>en</dc:language>
    <dc:subject>Fiction; Rings</dc:subject><dc:date opf:event="publication">2001-02-03</dc:date>{meta}
    {'<meta name="calibre:series" content="The Lord"/><meta name="calibre:series_index" content="2"/>' if series else ''}</metadata>
    <manifest>{items}<item id="i" href="img/big.png" media-type="image/png"/><item id="j" href="img/big.png" media-type="image/png"/><item id="s" href="img/small.png" media-type="image/png"/></manifest></package>"""
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("OEBPS/content.opf", opf)
        f.writestr("OEBPS/text/one.xhtml", "<html><body><p>one two</p><script>no</script>three</body></html>")
        f.writestr("OEBPS/nav.xhtml", "<p>not counted</p>")
        f.writestr("OEBPS/cover.xhtml", '<img src="img/cover.png"/>')
        f.writestr("OEBPS/img/cover.png", png(2000, 2000))
        f.writestr("OEBPS/img/big.png", png(1000, 1000))
        f.writestr("OEBPS/img/small.png", png(10, 10))
    return z.getvalue()


def pdf(title=True, packed=False):
    info = (b"/Title (Test \\(PDF\\)) " if title else b"") + b"/Author (Jane Roe; Ann Lee) /Subject (About) /CreationDate (D:20210203120000) "
    page = b"<< /Type /Page /Parent 2 0 R >>"
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R /Lang (es) >> endobj\n2 0 obj << /Type /Pages /Count 2 >> endobj\n"
    if packed:
        body = b"3 0 4 " + str(len(page)).encode() + b" "
        data = zlib.compress(body + page + page)
        out += b"9 0 obj << /Type /ObjStm /N 2 /First " + str(len(body)).encode() + b" /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >> stream\n" + data + b"\nendstream endobj\n"
    else:
        out += b"3 0 obj " + page + b" endobj\n4 0 obj " + page + b" endobj\n"
    out += b"6 0 obj << /Subtype /Image /Width 1000 /Height 1000 /Filter /DCTDecode >> stream\n\xff\xd8x\nendstream endobj\n5 0 obj << " + info + b">> endobj\ntrailer << /Root 1 0 R /Info 5 0 R >>"
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("lib")
    (d / "nested").mkdir()
    (d / "a.epub").write_bytes(epub())
    (d / "nested/b.epub").write_bytes(epub("Test EPUB", cover="page", series=False))
    (d / "c.PDF").write_bytes(pdf())
    (d / "d.pdf").write_bytes(pdf(title=False, packed=True))
    (d / "broken.epub").write_bytes(b"no zip")
    (d / "notes.txt").write_text("x")
    return str(d)


def test_readers():
    e = Epub(epub())
    assert (e.words(), e.illustrations(), e.cover_name()) == (3, 1, "OEBPS/img/cover.png")
    assert Epub(epub(cover="page")).cover_name() == "OEBPS/img/cover.png" and e.cover()[:4] == b"\x89PNG"
    assert e.illustrations(2.0) == 0 and image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4) and image_size(b"") == (0, 0)
    for p in (Pdf(pdf()), Pdf(pdf(packed=True))):
        assert (p.pages(), p.illustrations(), p.information()["title"], p.information()["language"]) == (2, 1, "Test (PDF)", "es")
    with pytest.raises(ValueError):
        Pdf(b"hello")


def test_library_scan(spark, folder):
    files = library.scan(spark, folder)
    assert sorted(r["path"] for r in files.select("path").collect()) == ["a.epub", "broken.epub", "c.PDF", "d.pdf", "nested/b.epub"]
    records = library.read_records(files).cache()
    rows = {r["id"]: r for r in ingest.with_unique_slugs(library.metadata(records)).collect()}
    assert rows["a.epub"]["slug"] == "john-doe-test-epub" and rows["nested/b.epub"]["slug"] == "john-doe-test-epub--2"
    assert rows["a.epub"]["subjects"] == ["Fiction", "Rings"] and rows["a.epub"]["illustrators"] == ["Ann Ink"] and rows["a.epub"]["series_index"] == 2.0
    assert rows["a.epub"]["words"] == 3.0 and rows["a.epub"]["illustrations"] == 1
    assert rows["c.PDF"]["authors"] == ["Jane Roe", "Ann Lee"] and rows["c.PDF"]["pages"] == 2.0 and rows["d.pdf"]["title"] == "d"
    assert [r["path"] for r in library.failures(records).collect()] == ["broken.epub"]
    seen = spark.createDataFrame([("a.epub",), ("c.PDF",)], "id string")
    assert library.pending(files, seen).count() == 3 and library.pending(files, None).count() == 5
    assert sorted(r["path"] for r in library.covers(files).collect()) == ["a.epub", "c.PDF", "d.pdf", "nested/b.epub"]
    assert library.raw_file(files, "c.PDF").first()["content_type"] == "application/pdf"


def test_records_to_catalogue(spark):
    rows = [record("z/1.epub", "T", "A & B", subjects=["x, y; z"], date="1975"), record("z/2.epub", "T", "A & B"), record("z/0.epub", "", " ")]
    got = {r["id"]: r for r in ingest.build_catalogue(spark.createDataFrame(rows, EPUB)).collect()}
    assert [got[k]["slug"] for k in ("z/1.epub", "z/2.epub", "z/0.epub")] == ["a-b-t", "a-b-t--2", "0"]
    assert got["z/1.epub"]["authors"] == ["A", "B"] and got["z/0.epub"]["authors"] == [""] and got["z/1.epub"]["subjects_slugs"] == ["x", "y", "z"]
    known = spark.createDataFrame([("z/1.epub", "a-b-t"), ("old", "a-b-t--2")], "id string, slug string")
    fresh = {r["id"]: r["slug"] for r in ingest.build_catalogue(spark.createDataFrame(rows, EPUB), known).collect()}
    assert fresh == {"z/2.epub": "a-b-t--3", "z/0.epub": "0"}
    cat = ingest.build_catalogue(spark.createDataFrame(rows, EPUB))
    assert sorted(r["slug"] for r in ingest.author_rows(cat).collect()) == ["a", "b"]
    assert ingest.author_rows(cat, spark.createDataFrame([("a",)], "slug string")).count() == 1
    assert ingest.build_catalogue(spark.createDataFrame([], EPUB)).count() == 0
    nulls = spark.createDataFrame([("p.epub", *[None] * 9)], EPUB)
    assert ingest.build_catalogue(nulls).first()["title"] == "p"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.open() is True and s.open() is False
    assert s.read("users").count() == 1 and s.read("documents").count() == 0
    s.upload(spark.createDataFrame([("a", "s", "T")], "id string, slug string, title string"), "2024-01-01 00:00:00")
    assert s.read("documents").first()["added_on"] == dt.datetime(2024, 1, 1)
    s.append("readings", spark.createDataFrame([(1, "s"), (1, "t")], "user_id bigint, slug string"))
    s.delete(spark.createDataFrame([("s",)], "slug string"))
    assert s.read("documents").count() == 0 and s.read("readings").count() == 1
    assert s.open(illustrated_min_size=1.0) is True
    assert json.loads(as_json(spark.createDataFrame([(1, "x")], "a int, b string")).first()["json"]) == {"a": 1, "b": "x"}
    ingest.bulk_write(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("p", "e")], "path string, error string"), str(tmp_path / "bulk"))
    assert spark.read.parquet(str(tmp_path / "bulk/quarantine")).count() == 1


def test_stream_of_records(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"slug": s, "title": t, "at": n}) for s, t, n in (("a", "old", 1), ("a", "new", 2), ("b", "B", 1))))
    out = str(tmp_path / "out")

    def merge(batch, _):
        stream.latest_by_key(batch, ["slug"], "at").write.mode("append").parquet(out)

    stream.watch_records(spark, str(src), "slug string, title string, at int", merge, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r["title"] for r in spark.read.parquet(out).collect()) == ["B", "new"]
    (src / "2.json").write_text(json.dumps({"slug": "c", "title": "C", "at": 1}))
    stream.watch_records(spark, str(src), "slug string, title string, at int", merge, str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_stream_of_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream.watch_files(spark, folder, lambda b, _: b.select("path").write.mode("append").parquet(out), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_file_events(spark):
    ev = spark.createDataFrame([("a", "create", 1), ("a", "delete", 2), ("b", "moved_to", 1), ("c", "moved_from", 1), ("d", "delete", 1), ("d", "close_write", 2)], "path string, event string, at int")
    add, gone = stream.split_events(ev)
    assert sorted(r[0] for r in add.collect()) == ["b", "d"] and sorted(r[0] for r in gone.collect()) == ["a", "c"]
    cat, here = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",)], "path string")
    assert [r[0] for r in stream.removed_paths(cat, here).collect()] == ["y"]
    assert stream.progress(1, 3, 10.0) == (33, 20.0) and stream.progress(0, 3, 1) == (0, 0.0) and stream.progress(5, 3, 1.0) == (100, 0.0)


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    batch = stream.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 day", "event_type")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    q = stream.windowed_counts(src.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type", late="1 hour")
    q = q.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("w").select("n").collect())) == sorted(map(str, batch.select("n").collect()))


ENT = "id string, claims map<string,array<struct<rank:string,value:string,precision:int>>>, descriptions map<string,string>, links map<string,string>"


def test_author_resolution(spark):
    c = lambda v, rank="normal", p=None: [(rank, v, p)]
    ents = [
        ("Q1", {"P31": c("Q4167410")}, {}, {}),
        ("Q2", {"P31": c("Q5"), "P1477": c("Ann Birth"), "P21": c("Q6581072"), "P569": [("normal", "+1900-00-00T00:00:00Z", 9), ("preferred", "+1901-02-03T00:00:00Z", 11)],
                "P742": c("Nom"), "P18": c("A b.jpg"), "P856": c("https://x.example")}, {"en": "writer"}, {"en": "https://w.example"}),
        ("Q3", {"P31": c("Q61002", "preferred")}, {}, {}),
    ]
    names = spark.createDataFrame([("ann", "Ann"), ("bo", "Bo"), ("cy", "Cy"), ("di", "Di")], "slug string, name string")
    found = spark.createDataFrame([("Ann", ["Q1", "Q2"]), ("Bo", ["Q2", "Q3"]), ("Cy", []), ("Di", ["X9", "Q2"])], "name string, ids array<string>")
    got = {r["slug"]: r for r in enrich.resolve_authors(names, found, spark.createDataFrame(ents, ENT), "https://img.example").collect()}
    assert set(got) == {"ann", "bo"} and got["bo"]["entity_id"] == "Q3" and got["bo"]["instance_of"] == 2
    ann = got["ann"]
    assert (ann["entity_id"], ann["birth_name"], ann["gender"], ann["date_of_birth"]["precision"], ann["pseudonyms"]) == ("Q2", "Ann Birth", 2, 11, ["Nom"])
    assert ann["date_of_birth"]["days"] == (dt.date(1901, 2, 3) - dt.date(1, 1, 1)).days and ann["date_of_death"]["days"] == 0
    assert ann["image"].endswith("A_b.jpg") and ann["description"] == {"en": "writer"}


def test_slugs_take_free_numbers(spark, monkeypatch):
    """Gaps are filled first, no slug stands twice, whether groups are numbered in one task or in ranges."""
    from stackroom.operators import joins

    new = [(f"n/{i}", "A", t) for i, t in enumerate(["b"] * 5 + ["c", "d", None, None])]
    rows = spark.createDataFrame([(i, [a], t, "en", "x") for i, a, t in new], "id string, authors array<string>, title string, language string, f string")
    taken = [("a-b--3",), ("a-b--3",), ("a-b--5",), ("a-d",), ("zz",), ("a-b--02",), (None,), ("a-c--x",)]
    for limit in (joins.GROUP_ROWS, 3):
        monkeypatch.setattr(joins.numbered, "__defaults__", (limit,))
        got = ingest.with_unique_slugs(rows, spark.createDataFrame(taken, "slug string")).collect()
        assert {r["id"]: r["slug"] for r in got} == dict(zip([r[0] for r in new], ["a-b", "a-b--2", "a-b--4", "a-b--6", "a-b--7", "a-c", "a-d--2", "a", "a--2"], strict=True))


def test_numbers_of_large_groups(spark):
    from stackroom.operators.joins import numbered

    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 500) END AS k", "xxhash64(id) AS at", "id AS n0").repartition(5)
    got = numbered(df, "k", ["at"], "n", group_rows=100)
    want = df.selectExpr("k", "at", "n0", "row_number() OVER (PARTITION BY k ORDER BY at) AS n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_checkpoints_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from stackroom.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda k: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    from stackroom.operators.joins import broadcast_checked

    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS t")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_checked(df)) and not hinted(broadcast_checked(df, max_rows=50)) and not hinted(broadcast_checked(df, max_bytes=5000))


def epub_file(title, author="Ann Lee", container=None):
    buf = io.BytesIO()
    opf = f'<package xmlns:dc="x"><metadata><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:language>en</dc:language></metadata><manifest/></package>'
    with zipfile.ZipFile(buf, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", f'<container><rootfiles><rootfile full-path="{container}"/></rootfiles></container>')
            z.writestr("A/first.opf", opf.replace(title, "The wrong one"))
            z.writestr(container, opf)
        else:
            z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/p.xhtml", "<p>one two</p>")
    return buf.getvalue()


def test_container_names_the_package():
    assert Epub(epub_file("Right", container="Z/last.opf")).information()["title"] == ["Right"]
    assert Epub(epub_file("Plain")).information()["title"] == ["Plain"]


def test_encryption_is_read_from_the_trailer():
    body = b"%%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n2 0 obj << /Length 9 >> stream\n/Encrypt 5 0 R\nendstream endobj\ntrailer << /Root 1 0 R %s >>"
    assert Pdf(body % b"").objects
    with pytest.raises(ValueError, match="encrypted"):
        Pdf(body % b"/Encrypt 5 0 R")


def test_upload_delete_and_watch(spark, tmp_path):
    folder, store = tmp_path / "books", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    store.open()
    assert store.upload_file(str(folder), "a.epub", epub_file("One"), "2024-01-01 00:00:00") == "ann-lee-one"
    assert store.upload_file(str(folder), "b.epub", epub_file("One"), "2024-01-01 00:00:00") == "ann-lee-one--2"
    for name, data, why in (("c.epub", b"no zip", "BadZipFile"), ("c.txt", b"x", "no file"), ("a.epub", b"x", "already")):
        with pytest.raises(ValueError, match=why):
            store.upload_file(str(folder), name, data, "2024-01-01 00:00:00")
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["a.epub", "b.epub"] and store.read("authors").count() == 1
    assert store.delete(spark.createDataFrame([("ann-lee-one",), ("none",)], "slug string"), str(folder)) == 1
    assert not (folder / "a.epub").exists() and [r["slug"] for r in store.read("documents").collect()] == ["ann-lee-one--2"]
    (folder / "d.epub").write_bytes(epub_file("One"))
    (folder / "e.epub").write_bytes(b"broken")
    for _ in range(2):
        stream.watch_library(spark, store, str(folder), str(tmp_path / "ckpt"))
    assert sorted(r["slug"] for r in store.read("documents").collect()) == ["ann-lee-one", "ann-lee-one--2"]
    assert spark.read.parquet(str(tmp_path / "store" / "quarantine")).count() == 1
    (folder / "b.epub").unlink()
    stream.watch_library(spark, store, str(folder), str(tmp_path / "ckpt"))
    assert [r["id"] for r in store.read("documents").collect()] == ["d.epub"]


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("users", spark.createDataFrame([(1, "A")], "id bigint, name string"))
    bad = store.read("users").withColumn("name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.replace("users", bad)
    assert [r["name"] for r in store.read("users").collect()] == ["A"]
    for n in "BCD":
        store.replace("users", store.read("users").withColumn("name", F.lit(n)))
    assert [r["name"] for r in store.read("users").collect()] == ["D"] and not (tmp_path / "users" / "v2").exists()


def test_endless_watch_stops_when_told(spark, tmp_path):
    import time

    folder, store = tmp_path / "books", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "a.epub").write_bytes(epub_file("One"))
    queries = stream.watch_library(spark, store, str(folder), str(tmp_path / "ckpt"), every="1 seconds")
    end = time.time() + 60
    while time.time() < end and store.read("documents").count() < 1:
        time.sleep(0.5)
    assert store.read("documents").count() == 1 and all(q.isActive for q in queries)
    (folder / "a.epub").unlink()
    while time.time() < end and store.read("documents").count():
        time.sleep(0.5)
    for q in queries:
        q.stop()
    assert store.read("documents").count() == 0


def test_sessions_and_sliding_windows(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 00:{m:02d}:00") for m in (0, 3, 20)] + [("b", "2024-01-01 00:04:00")], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((r["k"], r["n"]) for r in stream.session_counts(df, "at", "5 minutes", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert stream.windowed_counts(df, "at", "10 minutes", "k", slide="5 minutes").agg(F.sum("n")).first()[0] == 8


def test_entities_from_a_folder_of_answers(spark, tmp_path):
    for kind, rows in (("search", [{"name": "Ann", "ids": ["Q1"]}]), ("entities", [{"id": "Q1", "claims": {"P31": [{"rank": "normal", "value": "Q5", "precision": 0}]}, "descriptions": {"en": "x"}, "links": {}}])):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = enrich.authors_from(enrich.JsonFolders(spark, str(tmp_path)), spark.createDataFrame([("ann", "Ann"), ("bo", "Bo")], "slug string, name string"), "https://img.example").collect()
    assert [(r["slug"], r["entity_id"], r["instance_of"]) for r in got] == [("ann", "Q1", 1)]
