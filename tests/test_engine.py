import io
import json
import math
import os
import struct
import wave

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions.render import render
from quarry.plans.engine import Engine, IndexOptions, SearchOptions
from quarry.sources import media
from quarry.sources.folders import Rules, discover
from quarry.sources.snapshots import IdentityError, Snapshots


def tone(path, hertz, seconds=3, loud=9000):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(1), file.setsampwidth(2), file.setframerate(16000)
        file.writeframes(b"".join(struct.pack("<h", int(loud * math.sin(2 * math.pi * hertz * i / 16000))) for i in range(16000 * seconds)))


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "skipme").mkdir()
    (src / "a.txt").write_text("retry with backoff\n\nthe garden is green and the kettle boils\n")
    (src / "sub" / "b.py").write_text("def retry(n):\n    return n * 2\n")
    (src / "sub" / "bin.dat").write_bytes(b"a\0b")
    (src / "skipme" / "c.txt").write_text("left out by a rule")
    (src / ".gitignore").write_text("skipme/\n*.log\n!keep.log\n")
    (src / "x.log").write_text("log")
    (src / "keep.log").write_text("this one is kept")
    tone(src / "low.wav", 200)
    tone(src / "silent.wav", 200, loud=0)
    return src


def test_walk(spark, folder):
    names = {os.path.relpath(r["path"], folder) for r in discover(spark, str(folder)).collect()}
    assert names == {"a.txt", "sub/b.py", "sub/bin.dat", "keep.log", "low.wav", "silent.wav"}
    assert discover(spark, str(folder / "a.txt")).count() == 1


def test_rules():
    own = Rules("build/\n/top.txt\ndocs/**/x?.md\n[ab].c\n# note\n!b.c")
    assert own.verdict("build", True) and own.verdict("build", False) is None
    assert own.verdict("top.txt", False) and own.verdict("sub/top.txt", False) is None
    assert own.verdict("docs/q/r/x1.md", False) and own.verdict("docs/x1.md", False)
    assert own.verdict("a.c", False) and own.verdict("b.c", False) is False


def test_contents(tmp_path):
    assert media.decode_text(b"\xef\xbb\xbfhi\xff") == "hi�" and media.decode_text(b"a\0") is None and media.decode_text(b"") == ""
    probe = '{"streams":[{"codec_type":"video","width":100,"height":100,"disposition":{"attached_pic":1}},{"codec_type":"video","width":1920,"height":1080,"side_data_list":[{"rotation":-90}]},{"codec_type":"audio"}],"format":{"duration":"12.5"}}'
    assert media.parse_probe(probe) == {"duration": 12.5, "has_audio": True, "width": 1080, "height": 1920}
    assert media.parse_probe("{}") == {"duration": 0.0, "has_audio": False, "width": None, "height": None}
    tone(tmp_path / "t.wav", 100, 60)
    assert [(a, b) for a, b, _ in media.wave_windows(str(tmp_path / "t.wav"))] == [(0, 30000), (25000, 55000), (50000, 60000)]


def test_life_of_an_index(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    done = engine.index(str(folder))
    assert done["indexed"] == 6 and done["skipped_binary"] == 1 and done["skipped_recording_without_content"] == 1
    found = engine.search("kettle garden").collect()
    assert found[0]["path"].endswith("a.txt") and found[0]["place"] == 1
    shown = render(engine.search("kettle garden"), "text", str(folder))
    assert shown.startswith("a.txt:1-3  0.") and "3: the garden is green and the kettle boils" in shown
    assert render(engine.search("kettle garden"), "paths", str(folder)).startswith("a.txt\n")
    assert engine.refresh(str(folder)) == "up to date"
    (folder / "a.txt").write_text("now all about turbines\n")
    (folder / "sub" / "b.py").unlink()
    os.utime(folder / "low.wav", (1, 1))
    pending = engine.pending(str(folder))
    assert (pending["modified_files"], pending["deleted_files"], pending["updates_itself"]) == (2, 1, False)
    done = engine.index(str(folder))
    assert (done["indexed"], done["removed"]) == (1, 1)
    assert engine.pending(str(folder))["unchanged_files"] == 5
    assert [r["kind"] for r in engine.search("bass", options=SearchOptions(kind="audio")).collect()] == ["audio"]
    assert all(not r["path"].endswith("a.txt") for r in engine.similar(str(folder / "a.txt")).collect())
    assert "skipped: binary" in engine.status(str(folder)) and str(folder) in engine.status()
    assert engine.forget(str(folder / "sub")) == 1
    assert engine.statistics()["files"] == 3
    other = Snapshots(spark, str(tmp_path / "index"), "another", 64)
    with pytest.raises(IdentityError):
        other.check()


def test_options():
    assert IndexOptions(include_images=False).left_out() == ("image",)


def test_streams(spark, small, tmp_path):
    from quarry.streaming import updates

    rows = spark.read.parquet(f"{small}/file_sightings.parquet")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    got = []
    updates.run_available(updates.changed_files(spark, str(tmp_path / "in")), lambda batch, number: got.append(batch.count()), str(tmp_path / "c"))
    updates.run_available(updates.changed_files(spark, str(tmp_path / "in")), lambda batch, number: got.append(batch.count()), str(tmp_path / "c"))
    assert sum(got) == rows.count()
    query = updates.latest_states(updates.changed_files(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("states").count() == rows.filter("path is not null").select("path").distinct().count()


def pages_of(raw):
    return raw[5:].decode().split("\f") if raw.startswith(b"%PDF-") else None


def test_pages_of_pdfs(spark, tmp_path):
    src = tmp_path / "papers"
    src.mkdir()
    (src / "two.pdf").write_bytes("%PDF-first page about harbours\f\fthird page about lanterns in the fog".encode())
    (src / "blank.pdf").write_bytes(b"%PDF- \f ")
    (src / "broken.pdf").write_bytes(b"nothing")
    engine = Engine(spark, str(tmp_path / "index"), pdf_reader=pages_of)
    done = engine.index(str(src))
    assert done["skipped_pdf_without_text"] == 1 and done["skipped_pdf_unreadable"] == 1
    found = engine.search("lanterns").collect()
    assert [(r["kind"], r["page"]) for r in found][:1] == [("pdf", 3)]
    assert "two.pdf  page 3" in render(engine.search("lanterns"), "text", str(src))


def files_below(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    src = tmp_path / "notes"
    src.mkdir()
    for i in range(30):
        (src / f"n{i}.txt").write_text(f"note number {i} about kettles and word{i}\n")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(src))
    before = files_below(tmp_path / "index")
    (src / "n7.txt").write_text("now it tells of turbines\n")
    engine.index(str(src))
    new = [p for p in files_below(tmp_path / "index") - before]
    by_table = {t: sum(f"/{t}/" in p for p in new) for t in ("files", "chunks", "postings")}
    assert all(1 <= n <= 2 for n in by_table.values()), by_table
    version = engine.store.version()
    assert engine.index(str(src))["indexed"] == 0
    assert {r["path"].rsplit("/", 1)[-1] for r in engine.search("turbines").collect()} >= {"n7.txt"}
    texts = engine.store.table("postings").filter("term = 'word7'").count(), engine.store.table("postings").filter("term = 'word8'").count()
    assert texts == (0, 1) and engine.store.table("chunks").count() == 30
    engine.store.compact()
    assert engine.store.table("chunks").count() == 30 and engine.store.version() >= version
    assert engine.forget(str(src / "n8.txt")) == 1 and engine.store.table("postings").filter("term = 'word8'").count() == 0


def test_stored_words_rank_like_texts(spark, tmp_path, small):
    from quarry.operators import retrieval
    from quarry.plans.search_queries import _chunks

    chunks = _chunks(spark, small).withColumn("embedding", F.lit(None).cast("array<float>"))
    store = Snapshots(spark, str(tmp_path / "s"), "none", 64)
    store.write(chunks=chunks)
    queries = spark.read.parquet(f"{small}/search_queries.parquet").select("query_id", "query_text")
    terms = retrieval.query_words(queries)
    stored = retrieval.rank_postings(store.postings_of([r["term"] for r in terms.collect()]), terms)
    rows = lambda d: sorted((r[0], r[1], round(r[2], 9)) for r in d.collect())
    assert rows(stored) == rows(retrieval.keyword_scores(chunks, queries))


def test_sounds_at_other_rates(tmp_path):
    slow = [x for _, _, x in media.wave_windows(write_tone(tmp_path / "slow.wav", 440, 8000))][0]
    quick = [x for _, _, x in media.wave_windows(write_tone(tmp_path / "quick.wav", 440, 44100))][0]
    assert len(slow) == len(quick) == 32000
    assert abs(slow[4000:28000] - quick[4000:28000]).max() < 0.02


def write_tone(path, hertz, rate):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(1), file.setsampwidth(2), file.setframerate(rate)
        file.writeframes(b"".join(struct.pack("<h", round(9000 * math.sin(2 * math.pi * hertz * i / rate))) for i in range(rate * 2)))
    return str(path)


def test_command_line(spark, folder, tmp_path):
    def run(*arguments):
        out = io.StringIO()
        code = main(["--index", str(tmp_path / "index"), *arguments], spark, out)
        return code, out.getvalue()

    assert run("index", str(folder)) == (0, "6 indexed, 2 without content\n")
    code, shown = run("search", "kettle garden", str(folder), "-n", "1", "-l")
    assert (code, shown) == (0, "a.txt\n")
    assert json.loads(run("search", "kettle garden", "--json", "-k", "text")[1])[0]["kind"] == "text"
    assert run("search", "kettle", str(tmp_path / "elsewhere"))[0] == 1
    tone(tmp_path / "new.wav", 200)  # not in the index
    assert "low.wav" in run("similar", str(tmp_path / "new.wav"), str(folder), "--all")[1]
    assert "images" in run("status", str(folder))[1]
    assert run("forget", str(folder))[1].endswith("files forgotten\n")


def test_a_day_of_sightings(spark, small, tmp_path):
    from quarry.streaming import updates

    rows = spark.read.parquet(f"{small}/file_sightings.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = updates.sightings_per_day(updates.changed_files(spark, str(tmp_path / "in")), "400 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows.filter("arrived_at is not null").dropDuplicates(["scan_id", "path", "arrived_at"]).count()
    assert spark.table("days").selectExpr("sum(sightings)").first()[0] == want
