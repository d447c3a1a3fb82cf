"""Tables found from words, files of pages, failures of single files, and results written by commit."""

import json
import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from factloom.operators import grids, stages
from factloom.sources import documents, paged, results

WORD = "file_id string, page_number int, word int, text string, x0 double, y0 double, x1 double, y1 double, width double"
RULING = "file_id string, page_number int, x0 double, y0 double, x1 double, y1 double"


def laid(text, x, y, page=1, start=0):
    """Words of a line, five wide a character."""
    out, at = [], x
    for i, w in enumerate(text.split(" ")):
        out.append(("d", page, start + i, w, float(at), float(y), float(at + 5 * len(w)), float(y + 10), 600.0))
        at += 5 * len(w) + 5
    return out


def page_of(lines, page=1):
    words = []
    for text, x, y in lines:
        words += laid(text, x, y, page, len(words))
    return words


@pytest.fixture(scope="module")
def found(spark):
    ruled = page_of([("Heading of the page", 50, 20), ("Item", 60, 103), ("FY24", 210, 103), ("Net revenue", 60, 123), ("of shops", 60, 134), ("1,200", 210, 123), ("below the frame", 60, 200)])
    # lines of the frame touch; its second row is two lines high, and a box elsewhere is empty
    rulings = [("d", 1, 50.0, y, 300.0, y + 0.5) for y in (100.0, 118.0, 150.0)] + [("d", 1, x, 100.0, x + 0.5, 150.0) for x in (50.0, 200.0, 300.0)]
    rulings += [("d", 1, 400.0, 300.0, 500.0, 340.0), ("d", 1, 450.0, 300.0, 450.5, 340.0)]
    free = page_of(
        [("Some words of text that go on", 50, 20, ), ("and end here", 50, 32), ("Particulars", 50, 100), ("FY24", 300, 100), ("FY23", 400, 100), ("Sales of goods", 50, 114), ("1,200", 300, 114), ("1,000", 400, 114),
         ("Other", 50, 128), ("7", 405, 128), ("of which:", 50, 142), ("Rent", 50, 156), ("12", 305, 156), ("(3)", 405, 156)], 2,
    )
    prose = page_of([(t, x, 100 + 12 * i) for i, (l, r) in enumerate([("left column one", "right column one"), ("goes on here", "and here too"), ("to its end", "and ends")]) for t, x in ((l, 50), (r, 320))], 3)
    bad = [("d", 4, 0, "x", None, 1.0, 2.0, 3.0, 600.0), ("d", 4, 1, "y", 5.0, 1.0, 2.0, 3.0, 600.0), ("d", 4, 2, " ", 1.0, 1.0, 2.0, 3.0, 600.0), ("d", 4, 3, "z", float("nan"), 1.0, 2.0, 3.0, 600.0)]
    words = spark.createDataFrame(ruled + free + prose + bad, WORD)
    pages, blocks, warnings = grids.parse_words(words, spark.createDataFrame(rulings, RULING), ["file_id", "page_number"])
    return {r["page_number"]: r["text"] for r in pages.collect()}, blocks.collect(), {(r["page_number"], r["warning"]) for r in warnings.collect()}


def test_ruled_tables(found):
    texts, blocks, warnings = found
    assert texts[1] == "Heading of the page\n\n| Item | FY24 |\n| --- | --- |\n| Net revenue of shops | 1,200 |\n\nbelow the frame"
    assert [(b["n_rows"], b["n_cols"]) for b in blocks if b["page_number"] == 1 and b["kind"] == "table"] == [(2, 2)]
    assert (1, "a ruled frame of 2 columns holds no words") in warnings


def test_tables_without_rulings(found):
    texts, blocks, _ = found
    assert texts[2] == "Some words of text that go on\nand end here\n\n| Particulars | FY24 | FY23 |\n| --- | --- | --- |\n| Sales of goods | 1,200 | 1,000 |\n| Other |  | 7 |\n| of which: |  |  |\n| Rent | 12 | (3) |"
    assert all(texts[b["page_number"]][b["char_start"] : b["char_end"]] == b["text"] for b in blocks)


def test_columns_of_prose_are_no_table(found):
    texts, blocks, warnings = found
    assert not [b for b in blocks if b["page_number"] == 3 and b["kind"] == "table"]
    assert texts[3] == "left column one\ngoes on here\nto its end\n\nright column one\nand here too\nand ends"
    assert 4 not in texts and (4, "4 words without a usable box or text left out") in warnings


def test_words_without_rulings_and_empty_pages(spark):
    pages, blocks, warnings = grids.parse_words(spark.createDataFrame([], WORD), None, ["file_id", "page_number"])
    assert pages.count() == blocks.count() == warnings.count() == 0


def ruled_pages(n):
    words = [w for p in range(1, n + 1) for w in page_of([(f"Heading {p}", 50, 20), ("Item", 60, 103), ("FY24", 210, 103), ("Net revenue", 60, 123), (f"{p}00", 210, 123), ("Part", 50, 200), ("FY23", 300, 200), ("Rent", 50, 214), (f"{p}", 310, 214)], p)]
    rulings = [("d", p, *b) for p in range(1, n + 1) for b in [(50.0, y, 300.0, y + 0.5) for y in (100.0, 118.0, 150.0)] + [(x, 100.0, x + 0.5, 150.0) for x in (50.0, 200.0, 300.0)]]
    return words + [("d", 1, 99, "x", None, 1.0, 2.0, 3.0, 600.0)], rulings


def test_words_leave_only_blocks_and_warnings_on_disk(spark):
    words, rulings = ruled_pages(4)
    there = lambda: set(Path(stages.shared_dir(spark).removeprefix("file://")).glob("facts-*"))
    before = there()
    pages, blocks, warnings = grids.parse_words(spark.createDataFrame(words, WORD), spark.createDataFrame(rulings, RULING), ["file_id", "page_number"])
    assert len(there() - before) == 2 and pages.count() == 4 and blocks.where("kind = 'table'").count() == 8 and warnings.count() == 1


def test_pages_taken_in_turns_are_the_same(spark, monkeypatch):
    words, rulings = ruled_pages(6)
    frames = spark.createDataFrame(words, WORD), spark.createDataFrame(rulings, RULING)
    whole = [sorted(map(tuple, d.collect())) for d in grids.parse_words(*frames, ["file_id", "page_number"])]
    written, write = [], stages.Settled.__call__

    def counted(self, df, by=None):
        out = write(self, df, by)
        written.append(out.count() if "seg" in df.columns else 0)
        return out

    monkeypatch.setattr(stages.Settled, "__call__", counted)
    monkeypatch.setattr(grids, "WORDS", len(words) // 3)
    assert [sorted(map(tuple, d.collect())) for d in grids.parse_words(*frames, ["file_id", "page_number"])] == whole
    assert 0 < max(written) < sum(written) / 2
    # page keys whose hashes may differ where a join finds them equal are not parted
    other = frames[0].withColumn("page_number", F.col("page_number").cast("double"))
    assert grids.parse_words(other, frames[1], ["file_id", "page_number"])[0].count() == 6


def test_a_number_that_words_share_loses_none(spark):
    words, rulings = ruled_pages(1)
    same = [(*w[:2], 7, *w[3:]) for w in words]
    blocks = grids.parse_words(spark.createDataFrame(same, WORD), spark.createDataFrame(rulings, RULING), ["file_id", "page_number"])[1]
    assert sorted(w for b in blocks.collect() for w in b["text"].split() if w[0] not in "|-") == sorted(w[3] for w in words if w[4] is not None)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "a.txt").write_bytes("one\ftwo é\f\fﬁve".encode() + b"\f" + b"x" * (2 << 20) + b"\fsix")
    with zipfile.ZipFile(top / "b.zip", "w") as z:
        z.comment = json.dumps({"title": "Filing", "author": "", "year": 2024}).encode()
        z.writestr("p1.txt", "first")
        z.writestr("p2.json", json.dumps({"words": [["Item", 10, 10, 30, 20], ["x", None, 1, 2, 3]], "rulings": [[0, 0, 9, 0]], "width": 600, "images": 2}))
        z.writestr("p3.json", "{not json")
        z.writestr("notes.md", "no page")
    (top / "c.zip").write_bytes(b"PK\x03\x04 and then nothing of a zip file")
    (top / "d.txt").write_bytes(b"fine\f\xff\xfe broken")
    (top / "e.txt").write_bytes(b"")
    (top / "copy of a.txt").write_bytes((top / "a.txt").read_bytes())
    return str(top)


def test_pages_of_files(spark, folder):
    rows = {(r["filename"], r["page_number"]): r for r in paged.read_pages(spark, folder).collect()}
    assert sorted(k for k in rows if k[0] != "copy of a.txt") == [("a.txt", n) for n in range(1, 7)] + [("b.zip", 1), ("b.zip", 2), ("d.txt", 1), ("e.txt", 1)]
    assert [rows["a.txt", n]["text"] for n in (1, 2, 3, 4, 6)] == ["one", "two é", "", "ﬁve", "six"] and len(rows["a.txt", 5]["text"]) == 2 << 20
    assert rows["b.zip", 2]["words"][0][1] == "Item" and rows["b.zip", 2]["words"][1]["x0"] is None and rows["b.zip", 2]["image_count"] == 2 and rows["b.zip", 2]["rulings"] == [(0.0, 0.0, 9.0, 0.0)]
    assert rows["a.txt", 1]["file_id"] == rows["copy of a.txt", 1]["file_id"] and len(rows["a.txt", 1]["file_id"]) == 16
    words, rulings = paged.words_and_rulings(paged.read_pages(spark, folder, "b.zip"))
    assert words.count() == 2 and rulings.count() == 1


def test_a_filter_on_the_page_opens_no_other(spark, folder):
    some = paged.read_pages(spark, folder, "a.txt").where("page_number in (2, 6) and length(text) > 0")
    assert [(r["page_number"], r["opened"]) for r in some.orderBy("page_number").collect()] == [(2, 1), (6, 2)]
    assert [(r["page_number"], r["opened"]) for r in paged.read_pages(spark, folder, "b.zip").where("page_number > 1").collect()] == [(2, 1)]
    assert paged.read_pages(spark, folder, "a.txt").where("page_number = 99").count() == 0
    reader = paged.PagesReader({"path": folder, "glob": "a.txt"})
    other = EqualTo(("filename",), "a.txt")
    assert list(reader.pushFilters([GreaterThan(("page_number",), 1), LessThanOrEqual(("page_number",), 4), In(("page_number",), (2, 3, 4, 9)), other])) == [other]
    taken = [r[2] for p in reader.partitions() for r in reader.read(p)]
    assert taken == [2, 3, 4]


def test_subset_and_cap_of_pages(spark, folder):
    numbers = lambda **how: sorted(r["page_number"] for r in paged.read_pages(spark, folder, "a.txt", **how).collect())
    assert numbers(page_numbers=[6, 2, 2, 77, 0]) == [2, 6] and numbers(max_pages=2) == [1, 2] and numbers(page_numbers=[6, 4, 3], max_pages=2) == [3, 4]
    # a filter looks at what the cap leaves
    assert paged.read_pages(spark, folder, "a.txt", max_pages=2).where("page_number >= 2").count() == 1
    told = paged.read_documents(spark, folder, "a.txt", page_numbers=[6, 4, 3], max_pages=2).first()
    assert told["warnings"] == ["truncated to the first 2 of 3 pages"] and told["page_count"] == 6


def test_one_bad_file_is_one_warning(spark, folder):
    rows = {r["filename"]: r for r in paged.read_documents(spark, folder).collect()}
    assert rows["a.txt"]["warnings"] == [] and rows["a.txt"]["page_count"] == 6 and rows["b.zip"]["metadata"] == {"title": "Filing", "year": "2024"}
    assert rows["b.zip"]["warnings"] == ["page 3: cannot be read (JSONDecodeError)"]
    assert len(rows["c.zip"]["warnings"]) == 1 and rows["c.zip"]["warnings"][0].startswith("cannot be read (BadZipFile") and rows["c.zip"]["page_count"] == 0
    assert rows["d.txt"]["warnings"] == ["page 2: cannot be read (UnicodeDecodeError)"]
    assert rows["e.txt"]["warnings"] == ["most pages have no text: the document needs character recognition first"]
    assert all(r["parsed_at"] is not None and r["created_at"] is not None for r in rows.values())
    with pytest.raises(Exception, match="no such file"):
        paged.read_pages(spark, folder + "/nowhere").count()


def test_files_that_fail_while_read(spark, tmp_path):
    (tmp_path / "good.txt").write_text("good")
    (tmp_path / "bad.txt").write_text("bad bytes")
    (tmp_path / ".bad.txt.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")  # a checksum that does not hold
    (tmp_path / "large.txt").write_text("x" * 500)
    os.utime(tmp_path / "good.txt", (1_700_000_000, 1_700_000_000))
    good = documents.read_files(spark, str(tmp_path), "*.txt", most_bytes=100).collect()
    assert [(r["filename"], r["byte_size"], r["created_at"].timestamp()) for r in good] == [("good.txt", 4, 1_700_000_000.0)]
    warned = {r["filename"]: r["warning"] for r in documents.unreadable(spark, str(tmp_path), "*.txt", most_bytes=100).collect()}
    assert warned == {"bad.txt": "cannot be read", "large.txt": "has 500 bytes, more than 100"}
    before = good[0]["file_id"]
    os.utime(tmp_path / "good.txt", (1_800_000_000, 1_800_000_000))
    assert documents.read_files(spark, str(tmp_path), "good.txt").first()["file_id"] == before


def kinds(top):
    return sorted(p for p in os.listdir(top) if not p.startswith("."))


def test_results_appear_together_or_not_at_all(spark, tmp_path):
    top = str(tmp_path / "out")
    facts = spark.createDataFrame([("f1", 1.5), ("f2", None)], "id string, value double").repartition(2)
    edges = spark.createDataFrame([("e1", "f1", "f2")], "id string, a string, b string")
    results.publish(top, facts=facts, edges=edges)
    read = lambda kind, schema, **how: sorted(tuple(r) for r in results.published(spark, top, kind, schema, **how).collect())
    assert read("edges", edges.schema) == [("e1", "f1", "f2")] and len(read("facts", facts.schema)) == 2 and read("report", "line string") == []
    before = kinds(top), kinds(top + "/facts")
    # one task fails after others have written: nothing of the run is left
    broken = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).cast("double").alias("value"))
    with pytest.raises(Exception, match="lost"):
        results.publish(top, facts=facts.unionByName(broken), edges=edges)
    assert (kinds(top), kinds(top + "/facts")) == before and os.listdir(top + "/_staging") == [] and os.listdir(top + "/_versions") == ["00000001.json"]
    results.publish(top, replace=False, facts=facts.limit(1), report=spark.createDataFrame([("done",)], "line string"))
    assert len(read("facts", facts.schema)) == 3 and read("report", "line string") == [("done",)] and len(read("facts", facts.schema, version=1)) == 2
    results.publish(top, facts=facts.limit(1))
    assert len(read("facts", facts.schema)) == 1 and read("edges", edges.schema) == []


def test_attempts_that_are_not_committed_leave_no_file(tmp_path):
    writer = results.ResultsWriter(str(tmp_path), True)
    rows = [Row(kind="facts", body="{}")]
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([again, None])
    assert kinds(tmp_path / "facts") == [again.files[0][1]] and first.files[0][1] not in kinds(tmp_path / "facts") and kinds(tmp_path / "_staging") == []
