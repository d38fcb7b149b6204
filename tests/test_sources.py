"""SubRip reading, provider records and catalog answers."""

import hashlib
import itertools
import json

import pytest

from tideline.sources import catalog, records, srt

TWO = "1\n00:00:01,000 --> 00:00:02,500\nfirst line\nsecond line\n\n2\n00:00:03,000 --> 00:00:04,000\nthird\n"


def fault(text, read=srt.parse):
    with pytest.raises(srt.SrtError) as e:
        read(text)
    return e.value.line, e.value.kind


def test_layouts_parse_alike():
    want = [(1000, 2500, "first line\nsecond line"), (3000, 4000, "third")]
    for newline, arrow, dot, place in itertools.product(("\n", "\r\n", "\r"), (" --> ", "-->", "  -->\t"), (",", "."), ("", " X1:1 X2:2 Y1:3 Y2:4")):
        text = "".join(f"{n}\n{a}{arrow}{b}{place}\n{t}\n\n" for n, (a, b, t) in enumerate((("00:00:01,000", "00:00:02,500", "first line\nsecond line"), ("00:00:03,000", "00:00:04,000", "third")), 1))
        text = text.replace(",0", f"{dot}0").replace(",5", f"{dot}5").replace("\n", newline)
        assert [(c.start_ms, c.end_ms, c.text) for c in srt.parse(text)] == want
        for raw in (text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), b"\xef\xbb\xbf" + text.encode()):
            assert len(srt.parse_bytes(raw)) == 2


def test_faults_have_lines():
    assert fault("") == fault("\n \n") == (1, "Empty")
    assert fault("2\n00:00:01,000 --> 00:00:02,000\nx") == (1, "InvalidIndex")
    assert fault("1\n00:00:61,000 --> 00:00:02,000\nx") == fault("1\n\nx") == fault("1") == (2, "InvalidTimestamp")
    assert fault("1\n00:00:02,000 --> 00:00:02,000\nx") == (2, "InvalidTiming")
    assert fault(TWO.replace("00:00:03", "00:00:00").replace("00:00:04", "00:00:09")) == (7, "InvalidTiming")
    assert fault("1\n00:00:01,000 --> 00:00:02,000\n\n") == (3, "MissingText")
    assert fault(TWO.replace("\n\n", "\n")) == (6, "MissingSeparator")
    assert fault(TWO.replace("third", "th\x0bird")) == (8, "InvalidText")
    assert fault(TWO.replace("third", "x" * 4097)) == (8, "LimitExceeded")
    assert fault(b"\xff\xfea", srt.parse_bytes) == fault(b"\xff", srt.parse_bytes) == (1, "InvalidText")


def test_checked_cues_agree_with_windows(spark):
    good = [srt.Cue(0, 10, "a"), srt.Cue(0, 5, "b\n\tc")]
    bad = {"time": [*good, srt.Cue(9, 9, "x")], "back": [srt.Cue(5, 9, "x"), srt.Cue(4, 9, "y")], "text": [*good, srt.Cue(9, 12, "  ")], "ctl": [srt.Cue(0, 1, "a\x07")], "big": [srt.Cue(0, 1, "é" * 2049)], "good": good}
    rows = [(d, n, c.start_ms, c.end_ms, c.text) for d, cues in bad.items() for n, c in enumerate(cues)]
    got = {r.doc: (r.cue, r.error) for r in srt.check_cues(spark.createDataFrame(rows, "doc string, cue int, start_ms long, end_ms long, text string")).collect()}
    for doc, cues in bad.items():
        try:
            srt.checked(cues)
            want = (None, None)
        except srt.SrtError as e:
            want = (e.line, e.kind)
        assert got[doc] == want, doc


def test_render_reads_back(spark):
    files = spark.createDataFrame([("a", bytearray(TWO.encode())), ("bad", bytearray(b"1\nx")), ("none", None)], "path string, content binary")
    rows = srt.read_srt(files)
    assert {(r.doc, r.error, r.line) for r in rows.filter("error is not null").collect()} == {("bad", "InvalidTimestamp", 2), ("none", "Empty", 1)}
    assert srt.render(rows.filter("error is null")).first().srt == srt.write(srt.parse(TWO)) == TWO


def test_lenient_framing_of_every_defect():
    """Six defects in all combinations leave the same three captions, less what is omitted."""
    for separator, index, zero, fraction, c1, clock in itertools.product((0, 1), repeat=6):
        first = ["1", "0:0:1.0 --> 00:00:02,000" if clock else "00:00:01,000 --> 00:00:02,000", "it\u0092s one" if c1 else "it's one"]
        second = [] if index else ["2"]
        second += ["00:00:03,000 --> 00:00:03,000" if zero else "00:00:03,000 --> 00:00:04,000", "two"]
        third = ["3.5" if fraction else "3", "00:00:05,000 --> 00:00:06,000", "three"]
        text = "\n".join(first + ([] if separator else [""]) + second + [""] + third) + "\n"
        made = records.prepare(text)
        assert [c.text for c in made.cues] == ["it�s one" if c1 else "it's one", *([] if zero else ["two"]), "three"]
        assert {"lost-characters": c1, "zero-duration": zero, "boundaries": separator, "framing": clock}.items() <= {k: int(k in made.ledger) for k in ("lost-characters", "zero-duration", "boundaries", "framing")}.items()
        assert srt.parse(made.text) == made.cues


def test_lenient_paragraphs_order_and_faults():
    rec = lambda n, a, b, text: f"{n}\n00:00:{a:02},000 --> 00:00:{b:02},000\n{text}\n\n"
    made = records.prepare(rec(1, 9, 10, "late\n\nparagraph") + rec(2, 3, 4, "early") + rec(3, 20, 21, "").rstrip("\n") + "\n\n")
    assert [c.text for c in made.cues] == ["early", "late\nparagraph"]
    assert made.ledger["paragraphs"]["removed"] == 1 and made.ledger["ordering"]["affected"] == 2 and made.ledger["missing-text"]["affected"] == 1
    assert [r.missing_text for r in records.frame(rec(1, 1, 2, ""))] == [True]
    assert fault("x\n00:00:01,000 --> 00:00:02,000\ny", records.frame) == (1, "InvalidIndex")
    assert fault(rec(1, 1, 2, "a") + rec(1, 3, 4, "b"), records.frame) == (5, "InvalidIndex")
    assert fault("1\n00:00:99,000 --> 00:00:02,000\nx", records.frame) == (2, "InvalidTimestamp")
    assert fault("1\n00:00:03,000 --> 00:00:02,000\nx", records.frame) == (2, "InvalidTiming")
    assert fault(rec(1, 1, 2, "a") + "orphan\n", records.frame)[1] == "InvalidIndex"


def test_import_keeps_faults_as_rows(spark):
    files = spark.createDataFrame([("a", bytearray(TWO.encode())), ("b", bytearray(b"zzz"))], "path string, content binary")
    got = {r.doc: r for r in records.import_records(files).collect()}
    assert (got["a"].srt, got["a"].cues, json.loads(got["a"].ledger)) == (TWO, 2, {}) and got["b"].error == "InvalidIndex"


def test_catalog_pages(spark, tmp_path):
    def page(k, ids, total=3):
        data = [{"id": str(i), "attributes": {"title": f"Show {i}", "feature_type": "Tvshow", "feature_id": str(i), "imdb_id": i, "year": "2001"}} for i in ids]
        (tmp_path / f"p{k}.json").write_text(json.dumps({"page": k, "total_pages": 2, "total_count": total, "data": data}))

    page(1, [1, 2])
    page(2, [3])
    assert catalog.shows(spark, str(tmp_path)).count() == 3
    page(2, [2])
    with pytest.raises(ValueError, match="twice"):
        catalog.shows(spark, str(tmp_path))
    page(2, [3], total=9)
    with pytest.raises(ValueError, match="totals"):
        catalog.shows(spark, str(tmp_path))
    (tmp_path / "s").mkdir()
    seasons = [{"season_number": 1, "episodes": [{"episode_number": e, "feature_id": e, "title": f"E{e}"} for e in (1, 2, 3)]}, {"season_number": 2, "episodes": []}]
    (tmp_path / "s/x.json").write_text(json.dumps({"data": [{"id": "7", "attributes": {"title": "S", "seasons": seasons}}]}))
    assert [r.episode for r in catalog.episodes(spark, str(tmp_path / "s"), 1, 2, 3).orderBy("episode").collect()] == [2, 3]


def listing(folder, pages, **totals):
    folder.mkdir()
    for k, ids in enumerate(pages, 1):
        data = [{"id": str(i), "attributes": {"title": f"Show {i}", "feature_type": "Tvshow", "feature_id": str(i), "subtitle_id": str(i)}} for i in ids]
        (folder / f"{k}.json").write_text(json.dumps({"page": k, **totals, "data": data}))
    return str(folder)


def test_cut_listings_say_so(spark, tmp_path):
    cases = {
        "whole": ([[1, 2], [3]], {"total_pages": 2, "total_count": 3}, 3, False),
        "more counted": ([[1, 2], [3]], {"total_pages": 2, "total_count": 4}, 3, True),
        "more pages": ([[k] for k in range(10)], {"total_pages": 11, "total_count": 11}, 10, True),
        "more rows": ([range(600), range(600, 1200)], {"total_pages": 2, "total_count": 1200}, 1000, True),
        "no totals": ([[1]], {}, 1, True),
        "none": ([[]], {"total_pages": 0, "total_count": 0}, 0, False),
    }
    for name, (pages, totals, n, cut) in cases.items():
        path = listing(tmp_path / name, pages, **totals)
        rows = catalog.shows(spark, path).collect()
        assert len(rows) == n and {r.truncated for r in rows} <= {cut}, name
        if cut:
            with pytest.raises(catalog.CatalogError, match="cut"):
                catalog.subtitles(spark, path)
        else:
            assert catalog.subtitles(spark, path).count() == n
    for name, pages, totals in (("too few", [[1]], {"total_pages": 2, "total_count": 2}), ("too many", [[1, 2]], {"total_pages": 1, "total_count": 1}), ("gap", [[1], [], [2]], {"total_pages": 3, "total_count": 2})):
        with pytest.raises(catalog.CatalogError, match="totals"):
            catalog.shows(spark, listing(tmp_path / name, pages, **totals))


def test_series_display(spark, tmp_path):
    good = {"feature_type": "TV Show", "feature_id": "77", "original_title": "Nordlicht", "imdb_id": 5, "year": "1998"}

    def read(rows, imdb_id=None, **more):
        (tmp_path / "d.json").write_text(json.dumps({**more, "data": [{"id": "77", "attributes": a} for a in rows]}))
        return catalog.series_display(spark, str(tmp_path / "d.json"), 77, imdb_id)

    assert tuple(read([good], 5).first()) == (77, "Nordlicht", 1998, 5)
    assert catalog.display_prefix(read([good], total_pages=1)).first().prefix == "Nordlicht (1998)"
    bare = read([good | {"original_title": "", "imdb_id": None}])
    assert bare.first().original_title is None and catalog.display_prefix(bare).first().prefix is None
    assert catalog.display_prefix(bare, "Aurora").first().prefix == "Aurora (1998)"
    bad = ({"feature_id": "78"}, {"feature_type": "movie"}, {"year": "98"}, {"year": None}, {"original_title": " x"}, {"original_title": "x" * 201}, {"imdb_id": 0})
    for rows, more in (*(([good | change], {}) for change in bad), ([], {}), ([good, good], {}), ([good], {"total_pages": 2}), ([good], {"imdb_id": 6})):
        with pytest.raises(catalog.CatalogError):
            read(rows, **more)


def test_cached_entries_are_parsed_again(spark):
    late = "1\n00:00:09,000 --> 00:00:10,000\nlate\n\n2\n00:00:03,000 --> 00:00:04,000\nearly\n"
    raw = {"plain": TWO.encode(), "moved": late.encode()}
    files = spark.createDataFrame([(d, bytearray(c)) for d, c in raw.items()], "path string, content binary")
    ledger = {r.doc: r.ledger for r in records.import_records(files).collect()}
    assert "ordering" in ledger["moved"]

    def entry(doc, source, **change):
        c = raw[source]
        row = {"doc": doc, "content": bytearray(c), "size": len(c), "sha256": hashlib.sha256(c).hexdigest(), "ledger": ledger[source], "fetched_s": 7, "n": 1} | change
        return tuple(row.values())

    junk = b"zzz"
    rows = [
        entry("a", "plain"), entry("b", "moved"), entry("size", "plain", size=3), entry("digest", "plain", sha256="00"), entry("no digest", "plain", sha256=None),
        entry("ledger", "moved", ledger=ledger["plain"]), entry("never", "plain", fetched_s=0), entry("null", "plain", ledger=None), entry(None, "plain"), entry("gone", "plain", content=None),
        entry("junk", "plain", content=bytearray(junk), size=3, sha256=hashlib.sha256(junk).hexdigest()), entry("two", "plain"), entry("two", "moved"),
    ]
    schema = "doc string, content binary, size long, sha256 string, ledger string, fetched_s long, n int"
    got = records.reload_records(spark.createDataFrame(rows, schema)).collect()
    want = {"a": None, "b": None, "size": "ContentMismatch", "digest": "ContentMismatch", "no digest": "ContentMismatch", "ledger": "LedgerMismatch", "never": "InvalidProvenance", "null": "InvalidProvenance", None: "InvalidProvenance", "gone": "ContentMismatch", "junk": "InvalidIndex", "two": "DuplicateEntry"}
    assert {r.doc: r.error for r in got} == want and len(got) == len(rows)
    assert all((r.srt is None) == (r.error is not None) == (r.cues is None) for r in got)
    assert {r.doc: r.srt.index("early") < r.srt.index("late") for r in got if r.doc == "b"} == {"b": True}
    assert records.reload_records(spark.createDataFrame([], schema)).count() == 0
