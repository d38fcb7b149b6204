"""The whole way from files to a plan, still images and crops."""

import struct

import numpy as np
import pytest

from tideline import cli, paths
from tideline.sources import crops, heif, matroska, mp4, srt
from tideline.sources.matroska import Frame, MediaError

from .test_containers import TRACK
from .test_matching import A, B


def video(texts):
    return matroska.mux([TRACK], [Frame(3, (400 + 12_000 * k) * 1_000_000, True, 10**9, t.encode()) for k, t in enumerate(texts)])


def reference(texts, start):
    return srt.write([srt.Cue(start + 12_000 * k, start + 12_000 * k + 2000, t) for k, t in enumerate(texts)])


def test_folder_to_names(spark, tmp_path, capsys, monkeypatch):
    refs, videos = tmp_path / "refs", tmp_path / "videos"
    refs.mkdir()
    videos.mkdir()
    (refs / "S01E01 First.srt").write_text(reference(A, 60_000))
    (refs / "S01E02 Second| part.srt").write_text(reference(B, 0))
    (refs / "S02E01 Other.srt").write_text("broken")
    (videos / "a.mkv").write_bytes(video(A[:3]))
    (videos / "b+c d.mkv").write_bytes(video(B))
    (videos / "x.mkv").write_bytes(video(["no such words are anywhere in these"] * 3))
    run = ["--folder", str(videos), "--references", str(refs), "--show", "A Show", "--season", "1", "--episodes", "1-3"]
    assert cli.main([*run, "--dry-run"]) == 2
    out = capsys.readouterr().out
    assert "a.mkv: -> A Show - S01E01 - First.mkv" in out and "b+c d.mkv: -> A Show - S01E02 - Second_ part.mkv" in out and "x.mkv: unidentified" in out and "missing episodes: 3" in out
    monkeypatch.setattr("builtins.input", lambda _: "y")
    assert cli.main(run) == 2
    assert sorted(p.name for p in videos.iterdir()) == ["A Show - S01E01 - First.mkv", "A Show - S01E02 - Second_ part.mkv", "x.mkv"]
    (videos / "again.mkv").write_bytes(video(A[:3]))
    (videos / "bad.mkv").write_bytes(b"\x1aE\xdf\xa3nothing")
    assert cli.main([*run, "--dry-run"]) == 1
    out = capsys.readouterr().out
    assert "again.mkv: conflict" in out and "bad.mkv: scan failed" in out
    assert cli.main([*run[:-1], "1-1", "--dry-run", "--season", "2"]) == 1


@pytest.mark.parametrize("bad", [["--season", "0"], ["--season", "1x"], ["--episodes", "3-1"], ["--episodes", "0"], ["--show", "ab"], ["--show", " abc"], ["--nope"]])
def test_arguments_are_strict(bad):
    base = {"--references": "r", "--show": "Show", "--season": "1"}
    argv = [x for k, v in base.items() if k not in bad for x in (k, v)] + bad
    with pytest.raises(SystemExit):
        cli.arguments(argv)


def test_paths():
    assert str(paths.resolve("~/x/./y", home="/h")) == "/h/x/y" and str(paths.resolve("a", cwd="/c")) == "/c/a" and str(paths.resolve("/z")) == "/z"
    with pytest.raises(ValueError):
        paths.resolve("a/../b")


def test_still_image_items():
    full = lambda kind, *body, version=0: mp4.box(kind, bytes([version, 0, 0, 0]), *body)
    u2, u4 = (lambda *n: struct.pack(f">{len(n)}H", *n)), (lambda *n: struct.pack(f">{len(n)}I", *n))
    infe = lambda n, kind: full(b"infe", u2(n, 0), kind, b"name\0", version=2)

    def file(at):
        iloc = full(b"iloc", bytes([0x44, 0]), u2(2), u2(1, 0, 0, 1), u4(at, 5), u2(2, 1, 0, 1), u4(0, 8), version=1)
        ipco = mp4.box(b"ipco", full(b"ispe", u4(64, 48)), mp4.box(b"irot", b"\1"), mp4.box(b"hvcC", b"xyz"))
        ipma = full(b"ipma", u4(1), u2(1), bytes([4, 0x83, 0, 1, 9]))
        meta = full(b"meta", full(b"pitm", u2(2)), full(b"iinf", u2(2), infe(1, b"hvc1"), infe(2, b"grid")), iloc, full(b"iref", mp4.box(b"dimg", u2(2, 1, 1))), mp4.box(b"iprp", ipco, ipma), mp4.box(b"idat", bytes([0, 0, 0, 0]) + u2(64, 48)))
        return mp4.box(b"ftyp", b"heic") + meta + mp4.box(b"mdat", b"hello")

    data = file(len(file(0)) - 5)
    image = heif.Heif(data)
    assert (image.primary, image.items, image.references) == (2, {1: ("hvc1", "name"), 2: ("grid", "name")}, [(2, "dimg", [1])])
    assert image.properties_of(1) == [("hvcC", b"xyz"), ("ispe", (64, 48))] and image.associations[1][0] == (3, True)
    assert image.read(1) == b"hello" and mp4.grid(image.read(2)) == (1, 1, 64, 48)
    with pytest.raises(MediaError):
        heif.Heif(file(3)).read(1)


def test_crops_and_lines():
    rgba = np.zeros((600, 80, 4), np.uint8)
    rgba[10:20, 5:50], rgba[580:590, 20:70] = 255, 255
    image = crops.crop(rgba)
    assert image.shape == (20 + 13 + 32, 80 + 32) and (image == 0).sum() == 10 * 45 + 10 * 50
    assert crops.lines(image) == [(12, 17, 30, 70), (35, 32, 53, 90)]
    assert crops.grey(np.array([[255, 255, 255, 0], [0, 0, 0, 255], [255, 255, 255, 255]])).tolist() == [255, 255, 0]
    with pytest.raises(MediaError):
        crops.lines(np.full((40, 40), 255, np.uint8))
