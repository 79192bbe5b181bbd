"""Recognition rounds over pages in any direction."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import block_font as B
from lectern.functions import quality as Y
from lectern.functions import scan_image as I
from lectern.functions import text as T
from lectern.session import shared_folder
from lectern.sources import scans

TEXT = "the cat and the dog were in the house when it was not so late and there they had some of the milk with us. " * 40


def image(*pages, turn=0):
    return I.write_pgm(I.rotated(np.hstack([B.drawn(p) for p in pages]), turn))


def read_all(spark, rows, reader=B.read_image, **more):
    d = spark.createDataFrame(rows, "path string, page_no int, image binary")
    return {(r["path"], r["page_no"]): r for r in scans.oriented(d, reader, **more).collect()}


def test_turned_and_double_pages(spark):
    a, b = TEXT[:1500].strip("\n"), TEXT[37:1537]
    rows = [("one", t, image(a, turn=t)) for t in (0, 90, 180, 270)] + [("two", t, image(a, b, turn=t)) for t in (0, 90, 180, 270)]
    got = read_all(spark, rows)
    assert all(got["one", t]["text"] == a.strip() and got["one", t]["passes"] == 1 for t in (0, 90, 180, 270))
    assert all(got["two", t]["text"] == f"{a.strip()}\n\n{b.strip()}" and got["two", t]["passes"] == 2 for t in (0, 90, 180, 270))


def test_words_nobody_knows_still_win_over_a_turned_reading(spark):
    """Readings of a quality of 0 either way."""
    a, b = ("nréê éen" * 200)[:1500], ("u oueuxou oueuxou" * 100)[:1500]
    got = read_all(spark, [("two", t, image(a, b, turn=t)) for t in (0, 90, 180, 270)])
    assert {r["text"] for r in got.values()} == {f"{a}\n\n{b}".strip()} and {r["passes"] for r in got.values()} == {2}


def test_quality_in_python_is_that_of_spark(spark):
    rng = random.Random(5)
    texts = ["", " \n", "the end.", "— it’s “so” ñandú åäö", *("".join(rng.choice("theaioun  \n\t.,'-’éàZ9\ufffd\x00") for _ in range(rng.randrange(60))) for _ in range(300))]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Y.ocr_quality(F.col("t")).alias("q"), T.cleaned(F.col("t")).alias("c"))
    assert all((Y.quality_of(r["t"]), T.cleaned_text(r["t"])) == (r["q"], r["c"]) for r in d.collect())
    assert Y.odd_share("") == Y.odd_share("né 漢\n") == 0 and Y.odd_share("a\ufffd\x00b") == 0.5


def test_images_stay_in_their_tasks(spark):
    """What lies in the shared folder afterwards is text: less than one of the four images."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert len(read_all(spark, [("p", n, image(TEXT[:1500], turn=90 * n)) for n in range(4)])) == 4
    assert 0 < size() - before < len(image(TEXT[:1500]))


def test_black_and_white_pages_travel_as_bitmaps(spark):
    """An eighth of the graymaps; readers take graymaps or gray values."""
    a, b = TEXT[:1500].strip("\n"), TEXT[37:1537]
    both = [list(B.images(a.ljust(1500) + b, turn)) for turn in range(4)]
    assert all(len(x) == 1 and len(x[0]) < 1 / 7 * len(I.write_pgm(I.read_pgm(x[0]))) for x in both)
    assert all((I.read_pgm(x) == I.read_pgm(image(a.ljust(1500), b, turn=90 * t))).all() for t, (x,) in enumerate(both))
    rows = [("two", t, x) for t, (x,) in enumerate(both)]
    for got in (read_all(spark, rows), read_all(spark, rows, B.read, arrays=True)):
        assert {(r["text"], r["passes"]) for r in got.values()} == {(f"{a.strip()}\n\n{b.strip()}", 2)}
    with pytest.raises(ValueError, match="cut"):
        I.read_pgm(both[0][0][:-1])


def test_a_page_is_worked_in_arrays():
    """Drawing, geometry and reading call no Python function for a character, a line or a lag: a few hundred calls a page, where it were thousands."""
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    text = TEXT[:1500]
    Y.odd_share(text), Y.quality_of(text)  # tables and words known before
    sys.setprofile(count)
    try:
        parts = [p for x in B.images(text, 1) for p in scans._parts(x, B.read, None, scans.ACCEPT)]
    finally:
        sys.setprofile(None)
    assert [(p[1], p[2]) for p in parts] == [(text.strip(), 270)] and calls < 400


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_profiles_of_views(turn):
    """Views that go backward in memory have the profiles of their copies, also beyond what a byte counts."""
    img = np.random.default_rng(3).choice(np.array([0, 255], dtype=np.uint8), (700, 310))
    img[40:, :5] = 0
    view = I.rotated(img, turn)[3:, 2:]
    rows, cols = I.profiles(view)
    assert (rows == (view < I.INK).mean(axis=1)).all() and (cols == (view < I.INK).mean(axis=0)).all() and (I.columns(view) == cols).all()
    page = I.rotated(I.rotated(np.ascontiguousarray(B.drawn("a\n漢😀 " * 200)), -turn).copy(), turn)
    assert B.read(page) == "a\n漢😀 " * 200


def test_blank_and_broken_pages(spark):
    got = read_all(spark, [("a", 1, image("")), ("a", 2, b"no image"), ("a", 3, None), ("b", 1, image(TEXT[:1500])), ("b", 1, image(TEXT[:1500]))])
    assert (got["a", 1]["text"], got["a", 1]["passes"], got["a", 1]["error"]) == ("", 0, None)
    assert got["a", 2]["error"].startswith("ValueError") and got["a", 3]["error"] and got["a", 3]["text"] == ""
    assert got["b", 1]["text"].startswith("the cat")
    assert not read_all(spark, [])


def by_direction(texts):
    """A reader whose text depends on where a page's one dark corner lies."""

    def read(data):
        from lectern.functions import scan_image as I

        img = I.read_pgm(data)
        corner = [img[:9, :9], img[:9, -9:], img[-9:, -9:], img[-9:, :9]]
        text = texts[int(np.argmin([c.mean() for c in corner])) * 90]
        if text is None:
            raise OSError("the program failed")
        return text

    return read


def marked():
    img = np.full((800, 600), 255, dtype=np.uint8)
    for y in range(100, 700, 24):  # lines whose lower part is heavier: upright
        img[y : y + 7, 60:360] = 0
        img[y + 7 : y + 14, 60:500] = 0
    img[:9, :9] = 0
    assert I.candidates(img) == [0, 180]
    return img


@pytest.mark.parametrize(
    "texts,want,passes",
    [
        ({0: "zzqx brrt", 180: "it was the one that they had"}, "it was the one that they had", 1),  # the better text wins
        ({0: "it was the", 180: "and so it is"}, "it was the", 1),  # the first that reads well enough
        ({0: "", 180: "zzqx"}, "zzqx", 1),
        ({0: None, 180: "zzqx"}, "zzqx", 1),  # a failure is a missing text
        ({0: "", 180: ""}, "", 0),
    ],
)
def test_arbitration(spark, texts, want, passes):
    got = read_all(spark, [("p", 1, I.write_pgm(marked()))], by_direction(texts))["p", 1]
    assert (got["text"], got["passes"]) == (want, passes) and got["error"] is None


def test_all_failed(spark):
    got = read_all(spark, [("p", 1, I.write_pgm(marked()))], by_direction({0: None, 180: None}))["p", 1]
    assert got["passes"] == 0 and got["error"] == "OSError: the program failed"


def test_direction_from_outside_is_trusted(spark):
    read = by_direction({0: "it was the one", 90: "", 180: "zzqx brrt", 270: ""})
    assert read_all(spark, [("p", 1, I.write_pgm(marked()))], read, osd=lambda data: 180)["p", 1]["text"] == "zzqx brrt"


def test_each_rotation_is_read_once(spark, tmp_path):
    log = tmp_path / "log"

    def read(data):
        with log.open("a") as f:
            f.write("x")
        return "zzqx"

    got = read_all(spark, [("p", n, I.write_pgm(marked())) for n in range(3)], read)
    assert len(got) == 3 and len(log.read_text()) == 6


def test_recognised_scans(spark):
    pages = spark.createDataFrame([("a", 1, ""), ("a", 2, "kept"), ("b", 1, "kept too")], "path string, page_no int, text string")
    images = spark.createDataFrame([("a", 1, image(TEXT[:1500], turn=180)), ("a", 2, image(""))], "path string, page_no int, image binary")
    got = {(r["path"], r["page_no"]): (r["text"][:7], r["ocr"]) for r in scans.recognised_scans(pages, images, B.read_image).collect()}
    assert got == {("a", 1): ("the cat", True), ("a", 2): ("kept", False), ("b", 1): ("kept to", False)}
