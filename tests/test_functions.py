import random
from functools import reduce
from operator import or_

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import kinds as K
from lectern.functions import quality as Y
from lectern.functions import scan_image as I
from lectern.functions import text as T
from lectern.operators import search as S

PROSE = (
    "The method that we have used in this work is well known, and it has been in use for many years. We show here that it can be made to "
    "work with less data than was thought, and that the time it takes is not much more than that of the other methods. "
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        (PROSE, True), ("thequickbrownfoxjumpsoverthelazydogs" * 5, False), ("\x01\x02\x03\x04" * 30, False), ("12345 67890 " * 8, False), ("short", False),
        ("Tämä on suomenkielinen teksti, jossa on monta sanaa ja lausetta, jotta se olisi riittävän pitkä", True),
    ],
)
def test_sane(spark, text, want):
    assert one(spark, F.coalesce(Y.sane(F.lit(text)), F.lit(False))) is want


def test_ocr_quality(spark):
    flipped = "poseuyeb sqouw zxcvb ʇxǝʇ uoıʇɔǝs ɟo ǝɥʇ ƃuıʞɹoʍ qwrtp lkjhg"
    assert one(spark, Y.ocr_quality(F.lit(PROSE))) >= 0.55
    assert one(spark, Y.ocr_quality(F.lit(flipped))) <= 0.35
    assert one(spark, Y.ocr_quality(F.lit(""))) == 0


@pytest.mark.parametrize(
    "text, ocr, pages, kind",
    [
        ("Abstract\nx\nReferences\n[1] [2] [3] [4]", 0, 8, "paper"), ("Chapter One\nChapter Two\nPreface\nForeword\nISBN 9781234567890", 0, 300, "book"),
        ("figure 1", 10, 10, "gallery"), ("lecture, lecture, homework, syllabus", 0, 6, "course"), ("plain words", 0, 2, ""),
    ],
)
def test_kinds(spark, text, ocr, pages, kind):
    assert one(spark, K.best_kind(K.scores(F.lit(text), F.lit(ocr), F.lit(pages)))) == kind


def test_sections(spark):
    a = "Title\nAbstract\n" + PROSE + "\nIntroduction\nmore"
    assert one(spark, K.abstract(F.lit(a))) == PROSE.strip()
    assert one(spark, K.abstract(F.lit("none"))) == ""
    front = "Foreword\n" + "f " * 300 + "\nPreface\n" + "p " * 300 + "\nChapter 1\nx"
    assert set(one(spark, K.front_matter(F.lit(front)))) == {"p", " "}
    assert one(spark, K.contents(F.lit("Contents\nFirst part .... 3\nSecond 14\nPreface\nx"))) == "First part\nSecond"


def test_cuts_are_parameters(spark):
    late = F.lit("x " * 40_000 + "\nReferences\n" + "x " * 20_000)
    got = [one(spark, K.scores(late, F.lit(0), F.lit(0), c))["paper"] for c in (K.Cuts(), K.Cuts(long=None))]
    assert got == [0.0, 2.0]
    text = F.lit("Abstract\n" + "word " * 100)
    assert len(one(spark, K.abstract(text))) > 400 and len(one(spark, K.abstract(text, most=200))) <= 200 and one(spark, K.abstract(text, least=900)) == ""


def test_tokens(spark):
    assert one(spark, K.tokens(F.lit("The, Metatheory! of Session-Types (2026)"))) == ["metatheory", "session", "types", "2026"]


def test_text(spark):
    assert one(spark, T.html_to_text(F.lit("<style>a{}</style><h1>Hello</h1><script>x()</script><p>World &amp; friends</p>"))) == "Hello\nWorld & friends"
    assert one(spark, T.page_list(F.lit("7-9, 3,8,x"))) == [3, 7, 8, 9]
    assert [one(spark, T.clamped_interval(F.lit(v))) for v in (0, 1, 60, 99_999_999)] == [5, 2, 60, 86400]
    assert one(spark, T.slugified(F.lit("  A  b!"))) == "a-b"
    assert one(spark, T.slugified(F.lit("!!"))) == "collection"
    assert one(spark, T.wrapped(F.lit("aa bb cccccccc d"), 5)) == "aa bb\ncccccccc\nd"
    assert one(spark, T.within_budget(F.lit("a" * 1500 + "\n\n" + "b" * 1500), 600)) == "a" * 1500
    assert one(spark, T.page_label(F.lit(3))) == "p.3" and one(spark, T.page_label(F.lit(0))) == "chunk"


@pytest.mark.parametrize("model, query", [("embeddinggemma-300m", "task"), ("nomic-embed-text", "search_query"), ("bge-m3", "")])
def test_prefixes(spark, model, query):
    assert one(spark, S.embed_prefixes(F.lit(model)))["query"].startswith(query)


def test_query_language():
    assert S.parse("a b") == S.Op("and", S.Term(("a",)), S.Term(("b",)))
    assert S.parse("a OR b NOT c") == S.Op("or", S.Term(("a",)), S.Op("not", S.Term(("b",)), S.Term(("c",))))
    assert S.parse('"of the" pre*') == S.Op("and", S.Term(("of", "the")), S.Term(("pre",), True))
    assert S.parse("a AND (") == S.Term(("a", "and"))


def page(lines=30, width=200):
    img = np.full((300, width), 255, dtype=np.uint8)
    for k in range(lines):
        img[10 + 9 * k : 14 + 9 * k, 12 : width - 12] = 0
    return img


def test_page_geometry(spark):
    img = page()
    assert (I.read_pgm(I.write_pgm(img)) == img).all()
    assert I.axis(img) == "rows" and I.axis(I.rotated(img, 90)) == "columns"
    assert I.spine(img) is None and len(I.split(img)) == 1
    assert I.arbitrated({0: 0.3, 180: 0.2}) is None and I.arbitrated({0: 0.5, 180: 0.5}) == 0
    rows = spark.createDataFrame([(I.write_pgm(img),), (b"x",), (None,)], "b binary").select(I.analysed()("b").alias("a")).select("a.*").collect()
    assert rows[0]["axis"] == "rows" and rows[1]["error"] and rows[2]["error"]


def blocks(w, h, *areas, ink=0):
    img = np.full((h, w), 255, dtype=np.uint8)
    for x0, x1, y0, y1 in areas:
        for y in range(y0, y1, 12):
            img[y : y + 7, x0:x1] = ink
    return img


def test_spine():
    both = blocks(1190, 800, (70, 560, 100, 700), (640, 1120, 100, 700))
    assert 520 <= I.spine(both) <= 680
    assert I.spine(np.kron(both, np.ones((3, 3), dtype=np.uint8))) == pytest.approx(3 * I.spine(both), abs=12)  # above a million pixels
    assert I.spine(blocks(1190, 800, (70, 560, 100, 700), (640, 1120, 100, 700), ink=100)) and not I.spine(blocks(1190, 800, (70, 560, 100, 700), (640, 1120, 100, 700), ink=120))
    assert I.spine(blocks(1000, 800, (80, 900, 100, 700))) is None and I.spine(blocks(1000, 800)) is None
    solid = blocks(1000, 800)
    solid[100:700, 100:900] = 0
    assert I.spine(solid) is None
    assert I.spine(blocks(1190, 800, (70, 560, 100, 700))) is None  # one side is empty
    specks = both.copy()
    specks[::40, 560:640] = 0  # ink in every fortieth row of the gap
    assert I.spine(specks) is None


def test_halves():
    both = blocks(1190, 800, (70, 560, 100, 200), (640, 1120, 100, 200))
    left, right = I.halves(both, 590)
    assert left.shape[1] + right.shape[1] <= 1190 and min(left.shape[1], right.shape[1]) >= 1190 // 2 - 100
    assert not (left[:, 560:] < 110).any() and (right < 110).any()


def test_candidates():
    assert I.candidates(np.full((300, 200), 255, dtype=np.uint8)) == [0]
    page = blocks(600, 800, (60, 500, 100, 700))
    assert set(I.candidates(page)) == {0, 180} and set(I.candidates(I.rotated(page, 90))) == {90, 270}


@pytest.mark.parametrize("text", ["", "x", "plain text of a page, ÿ 漢 😀\n" * 60])
def test_block_font(text):
    from lectern.functions import block_font as B

    assert B.read(B.drawn(text[: B.PAGE_CHARS])) == text[: B.PAGE_CHARS]


def test_rhythm_and_mass():
    page = np.full((400, 300), 255, dtype=np.uint8)
    for top in range(60, 340, 20):  # lines whose lower part is heavier
        page[top : top + 4, 40:150] = 0
        page[top + 4 : top + 10, 40:260] = 0
    rows, _ = I.profiles(page)
    assert I.rhythm(rows) > 0.9 and I.rhythm(np.zeros(100)) == 0 and I.rhythm(np.ones(10)) == 0
    assert I.rhythm(rows) == pytest.approx(I.rhythm(rows[55:345]))  # white margins do not count
    assert I.asymmetry(page) > 0 > I.asymmetry(I.rotated(page, 180)) and I.asymmetry(np.full((50, 50), 255, dtype=np.uint8)) == 0
    assert I.candidates(page) == [0, 180] and I.candidates(I.rotated(page, 180)) == [180, 0]


def test_what_patterns_need_is_in_all_their_matches(spark):
    """Every pattern with a substring looked for first finds what it found, in any case and with odd letters."""
    bits = ["arXiv:", "DOI:", "https://doi.org/1", "Due:", "due ", "ISBN 9781234567890", "isbn: 978", "FIGURE 3", "[12]", "[x]", "A thing .... 3\n", "Ab·· 4\n", "Lecture", "Final Exam",
            "problem set", "HandBook", "companions", "All Rights Reserved", "Printed in x", "copyright ", "Copyright ©", "© 2010", "library of congress", "published by", "K\u212a", "\u0130", "\n", " "]
    rng = random.Random(7)
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(6))),) for _ in range(400)]
    d = spark.createDataFrame(rows, "t string").withColumn("low", F.lower("t"))
    assert set(K.NEEDS) >= {K.PUBLISHER, K.COURSE, K.HANDBOOK}  # the slow ones
    for p, needs in K.NEEDS.items():
        got = d.select(F.col("t").rlike(p).alias("hit"), reduce(or_, (F.col("low").contains(x) for x in needs)).alias("may")).where("hit").collect()
        assert got and all(r["may"] for r in got), p
