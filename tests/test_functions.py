import pytest
from pyspark.sql import functions as F

from cairn import functions as fn


@pytest.fixture
def apply(spark):
    def run(function, *values):
        cols = [F.lit(v) for v in values]
        return spark.range(1).select(function(*cols).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(
    ("path", "base", "dir", "stem", "folders"),
    [
        ("a/b/c.tar.gz", "c.tar.gz", "a/b", "c.tar", ["a", "b"]),
        (".profile", ".profile", "", ".profile", []),
        ("./x//y", "y", "./x/", "y", ["x"]),
        ("x/", "", "x", "", ["x"]),
    ],
)
def test_path_parts(apply, path, base, dir, stem, folders):
    assert apply(fn.basename, path) == base
    assert apply(fn.dirname, path) == dir
    assert apply(fn.strip_ext, path) == stem
    assert apply(fn.folders, path) == folders


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("Word List copy.pdf", "word list"),
        ("word-list (2).txt", "word list"),
        ("Duplicate of word_list.csv", "of word list"),
        ("foo_copy.txt", "foo copy"),  # the underscore belongs to the word
        ("foo-copy.txt", "foo"),
        ("écopy.txt", ""),  # an accented letter does not, so copy stands alone
        ("дом.txt", ""),
    ],
)
def test_names_are_normalised(apply, name, key):
    assert apply(fn.normalize_name, name) == key


def test_slugs_and_ids(apply):
    assert apply(fn.slugify, "  Été -- 2 Birds! ") == "t-2-birds"
    assert apply(fn.arcp_id, " ARCP://name,My Crate ") == "arcp://name,my-crate"
    assert apply(fn.arcp_id, "***") == "arcp://name,crate"
    assert apply(lambda v: fn.mint_id("Place", v), "Mt Isa") == "#place-mt-isa"


@pytest.mark.parametrize(
    ("term", "prefix"),
    [("dc:format", "dc"), ("https://x.org/a", ""), (":a", ""), ("name", ""), ("9x:a", ""), ("a b:c", "")],
)
def test_curie_prefix(apply, term, prefix):
    assert apply(fn.curie_prefix, term) == prefix


@pytest.mark.parametrize(
    ("path", "normal"),
    [
        ("./img/a.jpg", "img/a.jpg"),
        ("../../img/a.jpg", "img/a.jpg"),
        ("a/../../b/./c//d", "b/c/d"),
        ("img%2Fa%20b.jpg", "img/a b.jpg"),
        ("a+b.jpg", "a+b.jpg"),  # a plus is no blank in a path
        ("100%.jpg", "100%.jpg"),  # malformed escapes leave the text alone
        ("bad%FF.jpg", "bad%FF.jpg"),
        ("\\dir\\x.txt", "dir/x.txt"),
        ("  x ﻿", "x"),
    ],
)
def test_relative_paths(apply, path, normal):
    assert apply(fn.normalize_relative_path, path) == normal


def test_urls(apply):
    for url in ("https://x.org", "data:image/png", "//cdn", "#a", "X-y+z.1:q"):
        assert apply(fn.is_absolute_url, url)
    assert not apply(fn.is_absolute_url, "a/b:c")
    assert apply(fn.url_base, "a/b.jpg?v=1#f") == "a/b.jpg"
    assert apply(fn.url_suffix, "a/b.jpg#f?v") == "#f?v"
    assert apply(fn.encode_uri, "a b/ü(1)'~!.jpg?x#y") == "a%20b/%C3%BC(1)'~!.jpg?x#y"


def test_place_spellings(apply):
    assert apply(fn.place_variants, "Mt Isa") == ["Mt Isa", "Mount Isa", "Isa Mountain"]
    assert "Mount Black" in apply(fn.place_variants, "Black Mountain")
    assert apply(fn.place_variants, "Fraser lsland")[:2] == ["Fraser lsland", "Fraser Island"]


def test_coordinates_read_shortest(apply):
    assert apply(fn.wkt_point, -27.4698, 153.0251) == "POINT(153.0251 -27.4698)"
    assert apply(fn.wkt_point, 10.0, 0.00025) == "POINT(0.00025 10)"
    assert apply(fn.number_text, -100.0) == "-100"


def test_cells(apply):
    assert apply(fn.split_values, " a, b/ ,c ") == ["a", "b", "c"]
    assert apply(fn.csv_field, "#s1") == "#s1"
    assert apply(fn.csv_field, 'say "x", y') == '"say ""x"", y"'


def test_speaker_lines(apply):
    full = apply(fn.parse_speaker_line, "AB: Jo Doe (North, XY) #p7")
    assert tuple(full) == ("AB", "Jo Doe", "(North, XY)", "#p7")
    assert tuple(apply(fn.parse_speaker_line, "B: Sam #p2")) == ("B", "Sam", None, "#p2")
    assert tuple(apply(fn.parse_speaker_line, "C: Ann")) == ("C", "Ann", None, None)


def test_media_lines(apply):
    assert tuple(apply(fn.media_ref, "IMG_01.PNG at dusk")) == ("image", "IMG_01.PNG", "at dusk")
    assert tuple(apply(fn.media_ref, "my photo.jpeg")) == ("image", "my photo.jpeg", None)
    assert tuple(apply(fn.media_ref, "sound file: talk.mp3 ")) == ("sound", "talk.mp3", None)
    assert tuple(apply(fn.media_ref, "see x.jpgs now")) == (None, None, None)


def test_captions(apply):
    assert apply(fn.caption_half, "CAPTION: a") == "caption"
    assert apply(fn.caption_half, "photo: b") == "credit"
    assert apply(fn.caption_half, "a photo: b") is None
    assert apply(fn.caption_text, " Photo:  J. Smith ") == "J. Smith"


def test_numbers_have_no_exponent(table):
    numbers = [12345678.9, 1e21, 1e-21, 1.23456789e-15, -1.5e7, 100.0, -27.5, 0.0, 1e7, 123456789.0, 5e-324, 0.001, -0.00012, 1.7976931348623157e308]
    found = [r["t"] for r in table([(x,) for x in numbers], "x double").select(fn.number_text(F.col("x")).alias("t")).collect()]
    assert all("E" not in t and not t.endswith(".0") for t in found)
    assert [float(t) for t in found] == numbers
    assert found[:7] == ["12345678.9", "1" + "0" * 21, "0." + "0" * 20 + "1", "0." + "0" * 14 + "123456789", "-15000000", "100", "-27.5"]
