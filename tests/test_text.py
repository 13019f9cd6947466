import pytest

from cairn.operators import documents as docs
from cairn.operators import stats
from cairn.operators import transcripts as ts
from cairn.plans import scale
from cairn.sinks import text as out

TALK = """Transcript: Market day
Recorded by: Ines
Speakers:
A: Mara Lind (Port Guild, Delta) #mara
B: Oto #oto
PRELIMINARIES
A: good morning
B: they said
Listen: come home now
and wait there

  until noon
MAIN
A: Fish, "fresh"
X: how much
POSTLIMINARIES
A:
END OF TRANSCRIPT"""

@pytest.fixture(params=[1 << 16, 4], ids=["whole", "cut"])
def segments(request, monkeypatch):
    """Once as usual, once with segments of four lines."""
    monkeypatch.setattr(scale, "SEGMENT_ROWS", request.param)
    return request.param


@pytest.fixture
def texts(table):
    return table([("g", "talks/demo.docx", TALK), ("g", "talks/plain.docx", "no codes\nat all"), ("g", "talks/bare.docx", "Title: one\nA: first\nmore: of it\nB: second")], "graph_id string, doc_id string, text string")


def test_lines_are_normalised(texts, rows):
    lines = [r["line"] for r in ts.normalize_transcript(texts, 1, 1).filter("doc_id LIKE '%demo%'").orderBy("line_no").collect()]
    assert lines[0] == "Recorded by: Ines"
    assert "A:\tMara Lind (Port Guild, Delta) #mara" in lines
    assert lines[-1] == "A:\t"
    kept = ts.normalize_transcript(texts).filter("line LIKE 'END%'")
    assert kept.count() == 0


def said(df, doc):
    return [(r["code"], r["section"], r["text"]) for r in df.filter(f"doc_id LIKE '%{doc}%'").orderBy("at").collect()]


def test_rows_of_a_transcript(texts, segments):
    made = ts.transcript_rows(texts)
    assert said(made["rows"], "demo") == [
        ("A", "PRE", "good morning"),
        ("B", "PRE", "they said Listen: come home now and wait there until noon"),
        ("A", "MAIN", 'Fish, "fresh"'),
        ("X", "MAIN", "how much"),
        ("A", "POST", ""),
    ]
    demo = made["rows"].filter("doc_id LIKE '%demo%'")
    ids = {r["code"]: r["speaker_id"] for r in demo.collect() if r["code"]}
    assert ids == {"A": "#mara", "B": "#oto", "X": "X"}
    first = demo.first()
    assert (first["csv_id"], first["object_id"]) == ("./c2c-output/demo.csv", "./c2c-output/demo")
    assert made["rows"].filter("doc_id LIKE '%plain%'").count() == 0


def test_turns_outside_sections_are_kept(texts, segments):
    """Where no section begins, a line that reads as a label opens a heading."""
    assert said(ts.transcript_rows(texts)["rows"], "bare") == [("A", None, "first more: of it"), ("B", None, "second")]


def test_turns_cross_segment_borders_whole(table, segments):
    lines = [("g", "d", k, "A: one" if k == 0 else f"w{k}") for k in range(23)] + [("g", "d", 23, "B: two")]
    merged = ts.merge_continuations(table(lines, "graph_id string, doc_id string, line_no int, line string"))
    found = [(r["at"], r["code"], r["text"]) for r in merged.orderBy("at").collect()]
    assert found == [(0, "A", " ".join(["one", *(f"w{k}" for k in range(1, 23))])), (23, "B", "two")]


def test_speakers_from_lines_and_texts_agree(texts, rows, segments, lists):
    tagged = ts.tag_lines(ts.normalize_transcript(texts))
    columns = ["doc_id", "code", "label", "affiliation", "speaker_id"]
    expected = [
        ("talks/demo.docx", "A", "Mara Lind", "(Port Guild, Delta)", "#mara"),
        ("talks/demo.docx", "B", "Oto", None, "#oto"),
    ]
    assert rows(ts.speakers(tagged), *columns) == expected
    assert rows(ts.listed_speakers(texts), *columns) == expected
    people = ts.speaker_entities(ts.speakers(tagged))
    assert lists(people["props"])[("#mara", "affiliation")] == ["(Port Guild, Delta)"]
    assert lists(people["props"])[("#mara", "identifier")] == ["#mara"]


def test_unresolved_speakers(texts, rows):
    made = ts.transcript_rows(texts.filter("doc_id LIKE '%demo%'"))
    assert rows(ts.unresolved_speakers(made["rows"], made["speakers"]), "code") == [("X",)]
    known = made["rows"].filter("code <> 'X'")
    assert rows(ts.unresolved_speakers(known, made["speakers"]), "code") == [("none",)]


def test_csv_is_quoted_only_where_needed(texts, tmp_path, spark):
    made = ts.transcript_rows(texts.filter("doc_id LIKE '%demo%'"))["rows"]
    lines = [r["line"] for r in out.transcript_csv(made).orderBy("at").collect()]
    assert lines[0] == "speakerID,text,section"
    assert "#mara,good morning,PRE" in lines
    assert '#mara,"Fish, ""fresh""",MAIN' in lines
    out.write_transcript_csv(made, str(tmp_path / "csv"))
    read = spark.read.text(str(tmp_path / "csv"))
    assert [r["value"] for r in read.collect()] == lines


def test_chat_text(texts, segments, tmp_path, spark):
    made = ts.transcript_rows(texts.filter("doc_id LIKE '%demo%'"))
    out.write_chat(made["rows"], made["speakers"], "eng", "demo-corpus", str(tmp_path / "chat"))
    chat = [r["value"] for r in spark.read.text(str(tmp_path / "chat")).collect()]
    assert chat[:4] == ["@UTF8", "@Begin", "@Languages: eng", "@Participants: A Participant, B Participant, X Participant"]
    assert "@ID: eng|demo-corpus|A|||||Participant||Port Guild, Delta|" in chat
    assert chat[7:] == ["*A: good morning", "*B: they said Listen: come home now and wait there until noon", '*A: Fish, "fresh"', "*X: how much", "*A: "]


def test_characters_stay_whole(table):
    found = {r["character"]: r["count"] for r in stats.character_inventory(table([("g", "aé😀"), ("g", "a\n"), ("g", "")], "graph_id string, text string")).collect()}
    assert found == {"a": 2, "é": 1, "😀": 1, "\n": 1}


BLOCKS = [
    ("h1", "Title"),
    ("p", "intro"),
    ("h2", "One"),
    ("table", "c1\tc2\n c3 \tc4"),
    ("p", "text"),
    ("h3", "One a"),
    ("table", "d1"),
    ("p", "photo.jpg dusk"),
    ("image", "x"),
    ("caption", "caption: A bird"),
    ("caption", "in a tree"),
    ("caption", "Photo: Jo"),
    ("caption", "Smith"),
    ("caption", "caption: again"),
    ("p", "done"),
    ("caption", "stray"),
    ("h3", "Two"),
    ("p", "not a"),
    ("table", "late"),
    ("p", "note.png"),
]


@pytest.fixture
def blocks(table):
    rows = [("g", "d", i * 3, kind, text) for i, (kind, text) in enumerate(BLOCKS)]
    rows += [("g", "bare", 0, "p", "no headings"), ("g", "bare", 1, "table", "x")]
    return table(rows, "graph_id string, doc_id string, pos bigint, kind string, text string")


def test_chapters(blocks, rows, segments):
    chapters = docs.segment_chapters(blocks)
    numbers = {r["pos"]: r["chapter"] for r in chapters.collect()}
    assert [numbers[i * 3] for i in (0, 1, 2, 4, 5, 15, 16, 19)] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert rows(chapters.select("doc_id").distinct()) == [("d",)]
    assert rows(docs.documents_without_headings(blocks), "doc_id") == [("bare",)]


def test_sections_nest_before_a_table_only(blocks, rows, segments):
    found = {r["text"]: r["parent_pos"] for r in docs.nest_sections(blocks).collect()}
    assert found == {"One": None, "One a": 6, "Two": None}


def test_only_the_first_table_counts(blocks, rows, segments):
    assert rows(docs.structured_rows(blocks), "pos", "row_no", "cell") == [(18, 0, "d1"), (9, 0, "c1"), (9, 1, "c3")]


def test_captions_belong_to_images(blocks, segments):
    found = {(r["image_pos"], r["half"]): r["text"] for r in docs.attach_captions(blocks).collect()}
    assert found == {
        (24, "caption"): "dusk A bird in a tree again",
        (24, "credit"): "Jo Smith",
    }


def test_documents_by_topic(table, root, lists, rows):
    originals = table(
        [("g", "Web1 HOME", "Home.docx"), ("g", "Web2", "B.docx"), ("g", "Web2", "A.docx"), ("g", "Web3", "Field Notes.docx"), ("g", "Web2", "~$A.docx"), ("g", "Web2", ".x.docx")],
        "graph_id string, topic string, file_name string",
    )
    made = docs.document_collections(originals, root("./"))
    said = lists(made["props"])
    assert said[("./", "hasPart")] == [("@", "#derivedContent"), ("@", "#sourceDocuments")]
    assert said[("#derivedContent", "hasPart")] == [("@", "#Web1_HOME"), ("@", "#Web2")]
    assert said[("#sourceDocuments", "hasPart")] == [("@", "#sourceDocuments-Web1_HOME"), ("@", "#sourceDocuments-Web2")]
    assert said[("#sourceDocuments-Web2", "hasPart")] == [("@", f"ro-crate-preview_files/Web2/{n}.docx") for n in "AB"]
    assert said[("#sourceDocuments-Web1_HOME", "name")] == ["Web1 HOME"]
    assert rows(made["nodes"].filter("type = 'RepositoryCollection'"), "id") == [("#Web1_HOME",), ("#Web2",)]
