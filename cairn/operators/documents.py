"""Styled documents, as block streams, to chapters, captions and collections.

``blocks`` is (graph_id, doc_id, pos, kind, text); kinds are ``h1`` ``h2``
``h3`` ``image`` ``caption`` ``table`` and ``p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import fact, node_rows, prop_rows, union_all
from cairn.plans.scale import number_rows, scan

DOC = ["graph_id", "doc_id"]
CHAPTER_KINDS = ["h2", "h3"]
HEADINGS = ["h1", *CHAPTER_KINDS]

# Ids, types, folder and media type of the document structure.
DERIVED = "#derivedContent"
SOURCES = "#sourceDocuments"
SOURCE_FOLDER = "ro-crate-preview_files/"
DOCX_FORMAT = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def _with_headings(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("kind").isin(HEADINGS)).select(*DOC).distinct()


def documents_without_headings(blocks: DataFrame) -> DataFrame:
    """Documents that yield no chapters, for the report."""
    return blocks.select(*DOC).distinct().join(_with_headings(blocks), DOC, "left_anti")


def segment_chapters(blocks: DataFrame) -> DataFrame:
    """Number each block's chapter and give the position of its heading.

    Chapter 0 is the title and introduction. Documents without any heading
    are left out.
    """
    opens = F.col("kind").isin(CHAPTER_KINDS)
    styled = blocks.join(_with_headings(blocks), DOC, "left_semi")
    return scan(
        styled,
        DOC,
        "pos",
        total={"chapter": opens.cast("bigint")},
        last={"heading_pos": F.when(opens, F.col("pos"))},
    ).drop("_seg")


def nest_sections(blocks: DataFrame) -> DataFrame:
    """Chapter headings with their parent: (doc, pos, kind, text, parent_pos).

    An ``h3`` followed at once by a table belongs to the latest ``h2``;
    every other chapter has no parent.
    """
    scanned = scan(
        blocks,
        DOC,
        "pos",
        lead={"next_kind": F.col("kind")},
        last={"h2_pos": F.when(F.col("kind") == "h2", F.col("pos"))},
    )
    nests = (F.col("kind") == "h3") & (F.col("next_kind") == "table")
    return scanned.filter(F.col("kind").isin(CHAPTER_KINDS)).select(
        *DOC, "pos", "kind", "text", F.when(nests, F.col("h2_pos")).alias("parent_pos")
    )


def structured_rows(blocks: DataFrame) -> DataFrame:
    """First cell of each row of the tables that directly follow a chapter heading.

    A table's text has a line per row and tabs between cells.
    """
    scanned = scan(blocks, DOC, "pos", lag={"kind_above": F.col("kind")})
    tables = scanned.filter((F.col("kind") == "table") & F.col("kind_above").isin(CHAPTER_KINDS))
    return tables.select(
        *DOC, "pos", F.posexplode(F.split("text", "\r?\n", -1)).alias("row_no", "row")
    ).select(*DOC, "pos", "row_no", fn.trim_all(F.substring_index("row", "\t", 1)).alias("cell"))


def caption_lines(blocks: DataFrame) -> DataFrame:
    """Lines that belong to an image: (doc, image_pos, half, pos, text).

    Caption blocks directly after an image do, each to the half named last
    (caption, unless ``Photo:`` came before). A line that names an image file
    and is followed at once by an embedded image folds into that image: what
    it says after the file name leads the image's caption.
    """
    kind = F.col("kind")
    above = scan(blocks, DOC, "pos", lead={"below": F.struct("kind", "pos")}).drop("_seg")
    named = fn.media_ref(F.col("text"))
    folds = (kind == "p") & (named["kind"] == "image") & (F.col("below.kind") == "image")
    scanned = scan(
        above.withColumn("folds", F.coalesce(folds, F.lit(False))),
        DOC,
        "pos",
        last={
            # any other block than a caption ends the run
            "image": F.when(kind != "caption", F.struct(F.when(kind == "image", F.col("pos")).alias("at"))),
            "half": F.when(kind == "image", F.lit("caption")).when(
                kind == "caption", fn.caption_half(F.col("text"))
            ),
        },
    )
    after = scanned.filter("kind = 'caption' AND image.at IS NOT NULL").select(
        *DOC, F.col("image.at").alias("image_pos"), "half", "pos", fn.caption_text(F.col("text")).alias("text")
    )
    folded = scanned.filter("folds").select(
        *DOC,
        F.col("below.pos").alias("image_pos"),
        F.lit("caption").alias("half"),
        "pos",
        fn.media_ref(F.col("text"))["caption"].alias("text"),
    )
    return after.unionByName(folded).filter("text <> ''")


def attach_captions(blocks: DataFrame) -> DataFrame:
    """Caption and credit of each image, lines joined: (doc, image_pos, half, text)."""
    # the lines between two images of one document
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " "
    )
    return caption_lines(blocks).groupBy(*DOC, "image_pos", "half").agg(joined.alias("text"))


def exclude_working_docs(files: DataFrame) -> DataFrame:
    """Drop notes, lock files and dotfiles, judged by ``file_name``."""
    name = F.col("file_name")
    return files.filter(~(name.rlike("(?i)notes?") | name.startswith("~$") | name.startswith(".")))


def document_collections(documents: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """Wrapper collections, a collection and a source group per topic, a File per original.

    ``documents`` is (graph_id, topic, file_name). Working documents are left
    out first, so a topic of notes only makes no group.
    """
    numbered = number_rows(
        exclude_working_docs(documents.select("graph_id", "topic", "file_name").distinct()),
        ["graph_id"],
        ["topic", "file_name"],
        "doc_no",
    ).withColumns(
        {
            "topic_id": F.concat(F.lit("#"), fn.sanitize_segment(F.col("topic"))),
            "group_id": F.concat(F.lit(SOURCES + "-"), fn.sanitize_segment(F.col("topic"))),
            "file_id": F.concat(F.lit(SOURCE_FOLDER), "topic", F.lit("/"), "file_name"),
        }
    )
    topics = numbered.groupBy("graph_id", "topic_id", "group_id").agg(
        F.min("doc_no").alias("pos"), F.min_by("topic", "doc_no").alias("name")
    )
    wrappers = topics.select("graph_id").distinct().join(roots, "graph_id")
    file_id, pos, name = F.col("file_id"), F.col("pos"), F.col("name")
    nodes = [
        node_rows(wrappers, F.lit(DERIVED), "custom:DerivedContentCollection"),
        node_rows(wrappers, F.lit(SOURCES), "custom:SourceDocumentsCollection"),
        node_rows(topics, F.col("topic_id"), "RepositoryCollection"),
        node_rows(topics, F.col("group_id"), "custom:SourceDocumentGroup"),
        node_rows(numbered, file_id, "File"),
    ]
    props = [
        prop_rows(
            wrappers,
            F.col("root_id"),
            [fact("hasPart", ref=DERIVED), fact("hasPart", ref=SOURCES, pos=1)],
        ),
        prop_rows(topics, F.lit(DERIVED), [fact("hasPart", ref=F.col("topic_id"), pos=pos)]),
        prop_rows(topics, F.lit(SOURCES), [fact("hasPart", ref=F.col("group_id"), pos=pos)]),
        prop_rows(topics, F.col("topic_id"), [fact("name", name)]),
        prop_rows(topics, F.col("group_id"), [fact("name", name)]),
        prop_rows(numbered, F.col("group_id"), [fact("hasPart", ref=file_id, pos=F.col("doc_no"))]),
        prop_rows(
            numbered,
            file_id,
            [fact("name", F.col("file_name")), fact("encodingFormat", DOCX_FORMAT)],
        ),
    ]
    return {"nodes": union_all(nodes), "props": union_all(props)}


def document_entities(documents: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """Documents, chapters and media as entities under their topic collections.

    ``documents`` is (graph_id, doc_id, topic, file_name) of the originals. A
    topic has its documents as members; a document has its chapters as parts,
    a chapter those nested in it; a chapter, or the document before its first
    one, has its media. Ids follow from topic, file and position. A document
    is named by its title, else by its file.
    """
    doc_entity = F.concat(
        F.lit("#"), fn.sanitize_segment(F.col("topic")), F.lit("/"), fn.sanitize_segment(fn.strip_ext(F.col("file_name")))
    )
    known = exclude_working_docs(documents).select(
        *DOC, F.concat(F.lit("#"), fn.sanitize_segment(F.col("topic"))).alias("topic_id"), "file_name", doc_entity.alias("entity"),
        F.concat(F.lit(SOURCE_FOLDER), "topic", F.lit("/"), "file_name").alias("file_id"),
    )
    titles = blocks.filter("kind = 'h1'").groupBy(*DOC).agg(F.min_by("text", "pos").alias("title"))
    named = known.join(titles, DOC, "left").withColumn("name", F.coalesce("title", fn.strip_ext(F.col("file_name"))))

    def chapter_id(pos: str) -> Column:
        return F.concat("entity", F.lit("/chapter-"), F.col(pos).cast("string"))

    chapters = nest_sections(blocks).join(known, DOC)
    above = F.when(F.col("parent_pos").isNotNull(), chapter_id("parent_pos")).otherwise(F.col("entity"))
    chapters = chapters.withColumns({"id": chapter_id("pos"), "above": above})

    opens = F.col("kind").isin(CHAPTER_KINDS)
    placed = scan(blocks, DOC, "pos", last={"heading_pos": F.when(opens, F.col("pos"))})
    images = placed.filter("kind = 'image'").select(*DOC, F.col("pos").alias("image_pos"), "text", "heading_pos").join(known, DOC)
    above = F.when(F.col("heading_pos").isNotNull(), chapter_id("heading_pos")).otherwise(F.col("entity"))
    media = images.withColumns({"id": F.concat("entity", F.lit("/media-"), F.col("image_pos").cast("string")), "above": above})
    said = attach_captions(blocks).join(media.select(*DOC, "image_pos", "id"), [*DOC, "image_pos"])

    id, entity, topic = F.col("id"), F.col("entity"), F.col("topic_id")
    nodes = [
        node_rows(named, entity, "RepositoryObject"),
        node_rows(chapters, id, "RepositoryObject"),
        node_rows(media, id, "CreativeWork"),
    ]
    props = [
        prop_rows(named, entity, [fact("name", F.col("name")), fact("pcdm:memberOf", ref=topic), fact("isBasedOn", ref=F.col("file_id"))]),
        prop_rows(named, topic, [fact("pcdm:hasMember", ref=entity, pos=F.col("doc_id"))]),
        prop_rows(chapters, id, [fact("name", F.col("text")), fact("isPartOf", ref=F.col("above"))]),
        prop_rows(chapters, F.col("above"), [fact("hasPart", ref=id, pos=F.col("pos"))]),
        prop_rows(media, id, [fact("name", F.col("text")), fact("isPartOf", ref=F.col("above"))]),
        prop_rows(media, F.col("above"), [fact("hasPart", ref=id, pos=F.col("image_pos"))]),
        prop_rows(said, id, [fact(F.col("half"), F.col("text"))]),
    ]
    return {"nodes": union_all(nodes), "props": union_all(props)}
