"""From a file listing to the part/whole structure of a graph.

Files are numbered once, in path order; every list built from files takes its
positions from that number, so no list needs a window of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import (
    COLLECTION_PROFILE,
    COLLECTION_TYPE,
    DESCRIPTOR,
    DUPLICATE_PROP,
    NODE_COLS,
    OBJECT_PROFILE,
    OBJECT_TYPE,
    PROP_COLS,
    fact,
    node_rows,
    prop_rows,
    union_all,
)
from cairn.plans.scale import number_rows, scattered, staged


LINK_BLOCK = 1024  # files of a block of name-alikes


def order_files(files: DataFrame) -> DataFrame:
    """``file_no``: the place of each file in its graph's listing, by path."""
    return number_rows(files, ["graph_id"], ["relative_path"], "file_no")


def file_metadata(files: DataFrame) -> DataFrame:
    """Id, folders and top-level group of each file.

    A file in no folder is grouped under the stem of its ``file_name``, which
    need not be the path's last part.
    """
    chain = fn.folders(F.col("relative_path"))
    return (
        files.withColumns({"id": F.col("relative_path"), "folders": chain})
        .withColumn(
            "top_level_name",
            F.when(F.size("folders") > 0, F.get("folders", F.lit(0))).otherwise(
                fn.strip_ext(F.col("file_name"))
            ),
        )
        .withColumn("group_id", F.concat(F.lit("#"), fn.sanitize_url(F.col("top_level_name"))))
    )


def duplicate_groups(meta: DataFrame, skip_empty_key: bool = False) -> DataFrame:
    """Files that share their normalised name with others, one row per file.

    The group sizes are counted with map-side partial sums; the join side is
    unique per name, so adaptive execution can split a name that very many
    files share.
    """
    keyed = meta.select(
        "graph_id", "id", "file_no", fn.normalize_name(F.col("file_name")).alias("dup_key")
    )
    if skip_empty_key:
        keyed = keyed.filter("dup_key <> ''")
    sizes = keyed.groupBy("graph_id", "dup_key").agg(F.count("*").alias("group_size"))
    return keyed.join(sizes.filter("group_size > 1"), ["graph_id", "dup_key"])


def duplicate_hub(dup_key: Column) -> Column:
    return F.concat(F.lit("#duplicates-"), F.translate(dup_key, " ", "-"))


def possible_duplicates(groups: DataFrame) -> DataFrame:
    """Links between name-alikes: rows (graph_id, id, pos, ref).

    Each file links to the hub of its name and the hub to every file: a file's
    possible duplicates are the hub's files without itself. Groups of any size
    say it in two rows per file.
    """
    hub = duplicate_hub(F.col("dup_key"))
    return groups.select(
        "graph_id",
        F.inline(
            F.array(
                F.struct(F.col("id"), F.lit(0).cast("bigint").alias("pos"), hub.alias("ref")),
                F.struct(hub.alias("id"), F.col("file_no").alias("pos"), F.col("id").alias("ref")),
            )
        ),
    )


def duplicate_links(groups: DataFrame) -> DataFrame:
    """Links from each file to each of its name-alikes: rows (graph_id, id, pos, ref).

    A group of n files has n (n - 1) of them, so hubs are the default and this
    is for those who need the files named. A group is cut into blocks of
    ``LINK_BLOCK`` files; every pair of blocks is a key of its own, at which
    each pair of files meets once and gives both links. So no task has more
    than a block's pairs at a time, whatever the size of the group.
    """
    group = ["graph_id", "dup_key"]
    placed = number_rows(groups, group, ["file_no"], "place").select(
        *group, "id", "file_no", "place", F.floor(F.col("place") / LINK_BLOCK).cast("bigint").alias("block"), F.floor((F.col("group_size") - 1) / LINK_BLOCK).cast("bigint").alias("last")
    )
    lower = placed.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"))
    upper = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("i"), F.col("block").alias("j"))
    pair = [*group, "i", "j"]
    names = ["id", "file_no", "place"]
    met = lower.select(*pair, *[F.col(n).alias(f"a_{n}") for n in names]).join(upper.select(*pair, *[F.col(n).alias(f"b_{n}") for n in names]), pair)
    both = F.array(
        F.struct(F.col("a_id").alias("id"), F.col("b_file_no").alias("pos"), F.col("b_id").alias("ref")),
        F.struct(F.col("b_id").alias("id"), F.col("a_file_no").alias("pos"), F.col("a_id").alias("ref")),
    )
    return met.filter("a_place < b_place").select("graph_id", F.inline(both))


def duplicate_hub_nodes(groups: DataFrame) -> DataFrame:
    return node_rows(groups.select("graph_id", "dup_key").distinct(), duplicate_hub(F.col("dup_key")), "Collection")


def _described(objects: DataFrame, profile: str) -> DataFrame:
    return prop_rows(
        objects,
        F.col("object_id"),
        [
            fact("conformsTo", ref=profile),
            fact("name", F.col("name")),
            fact("description", ""),
            fact("datePublished", ""),
        ],
    )


def _named_groups(files: DataFrame, id: str, name: str, *also: Column) -> DataFrame:
    """One row per object: its first file's name for it, its first and last file number.

    Names join the keys of a first, hashed aggregation over all files; only
    the few names of an object are then sorted out. ``files`` may hold a row
    per file, or per several files with their ``first_no`` and ``last_no``.
    """
    first, last = ("first_no", "last_no") if "first_no" in files.columns else ("file_no", "file_no")
    numbers = [F.min(first).alias("first_no"), F.max(last).alias("last_no")]
    per_name = files.groupBy("graph_id", F.col(id).alias("object_id"), F.col(name).alias("name"), *also).agg(
        *numbers
    )
    return per_name.groupBy("graph_id", "object_id", *also).agg(
        F.min_by("name", "first_no").alias("name"),
        F.min("first_no").alias("first_no"),
        F.max("last_no").alias("last_no"),
    )


def _has_part(parents: DataFrame) -> DataFrame:
    return parents.select(
        "graph_id",
        F.col("parent_id").alias("id"),
        F.lit("hasPart").alias("prop"),
        F.col("file_no").alias("pos"),
        F.lit(None).cast("string").alias("value"),
        F.col("id").alias("ref"),
    )


def folder_objects(meta: DataFrame) -> dict[str, DataFrame]:
    """Object mode: one object per top-level group, holding every file beneath.

    Returns ``nodes``, ``props``, ``parents`` (file → its object) and
    ``top_level`` (the root's members). Ids that sanitise alike merge.
    """
    parents = meta.select("graph_id", "id", "file_no", F.col("group_id").alias("parent_id"))
    objects = _named_groups(meta, "group_id", "top_level_name")
    return {
        "nodes": node_rows(objects, F.col("object_id"), OBJECT_TYPE),
        "props": _described(objects, OBJECT_PROFILE).unionByName(_has_part(parents)),
        "parents": parents,
        "top_level": objects,
    }


def folder_collections(meta: DataFrame) -> dict[str, DataFrame]:
    """Collection mode: a collection per top folder, objects per subfolder.

    Files directly in a top folder, and a root file whose group also is a
    folder, go to ``<Name>_Files``. Groups without a folder stay objects.
    Child folders that sanitise to one id merge; the first name wins. Returns
    the tables of :func:`folder_objects` and ``children``, the objects inside
    collections. What a file says of its place is read several times, so it is
    staged, as are the groups and objects found by one aggregation.
    """
    child = F.get("folders", F.lit(1))
    direct = F.size("folders") <= 1
    files_segment = F.concat(F.expr("substr(group_id, 2)"), F.lit("_Files"))
    segment = F.when(direct, files_segment).otherwise(fn.sanitize_segment(child))
    told = staged(
        meta.select(
            "graph_id",
            "id",
            "file_no",
            "group_id",
            "top_level_name",
            (F.size("folders") > 0).alias("in_folder"),
            F.concat("group_id", F.lit("/"), segment).alias("inner_id"),
            F.when(~direct, child).alias("label"),
        )
    )
    collection_ids = (
        told.filter("in_folder").select("graph_id", "group_id").distinct().withColumn("known", F.lit(True))
    )
    # only root files have to ask whether their group is a folder
    loose = told.filter("NOT in_folder").join(collection_ids, ["graph_id", "group_id"], "left")
    flagged = (
        told.filter("in_folder")
        .withColumn("in_collection", F.lit(True))
        .unionByName(loose.withColumn("in_collection", F.coalesce("known", F.lit(False))).drop("known"))
    )
    placed = flagged.withColumn("object_id", F.when(F.col("in_collection"), F.col("inner_id")).otherwise(F.col("group_id")))
    per_label = staged(
        placed.groupBy("graph_id", "group_id", "top_level_name", "in_collection", "object_id", "label").agg(
            F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no")
        )
    )
    groups = staged(_named_groups(per_label, "group_id", "top_level_name", F.col("in_collection")))
    collections = groups.filter("in_collection")
    singles = groups.filter("NOT in_collection")
    named = collections.select(
        "graph_id", F.col("object_id").alias("group_id"), F.col("name").alias("group_name"), "last_no"
    )
    by_label = per_label.filter("in_collection").groupBy("graph_id", "group_id", "object_id", "label").agg(
        F.min("first_no").alias("first_no")
    )
    # subfolders come in order of their first file, and name the object first
    order = F.struct(F.col("label").isNull().alias("is_direct"), "first_no")
    children = staged(
        by_label.groupBy("graph_id", "group_id", "object_id")
        .agg(F.min_by("label", order).alias("label"), F.min(order).alias("first"))
        .join(named, ["graph_id", "group_id"])
        .withColumns(
            {
                "name": F.coalesce("label", F.concat("group_name", F.lit("_Files"))),
                # the direct files stand last
                "member_pos": F.when(F.col("first.is_direct"), F.col("last_no") + 1).otherwise(
                    F.col("first.first_no")
                ),
            }
        )
    )
    parents = placed.select("graph_id", "id", "file_no", F.col("object_id").alias("parent_id"))
    membership = prop_rows(
        children, F.col("object_id"), [fact("pcdm:memberOf", ref=F.col("group_id"))]
    ).unionByName(
        prop_rows(
            children,
            F.col("group_id"),
            [fact("pcdm:hasMember", ref=F.col("object_id"), pos=F.col("member_pos"))],
        )
    )
    return {
        "nodes": union_all(
            [
                node_rows(collections, F.col("object_id"), COLLECTION_TYPE),
                node_rows(children, F.col("object_id"), OBJECT_TYPE),
                node_rows(singles, F.col("object_id"), OBJECT_TYPE),
            ]
        ),
        "props": union_all(
            [
                _described(collections, COLLECTION_PROFILE),
                _described(children, OBJECT_PROFILE),
                _described(singles, OBJECT_PROFILE),
                membership,
                _has_part(parents),
            ]
        ),
        "parents": parents,
        "top_level": groups,
        "children": children.select("graph_id", "group_id", "object_id", "name", "member_pos"),
    }


def file_entities(
    meta: DataFrame,
    parents: DataFrame | None,
    file_properties: Sequence[str] = (),
    duplicates: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """File entities with their blank fields, parent and duplicate links.

    ``parents`` is None where other metadata describes the structure.
    Duplicate links are written only if the profile declares them.
    """
    blanks = ["description", "datePublished", "contentLocation"]
    blanks += [p for p in file_properties if p != DUPLICATE_PROP]
    props = prop_rows(
        meta,
        F.col("id"),
        [fact("name", F.col("file_name")), *[fact(key, "") for key in blanks]],
    )
    if parents is not None:
        props = props.unionByName(
            prop_rows(parents, F.col("id"), [fact("isPartOf", ref=F.col("parent_id"))])
        )
    if duplicates is not None and DUPLICATE_PROP in file_properties:
        links = duplicates.withColumns(
            {"prop": F.lit(DUPLICATE_PROP), "value": F.lit(None).cast("string")}
        )
        props = props.unionByName(links.select(*PROP_COLS))
    return {"nodes": node_rows(meta, F.col("id"), "File"), "props": props}


def root_membership(top_level: DataFrame, roots: DataFrame) -> DataFrame:
    """The root's members: its top-level groups in order of first file."""
    return prop_rows(
        top_level.join(roots, "graph_id"),
        F.col("root_id"),
        [fact("pcdm:hasMember", ref=F.col("object_id"), pos=F.col("first_no"))],
    )


def rewrite_hash_ids(
    nodes: DataFrame, props: DataFrame, roots: DataFrame
) -> dict[str, DataFrame]:
    """Move ``#x`` ids of objects and collections under the root's id.

    References follow. The root id and the rest are joined by exactly one
    slash. A graph with a blank root id is left alone.
    """
    base = roots.filter(fn.trim_all(F.col("root_id")) != "").select(
        "graph_id",
        F.concat(F.regexp_replace(fn.trim_all(F.col("root_id")), r"/+\z", ""), F.lit("/")).alias("base"),
    )
    renamed = (
        nodes.filter(F.col("type").isin(OBJECT_TYPE, COLLECTION_TYPE) & F.col("id").startswith("#"))
        .select("graph_id", "id")
        .distinct()
        .join(base, "graph_id")
        .select("graph_id", F.col("id").alias("old"), F.concat("base", F.expr("substr(id, 2)")).alias("new"))
    )
    return rename_everywhere(nodes, props, renamed, may_match=lambda c: c.startswith("#"))


def rename_everywhere(nodes: DataFrame, props: DataFrame, renamed: DataFrame, may_match=None):
    """Apply an id map (graph_id, old, new) to entities and references.

    ``old`` is unique per graph, so the joins add no rows and a hot id can be
    split. ``may_match`` tells which ids the map can hold at all: rows without
    one skip the joins, and cells without one get a scattered key that matches
    nothing, so that blanks do not gather in one task.
    """

    def wanted(column: str) -> Column:
        match = F.lit(True) if may_match is None else may_match(F.col(column))
        return F.coalesce(F.col(column).isNotNull() & match, F.lit(False))

    def swap(df: DataFrame, column: str) -> DataFrame:
        names = renamed.select("graph_id", F.col("old").alias("_key"), F.col("new").alias("_new"))
        return (
            df.withColumn("_key", scattered(F.col(column), wanted(column), *df.columns))
            .join(names, ["graph_id", "_key"], "left")
            .withColumn(column, F.coalesce("_new", column))
            .select(*df.columns)
        )

    def swap_all(df: DataFrame, *columns: str) -> DataFrame:
        touched = reduce(Column.__or__, [wanted(c) for c in columns])
        swapped = reduce(swap, columns, df if may_match is None else df.filter(touched))
        return swapped if may_match is None else swapped.unionByName(df.filter(~touched))

    return {"nodes": swap_all(nodes, "id"), "props": swap_all(props, "id", "ref")}


def assemble_root(
    roots: DataFrame, profile: Mapping, authored: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Root, descriptor and licence entity of every graph.

    ``profile`` gives ``types``, ``conforms_to`` and ``licence`` (an entity:
    ``id``, ``type`` and literal properties). ``authored`` (graph_id, prop,
    pos, value, ref) replaces whatever the profile says about a property;
    authored ``@type`` values replace the types.
    """
    root = F.col("root_id")
    types = [
        F.struct(F.lit(t).alias("type"), F.lit(i).alias("pos"))
        for i, t in enumerate(profile.get("types", ["Dataset"]))
    ]
    nodes = roots.select("graph_id", root.alias("id"), F.inline(F.array(*types)))
    props = []
    if profile.get("conforms_to"):
        props.append(prop_rows(roots, root, [fact("conformsTo", ref=profile["conforms_to"])]))
    if authored is not None:
        own = authored.join(roots, "graph_id").withColumn("id", root)
        typed = own.filter("prop = '@type'")
        nodes = nodes.join(typed.select("graph_id").distinct(), "graph_id", "left_anti").unionByName(
            typed.select("graph_id", "id", F.col("value").alias("type"), F.col("pos").cast("int"))
        )
        said = own.filter("prop <> '@type'").select(*PROP_COLS)
        props = [
            p.join(said.select("graph_id", "id", "prop").distinct(), ["graph_id", "id", "prop"], "left_anti")
            for p in props
        ] + [said]
    has_root = roots.filter(fn.trim_all(root) != "")
    facts = [fact("about", ref=root)]
    licence = profile.get("licence")
    node_parts = [nodes.select(*NODE_COLS), node_rows(roots, F.lit(DESCRIPTOR), "CreativeWork")]
    props.append(prop_rows(has_root, F.lit(DESCRIPTOR), facts))
    if licence:
        lid = F.lit(licence["id"])
        props.append(prop_rows(roots, F.lit(DESCRIPTOR), [fact("license", ref=lid)]))
        props.append(
            prop_rows(
                roots,
                lid,
                [fact(k, v) for k, v in licence.items() if k not in ("id", "type")],
            )
        )
        node_parts.append(node_rows(roots, lid, licence["type"]))
    return {"nodes": union_all(node_parts), "props": union_all(props)}


def declared_definitions(roots: DataFrame, definitions: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Entities that document the file properties a profile declares.

    Each definition has ``id`` and literal properties such as ``name``.
    """
    nodes = [node_rows(roots, F.lit(d["id"]), "rdf:Property") for d in definitions]
    props = [
        prop_rows(roots, F.lit(d["id"]), [fact(k, v) for k, v in d.items() if k != "id"])
        for d in definitions
    ]
    return {"nodes": union_all(nodes), "props": union_all(props)}


def inherit_license(nodes: DataFrame, props: DataFrame, roots: DataFrame) -> DataFrame:
    """Licence references of the root, copied to its objects and collections."""
    licences = (
        props.filter("prop = 'license' AND ref IS NOT NULL")
        .join(roots.withColumnRenamed("root_id", "id"), ["graph_id", "id"], "left_semi")
        .select("graph_id", "prop", "pos", "value", "ref")
    )
    holders = (
        nodes.filter(F.col("type").isin(OBJECT_TYPE, COLLECTION_TYPE))
        .join(roots.withColumnRenamed("root_id", "id"), ["graph_id", "id"], "left_anti")
        .select("graph_id", "id")
        .distinct()
    )
    return holders.join(licences, "graph_id").select(*PROP_COLS)
