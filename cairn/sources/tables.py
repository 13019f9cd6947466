"""Sheets, catalogues and profiles, from files or from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import NODE_COLS, PROP_COLS, union_all

# Scalar range types, and properties that say how a graph is put
# together, which no form asks for.
SCALAR_TYPES = ["Text", "Date", "URL"]
STRUCTURAL_PROPERTIES = ["pcdm:hasMember", "pcdm:memberOf", "hasPart", "isPartOf"]


def clean_sheet(sheet: DataFrame, graph_id: Column | str = "graph_id") -> DataFrame:
    """Trim the header, drop columns without one, and key the rows by ``@id``.

    Of columns that trim to one name the first is kept. All cells are text.
    """
    graph = F.col(graph_id) if isinstance(graph_id, str) else graph_id
    columns: dict[str, Column] = {}
    for position, raw in enumerate(sheet.columns):
        name = raw.strip()
        blank = not name or name == f"_c{position}"
        if not blank and name not in columns and name != "graph_id":
            columns[name] = F.col("`" + raw.replace("`", "``") + "`").cast("string")
    if "@id" not in columns:
        raise ValueError("a metadata sheet needs an @id column")
    key = fn.trim_all(columns.pop("@id"))
    return sheet.select(
        graph.alias("graph_id"), key.alias("id"), *[c.alias(n) for n, c in columns.items()]
    ).filter("id <> ''")


def read_sheet(spark: SparkSession, path: str, graph_id: str) -> DataFrame:
    """A CSV file or folder with a header row; an empty cell is null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return clean_sheet(raw, F.lit(graph_id))


def sheets_to_graph(sheets: dict[str, DataFrame], sheet_type: bool = True) -> dict[str, DataFrame]:
    """Per-type sheets (graph_id, id, columns …) to ``nodes`` and ``props``.

    A column ``@x`` holds references of ``x``; a cell that is a JSON list of
    strings holds several values, and so does a cell of a column ``.x``, by
    commas and slashes as in a metadata sheet.
    """
    nodes, props = [], []
    for kind, sheet in sheets.items():
        names = [c for c in sheet.columns if c not in ("graph_id", "id")]
        cells = F.array(
            *[
                F.struct(
                    F.lit(n.removeprefix("@")).alias("prop"),
                    F.lit(n.startswith("@")).alias("is_ref"),
                    F.lit(n.startswith(".")).alias("several"),
                    F.col("`" + n + "`").alias("cell"),
                )
                for n in names
            ]
        )
        long = sheet.select("graph_id", "id", F.inline(cells)).filter("cell IS NOT NULL")
        listed = F.when(F.col("cell").startswith("["), F.from_json("cell", "array<string>"))
        listed = F.coalesce(listed, F.when(F.col("several"), fn.split_values(F.col("cell"))))
        values = long.select(
            "graph_id",
            "id",
            "prop",
            "is_ref",
            F.posexplode(F.coalesce(listed, F.array("cell"))).alias("at", "item"),
        )
        props.append(
            values.select(
                "graph_id",
                "id",
                "prop",
                F.col("at").cast("bigint").alias("pos"),
                F.when(~F.col("is_ref"), F.col("item")).alias("value"),
                F.when(F.col("is_ref"), F.col("item")).alias("ref"),
            ).select(*PROP_COLS)
        )
        if sheet_type:
            nodes.append(
                sheet.select("graph_id", "id").distinct().withColumns(
                    {"type": F.lit(kind), "pos": F.lit(0)}
                ).select(*NODE_COLS)
            )
    # an entity of several types stands on several sheets, with the same cells
    return {
        "nodes": union_all(nodes) if nodes else None,
        "props": union_all(props).distinct() if len(props) > 1 else union_all(props),
    }


def catalog_records(records: DataFrame, source: str) -> DataFrame:
    """Reference records of one source, by code; none at all is an error."""
    kept = records.filter(F.col("source") == source)
    if kept.isEmpty():
        raise ValueError(f"the catalogue has no records of source {source!r}")
    return kept.orderBy("code")


def read_catalog(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A JSON array of records with ``source``, ``languageCode`` and ``name``."""
    records = spark.read.json(path, multiLine=True)
    return catalog_records(records.withColumnRenamed("languageCode", "code"), source)


def class_rules(inputs: DataFrame, long_texts: Sequence[str] = ()) -> DataFrame:
    """Class inputs (class, name, type, required, multiple, values) to rule rows.

    One row per accepted range type, with the kind of form field the input
    makes. Fixed ``Value`` inputs and structural properties are left out.
    """
    name, types = F.col("name"), F.col("type")
    entity = F.filter(types, lambda t: ~t.isin(SCALAR_TYPES))
    kind = (
        F.when(F.array_contains(types, "Date"), "date")
        .when(F.array_contains(types, "URL"), "url")
        .when(F.size(F.coalesce("values", F.array().cast("array<string>"))) > 0, "select")
        .when(F.size(entity) > 0, "entity-ref")
        .when(name.isin(list(long_texts)), "textarea")
        .otherwise("text")
    )
    return (
        inputs.filter(~F.array_contains(types, "Value") & ~name.isin(STRUCTURAL_PROPERTIES))
        .select(
            "class",
            name.alias("prop"),
            F.explode_outer(types).alias("range_type"),
            F.coalesce(F.col("required").cast("int"), F.lit(0)).alias("required"),
            F.coalesce(F.col("multiple").cast("int"), F.lit(0)).alias("multiple"),
            kind.alias("kind"),
        )
    )


def read_rules(spark: SparkSession, path: str, long_texts: Sequence[str] = ()) -> DataFrame:
    """Rules from JSON lines, one class per line: ``{"name", "inputs": [...]}``."""
    schema = (
        "name string, inputs array<struct<name string, type array<string>, required boolean, "
        "multiple boolean, `values` array<string>, help string>>"
    )
    classes = spark.read.schema(schema).json(path)
    return class_rules(classes.select(F.col("name").alias("class"), F.inline("inputs")), long_texts)
