"""Graph tables to one wide sheet per type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.scale import scratch_folder

CELL = 32_767  # characters that spreadsheet programs take in a cell


def _entries(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Values with the type of their entity and the column they stand in."""
    types = nodes.select("graph_id", "id", "type").distinct()
    column = F.when(F.col("ref").isNotNull(), F.concat(F.lit("@"), "prop")).otherwise(F.col("prop"))
    return props.withColumn("column", column).join(types, ["graph_id", "id"])


def sheet_columns(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """The columns in use of all types at once: (type, column, values)."""
    return _entries(nodes, props).groupBy("type", "column").agg(F.count("*").alias("values"))


def column_sizes(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """What each column would hold: (type, column, entities, longest, characters).

    ``longest`` is the most values that one entity has there, ``characters``
    the most that their texts take together. Counted per entity before they
    are compared, and no list is built.
    """
    length = F.length(F.coalesce("ref", "value"))
    per_entity = (
        _entries(nodes, props)
        .groupBy("type", "column", "graph_id", "id")
        .agg(F.count("*").alias("values"), F.coalesce(F.sum(length), F.lit(0)).alias("characters"))
    )
    return per_entity.groupBy("type", "column").agg(
        F.count("*").alias("entities"), F.max("values").alias("longest"), F.max("characters").alias("characters")
    )


def fitting_columns(sizes: DataFrame, cell: int = CELL) -> dict[str, list[str]]:
    """The columns of each type that a sheet can hold, by name, from :func:`column_sizes`.

    A name or two per property of the vocabulary in use; the values of the
    others go to the table ``others``.
    """
    fit = sizes.filter(F.col("characters") + 4 * F.col("longest") <= cell).orderBy("type", "column")
    columns: dict[str, list[str]] = {}
    for r in fit.select("type", "column").collect():
        columns.setdefault(r["type"], []).append(r["column"])
    return columns


def graph_to_sheet(nodes: DataFrame, props: DataFrame, type: str, columns: Sequence[str]) -> DataFrame:
    """Entities of a type, wide: graph_id, id and the named columns.

    References of ``x`` stand in column ``@x``. Several values form a JSON
    list, and so does a blank one, to differ from an absent one. A cell holds
    the whole list of an entity, as a sheet must; lists too long for a cell
    are left out of ``columns`` and stay in :func:`other_values`.
    :func:`cairn.sources.tables.sheets_to_graph` reads it all back.
    """
    of_type = nodes.filter(F.col("type") == type)
    entries = _entries(of_type, props).filter(F.col("column").isin(list(columns)))
    return _wide(of_type, _cells(entries), columns)


def _cells(entries: DataFrame) -> DataFrame:
    """A row per cell: type, graph_id, id, column, cell."""
    items = F.collect_list(F.struct("pos", F.coalesce("ref", "value").alias("text")))
    texts = F.transform(F.array_sort(items), lambda x: x["text"])
    single = F.get(texts, F.lit(0))
    plain = (F.size(texts) == 1) & ~single.startswith("[") & (single != "")
    return entries.groupBy("type", "graph_id", "id", "column").agg(F.when(plain, single).otherwise(F.to_json(texts)).alias("cell"))


def _wide(of_type: DataFrame, cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per entity of a type, a column per name."""
    everyone = of_type.select("graph_id", "id").distinct()
    filled = cells.select("graph_id", "id", "column", "cell").unionByName(everyone, allowMissingColumns=True)
    named = [F.max(F.when(F.col("column") == n, F.col("cell"))).alias(n) for n in columns]
    return filled.groupBy("graph_id", "id").agg(*named)


def other_values(nodes: DataFrame, props: DataFrame, type: str, columns: Sequence[str]) -> DataFrame:
    """Values of a type that stand in none of the columns, long: graph_id, id, column, pos, value, ref."""
    rest = _entries(nodes.filter(F.col("type") == type), props).filter(~F.col("column").isin(list(columns)))
    return rest.select("graph_id", "id", "column", "pos", "value", "ref")


def write_sheets(
    nodes: DataFrame, props: DataFrame, columns: Mapping[str, Sequence[str]], path: str, mode: str = "overwrite"
) -> None:
    """A CSV folder per type with the named columns, and one with all values that no column holds.

    The values are read twice however many types there are: once for the cells
    of all types, which are staged in a folder per type that the type's sheet
    reads alone, and once for the others.
    """
    known = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).alias("column")) for t, names in columns.items() for c in names])
    entries = _entries(nodes.filter(F.col("type").isin(list(columns))), props)
    in_a_column = F.array_contains(known, F.struct("type", "column"))
    cells, folder = _cells(entries.filter(in_a_column)), scratch_folder(nodes.sparkSession)
    cells.write.partitionBy("type").parquet(folder)
    by_type = nodes.sparkSession.read.schema(cells.schema).parquet(folder)
    for kind, names in columns.items():
        of_type = F.col("type") == kind
        wide = _wide(nodes.filter(of_type), by_type.filter(of_type), names)
        wide.write.mode(mode).csv(f"{path}/type={kind}", header=True, escape='"')
    rest = entries.filter(~in_a_column)
    rest.select("graph_id", "id", "type", "column", "pos", "value", "ref").write.mode(mode).csv(f"{path}/others", header=True, escape='"')
