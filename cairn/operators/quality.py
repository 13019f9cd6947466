"""Checking graphs against a rule table, and for loose ends.

``rules`` is (class, prop, range_type, required, multiple, min_instances), one
row per accepted range type. ``min_instances`` says how many entities of the
class every graph must have; null, 0 and an absent column ask for none. Every
check returns one row per finding; checks advise and never stop a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.model import PROP_COLS, entity_ids, union_all
from cairn.plans.scale import scattered, staged

# References to outside things that no entity describes.
EXTERNAL_PROPS = ["license", "conformsTo", "encodingFormat"]

# Types whose entities define vocabulary.
VOCABULARY_TYPES = ["rdf:Property", "rdfs:Class"]

# Range types that a literal can fit.
SCALAR_TYPES = ["Text", "Date", "DateTime", "Integer", "Number", "Boolean", "URL"]

PIECE = 4096  # not used any more: the report judges a value per row


def check_cardinality(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """Required properties that are absent, single ones that have several values.

    Rows (graph_id, id, class, prop, problem, found).
    """
    # rules name few properties, so they narrow the values before they are counted
    ruled = props.join(_bounds(rules).select("prop").distinct(), "prop", "left_semi")
    return _wrong_counts(nodes, rules, ruled.groupBy("graph_id", "id", "prop").agg(F.count("*").alias("found")))


def _bounds(rules: DataFrame) -> DataFrame:
    """The rules that bound the number of values: class, prop, required, multiple."""
    return (
        rules.groupBy("class", "prop")
        .agg(F.max("required").alias("required"), F.max("multiple").alias("multiple"))
        .filter("required = 1 OR multiple = 0")
    )


def _wrong_counts(nodes: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    due = nodes.select("graph_id", "id", F.col("type").alias("class")).distinct().join(_bounds(rules), "class")
    checked = due.join(counts, ["graph_id", "id", "prop"], "left").withColumn(
        "found", F.coalesce("found", F.lit(0))
    )
    problem = F.when((F.col("required") == 1) & (F.col("found") == 0), "missing").when(
        (F.col("multiple") == 0) & (F.col("found") > 1), "several"
    )
    return (
        checked.withColumn("problem", problem)
        .filter("problem IS NOT NULL")
        .select("graph_id", "id", "class", "prop", "problem", "found")
    )


def check_instances(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Classes of which a graph has too few entities: (graph_id, class, found, wanted).

    Only classes with a minimum are asked of every graph.
    """
    least = F.col("min_instances") if "min_instances" in rules.columns else F.lit(0)
    minimum = rules.groupBy("class").agg(F.max(least).alias("wanted")).filter("wanted > 0")
    # the classes of a hand-written table, as one value
    listed = minimum.agg(F.array_sort(F.collect_list(F.struct("class", "wanted"))).alias("listed"))
    due = nodes.select("graph_id").distinct().select("graph_id", F.inline(listed.scalar()))
    present = nodes.select("graph_id", "id", F.col("type").alias("class")).distinct()
    counts = present.groupBy("graph_id", "class").agg(F.count("*").alias("found"))
    return (
        due.join(counts, ["graph_id", "class"], "left")
        .select("graph_id", "class", F.coalesce("found", F.lit(0)).alias("found"), F.col("wanted").cast("bigint").alias("wanted"))
        .filter("found < wanted")
    )


def _mask(ranges: Column) -> Column:
    """The scalar types among range types, a bit each."""
    return sum((F.when(F.array_contains(ranges, name), 1 << i).otherwise(0) for i, name in enumerate(SCALAR_TYPES)), F.lit(0))


def _fitted(value: Column, ref: Column, wanted: Column) -> Column:
    """Those of the ``wanted`` scalar types that a value fits by itself: a literal by its form, a reference as ``URL``.

    A null literal passes every type. Bits rather than lists keep this in generated code.
    """
    date = value.rlike(r"^\d{4}-\d{2}-\d{2}\z") & value.try_cast("date").isNotNull()
    short_date = value.rlike(r"^\d{4}(-(0[1-9]|1[0-2]))?\z")
    moment = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & value.try_cast("timestamp").isNotNull()
    number = value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z")
    forms = {
        "Text": F.lit(True),
        "Date": date | short_date,
        "DateTime": moment,
        "Integer": value.rlike(r"^[+-]?\d+\z"),
        "Number": number,
        "Boolean": value.isin("true", "false"),
        "URL": _is_url(value),
    }

    def passing(name: str, form: Column) -> Column:
        # a form is only looked at where a rule asks for it
        bit = 1 << SCALAR_TYPES.index(name)
        return F.when((F.coalesce(wanted, F.lit(0)).bitwiseAND(bit) != 0) & form, bit).otherwise(0)

    literal = sum((passing(name, forms[name]) for name in SCALAR_TYPES), F.lit(0))
    return (
        F.when(ref.isNotNull(), passing("URL", _is_url(ref)))
        .when(value.isNull(), (1 << len(SCALAR_TYPES)) - 1)
        .otherwise(literal)
    )


def _is_url(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+\z")


def check_ranges(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """Values that fit none of the range types their class allows.

    A literal fits a scalar type; a reference fits ``URL`` if it reads as one,
    and a class if the entity it names has that type. Rows (graph_id, id,
    class, prop, pos, value, ref).
    """
    allowed = rules.groupBy("class", "prop").agg(F.sort_array(F.collect_set("range_type")).alias("ranges"))
    classes = nodes.select("graph_id", "id", F.col("type").alias("class")).distinct()
    allowed = allowed.withColumn("mask", _mask(F.col("ranges")))
    # values that fit what every class accepts are settled before the big joins
    masks = allowed.groupBy("prop").agg(F.bit_or("mask").alias("some"), F.bit_and("mask").alias("all"))
    doubtful = (
        props.join(masks, "prop")
        .withColumn("fits", _fitted(F.col("value"), F.col("ref"), F.col("some")))
        .filter(F.col("fits").bitwiseAND(F.col("all")) == 0)
        .select(*PROP_COLS, "fits")
    )
    graded = doubtful.join(classes, ["graph_id", "id"]).join(allowed, ["class", "prop"])
    graded = graded.filter(F.col("mask").bitwiseAND(F.col("fits")) == 0)
    targets = nodes.groupBy("graph_id", F.col("id").alias("_target")).agg(
        F.collect_set("type").alias("types")  # types of one entity
    )
    met = graded.withColumn("_target", scattered(F.col("ref"), F.col("ref").isNotNull(), "id", "prop", "pos")).join(
        targets, ["graph_id", "_target"], "left"
    )
    named = F.col("ref").isNotNull() & F.coalesce(F.arrays_overlap("ranges", "types"), F.lit(False))
    return met.filter(~named).select("graph_id", "id", "class", "prop", "pos", "value", "ref")


def dangling_refs(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """References to ids nobody describes: (graph_id, id, prop, ref)."""
    refs = props.filter(F.col("ref").isNotNull() & ~F.col("prop").isin(EXTERNAL_PROPS))
    known = entity_ids(nodes).withColumnRenamed("id", "ref")
    return refs.join(known, ["graph_id", "ref"], "left_anti").select("graph_id", "id", "prop", "ref")


def unknown_properties(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """Properties no rule mentions, on entities that are data: (graph_id, id, prop)."""
    vocabulary = entity_ids(nodes.filter(F.col("type").isin(VOCABULARY_TYPES)))
    return (
        props.select("graph_id", "id", "prop")
        .join(rules.select("prop").distinct(), "prop", "left_anti")
        .distinct()
        .join(vocabulary, ["graph_id", "id"], "left_anti")
        .select("graph_id", "id", "prop")
    )


def root_class(root_types: DataFrame, rules: DataFrame) -> DataFrame:
    """The first type of each root that the rules define, else an error text.

    ``root_types`` is (graph_id, pos, type); rows (graph_id, class, error).
    """
    classes = rules.select(F.col("class").alias("type"), F.lit(True).alias("known")).distinct()
    listed = rules.agg(F.array_join(F.array_sort(F.collect_set("class")), ", ").alias("listed"))
    # the types of one root
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]), ", ")
    per_graph = root_types.join(classes, "type", "left").groupBy("graph_id").agg(
        F.min_by("type", F.when(F.col("known"), F.col("pos"))).alias("first"),
        F.coalesce(F.max("known"), F.lit(False)).alias("any_known"),
        named.alias("named"),
    )
    text = F.concat(
        F.lit("root types ["), "named", F.lit("] match no class of the rules ["), listed.scalar(), F.lit("]")
    )
    return per_graph.select(
        "graph_id",
        F.when(F.col("any_known"), F.col("first")).alias("class"),
        F.when(~F.col("any_known"), text).alias("error"),
    )


def judged(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """What one pass over the values tells: graph_id, id, prop, unknown, findings.

    The rules are compiled to a map per property, from class to accepted
    ranges, so a value meets them, the types of its entity and those of what it
    names in one row each. A value that fits what every class accepts, names
    nothing and is of a known property has nothing to tell and goes before the joins.
    """
    ranges = rules.groupBy("prop", "class").agg(F.sort_array(F.collect_set("range_type")).alias("ranges"))
    # the classes of a hand-written table
    mask = _mask(F.col("ranges"))
    entry = F.when(F.col("class").isNotNull(), F.struct("class", F.struct("ranges", mask.alias("mask"))))
    compiled = ranges.groupBy("prop").agg(
        F.map_from_entries(F.collect_list(entry)).alias("ruled"), F.bit_or(mask).alias("some"), F.bit_and(mask).alias("all")
    )
    types = nodes.groupBy("graph_id", "id").agg(F.collect_set("type").alias("types"))  # types of one entity
    targets = types.select("graph_id", F.col("id").alias("_target"), F.col("types").alias("target"))
    is_ref = F.col("ref").isNotNull()
    doubted = F.coalesce(F.col("fits").bitwiseAND(F.col("all")) == 0, F.lit(False))
    told = (
        props.join(compiled, "prop", "left")
        .withColumn("fits", _fitted(F.col("value"), F.col("ref"), F.col("some")))
        .withColumns({"unruled": F.col("ruled").isNull(), "doubted": doubted, "inner": is_ref & ~F.coalesce(F.col("prop").isin(EXTERNAL_PROPS), F.lit(True))})
        .filter("unruled OR doubted OR inner")
        .select(
            "graph_id",
            "id",
            "prop",
            "pos",
            "ref",
            "unruled",
            "inner",
            F.when(F.col("doubted"), F.col("ruled")).alias("ruled"),
            F.when(F.col("doubted"), F.col("fits")).alias("fits"),
            F.when(F.col("doubted"), F.coalesce("value", "ref")).alias("detail"),
        )
    )
    met = (
        told.join(types, ["graph_id", "id"], "left")
        .withColumn("_target", scattered(F.col("ref"), is_ref, "id", "prop", "pos"))
        .join(targets, ["graph_id", "_target"], "left")
    )

    def misfit(kind):
        wanted = F.col("ruled")[kind]
        named = is_ref & F.coalesce(F.arrays_overlap(wanted["ranges"], "target"), F.lit(False))
        return F.coalesce(wanted.isNotNull() & (wanted["mask"].bitwiseAND(F.col("fits")) == 0) & ~named, F.lit(False))

    def finding(severity, check, detail):
        return F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), detail.alias("detail"))

    misfits = F.transform(F.filter("types", misfit), lambda _: finding("error", "range", F.col("detail")))
    loose = F.col("inner") & F.col("target").isNull()
    no_finding = F.slice(F.array(finding("", "", F.lit("").cast("string"))), 1, 0)
    findings = F.concat(
        F.when(F.col("ruled").isNotNull(), F.coalesce(misfits, no_finding)).otherwise(no_finding),
        F.when(loose, F.array(finding("warning", "dangling", F.col("ref")))).otherwise(no_finding),
    )
    vocabulary = F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, VOCABULARY_TYPES))), F.lit(False))
    return met.select("graph_id", "id", "prop", (F.col("unruled") & ~vocabulary).alias("unknown"), findings.alias("findings"))


def quality_report(nodes: DataFrame, props: DataFrame, rules: DataFrame) -> DataFrame:
    """All findings in one table: (graph_id, severity, check, id, prop, detail).

    What the values tell is staged and serves three checks; the number of
    values needs none of it and is counted by itself.
    """
    told = staged(judged(nodes, props, rules).filter("unknown OR size(findings) > 0"))
    unknown = told.filter("unknown").select("graph_id", "id", "prop").distinct()

    def findings(df, severity, check, id, prop, detail):
        return df.select(
            "graph_id",
            F.lit(severity).alias("severity"),
            F.lit(check).alias("check"),
            id.alias("id"),
            prop.alias("prop"),
            detail.cast("string").alias("detail"),
        )

    none = F.lit(None).cast("string")
    id, prop = F.col("id"), F.col("prop")
    of_values = told.select("graph_id", "id", "prop", F.inline("findings"))
    parts = [
        of_values.select("graph_id", "severity", "check", "id", "prop", "detail"),
        findings(check_cardinality(nodes, props, rules), "error", "cardinality", id, prop, F.col("problem")),
        findings(unknown, "warning", "unknown", id, prop, none),
        findings(check_instances(nodes, rules), "error", "instances", none, none, F.col("class")),
    ]
    return union_all(parts)


def quality_summary(report: DataFrame, roots: DataFrame) -> DataFrame:
    """Errors and warnings per graph, and whether it passes: no errors."""
    counts = report.groupBy("graph_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return (
        roots.select("graph_id")
        .join(counts, "graph_id", "left")
        .select(
            "graph_id",
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.coalesce("warnings", F.lit(0)).alias("warnings"),
            (F.coalesce("errors", F.lit(0)) == 0).cast("int").alias("passed"),
        )
    )
