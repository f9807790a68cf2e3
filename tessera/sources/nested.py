"""Mask stacks inside nested documents: JSON or VARIANT, the safe stand-in for pickled objects [O-05].

A document is walked level by level. An array of two or three axes of numbers is a candidate; of several the one that a search
meets first counts: in objects the preferred keys in their order (in any case), then the other keys by name; in lists item by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written_once

#: Keys under which a stack is looked for first, in this order.
PREFERRED = ("Final_tracked_tensor", "tracked_masks", "tracked_mask", "track_masks", "mask_stack", "label_stack", "labels", "masks", "tracks", "seg", "data", "array", "arr")
_STACK = r"^ARRAY<(ARRAY<){1,2}(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>+$"
_OPEN = r"^(OBJECT<|ARRAY<(OBJECT|ARRAY|VARIANT))"
_LIMIT = 65535
#: Levels that one pass of the search for stacks goes down before its state is written.
LEVELS = 6
#: Characters of stacks that one task turns into pixels.
CHARACTERS_EACH = 16 << 20


def _typed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with what each is: its schema, whether it is a stack, and whether there is anything to walk into."""
    out = nodes.withColumn("schema", F.schema_of_variant("v"))
    return out.withColumns({"stack": F.col("schema").rlike(_STACK), "open": F.col("schema").rlike(_OPEN)})


def _below(above: str, place: str, pos: str, key: str) -> tuple[Column, Column]:
    """The name of a node under ``above``, and its place in the search."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(PREFERRED):
        rank = F.when(F.lower(key) == name.lower(), F.lit(i)).otherwise(rank)
    step = F.coalesce(rank, F.lit(len(PREFERRED)) + F.col(pos))
    name = F.concat(above, F.when(F.col(key).isNull(), F.concat(F.lit("["), F.col(pos).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col(key))))
    return name, F.concat(place, F.array(step))


def _children(nodes: DataFrame) -> DataFrame:
    """What the open nodes hold, each with its place in the search."""
    spark = nodes.sparkSession
    held = spark.sql("SELECT n.path, n.key AS above, n.place, t.pos, t.key, t.value AS v FROM {nodes} n, LATERAL variant_explode(n.v) t", nodes=nodes.select("path", "key", "place", "v"))
    name, place = _below("above", "place", "pos", "key")
    return held.select("path", name.alias("key"), place.alias("place"), "v")


def _root(documents: DataFrame, body: str) -> Column:
    return F.col(body) if documents.schema[body].dataType.typeName() == "variant" else F.try_parse_json(body)


def walk(documents: DataFrame, body: str = "body", into_stacks: bool = False) -> DataFrame:
    """(path, key, place, v, schema, stack, open): every node of every document (path, body) down to stacks and scalars.

    ``body`` is JSON text or a VARIANT; text that isn't JSON and null bodies give no nodes. As many passes as the deepest
    document has levels, each written once.
    """
    level = documents.select("path", F.lit("$").alias("key"), F.array().cast("array<int>").alias("place"), _root(documents, body).alias("v")).filter("v is not null")
    out = None
    while True:
        level = written_once(_typed(level), "nested", wide=True)
        out = level if out is None else out.unionByName(level)
        inner = level.filter("open" if into_stacks else "open and not stack")
        if inner.isEmpty():
            return out
        level = _children(inner)


def describe(documents: DataFrame, body: str = "body") -> DataFrame:
    """(path, key, schema) of every node, for documents whose stack isn't found: what there is to choose from."""
    return walk(documents, body).select("path", "key", "schema")


def _axis(shape: list[Column], wanted: str) -> Column:
    """The axis that frames lie along: 'first', 'last', or 'auto' as ``frames.time_axis`` has it."""
    if wanted in ("first", "last"):
        return F.lit(0 if wanted == "first" else 2)
    a, b, c = shape
    least = F.when((a <= b) & (a <= c), 0).when(b <= c, 1).otherwise(2)
    small = F.least(a, b, c) * 2
    fits = F.when(least == 0, (small <= b) & (small <= c)).when(least == 1, (small <= a) & (small <= c)).otherwise((small <= a) & (small <= b))
    return F.when(fits, least).otherwise(F.lit(2))


def _kind(v: str) -> Column:
    """The schema of an array without objects, as far as a stack can be one; of other nodes only that there is something to walk into."""
    is_object = F.expr(f"try_variant_get({v}, '$', 'map<string,boolean>')").isNotNull()
    holds_objects = F.exists(F.expr(f"try_variant_get({v}, '$', 'array<map<string,boolean>>')"), lambda x: x.isNotNull())
    return F.when(is_object, "OBJECT<>").when(holds_objects, "ARRAY<VARIANT>").otherwise(F.schema_of_variant(v))


def _one_level(nodes: DataFrame) -> DataFrame:
    """``nodes`` (path, key, place, v, schema) with what the open ones hold in their stead. Stacks and rows without a place stay."""
    spark = nodes.sparkSession
    inner = nodes.withColumn("inner", F.when(F.col("schema").rlike(_OPEN) & ~F.col("schema").rlike(_STACK), F.col("v")))
    held = spark.sql("SELECT n.path, n.key AS above, n.place, n.v, n.schema, t.pos, t.key, t.value FROM {nodes} n, LATERAL variant_explode_outer(n.inner) t", nodes=inner)
    child = F.col("pos").isNotNull()
    held = held.filter(child | F.col("place").isNull() | F.col("schema").rlike(_STACK))
    either = lambda new, old: F.when(child, new).otherwise(F.col(old))
    name, place = _below("above", "place", "pos", "key")
    held = held.select("path", either(name, "above").alias("key"), either(place, "place").alias("place"), either(F.col("value"), "v").alias("v"), "schema", child.alias("child"))
    return held.withColumn("schema", F.when(F.col("child"), _kind("v")).otherwise(F.col("schema"))).drop("child")


def _stacks(documents: DataFrame, body: str) -> tuple[DataFrame, int]:
    """(path, key, place, schema, text, ...): the stacks of each document as JSON text, and a row without a place for each document; the characters of all.

    ``LEVELS`` levels are walked in one pass over the documents, as a stream of nodes; only what lies deeper is walked again.
    """
    # the row without a place tells a document without a stack from none
    rows = documents.select("path", F.col(body).alias("body"), F.explode(F.array(F.lit(False), F.lit(True))).alias("inside"))
    nodes = rows.select(
        "path",
        F.when(F.col("inside"), "$").alias("key"),
        F.when(F.col("inside"), F.array().cast("array<int>")).alias("place"),
        F.when(F.col("inside"), _root(rows, "body")).alias("v"),
    ).withColumn("schema", _kind("v"))
    out, chars = None, 0
    while True:
        for _ in range(LEVELS):
            nodes = _one_level(nodes)
        stack = F.coalesce(F.col("schema").rlike(_STACK), F.lit(False))
        held = nodes.filter(F.col("place").isNull() | F.col("schema").rlike(_OPEN)).withColumns({"deeper": ~stack & F.col("place").isNotNull(), "text": F.when(stack, F.to_json("v"))})
        held = held.withColumns({"chars": F.length("text"), "v": F.when(F.col("deeper"), F.col("v"))})
        written = written_once(held, "nested", wide=True)
        out = written if out is None else out.unionByName(written)
        deeper, more = written.agg(F.max("deeper"), F.sum("chars")).first()
        chars += more or 0
        if not deeper:
            return out, chars
        nodes = written.filter("deeper").select("path", "key", "place", "v", "schema")


def nested_stacks(documents: DataFrame, body: str = "body", time_axis: str = "first") -> DataFrame:
    """(path, key, frame, y, x, label, problem): labelled pixels of the stack found in each document [O-05, O-08, O-136].

    A single mask is frame 0. Documents without a stack, with labels that aren't whole numbers from 0 to 65535, or that can't be read are one
    row with the ``problem``; stacks without labelled pixels give no rows.
    """
    stacks, chars = _stacks(documents, body)
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, chars // CHARACTERS_EACH)
    one = ~F.col("schema").startswith("ARRAY<ARRAY<ARRAY<")
    # by number, as tasks aren't to be merged by the few bytes that text of zeros shuffles
    found = stacks.repartition(tasks, "path").groupBy("path").agg(F.min_by(F.struct("key", "text", one.alias("one")), F.when(F.col("text").isNotNull(), F.col("place"))).alias("s"))
    stack = F.when(F.col("s.one"), F.array(F.from_json("s.text", "array<array<double>>"))).otherwise(F.from_json("s.text", "array<array<array<double>>>"))
    found = found.select("path", F.col("s.key").alias("key"), F.col("s.one").alias("one"), stack.alias("a"))
    shape = [F.size("a"), F.size(F.col("a")[0]), F.size(F.col("a")[0][0])]
    axis = F.when(F.col("one"), F.lit(0)).otherwise(_axis(shape, time_axis))
    fine = lambda v: v.isNotNull() & (v == F.floor(v)) & v.between(0, _LIMIT)
    good = F.coalesce(F.forall("a", lambda p: F.forall(p, lambda r: F.forall(F.array_distinct(r), fine))), F.lit(False))
    found = found.select("path", "key", "a", axis.alias("axis"), good.alias("good"))
    problem = F.when(F.col("key").isNull(), "no stack found").when(~F.col("good"), "labels must be whole numbers from 0 to 65535")
    # outer, as a filter of empty arrays would read the text again
    planes = found.select("path", "key", "axis", problem.alias("problem"), F.posexplode_outer(F.when(F.col("good"), F.col("a"))).alias("i", "plane"))
    lines = planes.select("path", "key", "axis", "problem", "i", F.posexplode_outer("plane").alias("j", "line"))
    cells = lines.select("path", "key", "axis", "problem", "i", "j", F.posexplode_outer("line").alias("k", "label")).filter("label <> 0 or problem is not null")
    frame = F.when(F.col("axis") == 0, F.col("i")).when(F.col("axis") == 1, F.col("j")).otherwise(F.col("k"))
    y, x = F.when(F.col("axis") == 0, F.col("j")).otherwise(F.col("i")), F.when(F.col("axis") == 2, F.col("j")).otherwise(F.col("k"))
    return cells.select("path", "key", frame.alias("frame"), y.alias("y"), x.alias("x"), F.col("label").cast("int").alias("label"), "problem")
