"""Graphs written as creation statements, one a line, read and written in column functions.

    CREATE (a:gene {id: 'G1', gene_name: 'SFN', start: 17, synonyms: ['A', 'B']})
    MATCH (a:gene {id: 'G1'}), (b:transcript {id: 'T1'}) MERGE (a)-[r:transcribes_to {score: 0.5}]->(b);

``CREATE`` and ``MERGE`` mean the same here: of statements for one vertex, and for one edge, those later in the order
of files and lines give the properties that they name. A property's value is a quoted text (with backslash escapes), a number,
``true``, ``false``, ``null`` or a list of these; it is kept as JSON, so its type is. Files of nodes (``*nodes.cypher``) come
before files of edges (``*edges.cypher``); other files are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
_SCALAR = rf"(?:{_QUOTED}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)"
_LIST = rf"\[\s*(?:{_SCALAR}\s*(?:,\s*{_SCALAR}\s*)*)?\]"
_KEY = r"(?:\w+|`[^`]+`)"
_PAIR = rf"({_KEY})\s*:\s*({_SCALAR}|{_LIST})"
_MAP = rf"\{{\s*(?:{_PAIR.replace('(' + _KEY + ')', _KEY).replace('(' + _SCALAR, '(?:' + _SCALAR)}\s*,?\s*)*\}}"
_LABEL = rf"\s*:\s*({_KEY})\s*"
_NODE = rf"\(\s*(\w*){_LABEL}({_MAP})?\s*\)"
_END = r"\s*;?\s*$"
#: A map of nothing but an id, a text without escapes and control characters: its id needs no literal read.
_ID_ALONE = r"^\{\s*`?id`?\s*:\s*'([^'\\\x00-\x1f]+)'\s*,?\s*\}$"
_VERTEX = rf"(?i)^\s*(?:CREATE|MERGE)\s*{_NODE}{_END}"
_EDGE = rf"(?i)^\s*MATCH\s*{_NODE}\s*,\s*(?:MATCH\s*)?{_NODE}\s*(?:CREATE|MERGE)\s*\(\s*(\w+)\s*\)\s*-\s*\[\s*\w*{_LABEL}({_MAP})?\s*\]\s*->\s*\(\s*(\w+)\s*\){_END}"

#: Stands between the parts of a statement; in a text it is a blank.
_CUT = "\x01"


def _json(value: Column) -> Column:
    """A literal as JSON: quoted texts get double quotes and JSON's escapes."""
    items = F.regexp_extract_all(value, F.lit(rf"({_SCALAR})"), F.lit(1))

    def scalar(x: Column) -> Column:
        text = F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"(\\\\)|\\(['\"`])", "$1$2")
        text = F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
        return F.when(x.rlike(r"^['\"]"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(x)

    return F.when(value.startswith("["), F.concat(F.lit("["), F.array_join(F.transform(items, scalar), ","), F.lit("]"))).otherwise(scalar(value))


def _with_maps(frame: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """The frame with a map of names to JSON for each literal map; of a name given twice the last counts. Names and values
    are columns first, as an expression within a lambda would be evaluated for each item."""
    found = {}
    for name, text in texts.items():
        found[f"{name}_k"] = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), lambda k: F.translate(k, "`", ""))
        found[f"{name}_v"] = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)), _json)

    def one(name: str) -> Column:
        keys = F.col(f"{name}_k")
        last = F.filter(F.arrays_zip(keys.alias("k"), F.col(f"{name}_v").alias("v")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p.k))
        return F.map_from_entries(last)

    return frame.withColumns(found).withColumns({name: one(name) for name in texts})


def plain(value: Column) -> Column:
    """A property's JSON as text: a text without quotes, others as they are; a null is null."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(value != "null", value)


def parse_statements(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(kind, type, source_label, source, target_label, target, properties)`` and all other columns of ``lines``.

    ``kind`` is ``vertex``, ``edge``, or ``unknown`` for a line of neither form (also an edge between other variables than
    it matched, or an end without an id). ``properties`` maps names to JSON, without ``id``. Blank lines and ``//`` comments are skipped.
    """
    line = F.col(column)
    rows = lines.where(line.isNotNull() & ~line.rlike(r"^\s*(//.*)?$"))
    clean = F.translate(line, _CUT, " ")
    # one replacement finds a form and cuts it to its parts; a line of another form stays one part
    parts = lambda pattern, groups: F.split(F.regexp_replace(clean, pattern, _CUT.join(["", *[f"${g}" for g in groups]])), _CUT)
    matches = line.rlike(r"(?i)^\s*MATCH")  # a line is looked through for the one form that its first word may begin
    cut = rows.withColumns({"__v": F.when(~matches, parts(_VERTEX, (2, 3))), "__e": F.when(matches, parts(_EDGE, range(1, 11)))})
    sized = lambda c, n: F.coalesce(F.size(c) == n, F.lit(False))
    is_vertex, is_edge = sized("__v", 3), sized("__e", 11)
    e = lambda n: F.col("__e")[n]
    # an edge's ends mostly have an id alone, which is cut out; other maps are read
    alone = lambda n: F.when(is_edge, F.nullif(F.regexp_extract(e(n), _ID_ALONE, 1), F.lit("")))
    cut = cut.withColumns({"__id1": alone(3), "__id2": alone(6)})
    rest = lambda n, id_: F.when(is_edge & F.col(id_).isNull(), e(n))
    held = _with_maps(cut, {"__one": F.when(is_vertex, F.col("__v")[2]).otherwise(rest(3, "__id1")), "__two": rest(6, "__id2"), "__own": F.when(is_edge, e(9))})
    bare = lambda c: F.translate(c, "`", "")
    one, two = (bare(e(2)), F.coalesce("__id1", plain(F.element_at("__one", "id")))), (bare(e(5)), F.coalesce("__id2", plain(F.element_at("__two", "id"))))
    straight, back = (e(7) == e(1)) & (e(10) == e(4)), (e(7) == e(4)) & (e(10) == e(1))
    turned = lambda i: (F.when(straight, one[i]).otherwise(two[i]), F.when(straight, two[i]).otherwise(one[i]))
    edge = is_edge & (straight | back) & one[1].isNotNull() & two[1].isNotNull()
    kind = F.when(is_vertex & one[1].isNotNull(), "vertex").when(edge, "edge").otherwise("unknown")
    only = lambda k, c: F.when(F.col("kind") == k, c)
    found = F.struct(
        "kind",
        only("edge", bare(e(8))).alias("type"),
        F.coalesce(only("vertex", bare(F.col("__v")[1])), only("edge", turned(0)[0])).alias("source_label"),
        F.coalesce(only("vertex", one[1]), only("edge", turned(1)[0])).alias("source"),
        only("edge", turned(0)[1]).alias("target_label"),
        only("edge", turned(1)[1]).alias("target"),
        F.coalesce(only("vertex", F.map_filter("__one", lambda k, v: k != "id")), only("edge", F.col("__own"))).alias("properties"),
    )
    # a generator keeps a later filter from being pushed down and so from parsing each line once for every condition
    return held.withColumn("kind", kind).select(*[c for c in lines.columns if c != column], F.inline(F.array(found)))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """The statements of all scripts below ``path`` with ``file``, ``block`` and ``line`` (numbers that grow within a file); a path without
    scripts is a ``ValueError``. Edges of edge files whose ends no node file makes are the caller's to drop, as joins do."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{nodes,edges}.cypher").text(path)
    except AnalysisException as e:
        raise ValueError(f"no data at '{path}'") from e
    if not lines.inputFiles():
        raise ValueError(f"no scripts at '{path}'")
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = parse_statements(placed)
    of_nodes = F.col("file").endswith("nodes.cypher")
    return parsed.where((F.col("kind") == "unknown") | ((F.col("kind") == "vertex") == of_nodes))


def vertices_of(statements: DataFrame, label: str, properties: dict[str, str]) -> DataFrame:
    """One label's vertices ``id`` and the named properties, each cast to the given type (lists are arrays of it:
    ``array<...>``); of several statements for a vertex the last that names a property counts."""
    own = statements.where((F.col("kind") == "vertex") & (F.col("source_label") == label))
    return own.groupBy(F.col("source").alias("id")).agg(*_latest(statements, properties))


def edges_of(statements: DataFrame, source: str, name: str, target: str, properties: dict[str, str] | None = None) -> DataFrame:
    """One triple's edges ``src, dst, uid`` and the named properties, as ``vertices_of`` takes them."""
    own = statements.where((F.col("kind") == "edge") & (F.col("type") == name) & (F.col("source_label") == source) & (F.col("target_label") == target))
    keys = [F.col("source").alias("src"), F.col("target").alias("dst")]
    values = _latest(statements, properties or {})
    rows = own.groupBy(*keys).agg(*values) if values else own.select(*keys).distinct()
    return rows.withColumn("uid", F.xxhash64("src", F.lit(name), "dst"))


def _latest(statements: DataFrame, properties: dict[str, str]) -> list[Column]:
    order = F.struct(*[F.col(c) for c in ("file", "block", "line") if c in statements.columns], F.col("properties").cast("string"))
    out = []
    for p, kind in properties.items():
        value = F.element_at("properties", p)
        held = F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))
        out.append((F.from_json(held, kind) if kind.startswith("array") else plain(held).try_cast(kind)).alias(p))
    return out


def _literal(value: Column, kind: str) -> Column:
    quoted = lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    if kind == "string":
        return quoted(value)
    if kind.startswith("array"):
        item = kind.removeprefix("array<").removesuffix(">")
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(quoted(x) if item == "string" else x.cast("string"), F.lit("null"))), ", "), F.lit("]"))
    return value.cast("string")


def statements_of(frame: DataFrame, label: str | tuple[str, str, str]) -> DataFrame:
    """``(value)``: a line for each vertex of a label's frame, or for each edge of a triple's; null properties are left out.
    Line breaks in texts aren't expressible in a line and become blanks."""
    kinds = dict(frame.dtypes)
    pair = lambda c, name=None: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"`{name or c}`: "), _literal(F.col(f"`{c}`"), kinds[c])))
    text = lambda c: F.concat(F.lit("{id: "), _literal(F.col(c).cast("string"), "string"), F.lit("}"))
    if isinstance(label, str):
        pairs = F.concat_ws(", ", F.concat(F.lit("id: "), _literal(F.col("id").cast("string"), "string")), *[pair(c) for c in frame.columns if c != "id"])
        line = F.concat(F.lit(f"CREATE (a:`{label}` {{"), pairs, F.lit("})"))
    else:
        source, name, target = label
        own = F.concat_ws(", ", *[pair(c) for c in frame.columns if c not in ("src", "dst", "uid")])
        line = F.concat(F.lit(f"MATCH (a:`{source}` "), text("src"), F.lit(f"), (b:`{target}` "), text("dst"), F.lit(f") MERGE (a)-[r:`{name}` {{"), own, F.lit("}]->(b)"))
    return frame.select(F.translate(line, "\n\r", "  ").alias("value"))
