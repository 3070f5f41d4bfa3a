"""Titles, descriptions and durations as columns, and the title of a request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.plans.model import EdgePattern, NodePattern, QueryGraph


def duration_text(ms: Column) -> Column:
    """Whole milliseconds as ``ms``, ``sec``, ``min`` or ``hr``, but for the first with two decimals,
    which are rounded from the exact value, half up."""

    def two(unit: int, name: str) -> Column:
        hundredths = F.floor((ms * 200 + unit) / F.lit(2 * unit)).cast("long")
        return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {name}"))

    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60_000, two(1000, "sec")).when(ms < 3_600_000, two(60_000, "min")).when(ms.isNotNull(), two(3_600_000, "hr"))


def middle(edge_id: Column) -> Column:
    """An edge id without its first and last part."""
    parts = F.split(edge_id, "_")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def edge_sentence(source_name: Column, verb: Column, target_name: Column) -> Column:
    """``source verb target``, the verb's underscores as blanks, capitalised."""
    return capitalised(F.concat_ws(" ", source_name, F.translate(verb, "_", " "), target_name))


def description(columns: Sequence[str]) -> Column:
    """``Key: value | Key: value`` of the columns that are set; arrays show their first three items."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.capitalize()}: "), F.col(c).cast("string"))) for c in columns])


def list_description(key: str, values: Column) -> Column:
    return F.concat(F.lit(f"{key.capitalize()}: "), F.array_join(F.slice(values, 1, 3), ", "))


def term_id(text: Column) -> Column:
    """An ontology term as vertices are called, ``GO:0005575`` as ``go_0005575``."""
    return F.lower(F.translate(text, ":", "_"))


def term_name(text: Column) -> Column:
    """A vertex of an ontology as the term is called, ``go_0005575`` as ``GO:0005575``."""
    return F.upper(F.translate(text, "_", ":"))


def file_name(text: Column, owner: Column) -> Column:
    """A title as a file's name: letters, digits and underscores only, its words and the owner joined by hyphens."""
    plain = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return F.concat(F.array_join(F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != ""), "-"), F.lit("-"), owner.cast("string"))


def iso_time(at: Column) -> Column:
    """A time as ``2024-01-31T10:20:30``, its microseconds behind a point if there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def safe_name(text: Column) -> Column:
    """A name that may stand in an INFO field."""
    return F.translate(text, "; ", "__")


# How a property's value is said, types that are said in capitals, and the sentences.
SAID = {
    "chr": "Chromosome {}", "start": "Position {}", "biological_context": "{} Context", "cell": "{} Cell Line", "variant_type": "{} Variant", "transcript_type": "{} Transcript",
    "rna_type": "{} RNA", "biochemical_activity": "{} Region", "evidence_type": "{} Evidence", "state": "Chromatin State: {}", "modification": "Histone Modification: {}",
}
CAPITALS = frozenset({"snp", "tad", "dna", "rna", "go", "gtex"})
#: By how two ends are known: whether the source and the target are called by type only, and how the
#: target's label stands to the source's and to the verb (``same``, ``told`` or nothing). ``None`` fits all.
SENTENCES = {
    (True, True, "same"): "a {s} {v} another {t}", (None, True, "told"): "{s} {v}", (None, True, None): "{s} {v} a {t}", (True, False, None): "a {s} {v} {t}", (False, False, None): "{s} {v} {t}",
}


def node_label(node: NodePattern, names: Mapping[str, Sequence[str]] | None = None, generic: Sequence[str] | None = None) -> str | None:
    """What a node is called by its properties, or None. The properties listed for its type come first,
    then ``generic`` ones (default: any with ``name`` in its key)."""
    keys = [*(names or {}).get(node.type, ()), *(generic if generic is not None else (k for k in node.properties if "name" in k.lower()))]
    values = ((k, node.properties.get(k)) for k in keys)
    firsts = ((k, v[0] if isinstance(v, list) and v else v) for k, v in values)
    return next((SAID.get(k, "{}").format(str(v).replace("_", " ").title()) for k, v in firsts if v), None)


def title(query: QueryGraph, names: Mapping[str, Sequence[str]] | None = None, verbs: Mapping[str, str] | None = None, generic: Sequence[str] | None = None) -> str:
    """A title of a query graph in words: nodes by ``node_label``, else by type, and a sentence for each edge."""
    called = {n.node_id: node_label(n, names, generic) for n in query.nodes}
    by_type = {n.node_id: n.type.upper() if n.type.lower() in CAPITALS else n.type.replace("_", " ").title() for n in query.nodes}
    shown = {i: called[i] or by_type[i] for i in called}
    if not query.edges:
        return "Selection: " + ", ".join(f"Unnamed {shown[i]}" if called[i] is None else shown[i] for i in shown)

    def sentence(e: EdgePattern) -> str:
        verb = (verbs or {}).get(e.type, e.type.replace("_", " "))
        known = {(called[e.source] is None, called[e.target] is None)}
        relation = {"same"} if shown[e.source] == shown[e.target] else set()
        relation |= {"told"} if shown[e.target].lower() in verb.lower() else set()
        fits = (form for (s, t, r), form in SENTENCES.items() if all(s in (None, a) and t == b for a, b in known) and (r is None or r in relation))
        return next(fits).format(s=shown[e.source], v=verb, t=shown[e.target])

    whole = ", and ".join(map(sentence, query.edges))
    return whole[0].upper() + whole[1:]


def batches(texts: Sequence[str], sizes: Sequence[int], most: int) -> list[list[str]]:
    """Consecutive texts together as long as their sizes stay within ``most``."""
    out: list[list[str]] = []
    used = 0
    for text, size in zip(texts, sizes, strict=True):
        if not out or used + size > most:
            out.append([])
            used = 0
        out[-1].append(text)
        used += size
    return out
