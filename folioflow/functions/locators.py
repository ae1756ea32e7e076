"""Locators of sections as columns, and intervals of lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Fixed names: page locators tell nothing of a place in the text, generic keys nothing of a place at all.
PAGE_TYPES = ("page", "pdf_page", "printed_page")
PAGE_KEYS = ("page", "page_number", "pdf_page", "printed_page", "source_pdf_page")
GENERIC_KEYS = ("basis", "boundary_role", "exclusive", "source_node_id", "next_segment_key", "next_source_key")

def _none() -> Column:
    return F.array().cast("array<string>")


def _scalar(column: Column) -> Column:
    return F.trim(column.cast("string"))


def _tokens(column: Column, kind: T.DataType, path: Column) -> Column:
    if isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x, k: _tokens(x, kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(parts), _none())
    if not isinstance(kind, T.StructType):
        text = _scalar(column)
        return F.when(text.isNotNull() & ~text.isin("", "null"), F.array(F.concat(path, F.lit("="), text))).otherwise(_none())
    typed = "type" in kind.names and isinstance(kind["type"].dataType, T.StringType)
    parts = [_none()]
    for field in sorted(kind, key=lambda f: f.name):
        if field.name in PAGE_KEYS + GENERIC_KEYS:
            continue
        child, at = column[field.name], F.when(path == "", F.lit(field.name)).otherwise(F.concat(path, F.lit(f".{field.name}")))
        found = _tokens(child, field.dataType, at)
        if field.name == "value" and typed:
            named = F.concat(F.when(path == "", "locator").otherwise(path), F.lit(".type="), column["type"])
            both = F.array(named, F.concat(at, F.lit("="), _scalar(child)))
            found = F.when(column["type"].isNull(), found).when(_scalar(child) != "", both).otherwise(_none())
        parts.append(found)
    out = F.when(column.isNull(), _none()).otherwise(F.concat(*parts))
    return F.when(column["type"].isin(*PAGE_TYPES), _none()).otherwise(out) if typed else out


def anchor_tokens(column: Column, kind: T.DataType) -> Column:
    """``path=value`` of all that a nested locator says besides pages, sorted, each once. A null field counts as absent."""
    return F.array_sort(F.array_distinct(_tokens(column, kind, F.lit(""))))


def anchor_signature(tokens: Column) -> Column:
    """A short hash of the tokens; null without any."""
    return F.when(F.size(tokens) > 0, F.left(F.sha2(F.to_json(tokens), 256), F.lit(24)))


def semantic_locator(type_: Column, value: Column) -> Column:
    """``(available, normalized)``: a type besides pages, and a value that is not blank."""
    kind = F.coalesce(F.trim(type_), F.lit(""))
    available = (kind != "") & ~kind.isin(*PAGE_TYPES) & (F.coalesce(_scalar(value), F.lit("")) != "")
    return F.struct(available.alias("available"), F.when(available, F.to_json(F.struct(kind.alias("type"), value.alias("value")))).alias("normalized"))


def structural_interval(lines: Column) -> Column:
    """Whether lines are headings only: the first that is not blank has a bullet, and none is numbered or quoted; true of no lines."""
    kept = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != "")
    ruled_out = F.exists(kept, lambda s: s.rlike(r"(?U)^\d+\s*[.\-–—)]") | s.rlike("^[“\"]"))
    return (F.size(kept) == 0) | (F.element_at(kept, 1).startswith("•") & ~ruled_out)
