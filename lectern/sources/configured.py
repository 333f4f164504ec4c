"""Configured sources (S4, R3, T13, T15-T17): a mapping of fields to dot paths, compiled once per
source against the payload's schema into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StringType, StructType

from lectern.functions.text import plain_text
from lectern.sources.normalizers import ensure_list

AUTHOR = "array<struct<name:string>>"
#: Date formats tried in turn on the first ten characters, and the years taken for plausible.
DAY_FORMATS = ("yyyy-M-d", "d/M/yyyy", "yyyy/M/d")
YEARS = (1900, 2100)


class SourceConfig(NamedTuple):
    name: str
    fields: dict[str, str]              # article field -> dot path
    author_type: str = "object_array"   # string, array or object_array
    author_name: str = "name"
    date_format: str | None = None


def resolve(c: Column, kind: DataType, path: list[str]) -> tuple[Column, DataType]:
    """The value at a path and its type.  A number indexes a list (from 0); any other step through a
    list collects from every element, nested lists flattened, missing values left out, nothing found: null."""
    if not path:
        return c, kind
    step, rest = path[0], path[1:]
    if isinstance(kind, StructType):
        return resolve(c.getField(step), kind[step].dataType, rest) if step in kind.names else (F.lit(None), NullType())
    if isinstance(kind, MapType):
        return resolve(F.try_element_at(c, F.lit(step)), kind.valueType, rest)
    if isinstance(kind, ArrayType):
        if step.isdigit():
            return resolve(F.try_element_at(c, F.lit(int(step) + 1)), kind.elementType, rest)
        inner = resolve(F.lit(None), kind.elementType, path)[1]
        if isinstance(inner, NullType):
            return F.lit(None), inner
        found = F.filter(F.transform(c, lambda x: resolve(x, kind.elementType, path)[0]), lambda x: x.isNotNull())
        if isinstance(inner, ArrayType):
            found, inner = F.flatten(found), inner.elementType
        return F.when(F.size(found) > 0, found), ArrayType(inner)
    return F.lit(None), NullType()


def as_list(c: Column, kind: DataType) -> Column:
    """T16 for any type: null -> [], a list as it is, a string split at commas, anything else as its text."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>"))
    text = c.cast("string")
    return ensure_list(text) if isinstance(kind, (StringType, NullType)) else F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))


def authors(c: Column, kind: DataType, author_type: str, author_name: str) -> Column:
    """Authors as (name): a comma-separated string, a list of names, or a list of objects whose name is the
    configured field, else given and family name, else display_name; objects without any are left out."""
    none = F.array().cast(AUTHOR)
    named = lambda names: F.transform(names, lambda n: F.struct(n.alias("name")))
    if author_type == "string" and isinstance(kind, StringType):
        return named(ensure_list(c))
    if author_type == "array" and isinstance(kind, ArrayType):
        return F.coalesce(named(as_list(c, kind)), none)
    if author_type == "object_array" and isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, StructType):
            return F.coalesce(named(as_list(c, kind)), none)
        have = kind.elementType.names

        def name(a: Column) -> Column:
            get = lambda f: F.coalesce(a[f].cast("string"), F.lit("")) if f in have else F.lit("")
            both = F.trim(F.concat_ws(" ", get("given"), get("family")))
            return F.coalesce(F.nullif(get(author_name), F.lit("")), F.nullif(both, F.lit("")), F.nullif(get("display_name"), F.lit("")))
        return F.coalesce(named(F.filter(F.transform(c, name), lambda n: n.isNotNull())), none)
    return none


def _from_parts(parts: Column) -> Column:
    part = lambda i: F.try_element_at(parts, F.lit(i)).cast("int")
    or_one = lambda x: F.coalesce(F.nullif(x, F.lit(0)), F.lit(1))
    made = F.try_make_timestamp(part(1), or_one(part(2)), or_one(part(3)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(part(1).between(*YEARS), made)


def payload_day(c: Column, kind: DataType, date_format: str | None = None) -> Column:
    """Date parts (an object with date-parts, or a list, nested or not; plausible years only), else a string:
    the configured format, then common formats on its first ten characters."""
    if isinstance(kind, StructType):
        return payload_day(c["date-parts"], kind["date-parts"].dataType) if "date-parts" in kind.names else F.lit(None).cast("date")
    if isinstance(kind, ArrayType):
        return _from_parts(F.try_element_at(c, F.lit(1)) if isinstance(kind.elementType, ArrayType) else c)
    if not isinstance(kind, StringType):
        return F.lit(None).cast("date")
    tries = [F.try_to_timestamp(c, F.lit(date_format)).cast("date")] if date_format else []
    return F.coalesce(*tries, *[F.try_to_timestamp(F.substring(c, 1, 10), F.lit(f)).cast("date") for f in DAY_FORMATS])


def normalize_configured(items: DataFrame, cfg: SourceConfig, item: str = "item") -> DataFrame:
    """Item rows of one source -> articles.  Titles and abstracts become plain text, rows without a title
    drop, a missing external_id is made from the payload (T22), and the payload is kept as raw_data."""
    root = items.schema[item].dataType
    got = {f: resolve(F.col(item), root, p.split(".")) for f, p in cfg.fields.items()}
    value = lambda f: got.get(f, (F.lit(None), NullType()))
    text = lambda f: value(f)[0].cast("string")
    raw = F.to_json(F.col(item))
    own = F.nullif(F.trim(text("external_id")), F.lit(""))
    out = items.select(
        F.coalesce(own, F.concat(F.lit(cfg.name + ":"), F.sha2(raw, 256))).alias("external_id"),
        plain_text(F.coalesce(text("title"), F.lit(""))).alias("title"), plain_text(F.coalesce(text("abstract"), F.lit(""))).alias("abstract"),
        authors(*value("authors"), cfg.author_type, cfg.author_name).alias("authors"),
        payload_day(*value("published_date"), cfg.date_format).alias("published_date"),
        *[text(f).alias(f) for f in ("doi", "url", "pdf_url", "journal")],
        as_list(*value("categories")).alias("categories"), as_list(*value("keywords")).alias("keywords"),
        F.coalesce(text("citation_count").try_cast("int"), F.lit(0)).alias("citation_count"),
        F.lit(cfg.name).alias("source"), F.struct(F.lit(cfg.name).alias("source"), raw.alias("original_data")).alias("raw_data"))
    return out.filter(F.col("title") != "")
