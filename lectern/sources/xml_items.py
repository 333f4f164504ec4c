"""Items of configured XML sources (S2): any tree, a dot path to the items, dot paths to the fields.

A payload's items are the elements at the data path below its root, or, if there are none, the
elements named like the path's last component anywhere in it; a payload that is not
well-formed has none.  An item becomes a VARIANT by these rules: namespaces are dropped, attributes come as
`@name` and as `name`, children that come again form a list, text beside attributes or children is `_text`.
Whether a field is one value or a list so differs from item to item, which a fixed
schema cannot say; `at_path` resolves dot paths on the VARIANT itself, in the JVM.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions.text import plain_text
from lectern.sources.configured import AUTHOR, SourceConfig, payload_day
from lectern.sources.normalizers import ensure_list


def _plain(name: str) -> str:
    return name.rpartition("}")[2]


def _value(e: ET.Element):
    out: dict = {}
    for k, v in e.attrib.items():
        out["@" + _plain(k)] = out[_plain(k)] = v
    if e.text and e.text.strip():
        out["_text"] = e.text.strip()
    for child in e:
        tag, v = _plain(child.tag), _value(child)
        if tag not in out:
            out[tag] = v
        elif isinstance(out[tag], list):
            out[tag].append(v)
        else:
            out[tag] = [out[tag], v]
    return out["_text"] if out.keys() == {"_text"} else out


def item_texts(payload: str | None, path: list[str]) -> list[str]:
    """The items of one payload as JSON, in document order."""
    try:
        root = ET.fromstring(payload or "")
    except ET.ParseError:
        return []
    for e in root.iter():
        e.tag = _plain(e.tag)
    found = root.findall(".//" + "/".join(path)) or root.findall(".//" + path[-1])
    return [json.dumps(_value(e), ensure_ascii=False) for e in found]


def xml_items(landed: DataFrame, data_path: str, payload: str = "payload") -> DataFrame:
    """A row for each item, in column `item` (VARIANT), beside the other columns of `landed`; no path, no items."""
    path = [p for p in data_path.split(".") if p]

    @F.pandas_udf(ArrayType(StringType()))
    def texts(payloads: pd.Series) -> pd.Series:
        return pd.Series([item_texts(p, path) if path else [] for p in payloads])

    rest = [c for c in landed.columns if c != payload]
    return landed.select(*rest, F.explode(texts(payload)).alias("item")).withColumn("item", F.parse_json("item"))


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _elements(v: Column) -> Column:
    none = F.array().cast("array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), none).when(_is_list(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def at_path(item: Column, path: str) -> Column:
    """T13 on a VARIANT: struct(found: the values at a dot path, several: whether they are a list).

    A number indexes a list (from 0); any other step through a list collects from every element, nested lists
    flattened, missing values left out.
    """
    start = F.struct(_elements(item).alias("found"), _is_list(item).alias("several"))

    def step(at: Column, key: str) -> Column:
        get = lambda v: F.try_variant_get(v, f'$["{key}"]', "variant")
        each = F.flatten(F.transform(at["found"], lambda v: _elements(get(v))))
        one = F.try_element_at(at["found"], F.lit(1))
        by_key = F.struct(each.alias("found"), (at["several"] | _is_list(get(one))).alias("several"))
        if not key.isdigit():
            return by_key
        nth = F.try_element_at(at["found"], F.lit(int(key) + 1))
        return F.when(at["several"], F.struct(_elements(nth).alias("found"), _is_list(nth).alias("several"))).otherwise(by_key)

    return reduce(step, path.split("."), start)


def as_text(v: Column) -> Column:
    """A VARIANT leaf as string; of an element with attributes or children its text."""
    own = F.try_variant_get(v, "$._text", "string")
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), own).otherwise(F.try_variant_get(v, "$", "string"))


def _names(values: Column, several: Column, cfg: SourceConfig) -> Column:
    """T15 on VARIANTs."""
    none = F.array().cast(AUTHOR)
    named = lambda names: F.transform(names, lambda n: F.struct(n.alias("name")))
    texts = F.transform(values, as_text)
    if cfg.author_type == "string":
        return F.when(~several & (F.size(texts) == 1), named(ensure_list(texts[0]))).otherwise(none)
    if cfg.author_type == "array":
        return F.when(several, named(texts)).otherwise(none)

    def name(v: Column) -> Column:
        get = lambda f: F.coalesce(F.try_variant_get(v, f'$["{f}"]', "string"), F.lit(""))
        full = F.trim(F.concat_ws(" ", get("given"), get("family")))
        of_object = F.coalesce(F.nullif(get(cfg.author_name), F.lit("")), F.nullif(full, F.lit("")), F.nullif(get("display_name"), F.lit("")))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), of_object).otherwise(F.try_variant_get(v, "$", "string"))

    return F.when(several, named(F.filter(F.transform(values, name), lambda n: n.isNotNull()))).otherwise(none)


def normalize_xml(items: DataFrame, cfg: SourceConfig) -> DataFrame:
    """S2 + S4: XML item rows of one source -> articles, by the rules of `configured.normalize_configured`."""
    got = {f: f"_{f}" for f in cfg.fields}
    staged = items.select("item", *[at_path(F.col("item"), p).alias(got[f]) for f, p in cfg.fields.items()])
    values = lambda f: F.col(f"{got[f]}.found") if f in got else F.array().cast("array<variant>")
    several = lambda f: F.col(f"{got[f]}.several") if f in got else F.lit(False)
    texts = lambda f: F.filter(F.transform(values(f), as_text), lambda t: t.isNotNull())
    text = lambda f: F.try_element_at(texts(f), F.lit(1))
    many = lambda f: F.when(several(f), texts(f)).otherwise(ensure_list(text(f)))
    raw = F.to_json(F.col("item"))
    own = F.nullif(F.trim(text("external_id")), F.lit(""))
    out = staged.select(
        F.coalesce(own, F.concat(F.lit(cfg.name + ":"), F.sha2(raw, 256))).alias("external_id"),
        plain_text(F.coalesce(text("title"), F.lit(""))).alias("title"), plain_text(F.coalesce(text("abstract"), F.lit(""))).alias("abstract"),
        _names(values("authors"), several("authors"), cfg).alias("authors"),
        payload_day(text("published_date"), StringType(), cfg.date_format).alias("published_date"),
        *[text(f).alias(f) for f in ("doi", "url", "pdf_url", "journal")], many("categories").alias("categories"), many("keywords").alias("keywords"),
        F.coalesce(text("citation_count").try_cast("int"), F.lit(0)).alias("citation_count"), F.lit(cfg.name).alias("source"))
    return out.filter(F.col("title") != "")
