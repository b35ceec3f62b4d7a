"""Entity–attribute–value rows into one row per entity with typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import computed_once
from ledgerloom.functions.text import states_nothing, token_of, unquoted

# How a yes and a no are written, in lower case.
YES, NO = ("true", "t", "yes", "y", "1", "☒", "☑", "[x]", "x"), ("false", "f", "no", "n", "0", "☐", "[ ]", "[]")
NUMBER_PLACES = 15
NUMBER_TYPE = f"decimal(38,{NUMBER_PLACES})"


@dataclass(frozen=True)
class Attribute:
    """A known attribute: its path, type (boolean, number, text, records) and its former path."""

    path: str
    kind: str
    former: str | None = None

    @property
    def column(self) -> str:
        return self.path.replace(".", "__")


def catalog_of(rows: DataFrame) -> list[Attribute]:
    """The attributes of a field catalog (one row per column of the wide table, so as many as a schema has)."""
    return [Attribute(r["field_path"], r["value_type"], r["former_path"]) for r in rows.select("field_path", "value_type", "former_path").orderBy("field_path").collect()]


def path_key(path: Column) -> Column:
    """What spelling variants of a path share: its letters and digits in lower case, without a leading `fields.`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"^fields[./]", ""), "[^a-z0-9]+", "")


def _key(path: str) -> str:
    return "".join(ch for ch in path.lower() if ch.isascii() and ch.isalnum())


def _places(n: Column) -> Column:
    """The decimal places that a number in digits needs, with its exponent and without zeros at its end; below 0 for whole tens."""
    exponent = F.when(n.rlike(r"e-[0-9]{5,}$"), -99_999).otherwise(F.coalesce(F.regexp_extract(n, r"e([+-]?[0-9]{1,4})$", 1).try_cast("int"), F.lit(0)))
    fraction = F.char_length(F.regexp_extract(n, r"\.([0-9]*?)0*(?:e|$)", 1))
    zeros = F.char_length(F.regexp_extract(n, r"(0*)(?:\.0*)?(?:e|$)", 1))
    return F.when(n.rlike(r"^[+-]?[0.]*(?:e|$)"), 0).otherwise(F.when(fraction > 0, fraction).otherwise(-zeros) - exponent)


def read_value(kind: str, v: Column) -> Column:
    """An unquoted text as the type of `kind`; null if it states nothing or cannot be read as that."""
    low = F.lower(v)
    if kind == "boolean":
        read = F.when(low.isin(*YES), True).when(low.isin(*NO), False)
    elif kind == "number":
        n = F.regexp_replace(low, r"\s*(?:%|per\s?cent)$", "")
        plain = n.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$")
        commas = n.rlike(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?$")
        bare = F.regexp_replace(F.regexp_replace(n, ",", ""), r"\.(?=e|$)", "")
        # A number with more places than the type has would be rounded: it is not read.
        long = n.rlike(rf"e|\.[0-9]{{{NUMBER_PLACES + 1}}}")
        read = F.when((plain | commas) & (~long | (_places(bare) <= NUMBER_PLACES)), bare).try_cast(NUMBER_TYPE)
    elif kind == "records":
        read = F.when(F.get_json_object(v, "$").rlike(r"^\s*[\[{]"), v)
    else:
        read = token_of(v)
    return F.when(~states_nothing(v), read)


def resolve(rows: DataFrame, catalog: list[Attribute], entity: str = "filing_id", latest: bool = True) -> DataFrame:
    """One row per entity and attribute, the latest version: entity, place (in the catalog; null: none), path_raw (of those), value.

    The latest `updated_at` decides (null is earliest), then the greater `gt_row_id`; the first version does without `latest`. The paths of unknown
    attributes stay apart by `path_raw`. The maximum is taken before and after the shuffle, so a hot entity or attribute
    arrives as at most one row per task and cell, and a known path travels as its place.
    """
    names = {_key(p): i for i, a in enumerate(catalog) for p in (a.former, a.path) if p}
    key = path_key(F.col("field_path"))
    place = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key] if names else F.lit(None).cast("int")
    version = F.struct(F.coalesce(F.col("updated_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), F.col("gt_row_id").alias("n"), F.col("expected").alias("value"))
    rows = rows.select(F.col(entity), place.alias("place"), F.when(place.isNull(), F.col("field_path")).alias("path_raw"), version.alias("v"))
    return rows.groupBy(entity, "place", "path_raw").agg((F.max("v") if latest else F.min("v")).alias("v")).select(entity, "place", "path_raw", F.col("v.value").alias("value"))


def widen(rows: DataFrame, catalog: list[Attribute], entity: str = "filing_id", latest: bool = True) -> DataFrame:
    """One row per entity: a typed column per attribute (`a.b` as `a__b`), `cast_failures` and `n_unknown`.

    `cast_failures` maps the path of each value that states something but cannot be read as its type to that value; a number of
    more than NUMBER_PLACES decimal places is such a value, as it is never rounded. `n_unknown` counts the entity's attributes
    outside the catalog, which `others` returns. An entity whose rows all give no value has a row of nulls; rows with a null
    entity make a row with a null key. An empty input gives no rows.
    """
    cells = resolve(rows, catalog, entity, latest)
    kind = F.create_map(*[F.lit(x) for i, a in enumerate(catalog) for x in (i, a.kind)])[F.col("place")] if catalog else F.lit(None).cast("string")
    cells = computed_once(cells, {"kind": kind, "text": unquoted(F.col("value"))})
    typed = {k: F.when(F.col("kind") == k, read_value(k, F.col("text"))) for k in ("boolean", "number", "text", "records")}
    cells = computed_once(cells, {"flag": typed["boolean"], "number": typed["number"], "word": F.coalesce(typed["text"], typed["records"]), "stated": ~states_nothing(F.col("text"))})
    failed = F.col("stated") & F.coalesce(F.col("flag").cast("string"), F.col("number").cast("string"), F.col("word")).isNull()
    known = F.col("place").isNotNull()
    # The map has at most one entry per attribute of the catalog, however many rows the entity had.
    entry = F.struct("place", F.struct("flag", "number", F.when(failed, F.col("value")).otherwise(F.col("word")).alias("word"), failed.alias("failed")).alias("cell"))
    pairs = cells.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.when(known, entry))).alias("pairs"), F.count_if(~known).alias("n_unknown"))
    cell = {a.path: F.col("pairs")[F.lit(i)] for i, a in enumerate(catalog)}
    slot = {"boolean": lambda c: c["flag"], "number": lambda c: c["number"]}
    columns = [slot.get(a.kind, lambda c: F.when(~c["failed"], c["word"]))(cell[a.path]).alias(a.column) for a in catalog]
    paths = F.array(*[F.lit(a.path) for a in catalog]).cast("array<string>")
    failures = F.transform_keys(F.map_filter("pairs", lambda _, c: c["failed"]), lambda i, _: F.get(paths, i))
    return pairs.select(entity, *columns, F.transform_values(failures, lambda _, c: c["word"]).alias("cast_failures"), "n_unknown")


def others(rows: DataFrame, catalog: list[Attribute], entity: str = "filing_id") -> DataFrame:
    """The attributes outside the catalog, which no wide table has a column for: entity, field_path (as written), value, the latest.

    In rows, as their number per entity has no bound. A value that states nothing stays, as it is nobody's null spelling.
    """
    return resolve(rows, catalog, entity).where("place is null").select(entity, F.col("path_raw").alias("field_path"), "value")


def cells_of(wide: DataFrame, catalog: list[Attribute], entity: str = "filing_id", kinds: tuple[str, ...] = ("boolean", "number", "text")) -> DataFrame:
    """The non-null cells of a wide table, back in rows: entity, field_path, cell.

    A cell is `true` or `false`, a plain decimal without superfluous zeros, or the text.
    """
    null = {"boolean": "boolean", "number": NUMBER_TYPE, "text": "string"}
    slot = lambda a, k: (F.col(a.column) if a.kind == k else F.lit(None).cast(null[k])).alias(k)
    cells = F.array(*[F.struct(F.lit(a.path).alias("field_path"), *[slot(a, k) for k in null]) for a in catalog if a.kind in kinds])
    rows = wide.select(entity, F.explode(cells).alias("c")).select(entity, "c.*")
    number = F.col("number")
    digits = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    # A decimal of a great scale is written with an exponent when it is near zero; formatting as a fixed number is exact.
    plain = F.when(number == 0, "0").when(number.cast("string").contains("E"), F.regexp_replace(F.format_string("%.15f", number), r"\.?0+$", "")).otherwise(digits)
    cell = F.coalesce(F.when(F.col("boolean"), "true").when(~F.col("boolean"), "false"), F.when(number.isNotNull(), plain), F.col("text"))
    return rows.select(entity, "field_path", cell.alias("cell")).where("cell is not null")
