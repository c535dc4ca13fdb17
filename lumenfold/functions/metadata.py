"""Metadata functions: ion modes, structure strings, safe numbers, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Tokens that name an ion mode, tested in this order in legacy mode.
NEGATIVE = ("negative", "neg", "-")
POSITIVE = ("positive", "pos", "+")


def infer_ion_mode(*columns: Column, legacy: bool = False) -> Column:
    """From joined metadata. Legacy: any negative token, even a bare hyphen, comes first; else the trailing charge sign decides."""
    text = F.lower(F.concat_ws(" ", *columns))
    has = lambda tokens: F.coalesce(*[F.when(text.contains(t), True) for t in tokens], F.lit(False))
    if legacy:
        return F.when(has(NEGATIVE), "negative").when(has(POSITIVE), "positive").otherwise("unknown")
    return (
        F.when(has(NEGATIVE[:2]), "negative").when(has(POSITIVE[:2]), "positive")
        .when(text.rlike(r"\][0-9]*-\s*$|(^|\s)-\s*$"), "negative").when(text.rlike(r"\][0-9]*\+\s*$|(^|\s)\+\s*$"), "positive").otherwise("unknown")
    )


def normalize_ion_mode(text: Column, legacy: bool = False) -> Column:
    """positive, negative or null. Finite numbers go by sign; legacy mode takes only numeric columns for numbers and drops hyphens, so the string '-1' is positive."""
    low = F.lower(F.trim(text.cast("string")))
    number = low.try_cast("double")
    if legacy:
        number = F.when(F.typeof(text).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), number)
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    # Names and endings of the two modes, below.
    bare = F.regexp_replace(low, "[ _/-]" if legacy else "[ _/]", "")
    return (
        F.when(number < 0, "negative").when(number > 0, "positive").when(number == 0, None)
        .when(bare.isin("negative", "neg", "n", "-", "-1", "esi-"), "negative").when(bare.isin("positive", "pos", "p", "+", "+1", "1", "esi+"), "positive")
        .when(bare.contains("positive") | bare.endswith("pos") | bare.contains("esi+"), "positive").when(bare.contains("negative") | bare.endswith("neg") | bare.contains("esi-"), "negative")
    )


def ion_mode(metadata: Column, setting: str | None = None, fallback: str = "positive") -> Column:
    return F.coalesce(normalize_ion_mode(metadata), F.lit(setting), F.lit(fallback))


def run_ion_mode(setting: str) -> str:
    """A mode for a whole run."""
    if setting not in ("positive", "negative"):
        raise ValueError("the ion mode must be positive or negative")
    return setting


def structure(text: Column) -> Column:
    """Trimmed, empty for null-like strings."""
    t = F.trim(text)
    return F.when(text.isNull() | F.lower(t).isin("nan", "none", "null"), "").otherwise(t)


def safe_double(text: Column, default: float | None = None) -> Column:
    x = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default).cast("double"))


def safe_long(text: Column, default: int | None = None) -> Column:
    """Truncates."""
    return F.coalesce(safe_double(text).cast("long"), F.lit(default).cast("long"))


def confidence_level(score: Column) -> Column:
    low = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(low, "Low").when(score >= 0.70, "High").when(score >= 0.40, "Medium").otherwise("Low")


def joined(values: Column, separator: str = " | ") -> Column:
    return F.array_join(values, separator, "")


def decoded(raw: Column) -> Column:
    """UTF-8 without the bytes that are none."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first column with a value that isn't blank."""
    return F.coalesce(*[F.when(structure(c.cast("string")) != "", c.cast("string")) for c in columns])


def scalar(value: Column, kind: T.DataType) -> Column:
    """As a string: bytes decoded, of a list its first element, null for an empty one."""
    if isinstance(kind, T.ArrayType):
        return scalar(F.get(value, F.lit(0)), kind.elementType)
    return decoded(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def probed(held: Column, kind: T.DataType, *path: str) -> Column:
    """The scalar at a path of names in a struct, a map, a variant, a string of JSON, or the first record of a list; null where there is none."""
    if isinstance(kind, T.ArrayType):
        return probed(F.get(held, F.lit(0)), kind.elementType, *path)
    if isinstance(kind, (T.StringType, T.VariantType)):
        if any("'" in name and '"' in name for name in path):
            raise ValueError(f"a name with both kinds of quotes can't be looked up in JSON: {path}")
        at = "$" + "".join(f'["{name}"]' if "'" in name else f"['{name}']" for name in path)
        v = F.try_parse_json(held) if isinstance(kind, T.StringType) else held
        whole = F.when(~F.schema_of_variant(F.try_variant_get(v, at, "variant")).startswith("ARRAY"), F.try_variant_get(v, at, "string"))
        return F.coalesce(F.try_variant_get(v, f"{at}[0][0]", "string"), F.when(whole.isNull(), F.try_variant_get(v, f"{at}[0]", "string")), whole)
    name, *rest = path
    if isinstance(kind, T.StructType) and name in kind.names:
        value, inner = held.getField(name), kind[name].dataType
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        value, inner = F.try_element_at(held, F.lit(name)), kind.valueType
    else:
        return F.lit(None).cast("string")
    return probed(value, inner, *rest) if rest else scalar(value, inner)


def metadata_value(df: DataFrame, *names: str, containers: tuple[str, ...] = ("obs", "metadata", "item")) -> Column:
    """The first value under one of the names, as a string: a column, then a field of a container column, then of its `metadata`.

    In each place the names count in the order given, and a null value lets the next be tried. Containers are structs,
    maps, variants, strings of JSON, or lists of such records, of which the first counts; broken JSON holds nothing.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    column = lambda name: df[f"`{name.replace('`', '``')}`"]
    found = [scalar(column(name), kinds[name]) for name in names if name in kinds]
    for c in (c for c in containers if c in kinds):
        found += [probed(column(c), kinds[c], *inside, name) for inside in ((), ("metadata",)) for name in names]
    return F.coalesce(*found, F.lit(None).cast("string"))


def method_name(path: Column) -> Column:
    """The method in library_<method>.npy, or <name>.<method>.npy, or the bare stem; lower case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(npy|npz)$", "")
    return F.lower(F.element_at(F.split(F.regexp_replace(stem, "^library_", ""), r"\."), -1))


def chimera_id(kind: Column, index: Column) -> Column:
    return F.format_string("chimera_%s_%06d", kind, index)
