"""Parcel identifiers: 16 digits, of which 8 name the commune (syscol), 3 the section and 5 the parcel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelspark.functions.text import digits, pad_left

#: Property names that hold the identifier or the object's id, in order (fixed values).
NICAD_KEYS = ["nicad", "NICAD", "Nicad", "NIC", "NUM_NICAD", "num_nicad", "CODE_NICAD", "code_nicad", "CODIF", "codif"]
OBJECT_KEYS = ["OBJECTID", "objectid", "ObjectID", "FID", "fid", "OBJ_ID", "GID", "id"]
#: Values that stand for a missing identifier (fixed values).
MISSING = ["", "null", "undefined", "na", "n/a", "néant", "neant", "aucun", "sans nicad", "0", "-"]


def from_properties(props: Column) -> Column:
    """The first of the known keys that is not null, trimmed; an empty value ends the search."""
    return F.trim(F.coalesce(*[F.try_element_at(props, F.lit(k)) for k in NICAD_KEYS], F.lit("")))


def object_id(props: Column, idx: Column) -> Column:
    return F.coalesce(*[F.try_element_at(props, F.lit(k)) for k in OBJECT_KEYS], idx.cast("string"))


def is_missing(nicad: Column) -> Column:
    return F.lower(F.trim(F.coalesce(nicad, F.lit("")))).isin(MISSING)


def cleaned(nicad: Column) -> Column:
    """Without blanks (Unicode ones too), hyphens, underscores and middle dots."""
    return F.regexp_replace(F.coalesce(nicad, F.lit("")), r"(?U)[\s\-_·]", "")


def errors(nicad: Column) -> Column:
    """What is wrong with an identifier, as an array of: empty, not_numeric, length, syscol_zero, section_zero."""
    c = cleaned(nicad)
    form = F.array_compact(F.array(F.when(~c.rlike("^[0-9]+$"), "not_numeric"), F.when(F.length(c) != 16, "length")))
    parts = F.array_compact(F.array(F.when(F.substring(c, 1, 8) == "00000000", "syscol_zero"), F.when(F.substring(c, 9, 3) == "000", "section_zero")))
    return F.when(c == "", F.array(F.lit("empty"))).when(F.size(form) > 0, form).otherwise(parts)


def is_valid(nicad: Column) -> Column:
    return F.size(errors(nicad)) == 0


def warning(nicad: Column) -> Column:
    c = cleaned(nicad)
    return F.when(c.rlike("^[0-9]{11}00000$"), "parcel_zero")


def syscol_of(nicad: Column) -> Column:
    return F.substring(cleaned(nicad), 1, 8)


def section_of(nicad: Column) -> Column:
    return F.substring(cleaned(nicad), 9, 3)


def parcel_of(nicad: Column) -> Column:
    return F.substring(cleaned(nicad), 12, 5)


def joined(nicad: Column, separator: str) -> Column:
    """The three parts with a separator; another length than 16 is left as it is."""
    parts = F.concat_ws(separator, F.substring(nicad, 1, 8), F.substring(nicad, 9, 3), F.substring(nicad, 12, 5))
    return F.when(F.length(nicad) == 16, parts).otherwise(F.coalesce(nicad, F.lit("")))


def parcel_number(raw: Column) -> tuple[Column, Column]:
    """(5 digits or null, how they came about: ok, padded, truncated, none); of more digits the last 5 count."""
    d = digits(raw)
    n = F.length(d)
    value = F.when(n == 0, F.lit(None).cast("string")).when(n <= 5, F.lpad(d, 5, "0")).otherwise(F.substring(d, -5, 5))
    return value, F.when(n == 0, "none").when(n == 5, "ok").when(n < 5, "padded").otherwise("truncated")


def section_number(raw: Column) -> Column:
    """3 digits, the last ones of the text; null without digits."""
    d = digits(raw)
    return F.when(d == "", F.lit(None).cast("string")).otherwise(F.lpad(F.when(F.length(d) > 3, F.substring(d, -3, 3)).otherwise(d), 3, "0"))


def syscol_number(raw: Column, blank: bool = False) -> Column:
    """Digits padded to 8; empty for an empty input. With ``blank`` also for one without digits, else that is 00000000."""
    d = digits(raw)
    return F.when((F.coalesce(raw, F.lit("")) == "") | (F.lit(blank) & (d == "")), F.lit("")).otherwise(pad_left(d, 8))


def prefix_of(raw: Column) -> Column:
    """8 characters: cut, or filled with zeros on the right."""
    return F.rpad(F.substring(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s", ""), 1, 8), 8, "0")


def built(prefix: Column, section: Column, parcel: Column) -> Column:
    """Null without a parcel number; a missing section is 000."""
    return F.when(F.coalesce(parcel, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.concat(prefix, F.coalesce(section, F.lit("000")), parcel))


def generated(syscol: Column, section: Column, parcel: Column) -> Column:
    """The identifier of padded parts; null where a part is too long."""
    s, c, p = pad_left(syscol.cast("string"), 8), pad_left(section.cast("string"), 3), pad_left(parcel.cast("string"), 5)
    return F.when((F.length(s) == 8) & (F.length(c) == 3) & (F.length(p) == 5), F.concat(s, c, p))


def same_parcel(a: Column, b: Column) -> Column:
    """Whether two valid identifiers have one section and parcel number."""
    return F.coalesce(is_valid(a) & is_valid(b) & (section_of(a) == section_of(b)) & (parcel_of(a) == parcel_of(b)), F.lit(False))


def switched(nicad: Column, syscol: Column, section: Column | None = None, number: Column | None = None) -> Column:
    """The identifier under another commune: section and number stay, or both are given anew. Null for an invalid one."""
    s = section_of(nicad) if section is None else pad_left(section.cast("string"), 3)
    n = parcel_of(nicad) if number is None else pad_left(number.cast("string"), 5)
    return F.when(is_valid(nicad), F.concat(pad_left(syscol.cast("string"), 8), s, n))


def resolved(nicad: Column, section_code: Column, syscol: Column, section: Column, number: Column, position: Column) -> Column:
    """(syscol, section, parcelle) of an imported parcel as a struct: from 16 digits; else from a section code of 11 digits; else from columns of its own, where a missing section is 001. A missing number is the row's place, counted from 1. Null without a commune."""
    whole, code = digits(nicad), digits(section_code)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    key = lambda s, c, n: F.struct(s.alias("syscol"), c.alias("section"), n.alias("parcelle"))
    own = pad_left(F.when(given(number), digits(number)).otherwise((position + 1).cast("string")), 5)
    by_columns = key(syscol_number(syscol), F.when(given(section), pad_left(digits(section), 3)).otherwise(F.lit("001")), own)
    by_code = key(F.substring(code, 1, 8), F.substring(code, 9, 3), own)
    return F.when(F.length(whole) == 16, key(F.substring(whole, 1, 8), F.substring(whole, 9, 3), F.substring(whole, 12, 5))).when(F.length(code) == 11, by_code).when(given(syscol), by_columns)


def section_prefix(syscol: Column, section: Column) -> Column:
    """The first eleven digits of a section's identifiers."""
    return F.concat(pad_left(syscol, 8), pad_left(section, 3))


def parts(nicad: Column) -> Column:
    """An identifier as a struct of its parts; null unless it has 16 digits."""
    c = cleaned(nicad)
    return F.when(c.rlike("^[0-9]{16}$"), F.struct(syscol_of(nicad).alias("syscol"), section_of(nicad).alias("section"), parcel_of(nicad).alias("num_parcelle"), c.alias("full")))


#: Names under which imports have their attributes, in the order in which they count (fixed values).
COMMUNE_2013 = {
    "syscol": ["Syscol", "SYSCOL", "syscol", "COD_SYSCOL", "cod_syscol"],
    "nom": ["NomCommune", "NOM_COMMUN", "NOM", "nom", "Commune", "COMMUNE"],
}
COMMUNE_2026 = {
    "syscol": ["COD_SYSCOL", "Syscol", "SYSCOL", "syscol", "cod_syscol"],
    "nom": ["NomCommune", "NOM_COMMUN", "NOM", "nom", "Commune", "COMMUNE"],
    "region": ["REGION", "Region", "region", "NOM_REGION"],
    "departement": ["DEPARTEMEN", "DEPARTEMENT", "Departement", "departement"],
}
SECTION = {
    "code": ["Num_sect_N", "NUM_SECT_N"],
    "numero": ["Num_sectio", "Num_sect", "NUM_SECT", "NUMSECT", "numSection", "NUM_SECTION", "SECTION"],
    "nom": ["NOM_SECT", "NOMSECT", "nomSection", "NOM_SECTION", "NAME"],
    "commune": ["COM_ARROND", "NomCommune", "NOM_COMMUN", "NOM", "nom"],
    "region": ["REGION", "region"],
    "departement": ["ARRONDISSE", "DEPARTEMENT", "departement"],
}
PARCEL = {
    "commune": ["commune", "NomCommune", "NOM_COMMUN", "NOM"],
    "region": ["region", "REGION"],
    "departement": ["departemen", "DEPARTEMENT", "departement"],
    "quartier": ["Quartier", "QUARTIER", "quartier", "NOM_QUART"],
    "num_lot": ["NumLot", "NUM_LOT", "NUMLOT", "numLot"],
    "titre": ["TitreParce", "TITRE_PARC", "TITREPARCE", "titreParce"],
    "type_document": ["TypeDocFon", "TYPE_DOC", "TYPEDOC", "typeDocFon"],
    "nature": ["NatJuri", "NAT_JURI", "NATJURI", "natJuri"],
    "destination": ["TypeDestin", "TYPE_DEST", "TYPEDEST", "typeDestin"],
    "occupation": ["CatOcup", "CAT_OCUP", "CATOCUP", "catOcup"],
    "superficie": ["SupLegale", "SupReelle", "SUPERFICIE", "superficie", "Shape_Area"],
    "proprietaire": ["TitulaireD", "Occupant", "nomProprietaire"],
}
#: The identifier's names in the two map clients, which know fewer than imports do (fixed values).
MAP_NICAD, LEAFLET_NICAD = ["NICAD", "nicad", "NIC", "Nicad"], ["NICAD", "nicad", "NIC"]


def first_of(props: Column, names: list[str]) -> Column:
    """The first of a map's entries that is not null; empty if none is."""
    return F.coalesce(*[F.try_element_at(props, F.lit(n)) for n in names], F.lit(""))


def attributes(props: Column, names: dict[str, list[str]]) -> dict[str, Column]:
    return {k: first_of(props, v).alias(k) for k, v in names.items()}
