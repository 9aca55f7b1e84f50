"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they are without; letters outside these keep their form.
MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőřśšťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorsstuuuuuuuyyzzz"


def pad_left(c: Column, width: int) -> Column:
    """Zeros on the left up to width; a longer text stays whole (lpad would cut it)."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def unmarked(c: Column) -> Column:
    """Without combining marks, and Latin letters without theirs; both cases."""
    return F.regexp_replace(F.translate(F.translate(c, MARKED, PLAIN), MARKED.upper().replace("Ÿ", "Ÿ"), PLAIN.upper()), "[\u0300-\u036f]", "")


def layer_text(c: Column) -> Column:
    """Lower case without marks; all but a-z, 0-9, _, - and blanks become _; blanks run together."""
    kept = F.regexp_replace(unmarked(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9_\- ]", "_")
    return F.trim(F.regexp_replace(kept, r" +", " "))


def name_key(c: Column) -> Column:
    """A name to compare by: without marks, other characters as blanks, upper case."""
    return F.upper(F.trim(F.regexp_replace(unmarked(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9]+", " ")))


def half_up(c: Column, places: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(c * 10**places + 0.5) / 10**places if places else F.floor(c + 0.5)


def label_kind(label: Column) -> Column:
    """Whether a text is a number (numero) or a name (denomination)."""
    t = F.trim(label)
    number = t.rlike(r"(?i)^(lot|tf|titre\s*foncier|parcelle|n)[°ºo.\s_-]*\d")
    n_digits, n_letters = F.regexp_count(t, F.lit(r"\d")), F.regexp_count(t, F.lit("[a-zA-Z]"))
    return F.when(t == "", "denomination").when(number | ((n_digits > 0) & (n_digits >= n_letters)), "numero").otherwise("denomination")


def text_lines(c: Column) -> Column:
    """Lines of a multi-line annotation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\\P|\r\n|\n"), lambda s: F.trim(s)), lambda s: s != "")


def area_text(m2: Column) -> Column:
    """Square metres, or hectares from one on."""
    return F.when(m2 >= 10000, F.format_string("%.2f ha", m2 / 10000)).otherwise(F.format_string("%.2f m²", m2))


def score_text(score: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(score.cast("double"), F.lit(0.0)))


def score_band(score: Column) -> Column:
    """The band that a score is coloured by."""
    return F.when(score >= 90, "good").when(score >= 70, "fair").when(score >= 50, "weak").otherwise("poor")


def table_cells(line: Column) -> Column:
    """The trimmed cells of a line of a Markdown table; null for any other line, and for the line under the head."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    rule = inner.rlike(r"^[\s:|-]+$") & F.contains(inner, F.lit("-"))
    return F.when(line.rlike(r"^\s*\|.*\|\s*$") & ~rule, F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)))


def file_name(c: Column) -> Column:
    """A name that is safe on disks: the last part of a path, with anything but letters, digits, dot, dash and underline replaced."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), "[^a-zA-Z0-9._-]", "_")


def folder_name(c: Column) -> Column:
    """A commune's name as a folder."""
    return F.upper(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"))


def stored_name(user: Column, at: Column, name: Column) -> Column:
    """user_milliseconds_name.geojson for an uploaded file; archives change their ending."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_"), "(?i)\\.zip$", ".geojson")
    safe = F.when(F.endswith(safe, F.lit(".geojson")), safe).otherwise(F.concat(safe, F.lit(".geojson")))
    return F.concat_ws("_", F.coalesce(user, F.lit("anon")), F.unix_millis(at).cast("string"), safe)


#: Kinds of report and how they are called (fixed values).
REPORTS = {"EXPERT": "d'Expert", "DETAILED": "Détaillé"}


def report_title(kind: Column, name: Column) -> Column:
    called = F.lit("Résumé")
    for k, v in REPORTS.items():
        called = F.when(kind == k, v).otherwise(called)
    return F.concat(F.lit("Rapport "), called, F.lit(" — "), name)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_base64(c: Column) -> Column:
    """The text that a base64 string holds; a data URL's head is left out."""
    return F.decode(F.unbase64(F.regexp_replace(c, "^data:[^,]*,", "")), "UTF-8")


def overridden(props: Column, more: Column) -> Column:
    """A map with the entries of another laid over it; the other's win."""
    kept = F.map_filter(props, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.when(more.isNull(), props).when(props.isNull(), more).otherwise(F.map_concat(kept, more))
