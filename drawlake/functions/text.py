"""Dimension text as columns: normalisation, strict grammar, families and comparable keys."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number grammar, marker glyphs, and the word lists of layer and family rules.
UNSIGNED = r"(?:\d+(?:\.\d*)?|\.\d+)"
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
DIAMETER_MARKS = "⌀ØøΦφ∅"
NON_PROFILE_LAYER = (
    "(?i)(?:CONSTRUCTION|CONSTRUCT|DEBUG|MEASURE|DIMENSION|ANNOTATION|CENTERLINE|CENTRELINE|DATUM|GUIDE|HATCH|META)"
)
ASSUMED_LAYER = "(?i)(?:CLOSURE|SIMPLIFIED|FALLBACK|SOFT|TREAD_GOST.*REF)"
MAX_MAGNITUDE = 1e6


@lru_cache(maxsize=1)
def _compatibility() -> tuple[str, str, dict[str, str]]:
    """Characters whose NFKC form the grammar can read, from the Unicode tables: one for one, and one for several."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = unicodedata.normalize("NFKC", char)
        if folded == char or not all(" " <= c <= "~" or c in "ØøΦφδΔ±°×" for c in folded):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            longer[char] = folded
    return "".join(source), "".join(target), longer


def compatibility_form(text: Column) -> Column:
    """NFKC of the characters the grammar can use, on the JVM side; texts without any pass through."""
    source, target, longer = _compatibility()
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c <= "~", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    # Removing those characters and comparing lengths is far cheaper than a class of some hundred of them.
    several = F.length(F.translate(text, "".join(longer), "")) < F.length(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(F.when(several, spread).otherwise(text), source, target)).otherwise(text)


def is_profile_layer(layer: Column) -> Column:
    return ~layer.rlike(NON_PROFILE_LAYER)


def is_assumed_layer(layer: Column) -> Column:
    return layer.rlike(ASSUMED_LAYER)


def with_form(df: DataFrame, text: str = "text") -> DataFrame:
    """Attach ``_form``, the compatibility form of the text; what reads a text uses it where it is there already.

    It ends in a one-element ``explode``, so that it is evaluated once for all that read it.
    """
    return df if "_form" in df.columns else df.select("*", F.explode(F.array(compatibility_form(F.col(text)))).alias("_form"))


def once_per_text(rows: DataFrame, names: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``read`` adds to their texts ``names``; each different text is read once and joined back.

    ``read`` gets a table of different texts and must depend on nothing else; rows whose texts it leaves out go.
    """
    found = read(rows.select(*names).distinct())
    found = found.select(*[F.col(c).alias(f"_read_{c}" if c in names else c) for c in found.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_read_{c}")) for c in names])
    return rows.join(found, same).drop(*[f"_read_{c}" for c in names])


def with_dimension(df: DataFrame, text: str = "text", out: str = "dimension", keep_form: bool = False) -> DataFrame:
    """Attach ``struct(kind, nominal, upper, lower, unit, is_reference)`` parsed from the text.

    One regular expression splits a text into its parts.  Each stage ends in a one-element
    ``explode``: a filter on the parsed value would otherwise be pushed below the projections and
    the whole parser repeated inside it.
    """
    df = with_form(df, text)
    plain = F.replace(F.replace(F.col("_form"), F.lit(" "), F.lit("")), F.lit("−"), F.lit("-"))
    df = df.select("*", F.explode(F.array(plain)).alias("_n"))
    wrapped = F.col("_n").startswith("(") & F.col("_n").endswith(")") & (F.length("_n") > 1)
    body = F.when(wrapped, F.expr("substring(_n, 2, length(_n) - 2)")).otherwise(F.col("_n"))
    grammar = (
        rf"\A([{DIAMETER_MARKS}Rr])?({NUMBER})"
        rf"(?:±({NUMBER})|\^\{{?({NUMBER})\}}?_\{{?({NUMBER})\}}?|([+-])({UNSIGNED}))?(°)?\z"
    )
    parts = F.split(F.regexp_replace(body, grammar, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7\u0001$8"), "\u0001", -1)
    df = df.select(
        "*",
        F.explode(
            F.array(
                F.struct(
                    parts.alias("g"),
                    wrapped.alias("wrapped"),
                    F.col("_n").rlike(r"^(?i:ra)").alias("finish"),
                    F.col("_n").rlike(r"\A[δΔ][12]?\z").alias("symbol"),
                )
            )
        ).alias("_p"),
    )
    g = F.col("_p.g")
    special = F.col("_p.finish") | F.col("_p.symbol")

    def value(i):
        return F.get(g, i).try_cast("double")

    numbers = F.struct(
        F.when(F.get(g, 0) == "", "length").when(F.lower(F.get(g, 0)) == "r", "radius").otherwise("diameter").alias("mark"),
        (F.get(g, 7) == "°").alias("angle"), value(1).alias("nominal"), value(2).alias("sym"), value(3).alias("up"),
        value(4).alias("low"), (F.get(g, 5) == "+").alias("plus"), value(6).alias("one"), (F.size(g) == 8).alias("full"),
    )
    df = df.select("*", F.explode(F.array(numbers)).alias("_v"))
    one, plus = F.col("_v.one"), F.col("_v.plus")
    upper = F.coalesce(F.col("_v.sym"), F.col("_v.up"), F.when(plus, one), F.when(one.isNotNull(), F.lit(0.0)))
    lower = F.coalesce(-F.col("_v.sym"), F.col("_v.low"), F.when(plus, F.lit(0.0)), -one)
    df = df.select("*", F.explode(F.array(F.struct(upper.alias("upper"), lower.alias("lower")))).alias("_t"))

    def bounded(x):
        return F.coalesce(F.abs(x) <= MAX_MAGNITUDE, F.lit(True))

    mark, angle, upper, lower = F.col("_v.mark"), F.col("_v.angle"), F.col("_t.upper"), F.col("_t.lower")
    passes = (
        F.col("_v.full") & ~special & F.coalesce(upper >= lower, F.lit(True))
        & (one.isNull() | ((mark != "length") & ~angle))
        & bounded(F.col("_v.nominal")) & bounded(upper) & bounded(lower)
    )
    df = df.select("*", F.explode(F.array(passes)).alias("_ok"))
    good = F.col("_ok")
    kind = (
        F.when(F.col("_p.finish"), "surface_finish").when(F.col("_p.symbol"), "symbol")
        .when(good & angle, "angle").when(good, mark).otherwise("unknown")
    )
    parsed = F.struct(
        kind.alias("kind"),
        F.when(good, F.col("_v.nominal")).alias("nominal"),
        F.when(good, upper).alias("upper"),
        F.when(good, lower).alias("lower"),
        F.when(good, F.when(angle, "deg").otherwise("mm")).alias("unit"),
        (F.col("_p.wrapped") & ~special).alias("is_reference"),
    )
    return df.select("*", F.explode(F.array(parsed)).alias(out)).drop("_n", "_p", "_v", "_t", "_ok", *([] if keep_form else ["_form"]))


def compact_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def with_inclination(df: DataFrame, text: str = "text", out: str = "ratio", keep_form: bool = False) -> DataFrame:
    """Attach ``struct(numerator, denominator)`` of an ``n IN m`` taper note, else null."""
    df = with_form(df, text)
    flat = F.upper(F.replace(F.col("_form"), F.lit(" "), F.lit("")))
    df = df.select("*", F.explode(F.array(flat)).alias("_flat"))
    pattern = r"\A(?:INCLINE|INCLINATION|SLOPE|TAPER)?(\d+(?:\.\d+)?)IN(\d+(?:\.\d+)?)\z"
    parts = [F.regexp_extract("_flat", pattern, i).try_cast("double").alias(n) for i, n in ((1, "numerator"), (2, "denominator"))]
    df = df.select("*", F.explode(F.array(F.struct(*parts))).alias("_r"))
    top, bottom = F.col("_r.numerator"), F.col("_r.denominator")
    inside = (top > 0) & (top <= MAX_MAGNITUDE) & (bottom > 0) & (bottom <= MAX_MAGNITUDE)
    return df.withColumn(out, F.when(inside, F.col("_r"))).drop("_flat", "_r", *([] if keep_form else ["_form"]))


def with_family(df: DataFrame, text: str = "text", dimension: str = "dimension") -> DataFrame:
    """Attach the first matching ``family`` of a source note; null for an ordinary dimension.

    The folded text and the family end in one-element explodes for the reason given in
    :func:`with_dimension`.
    """
    df = with_inclination(df, text, "_ratio", keep_form=True)
    folded = F.struct(compact_upper(F.col("_form")).alias("flat"), F.col("_ratio").isNotNull().alias("ratio"))
    df = df.select("*", F.explode(F.array(folded)).alias("_f"))
    flat, kind = F.col("_f.flat"), F.col(f"{dimension}.kind")
    family = (
        F.when(F.col("_f.ratio"), "inclination")
        .when(flat.rlike("ROUGH.?TURNED|WHENROUGH|MHENROUGH"), "manufacturing_stage")
        .when(flat.rlike(r"\A\d+[-X×][⌀ØΦ∅]\d+(?:\.\d+)?HOLES?\z"), "hole_feature")
        .when(flat.rlike(r"INCLINE|INCLINATION|SLOPE|TAPER|\dIN\d"), "unresolved_inclination")
        .when((kind == "angle") & flat.startswith("R"), "conflicting_angle_prefix")
        .when(flat.rlike(r"RA.*R\d"), "mixed_radius_and_surface_glyphs")
        .when((kind == "unknown") & flat.rlike(r"R\d"), "unparsed_radius")
        .when((kind == "unknown") & flat.rlike(r"[⌀ØΦ∅]\d"), "compound_diameter")
    )
    return df.select("*", F.explode(F.array(family)).alias("family")).drop("_f", "_ratio", "_form")


def review_priority(text: Column, kind: Column, family: Column) -> Column:
    return (
        F.when(family.isin("manufacturing_stage", "hole_feature"), F.lit(None).cast("int"))
        .when(family.isNotNull(), 0)
        .when(kind == "length", 1)
        .when((kind == "unknown") & text.rlike(r"\d"), 2)
    )


def radius_text_issue(text: Column, parsed_kind: Column, parsed_nominal: Column, source: Column) -> Column:
    """``valid``, an issue code, or null when the text shows no radius marker at all."""
    flat = F.regexp_replace(compatibility_form(text), r"\s+", "")
    core = F.regexp_replace(F.regexp_replace(flat, r"^\(+", ""), r"\)+$", "")
    after = F.substring(core, F.lit(2), F.length(core))
    marker = (
        core.rlike("^[Rr]") & ~core.rlike("^(?i:ra)")
        & ((after == "") | ~after.rlike(r"^\p{L}") | F.lower(after).isin("o", "i", "l", "nan", "inf", "infinity"))
    )
    positive = F.coalesce(source["nominal"] > 0, F.lit(False))
    same = F.coalesce((parsed_kind == "radius") & (parsed_nominal > 0) & (parsed_nominal == source["nominal"]), F.lit(False))
    return F.when(
        marker | (parsed_kind == "radius"),
        F.when((source["kind"] != "radius") | ~positive, "source_radius_text_invalid_or_nonpositive")
        .when(~same, "source_radius_parsed_metadata_mismatch")
        .otherwise("valid"),
    )


def semantic_key(text: Column, dimension: Column, ratio: Column) -> Column:
    """Comparable reading of a text as one string; null when it has no dimension meaning."""
    d = dimension

    def show(value):
        return F.coalesce(value.cast("string"), F.lit("-"))

    return F.when(
        ratio.isNotNull(), F.concat_ws("|", F.lit("inclination_ratio"), show(ratio["numerator"]), show(ratio["denominator"]))
    ).when(
        d["kind"].isin("length", "angle", "radius", "diameter", "symbol"),
        F.concat_ws(
            "|", d["kind"], show(d["nominal"]), show(d["upper"]), show(d["lower"]), show(d["is_reference"]), show(d["unit"]),
            F.when(d["kind"] == "symbol", F.regexp_replace(text, r"\s", "")).otherwise("-"),
            F.when((d["kind"] == "angle") & text.rlike(r"^\s*[Rr]"), "conflicting_radius_angle_prefix").otherwise("-"),
        ),
    )


def path_problem(path: Column) -> Column:
    """Reason an archive member or relative path is refused, else null."""
    value = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(value == "", "empty")
        .when(value.startswith("/"), "absolute")
        .when(value.rlike(r"^[A-Za-z]:") | value.contains(":"), "drive")
        .when(value.rlike(r"(^|/)\.\.(/|$)"), "traversal")
        .when(value.contains("\u0000"), "nul")
    )


def case_token(case_id: Column) -> Column:
    """Key that pairs a case with its files: the drawing number, else the bare name."""
    number = F.regexp_extract(case_id, r"img_0*(\d+)", 1)
    bare = F.replace(F.replace(F.lower(case_id), F.lit("-main"), F.lit("")), F.lit("-"), F.lit(""))
    return F.when(number != "", number).otherwise(bare)


def after_anchor(path: Column, anchor: str = "/__dataset/") -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), anchor, -1)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]+", "[REDACTED]")
