"""Text normalisers and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from harvestlens.functions.numeric import to_column

# Spellings accepted for yes/no columns and crop labels.
TRUE_WORDS = ["1", "1.0", "irrigated", "yes", "y", "true", "t"]
FALSE_WORDS = ["0", "0.0", "non-irrigated", "non irrigated", "no", "n", "false", "f"]
MISSING_WORDS = ["", "none", "null"]
CROP_WORDS = {"Corn": ["corn"], "Soybeans": ["soybeans", "soybean", "soy"]}


def _folded(c) -> Column:
    return F.lower(F.trim(to_column(c).cast("string")))


def eq_ci(c, value) -> Column:
    """Equality that ignores case and surrounding blanks."""
    value = F.lit(value) if isinstance(value, str) else value
    return _folded(c) == F.lower(F.trim(value))


def norm_flag(c) -> Column:
    """Messy yes/no text to 1, 0 or NULL; other numbers count as yes from 1 upward."""
    word = _folded(c)
    number = word.try_cast("double")
    whole = F.when(~F.isnan(number), number).try_cast("bigint")
    return (
        F.when(word.isin(MISSING_WORDS), F.lit(None).cast("int"))
        .when(word.isin(TRUE_WORDS), F.lit(1))
        .when(word.isin(FALSE_WORDS), F.lit(0))
        .when(whole >= 1, F.lit(1))
        .when(whole < 1, F.lit(0))
    )


def flag_is(c, wanted: int) -> Column:
    """Filter form of the yes/no spelling lists, for pushing into a scan."""
    return _folded(c).isin(TRUE_WORDS if wanted == 1 else FALSE_WORDS)


def norm_crop(c, strict: bool = False) -> Column:
    """Canonical crop label; unknown labels become NULL, or an error when strict."""
    word = _folded(c)
    label = F.coalesce(*[F.when(word.isin(words), F.lit(name)) for name, words in CROP_WORDS.items()])
    if strict:
        refused = F.raise_error(F.concat(F.lit("unsupported crop: "), F.coalesce(word, F.lit("NULL"))))
        return F.coalesce(label, refused.cast("string"))
    return label


def geoid(state, county) -> Column:
    """Zero-padded five-digit county key."""

    def padded(c, width):
        text = F.trim(to_column(c).cast("string"))
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))

    return F.concat(padded(state, 2), padded(county, 3))


def split_geoid(c) -> tuple[Column, Column]:
    c = to_column(c)
    return F.substring(c, 1, 2), F.substring(c, 3, 3)


def digits_only(c) -> Column:
    return F.regexp_replace(to_column(c).cast("string"), r"\D", "")


def path_parts(c) -> tuple[Column, Column]:
    """(folder, file) of a path: its last two segments."""
    tail = F.substring_index(to_column(c), "/", -2)
    return F.substring_index(tail, "/", 1), F.substring_index(tail, "/", -1)


def to_payload(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def from_payload(c, schema) -> Column:
    return F.from_json(to_column(c), schema)
