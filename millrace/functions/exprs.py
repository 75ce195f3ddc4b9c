"""Scalar expressions: rounding, hashing, identifiers, text, safe arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a word (ASCII letters and digits, with inner apostrophes and hyphens).
WORD_PATTERN = r"[A-Za-z0-9][A-Za-z0-9'\-]*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sig(c: Column | str, digits: int = 9) -> Column:
    """Rounded to significant digits, so that sums taken in another order compare equal. NULL stays NULL.

    The factor moves exact ties, which decimal data have, off the middle.
    """
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits - 1}e", col(c).cast("double") * F.lit(1 + 1e-12)).cast("double"))


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities, else the value as a double."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def abs_err(pred: Column | str, truth: Column | str) -> Column:
    """NULL if either is missing."""
    return F.abs(finite(pred) - finite(truth))


def rel_err(pred: Column | str, truth: Column | str) -> Column:
    """NULL if either is missing or the truth is zero."""
    return F.try_divide(abs_err(pred, truth), F.abs(finite(truth)))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def _joined(parts: tuple[Column | str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def hash_key(seed: int, *parts: Column | str) -> Column:
    """The hex SHA-256 of seed|part|...: every random choice is a function of it, so none depends on partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), _joined(parts)), 256)


def hash01(seed: int, *parts: Column | str) -> Column:
    """A uniform number in [0, 1): the first 52 bits of the key."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_int(n: Column | int, seed: int, *parts: Column | str) -> Column:
    """A number in 0 .. n-1."""
    return F.pmod(F.conv(F.substring(hash_key(seed, *parts), 1, 12), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def choose(options: Column, seed: int, *parts: Column | str) -> Column:
    """An element of an array; NULL for an empty one."""
    return F.when(F.size(options) > 0, F.try_element_at(options, (1 + hash_int(F.greatest(F.size(options), F.lit(1)), seed, *parts)).cast("int")))


def choose_where(options: Column, keep: Callable[[Column], Column], seed: int, *parts: Column | str) -> Column:
    """An element among those that a condition keeps, among all if it keeps none."""
    kept = F.filter(options, keep)
    return choose(F.when(F.size(kept) > 0, kept).otherwise(options), seed, *parts)


def derive_seed(*parts: Column | str) -> Column:
    """The first 16 hex digits of SHA-256 modulo 2^31 - 1."""
    return F.pmod(F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(2147483647).cast("decimal(20,0)")).cast("long")


def count_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD_PATTERN)), F.lit(0))


def slugify(text: Column | str) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def opaque_document_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(_joined(parts), 256), 1, 12))


def is_opaque_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"\Adoc_[0-9a-f]{12}\z"), F.lit(False))


def make_world_id(theme: Column | str, index: Column | str, seed: Column | str) -> Column:
    return F.format_string("%s__w%02d__s%d", col(theme), col(index).cast("int"), col(seed).cast("int"))


def theme_of(world_id: Column | str) -> Column:
    return F.element_at(F.split(col(world_id), "__"), 1)


def corpus_id(condition: Column | str, provenance: Column | str, density: Column | str, n: Column | str, baseline: Column | str) -> Column:
    """Condition, provenance, density in percent (half-even) and size; the baseline, where there is one, at the end."""
    head = F.format_string("%s__%s__d%03d__n%04d", col(condition), col(provenance), F.bround(col(density) * 100).cast("int"), col(n).cast("int"))
    return F.concat(head, F.when(col(baseline).isNotNull(), F.concat(F.lit("__bl-"), col(baseline))).otherwise(F.lit("")))


def experiment_id(date: Column | str, theme: Column | str, world: Column | str, seed: Column | str) -> Column:
    return F.concat_ws("_", col(date), col(theme), col(world), F.concat(F.lit("seed"), col(seed).cast("string")))


def label_prefix(variant: Column | str, labels: dict[str, str]) -> Column:
    """The variant's prefix, empty for other variants and NULL."""
    return F.coalesce(reduce(lambda w, k: w.when(col(variant) == k, F.lit(labels[k])), labels, F.when(F.lit(False), "")), F.lit(""))


def apply_template(template: Column | str, name: Column | str) -> Column:
    """{name} filled in; an article before a name that brings its own is dropped."""
    filled = F.replace(col(template), F.lit("{name}"), col(name))
    return F.when(F.lower(col(name)).startswith("the "), F.regexp_replace(filled, r"(?i)\bthe (the )", "$1")).otherwise(filled)


def format_value(value: Column | str, decimals: int) -> Column:
    """Whole numbers without a point, others with fixed decimals; no thousands separators; ties go away from zero."""
    x = col(value).cast("double") * F.lit(1 + 1e-12)
    return F.when(x.isNotNull(), F.format_string(f"%.{decimals}f", x))


def snippet(text: Column | str, start: Column, end: Column, around: int = 90) -> Column:
    """The text around a match (offsets from 0), line breaks as blanks, an ellipsis where it is clipped."""
    t = col(text)
    a, b = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(t))
    body = F.translate(F.substring(t, (a + 1).cast("int"), (b - a).cast("int")), "\n", " ")
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(t), "…").otherwise(""))


def clipped(zone: Column | str, left: Column | str, right: Column | str) -> Column:
    """A piece of a text with line breaks as blanks, and an ellipsis on each side where the text goes on."""
    return F.concat(F.when(col(left), "…").otherwise(""), F.translate(col(zone), "\n", " "), F.when(col(right), "…").otherwise(""))


def stable_hash(record: Column, digits: int = 12) -> Column:
    """The first digits of the SHA-256 of a map's entries in the order of their keys, so that the order of writing does not matter; record: map<string, any>."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.map_entries(record))), 256), 1, digits)


def shown(c: Column | str, decimals: int = 3) -> Column:
    """A value for a report: a dash for NULL, n/a for NaN, fixed decimals else."""
    x = col(c)
    return F.when(x.isNull(), F.lit("–")).when(F.isnan(x.cast("double")), F.lit("n/a")).otherwise(F.format_string(f"%.{decimals}f", x.cast("double")))


def escaped(c: Column | str) -> Column:
    """Text safe within HTML."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), col(c))


def custom_order(c: Column | str, order: list[str]) -> Column:
    """The place in a list, 999 for anything else."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), col(c))
    return F.coalesce(F.when(at > 0, at - 1), F.lit(999)).cast("int")
