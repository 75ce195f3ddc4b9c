"""Text helpers that stay in generated code: nouns, labels, phrases, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.exprs import col
from millrace.functions.numbers import num_to_words

# What a model's chatter around a document looks like, in the order of removal.
CHATTER = [
    r"(?i)\A(here is|here's|sure[,!]?|certainly[,!]?)[^\n]*\n+",
    r"\A\*\*?[^\n]{0,80}\*\*?\n+",
    r"\A#+\s[^\n]*\n+",
    r"(?i)\n+\(?\s*word count[^\n]*\z",
]
# Fixed value: words in -s that are no plurals.
NOT_PLURAL = ("is", "was", "has", "its", "this")


def strip_generation(text: Column | str) -> Column:
    """Without opening chatter, a title line and a closing word count; blanks trimmed."""
    trim = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    out = trim(col(text))
    for p in CHATTER:
        out = F.regexp_replace(out, p, "")
    return trim(out)


# How an alias says what is counted.
COUNT_ALIAS = r"(?i)^(?:the )?(?:number|count) of (.+)$"
HOW_MANY = r"(?i)^how many ([a-z\- ]+?)(?: (?:it|there|they|that|who|which|were|are|orbit|live|grow|run|contains?|in|on|at|per)\b.*)?$"


def count_noun(aliases: Column, name: Column) -> Column:
    """What is counted: from an alias "number of ..." or "how many ...", else from the attribute's name."""
    number = F.transform(aliases, lambda a: F.regexp_extract(a, COUNT_ALIAS, 1))
    many = F.transform(aliases, lambda a: F.trim(F.regexp_extract(a, HOW_MANY, 1)))
    found = F.filter(F.concat(number, many), lambda x: x != "")
    plain = F.regexp_replace(F.replace(name, F.lit("_count"), F.lit("")), "_", " ")
    return F.when(F.size(found) > 0, found[0]).otherwise(F.concat(plain, F.when(name.endswith("s"), "").otherwise("s")))


def singularize_label(label: Column | str) -> Column:
    """The first plural word of a label made singular."""
    ws = F.split(col(label), " ")
    plural = lambda w: w.endswith("s") & ~w.endswith("ss") & ~F.lower(w).isin(*NOT_PLURAL)
    flags = F.transform(ws, plural)
    at = F.array_position(flags, F.lit(True))
    one = lambda w: F.when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.rlike("(sh|ch|x)es$"), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_join(F.transform(ws, lambda w, i: F.when(i + 1 == at, one(w)).otherwise(w)), " ")


def part_phrase(value: Column | str, label: Column | str, formatted: Column | str, unit: Column | str, words: bool = False) -> Column:
    """A part as its value and label; one of something takes the label's singular, a measure keeps its unit before the label."""
    whole = (col(value) == F.rint(col(value))) & col(unit).isNull()
    noun = F.when(whole & (col(value) == 1), singularize_label(label)).otherwise(col(label))
    return F.concat_ws(" ", value_phrase(value, formatted, unit, words), noun)


def value_phrase(value: Column | str, formatted: Column | str, unit: Column | str, words: bool = False) -> Column:
    """A count as a number or in words (below 1000), a measure with its unit."""
    n = F.rint(col(value)).cast("long")
    count = F.when(n < 1000, num_to_words(n)).otherwise(n.cast("string")) if words else n.cast("string")
    return F.when(col(unit).isNull() & (col(value) == F.rint(col(value))), count).otherwise(F.concat_ws(" ", col(formatted), col(unit)))
