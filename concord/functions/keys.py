"""Blocking-key functions as column expressions.

Each function maps a column to ``array<string>``, the keys of a value.  They are
built-in SQL functions only, so they stay in the JVM; the two phonetic ones are
Arrow functions over whole batches.  String functions expect a value that
``prepared`` has cleaned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.metaphone import double_metaphone

#: Deleted by prepared(): the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NONE = "cast(array() as array<string>)"


def _nothing() -> Column:
    return F.expr(_NONE)


def prepared(x: Column) -> Column:
    """Punctuation deleted, white space folded to single spaces, ends trimmed; letters keep their case."""
    bare = F.translate(x, PUNCTUATION, "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def as_text(x: Column, kind: T.DataType) -> Column:
    """A value as Python's str() shows it, with exponents unpadded."""
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, T.BooleanType):
        return F.when(x, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        d = x.cast("double")
        size = F.abs(d)
        shown = d.cast("string")
        whole = F.regexp_replace(F.format_number(d, 1), ",", "")
        # Java writes 1.0E-4 where Python writes 0.0001 or 1e-05
        mantissa = F.regexp_replace(F.regexp_extract(shown, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
        power = F.regexp_extract(shown, r"E(-?[0-9]+)$", 1)
        written = F.concat(mantissa, F.lit("e"), F.when(power.startswith("-"), power).otherwise(F.concat(F.lit("+"), power)))
        digits = F.regexp_replace(mantissa, r"[-.]", "")
        small = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0.000"), digits)
        large = d.cast("decimal(38,10)").cast("string")
        large = F.regexp_replace(large, r"0+$", "")
        text = F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf")).when(d == float("-inf"), F.lit("-inf"))
        text = text.when((d == F.rint(d)) & (size < 1e16), whole).when((size >= 1e-4) & (size < 1e-3), small)
        text = text.when(size < 1e-4, written).when((size >= 1e7) & (size < 1e16), large).when(size >= 1e16, written)
        return text.otherwise(shown)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(x, lambda v: _quoted(v, kind.elementType))
        return F.concat(F.lit("["), F.array_join(inner, ", ", "None"), F.lit("]"))
    return x.cast("string")


def _quoted(x: Column, kind: T.DataType) -> Column:
    text = as_text(x, kind)
    if not isinstance(kind, T.StringType):
        return text
    single = F.concat(F.lit("'"), text, F.lit("'"))
    return F.when(F.contains(text, F.lit("'")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def truthy(x: Column, kind: T.DataType) -> Column:
    """Whether a value counts: not null, not false, not zero, not empty.  NaN counts."""
    if isinstance(kind, T.StringType):
        test = x != ""
    elif isinstance(kind, T.BooleanType):
        test = x
    elif isinstance(kind, T.NumericType):
        test = x != 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(x) > 0
    else:
        test = x.isNotNull()
    return F.coalesce(test, F.lit(False))


# -- parts that several functions use ------------------------------------------------------------


def tokens(x: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def word_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)([\w']+)"), F.lit(1))


def _found(x: Column, pattern: str) -> Column:
    got = F.regexp_extract(x, pattern, 1)
    return F.when(got != "", F.array(got)).otherwise(_nothing())


def _integers(x: Column) -> Column:
    runs = F.regexp_extract_all(x, F.lit(r"(?U)(\d+)"), F.lit(1))
    return F.transform(runs, lambda d: F.regexp_replace(d, "^0+(?=.)", ""))


def _pieces(x: Column, n: int) -> Column:
    """All substrings of n characters, in order."""
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(_nothing())


def _runs(items: Column, n: int) -> Column:
    """All n neighbours of an array, joined by a space."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))).otherwise(_nothing())


def _unspaced(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def _hundreds(x: Column, last: Callable[[Column], Column]) -> Column:
    return F.transform(_integers(x), lambda d: F.concat(F.substring(d, F.lit(1), F.greatest(F.length(d) - 2, F.lit(0))), F.lit("0"), last(d)))


def _near(x: Column) -> Column:
    def around(d):
        n = F.when(d.rlike("^[0-9]{1,37}$"), d.try_cast("decimal(38,0)"))
        return F.when(n.isNull(), F.array(d)).otherwise(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: (n + k).cast("decimal(38,0)").cast("string")))

    return F.flatten(F.transform(_integers(x), around))


# -- string functions ----------------------------------------------------------------------------

STRING_KEYS: dict[str, Callable[[Column], Column]] = {
    "wholeFieldPredicate": lambda x: F.array(x),
    "tokenFieldPredicate": word_tokens,
    "firstTokenPredicate": lambda x: _found(x, r"(?U)^([\w']+)"),
    "firstTwoTokensPredicate": lambda x: _found(x, r"(?U)^([\w']+\W+[\w']+)"),
    "commonIntegerPredicate": _integers,
    "nearIntegersPredicate": _near,
    "firstIntegerPredicate": lambda x: _found(x, r"(?U)^(\d+)"),
    "hundredIntegerPredicate": lambda x: _hundreds(x, lambda d: F.lit("0")),
    "hundredIntegersOddPredicate": lambda x: _hundreds(x, lambda d: (F.substring(d, -1, 1).cast("int") % 2).cast("string")),
    "alphaNumericPredicate": lambda x: F.regexp_extract_all(x, F.lit("([A-Za-z0-9]*[0-9][A-Za-z0-9]*)"), F.lit(1)),
    "sameThreeCharStartPredicate": lambda x: F.array(F.substring(_unspaced(x), 1, 3)),
    "sameFiveCharStartPredicate": lambda x: F.array(F.substring(_unspaced(x), 1, 5)),
    "sameSevenCharStartPredicate": lambda x: F.array(F.substring(_unspaced(x), 1, 7)),
    "commonTwoTokens": lambda x: _runs(tokens(x), 2),
    "commonThreeTokens": lambda x: _runs(tokens(x), 3),
    "fingerprint": lambda x: F.array(F.array_join(F.array_sort(tokens(x)), "")),
    "oneGramFingerprint": lambda x: F.array(F.array_join(F.array_sort(F.array_distinct(F.split(_unspaced(x), ""))), "")),
    "twoGramFingerprint": lambda x: F.when(F.length(x) > 1, F.array(F.array_join(F.array_sort(F.array_distinct(_pieces(_unspaced(x), 2))), ""))).otherwise(_nothing()),
    "sortedAcronym": lambda x: F.array(F.array_join(F.array_sort(F.transform(tokens(x), lambda t: F.substring(t, 1, 1))), "")),
    "commonFourGram": lambda x: _pieces(_unspaced(x), 4),
    "commonSixGram": lambda x: _pieces(_unspaced(x), 6),
    "suffixArray": lambda x: F.when(F.length(x) > 4, F.transform(F.sequence(F.lit(1), F.length(x) - 4), lambda i: F.substring(x, i, F.length(x)))).otherwise(_nothing()),
    "doubleMetaphone": lambda x: double_metaphone(F.array(x)),
    "metaphoneToken": lambda x: double_metaphone(F.array_distinct(tokens(x))),
}

# -- set functions; elements are text in sorted order ----------------------------------------------


def _members(x: Column, kind: T.DataType) -> Column:
    element = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
    return F.transform(F.array_sort(F.array_distinct(x)), lambda v: as_text(v, element))


def order_of_magnitude(x: Column) -> Column:
    """rint(log10 x), half to even, of what is above zero."""
    return F.when(x > 0, F.array(F.rint(F.log10(x)).cast("bigint").cast("string"))).otherwise(_nothing())


SET_KEYS: dict[str, Callable[[Column], Column]] = {
    "wholeSetPredicate": lambda m: F.array(F.concat(F.lit("{"), F.array_join(F.transform(m, lambda v: _quoted(v, T.StringType())), ", "), F.lit("}"))),
    "commonSetElementPredicate": lambda m: m,
    "commonTwoElementsPredicate": lambda m: _runs(m, 2),
    "commonThreeElementsPredicate": lambda m: _runs(m, 3),
    "lastSetElementPredicate": lambda m: F.array(F.element_at(m, -1)),
    "firstSetElementPredicate": lambda m: F.array(F.element_at(m, 1)),
    "magnitudeOfCardinality": lambda m: order_of_magnitude(F.size(m)),
}

# -- numbers and places ------------------------------------------------------------------------------


def round_to_one(x: Column) -> Column:
    """One significant figure, as an integer's text."""
    d = x.cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(d))))
    return F.when(d != 0, F.array((F.signum(d) * F.rint(F.abs(d) / unit) * unit).cast("bigint").cast("string"))).otherwise(_nothing())


def lat_long_grid(x: Column) -> Column:
    """A cell of a tenth of a degree; none for (0, 0).  x: a struct or array of two numbers."""
    lat, lon = x[0], x[1]

    def cell(v):
        text = F.format_number(v.cast("double"), 1)
        return F.when(text == "-0", F.lit("-0.0")).otherwise(text)

    both = (lat != 0) | (lon != 0)
    return F.when(both, F.array(F.concat(F.lit("("), cell(lat), F.lit(", "), cell(lon), F.lit(")")))).otherwise(_nothing())


NUMBER_KEYS: dict[str, Callable[[Column], Column]] = {"orderOfMagnitude": order_of_magnitude, "roundTo1": round_to_one}
PLACE_KEYS: dict[str, Callable[[Column], Column]] = {"latLongGridPredicate": lat_long_grid}


def keys(name: str, x: Column, kind: T.DataType, as_string: bool = True) -> Column:
    """Distinct keys of a column by the function of that name; an empty array for values that don't count.

    ``as_string`` cleans the value as string variables do; without it the value is only turned to text.
    """
    if name in SET_KEYS:
        found = SET_KEYS[name](_members(x, kind))
    elif name in NUMBER_KEYS:
        found = NUMBER_KEYS[name](x)
    elif name in PLACE_KEYS:
        pair = F.array(x["lat"], x["lon"]) if isinstance(kind, T.StructType) and {"lat", "lon"} <= set(kind.names) else x
        found = PLACE_KEYS[name](pair)
    elif name in STRING_KEYS:
        text = as_text(x, kind)
        found = STRING_KEYS[name](prepared(text) if as_string else text)
    else:
        raise ValueError(f"no key function is named {name}")
    return F.when(truthy(x, kind), F.array_distinct(F.coalesce(found, _nothing()))).otherwise(_nothing())
