"""Printed figures to numbers, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<txt:string,num:double,prefix:string,suffix:string,paren_neg:boolean>"
_SPACES = r"(?U)^\s+|\s+$"
_FAST = r"^\(?-?[\d,]+(?:\.\d+)?\)?%?$"
_FLOAT = r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_CURRENCY = r"(?i)^(aed|usd|eur|gbp|egp|sar|rs\.?|\$|£|€)\s*"
_BLANKS = ["", "-", "–", "—", "--", "nil", "n/a", "na"]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def settle(df: DataFrame) -> DataFrame:
    """df behind a filter that is always true and that the optimiser can't see through, so that it does not copy
    the long expressions below into each of their uses above."""
    return df.filter(F.rand() >= 0)


def keep(df: DataFrame) -> DataFrame:
    """df persisted (memory, then disk). What is read from tables feeds several consumers, and behind a persisted
    result the optimiser doesn't compare its nested lambdas with the consumers' filters, which takes it minutes.
    The caller may unpersist it; lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, _SPACES, "")


def normspace(x: Column) -> Column:
    """White space, no-break spaces and replacement characters to single spaces, trimmed."""
    return _strip(F.regexp_replace(F.translate(x, "� \n", "   "), r"(?U)\s+", " "))


def _value(num: Column, prefix: Column, percent: Column, paren: Column) -> Column:
    dressed = (prefix != "") | percent | paren
    rounded = F.when(num == F.rint(num), num).otherwise(F.bround(num, 4)) + F.lit(0.0)
    return F.struct(
        rounded.alias("num"), F.when(dressed, prefix).alias("prefix"), F.when(dressed, F.when(percent, "%").otherwise("")).alias("suffix"), (dressed & paren).alias("paren_neg")
    )


_N = r"(?:[0-9]{1,3}(?:,[0-9]{3}){1,3}|[0-9]{1,12})(?:\.[0-9]{1,4})?"
_SIGN = r"(?i:AED|USD|EUR|GBP|EGP|SAR|\$|£|€)"
#: Figures as they are mostly printed, by one decoration each: sign or percent, parentheses (also turned round), currency, credit side, decimal comma.
_POINT = rf"-?{_N}%?|{_N}-|\({_N}%?\)|\){_N}\(|{_SIGN} ?{_N}(?: ?[$£€])?|{_N} (?i:CR|DR)"
_COMMA = r"[0-9]{1,3}(?:\.[0-9]{3}){1,3},[0-9]{1,2}|[0-9]{1,12},[0-9]{1,2}"
_COMMON = rf"^(?:{_POINT}|{_COMMA})$"
_SEPARATED = r"^\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?$"


def _common(s: Column) -> Column:
    """The value of a text that is like _COMMON, by plain functions that are compiled; parse_number gives the same the long way."""
    comma = s.rlike(f"^(?:{_COMMA})$")
    digits = F.regexp_replace(F.when(comma, F.translate(s, ",.", ".")).otherwise(s), "[^0-9.]", "")
    paren, percent = s.startswith("(") | s.startswith(")"), s.endswith("%")
    negative = paren | F.contains(s, F.lit("-")) | F.lower(s).endswith("cr")
    value = digits.cast("double") * F.when(negative, F.lit(-1.0)).otherwise(1.0) + F.lit(0.0)
    prefix = F.regexp_extract(s, f"^{_SIGN}", 0)
    dressed = (prefix != "") | percent | paren
    return F.struct(value.alias("num"), F.when(dressed, prefix).alias("prefix"), F.when(dressed, F.when(percent, "%").otherwise("")).alias("suffix"), (dressed & paren).alias("paren_neg"))


def parse_number(raw: Column) -> Column:
    """As _parsed, with the common forms first."""
    text = raw.cast("string")
    return F.when(text.rlike(_COMMON), _common(text)).otherwise(_parsed(text))


def _parsed(raw: Column) -> Column:
    """struct(num, prefix, suffix, paren_neg) of a printed figure; null if it is none.

    Reads thousands separators, parentheses (also reversed), leading and trailing minus, CR and DR,
    currencies, percent signs, footnote marks and European decimals. Several numbers glued
    together, runs of more than 16 digits and blanks (dash, nil, n/a) are no numbers."""
    text = raw.cast("string")
    none = F.lit(None).cast("struct<num:double,prefix:string,suffix:string,paren_neg:boolean>")

    def signed(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\*+$", "")
        bare = F.regexp_replace(bare, r"\s+$", "")
        lead = r"^\)\s*\(\s*([\d,]+(?:\.\d+)?)\s*$"
        both = s.startswith("(") & bare.endswith(")")
        swapped = s.startswith(")") & bare.endswith("(")
        front = s.rlike(lead)
        inner = F.when(both, F.regexp_extract(s, r"(?s)^\((.*)\)[^)]*$", 1)).when(swapped, F.regexp_extract(s, r"(?s)^\)(.*)\([^(]*$", 1)).when(front, F.regexp_extract(s, lead, 1)).otherwise(s)
        return F.struct(inner.alias("s"), (both | swapped | front).alias("paren"))

    def credited(x: Column) -> Column:
        side = F.lower(F.regexp_extract(x["s"], r"(?i)\b(cr|dr)\b\.?$", 1))
        return F.struct(F.when(side != "", _strip(F.regexp_replace(x["s"], r"(?i)\b(cr|dr)\b\.?$", ""))).otherwise(x["s"]).alias("s"), x["paren"].alias("paren"), (x["paren"] != (side == "cr")).alias("neg"))

    def priced(x: Column) -> Column:
        lead, rest = F.regexp_extract(x["s"], _CURRENCY, 1), F.regexp_replace(x["s"], _CURRENCY, "")
        trail = F.regexp_extract(rest, r"\s*([$£€])\s*$", 1)
        return F.struct(F.regexp_replace(rest, r"\s*([$£€])\s*$", "").alias("s"), x["paren"].alias("paren"), x["neg"].alias("neg"), F.when(lead != "", lead).otherwise(trail).alias("currency"))

    def marked(x: Column) -> Column:
        percent = F.regexp_replace(x["s"], r"\s+$", "").endswith("%")
        s = F.regexp_replace(F.regexp_replace(x["s"], r"[%\s]+$", ""), r"\s*[*†‡]$", "")
        s = _strip(F.regexp_replace(s, r"(?i)\s*\([a-z0-9]{1,3}\)$", ""))
        minus = s.rlike(r"\d-$")
        s = F.regexp_replace(F.when(minus, _strip(F.regexp_replace(s, "-$", ""))).otherwise(s), r"^[+-]+", "")
        unit = (x["currency"] != "") & _strip(x["s"]).rlike(r"^'?0{2,3}$")
        return F.struct(s.alias("s"), x["paren"].alias("paren"), (x["neg"] != minus).alias("neg"), x["currency"].alias("currency"), percent.alias("percent"), unit.alias("unit"))

    def number(x: Column) -> Column:
        tokens = F.filter(F.split(x["s"], r"\s+"), lambda t: t != "")

        def whole(t: Column) -> Column:
            n = F.size(t)
            spaced = F.get(t, F.lit(0)).rlike(r"^\d{1,3}$") & F.forall(F.slice(t, 2, F.greatest(n - 2, F.lit(0))), lambda y: y.rlike(r"^\d{3}$")) & F.get(t, n - 1).rlike(r"^\d{3}(?:\.\d+)?$")
            torn = F.array_join(t, "").rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$")
            figures = F.size(F.filter(t, lambda y: y.rlike(_FAST)))
            return (n <= 1) | spaced | torn | (figures < 2)

        flat = F.regexp_replace(x["s"], r"\s+", "")
        flat = F.when(flat.rlike(r"^[\d.]*,\d{1,2}$"), F.translate(flat, ".,", "\u0001.")).otherwise(F.replace(flat, F.lit(","), F.lit("")))
        flat = F.replace(flat, F.lit("\u0001"), F.lit(""))
        good = x["s"].rlike(r"\d") & ~x["unit"] & let(tokens, whole) & flat.rlike(_FLOAT) & (F.length(F.regexp_replace(flat, r"\D", "")) <= 16)
        val = F.when(good, flat.try_cast("double"))
        val = F.when(val < F.lit(float("inf")), val)
        sign = F.when(_strip(text).startswith("-"), F.lit(-1.0)).otherwise(1.0)
        return let(val, lambda v: F.when(v.isNotNull(), _value(F.when(x["neg"], -v).otherwise(v * sign), x["currency"], x["percent"], x["paren"])).otherwise(none))

    start = F.regexp_replace(_strip(F.translate(text, " −", " -")), "[⁰¹²³⁴-⁹]", "")
    return let(start, lambda s: F.when(F.lower(s).isin(_BLANKS), none).otherwise(let(let(let(let(signed(s), credited), priced), marked), number)))


def coerce_cell(raw: Column) -> Column:
    """A cell as CELL: a number, or its text; a bare dash stays text, blanks have neither."""
    text = raw.cast("string")
    # Digits, commas and a point, in parentheses or with a percent sign: commas are separators, also a lone one.
    neg, percent = text.startswith("(") & F.contains(text, F.lit(")")), text.endswith("%")
    number = F.regexp_replace(text, "[()%,]", "").cast("double") * F.when(neg, F.lit(-1.0)).otherwise(1.0) + F.lit(0.0)
    dressed = F.when(neg | percent, "")
    void = F.lit(None).cast("string")
    separated = F.struct(void.alias("txt"), number.alias("num"), dressed.alias("prefix"), F.when(neg | percent, F.when(percent, "%").otherwise("")).alias("suffix"), neg.alias("paren_neg"))
    quick = _common(text)
    common = F.struct(void.alias("txt"), *[quick[k].alias(k) for k in ("num", "prefix", "suffix")], F.coalesce(quick["paren_neg"], F.lit(False)).alias("paren_neg"))
    return F.when(text.rlike(_SEPARATED), separated).when(text.rlike(_COMMON), common).otherwise(_coerced(text))


def _coerced(raw: Column) -> Column:
    def cell(s: Column) -> Column:
        neg, percent = s.startswith("(") & F.contains(s, F.lit(")")), F.regexp_replace(s, r"\)+$", "").endswith("%")
        digits = F.replace(F.regexp_replace(s, r"^[()%]+|[()%]+$", ""), F.lit(","), F.lit(""))
        fast = s.rlike(_FAST) & digits.rlike(r"^-?\d+(\.\d+)?$")
        num = digits.try_cast("double") * F.when(neg, F.lit(-1.0)).otherwise(1.0) + F.lit(0.0)
        plain = F.struct(num.alias("num"), F.when(neg | percent, "").alias("prefix"), F.when(neg | percent, F.when(percent, "%").otherwise("")).alias("suffix"), neg.alias("paren_neg"))
        found = F.when(s.isin("", "-", "–") | (s.rlike(_FAST) & ~fast), None).when(fast, plain).otherwise(parse_number(s))
        return let(found, lambda v: F.struct(F.when(v["num"].isNull() & (s != ""), s).alias("txt"), v["num"].alias("num"), v["prefix"].alias("prefix"), v["suffix"].alias("suffix"), F.coalesce(v["paren_neg"], F.lit(False)).alias("paren_neg")))

    return let(F.coalesce(normspace(raw.cast("string")), F.lit("")), cell)


def formatted(num: Column, prefix: Column, suffix: Column, paren_neg: Column) -> Column:
    """The figure as it was printed: prefix, thousands separators, suffix, parentheses for negatives that had them."""
    body = F.regexp_replace(F.regexp_replace(F.format_number(F.abs(num), 10), r"0+$", ""), r"\.$", "")
    gap = F.when(prefix.rlike(r"[A-Za-z]$"), " ").otherwise("")
    shown = F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(gap, F.lit("")), body, F.coalesce(suffix, F.lit("")))
    return F.when((num < 0) & paren_neg, F.concat(F.lit("("), shown, F.lit(")"))).when(num < 0, F.concat(F.lit("-"), shown)).otherwise(shown)
