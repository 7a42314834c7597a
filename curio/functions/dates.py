"""Free-text dates to (start, end, precision), as staged Column expressions.

Each stage is a ``select`` of its own, so that a regular expression runs once a row and the rules
only combine named columns.  Years before the common era are plain negative numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_VERSION = "curio-1"
#: Precision words of one source.
PRECISION_WORDS = {"en": "exact", "vers": "circa", "entre": "range", "après": "after", "apres": "after", "avant": "before", "début": "circa", "debut": "circa", "fin": "circa"}

# The patterns that the rules are made of.
_UNKNOWN = r"^(n\.?d\.?|unknown|undated|sans date)$"
_BCE = r"\bb\.?\s?c\.?(\s?e\.?)?\b|\bav\.?\s?j\.?-?c\.?"
_CIRCA = r"\bca?\.|\bcirca\b|\babout\b|\bapprox|\bvers\b|\benviron\b"
_CIRCA_WORDS = r"\b(?:ca?\.|circa|about|approx\.?|vers|environ)\s*"
_ISO = r"(-?\d{3,4})-\d{2}-\d{2}\b"
_YEAR3, _YEAR1 = r"(?<![\w.])-?\d{3,4}\b", r"(?<![\w.])-?\d{1,4}\b"
_CENTURY = r"(\d{1,2})(?:st|nd|rd|th)?\s*(?:-\s*(\d{1,2})(?:st|nd|rd|th)?\s*)?centur(?:y|ies)"
_DECADE = r"\b(\d{3,4})s\b"
_RANGE = r"(?<![\w.])(-?\d{1,4})\s*(?:-|/|or|ou|to)\s*(-?\d{1,4})\b"

_NONE = "struct<start:int,end:int,precision:string>"


def normalize(text: Column) -> Column:
    """Dashes made alike, white space collapsed, trimmed, lower-cased; null is the empty text."""
    dashes = F.regexp_replace(F.coalesce(text, F.lit("")), "[‐-―−]", "-")
    return F.lower(F.trim(F.regexp_replace(dashes, r"\s+", " ")))


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *(c.alias(name) for name, c in columns.items()))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _signed(digits: Column) -> Column:
    return F.when(digits.startswith("-"), _int(digits)).otherwise(F.col("_sign") * _int(digits))


def _result(start: Column, end: Column, precision: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), precision.alias("precision"))


def parse(df: DataFrame, text: str, into: str = "parsed") -> DataFrame:
    """``df`` with the struct ``into`` (start, end, precision); the struct is null where the text says nothing."""
    null = F.lit(None)
    circa_or = lambda other: F.when(F.col("_circa"), "circa").otherwise(other)
    d = _add(df, _n=normalize(F.col(text)))
    d = _add(d, _sign=F.when(F.col("_n").rlike(_BCE), -1).otherwise(1), _circa=F.col("_n").rlike(_CIRCA), _t=F.regexp_replace("_n", _ISO, "$1"))
    bounded = reduce(lambda c, r: F.regexp_replace(c, *r), ((r"\bnot after\b", "before"), (r"\bnot before\b", "after"), (r"\bavant\b", "before"), (r"\bapr[eè]s\b", "after")), F.col("_t"))
    d = _add(d, _going=F.col("_t").rlike(r"\b(ongoing|present)\b"), _any=F.regexp_extract("_t", r"(-?\d{1,4})", 1), _b=bounded, _plain=F.regexp_replace("_t", _CIRCA_WORDS, ""))
    every = F.regexp_extract_all("_t", F.lit(_YEAR1), F.lit(0))
    d = _add(
        d,
        _before=F.col("_b").rlike(r"\bbefore\b"), _after=F.col("_b").rlike(r"\bafter\b"),
        _y3=F.regexp_extract_all("_b", F.lit(_YEAR3), F.lit(0)), _y1=F.regexp_extract_all("_b", F.lit(_YEAR1), F.lit(0)),
        _c1=F.regexp_extract("_t", _CENTURY, 1), _c2=F.regexp_extract("_t", _CENTURY, 2), _s=F.regexp_extract("_t", _DECADE, 1),
        _r1=F.regexp_extract("_plain", _RANGE, 1), _r2=F.regexp_extract("_plain", _RANGE, 2),
        # the longest run of digits, the first of equals
        _long=F.array_max(F.transform(every, lambda s, i: F.struct(F.length(F.ltrim(s, F.lit("-"))).alias("n"), (-i).alias("i"), s.alias("s"))))["s"],
    )
    d = _add(d, _ys=F.when(F.size("_y3") > 0, F.col("_y3")).otherwise(F.col("_y1")))
    d = _add(d, _ya=F.get("_ys", F.lit(0)), _yb=F.get("_ys", F.lit(1)))
    sign = F.col("_sign")

    after_before = (
        F.when(F.col("_yb").isNotNull(), _result(_signed(F.col("_ya")), _signed(F.col("_yb")), circa_or("range")))
        .when(F.col("_ya").isNull(), F.lit(None).cast(_NONE))
        .when(F.col("_before") & ~F.col("_after"), _result(null, _signed(F.col("_ya")), F.lit("before")))
        .otherwise(_result(_signed(F.col("_ya")), null, F.lit("after")))
    )
    first = _int(F.col("_c1"))
    last = F.coalesce(_int(F.nullif("_c2", F.lit(""))), first)
    century = F.when(sign < 0, _result(-(first * 100), -((last - 1) * 100 + 1), F.lit("century"))).otherwise(_result((first - 1) * 100 + 1, last * 100, F.lit("century")))
    decade = sign * _int(F.col("_s"))
    a, b = _int(F.col("_r1")), _int(F.col("_r2"))
    near = a - F.pmod(a, F.lit(100)) + b
    complete = F.when((F.abs(b) >= 100) | (F.abs(a) < 100), b).when(near < a, near + 100).otherwise(near)
    own = F.col("_r1").startswith("-") | F.col("_r2").startswith("-")
    span = F.when(own, _result(_signed(F.col("_r1")), _signed(F.col("_r2")), circa_or("range"))).otherwise(_result(sign * a, sign * complete, circa_or("range")))
    single = _signed(F.col("_long"))

    found = (
        F.when((F.col("_n") == "") | F.col("_n").rlike(_UNKNOWN), _result(null, null, F.lit("unknown")))
        .when(F.col("_going"), F.when(F.col("_any") == "", _result(null, null, F.lit("unknown"))).otherwise(_result(_signed(F.col("_any")), null, F.lit("after"))))
        .when(F.col("_before") | F.col("_after"), after_before)  # and stops, even without a year
        .when(F.col("_c1") != "", century)
        .when(F.col("_s") != "", _result(decade, decade + 9, F.lit("decade")))
        .when(F.col("_r1") != "", span)
        .when(F.col("_long").isNotNull(), _result(single, single, circa_or("exact")))
    )
    d = _add(d, _found=found)
    f = F.col("_found")
    swapped = F.when(f["start"] > f["end"], _result(f["end"], f["start"], f["precision"])).otherwise(f)
    return d.select(*(F.col(f"`{c}`") for c in df.columns), swapped.alias(into))


def resolve(df: DataFrame, source: str = "source", text: str = "date", raw_start: str = "date_raw_start", raw_end: str = "date_raw_end", raw_precision: str = "date_raw_precision") -> DataFrame:
    """``df`` with date_start, date_end and date_precision, from the text and from years that the source gives."""
    d = parse(df, text, "_p")
    s, hint = F.col(raw_start), F.lower(F.trim(F.col(raw_precision).cast("string")))
    d = _add(d, _e=F.when(F.col(raw_start) > F.col(raw_end), F.lit(None)).otherwise(F.col(raw_end)).cast("int"))
    e, p = F.col("_e"), F.col("_p")
    one_year = F.coalesce((p["precision"] == "exact") & (p["start"] == p["end"]), F.lit(False))
    outside = F.coalesce(p["start"] < s, F.lit(False)) | F.coalesce(p["start"] > e, F.lit(False))
    words = F.create_map(*(F.lit(x) for pair in PRECISION_WORDS.items() for x in pair))
    hinted = F.when((F.col(source) == "parismusees") & hint.isNotNull(), F.element_at(words, hint)).when((F.col(source) == "aic") & hint.startswith("c."), "circa")
    spoken = F.when(p["precision"] != "unknown", p["precision"])
    guessed = F.when(s.isNull(), "before").when(e.isNull() | (s == e), "exact").otherwise("range")
    d = _add(d, _no_years=s.isNull() & F.col(raw_end).isNull(), _text_wins=one_year & (outside | e.isNull()), _k=F.coalesce(hinted, spoken, guessed))
    both = s.isNotNull() & e.isNotNull()
    k = F.col("_k")
    d = _add(d, _k2=F.when((k == "range") & F.coalesce(s == e, F.lit(False)), "exact").when(both & k.isin("before", "after"), F.when(s == e, "exact").otherwise("range")).otherwise(k))
    k = F.when(s.isNull(), "before").when(both & F.col("_k2").isin("decade", "century"), F.when(e - s <= 15, "decade").otherwise("century")).otherwise(F.col("_k2"))
    d = _add(d, _k3=k)
    as_text = F.col("_no_years") | F.col("_text_wins")
    end = F.when(e.isNull() & s.isNotNull() & (F.col("_k3") != "after"), s).otherwise(e)
    return d.select(
        *(F.col(f"`{c}`") for c in df.columns),
        F.when(as_text, p["start"]).otherwise(s).cast("int").alias("date_start"),
        F.when(as_text, p["end"]).otherwise(end).cast("int").alias("date_end"),
        F.when(as_text, F.coalesce(p["precision"], F.lit("unknown"))).otherwise(F.col("_k3")).alias("date_precision"),
    )
