"""Golden vectors of the date rules."""

import pytest

from curio.functions import dates

N = None
PARSE = [
    (N, N, N, "unknown"), ("", N, N, "unknown"), ("n.d.", N, N, "unknown"), ("N.D", N, N, "unknown"), ("undated", N, N, "unknown"), ("sans date", N, N, "unknown"),
    ("1863", 1863, 1863, "exact"), ("July 27, 1865", 1865, 1865, "exact"), ("1861, printed 1875", 1861, 1861, "exact"), ("dated 1890.5", 1890, 1890, "exact"),
    ("c. 1570", 1570, 1570, "circa"), ("ca. 1890", 1890, 1890, "circa"), ("vers 1850", 1850, 1850, "circa"), ("ca 1890", 1890, 1890, "exact"), ("c.1570", N, N, N), ("c1890", N, N, N),
    ("c.1890-1900", 1890, 1900, "circa"), ("1863-05-01", 1863, 1863, "exact"), ("1914-19", 1914, 1919, "range"), ("940-44", 940, 944, "range"), ("940-944", 940, 944, "range"),
    ("1780–1785", 1780, 1785, "range"), ("1630/36", 1630, 1636, "range"), ("1810 or 1818", 1810, 1818, "range"), ("1880 to 1890", 1880, 1890, "range"), ("spring 1890 to 1891", 1890, 1891, "range"),
    ("Edo period (1615–1868)", 1615, 1868, "range"), ("1 or 2", 1, 2, "range"), ("c. 1875 - c. 1949", 1875, 1949, "circa"), ("vers 1850-1860", 1850, 1860, "circa"), ("c. 1886 - c. 1866", 1866, 1886, "circa"),
    ("1892-12", 1892, 1912, "range"), ("1914-5", 1914, 2005, "range"), ("between 1880 and 1890", 1880, 1880, "exact"), ("1880-90s", 1880, 1880, "exact"), ("-1700", -1700, -1700, "exact"),
    ("-1700 - -1650", -1700, -1650, "range"), ("-0800--0750", -800, -750, "range"), ("1780--1785", -1785, 1780, "range"), ("100 BC", -100, -100, "exact"), ("100 B.C.", -100, -100, "circa"),
    ("av. J.-C. 50", -50, -50, "circa"), ("100 BC - AD 50", -100, -100, "exact"), ("300-50 BC", -350, -300, "range"), ("c. 1391-1353 BCE", -1391, -1353, "circa"), ("17th century", 1601, 1700, "century"),
    ("16th-17th century", 1501, 1700, "century"), ("18/19th century", 1801, 1900, "century"), ("late 19th–early 20th century", 1901, 2000, "century"), ("1st century B.C.E.", -100, -1, "century"),
    ("5th-4th century BC", -500, -301, "century"), ("1710s", 1710, 1719, "decade"), ("c. 1710s", 1710, 1719, "decade"), ("1900s", 1900, 1909, "decade"), ("1800–1900s", 1900, 1909, "decade"), ("500s BC", -500, -491, "decade"),
    ("2004-ongoing", 2004, N, "after"), ("ongoing", N, N, "unknown"), ("before 1896", N, 1896, "before"), ("not after 1840", N, 1840, "before"), ("avant 1789", N, 1789, "before"), ("after 1896", 1896, N, "after"),
    ("not before 1840", 1840, N, "after"), ("après 1789", 1789, N, "after"), ("before 79", N, 79, "before"), ("before dawn", N, N, N), ("in or before 1892-12", N, 1892, "before"),
    ("in or after 1818 - in or before 1842", 1818, 1842, "range"), ("in or before 1790 - in or after 1837", 1790, 1837, "range"), ("after 1635 - 1670", 1635, 1670, "range"), ("1601 - before 1606-01-01", 1601, 1606, "range"),
    ("after 1903-04-11 - c. 1905", 1903, 1905, "circa"), ("Before 1797 probably 1780's", 1780, 1797, "range"), ("XIXe siècle", N, N, N), ("19e siècle", N, N, N), ("1890年", N, N, N), ("12345", N, N, N),
]
RESOLVE = [
    ("smithsonian", "c.1890", N, N, N, N, N, "unknown"), ("parismusees", "XIXe siècle", N, N, N, N, N, "unknown"), ("cleveland", "1970", 1965, N, N, 1970, 1970, "exact"), ("cleveland", "1970", 1965, 1980, N, 1965, 1980, "exact"),
    ("met", "1863", 1900, 1910, N, 1863, 1863, "exact"), ("met", "1863", 1863, 1863, N, 1863, 1863, "exact"), ("met", N, 1863, 1863, N, 1863, 1863, "exact"), ("met", "before 1896", 1890, 1896, N, 1890, 1896, "range"),
    ("met", "before 1896", 1896, 1896, N, 1896, 1896, "exact"), ("met", "after 1896", 1896, N, N, 1896, N, "after"), ("met", "ca. 1890", 1885, 1895, N, 1885, 1895, "circa"), ("met", "ca 1890", 1885, 1895, N, 1885, 1895, "exact"),
    ("met", "Edo period", N, 1868, N, N, 1868, "before"), ("met", "Edo period", 1615, 1868, N, 1615, 1868, "range"), ("met", "Edo period", 1615, N, N, 1615, 1615, "exact"), ("aic", "c. 1890", 1885, 1895, "c.", 1885, 1895, "circa"),
    ("aic", "n.d.", 1890, 1895, N, 1890, 1895, "range"), ("aic", "1st century B.C.E.", -100, -1, N, -100, -1, "century"), ("aic", "1700s", 1700, 1709, N, 1700, 1709, "decade"), ("cleveland", "1700s", 1700, 1799, N, 1700, 1799, "century"),
    ("cleveland", "17th century", 1601, N, N, 1601, 1601, "century"), ("parismusees", "1890", 1890, N, "Après", 1890, 1890, "exact"), ("parismusees", "1890", 1890, N, "Vers", 1890, 1890, "exact"),
    ("parismusees", "1890-1900", 1890, 1900, "Vers", 1890, 1900, "circa"), ("parismusees", "1890-1900", 1890, 1900, "Entre", 1890, 1900, "range"), ("parismusees", "1890-1900", 1890, 1900, "Après", 1890, 1900, "range"),
    ("parismusees", "1890-1900", 1890, 1900, "En", 1890, 1900, "exact"), ("parismusees", "1890-1900", 1890, 1900, "Siècle", 1890, 1900, "range"), ("parismusees", "1890-1890", 1890, 1890, N, 1890, 1890, "exact"),
    ("parismusees", "1900-1890", 1900, 1890, "Entre", 1900, 1900, "range"), ("parismusees", "-1900", N, 1900, N, N, 1900, "before"), ("parismusees", "-4205--4000", -4205, -4000, N, -4205, -4000, "range"),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSE)], "i int, date string")
    got = {r["i"]: r["parsed"] for r in dates.parse(df, "date").collect()}
    bad = [(r, got[i]) for i, r in enumerate(PARSE) if (tuple(got[i]) if got[i] else (N, N, N)) != r[1:]]
    assert not bad


def test_resolve(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(RESOLVE)], "i int, source string, date string, date_raw_start int, date_raw_end int, date_raw_precision string")
    got = {r["i"]: (r["date_start"], r["date_end"], r["date_precision"]) for r in dates.resolve(df).collect()}
    bad = [(r, got[i]) for i, r in enumerate(RESOLVE) if got[i] != r[5:]]
    assert not bad


@pytest.mark.parametrize("text", ["-", "s", "1000s BC before", "c.", "to 19", " 1890 "])
def test_parse_never_fails(spark, text):
    row = dates.parse(spark.createDataFrame([(text,)], "date string"), "date").first()["parsed"]
    assert row is None or row["precision"]
