"""Genotype text as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing genotype or allele.
MISSING_CODES = ("00", "0", "000", "NA", "N/A", "", "--", "-", "?", "00/00", "0/0", "000000", "NN", "..", ".")
SEPARATORS = ("/", "|", ":", "-", " ")

_BLANKS = " \t\r\n"


def cleaned(raw: Column) -> Column:
    """Upper case, no white space at the ends, no quality flags; null becomes empty."""
    return F.regexp_replace(F.upper(F.btrim(F.coalesce(raw, F.lit("")), F.lit(_BLANKS))), r"[*?!#]", "")


def normalise(raw: Column, sep: str | None = None) -> Column:
    """'a/b' with the alleles in string order, or null when missing or malformed."""
    x = cleaned(raw)
    if sep:
        parts = F.split(x, re.escape(sep), -1)
        # one empty piece at the very end does not count
        n = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        a1, a2 = F.get(parts, F.lit(0)), F.coalesce(F.when(n >= 2, F.get(parts, F.lit(1))), F.lit(""))
        odd = n > 2
    else:
        n = F.length(x)
        a1, a2 = F.substring(x, 1, 1), F.when(n == 1, x).otherwise(F.substring(x, 2, 1))
        odd = n > 2
    a1, a2 = (F.btrim(a, F.lit(_BLANKS)) for a in (a1, a2))
    bad = odd | a1.isin(*MISSING_CODES) | a2.isin(*MISSING_CODES) | x.isin(*MISSING_CODES)
    return F.when(~bad, F.concat_ws("/", F.least(a1, a2), F.greatest(a1, a2)))


def allele(gt: Column, k: int) -> Column:
    """The first (1) or second (2) allele of a normalised genotype."""
    return F.split_part(gt, F.lit("/"), F.lit(k))


def is_het(gt: Column) -> Column:
    return allele(gt, 1) != allele(gt, 2)


def floor_log10(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-300)))


def signif(x: Column, digits: int) -> Column:
    """x to so many significant digits."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def posterior(log10_lr: Column, prior: Column) -> Column:
    """1 / (1 + 10^-(log10 prior odds + log10 LR)), finite for any evidence."""
    e = F.log10(prior / (1 - prior)) + log10_lr
    return 1 / (1 + F.pow(F.lit(10.0), F.greatest(F.least(-e, F.lit(300.0)), F.lit(-300.0))))
