"""String column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parasol.constants import PAN_HOLDERS, PAN_PATTERN
from parasol.functions.numeric import as_col


def clean_pan(c) -> Column:
    return F.upper(F.trim(as_col(c)))


def pan_is_valid(c) -> Column:
    return F.coalesce(clean_pan(c).rlike(PAN_PATTERN), F.lit(False))


def pan_holder(c) -> Column:
    pan = clean_pan(c)
    holder = F.lit("Other")
    for letter, kind in PAN_HOLDERS.items():
        holder = F.when(F.substring(pan, 4, 1) == letter, F.lit(kind)).otherwise(holder)
    return F.when(pan_is_valid(c), holder)


def claim_id(created_at, number, width: int = 8) -> Column:
    return F.concat(
        F.lit("CLM-"),
        F.date_format(as_col(created_at), "yyyyMMdd"),
        F.lit("-"),
        F.lpad(as_col(number).cast("string"), width, "0"),
    )


def idempotency_key(claim, prefix: str = "PAY") -> Column:
    """Deterministic key, so a retried payout reuses it."""
    return F.concat(F.lit(prefix + "-"), as_col(claim))


def upi_handle(name) -> Column:
    return F.concat(F.replace(F.lower(as_col(name)), F.lit(" "), F.lit(".")), F.lit("@upi"))


def mentions_any(c, words) -> Column:
    return F.lower(as_col(c)).rlike("|".join(words))


def truncated(c, length: int = 500) -> Column:
    return F.substring(as_col(c), 1, length)


def initials(c) -> Column:
    """First letters of the words, upper case, two at most; 'U' without a name."""
    words = F.filter(F.split(as_col(c), " "), lambda w: w != "")
    letters = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.coalesce(as_col(c), F.lit("")) == "", F.lit("U")).otherwise(
        F.substring(F.upper(letters), 1, 2)
    )


def title_words(c) -> Column:
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))
