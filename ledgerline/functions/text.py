"""Column functions over text: coins, percentages, names and shapes.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Copper in a coin.
COPPER = {"platinum": 1000, "gold": 100, "silver": 10, "copper": 1}
COIN = r"\d+ (?:platinum|gold|silver|copper)"
COIN_LIST = rf"{COIN}(?:(?:, | and ){COIN})*"
COIN_SPACED = rf"{COIN}(?: {COIN})*"

ARTICLE = r"(?i)^(?:a|an|the)\s"
#: Fixed value: the shape of generated pet names.
PET_NAME = r"^[GJKLVXZ](?:[aeio][bknrs]){0,2}(?:ab|er|n|tik)\z"


def copper(coins: Column) -> Column:
    """Copper in a list of coins joined by commas, ``and`` or blanks; null where it is malformed."""
    whole = coins.rlike(rf"^{COIN}(?:(?:, | and | ){COIN})*\z")
    parts = F.regexp_extract_all(coins, F.lit(r"(\d+ [a-z]+)"), F.lit(1))
    worth = F.create_map(*[F.lit(x) for pair in COPPER.items() for x in pair])
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + F.split(p, " ")[0].cast("long") * F.element_at(worth, F.split(p, " ")[1]))
    return F.when(whole, total)


def milli(whole: Column, fraction: Column) -> Column:
    """Thousandths of a percent from the digits before and the three after the point."""
    return whole.cast("long") * 1000 + fraction.cast("long")


def quantity(count: Column) -> Column:
    return F.when(count.isin("a", "an"), F.lit(1).cast("long")).otherwise(count.try_cast("long"))


def outcome(text: Column) -> Column:
    """How an attack missed, in one word; other wordings stay as they are."""
    return (
        F.when(text.rlike(r"^miss(?:es)?\z"), "miss")
        .when(text.rlike(r"(?:^YOU riposte|ripostes)\z"), "riposte")
        .when(text.rlike(r"(?:^YOU dodge|dodges)\z"), "dodge")
        .when(text.rlike(r"(?:^YOU parry|parries)\z"), "parry")
        .when(text.rlike(r"(?:^YOU block|blocks)\z"), "block")
        .when(text.rlike(r"absorbs the blow\z"), "absorb")
        .otherwise(text)
    )


#: Capitalised words that a shape keeps at the head of a run.
KEPT_OPENERS = "YOUR|YOU|Your|You|The|An|A"


def shape(message: Column) -> Column:
    """A message without quoted text, digits and names.

    Quotes become a placeholder and digits ``#``.  A run of capitalised words becomes ``Name``, but for kept openers at
    its head; a run of openers alone stays as it is.
    """
    quoted = F.regexp_replace(message, "(?s)'.*'", "'…'")
    digits = F.regexp_replace(quoted, r"\d+", "#")
    word = r"[A-Z][A-Za-z`'-]*"
    opener = rf"(?:{KEPT_OPENERS})(?![A-Za-z`'-])"
    runs = rf"(?<![A-Z][A-Za-z`'-]{{0,60}})((?:{opener}\s+)*+)(?!{opener}){word}(?:\s+{word})*"
    return F.regexp_replace(digits, runs, "$1Name")


def timestamp_ms(raw: Column) -> Column:
    """Milliseconds of a line's fixed 27-character prefix, read as UTC; null where it is malformed or no such day exists."""
    days, months = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    two = r"(?:\d\d| \d|\d )"
    fits = raw.rlike(rf"^\[(?:{days}) (?:{months}) {two} {two}:{two}:{two} \d{{4}}\] ")
    padded = [F.lpad(F.trim(F.substring(raw, at, 2)), 2, "0") for at in (10, 13, 16, 19)]
    text = F.concat_ws(" ", F.substring(raw, 22, 4), F.substring(raw, 6, 3), *padded)
    local = F.try_to_timestamp(text, F.lit("yyyy MMM dd HH mm ss")).cast("timestamp_ntz")  # the session's time zone comes in and goes out again
    return F.when(fits, F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), local))


def message_of(raw: Column) -> Column:
    return F.substring(raw, 28, 1 << 30)
