"""Postcode -> shift zone, in the two rule sets the analyses use.

Shifts are published per zone, which in most countries is the postcode itself and in a few is its
leading part. A length that drops to zero or below gives an empty zone, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries per rule, and the one Dutch postcode that is stored with its prefix.
GB_EXTENDED = ("GB", "GN")
STRIP_TWO_EXTENDED = ("NL", "TT", "GQ")
PREFIXED_NL_POSTCODE = "NL5042ZK"
PREFIXED_NL_ZONE = "5042"


def _head(text: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.substr(text, F.lit(1), n)


def _without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def zone_simple(country: Column, postcode: Column, fix_nl: bool = False) -> Column:
    """Zone rules of the status-rate analyses.

    GB keeps as many characters as the postcode has non-blank ones less three, IE drops the last
    four. The Dutch rule as published compares the postcode itself with 6 and so never applies;
    ``fix_nl`` applies what it evidently means: six non-blank characters lose the last two.
    """
    zone = F.when(
        country == "GB", _head(postcode, F.length(_without_spaces(postcode)) - 3)
    ).when(country == "IE", _head(postcode, F.length(postcode) - 4))
    if fix_nl:
        six = F.length(_without_spaces(postcode)) == 6
        zone = zone.when((country == "NL") & six, _head(postcode, F.length(postcode) - 2))
    prefixed = (country == "NL") & (postcode == PREFIXED_NL_POSTCODE)
    return zone.when(prefixed, F.lit(PREFIXED_NL_ZONE)).otherwise(postcode)


def zone_extended(entity_code: Column, postcode: Column) -> Column:
    """Zone rules of the impact table and the order-rate analysis; also upper-cases (not IE).

    The Dutch rule catches the prefixed postcode before its exception could, so ``NL5042ZK``
    stays ``NL5042`` here.
    """
    upper = F.upper(postcode)
    packed = _without_spaces(upper)
    short_or_first_four = F.when(
        F.length(postcode) <= 5, _head(upper, F.length(postcode) - 3)
    ).otherwise(_head(upper, 4))
    return (
        F.when(entity_code.isin(*GB_EXTENDED) & postcode.isNotNull(), short_or_first_four)
        .when(entity_code == "IE", _head(postcode, F.length(postcode) - 4))
        .when(entity_code.isin(*STRIP_TWO_EXTENDED), _head(packed, F.length(packed) - 2))
        .otherwise(upper)
    )
