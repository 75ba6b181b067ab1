"""What others may see of a member."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of anonymous members and of those without a name.
ANONYMOUS_NAME, NO_NAME = "مجهول", "مستخدم"


def display_name(full_name: Column, anonymous: Column) -> Column:
    """The shown name: masked if anonymous, a general one if there is none."""
    return F.when(F.coalesce(anonymous, F.lit(False)), F.lit(ANONYMOUS_NAME)).otherwise(F.coalesce(F.nullif(full_name, F.lit("")), F.lit(NO_NAME)))


def avatar(url: Column, anonymous: Column) -> Column:
    """The shown picture: none of anonymous members."""
    return F.when(~F.coalesce(anonymous, F.lit(False)), F.nullif(url, F.lit("")))


def badge(elite: Column, show: Column) -> Column:
    """In lists the badge shows even for anonymous members; an unset preference means shown."""
    return F.coalesce(elite, F.lit(False)) & F.coalesce(show, F.lit(True))
