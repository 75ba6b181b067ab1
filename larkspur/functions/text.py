"""Text expressions: white space, folds, entities, names, paths, device labels.

All are Column expressions, so they stay inside the JVM's generated code.
``SPACE`` is the white space of browsers (with no-break spaces), wider than the
regex class ``\\s`` of the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
ARABIC = r"\u0600-\u06ff"
#: The shapes of tags, mentions and names.
#: The sign comes first, so that only signs are looked at; what stands before one must not be a word.
TAG = rf"#(?<![^{SPACE[1:]}#)([0-9A-Za-z_{ARABIC}]{{2,50}})"
MENTION = rf"@(?<![^{SPACE[1:]}@)([0-9A-Za-z_]{{2,30}})"
#: Two words of Arabic or Latin letters; browsers accept any white space between them, the database ASCII spaces.
CLIENT_NAME = rf"^[A-Za-z{ARABIC}]+{SPACE}+[A-Za-z{ARABIC}]+$"
SERVER_NAME = rf"^[A-Za-z{ARABIC}]+[ ]+[A-Za-z{ARABIC}]+$"
RICH_LINK = r"\[([^\]]+)\]\((/[^)\s]*)\)"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.regexp_replace(trim_all(c), f"{SPACE}+", " ")


def shorten(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis after them if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def _found(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lower))


def tags(c: Column) -> Column:
    """Distinct lower-case hash tags, Arabic or Latin, in order."""
    return _found(c, TAG)


def mentions(c: Column) -> Column:
    """Distinct lower-case handles that are mentioned, in order."""
    return _found(c, MENTION)


def tokens(c: Column) -> Column:
    """Words and the white space between them, each with its kind: tag, mention, space or word."""
    parts = F.filter(F.regexp_extract_all(c, F.lit(f"({SPACE}+|[^\\s]+)"), F.lit(1)), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(f"^{SPACE}+$"), "space").when(x.rlike(f"^#[0-9A-Za-z_{ARABIC}]{{2,50}}$"), "tag").when(x.rlike("^@[0-9A-Za-z_]{2,30}$"), "mention").otherwise("word")
    return F.transform(parts, lambda x: F.struct(x.alias("token"), kind(x).alias("kind")))


def rich_links(c: Column) -> Column:
    """Labels and in-app paths of links, in order."""
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(RICH_LINK), F.lit(1)).alias("label"), F.regexp_extract_all(c, F.lit(RICH_LINK), F.lit(2)).alias("href"))


def fold_search(c: Column) -> Column:
    """For search: alef forms and teh marbuta unified, lower case, trimmed."""
    return trim_all(F.lower(F.translate(c, "أإآة", "اااه")))


def fold_reading(c: Column) -> Column:
    """For reading aloud: diacritics and white space gone, alef forms unified; teh marbuta stays."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"[\u064b-\u0652\u0670]", ""), "أإآ", "ااا"), f"{SPACE}+", "")


def handle_base(c: Column) -> Column:
    """The fixed part of a handle made from a name."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(trim_all(F.coalesce(c, F.lit("")))), f"{SPACE}+", "_"), f"[^a-z0-9_{ARABIC}]", ""), 1, 16)
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("user"))


def initial(c: Column, fallback: str = "م") -> Column:
    return F.coalesce(F.nullif(F.substring(trim_all(F.coalesce(c, F.lit(""))), 1, 1), F.lit("")), F.lit(fallback))


def phone(c: Column) -> Column:
    """Digits with the country code; null if there are none."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits != "", F.concat(F.lit("+966"), digits))


def phone_valid(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\D", "").rlike(r"^\d{9}$"), F.lit(False))


def join_nonempty(*parts: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))


def path_part(c: Column, i: int) -> Column:
    """Part i (from 1, or from -1 at the end) of a slash-separated path; null if there is none."""
    return F.try_element_at(F.split(c, "/"), F.lit(i))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(path_part(c, -1), r"\.([^.]+)$", 1))


def pdf_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\()])", r"\\$1")


#: What a lower-case user agent holds, and the label it then gets; the first that fits counts.
SYSTEMS = (("windows", "Windows"), ("iphone|ipad|ipod", "iOS"), ("mac os x|macintosh", "macOS"), ("android", "Android"), ("linux", "Linux"))
BROWSERS = (("edg/", "Edge"), ("opr/|opera", "Opera"), ("chrome/", "Chrome"), ("firefox/", "Firefox"))
NOT_SAFARI = "chrome|crios|android"
DEVICES = (("ipad|tablet", "جهاز لوحي"), ("mobile|iphone|android", "جوال"))
OTHER_SYSTEM, OTHER_BROWSER, OTHER_DEVICE = "نظام غير معروف", "متصفح", "حاسوب"
AGENT_LENGTH = 400


def _first(rules: tuple[tuple[str, str], ...], ua: Column, *more: Column) -> Column:
    plain = F.lower(F.coalesce(ua, F.lit("")))
    return F.coalesce(*(F.when(plain.rlike(pattern), F.lit(label)) for pattern, label in rules), *more)


def operating_system(ua: Column) -> Column:
    return _first(SYSTEMS, ua, F.lit(OTHER_SYSTEM))


def browser(ua: Column) -> Column:
    plain = F.lower(F.coalesce(ua, F.lit("")))
    return _first(BROWSERS, ua, F.when(plain.rlike("safari/") & ~plain.rlike(NOT_SAFARI), F.lit("Safari")), F.lit(OTHER_BROWSER))


def device_type(ua: Column) -> Column:
    return _first(DEVICES, ua, F.lit(OTHER_DEVICE))


def stored_agent(ua: Column) -> Column:
    """As much of a user agent as a session keeps."""
    return F.substring(F.coalesce(ua, F.lit("")), 1, AGENT_LENGTH)


def device_label(ua: Column) -> Column:
    return F.concat_ws(" — ", operating_system(ua), browser(ua))


def bio(c: Column) -> Column:
    """A profile's text as it is stored: ASCII spaces trimmed, null if nothing is left."""
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of an ISO time; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(c))


def faq_json_ld(items: Column) -> Column:
    """Structured data of a list of questions and answers (q, a)."""
    answer = lambda x: F.struct(F.lit("Question").alias("@type"), x["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), x["a"].alias("text")).alias("acceptedAnswer"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.transform(items, answer).alias("mainEntity")))
