"""Column expressions over post texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Handle patterns, names in links that are no channels, languages with a bucket.
MENTION = r"@([A-Za-z][A-Za-z0-9_]{4,31})(?=[^A-Za-z0-9_]|$)"
LINK = r"(?i)(?:https?://)?(?:t\.me|telegram\.me)/([A-Za-z][A-Za-z0-9_]{4,31})"
RESERVED = ["joinchat", "addlist", "addstickers", "addemoji", "addtheme", "share", "proxy", "socks", "login", "boost", "giftcode", "setlanguage"]
LANGUAGES = ["ru", "cs", "sk", "uk", "en"]
# Function words that are no terms, and boilerplate and calls to action.
STOP_WORDS = """
the and for that with this from have are was you not but all can has its our out who
про что как для это так его она они оно при над под без либо если чтобы когда уже еще
или нас вам наш этот этого этом была были было быть есть нет был вот там тут где этой
тех тот того тому теми этих этим году год день дня дней раз нам них ним ему ей мы вы он
она они мне тебя меня себя свой своя свои наша наши ваш ваша ваши также если чем чём
a aby ako ale alebo ani az ako už už som si sa se ze že jak již jen jako pro pre při bez
nad pod tak ten ta to ty te tato tento této toho tom tím při jsou jsem byl byla bylo být
ako co čo ked keď lebo preto teda však viac tu tam kde kto čo ako ich jeho jej náš naša
naše vaš naši ten tá to tie ako že ze za na do od po ku ze zo isi ešte este už už len iba
""".split()
JUNK_WORDS = ["https", "http", "www", "com", "org", "html", "php", "amp", "quot", "nbsp"]
CALL_WORDS = """
подписаться подпишись подписывайтесь подписка подписки подпишитесь подписчики репост канал канала телеграм
sledujte odber odoberajte zdielajte zdieľajte sdilejte subscribe follow channel telegram share chat dołącz
""".split()


def normalise(text: Column) -> Column:
    """Runs of any Unicode space collapse, ends are trimmed, letters lowered."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def content_key(text: Column, min_chars: int = 100, truncate: int | None = 400) -> Column:
    """md5 of the normalised text; null for shorter raw texts. Lengths are code points."""
    head = F.substring(text, 1, truncate) if truncate else text
    return F.when(F.length(text) >= min_chars, F.md5(normalise(head)))


def has_text(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s", "") != "", F.lit(False))


def mentions(text: Column) -> Column:
    """Handles named with @, lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), F.lower)


def links(text: Column) -> Column:
    """Handles in channel links, lower case; long names are cut at 32 as the pattern has no right end."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), F.lower)


def utf16_slice(text: Column, offset: Column, length: Column) -> Column:
    """Entity offsets count UTF-16 units, so characters beyond the basic plane count twice."""
    return F.decode(F.substring(F.encode(text, "UTF-16LE"), 2 * offset + 1, 2 * length), "UTF-16LE")


def snippet(text: Column, at: Column, length: Column, around: int = 30) -> Column:
    """Text around a 1-based place, with dots where it is cut."""
    start = F.greatest(F.lit(1), at - around)
    end = at + length + around
    return F.concat(
        F.when(start > 1, F.lit("…")).otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), F.lit("…")).otherwise("")
    )


def tokens(text: Column) -> Column:
    """Runs of three letters or more, lower case; numeric letters count as letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}]{3,}"), F.lit(0))


def language_bucket(language: Column, keep: list[str] = LANGUAGES, merge: dict[str, str] | None = None) -> Column:
    out = F.when(language.isNull() | (language == "") | (language == "unknown"), "unknown")
    for a, b in (merge or {}).items():
        out = out.when(language == a, b)
    return out.when(language.isin(keep), language).otherwise("other")


def any_matches(pattern: str, *texts: Column) -> Column:
    """A case-insensitive pattern over several columns at once."""
    return F.concat_ws(" ", *texts).rlike(f"(?iu){pattern}")


def permalink(handle: Column, msg_id: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), handle, F.lit("/"), msg_id.cast("string"))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.pmod(F.floor(s / 60).cast("int"), F.lit(60)), F.pmod(s, F.lit(60)))


def unresolved(handle: Column) -> Column:
    return F.startswith(handle, F.lit("id:"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds, exact to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
