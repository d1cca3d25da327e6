"""Column builders for text: words, language, rejection rules, shingles, hashes.  All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin words with one inner apostrophe, Cyrillic words, or digits.
WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?|[А-Яа-яЁё]+|\p{Nd}+"
#: Fixed values of the rejection rules.  Classes with \x1c-\x1f count these as blanks; flag U gives Unicode digits, blanks and word borders.
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]{1,64}@[\w.-]+\.[A-Za-z]{2,}(?!\w)"
PHONE = r"(?iuU)(?:тел(?:ефон)?|phone|mobile|call|контакт|звонить|номер)[\s\x1c-\x1f]*[:#-]?[\s\x1c-\x1f]*\+?\d[\d\s\x1c-\x1f().-]{8,}\d"
CREDENTIAL = r"(?iuU)\b(?:api[_ -]?key|access[_ -]?token|client[_ -]?secret|password|пароль|секретный[\s\x1c-\x1f]+ключ)[\s\x1c-\x1f]*[:=][\s\x1c-\x1f]*[^\s\x1c-\x1f,;]{8,}"
#: What is a letter from a to z in lower case.
LATIN = "[A-Za-z\u0130\u212a]"
URL = r"(?i)\b(?:https?://|www\.)\S+"
REPEAT = r"([A-Za-zА-Яа-яЁё0-9])\1{31,}"
#: What a text must hold at least for the expensive patterns to be worth a try.
LONG_NUMBER = r"(?U)\d[\d\s\x1c-\x1f().-]{8,}\d"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def foreign(text: Column) -> Column:
    """Whether a text holds anything but ASCII."""
    return F.octet_length(text) != F.length(text)


def language(text: Column) -> Column:
    """ru from a quarter of Cyrillic letters on, en from four fifths of a-z on, else other.

    Without Cyrillic letters a single other one decides, so they aren't counted."""
    counted = language_of(count_of(text, "[Ѐ-ӿ]"), count_of(F.lower(text), "[a-z]"))
    return F.when(foreign(text) & text.rlike("[Ѐ-ӿ]"), counted).when(text.rlike(LATIN), "en").otherwise("other")


def count_of(text: Column, signs: str) -> Column:
    """How many characters of a text are of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{signs}+", ""))


def language_of(cyr: Column, lat: Column) -> Column:
    """The language by the counts of both scripts."""
    both = cyr + lat
    return F.when(both == 0, "other").when(cyr * 4 >= both, "ru").when(lat * 5 >= both * 4, "en").otherwise("other")


def spoken(text: Column, tie: str = "ru") -> Column:
    """ru or en, whichever has more letters; `tie` where both have as many."""
    low = F.lower(text)
    ru, en = F.regexp_count(low, F.lit("[а-яё]")), F.regexp_count(low, F.lit("[a-z]"))
    return F.when(ru > en, "ru").when(en > ru, "en").otherwise(tie)


def sensitive(text: Column) -> Column:
    """Kind of personal data or secret in a text, or null; cheap tests come before the patterns."""
    return (
        F.when(text.contains("@") & text.rlike(EMAIL), "email")
        .when(text.rlike(LONG_NUMBER) & text.rlike(PHONE), "phone_with_contact_context")
        .when(text.rlike("[:=]") & text.rlike(CREDENTIAL), "credential_pattern")
    )


def contact_or_secret(text: Column) -> Column:
    return F.coalesce(sensitive(text).isNotNull(), F.lit(False))


def distinct_words(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(words(text), F.lower)))


def reason(text: Column, n: Column, lang: Column, min_chars: int = 300, min_words: int = 50, allowed: tuple[str, ...] = ("ru", "en")) -> Column:
    """Name of the first cleaning rule that rejects a text of n words; null if all pass.

    Words, lines and patterns are only looked at in the branch that needs them, once.
    """
    lines = F.split(text, "\n", -1)
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0e-\x1f]"))
    links = F.when(text.contains("://") | text.rlike(r"[wW]{3}\."), F.regexp_count(text, F.lit(URL))).otherwise(0)
    #: The words of a prefix are words of the text, but for the last, which may be cut; mostly they are enough.
    few = F.when((distinct_words(F.substr(text, F.lit(1), n)) - 1) * 25 >= n, False).otherwise(distinct_words(text) * 25 < n)
    same = F.transform(F.array(lines), lambda x: (F.size(x) > 20) & (F.size(F.array_distinct(x)) <= F.greatest(F.lit(1), F.floor(F.size(x) / 5))))[0]
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty_removed")
        .when(text.contains("�") | (control > F.greatest(F.lit(2), F.floor(F.length(text) / 1000))), "corrupt_removed")
        .when((F.length(text) < min_chars) | (n < min_words), "too_short_removed")
        .when(text.rlike(REPEAT), "noise_repeated_character_noise_removed")
        .when(F.when(n >= 100, few).otherwise(False), "noise_low_lexical_diversity_removed")
        .when(links > F.greatest(F.lit(5), F.floor(n / 100)), "noise_link_spam_removed")
        .when(same, "repetitive_noise_removed")
        .otherwise(F.coalesce(F.concat(F.lit("sensitive_"), sensitive(text), F.lit("_removed")), F.when(~lang.isin(*allowed), "language_filtered_removed")))
    )


def tokens(key: Column) -> Column:
    """Runs of letters, digits and underscores of a folded text."""
    return F.regexp_extract_all(key, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngrams(ws: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; none where there are fewer."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def prefixes(ws: Column, least: int = 3, most: int = 10) -> Column:
    """`n:` and the first n words, for n from `least` to `most` as far as there are words."""
    n = F.least(F.size(ws), F.lit(most))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.concat(k.cast("string"), F.lit(":"), F.array_join(F.slice(ws, F.lit(1), k), " ")))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def template(folded: Column) -> Column:
    """A folded text with {N} for numbers that stand alone and single blanks."""
    numbers = F.regexp_replace(F.btrim(folded, F.lit(" \t\n\r\x0b\x0c")), r"(?U)(?<!\w)[+-]?\d+(?:[.,]\d+)?(?!\w)", "{N}")
    return F.regexp_replace(numbers, r"(?U)[\s\x1c-\x1f]+", " ")


def split_hash(text: Column, seed: int = 42) -> Column:
    """First 64 bits, as hex, of SHA-256 over seed, NUL and text; hex order is unsigned order."""
    return F.substr(F.sha2(F.concat(F.lit(f"{seed}\u0000"), text), 256), F.lit(1), F.lit(16))


def git_blob_sha(content: Column) -> Column:
    """SHA-1 that git gives a file of these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\u0000")), "UTF-8"), content))


def wiki_url(base: str, title: Column) -> Column:
    """Page address: blanks become underscores, all but a few signs is percent-encoded."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for quoted, plain in (("%28", "("), ("%29", ")"), ("%21", "!"), ("%2C", ","), ("%7E", "~"), ("\\*", "%2A")):
        out = F.regexp_replace(out, quoted, plain)
    return F.concat(F.lit(base), out)
