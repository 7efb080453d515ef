"""Masking, truncation and redaction of stored text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
SENSITIVE_WORDS = ["password", "secret", "token", "key", "credential"]
REDACTED = "[REDACTED]"
TRUNCATED = "...[TRUNCATED]"
STATE_LIMIT = 1024
ERROR_CODE_LIMIT = 100
ERROR_MESSAGE_LIMIT = 2000
AUDIT_ERROR_LIMIT = 500

# The loops are possessive, so the matcher neither backtracks nor recurses on long values. A key
# is told from a value first, by the colon after it; only keys are searched for the words, and
# letters that start none of them are skipped in runs.
_WORD = "(?i:" + "|".join(SENSITIVE_WORDS) + ")"
_STARTS = "".join(sorted({w[0] + w[0].upper() for w in SENSITIVE_WORDS}))
_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING = f'"{_BODY}"'
_SEARCH = rf'(?:[^"\\{_STARTS}]++|(?!{_WORD})[^"\\]|\\.)*+{_WORD}'
_KEY = rf'(?<!\\)"(?={_BODY}"\s*:){_SEARCH}{_BODY}"\s*:\s*'
_SCALAR = rf"(?:{_STRING}|-?[0-9][0-9eE+.\-]*+|true|false|null)"
_LIST = rf"(\[\s*){_SCALAR}(?:\s*,\s*{_SCALAR})*+(?=\s*\])"
_LEAVES = f"({_KEY}){_SCALAR}"
_LEAVES_AND_LISTS = f"({_KEY})(?:{_LIST}|{_SCALAR})"


# Two hexadecimal digits of an escape: a hyphen, digit, letter or underscore.
_PLAIN = r"^(?i:2d|3[0-9]|4[1-9a-f]|5[0-9af]|6[1-9a-f]|7[0-9a])"
_ODD_BACKSLASHES = r"(?:^|[^\\])(?:\\\\)*\\\z"


def plain_letters(text: Column) -> Column:
    r"""JSON text with ``\u00..`` escapes of plain letters and digits written as such, so that keys
    read alike. An escape whose backslash is itself escaped is left."""
    parts = F.split(text, r"\\u00", -1)
    rest = F.size(parts) - 1

    def written(part: Column, before: Column) -> Column:
        letter = F.char(F.conv(F.substring(part, 1, 2), 16, 10).try_cast("int"))
        return F.when(
            before.rlike(_ODD_BACKSLASHES) | ~part.rlike(_PLAIN), F.concat(F.lit("\\u00"), part)
        ).otherwise(F.concat(letter, F.substr(part, F.lit(3))))

    after_first = F.zip_with(F.slice(parts, F.lit(2), rest), F.slice(parts, F.lit(1), rest), written)
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(after_first, ""))
    return F.when(F.contains(text, F.lit("\\u00")), decoded).otherwise(text)


def mask_sensitive(text: Column, scalar_lists: bool = True) -> Column:
    """Replace every leaf under a sensitive key, at any depth, in JSON text.

    Objects and lists under such a key are kept and searched. The values of a list of plain values
    are replaced by one marker, unless ``scalar_lists`` is off. Letters of keys may be escaped.
    """
    text = plain_letters(text)
    if scalar_lists:
        return F.regexp_replace(text, _LEAVES_AND_LISTS, f'$1$2"{REDACTED}"')
    return F.regexp_replace(text, _LEAVES, f'$1"{REDACTED}"')


def truncate_text(text: Column, limit: int = STATE_LIMIT) -> Column:
    """Cut text that is too long. Mask before this, so a cut never exposes half a secret."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))
    ).otherwise(text)


def redact_uri_password(uri: Column) -> Column:
    return F.regexp_replace(uri, r"://([^:/@]*):[^@]*@", f"://$1:{REDACTED}@")


def pseudonym(text: Column) -> Column:
    return F.sha2(text, 256)


def capped(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id from business columns: the same row gets the same id when a task is rerun."""
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )
