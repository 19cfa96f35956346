"""Scalar text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words with inner apostrophes, hyphens and slashes; possessive, so that a word of any length is matched in a loop.
WORD = r"[A-Za-z0-9]+(?:['’/-][A-Za-z0-9]+)*+"


#: Fixed value: white space other than the blank.
_ODD = "\\t-\\r\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def squeeze(c: Column) -> Column:
    """White space runs, Unicode ones too, as one blank; trimmed. Texts with single blanks only, nearly all, aren't rewritten."""
    return F.trim(F.when(c.rlike(f"[{_ODD}]|  "), F.regexp_replace(c, f"[ {_ODD}]+", " ")).otherwise(c))


def fold(c: Column) -> Column:
    """Lower case with ß as ss, squeezed: the form in which texts are compared without case."""
    return F.replace(F.lower(squeeze(c)), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


#: Fixed value: what reads as a link.
LINK = r"(?iU)(?:https?://|www\.)\S+"


def without_links(c: Column) -> Column:
    """The text without links; only texts that can hold one are searched."""
    return F.when(F.contains(c, F.lit("://")) | F.contains(F.lower(c), F.lit("www.")), F.regexp_replace(c, LINK, "")).otherwise(c)


def sentence_count(c: Column) -> Column:
    """Sentence ends before white space or the end of a squeezed text, whose blanks are all plain; a text may have none."""
    return F.regexp_count(c, F.lit(r"[.!?](?=\s|$)"))


def has_phrase(c: Column, phrases) -> Column:
    """Whether the column holds one of the phrases, in any letter case, with no letter, digit or low line next to it."""
    some = "(?:" + "|".join(re.escape(p) for p in phrases) + ")"
    # the plain search first: it is cheap, and most texts fail it
    return F.lower(c).rlike(some) & c.rlike(r"(?iU)(?<!\w)" + some + r"(?!\w)")


def has_term(c: Column, term: str) -> Column:
    """Whether the lower-cased column holds the term with no letter or digit next to it."""
    return c.rlike(rf"(^|[^a-z0-9]){term}([^a-z0-9]|$)")


def brief(c: Column, limit: int) -> Column:
    """Squeezed and, if longer than ``limit``, cut with three points at its end."""
    s = squeeze(c)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("..."))).otherwise(s)


def slug(c: Column, fallback: str) -> Column:
    """Runs of other characters than letters, digits, point, low line and hyphen as one hyphen; trimmed of hyphens and points."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def problem_id(c: Column, fallback: str = "UNASSIGNED") -> Column:
    """A statement id without its prefix, other characters as hyphens, in upper case."""
    s = F.regexp_replace(F.trim(c), r"(?i)^(sih|problem|ps)[\s:#._-]*(statement)?[\s:#._-]*(id)?[\s:#._-]*", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.upper(s), F.lit("")), F.lit(fallback))


#: Ids of statements in a text, the surest form first, and in a file's name; the first form's digits may be spaced, the last is a bare "PS" and five to eight digits.
STATEMENT_IDS = (
    r"(?iU)\bs\s*i\s*h\s*[-_:#]?\s*(\d(?:[\s_-]*\d){4,7})\b", r"(?iU)problem\s+statement\s+(?:id|number|no)\s*[:#\-–—]?\s*([A-Za-z0-9][A-Za-z0-9_-]*)",
    r"(?iU)\bps\s+(?:id|number|no)\s*[:#\-–—]?\s*([A-Za-z0-9][A-Za-z0-9_-]*)", r"(?iU)\bps\s+(?:id)?[\s:#-]*([0-9]{5,8})",
)
NAMED_ID = r"(?i)(?:^|[-_ ()])(?:ps|problem[-_ ]?statement)[-_ ]*([0-9][A-Za-z0-9_-]*)"
TEAM = r"(?iU)team\s+name\s*[:#\-–—]?\s*([^\r\n]+)"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def stem(name: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def named_problem(text: Column, name: Column) -> Column:
    """The normalised statement id that a text names, by the first of ``STATEMENT_IDS`` that it holds, else that of the file's name, else UNASSIGNED."""
    spaced, *rest = STATEMENT_IDS
    return problem_id(F.coalesce(F.regexp_replace(_first(text, spaced), r"(?U)[\s_-]+", ""), *[_first(text, p) for p in rest], _first(stem(name), NAMED_ID)))


def named_team(text: Column, name: Column) -> Column:
    """The team that a text names, bullets stripped, else the file's name without its suffix."""
    t = squeeze(F.regexp_replace(_first(text, TEAM), r"(?U)^[\s•●▪*-]+", ""))
    return F.coalesce(F.nullif(t, F.lit("")), stem(name))


def external_target(link: Column) -> Column:
    """The target of a link that leaves the deck, else null."""
    t = F.coalesce(link["resolved_target"], link["target"])
    return F.when(F.lower(t).rlike("^(https?|mailto|ftp):|^//"), t)
