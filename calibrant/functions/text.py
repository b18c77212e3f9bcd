"""String functions with Unicode classes and code-point lengths (STR-01..29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailers, automation accounts, boilerplate heads and excluded paths.
TRAILER_NAMES = (
    r"(?:co[-\s]?)?authored[-\s]by|signed[-\s]off[-\s]by|reviewed[-\s]by|acked[-\s]by|tested[-\s]by|helped[-\s]by|"
    r"reported[-\s]by|suggested[-\s]by|generated[-\s]by|assisted[-\s]by|noticed[-\s]by|co[-\s]developed[-\s]by|"
    r"co[-\s]committed[-\s]by|on[-\s]behalf[-\s]of|pull[-\s]request[-\s]author"
)
BOTS = (
    r"(\[bot\]|dependabot|renovate|greenkeeper|snyk-bot|imgbot|allcontributors|github-actions|semantic-release|release-please|"
    r"mergify|pyup|whitesource|scala-steward|depfu|codecov|travis|appveyor|circleci)"
)
BOT_LOGINS = ["[bot]", "dependabot", "renovate", "greenkeeper", "codecov", "github-actions"]
BOILERPLATE = (
    r"^\s*(Summary|Test Plan|Differential Revision|Change-Id|Reviewers|Subscribers|Reviewed on|Bug|Fixes|Refs|Pull-request|"
    r"Auto-Submit|Commit-Queue|Cr-Commit-Position|git-svn-id|Former-commit-id|Sponsored by|Upstream-Status|BUG|ISSUE):"
)
EXCLUDED = (
    r"(^|/)(node_modules|vendor|third_party|thirdparty|externals|dist|build|generated|__generated__|\.min\.|migrations)/|"
    r"(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|composer\.lock|Gemfile\.lock|go\.sum|\.pbxproj|\.snap)$|"
    r"\.(min\.js|min\.css|map|lock|svg|png|jpg|jpeg|gif|ico|pdf|woff2?|ttf|eot|zip|gz|jar|so|dll|dylib|exe|bin|class|pyc|out|error|bench)$"
)
#: Languages of file extensions.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust",
    "java": "Java", "kt": "Kotlin", "cs": "C#", "cpp": "C++", "cc": "C++", "h": "C++", "c": "C", "rb": "Ruby", "php": "PHP",
    "swift": "Swift", "scala": "Scala", "dart": "Dart", "ex": "Elixir",
}
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: White space as the source counts it: Unicode's, and the four information separators.
_SPACE = r"[\s\x1c-\x1f\x{85}]"


def strip(x: Column) -> Column:
    """Without white space at both ends (STR-01)."""
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){_SPACE}+\z", "")


def n_lines(x: Column) -> Column:
    """Line feeds and one (STR-03)."""
    return F.size(F.split(x, "\n", -1))


def split_lines(x: Column) -> Column:
    """Lines by any line end, none after the last (STR-04)."""
    lines = F.split(x, _LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def ext_of_name(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without one (STR-06)."""
    return F.lower(F.substring_index(name, ".", -1))


def suffix(name: Column) -> Column:
    """The extension of the last path part in lower case, null without one (STR-07)."""
    found = F.regexp_extract(F.substring_index(name, "/", -1), r"[^.]\.([^.]+)$", 1)
    return F.lower(F.nullif(found, F.lit("")))


def contains_ci(x: Column, needle: str) -> Column:
    """STR-10."""
    return F.contains(F.lower(x), F.lit(needle.lower()))


def strip_trailers(x: Column) -> Column:
    """struct<text, had_trailer>: whole trailer lines go, inline ones are cut, blank lines go (STR-11, STR-12)."""
    flags = "(?iUd)"
    lines = split_lines(x)
    whole = rf"{flags}^{_SPACE}*(?:{TRAILER_NAMES}):"
    inline = rf"{flags}{_SPACE}*(?:{TRAILER_NAMES}):.*$"
    kept = F.transform(F.filter(lines, lambda s: ~s.rlike(whole)), lambda s: F.regexp_replace(s, inline, ""))
    had = F.exists(lines, lambda s: s.rlike(inline))
    text = strip(F.array_join(F.filter(kept, lambda s: strip(s) != ""), "\n"))
    return F.struct(text.alias("text"), had.alias("had_trailer"))


def has_boilerplate(x: Column) -> Column:
    """STR-13."""
    return F.coalesce(x.rlike("(?imUd)" + BOILERPLATE), F.lit(False))


def is_bot_author(x: Column) -> Column:
    """STR-14; null is no bot."""
    return F.coalesce(x.rlike("(?i)" + BOTS), F.lit(False))


def is_bot_login(login: Column, kind: Column) -> Column:
    """STR-15: the account's type, or a marker in its login."""
    marked = reduce(lambda a, b: a | b, [F.contains(F.lower(login), F.lit(m)) for m in BOT_LOGINS])
    return F.coalesce(kind == "Bot", F.lit(False)) | F.coalesce(marked, F.lit(False))


def excluded_path(name: Column) -> Column:
    """STR-16; null is kept."""
    return F.coalesce(name, F.lit("")).rlike("(?id)" + EXCLUDED)


def language(ext: Column) -> Column:
    """MAP-01; null for other extensions."""
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), ext)


def first_score(x: Column) -> Column:
    """The first number of one to three digits, at most 100, over 100; null without one (STR-19)."""
    digits = F.nullif(F.regexp_extract(x, r"(?U)\d{1,3}", 0), F.lit(""))
    return F.when(digits.isNotNull(), F.least(F.lit(100), digits.cast("int")) / 100.0)


def generic_path(x: Column) -> Column:
    """Indexes and issue numbers of a JSON path made generic (STR-22)."""
    return F.regexp_replace(F.regexp_replace(x, r"\[\d+\]", "[]"), r"/issue\d+/", "/issueNNN/")


#: Digits as words.
DIGIT_WORDS = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine"]


def macro_name(x: Column) -> Column:
    """CamelCase with digits as words, letters only (STR-23)."""
    words = F.transform(F.split(x, r"[^A-Za-z0-9]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return reduce(lambda c, i: F.replace(c, F.lit(str(i)), F.lit(DIGIT_WORDS[i])), range(10), F.array_join(words, ""))


def shown_number(x: Column, form: str = "%.3f") -> Column:
    """A formatted number, ``---`` if it is none (STR-24)."""
    odd = x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    return F.when(odd, "---").otherwise(F.format_string(form, x))


def short_iri(x: Column, prefixes: dict[str, str]) -> Column:
    """The name of an IRI with its prefix (STR-25)."""
    out = x
    for short, long in prefixes.items():
        out = F.when(x.startswith(long), F.concat(F.lit(short + ":"), F.substr(x, F.lit(len(long) + 1)))).otherwise(out)
    return out


def human_list(items: Column) -> Column:
    """``a, b and c`` (STR-26)."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def char_ratio(x: Column, cls: str) -> Column:
    """Share of the code points in a character class (STR-29); an empty text counts as one character."""
    kept = F.length(F.regexp_replace(x, f"[^{cls}]", ""))
    return kept / F.greatest(F.length(x), F.lit(1))


def prompt(template: str, **values: Column) -> Column:
    """A template with named fields filled in (STR-21)."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def truncated(x: Column, most: int = 6000) -> Column:
    """STR-20."""
    return F.substring(x, 1, most)
