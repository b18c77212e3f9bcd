"""The 24 text features of the supervised detector, as columns (DET-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import text as X
from calibrant.functions.structure import population_std

#: White space in a class of characters: Unicode's, and the four information separators.
SPACES = r"\s\x1c-\x1f\x{85}"
#: Patterns that are counted.
CONVENTIONAL = r"^(feat|fix|chore|docs|refactor|test|perf|build|ci|style|revert)(\([^)]+\))?!?:\s"
COUNTED = {
    "n_urls": ("U", r"https?://\S+"),
    "n_code_fences": ("", r"```"),
    "n_checkboxes": ("mUd", r"^\s*[-*]\s+\[[ xX]\]"),
    "n_bullets": ("mUd", r"^\s*[-*+]\s+"),
    "n_headings": ("mUd", r"^#{1,6}\s+\S"),
    "comment": ("mUd", r"^\s*(#|//|/\*|\*|--)"),
    "import": ("mUd", r"^\s*(import|from|#include|using|require)\b"),
    "function": ("U", r"\b(def|function|func|fn)\b|=>"),
    "class": ("U", r"\b(class|struct|interface|enum)\b"),
    "condition": ("U", r"\b(if|else|elif|switch|case|when)\b"),
    "loop": ("U", r"\b(for|while|foreach|loop)\b"),
}
FEATURES = [
    "n_chars", "n_words", "n_lines", "mean_line_len", "max_line_len", "std_line_len", "multiline", "blank_line_ratio",
    "trailing_ws_ratio", "indent_ratio", "mean_indent", "upper_ratio", "digit_ratio", "punct_ratio", "capitalised_start",
    "conventional_prefix", "n_urls", "n_code_fences", "n_checkboxes", "n_bullets", "n_headings", "comment_density",
    "import_density", "structure_density",
]


def count(text: Column, name: str) -> Column:
    flags, pattern = COUNTED[name]
    return F.regexp_count(text, F.lit(f"(?{flags}){pattern}" if flags else pattern))


def with_features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the features of a text as doubles, null counting as empty.

    Lines, their lengths and indents are columns of their own first, so that each is
    computed once however many features use it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    split = df.select(*keep, t.alias("_t"), F.split(t, "\n", -1).alias("_lines"))
    lengths = F.transform("_lines", lambda x: F.length(x).cast("double"))
    full = F.filter("_lines", lambda x: x.rlike(rf"(?U)[^{SPACES}]"))
    split = split.select(*keep, "_t", "_lines", lengths.alias("_lengths"), full.alias("_full"))
    indents = F.transform("_full", lambda x: F.length(F.regexp_extract(x, rf"(?U)^[{SPACES}]+", 0)))
    split = split.select(*keep, "_t", "_lines", "_lengths", indents.alias("_indents"))
    return split.select(*keep, *[c.alias(n) for n, c in _features().items()])


def _features() -> dict[str, Column]:
    """name -> double column over the columns that ``with_features`` prepares."""
    t, lines, lengths, indents = (F.col(c) for c in ("_t", "_lines", "_lengths", "_indents"))
    n, n_full = F.size(lines), F.size(indents)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    found = {
        "n_chars": F.length(t),
        "n_words": F.regexp_count(t, F.lit(rf"(?U)[^{SPACES}]+")),
        "n_lines": n,
        "mean_line_len": total / n,
        "max_line_len": F.array_max(lengths),
        "std_line_len": population_std(lengths),
        "multiline": (n > 1).cast("int"),
        "blank_line_ratio": (n - n_full) / n,
        "trailing_ws_ratio": F.size(F.filter(lines, lambda x: x.rlike(rf"(?U)[{SPACES}]\z"))) / n,
        "indent_ratio": F.size(F.filter(indents, lambda i: i > 0)) / F.greatest(n_full, F.lit(1)),
        "mean_indent": F.aggregate(indents, F.lit(0.0), lambda a, i: a + i) / F.greatest(n_full, F.lit(1)),
        "upper_ratio": X.char_ratio(t, r"\p{Lu}"),
        "digit_ratio": X.char_ratio(t, r"\p{Nd}"),
        "punct_ratio": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\p{IsWhite_Space}\x1c-\x1f]", "")) / F.greatest(F.length(t), F.lit(1)),
        "capitalised_start": t.rlike(r"^\p{Lu}").cast("int"),
        "conventional_prefix": t.rlike(f"(?Ud){CONVENTIONAL}").cast("int"),
        **{k: count(t, k) for k in ("n_urls", "n_code_fences", "n_checkboxes", "n_bullets", "n_headings")},
        "comment_density": count(t, "comment") / n,
        "import_density": count(t, "import") / n,
        "structure_density": (count(t, "function") + count(t, "class") + count(t, "condition") + count(t, "loop")) / n,
    }
    return {k: found[k].cast("double") for k in FEATURES}
