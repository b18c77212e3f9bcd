"""Report tables: pivots, highlights, macros and lint (SNK-10..12, AGG-22..24, WIN-05, STR-24..27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.text import macro_name, shown_number


def by_genre(metric: DataFrame, column: str, genres: list[str]) -> DataFrame:
    """One row per detector, a column per genre: unweighted means (AGG-22)."""
    return metric.groupBy("detector").pivot("genre", genres).agg(F.avg(column))


def counts_by(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A count table with zeros (AGG-23)."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def highlighted(metric: DataFrame, column: str) -> DataFrame:
    """Shown value of each cell, the row's highest and lowest marked (WIN-05)."""
    w = Window.partitionBy("detector")
    high, low = F.max(column).over(w), F.min(column).over(w)
    shown = shown_number(F.col(column))
    return metric.select("detector", "genre", F.when(F.col(column) == high, F.concat(F.lit("\\textbf{"), shown, F.lit("}"))).otherwise(shown).alias("shown"), (F.col(column) == high).alias("is_max"), (F.col(column) == low).alias("is_min"))


def macros(metric: DataFrame, column: str, form: str = "%.3f") -> DataFrame:
    r"""``\newcommand`` lines (SNK-10)."""
    name = macro_name(F.concat_ws(" ", "detector", "genre", F.lit(column)))
    return metric.select(F.concat(F.lit("\\newcommand{\\"), name, F.lit("}{"), shown_number(F.col(column), form), F.lit("}")).alias("value"))


def latex_table(metric: DataFrame, column: str, genres: list[str], caption: str, label: str) -> str:
    """A table environment of a small pivot (SNK-11)."""
    rows = by_genre(metric, column, genres).orderBy("detector").collect()
    head = " & ".join(["Detector", *genres])
    body = " \\\\\n".join(" & ".join([r["detector"], *("---" if r[g] is None else f"{r[g]:.3f}" for g in genres)]) for r in rows)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\\label{{{label}}}\n\\begin{{tabular}}{{l{'r' * len(genres)}}}\n{head} \\\\\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"


def lint(lines: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """(file, number, problem, found): undefined macros, numbers typed by hand, banned phrases (STR-27)."""
    each = lines.select("file", "number", F.regexp_replace("line", r"(?<!\\)%.*$", "").alias("line"))
    defined = each.select(F.explode(F.regexp_extract_all("line", F.lit(r"\\(?:newcommand|def)\{?\\([A-Za-z]+)"), F.lit(1))).alias("found")).distinct()
    used = each.select("file", "number", F.explode(F.regexp_extract_all("line", F.lit(r"\\([A-Z][A-Za-z]+)\b"), F.lit(1))).alias("found"))
    undefined = used.join(defined, "found", "left_anti").select("file", "number", F.lit("undefined macro").alias("problem"), "found")
    typed = each.select("file", "number", F.lit("number").alias("problem"), F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.{])(\d+\.\d+|\d{3,})(?![\w}])"), F.lit(1))).alias("found"))
    phrases = "|".join(banned or ["state-of-the-art", "to the best of our knowledge"])
    banned_rows = each.select("file", "number", F.lit("phrase").alias("problem"), F.explode(F.regexp_extract_all(F.lower("line"), F.lit(f"({phrases})"), F.lit(1))).alias("found"))
    return undefined.unionByName(typed).unionByName(banned_rows)
