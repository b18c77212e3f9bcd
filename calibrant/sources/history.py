"""Version-control output as tables: logs, patches and paged collections (SRC-07..12)."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import text as X
from calibrant.shipping import ship

#: Separators of fields and records, and the subject of a merge.
FIELD, RECORD = "\x1f", "\x1e"
MERGE_SUBJECT = r"^(Merge (pull request|branch|remote-tracking|commit)\b|Merge tag\b)"
MAX_DIFF_CHARS = 20_000


def commits(logs: DataFrame, repo: str = "repo", raw: str = "raw") -> DataFrame:
    """One row per commit of raw logs; records without exactly seven fields are skipped (SRC-10, UDTF-04)."""
    record = logs.select(F.col(repo).alias("repo"), F.explode(F.split(raw, RECORD)).alias("record"))
    fields = F.split(F.regexp_replace("record", r"^\n+|\n+$", ""), FIELD)
    parts = record.select("repo", fields.alias("f")).where(F.size("f") == 7)
    body = X.strip_trailers(F.regexp_replace(F.col("f")[6], r"^\n+|\n+$", ""))
    rows = parts.select("repo", "f", body.alias("body"))
    lines = X.split_lines(F.col("body.text"))
    author = F.concat(F.col("f")[3], F.lit(" <"), F.col("f")[4], F.lit(">"))
    parents = F.size(F.filter(F.split(F.col("f")[5], r"\s+"), lambda p: p != ""))
    return rows.select(
        "repo",
        F.col("f")[0].alias("sha"),
        F.col("f")[1].alias("committed_at"),
        F.col("f")[2].alias("authored_at"),
        author.alias("author"),
        F.col("body.text").alias("text"),
        F.length("body.text").alias("n_chars"),
        F.size(lines).alias("n_lines"),
        ((parents > 1) | F.coalesce(F.get(lines, F.lit(0)).rlike(MERGE_SUBJECT), F.lit(False))).alias("is_merge"),
        X.is_bot_author(author).alias("is_bot"),
        F.col("body.had_trailer").alias("had_trailer"),
        F.lit("commit_message").alias("genre"),
    )


def patches(raw: Column) -> Column:
    """array<struct<filename, patch>> of a diff: hunk lines only, per file (UDTF-02)."""
    header = r"(?d)^diff --git a/(.+?) b/(.+)$"

    def hunk(line: Column) -> Column:
        start = line.startswith("@@") | line.startswith("+") | line.startswith("-") | line.startswith(" ")
        return start & ~line.startswith("+++") & ~line.startswith("---")

    def by_file(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(header), i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            until = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines))
            own = lambda i, k: F.filter(F.slice(lines, i + 2, until(k) - i - 1), hunk)
            return F.transform(at, lambda i, k: F.struct(F.regexp_extract(F.get(lines, i), header, 2).alias("filename"), own(i, k).alias("lines")))

        return once(heads, cut)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed a single time, however often it is used."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    files = once(X.split_lines(raw), by_file)
    named = F.transform(files, lambda f: F.struct(f["filename"].alias("filename"), X.strip(F.array_join(f["lines"], "\n")).alias("patch")))
    return F.filter(named, lambda f: (f["patch"] != "") & (f["filename"] != ""))


def diffs(shows: DataFrame, repo: str = "repo", raw: str = "raw", most: int = MAX_DIFF_CHARS) -> DataFrame:
    """One row per file and commit of ``show`` output; excluded paths and odd lengths go (SRC-12, FLT-03)."""
    parts = F.split(raw, "__COMMIT__")
    chunk = shows.select(F.col(repo).alias("repo"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("chunk"))
    sha = X.strip(F.substring_index("chunk", "\n", 1))
    each = chunk.select("repo", sha.alias("sha"), F.explode(patches(F.expr("substr(chunk, length(substring_index(chunk, '\n', 1)) + 2)"))).alias("p"))
    rows = each.select("repo", "sha", F.concat_ws(":", "sha", "p.filename").alias("source_id"), F.col("p.filename").alias("filename"), X.suffix(F.col("p.filename")).alias("ext"), F.col("p.patch").alias("text"))
    n = F.length("text")
    return rows.where(~X.excluded_path(F.col("filename")) & (n > 10) & (n <= most)).withColumns({"n_chars": n, "genre": F.lit("diff")})


class RateLimit:
    """One pause for all callers: after a refusal nobody asks before it is over (STM-05)."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.resume, self.lock = clock, sleep, 0.0, threading.Lock()

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.resume = max(self.resume, self.clock() + seconds)

    def wait(self) -> None:
        while (left := self.resume - self.clock()) > 0:
            self.sleep(left)


def fetch(get: Callable[[str, int], tuple[int, Any, dict]], path: str, page: int, limit: RateLimit, tries: int = 5) -> tuple[Any, str | None]:
    """(answer, error): waits on 403 and 429, retries 5xx ever later, takes other 4xx as an answer (SRC-08)."""
    for k in range(tries):
        limit.wait()
        status, body, headers = get(path, page)
        if status in (403, 429):
            limit.pause(float(headers.get("retry-after", 60)))
        elif status >= 500:
            limit.sleep(2.0**k)
        elif status >= 400:
            return None, f"http {status}"
        else:
            return body, None
    return None, "gave up"


class FailedPage(Exception):
    """A page that could not be had."""


def paged(get: Callable[[str, int], tuple[int, Any, dict]], path: str, cutoff: str, limit: RateLimit, most_pages: int = 50, size: int = 100) -> Iterator[dict]:
    """Items of an ascending listing up to the cut-off, a short page or ``most_pages`` (SRC-07, STM-02); a page that fails is an error."""
    for page in range(1, most_pages + 1):
        body, error = fetch(get, path, page, limit)
        if error:
            raise FailedPage(f"page {page}: {error}")
        if not body:
            return
        for item in body:
            if item.get("created_at", "") >= cutoff:
                return
            yield item
        if len(body) < size:
            return


def collect(repos: DataFrame, get: Callable[[str, int], tuple[int, Any, dict]], cutoff: str, column: str = "repo", callers: int = 8) -> DataFrame:
    """(repo, item, error): items of every repository as JSON (SRC-07, SRC-09).

    A repository whose listing fails has the items before the failure, and a last
    row with the error and no item. The service's quota is one for all callers, so
    one task asks, with ``callers`` threads that share one pause (STM-05).
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = RateLimit()

        def one(repo: str) -> pa.RecordBatch:
            items: list[str | None] = []
            error = None
            try:
                for x in paged(get, repo, cutoff, limit):
                    items.append(json.dumps(x))
            except FailedPage as failure:
                error = str(failure)
            errors = [None] * len(items) + ([error] if error else [])
            items += [None] if error else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([repo] * len(items), items, errors)], ["repo", "item", "error"])

        with ThreadPoolExecutor(callers) as pool:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for k in range(0, len(names), callers):
                    yield from pool.map(one, names[k : k + callers])

    ship(repos.sparkSession)
    return repos.select(column).distinct().repartition(1).mapInArrow(run, "repo string, item string, error string")
