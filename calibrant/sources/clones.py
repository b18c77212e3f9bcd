"""Commit logs and patches of repositories, read from bare partial clones (SRC-11).

Each task clones one repository after the other into a scratch folder of its own,
streams what git prints, and deletes the clone: nothing of it outlives the task or
is read by another, so a lost executor's repositories are simply cloned again.
"""

from __future__ import annotations

import base64
import io
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from calibrant.shipping import ship
from calibrant.sources.history import FIELD, RECORD

#: What ``history.commits`` reads: sha, both dates, author's name and address, parents, message.
LOG_FORMAT = FIELD.join(["%H", "%cI", "%aI", "%an", "%ae", "%P", "%B"]) + RECORD
#: What ``history.diffs`` reads.
SHOW_MARK = "__COMMIT__"
#: Characters of one output row, at least; a row ends with a whole record.
ROW_CHARS = 1 << 22


def _settings(token: str | None) -> dict[str, str]:
    """git's environment: no questions, and the token as a header that no process list shows."""
    env = {**os.environ, "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    if token:
        login = base64.b64encode(f"x-access-token:{token}".encode()).decode()
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Basic {login}"}
    return env


class GitFailed(Exception):
    """git ended with an error; the message is the last line that it printed."""


def _printed(args: list[str], env: dict[str, str], asked: str = "") -> Iterator[str]:
    """What git prints, block by block; ``asked`` is its input."""
    with tempfile.TemporaryFile("w+", encoding="utf-8", errors="replace") as errors, tempfile.TemporaryFile("w+", encoding="utf-8") as source:
        source.write(asked)
        source.seek(0)
        with subprocess.Popen(["git", *args], stdin=source, stdout=subprocess.PIPE, stderr=errors, env=env) as process:
            text = io.TextIOWrapper(process.stdout, "utf-8", "replace", newline="")
            while block := text.read(1 << 20):
                yield block
        if process.returncode:
            errors.seek(0)
            lines = errors.read().strip().splitlines()
            raise GitFailed(lines[-1] if lines else f"git ended with {process.returncode}")


def _rows(blocks: Iterator[str], mark: str, ends: bool, size: int = ROW_CHARS) -> Iterator[str]:
    """The blocks' text cut after (or before) a mark, in rows of ``size`` characters or more."""
    held: list[str] = []
    length, enough = 0, size
    for block in blocks:
        held.append(block)
        length += len(block)
        if length < enough:
            continue
        text = "".join(held)
        at = text.rfind(mark) + (len(mark) if ends else 0)
        if at > (len(mark) if ends else 0):
            yield text[:at]
            text = text[at:]
        held, length = [text], len(text)
        enough = max(size, 2 * length)  # a record longer than a row is not searched again for every block
    if length:
        yield "".join(held)


def _cloned(repos: DataFrame, read: Callable[[str, dict, tuple], Iterator[str]], address: Callable[[str], str], keep: str, token: str | None, callers: int, tries: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env = _settings(token)
        for batch in batches:
            for repo, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for raw, error in one(repo, rest, env):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (repo, raw, error)], ["repo", "raw", "error"])

    def one(repo: str, rest: list, env: dict[str, str]) -> Iterator[tuple[str | None, str | None]]:
        with tempfile.TemporaryDirectory() as folder:
            error = None
            for k in range(tries):
                into = f"{folder}/{k}"
                try:
                    for _ in _printed(["clone", "--bare", f"--filter={keep}", "--no-tags", "--quiet", "--", address(repo), into], env):
                        pass
                    error = None
                    break
                except GitFailed as failure:
                    error = f"clone: {failure}"
            try:
                if error is None:
                    for raw in read(into, env, tuple(rest)):
                        yield raw, None
            except GitFailed as failure:
                error = str(failure)
            if error is not None:
                yield None, error

    ship(repos.sparkSession)
    return repos.repartition(callers).mapInArrow(run, "repo string, raw string, error string")


def logs(repos: DataFrame, address: Callable[[str], str], before: str, most: int, column: str = "repo", token: str | None = None, callers: int = 8, tries: int = 3) -> DataFrame:
    """(repo, raw, error): the last ``most`` commits before a date, for ``history.commits``.

    ``address`` turns a repository's name into what git clones. The clone holds
    commits only. A long log is several rows, each of whole commits. A repository that
    cannot be cloned or read has a last row with the error and no text; an empty
    one has no row. Null names go, repeated ones are cloned once. At most ``callers`` clone at once.
    """

    def read(folder: str, env: dict[str, str], _: tuple) -> Iterator[str]:
        if not any(_printed(["-C", folder, "for-each-ref", "--count=1"], env)):
            return  # no commit yet
        yield from _rows(_printed(["-C", folder, "log", f"--before={before}", f"--max-count={int(most)}", f"--format=tformat:{LOG_FORMAT}"], env), RECORD, ends=True)

    names = repos.select(column).where(f"`{column}` IS NOT NULL").distinct()
    return _cloned(names, read, address, "tree:0", token, callers, tries)


def shows(wanted: DataFrame, address: Callable[[str], str], column: str = "repo", sha: str = "sha", token: str | None = None, callers: int = 8, tries: int = 3) -> DataFrame:
    """(repo, raw, error): patches of the wanted commits' added and changed files, for ``history.diffs``.

    ``wanted`` has a row per repository and commit; a repository's commits are as many as
    ``logs`` gave, so they fit one row. Failures are rows, as in ``logs``.
    """
    from pyspark.sql import functions as F

    def read(folder: str, env: dict[str, str], rest: tuple) -> Iterator[str]:
        asked = "\n".join(rest[0]) + "\n"
        yield from _rows(_printed(["-C", folder, "log", "--no-walk=unsorted", "--stdin", "-p", "--diff-filter=AM", f"--format=tformat:{SHOW_MARK}%H"], env, asked), SHOW_MARK, ends=False)

    each = wanted.where(F.col(column).isNotNull() & F.col(sha).rlike("^[0-9a-f]{7,64}$"))
    own = each.groupBy(F.col(column).alias("repo")).agg(F.sort_array(F.collect_set(sha)).alias("shas"))
    return _cloned(own, read, address, "blob:none", token, callers, tries)
