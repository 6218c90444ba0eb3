"""Checks that have no built-in form: paths of the machine a task runs on, and Python patterns. One Arrow batch at a time.

Paths are looked up on whatever executor has the row, so results differ between machines and times: use them where all see the same files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pactframe.plans.nodes import check, text


def _python(name: str, code: str, key: str, make):
    """A check by a Python predicate over texts; ``make`` gives it inside the worker, so that workers need no module of this package."""

    def rule(c, t):
        if not text(t):
            return F.lit(False)

        def run(values):
            test = make()
            return values.map(lambda x: x is not None and bool(test(x)))

        return F.pandas_udf(run, "boolean").asNondeterministic()(c)

    rule.__name__ = name
    return check(code, key)(rule)


def _path(kind: str):
    def make():
        import os
        import stat

        def test(path: str) -> bool:
            try:
                if kind == "exists":
                    return os.path.exists(path)
                mode = os.lstat(path).st_mode if kind == "S_ISLNK" else os.stat(path).st_mode
                return getattr(stat, kind)(mode)
            except (OSError, ValueError):
                return False

        return test

    return make


def _regex():
    def make():
        import re

        def test(pattern: str) -> bool:
            try:
                re.compile(pattern)
            except (re.error, OverflowError, RecursionError):
                return False
            return True

        return test

    return make


IsRegex = _python("IsRegex", "value", "expected_regex", _regex())
IsDir = _python("IsDir", "not_a_directory", "not_a_directory", _path("S_ISDIR"))
IsFile = _python("IsFile", "not_a_file", "not_a_file", _path("S_ISREG"))
PathExists = _python("PathExists", "not_a_path", "path_does_not_exist", _path("exists"))
IsSymlink = _python("IsSymlink", "not_a_symlink", "not_a_symlink", _path("S_ISLNK"))
IsSocket = _python("IsSocket", "not_a_socket", "not_a_socket", _path("S_ISSOCK"))
IsFifo = _python("IsFifo", "not_a_fifo", "not_a_fifo", _path("S_ISFIFO"))
IsBlockDevice = _python("IsBlockDevice", "not_a_block_device", "not_a_block_device", _path("S_ISBLK"))
