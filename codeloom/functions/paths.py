"""Scalar expressions over repository paths."""

import fnmatch
import functools
import operator
import re

from pyspark.sql import Column, functions as F

from codeloom import constants as C
from codeloom.functions.like import _col, like_text


def any_of(conditions) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def normalize_path(path) -> Column:
    """Posix form relative to the repository root."""
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^(\./)+|^/+|/+$", "")


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_stem(path) -> Column:
    name = file_name(path)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(stem == "", name).otherwise(stem)


def is_noise_path(path) -> Column:
    lowered = F.concat(F.lit("/"), F.lower(_col(path)))
    return lowered.rlike("|".join(re.escape(m) for m in C.NOISE_MARKERS))


def is_test_path(path) -> Column:
    return any_of(like_text(path, p) for p in C.TEST_PATH_PATTERNS)


def is_filename_shaped(query) -> Column:
    return F.trim(_col(query)).rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.\w+)?$")


def language_of(path) -> Column:
    """Language of a supported extension, null for any other file."""
    out = None
    for ext, lang in C.LANGUAGE_EXTENSIONS.items():
        hit = _col(path).endswith(ext)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def display_language(path) -> Column:
    return F.when(_col(path).endswith(".markdown"), "text").otherwise(
        F.coalesce(language_of(path), F.lit("text")))


def is_hidden(path) -> Column:
    return _col(path).rlike(r"(^|/)\.")


def glob_regex(pattern: str) -> str:
    """Regex of a whole-string shell glob; ``*`` crosses directory separators."""
    return "^" + fnmatch.translate(pattern).replace(r"\z", r"\Z")


def is_excluded(path, excludes=C.DEFAULT_EXCLUDES) -> Column:
    """Exclude globs; ``dir/**`` covers everything below ``dir``."""
    path = _col(path)
    tests = []
    for pattern in excludes:
        tests.append(path.rlike(glob_regex(pattern)))
        if pattern.endswith("/**"):
            tests.append(path.startswith(pattern[:-2]) | (path == pattern[:-3]))
    return any_of(tests)


def is_gitignored(path, patterns=()) -> Column:
    """Root ignore-file lines, matched on the whole path, the file name, or as a prefix."""
    path, name = _col(path), file_name(path)
    tests = []
    for line in patterns:
        bare = line.rstrip("/")
        tests += [path.rlike(glob_regex(line)), name.rlike(glob_regex(line))]
        if "/" not in bare:
            tests.append(name.rlike(glob_regex(bare)))
            # a bare name also ignores everything below a directory of that name
            tests.append(path.rlike("(^|/)" + glob_regex(bare).removeprefix("^").removesuffix(r"\Z") + "/"))
        else:
            tests.append(path.startswith(bare))
    return any_of(tests)


def is_ignored(path, excludes=C.DEFAULT_EXCLUDES, gitignore=()) -> Column:
    return is_excluded(path, excludes) | is_gitignored(path, gitignore)
