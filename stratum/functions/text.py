"""Text, path and id functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_FROM = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without accents; ASCII text, which has none, skips the slow translation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_identifier(name: Column) -> Column:
    """camelCase, snake_case and acronyms to lower-case words."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def is_test_path(path: Column) -> Column:
    """A folder named test, tests or __tests__, a .test. or .spec. infix, or a name that ends in Test.php or TestCase.php."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.substring_index(p, "/", -1)
    folder = F.exists(F.split(p, "/"), lambda x: x.isin("test", "tests", "__tests__"))
    return folder | F.lower(name).contains(".test.") | F.lower(name).contains(".spec.") | name.endswith("Test.php") | name.endswith("TestCase.php")


def module_of(path: Column) -> Column:
    """First path segment of a url or file path."""
    return F.regexp_extract(path, r"^(?:[a-z]+://)?[^/]+/([^/?#]+)", 1)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first pattern that matches, else a refusal label."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(otherwise)
