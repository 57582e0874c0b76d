"""Ranked search: BM25 with column weights, exact cosine, rank fusion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import fold, tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6


class InvalidQuery(ValueError):
    """The query has no term; a refusal, not an empty answer."""


class Leaf:
    """A word, a prefix (word*) or a phrase; ``column`` restricts it."""

    def __init__(self, words: list[str], prefix: bool = False, column: str | None = None):
        self.words, self.prefix, self.column = words, prefix, column


def parse(query: str, columns: list[str]) -> tuple[tuple, list[Leaf]]:
    """Syntax tree and leaves of ``a b``, ``a OR b``, ``a NOT b``, ``(..)``, ``"a phrase"``, ``pre*``, ``col: ..``.

    Neighbours are joined by AND; NOT binds closest, then AND, then OR.  Raises InvalidQuery.
    """
    marks = re.findall(r'"[^"]*"\*?|[()]|[^\s()":]+\s*:|[^\s()":]+|"|:', query)
    leaves: list[Leaf] = []
    at = 0

    def peek() -> str | None:
        return marks[at] if at < len(marks) else None

    def leaf(text: str, column: str | None) -> tuple:
        prefix = text.endswith("*")
        words = fold_words(text)
        if not words or text in ('"', ":"):
            raise InvalidQuery(f"no searchable term at {text!r}")
        leaves.append(Leaf(words, prefix, column))
        return ("leaf", len(leaves) - 1)

    def one(column: str | None) -> tuple:
        nonlocal at
        mark = peek()
        if mark is None or mark in (")", "AND", "OR", "NOT"):
            raise InvalidQuery(f"a term is missing before {mark!r}")
        at += 1
        if mark == "(":
            inside = either(column)
            if peek() != ")":
                raise InvalidQuery("unbalanced parentheses")
            at += 1
            return inside
        if mark.endswith(":") and mark != ":":
            name = mark[:-1].strip()
            if name not in columns:
                raise InvalidQuery(f"no column {name!r}")
            return one(name)
        return leaf(mark, column)

    def without(column: str | None) -> tuple:
        nonlocal at
        left = one(column)
        while peek() == "NOT":
            at += 1
            left = ("not", left, one(column))
        return left

    def both(column: str | None) -> tuple:
        nonlocal at
        left = without(column)
        while peek() not in (None, ")", "OR"):
            at += peek() == "AND"
            left = ("and", left, without(column))
        return left

    def either(column: str | None) -> tuple:
        nonlocal at
        left = both(column)
        while peek() == "OR":
            at += 1
            left = ("or", left, both(column))
        return left

    if not marks:
        raise InvalidQuery("no searchable term")
    tree = either(None)
    if peek() is not None:
        raise InvalidQuery("unbalanced parentheses")
    return tree, leaves


def index(rows: DataFrame, key: str, columns: list[str], segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, col, pos, d), one row per occurrence, and one row of statistics (N, avg_d).

    A row's postings stay in the partition of the row, sorted by term there: each written
    file is a segment, of which a query reads the pages of its terms.  Only the rows
    themselves are exchanged, and only if ``segments`` is given, which keeps each sort in memory.
    """
    own = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"c_{c}") for c in columns])
    if segments:
        own = own.repartition(segments, "key")
    sized = own.select("key", *[tokens(fold(F.col(f"c_{c}"))).alias(f"t_{c}") for c in columns]).withColumn("d", sum((F.size(f"t_{c}") for c in columns), F.lit(0)))
    stats = sized.agg(F.count(F.lit(1)).alias("N"), F.avg("d").alias("avg_d"))

    def entry(c: str):
        return lambda x, i: F.struct(x.alias("term"), F.lit(c).alias("col"), i.alias("pos"))

    entries = F.concat(*[F.transform(f"t_{c}", entry(c)) for c in columns])
    postings = sized.select("key", "d", F.explode(entries).alias("e")).select("e.term", "key", "e.col", "e.pos", "d")
    return postings.sortWithinPartitions("term", "key"), stats


def statistics(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """The statistics of ``index`` from stored postings: both counts come from file footers, no text is read."""
    n, all_d = rows.agg(F.count(F.lit(1)).alias("N")), postings.agg(F.count(F.lit(1)).alias("all_d"))
    return n.crossJoin(F.broadcast(all_d)).select("N", (F.col("all_d").cast("double") / F.nullif("N", F.lit(0))).alias("avg_d"))


def search(postings: DataFrame, stats: DataFrame, columns: dict[str, float], query: str) -> DataFrame:
    """key, rank of the rows that match the query; reads the postings of its terms only.

    Each leaf scores as one unit, by its weighted number of occurrences.
    """
    tree, leaves = parse(query, list(columns))
    return _score(postings, stats, columns, tree, leaves)


def _score(postings: DataFrame, stats: DataFrame, columns: dict[str, float], tree: tuple, leaves: list[Leaf]) -> DataFrame:
    exact = sorted({w for x in leaves for w in (x.words[:-1] if x.prefix else x.words)})
    starts = sorted({x.words[-1] for x in leaves if x.prefix})
    wanted = F.col("term").isin(exact)
    for w in starts:
        wanted = wanted | F.col("term").startswith(w)
    hit = postings.filter(wanted)

    def matches(word: str, prefix: bool):
        return F.col("term").startswith(word) if prefix else F.col("term") == word

    def asked_by(xs: list[Leaf]) -> list[tuple[str, bool]]:
        return sorted({(w, x.prefix and k == len(x.words) - 1) for x in xs for k, w in enumerate(x.words)})

    # positions are collected for phrases only; words alone are counted
    lone, joined_up = asked_by([x for x in leaves if len(x.words) == 1]), asked_by([x for x in leaves if len(x.words) > 1])
    sums = [F.count(F.when(matches(*a), 1)).alias(f"n{k}") for k, a in enumerate(lone)]
    lists = [F.collect_list(F.when(matches(*a), F.col("pos"))).alias(f"p{k}") for k, a in enumerate(joined_up)]
    per = hit.groupBy("key", "col").agg(F.first("d").alias("d"), *sums, *lists)

    def occurrences(x: Leaf):
        if len(x.words) == 1:
            return F.col(f"n{lone.index((x.words[0], x.prefix))}")
        cols = [f"p{joined_up.index((w, x.prefix and k == len(x.words) - 1))}" for k, w in enumerate(x.words)]

        def goes_on(p):
            found = F.array_contains(cols[1], p + 1)
            for k, c in enumerate(cols[2:], 2):
                found = found & F.array_contains(c, p + k)
            return found

        return F.size(F.filter(cols[0], goes_on))

    weight = F.element_at(F.create_map(*[F.lit(v) for c, w in columns.items() for v in (c, float(w))]), F.col("col"))
    counts = [F.sum(F.when(F.lit(x.column is None) | (F.col("col") == (x.column or "")), weight * occurrences(x)).otherwise(0.0)).alias(f"f{k}") for k, x in enumerate(leaves)]
    found = per.groupBy("key").agg(F.first("d").alias("d"), *counts)
    df = found.agg(*[F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(leaves))])

    def holds(t: tuple):
        if t[0] == "leaf":
            return F.col(f"f{t[1]}") > 0
        a, b = holds(t[1]), holds(t[2])
        return a & b if t[0] == "and" else a | b if t[0] == "or" else a & ~b

    joined = found.filter(holds(tree)).crossJoin(F.broadcast(df)).crossJoin(F.broadcast(stats))  # one row each

    def part(i: int):
        idf = F.greatest(F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(FLOOR))
        f = F.col(f"f{i}")
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))).otherwise(0.0)

    return joined.select("key", F.round(-sum((part(i) for i in range(1, len(leaves))), part(0)), 9).alias("rank"))


def words_query(query: list[str], every_term: bool, scope: str | None = None) -> tuple[tuple, list[Leaf]]:
    """Bare words, all or any of them, sorted and without repeats."""
    terms = sorted({t for q in query for t in fold_words(q)})
    if not terms:
        raise InvalidQuery("no searchable term")
    leaves = [Leaf([t], column=scope) for t in terms]
    tree: tuple = ("leaf", 0)
    for k in range(1, len(terms)):
        tree = ("and" if every_term else "or", tree, ("leaf", k))
    return tree, leaves


def bm25_on(postings: DataFrame, stats: DataFrame, columns: dict[str, float], query: list[str], every_term: bool, scope: str | None = None) -> DataFrame:
    return _score(postings, stats, columns, *words_query(query, every_term, scope))


def bm25(rows: DataFrame, key: str, columns: dict[str, float], query: list[str], every_term: bool, scope: str | None = None) -> DataFrame:
    """key, rank (more negative is better), without a stored index: every row is tokenised for this query."""
    asked = words_query(query, every_term, scope)
    return _score(*index(rows, key, list(columns)), columns, *asked)


#: function words: one of them must not be the only match of a question
STOPWORDS = frozenset(
    "would with will why whose who while which when what were was up to those this these then them their the that than so per over or on of its it is into in if how have has had from for does do did could cannot can by but been be at as are and an a".split()
)
MOST_TERMS = 64


def anchor_terms(query: str) -> list[str]:
    """Distinct words of a question without function words (with them if nothing else is left), 64 at most."""
    words = fold_words(query)
    if not words:
        raise InvalidQuery("no searchable term")
    content = [w for w in words if w not in STOPWORDS] or words
    return list(dict.fromkeys(content))[:MOST_TERMS]


def interleave(results: DataFrame, source: str, *order) -> DataFrame:
    """Ranked lists of several sources dealt in turn: all firsts by source, then all seconds, and so on."""
    own = results.withColumn("round", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return own.withColumn("turn", F.row_number().over(Window.orderBy("round", source)))


def fold_words(q: str) -> list[str]:
    from stratum.functions.text import FOLD_FROM, FOLD_TO

    return re.findall(r"[^\W_]+", q.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)))


def cosine_topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, floor: float | None = None) -> DataFrame:
    """Exact top k by dot product (unit vectors); one pass, a heap of k per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.select(F.col(key), F.round(dot, 6).alias("cosine"))
    if floor is not None:
        scored = scored.filter(F.col("cosine") >= floor)
    return scored.orderBy(F.desc("cosine"), key).limit(k)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """1-based rank of a result list that has passed its limit (so one small partition)."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two lists (key, pos)."""
    a, b = lexical.select(key, F.col("pos").alias("lexical_rank")), semantic.select(key, F.col("pos").alias("semantic_rank"))
    score = sum((F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0)) for c in ("lexical_rank", "semantic_rank")), F.lit(0.0))
    return a.join(b, key, "full").withColumn("fused", F.round(score, 9))
