"""Queries on ranked search, vectors, text functions, extraction and resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.functions import text as T
from stratum.operators import search
from stratum.sources.stored import shares, stored
from stratum.sources.tables import load

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def toks(col: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({col}, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


def rank_sql(table: str, key: str, columns: dict[str, float], fs: list[str], keep: str) -> str:
    """BM25 over units whose weighted counts are the expressions fs on the token lists t_<column>."""
    d = " + ".join(f"len(t_{c})" for c in columns)
    n = len(fs)
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((N - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avg_d)) ELSE 0 END" for i in range(n))
    return f"""WITH t AS (SELECT {key} AS key, {", ".join(f"{toks(c)} AS t_{c}" for c in columns)} FROM {table}),
c AS (SELECT key, {d} AS d, {", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(fs))} FROM t),
s AS (SELECT count(*) AS N, avg(d) AS avg_d, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(n))} FROM c)
SELECT key, round(-({score}), 9) AS rank FROM c, s WHERE {keep}"""


def bm25_sql(table: str, key: str, columns: dict[str, float], terms: list[str], every: bool, scope: str | None = None) -> str:
    used = [scope] if scope else list(columns)
    fs = [" + ".join(word_sql(c, t, columns[c]) for c in used) for t in terms]
    return rank_sql(table, key, columns, fs, (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms))))


def word_sql(c: str, word: str, weight: float = 1.0) -> str:
    return f"{weight} * len(list_filter(t_{c}, lambda x: x = '{word}'))"


def prefix_sql(c: str, start: str, weight: float = 1.0) -> str:
    return f"{weight} * len(list_filter(t_{c}, lambda x: starts_with(x, '{start}')))"


def phrase_sql(c: str, words: list[str], weight: float = 1.0) -> str:
    same = " AND ".join(f"t_{c}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"{weight} * len(list_filter(range(1, len(t_{c}) + 1), lambda i: {same}))"


DOC = {"text": 1.0, "source": 1.0}
DOC_FIELDS = ["text", "source"]


def _index(spark, d, table: str, key: str, columns: list[str]):
    """Stored postings and statistics of a table's columns."""
    name = f"{table}-{'-'.join(columns)}"
    rows = load(spark, d, table)
    postings = stored(spark, d, f"postings-{name}", [table], lambda: search.index(rows, key, columns, shares(rows))[0])
    return postings, stored(spark, d, f"lengths-{name}", [table], lambda: search.statistics(rows, postings))


def _documents(spark, d):
    return _index(spark, d, "documents", "doc_id", DOC_FIELDS)


PART = {"p_name": 5.0, "p_brand": 2.0, "p_type": 1.0}


@query(bm25_sql("documents", "doc_id", {"text": 1.0, "source": 1.0}, ["and", "the"], True))
def bm25_documents(spark, d):
    return search.bm25_on(*_documents(spark, d), DOC, ["the and"], every_term=True)


@query(bm25_sql("documents", "doc_id", {"text": 1.0, "source": 1.0}, ["idiot"], True, "text"))
def bm25_content_scope(spark, d):
    return search.bm25_on(*_documents(spark, d), DOC, ["idiot"], every_term=True, scope="text")


@query(rank_sql("documents", "doc_id", DOC, [f"{phrase_sql('text', ['of', 'the'])} + {phrase_sql('source', ['of', 'the'])}"], "f0 > 0"))
def search_phrase(spark, d):
    return search.search(*_documents(spark, d), DOC, '"of the"')


@query(rank_sql("documents", "doc_id", DOC, [f"{word_sql('text', 'idiot')} + {word_sql('source', 'idiot')}", f"{word_sql('text', 'moron')} + {word_sql('source', 'moron')}", f"{word_sql('text', 'the')} + {word_sql('source', 'the')}"], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0"))
def search_boolean(spark, d):
    return search.search(*_documents(spark, d), DOC, "(idiot OR moron) NOT the")


@query(rank_sql("documents", "doc_id", DOC, [f"{prefix_sql('text', 'idio')} + {prefix_sql('source', 'idio')}", word_sql("source", "src1")], "f0 > 0 AND f1 > 0"))
def search_prefix_and_column(spark, d):
    return search.search(*_documents(spark, d), DOC, "idio* AND source: src1")


@query(bm25_sql("part", "p_partkey", {"p_name": 5.0, "p_brand": 2.0, "p_type": 1.0}, ["brand", "red"], False))
def anchor_search(spark, d):
    """A question in natural language: function words fall away, any of the rest may match."""
    terms = search.anchor_terms("Which of these are of the brand Red?")
    return search.bm25_on(*_index(spark, d, "part", "p_partkey", list(PART)), PART, terms, every_term=False)


@query(bm25_sql("part", "p_partkey", PART, ["1", "brand", "red"], False))
def bm25_weighted_columns(spark, d):
    return search.bm25_on(*_index(spark, d, "part", "p_partkey", list(PART)), PART, ["Brand red 1"], every_term=False)


COS = "round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


def _query_vector(spark, d):
    """The query is one row: a vector of fixed length is all that is collected."""
    return [float(x) for x in load(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


@query(f"SELECT vec_id, {COS} AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return search.cosine_topk(load(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 10)


@query(f"SELECT vec_id, {COS} AS cosine FROM embeddings WHERE label = 3 AND {COS} >= 0.1 ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_model_floor(spark, d):
    return search.cosine_topk(load(spark, d, "embeddings").filter("label = 3"), "vec_id", "embedding", _query_vector(spark, d), 20, floor=0.1)


LEX = bm25_sql("documents", "doc_id", DOC, ["idiot", "moron"], False)
POOL, FILTER_POOL = 50, 200


def rrf_sql(pool: int) -> str:
    return f"""l0 AS ({LEX}), l AS (SELECT key AS id, row_number() OVER (ORDER BY rank, key) AS p FROM (SELECT * FROM l0 ORDER BY rank, key LIMIT {pool})),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY cosine DESC, vec_id) AS p FROM (SELECT vec_id, {COS} AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT {pool})),
f AS (SELECT coalesce(l.id, v.id) AS id, CAST(l.p AS INTEGER) AS lexical_rank, CAST(v.p AS INTEGER) AS semantic_rank, round(coalesce(1.0::DOUBLE / (60 + l.p), 0) + coalesce(1.0::DOUBLE / (60 + v.p), 0), 9) AS fused FROM l FULL JOIN v ON l.id = v.id)"""


RRF = rrf_sql(POOL)


def _fused(spark, d, pool: int = POOL):
    lex = search.bm25_on(*_documents(spark, d), DOC, ["idiot moron"], every_term=False).orderBy("rank", "key").limit(pool)
    sem = search.cosine_topk(load(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), pool)
    a = search.ranked(lex.select(F.col("key").alias("id"), "rank"), "rank", "id").select("id", "pos")
    b = search.ranked(sem.select(F.col("vec_id").alias("id"), "cosine"), F.desc("cosine"), "id").select("id", "pos")
    return search.fuse(a, b, "id")


@query(f"WITH {RRF} SELECT * FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d)


@query(f"WITH {rrf_sql(FILTER_POOL)}, g AS (SELECT f.id, source, fused, lexical_rank, row_number() OVER (PARTITION BY source ORDER BY fused DESC, lexical_rank NULLS LAST, f.id) AS k, count(*) OVER (PARTITION BY source) AS n FROM f JOIN documents ON doc_id = f.id WHERE source <> 'src0') SELECT id, source, fused, n FROM g WHERE k = 1")
def hybrid_topk_per_group(spark, d):
    """One representative per source; both lists are four times as long where a filter or a roll-up follows the cut."""
    j = _fused(spark, d, FILTER_POOL).join(load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id").filter("source <> 'src0'")
    w = Window.partitionBy("source")
    return j.withColumn("k", F.row_number().over(w.orderBy(F.desc("fused"), F.asc_nulls_last("lexical_rank"), "id"))).withColumn("n", F.count(F.lit(1)).over(w)).filter("k = 1").select("id", "source", "fused", "n")


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1")
def tokenise(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.explode(T.tokens(T.fold(F.col("text")))).alias("token"))
    per = t.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM part")
def identifier_split(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(T.split_identifier(F.col("p_name")), " ").alias("words"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT page_id, regexp_matches(url, '(^|/)(test|tests|__tests__)(/|$)') OR regexp_matches(url, '(?i)\\.(test|spec)\\.[^/]*$') OR regexp_matches(url, '(Test|TestCase)\\.php$') AS is_test, regexp_matches(url, '/(fr|de)/') AS indexed FROM pages")
def path_classifier(spark, d):
    return load(spark, d, "pages").select("page_id", T.is_test_path(F.col("url")).alias("is_test"), F.col("url").rlike("/(fr|de)/").alias("indexed"))


@query("SELECT page_id, regexp_extract(url, '^(?:[a-z]+://)?[^/]+/([^/?#]+)', 1) AS module FROM pages")
def module_of_path(spark, d):
    return load(spark, d, "pages").select("page_id", T.module_of(F.col("url")).alias("module"))


@query("SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY 1, 2")
def import_extract(spark, d):
    t = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return t.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS q FROM part), n AS (SELECT DISTINCT p_name FROM part),
t AS (SELECT q, p_name, CASE WHEN p_name = q THEN 1 WHEN lower(p_name) = q THEN 2 WHEN starts_with(lower(p_name), q) THEN 3 WHEN contains(lower(p_name), q) THEN 4 END AS tier FROM q, n WHERE contains(lower(p_name), q)),
m AS (SELECT q, min(tier) AS tier FROM t GROUP BY 1)
SELECT m.q, CAST(m.tier AS INTEGER) AS tier, count(*) AS matches, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM m JOIN t ON t.q = m.q AND t.tier = m.tier GROUP BY 1, 2""")
def tiered_resolution(spark, d):
    """Exact, case-blind, prefix, contains: the best tier wins; several matches in it are ambiguous.

    The catalogue of distinct names is what is matched (64 names here), not the parts.
    """
    n = load(spark, d, "part").select("p_name").distinct()
    q = n.select(F.lower(F.substring_index("p_name", " ", 1)).alias("q")).distinct()
    low = F.lower("p_name")
    t = q.join(n, F.contains(low, F.col("q"))).withColumn("tier", F.when(F.col("p_name") == F.col("q"), 1).when(low == F.col("q"), 2).when(F.startswith(low, F.col("q")), 3).otherwise(4))
    return t.groupBy("q", "tier").agg(F.count(F.lit(1)).alias("matches")).withColumn("best", F.row_number().over(Window.partitionBy("q").orderBy("tier"))).filter("best = 1").select("q", "tier", "matches", F.when(F.col("matches") > 1, "ambiguous").otherwise("resolved").alias("outcome"))


INTENTS = [(r"\?", "question"), (r"(?i)(^| )(the|and)( |$)", "english"), (r"(?i)(^| )(der|die|und)( |$)", "german"), (r"(?i)(^| )(le|la|et)( |$)", "french")]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{v}'" for p, v in INTENTS) + " ELSE 'refused' END AS intent FROM conversations")
def intent_routing(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.first_match(F.col("text"), INTENTS, "refused").alias("intent"))


@query("SELECT doc_id, text FROM documents WHERE lang = 'fr' AND source IN ('src0', 'src4') AND n_chars IS NOT NULL AND text ILIKE '%LE%' AND (n_chars > 500 OR n_chars < 100)")
def predicate_scan(spark, d):
    return load(spark, d, "documents").filter("lang = 'fr' and source in ('src0', 'src4') and n_chars is not null and text ilike '%LE%' and (n_chars > 500 or n_chars < 100)").select("doc_id", "text")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def keyset_scan(spark, d):
    """Large key sets by semi join; the optimiser broadcasts the keys only while they are small."""
    return load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"SELECT repo, doc_id, rank, k, CAST(row_number() OVER (ORDER BY k, repo) AS INTEGER) AS turn FROM (SELECT lang AS repo, key AS doc_id, rank, CAST(row_number() OVER (PARTITION BY lang ORDER BY rank, key) AS INTEGER) AS k FROM ({bm25_sql('documents', 'doc_id', DOC, ['idiot', 'moron'], False)}) JOIN documents ON doc_id = key) WHERE k <= 5")
def federated_search(spark, d):
    """One ranked list per repository (language), five of each, dealt in turn."""
    hits = search.bm25_on(*_documents(spark, d), DOC, ["idiot moron"], every_term=False)
    j = hits.join(load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("repo")), "key")
    top = j.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "key"))).filter("k <= 5")
    return search.interleave(top, "repo", "k").select("repo", F.col("key").alias("doc_id"), "rank", "k", "turn")


@query("SELECT doc_id, n_chars, source IN ('src0', 'src1') AS own FROM documents ORDER BY source IN ('src0', 'src1') DESC, n_chars DESC, doc_id LIMIT 50")
def boolean_order(spark, d):
    own = F.col("source").isin("src0", "src1")
    return load(spark, d, "documents").select("doc_id", "n_chars", own.alias("own")).orderBy(F.desc("own"), F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT DISTINCT substr(sha256(doc_id::VARCHAR), 1, 8) || '-' || lang AS id, 'doc:' || lang || ':' || doc_id AS qualified FROM documents")
def id_constructors(spark, d):
    t = load(spark, d, "documents")
    return t.select(F.concat(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), F.lit("-"), "lang").alias("id"), F.concat_ws(":", F.lit("doc"), "lang", "doc_id").alias("qualified")).distinct()


@query("SELECT doc_id, md5(text) AS md5, n_chars FROM documents WHERE doc_id = 7 UNION ALL SELECT doc_id, md5(text), n_chars FROM documents WHERE doc_id BETWEEN 20 AND 25")
def point_lookup(spark, d):
    """Keys reach the scan as pushed filters."""
    return load(spark, d, "documents").filter("doc_id = 7 or doc_id between 20 and 25").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), "n_chars")


@query("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY GROUP BY 1, 2")
def relative_window(spark, d):
    """The last fourteen days before a reference day, by week."""
    e = load(spark, d, "events").filter(F.col("ts") >= F.expr("timestamp '2024-01-30' - interval 14 days"))
    return e.groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS by_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def map_of_counts(spark, d):
    """A map per user, printed in key order; it has one entry per event type."""
    per = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return counts.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("by_type"))


@query("SELECT page_id, count(*) AS anchors, count(DISTINCT tag) AS tags FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|article|section|nav|main)[ >]', 1)) AS tag FROM pages) GROUP BY 1")
def surface_extract(spark, d):
    t = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(h[1-6]|article|section|nav|main)[ >]"), F.lit(1))).alias("tag"))
    return t.groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"), F.countDistinct("tag").alias("tags"))


@query()
def snippets(spark, d):
    """Twelve tokens around the first token that contains the folded term, such tokens marked; text between tokens is kept."""
    units = F.regexp_extract_all("text", F.lit(r"(?:^[^\p{L}\p{N}]+)?[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    docs = load(spark, d, "documents").filter(F.contains(T.fold(F.col("text")), F.lit("idiot"))).select("doc_id", units.alias("units"))
    at = F.array_position(F.transform("units", lambda u: F.contains(T.fold(u), F.lit("idiot"))), True).cast("int")
    cut = F.slice("units", F.greatest(at - 5, F.lit(1)), F.lit(12))
    marked = F.transform(cut, lambda u: F.when(F.contains(T.fold(u), F.lit("idiot")), F.regexp_replace(u, r"([\p{L}\p{N}]+)", "<mark>$1</mark>")).otherwise(u))
    return docs.select("doc_id", F.btrim(F.regexp_replace(F.array_join(marked, ""), r"\s+", " ")).alias("snippet"))


@query("SELECT conv_id, count(*) AS turns, json_object('conv_id', conv_id, 'turns', count(*))::VARCHAR AS envelope FROM conversations GROUP BY 1")
def query_envelope(spark, d):
    g = load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return g.select("conv_id", "turns", F.to_json(F.struct("conv_id", "turns")).alias("envelope"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def counts(spark, d):
    return load(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
