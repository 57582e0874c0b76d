"""Queries on modules, snapshots, maintenance, events and classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators import maintain, modules
from stratum.sources.tables import REFERENCES_SQL, edges, load, references

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _deps(spark, d):
    return modules.dependencies(references(spark, d))


def _counts(spark, d):
    return modules.dependencies_only(references(spark, d))


@query(f"WITH {REFERENCES_SQL} SELECT source_module, target_module, reference_count, array_to_string(files, ',') AS sample_files FROM deps")
def module_dependencies(spark, d):
    return _deps(spark, d).withColumn("sample_files", F.array_join("sample_files", ","))


@query(f"WITH {REFERENCES_SQL} SELECT target_module AS module, count(*) AS dependents, CAST(sum(reference_count) AS BIGINT) AS total_references FROM deps GROUP BY 1")
def blast_radius(spark, d):
    return modules.blast_radius(_counts(spark, d))


@query(f"WITH {REFERENCES_SQL} SELECT * FROM (SELECT source_module, target_module, reference_count, CAST(row_number() OVER (PARTITION BY source_module ORDER BY reference_count DESC, target_module) AS INTEGER) AS rank FROM deps) WHERE rank <= 5")
def module_graph_top5(spark, d):
    return modules.top_targets(_counts(spark, d))


@query(f"WITH {REFERENCES_SQL} SELECT source_module AS module FROM deps UNION SELECT target_module FROM deps")
def distinct_modules(spark, d):
    r = references(spark, d)
    return r.select(F.col("source_module").alias("module")).union(r.select("target_module")).distinct()


@query(f"WITH {REFERENCES_SQL} SELECT module, CAST(sum(c) AS BIGINT) AS coupling FROM (SELECT source_module AS module, reference_count AS c FROM deps UNION ALL SELECT target_module, reference_count FROM deps) GROUP BY 1")
def module_coupling(spark, d):
    return modules.coupling(_counts(spark, d))


@query(f"""WITH {REFERENCES_SQL}, w AS (SELECT a, b, sum(c) AS w FROM (SELECT source_module AS a, target_module AS b, reference_count AS c FROM deps UNION ALL SELECT target_module, source_module, reference_count FROM deps) GROUP BY 1, 2),
m AS (SELECT DISTINCT a FROM w), n AS (SELECT DISTINCT b FROM w),
g AS (SELECT p.a AS p, q.a AS q, sum(least(coalesce(x.w, 0), coalesce(y.w, 0))) AS lo, sum(greatest(coalesce(x.w, 0), coalesce(y.w, 0))) AS hi
 FROM m p JOIN m q ON p.a < q.a CROSS JOIN n LEFT JOIN w x ON x.a = p.a AND x.b = n.b LEFT JOIN w y ON y.a = q.a AND y.b = n.b GROUP BY 1, 2)
SELECT p AS module_a, q AS module_b, round(lo / hi, 6) AS similarity FROM g WHERE lo > 0""")
def weighted_jaccard_pairs(spark, d):
    return modules.weighted_jaccard(_counts(spark, d))


@query()
def module_clusters(spark, d):
    return modules.clusters(_counts(spark, d))


def _halves(spark, d):
    o = load(spark, d, "orders")
    base = o.filter("o_orderdate < timestamp '1999-01-01'").select("o_orderkey", "o_custkey", "o_orderstatus")
    head = o.filter("o_orderdate >= timestamp '1997-01-01'").select("o_orderkey", "o_custkey", F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return base, head


HALVES = """base AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
head AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')"""


@query(f"WITH {HALVES} SELECT 'removed' AS change, o_orderkey FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.o_orderkey = b.o_orderkey) UNION ALL SELECT 'added', o_orderkey FROM head h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE h.o_orderkey = b.o_orderkey)")
def baseline_diff(spark, d):
    base, head = _halves(spark, d)
    return maintain.added(head, base, ["o_orderkey"]).select(F.lit("removed").alias("change"), "o_orderkey").unionByName(maintain.added(base, head, ["o_orderkey"]).select(F.lit("added").alias("change"), "o_orderkey"))


@query(f"WITH {HALVES} SELECT * FROM head UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM head)")
def upsert_last_wins(spark, d):
    base, head = _halves(spark, d)
    return maintain.merge(base, head, ["o_orderkey"], last_wins=True)


@query(f"WITH {HALVES} SELECT * FROM base UNION ALL SELECT * FROM head WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)")
def merge_first_wins(spark, d):
    base, head = _halves(spark, d)
    return maintain.merge(base, head, ["o_orderkey"], last_wins=False)


@query(f"WITH {HALVES} SELECT o_orderkey FROM base INTERSECT SELECT o_orderkey FROM head")
def sibling_intersection(spark, d):
    base, head = _halves(spark, d)
    return base.select("o_orderkey").intersect(head.select("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, d):
    gone = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintain.delete(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), gone, ["l_orderkey"])


STATE = "CASE o_orderstatus WHEN 'F' THEN 'fresh' WHEN 'O' THEN 'dirty-dependent' ELSE 'stale' END"


@query(f"""WITH s AS (SELECT o_orderkey, {STATE} AS state, o_orderkey % 3 = 0 AS t FROM orders)
SELECT o_orderkey, CASE WHEN t THEN 'stale' ELSE state END AS by_file,
CASE WHEN t AND state = 'fresh' THEN 'stale' ELSE state END AS by_evidence,
CASE WHEN t AND state = 'fresh' THEN 'stale' ELSE state END AS by_commit,
CASE WHEN t AND state IN ('fresh', 'dirty-dependent') THEN 'stale' ELSE state END AS by_target,
CASE WHEN t AND state = 'fresh' THEN 'dirty-dependent' ELSE state END AS by_fence,
CASE WHEN t AND state = 'dirty-dependent' THEN 'fresh' ELSE state END AS by_restore FROM s""")
def freshness_transition(spark, d):
    s = load(spark, d, "orders").select("o_orderkey", F.expr(STATE).alias("state"), (F.pmod("o_orderkey", F.lit(3)) == 0).alias("t"))
    return s.select("o_orderkey", *[maintain.transition(F.col("state"), e, F.col("t")).alias(f"by_{e}") for e in maintain.TRANSITIONS])


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS fresh, count(*) FILTER (o_orderstatus = 'O') AS stale, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, count(*) AS total FROM orders")
def freshness_histogram(spark, d):
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").agg(F.sum((s == "F").cast("long")).alias("fresh"), F.sum((s == "O").cast("long")).alias("stale"), F.sum((~s.isin("F", "O")).cast("long")).alias("other"), F.count(F.lit(1)).alias("total"))


@query("SELECT DISTINCT 'part:' || l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' UNION SELECT DISTINCT 'supplier:' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def stale_file_paths(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    ends = j.select(F.explode(F.array(F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey"))).alias("path"))
    return ends.distinct()


@query("""WITH c AS (SELECT c_custkey, min(o_orderkey) AS first_order FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT o_orderkey, CASE WHEN c.first_order IS NULL THEN 'unresolved' WHEN c.first_order = o_orderkey THEN 'client' ELSE 'kernel' END AS owner FROM orders LEFT JOIN c ON o_custkey = c_custkey""")
def cross_area_ownership(spark, d):
    o = load(spark, d, "orders")
    first = o.filter(F.col("o_orderpriority").startswith("1")).join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    return o.join(first, "o_custkey", "left").select("o_orderkey", F.when(F.col("first_order").isNull(), "unresolved").when(F.col("first_order") == F.col("o_orderkey"), "client").otherwise("kernel").alias("owner"))


@query("SELECT o_orderpriority AS owner, count(*) AS n FROM orders GROUP BY 1")
def ownership_breakdown(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("owner")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "owner")


@query("SELECT sha256(text) AS id, count(DISTINCT doc_id) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def id_census(spark, d):
    return load(spark, d, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.countDistinct("doc_id").alias("files")).filter("files > 1")


@query("WITH t AS (SELECT sha256(text) AS id, doc_id::VARCHAR AS file FROM documents), n AS (SELECT id, count(DISTINCT file) AS files FROM t GROUP BY 1) SELECT file, CASE WHEN files > 1 THEN id || '#file:' || file ELSE id END AS qualified FROM t JOIN n USING (id)")
def file_qualified_ids(spark, d):
    t = load(spark, d, "documents").select(F.sha2("text", 256).alias("id"), F.col("doc_id").cast("string").alias("file"))
    return maintain.qualified_ids(t).select("file", "qualified")


SNAP = """a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)"""


@query(f"WITH {SNAP} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def incremental_plan(spark, d):
    t = load(spark, d, "documents").select("doc_id", "text")
    a = t.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("a_id"), F.sha2("text", 256).alias("ah"))
    b = t.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("b_id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("bh"))
    j = a.join(b, F.col("a_id") == F.col("b_id"), "full").filter(~F.col("ah").eqNullSafe(F.col("bh")))
    return j.select(F.coalesce("a_id", "b_id").alias("doc_id"), F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "deleted").otherwise("modified").alias("status"))


@query(f"WITH {REFERENCES_SQL} SELECT DISTINCT source_module AS module FROM deps WHERE target_module IN ('NATION_1', 'NATION_2') AND source_module NOT IN ('NATION_1', 'NATION_2')")
def reverse_closure(spark, d):
    changed = ["NATION_1", "NATION_2"]
    return references(spark, d).filter(F.col("target_module").isin(changed) & ~F.col("source_module").isin(changed)).select(F.col("source_module").alias("module")).distinct()


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents d LEFT JOIN (SELECT vec_id, sha256(vec_id::VARCHAR) AS h FROM embeddings WHERE label < 5) e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR e.h <> sha256(d.text)")
def embedding_queue(spark, d):
    items = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    done = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.when(F.col("label") < 5, "m").otherwise("other").alias("model"))
    return maintain.stale_queue(items, done, "doc_id", "m")


@query("SELECT (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id WHERE label < 5) AS embedded, (SELECT count(*) FROM documents) AS viable")
def embedding_coverage(spark, d):
    e = load(spark, d, "embeddings").filter("label < 5").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e"))
    return load(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").agg(F.count("e").alias("embedded"), F.count(F.lit(1)).alias("viable"))


@query("SELECT event_type AS surface, count(*) AS events, count(DISTINCT user_id) AS invocations, count(*) FILTER ((props->>'k')::INT % 2 = 0) AS hits, count(*) FILTER ((props->>'k')::INT % 2 <> 0) AS misses FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1")
def usage_report_surface(spark, d):
    e = load(spark, d, "events").filter("ts >= timestamp '2024-01-08'").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy(F.col("event_type").alias("surface")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("invocations"), F.count(F.when(F.col("k") % 2 == 0, 1)).alias("hits"), F.count(F.when(F.col("k") % 2 != 0, 1)).alias("misses"))


@query("SELECT user_id, (props->>'k')::INT AS miss, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def usage_repeated_miss(spark, d):
    return load(spark, d, "events").filter("event_type = 'error'").groupBy("user_id", F.from_json("props", "k int")["k"].alias("miss")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("SELECT a AS from_surface, event_type AS to_surface, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) WHERE a = 'error' AND event_type <> 'error' GROUP BY 1, 2")
def usage_fallbacks(spark, d):
    e = load(spark, d, "events").select("event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("a"))
    return e.filter("a = 'error' and event_type <> 'error'").groupBy(F.col("a").alias("from_surface"), F.col("event_type").alias("to_surface")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


@query("""WITH w AS (SELECT event_id AS wid, user_id, ts AS a, ts + INTERVAL 1 HOUR * (1 + event_id % 48) AS b FROM events WHERE event_type = 'signup'),
m AS (SELECT e.event_id, w.wid, row_number() OVER (PARTITION BY e.event_id ORDER BY epoch(w.b - w.a), w.wid) AS k FROM events e JOIN w ON e.user_id = w.user_id AND e.ts >= w.a AND e.ts < w.b WHERE e.event_type <> 'signup')
SELECT event_id, wid AS window_id FROM m WHERE k = 1""")
def range_containment_join(spark, d):
    """Smallest window of the same user that holds the event: equi join on the user, range as condition, argmin."""
    e = load(spark, d, "events")
    w = e.filter("event_type = 'signup'").select(F.col("event_id").alias("wid"), F.col("user_id").alias("w_user"), F.col("ts").alias("a"), (1 + F.col("event_id") % 48).alias("hours")).withColumn("b", F.timestamp_add("HOUR", F.col("hours"), F.col("a")))
    j = e.filter("event_type <> 'signup'").join(w, (F.col("user_id") == F.col("w_user")) & (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b")))
    return j.groupBy("event_id").agg(F.min(F.struct("hours", "wid")).alias("m")).select("event_id", F.col("m.wid").alias("window_id"))


@query("""WITH n AS (SELECT lang, count(*) AS files, count(l.doc_id) AS covered, coalesce(sum(l.toxic), 0) AS failed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT lang, CASE WHEN covered = 0 THEN 'not_applicable' WHEN failed > 20 THEN 'failed' WHEN covered < files THEN 'partial' ELSE 'active' END AS state, CASE WHEN covered = 0 THEN 'no facts' WHEN failed > 20 THEN 'errors' WHEN covered < files THEN 'uncovered files' ELSE '' END AS reason FROM n""")
def capability_state(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels").select("doc_id", "toxic", F.lit(1).alias("l")), "doc_id", "left")
    n = j.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count("l").alias("covered"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("failed"))
    rules = [(F.col("covered") == 0, "not_applicable", "no facts"), (F.col("failed") > 20, "failed", "errors"), (F.col("covered") < F.col("files"), "partial", "uncovered files")]
    state, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, a, b in rules[1:]:
        state, reason = state.when(cond, a), reason.when(cond, b)
    return n.select("lang", state.otherwise("active").alias("state"), reason.otherwise("").alias("reason"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN f = n THEN 'complete' WHEN p > 0 THEN 'degraded' WHEN f = 0 THEN 'stale' ELSE 'content-only' END AS trust FROM s""")
def trust_level(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("p"))
    return s.select("o_custkey", F.when(F.col("f") == F.col("n"), "complete").when(F.col("p") > 0, "degraded").when(F.col("f") == 0, "stale").otherwise("content-only").alias("trust"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS r, max(l_discount) AS m FROM lineitem GROUP BY 1)
SELECT 'returns' AS gate, l_suppkey AS subject FROM g WHERE r * 3 > n UNION ALL SELECT 'volume', l_suppkey FROM g WHERE n > 620 UNION ALL SELECT 'discount', l_suppkey FROM g WHERE m > 0.095""")
def gate_violations(spark, d):
    """One aggregate, then every rule that a subject breaks (no rescans per rule)."""
    g = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max("l_discount").alias("m"))
    broken = F.array_compact(F.array(F.when(F.col("r") * 3 > F.col("n"), "returns"), F.when(F.col("n") > 620, "volume"), F.when(F.col("m") > 0.095, "discount")))
    return g.select(F.explode(broken).alias("gate"), F.col("l_suppkey").alias("subject"))


@query("""SELECT lang AS cohort, count(*) FILTER (quality = 1 AND n_chars > 500) AS hits, round(count(*) FILTER (quality = 1 AND n_chars > 500) / count(*) FILTER (n_chars > 500), 6) AS "precision", round(count(*) FILTER (quality = 1 AND n_chars > 500) / count(*) FILTER (quality = 1), 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def cohort_precision_recall(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang", "n_chars").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    hit, said, gold = (F.count(F.when(c, 1)) for c in ((F.col("quality") == 1) & (F.col("n_chars") > 500), F.col("n_chars") > 500, F.col("quality") == 1))
    return j.groupBy(F.col("lang").alias("cohort")).agg(hit.alias("hits"), F.round(hit / said, 6).alias("precision"), F.round(hit / gold, 6).alias("recall"))


@query("""SELECT lang, bool_or(toxic = 1) AS any_toxic, bool_and(quality = 1) AS all_good, CASE WHEN bool_and(quality = 1) THEN 'promoted' WHEN bool_or(quality = 1) THEN 'partial' ELSE 'refused' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def cross_language_status(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    return j.groupBy("lang").agg(F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.bool_and(good).alias("all_good"), F.when(F.bool_and(good), "promoted").when(F.bool_or(good), "partial").otherwise("refused").alias("status"))


@query("""WITH c AS (SELECT o_custkey, sum((o_orderstatus = 'F')::INT) AS direct, sum((o_orderstatus = 'O')::INT) AS weak, count(DISTINCT o_orderpriority) AS tracks FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN direct >= 3 AND tracks >= 3 THEN 'sufficient' WHEN direct >= 1 THEN 'partial' WHEN weak >= 1 THEN 'weak' ELSE 'insufficient' END AS label FROM c""")
def sufficiency(spark, d):
    c = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("direct"), F.sum((F.col("o_orderstatus") == "O").cast("int")).alias("weak"), F.countDistinct("o_orderpriority").alias("tracks"))
    return c.select("o_custkey", F.when((F.col("direct") >= 3) & (F.col("tracks") >= 3), "sufficient").when(F.col("direct") >= 1, "partial").when(F.col("weak") >= 1, "weak").otherwise("insufficient").alias("label"))
