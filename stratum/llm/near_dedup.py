"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, ``BANDS * ROWS`` minima and a
   128-bit digest of its word sequence.  Texts with equal word sequences are one class,
   represented by its smallest id, so copies never meet in pairs.
2. Representatives that agree on a whole band share a bucket.  At similarity 0.8 a pair
   shares none of 40 bands of 5 with probability 1e-7.
3. First round: each member is paired with one pivot (the smallest id of the bucket it
   shares most often).  Verified links are closed to components.
4. Second round: whatever two members of a bucket are still in different components are
   compared; nothing that could join two components is skipped.  Buckets of at most
   ``BIG`` members give pairs.  Larger ones (merged where they share their pivot) are
   dealt in blocks of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles; a component
   that fills blocks has blocks of its own, which are not compared with each other.  A
   task first compares two blocks by their minima alone; texts are sent only for members
   that may link across components, to the blocks where they may, and only links that
   connect components are returned.
5. Verification compares minima in batches of ``BATCH``.  With m of n equal, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped once the
   chance of 0.8 or more is below ``MISS``.  Survivors are decided exactly, on the
   words of both whole texts.

Work on a bucket of M members in different components grows with the square of M, as any
exact comparison of all its members does; rows that are exchanged grow with
``M * M / BLOCK`` minima of two bytes each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Words, binary_values, chunks, gram_hashes, stage, unstage
from stratum.llm.common import mix as finalise
from stratum.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS = 40
ROWS = 5
BATCH = 40
MISS = 1e-6
BIG = 32
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
VERIFY_BYTES = 1 << 20
SIGN_BYTES = 1 << 19


def coefficients(count: int, seed: int = 97) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text, and how many each has."""
    words = Words(texts, lower=True)
    n, h = np.diff(words.first), words.hashes()
    doc_of = np.repeat(np.arange(len(texts)), n)
    g = gram_hashes(h, k)
    inside = doc_of[k - 1 :] == doc_of[: len(g)]
    values, owner = g[inside], doc_of[: len(g)][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence as one shingle
        whole = [gram_hashes(h[words.first[i] : words.first[i + 1]], int(n[i]))[0] for i in short]
        values, owner = np.concatenate([values, np.array(whole, dtype=np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(texts))


def minima(values: np.ndarray, counts: np.ndarray, count: int) -> np.ndarray:
    """count minima (32 bits each) for every text with a shingle; rows of zeros for the others."""
    out = np.zeros((len(counts), count), dtype=np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        a, b = coefficients(count)
        for i in range(count):
            out[full, i] = np.minimum.reduceat(values * a[i] + b[i], starts) >> np.uint64(32)
    return out


def sequence_digest(text: bytes) -> bytes | None:
    """128 bits of the lower-cased word sequence; none without words."""
    words = text.lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _sign(batches: Iterator[pa.RecordBatch], k: int, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in chunks(batch.column(1), SIGN_BYTES):
            texts = binary_values(batch.column(1).slice(a, z - a))
            values, counts = shingle_sets(texts, k)
            sig = minima(values, counts, count)
            cols = [batch.column(0).slice(a, z - a), pa.array(counts.astype(np.int64)), pa.array([sequence_digest(t) for t in texts], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "digest", "sig"])


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(n, bands, rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
        for r in range(rows):
            key = finalise(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        ids = np.repeat(batch.column(0).to_numpy(), bands)
        sizes = np.repeat(batch.column(1).to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(ids), pa.array(sizes)], names=["key", "rep", "n"])


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n equal minima at which P(similarity >= threshold | matches) reaches miss."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n + 1


def _prune(batches: Iterator[pa.RecordBatch], count: int, batch_size: int, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(n, count) for i in (2, 3))
        alive, matches = np.arange(n), np.zeros(n, dtype=np.int64)
        for upto, least in bounds:
            matches[alive] += (a[alive, upto - batch_size : upto] == b[alive, upto - batch_size : upto]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["u", "v"])


def word_shingles(text: bytes, k: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in chunks(batch.column(2), VERIFY_BYTES):
            part = batch.slice(a, z - a)
            keep, last = [], (None, None)
            for v, x, y in zip(part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                x, y = (t.as_py() or "" for t in (x, y))
                if last[0] != (v, y):
                    last = ((v, y), word_shingles(y.encode(), k))
                own = word_shingles(x.encode(), k)
                both = len(own & last[1])
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _survivors(table: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row i of a pair of blocks, the later rows of the other block that may be linked with it, likeliest first."""
    n, lo, hi = table.num_rows, table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(n, -1)
    root, block = np.array(table.column("root").to_pylist()), np.array(table.column("block").to_pylist())
    rows = np.arange(n)
    for i in np.flatnonzero(block == lo).tolist():
        other = np.flatnonzero((block == hi) & (root != root[i]) & ((rows > i) | (lo != hi)))
        matches = np.zeros(len(other), dtype=np.int64)
        for upto, least in bounds:
            matches += (sig[other, upto - BATCH : upto] == sig[i, upto - BATCH : upto]).sum(axis=1)
            other, matches = other[matches >= least], matches[matches >= least]
        if len(other):
            yield i, other[np.argsort(-matches, kind="stable")]


def _may_link(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
    """Members of two blocks that may be linked across components."""
    found: set[int] = set()
    for i, other in _survivors(table, bounds):
        found.add(i)
        found.update(other.tolist())
    return table.take(pa.array(sorted(found), pa.int64()))


def _compare_blocks(table: pa.Table, k: int, percent: int, bounds: list[tuple[int, int]]) -> pa.Table:
    """Links between the components met in two blocks of a large bucket; at most one fewer than components.

    Hashed sets, 8 bytes a shingle, rule a pair out; a link is confirmed on the words.
    """
    ids, roots = table.column("rep").to_pylist(), table.column("root").to_pylist()
    texts = table.column("text").combine_chunks()
    parent = {r: r for r in roots}
    hashed: dict[int, np.ndarray] = {}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    def raw(i: int) -> bytes:
        return (texts[i].as_py() or "").encode()

    def own(i: int) -> np.ndarray:
        if i not in hashed:
            hashed[i] = shingle_sets([raw(i)], k)[0]
        return hashed[i]

    def alike(both: int, x: int, y: int) -> bool:
        return both > 0 and 100 * both >= percent * (x + y - both)

    links = []
    for i, other in _survivors(table, bounds):
        for j in other.tolist():
            a, b = find(roots[i]), find(roots[j])
            if a == b or not alike(len(np.intersect1d(own(i), own(j), assume_unique=True)), len(own(i)), len(own(j))):
                continue
            x, y = word_shingles(raw(i), k), word_shingles(raw(j), k)
            if alike(len(x & y), len(x), len(y)):
                parent[a] = b
                links.append((ids[i], ids[j]))
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minima of two bytes: equal ones stay equal, so nothing is lost."""
    for batch in batches:
        sig = [np.frombuffer(x, dtype=np.uint32).astype(np.uint16).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], names=["rep", "sig"])


def _block_links(large: DataFrame, signs: DataFrame, partners: DataFrame, shingle: int, percent: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """Links (u, v) that connect components within large buckets; large: pivot, rep, root, n."""
    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    groups = large.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).withColumn("own", F.greatest(F.col("m") / BLOCK, F.col("s") / BLOCK_SHINGLES) > 1)
    # a large component's blocks are its own (part = root); small components share blocks (part = -1)
    groups = groups.withColumn("part", F.when(F.col("own"), F.col("root")).otherwise(F.lit(-1).cast("long")))
    parts = stage(groups.groupBy("pivot", "part").agg(blocks(F.sum("m"), F.sum("s")).alias("blocks")), "parts")
    named = stage(groups.select("pivot", "root", "part").join(parts, ["pivot", "part"]), "named-parts")
    members = stage(large.join(named, ["pivot", "root"]).withColumn("block", F.struct("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("k"))).select("pivot", "rep", "root", "block"), "members")
    one = parts.select("pivot", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("pivot", F.struct("part", "k").alias("a"))
    pairs = one.join(one.select("pivot", F.col("a").alias("b")), "pivot").filter((F.col("a") <= F.col("b")) & ~((F.col("a.part") == F.col("b.part")) & (F.col("a.part") >= 0)))
    at = pairs.select("pivot", F.col("a").alias("lo"), F.col("b").alias("hi"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = members.join(at, ["pivot", "block"]).join(signs.mapInArrow(_narrow, "rep long, sig binary"), "rep")
    flat = ["pivot", "rep", "root", F.concat_ws("/", "block.part", "block.k").alias("block"), F.concat_ws("/", "lo.part", "lo.k").alias("lo"), F.concat_ws("/", "hi.part", "hi.k").alias("hi"), "sig"]
    schema = "pivot long, rep long, root long, block string, lo string, hi string, sig binary"
    open_members = stage(dealt.select(flat).groupBy("pivot", "lo", "hi").applyInArrow(lambda t: _may_link(t, bounds), schema), "may-link")
    told = open_members.join(partners.select(F.col("doc_id").alias("rep"), "text"), "rep")
    links = stage(told.select("pivot", "rep", "root", "block", "lo", "hi", "sig", "text").groupBy("pivot", "lo", "hi").applyInArrow(lambda t: _compare_blocks(t, shingle, percent, bounds), "u long, v long"), "block-links")
    unstage(parts, named, members, open_members)
    return links


def near_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space, A-Z lower-cased.  Fewer words than a shingle
    are one shingle; null and empty texts have none and are linked with nothing.  Rows
    that repeat a doc_id are one document with several texts and share one component.  A
    null doc_id has no component (null) and is kept.  A very long text is one task's
    work.  Columns other than doc_id and text are not read.  An empty table gives an
    empty result.
    """
    count = bands * rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(texts.mapInArrow(lambda b: _sign(b, shingle, count), "doc_id long, n long, digest binary, sig binary"), "signatures")

    sets = signed.filter("n > 0 and doc_id is not null")
    classes = stage(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep < top").select("digest", "rep"), "classes")
    classed = sets.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    every = stage(classed.unionByName(signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("rep"))), "members")
    members = every.filter("rep is not null")
    copies = members.filter("rep < doc_id").select(F.col("doc_id").alias("rep")).distinct()
    # an id none of whose texts is a class of its own has no signature to compare
    own = members.filter("rep = doc_id").select("rep").distinct()
    reps = stage(sets.select(F.col("doc_id").alias("rep"), "n", "sig", "digest").join(copies, "rep", "left_anti").select("rep", "n", "sig").unionByName(_mixed(sets, classes, copies.join(own, "rep", "left_semi"))), "representatives")
    unstage(signed)

    spread = stage(reps.select("rep", "n", "sig").mapInArrow(lambda b: _bands(b, bands, rows), "key long, rep long, n long"), "bands")
    shared = stage(spread.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).filter("pivot < top").select("key", "pivot"), "shared")
    buckets = stage(spread.join(shared, "key"), "buckets")
    unstage(spread, shared)

    partners = stage(texts.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "partners")
    signs = reps.select("rep", "sig")
    bounds = [(n, least_matches(n, percent / 100, miss)) for n in range(BATCH, count + 1, BATCH)]

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that pass both verifications."""
        both = pairs.join(signs.select(F.col("rep").alias("u"), F.col("sig").alias("su")), "u").join(signs.select(F.col("rep").alias("v"), F.col("sig").alias("sv")), "v").select("u", "v", "su", "sv")
        left = stage(both.mapInArrow(lambda b: _prune(b, count, BATCH, bounds), "u long, v long"), "likely")
        both = left.join(partners.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").join(partners.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")
        found = stage(both.mapInArrow(lambda b: _verify(b, shingle, percent), "u long, v long"), "links")
        unstage(left)
        return found

    hits = buckets.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("hits"))
    stars = hits.groupBy("rep").agg(F.min(F.struct((-F.col("hits")).alias("h"), "pivot")).alias("best")).select(F.col("rep").alias("u"), F.col("best.pivot").alias("v"))
    # texts of one id belong together
    same = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).filter("v < top").select("doc_id", "v")
    same = members.join(same, "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    links = stage(linked(stars).unionByName(same), "links")
    roots = components(links)

    named = stage(buckets.select("key", "rep", "n").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root")), "named")
    open_keys = stage(named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m"), F.min("rep").alias("pivot")).filter("a < b").select("key", "m", "pivot"), "open-keys")
    rest = stage(named.join(open_keys, "key"), "open-buckets")
    unstage(named, buckets)
    small = rest.filter(F.col("m") <= BIG)
    one, two = (small.select("key", F.col("rep").alias(a), F.col("n").alias(f"n{a}"), F.col("root").alias(f"r{a}")) for a in "uv")
    near = (F.col("ru") < F.col("rv")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    across = linked(one.join(two, "key").filter(near).select("u", "v").distinct())

    large = stage(rest.filter(F.col("m") > BIG).groupBy("pivot", "rep", "root").agg(F.max("n").alias("n")), "large")
    if not large.isEmpty():
        across = across.unionByName(_block_links(large, signs, partners, shingle, percent, bounds))
    if not across.isEmpty():
        roots = components(roots.select("u", "v").unionByName(across.select("u", "v")))
    unstage(reps, partners, rest, open_keys, large, links, classes)

    named = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = named.join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select(F.col("doc_id").alias("m_id"), F.coalesce("root", "rep").alias("root"))
    known, lone = every.filter("doc_id is not null"), every.filter("doc_id is null")
    out = known.join(found, F.col("doc_id") == F.col("m_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(lone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _mixed(sets: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Signatures of repeated ids that are a copy in one text and a class of their own in another."""
    rows = sets.select(F.col("doc_id").alias("rep"), "n", "sig", "digest").join(ids, "rep", "left_semi")
    return rows.join(classes.select("digest", F.col("rep").alias("first")), "digest", "left").filter(F.coalesce("first", "rep") == F.col("rep")).select("rep", "n", "sig")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its smallest id, with all columns of docs.

    Rows without id stay.  Of rows that repeat the smallest id, the one with the smallest
    hash of its text stays.
    """
    kept = near_components(docs, **options).filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count(F.lit(1)).alias("__times"))
    kept = stage(kept, "kept-one")
    same = docs["doc_id"].cast("long") == F.col("__kept_id")
    lone = docs.filter(docs["doc_id"].isNull())
    if kept.filter("__times > 1").isEmpty():
        return docs.join(kept, same, "left_semi").unionByName(lone)
    many = docs.join(kept.filter("__times > 1"), same, "left_semi").select(docs["doc_id"].cast("long").alias("id"), F.xxhash64("text").alias("h"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    many = many.groupBy("id").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return docs.join(kept.filter("__times = 1"), same, "left_semi").unionByName(many).unionByName(lone)


def op1_near_dedup(spark, sf_dir):
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), b AS (
  SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 80 * (p.n + q.n - c)
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS z FROM documents
  UNION
  SELECT r.a, e.v FROM r JOIN e ON e.u = r.z
), c AS (SELECT a, min(z) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
""".replace("WITH w AS", "WITH RECURSIVE w AS")
