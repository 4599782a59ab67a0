"""Queries of passages, pages, visibility, both retrieval arms and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartage.functions import passages, text
from cartage.functions.staging import shared_folder
from cartage.operators import evidence, retrieval
from cartage.plans.queries import NORMAL, TOKENS, query, t
from cartage.sources import commits


@query()
def document_passages(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(passages.passages_of(F.col("text"))).alias("c"))
    return x.select("doc_id", "c.chunk_index", "c.heading", "c.token_count", "c.content_hash")


@query()
def entry_passages(spark, d):
    """Manual entries: the title stands for all headings, keywords are indexed with the content."""
    e = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), passages.entry_text(F.concat_ws(" ", "p_type", F.lit("from"), "p_brand"), F.array("p_brand", F.lit(" "), F.col("p_type"))).alias("body"))
    return e.select("p_partkey", F.explode(passages.passages_of(F.col("body"), F.col("title"), False)).alias("c")).select("p_partkey", "c.chunk_index", "c.content", "c.token_count")


def _starts(spark, d):
    return passages.page_starts(t(spark, d, "conversations"), "conv_id", "turn", "text")


PAGES = f"""WITH p AS (SELECT conv_id, turn AS page, {NORMAL} AS clean FROM conversations), s AS (SELECT conv_id, page, clean,
coalesce(sum(length(clean) + 2) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p WHERE clean <> '')"""


@query(PAGES + " SELECT conv_id, page, start FROM s")
def page_offsets(spark, d):
    """The turns of a conversation as the pages of a document."""
    return _starts(spark, d).select("conv_id", "page", "start")


@query(PAGES + """, n AS (SELECT conv_id, max(start + length(clean)) AS size FROM s GROUP BY 1), o AS (SELECT conv_id, unnest(range(0, size::BIGINT, 100)) AS off FROM n)
SELECT o.conv_id, off, arg_max(page, start) AS page FROM o JOIN s ON s.conv_id = o.conv_id AND s.start <= off GROUP BY 1, 2""")
def page_lookup(spark, d):
    """The page of every hundredth character."""
    x = passages.joined_pages(_starts(spark, d), "conv_id")
    at = x.select("conv_id", "starts", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(100))).alias("off"))
    return at.select("conv_id", F.col("off").cast("long").alias("off"), passages.page_at(F.col("starts"), F.col("off")).alias("page"))


@query()
def passage_pages(spark, d):
    x = passages.page_spans(passages.joined_pages(_starts(spark, d), "conv_id"), "conv_id")
    return x.select("conv_id", "chunk_index", "first_page", "last_page")


@query("""SELECT o_orderkey AS document_id, o_orderstatus AS status, count(l_orderkey) AS passages, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS embedded,
count(l_orderkey) > 0 AND count(l_orderkey) = count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS fully_embedded FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def document_list(spark, d):
    """Documents with the counts of their passages, 0 where there are none; orders stand for documents."""
    n = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") != "R", 1).alias("embedding")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("e"))
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status")).join(n, "document_id", "left")
    return x.select("document_id", "status", F.coalesce("n", F.lit(0)).alias("passages"), F.coalesce("e", F.lit(0)).alias("embedded"), F.coalesce(F.col("n") == F.col("e"), F.lit(False)).alias("fully_embedded"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, CASE WHEN l_suppkey % 3 <> 0 THEN l_orderkey END AS doc, CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey END AS entry FROM lineitem WHERE l_returnflag <> 'R') c
LEFT JOIN orders ON o_orderkey = doc LEFT JOIN part ON p_partkey = entry WHERE (doc IS NULL OR (o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%')) AND (entry IS NULL OR p_size > 10)""")
def visible_chunks(spark, d):
    c = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 3 != 0, F.col("l_orderkey")).alias("document_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey")).alias("entry_id"), (F.col("l_returnflag") != "R").alias("is_active"))
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"), F.when(F.col("o_orderpriority").startswith("5"), F.col("o_orderdate")).alias("deleted_at"))
    entries = t(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), (F.col("p_size") > 10).alias("is_active"))
    return evidence.visible(c, docs, entries).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def chunks(spark, d):
    """Parts as passages; parts of one brand are one document, in the order of their keys."""
    words = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return t(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.col("p_partkey").cast("int").alias("chunk_index"), words.alias("text"), text.content_hash(words).alias("content_hash"), "p_name", "p_type", "p_size")


def questions(spark, d):
    """The stated query set: name and type of every part whose key is divisible by 100."""
    return t(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_name", "p_size")


def _arms(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    return evidence.lexical_arm(c, q), evidence.text_vector_arm(c, q)


CHUNKS = f"""WITH c AS (SELECT p_partkey AS chunk_id, p_name, p_brand, p_size, p_name || ' ' || p_type || ' ' || p_brand AS body FROM part), a AS (SELECT *, {TOKENS.replace('lower(text)', 'lower(body)')} AS have, sha256('text:' || body) AS hash FROM c),
q AS (SELECT p_partkey AS query_id, p_name AS wanted, p_size AS q_size, p_name || ' ' || p_type AS asked FROM part WHERE p_partkey % 100 = 0), w AS (SELECT *, {TOKENS.replace('lower(text)', 'lower(asked)')} AS want FROM q),
l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hash, chunk_id) AS lexical_rank FROM w JOIN a ON len(want) > 0 AND list_has_all(have, want) QUALIFY lexical_rank <= 20)"""


@query(CHUNKS + " SELECT query_id, chunk_id, lexical_rank FROM l")
def lexical_search(spark, d):
    return evidence.lexical_arm(chunks(spark, d), questions(spark, d)).withColumn("lexical_rank", F.col("lexical_rank").cast("long"))


@query()
def hybrid_search(spark, d):
    lexical, vector = _arms(spark, d)
    return evidence.hybrid(lexical, vector, chunks(spark, d)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "position")


CASES = CHUNKS + """, k AS (SELECT query_id, wanted, CASE q_size % 3 WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'cross_tenant' ELSE 'relevant' END AS kind, unnest([1, 3, 5, 20]) AS depth FROM q),
r AS (SELECT k.query_id, depth, kind, min(CASE WHEN p_name = wanted AND p_size > 25 THEN lexical_rank END) AS rank, count(chunk_id) AS n_found, coalesce(bool_or(p_size > 30 AND lexical_rank > 5), false) AS leaked
  FROM k LEFT JOIN (SELECT * FROM l JOIN c USING (chunk_id)) f ON f.query_id = k.query_id AND lexical_rank <= depth GROUP BY ALL),
m AS (SELECT depth, count(*) AS cases, count(*) FILTER (kind = 'relevant') AS retrievable, round(coalesce(avg((coalesce(rank, 99) <= 1)::INT) FILTER (kind = 'relevant'), 0), 4) AS recall_at_1, round(coalesce(avg((coalesce(rank, 99) <= 3)::INT) FILTER (kind = 'relevant'), 0), 4) AS recall_at_3,
  round(coalesce(avg((coalesce(rank, 99) <= 5)::INT) FILTER (kind = 'relevant'), 0), 4) AS recall_at_5, round(coalesce(avg(coalesce(1.0 / rank, 0)) FILTER (kind = 'relevant'), 0), 4) AS mrr,
  round(coalesce(avg((n_found > 0)::INT) FILTER (kind <> 'relevant'), 0), 4) AS false_positive_rate, round(avg(leaked::INT), 4) AS leak_rate FROM r GROUP BY 1)"""


def _judged(spark, d):
    """The lexical arm at four depths against cases of three kinds."""
    kind = F.when(F.col("p_size") % 3 == 0, "irrelevant").when(F.col("p_size") % 3 == 1, "cross_tenant").otherwise("relevant")
    q = questions(spark, d)
    cases = q.select("query_id", F.col("p_name").alias("wanted"), kind.alias("kind"), F.explode(F.array(*map(F.lit, (1, 3, 5, 20)))).alias("depth"))
    found = evidence.lexical_arm(chunks(spark, d), q).join(chunks(spark, d).select("chunk_id", "p_name", "p_size"), "chunk_id")
    met = cases.join(found, "query_id", "left").withColumn("in", F.coalesce(F.col("lexical_rank") <= F.col("depth"), F.lit(False)))
    hit = F.col("in") & (F.col("p_name") == F.col("wanted")) & (F.col("p_size") > 25)
    one = met.groupBy("query_id", "depth", "kind").agg(F.min(F.when(hit, F.col("lexical_rank"))).alias("rank"), F.count_if("in").alias("n_found"), F.coalesce(F.bool_or(F.col("in") & (F.col("lexical_rank") > 5) & (F.col("p_size") > 30)), F.lit(False)).alias("leaked"))
    return evidence.judged(one, "depth")


@query(CASES + " SELECT * FROM m")
def retrieval_evaluation(spark, d):
    return _judged(spark, d)


@query(CASES + " SELECT depth, recall_at_5, false_positive_rate FROM m WHERE leak_rate <= 1.0 AND false_positive_rate <= 1.0 AND leak_rate = 0 ORDER BY recall_at_5 DESC, recall_at_3 DESC, mrr DESC, depth LIMIT 1")
def recommended_depth(spark, d):
    return evidence.recommended(_judged(spark, d), "depth", 1.0).select("depth", "recall_at_5", "false_positive_rate")


LISTS = """WITH k AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS a FROM orders GROUP BY 1), h AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN [] ELSE ['5-LOW', ' 1-urgent ', '5-low', '3-MEDIUM'] END AS b FROM customer),
x AS (SELECT c_custkey, b IS NULL AS failed, list_reduce(list_prepend([]::VARCHAR[], list_transform(coalesce(a, []), lambda v: [lower(trim(v))])), lambda p, v: CASE WHEN len(p) >= 3 OR list_contains(p, v[1]) THEN p ELSE list_concat(p, v) END) AS k, CASE WHEN coalesce(len(b), 0) = 0 THEN [] ELSE ['5-low', '1-urgent', '3-medium'] END AS h FROM h LEFT JOIN k ON o_custkey = c_custkey),
v AS (SELECT *, len(list_intersect(k, h)) AS shared, CASE WHEN failed THEN 'hybrid_failed' WHEN len(k) = 0 AND len(h) = 0 THEN 'both_empty' WHEN len(h) = 0 THEN 'keyword_only' WHEN len(k) = 0 THEN 'hybrid_only' WHEN k = h THEN 'identical'
  WHEN len(list_intersect(k, h)) = len(list_distinct(list_concat(k, h))) THEN 'same_set' WHEN len(list_intersect(k, h)) > 0 THEN 'overlap' ELSE 'disjoint' END AS agreement FROM x)"""


def _lists(spark, d):
    """For each customer the priorities of their orders as one arm's titles, and a fixed list, none or a failure as the other's."""
    listed = t(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("a"))
    k = F.col("c_custkey")
    other = F.when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("5-LOW", " 1-urgent ", "5-low", "3-MEDIUM"))))
    x = t(spark, d, "customer").join(listed, k == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("a", F.array().cast("array<string>")).alias("a"), other.alias("b"))
    return evidence.compared(x, "a", "b")


@query(LISTS + " SELECT c_custkey, agreement, len(k)::INTEGER AS keyword_count, (CASE WHEN failed THEN 0 ELSE shared END)::INTEGER AS overlap, NOT failed AND len(k) > 0 AND len(h) > 0 AND k[1] = h[1] AS top1_match FROM v")
def answer_comparison(spark, d):
    return _lists(spark, d).select("c_custkey", "agreement", "keyword_count", "overlap", "top1_match")


@query(LISTS + """ SELECT count(*) AS n, count(*) FILTER (agreement = 'identical') AS identical, count(*) FILTER (agreement = 'overlap') AS overlap, count(*) FILTER (agreement = 'hybrid_failed') AS hybrid_failed,
round(count(*) FILTER (NOT failed AND len(k) > 0 AND len(h) > 0 AND k[1] = h[1]) / count(*) FILTER (NOT failed), 4) AS top1_rate, round(count(*) FILTER (agreement IN ('disjoint', 'keyword_only', 'hybrid_only')) / count(*) FILTER (NOT failed), 4) AS disagreement_rate FROM v""")
def shadow_tally(spark, d):
    return evidence.tally(_lists(spark, d)).select("n", "identical", "overlap", "hybrid_failed", "top1_rate", "disagreement_rate")


@query("""WITH c AS (SELECT p_partkey, p_brand, p_size % 7 <> 0 AS is_active FROM part), d AS (SELECT p_brand, count(*) AS n, count(*) FILTER (is_active) AS own FROM c GROUP BY 1)
SELECT p_brand AS document_id, p_brand LIKE '%#2%' AS deleted, p_brand NOT LIKE '%#2%' AND p_brand NOT LIKE '%#3%' AS visible, CASE WHEN p_brand LIKE '%#2%' THEN 0 ELSE n END AS passages,
CASE WHEN p_brand LIKE '%#2%' OR p_brand LIKE '%#3%' THEN 0 WHEN p_brand LIKE '%#4%' THEN n ELSE own END AS active FROM d""")
def visibility_commits(spark, d):
    """Brands as documents with their parts as passages: some are deleted, some switched off, some off and on again; read back from storage."""
    root = shared_folder(spark, "index")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), (F.col("p_size") % 7 != 0).alias("is_active"))
    docs = p.select("document_id").distinct().withColumns({"is_active": F.lit(True), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    for k in range(2):  # two commits, so that some are not touched
        own = F.pmod(F.xxhash64("document_id"), F.lit(2)) == k
        commits.publish(spark, root, f"load-{k}", {"documents": docs.where(own), "passages": p.where(own)})
    names = sorted(r[0] for r in docs.select("document_id").collect())
    of = lambda digit: [n for n in names if f"#{digit}" in n]
    commits.set_visible(spark, root, "off-3", "document_id", of(3), False)
    commits.set_visible(spark, root, "off-4", "document_id", of(4), False)
    commits.set_visible(spark, root, "on-4", "document_id", of(4), True)
    for _ in range(2):  # the second is a retry
        commits.delete_documents(spark, root, "delete-2", "document_id", of(2), F.lit("1998-01-01").cast("timestamp_ntz"))
    n = commits.read(spark, root, "passages").groupBy("document_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if("is_active").alias("active"))
    out = commits.read(spark, root, "documents").select("document_id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("is_active").alias("visible")).join(n, "document_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("passages", "active")})
