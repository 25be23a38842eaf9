"""Nearest neighbours, retrieval, links and answers over the vector bank: embeddings with their documents and labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.rules import answer, note_fields, overlap_score
from engram.functions.vector import cosine, norm
from engram.operators import bank as banks
from engram.operators import link, retrieve, vector_index
from engram.operators.knn import knn
from engram.plans.registry import query, table
from engram.schema import Params
from engram.shared import written

P = Params()


def vector_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, utility, content, tags)"""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"))
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("double").alias("quality"))
    return v.join(d, "vec_id").join(q, "vec_id", "left").withColumn("utility", F.coalesce("quality", F.lit(P.q0))).drop("quality")


def asked(bank: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return bank.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


BANK_SQL = """
bank AS (SELECT vec_id, embedding::DOUBLE[] AS e, text AS content, [lang, source] AS tags, coalesce(quality::DOUBLE, 0.5) AS utility
  FROM embeddings JOIN documents ON vec_id = documents.doc_id LEFT JOIN labels ON labels.doc_id = vec_id),
pairs AS (SELECT q.vec_id AS query_id, b.vec_id, b.utility, list_cosine_similarity(b.e, q.e) AS sim FROM bank b, bank q WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM pairs)"""
POOL_SQL = BANK_SQL + """,
pool AS (SELECT * FROM ranked WHERE rank <= 20 AND sim > 0.3)"""


def _z(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER w < 1e-12 THEN 0 ELSE ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w END"


SCORED_SQL = POOL_SQL + f""",
normal AS (SELECT *, {_z("sim")} AS s, {_z("utility")} AS q FROM pool WINDOW w AS (PARTITION BY query_id))"""


def _best(score: str) -> str:
    return f"""SELECT query_id, vec_id, place, round(sim, 6) AS sim, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM (SELECT *, {score} AS score FROM normal)) WHERE place <= 5"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) if c in names else F.col(c)).alias(c) for c in df.columns])


@query(f"WITH {SCORED_SQL} {_best('0.6 * s + 0.4 * q')}")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    return _rounded(retrieve.hybrid_retrieve(asked(bank), bank), "sim", "score")


@query(f"WITH {SCORED_SQL} {_best('0.6 * sim + 0.4 * utility')}")
def hybrid_retrieve_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    return _rounded(retrieve.hybrid_retrieve(asked(bank), bank, replace(P, use_zscore=False)), "sim", "score")


@query(f"""WITH {SCORED_SQL}, lams AS (SELECT unnest([0.0::DOUBLE, 0.2, 0.4, 0.6, 0.8, 1.0]) AS lam)
SELECT lam, query_id, vec_id, place, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lam, query_id ORDER BY score DESC, rank) AS place
  FROM (SELECT *, (1.0 - lam) * s + lam * q AS score FROM normal, lams)) WHERE place <= 5""")
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    pool = retrieve.candidates(asked(bank), bank.select("vec_id", "embedding"), P).join(bank.select("vec_id", "utility"), "vec_id")
    out = None
    for lam in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0):
        one = retrieve.rerank(pool, replace(P, lam=lam)).select(F.lit(lam).alias("lam"), "query_id", "vec_id", "place", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {BANK_SQL} SELECT query_id, vec_id, rank, round(sim, 6) AS sim FROM ranked WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    return _rounded(knn(asked(bank), bank, 10), "sim").select("query_id", "vec_id", "rank", "sim")


@query(f"WITH {BANK_SQL} SELECT query_id, vec_id, rank, round(sim, 6) AS sim FROM ranked WHERE rank <= 10")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a kept index: of two thirds of the vectors, extended by the others."""
    bank = vector_bank(spark, sf_dir).select("vec_id", "embedding")
    index = vector_index.extended(vector_index.build(bank.where("vec_id % 3 <> 0")), bank.where("vec_id % 3 = 0"))
    return _rounded(vector_index.search(asked(bank), index, 10), "sim").select("query_id", "vec_id", "rank", "sim")


@query(f"WITH {POOL_SQL} SELECT query_id, vec_id, rank, round(sim, 6) AS sim FROM pool")
def phase_a_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    return _rounded(retrieve.candidates(asked(bank), bank), "sim").select("query_id", "vec_id", "rank", "sim")


@query(f"WITH {SCORED_SQL} SELECT query_id, vec_id, round(s, 6) AS z_sim, round(q, 6) AS z_utility FROM normal")
def zscore_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vector_bank(spark, sf_dir)
    pool = retrieve.candidates(asked(bank), bank.select("vec_id", "embedding"), P).join(bank.select("vec_id", "utility"), "vec_id")
    return pool.select("query_id", "vec_id", F.round(retrieve.zscore("sim", "query_id"), 6).alias("z_sim"), F.round(retrieve.zscore("utility", "query_id"), 6).alias("z_utility"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim,
  round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS length
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("sim"), F.round(norm(F.col("embedding")), 6).alias("length"))


NEAR_SQL = BANK_SQL + """,
near AS (SELECT r.query_id AS src, r.vec_id AS dst, rank, a.tags AS src_tags, b.tags AS dst_tags
  FROM ranked r JOIN bank a ON a.vec_id = r.query_id JOIN bank b ON b.vec_id = r.vec_id WHERE rank <= 5),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank) AS k FROM near WHERE src <> dst) WHERE k <= 2),
edges AS (SELECT src, dst FROM found UNION SELECT dst, src FROM found)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, rank, src_tags, dst_tags): the five nearest of each query vector, itself included."""
    bank = vector_bank(spark, sf_dir)
    # Written once: whoever takes these rows several times does not search again.
    found = written(knn(asked(bank), bank, P.k).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "rank"), "near")
    tags = bank.select("vec_id", "tags")
    return found.join(tags.select(F.col("vec_id").alias("src"), F.col("tags").alias("src_tags")), "src").join(tags.select(F.col("vec_id").alias("dst"), F.col("tags").alias("dst_tags")), "dst")


@query(f"""WITH {NEAR_SQL} SELECT src AS source, dst AS target,
  CASE WHEN list_has_any(list_transform(src_tags, lambda x: lower(x)), list_transform(dst_tags, lambda x: lower(x))) THEN 'same-domain' ELSE 'semantic-related' END AS relation FROM found""")
def link_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.relations(_near(spark, sf_dir))


def _edges(near: DataFrame) -> DataFrame:
    return link.link_edges(link.accepted(link.relations(near), near))


@query(f"WITH {NEAR_SQL} SELECT src, dst FROM edges")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_near(spark, sf_dir))


@query(f"WITH {NEAR_SQL} SELECT vec_id AS id, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst::VARCHAR) FROM edges WHERE src = vec_id), '') AS links FROM bank")
def link_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = vector_bank(spark, sf_dir).select(F.col("vec_id").alias("id"), F.array().cast("array<string>").alias("links"))
    edges = _edges(_near(spark, sf_dir)).select("src", F.col("dst").cast("string").alias("dst"))
    return link.add_links(notes, edges).select("id", F.array_join("links", ",").alias("links"))


@query(f"WITH {NEAR_SQL} SELECT src, dst FROM edges WHERE dst NOT IN (SELECT vec_id FROM bank WHERE vec_id % 3 <> 0) AND src IN (SELECT vec_id FROM bank WHERE vec_id % 3 <> 0)")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links left over after every third note has been deleted."""
    arrays = _edges(_near(spark, sf_dir)).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("links"))
    notes = vector_bank(spark, sf_dir).select(F.lit("b").alias("bank_id"), F.col("vec_id").alias("id")).join(arrays, "id", "left")
    left = banks.delete(notes, notes.where(F.col("id") % 3 == 0))
    return banks.dangling_links(left).select("src", "dst")


@query(f"""WITH RECURSIVE {NEAR_SQL},
walk AS (SELECT DISTINCT src AS start, src AS id, 0 AS hop FROM found UNION SELECT start, dst, hop + 1 FROM walk JOIN edges ON src = id WHERE hop < 2)
SELECT start, id, min(hop) AS hop FROM walk GROUP BY start, id""")
def link_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    start = link.relations(near).select(F.col("source").alias("id")).distinct()
    return link.hops(_edges(near), start, 2)


FIELDS_SQL = r"""
texts AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS low FROM documents),
parts AS (SELECT *, regexp_extract(low, 'name is\s+([a-z]+)', 1) AS nm,
  CASE WHEN len(regexp_extract_all(t, 'named\s+([A-Za-z]+)', 1)) > 0 THEN list_transform(regexp_extract_all(t, 'named\s+([A-Za-z]+)', 1), lambda x: lower(x))
    ELSE list_filter(['buddy', 'scout'], lambda x: contains(low, x)) END AS pets,
  contains(low, 'dog') OR contains(low, 'buddy') OR contains(low, 'scout') AS dogs,
  contains(low, 'work') OR contains(low, 'job') OR contains(low, 'scientist') AS work FROM texts),
ruled AS (SELECT *, contains(low, 'name is') AND nm <> '' AS named FROM parts),
fields AS (SELECT doc_id, text, list_distinct(CASE WHEN named OR dogs OR work THEN
    list_concat(CASE WHEN named THEN [nm, 'name', 'identity'] ELSE [] END, CASE WHEN dogs THEN list_concat(['dog', 'pet'], pets) ELSE [] END,
      CASE WHEN work THEN ['job', 'career', 'data scientist'] ELSE [] END)
    WHEN len(regexp_extract_all(low, '[a-z0-9]+')) > 0 THEN regexp_extract_all(low, '[a-z0-9]+')[1:4] ELSE ['general'] END) AS keywords,
  list_distinct(CASE WHEN named OR dogs OR work THEN list_concat(CASE WHEN named THEN ['profile', 'personal'] ELSE [] END, CASE WHEN dogs THEN ['pets'] ELSE [] END,
      CASE WHEN work THEN ['career', 'professional'] ELSE [] END) ELSE ['general'] END) AS tags,
  CASE WHEN work THEN 'User works as a data scientist at a tech company.'
    WHEN dogs AND len(pets) > 0 THEN 'User has dog(s): ' || array_to_string(list_transform(list_distinct(pets), lambda x: upper(x[1]) || x[2:]), ', ') || '.'
    WHEN named THEN 'User''s name is ' || upper(nm[1]) || nm[2:] || '.' ELSE t END AS description FROM ruled)"""


def _sorted(name: str) -> Column:
    return F.array_join(F.array_sort(name), ",").alias(name)


@query(f"""WITH {FIELDS_SQL} SELECT doc_id, array_to_string(list_sort(keywords), ',') AS keywords, array_to_string(list_sort(tags), ',') AS tags,
  md5(description) AS description FROM fields""")
def note_field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", note_fields(F.col("text")).alias("f")).select("doc_id", _sorted("f.keywords").alias("keywords"), _sorted("f.tags").alias("tags"), F.md5("f.description").alias("description"))


def _in_order(items: str) -> str:
    """The first of each item of a list, in its order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


#: The fields of notes with their lists in order.
ORDERED_SQL = FIELDS_SQL.replace("list_distinct(CASE", "(CASE")


@query(f"""WITH {ORDERED_SQL} SELECT doc_id, array_to_string({_in_order("keywords")}, ',') AS keywords, array_to_string({_in_order("tags")}, ',') AS tags FROM fields""")
def note_field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and tags as the rules list them: each once, where it comes first."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", note_fields(F.col("text")).alias("f")).select("doc_id", F.array_join("f.keywords", ",").alias("keywords"), F.array_join("f.tags", ",").alias("tags"))


@query(f"""WITH {NEAR_SQL}, {FIELDS_SQL}
SELECT src, dst, array_to_string(list_sort(list_distinct(list_concat(o.keywords, n.keywords))), ',') AS keywords,
  array_to_string(list_sort(list_distinct(list_concat(o.tags, n.tags))), ',') AS tags,
  md5(CASE WHEN regexp_replace(n.description, '^\\s+|\\s+$', '', 'g') = '' THEN regexp_replace(o.description, '^\\s+|\\s+$', '', 'g')
    ELSE trim(regexp_replace(o.description, '^\\s+|\\s+$', '', 'g') || ' | Related update: ' || regexp_replace(n.description, '^\\s+|\\s+$', '', 'g'), ' |') END) AS description
FROM near JOIN fields n ON n.doc_id = src JOIN fields o ON o.doc_id = dst""")
def evolve_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(F.col("doc_id"), note_fields(F.col("text")).alias("f"))
    near = _near(spark, sf_dir).select("src", "dst")
    old, new = (made.select(F.col("doc_id").alias(k), *[F.col(f"f.{c}").alias(f"{p}_{c}") for c in ("keywords", "tags", "description")]) for k, p in (("dst", "old"), ("src", "new")))
    out = link.evolve(near.join(old, "dst").join(new, "src"))
    return out.select("src", "dst", _sorted("keywords"), _sorted("tags"), F.md5("description").alias("description"))


OVERLAP_SQL = SCORED_SQL + f""", {FIELDS_SQL},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * s + 0.4 * q DESC, rank) AS place FROM normal) WHERE place <= 5),
scored AS (SELECT query_id, vec_id, place, best.utility, f.text AS content, f.keywords,
  len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(f.text), '[a-z0-9]+'))))
  + len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')), list_distinct(list_transform(f.keywords, lambda x: lower(x))))) + best.utility AS overlap, a.text AS asked
  FROM best JOIN fields f ON f.doc_id = vec_id JOIN documents a ON a.doc_id = query_id),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, place) AS pick FROM scored) WHERE pick <= 2)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, place, content, keywords, asked, overlap) of the retrieved notes."""
    bank = vector_bank(spark, sf_dir)
    best = retrieve.hybrid_retrieve(asked(bank), bank).select("query_id", "vec_id", "place")
    notes = bank.select("vec_id", "content", "utility", note_fields(F.col("content"))["keywords"].alias("keywords"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("asked"))
    rows = best.join(notes, "vec_id").join(texts, "query_id")
    return rows.withColumn("overlap", overlap_score(F.col("asked"), F.col("content"), F.col("keywords"), F.col("utility"))).withColumn("id", F.col("vec_id").cast("string"))


@query(f"WITH {OVERLAP_SQL} SELECT query_id, vec_id, pick, round(overlap, 6) AS overlap FROM picked")
def distil_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.distil(_scored(spark, sf_dir)).select("query_id", "vec_id", "pick", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {OVERLAP_SQL} SELECT query_id, md5(string_agg('- ' || content, chr(10) ORDER BY place)) AS context FROM scored GROUP BY query_id")
def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.context(_scored(spark, sf_dir)).select("query_id", F.md5("context").alias("context"))


@query(rf"""WITH {OVERLAP_SQL},
sets AS (SELECT query_id, any_value(lower(asked)) AS q, list(content ORDER BY pick) AS contents, flatten(list(list_concat(
  CASE WHEN len(regexp_extract_all(content, 'named\s+([A-Za-z]+)', 1)) > 0 THEN list_transform(regexp_extract_all(content, 'named\s+([A-Za-z]+)', 1), lambda x: lower(x))
    ELSE list_filter(['buddy', 'scout'], lambda x: contains(lower(content), x)) END,
  list_filter(list_transform(keywords, lambda x: lower(x)), lambda x: x IN ('buddy', 'scout'))) ORDER BY pick)) AS dogs,
  list_filter(list(regexp_extract(lower(content), 'name is\s+([a-z]+)', 1) ORDER BY pick), lambda x: x <> '') AS names FROM picked GROUP BY query_id)
SELECT query_id, md5(CASE
  WHEN contains(q, 'dog') OR contains(q, 'pet') THEN CASE WHEN len(dogs) > 0 THEN
    'You have two dogs: ' || array_to_string(list_transform(list_filter(dogs, lambda x, i: list_position(dogs, x) = i), lambda x: upper(x[1]) || x[2:]), ', ') || '.'
    ELSE 'I could not find your dog names in memory yet.' END
  WHEN contains(q, 'job') OR contains(q, 'work') OR contains(q, 'career') THEN 'You work as a data scientist at a tech company.'
  WHEN contains(q, 'name') OR contains(q, 'who am i') THEN CASE WHEN len(names) > 0 THEN 'Your name is ' || upper(names[1][1]) || names[1][2:] || '.'
    ELSE 'I could not find your name in memory yet.' END
  ELSE contents[1] END) AS answer FROM sets""")
def answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = retrieve.distil(_scored(spark, sf_dir))
    rows = F.array_sort(F.collect_list(F.struct("pick", "content", "keywords")))
    sets = picked.groupBy("query_id").agg(F.first("asked").alias("asked"), rows.alias("rows"))
    sets = sets.select("query_id", "asked", F.transform("rows", lambda r: r["content"]).alias("contents"), F.transform("rows", lambda r: r["keywords"]).alias("keys"))
    return sets.select("query_id", F.md5(answer(F.col("asked"), F.col("contents"), F.col("keys"))).alias("answer"))


@query(f"""WITH {OVERLAP_SQL}, ids AS (SELECT query_id, list(vec_id::VARCHAR ORDER BY place) AS ids FROM scored GROUP BY query_id)
SELECT b.vec_id AS query_id, array_to_string(CASE WHEN ids IS NULL THEN [] WHEN b.vec_id % 300 = 0 THEN ids[1:1] ELSE ids END, ',') AS ids,
  CASE WHEN ids IS NULL OR b.vec_id % 300 = 100 THEN 'baseline' ELSE 'reply' END AS answer
FROM (SELECT vec_id FROM bank WHERE vec_id % 100 = 0) b LEFT JOIN ids ON ids.query_id = b.vec_id""")
def distil_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that select one note, that can't be read, and that select no candidate."""
    pool = _scored(spark, sf_dir).select("query_id", "id", "place")
    queries = asked(vector_bank(spark, sf_dir)).select("query_id")
    first = pool.where("place = 1").select("query_id", F.col("id").alias("first"))
    reply = (
        F.when(F.col("query_id") % 300 == 0, F.concat(F.lit('{"selected_ids": ["'), F.coalesce("first", F.lit("none")), F.lit('"], "answer": "reply"}')))
        .when(F.col("query_id") % 300 == 100, F.lit("not json"))
        .otherwise(F.lit('{"selected_ids": ["unknown"], "answer": "reply"}'))
    )
    replies = queries.join(first, "query_id", "left").select("query_id", reply.alias("reply"))
    return retrieve.distil_and_answer(queries, pool, replies, F.lit("baseline")).select("query_id", F.array_join("ids", ",").alias("ids"), "answer")
