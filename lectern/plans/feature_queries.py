"""Queries on corpus features, retrieval and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import STOP_WORDS, TOKEN1, TOKEN2
from lectern.operators import chunk, criteria, features, parsed, retrieval
from lectern.plans.scoring_queries import CRIT, DOCS, PARAS, counts_of, docs_of, paras_of, quoted, split_words
from lectern.session import cut
from lectern.sources.tables import table


def _corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Paragraphs, postings, vocabulary and weights of the parsed files."""
    paras = paras_of(spark, folder)
    post = features.postings(paras)
    n = docs_of(spark, folder).count()
    vocab = features.vocabulary(post, n)
    return paras, post, vocab, features.weigh(post, vocab)


def _by_file(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and weights as _corpus gives them. Paragraphs are put by file once, so that postings and weights need no shuffle of their own."""
    paras = parsed.paragraphs(table(spark, folder, "paragraphs").repartition(F.col("doc_id")))
    post = features.postings(paras)
    vocab = cut(features.vocabulary(post, docs_of(spark, folder).count()))
    # sent around only if it is small enough
    return paras, features.weigh_once(post, F.broadcast(vocab) if vocab.count() <= 1_000_000 else vocab)


def tfidf_vocabulary(spark, folder):
    return _corpus(spark, folder)[2].select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, folder):
    return _corpus(spark, folder)[3].groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"), F.round(F.max("weight"), 6).alias("max_weight"))


def document_entropy(spark, folder):
    return features.entropy(_corpus(spark, folder)[3]).withColumn("entropy", F.round("entropy", 6))


def readability_grade(spark, folder):
    return features.readability(paras_of(spark, folder)).withColumn("grade", F.round("grade", 6))


def heading_coherence(spark, folder):
    paras, _, vocab, _ = _corpus(spark, folder)
    return features.coherence(parsed.heading_content(paras), vocab).withColumn("coherence", F.round("coherence", 6))


def information_density(spark, folder):
    paras, _, vocab, _ = _corpus(spark, folder)
    body = parsed.sections(paras).filter("level = 0").select("doc_id", "section", "text")
    return features.density(body, vocab).withColumn("density", F.round("density", 6))


def topic_boundaries(spark, folder):
    paras, _, vocab, _ = _corpus(spark, folder)
    return features.topic_boundaries(paras, vocab).select("doc_id", F.col("boundary").cast("long").alias("boundary"))


def similar_documents(spark, folder):
    return features.similar_documents(_by_file(spark, folder)[1], 0.6).withColumn("cosine", F.round("cosine", 5))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items", "item_id", "question").distinct().select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")


def bm25_top5(spark, folder):
    index, idf = retrieval.bm25_index(_texts(spark, folder))
    got = retrieval.top_k(retrieval.bm25(retrieval.query_terms(_items(spark, folder)), index, idf), 5)
    return got.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def self_retrieval(spark, folder):
    paras, weights = _by_file(spark, folder)
    index, _ = retrieval.bm25_index(paras)
    return retrieval.self_retrieval(weights, index).withColumn("self_retrieval", F.round("self_retrieval", 6))


def metrics_scorecards(spark, folder):
    """Scorecards that know the entropy and the self-retrieval of each file."""
    paras, weights = _by_file(spark, folder)
    top = retrieval.own_terms(weights)
    found = retrieval.self_retrieval_of(top, paras)
    counts = criteria.document_counts(docs_of(spark, folder), paras)
    crit = criteria.criteria(counts, top.filter("r = 1").select(F.col("q").alias("doc_id"), "entropy"), found)
    return criteria.scorecards(crit).select("doc_id", F.round("overall_score", 6).alias("overall_score"), "gate_decision")


def rocchio_expansion(spark, folder):
    texts = _texts(spark, folder)
    post = features.postings(texts)
    n = texts.select("doc_id").distinct().count()
    vocab = features.vocabulary(post, n)
    q = features.weigh(features.postings(_items(spark, folder), "query_id"), vocab, "query_id")
    return features.rocchio_terms(q, features.weigh(post, vocab), n).select("query_id", "term", "rank")


def section_chunks(spark, folder):
    c = chunk.chunks(docs_of(spark, folder), paras_of(spark, folder))
    return c.select("chunk_id", "doc_id", "n_words", F.md5("text").alias("md5"), F.array_join("heading_path", " > ").alias("heading_path"), "start_paragraph", "end_paragraph", "token_estimate")


def chunk_counts(spark, folder):
    return chunk.chunks(docs_of(spark, folder), paras_of(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def split_recommendations(spark, folder):
    paras, _, vocab, _ = _corpus(spark, folder)
    rec = chunk.split_recommendations(criteria.criteria(counts_of(spark, folder)), features.topic_boundaries(paras, vocab), paras)
    return rec.select("doc_id", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), ",").alias("boundaries"), F.array_join("titles", "|").alias("titles"))


def embedding_neighbours(spark, folder):
    """For every vector whose id is divisible by 20: the five others nearest by cosine."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding").distinct()
    unit = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = unit.withColumn("norm", norm)
    # a stated query set against all rows; its size is checked before it is sent around
    q = unit.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    small = q.count() <= 20_000
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = unit.crossJoin(F.broadcast(q) if small else q).filter("vec_id <> query_id").select("query_id", "vec_id", (dot / (F.col("norm") * F.col("qn"))).alias("score"))
    return retrieval.top_k(pairs, 5, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_vocabulary, tfidf_weights, document_entropy, readability_grade, heading_coherence, information_density, topic_boundaries, similar_documents, bm25_top5, self_retrieval,
        metrics_scorecards, rocchio_expansion, section_chunks, chunk_counts, split_recommendations, embedding_neighbours,
    )
}


def tokens_sql(c: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({c}), '({pattern})', 1)"


def _postings(name: str, source: str, key: str, pattern: str = TOKEN2, stop: bool = True) -> str:
    no = f"WHERE term NOT IN ({quoted(STOP_WORDS)})" if stop else ""
    return f"{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({tokens_sql('text', pattern)}) AS term FROM {source}) {no} GROUP BY ALL)"


def _weights(name: str, post: str, key: str) -> str:
    return (
        f"{name}_raw AS (SELECT {key}, term, tf * idf AS w FROM {post} JOIN vocab USING (term)), "
        f"{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"
    )


def _vocab(post: str, n: str) -> str:
    return f"nd AS (SELECT count(*) AS n FROM {n}), vocab AS (SELECT term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM {post} GROUP BY term), nd WHERE n <= 1 OR df <= 0.95 * n)"


CORPUS = f"{DOCS}, {PARAS}, " + ", ".join((_postings("post", "paras", "doc_id"), _vocab("post", "docs"), _weights("tfidf", "post", "doc_id")))
_SEC = "sec AS (SELECT *, (sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY index))::INT AS section FROM paras)"
_HC = "hc AS (SELECT * FROM (SELECT doc_id, section, max(text) FILTER (level > 0) AS heading, string_agg(text, ' ' ORDER BY index) FILTER (level = 0) AS content FROM sec WHERE section > 0 GROUP BY doc_id, section) WHERE content <> '')"
_SYL = "list_sum(list_transform({w}, lambda x: greatest(1, len(regexp_extract_all(CASE WHEN length(x) > 2 THEN regexp_replace(x, 'e$', '') ELSE x END, '[aeiouy]+')))))"


def _bm25(texts: str, key: str, queries: str) -> str:
    """CTEs up to scores(query_id, key, score)."""
    return ", ".join((
        _postings("bp", texts, key, TOKEN1, False),
        f"bl AS (SELECT {key}, coalesce(sum(tf), 0) AS dl FROM (SELECT DISTINCT {key} FROM {texts}) LEFT JOIN bp USING ({key}) GROUP BY {key})",
        "bn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bl)",
        "bi AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM bp GROUP BY term), bn)",
        f"bx AS (SELECT {key}, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS part FROM bp JOIN bl USING ({key}) JOIN bi USING (term), bn)",
        _postings("bq", queries, "query_id", TOKEN1, False),
        "bc AS (SELECT query_id, sum(tf * idf) AS constant FROM bq JOIN bi USING (term) GROUP BY query_id)",
        f"scores AS (SELECT query_id, {key}, s + constant AS score FROM (SELECT query_id, {key}, sum(tf * part) AS s FROM bq JOIN bx USING (term) GROUP BY ALL) JOIN bc USING (query_id))",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM scores)",
    ))


_ITEMS = "queries AS (SELECT DISTINCT item_id AS query_id, question AS text FROM eval_items), texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"
_SMOOTH = " ".join(
    f"WHEN {cond} THEN (" + " + ".join(f"{c} * lag(cosine, {shift - i}) OVER w" for i, c in enumerate(cs)) + ") / 35"
    for cond, shift, cs in (("b = 0", 0, (31, 9, -3, -5, 3)), ("b = 1", 1, (9, 13, 12, 6, -5)), ("b = k - 2", 3, (-5, 6, 12, 13, 9)), ("b = k - 1", 4, (3, -5, -3, 9, 31)))
) + " ELSE (" + " + ".join(f"{c} * lag(cosine, {2 - i}) OVER w" for i, c in enumerate((-3, 12, 17, 12, -3))) + ") / 35"
_TILES = f"""np AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY index) - 1 AS pos FROM paras), nb AS (SELECT doc_id, pos // 3 AS b, text, doc_id || ':' || (pos // 3) AS key FROM np),
  {_postings("tp", "nb", "key, doc_id, b")}, traw AS (SELECT doc_id, b, term, tf * idf AS w FROM tp JOIN vocab USING (term)),
  tw AS (SELECT doc_id, b, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, b)) AS weight FROM traw),
  tc AS (SELECT x.doc_id, x.b, sum(x.weight * y.weight) AS cosine FROM tw x JOIN tw y ON x.doc_id = y.doc_id AND y.b = x.b + 1 AND x.term = y.term GROUP BY ALL),
  ts AS (SELECT doc_id, n, ceil(n / 3.0)::INT - 1 AS k FROM (SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id) WHERE n >= 3),
  tg AS (SELECT doc_id, n, k, b, coalesce(cosine, 0) AS cosine FROM (SELECT doc_id, n, k, unnest(range(k)) AS b FROM ts WHERE k >= 2) LEFT JOIN tc USING (doc_id, b)),
  tm AS (SELECT *, CASE WHEN k < 7 THEN cosine {_SMOOTH} END AS s FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
  tz AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r, avg(s) OVER (PARTITION BY doc_id) - stddev_pop(s) OVER (PARTITION BY doc_id) AS lim FROM tm WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
  tb AS (SELECT doc_id, b * 3 + 3 AS boundary FROM tz WHERE s < l AND s < r AND s < lim AND b * 3 + 3 < n)"""
_ENTROPY = "ent AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END AS entropy FROM (SELECT doc_id, weight / sum(weight) OVER (PARTITION BY doc_id) AS p FROM tfidf) GROUP BY doc_id)"
_CHUNKS = f"""secw AS (SELECT doc_id, section, flatten(list({split_words("text")} ORDER BY index)) AS w, flatten(list(list_transform({split_words("text")}, lambda x: index) ORDER BY index)) AS pix FROM sec WHERE level = 0 GROUP BY doc_id, section),
  win AS (SELECT doc_id, section, w, pix, unnest(range(CASE WHEN len(w) <= 220 THEN 1 ELSE 1 + ceil((len(w) - 220) / 180.0)::INT END)) AS i FROM secw WHERE len(w) > 0),
  cut AS (SELECT doc_id, section, i, w[i * 180 + 1:i * 180 + 220] AS w, pix[i * 180 + 1:i * 180 + 220] AS pix, row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS ix FROM win)"""
_PATHS = """h AS (SELECT doc_id, index, level, section, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS rn FROM sec WHERE level > 0),
  r AS (SELECT doc_id, section, rn, [t] AS path FROM h WHERE rn = 1 UNION ALL SELECT h.doc_id, h.section, h.rn, list_append(r.path[1:h.level - 1], h.t) FROM r JOIN h ON h.doc_id = r.doc_id AND h.rn = r.rn + 1)"""
SQL = {
    "tfidf_vocabulary": f"WITH {CORPUS} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_weights": f"WITH {CORPUS} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight, round(max(weight), 6) AS max_weight FROM tfidf GROUP BY doc_id",
    "document_entropy": f"WITH {CORPUS}, {_ENTROPY} SELECT doc_id, round(entropy, 6) AS entropy FROM ent",
    "readability_grade": f"""WITH {PARAS}, r AS (SELECT doc_id, sum(len({tokens_sql("text", TOKEN1)})) AS w, sum(len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''))) AS s,
        sum(coalesce({_SYL.format(w=tokens_sql("text", TOKEN1))}, 0)) AS y FROM paras GROUP BY doc_id)
        SELECT doc_id, round(CASE WHEN w > 0 AND s > 0 THEN greatest(0, 0.39 * w / s + 11.8 * y / w - 15.59) ELSE 0 END, 6) AS grade FROM r""",
    "heading_coherence": f"""WITH {CORPUS}, {_SEC}, {_HC}, hk AS (SELECT doc_id, section, heading AS text FROM hc), ck AS (SELECT doc_id, section, content AS text FROM hc),
        {_postings("hp", "hk", "doc_id, section")}, {_postings("cp", "ck", "doc_id, section")}, hraw AS (SELECT doc_id, section, term, tf * idf AS w FROM hp JOIN vocab USING (term)), craw AS (SELECT doc_id, section, term, tf * idf AS w FROM cp JOIN vocab USING (term)),
        hw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, section)) AS x FROM hraw), cw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, section)) AS x FROM craw),
        cs AS (SELECT doc_id, section, sum(hw.x * cw.x) AS cosine FROM hw JOIN cw USING (doc_id, section, term) GROUP BY ALL)
        SELECT doc_id, round(avg(coalesce(cosine, 0)), 6) AS coherence FROM hc LEFT JOIN cs USING (doc_id, section) GROUP BY doc_id""",
    "information_density": f"""WITH {CORPUS}, {_SEC}, bs AS (SELECT doc_id, section, text FROM sec WHERE level = 0), {_postings("bp", "bs", "doc_id, section")}, braw AS (SELECT doc_id, section, term, tf * idf AS w FROM bp JOIN vocab USING (term)),
        bw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, section)) AS x FROM braw), bd AS (SELECT doc_id, section, avg(x) AS density FROM bw GROUP BY ALL)
        SELECT doc_id, section, round(coalesce(density, 0), 6) AS density FROM (SELECT DISTINCT doc_id, section FROM bs) LEFT JOIN bd USING (doc_id, section)""",
    "topic_boundaries": f"WITH {CORPUS}, {_TILES} SELECT doc_id, boundary FROM tb",
    "similar_documents": f"WITH {CORPUS} SELECT doc_a, doc_b, round(cosine, 5) AS cosine FROM (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS cosine FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) WHERE cosine >= 0.6",
    "bm25_top5": f"WITH {_ITEMS}, {_bm25('texts', 'doc_id', 'queries')} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 5",
    "section_chunks": f"""WITH RECURSIVE {DOCS}, {PARAS}, {_SEC}, {_CHUNKS}, {_PATHS}
        SELECT stem || '::' || CASE WHEN ix < 1000 THEN lpad(ix::VARCHAR, 3, '0') ELSE ix::VARCHAR END AS chunk_id, doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS md5, coalesce(array_to_string(path, ' > '), '') AS heading_path,
        pix[1] AS start_paragraph, pix[-1] AS end_paragraph, greatest(1, length(array_to_string(w, ' ')) // 4) AS token_estimate FROM cut JOIN docs USING (doc_id) LEFT JOIN r USING (doc_id, section)""",
    "chunk_counts": f"WITH {DOCS}, {PARAS}, {_SEC}, {_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM cut JOIN docs USING (doc_id) GROUP BY doc_id",
    "split_recommendations": f"""WITH {CRIT}, {_postings("post", "paras", "doc_id")}, {_vocab("post", "docs")}, {_TILES}, bb AS (SELECT doc_id, string_agg(boundary::VARCHAR, ',' ORDER BY boundary) AS b FROM tb GROUP BY doc_id),
        hh AS (SELECT doc_id, list(index ORDER BY index) AS ix, list(regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY index) AS t FROM paras WHERE level > 0 GROUP BY doc_id)
        SELECT doc_id, coalesce(b, array_to_string(ix[2:], ','), '') AS boundaries, coalesce(array_to_string(list_filter(t[1:6], lambda x: x <> ''), '|'), '') AS titles
        FROM (SELECT doc_id FROM crit WHERE category = 'file_focus' AND score <= 65) LEFT JOIN bb USING (doc_id) LEFT JOIN hh USING (doc_id)""",
    "embedding_neighbours": """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e)
        SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
          SELECT q.vec_id AS query_id, n.vec_id, list_inner_product(q.v, n.v) / (q.n * n.n) AS score FROM n, n q WHERE q.vec_id % 20 = 0 AND n.vec_id <> q.vec_id)) WHERE rank <= 5""",
}
