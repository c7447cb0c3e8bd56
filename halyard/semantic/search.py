"""Search over the catalogue: a keyword channel, a vector channel, rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import CHANNEL_HITS, SEARCH_HITS
from halyard.session import materialize

#: Terms shorter than a trigram can't be found by themselves.
TERM_CHARS = 3
# fixed values: parameters of BM25 and of the rank fusion
K1, B, IDF_LEAST = 1.2, 0.75, 1e-6
FUSION_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 2.0, 1.0
SEARCHABLE = ("concept", "metric")


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("tombstone", F.lit(False)))


def terms(query: str) -> list[str]:
    """The terms of a query that count: those of at least TERM_CHARS characters."""
    return [t.lower() for t in query.split() if len(t) >= TERM_CHARS]


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def bm25(df: DataFrame, key: str, texts: Sequence[str], query: Sequence[str], among: Column | None = None) -> DataFrame:
    """(key, score) of the rows that have every term as a substring of one of the
    text columns, by BM25 over trigrams. All rows of df count for the statistics;
    `among` restricts what is given."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in texts]
    rows = df.select(
        F.col(key).alias("key"),
        (among if among is not None else F.lit(True)).alias("ok"),
        sum((F.greatest(F.char_length(t) - 2, F.lit(0)) for t in low), F.lit(0)).alias("dl"),
        F.array(*(sum((occurrences(t, q) for t in low), F.lit(0)) for q in query)).alias("f"),
    )
    # texts are read once: what is counted of them is written, for the statistics and the hits
    rows = materialize(rows)
    has = [F.sum(F.when(F.get("f", F.lit(i)) > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(query))]
    stats = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("av"), *has).alias("s")).scalar()
    hit = rows.where(F.col("ok") & F.forall("f", lambda x: x > 0)).withColumn("s", stats)
    score = F.lit(0.0)
    for i in range(len(query)):
        n1, f = F.col(f"s.n{i}"), F.get("f", F.lit(i))
        idf = F.greatest(F.log((F.col("s.n") - n1 + 0.5) / (n1 + 0.5)), F.lit(IDF_LEAST))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("s.av")))
    return hit.select("key", score.alias("score"))


def ranked(df: DataFrame, order: Sequence[Column], cap: int, rank: str) -> DataFrame:
    """The first `cap` rows with their rank. The limit comes first, so that the
    window sees no more than `cap` rows."""
    top = df.orderBy(*order).limit(cap)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def keyword_hits(entities: DataFrame, query: str, kinds: Sequence[str] = SEARCHABLE, cap: int = CHANNEL_HITS) -> DataFrame:
    """(fqn, kw_rank), best first. All terms must occur in name or description; a
    query without a long enough term is looked for literally in fqn, name and
    description, in order of fqn. Statistics are over all live entities."""
    rows = live(entities)
    mine = F.col("kind").isin(list(kinds))
    q = terms(query)
    if q:
        score = bm25(rows, "fqn", ["name", "description"], q, mine)
        best = score.select(F.col("key").alias("fqn"), F.round("score", 12).alias("score"))
        return ranked(best, [F.desc("score"), F.asc("fqn")], cap, "kw_rank").select("fqn", "kw_rank")
    text = query.strip().lower()
    found = F.lit(False)
    for c in ("fqn", "name", "description"):
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text))
    return ranked(rows.where(mine & found).select("fqn"), [F.asc("fqn")], cap, "kw_rank")


def distance(v: Column, q: Sequence[float], cosine: bool = False) -> Column:
    """Distance of a vector column (array of numbers) from a query vector: L2, or one less the cosine."""
    vec = F.array(*(F.lit(float(x)) for x in q))
    d = F.transform(v, lambda x: x.cast("double"))
    if cosine:
        dot = F.aggregate(F.zip_with(d, vec, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
        return 1 - dot / (norm * float(sum(x * x for x in q)) ** 0.5)
    return F.sqrt(F.aggregate(F.zip_with(d, vec, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def vector_hits(vectors: DataFrame, key: str, vector: str, q: Sequence[float], cap: int = CHANNEL_HITS, cosine: bool = False) -> DataFrame:
    """(key, distance, vec_rank) of the nearest vectors of the query's dimension,
    ties by key. What may not be found is to be filtered out before."""
    near = vectors.where(F.size(vector) == len(q)).select(F.col(key).alias(key), F.round(distance(F.col(vector), q, cosine), 9).alias("distance"))
    return ranked(near, [F.asc("distance"), F.asc(key)], cap, "vec_rank")


def fuse(keyword: DataFrame, vector: DataFrame, key: str, cap: int = SEARCH_HITS) -> DataFrame:
    """(key, score, kw_rank, vec_rank) of the union of two ranked lists (columns
    kw_rank, vec_rank), best first by reciprocal ranks; any keyword hit is before
    any that only the vectors found."""
    both = keyword.select(key, "kw_rank").join(vector.select(key, "vec_rank"), key, "full")
    zero = F.lit(0.0)
    score = F.coalesce(F.lit(KEYWORD_WEIGHT) / (F.col("kw_rank") + FUSION_K), zero) + F.coalesce(F.lit(VECTOR_WEIGHT) / (F.col("vec_rank") + FUSION_K), zero)
    order = [F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), F.asc(key)]
    return both.withColumn("score", score).orderBy(*order).limit(cap)


def entity_text(e: str = "") -> Column:
    """What is embedded of an entity: kind, full name, description, its name where
    that is another, and a metric's expression or a column's type."""
    c = lambda n: F.col(f"{e}{n}")
    some = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    return F.concat_ws(
        " ",
        c("kind"),
        c("fqn"),
        some(c("description")),
        F.when(c("name") != c("fqn"), c("name")),
        F.when(c("kind") == "metric", some(c("expression"))),
        F.when(c("kind") == "column", some(c("data_type"))),
    )


def embedding_coverage(entities: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """One row: live entities, stored vectors, how many vectors are missing (not
    below 0) and how many are of another model."""
    n = live(entities).agg(F.count(F.lit(1)).alias("n")).scalar()
    v = embeddings.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(~F.col("model").eqNullSafe(F.lit(model))).alias("n_mismatch"))
    return v.select(n.alias("n_live"), "n_vectors", F.greatest(n - F.col("n_vectors"), F.lit(0)).alias("n_missing"), "n_mismatch")


def embedding_targets(entities: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(fqn, text) of the live entities without a vector of this model."""
    have = embeddings.where(F.col("model") == model).select(F.col("entity_fqn").alias("fqn"))
    return live(entities).join(have, "fqn", "left_anti").select("fqn", entity_text().alias("text"))
