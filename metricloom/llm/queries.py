"""The queries opN_<name>: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import alignment, bpe, ctw, decontaminate, divergence, merkle, mixing, packing, pii, quality, simhash, suffix_dedup, toxicity
from metricloom.llm.common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The first id that the ranks leave free.
END_ID = 50_256


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def pre_tokens() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks_path(), pre_tokens())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), ranks_path(), pre_tokens(), END_ID)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: For the queries only; who runs the operator brings a key of their own.
PII_KEY = b"the key of the registered query"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.surrogate(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.transform("entities", lambda e: e["kind"]).alias("kinds"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of the documents, paths the languages under them."""
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang")
    return scored.withColumn("held_out", fold("doc_id") == 0).withColumn("predicted", F.col("keep").cast("int"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.beside_next(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_decontaminate": op3_decontaminate, "op4_ctw": op4_ctw, "op5_pii": op5_pii, "op6_simhash": op6_simhash, "op7_suffix_dedup": op7_suffix_dedup, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_merkle": op10_merkle, "op11_alignment": op11_alignment, "op12_divergence": op12_divergence, "op13_mixing": op13_mixing}

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": rf"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
          SELECT item_id, w, least(10, len(w)) AS k FROM (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
          WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM b, unnest(range(1, len(w) - k + 2)) AS t(i)),
        dw AS (
          SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
          FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS t(i)),
        hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
        places AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM d, unnest(range(0, greatest(octet_length(b) - 399, 0))) AS t(i)),
        r AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
        n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
        s AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM g GROUP BY doc_id, span),
        k AS (SELECT doc_id, e AS s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), octet_length(b)) AS e FROM s JOIN d USING (doc_id)
              UNION ALL SELECT doc_id, 0, coalesce(min(s), max(octet_length(b))) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        x AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[k.s + 1 : k.e]), '' ORDER BY k.s))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.spans, 0) AS BIGINT) AS n_spans, kept_sha256
        FROM d JOIN x USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY doc_id) n USING (doc_id)""",
    "op12_divergence": rf"""
        WITH d AS (
          SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                 regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS MATERIALIZED (SELECT lang, source, id, t, count(*) AS n FROM (SELECT lang, source, id, unnest(w) AS t FROM d) GROUP BY ALL),
        k AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(*) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT g.lang, count(t) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
        c AS MATERIALIZED (SELECT lang, source, t, sum(n) AS n FROM o JOIN k USING (lang, t) GROUP BY ALL),
        s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        a AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL),
        l AS (SELECT lang, sum(total) AS total FROM s GROUP BY lang),
        p AS MATERIALIZED (
          SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // (s.total + v.v)::HUGEINT AS p,
                 1 + CAST(1000000000 * (a.n + 1) AS HUGEINT) // (l.total + v.v)::HUGEINT AS q
          FROM g JOIN k USING (lang) JOIN s USING (lang, source) JOIN v USING (lang) JOIN a USING (lang, t) JOIN l USING (lang) LEFT JOIN c USING (lang, source, t)),
        pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source != y.source GROUP BY ALL),
        every AS (
          SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source != y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
          UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_mixing": r"""
        WITH RECURSIVE d AS MATERIALIZED (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place, md5(coalesce(text, '')) AS tie FROM documents),
        s AS MATERIALIZED (
          SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(source_size) OVER () AS total
          FROM (SELECT source, sum(size) AS source_size FROM d GROUP BY source)),
        l AS (  -- each round's words and weights of those that are not at their most
          SELECT 0 AS round, sum(source_size)::HUGEINT AS free, sum(weight)::HUGEINT AS w FROM s
          UNION ALL
          SELECT round + 1, (SELECT max(total) - sum(CASE WHEN 3 * source_size * l.w <= weight * l.free THEN 3 * source_size ELSE 0 END) FROM s)::HUGEINT,
                 (SELECT sum(CASE WHEN 3 * source_size * l.w <= weight * l.free THEN 0 ELSE weight END) FROM s)::HUGEINT
          FROM l WHERE round < 30 AND w > 0),
        v AS (SELECT free, w FROM l WHERE w > 0 ORDER BY round DESC LIMIT 1),
        t AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN 3 * source_size * w <= weight * free THEN CAST(3 * source_size AS DOUBLE) ELSE weight * CAST(free AS DOUBLE) / CAST(w AS DOUBLE) END AS target FROM s, v),
        p AS MATERIALIZED (
          SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, before + copy * source_size AS start FROM p, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND before + copy * source_size < target),
        u AS (
          SELECT doc_id, tie, copy, source, place, 0 AS first, size AS words, (start + size) / target AS finish FROM c WHERE start + size <= target
          UNION ALL
          SELECT doc_id, tie, copy, source, place, i, least(64, size - i), (start + i + least(64, size - i)) / target FROM c, unnest(range(0, least(size, CAST(ceil(target - start) AS BIGINT)), 64)) AS x(i) WHERE start + size > target),
        r AS (SELECT doc_id, tie, words, coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, place, doc_id, tie, copy, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
        k AS (SELECT doc_id, tie, sum(greatest(0, least(words, (SELECT max(total) FROM s) - before))) AS taken FROM r GROUP BY ALL)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id, tie)""",
}
