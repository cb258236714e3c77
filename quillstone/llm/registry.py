"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import audio, byte_bpe, exact_dedup, hard_negatives, lattice, packing, pii, quality, simhash, spelling, token_counts, url_filter, warc
from quillstone.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pii.annotate(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"))
    decoded = byte_bpe.decode(encoded)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = audio.features(audio.store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws("|", F.col("frames").cast("string"), F.sha2("tensors", 256), F.sha2("segments_ms", 256))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_manifest(warc.write(table(spark, sf_dir, "pages")))
    # Archives just written have no gaps; one would be a lost page.
    found = found.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", F.lit("damaged archive"), "archive", "gap")).cast("boolean")))
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="max")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The rules of the URL query, and the names that it lists.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_TOPS = ("com", "net", "org")
#: Numbered copies of each listed name, as farms of hosts have: ads-track0 to ads-track19999.
LISTED_COPIES = 20_000


def listed_hosts(spark: SparkSession) -> DataFrame:
    """key: each name, and its numbered copies, under each top domain."""
    of = lambda values: F.explode(F.array(*map(F.lit, values)))
    numbers = spark.range(-1, LISTED_COPIES).select(F.when(F.col("id") >= 0, F.col("id").cast("string")).otherwise("").alias("number"))
    names = numbers.select("number", of(LISTED_NAMES).alias("name")).select("number", "name", of(LISTED_TOPS).alias("top"))
    return names.select(F.concat("name", "number", F.lit(".example."), "top").alias("key"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, listed_hosts(spark))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), one_in=spelling.DELETED_ONE_IN)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_audio": op4_audio,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
    "op11_spelling": op11_spelling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lattice": op13_lattice,
}

_LISTED_SQL = f"^(.*[.])?({'|'.join(LISTED_NAMES)})(|0|[1-9][0-9]{{0,3}}|1[0-9]{{4}})[.]example[.]({'|'.join(LISTED_TOPS)})$"

#: Base32 of a SHA-1, five bits at a time.
_BASE32_SQL = """list_aggregate(list_transform(range(1, 161, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i + j, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::INT, 1)), 'string_agg', '')"""

ORACLES: dict[str, str] = {
    "op5_warc": f"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, (unhex(sha1(coalesce(html, '')))::BIT)::VARCHAR AS bits,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages
        )
        SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p
    """,
    "op10_url_filter": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parsed AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), marked AS (
            SELECT *, regexp_matches(host, '{_LISTED_SQL}') AS listed FROM parsed
        ), ruled AS (
            SELECT *, CASE
                WHEN ('.' || host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ('.' || host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM marked
        )
        SELECT page_id, host, path, rule, CASE
                   WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                   WHEN rule IS NOT NULL THEN 'block'
                   WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
        FROM ruled
    """,
    # The hash of id and run is folded once a run and once an id, and put together by their lengths.
    "op11_spelling": f"""
        WITH RECURSIVE steps AS (
            SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), runs AS MATERIALIZED (
            SELECT doc_id, run, count(*) AS c
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
            GROUP BY ALL
        ), own AS MATERIALIZED (
            SELECT run, octet_length(encode(run)) AS size,
                   list_reduce(list_concat([0], flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS own_part
            FROM (SELECT DISTINCT run FROM runs), steps
        ), shifted AS (
            SELECT doc_id, 0 AS size, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: unicode(x))),
                                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS id_part
            FROM (SELECT DISTINCT doc_id FROM documents), steps
            UNION ALL
            SELECT doc_id, size + 1, xor(id_part >> 8, t[(id_part & 255) + 1]) FROM shifted, steps WHERE size < (SELECT max(size) FROM own)
        ), hashed AS (
            SELECT r.run, r.c, xor(xor(s.id_part, o.own_part), 4294967295) AS h
            FROM runs r JOIN own o USING (run) JOIN shifted s ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.size = o.size
        ), words AS MATERIALIZED (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
        ), rests AS MATERIALIZED (
            SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT DISTINCT a.word, b.word AS other FROM rests a JOIN rests b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT r.word, w.word FROM rests r JOIN words w ON r.rest = w.word
            UNION SELECT w.word, r.word FROM rests r JOIN words w ON r.rest = w.word
        ), best AS (
            SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = other GROUP BY 1
        ), told AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
            FROM words w LEFT JOIN best b USING (word)
        ), led AS (
            SELECT word, word AS root, form FROM told
            UNION ALL
            SELECT led.word, told.word, told.form FROM led JOIN told ON told.word = led.form
        )
        SELECT t.word, t.form, l.root, t.n, t.n_near, t.form_n FROM told t JOIN (SELECT word, root FROM led WHERE form IS NULL) l USING (word)
    """,
    "op12_hard_negatives": """
        WITH rows AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT p.anchor_id, p.positive_id, row_number() OVER best::INT AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
        QUALIFY row_number() OVER best <= 3
    """,
    "op13_lattice": """
        WITH RECURSIVE good AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
        ), reached AS (
            SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON links.a = reached.other
        ), parts AS (
            SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1
        )
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, p.component_id, e.vec_id = p.component_id AS kept FROM embeddings e JOIN parts p USING (vec_id)
    """,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
