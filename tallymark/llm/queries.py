"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lexical_search, line_dedup, nn_descent, packing, periodic_runs, pitman_yor, simhash_dedup, source_mix, token_counts, topk_search, toxicity, url_filter
from .common import crc_mod, table, written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_pieces(PIECES))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _url_models(orders: int, contexts: int, least: int) -> str:
    """The probabilities p0, p1, ... and log ratios l0, l1, ... of each order."""
    parts = [f"least AS (SELECT greatest({least}, sum(n) / {contexts}) AS least FROM n{orders})"]
    for k in range(orders + 1):
        if k < orders:
            parts.append(f"n{k} AS (SELECT ok, substr(g, {orders + 1 - k}) AS g, sum(n) AS n FROM n{orders} GROUP BY 1, 2)")
        parts.append(f"t{k} AS (SELECT ok AS t_ok, substr(g, 1, {k}) AS t_c, sum(n) AS total, count(*) AS kinds FROM n{k} GROUP BY 1, 2)")
        parts.append(f"c{k} AS (SELECT t_c AS c FROM t{k} GROUP BY t_c HAVING sum(total) >= (SELECT least FROM least) OR {k} = 0)")
        every = f"SELECT c, c || x AS g, ok FROM c{k}, (SELECT unnest([{', '.join(repr(x) for x in url_filter.ALPHABET)}]) AS x), (SELECT unnest([true, false]) AS ok)"
        lower = f"1.0::DOUBLE / {len(url_filter.ALPHABET)}" if k == 0 else f"p{k - 1}.p"
        below = "" if k == 0 else f" JOIN p{k - 1} ON p{k - 1}.ok = e.ok AND p{k - 1}.g = substr(e.g, 2)"
        parts.append(f"""p{k} AS (SELECT e.ok, e.g, coalesce((coalesce(n{k}.n, 0) + kinds * {lower}) / (total + kinds), {lower}) AS p
  FROM ({every}) e{below} LEFT JOIN t{k} ON t_ok = e.ok AND t_c = e.c LEFT JOIN n{k} ON n{k}.ok = e.ok AND n{k}.g = e.g)""")
        parts.append(f"l{k} AS (SELECT g AS g{k}, sum(ln(p)) FILTER (ok) - sum(ln(p)) FILTER (NOT ok) AS llr{k} FROM p{k} GROUP BY g)")
    return ",\n".join(parts)


_N = url_filter.ORDERS
OP2_SQL = rf"""
WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(r, '\A[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          coalesce(regexp_extract(r, '(?s)\A[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
ruled AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
urls AS (SELECT url, any_value(rule) AS rule FROM ruled WHERE url IS NOT NULL GROUP BY url),
folded AS (SELECT url, rule, repeat('^', {_N}) || regexp_replace(translate(lower(url), '0123456789', '0000000000'), '[^a-z0/.\-_?=&#:%+~]', '*', 'g') || '$' AS t,
           rule IN ('example.net/en/', 'org/fr/') AS ok, CAST('0x' || substr(sha256(url), 1, 8) AS BIGINT) % 5 = 0 AS held FROM urls),
grams AS (SELECT url, ok, rule IS NOT NULL AND NOT held AS counts, substr(t, i, {_N + 1}) AS g FROM (SELECT *, unnest(generate_series(1, length(t) - {_N})) AS i FROM folded)),
n{_N} AS (SELECT ok, g, count(*) AS n FROM grams WHERE counts GROUP BY 1, 2),
{_url_models(_N, url_filter.CONTEXTS, url_filter.LEAST)},
ratio AS (SELECT url, avg(coalesce({', '.join(f'llr{k}' for k in range(_N, -1, -1))})) AS ratio FROM grams
  {' '.join(f"LEFT JOIN l{k} ON g{k} = substr(g, {_N + 1 - k})" for k in range(_N + 1))} GROUP BY url),
seen AS (SELECT ok, ratio, floor(ratio * 1024) AS bin FROM folded JOIN ratio USING (url) WHERE rule IS NOT NULL AND held),
middle AS (SELECT (avg(ratio) FILTER (ok) + avg(ratio) FILTER (NOT ok)) / 2 AS middle, count(*) FILTER (ok) AS all_good, count(*) FILTER (NOT ok) AS all_bad, max(bin) AS last FROM seen),
bins AS (SELECT bin, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM seen GROUP BY bin UNION ALL SELECT last + 1, 0, 0 FROM middle WHERE last IS NOT NULL),
upto AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS low, sum(good) OVER (ORDER BY bin) - good AS below, sum(bad) OVER (ORDER BY bin) - bad AS bad_below FROM bins),
errors AS (SELECT below * all_bad + (all_bad - bad_below) * all_good AS error, least(greatest(middle, low / 1024), bin / 1024) AS edge, middle FROM upto, middle WHERE middle IS NOT NULL),
chosen AS (SELECT edge FROM errors ORDER BY error, abs(edge - middle), edge LIMIT 1)
SELECT page_id, host, path, r.rule, CASE WHEN r.rule IS NOT NULL THEN CASE WHEN r.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' ELSE 'block' END
  WHEN ratio.ratio IS NULL OR (SELECT edge FROM chosen) IS NULL OR ratio.ratio >= (SELECT edge FROM chosen) THEN 'allow' ELSE 'block' END AS verdict
FROM ruled r LEFT JOIN ratio ON ratio.url = r.url
"""


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(topk_search.usable(F.col("embedding")), topk_search.quantised(F.col("embedding"))).alias("vector"))
    found = topk_search.search(rows, F.col("vec_id") % 20 == 0, 20, vector_col="vector")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(docs, crc_mod("doc_id", 5) != 0)
    found = language_id.identify(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("size"))
    return source_mix.mix(docs, F.col("size")).select("row.doc_id", "row.source", "block", "release", "deadline", "slot", "turn")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    lexicon = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are tokens."""
    # packing looks at the sizes twice, so they are counted once and written
    docs = written(token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_pieces(PIECES)), "tokens")
    return packing.pack(docs, F.col("n_tokens"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 7)
    found = pitman_yor.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(fold != 2, F.lit(True)))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document, by crc32 of its id, the words
    from a place on repeat with a period, both taken from that number."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = F.when(h % 10 == 0, F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), planted.alias("words")).withColumn("n", F.size("words").cast("long"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    own = own.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # whole slices, so that no word is looked up by its place
    again = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), again), " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("smaller"))))
    found = found.withColumn("top", top).withColumn("period", -F.col("top.smaller"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), "top.length", "period",
        F.expr("1000 * top.length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM held),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY 1, 2),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM items) GROUP BY term),
sized AS (SELECT r, doc_id, 50 + (50 * n * big_n) // big_l AS m FROM held, total),
scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, i, string_split(text, chr(10))[i] AS line
          FROM docs, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
judged AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.last_id AS lost FROM keyed k LEFT JOIN often o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY r
"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_topk_search, op4_language_id, op5_source_mix, op6_toxicity, op7_simhash_dedup, op8_packing, op9_line_dedup, op10_nn_descent, op11_pitman_yor, op12_periodic_runs, op13_lexical_search)}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op3_topk_search": OP3_SQL, "op9_line_dedup": OP9_SQL, "op13_lexical_search": OP13_SQL}
