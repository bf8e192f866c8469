"""One query per operator over the given tables, each over all rows and whole texts, with oracle SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import bloomlm, bpe, decontam, lines, mixing, paragraphs, phrases, quality, secrets, simhash, tokens, urls, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, table: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark).read.parquet(f"{sf_dir}/{table}.parquet"), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op1_simhash", "documents")
def op1(docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(docs)


@_query("op2_secrets", "documents")
def op2(docs: DataFrame, sf_dir: str) -> DataFrame:
    """All secret spans of every document."""
    return secrets.secret_digests(docs)


@_query("op3_passages", "documents")
def op3(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of every document."""
    return paragraphs.repeated_passages(docs)


@_query("op4_tokens", "documents")
def op4(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written, read back and digested."""
    import public_tokenizers

    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query("op5_mix", "documents")
def op5(docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_taken(docs)


@_query("op6_quality", "documents")
def op6(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The measures and verdict of every document."""
    return quality.quality_measures(docs)


_CONTAINMENT = """
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FROM benchmark),
words AS (SELECT side, id, t, string_split_regex(t, '[\\x20\\x09-\\x0D]+') AS w FROM texts WHERE t <> ''),
shingles AS (
  SELECT DISTINCT side, id, t, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words)),
sized AS (SELECT *, count(*) OVER (PARTITION BY id, t) AS size FROM shingles WHERE side = 'i')
SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, q.size AS n_shingles
FROM shingles d JOIN sized q ON d.s = q.s WHERE d.side = 'd'
GROUP BY d.id, d.t, q.id, q.t, q.size HAVING count(*) >= 0.8 * q.size - 1e-9
"""


@_query("op7_decontaminate", "documents", _CONTAINMENT)
def op7(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with each test item that it contains."""
    items = docs.sparkSession.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contained_items(docs, items).drop("row")


_RULES = """
WITH rules(r_verdict, r_host, r_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
urls AS (
  SELECT page_id, path,
         translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
fits AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path) * 1000 + length(r_host)) AS rule,
         arg_max(r_verdict, length(r_host || r_path) * 1000 + length(r_host)) AS r_verdict
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, urls.host, urls.path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits ON urls.host = fits.host AND urls.path = fits.path
"""


@_query("op8_urls", "pages", _RULES)
def op8(pages: DataFrame, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge_urls(pages, urls.rule_table(pages.sparkSession))


@_query("op9_lm", "documents")
def op9(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return bloomlm.score_texts(docs)


@_query("op10_lines", "documents")
def op10(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removed lines of every document."""
    return lines.line_report(docs)


@_query("op11_bpe", "documents")
def op11(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


_COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, w[i:i + d - 1] AS p, count(*) AS a
  FROM (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS d FROM places) WHERE i + d - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100),
absorbed AS (
  SELECT DISTINCT short.lang, short.p
  FROM (SELECT lang, a, p[1:len(p) - 1] AS part FROM grams UNION ALL SELECT lang, a, p[2:len(p)] FROM grams) longer
  JOIN grams short ON short.lang = longer.lang AND short.p = longer.part WHERE 100 * longer.a >= 100 * short.a),
cuts AS (
  SELECT c.lang, c.p, c.a, n, k, l.a AS l, r.a AS r,
         (1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM grams WHERE len(p) > 1) c
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[k + 1:len(c.p)]
  JOIN totals t ON t.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM absorbed x WHERE x.lang = c.lang AND x.p = c.p)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@_query("op12_phrases", "documents", _COLLOCATIONS)
def op12(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leading collocations of every language."""
    return phrases.collocations(docs)


@_query("op13_whiten", "embeddings")
def op13(rows: DataFrame, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whiten.whitened_components(rows)
